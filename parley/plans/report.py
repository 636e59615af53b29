"""The report: keywords per community and controversial against other comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.controversy import (
    controversy_rate_by_subreddit,
    controversy_stats,
    differential_keywords,
    keyword_comparison,
    rank_differential,
    stats_long,
    with_comment_length,
)
from parley.operators.filters import analysis_rows
from parley.operators.keywords import compute_tfidf, rank_tfidf
from parley.operators.wordpass import comments_with_word, rates, side_statistics, word_pass, words_by_side
from parley.plans.storage import written
from parley.sources.comments import require_columns, with_body
from parley.sources.ids import with_stable_ids
from parley.sources.publish import publish
from parley.sources.sinks import write_table


def _figures(rows: DataFrame, text_column: str) -> DataFrame:
    """What the report needs besides the words: a few numbers per comment."""
    return with_comment_length(rows, text_column).select(
        "id", "subreddit", "controversiality", "score", "comment_length"
    )


def analyze(
    comments: DataFrame,
    text_column: str = "body",
    sample_size: int | None = None,
    figures: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Controversy tables: one-row statistics, rates per community, telling words of both sides."""
    figures = _figures(comments, text_column) if figures is None else figures
    rates = controversy_rate_by_subreddit(figures).select("subreddit", "controversy_rate")
    return {
        "controversy_stats": controversy_stats(figures),
        "subreddit_controversy_rates": rates.orderBy(F.desc_nulls_last("controversy_rate"), "subreddit"),
        "differential_keywords": differential_keywords(comments, text_column, sample_size, keys=figures),
    }


def build_report(
    comments: DataFrame, top_n: int = 20, sample_size: int | None = None, stage: bool = False
) -> dict[str, DataFrame]:
    """The four tables of the report, all lazy.

    With ``stage`` one job first counts all words and figures to the shared folder, and the tables are roll-ups of these
    counts: the text is read once instead of six times. With a ``sample_size`` the staged table has the figures of
    the comments, and the words are read from the text. A sample of a table without ids numbers the rows by their content.
    """
    rows = analysis_rows(require_columns(with_body(comments)))
    if stage and sample_size is None:
        return report_of_counts(written(word_pass(rows), "report-words"), top_n)
    if "id" not in rows.columns:
        # Ids matter to a sample only; there they have to be the same in every table that reads them.
        rows = with_stable_ids(rows) if sample_size is not None else rows.withColumn("id", F.monotonically_increasing_id())
    figures = written(_figures(rows, "body"), "report-figures") if stage else None
    controversy = analyze(rows, sample_size=sample_size, figures=figures)
    return {
        "tfidf_keywords": compute_tfidf(rows, top_n=top_n),
        "controversy_stats": stats_long(controversy["controversy_stats"]),
        "subreddit_controversy_rates": controversy["subreddit_controversy_rates"],
        "keyword_comparison": keyword_comparison(controversy["differential_keywords"]),
    }


def report_of_counts(counted: DataFrame, top_n: int = 20) -> dict[str, DataFrame]:
    """The four tables from what ``word_pass`` counted."""
    rates_ = rates(counted).select("subreddit", "controversy_rate")
    return {
        "tfidf_keywords": rank_tfidf(comments_with_word(counted), top_n),
        "controversy_stats": stats_long(side_statistics(counted)),
        "subreddit_controversy_rates": rates_.orderBy(F.desc_nulls_last("controversy_rate"), "subreddit"),
        "keyword_comparison": keyword_comparison(rank_differential(words_by_side(counted))),
    }


def write_report(report: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    for name, df in report.items():
        write_table(df, f"{path.rstrip('/')}/{name}", fmt)


def publish_report(report: dict[str, DataFrame], path: str, fmt: str = "csv") -> str:
    """Publish the tables together: readers of ``sources.publish`` see the old report until the new one is whole."""
    return publish(report, path, fmt)
