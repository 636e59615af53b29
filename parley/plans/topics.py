"""The topics job: hot n-grams and opinion clusters of a table of comments, sized by a preset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parley.config import preset
from parley.operators.clusters import opinion_clusters
from parley.operators.trends import hot_ngrams


def topic_tables(preprocessed: DataFrame, size: str = "medium", method: str | None = "kmeans") -> dict[str, DataFrame]:
    """``hot_ngrams`` and ``opinion_clusters`` with as many topics and clusters as the preset ``size`` asks for.

    Takes the comments as the preprocessing leaves them, all of them: a preset never limits what is read. Clusters cost several
    passes; without a ``method`` they are left out.
    """
    wanted = preset(size)
    tables = {"hot_ngrams": hot_ngrams(preprocessed, top_k=wanted.top_k)}
    if method:
        tables["opinion_clusters"] = opinion_clusters(preprocessed, k=wanted.num_clusters, method=method)
    return tables
