"""Text cleaning, tokens, n-grams, shingles and keyword words as Column expressions.

Whitespace, letters and line ends follow Unicode rules where the rule they implement does, which
in Java's regex dialect has to be spelled out: ``(?d)`` makes ``\\n`` the only line end and
``[\\p{L}\\p{N}_]`` stands for a word character.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.config import KEYWORD_STOP_WORDS, CleanOptions

# --- Fixed values: patterns of the cleaner, in the order they apply -------------------------
QUOTED_LINE = r"(?dm)^>.*$"
TABLE_TEXT = r"(?d)\|.*\|"
TABLE_SEPARATOR = r":?-{2,}:?"
EMPHASIS = r"\*{1,2}[^*]+\*{1,2}"
REPEATED_CHARS = r"(?d)(.)\1\1\1+"
NAMED_ENTITY = r"&[a-zA-Z]+;"
NUMERIC_ENTITY = r"&#x?[0-9a-fA-F]+;?"
BARE_HEX_ENTITY = r"x[0-9a-fA-F]{4}"
URL = r"https?://[!$-_a-z]+"  # one flat class: nested repeats overflow Java's stack on long URLs
MENTION = r"@[\p{L}\p{N}_]+"
# Runs of all but ASCII letters, digits, ' and -; not a single space, which already is what a run becomes.
NOT_PLAIN_TEXT = r" [^\p{Alnum}'\-]+|[^\p{Alnum}'\- ][^\p{Alnum}'\-]*"
# Tokens that carry no meaning: digits only, marks only, any three equal characters in a row.
NOISE_TOKEN = r"^[0-9]+$|^[-*=_|:]+$|(.)\1{2}"
# A keyword is a whole word of 3 to 15 plain lower-case letters.
KEYWORD = r"(?<![\p{L}\p{N}_])[a-z]{3,15}+(?![\p{L}\p{N}_])"
# What a text must hold for a pattern to match: found much faster than the pattern.
NEEDED = {
    TABLE_TEXT: "|",
    TABLE_SEPARATOR: "--",
    EMPHASIS: "*",
    NAMED_ENTITY: "&",
    NUMERIC_ENTITY: "&#",
    URL: "://",
    MENTION: "@",
    " {2,}": "  ",
}
# --- end of the fixed patterns --------------------------------------------------------------


def _in_list(words: Iterable[str]) -> str:
    """SQL list of word literals: one parse, where a literal per word costs hundreds of JVM calls."""
    return "(" + ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in sorted(words)) + ")"


def _replaced(text: Column, pattern: str, replacement: str) -> Column:
    """``regexp_replace``, skipped for texts that lack what the pattern needs."""
    if pattern not in NEEDED:
        return F.regexp_replace(text, pattern, replacement)
    # A lambda, so that the text is computed once, however often the steps refer to it.
    step = lambda t: F.when(F.contains(t, F.lit(NEEDED[pattern])), F.regexp_replace(t, pattern, replacement)).otherwise(t)
    return F.element_at(F.transform(F.array(text), step), 1)


def comment_length(body: Column) -> Column:
    """Length in code points; null for a null body."""
    return F.length(body)


def clean_text(text: Column, options: CleanOptions = CleanOptions()) -> Column:
    """Plain text of a comment: markup, entities, links and mentions gone, single spaces.

    A null text gives an empty string.
    """
    steps = [(QUOTED_LINE, "")]
    steps += [(p, " ") for p in (TABLE_TEXT, TABLE_SEPARATOR, EMPHASIS, REPEATED_CHARS)]
    steps += [(p, " ") for p in (NAMED_ENTITY, NUMERIC_ENTITY, BARE_HEX_ENTITY)]
    if options.remove_urls:
        steps.append((URL, " "))
    if options.remove_mentions:
        steps.append((MENTION, " "))
    for pattern, replacement in steps:
        text = _replaced(text, pattern, replacement)
    if options.lowercase:
        text = F.lower(text)
    # Other characters, all whitespace included, fold into one space, which also collapses runs.
    return F.coalesce(F.trim(F.regexp_replace(text, NOT_PLAIN_TEXT, " ")), F.lit(""))


def clean_again(clean: Column) -> Column:
    """What a second cleaning does to a text that ``clean_text`` gave.

    Such a text has letters, digits, apostrophes, hyphens and single spaces only. All the other
    patterns need a character that is gone by now, so three of them are left to apply.
    """
    for pattern in (TABLE_SEPARATOR, REPEATED_CHARS, BARE_HEX_ENTITY):
        clean = _replaced(clean, pattern, " ")
    return F.trim(_replaced(clean, " {2,}", " "))


def split_tokens(clean: Column, options: CleanOptions = CleanOptions()) -> Column:
    """Tokens of a text that is already clean."""
    tokens = F.split(clean, " ")
    if not options.remove_stopwords:
        return F.filter(tokens, lambda t: t != "")
    meaningful = "length(t) > 1"
    if options.stop_words:
        meaningful += f" AND t NOT IN {_in_list(options.stop_words)}"
    meaningful += f" AND NOT t RLIKE r'{NOISE_TOKEN}'"
    return F.call_function("filter", tokens, F.expr(f"t -> {meaningful}"))


def tokenize(text: Column, options: CleanOptions = CleanOptions()) -> Column:
    """Tokens of any text: cleaned once here, however often it was cleaned before."""
    return split_tokens(clean_text(text, options), options)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, each joined by a space; empty if there are fewer tokens.

    ``tokens`` should be a column of the table: an expression would be computed again per run.
    """
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def ngram_range(tokens: Column, low: int = 1, high: int = 3) -> Column:
    """N-grams of every length from ``low`` to ``high``, shortest first."""
    return F.concat(*[ngrams(tokens, n) for n in range(low, high + 1)])


def split_shingles(clean: Column, k: int = 5) -> Column:
    """Set of ``k``-character pieces of a clean text; a shorter text is its own only piece.

    The lookahead matches at every position without consuming it: one pass over the text, where a
    substring per position would walk the text from its start each time.
    """
    pieces = F.array_distinct(F.regexp_extract_all(clean, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))
    return (
        F.when(F.length(clean) >= k, pieces)
        .when(F.length(clean) > 0, F.array(clean))
        .otherwise(F.array().cast("array<string>"))
    )


def keyword_words(body: Column, stop_words: Iterable[str] = KEYWORD_STOP_WORDS) -> Column:
    """Words that may become keywords, repeats kept; null for a null body."""
    words = F.regexp_extract_all(F.lower(body), F.lit(KEYWORD), F.lit(0))
    if not stop_words:
        return words
    return F.call_function("filter", words, F.expr(f"w -> w NOT IN {_in_list(stop_words)}"))


def staged(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a costly column that is computed once, whatever reads it afterwards.

    A plain ``withColumn`` lets the optimizer copy the expression into every later filter and
    projection. A generator is a barrier to that. It is also a barrier to pushdown: put cheap
    filters before it.
    """
    return df.select("*", F.inline(F.array(F.struct(column.alias(name)))))
