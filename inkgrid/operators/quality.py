"""Quality scores, gates and document profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed value: the characters taken off a word's ends before it is looked up as a stop word.
STOP_TRIM = ".,!?;:\"'()[]{}"
#: Phrases of legal boilerplate.
LEGAL_PHRASES = ("all rights reserved", "confidential and proprietary")


def stop_ratio(c: Column, stop_words: Sequence[str]) -> Column:
    if not stop_words:
        return F.lit(0.0)
    w = T.words_of(F.lower(T.trim_ws(c)))
    stops = F.array(*[F.lit(s) for s in sorted(set(stop_words))])
    hit = F.filter(w, lambda x: F.array_contains(stops, F.btrim(x, F.lit(STOP_TRIM))))
    return F.when(F.size(w) > 0, F.size(hit) / F.size(w)).otherwise(F.lit(0.0))


def quality_score(c: Column, stop_words: Sequence[str] = ()) -> Column:
    """0 for texts under 20 trimmed bytes or 4 words, 0.1 if few letters, 0.2 if the entropy is unusual, else a weighted sum up to 1.

    All counts come from one pass over the text; a null text scores 0.
    """
    t = T.text_stats(c)
    alpha, h = t["letters"] / t["chars"], t["entropy"]
    return (
        F.when(c.isNull() | (t["octets"] < 20), 0.0)
        .when(t["words"] < 4, 0.0)
        .when(alpha < 0.35, 0.1)
        .when((h < 2.2) | (h > 6.8), 0.2)
        .otherwise(F.least(F.lit(1.0), 0.4 * alpha + 0.4 * stop_ratio(c, stop_words) + 0.2 * (h / 7.0)))
    )


def passes_gate(c: Column) -> Column:
    """The stricter yes-or-no test of chunks; tables of numbers with some words pass early. False for null."""
    t = T.text_stats(c)
    alpha, digit, words, h = t["letters"] / t["chars"], t["digits"] / t["chars"], t["words"], t["entropy"]
    low = F.lower(c)
    legal = F.lit(False)
    for p in LEGAL_PHRASES:
        legal = legal | F.contains(low, F.lit(p))
    return (
        F.when(c.isNull() | (t["octets"] < 20), False)
        .when((digit > 0.4) & (alpha > 0.15), True)
        .when(alpha < 0.35, False)
        .when((h < 2.5) | (h > 6.8), False)
        .when(words < 5, False)
        .when(legal & (words < 15), False)
        .otherwise(True)
    )


def profile(c: Column) -> Column:
    """struct(sentence_count, avg_sentence_len, lexical_diversity, digit_ratio, uppercase_ratio, token_count); zeros for a blank text.

    Sentences are the pieces between full stops, an empty last one among them.
    """
    t = T.text_stats(c)
    n = F.coalesce(t["words"], F.lit(0))
    trimmed = T.trim_ws(c)
    sentences = F.size(F.split(trimmed, r"\.", -1))
    distinct = F.size(F.array_distinct(F.split(F.lower(trimmed), r"(?U)\s+")))
    zero = lambda x, kind: F.when(n == 0, F.lit(0).cast(kind)).otherwise(x.cast(kind))
    return F.struct(
        zero(sentences, "int").alias("sentence_count"),
        zero(n / sentences, "double").alias("avg_sentence_len"),
        zero(distinct / n, "double").alias("lexical_diversity"),
        zero(t["digits"] / t["chars"], "double").alias("digit_ratio"),
        zero(t["uppers"] / t["chars"], "double").alias("uppercase_ratio"),
        zero(n, "int").alias("token_count"),
    )


def with_profile(df: DataFrame, text_col: str) -> DataFrame:
    p = profile(F.col(f"`{text_col}`"))
    return df.withColumn("_p", p).select(*df.columns, "_p.*")
