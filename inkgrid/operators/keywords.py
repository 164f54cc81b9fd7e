"""Keyword phrases by word degree and frequency."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T

_CUT = re.compile(r"[.!?;\n,]")
_WORDS = re.compile(f"[{T.WHITE_SPACE}]+")
_EDGES = regex.compile(r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$")


def phrases_of(text: str, stops: frozenset[str] = frozenset()) -> list[list[str]]:
    """The phrases of a text in order.

    Sentences end at . ! ? ; , and line feeds. Words lose punctuation and symbols at their ends and capitals; empty ones are skipped
    without ending a phrase; a stop word (given, or of at most two bytes) ends it.
    """
    out: list[list[str]] = []
    for sentence in _CUT.split(text):
        phrase: list[str] = []
        for w in _WORDS.split(sentence):
            if not w.isalnum():
                w = _EDGES.sub("", w)
            w = w.lower()
            if not w:
                continue
            if w in stops or (len(w) <= 2 and len(w.encode("utf-8", "surrogatepass")) <= 2):
                if phrase:
                    out.append(phrase)
                    phrase = []
            else:
                phrase.append(w)
        if phrase:
            out.append(phrase)
    return out


def candidate_phrases(c: Column, stop_words: Sequence[str] = ()) -> Column:
    """array<array<word>> of :func:`phrases_of`, in Arrow batches; none for a null text."""
    stops = frozenset(stop_words)

    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda t: phrases_of(t, stops) if t else [])

    return of(c)


def scores_of(phrases: list[list[str]]) -> dict[str, float]:
    """(degree + frequency) / frequency of each word; the degree sums the other words of its phrases."""
    freq: dict[str, int] = {}
    degree: dict[str, int] = {}
    for p in phrases:
        for w in p:
            freq[w] = freq.get(w, 0) + 1
            degree[w] = degree.get(w, 0) + len(p) - 1
    return {w: (degree[w] + n) / n for w, n in freq.items()}


def phrase_rows(df: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str] = ()) -> DataFrame:
    """(id, phrase_no, words): one row for each occurrence of a phrase."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(candidate_phrases(F.col(f"`{text_col}`"), stop_words)).alias("phrase_no", "words"))


def word_scores(phrases: DataFrame) -> DataFrame:
    """(id, word, freq, degree, score): degree sums the other words of the phrases that a word is in; score is (degree + freq) / freq."""
    w = phrases.select("id", F.explode("words").alias("word"), (F.size("words") - 1).alias("d"))
    g = w.groupBy("id", "word").agg(F.count("*").alias("freq"), F.sum("d").alias("degree"))
    return g.withColumn("score", (F.col("degree") + F.col("freq")) / F.col("freq"))


def top_keywords(df: DataFrame, id_col: str, text_col: str, top_n: int = 8, stop_words: Sequence[str] = ()) -> DataFrame:
    """(id, rank, keyword, score): the top_n distinct phrases of each text, ties by phrase. Nothing for top_n <= 0, null and blank texts.

    A text is cut, counted and ranked where it lies, so nothing is shuffled; every row is a text of its own.
    """
    stops = frozenset(stop_words)
    d = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def rank(batches):
        for b in batches:
            at, ranks, words, scores = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t or top_n <= 0:
                    continue
                phrases = phrases_of(t, stops)
                score = scores_of(phrases)
                found = {" ".join(p): sum(score[w] for w in p) for p in phrases}
                for k, (p, v) in enumerate(sorted(found.items(), key=lambda x: (-round(x[1], 9), x[0]))[:top_n], 1):
                    at.append(i)
                    ranks.append(k)
                    words.append(p)
                    scores.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(ranks, pa.int32()), pa.array(words, pa.string()), pa.array(scores, pa.float64())], names=["id", "rank", "keyword", "score"])

    return d.mapInArrow(rank, f"id {dict(d.dtypes)['id']}, rank int, keyword string, score double")
