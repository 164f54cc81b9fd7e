"""Lines and pages of extracted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def split_pages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, page, text): the lines of each text; a form feed begins a page.

    Fragments that a form feed leaves blank are dropped; blank lines without one stay, as they end paragraphs. The page is one
    more than the form feeds before the line. All is done inside the row, so nothing is shuffled.
    """
    pages = F.split(F.col(f"`{text_col}`"), "\f", -1)

    def lines_of(p: Column, i: Column) -> Column:
        ls = F.split(p, "\n", -1)

        def keep(x: Column, k: Column) -> Column:
            torn = ((k == 0) & (i > 0)) | ((k == F.size(ls) - 1) & (i < F.size(pages) - 1))
            return ~(torn & (T.trim_ws(x) == ""))

        return F.transform(F.filter(ls, keep), lambda x: F.struct((i + 1).alias("page"), x.alias("text")))

    rows = F.flatten(F.transform(pages, lines_of))
    d = df.filter(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.posexplode(rows).alias("_k", "_x"))
    return d.select("id", (F.col("_k") + 1).alias("line_no"), F.col("_x.page").alias("page"), F.col("_x.text").alias("text"))


def remove_running_lines(lines: DataFrame) -> DataFrame:
    """Lines without running headers and footers, normalised; blank lines stay (as empty text).

    A trimmed line of 6 to 119 bytes that occurs at least max(pages / 2, 2) times in its document is dropped, if the document has more
    than one page. Occurrences are counted by a partial aggregation and joined back; a document is never gathered in one task.
    """
    d = lines.withColumn("_t", T.trim_ws(F.coalesce("text", F.lit(""))))
    size = F.octet_length("_t")
    counts = d.filter((size > 5) & (size < 120)).groupBy(F.col("document_id").alias("_d"), F.col("_t").alias("_k")).agg(F.count("*").alias("_n"))
    pages = d.groupBy(F.col("document_id").alias("_d")).agg(F.max("page").alias("_pages"))
    often = counts.join(pages, "_d").filter((F.col("_pages") > 1) & (F.col("_n") >= F.greatest(F.floor(F.col("_pages") / 2), F.lit(2)))).select("_d", "_k")
    kept = d.join(often, F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_k")), "left_anti")
    return kept.select("document_id", "line_no", "page", T.collapse_ws(T.strip_control(T.nfkc(F.coalesce("text", F.lit(""))))).alias("text"))


def drop_boilerplate(paragraphs: DataFrame, ratio: float = 0.3) -> DataFrame:
    """Paragraphs (doc_id, para_no, text) without those that repeat within their document.

    Paragraphs of more than 10 trimmed bytes are compared by the hash of their lower-cased collapsed text; all copies of one that
    occurs at least max(int(n * ratio), 2) times go, n being the document's paragraphs. Short ones stay.
    """
    d = paragraphs.withColumn("_h", F.when(F.octet_length(T.trim_ws(F.col("text"))) > 10, T.paragraph_hash(F.col("text"))))
    total = d.groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("_n"))
    many = d.filter(F.col("_h").isNotNull()).groupBy(F.col("doc_id").alias("_d"), F.col("_h").alias("_k")).agg(F.count("*").alias("_c"))
    often = many.join(total, "_d").filter(F.col("_c") >= F.greatest(F.floor(F.col("_n") * F.lit(ratio)), F.lit(2))).select("_d", "_k")
    return d.join(often, (F.col("doc_id") == F.col("_d")) & (F.col("_h") == F.col("_k")), "left_anti").drop("_h")
