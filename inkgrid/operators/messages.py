"""Exactly one delivery of every message of an at-least-once feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UUID = r"^[0-9a-f]{32}$"


def message_key(event_id: Column) -> Column:
    """Canonical identifier: the 32 hex digits of a UUID in any spelling, else the trimmed text.

    Braces, ``urn:uuid:``, hyphens, letter case and surrounding white space do not count. Null,
    empty and blank identifiers give null: such a delivery has no identity to compare.
    """
    t = F.trim(F.regexp_replace(event_id, r"(?U)^\s+|\s+$", ""))
    hexed = F.regexp_replace(F.regexp_replace(F.lower(t), r"^\{|\}$|^urn:uuid:", ""), "-", "")
    return F.when(hexed.rlike(_UUID), hexed).when(F.length(t) > 0, F.concat(F.lit("raw:"), t))


def _order(seq: str, received: str, content: list[str] | None = None) -> list[Column]:
    """The arrival number first (a null one comes last), then the time of receipt, as the fields of a struct that min compares one by one; with ``content`` its hash breaks ties."""
    o = [F.col(seq).isNull().alias("n"), F.col(seq).alias("s"), F.col(received).alias("r")]
    return o + [F.xxhash64(*[F.col(f"`{c}`") for c in content]).alias("h")] if content else o


def first_deliveries(events: DataFrame, id_col: str = "event_id", seq: str = "delivery_seq", received: str = "received_at") -> DataFrame:
    """(message_key, delivery_seq) of the delivery that stays for each message.

    A hash of the key distributes the groups; ``min_by`` combines on the map side, so a message that makes up a
    third of the feed leaves each task as one row. Deliveries without identity are not in the result.
    """
    keyed = events.select(message_key(F.col(id_col)).alias("message_key"), F.col(seq).alias("_seq"), F.struct(*_order(seq, received)).alias("_o")).filter(F.col("message_key").isNotNull())
    return keyed.groupBy("message_key").agg(F.min_by("_seq", "_o").alias(seq), F.count("*").alias("deliveries"))


def keep_one(events: DataFrame, id_col: str = "event_id", seq: str = "delivery_seq", received: str = "received_at", keep_unidentified: bool = True) -> DataFrame:
    """All columns of exactly one delivery of each message.

    The first delivery by ``delivery_seq`` stays; ties (repeated rows with one number) are broken by receipt time and
    then by the row's content, so the result is the same in every run. With ``keep_unidentified`` rows without an
    identifier, undecodable ones among them, pass through: nothing says that they repeat each other. An empty input
    gives an empty output; columns that the caller added are kept, a column named ``message_key`` is overwritten.
    """
    cols = [c for c in events.columns if c != "message_key"]
    o, k, f, n = (next(x for i in range(len(cols) + 1) if (x := f"_{base}{i}") not in cols) for base in ("order", "key", "first", "written"))  # names that the events do not have
    keyed = events.select(*[F.col(f"`{c}`") for c in cols]).withColumn("message_key", message_key(F.col(id_col))).withColumn(o, F.struct(*_order(seq, received, cols)))
    named = keyed.filter(F.col("message_key").isNotNull())
    # numbers only: how often each delivery was written, then the first of each message
    written = named.groupBy("message_key", o).agg(F.count("*").alias(n))
    first = written.groupBy("message_key").agg(F.min(o).alias(f), F.min_by(n, o).alias(n)).withColumnRenamed("message_key", k)
    kept = named.join(first, (F.col("message_key") == F.col(k)) & F.col(o).eqNullSafe(F.col(f)))
    once = kept.filter(F.col(n) == 1).unionByName(kept.filter(F.col(n) > 1).dropDuplicates(["message_key"])).select(*[F.col(f"`{c}`") for c in cols], "message_key")
    if not keep_unidentified:
        return once
    return once.unionByName(keyed.filter(F.col("message_key").isNull()).select(*once.columns))


def repeated_deliveries(events: DataFrame, id_col: str = "event_id", seq: str = "delivery_seq", received: str = "received_at") -> DataFrame:
    """``delivery_seq`` of every delivery that :func:`keep_one` removes.

    The kept numbers are taken away from all identified ones by an anti join on the unique delivery number, not on the
    message: a message with very many deliveries is spread over all tasks. Rows without a delivery number cannot be
    named by it and are left out.
    """
    kept = first_deliveries(events, id_col, seq, received).select(seq)
    named = events.filter(message_key(F.col(id_col)).isNotNull() & F.col(seq).isNotNull()).select(seq)
    return named.join(kept, seq, "left_anti")
