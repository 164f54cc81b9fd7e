"""Mixing sources to target weights (problem 9).

Slot i of the mixture has the golden-ratio point frac((i + 1/2) * phi); the source whose interval of cumulative weights holds it
fills the slot. A source's slots are ranked, and its k-th slot takes its k-th block: its documents, shuffled anew for
each repetition, laid end to end and cut into blocks of equal tokens (a document belongs to the block in which it begins).

How large the mixture is: ``total_tokens``, or else as large as every source can keep its share of, but never less than
``least_use`` of the tokens there are. A source that runs out before (its tokens times its ``max_repeats``) gives all it has, and
the others take over what it lacks in proportion to their targets; so a tiny source cannot shrink the mixture, and the report
shows the shares that were reached.

Defined results: documents without tokens and documents whose source is null or has no target are not used; a source
without documents is reported with share 0 and its target goes to the others in proportion; null or non-positive targets count
as 0, a null ``max_repeats`` as 1. Repeated rows of one document count once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import sharded_position
from ..runtime import cut, table
from .containers import document_sizes
from .tokens import TOKENIZER_FILE

#: Fixed value: the fractional part of the golden ratio.
GOLDEN = (math.sqrt(5) - 1) / 2


def schedule(spark, weights: list[float], n_slots: int) -> DataFrame:
    """(slot, source_no) of the low-discrepancy schedule."""
    edge, cum = [], 0.0
    for w in weights:
        cum += w
        edge.append(cum)
    u = F.pmod((F.col("id") + 0.5) * F.lit(GOLDEN), F.lit(1.0))
    src = F.lit(len(weights) - 1)
    for k in range(len(weights) - 2, -1, -1):
        src = F.when(u < F.lit(edge[k] / cum), F.lit(k)).otherwise(src)
    return spark.range(n_slots).select(F.col("id").alias("slot"), src.cast("int").alias("source_no"))


def quotas(caps: list[float], weights: list[float], size: float) -> list[float]:
    """Tokens of each source in a mixture of ``size``: in proportion to the weights, at most its cap; what a source lacks goes to the others."""
    out, left, open_ = [0.0] * len(caps), size, set(range(len(caps)))
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if caps[i] <= left * weights[i] / total}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = caps[i]
        left -= sum(caps[i] for i in full)
        open_ -= full
    return out


def plan_mixture(supply: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], block_tokens: int | None = None, total_tokens: int | None = None, least_use: float = 0.5, least_blocks: int = 4096, most_block: int = 65_536) -> tuple[list[str], list[float], int, int]:
    """Sources, weights, number of slots and tokens of a block; supply: source -> (tokens, documents).

    A block is a ``least_blocks``-th of the mixture, but never more than ``most_block`` tokens, so that sources alternate finely at any size.
    """
    have = [s for s in sorted(targets) if targets[s][0] > 0 and supply.get(s, (0, 0))[0] > 0]
    if not have:
        return [], [], 0, 1
    total_w = sum(targets[s][0] for s in have)
    w = [targets[s][0] / total_w for s in have]
    cap = [float(supply[s][0] * targets[s][1]) for s in have]
    size = total_tokens or max(min(c / x for c, x in zip(cap, w)), least_use * sum(supply[s][0] for s in have))
    q = quotas(cap, w, size)
    b = block_tokens or min(most_block, max(1, math.ceil(sum(q) / least_blocks)))
    return have, [x / sum(q) for x in q], max(1, math.ceil(sum(q) / b)), b


def mixture(sizes: DataFrame, targets: DataFrame, block_tokens: int | None = None, total_tokens: int | None = None, least_use: float = 0.5, seed: int = 11) -> DataFrame:
    """(slot, source, repeat_no, doc_id, n_tokens, block_start): the documents of the mixture in slot order.

    ``sizes``: doc_id, source, n_tokens. Only the sums by source, of which there are as many as targets, reach the
    driver. Ranks and running sums are sharded, so a source with a third of all documents is no single task.
    """
    spark = sizes.sparkSession
    t = {r["source"]: (max(0.0, r["target_share"] or 0.0), max(1, r["max_repeats"] or 1)) for r in targets.filter(F.col("source").isNotNull()).collect()}
    docs = sizes.filter((F.col("n_tokens") > 0) & F.col("source").isin(list(t))).select("doc_id", "source", "n_tokens")
    docs = docs.groupBy("doc_id").agg(F.min_by("source", F.struct("source", "n_tokens")).alias("source"), F.min_by("n_tokens", F.struct("source", "n_tokens")).alias("n_tokens"))
    docs = cut(docs)
    supply = {r["source"]: (int(r["t"]), int(r["k"])) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k")).collect()}
    have, w, slots, b = plan_mixture(supply, t, block_tokens, total_tokens, least_use)
    if not have:
        return docs.limit(0).select(F.lit(0).cast("bigint").alias("slot"), "source", F.lit(0).alias("repeat_no"), "doc_id", "n_tokens", F.lit(0).cast("bigint").alias("block_start"))
    # the schedule's count of a source differs from its share by less than 3 + log2 of the slots
    info = [(s, k, supply[s][0], min(t[s][1], math.ceil((slots * w[k] + 3 + math.log2(slots + 1)) * b / supply[s][0]))) for k, s in enumerate(have)]
    per_source = F.broadcast(spark.createDataFrame(info, "source string, source_no int, supply bigint, passes int"))  # one row per target
    copies = docs.join(per_source, "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    placed = sharded_position(copies, ["source_no", "repeat_no"], F.xxhash64("doc_id", "repeat_no", F.lit(seed)), ["doc_id"], value="n_tokens", rank="_r", total="_before")
    placed = placed.withColumn("block_start", F.col("repeat_no") * F.col("supply") + F.col("_before")).withColumn("block_no", F.floor(F.col("block_start") / F.lit(b)).cast("bigint"))
    s = schedule(spark, w, slots)
    ranked = sharded_position(s, ["source_no"], F.shiftleft(F.col("slot"), 63 - max(1, slots.bit_length())), ["slot"], rank="block_no")
    return ranked.join(placed, ["source_no", "block_no"]).select("slot", "source", F.col("repeat_no").cast("int").alias("repeat_no"), "doc_id", "n_tokens", "block_start")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats, max_repeats) of every target."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    per = per_doc.groupBy("source").agg(F.sum("t").alias("tokens"), F.count("*").alias("documents"), F.max("k").alias("most_repeats"))
    per = per.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))  # no more rows than targets
    return (
        targets.filter(F.col("source").isNotNull())
        .join(per, "source", "left")
        .select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats")
    )


def p9_mixture(spark, d, tokenizer_file: str = TOKENIZER_FILE):
    return mixture(document_sizes(table(spark, d, "documents"), tokenizer_file), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    return share_report(p9_mixture(spark, d), table(spark, d, "mix_targets"))
