"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.segment import load_bpe

#: Where the vocabularies of the public tokenizers lie; a parameter of every operator that sizes texts.
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

_cache: dict[int, object] = {}


def encoder(ranks: bytes):
    """The tokenizer of a rank file's bytes, made once in each worker process."""
    k = hash(ranks)
    if k not in _cache:
        _cache[k] = load_bpe(ranks)
    return _cache[k]


def token_sizes(df: DataFrame, text: str, keep: list[str], out: str = "n_tokens", tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """The columns ``keep`` and the token count of ``text``; a null text has 0 tokens.

    The rank file (under 1 MB) is read by the driver and sent along, so that executors need no copy of it.
    """
    ranks = df.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_bytes())
    schema = df.select(*keep).schema.add(out, "long")

    def sizes(batches):
        enc = encoder(ranks.value)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            n = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, out])

    return df.select(*keep, df[text].alias("_text")).mapInArrow(sizes, schema)
