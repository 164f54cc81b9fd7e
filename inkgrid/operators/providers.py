"""Pluggable models with deterministic local defaults: tokenizer, embedder, language, entities, extractor.

A provider is a function on a batch (list in, list out). Registered ones are called in Arrow batches; failures are retried with a linear pause
and then fail the task, which Spark retries.
"""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pdf import pdf_text

# Frequent function words by language, for the default language provider.
FUNCTION_WORDS = {
    "en": "the of and to in is was for that with on by not this from or are",
    "de": "der die das und in den zu mit von für ist auf nicht ein eine am",
    "fr": "le la les des et du en une est pour que dans par sur pas au",
    "es": "el la los las de y en que un una por con para del se al",
    "pt": "o a os as de e em que um uma por com para do da não",
    "it": "il la le di e in che un una per con non del della gli",
    "nl": "de het een van en in is dat op te voor met niet zijn",
}
_SCRIPTS = [("ja", r"[\p{Hiragana}\p{Katakana}]"), ("zh", r"\p{Han}"), ("ko", r"\p{Hangul}"), ("ru", r"\p{Cyrillic}"), ("ar", r"\p{Arabic}"), ("hi", r"\p{Devanagari}"), ("th", r"\p{Thai}"), ("el", r"\p{Greek}"), ("he", r"\p{Hebrew}")]


def default_tokens(texts: list[str]) -> list[int]:
    return [len(t.split()) for t in texts]


def default_embedding(texts: list[str], dimensions: int = 64) -> list[list[float]]:
    """Signed feature hashing of words, of unit length: the same text has the same vector everywhere."""
    out = []
    known: dict[str, tuple[int, float]] = {}
    for t in texts:
        v = [0.0] * dimensions
        for w in t.lower().split():
            if w not in known:
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                known[w] = (h % dimensions, 1.0 if h >> 63 else -1.0)
            i, sign = known[w]
            v[i] += sign
        v = np.array(v)
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype(np.float32).tolist())
    return out


def default_language(texts: list[str]) -> list[str]:
    """By script, then by function words; ``en`` where nothing is known."""
    words = {k: set(v.split()) for k, v in FUNCTION_WORDS.items()}
    out = []
    for t in texts:
        letters = len(regex.findall(r"\p{L}", t)) or 1
        by_script = next((k for k, p in _SCRIPTS if len(regex.findall(p, t)) > 0.3 * letters), None)
        if by_script:
            out.append(by_script)
            continue
        ws = t.lower().split()
        score = {k: sum(w in s for w in ws) for k, s in words.items()}
        best = max(sorted(score), key=lambda k: score[k])
        out.append(best if score[best] else "en")
    return out


_SPAN = regex.compile(r"\b\p{Lu}[\p{L}\p{M}’'-]+(?:\s+\p{Lu}[\p{L}\p{M}’'-]+)*")
_ORGANISATION = regex.compile(r"\b(?:Inc|Ltd|GmbH|Corp|LLC|AG|Department|Office|Team|Company)\b")


def default_entities(texts: list[str]) -> list[list[tuple[str, str]]]:
    """Runs of capitalised words that do not begin a sentence; those with a company word are ORG, runs of two or more PERSON, others MISC."""
    out = []
    for t in texts:
        found: dict[str, str] = {}
        for m in _SPAN.finditer(t):
            before = t[: m.start()].rstrip()
            if not before or before[-1] in ".!?:\n":
                continue
            s = m.group()
            found[s] = "ORG" if _ORGANISATION.search(s) else "PERSON" if " " in s else "MISC"
        out.append(sorted(found.items()))
    return out


def default_extract(contents: list[bytes]) -> list[str]:
    """The text of PDF files, and text files as they are (bytes that are not UTF-8 are replaced); pages are separated by form feeds."""
    return [pdf_text(c) if b"%PDF-" in c[:1024] else c.decode("utf-8", "replace") for c in map(bytes, contents)]


_REGISTRY: dict[tuple[str, str], Callable] = {
    ("tokenizer", "default"): default_tokens,
    ("embedder", "default"): default_embedding,
    ("language", "default"): default_language,
    ("entities", "default"): default_entities,
    ("extractor", "default"): default_extract,
}


def register(kind: str, name: str, fn: Callable) -> None:
    _REGISTRY[kind, name] = fn


def provider(kind: str, name: str = "default") -> Callable:
    try:
        return _REGISTRY[kind, name]
    except KeyError:
        raise KeyError(f"no {kind} provider named {name!r}") from None


def available() -> list[tuple[str, str]]:
    return sorted(_REGISTRY)


_TYPES = {
    "tokenizer": ("int", pa.int32()),
    "embedder": ("array<float>", pa.list_(pa.float32())),
    "language": ("string", pa.string()),
    "entities": ("array<struct<text:string,category:string>>", pa.list_(pa.struct([("text", pa.string()), ("category", pa.string())]))),
    "extractor": ("string", pa.string()),
}


def call_with_retry(fn: Callable, batch: list, attempts: int = 3, pause: float = 0.1, timeout: float | None = None) -> list:
    """The provider's answer, which must have one item for each input; retried with a growing pause. A call that takes longer than ``timeout``
    seconds counts as failed."""
    for n in range(1, attempts + 1):
        try:
            got = fn(batch) if timeout is None else _within(timeout, fn, batch)
            if len(got) != len(batch):
                raise ValueError(f"{len(got)} answers for {len(batch)} inputs")
            return got
        except Exception:
            if n == attempts:
                raise
            time.sleep(pause * n)
    return []


def _within(seconds: float, fn: Callable, batch: list) -> list:
    """fn(batch) on a thread of its own, which is left behind when the time is over."""
    box: list = []

    def call() -> None:
        try:
            box.append((fn(batch), None))
        except Exception as e:  # noqa: BLE001
            box.append((None, e))

    t = threading.Thread(target=call, daemon=True)
    t.start()
    t.join(seconds)
    if not box:
        raise TimeoutError(f"no answer within {seconds} seconds")
    got, error = box[0]
    if error is not None:
        raise error
    return got


def apply_provider(df: DataFrame, kind: str, input_col: str, out: str, name: str = "default", batch: int = 16, attempts: int = 3, timeout: float | None = None) -> DataFrame:
    """Adds the provider's output for each row, in calls of at most ``batch`` inputs; a null input gives null without a call."""
    fn = provider(kind, name)
    ddl, arrow = _TYPES[kind]
    cols = [c for c in df.columns if c != out]
    src = cols.index(input_col)

    def run(batches):
        for b in batches:
            values = b.column(src).to_pylist()
            at = [i for i, v in enumerate(values) if v is not None]
            res: list = [None] * len(values)
            for s in range(0, len(at), batch):
                part = at[s : s + batch]
                for i, r in zip(part, call_with_retry(fn, [values[i] for i in part], attempts, timeout=timeout)):
                    res[i] = [{"text": x, "category": y} for x, y in r] if kind == "entities" else r
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(res, arrow)], names=[*cols, out])

    d = df.select(*[F.col(f"`{c}`") for c in cols])
    return d.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in [*d.dtypes, (out, ddl)]))


def embed(df: DataFrame, text_col: str, name: str = "default", dimensions: int = 64, batch: int = 16, parallelism: int | None = None, timeout: float | None = None) -> DataFrame:
    """Rows with embedding and dimensions.

    With ``parallelism`` no more tasks than that call a remote provider at once; rows move there, so what comes before keeps its own tasks.
    """
    d = df.repartition(parallelism) if parallelism else df
    e = apply_provider(d, "embedder", text_col, "embedding", name, batch, timeout=timeout)
    return e.withColumn("dimensions", F.when(F.col("embedding").isNotNull(), F.when(F.size("embedding") > 0, F.size("embedding")).otherwise(F.lit(dimensions))))


def vector_rows(embedded: DataFrame, model_version: str, at: str = "created_at") -> DataFrame:
    """Vectors of embedded chunks: id from the hash and model, the chunk's hash, the time of the chunk (runs are repeatable)."""
    from ..functions.text import stable_id

    return embedded.filter(F.col("embedding").isNotNull()).select(stable_id(F.col("hash"), F.lit(model_version)).alias("id"), "hash", "embedding", F.lit(model_version).alias("model_version"), "dimensions", F.col(at).alias("created_at"))
