"""Settings of the engine, from defaults, the environment or a mapping."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class EngineConfig:
    """All parameters with the defaults of production. Unknown keys of a source are ignored."""

    chunk_strategy: str = "paragraph"
    chunk_budget: int = 450
    chunk_overlap: int = 80
    chars_per_token: int = 4
    quality_threshold: float = 0.25
    keywords_per_chunk: int = 8
    minhash_count: int = 64
    minhash_bands: int = 16
    warmup_hashes: int = 10_000
    dedup_ttl_days: int = 7
    embed_batch: int = 16
    embed_parallelism: int = 8
    embed_attempts: int = 3
    embed_dimensions: int = 64
    embed_timeout_seconds: int = 30
    write_batch: int = 400
    search_top_k: int = 10
    search_min_similarity: float = 0.18
    max_deliveries: int = 5
    backoff_seconds: int = 2
    default_tenant: str = "default"
    default_language: str = "en"
    query_prefix: str = "search_query: "
    embed_on: str = "raw"
    enrich_duplicates: bool = False
    stop_words: tuple[str, ...] = ()
    honorifics: tuple[str, ...] = ()
    required: tuple[str, ...] = field(default=(), repr=False)

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, prefix: str = "INKGRID_", required: tuple[str, ...] = ()) -> EngineConfig:
        """From ``PREFIX_NAME`` keys; a missing required key raises, an empty value counts as missing."""
        env = os.environ if env is None else env
        values = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper(), "")
            if raw == "" or f.name == "required":
                continue
            default = f.default
            if isinstance(default, bool):
                values[f.name] = raw.lower() in ("1", "true", "yes")
            elif isinstance(default, int):
                values[f.name] = int(raw)
            elif isinstance(default, float):
                values[f.name] = float(raw)
            elif isinstance(default, tuple):
                values[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            else:
                values[f.name] = raw
        missing = [k for k in required if k not in values]
        if missing:
            raise ValueError("missing settings: " + ", ".join(prefix + k.upper() for k in missing))
        return cls(**values, required=required)


def load_env_file(text: str) -> dict[str, str]:
    """KEY=value lines of a settings file; comments, blank lines and quotes around values are dropped, the first setting of a key wins."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            k, _, v = line.removeprefix("export ").partition("=")
            out.setdefault(k.strip(), v.strip().strip("\"'"))
    return out
