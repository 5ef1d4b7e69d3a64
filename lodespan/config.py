"""Settings of a crawl and search deployment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Every setting has a default; `from_env` overrides it by the variable LODESPAN_<NAME>."""

    agent: str = "lodespanbot"
    shards: int = 1
    shard: int = 0
    chunk_words: int = 200
    chunk_overlap: int = 2
    dimensions: int = 384
    crawl_delay_s: int = 2
    backoff_cap_s: int = 300
    result_limit: int = 5
    seed_urls: str = ""

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        given = {f.name: env[key] for f in fields(cls) if (key := f"LODESPAN_{f.name.upper()}") in env}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in given.items()})

    @staticmethod
    def shard_of_host(host: str) -> int:
        """The number behind the last dash of a host name; 0 if there is none."""
        tail = host.rsplit("-", 1)[-1]
        return int(tail) if tail.isascii() and tail.isdigit() else 0
