"""Settings of the engine, checked once at construction."""

from __future__ import annotations

import os
from dataclasses import dataclass

#: Where chunk objects are said to live, and the segment size of the file client.
LOCATION_PREFIX = "minio://dedupe-chunks/"
SEGMENT_BYTES = 65536


@dataclass(frozen=True)
class EngineConfig:
    """min_size, max_size: bounds of a chunk in bytes. block_aligned: cut at every max_size bytes too, as a
    buffered reader would. hash_alg: sha2 (built in) or blake3 (Arrow UDF). mode: exact, or lru with lru_capacity
    remembered fingerprints. filter_capacity: keys the one-slot filter model is made for. touch_on_hit: a duplicate
    moves last_referenced_time of the stored chunk. verify_on_put: bytes are hashed again before they are stored. timeout_s: a session without an end after that is reported."""

    min_size: int = 64
    max_size: int = 8192
    block_aligned: bool = False
    hash_alg: str = "sha2"
    mode: str = "exact"
    lru_capacity: int = 1000
    filter_capacity: int = 10000
    location_prefix: str = LOCATION_PREFIX
    touch_on_hit: bool = True
    verify_on_put: bool = True
    node_id: str = "storage-node-1"
    client_id: str = "test-client"
    policy_id: str = "default-policy"
    timeout_s: int = 1800
    store_path: str | None = None

    def __post_init__(self) -> None:
        if self.min_size < 1 or self.max_size < max(self.min_size, 4):
            raise ValueError("need min_size >= 1 and max_size >= max(min_size, 4)")
        if self.hash_alg not in ("sha2", "blake3"):
            raise ValueError(f"unknown hash_alg {self.hash_alg!r}")
        if self.mode not in ("exact", "lru"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.lru_capacity < 1 or self.filter_capacity < 1:
            raise ValueError("capacities must be positive")

    @property
    def filter_buckets(self) -> int:
        return max(1, self.filter_capacity // 4)

    @classmethod
    def from_env(cls, env: dict | None = None, **overrides) -> EngineConfig:
        """NODE_ID and SILTSPARK_STORE from the environment; keyword arguments win."""
        env = os.environ if env is None else env
        found = {k: env[e] for k, e in (("node_id", "NODE_ID"), ("store_path", "SILTSPARK_STORE")) if env.get(e)}
        return cls(**(found | overrides))
