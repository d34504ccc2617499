"""Settings: an argument counts, then the environment (TIDEMARK_<NAME>), then the default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Limits:
    # fixed values
    max_k: int = 256
    max_dim: int = 4096
    max_key_len: int = 512
    max_id_len: int = 128
    max_collection_len: int = 64
    max_json_bytes: int = 64 * 1024
    max_state_batch: int = 256
    max_vector_batch: int = 256
    max_doc_find: int = 100
    max_query_bytes: int = 1024
    list_default: int = 100
    list_cap: int = 1000

    @classmethod
    def resolve(cls, **given: int) -> Limits:
        values = {}
        for f in fields(cls):
            env = os.environ.get(f"TIDEMARK_{f.name.upper()}")
            values[f.name] = int(given.get(f.name, env if env is not None else f.default))
        return cls(**values)


@dataclass(frozen=True)
class Maintenance:
    """What the engine does after commits; 0 switches a trigger off."""

    snapshot_commits: int = 64
    max_commits: int = 1024
    kept_commits: int = 0
    deleted_share: float = 0.3
    least_events: int = 10_000


@dataclass(frozen=True)
class IndexSettings:
    """Settings of the cluster index and the graph index, clamped to what makes sense."""

    # fixed values
    kind: str = "exact"
    clusters: int = 1024
    nprobe: int = 8
    refine: int = 512
    min_train: int = 1024
    training_sample: int = 200_000
    retrain_min: int = 5000
    degree: int = 48
    search_list: int = 128
    #: Clusters that an item is kept in: those of its most similar centroids.
    copies: int = 1

    def clamped(self) -> IndexSettings:
        clusters = max(2, self.clusters)
        return IndexSettings(
            kind=self.kind if self.kind in ("exact", "ivf", "graph") else "exact",
            clusters=clusters,
            nprobe=min(max(1, self.nprobe), clusters),
            refine=max(1, self.refine),
            min_train=max(2, self.min_train),
            training_sample=max(2, self.training_sample),
            retrain_min=max(1, self.retrain_min),
            degree=min(max(4, self.degree), 1024),
            search_list=min(max(8, self.search_list), 65535),
            copies=min(max(1, self.copies), clusters),
        )
