"""What an index is made of, as data that goes to JSON and back."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

SEPARATOR = "-"


@dataclass(frozen=True)
class IndexSpec:
    """Groups of columns (each a grid), inner bin edges by column, special values by column, the row id's name.

    A group named in `absent` leaves out rows in which one of its columns is NULL or NaN.
    """

    groups: tuple[tuple[str, ...], ...]
    edges: dict[str, list[float]]
    rid: str = "rid"
    special_values: dict[str, list[float]] = field(default_factory=dict)
    source: str | None = None
    rows: int | None = None
    compression: str = "zstd"
    absent: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for g in self.groups:
            for c in g:
                if SEPARATOR in c:
                    raise ValueError(f"column names in groups must not contain {SEPARATOR!r}: {c}")
                if c not in self.edges:
                    raise ValueError(f"no edges for column {c}")
            if len(set(g)) != len(g) or not g:
                raise ValueError(f"a group names each of its columns once: {g}")
        if not set(self.absent) <= set(self.names):
            raise ValueError(f"absent names unknown groups: {self.absent}")
        for c, e in self.edges.items():
            if list(e) != sorted(set(e)):
                raise ValueError(f"edges of {c} must ascend without repeats")

    @staticmethod
    def name_of(group: Sequence[str]) -> str:
        return SEPARATOR.join(group)

    @property
    def names(self) -> list[str]:
        return [self.name_of(g) for g in self.groups]

    def columns_of(self, name: str) -> tuple[str, ...]:
        return dict(zip(self.names, self.groups, strict=True))[name]

    def shape(self, name: str) -> list[int]:
        return [len(self.edges[c]) + 1 for c in self.columns_of(name)]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> IndexSpec:
        raw = json.loads(text)
        return cls(**raw | {"groups": tuple(map(tuple, raw["groups"])), "absent": tuple(raw.get("absent", ()))})

    def agrees(self, other: IndexSpec) -> list[str]:
        """What keeps two configurations from sharing one folder: ids, edges and special values of common columns, groups that leave rows out."""
        found = [] if self.rid == other.rid else ["rid"]
        for c in self.edges.keys() & other.edges.keys():
            if list(self.edges[c]) != list(other.edges[c]) or list(self.special_values.get(c, ())) != list(other.special_values.get(c, ())):
                found.append(c)
        both = set(self.names) & set(other.names)
        return found + [g for g in both if (g in self.absent) != (g in other.absent)]

    def joined(self, other: IndexSpec) -> IndexSpec:
        """One configuration with the groups of both."""
        more = tuple(g for g in other.groups if g not in self.groups)
        return IndexSpec(**{**self.__dict__, "groups": self.groups + more, "edges": self.edges | other.edges, "special_values": self.special_values | other.special_values, "absent": tuple(dict.fromkeys(self.absent + other.absent))})

    def tag(self, n: int = 10) -> str:
        """Short name of this configuration."""
        return hashlib.sha256(self.to_json().encode()).hexdigest()[:n]


def numbered(specs: Sequence[IndexSpec]) -> dict[str, IndexSpec]:
    """A folder name for each configuration: its place and its tag."""
    return {f"index_{i}_{s.tag()}": s for i, s in enumerate(specs)}


#: Compressions of posting tables that a user may ask for, with the Parquet writer's options.
COMPRESSIONS = {
    "copy": {"compression": "uncompressed"},
    "zstd": {"compression": "zstd"},
    "zstdmore": {"compression": "zstd", "parquet.compression.codec.zstd.level": "19"},
    "zstdfaster": {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"},
    "delta": {"compression": "uncompressed", "parquet.writer.version": "v2"},
    "delta+zstd": {"compression": "zstd", "parquet.writer.version": "v2"},
    "snappy": {"compression": "snappy"},
}
