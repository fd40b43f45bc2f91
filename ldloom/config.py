"""Settings of the command line and the plans, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

#: Bytes that a tile of the trait matrix is meant to hold when its size is left open.
TILE_BYTES = 1 << 30


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class StandardConfig:
    vcf: str
    out: str = "synthetic.vcf"
    samples: str = ""
    maf: float = 0.01
    n_traits: int = 10
    workers: int = 0
    compress: bool = False
    seed: int | None = None

    def __post_init__(self) -> None:
        _check(0 <= self.maf <= 0.5, "maf must lie in [0, 0.5]")
        _check(self.n_traits >= 1, "at least one trait is needed")


@dataclass(frozen=True)
class PreprocessConfig:
    vcf: str
    out: str
    samples: str = ""
    maf: float = 0.01
    n_traits: int = 10
    chunk_size: int = 10_000
    traits_per_tile: int = 0
    seed: int | None = None

    def __post_init__(self) -> None:
        _check(0 <= self.maf <= 0.5, "maf must lie in [0, 0.5]")
        _check(self.n_traits >= 1, "at least one trait is needed")
        _check(self.chunk_size >= 1, "a chunk holds at least one variant")


@dataclass(frozen=True)
class SimulateConfig:
    prep: str
    out: str
    workers: int = 0
    compress: bool = False
    start_chunk: int = -1
    end_chunk: int = -1


@dataclass(frozen=True)
class MergeConfig:
    chunks: str
    out: str
    compress: bool = True
    order: str = "numeric"

    def __post_init__(self) -> None:
        _check(self.order in ("numeric", "lexicographic"), "order is numeric or lexicographic")


def traits_per_tile(n_traits: int, n_samples: int, wanted: int = 0) -> int:
    """The wanted number if positive, else what fills TILE_BYTES with doubles, within [1, n_traits]."""
    if wanted > 0:
        return wanted
    return min(n_traits, max(1, TILE_BYTES // (8 * max(1, n_samples))))
