"""Settings of a barcode library and the checks on them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Filter:
    """What each sequence, and each pair of sequences, must meet."""

    gc_min: float = 0.4
    gc_max: float = 0.6
    homopolymer_max: int = 2
    min_distance: int = 3

    def __post_init__(self) -> None:
        if not 0 <= self.gc_min < self.gc_max <= 1:
            raise ValueError(f"GC bounds must satisfy 0 <= gc_min < gc_max <= 1, not {self.gc_min} and {self.gc_max}")
        if self.homopolymer_max < 1:
            raise ValueError(f"homopolymer_max must be at least 1, not {self.homopolymer_max}")
        if self.min_distance < 1:
            raise ValueError(f"min_distance must be at least 1, not {self.min_distance}")


#: Fixed values of the reported method: sets below this size are compared pair by pair; neighbours are walked up to this distance.
PAIRWISE_BELOW, NEIGHBORS_UP_TO = 10_000, 4


def distance_method(n: int, min_distance: int, mixed_lengths: bool) -> str:
    """Name of the method reported for n sequences. The physical join is chosen apart from it."""
    if n < PAIRWISE_BELOW:
        return "pairwise_sequential"
    if mixed_lengths or min_distance > NEIGHBORS_UP_TO:
        return "pairwise"
    return "neighbor_enumeration"


def batch_size(target: int) -> int:
    """Candidates accepted in one step of growth, at most."""
    return max(50, target // 10) if target <= 10_000 else 10_000


def check_paired(paired: bool, seeds: list[str] | None, seed1: str | None, seed2: str | None) -> None:
    """Which seed files may be given together."""
    if paired:
        if bool(seed1) != bool(seed2):
            raise ValueError("paired mode takes both paired seed files or neither")
        if seeds:
            raise ValueError("paired mode takes no unpaired seed files")
    elif seed1 or seed2:
        raise ValueError("paired seed files are for paired mode only")
