"""The text report of a validation."""

from __future__ import annotations

from ..config import Filter
from .validate import ValidationResult


def render(result: ValidationResult, f: Filter, inputs: list[str], most: int | None = None) -> str:
    """most: composition violations listed, all if None."""
    rows = result.biological_violations.limit(most).collect() if most is not None else result.biological_violations.collect()
    out = ["Sequence list validation", "=" * 40, "Inputs: " + ", ".join(inputs), f"GC content: {f.gc_min} to {f.gc_max}", f"Longest homopolymer: {f.homopolymer_max}", f"Least distance: {f.min_distance}", ""]
    out += [f"Sequences: {result.total_sequences}", f"Passed composition: {result.biological_passed}", f"Failed composition: {result.biological_failed}"]
    out.append("Distances: skipped" if result.distance_skipped else f"Distances: {result.validation_method}, {result.features_checked} pairs checked")
    if result.distance_violation:
        i, j, a, b, d = result.distance_violation
        out.append(f"  Sequences {i} and {j} ({a}, {b}) are at distance {d}")
    if rows:
        out += ["", "Composition violations:"] + [f"  Line {r['ordinal']}: {r['seq']} - {r['reason']}" for r in rows]
    out += ["", "All barcodes are valid!" if result.overall_valid else "VALIDATION FAILED!"]
    return "\n".join(out) + "\n"
