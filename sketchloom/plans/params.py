"""Parameter strings of sketches and indexes."""

from __future__ import annotations

from dataclasses import dataclass

from sketchloom.operators.index import KINDS, SORTS
from sketchloom.operators.sketch import TYPES, SketchSpec


def sketch_name(spec: SketchSpec) -> str:
    size = f"{spec.size:g}" if spec.type == "GKMV" else str(spec.k)
    return f"{spec.type}:{size}"


def parse_sketches(text: str, aggregate: str = "FIRST") -> list[SketchSpec]:
    """``TYPE:BUDGET`` entries, comma-separated."""
    out = []
    for part in text.split(","):
        name, colon, budget = part.strip().partition(":")
        if not colon or name not in TYPES:
            raise ValueError(f"not a sketch parameter: {part}")
        out.append(SketchSpec(name, float(budget), aggregate))
    return out


@dataclass(frozen=True)
class IndexParams:
    kind: str
    sort: str
    top_k: int
    sketch: SketchSpec

    def __str__(self) -> str:
        return f"{self.kind}:{self.sort}:{self.top_k}:{sketch_name(self.sketch)}"


def parse_index(text: str, aggregate: str = "FIRST") -> list[IndexParams]:
    """``INDEX:SORT:TOPK:TYPE:BUDGET`` entries, comma-separated; only KMV and GKMV sketches are indexed."""
    out = []
    for entry in text.split(","):
        parts = entry.strip().split(":")
        if len(parts) != 5 or parts[0] not in KINDS or parts[1] not in SORTS or parts[3] not in ("KMV", "GKMV"):
            raise ValueError(f"not an index parameter: {entry}")
        out.append(IndexParams(parts[0], parts[1], int(parts[2]), SketchSpec(parts[3], float(parts[4]), aggregate)))
    return out
