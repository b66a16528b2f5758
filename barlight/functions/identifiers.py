"""Names that are safe as one segment of a path."""

from __future__ import annotations

from pathlib import Path
from typing import Literal

from pyspark.sql import Column
from pyspark.sql import functions as F

Case = Literal["lower", "upper", "preserve"]
FORBIDDEN = frozenset('/\\<>:"|?*') | {chr(i) for i in range(32)}


def segment(value: str, *, field: str, case: Case = "preserve") -> str:
    """The name in the wanted case, or an error if it could lead out of its folder."""
    if not isinstance(value, str):
        raise TypeError(f"{field} must be a string")
    if not value or value != value.strip() or value in (".", "..") or FORBIDDEN & set(value):
        raise ValueError(f"{field} is not a safe path segment: {value!r}")
    return value if case == "preserve" else value.lower() if case == "lower" else value.upper()


def is_safe_segment(value: Column) -> Column:
    """Column form of the test in segment(): false for null."""
    bad = value.isNull() | (value == "") | (value != F.trim(value)) | value.isin(".", "..") | value.rlike(r'[/\\<>:"|?*\x00-\x1F]')
    return ~F.coalesce(bad, F.lit(True))


def inside(base: str | Path, *segments: str) -> Path:
    """base joined with the segments; an error if links or dots lead out of base."""
    root, path = Path(base), Path(base, *segments)
    if not path.resolve().is_relative_to(root.resolve()):
        raise ValueError(f"path leaves {root}: {path}")
    return path
