"""Pivot-distance tables: Hamming distances from 128-bit fingerprints to fixed reference fingerprints.

For any metric, |d(x, p) - d(y, p)| <= d(x, y) for every pivot p. A table that stores d(x, p_1..p_16) next to x can thus
discard a pair as soon as one coordinate differs by more than the search radius, without touching the pair itself. The
16 distances (0..128, one byte each) are packed into two longs, so with radius 0 "all coordinates agree" is equality of
two longs. The first coordinates, cut into ranges, are the cells by which tables are partitioned and joined.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIVOTS = 16
#: Coordinates whose ranges are join keys when the radius is above 0.
RANGE_KEYS = 3
#: Ranges of each of those coordinates where a table is partitioned by them.
CUTS = 8


def _signed(b: bytes) -> int:
    return int.from_bytes(b, "big", signed=True)


def reference_points(n: int = PIVOTS) -> list[tuple[int, int]]:
    """n fixed 128-bit points as pairs of signed longs, from MD5 of their number."""
    out = []
    for i in range(n):
        digest = hashlib.md5(f"reference point {i}".encode()).digest()
        out.append((_signed(digest[:8]), _signed(digest[8:])))
    return out


def distance_expr(i: int, h1: str = "h1", h2: str = "h2") -> str:
    """SQL text of the Hamming distance from (h1, h2) to reference point i."""
    p1, p2 = reference_points()[i]
    return f"bit_count({h1} ^ {_lit(p1)}) + bit_count({h2} ^ {_lit(p2)})"


def _lit(v: int) -> str:
    # the least long has no literal of its own
    return f"({v + 1}L - 1L)" if v == -(2**63) else f"({v}L)"


def packed_exprs(h1: str = "h1", h2: str = "h2") -> tuple[str, str]:
    """SQL text of the two longs that hold the 16 coordinates."""
    words = []
    for base in (0, 8):
        words.append(" | ".join(f"shiftleft(cast({distance_expr(base + k, h1, h2)} as bigint), {8 * k})" for k in range(8)))
    return words[0], words[1]


def fingerprint(*cols: Column) -> tuple[Column, Column]:
    """A 128-bit fingerprint of the columns as two longs."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second half"), *cols)


def with_pivot_table(df: DataFrame) -> DataFrame:
    """Adds v1, v2 (packed coordinates) to a frame that has h1, h2."""
    w1, w2 = packed_exprs()
    return df.withColumn("v1", F.expr(w1)).withColumn("v2", F.expr(w2))


def within_coordinates(left: str, right: str, radius: int) -> Column:
    """True if no coordinate of two packed tables differs by more than the radius."""
    tests = []
    for word in ("v1", "v2"):
        for k in range(8):
            a = f"(shiftright({left}.{word}, {8 * k}) & 255)"
            b = f"(shiftright({right}.{word}, {8 * k}) & 255)"
            tests.append(f"abs({a} - {b}) <= {radius}")
    return F.expr(" AND ".join(tests))


def true_distance(left: str, right: str, text: str | None = None) -> Column:
    """The Hamming distance of two fingerprints and, if the column of the texts they were made from is named, one more where
    these texts differ.

    Different texts may have equal fingerprints, so only with the texts does 0 mean the same. The sum is a metric too, and no
    less than the distance of the fingerprints: what the pivots discard is beyond the radius in it as well.
    """
    bits = f"bit_count({left}.h1 ^ {right}.h1) + bit_count({left}.h2 ^ {right}.h2)"
    return F.expr(bits if text is None else f"{bits} + cast({left}.{text} <> {right}.{text} AS int)")


def cut_points(bits: int = 128, cuts: int = CUTS) -> list[int]:
    """Distances at which the ranges after the first begin. The distance of a fingerprint to a fixed point is binomial,
    so the quantiles that make ranges of like size are known without looking at data."""
    points, below, d = [], 0, 0
    for k in range(1, cuts):
        while below * cuts < k * 2**bits:
            below += math.comb(bits, d)
            d += 1
        points.append(d)
    return points


def cells() -> int:
    return CUTS**RANGE_KEYS


def cell_expr() -> str:
    """SQL text of the number of the cell of packed coordinates v1: the ranges of its first RANGE_KEYS coordinates."""
    parts = []
    for k in range(RANGE_KEYS):
        steps = " + ".join(f"cast((shiftright(v1, {8 * k}) & 255) >= {p} AS int)" for p in cut_points())
        parts.append(f"({steps}) * {CUTS**k}")
    return " + ".join(parts)


def pairs_within(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """(left_id, right_id, distance) of all pairs with Hamming distance <= radius.

    Both frames have id, h1, h2, v1, v2. The first RANGE_KEYS coordinates are cut into ranges of radius + 1, so partners
    lie in the same or a neighbouring range; the left side is sent to its 3^RANGE_KEYS ranges, all 16 coordinates are
    compared inside the join, and the true distance is taken of what is left. No pair is lost.
    """
    width = radius + 1
    cell = [f"cast((shiftright(v1, {8 * k}) & 255) div {width} as int)" for k in range(RANGE_KEYS)]
    near = left
    for k in range(RANGE_KEYS):
        near = near.withColumn(f"c{k}", F.explode(F.expr(f"array({cell[k]} - 1, {cell[k]}, {cell[k]} + 1)")))
    far = right
    for k in range(RANGE_KEYS):
        far = far.withColumn(f"c{k}", F.expr(cell[k]))
    cond = within_coordinates("l", "r", radius)
    for k in range(RANGE_KEYS):
        cond = (F.col(f"l.c{k}") == F.col(f"r.c{k}")) & cond
    return (
        near.alias("l")
        .join(far.alias("r"), cond)
        .select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), true_distance("l", "r").alias("distance"))
        .where(F.col("distance") <= radius)
    )
