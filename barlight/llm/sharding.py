"""Sharding: minimax contiguous partition of atomic groups.

Groups of equal texts are atoms. They stand in the order of a 60-bit text hash;
groups larger than an even share come first, each in a shard of its own. For the
rest, a binary search finds the smallest capacity with which a greedy left to
right fill needs no more than the shards left, and the sequence is cut there: of
the cuts that keep to this capacity, those nearest to even shares are taken.

The driver never sees the groups. It holds a histogram of cells of the hash range
and asks the cluster to split only those cells in which a cut can fall, until
they are single groups; elsewhere a cell's sum is all that the search needs.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze, null_safe_text, numbered

KEY_BITS = 60
#: The first histogram has 2**12 cells; a cell in which a cut may fall is split into 2**6.
FIRST_BITS, STEP_BITS = 12, 6


class Cells:
    """Cells of the hash range in order: [low, low + 2**bits), the bytes and the number of groups inside."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows)
        self.ends = list(accumulate((r[2] for r in self.rows), initial=0))
        self.total = self.ends[-1]

    def forward(self, start: int, capacity: int, whole: bool) -> int:
        """The furthest end of a shard from byte ``start``. whole: at a cell's end, else anywhere."""
        end = start + capacity
        if end >= self.total:
            return self.total
        return self.ends[bisect_right(self.ends, end) - 1] if whole else end

    def fits(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            at = self.forward(at, capacity, True)
        return at >= self.total

    def least(self, shards: int) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fits(mid, shards) else (mid + 1, high)
        return low

    def open_cells(self, shards: int) -> list[tuple[int, int]]:
        """Cells of several groups in which a cut may fall, at any capacity up to the one that whole cells allow."""
        high, found = self.least(shards), set()
        for k in range(1, shards):
            # with no shard above this capacity, the k-th cut is in this stretch
            low, top = max(0, self.total - (shards - k) * high), min(self.total, k * high)
            found.update(range(max(0, bisect_right(self.ends, low) - 1), min(bisect_left(self.ends, top), len(self.rows))))
        return [(r[0], r[1]) for r in (self.rows[i] for i in sorted(found)) if r[3] > 1 and r[1] > 0]

    def cuts(self, shards: int) -> list[int]:
        """The ends of all shards but the last, as hashes: a group at or above the k-th belongs to a later shard."""
        capacity, last, out = self.least(shards), 0, []
        right = [self.total]
        for _ in range(shards - 1):
            need = right[-1] - capacity
            right.append(self.ends[bisect_left(self.ends, max(0, need))])
        right = right[1:][::-1]
        for k in range(1, shards):
            most, want = self.forward(last, capacity, True), self.total * k // shards
            i = bisect_left(self.ends, want)
            near = min((self.ends[j] for j in (i - 1, i) if 0 <= j < len(self.ends)), key=lambda e: abs(e - want), default=0)
            last = max(last, min(most, max(right[k - 1], near)))
            i = bisect_left(self.ends, last)
            out.append(self.rows[i][0] if i < len(self.rows) else 1 << KEY_BITS)
        return out


def _split(groups: DataFrame, cells: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Sums over the next finer cells of the given cells."""
    spark, out = groups.sparkSession, []
    by_bits: dict[int, list[int]] = {}
    for low, bits in cells:
        by_bits.setdefault(bits, []).append(low >> bits)
    for bits, prefixes in by_bits.items():
        finer = max(0, bits - (FIRST_BITS if bits == KEY_BITS else STEP_BITS))
        wanted = spark.createDataFrame([(p,) for p in prefixes], "p long")
        rows = groups.join(F.broadcast(wanted), F.shiftright("key", bits) == F.col("p"), "left_semi").groupBy(F.shiftright("key", finer).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        out += [(r["cell"] << finer, finer, r["size"], r["n"]) for r in rows]
    return out


def plan_cuts(groups: DataFrame, shards: int) -> tuple[dict[int, int], list[int], int]:
    """Shards of oversize groups by key, the cuts for all others, and the first shard that they fill.

    groups: key (60-bit long), size. On the driver: 2**12 sums, then at most 2**6 for each cell that is split.
    """
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    left, own, rest = total, {}, shards
    # groups over an even share are fewer than the shards
    large = [(r["size"], r["key"]) for r in groups.where(F.col("size") * shards > total).select("key", "size").collect()]
    for size, key in sorted(large, key=lambda x: (-x[0], x[1])):
        if rest > 1 and size * rest > left:
            own[key], left, rest = len(own), left - size, rest - 1
    others = groups.where(~F.col("key").isin(list(own))) if own else groups
    cells = Cells(_split(others, [(0, KEY_BITS)]))
    while wanted := cells.open_cells(rest):
        gone = set(wanted)
        cells = Cells([r for r in cells.rows if (r[0], r[1]) not in gone] + _split(others, wanted))
    return own, cells.cuts(rest) if rest > 1 else [], len(own)


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put all rows into shards 0 to ``shards`` - 1 of near-equal bytes, equal texts together.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'), shard, slot (gapless from 0 in
    each shard) and grown_shard (null: the law is not 'key'). A null text counts as empty: size 1 and the
    group of the empty texts. Repeated rows stay apart and share a shard. A null id is kept. An empty table
    gives no rows. A group over an even share has a shard to itself. Further columns are ignored.
    """
    body = null_safe_text(text)
    rows = freeze(
        docs.select(F.col(key).alias("doc_id"), body.alias("t")).select(
            "doc_id",
            (F.octet_length("t") + 1).cast("long").alias("size"),
            F.crc32(F.encode("t", "UTF-8")).alias("text_crc32"),
            F.conv(F.substring(F.md5(F.encode("t", "UTF-8")), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
        )
    )
    groups = freeze(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    own, cuts, first = plan_cuts(groups, shards)
    n = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    number = F.lit(first)
    for cut in cuts:
        number = number + (F.col("key") >= F.lit(cut)).cast("int")
    for k, s in own.items():
        number = F.when(F.col("key") == F.lit(k), F.lit(s)).otherwise(number)
    placed = rows.withColumn("shard", number.cast("int"))
    out = numbered(placed, ["shard"], ["doc_id", "text_crc32"], F.xxhash64("doc_id", "key"), n, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
