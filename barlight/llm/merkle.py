"""A Merkle manifest of a table: one tree for each source, one over the sources, and a proof for each row.

Only ids and digests leave the tasks that read the texts. Rows are put in order by ranges and numbered without gaps; every 4096
neighbours of a source are a block, three levels high. A treehash over each block gives its root, blocks of blocks rise in the same way until
one node is left, and so do the sources. On the way down each block is traversed leaf by leaf: stacks that run ahead by one
run of 16 nodes have each level's next nodes ready when the path comes to need them, so that a level never holds more than two runs and
the open ends of the levels below. What lies above a block is the same for all its leaves and is appended as it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import freeze, stored

#: Nodes that become one, characters of a digest, levels of a block and its leaves.
RUN, DIGEST, LEVELS = 16, 64, 3
BLOCK = RUN**LEVELS
#: A side with the numbers of ranges is sent to the tasks up to so many rows of about 40 bytes; above, it is joined by a shuffle.
BROADCAST_RANGES = 200_000
PROOF = "array<struct<left: string, right: string>>"


def record(*values: Column) -> Column:
    """The text of a leaf: each value with its number of bytes, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def digest(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings from left to right, level by level."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest leads to with these siblings."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


# ---- trees


def parent(run: str) -> str:
    return sha256(run.encode()).hexdigest()


def height(n: int) -> int:
    """Levels until one of ``n`` nodes is left."""
    out = 0
    while n > 1:
        n, out = -(-n // RUN), out + 1
    return out


class Treehash:
    """The nodes of a level from leaves that are put in one by one; keeps the unfinished run of each level below."""

    def __init__(self, level: int):
        self.open, self.nodes = [""] * level, ""

    def put(self, node: str) -> None:
        for k, run in enumerate(self.open):
            run += node
            if len(run) < RUN * DIGEST:
                self.open[k] = run
                return
            self.open[k], node = "", parent(run)
        self.nodes += node

    def take(self) -> str:
        """The nodes one behind another; runs at the end that aren't full rise as they are."""
        node = ""
        for k, run in enumerate(self.open):
            self.open[k], node = "", parent(run + node) if run + node else ""
        out, self.nodes = self.nodes + node, ""
        return out


def raised(leaves: Sequence[str], level: int) -> str:
    tree = Treehash(level)
    for leaf in leaves:
        tree.put(leaf)
    return tree.take()


def traverse(leaves: Sequence[str], levels: int) -> Iterator[list[str]]:
    """For each leaf in turn the runs that its path goes through, from the leaves up. The list is used again: read it before the next."""
    spans = [RUN ** (k + 1) for k in range(levels)]
    runs = [raised(leaves[:span], k) for k, span in enumerate(spans)]
    ahead = [Treehash(k) for k in range(levels)]
    for i in range(len(leaves)):
        yield runs
        for k, span in enumerate(spans):
            if i + span < len(leaves):
                ahead[k].put(leaves[i + span])
            if (i + 1) % span == 0:
                runs[k] = ahead[k].take()


def _levels(n: int) -> int:
    return LEVELS if n > BLOCK else height(n)


def _block_root(key: tuple, block: pa.Table) -> pa.Table:
    rows = block.sort_by("pos")
    n = rows["n"][0].as_py()
    root = raised([d.hex() for d in rows["node"].to_pylist()], _levels(n))
    return pa.table({"tree": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // BLOCK)], pa.int64()), "node": [bytes.fromhex(root)]})


def _block_proofs(kept: Sequence[str]):
    """Proofs of a block's nodes, with what stands above the block appended."""

    def make(block: pa.Table, above: pa.Table) -> pa.Table:
        rows, up = block.sort_by("pos"), above.to_pylist()[0]
        nodes, levels = [d.hex() for d in rows["node"].to_pylist()], _levels(rows["n"][0].as_py())
        left, right, offsets = [], [], [0]
        over = [(level["left"], level["right"]) for level in up["proof"]]
        for i, runs in enumerate(traverse(nodes, levels)):
            for k, run in enumerate(runs):
                at = i // RUN**k % RUN * DIGEST
                left.append(run[:at]), right.append(run[at + DIGEST :])
            for a, b in over:
                left.append(a), right.append(b)
            offsets.append(len(left))
        pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
        same = {c: pa.array([up[c]] * len(nodes), pa.string()) for c in ("subroot", "root")}
        return pa.table({c: rows[c].combine_chunks() for c in ("tree", "pos", *kept)} | {"proof": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)} | same)

    return make


def _blocks(nodes: DataFrame):
    return nodes.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("block"))


def climb(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The tiers from the leaves up, each the block roots of the one below, and the root of each tree. ``most``: leaves of the largest tree."""
    tiers = [nodes]
    while True:
        nodes = freeze(_blocks(nodes.select("tree", "pos", "n", "node")).applyInArrow(_block_root, "tree string, pos long, n long, node binary"))
        if most <= BLOCK:
            return tiers, nodes.select("tree", "node")
        most = -(-most // BLOCK)
        tiers.append(nodes)


def descend(tiers: Sequence[DataFrame], above: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """The leaves' proofs. ``above``: for each tree its root as subroot, the proof from there on and the last root."""
    above = above.select("tree", F.lit(0).cast("long").alias("block"), "proof", "subroot", "root")
    for k, nodes in reversed(list(enumerate(tiers))):
        names = list(kept) if k == 0 else []
        types = "".join(f", {c} {nodes.schema[c].dataType.simpleString()}" for c in names)
        made = _blocks(nodes).cogroup(above.groupBy("tree", "block")).applyInArrow(_block_proofs(names), f"tree string, pos long{types}, proof {PROOF}, subroot string, root string")
        above = made.withColumnRenamed("pos", "block")
    return made


# ---- order


def placed(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """The rows with ``pos``, their number within ``tree`` from 0 on, and ``n``, how many the tree has; and the most that one has.

    Rows are dealt by ranges of tree and order, so that a large tree is spread over many tasks, also where rows are equal.
    """
    keys = ["tree", *order, "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    # a partition's number stands in the upper bits of this id, and the place in the partition in the lower 33
    at = ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    at = stored(at)
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = freeze(at.groupBy("tree", "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_n")).select("tree", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_shift"), F.sum("_n").over(whole).alias("n")))
    ranges, most = counts.agg(F.count("*"), F.max("n")).first()
    side = F.broadcast(counts) if ranges <= BROADCAST_RANGES else counts
    numbered = at.join(side, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift"))
    return numbered.drop("_at", "_part", "_shift"), most or 0


def manifest(docs: DataFrame, leaf: Column, keep: dict[str, Column] | None = None, group: str = "source", key: str = "doc_id") -> DataFrame:
    """``key``, ``position`` in its source, the columns in ``keep``, leaf, subroot, root and proof of each row.

    ``leaf`` is the binary digest of a row. Rows without key stand first in their source, a null source is one of its own and stands before the others;
    rows with equal keys are ordered by leaf, and equal rows stand as often as they are there. Null and empty values
    count as record() says; texts of any length are hashed where they are read. An empty table gives no rows. Further columns
    are ignored.
    """
    keep = keep or {}
    kept = [f"k{i}" for i in range(len(keep) + 1)]
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("s"), F.col(group).cast("string")))
    narrow = docs.select(tree.alias("tree"), F.col(key).alias("k0"), *[c.alias(n) for c, n in zip(keep.values(), kept[1:], strict=True)], leaf.alias("node"))
    # the texts are read once: finding the ranges would read them a second time
    rows, most = placed(stored(narrow), ["k0", "node"])
    tiers, subroots = climb(stored(rows), most)
    sources, many = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("k0"), "node"), ["k0"])
    upper, roots = climb(stored(sources), many)
    top = roots.select("tree", F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("node")).alias("root"), F.array().cast(PROOF).alias("proof"))
    over = descend(upper, top, ["k0", "node"]).select(F.col("k0").alias("tree"), F.lower(F.hex("node")).alias("subroot"), "root", "proof")
    out = descend(tiers, over, [*kept, "node"])
    return out.select(F.col("k0").alias(key), F.col("pos").alias("position"), *[F.col(n).alias(c) for n, c in zip(kept[1:], keep, strict=True)], F.lower(F.hex("node")).alias("leaf"), "subroot", "root", "proof")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaf(text: Column | None = None) -> Column:
    """The digest of a row of documents, or of the same row with another text."""
    return digest(record(*[F.col(c) for c in FIELDS[:-1]], F.col("text") if text is None else text))


def tampered(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and what becomes of it where one in five rows has lost its capitals since."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = manifest(docs, document_leaf(), {"seen": F.when(touched, document_leaf(lower))})
    seen = F.coalesce(F.lower(F.hex("seen")), "leaf")
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(seen, F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
