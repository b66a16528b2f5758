"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows of the incidence are documents with the same set of shingles taken as one; columns are shingles, blocks of columns are
Spark's partitions by shingle. The product is taken over prefixes: with all shingles in one order, documents whose sets are
alike enough share one of their first few. Pairs below the bounds that sizes, counts and bit maps of the sets set to their
overlap are discarded; what is left is counted exactly.

Only components of links are asked for, so not all pairs of a group are formed: each column links its documents to its
least, and what is in one component after that needs no further test. Where crowded columns still hold many components, as
in large groups of loosely alike copies, a few of their documents, others each turn, are held against the rest until
turns no longer help. Pairs of documents that share a column and lie in different components are then all tested, so no
component is split.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import freeze, map_texts, null_safe_text, stored, unused

N = 5
PERCENT = 80
#: Shingles that stand last in the order: those in at least COMMON of the texts in a sample of one document in SAMPLE.
#: They bear on speed alone. Their set is kept as bits of their hash, and no more than MOST_COMMON are marked.
SAMPLE, COMMON, MOST_COMMON, COMMON_BITS = 32, 3, 200_000, 22
#: Columns of the most common shingles, of at least HOT_LEAST texts in the sample, are dealt out by shingle and set; any other holds a small part of all cells.
HOT, HOT_LEAST = 10_000, 64
#: 64-bit words of a set's bit map.
WORDS = 16
#: So many ids (8 bytes each) are sent to every executor to pick texts by them. More meet the texts in a shuffle, with the same result.
BROADCAST_IDS = 2_000_000
#: The sets of the pairs' first documents are sent to every executor up to so many shingles (8 bytes each) in all; more are shuffled, with the same result.
BROADCAST_SHINGLES = 6_000_000
#: A column is crowded if its sets have more partners than this in other components, on average. Turns end when all columns
#: together aren't, or when a turn leaves over three quarters of the pairs.
CROWD = 16
#: Sets of a crowded column that are held against the rest in a turn, and partners of a set that are tested in it.
PIVOTS, TRIES = 4, 8


class Hashes(dict):
    """Hashes of words, remembered up to a bound and until a task ends."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = value
        return value


HASHES = Hashes()


def forget() -> None:
    """Called where a task ends: the worker may serve other stages next."""
    HASHES.clear()


def shingle_hashes(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; of a text with fewer words, one for all of them; of none, none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    w = np.fromiter(map(HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    h = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[k : len(w) - n + 1 + k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def class_of(hashes: np.ndarray) -> int:
    """One number for a set, so that equal sets are one row. Two sets of N documents share a number by chance with odds of N^2 / 2^65."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def bit_map(hashes: np.ndarray) -> np.ndarray:
    """Parities of the elements in 64 * WORDS cells: two sets differ in at least as many elements as their maps in bits."""
    cells = np.bincount((hashes & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").view("<i8")


def _full_sets(docs: DataFrame) -> DataFrame:
    """c and s, the number and the shingles of the documents' sets; of copies in one batch once."""

    def make(texts: list[str | None]) -> tuple:
        sets = {class_of(h): h for t in texts if len(h := shingle_hashes(t))}
        return [0] * len(sets), [list(sets), _lists(list(sets.values()))]

    return map_texts(docs, [], "text", "c long, s array<long>", make, forget)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A bit for each value of a shingle's leading COMMON_BITS bits, whether a common shingle has it; and the hottest shingles, sorted."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    # a copy in another batch makes a shingle a little more common: it bears on the order alone
    once = _full_sets(sample).select(F.explode("s").alias("s")).groupBy("s").count()
    top = once.where(F.col("count") >= COMMON).orderBy(F.col("count").desc(), "s").limit(MOST_COMMON).toPandas()
    found = top["s"].to_numpy(dtype=np.int64).view(np.uint64)
    bits = np.zeros(1 << COMMON_BITS, dtype=bool)
    bits[(found >> np.uint64(64 - COMMON_BITS)).astype(np.int64)] = True
    hot = np.sort(found[: min(HOT, int((top["count"] >= HOT_LEAST).sum()))])
    return np.packbits(bits), hot


def prefix_of(hashes: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a set, common ones last, one of which any set as like as ``percent`` has among its own first."""
    late = common[(hashes >> np.uint64(64 - COMMON_BITS)).astype(np.int64)]
    order = np.concatenate([hashes[~late], hashes[late]])
    n = len(order)
    return order[: n - (n * percent + 99) // 100 + 1]


def like_enough(overlap: Column, a: Column, b: Column, percent: int = PERCENT) -> Column:
    return 100 * overlap >= percent * (a + b - overlap)


def components(edges: DataFrame) -> DataFrame:
    """Least node of each node's component: node, root. edges: a, b. Labels run along the links and are shortened by what their own label has."""
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    links = freeze(edges.select(F.explode(both).alias("e")).select("e.a", "e.b").distinct())
    labels = freeze(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        # labels are read with the same names each time, so that one shuffle of them serves all three joins
        best = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("next"))
        near = labels.join(best, F.col("node") == F.col("a")).select("node", "root", F.least("root", "next").alias("next")).alias("near")
        far = near.join(labels.alias("far"), F.col("near.next") == F.col("far.node"), "left")
        moved = freeze(far.select("near.node", "near.root", F.least("near.next", "far.root").alias("next")))
        if moved.where(F.col("next") < F.col("root")).isEmpty():
            return labels
        labels = moved.select("node", F.col("next").alias("root"))


def _merged(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """The rows, each root replaced by the one that moves (node, root) name for it. Roots that it doesn't name stay."""
    moves = moves.where(F.col("node") != F.col("root")).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return rows.join(moves, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with these ids: few ids go to the texts; many meet them in a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs of classes a < b those that are alike enough, by exact counts of their shared shingles. Further columns of a pair stay with it."""
    more = [c for c in pairs.columns if c not in ("a", "b")]
    side = lambda x: classes.select(F.col("c").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "m", "rep")])
    apart = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    most = F.least((F.col("na") + F.col("nb") - apart) / 2, F.col("na"), F.col("nb"))
    near = like_enough(F.least("na", "nb"), F.col("na"), F.col("nb"), percent)
    left = pairs.join(side("a"), "a").join(side("b"), "b").where(near & like_enough(most, F.col("na"), F.col("nb"), percent))
    left = freeze(left.select("a", "b", "na", "nb", "repa", "repb", *more).distinct())
    ids = freeze(left.select(F.explode(F.array("repa", "repb")).alias("doc_id")).distinct())
    sets = _full_sets(_picked(docs, ids))
    firsts = left.groupBy("a").agg(F.max("na").alias("na"))
    light = firsts.agg(F.coalesce(F.sum("na"), F.lit(0))).first()[0] <= BROADCAST_SHINGLES
    first = sets.join(F.broadcast(firsts.select(F.col("a").alias("c"))), "c", "left_semi") if light else sets
    # a document's id may stand in several rows, and its set then meets a pair more than once
    first = first.select(F.col("c").alias("a"), F.col("s").alias("sa"))
    second = left.drop("repa", "repb").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    both = second.join(F.broadcast(first) if light else first, "a")
    return both.where(like_enough(F.size(F.array_intersect("sa", "sb")), F.col("na"), F.col("nb"), percent)).select("a", "b", *more).distinct()


def _sets(docs: DataFrame, percent: int, keep: list[str]) -> DataFrame:
    """For each row what is kept of it, n (size of its set), c (number of the set), m (bit map), p and q (prefix; hot shingles in q)."""
    common, hot = common_shingles(docs)

    def make(texts: list[str | None]) -> tuple:
        late, seen, rows, maps, cold, warm = np.unpackbits(common).astype(bool), set(), [], [], [], []
        for t in texts:
            h = shingle_hashes(t)
            c = class_of(h) if len(h) else 0
            # copies in one batch give their prefix and bit map once
            new = len(h) > 0 and c not in seen
            prefix = prefix_of(h, late, percent) if new else h[:0]
            is_hot = np.isin(prefix, hot) if len(hot) and new else np.zeros(len(prefix), dtype=bool)
            seen.add(c)
            rows.append((len(h), c))
            maps.append(bit_map(h))
            cold.append(prefix[~is_hot])
            warm.append(prefix[is_hot])
        return None, [*(zip(*rows, strict=True) if rows else ([], [])), _lists(maps), _lists(cold), _lists(warm)]

    return stored(map_texts(docs, keep, "text", "n long, c long, m array<long>, p array<long>, q array<long>", make, forget))


def _columns(full: DataFrame) -> DataFrame:
    """The cells s, c, n of columns with several sets; has: in how many of them the set stands; lead: whether it is the column's least."""
    column = Window.partitionBy("s")
    # all cells are shuffled once; what the least and the greatest set of a column are is told where they lie
    cold = full.select("c", F.col("n").cast("int").alias("n"), F.explode("p").alias("s"))
    cold = cold.withColumn("c1", F.min("c").over(column)).withColumn("c2", F.max("c").over(column)).where(F.col("c1") < F.col("c2")).select("s", "c", "n", (F.col("c") == F.col("c1")).alias("lead")).dropDuplicates(["s", "c"])
    # a hot column may hold a large part of all sets: it is dealt out by set, and its bounds (of HOT columns at most) are sent to its cells
    warm = full.select("c", F.col("n").cast("int").alias("n"), F.explode("q").alias("s")).dropDuplicates(["s", "c"])
    bounds = warm.groupBy("s").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where(F.col("c1") < F.col("c2"))
    warm = warm.join(F.broadcast(bounds), "s").select("s", "c", "n", (F.col("c") == F.col("c1")).alias("lead"))
    return freeze(cold.union(warm).withColumn("has", F.count("*").over(Window.partitionBy("c")).cast("int")))


def _roots(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """c and root of every set, root one number for all sets of a component."""
    full = sets.where(F.col("n") > 0)
    reps = full.groupBy("c").agg(F.min("doc_id").alias("rep"))
    classes = full.select("c", "doc_id", "n", "m").join(reps, "c").where(F.col("doc_id") == F.col("rep")).select("c", "rep", "n", "m")
    columns = _columns(full)

    def room(shared: Column, na: Column, nb: Column) -> Column:
        """Whether sets can be alike enough that share so many of their first shingles: in the order, what else they share
        comes after the first shingles of the one whose first shingles end sooner.
        """
        rest = lambda n: F.floor((n * percent + 99) / 100) - 1
        return like_enough(F.least(shared + F.greatest(rest(na), rest(nb)), na, nb), na, nb, percent)

    def product(left: DataFrame, right: DataFrame, apart: Column, whole: bool = True) -> DataFrame:
        """Pairs a, b of sets with the count of first shingles that they share, but for those that sizes and counts rule out; r1 < r2: their roots, where given.

        No more can be shared than either has in common with any set at all, which rules most pairs out before they are formed.
        whole: the counts are of all columns, so that they bear on a pair.
        """
        x = left.select("s", *[F.col(c).alias(f"{c}1") for c in left.columns if c != "s"])
        y = right.select("s", *[F.col(c).alias(f"{c}2") for c in right.columns if c != "s"])
        pairs = x.join(y, (x["s"] == y["s"]) & apart & room(F.least("has1", "has2"), F.col("n1"), F.col("n2")))
        ends = [F.min(f("root1", "root2")).alias(r) for r, f in (("r1", F.least), ("r2", F.greatest)) if "root" in left.columns]
        counted = pairs.groupBy(F.col("c1").alias("a"), F.col("c2").alias("b")).agg(F.count("*").alias("o"), F.min("n1").alias("n1"), F.min("n2").alias("n2"), *ends)
        return (counted.where(room(F.col("o"), F.col("n1"), F.col("n2"))) if whole else counted).drop("n1", "n2")

    def opened(cells: DataFrame, moves: DataFrame) -> DataFrame:
        """The cells of columns whose sets lie in several components, when roots have moved."""
        placed = _merged(cells.select("s", "c", "n", "has", "root"), moves)
        mixed = placed.groupBy("s").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where(F.col("r1") != F.col("r2")).select("s")
        return freeze(placed.join(mixed, "s", "left_semi"))

    def crowds(cells: DataFrame) -> DataFrame:
        """s, k and pairs: the sets of a column, and the pairs of them that lie in different components."""
        k = F.count("*").cast("double")
        sums = cells.groupBy("s", "root").agg(k.alias("k")).groupBy("s").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("q"))
        return sums.select("s", "k", ((F.col("k") * F.col("k") - F.col("q")) / 2).alias("pairs"))

    # of the columns' least sets, each set is held against the one with which it shares most
    met = product(columns.where("lead").drop("lead"), columns.drop("lead"), F.col("c1") != F.col("c2"))
    tested = freeze(met.groupBy("b").agg(F.min(F.struct(-F.col("o"), F.col("a"))).alias("best")).select(F.col("best.a").alias("a"), "b"))
    # later links join components: of each turn only where roots move is worked out
    moves = [components(freeze(_verified(docs, tested, classes, percent)))]
    open_, turn, before = opened(columns.withColumn("root", F.col("c")), moves[0]), 0, math.inf
    while True:
        crowd = freeze(crowds(open_))
        pairs, cells = crowd.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0.0))).first()
        if pairs <= CROWD * cells or pairs > 0.75 * before:
            break
        before, turn = pairs, turn + 1
        dense = open_.join(crowd.where(F.col("pairs") > CROWD * F.col("k")).select("s"), "s", "left_semi")
        # those with the fewest shingles of their own stand in the middle of their group; the others are chosen by hash
        rank = [F.struct(-F.col("has") if k % 2 == 0 else F.lit(0), F.xxhash64("c", F.lit(PIVOTS * turn + k))) for k in range(PIVOTS)]
        chosen = dense.groupBy("s").agg(*[F.min_by("c", rank[k]).alias(f"p{k}") for k in range(PIVOTS)])
        chosen = chosen.select("s", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("c"))
        some = dense.join(chosen, ["s", "c"], "left_semi")
        met = product(some, dense, F.col("root1") != F.col("root2"), whole=False)
        order = Window.partitionBy("b").orderBy(F.col("o").desc(), "a")
        best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TRIES)
        tries = freeze(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "r1", "r2").distinct().join(tested, ["a", "b"], "left_anti"))
        found = freeze(_verified(docs, tries, classes, percent))
        tested = tested.union(tries.select("a", "b"))
        if found.isEmpty():
            break
        moves.append(components(found.select(F.col("r1").alias("a"), F.col("r2").alias("b"))))
        open_ = opened(open_, moves[-1])
    cross = product(open_, open_, (F.col("c1") < F.col("c2")) & (F.col("root1") != F.col("root2"))).drop("o").join(tested, ["a", "b"], "left_anti")
    last = freeze(_verified(docs, cross, classes, percent))
    if not last.isEmpty():
        moves.append(components(last.select(F.col("r1").alias("a"), F.col("r2").alias("b"))))
    return freeze(reduce(_merged, moves, reps.select("c", F.col("c").alias("root"))).select("c", "root"))


def link(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Link documents whose sets of word 5-shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Returns doc_id, n_shingles and component_id, the least id that links lead to, the document's own included. A null or empty text and one
    without words has no shingles and no links. A text of fewer words has one shingle, all of it. Repeated rows and copies
    share a component. A row with a null id is linked with nothing and has a null component. An empty table gives no rows. Further
    columns are ignored. Sizes decide whether a side of a join is sent to the executors or shuffled; rows are the same either way.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), null_safe_text(text).alias("text"))
    # rows without id stay out, so that they change nothing about the others
    named = docs.where(F.col("doc_id").isNotNull())
    sets = _sets(named, percent, ["doc_id"])
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), "c")
    firsts = rows.where(F.col("n_shingles") > 0).groupBy("c").agg(F.min("doc_id").alias("rep")).join(_roots(named, sets, percent), "c")
    firsts = firsts.join(firsts.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("c", "component_id")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    linked = rows.join(firsts, "c", "left").select("doc_id", "n_shingles", own.alias("component_id"))
    nameless = map_texts(docs.where(F.col("doc_id").isNull()), ["doc_id"], "text", "n_shingles long", lambda texts: (None, [[len(shingle_hashes(t)) for t in texts]]))
    return linked.unionByName(nameless.withColumn("component_id", F.lit(None).cast("long")))


def representatives(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of linked rows, with all columns: that of the least id, and of these the least hash of the text.

    A row is told by its id and its text. Of rows that have both in common one stays, whichever. Rows of one id with different texts are
    different documents. Rows with a null id are linked like others and stay only where no row of their component has an id. A
    null or empty text and one without words is linked with nothing: it stays, once for an id. An empty table gives no rows. Further columns
    may have any names. Sizes decide whether the rows that go are sent to the executors or shuffled; the result is the same.
    """
    id_, hash_ = unused(docs.columns, "id", "hash")
    marked = docs.withColumn(id_, F.col(key).cast("long")).withColumn(hash_, F.xxhash64(null_safe_text(text)))
    # where there is no id, the hash of the text stands for it when texts are read again
    rows = marked.select(F.coalesce(id_, hash_).alias("doc_id"), F.col(id_).alias("id"), F.col(hash_).alias("hash"), null_safe_text(text).alias("text"))
    sets = _sets(rows, percent, ["doc_id", "id", "hash"])
    with_words, unnamed = F.col("n") > 0, F.col("id").isNull()
    placed = sets.where(with_words).select("id", "hash", "c").join(_roots(rows, sets, percent), "c")
    first = placed.groupBy("root").agg(F.min(F.struct(unnamed.alias("unnamed"), "id", "hash")).alias("first"))
    gone = placed.join(first, "root").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("hash") == F.col("first.hash")))).select("id", "hash").distinct()
    again = sets.where(with_words | ~unnamed).groupBy("id", "hash").count().where(F.col("count") > 1).select("id", "hash")

    def meet(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        few = keys.count() <= BROADCAST_IDS
        keys = keys.select(F.col("id").alias("_key_id"), F.col("hash").alias("_key_hash"))
        return rows.join(F.broadcast(keys) if few else keys, F.col(id_).eqNullSafe(F.col("_key_id")) & (F.col(hash_) == F.col("_key_hash")), how)

    kept = meet(marked, freeze(gone), "left_anti")
    again = freeze(again)
    if not again.isEmpty():
        kept = meet(kept, again, "left_anti").unionByName(meet(kept, again, "left_semi").dropDuplicates([id_, hash_]))
    return kept.select(*docs.columns)
