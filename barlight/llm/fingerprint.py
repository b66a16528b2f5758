"""Document fingerprints: SimHash over word pairs, and Hamming search by permuted block tables.

Built from DataFrame functions alone: no Python runs on the executors.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import freeze, null_safe_text

#: Two 64-bit halves.
BITS = 128
HALF = 64
#: A sum holds the votes on bit k in its low and on bit k + 32 in its high half.
LANES = 0x0000000100000001
#: Texts whose sets of word 5-shingles have a Jaccard similarity of 0.8 or more lay at most so many bits apart (README), and the
#: blocks and flips by which they are searched.
RADIUS, BLOCKS, FLIPS = 22, 8, 2


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def terms(hashes: Column) -> Column:
    """Hashes of a text's terms: pairs of neighbouring words, lower-cased; of a text of one word, that word. hashes: a column, as it is read several times."""
    n = F.size(hashes)
    pairs = F.zip_with(F.slice(hashes, 1, F.greatest(n - 1, F.lit(0))), F.slice(hashes, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.when(n == 1, hashes).otherwise(pairs)


def votes() -> list[Column]:
    """Aggregates over rows with a term hash h (null: no term): votes for each of 64 pairs of bits, and the number of terms.

    A term that a text has several times votes as often: its weight is its count.
    """
    second = F.when(F.col("h").isNotNull(), F.xxhash64("h", F.lit(1)))
    out = []
    for half, h in enumerate((F.col("h"), second)):
        for k in range(32):
            out.append(F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES))).alias(f"v{half}_{k}"))
    return [*out, F.count("h").alias("weight")]


def half(which: int) -> Column:
    """64 signed bits from the votes: a bit is set if more than half of the weight votes for it."""
    bits = F.lit(0).cast("long")
    for k in range(32):
        v = F.coalesce(F.col(f"v{which}_{k}"), F.lit(0).cast("long"))
        low, high = v.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(v, 32)
        bits = bits.bitwiseOR(F.when(2 * low > F.col("weight"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        bits = bits.bitwiseOR(F.when(2 * high > F.col("weight"), F.lit((1 << (k + 32)) - ((1 << 64) if k == 31 else 0))).otherwise(F.lit(0)).cast("long"))
    return bits


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """The share of equal bits of two fingerprints, each of two long columns."""
    apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))
    return 1.0 - apart.cast("double") / BITS


def as_hex(*words: str) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(F.col(c)), 16, "0")) for c in words])


def fingerprints(rows: DataFrame, by: list[str], text: str, carry: list[str] = ()) -> DataFrame:
    """``by``, ``carry``, f0 and f1 (64 bits each) for rows that ``by`` tells apart.

    What is carried must be numbers: with a string among its values the aggregation would sort all terms instead of hashing.
    """
    words = rows.select(*by, *carry, word_hashes(F.col(text)).alias("words"))
    exploded = words.select(*by, *carry, F.explode_outer(terms(F.col("words"))).alias("h"))
    voted = exploded.groupBy(*by).agg(*votes(), *[F.max(c).alias(c) for c in carry])
    return voted.select(*by, *carry, half(0).alias("f0"), half(1).alias("f1"))


def near_pairs(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 5, flips: int = 0) -> DataFrame:
    """All pairs of a query and a fingerprint within ``radius`` bits: columns q0, q1, f0, f1, distance.

    prints has f0 and f1, queries q0 and q1; give distinct fingerprints, so that copies aren't paired. The 128 bits
    are cut into blocks, of which at most radius // (flips + 1) differ by more than ``flips`` bits. So there is a table for each
    choice of as many blocks as are left; prints are looked up in it by the bits of the chosen blocks, queries by these bits with
    up to ``flips`` of each block turned, which finds every pair. A pair that meets in several tables is given by the first.
    """
    if not 0 <= radius < blocks * (flips + 1):
        raise ValueError("radius must be less than the number of blocks times one more than the flips")
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def block(a: Column, b: Column, i: int) -> Column:
        bits = F.lit(0).cast("long")
        for word, start in ((a, 0), (b, HALF)):
            low, high = max(edges[i], start), min(edges[i + 1], start + HALF)
            if low < high:
                piece = F.shiftrightunsigned(word, low - start).bitwiseAND(F.lit((1 << (high - low)) - 1))
                bits = bits.bitwiseOR(F.shiftleft(piece, low - edges[i]))
        return bits

    tables = list(combinations(range(blocks), blocks - radius // (flips + 1)))
    signed = lambda x: x - (1 << HALF) if x >> (HALF - 1) else x
    turned = [[sum(1 << k for k in ks) for n in range(flips + 1) for ks in combinations(range(edges[i], edges[i + 1]), n)] for i in range(blocks)]
    masks = [(t, signed(m & ((1 << HALF) - 1)), signed(m >> HALF)) for t, chosen in enumerate(tables) for m in map(sum, product(*[turned[i] for i in chosen]))]
    spark = queries.sparkSession

    def key(a: Column, b: Column, chosen: tuple[int, ...]) -> Column:
        return F.xxhash64(*[block(a, b, i) for i in chosen])

    keys = F.array(*[F.struct(F.lit(t).alias("t"), key(F.col("f0"), F.col("f1"), chosen).alias("k")) for t, chosen in enumerate(tables)])
    placed = prints.select("f0", "f1", F.explode(keys).alias("e")).select("f0", "f1", "e.t", "e.k")
    # few queries make many rows: they are dealt out before, not all in one task
    dealt = queries.select("q0", "q1").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "q0", "q1")
    asked = dealt.crossJoin(F.broadcast(spark.createDataFrame(masks, "t int, m0 long, m1 long")))
    x, y = F.col("q0").bitwiseXOR(F.col("m0")), F.col("q1").bitwiseXOR(F.col("m1"))
    asked = asked.select("q0", "q1", "t", F.coalesce(*[F.when(F.col("t") == t, key(x, y, chosen)) for t, chosen in enumerate(tables)]).alias("k"))
    d0, d1 = F.col("f0").bitwiseXOR(F.col("q0")), F.col("f1").bitwiseXOR(F.col("q1"))
    meet = [reduce(Column.__and__, [F.bit_count(block(d0, d1, i)) <= flips for i in chosen]) for chosen in tables]
    first = F.coalesce(*[F.when(m, F.lit(t)) for t, m in enumerate(meet)])
    found = asked.join(placed, ["t", "k"]).withColumn("distance", F.bit_count(d0) + F.bit_count(d1))
    return found.where((F.col("distance") <= radius) & (F.col("t") == first)).select("q0", "q1", "f0", "f1", "distance")


def among(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are no greater than the value: first among every so many, then between two of these."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    pieces = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    upto = lambda array: F.size(F.filter(array, lambda b: b <= value))
    longs = lambda x: F.array(*map(F.lit, x)).cast("array<bigint>")
    piece = upto(longs([p[0] for p in pieces]))
    return F.when(piece > 0, (piece - 1) * step + upto(F.get(F.array(*map(longs, pieces)), piece - 1))).otherwise(0)


def _dealt(docs: DataFrame, key: str, text: str, per_part: int, most: int) -> DataFrame:
    """Rows in buckets of neighbouring ids; the first row of the next lower bucket stands in each bucket once more, as its last.

    The bounds of the buckets are quantiles of the ids, at most ``most``, and so are the rows that stand twice.
    """
    ids = docs.select(F.col(key).cast("long").alias("id"))
    n = ids.count()
    parts = min(most, max(1, n // per_part))
    cut = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    bucket = among(F.col("id"), sorted(set(cut or [])))
    heads = ids.withColumn("b", bucket).groupBy("b").agg(F.max("id").alias("id")).orderBy("b").collect()
    used = [r["b"] for r in heads]
    again = docs.sparkSession.createDataFrame([(r["id"], used[(i + 1) % len(used)]) for i, r in enumerate(heads)], "head long, up int")
    rows = docs.select(F.col(key).cast("long").alias("id"), null_safe_text(text).alias("text")).withColumn("b", bucket)
    rows = rows.join(F.broadcast(again), F.col("id").eqNullSafe(F.col("head")), "left")
    places = F.when(F.col("up").isNull(), F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("guest")))).otherwise(F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("guest")), F.struct(F.col("up").alias("b"), F.lit(1).alias("guest"))))
    return rows.select("id", "text", F.explode(places).alias("p")).select("p.b", "p.guest", "id", "text")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, per_part: int = 500, most_parts: int = 20_000) -> DataFrame:
    """Fingerprint each text and its edited text, whose second half is the start of the next document.

    Next: in descending order of the id, after the last the first; rows of one id stand in the order of a hash of the
    text, null ids last. A null text counts as empty, and a text without words has the fingerprint of
    zeros. Repeated rows are rows of their own. An empty table gives no rows. Further columns are ignored.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (32 hex digits), near_edited, near_next,
    n_near: for documents whose id 100 divides, how many other documents have a fingerprint within ``radius`` bits; else null; and
    near_ids: the ids of these in ascending order, one for each row; rows with a null id are counted but have none to give.

    The texts are shuffled once, by ranges of the id; all that follows stays in these partitions. A range holds about ``per_part`` rows, or more
    where that would make over ``most_parts`` ranges, of which the driver knows the bounds.
    """
    dealt = _dealt(docs, key, text, per_part, most_parts)
    order = Window.partitionBy("b").orderBy("guest", F.col("id").desc_nulls_last(), "tie")
    placed = dealt.withColumn("tie", F.xxhash64("text")).withColumn("rn", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    n = F.char_length("text")
    cut = F.floor(n / 2).cast("int")
    both = placed.select("b", "rn", "guest", "id", "text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut)).alias("edited"))
    sides = both.select("b", "rn", "guest", "id", "n_chars", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))).alias("x"))
    sides = sides.select("b", "rn", "guest", "id", "n_chars", "x.side", F.col("x.body").alias("body"), F.when(F.col("x.side") == 1, F.sha2(F.col("x.body").cast("binary"), 256)).alias("sha"))
    sides = sides.select("b", "rn", "guest", "id", "n_chars", "side", "body", *[F.conv(F.substring("sha", 16 * k + 1, 16), 16, -10).cast("long").alias(f"s{k}") for k in range(4)])
    prints = fingerprints(sides, ["b", "rn", "side"], "body", ["guest", "id", "n_chars", "s0", "s1", "s2", "s3"])
    own, other = F.col("side") == 0, F.col("side") == 1
    pick = lambda c, which: F.max(F.when(which, F.col(c)))
    merged = prints.groupBy("b", "rn").agg(pick("guest", own).alias("guest"), pick("id", own).alias("doc_id"), pick("n_chars", own).alias("n_chars"), *[pick(f"s{k}", other).alias(f"s{k}") for k in range(4)], pick("f0", own).alias("f0"), pick("f1", own).alias("f1"), pick("f0", other).alias("e0"), pick("f1", other).alias("e1"))
    after = Window.partitionBy("b").orderBy("rn")
    whole = freeze(merged.withColumn("n0", F.lead("f0").over(after)).withColumn("n1", F.lead("f1").over(after)).where(F.col("guest") == 0))
    classes = whole.groupBy("f0", "f1").agg(F.count("*").alias("copies"), F.max(F.col("doc_id") % 100 == 0).alias("asked"), F.collect_list("doc_id").alias("ids"))
    found = near_pairs(classes.select("f0", "f1"), classes.where("asked").select(F.col("f0").alias("q0"), F.col("f1").alias("q1")), radius, BLOCKS, FLIPS)
    near = found.join(classes.select("f0", "f1", "copies", "ids"), ["f0", "f1"]).groupBy(F.col("q0").alias("f0"), F.col("q1").alias("f1")).agg(F.sum("copies").alias("around"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    own_place = F.array_position("ids", F.col("doc_id")).cast("int")
    others = F.concat(F.slice("ids", F.lit(1), own_place - 1), F.slice("ids", own_place + 1, F.size("ids")))
    asked = whole.where(F.col("doc_id") % 100 == 0).join(near, ["f0", "f1"]).withColumn("n_near", F.col("around") - 1).withColumn("near_ids", others)
    rest = whole.where((F.col("doc_id") % 100 != 0) | F.col("doc_id").isNull()).withColumn("n_near", F.lit(None).cast("long")).withColumn("near_ids", F.lit(None).cast("array<long>"))
    return asked.drop("around", "ids").unionByName(rest).select("doc_id", "n_chars", as_hex("s0", "s1", "s2", "s3").alias("edited_sha256"), as_hex("f0", "f1").alias("fingerprint"), as_hex("e0", "e1").alias("edited_fingerprint"), likeness(("f0", "f1"), ("e0", "e1")).alias("near_edited"), likeness(("f0", "f1"), ("n0", "n1")).alias("near_next"), "n_near", "near_ids")
