"""Mixing sources to target weights by capped water-filling.

A source's share of all words is proportional to its weight but for sources that
would need more than ``max_epochs`` passes: they stop there, and what they leave
goes to the others by weight until none is above its cap. Each document is then
taken whole as often as its source's target holds the source, and a seeded choice
of documents once more, so that the words taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_RE, freeze

#: Weights of the sources in code-point order, again and again.
WEIGHTS = (5, 2, 1)
#: About so many documents of a source are tried, one by one, to fill what the cut by hash leaves open.
FILLERS = 64
#: A source is dealt out to so many parts where its documents meet its bounds.
SALTS = 64
#: Bounds of so many sources, of about 1 KB each, are sent to every executor.
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """source, source_size -> source, source_size, target.

    Capped sources are those with the smallest cap for their weight: in the order of cap / weight, the first source
    for which the level of the sources from it on is no higher than its own ratio, and all after it, are free. The table has a row for each source, not for each
    document, so one task can hold it.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    base = sizes.withColumn("w", w).withColumn("cap", max_epochs * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    ahead, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / F.sum("w").over(on)
    free = base.withColumn("level", level).withColumn("rank", F.row_number().over(order)).withColumn("found", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(whole))
    flow = F.coalesce(F.col("found.level"), F.lit(0.0)) * F.col("w")
    return free.select("source", "source_size", *[c for c in ("n",) if c in sizes.columns], F.when(F.col("found").isNull() | (F.col("rank") < F.col("found.rank")), F.col("cap")).otherwise(F.least(flow, F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words the mix takes of each document.

    Returns doc_id, size (words), source_size, target (of the source, in words), taken (size times the passes
    over the document), passes, and the columns in ``keep``. Null text: size 0. Sources stand by code point, a
    null source last and a source like others. Repeated rows are rows of their own but are chosen together if
    their ids are equal. Documents without words count as passed as often as their source is whole. An empty
    table gives no rows. Reruns agree: the choice hangs on the seed and the id alone.

    The choice takes the documents of a source in the order of a seeded hash until the fraction is met. To find
    that place no source is sorted as a whole: two rounds of sums over 1024 cells of the hash leave one
    cell in a million, whose rows alone are summed one by one, and the next FILLERS documents or so close the gap.
    """
    tag = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    full = docs.select("doc_id", *[c for c in keep if c not in ("doc_id", "source")], "source", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"), F.conv(F.substring(tag, 1, 15), 16, 10).cast("long").alias("h"))
    full = full.withColumn("c1", F.shiftright("h", 50).cast("int")).withColumn("c2", F.shiftright("h", 40).cast("int"))
    rows = freeze(full.select("doc_id", "source", "size", "h", "c1", "c2"))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, max_epochs)
    goal = goal.withColumn("passes", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) + 1e-12).cast("long"))
    goal = freeze(goal.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))).withColumnRenamed("source", "s"))
    same = F.col("source").eqNullSafe(F.col("s"))

    def edge(sums: DataFrame, cell: str) -> DataFrame:
        """For each source the cell in which its running sum passes the need: s, cell, what is needed inside."""
        before = F.sum("size").over(Window.partitionBy("source").orderBy(cell)) - F.col("size")
        inside = sums.withColumn("before", before).where((F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("size")))
        return inside.select(F.col("source").alias("s"), F.col(cell).alias("e"), (F.col("need") - F.col("before")).alias("need"))

    few = goal.count() <= BROADCAST_SOURCES

    def meet(docs: DataFrame, bounds: DataFrame) -> DataFrame:
        """Documents with the row of their source: sent to all if these are few, else with a salt, so that a hot source is met in many tasks."""
        if few:
            return docs.join(F.broadcast(bounds), same)
        salts = bounds.withColumn("bs", F.explode(F.array(*map(F.lit, range(SALTS)))))
        return docs.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salts, same & (F.col("salt") == F.col("bs")))

    first = edge(rows.groupBy("source", "c1").agg(F.sum("size").alias("size")).join(goal.select("s", "need"), same).drop("s"), "c1")
    part = rows.join(first, same & (F.col("c1") == F.col("e"))).drop("s", "e", "c1")
    second = freeze(edge(part.groupBy("source", "c2").agg(F.sum("size").alias("size"), F.first("need").alias("need")), "c2"))
    last = rows.join(second, same & (F.col("c2") == F.col("e"))).select("source", "c2", "need", "h", "size")
    # one cell in a million of a source: its rows in order, as far as they fit
    ties = last.groupBy("source", "c2", "need", "h").agg(F.sum("size").alias("size"))
    ordered = ties.withColumn("upto", F.sum("size").over(Window.partitionBy("source", "c2").orderBy("h")))
    fits = F.col("upto") <= F.col("need")
    cut = ordered.groupBy("source", "c2", "need").agg(F.max(F.when(fits, F.col("h"))).alias("cut"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("sum"))
    cut = cut.select(F.col("source").alias("s2"), F.coalesce("cut", F.shiftleft(F.col("c2").cast("long"), 40) - 1).alias("cut"), (F.col("need") - F.col("sum")).alias("gap"))
    # what the cut leaves open is filled with the next documents in the order that still fit, of about FILLERS
    span = F.ceil(F.lit(FILLERS * 2.0**60) / F.col("n")).cast("long")
    ends = freeze(goal.join(cut, F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2").withColumn("end", F.col("cut") + F.least(span, F.lit(1 << 60))))
    after = meet(rows, ends.select("s", "cut", "end", "gap")).where((F.col("h") > F.col("cut")) & (F.col("h") <= F.col("end")))
    after = after.groupBy("source", "h", "gap").agg(F.sum("size").alias("size")).groupBy("source", "gap").agg(F.sort_array(F.collect_list(F.struct("h", F.col("size").cast("double").alias("size")))).alias("next"))
    empty = F.struct(F.col("gap").alias("gap"), F.array().cast("array<bigint>").alias("hs"))
    fill = lambda a, x: F.when((x["size"] > 0) & (x["size"] <= a["gap"]), F.struct((a["gap"] - x["size"]).alias("gap"), F.concat(a["hs"], F.array(x["h"])).alias("hs"))).otherwise(a)
    filled = after.withColumn("a", F.aggregate("next", empty, fill))
    # one document too much where that is nearer than none
    unused = F.filter("next", lambda x: (x["size"] > 0) & ~F.array_contains(F.col("a.hs"), x["h"]))
    least = F.array_min(F.transform(unused, lambda x: F.struct(x["size"].alias("size"), x["h"].alias("h"))))
    filled = filled.withColumn("over", least)
    near = F.coalesce(F.col("over.size") < 2 * F.col("a.gap"), F.lit(False))
    filled = filled.select(F.col("source").alias("s3"), F.when(near, F.concat("a.hs", F.array("over.h"))).otherwise(F.col("a.hs")).alias("fillers"))
    bounds = ends.join(filled, F.col("s").eqNullSafe(F.col("s3")), "left")
    # no edge: the fraction is nothing, or all of the source
    open_end = F.when(F.col("need") > 0, F.lit(1 << 60)).otherwise(F.lit(-1))
    bounds = bounds.select("s", "source_size", "target", F.col("passes").alias("base"), F.when(F.col("need") <= 0, F.lit(-1)).otherwise(F.coalesce("cut", open_end)).cast("long").alias("cut"), F.when(F.col("need") > 0, F.col("fillers")).alias("fillers"))
    extra = ((F.col("h") <= F.col("cut")) | F.coalesce(F.array_contains("fillers", F.col("h")), F.lit(False))).cast("long")
    return meet(full if keep else rows, bounds).withColumn("passes", F.least(F.col("base") + extra, F.lit(max_epochs).cast("long"))).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), "passes", *[c for c in keep if c != "doc_id"])


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The rows of documents, each as often as the mix takes it, with all columns.

    Nulls are read as in mix(): a null text has no words, a null source stands last, and rows with a null id are chosen together, as are rows of
    one id. Rows without words stay as often as their source is whole. An empty table gives no rows. Further columns may have any
    names: they travel under numbers.
    """
    other = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    plain = docs.select("doc_id", "source", "text", *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(other)])
    taken = mix(plain, weights, max_epochs, seed, keep=tuple(plain.columns)).where(F.col("passes") > 0)
    often = taken.withColumn("_pass", F.explode(F.array_repeat(F.lit(0), F.col("passes").cast("int"))))
    names = {c: f"_{i}" for i, c in enumerate(other)}
    return often.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
