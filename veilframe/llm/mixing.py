"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source with target T and size S is due T/S copies.  The whole part is taken as it
is; the fractional parts are rounded dependently.  Two documents are paired and mass is moved between
them, measured in words, until one becomes integral; which way is drawn so that each keeps its
expectation.  The words taken thus never change by a transfer, and only the last residual of a source is
off its target.  Documents meet in buckets of bounded size; each leaves one residual, and the residuals
meet again one level up, until one per source is left.

Defined results: null text has size 0; documents of size 0 take 0 words; null is a source of its own, last
in order; repeated rows are rounded together and share their copies as evenly as can be; an empty table
gives an empty result.  Columns beside the named ones are not read.  Draws are hashes of ids and of
``seed``, so reruns agree however rows are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, table, words

_EPS = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, rounds: int = 0) -> DataFrame:
    """(source, n_rows, source_size, target): weights repeat over the sources by code point, null last.

    A target stops at ``cap`` times its source's size; the excess goes to the others by weight until none
    is above.  The level at which that settles has a closed form over sources ordered by cap * size /
    weight, so no loop is needed: those below the level are full, the others get weight * level.
    """
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(cap))
    by = by.withColumn("full_at", F.col("limit") / F.col("weight"))
    every, before = W.partitionBy(), W.orderBy("full_at", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    by = (
        by.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("filled", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    level = (F.col("total") - F.col("filled")) / F.col("open")
    # Over the sources in this order the level rises while they are full and falls after: the largest open one holds.
    by = by.withColumn("level", F.max(F.when(level <= F.col("full_at"), level)).over(every))
    target = F.least(F.col("limit"), F.col("weight") * F.coalesce("level", F.lit(float("inf"))))
    return by.select("source", "n_rows", "source_size", target.alias("target"))


def _draw(*key: Column) -> Column:
    """Uniform in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _round_bucket(items: Column, seed: Column) -> Column:
    """Pivotal rounding over array<struct<id, p, w>>: struct<left: the residual's struct, done: array<struct<id, up>>>.

    ``p`` is in (0, 1), ``w`` the words that a whole copy has.  The fold holds one fractional item.  Items
    come longest first: short ones then use up a long residual, and what is left at the end is short.
    """
    def step(acc: Column, x: Column) -> Column:
        c = acc["left"]
        mass_c, mass_x = c["p"] * c["w"], x["p"] * x["w"]
        gap_c, gap_x = (1 - c["p"]) * c["w"], (1 - x["p"]) * x["w"]
        to_c, to_x = F.least(gap_c, mass_x), F.least(mass_c, gap_x)  # words that can move either way
        u = _draw(seed, c["id"], x["id"])
        move = F.when(u * (to_c + to_x) < to_x, to_c).otherwise(-to_x)  # drawn so that expectations stay
        pc, px = (mass_c + move) / c["w"], (mass_x - move) / x["w"]
        c_done = (pc <= _EPS) | (pc >= 1 - _EPS)
        made = F.when(c_done, F.struct(c["id"].alias("id"), (pc >= 0.5).cast("int").alias("up"))).otherwise(F.struct(x["id"].alias("id"), (px >= 0.5).cast("int").alias("up")))
        left = F.when(c_done, F.struct(x["id"].alias("id"), px.alias("p"), x["w"].alias("w"))).otherwise(F.struct(c["id"].alias("id"), pc.alias("p"), c["w"].alias("w")))
        return F.struct(left.alias("left"), F.concat(acc["done"], F.array(made)).alias("done"))

    x = F.element_at(items, 1)
    first = F.struct(F.struct(x["id"].alias("id"), x["p"].alias("p"), x["w"].alias("w")).alias("left"), F.array().cast("array<struct<id:bigint,up:int>>").alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), first, step)


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: Column | None = None, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, bucket: int = 64, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, source.

    ``size`` is a column expression over ``docs`` (null counts as 0).  ``bucket`` bounds what one fold sees:
    keys are dealt over ceil(n / bucket) buckets by hash, and a heavy source only has more buckets.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    size = F.size(words(F.col("text"))) if size is None else size
    sizes = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"))
    # Repeated rows become one item, so that no bucket can grow by them.
    sizes = scratch.keep(sizes.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_keys"))
    targets = source_targets(sizes.withColumn("size", F.col("size") * F.col("rows")), weights, cap)
    targets = scratch.keep(targets.withColumn("n_rows", F.lit(0)).alias("t").join(by.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")), "left").select("t.source", "source_size", "target", "n_keys"), "targets")
    due = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)) * F.col("rows")
    items = sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("due", due)
    whole = F.floor(F.col("due") + _EPS)
    items = items.withColumn("whole", whole).withColumn("p", F.greatest(F.col("due") - whole, F.lit(0.0)))
    # An id for each item that tells items of one doc_id apart; sources are part of it.
    item = F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("source").isNull(), F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), "size")
    items = items.withColumn("item", item)
    open_ = (F.col("p") > _EPS) & (F.col("size") > 0)
    level = items.where(open_).select(F.col("source").alias("g"), "n_keys", F.struct(F.col("item").alias("id"), "p", F.col("size").cast("double").alias("w")).alias("x"))
    decided, depth = [], 0
    while True:
        n = F.ceil(F.col("n_keys") / bucket)
        dealt = level.groupBy("g", F.pmod(F.xxhash64(F.lit(seed + depth), F.col("x.id")), n).alias("b"), n.alias("n")).agg(F.array_sort(F.collect_list(F.struct((-F.col("x.w")).alias("o"), F.col("x.id").alias("id"), F.col("x.p").alias("p"), F.col("x.w").alias("w")))).alias("xs"))
        done = scratch.keep(dealt.select("g", "n", _round_bucket(F.col("xs"), F.lit(seed + depth)).alias("r")), f"level{depth}")
        decided.append(done.select(F.explode("r.done").alias("d")).select("d.*"))
        left = done.select("g", F.col("n").alias("n_keys"), F.col("r.left").alias("x"))
        top = done.agg(F.max("n")).first()[0]
        if top is None or top <= 1:
            break
        level, depth = left, depth + 1
    root = left.select(F.col("x.id").alias("id"), F.when((F.col("x.p") >= 1 - _EPS) | (_draw(F.lit(seed), F.col("x.id")) < F.col("x.p")), 1).otherwise(0).alias("up"))
    ups = root
    for frame in decided:
        ups = ups.unionByName(frame)
    # Hashed ids are all but unique; were two alike, both would go up or not with the larger decision.
    ups = ups.where("up = 1").groupBy("id").agg(F.max("up").alias("up"))
    out = items.join(ups, items["item"] == ups["id"], "left").withColumn("total", F.col("whole") + F.coalesce("up", F.lit(0)))
    out = out.withColumn("total", F.when(F.col("size") > 0, F.least(F.col("total"), F.floor(F.lit(cap) * F.col("rows")))).otherwise(F.greatest(F.col("rows"), F.lit(0))))
    k = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("k")
    out = out.select("*", k).withColumn("copies", F.floor(F.col("total") / F.col("rows")) + (F.col("k") <= F.col("total") % F.col("rows")).cast("bigint"))
    return out.select("doc_id", "source", "size", F.coalesce("source_size", F.lit(0)).cast("bigint").alias("source_size"), F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
