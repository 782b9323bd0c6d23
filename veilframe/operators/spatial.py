"""Joins, deduplication and fusion of boxes.

Boxes meet by an equi-join on the page and a grid cell, so no page is a nested loop; a pair counts in the cell of
its common corner only, hence once.  What is sequential by nature runs per page in a grouped function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..scratch import Scratch
from . import geometry as G

CELL = 128
#: Cells on an axis, before and behind the page's origin; what lies beyond counts to the last one.
BEHIND, MOST = -16, 255


def _cell(at: Column, cell: int) -> Column:
    """The cell of a coordinate; those far off the page share the border cells, so no box has cells without a bound."""
    return F.least(F.greatest(F.floor(at / cell), F.lit(BEHIND)), F.lit(MOST)).cast("int")


def _cells(frame: DataFrame, b: str, cell: int) -> DataFrame:
    """A row for each grid cell that a box touches."""
    span = lambda lo, n: F.explode(F.sequence(_cell(lo, cell), _cell(lo + F.greatest(n, F.lit(0.0)), cell)))
    c = F.col(b)
    return frame.withColumn("_cx", span(c["x"], c["w"])).withColumn("_cy", span(c["y"], c["h"]))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, test: Column | None = None, cell: int = CELL) -> DataFrame:
    """Pairs of boxes ``a`` and ``b`` with equal keys that overlap (or, with ``test``, pass it besides)."""
    both = _cells(left, a, cell).join(_cells(right, b, cell), [*keys, "_cx", "_cy"])
    x, y = F.greatest(F.col(a)["x"], F.col(b)["x"]), F.greatest(F.col(a)["y"], F.col(b)["y"])
    own = (F.col("_cx") == _cell(x, cell)) & (F.col("_cy") == _cell(y, cell))
    out = both.where(own & (G.shared(F.col(a), F.col(b)) > 0))
    return (out if test is None else out.where(test)).drop("_cx", "_cy")


def iou_pairs(boxes: DataFrame, keys: Sequence[str], least: float = 0.7) -> DataFrame:
    """keys, a, b (ordinals, a < b), iou of boxes (columns ord, box) of one page that overlap enough."""
    left = boxes.select(*keys, F.col("ord").alias("a"), F.col("box").alias("box_a"))
    right = boxes.select(*keys, F.col("ord").alias("b"), F.col("box").alias("box_b"))
    own = G.iou(F.col("box_a"), F.col("box_b"))
    return overlap_join(left, right, keys, "box_a", "box_b", (F.col("a") < F.col("b")) & (own >= least)).select(*keys, "a", "b", own.alias("iou"))


def oversized(b: Column, most_w: float = 800, most_h: float = 600, view_w: Column | None = None, view_h: Column | None = None) -> Column:
    out = (b["w"] > most_w) | (b["h"] > most_h)
    if view_w is not None:
        out = out | (b["w"] / view_w > 0.6) | (b["h"] / view_h > 0.6)
    return out


def _iou(p: Sequence[float], q: Sequence[float]) -> float:
    w = min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0])
    h = min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = w * h
    return both / (p[2] * p[3] + q[2] * q[3] - both)


def seed_groups(boxes: Sequence[Sequence[float]], alike: Callable[[int, int], bool]) -> Iterator[list[int]]:
    """Each free item in order is a seed and takes all later free ones that are alike it."""
    taken = [False] * len(boxes)
    for i in range(len(boxes)):
        if not taken[i]:
            own = [i, *(j for j in range(i + 1, len(boxes)) if not taken[j] and alike(i, j))]
            for j in own:
                taken[j] = True
            yield own


def per_page(frame: DataFrame, columns: Sequence[str], run: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``run`` over each page's rows (``columns``, by ordinal), many pages to a Python batch.

    What runs here is sequential within a page by definition, and a page is bounded by what a screen holds.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    pages = frame.groupBy("cycle").agg(F.array_sort(F.collect_list(F.struct("ord", *columns))).alias("rows"))

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in it:
            out = []
            for cycle, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(cycle, *r) for r in run([tuple(r.values()) for r in rows])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(len(names))], names)

    import pyarrow as pa

    kinds = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]
    return pages.mapInArrow(batches, schema)


def dedup_detections(frame: DataFrame, least: float = 0.7) -> DataFrame:
    """cycle, ord, kind, conf, x, y, w, h, members: seeds of one kind, the surest detection, the smallest box.

    Detections without a box are groups of their own and keep their nulls.
    """

    def run(every: list[tuple]) -> list[tuple]:
        rows = [r for r in every if None not in r[3:7]]
        b, out = [r[3:7] for r in rows], [(*r, 1) for r in every if None in r[3:7]]
        for own in seed_groups(b, lambda i, j: rows[i][1] == rows[j][1] and _iou(b[i], b[j]) >= least):
            best = max(own, key=lambda i: (rows[i][2], -i))
            tight = min(own, key=lambda i: (b[i][2] * b[i][3], i))
            out.append((rows[best][0], rows[best][1], rows[best][2], *b[tight], len(own)))
        return out

    return per_page(frame, ["kind", "conf", "x", "y", "w", "h"], run, "cycle long, ord long, kind string, conf double, x double, y double, w double, h double, members long")


def dedup_boxes(frame: DataFrame, least: float = 0.7) -> DataFrame:
    """cycle, ord, x, y, w, h: of each seed's boxes the smallest, whatever their labels."""

    def run(rows: list[tuple]) -> list[tuple]:
        b = [r[1:5] for r in rows]
        return [rows[min(own, key=lambda i: (b[i][2] * b[i][3], i))] for own in seed_groups(b, lambda i, j: _iou(b[i], b[j]) >= least)]

    return per_page(frame, ["x", "y", "w", "h"], run, "cycle long, ord long, x double, y double, w double, h double")


def suppress(frame: DataFrame, most: float = 0.4, merge: float | None = None, top: int = 5000, least_side: float = 8) -> DataFrame:
    """cycle, ord, conf, x, y, w, h: non-maximum suppression; with ``merge`` also by overlap of the smaller box."""

    def covered(p: tuple, q: tuple) -> bool:
        over = _iou(p, q)
        if over > most or merge is None or not over:
            return over > most
        both = over * (p[2] * p[3] + q[2] * q[3]) / (1 + over)
        return both / min(p[2] * p[3], q[2] * q[3]) > merge

    def run(rows: list[tuple]) -> list[tuple]:
        rows, keep = sorted(rows, key=lambda r: (-r[1], r[0])), []
        live = [True] * len(rows)
        for i, r in enumerate(rows):
            if not live[i]:
                continue
            if r[4] >= least_side and r[5] >= least_side:
                keep.append(r)
            if len(keep) >= top:
                break
            for j in range(i + 1, len(rows)):
                live[j] = live[j] and not covered(r[2:6], rows[j][2:6])
        return keep

    return per_page(frame, ["conf", "x", "y", "w", "h"], run, "cycle long, ord long, conf double, x double, y double, w double, h double")


def subdivided(parents: DataFrame, children: DataFrame) -> DataFrame:
    """cycle, parent, ord, x, y, w, h: a parent's fully contained children, or itself."""
    own = parents.select("cycle", F.col("ord").alias("parent"), F.col("box").alias("outer"))
    inner = children.select("cycle", F.col("ord").alias("child"), F.col("box").alias("inner"))
    o, i = F.col("outer"), F.col("inner")
    inside = (F.col("parent") != F.col("child")) & (i["x"] >= o["x"]) & (i["y"] >= o["y"]) & (i["x"] + i["w"] <= o["x"] + o["w"]) & (i["y"] + i["h"] <= o["y"] + o["h"])
    found = overlap_join(own, inner, ["cycle"], "outer", "inner", inside).select("cycle", "parent", "child", "inner")
    both = own.join(found, ["cycle", "parent"], "left")
    b = F.coalesce("inner", "outer")
    return both.select("cycle", "parent", F.coalesce("child", "parent").alias("ord"), *[b[f].alias(f) for f in "xywh"])


def first_match(items: DataFrame, regions: DataFrame, test: Column) -> DataFrame:
    """cycle, item, region: for each item the first region (by ordinal) that passes ``test``; null where none does."""
    found = overlap_join(items, regions, ["cycle"], "item_box", "region_box", test).groupBy("cycle", "item").agg(F.min("region").alias("region"))
    return items.select("cycle", "item").join(found, ["cycle", "item"], "left")


def fusion_test(least_iou: float = 0.5, least_iom: float = 0.8, most_ratio: float = 4.0) -> Column:
    a, b = F.col("item_box"), F.col("region_box")
    big, small = F.greatest(a["w"] * a["h"], b["w"] * b["h"]), F.least(a["w"] * a["h"], b["w"] * b["h"])
    return (small > 0) & ((G.iou(a, b) > least_iou) | ((G.iom(a, b) > least_iom) & (big < small * most_ratio)))


def dirty(elements: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The elements (keys, ord, box) with ``dirty``: an event of the same keys overlaps, or has no box."""
    whole = events.where("box is null").select(*keys).distinct().withColumn("_whole", F.lit(True))
    boxed = events.where("box is not null").select(*keys, F.col("box").alias("_event"))
    hit = overlap_join(elements, boxed, keys, "box", "_event").select(*keys, "ord", "box").distinct().withColumn("_hit", F.lit(True))
    out = elements.join(whole, list(keys), "left").join(hit, [*keys, "ord", "box"], "left")
    return out.withColumn("dirty", F.coalesce("_whole", "_hit", F.lit(False))).drop("_whole", "_hit")


def uncovered_cells(boxes: DataFrame, width: int, height: int, cell: int = CELL) -> DataFrame:
    """cycle, r, c: the grid cells of each page that no box touches."""
    cols, rows = -(-width // cell), -(-height // cell)
    span = lambda lo, n, most: F.sequence(F.greatest(F.lit(0), F.floor(lo / cell)).cast("int"), F.least(F.lit(most - 1), F.floor((lo + n) / cell)).cast("int"))
    in_view = (F.floor(F.col("x") / cell) < cols) & (F.floor(F.col("y") / cell) < rows) & (F.col("x") + F.col("w") >= 0) & (F.col("y") + F.col("h") >= 0)
    covered = boxes.where(in_view).select("cycle", "y", "h", F.explode(span(F.col("x"), F.col("w"), cols)).alias("c")).select("cycle", F.explode(span(F.col("y"), F.col("h"), rows)).alias("r"), "c").distinct()
    every = boxes.select("cycle").distinct().select("cycle", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r")).select("cycle", "r", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"))
    return every.join(covered, ["cycle", "r", "c"], "left_anti")


def coverage_gaps(boxes: DataFrame, width: int, height: int, cell: int = CELL) -> DataFrame:
    """cycle, gap, x, y, w, h: two by two free cells, taken greedily row by row.  A page has a bounded grid."""
    cols, rows = -(-width // cell), -(-height // cell)
    free = uncovered_cells(boxes, width, height, cell).groupBy("cycle").agg(F.collect_set(F.col("r") * cols + F.col("c")).alias("free"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for cycle, cells in zip(batch["cycle"], batch["free"], strict=True):
                left, n = set(map(int, cells)), 0
                for r in range(rows - 1):
                    for c in range(cols - 1):
                        own = {r * cols + c, r * cols + c + 1, (r + 1) * cols + c, (r + 1) * cols + c + 1}
                        if own <= left:
                            left -= own
                            n += 1
                            out.append((cycle, n, float(c * cell), float(r * cell), float(min(width - c * cell, 2 * cell)), float(min(height - r * cell, 2 * cell))))
            yield pd.DataFrame(out, columns=["cycle", "gap", "x", "y", "w", "h"])

    return free.mapInPandas(run, "cycle long, gap int, x double, y double, w double, h double")


def quality_report(expected: DataFrame, actual: DataFrame, good: float = 0.5) -> DataFrame:
    """cycle, ord, best, status: the best overlap of each expected box, and actual boxes that nothing expected."""
    e = expected.select("cycle", F.col("ord").alias("item"), F.col("box").alias("item_box"))
    a = actual.select("cycle", F.col("ord").alias("region"), F.col("box").alias("region_box"))
    own = G.iou(F.col("item_box"), F.col("region_box"))
    pairs = overlap_join(e, a, ["cycle"], "item_box", "region_box").select("cycle", "item", "region", own.alias("iou"), (F.col("region_box")["w"] * F.col("region_box")["h"] > 2 * F.col("item_box")["w"] * F.col("item_box")["h"]).alias("large"))
    best = pairs.groupBy("cycle", "item").agg(F.max("iou").alias("best"), F.max_by("large", F.struct("iou", -F.col("region"))).alias("large"))
    status = F.when(F.col("best").isNull(), "missed").when(F.col("best") >= good, "matched").when(F.col("large"), "over_redaction").otherwise("missed")
    report = e.join(best, ["cycle", "item"], "left").select("cycle", F.col("item").alias("ord"), F.coalesce("best", F.lit(0.0)).alias("best"), status.alias("status"))
    extra = a.join(pairs.select("cycle", "region").distinct(), ["cycle", "region"], "left_anti").select("cycle", F.col("region").alias("ord"), F.lit(0.0).alias("best"), F.lit("unexpected").alias("status"))
    return report.unionByName(extra)


def reading_order(frame: DataFrame, page: str = "cycle", band: int = 16) -> DataFrame:
    """With ``region``: r1, r2, ... by bands of rows, then from the left."""
    n = F.row_number().over(W.partitionBy(page).orderBy(F.floor(F.col("y") / band), "x", "ord"))
    return frame.withColumn("region", F.concat(F.lit("r"), n.cast("string")))


def top_by_area(frame: DataFrame, n: int = 3, page: str = "cycle") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(page).orderBy(F.desc(F.col("w") * F.col("h")), "ord"))
    return frame.withColumn("rank", rank).where(F.col("rank") <= n)


def crop_candidates(elements: DataFrame, n: int = 3, page: str = "cycle") -> DataFrame:
    """With ``rank``: the ``n`` largest visible images of each page that are worth a second look."""
    image = F.col("tag").isin("img", "canvas", "embed") | F.col("has_bg_image") | F.col("rendering").isin("img", "canvas")
    return top_by_area(elements.where(F.col("visible") & F.col("in_viewport") & image & (F.col("w") >= 80) & (F.col("h") >= 50)), n, page)


def from_crop(element: Column, token: Column, view_w: Column, view_h: Column, zoom: int = 2) -> Column:
    """The page box of a token found in an enlarged crop of ``element``; null where it begins outside the view."""
    x, y = (F.greatest(F.lit(0.0), G.js_round(element[c] + token[c] / zoom)) for c in "xy")
    w, h = (F.greatest(F.lit(1.0), F.least(most - at, G.js_round(token[c] / zoom))) for c, most, at in (("w", view_w, x), ("h", view_h, y)))
    return F.when((x < view_w) & (y < view_h), G.box(x, y, w, h))


def _climbed(scratch: Scratch, start: DataFrame, tag: str) -> tuple[list[DataFrame], DataFrame | None]:
    """Frames (frame_id, up, x, y) summed up to their roots, by pointers that reach twice as far each round.

    Gives the finished frames in parts, and those that never finish: the ones that lead into a cycle, with pointers
    some power of two frames up.  A round in which none finishes says so, as chains with an end lose some every round.
    """
    step, done, before, n = start, [], None, 0
    while True:
        done.append(step.where("up is null"))
        live = step.where("up is not null")
        left = live.count()
        if not left:
            return done, None
        if left == before:
            return done[:-1], live
        known = reduce(DataFrame.unionByName, [*done, live]).select(F.col("frame_id").alias("up"), F.col("up").alias("_up"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.lit(True).alias("_known"))
        total = lambda c: F.when(F.col("_known"), F.col(c) + F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        before, n = left, n + 1
        step = scratch.keep(live.join(known, "up", "left").select("frame_id", F.col("_up").alias("up"), total("x"), total("y")), f"{tag}_{n}")


def _cycles(scratch: Scratch, frames: DataFrame, live: DataFrame) -> DataFrame:
    """frame_id, x, y: the frames on cycles, each with the sums over its cycle.  Every pointer of ``live`` leads to one of its rows."""
    step, size, n = live.select("frame_id", "up"), live.select("up").distinct().count(), 0
    while True:  # what twice as many steps still reach is on a cycle
        n += 1
        step = scratch.keep(step.join(step.select(F.col("frame_id").alias("up"), F.col("up").alias("_up")), "up").select("frame_id", F.col("_up").alias("up")), f"ring_{n}")
        before, size = size, step.select("up").distinct().count()
        if size == before:
            break
    ring = scratch.keep(frames.join(step.select(F.col("up").alias("frame_id")).distinct(), "frame_id", "left_semi"), "ring")
    step, changed, n = ring.select("frame_id", "up", F.col("frame_id").alias("low")), 1, 0
    while changed:  # the smallest id of a cycle names it
        n += 1
        ahead = step.select(F.col("frame_id").alias("up"), F.col("up").alias("_up"), F.col("low").alias("_low"))
        step = scratch.keep(step.join(ahead, "up").select("frame_id", F.col("_up").alias("up"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("changed")), f"low_{n}")
        changed = step.where("changed").count()
    named = ring.join(step.select("frame_id", "low"), "frame_id")
    total = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c)
    return named.select("frame_id", "low").join(named.groupBy("low").agg(total("x"), total("y")), "low").select("frame_id", "x", "y")


def frame_offsets(spark, frames: DataFrame) -> DataFrame:
    """frame_id, x, y: offsets summed up the chain of parents; cycles end where a frame comes again.

    Chains may have any depth: rounds grow with its logarithm, and no path is kept.  A parent that isn't there ends
    a chain.  An id names one frame; of several rows the one with the greatest parent, then x and y, counts.
    """
    scratch = Scratch(spark, "frames")
    one = frames.groupBy("frame_id").agg(F.max(F.struct(F.col("parent_frame_id").alias("up"), "x", "y")).alias("f")).select("frame_id", "f.*")
    one = scratch.keep(one, "frames")
    done, live = _climbed(scratch, one, "up")
    if live is not None:
        own = one.join(live.select(F.col("frame_id").alias("_id")), F.col("frame_id").eqNullSafe(F.col("_id")), "left_semi")
        on = scratch.keep(_cycles(scratch, own, live), "cycles")
        rest = own.join(on, "frame_id", "left_anti").select("frame_id", "up", "x", "y")
        done += _climbed(scratch, scratch.keep(rest.unionByName(on.withColumn("up", F.lit(None).cast(own.schema["up"].dataType))), "tails"), "tail")[0]
    return reduce(DataFrame.unionByName, done).select("frame_id", "x", "y")
