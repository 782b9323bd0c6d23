"""Queries over boxes: geometry, joins, deduplication, windows and aggregates, on boxes derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import geometry as G
from ..operators import spatial as S
from .derived import BOXES, CLOSE, inputs, oracle

QUERIES, ORACLES = {}, {}
_K = ["cycle", "ord"]


def _b():
    return G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))


def _part():
    return G.box(F.lit(300.0), F.lit(200.0), F.lit(500.0), F.lit(300.0))


_OB, _OC = oracle(BOXES), oracle(CLOSE)


def _flat(b, *more):
    return [*_K, *[F.round(b[f], 4).alias(f"r{f}") for f in "xywh"], *more]


def _scalar(name: str, columns, sql: str, source: str = BOXES) -> None:
    QUERIES[name] = lambda spark, sf_dir: inputs(spark, sf_dir, source).select(*columns())
    ORACLES[name] = f"SELECT cycle, ord, {sql} FROM ({oracle(source)})"


def _r(**exprs: str) -> str:
    return ", ".join(f"round({e}, 4) {n}" for n, e in exprs.items())


_scalar("g02_image_px", lambda: _flat(G.scaled(_b(), F.col("ord") - 1.0)), _r(**{f"r{f}": f"{f} * CASE WHEN ord > 1 THEN ord - 1.0 ELSE 1 END" for f in "xywh"}))
_scalar("g02_css_px", lambda: _flat(G.scaled(_b(), F.col("ord") - 1.0, up=False)), _r(**{f"r{f}": f"{f} / CASE WHEN ord > 1 THEN ord - 1.0 ELSE 1 END" for f in "xywh"}))
_scalar("g03_padded", lambda: _flat(G.padded(_b(), 8, F.lit(1280), F.lit(800))), _r(rx="greatest(0, x - 8)", ry="greatest(0, y - 8)", rw="greatest(0, least(1280, x + w + 8) - greatest(0, x - 8))", rh="greatest(0, least(800, y + h + 8) - greatest(0, y - 8))"))
_scalar("g04_rounded", lambda: _flat(G.rounded(G.moved(_b(), F.lit(-400.5), F.lit(-300.5)), 4)), _r(rx="floor((x - 400.5) / 4 + 0.5) * 4", ry="floor((y - 300.5) / 4 + 0.5) * 4", rw="floor(w / 4 + 0.5) * 4", rh="floor(h / 4 + 0.5) * 4"))
_scalar("g05_center", lambda: [*_K, F.round(G.center(_b())["x"], 4).alias("cx"), F.round(G.center(_b())["y"], 4).alias("cy"), G.contains_point(_b(), F.lit(640.0), F.lit(400.0)).alias("inside")], _r(cx="x + w / 2", cy="y + h / 2") + ", 640 BETWEEN x AND x + w AND 400 BETWEEN y AND y + h inside")
_scalar("g06_intersection", lambda: _flat(G.intersection(_b(), _part())), ", ".join(f"CASE WHEN least(x + w, 800) > greatest(x, 300) AND least(y + h, 500) > greatest(y, 200) THEN round({e}, 4) END r{f}" for f, e in {"x": "greatest(x, 300)", "y": "greatest(y, 200)", "w": "least(x + w, 800) - greatest(x, 300)", "h": "least(y + h, 500) - greatest(y, 200)"}.items()))
_scalar("g07_area", lambda: [*_K, F.round(G.area(G.box(F.col("x"), F.col("y"), F.col("w") - 30, F.col("h"))), 4).alias("area")], _r(area="greatest(0, w - 30) * greatest(0, h)"))
_I = "greatest(0, least(x + w, 800) - greatest(x, 300)) * greatest(0, least(y + h, 500) - greatest(y, 200))"
_scalar("g08_iou", lambda: [*_K, F.round(G.iou(_b(), _part()), 4).alias("iou")], _r(iou=f"({_I}) / (w * h + 150000 - ({_I}))"))
_scalar("g09_iom", lambda: [*_K, F.round(G.iom(_b(), _part()), 4).alias("iom")], _r(iom=f"({_I}) / least(w * h, 150000)"))
_scalar("g11_drift", lambda: [*_K, F.round(G.drift(_b(), _part()), 4).alias("drift"), (G.drift(_b(), _part()) > 32).alias("moved")], "round(sqrt((x - 300) * (x - 300) + (y - 200) * (y - 200)), 4) drift, sqrt((x - 300) * (x - 300) + (y - 200) * (y - 200)) > 32 moved")
_scalar("g12_clipped", lambda: _flat(G.clipped(_b(), F.lit(1.5), F.lit(1.5), F.lit(1600.0), F.lit(1000.0))), _r(rx="greatest(0, floor(x * 1.5))", ry="greatest(0, floor(y * 1.5))", rw="greatest(0, least(ceil(w * 1.5), 1600 - greatest(0, floor(x * 1.5))))", rh="greatest(0, least(ceil(h * 1.5), 1000 - greatest(0, floor(y * 1.5))))"))

_FRAMES = "SELECT CAST(c_custkey AS STRING) frame_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey - c_custkey % 5 + c_custkey % 5 - 1 AS STRING) END parent_frame_id, CAST(c_custkey % 13 AS DOUBLE) x, CAST(c_custkey % 7 AS DOUBLE) y FROM {customer}"
QUERIES["g10_frame_offsets"] = lambda spark, sf_dir: S.frame_offsets(spark, inputs(spark, sf_dir, _FRAMES))
ORACLES["g10_frame_offsets"] = f"""WITH RECURSIVE f AS ({oracle(_FRAMES)}), up AS (SELECT frame_id, parent_frame_id p, x, y, 1 d FROM f UNION ALL
SELECT up.frame_id, f.parent_frame_id, up.x + f.x, up.y + f.y, d + 1 FROM up JOIN f ON f.frame_id = up.p)
SELECT frame_id, arg_max(x, d) x, arg_max(y, d) y FROM up GROUP BY frame_id"""


def _boxes(spark, sf_dir, source=BOXES):
    return inputs(spark, sf_dir, source).withColumn("box", _b())


def _overlap(a: str, b: str) -> str:
    return f"greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"


_IOU = f"({_overlap('p', 'q')}) / (p.w * p.h + q.w * q.h - ({_overlap('p', 'q')}))"
QUERIES["q13_iou_pairs"] = lambda spark, sf_dir: S.iou_pairs(_boxes(spark, sf_dir, CLOSE), ["cycle", "kind"]).select("cycle", "kind", "a", "b", F.round("iou", 4).alias("iou"))
ORACLES["q13_iou_pairs"] = f"WITH b AS ({_OC}) SELECT p.cycle, p.kind, p.ord a, q.ord b, round({_IOU}, 4) iou FROM b p JOIN b q ON p.cycle = q.cycle AND p.kind = q.kind AND p.ord < q.ord WHERE {_IOU} >= 0.7"
QUERIES["h02_dedup_detections"] = lambda spark, sf_dir: S.dedup_detections(inputs(spark, sf_dir, CLOSE))
QUERIES["h03_dedup_boxes"] = lambda spark, sf_dir: S.dedup_boxes(inputs(spark, sf_dir, CLOSE))
QUERIES["h13_suppression"] = lambda spark, sf_dir: S.suppress(inputs(spark, sf_dir, CLOSE))
QUERIES["h14_tile_merge"] = lambda spark, sf_dir: S.suppress(inputs(spark, sf_dir, CLOSE), merge=0.8)


def _greedy(alike: str, order: str, out: str) -> str:
    """Seeds by recursion over the rank in a page: a row is a seed if no seed before it is alike."""
    return f"""WITH RECURSIVE b AS (SELECT *, CAST(row_number() OVER (PARTITION BY cycle ORDER BY {order}) AS BIGINT) n FROM ({_OC})),
walk AS (SELECT cycle, 1 n, [n] seeds FROM b WHERE n = 1 UNION ALL
SELECT w.cycle, w.n + 1, CASE WHEN EXISTS (SELECT 1 FROM b p WHERE p.cycle = w.cycle AND list_contains(w.seeds, p.n) AND {alike}) THEN w.seeds ELSE list_append(w.seeds, q.n) END
FROM walk w JOIN b q ON q.cycle = w.cycle AND q.n = w.n + 1),
seeds AS (SELECT cycle, unnest(arg_max(seeds, n)) s FROM walk GROUP BY cycle) {out}"""


ORACLES["h13_suppression"] = _greedy(f"{_IOU} > 0.4", "conf DESC, ord", "SELECT b.cycle, b.ord, conf, x, y, w, h FROM b JOIN seeds ON b.cycle = seeds.cycle AND b.n = seeds.s")
def _grouped(alike: str, out: str) -> str:
    """Groups of seeds in order: a row belongs to the first seed before it that is alike it, or is one itself."""
    return _greedy(alike, "ord", f""", g AS (SELECT q.cycle, q.ord, q.n, q.kind, q.conf, q.x, q.y, q.w, q.h, min(p.n) seed FROM b q JOIN seeds s ON s.cycle = q.cycle JOIN b p ON p.cycle = s.cycle AND p.n = s.s AND p.n <= q.n
WHERE p.n = q.n OR ({alike}) GROUP BY ALL) {out}""")


_TIGHT = ", ".join(f"arg_min({c}, (w * h, n)) {c}" for c in "xywh")
ORACLES["h02_dedup_detections"] = _grouped(f"p.kind = q.kind AND {_IOU} >= 0.7", f"SELECT cycle, arg_max(ord, (conf, -n)) ord, any_value(kind) kind, max(conf) conf, {_TIGHT}, count(*) members FROM g GROUP BY cycle, seed")
ORACLES["h03_dedup_boxes"] = _grouped(f"{_IOU} >= 0.7", f"SELECT cycle, arg_min(ord, (w * h, n)) ord, {_TIGHT} FROM g GROUP BY cycle, seed")
QUERIES["q15_oversized_filter"] = lambda spark, sf_dir: _boxes(spark, sf_dir).where(~S.oversized(F.col("box"), 60, 75, F.lit(100.0), F.lit(120.0))).select("cycle", "ord", "w", "h")
ORACLES["q15_oversized_filter"] = f"SELECT cycle, ord, w, h FROM ({_OB}) WHERE NOT (w > 60 OR h > 75 OR w / 100 > 0.6 OR h / 120 > 0.6)"
QUERIES["h05_subdivided"] = lambda spark, sf_dir: S.subdivided(_boxes(spark, sf_dir, CLOSE).where("w > 65"), _boxes(spark, sf_dir, CLOSE).where("w <= 65"))
ORACLES["h05_subdivided"] = f"""WITH b AS ({_OC}), hit AS (SELECT p.cycle, p.ord parent, q.ord, q.x, q.y, q.w, q.h FROM b p JOIN b q ON p.cycle = q.cycle AND p.w > 65 AND q.w <= 65 AND q.x >= p.x AND q.y >= p.y AND q.x + q.w <= p.x + p.w AND q.y + q.h <= p.y + p.h)
SELECT * FROM hit UNION ALL SELECT cycle, ord, ord, x, y, w, h FROM b WHERE w > 65 AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.cycle = b.cycle AND hit.parent = b.ord)"""


def _fused(spark, sf_dir, test):
    b = _boxes(spark, sf_dir, CLOSE)
    items = b.where("kind <> 'R'").select("cycle", F.col("ord").alias("item"), F.col("box").alias("item_box"))
    regions = b.where("kind = 'R'").select("cycle", F.col("ord").alias("region"), F.col("box").alias("region_box"))
    return S.first_match(items, regions, test)


def _fused_sql(test: str) -> str:
    return f"WITH b AS ({_OC}) SELECT p.cycle, p.ord item, min(q.ord) FILTER ({test}) region FROM b p LEFT JOIN b q ON p.cycle = q.cycle AND q.kind = 'R' WHERE p.kind <> 'R' GROUP BY p.cycle, p.ord"


_IOM = f"({_overlap('p', 'q')}) / least(p.w * p.h, q.w * q.h)"
ORACLES["h14_tile_merge"] = _greedy(f"({_IOU} > 0.4 OR {_IOM} > 0.8)", "conf DESC, ord", "SELECT b.cycle, b.ord, conf, x, y, w, h FROM b JOIN seeds ON b.cycle = seeds.cycle AND b.n = seeds.s")
QUERIES["h06_spatial_fusion"] = lambda spark, sf_dir: _fused(spark, sf_dir, G.iou(F.col("item_box"), F.col("region_box")) >= 0.5)
ORACLES["h06_spatial_fusion"] = _fused_sql(f"{_IOU} >= 0.5")
QUERIES["h07_frame_fusion"] = lambda spark, sf_dir: _fused(spark, sf_dir, S.fusion_test())
ORACLES["h07_frame_fusion"] = _fused_sql(f"{_IOU} > 0.5 OR ({_IOM} > 0.8 AND greatest(p.w * p.h, q.w * q.h) < 4 * least(p.w * p.h, q.w * q.h))")


def _inside(spark, sf_dir):
    b = _boxes(spark, sf_dir, CLOSE)
    images = b.where("kind = 'R'").select("cycle", F.col("ord").alias("image"), G.box(F.col("x") - 10, F.col("y") - 10, F.col("w") + 20, F.col("h") + 20).alias("outer"))
    tokens = b.where("kind <> 'R'").select("cycle", F.col("ord").alias("token"), F.col("box").alias("inner"))
    o, i = F.col("outer"), F.col("inner")
    return S.overlap_join(images, tokens, ["cycle"], "outer", "inner", (i["x"] >= o["x"]) & (i["y"] >= o["y"]) & (i["x"] + i["w"] <= o["x"] + o["w"]) & (i["y"] + i["h"] <= o["y"] + o["h"])).select("cycle", "image", "token")


QUERIES["h09_tokens_in_images"] = _inside
ORACLES["h09_tokens_in_images"] = f"WITH b AS ({_OC}) SELECT p.cycle, p.ord image, q.ord token FROM b p JOIN b q ON p.cycle = q.cycle AND p.kind = 'R' AND q.kind <> 'R' AND q.x >= p.x - 10 AND q.y >= p.y - 10 AND q.x + q.w <= p.x + p.w + 10 AND q.y + q.h <= p.y + p.h + 10"
_ROUTES = "SELECT o_orderkey cycle, o_orderpriority level FROM {orders}"
QUERIES["h08_routed"] = lambda spark, sf_dir: inputs(spark, sf_dir, BOXES).where("conf > 0.6").join(inputs(spark, sf_dir, _ROUTES).where("level in ('1-URGENT', '2-HIGH')"), "cycle", "left_semi").select("cycle", "ord", "kind")
ORACLES["h08_routed"] = f"SELECT cycle, ord, kind FROM ({_OB}) WHERE conf > 0.6 AND cycle IN (SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))"
QUERIES["h10_element_lookup"] = lambda spark, sf_dir: inputs(spark, sf_dir, BOXES).select("cycle", "ord").join(inputs(spark, sf_dir, _ROUTES), "cycle", "left")
ORACLES["h10_element_lookup"] = f"SELECT b.cycle, ord, o_orderpriority level FROM ({_OB}) b LEFT JOIN orders ON cycle = o_orderkey"
#: Every event, dealt over all pages.
_DIRTY = "SELECT user_id * 100 + event_id % 100 cycle, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(user_id % 600 AS DOUBLE) END x, CAST(event_id % 400 AS DOUBLE) y FROM {events}"


def _dirty(spark, sf_dir):
    events = inputs(spark, sf_dir, _DIRTY).select("cycle", F.when(F.col("x").isNotNull(), G.box(F.col("x"), F.col("y"), F.lit(300.0), F.lit(200.0))).alias("box"))
    return S.dirty(_boxes(spark, sf_dir).select("cycle", "ord", "box"), events, ["cycle"]).select("cycle", "ord", "dirty")


QUERIES["q19_dirty_semi_join"] = _dirty
ORACLES["q19_dirty_semi_join"] = f"""WITH b AS ({_OB}), e AS ({oracle(_DIRTY)}) SELECT cycle, ord, EXISTS (SELECT 1 FROM e WHERE e.cycle = b.cycle AND
(e.x IS NULL OR (b.x < e.x + 300 AND b.x + b.w > e.x AND b.y < e.y + 200 AND b.y + b.h > e.y))) dirty FROM b"""
QUERIES["q20_coverage_cells"] = lambda spark, sf_dir: S.uncovered_cells(inputs(spark, sf_dir, BOXES), 1280, 800)
ORACLES["q20_coverage_cells"] = f"""WITH b AS ({_OB}) SELECT cycle, CAST(r AS INTEGER) r, CAST(c AS INTEGER) c FROM (SELECT DISTINCT cycle FROM b), range(0, 7) t(r), range(0, 10) u(c)
WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.cycle = cycle AND false) AND (cycle, r, c) NOT IN (SELECT b.cycle, r2.r, c2.c FROM b, range(0, 7) r2(r), range(0, 10) c2(c) WHERE c BETWEEN floor(x / 128) AND floor((x + w) / 128) AND r BETWEEN floor(y / 128) AND floor((y + h) / 128))"""
QUERIES["h12_coverage_gaps"] = lambda spark, sf_dir: S.coverage_gaps(inputs(spark, sf_dir, BOXES), 1280, 800)
#: The first free square of a page from a cell on, row by row; what it takes isn't free for the next one.
ORACLES["h12_coverage_gaps"] = f"""WITH RECURSIVE f AS (SELECT cycle, list(r * 10 + c) cells FROM ({ORACLES["q20_coverage_cells"]}) GROUP BY cycle),
w AS (SELECT cycle, cells, -1 pos, 0 gap, false hit FROM f UNION ALL
SELECT cycle, CASE WHEN ok THEN list_filter(cells, lambda k: k NOT IN (n, n + 1, n + 10, n + 11)) ELSE cells END, n, gap + CAST(ok AS INTEGER), ok
FROM (SELECT *, n % 10 < 9 AND list_has_all(cells, [n, n + 1, n + 10, n + 11]) ok FROM (SELECT *, pos + 1 n FROM w WHERE pos < 59)))
SELECT cycle, CAST(gap AS INTEGER) gap, CAST(pos % 10 * 128 AS DOUBLE) x, CAST(pos // 10 * 128 AS DOUBLE) y, CAST(least(1280 - pos % 10 * 128, 256) AS DOUBLE) w, CAST(least(800 - pos // 10 * 128, 256) AS DOUBLE) h FROM w WHERE hit"""


def _report(spark, sf_dir):
    b = _boxes(spark, sf_dir, CLOSE)
    return S.quality_report(b.where("kind = 'R'"), b.where("kind = 'A'")).withColumn("best", F.round("best", 4))


QUERIES["h15_quality_report"] = _report
ORACLES["h15_quality_report"] = f"""WITH b AS ({_OC}), pair AS (SELECT p.cycle, p.ord e, q.ord a, {_IOU} v, q.w * q.h > 2 * p.w * p.h large FROM b p JOIN b q ON p.cycle = q.cycle AND p.kind = 'R' AND q.kind = 'A' WHERE {_overlap('p', 'q')} > 0),
best AS (SELECT cycle, e, max(v) v, arg_max(large, (v, -a)) large FROM pair GROUP BY ALL)
SELECT b.cycle, b.ord, round(coalesce(v, 0), 4) best, CASE WHEN v IS NULL THEN 'missed' WHEN v >= 0.5 THEN 'matched' WHEN large THEN 'over_redaction' ELSE 'missed' END status FROM b LEFT JOIN best ON b.cycle = best.cycle AND b.ord = e WHERE kind = 'R'
UNION ALL SELECT cycle, ord, 0, 'unexpected' FROM b WHERE kind = 'A' AND NOT EXISTS (SELECT 1 FROM pair WHERE pair.cycle = b.cycle AND a = b.ord)"""

QUERIES["q16_reading_order"] = lambda spark, sf_dir: S.reading_order(inputs(spark, sf_dir, BOXES)).select("cycle", "ord", "region")
ORACLES["q16_reading_order"] = f"SELECT cycle, ord, 'r' || row_number() OVER (PARTITION BY cycle ORDER BY floor(y / 16), x, ord) region FROM ({_OB})"
QUERIES["q22_top3_area"] = lambda spark, sf_dir: S.top_by_area(inputs(spark, sf_dir, BOXES)).select("cycle", "ord", F.col("rank").cast("bigint").alias("rank"))
ORACLES["q22_top3_area"] = f"SELECT * FROM (SELECT cycle, ord, row_number() OVER (PARTITION BY cycle ORDER BY w * h DESC, ord) AS rank FROM ({_OB})) WHERE rank <= 3"
_IMAGES = """SELECT l_orderkey cycle, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) ord, CASE l_partkey % 3 WHEN 0 THEN 'img' WHEN 1 THEN 'div' ELSE 'canvas' END tag, l_suppkey % 4 = 0 has_bg_image, 'html' rendering,
l_partkey % 5 <> 0 visible, l_orderkey % 7 <> 0 in_viewport, CAST(l_partkey % 1400 AS DOUBLE) x, CAST(l_suppkey % 700 AS DOUBLE) y, CAST(60 + l_partkey % 90 AS DOUBLE) w, CAST(40 + (l_partkey * 7) % 50 AS DOUBLE) h, CAST(l_quantity * 3 AS DOUBLE) tx FROM {lineitem}"""


def crop_tokens(spark, sf_dir):
    own = S.crop_candidates(inputs(spark, sf_dir, _IMAGES))
    token = G.box(F.col("tx"), F.col("tx") / 2, F.col("tx") + 1, F.lit(15.0))
    return own.withColumn("t", S.from_crop(_b(), token, F.lit(1280.0), F.lit(800.0))).where("t is not null").select("cycle", "ord", F.col("rank").cast("bigint").alias("rank"), *[F.col(f"t.{c}").cast("double").alias(f"t{c}") for c in "xywh"])


QUERIES["a07_crop_tokens"] = crop_tokens
ORACLES["a07_crop_tokens"] = f"""SELECT cycle, ord, rank, rx tx, ry ty, greatest(1, least(1280 - rx, floor((tx + 1) / 2 + 0.5))) tw, greatest(1, least(800 - ry, 8)) th FROM (SELECT *, floor(x + tx / 2 + 0.5) rx, floor(y + tx / 4 + 0.5) ry,
row_number() OVER (PARTITION BY cycle ORDER BY w * h DESC, ord) AS rank FROM ({oracle(_IMAGES)}) WHERE visible AND in_viewport AND (tag <> 'div' OR has_bg_image) AND w >= 80 AND h >= 50) WHERE rank <= 3 AND rx < 1280 AND ry < 800"""
_EV = "SELECT event_id, user_id, ts, event_type FROM {events}"
QUERIES["q21_recent_hashes"] = lambda spark, sf_dir: inputs(spark, sf_dir, _EV).select("event_id", "user_id", F.array_join(F.collect_list(F.substring(F.sha2(F.concat_ws("|", "event_type", "event_id"), 256), 1, 16)).over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)), ",").alias("recent"))
ORACLES["q21_recent_hashes"] = "SELECT event_id, user_id, array_to_string(list(substr(sha256(event_type || '|' || event_id), 1, 16)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), ',') recent FROM events"
_TILES = "SELECT CAST(p_partkey AS BIGINT) image, CAST(700 + p_size * 40 AS BIGINT) w, CAST(650 + p_size * 20 AS BIGINT) h FROM {part}"


def tiles(spark, sf_dir, size: int = 640, stride: int = 384, most: int = 64):
    """Tiles of images larger than the detector's input, at 60 % of its side; at most ``most`` for an image."""
    at = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col(n) - size + stride - 1, F.lit(0)), F.lit(stride).cast("bigint")))
    out = inputs(spark, sf_dir, _TILES).withColumn("y", at("h")).withColumn("x", at("w"))
    rank = F.row_number().over(W.partitionBy("image").orderBy("y", "x"))
    return out.withColumn("n", rank).where(F.col("n") <= most).select("image", "x", "y", F.least(F.lit(size), F.col("w") - F.col("x")).cast("bigint").alias("tw"), F.least(F.lit(size), F.col("h") - F.col("y")).cast("bigint").alias("th"))


QUERIES["j06_tiles"] = tiles
ORACLES["j06_tiles"] = f"""SELECT image, x, y, CAST(least(640, w - x) AS BIGINT) tw, CAST(least(640, h - y) AS BIGINT) th FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY y, x) n FROM
(SELECT *, unnest(range(0, greatest(w - 640 + 383, 0) + 1, 384)) x FROM (SELECT *, unnest(range(0, greatest(h - 640 + 383, 0) + 1, 384)) y FROM ({oracle(_TILES)})))) WHERE n <= 64"""

# -- aggregates -------------------------------------------------------------------------------------------

QUERIES["i02_summary_counts"] = lambda spark, sf_dir: inputs(spark, sf_dir, BOXES).groupBy("cycle", "kind").agg(F.count(F.lit(1)).alias("n"))
ORACLES["i02_summary_counts"] = f"SELECT cycle, kind, count(*) n FROM ({_OB}) GROUP BY ALL"
QUERIES["q33_mask_area"] = lambda spark, sf_dir: inputs(spark, sf_dir, BOXES).where((F.col("w") < 800) & (F.col("h") < 600) & ((F.col("w") * F.col("h") <= 4000) | (F.col("kind") == "R"))).groupBy("cycle").agg(F.round(F.sum(F.col("w") * F.col("h")), 4).alias("area"), F.count(F.lit(1)).alias("boxes"))
ORACLES["q33_mask_area"] = f"SELECT cycle, round(sum(w * h), 4) area, count(*) boxes FROM ({_OB}) WHERE w < 800 AND h < 600 AND (w * h <= 4000 OR kind = 'R') GROUP BY cycle"
QUERIES["i05_sources"] = lambda spark, sf_dir: inputs(spark, sf_dir, BOXES).groupBy("cycle").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("sources"))
ORACLES["i05_sources"] = f"SELECT cycle, array_to_string(list_sort(list(DISTINCT kind)), ',') sources FROM ({_OB}) GROUP BY cycle"
QUERIES["i06_surest"] = lambda spark, sf_dir: inputs(spark, sf_dir, BOXES).groupBy("cycle").agg(F.max_by("ord", F.struct("conf", -F.col("ord"))).alias("ord"), F.round(F.max("conf"), 4).alias("conf"))
ORACLES["i06_surest"] = f"SELECT cycle, arg_max(ord, (conf, -ord)) ord, round(max(conf), 4) conf FROM ({_OB}) GROUP BY cycle"
QUERIES["i07_tightest"] = lambda spark, sf_dir: inputs(spark, sf_dir, BOXES).groupBy("cycle").agg(F.min_by("ord", F.struct(F.col("w") * F.col("h"), "ord")).alias("ord"), F.min(F.col("w") * F.col("h")).alias("area"))
ORACLES["i07_tightest"] = f"SELECT cycle, arg_min(ord, (w * h, ord)) ord, min(w * h) area FROM ({_OB}) GROUP BY cycle"
QUERIES["i08_any_every"] = lambda spark, sf_dir: inputs(spark, sf_dir, BOXES).groupBy("cycle").agg(F.bool_or(F.col("w") * F.col("h") >= 2500).alias("visual"), F.bool_and(F.col("conf") > 0.55).alias("sure"))
ORACLES["i08_any_every"] = f"SELECT cycle, bool_or(w * h >= 2500) visual, bool_and(conf > 0.55) sure FROM ({_OB}) GROUP BY cycle"
QUERIES["i09_latency"] = lambda spark, sf_dir: inputs(spark, sf_dir, "SELECT event_type stage, value FROM {events}").groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 4).alias("median"), F.round(F.max("value"), 4).alias("most"))
ORACLES["i09_latency"] = "SELECT event_type stage, count(*) n, round(avg(value), 4) mean, round(quantile_cont(value, 0.5), 4) median, round(max(value), 4) most FROM events GROUP BY ALL"
QUERIES["i11_vision_stats"] = lambda spark, sf_dir: inputs(spark, sf_dir, BOXES).groupBy("kind").agg(F.count(F.lit(1)).alias("calls"), F.sum((F.col("w") * F.col("h")).cast("bigint")).alias("pixels"))
ORACLES["i11_vision_stats"] = f"SELECT kind, count(*) calls, CAST(sum(w * h) AS BIGINT) pixels FROM ({_OB}) GROUP BY kind"
