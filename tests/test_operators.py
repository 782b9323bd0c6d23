"""Golden values of the detectors and validators, and operators without SQL against brute force."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from veilframe.functions import validators as V
from veilframe.operators import detectors as D
from veilframe.operators import documents as DOC
from veilframe.operators import geometry as G
from veilframe.operators import pages as PG
from veilframe.operators import redaction as R
from veilframe.operators import spatial as S
from veilframe.plans import spatial_queries as SQ
from veilframe.streaming import events as M


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("fn", "good", "bad"), [
    (V.verhoeff, ["5489 1234 5674", "5489-1234-5674", "2345 6789 0124"], ["5489 1234 5678", "1234 5678 9012", "0123 4567 8901", "12345", ""]),
    (V.pan, ["ABCPE1234F", "XYZCA9876K", "DELGA1111Z", "ABCPEI234F"], ["ABCZE1234F", "12345ABCDE", "ABCPE12345", ""]),
    (V.iban, ["GB82WEST12345698765432", "gb82 west 1234 5698 7654 32"], ["GB82WEST12345698765433", "GB82-WEST"]),
    (V.luhn, ["4539 1488 0343 6467"], ["4539 1488 0343 6468", "123"]),
    (V.ssn, ["123-45-6789", "123456789"], ["000-12-3456", "900-12-3456", "123-00-4567"]),
])
def test_golden(spark, fn, good, bad):
    assert all(_one(spark, fn(F.lit(x))) for x in good)
    assert not any(_one(spark, fn(F.lit(x))) for x in bad)
    assert not _one(spark, fn(F.lit(None).cast("string")))


def _found(spark, text):
    frame = spark.createDataFrame([(1, text)], "k int, text string")
    return [(r["subtype"], r["at"]) for r in D.detect_text(frame, ["k"]).orderBy(F.desc("priority"), "occurrence").collect()]


def test_repeats_and_places(spark):
    text = "mail a.b@c.org, then a.b@c.org and x@y.net"
    assert _found(spark, text) == [("EMAIL", text.index("a.b")), ("EMAIL", text.rindex("a.b")), ("EMAIL", text.index("x@"))]


def test_boundaries_are_ascii(spark):
    assert ("IFSC", 1) in _found(spark, "éHDFC0001234 bank branch")
    assert _found(spark, "xHDFC0001234") == []


def test_first_invalid_hides_later(spark):
    assert _found(spark, "000-12-3456 then 123-45-6789") == []


def test_lower_case_evidence_ends_the_search(spark):
    assert _found(spark, "voter abc1234567 and xyz1234567") == [("VOTER_ID", None)]


def test_look_alikes(spark):
    for text in ("ORD-9876543210", "550e8400-e29b-41d4-a716-446655440000", "192.168.1.1", "order 9876543210", "a frying pan ABCZE1234F"):
        assert _found(spark, text) == []


def test_registry_replaces():
    own = D.Registry()
    own.register(D.DetectorSpec("EMAIL", "EMAIL", 101, "<M>", ("EMAIL",), without=0.9))
    assert own.list()[0].token == "<M>" and len(own.list()) == len(D.DETECTORS) and own.get("NONE") is None


def test_region_redaction_is_by_first_occurrence(spark):
    mail = [s for s in D.DETECTORS if s.subtype == "EMAIL"]
    assert _one(spark, R.redact_region(F.lit("to a@b.org or a@b.org"), mail)) == "to <EMAIL> or <EMAIL>"
    assert _one(spark, R.redact_region(F.lit("full name: Ann"))) == "<REDACTED_NAME>"
    assert _one(spark, R.redact_spans(F.lit(None).cast("string"))) == ""


def test_round_half_up(spark):
    assert _one(spark, G.js_round(F.lit(-2.5))) == -2 and _one(spark, G.js_round(F.lit(2.5))) == 3


def _boxes(n, seed):
    r = random.Random(seed)
    return [(1, i, r.choice("AB"), r.random(), float(r.randrange(20)), float(r.randrange(20)), float(20 + r.randrange(9)), float(20 + r.randrange(9))) for i in range(n)]


def _iou(p, q):
    w, h = min(p[4] + p[6], q[4] + q[6]) - max(p[4], q[4]), min(p[5] + p[7], q[5] + q[7]) - max(p[5], q[5])
    return w * h / (p[6] * p[7] + q[6] * q[7] - w * h) if w > 0 and h > 0 else 0.0


SCHEMA = "cycle long, ord long, kind string, conf double, x double, y double, w double, h double"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dedup_and_pairs(spark, seed):
    own = _boxes(40, seed)
    frame = spark.createDataFrame(own, SCHEMA).repartition(3)
    left, expected = list(own), []
    while left:
        seed_ = left[0]
        group = [seed_] + [b for b in left[1:] if b[2] == seed_[2] and _iou(seed_, b) >= 0.7]
        best, tight = max(group, key=lambda b: (b[3], -b[1])), min(group, key=lambda b: (b[6] * b[7], b[1]))
        expected.append((best[1], tight[4], tight[5], tight[6], tight[7], len(group)))
        left = [b for b in left if b not in group]
    got = [(r.ord, r.x, r.y, r.w, r.h, r.members) for r in S.dedup_detections(frame).collect()]
    assert sorted(got) == sorted(expected)
    pairs = S.iou_pairs(frame.withColumn("box", G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))), ["cycle", "kind"])
    brute = {(p[1], q[1]) for p in own for q in own if p[1] < q[1] and p[2] == q[2] and _iou(p, q) >= 0.7}
    assert {(r.a, r.b) for r in pairs.collect()} == brute


def test_coverage_gaps(spark):
    frame = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0)], "cycle long, x double, y double, w double, h double")
    got = [(r.x, r.y, r.w, r.h) for r in S.coverage_gaps(frame, 512, 256).orderBy("gap").collect()]
    assert got == [(128.0, 0.0, 256.0, 256.0)]


def test_document_fields():
    own = ["INCOME TAX DEPARTMENT", "PAN: ABCPJ1234K", "Name: John Doe", "Father's Name: Robert Doe", "Date of Birth: 15/08/1990"]
    assert [(f, c) for _, f, c, _ in DOC.fields_of(own)] == [("PAN", "GOV_ID"), ("NAME", "PERSON"), ("FATHER_NAME", "PERSON"), ("DOB", "DOB")]
    # The value below the label is found from the label's line and from its own.
    assert [(i, f) for i, f, _, _ in DOC.fields_of(["Permanent Account Number", "-", "ABCPJ1234K"])] == [(2, "PAN"), (2, "PAN")]
    assert DOC.fields_of([]) == []


def test_tracker():
    tracks, n = M.match_tracks([], [(0, 0, 10, 10), (50, 50, 10, 10)], 1)
    tracks, n = M.match_tracks(tracks, [(52, 50, 10, 10), (200, 0, 10, 10)], n)
    assert [(t[0], t[1]) for t in tracks] == [(2, 2), (3, 1)] and n == 4


def test_debounce_stream(spark, tmp_path):
    ts = pd.to_datetime([10**9 + t for t in (0, 50, 99, 100, 260, 100_000)], unit="ms")
    frame = spark.createDataFrame(pd.DataFrame({"key": [1] * 6, "ts": ts}))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = M.debounce_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), 100, delay="1 second")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    batch = M.debounce(frame, 100).orderBy("opened").select("events").collect()
    assert [r.events for r in batch] == [3, 1, 1, 1]
    got = spark.table("bursts").orderBy("opened").collect()
    assert [r.events for r in got][:3] == [3, 1, 1], got


def test_identifiers_beyond_the_shown_text(spark):
    words = "word " * 58  # the first address lies across character 300, the second behind it
    page = f"<html><body><p>{words}one.person@example.org and later two@example.org</p></body></html>"
    e = PG.scan(spark.createDataFrame([(1, page)], "page_id long, html string"))
    text = f"{words}one.person@example.org and later two@example.org"
    spans = {(r["kind"], r["at"], r["length"]) for r in PG.inline_spans(e).collect()}
    assert spans == {("EMAIL", text.index(x), len(x)) for x in ("one.person@example.org", "two@example.org")}
    found = D.detect_text(e, ["page_id", "ord"]).where("subtype = 'EMAIL'").collect()
    assert {r["at"] for r in found} == {text.index("one.person"), text.index("two@")}
    assert _one(spark, F.length(PG.masked_text(F.lit(text)))) == 300


def test_dirty_takes_every_event_and_box(spark, data):
    read = lambda name: spark.read.parquet(f"{data}/{name}.parquet").toPandas()
    of = {}
    for e in read("events").itertuples():
        of.setdefault(e.user_id * 100 + e.event_id % 100, []).append((None if e.event_id % 11 == 0 else e.user_id % 600, e.event_id % 400))
    want = Counter()
    for b in read("lineitem").itertuples():
        x, y, w, h = b.l_partkey % 1280, b.l_suppkey % 800, 20 + b.l_quantity, 20 + b.l_partkey % 7 * 10
        hit = any(p is None or x < p + 300 and x + w > p and y < q + 200 and y + h > q for p, q in of.get(b.l_orderkey, ()))
        want[b.l_orderkey, b.l_linenumber, hit] += 1
    got = Counter((r["cycle"], r["ord"], r["dirty"]) for r in SQ.QUERIES["q19_dirty_semi_join"](spark, data).collect())
    assert got == want and any(c >= 500 and d for c, _, d in got)


def test_fallback_elements():
    from veilframe.operators import pages as PG

    html = '<div class="user-card"><p>Hi <b>there</b></p></div><label for="m">Mail</label><input id="m" type="email" value="a@b.co"><label>Secret <input type="password" value="x"></label><a href="/">Go</a><span>no</span><button name="save">Save</button><img alt="">'
    got = [(r[1], r[2], r[3], r[4], r[5], r[12], r[14]) for r in PG.fallback_elements(html)]
    assert got == [
        ("d1", "div", "Hi there", "Hi there", None, None, None), ("d2", "p", "Hi there", "Hi there", None, None, None), ("d3", "label", "Mail", "Mail", None, None, None),
        ("d4", "input", "Mail", "", "textbox", False, "a@b.co"), ("d5", "label", "Secret", "Secret", None, None, None), ("d6", "input", "Secret", "", "textbox", True, None),
        ("d7", "a", "Go", "Go", "link", None, None), ("d8", "button", "save", "Save", "button", None, None), ("d9", "img", None, "", "img", None, None),
    ]
    assert PG.fallback_elements(None) == [] and len(PG.fallback_elements("<p>" + "x" * 500)[0][4]) == 200


def test_overlaps_off_the_page(spark):
    from veilframe.operators import geometry as GE
    from veilframe.operators import spatial as SP

    rows = [(1, 1, 0.0, 0.0, 1e9, 10.0), (1, 2, 9e8, 5.0, 10.0, 1e9), (1, 3, -1e7, -1e7, 5.0, 5.0), (1, 4, -1e7, -1e7, 5.0, 5.0), (1, 5, 40_000.0, 0.0, 5.0, 5.0), (1, 6, 50_000.0, 0.0, 5.0, 5.0)]
    own = spark.createDataFrame(rows, "cycle long, ord long, x double, y double, w double, h double").select("cycle", "ord", GE.box(*[F.col(c) for c in "xywh"]).alias("box"))
    other = own.select("cycle", F.col("ord").alias("b"), F.col("box").alias("other"))
    got = SP.overlap_join(own, other, ["cycle"], "box", "other", F.col("ord") < F.col("b"))
    assert sorted((r.ord, r.b) for r in got.collect()) == [(1, 2), (1, 5), (1, 6), (3, 4)]


def test_deep_frames_are_whole(spark):
    from veilframe.operators import spatial as SP

    frames = spark.createDataFrame([(str(i), str(i - 1) if i else None, 1.0, 2.0) for i in range(60)], "frame_id string, parent_frame_id string, x double, y double")
    assert {r.frame_id: (r.x, r.y) for r in SP.frame_offsets(spark, frames).collect()}["59"] == (60.0, 120.0)


def test_frames_without_limits(spark):
    """Beyond the limits of Spark's recursion: a chain 300 deep, more than a million steps of short chains; cycles end."""
    from veilframe.operators import spatial as SP

    schema = "frame_id string, parent_frame_id string, x double, y double"
    read = lambda own: {r.frame_id: (r.x, r.y) for r in SP.frame_offsets(spark, spark.createDataFrame(own, schema)).collect()}
    assert read([(str(i), str(i - 1) if i else "gone", 1.0, float(i)) for i in range(300)]) == {str(i): (i + 1.0, i * (i + 1) / 2) for i in range(300)}
    ring = [(f"r{i}", f"r{(i + 1) % 7}", 2.0**i, 1.0) for i in range(7)] + [("self", "self", 5.0, 1.0), ("own", "self", 1.0, 1.0), (None, "r0", 1.0, 1.0), ("null", None, None, 2.0), ("below", "null", 1.0, 1.0)]
    tail = [(f"t{i}", f"t{i - 1}" if i else "r3", 1000.0, 1.0) for i in range(20)]
    got = read(ring + tail + ring)
    assert got == {f"r{i}": (127.0, 7.0) for i in range(7)} | {"self": (5.0, 1.0), "own": (6.0, 2.0), None: (128.0, 8.0), "null": (None, 2.0), "below": (None, 3.0)} | {f"t{i}": (1127.0 + 1000 * i, 8.0 + i) for i in range(20)}
    wide = spark.range(400_000).selectExpr("CAST(id AS STRING) frame_id", "IF(id % 5 = 0, NULL, CAST(id - 1 AS STRING)) parent_frame_id", "1D x", "CAST(id AS DOUBLE) y")
    sums = SP.frame_offsets(spark, wide).selectExpr("CAST(frame_id AS LONG) k", "x", "y").selectExpr("count(*) n", "count_if(x = k % 5 + 1 AND y = (k % 5 + 1) * (k - (k % 5) / 2)) good").first()
    assert (sums.n, sums.good) == (400_000, 400_000)
