"""Event logs, attested sinks, the keyed store, and the detectors' registry in text mode."""

import hashlib

from pyspark.sql import functions as F
from veilframe.operators import classifier as C
from veilframe.operators import detectors as D
from veilframe.operators import documents as DOC
from veilframe.operators import spatial as S
from veilframe.sources import events_log as E


def test_events_keep_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"event_id":"1","type":"click","ts":5,"tab":2,"payload":"x","more":1}\n\nnot json\n{"event_id":"2"}\n')
    got = {r.event_id: r for r in E.read_events(spark, str(tmp_path)).collect()}
    assert (got["1"].ts, got["1"].tab, got["1"]._bad) == (5, 2, None) and got["2"].type is None and got[None]._bad == "not json" and len(got) == 3


def test_events_round_trip_and_stream(spark, tmp_path):
    rows = [(str(i), "t", i, 1, None if i % 2 else "p") for i in range(20)]
    frame = spark.createDataFrame(rows, E.EVENT)
    E.write_events(frame, str(tmp_path / "log"))
    back = E.read_events(spark, str(tmp_path / "log")).drop("_bad")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    out = E.stream_events(spark, str(tmp_path / "log")).writeStream.format("memory").queryName("events_log").trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert spark.table("events_log").count() == 20


def test_only_attested_bodies_leave(spark, tmp_path):
    sha = hashlib.sha256(b"body").hexdigest()
    frame = spark.createDataFrame([("body", sha), ("bodY", sha), ("body", None), (None, sha)], "body string, sha256 string")
    E.write_attested(frame, str(tmp_path / "out"))
    assert [r.body for r in spark.read.json(str(tmp_path / "out")).collect()] == ["body"]


def test_keyed_store(spark, tmp_path):
    store = E.KeyedStore(spark, str(tmp_path / "store"))
    kind = "key string, value string, version long"
    store.put(spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1)], kind))
    store.put(spark.createDataFrame([("a", "2", 2), ("b", None, 2)], kind))
    assert sorted((r.key, r.value, r.version) for r in store.get().collect()) == [("a", "2", 2), ("c", "1", 1)]
    assert [r.value for r in store.get(spark.createDataFrame([("a",), ("z",)], "key string")).collect()] == ["2"]
    assert store.compact(str(tmp_path / "next")).get().count() == 2


def test_registry_in_text_mode(spark):
    own = D.Registry()
    own.register(D.DetectorSpec("BADGE", "IDENTIFIER", 99, "<BADGE>", ("VOTER",), None, with_context=0.9, without=0.9))
    frame = spark.createDataFrame([(1, "badge ABC1234567")], "k long, text string")
    assert {r.subtype for r in D.detect_text(frame, ["k"], specs=own).collect()} == {"BADGE"} and D.detect_text(frame, ["k"]).count() == 0


def test_evidence_holds_no_values(spark):
    frame = spark.createDataFrame([("My e-mail x@y.org", "email")], "label string, type string")
    got = frame.select(C.classify({"label": F.col("label"), "type": F.col("type"), "value": F.lit("z@w.org")}).alias("r")).first().r
    assert got.category == "EMAIL" and not any("@" in e.field + e.rule for e in got.evidence)


def test_detections_without_boxes_pass(spark):
    frame = spark.createDataFrame([(1, 1, "A", 0.5, None, None, None, None), (1, 2, "A", 0.9, 0.0, 0.0, 9.0, 9.0), (1, 3, "A", 0.8, 0.0, 0.0, 9.0, 9.0)], "cycle long, ord long, kind string, conf double, x double, y double, w double, h double")
    assert sorted((r.ord, r.members, r.x) for r in S.dedup_detections(frame).collect() if r.ord > 1) == [(2, 2, 0.0)]
    assert [(r.ord, r.x) for r in S.dedup_detections(frame).where("ord = 1").collect()] == [(1, None)]


def test_document_fields_fall_back(spark):
    assert DOC.sheet_fields([["statement"], ["no", "ABCPE1234F"]], "BANK_STATEMENT") == [(1, "PAN", "GOV_ID", 0.98, "pan_anywhere")]
    assert DOC.fields_of(["Guardian", "Vik Rao"])[0][:2] == (1, "FATHER_NAME")
    assert DOC.pan_of("abcpe l23o f") == "ABCPE1230F" and DOC.pan_of("ABCDE1234F") is None


def test_attested_stream_batches_replace_themselves(spark, tmp_path):
    sha = hashlib.sha256(b"body").hexdigest()
    spark.createDataFrame([("body", sha), ("bodY", sha)], "body string, sha256 string").write.json(str(tmp_path / "in"))
    out = E.attested_sink(spark.readStream.schema("body string, sha256 string").json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    out.awaitTermination(60)
    E.write_attested(spark.read.json(str(tmp_path / "in")), str(tmp_path / "out/batch=0"), mode="overwrite")  # as if tried again
    assert [r.body for r in spark.read.json(str(tmp_path / "out")).collect()] == ["body"]


def test_telemetry_by_stage_and_cycle(spark, tmp_path):
    store = E.TelemetryStore(spark, str(tmp_path / "telemetry"))
    rows = [(i // 2, "dom" if i % 2 else "ocr", 1.23456, {"ok": "true", "long": "x" * 41, "said": "two words", "none": None}) for i in range(10)]
    store.record(spark.createDataFrame(rows, "cycle long, stage string, duration double, meta map<string,string>"))
    got = store.by_cycle(3).collect()
    assert sorted(r.stage for r in got) == ["dom", "ocr"] and got[0].duration == 1.235
    assert got[0].meta == {"ok": "true", "long": "[REDACTED_BY_I11]", "said": "[REDACTED_BY_I11]", "none": None}
    dom = store.by_stage("dom")
    assert dom.count() == 5 and "PartitionFilters: [isnotnull(stage" in dom._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_sealed_store(spark, tmp_path):
    secret = F.lit(b"0123456789abcdef")
    store = E.SealedStore(spark, str(tmp_path / "sealed"), secret)
    kind = "key string, value string, version long"
    store.put(spark.createDataFrame([("a", "one", 1), ("b", "two", 1)], kind))
    store.put(spark.createDataFrame([("a", "three", 2)], kind))
    assert sorted((r.key, r.value) for r in store.opened().collect()) == [("a", "three"), ("b", "two")]
    assert all("t" not in r.value or r.value not in ("two", "three") for r in store.get().collect())
    swapped = store.get().withColumn("key", F.when(F.col("key") == "a", "b").otherwise("a"))
    E.KeyedStore(spark, str(tmp_path / "swapped")).put(swapped)
    try:
        E.SealedStore(spark, str(tmp_path / "swapped"), secret).opened().collect()
        raise AssertionError("a value sealed for another key was opened")
    except Exception as e:
        assert "AES" in str(e) or "Tag mismatch" in str(e)
    store.clear()
    assert store.get().count() == 0
