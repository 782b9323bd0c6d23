"""The corpus operators: contracts against SQL or brute force, held-out accuracy, round trips and hard rows."""

import hashlib
import itertools
import pickle
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from llm_rows import hard_rows, rows
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T
from veilframe.llm import bpe, catalog, common, langid, licences, media, mixing, neardup, quality, toxicity, trie_tokens, warc
from veilframe.llm.common import table

import corpus_pipeline


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, data, duck, name):
    assert rows(catalog.QUERIES[name](spark, data).toPandas()) == rows(duck.sql(catalog.ORACLES[name]).df())


# -- 1 toxicity, 4 language ID ----------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.QUERIES["op1_toxicity"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out and toxic is not null").toPandas()
    assert got["score"].between(0, 1).all()
    assert got[got.toxic == 1].predicted.mean() >= 0.6 and got[got.toxic == 0].predicted.mean() <= 0.05


def _plain_score(model, text):
    """A document's score by loops over hashes, windows and filters."""
    words = langid.WORD.findall((text or "").lower())
    dim = model.conv.shape[0]
    own = [np.sum([model.tables[model.rows.get(h) or 0].astype(np.float64) for h in toxicity.buckets(w)], axis=0) for w in words]
    own += [np.zeros(dim)] * 4
    conv, logit, k = model.conv.astype(np.float64), model.out_bias, 0
    for w, a in zip(toxicity.WIDTHS, (0, 1, 3), strict=True):
        every = np.stack([sum(own[i + o] @ conv[:, a + o] for o in range(w)) for i in range(len(words) + 2)])
        for best in every.max(0):
            logit += max(best + model.bias[k], 0) * model.out[k]
            k += 1
    lang = model.languages.scorer().predict([text or ""])[0][0]
    return 1 / (1 + np.exp(-np.clip(logit - model.cutoffs.get(lang, model.cutoff), -60, 60)))


def test_toxicity_query_brute(spark, data, monkeypatch):
    """The whole query against loops, with the model it fitted."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda *a, f=toxicity.fit, **k: (seen.append(f(*a, **k)), seen[-1])[1])
    got = catalog.QUERIES["op1_toxicity"](spark, data).collect()
    texts = {d.doc_id: d.text for d in table(spark, data, "documents").collect()}
    assert len(got) == len(texts)
    for r in got:
        assert abs(r.score - _plain_score(seen[0], texts[r.doc_id])) < 1e-3
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_without_labels(spark, hard):
    model = toxicity.fit(hard, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    got = hard.select(toxicity.scorer(spark, model)(F.col("text")).alias("s")).collect()
    assert {r.s for r in got} == {0.0}


def test_toxicity_rows_sum_hashes():
    model = toxicity.Model({h: 1 for h in toxicity.buckets("bad")}, np.ones((2, 6, 8), np.float32), np.zeros(24, np.float32), np.ones(24, np.float32))
    model.tables[0] = 0
    one = toxicity.Scorer(model)
    assert one.logits([["fine"], []]).tolist() == [0.0, 0.0] and one.logits([["x", "bad", "y"]])[0] > 0


def test_toxicity_score_is_the_texts_own():
    r = np.random.default_rng(3)
    model = toxicity.Model({h: i for i, h in enumerate(toxicity.buckets("bad"), 1)}, r.standard_normal((8, 6, 8)).astype(np.float32), np.zeros(24, np.float32), np.ones(24, np.float32))
    model.tables[0] = 0
    texts = [[], ["fine"], ["x", "bad"], ["bad", "y", "bad"], ["so", "fine", "it", "is"]]
    one = toxicity.Scorer(model)
    alone = [one.logits([t])[0] for t in texts]
    for order in itertools.permutations(range(len(texts))):
        assert one.logits([texts[i] for i in order]).tolist() == [alone[i] for i in order]
    ids, index = toxicity.indexed(texts)
    flat, begin, end = toxicity._lay(ids)
    assert all(not flat[e : e + 2].any() and not flat[b + len(x) : e].any() and e - b == len(x) + 2 for x, b, e in zip(ids, begin, end, strict=True)) and len(flat) == end[-1] + 2


def test_toxicity_sample_is_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "indexed", lambda texts, f=toxicity.indexed: (seen.append(f(texts)), seen[-1])[1])
    monkeypatch.setattr(toxicity, "train", lambda *a, f=toxicity.train: f(*a, epochs=1))
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, "bad word").otherwise("good word").alias("text"))
    toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")), F.lit(True))
    assert 5700 <= len(seen[0][0]) <= 6300


def test_best_cutoff():
    assert 0.2 < toxicity.best_cutoff(np.array([0.0, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) < 0.8


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.QUERIES["op4_language_id"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.98 and got.score.between(0, 1).all()


def test_language_query_brute(spark, data):
    """The whole query against a plain fit and plain sums; every training document is in the sample at this size."""
    docs = table(spark, data, "documents").collect()
    held = lambda d: zlib.crc32(str(d.doc_id).encode()) % 3 == 1
    words = lambda t: "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (t or "").lower()).split()
    seen = [Counter() for _ in range(5)]
    for d in docs:
        if d.text is not None and d.lang is not None and not held(d):
            for w in words(d.text):
                for n in range(5):
                    for g in [w] if n == 0 else langid.grams(w, n):
                        seen[n][d.lang, g] += 1
    langs = sorted({lang for lang, _ in seen[0]})
    names = [{g for _, g in c} for c in seen]
    total = [{lang: sum(x for (own, _), x in c.items() if own == lang) + 0.5 * len(v) for lang in langs} for c, v in zip(seen, names, strict=True)]
    log = lambda n, lang, g: np.log((seen[n][lang, g] + 0.5) / total[n][lang])

    def weight(w, lang):
        if w in names[0]:
            return log(0, lang, w)
        for n in range(4, 0, -1):
            if known := [g for g in langid.grams(w, n) if g in names[n]]:
                return np.mean([log(n, lang, g) for g in known])
        return 0.0

    want = {}
    for d in docs:
        own = [sum(c * weight(w, lang) for w, c in Counter(words(d.text)).items()) for lang in langs]
        best = int(np.argmax(own))
        want[d.doc_id] = (langs[best], 1 / np.exp(np.array(own) - own[best]).sum(), held(d)) if words(d.text) else ("und", 0.0, held(d))
    got = catalog.QUERIES["op4_language_id"](spark, data).collect()
    assert len(got) == len(docs)
    for r in got:
        lang, score, out = want[r.doc_id]
        assert (r.lang_pred, r.held_out) == (lang, out) and abs(r.score - score) < 1e-3, r


def test_language_backs_off():
    model = langid.from_counts([("a", 0, "the", 9), ("b", 0, "der", 9), ("a", 3, "<th", 5), ("b", 3, "<de", 5), ("a", 1, "t", 5), ("b", 1, "d", 5)])
    one = model.scorer()
    assert one.predict(["the the", "derx", "tttt", "", "123", "ddd"])[0] == ["a", "b", "a", "und", "und", "b"]
    assert langid.from_counts([]).scorer().predict(["x"]) == (["und"], [0.0])


def test_numerals_are_no_letters(spark):
    model = langid.from_counts([("a", 0, "the", 9), ("b", 0, "der", 9)])
    frame = spark.createDataFrame([(t,) for t in ("²", "½ ①", "Ⅷ ٣", "the ²")], "text string")
    got = [r.p for r in frame.coalesce(1).select(langid.predictor(spark, model)(F.col("text")).alias("p")).collect()]
    assert [(p.lang, p.score == 0) for p in got] == [("und", True)] * 3 + [("a", False)]


def test_language_hard_rows(spark, hard, nothing):
    assert nothing.select(langid.predictor(spark, langid.from_counts([]))(F.col("text"))).count() == 0
    model = langid.fit(hard, F.lit(True))
    got = hard.select("text", langid.predictor(spark, model)(F.col("text")).alias("p")).collect()
    assert len(got) == hard.count() and all((r.p.lang == "und") == (not any(unicodedata.category(c)[0] == "L" for c in r.text or "")) for r in got)
    assert langid.fit(nothing, F.lit(True)).langs == []


def test_language_keeps_every_count(spark):
    """A language with one document, beside 69 others whose words come more often than all of its own."""
    letters = "abcdefghijklmnopqrst"
    docs = [(1000 * k + i, " ".join(f"{letters[k % 20]}{letters[k // 20]}{letters[j % 20]}{letters[j // 20]}" for j in range(60)), f"l{k}") for k in range(69) for i in range(3)]
    docs += [(10**6, "zuzu vuvu xuxu", "rare")]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), F.lit(True))
    want = {(lang, w): c for lang in {d[2] for d in docs} for w, c in Counter(w for _, t, own in docs if own == lang for w in t.split()).items()}
    assert len(model.langs) == 70 and set(model.words) == {w for _, w in want}
    assert {n: sum(len(g) == n for g in model.grams) for n in range(1, 5)} == {n: len({g for _, w in want for g in langid.grams(w, n)}) for n in range(1, 5)}
    total = {lang: sum(c for (own, _), c in want.items() if own == lang) + 0.5 * len(model.words) for lang in model.langs}
    for (lang, w), c in want.items():
        assert abs(model.word_rows[model.words[w], model.langs.index(lang)] - np.log((c + 0.5) / total[lang])) < 1e-5
    assert model.scorer().predict(["zuzu vuvu", "xuxu"])[0] == ["rare", "rare"]


# -- 2 BPE ------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library():
    own, ref, r = bpe.load(bpe.default_path()), tokenizers.Tokenizer.from_file(bpe.default_path()), random.Random(3)
    texts = [t or "" for _, t, *_ in hard_rows()] + ["a" * 3000, "ab" * 2000, "it's we'll  x\n\n y", "".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0xD7FF), r.randrange(0x10000, 0x1FFFF)])) for _ in range(2000))]
    for t in texts:
        ids = own.encode(t)
        assert ids == ref.encode(t, add_special_tokens=False).ids and own.decode(ids) == t


def test_bpe_tree_of_rows_equals_single_tree():
    own = bpe.load(bpe.default_path())
    for t in [" withheld", "mentation", " 1234567", "zzzzzzzzzzzzzz"]:
        assert np.frombuffer(own.encode_bytes([t])[0], "<u4").tolist() == own._merge_one(own.first[np.frombuffer(t.encode(), np.uint8)].tolist())


def test_bpe_query_columns(spark, data):
    """Every column of the query against the library, over the whole table."""
    ref = tokenizers.Tokenizer.from_file(bpe.default_path())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for d in table(spark, data, "documents").collect():
        ids = ref.encode(d.text or "", add_special_tokens=False).ids
        want[d.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(ref.decode(ids, skip_special_tokens=False).encode())] += 1
    got = catalog.QUERIES["op2_bpe_round_trip"](spark, data).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_bpe_bounded_cache(monkeypatch):
    own = bpe.ByteBPE(bpe.default_path())
    monkeypatch.setattr(bpe, "CACHE", 1000)
    texts = [f"alpha{i} beta{i % 7}" for i in range(40)]
    assert [own.decode_bytes(own.encode_bytes([t])[0]) for t in texts] == texts and own.held < 2000


def test_bpe_hard_rows(hard, nothing):
    got = bpe.round_trip(hard).collect()
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in hard_rows())
    assert sorted(r.decoded_sha256 for r in got) == want and bpe.round_trip(nothing).count() == 0


# -- 3 WARC -----------------------------------------------------------------------------------------------


def test_warc_skips_and_pushes_down(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pages = spark.createDataFrame([(3, "u", "same"), (1, "u", "same"), (2, None, None), (4, "v", ""), (5, "w\r\nx", "é" * 9000), (None, "n", "same")], "page_id long, url string, html string")
    warc.register(spark)
    path = str(tmp_path / "w")
    warc.to_records(pages).write.format("veilframe_warc").mode("append").save(path)
    got = {(r.record_id, r.record_type): r for r in warc.read_archive(spark, path).collect()}
    assert got["urn:x-page:3", "revisit"].refers_to == "urn:x-page:1" and got["urn:x-page:3", "revisit"].payload is None
    assert got["urn:x-page:4", "revisit"].refers_to == "urn:x-page:2" and got["urn:x-page:none", "response"].payload == b"same"
    assert got["urn:x-page:5", "response"].payload.decode() == "é" * 9000 and len(got) == 6
    some = warc.read_archive(spark, path).where("record_type = 'revisit' and target_uri like 'v%'")
    assert [r.record_id for r in some.collect()] == ["urn:x-page:4"]
    reader = warc._Reader({"path": path})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 4)])) == [warc.EqualTo(("payload_bytes",), 4)]
    seen = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["record_type"] for r in seen} == {"revisit"}


def test_warc_repeated_and_long_rows(spark, tmp_path):
    """Rows that repeat an id are records each; of one payload all rows with the smallest id are responses."""
    rows_ = [(1, "u", "same", 0), (1, "u", "same", 0), (2, "u", "same", 0), (2, "u", "other", 0), (3, "v", "x" * 3_000_000, 0)]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string, payload_digest int")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog.QUERIES["op3_warc_round_trip"](spark, str(tmp_path)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == Counter([(1, 4, "response", None)] * 2 + [(2, 4, "revisit", 1), (2, 5, "response", None), (3, 3_000_000, "response", None)])
    assert {r.payload_digest for r in got if r.page_id == 1} == {warc.digest(b"same")}


def test_warc_plain_files(tmp_path):
    row = {"record_id": "a", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": None, "payload_bytes": 2, "payload": b"hi"}
    (tmp_path / "x.warc").write_bytes(warc.record(row) + warc.record({**row, "record_id": "b"}))
    reader = warc._Reader({"path": str(tmp_path)})
    assert [r["record_id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == ["a", "b"]


def test_warc_members_of_many_records(tmp_path):
    import gzip

    row = {"record_id": "a", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": None, "payload_bytes": 2, "payload": b"hi"}
    big = {**row, "record_id": "c", "target_uri": "v", "payload_bytes": 300_000, "payload": random.Random(1).randbytes(300_000)}
    first = warc.record(row) + warc.record(big) + warc.record({**row, "record_id": "b", "payload": b"\r\n\r\n\r\n", "payload_bytes": 6})
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(first) + gzip.compress(warc.record({**row, "record_id": "d"}) + warc.record({**row, "record_id": "e", "target_uri": "v"})))
    reader = warc._Reader({"path": str(tmp_path)})
    read = lambda: [(r["record_id"], r["payload"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert read() == [("a", b"hi"), ("c", big["payload"]), ("b", b"\r\n\r\n\r\n"), ("d", b"hi"), ("e", b"hi")]
    list(reader.pushFilters([warc.EqualTo(("target_uri",), "v")]))
    assert [i for i, _ in read()] == ["c", "e"]
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(first)[:-20_000])
    with pytest.raises(ValueError):
        read()


def test_warc_empty(spark, tmp_path):
    warc.register(spark)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.to_records(empty).write.format("veilframe_warc").mode("append").save(str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


# -- 5 near-duplicates ------------------------------------------------------------------------------------


def _brute_components(docs):
    sets = {}
    for i, t in docs:
        if i is not None:
            w = (t or "").encode().lower().split()
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_near_duplicates_brute(spark):
    r, docs = random.Random(5), []
    base = [[f"w{r.randrange(400)}" for _ in range(120)] for _ in range(6)]
    for i in range(150):
        w = list(base[i % 6])
        for _ in range(r.randrange(5)):
            w[r.randrange(120)] = f"x{r.randrange(10**6)}"
        docs.append((1000 - i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _brute_components(docs)


def test_near_duplicates_hard_rows(hard, nothing):
    got = neardup.near_duplicates(hard).collect()
    want = _brute_components([(i, t) for i, t, *_ in hard_rows()])
    assert len(got) == len(hard_rows())
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept for r in got if r.doc_id is None) and neardup.near_duplicates(nothing).count() == 0


def test_near_duplicates_repeated_ids(spark):
    """Rows of one id with other texts are classes of their own; groups follow the texts, component ids the ids."""
    r = random.Random(8)
    base = [[f"w{r.randrange(400)}" for _ in range(100)] for _ in range(3)]
    near = lambda k, x: " ".join([*base[k][:-1], x])
    docs = [(5, near(0, "x")), (5, near(1, "y")), (7, near(0, "z")), (4, near(1, "q")), (9, near(2, "u")), (9, near(2, "u")), (8, near(2, "v")), (5, near(0, "x").upper())]
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    want = Counter((i, 96, {0: 5, 1: 4, 2: 8}[next(k for k in range(3) if t.lower().split()[0] == base[k][0])]) for i, t in docs)
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == want and len({x.group for x in got}) == 3
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    assert sorted(x.doc_id for x in kept) == [4, 5, 8] and sum(x.text.lower() == near(0, "x") for x in kept) == 1


def test_near_duplicates_raise_when_unfinished(spark, tmp_path):
    path = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    own = neardup.Scratch(spark, "test")
    assert {x.root for x in neardup.components(path, own, "all").collect()} == {0}
    with pytest.raises(RuntimeError):
        neardup.components(path, own, "few", rounds=2)


def test_blocks_count_collisions_like_signatures():
    import pyarrow as pa

    r = np.random.default_rng(4)
    base = [np.unique(r.integers(0, 1 << 60, 200).astype(np.uint64)) for _ in range(4)]
    sets = [np.unique(np.r_[base[i % 4][r.integers(0, 30) :], r.integers(0, 1 << 60, 8).astype(np.uint64)]) for i in range(60)]
    sig = neardup.signatures(sets)
    first = np.arange(60) < 25
    for same in (True, False):
        group = pa.table({"first": [True] * 60 if same else first.tolist(), "same": [same] * 60, "root": list(range(60)), "n": [len(x) for x in sets], "sig": sig.tolist(), "last": pa.array([x.tobytes() for x in sets])})
        links = neardup._meet(group, 80).to_pylist()
        up = list(range(60))
        for x in links:
            a, b = up[x["a"]], up[x["b"]]
            up = [a if u == b else u for u in up]
        want = list(range(60))
        for i, j in itertools.combinations(range(60), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if (same or first[i] != first[j]) and (sig[i] == sig[j]).sum() >= neardup.MATCH[80] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and want[i] != want[j]:
                want = [want[i] if u == want[j] else u for u in want]
        assert all((up[i] == up[j]) == (want[i] == want[j]) for i, j in itertools.combinations(range(60), 2)) and len(set(want)) < 40


def test_blocks_meet_once_per_root():
    import pyarrow as pa

    s = np.arange(100, dtype=np.uint64)
    sets = [s, s, np.r_[s[1:], np.uint64(500)], np.arange(1000, 1100, dtype=np.uint64)]
    sig = neardup.signatures(sets)
    group = pa.table({"first": [True] * 4, "same": [True] * 4, "root": [1, 2, 3, 4], "n": [100] * 4, "sig": sig.tolist(), "last": pa.array([x.tobytes() for x in sets])})
    assert len(neardup._meet(group)) == 2


def test_pipeline_near_duplicates_at_80(spark):
    r, docs = random.Random(11), []
    base = [[f"w{r.randrange(400)}" for _ in range(120)] for _ in range(12)]
    for i in range(96):
        w = list(base[i % 12])
        for at in r.sample(range(5, 115), (i // 12) % 4):
            w[at] = f"x{r.randrange(10**6)}"
        docs.append((500 - i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in docs}
    root, changed, between = {i: i for i in sets}, True, 0
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            both, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            between += 80 * every <= 100 * both < 85 * every
            if 100 * both >= 80 * every and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    want = {i for i in root if root[i] == i}
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, frame.repartition(5), "").collect()}
    at_85 = {i for i, (_, c) in _brute_components(docs).items() if i == c}
    assert between and got == want and len(want) < len(at_85)


# -- 6 quality --------------------------------------------------------------------------------------------


def _features(text):
    w = [x for x in (text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if x]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    spans = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {p for i in range(len(w) - 7) if spans[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_hard_rows(spark, hard, nothing):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (3, None), (99, 1)], "doc_id long, quality int")
    got = quality.label_quality(hard, labels).collect()
    want = Counter((i, *_features(t)) for i, t, *_ in hard_rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert quality.label_quality(nothing, labels).count() == 0


def test_binomial_tail(spark):
    from math import comb

    for n, k, p in [(10, 0, 0.1), (200, 1, 0.02), (3000, 4, 0.004), (50, 40, 0.1)]:
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k <= n * p else 1.0
        got = spark.range(1).select(quality._binomial_tail(F.lit(n).cast("bigint"), F.lit(k).cast("bigint"), p).alias("x")).first().x
        assert abs(got - want) < 1e-9


def test_certified_cutoffs_keep_good(spark):
    rows_ = [("s", 1, 100, 1000, 0, 0, 0, 0, 0, 10)] * 4000 + [("s", 0, 100, 1000, 400, 0, 0, 0, 0, 10)] * 50
    names = "stratum string, quality int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_bangs long, n_lines long"
    got = quality.thresholds(spark.createDataFrame(rows_, names)).collect()
    assert [(r.stratum, r.symbol_ratio, r.bang_ratio) for r in got] == [("s", 0.3, None)]
    few = quality.thresholds(spark.createDataFrame(rows_[:100] + rows_[-5:], names)).collect()
    assert few == []


# -- 7 media, 8 licences, 9 tokens ------------------------------------------------------------------------


def test_media_round_trip(spark, data):
    got = {r.doc_id: r for r in catalog.QUERIES["op7_media_columns"](spark, data).collect()}
    docs = table(spark, data, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        n, payload = media.pad(d.text)
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.to_png(payload)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(media.from_png(stored)))


def test_media_positions_and_texts(spark, hard, nothing, tmp_path):
    """The whole query over hard rows: the figure stands between the halves of the lines, no text is lost."""
    for name, frame in (("some", hard), ("none", nothing)):
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
    got = catalog.QUERIES["op7_media_columns"](spark, str(tmp_path / "some")).collect()
    want = Counter()
    for i, t, *_ in hard_rows():
        lines = (t or "").split("\n")
        half = (len(lines) + 1) // 2
        runs = [" ".join(" ".join(part).split()) for part in (lines[:half], lines[half:])]
        n, payload = media.pad(t)
        texts = "\n".join(r for r in runs if r)
        want[i, n, len(payload), hashlib.sha256(payload).hexdigest(), int(bool(runs[0])), f"{n} bytes", 1 + sum(map(bool, runs)), hashlib.sha256(texts.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.position, r.caption, r.n_items, r.texts_sha256) for r in got) == want
    assert catalog.QUERIES["op7_media_columns"](spark, str(tmp_path / "none")).count() == 0


def test_sequences_of_real_pages(spark, data):
    """Words of the text runs and captions, in order, against the tags of each page taken out by hand."""
    import re
    from html import unescape

    pages = table(spark, data, "pages")
    got = {r.page_id: r["items"] for r in media.sequences(pages, "page_id").collect()}
    for p in pages.collect():
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<![^>]*>|<\?[^>]*>", " ", p.html or "")
        images = [unescape(x) for x in re.findall(r"""(?is)<(?:img|video|audio|source|embed)\b[^>]*?\bsrc\s*=\s*["']([^"']+)["']""", bare)]
        words = unescape(re.sub(r"(?s)<[^>]*>", " ", bare)).split()
        items = got[p.page_id]
        own = [w for x in items for w in (x["text"] or x["caption"] or "").split()] if not images else [w for x in items if x["text"] for w in x["text"].split()]
        assert [x["position"] for x in items] == list(range(len(items))) and [x["source"] for x in items if x["kind"] == "media"] == images
        assert "".join(own) == "".join(words) or images


def test_sequences_stay_aligned():
    d = "0" * 64
    got = media.parse(f'<p>a</p><script>no</script><figure><img src="sha256:{d}"><figcaption>one &amp; two</figcaption></figure>b<img src="x.png" alt="alt">c')
    assert [(x["position"], x["kind"], x["text"] or x["caption"], x["digest"]) for x in got] == [(0, "text", "a", None), (1, "media", "one & two", d), (2, "text", "b", None), (3, "media", "alt", None), (4, "text", "c", None)]
    assert media.parse(None) == [] and media.parse("") == []


def test_png_filters():
    rows_ = np.array([[1, 2, 3], [4, 5, 6]], np.uint8)
    raw = bytes([1, 1, 1, 1]) + bytes([2, 3, 3, 3])
    import struct

    head = struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)
    png = b"\x89PNG\r\n\x1a\n" + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(raw)) + media._chunk(b"IEND", b"")
    assert (media.from_png(png) == rows_).all() and (media.from_png(media.to_png(bytes(576))) == 0).all()
    with pytest.raises(ValueError):
        media.from_png(png[:-5] + b"xxxxx")


def test_licence_rules(spark, hard):
    text = "intro\nThis file is\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://x"
    got = licences.scan_licences(spark.createDataFrame([(1, text), (2, "Released under the MIT License.")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licences for r in got] == [["Apache-2.0"], ["MIT"]] and got[0].rules == ["apache-2.0-header"]
    assert all(r.rules == [] for r in licences.scan_licences(hard).collect())


_MIT = """MIT License

Copyright (c) 2020 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
_BSD = """Copyright (c) 2020, A Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE.
"""
_GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""


def test_licence_wrapped_texts(spark):
    commented = "".join(f" * {line}".rstrip() + "\r\n" for line in _GPL.splitlines())
    notice = "about\nLicensed under the\nApache License, Version 2.0\nand so on\n\nThis work is licensed under the\nGNU General Public License version 3.\nReleased under the MIT License"
    texts = [_MIT, _MIT.replace("MIT License", "The MIT License (MIT)", 1), _BSD, _GPL, commented, notice, "Released under the MIT\n\nLicense"]
    got = licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.rules for r in got[:1] + got[2:5]] == [["mit-whole-text-short"], ["bsd-whole-text-holders"], ["gpl-header"], ["gpl-header"]]
    assert [r.licences for r in got] == [["MIT"], ["MIT"], ["BSD"], ["GPL"], ["GPL"], ["Apache-2.0", "GPL-3.0", "MIT"], []]


def test_licence_texts_of_others(spark, nothing):
    texts = {
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS. IN NO EVENT",
        "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty.  In no event will\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n",
        "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n",
        "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n\nSee the GNU General Public License for more details.\n",
        "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted",
    }
    got = licences.scan_licences(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licences for r in got] == [[k] for k in texts]
    long = "word " * 200_000 + "\nReleased under the MIT License.\n" + "word " * 200_000
    assert licences.scan_licences(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().licences == ["MIT"]
    assert licences.scan_licences(nothing).count() == 0
    own = spark.createDataFrame([("Do as you like!",)], "text string").select(licences.known_sentences(F.col("text"), {"any": "do as you like"}).alias("x"))
    assert own.first().x == ["any"]


def test_trie_counts():
    vocab = trie_tokens.pieces(trie_tokens.default_path())
    trie = trie_tokens.Trie(vocab)

    def brute(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            width = len(word[i - 1].encode())
            own = [(best[i - 1][0] + trie_tokens.BYTE * width, best[i - 1][1] + width)] if word[i - 1] not in vocab else []
            own += [(best[j][0] + vocab[word[j:i]], best[j][1] + 1) for j in range(i) if word[j:i] in vocab]
            best.append(max(own, key=lambda x: (x[0], -x[1])))
        return best[-1][1]

    for w in ("the", "thereof", "menttion", "ñandú", "日本語x", "a" * 60, "zzqx"):
        assert trie.tokens(w) == brute("▁" + w), w
    assert trie.text("") == (0, 0, 0) and trie.text(" the the x") == (3, 2, 2 * trie.tokens("the") + trie.tokens("x"))


def test_tokens_query_brute(spark, data):
    vocab = trie_tokens.pieces(trie_tokens.default_path())
    longest, known = max(map(len, vocab)), {}

    def brute(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            width = len(word[i - 1].encode())
            own = [(best[i - 1][0] + trie_tokens.BYTE * width, best[i - 1][1] + width)] if word[i - 1] not in vocab else []
            own += [(best[j][0] + vocab[word[j:i]], best[j][1] + 1) for j in range(max(0, i - longest), i) if word[j:i] in vocab]
            best.append(max(own, key=lambda x: (x[0], -x[1])))
        return best[-1][1]

    want = Counter()
    for d in table(spark, data, "documents").collect():
        own = Counter((d.text or "").split())
        for w in own:
            known.setdefault(w, brute("▁" + w))
        want[d.doc_id, sum(own.values()), len(own), sum(c * known[w] for w, c in own.items())] += 1
    assert Counter(map(tuple, catalog.QUERIES["op9_token_counts"](spark, data).collect())) == want


def test_tokens_hard_rows(hard, nothing):
    got = trie_tokens.count_tokens(hard).collect()
    assert len(got) == len(hard_rows()) and all(r.n_tokens >= r.n_pretokens for r in got) and trie_tokens.count_tokens(nothing).count() == 0


# -- 10 mixing --------------------------------------------------------------------------------------------


def _targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w, total, full = {s: weights[i % 3] for i, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        share = {s: cap * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in names if x not in full) for s in names}
        more = {s for s in names if s not in full and share[s] > cap * sizes[s]}
        if not more:
            return share
        full |= more


def test_mix_targets_and_bounds(spark):
    r = random.Random(2)
    docs = [(i, r.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"]), r.randrange(0, 400)) for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, size long")
    got = mixing.mix(frame.repartition(7), size=F.col("size")).collect()
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    want, taken = _targets(sizes), Counter()
    for x in got:
        taken[x.source] += x.taken
        assert abs(x.target - want[x.source]) < 1e-6 * max(1, want[x.source]) and x.taken <= 3 * x.size and x.source_size == sizes[x.source]
    assert len(got) == 3000 and all(abs(taken[s] - want[s]) <= 400 for s in want)
    again = mixing.mix(frame.repartition(3), size=F.col("size")).collect()
    assert {x.doc_id: x.taken for x in again} == {x.doc_id: x.taken for x in got}


def test_mix_query_brute(spark, data):
    """The query's sizes and targets by the contract's words, and what its sources take."""
    import re

    docs = table(spark, data, "documents").collect()
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    sizes, most = Counter(), Counter()
    for d in docs:
        sizes[d.source] += size[d.doc_id]
        most[d.source] = max(most[d.source], size[d.doc_id])
    want, taken = _targets(sizes), Counter()
    got = catalog.QUERIES["op10_mix_sources"](spark, data).collect()
    assert Counter(r.doc_id for r in got) == Counter(d.doc_id for d in docs)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[r.source]) and abs(r.target - want[r.source]) <= 1e-9 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= most[s] for s in want)


def test_mix_hard_rows(hard, nothing):
    got = mixing.mix(hard).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r.taken <= 3 * r.size for r in got) and mixing.mix(nothing).count() == 0


# -- workers ----------------------------------------------------------------------------------------------


class _Sent:
    """Stands for a frame; gives the function that a worker would get, unpickled."""

    schema = T.StructType([T.StructField("doc_id", T.LongType())])

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return pickle.loads(cloudpickle.dumps(run))


def test_worker_forgets_other_operators_words():
    run = neardup._shingled(_Sent())
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array(["a b c d e f g"])], ["doc_id", "text_hash", "text"])
    assert [b.num_rows for b in run(iter([batch]))] == [1] and len(neardup._words) >= 7
    common.take_worker("another", lambda: None)
    assert not neardup._words


def test_worker_gives_memory_back_after_a_task(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common.gc, "collect", lambda *_: calls.append(1))  # what give_back begins with
    common.take_worker("bpe", lambda: None)
    calls.clear()
    batch = pa.RecordBatch.from_arrays([pa.array(["a b"]), pa.array([1])], ["_text", "doc_id"])
    tasks = bpe.tokenized(_Sent())(iter([batch, batch]))
    assert next(tasks).num_rows == 1 and not calls
    assert [b.num_rows for b in tasks] == [1] and calls == [1]
    with pytest.raises(AttributeError):
        list(bpe.tokenized(_Sent())(iter([None])))
    assert calls == [1, 1]


def test_scorers_copy_neither_known_words_nor_the_matrix():
    one = langid.from_counts([("a", 0, "the", 9), ("b", 0, "der", 9), ("b", 1, "x", 1)]).scorer()
    assert one.predict(["the x", "the"])[0] == ["a", "a"] and set(one.rows) == {"the", "x"}
    model = toxicity.Model({h: 1 for h in toxicity.buckets("bad")}, np.ones((2, 6, 8), np.float32), np.zeros(24, np.float32), np.ones(24, np.float32))
    one = toxicity.Scorer(model)
    matrix = one.matrix
    assert one.logits([[f"q{i}" for i in range(40_000)] + ["bad"]])[0] > 0 and one.matrix is matrix


# -- the pipeline -----------------------------------------------------------------------------------------


def test_pipeline_stages(spark, data):
    docs = table(spark, data, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, data)
        assert after.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(after.collect(), after.schema)
        if name == "language_id":
            assert docs.count() == before
        if name == "near_duplicates":
            own = {r.doc_id: r.text for r in docs.collect()}
            assert len(own) == docs.count() and len(set(_brute_components(own.items())[i][1] for i in own)) == len(own)
    out = corpus_pipeline.encode(spark, docs, data).collect()
    texts = Counter(r.text for r in docs.collect())
    assert Counter(r.decoded for r in out) == texts and all(len(r.ids) == 4 * r.n_tokens for r in out)


def test_pipeline_brute(spark, data):
    """run() against its rules: languages, toxicity and groups by plain code, the mix by its targets, BPE by the library."""
    docs = {d.doc_id: d for d in table(spark, data, "documents").collect()}
    frame = table(spark, data, "documents")
    first = {i for i, d in docs.items() if any(unicodedata.category(c)[0] == "L" for c in d.text or "")}
    assert {r.doc_id for r in corpus_pipeline.language(spark, frame, data).collect()} == first
    left = frame.where(F.col("doc_id").isin(*first))
    model = toxicity.fit(left, table(spark, data, "labels"), F.lit(True), languages=langid.fit(left, F.lit(True), docs_per_lang=500))
    second = {i for i in first if _plain_score(model, docs[i].text) < 0.5}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i in second for w in [(docs[i].text or "").encode().lower().split()]}
    root = {i: i for i in second}
    for a, b in itertools.combinations(sorted(second), 2):
        if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    third = {i for i in second if root[i] == i}
    sizes, most = Counter(), Counter()
    n_words = {i: len([w for w in docs[i].text.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]) for i in third}
    for i in third:
        sizes[docs[i].source] += n_words[i]
        most[docs[i].source] = max(most[docs[i].source], n_words[i])
    ref, out = tokenizers.Tokenizer.from_file(bpe.default_path()), corpus_pipeline.run(spark, data).collect()
    taken = Counter()
    for i, n in Counter(r.doc_id for r in out).items():
        assert i in third and n <= 3
        taken[docs[i].source] += n * n_words[i]
    assert all(abs(taken[s] - t) <= most[s] for s, t in _targets(sizes).items())
    for r in out:
        assert r.ids == np.array(ref.encode(docs[r.doc_id].text, add_special_tokens=False).ids, "<u4").tobytes() and r.decoded == docs[r.doc_id].text and (r.lang, r.source) == (docs[r.doc_id].lang, docs[r.doc_id].source)


def test_pipeline_hard_rows(spark, hard, data):
    docs = hard.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        docs = spark.createDataFrame(docs.collect(), T.StructType(docs.schema.fields))
    assert corpus_pipeline.encode(spark, docs, data).count() == docs.count()


def test_hot_digests_are_salted_whole(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else f"d{i}") for i in range(300)] + [(900, None), (901, "missing"), (902, "missing")]
    spark.createDataFrame(rows, "k long, digest string").repartition(5).write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    store = spark.createDataFrame([("hot", 1), *[(f"d{i}", i) for i in range(0, 300, 3)]], "digest string, size long")
    want = sorted((k, str(d), str(1 if d == "hot" else int(d[1:]) if d and d[0] == "d" else None)) for k, d in rows)
    for parts in (1, 16, 1024):
        got = media.resolve(items, store, ["size"], parts)
        assert got.columns == ["k", "digest", "size"] and sorted((r.k, str(r.digest), str(r.size)) for r in got.collect()) == want
    assert media.resolve(items.limit(0), store, ["size"]).collect() == []
