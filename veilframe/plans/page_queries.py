"""Queries over page elements, redaction, attestation and audit labels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import patterns as P
from ..operators import detectors as D
from ..operators import pages as G
from ..operators import redaction as R
from . import detector_queries as DQ
from . import validator_queries as VQ
from ..sources import events_log as E
from .derived import BOXES, inputs, oracle

QUERIES, ORACLES = {}, {}
_table = lambda spark, sf_dir, n: spark.read.parquet(f"{sf_dir}/{n}.parquet")

QUERIES["a01_elements"] = lambda spark, sf_dir: G.scan(_table(spark, sf_dir, "pages")).select("page_id", "ord", "dom_id", "parent_dom_id", "tag", "depth", F.length(G.shown(F.col("text"))).alias("chars"))
QUERIES["a01_tag_counts"] = lambda spark, sf_dir: G.scan(_table(spark, sf_dir, "pages")).where("tag in ('p', 'li', 'h1', 'script')").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))
ORACLES["a01_tag_counts"] = "SELECT page_id, tag, n FROM (SELECT page_id, tag, len(regexp_extract_all(html, '<' || tag || '[ >]')) n FROM pages, (VALUES ('p'), ('li'), ('h1'), ('script')) t(tag)) WHERE n > 0"
QUERIES["a02_fallback_elements"] = lambda spark, sf_dir: G.fallback_scan(_table(spark, sf_dir, "pages")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text") > 200).alias("long"))
ORACLES["a02_fallback_elements"] = f"SELECT page_id, tag, n, false long FROM (SELECT page_id, tag, len(regexp_extract_all(html, '<' || tag || '[ />]')) n FROM pages, (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in sorted(G.FALLBACK_TAGS))}) t(tag)) WHERE n > 0"
QUERIES["a04_inline_spans"] = lambda spark, sf_dir: G.inline_spans(G.scan(_table(spark, sf_dir, "pages")))
QUERIES["a04_masked_text"] = lambda spark, sf_dir: _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(G.masked_text(F.col("text")), 256).alias("digest"))
ORACLES["a04_masked_text"] = f"SELECT conv_id, turn, sha256(substr(regexp_replace(regexp_replace(regexp_replace(text, '{P.re2('EMAIL')}', '<EMAIL>', 'g'), '{P.re2('PAN')}', '<PAN>', 'g'), '{P.re2('AADHAAR')}', '<AADHAAR>', 'g'), 1, 300)) digest FROM conversations"
QUERIES["a18_eligible_pages"] = lambda spark, sf_dir: _table(spark, sf_dir, "pages").select("page_id", G.eligible(F.col("url")).alias("eligible"))
ORACLES["a18_eligible_pages"] = "SELECT page_id, coalesce(regexp_matches(url, '(?i)^(?:https?|file)://'), false) eligible FROM pages"
QUERIES["q05_pages_pii"] = lambda spark, sf_dir: D.detect_text(G.scan(_table(spark, sf_dir, "pages")), ["page_id", "ord"], at=False).groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))


def roles(spark, sf_dir):
    e = G.scan(_table(spark, sf_dir, "pages"))
    r = G.role(F.col("tag"), F.col("attributes"))
    return e.groupBy(r.alias("role"), G.semantic_type(r, F.col("tag")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["k03_roles"] = roles
#: Start tags in order of the page, without what scripts and styles hold.
_TAGS = """SELECT regexp_extract(t, '^<([a-z0-9]+)', 1) tag, contains(t, ' href=') linked FROM (SELECT unnest(regexp_extract_all(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(?:script|style)>', '<\\1>', 'g'), '<[a-z][^>]*>')) t FROM pages)"""
ORACLES["k03_roles"] = f"""SELECT role, CASE role WHEN 'link' THEN 'link' WHEN 'navigation' THEN 'navigation' WHEN 'img' THEN 'image' WHEN 'heading' THEN 'text' ELSE CASE WHEN tag IN ('p', 'span', 'li', 'div', 'b', 'title', 'footer', 'article') THEN 'text' ELSE 'unknown' END END kind, count(*) n
FROM (SELECT tag, CASE WHEN tag = 'a' AND linked THEN 'link' WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' WHEN tag = 'nav' THEN 'navigation' WHEN tag = 'img' THEN 'img' END role FROM ({_TAGS})) GROUP BY ALL"""
QUERIES["k04_names"] = lambda spark, sf_dir: G.accessible_name(G.scan(_table(spark, sf_dir, "pages"))).groupBy("tag").agg(F.count("name").alias("named"), F.count(F.lit(1)).alias("n"))

ORACLES["k04_names"] = f"""SELECT tag, coalesce(named, 0) named, n FROM (SELECT tag, count(*) n FROM ({_TAGS}) GROUP BY tag) LEFT JOIN (SELECT tag, count(*) named FROM (SELECT unnest(regexp_extract_all(html, '<(a|li|h[1-6])(?: [^>]*)?>[ \\n\\t]*[^< \\n\\t]', 1)) tag FROM pages) GROUP BY tag) USING (tag)"""


def selectors(spark, sf_dir):
    e = G.scan(_table(spark, sf_dir, "pages"))
    nth = F.row_number().over(W.partitionBy("page_id", "parent_dom_id").orderBy("ord"))
    return e.withColumn("nth", nth).select("page_id", "ord", G.stable_selector(F.col("tag"), F.col("attributes"), F.col("nth")).alias("selector"))


QUERIES["k08_selectors"] = selectors

#: Elements of pages, derived: roles, names and layout flags by key.
_ELEMENTS = """SELECT l_orderkey cycle, l_linenumber ord, CASE l_partkey % 4 WHEN 0 THEN 'button' WHEN 1 THEN 'link' ELSE NULL END role,
CASE l_suppkey % 3 WHEN 0 THEN 'Name ' || CAST(l_suppkey AS STRING) ELSE NULL END name, CASE l_partkey % 9 WHEN 0 THEN 'canvas' WHEN 1 THEN 'img' WHEN 2 THEN 'shadow_closed' ELSE 'html' END rendering,
l_partkey % 5 <> 0 visible, CAST(l_quantity * 2 AS DOUBLE) w, CAST(l_partkey % 60 AS DOUBLE) h, l_suppkey % 4 = 0 handlers_hint, l_partkey % 13 = 0 occluded, l_partkey % 17 = 0 has_bg_image, l_partkey % 6 = 0 dirty,
CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS BIGINT) n FROM {lineitem}"""
_e = lambda: {c: F.col(c) for c in ("rendering", "role", "name", "visible", "w", "h", "handlers_hint", "occluded", "has_bg_image")}
_SCORE = """CASE WHEN rendering IN ('canvas', 'shadow_closed') THEN 0.1 ELSE greatest(0, least(1, CASE WHEN role IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN name IS NOT NULL THEN 0.35 ELSE 0 END + CASE WHEN visible THEN 0.15 ELSE -0.2 END
+ CASE WHEN w > 0 AND h > 0 THEN 0.15 ELSE 0 END + CASE WHEN rendering = 'html' THEN 0.1 ELSE 0 END - CASE WHEN handlers_hint AND (role IS NULL OR name IS NULL) THEN 0.3 ELSE 0 END - CASE WHEN occluded THEN 0.25 ELSE 0 END)) END"""
_MEDIA = "((rendering IN ('img', 'video', 'canvas', 'svg') OR has_bg_image) AND w * h >= 1600)"
_LEVEL = f"CASE WHEN rendering IN ('canvas', 'shadow_closed') THEN 'LOW' WHEN score >= 0.85 AND NOT ({_MEDIA} OR dirty) THEN 'HIGH' WHEN score >= 0.45 OR {_MEDIA} OR dirty THEN 'MEDIUM' ELSE 'LOW' END"
_SCORED = f"SELECT *, round(CAST({_SCORE} AS DOUBLE), 4) score FROM ({oracle(_ELEMENTS)})"


def route(spark, sf_dir):
    e = inputs(spark, sf_dir, _ELEMENTS)
    return e.withColumn("score", F.round(G.score(_e()), 4)).withColumn("level", G.level(_e(), F.col("dirty"))).withColumn("needs", G.needs(F.col("level"), G.media(_e())))


QUERIES["k11_scores"] = lambda spark, sf_dir: route(spark, sf_dir).select("cycle", "n", "score")
ORACLES["k11_scores"] = f"SELECT cycle, n, score FROM ({_SCORED})"
QUERIES["q17_route_levels"] = lambda spark, sf_dir: route(spark, sf_dir).select("cycle", "n", "level", F.array_join("needs", ",").alias("needs"))
_NEEDS = f"CASE WHEN level <> 'MEDIUM' THEN '' WHEN {_MEDIA} THEN 'ocr,face,ground' ELSE 'ocr,ground' END"
_ROUTED = f"SELECT *, {_NEEDS} needs FROM (SELECT *, {_LEVEL} level FROM ({_SCORED}))"
ORACLES["q17_route_levels"] = f"SELECT cycle, n, level, needs FROM ({_ROUTED})"
QUERIES["q18_budget_cap"] = lambda spark, sf_dir: G.budgeted(route(spark, sf_dir), "cycle", "n", 2).select("cycle", "n", "capped", F.array_join("needs", ",").alias("needs"))
ORACLES["q18_budget_cap"] = f"SELECT cycle, n, capped, CASE WHEN capped THEN '' ELSE needs END needs FROM (SELECT *, level <> 'HIGH' AND sum(CASE WHEN level <> 'HIGH' THEN 1 ELSE 0 END) OVER (PARTITION BY cycle ORDER BY n ROWS UNBOUNDED PRECEDING) > 2 capped FROM ({_ROUTED}))"
QUERIES["k20_avatars"] = lambda spark, sf_dir: inputs(spark, sf_dir, BOXES).select("cycle", "ord", G.avatar(F.col("w"), F.col("h"), F.concat(F.lit("User Avatar "), "kind")).alias("avatar"))
ORACLES["k20_avatars"] = f"SELECT cycle, ord, least(w, h) >= 24 AND greatest(w, h) <= 512 AND greatest(w, h) <= least(w, h) * 1.25 avatar FROM ({oracle(BOXES)})"
QUERIES["k21_maskable"] = lambda spark, sf_dir: inputs(spark, sf_dir, BOXES).select("cycle", "ord", G.maskable(F.col("w") * 10, F.col("h") * 4, F.col("kind") == "R", F.col("ord") == 1, F.col("kind") == "A").alias("maskable"))
ORACLES["k21_maskable"] = f"SELECT cycle, ord, w * 10 < 800 AND h * 4 < 600 AND (kind <> 'R' OR ord = 1) AND (w * h * 40 <= 15000 OR kind = 'A') maskable FROM ({oracle(BOXES)})"


def state_hash(spark, sf_dir):
    e = inputs(spark, sf_dir, _ELEMENTS).select("cycle", F.col("n").alias("ord"), F.lit("input").alias("tag"), "role", "name", F.col("w").alias("x"), F.col("h").alias("y"), "w", "h", F.lit(None).cast("boolean").alias("checked"), F.col("handlers_hint").alias("disabled"), "visible", F.lit(True).alias("interactable"), F.lit("https://h").alias("origin"), F.lit("/p").alias("path"), (F.col("cycle") % 500).alias("scroll_y"))
    e = e.withColumn("frames", F.array(F.struct(F.lit("main").alias("id"), F.lit("https://h").alias("origin")), F.struct(F.concat(F.lit("f"), F.col("cycle") % 3).alias("id"), F.lit(None).cast("string").alias("origin"))))
    target = F.struct(F.lit(10.0).alias("x"), (F.col("cycle") % 40 - 150).cast("double").alias("y"), F.lit(-100.0).alias("w"), F.lit(20.0).alias("h"))
    return G.page_state_hash(e, frames="frames"), G.page_state_hash(e.withColumn("target", target), frames="frames", target="target")


_Q = lambda c: f"CASE WHEN {c} IS NULL THEN 'null' ELSE '\"' || {c} || '\"' END"
_S4 = lambda c: f"CAST(CAST(floor({c} / 4 + 0.5) * 4 AS BIGINT) AS VARCHAR)"
QUERIES["k13_page_state_hash"] = lambda spark, sf_dir: state_hash(spark, sf_dir)[0]
QUERIES["k13_hash_near_target"] = lambda spark, sf_dir: state_hash(spark, sf_dir)[1]
_HASH = lambda live: f"""WITH e AS (SELECT *, '{{"bbox":[' || {_S4('w')} || ',' || {_S4('h')} || ',' || {_S4('w')} || ',' || {_S4('h')} || '],"checked":undefined,"disabled":' || CAST(handlers_hint AS VARCHAR) || ',"name":' || {_Q('name')} || ',"role":' || {_Q('role')} || ',"tag":"input"}}' j FROM ({oracle(_ELEMENTS)}))
SELECT cycle, substr(sha256('{{"dialogOpen":false,"frames":[{{"id":"main","origin":"https://h"}},{{"id":"f' || CAST(any_value(cycle % 3) AS VARCHAR) || '","origin":null}}],"interactive":[' || coalesce(string_agg(j, ',' ORDER BY n) FILTER (visible AND {live}), '') || '],"origin":"https://h","path":"/p","scrollBucket":' || CAST(CAST(floor(any_value(cycle % 500) / 64) AS BIGINT) AS VARCHAR) || '}}'), 1, 16) hash FROM e GROUP BY cycle"""  # noqa: E731
ORACLES["k13_page_state_hash"] = _HASH("true")
ORACLES["k13_hash_near_target"] = _HASH("abs(w - 10) < 50 AND abs(h - (cycle % 40 - 150)) < 170")

_FIELDS = "SELECT c_custkey k, CASE c_custkey % 10 WHEN 0 THEN 'Aadhaar number' WHEN 1 THEN 'E-mail address' WHEN 2 THEN 'Mobile phone' WHEN 3 THEN 'Full name' WHEN 4 THEN 'Date of birth' WHEN 5 THEN 'File name' WHEN 6 THEN 'Voter epic' WHEN 7 THEN 'Home address' WHEN 8 THEN 'Card number' ELSE 'Search' END label, CASE WHEN c_custkey % 3 = 0 THEN 'button' ELSE 'text' END kind FROM {customer}"


def fields(spark, sf_dir):
    f = inputs(spark, sf_dir, _FIELDS)
    c = D.element_candidate({"label": F.col("label"), "type": F.col("kind")})
    return f.select("k", c["subtype"].alias("subtype"), F.round(c["confidence"], 4).alias("confidence"))


QUERIES["d02_elements"] = fields
ORACLES["d02_elements"] = f"SELECT k, CASE WHEN kind = 'button' THEN NULL ELSE CASE k % 10 WHEN 0 THEN 'AADHAAR' WHEN 1 THEN 'EMAIL' WHEN 2 THEN 'PHONE' WHEN 3 THEN 'PERSON' WHEN 4 THEN 'DOB' WHEN 6 THEN 'VOTER_ID' WHEN 7 THEN 'PINCODE' WHEN 8 THEN 'CARD' END END subtype, CASE WHEN kind = 'button' THEN NULL ELSE CASE k % 10 WHEN 0 THEN 0.95 WHEN 1 THEN 0.92 WHEN 2 THEN 0.9 WHEN 3 THEN 0.9 WHEN 4 THEN 0.95 WHEN 6 THEN 0.9 WHEN 7 THEN 0.9 WHEN 8 THEN 0.95 END END confidence FROM ({oracle(_FIELDS)})"

QUERIES["q03_redact_text"] = lambda spark, sf_dir: _table(spark, sf_dir, "documents").select("doc_id", R.redact_spans(F.col("text"), [s for s in D.DETECTORS if s.subtype in ("EMAIL", "IBAN", "PHONE_INTL")]).alias("t")).select("doc_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("bigint").alias("chars"))
QUERIES["k18_redact_region"] = lambda spark, sf_dir: inputs(spark, sf_dir, DQ.sentences("EMAIL")).select("k", R.redact_region(F.col("text"), [s for s in D.DETECTORS if s.subtype == "EMAIL"]).alias("redacted"))
ORACLES["k18_redact_region"] = f"SELECT k, CASE WHEN contains(text, 'voicemail') THEN text ELSE regexp_replace(text, '{P.re2('EMAIL')}', '<EMAIL>', 'g') END redacted FROM ({oracle(DQ.sentences('EMAIL'))})"
QUERIES["k19_fallback"] = lambda spark, sf_dir: inputs(spark, sf_dir, DQ.sentences("AADHAAR")).select("k", R.fallback(F.col("text")).alias("redacted"))
ORACLES["k19_fallback"] = f"SELECT k, regexp_replace(regexp_replace(regexp_replace(text, '{P.re2('AADHAAR')}', '<REDACTED_AADHAAR>', 'g'), '{P.re2('PAN')}', '<REDACTED_PAN>', 'g'), '{P.re2('EMAIL')}', '<EMAIL>', 'g') redacted FROM ({oracle(DQ.sentences('AADHAAR'))})"
QUERIES["q04_outbound_scan"] = lambda spark, sf_dir: _table(spark, sf_dir, "documents").select("doc_id", F.explode(R.outbound_scan(F.col("text"))).alias("s")).select("doc_id", "s.*")
QUERIES["k22_outbound_mail"] = lambda spark, sf_dir: inputs(spark, sf_dir, DQ.sentences("EMAIL")).select("k", F.explode(R.outbound_scan(F.col("text"))).alias("s")).select("k", "s.*")
ORACLES["k22_outbound_mail"] = f"SELECT k, 'EMAIL' kind, CAST(strpos(text, v) - 1 AS INTEGER) AS start, CAST(strpos(text, v) - 1 + len(v) AS INTEGER) AS stop FROM (SELECT k, text, regexp_extract(text, '{P.re2('EMAIL')}', 1) v FROM ({oracle(DQ.sentences('EMAIL'))})) WHERE v <> ''"
_canon = lambda: {"id": F.col("c_custkey"), "segment": F.col("c_mktsegment"), "name": F.col("c_name"), "nation": F.col("c_nationkey")}
_CANON_SQL = "'{\"id\":' || c_custkey || ',\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || ',\"segment\":\"' || c_mktsegment || '\"}'"
QUERIES["q25_attest"] = lambda spark, sf_dir: _table(spark, sf_dir, "customer").select("c_custkey", R.canonical(_canon()).alias("body")).withColumn("sha256", R.digest(F.col("body")))
ORACLES["q25_attest"] = f"SELECT c_custkey, body, sha256(body) sha256 FROM (SELECT c_custkey, {_CANON_SQL} body FROM customer)"
QUERIES["q26_verify_digest"] = lambda spark, sf_dir: _table(spark, sf_dir, "orders").select("o_orderkey", R.intact(F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 3 == 0, F.sha2("o_orderstatus", 256)).when(F.col("o_orderkey") % 3 == 1, F.lit("00"))).alias("intact"))
ORACLES["q26_verify_digest"] = "SELECT o_orderkey, o_orderkey % 3 = 0 intact FROM orders"
QUERIES["k30_tickets"] = lambda spark, sf_dir: _table(spark, sf_dir, "orders").select("o_orderkey", R.signed_ticket(F.col("o_orderkey").cast("string"), F.lit("secret")).alias("ticket"))
ORACLES["k30_tickets"] = "SELECT o_orderkey, sha256(o_orderkey || 'secret') ticket FROM orders"


def sealed(spark, sf_dir):
    key = F.lit(b"0123456789abcdef0123456789abcdef")
    own = F.aes_decrypt(F.aes_encrypt(F.encode("c_name", "utf-8"), key, F.lit("GCM")), key, F.lit("GCM")).cast("string")
    return _table(spark, sf_dir, "customer").select("c_custkey", own.alias("opened"))


QUERIES["k31_sealed_round_trip"] = sealed
ORACLES["k31_sealed_round_trip"] = "SELECT c_custkey, c_name opened FROM customer"


def audit(spark, sf_dir):
    found = D.detect_text(_table(spark, sf_dir, "documents"), ["doc_id"], at=False)
    return found.groupBy(R.label(F.col("subtype")).alias("label"), F.col("token").alias("redacted_as")).agg(F.count(F.lit(1)).alias("n"))


_LABELS = "CASE subtype WHEN 'EMAIL' THEN 'E-mail' WHEN 'PHONE' THEN 'Phone' WHEN 'PHONE_INTL' THEN 'Phone' WHEN 'US_SSN' THEN 'SSN' WHEN 'PAN' THEN 'PAN' WHEN 'DOB' THEN 'Date of birth' WHEN 'CARD' THEN 'Card' WHEN 'UPI' THEN 'UPI' WHEN 'PERSON' THEN 'Name' ELSE subtype END"
QUERIES["q34_audit_labels"] = audit
ORACLES["q34_audit_labels"] = f"SELECT {_LABELS} AS label, CASE subtype " + " ".join(f"WHEN '{s.subtype}' THEN '{s.token}'" for s in D.DETECTORS) + f" END redacted_as, count(*) n FROM ({DQ._all(DQ._DOCS, 'doc_id')}) GROUP BY ALL"
_META = "SELECT event_id, event_type stage, value, 'user ' || CAST(user_id AS STRING) a, event_type b FROM {events}"


def telemetry(spark, sf_dir):
    e = inputs(spark, sf_dir, _META).withColumn("meta", F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"))).withColumn("duration", F.col("value"))
    return E.clean_telemetry(e).select("event_id", "stage", "duration", F.col("meta")["a"].alias("a"), F.col("meta")["b"].alias("b"))


QUERIES["q30_telemetry_meta"] = telemetry
ORACLES["q30_telemetry_meta"] = "SELECT event_id, event_type stage, floor(value * 1000 + 0.5) / 1000 duration, '[REDACTED_BY_I11]' a, event_type b FROM events"
