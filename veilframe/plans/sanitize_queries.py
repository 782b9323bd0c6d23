"""Queries over sanitised regions, outgoing contexts, audits, document fields and page changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors as D
from ..operators import documents as DOC
from ..operators import pages as PG
from ..operators import sanitize as S
from ..streaming import events as M
from .agent_queries import _FIELD_COLUMNS, _REGIONS, _fields
from .derived import BOXES, expected, golden, inputs, oracle

QUERIES, ORACLES = {}, {}
_N = None

#: A region, and the label, type, confidence, text and number of replacements it must get.
_LADDER: list[tuple[dict, tuple]] = [
    ({"has_element": True, "label": "Mobile", "type": "tel", "tag": "input", "region_text": "98"}, ("PHONE", "PHONE", 0.95, "<PHONE>", 1)),
    ({"has_element": True, "tag": "input", "is_password": True, "region_text": "x"}, ("PASSWORD", "PASSWORD", 0.95, "<REDACTED_PASSWORD>", 1)),
    ({"semantic_type": "input", "region_text": "my passwords"}, ("PASSWORD", "PASSWORD", 1.0, "<REDACTED_PASSWORD>", 1)),
    ({"semantic_type": "image", "w": 48.0, "h": 50.0, "classes": "round pic"}, ("FACE", "FACE", 1.0, "<REDACTED_FACE>", 1)),
    ({"semantic_type": "image", "w": 48.0, "h": 90.0, "classes": "round", "region_text": "x y"}, (_N, _N, _N, "x y", 0)),
    ({"semantic_type": "input", "region_text": "Aadhaar no"}, ("AADHAAR", "GOV_ID", 1.0, "<REDACTED_AADHAAR>", 1)),
    ({"semantic_type": "input", "region_text": "pan no"}, ("PAN", "GOV_ID", 1.0, "<REDACTED_PAN>", 1)),
    ({"semantic_type": "input", "region_text": "contact"}, ("PHONE", "PHONE", 1.0, "<PHONE>", 1)),
    ({"semantic_type": "input", "region_text": "order contact"}, (_N, _N, _N, "order contact", 0)),
    ({"semantic_type": "input", "region_text": "mail me"}, ("EMAIL", "EMAIL", 1.0, "<EMAIL>", 1)),
    ({"semantic_type": "text", "region_text": "write to a@b.co or c@d.org"}, ("EMAIL", "EMAIL", 0.98, "write to <EMAIL> or <EMAIL>", 2)),
    ({"region_text": "nothing here"}, (_N, _N, _N, "nothing here", 0)),
    ({"region_text": _N}, (_N, _N, _N, "", 0)),
    ({"has_element": True, "tag": "button", "name": "Password", "region_text": "show"}, (_N, _N, _N, "show", 0)),
]
_REGION_COLUMNS = ["has_element", "region_text", "semantic_type", "tag", "label", "type", "name", "classes", "is_password", "w", "h"]


def _ladder(spark, sf_dir):
    own = golden(spark, sf_dir, [{"w": 10.0, "h": 10.0, **r} for r, _ in _LADDER])
    return own.select("k", S.sanitize_region({c: F.col(c) for c in _REGION_COLUMNS}).alias("r")).select("k", "r.label", "r.type", F.round("r.confidence", 4).alias("confidence"), "r.text", "r.replacements")


QUERIES["k17_sanitized_regions"] = _ladder
ORACLES["k17_sanitized_regions"] = expected(["label", "type", "confidence", "text", "replacements"], [e for _, e in _LADDER], {"confidence": "DOUBLE", "replacements": "INTEGER"})


def _context(spark, sf_dir):
    regions = inputs(spark, sf_dir, _REGIONS)
    found = regions.where("type in ('input', 'link')").select("request", F.when(F.col("type") == "input", "EMAIL").otherwise("PHONE").alias("type"))
    return S.sanitized_context(regions, found).select("request", "sha256", F.length("body").cast("bigint").alias("chars"))


QUERIES["k24_contexts"] = _context
ORACLES["k24_contexts"] = f"""WITH r AS ({oracle(_REGIONS)}),
j AS (SELECT request, string_agg('{{"interactable":' || CAST(interactable AS VARCHAR) || ',"region_id":"' || region_id || '","text":' || coalesce('"' || text || '"', 'null') || ',"type":"' || type || '"}}', ',' ORDER BY ord) j FROM r GROUP BY request),
c AS (SELECT request, string_agg('{{"count":' || n || ',"type":"' || t || '"}}', ',' ORDER BY '{{"count":' || n || ',"type":"' || t || '"}}') c FROM (SELECT request, CASE type WHEN 'input' THEN 'EMAIL' ELSE 'PHONE' END t, count(*) n FROM r WHERE type IN ('input', 'link') GROUP BY ALL) GROUP BY request),
b AS (SELECT request, '{{"redactions":[' || coalesce(c, '') || '],"regions":[' || j || '],"request_id":"req_' || request || '","schema_version":"1.0"}}' body FROM j LEFT JOIN c USING (request))
SELECT request, sha256(body) sha256, CAST(length(body) AS BIGINT) chars FROM b"""

_AUDITED = [
    ("pii_aadhaar_1", "GOV_ID", "Aadhaar (UIDAI 12-Digit)", "<REDACTED_AADHAAR>"), ("pii_pan_2", "GOV_ID", "Indian PAN Card", "<REDACTED_PAN>"), ("x", "PASSWORD", "Password Credential", "<VAULT_PASSWORD>"),
    ("pii_voter_id_1", "GOV_ID", "Voter ID / EPIC Number", "<REDACTED_VOTER_ID>"), ("pii_passport_1", "GOV_ID", "Indian Passport", "<REDACTED_PASSPORT>"), ("pii_driving_licence_1", "GOV_ID", "Indian Driving Licence", "<REDACTED_DRIVING_LICENCE>"),
    ("x", "BANK_ACCOUNT", "Bank Account Number", "<REDACTED_BANK_ACCOUNT>"), ("pii_ifsc", "IDENTIFIER", "Bank Branch IFSC Code", "<REDACTED_IFSC>"), ("pii_upi", "IDENTIFIER", "UPI ID / VPA Handle", "<REDACTED_UPI>"),
    ("x", "CARD", "Payment Card Number", "<REDACTED_CARD>"), ("pii_pincode", "x", "Postal Address / PIN Code", "<REDACTED_ADDRESS>"), ("x", "DOB", "Date of Birth", "<REDACTED_DOB>"), ("pii_person_el", "PERSON", "Person Full Name", "<REDACTED_NAME>"),
    ("x", "EMAIL", "Work Email Address", "<EMAIL>"), ("x", "PHONE", "Mobile / Phone Number", "<PHONE>"), ("x", "FACE", "Biometric Face Avatar", "Solid Blackout Box [Red Border]"), ("x", "GOV_ID", "GOV_ID", "<REDACTED>"),
    ("pii_span", "EMAIL", "Indian PAN Card", "<REDACTED_PAN>"),
]
QUERIES["i12_audit_items"] = lambda spark, sf_dir: golden(spark, sf_dir, [{"id": i, "t": t} for i, t, *_ in _AUDITED]).select("k", S.audit_item(F.col("id"), F.col("t")).alias("a")).select("k", "a.label", "a.redacted_as")
ORACLES["i12_audit_items"] = expected(["label", "redacted_as"], [tuple(x) for _, _, *x in _AUDITED])

_CYCLES = "SELECT o_orderkey cycle, o_orderkey % 5 texts, o_custkey % 3 boxes FROM {orders}"
QUERIES["i04_redaction_totals"] = lambda spark, sf_dir: S.redaction_totals(inputs(spark, sf_dir, BOXES).where("conf > 0.7"), inputs(spark, sf_dir, _CYCLES))
ORACLES["i04_redaction_totals"] = f"SELECT cycle, (SELECT count(*) FROM ({oracle(BOXES)}) b WHERE b.cycle = c.cycle AND conf > 0.7) detections, texts + boxes replaced FROM ({oracle(_CYCLES)}) c"
QUERIES["i10_span_counts"] = lambda spark, sf_dir: inputs(spark, sf_dir, BOXES).groupBy("cycle").agg(F.count(F.lit(1)).alias("elements"), F.count_if(F.col("conf") > 0.8).alias("decisions"), F.count_distinct("kind").alias("regions"))
ORACLES["i10_span_counts"] = f"SELECT cycle, count(*) elements, count(*) FILTER (conf > 0.8) decisions, count(DISTINCT kind) regions FROM ({oracle(BOXES)}) GROUP BY cycle"
_IMAGES = """SELECT l_orderkey cycle, l_partkey % 3 <> 0 visible, l_suppkey % 4 <> 0 in_viewport, CASE l_linenumber WHEN 1 THEN 'img' WHEN 2 THEN 'canvas' ELSE 'html' END rendering, CASE l_partkey % 5 WHEN 0 THEN 'embed' ELSE 'div' END tag,
l_suppkey % 9 = 0 has_bg_image, CAST(l_quantity * 2 AS DOUBLE) w, CAST(l_quantity AS DOUBLE) h, CASE WHEN l_orderkey % 8 = 0 THEN 'https://Docs.google.com' ELSE 'https://a.example' END origin FROM {lineitem}"""
QUERIES["a08_ocr_wanted"] = lambda spark, sf_dir: S.ocr_wanted(inputs(spark, sf_dir, _IMAGES))
ORACLES["a08_ocr_wanted"] = f"SELECT cycle, bool_or(visible AND in_viewport AND (rendering IN ('img', 'canvas') OR tag = 'embed' OR has_bg_image) AND w * h >= 2500) OR cycle % 8 = 0 wanted FROM ({oracle(_IMAGES)}) GROUP BY cycle"
_WORDS = "SELECT l_orderkey doc, l_linenumber n, 'w' || l_partkey word, CAST((l_partkey * 7) % 100 AS DOUBLE) confidence, CAST(l_suppkey AS DOUBLE) x0, CAST(l_linenumber * 10 AS DOUBLE) y0, CAST(l_suppkey + 30 AS DOUBLE) x1, CAST(l_linenumber * 10 + 8 AS DOUBLE) y1 FROM {lineitem}"


def _ocr(spark, sf_dir):
    """Two blocks a document, each with a paragraph of one line."""
    words = inputs(spark, sf_dir, _WORDS).groupBy("doc", (F.col("n") % 2).alias("b")).agg(F.collect_list(F.struct("word", "confidence", "x0", "y0", "x1", "y1")).alias("words"))
    blocks = words.groupBy("doc").agg(F.collect_list(F.struct(F.array(F.struct(F.array(F.struct("words")).alias("lines"))).alias("paragraphs"))).alias("blocks"))
    return DOC.unnest_ocr(blocks)


QUERIES["a06_ocr_words"] = _ocr
ORACLES["a06_ocr_words"] = f"SELECT doc, word, x0 x, y0 y, x1 - x0 w, y1 - y0 h, confidence / 100 confidence FROM ({oracle(_WORDS)}) WHERE confidence >= 25"


def _all(spark, sf_dir):
    """Pages of a hundred customers; elements share ids by k % 3."""
    own = _fields(spark, sf_dir).withColumn("page", F.floor(F.col("k") / 100)).withColumn("dom_id", F.when(F.col("k") % 3 > 0, F.col("k") % 3))
    return D.detect_all(own, {c: F.col(c) for c in _FIELD_COLUMNS}, ["page"], "k").select("page", "k", "id", F.round("confidence", 4).alias("confidence"))


#: What the detectors alone find in the cases of fields, by case.
_DETECTED = {6: ("aadhaar", 0.95), 8: ("pan", 0.9), 11: ("passport", 0.9), 12: ("email", 0.92), 13: ("email", 1.0), 14: ("phone", 0.95), 15: ("phone", 0.9), 32: ("phone", 0.9), 33: ("email", 0.98)}
QUERIES["d04_detect_all"] = _all
ORACLES["d04_detect_all"] = f"""SELECT page, k, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY k) n FROM (SELECT CAST(floor(c_custkey / 100) AS BIGINT) page, c_custkey k, confidence,
'pii_' || subtype || '_' || CASE WHEN c_custkey % 3 = 0 THEN 'elem' ELSE CAST(c_custkey % 3 AS VARCHAR) END id FROM customer JOIN (VALUES {', '.join(f"({i}, '{s}', {c})" for i, (s, c) in _DETECTED.items())}) e(i, subtype, confidence) ON c_custkey % 34 = i)) WHERE n = 1"""

#: A text, and the spans it must give: kind, occurrence, place and length.
_SPANS: list[tuple[str, list[tuple]]] = [
    ("a@b.co or a@b.co", [("EMAIL", 0, 0, 6), ("EMAIL", 1, 10, 6)]),
    ("id 2345 6789 0124 or 2345 6789 0123", [("AADHAAR", 0, 3, 14)]),
    ("ABCPE1234F abcpe1234f ABCDE1234F", [("PAN", 0, 0, 10), ("PAN", 1, 11, 10)]),
    ("ring +91 98765 43210", [("PHONE", 0, 5, 15)]),
    ("nothing", []),
    (None, []),
]


def _spans(spark, sf_dir):
    return PG.inline_spans(golden(spark, sf_dir, [{"text": t} for t, _ in _SPANS]), ("k",)).select("k", "kind", "n", "at", "length")


QUERIES["a04_span_cases"] = _spans
ORACLES["a04_span_cases"] = "SELECT c_custkey k, kind, n, p AS \"at\", length FROM customer JOIN (VALUES " + ", ".join(f"({i}, '{kind}', {n}, {at}, {length})" for i, (_, own) in enumerate(_SPANS) for kind, n, at, length in own) + f") e(c, kind, n, p, length) ON c_custkey % {len(_SPANS)} = c"

# -- documents --------------------------------------------------------------------------------------------

#: A document's lines, and the fields it must get, in order: line, field, category, confidence.
_SHEETS: list[tuple[list[str], list[tuple]]] = [
    (["INCOME TAX DEPARTMENT", "RAHUL KUMAR", "MOHAN KUMAR", "01/02/1990", "ABCPE1234F"], [(3, "DOB", "DOB", 0.9), (4, "PAN", "GOV_ID", 0.99), (1, "NAME", "PERSON", 0.92), (2, "FATHER_NAME", "PERSON", 0.9)]),
    (["Permanent Account Number Card", "ABCPE I234 F", "Name", "Asha Rao"], [(1, "PAN", "GOV_ID", 0.99), (1, "PAN", "GOV_ID", 0.99), (3, "NAME", "PERSON", 0.88)]),
    (["Name : Asha Rao", "Father : Vik Rao", "DOB", "1.2.85"], [(0, "NAME", "PERSON", 0.88), (1, "FATHER_NAME", "PERSON", 0.88), (3, "DOB", "DOB", 0.9)]),
    (["uid 2345 6789 0123"], [(0, "AADHAAR", "GOV_ID", 0.95)]),
    (["account statement", "write a@b.co", "write c@d.co"], [(1, "EMAIL", "EMAIL", 0.98)]),
    (["plain words only"], []),
]


def _sheets(spark, sf_dir):
    own = golden(spark, sf_dir, [{"text": "\n".join(lines)} for lines, _ in _SHEETS])
    return own.select(F.col("k").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "text"))


QUERIES["f08_sheet_fields"] = lambda spark, sf_dir: DOC.fields(_sheets(spark, sf_dir)).select("doc", "idx", F.col("line").cast("bigint").alias("line"), "category", F.round("confidence", 4).alias("confidence"), "id", "token")
ORACLES["f08_sheet_fields"] = "SELECT c_custkey doc, CAST(idx AS INTEGER) idx, CAST(line AS BIGINT) line, category, CAST(confidence AS DOUBLE) confidence, 'doc_field_' || lower(field) || '_' || c_custkey || '_' || idx id, '<REDACTED_' || field || '>' token FROM customer JOIN (VALUES " + ", ".join(
    f"({case}, {i}, {line}, '{field}', '{category}', {confidence})" for case, (_, found) in enumerate(_SHEETS) for i, (line, field, category, confidence) in enumerate(found)
) + f") e(c, idx, line, field, category, confidence) ON c_custkey % {len(_SHEETS)} = c"
QUERIES["f13_sheet_confidence"] = lambda spark, sf_dir: DOC.confidences(_sheets(spark, sf_dir)).select("doc", F.round("confidence", 4).alias("confidence"), "fields")
ORACLES["f13_sheet_confidence"] = "SELECT c_custkey doc, CAST(confidence AS DOUBLE) confidence, CAST(fields AS BIGINT) fields FROM customer JOIN (VALUES " + ", ".join(
    f"({case}, {round(sum(f[3] for f in found) / max(1, len(found)), 4)}, {len(found)})" for case, (_, found) in enumerate(_SHEETS)
) + f") e(c, confidence, fields) ON c_custkey % {len(_SHEETS)} = c"

# -- changes of pages -------------------------------------------------------------------------------------

_CHANGES = "SELECT user_id key, CAST((event_id * 53) % 20011 AS BIGINT) ms, event_id event FROM {events}"
_ACTIONS = "SELECT user_id key, event_id action, CAST((event_id * 31) % 20000 AS BIGINT) ms FROM {events} WHERE event_id % 5 = 2"
_CACHE = "SELECT DISTINCT user_id key, CAST(19800 + user_id % 211 AS BIGINT) cached_at FROM {events}"
_C, _A, _K = oracle(_CHANGES), oracle(_ACTIONS), oracle(_CACHE)


def _timed(spark, sf_dir, sql):
    return inputs(spark, sf_dir, sql).withColumnRenamed("ms", "at")


QUERIES["m11_settled"] = lambda spark, sf_dir: M.settled(_timed(spark, sf_dir, _ACTIONS), _timed(spark, sf_dir, _CHANGES))
ORACLES["m11_settled"] = f"""WITH p AS (SELECT action, ms s, ms FROM ({_A}) UNION SELECT action, a.ms, c.ms FROM ({_A}) a JOIN ({_C}) c ON a.key = c.key AND c.ms > a.ms AND c.ms < a.ms + 2000)
SELECT action, least(min(ms) FILTER (nxt IS NULL OR nxt - ms > 150) + 150, any_value(s) + 2000) settled_at FROM (SELECT *, lead(ms) OVER (PARTITION BY action ORDER BY ms) nxt FROM p) GROUP BY action"""
QUERIES["m03_drained"] = lambda spark, sf_dir: M.drained(_timed(spark, sf_dir, _CHANGES), _timed(spark, sf_dir, _ACTIONS).select("key", "at"))
ORACLES["m03_drained"] = f"SELECT c.key, event, (SELECT min(a.ms) FROM ({_A}) a WHERE a.key = c.key AND a.ms >= c.ms) drained_at FROM ({_C}) c"
QUERIES["m10_still_cached"] = lambda spark, sf_dir: M.invalidated(inputs(spark, sf_dir, _CACHE), _timed(spark, sf_dir, _CHANGES), ["key"])
ORACLES["m10_still_cached"] = f"SELECT * FROM ({_K}) k WHERE NOT EXISTS (SELECT 1 FROM ({_C}) c WHERE c.key = k.key AND c.ms > k.cached_at)"
