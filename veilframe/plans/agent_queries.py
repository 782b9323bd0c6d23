"""Queries over fields, contracts, plans, regions and decoded outputs; expected rows of cases are written out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classifier as C
from ..operators import contracts as K
from ..operators import decoders as DEC
from ..operators import documents as DOC
from ..operators import geometry as G
from ..operators import perception as P
from ..operators import planner as PL
from .derived import expected, golden, inputs, oracle

QUERIES, ORACLES = {}, {}
_N = None

# -- fields -----------------------------------------------------------------------------------------------

#: A field, and the category, subtype and confidence it must get.
_FIELDS: list[tuple[dict, tuple]] = [
    ({"label": "Password", "type": "password"}, ("PASSWORD", "PASSWORD", 0.98)),
    ({"label": "API token"}, (_N, _N, _N)),
    ({"element_name": "api_key"}, ("AUTH_TOKEN", "AUTH_TOKEN", 0.95)),
    ({"label": "Code", "autocomplete": "one-time-code"}, ("PASSWORD", "PASSWORD", 0.95)),
    ({"label": "OTP token"}, ("AUTH_TOKEN", "AUTH_TOKEN", 0.95)),
    ({"label": "PIN"}, (_N, _N, _N)),
    ({"label": "Aadhaar number"}, ("GOV_ID", "AADHAAR", 0.95)),
    ({"label": "ID", "placeholder": "XXXX XXXX XXXX"}, ("GOV_ID", "AADHAAR", 0.95)),
    ({"label": "PAN card"}, ("GOV_ID", "PAN", 0.9)),
    ({"label": "Frying pan"}, (_N, _N, _N)),
    ({"label": "National ID", "name": "National ID"}, ("GOV_ID", "GOV_ID", 0.98)),
    ({"label": "Passport number"}, ("GOV_ID", "PASSPORT", 0.9)),
    ({"label": "Reach us", "type": "email"}, ("EMAIL", "EMAIL", 0.92)),
    ({"label": "E-mail", "type": "email"}, ("EMAIL", "EMAIL", 1.0)),
    ({"label": "Mobile", "type": "tel"}, ("PHONE", "PHONE", 0.95)),
    ({"label": "Mobile"}, ("PHONE", "PHONE", 0.9)),
    ({"label": "Microphone booth"}, (_N, _N, _N)),
    ({"label": "Number", "autocomplete": "cc-number"}, ("CARD", "CARD", 0.95)),
    ({"label": "Holder", "autocomplete": "cc-name"}, (_N, _N, _N)),
    ({"label": "Routing number"}, ("BANK_ACCOUNT", "BANK_ACCOUNT", 0.95)),
    ({"label": "Exp date"}, ("CARD", "CARD", 0.95)),
    ({"label": "Greeting card number"}, (_N, _N, _N)),
    ({"label": "Legal name"}, ("PERSON", "PERSON", 0.88)),
    ({"label": "Mother's name", "autocomplete": "name"}, ("PERSON", "PERSON", 0.92)),
    ({"label": "Name", "tag": "input"}, (_N, _N, _N)),
    ({"label": "Zip code", "autocomplete": "postal-code"}, ("ADDRESS", "ADDRESS", 0.93)),
    ({"label": "IP address"}, (_N, _N, _N)),
    ({"label": "Day", "autocomplete": "bday"}, ("DOB", "DOB", 0.92)),
    ({"label": "Birthdate"}, ("DOB", "DOB", 0.92)),
    ({"label": "Password", "type": "submit"}, (_N, _N, _N)),
    ({"label": "Release date"}, (_N, _N, _N)),
    ({"label": "Voice mail"}, (_N, _N, _N)),
    ({"label": "Cell number"}, ("PHONE", "PHONE", 0.9)),
    ({"label": "Write", "value": "a@b.co"}, ("EMAIL", "EMAIL", 0.98)),
]
_FIELD_COLUMNS = ["label", "name", "placeholder", "element_name", "type", "autocomplete", "tag", "value"]


def _element() -> dict:
    return {c: F.col(c) for c in _FIELD_COLUMNS}


def _fields(spark, sf_dir):
    return golden(spark, sf_dir, [f for f, _ in _FIELDS])


def _classified(spark, sf_dir):
    return _fields(spark, sf_dir).select("k", C.classify(_element()).alias("r")).select("k", "r.category", "r.subtype", F.round("r.confidence", 4).alias("confidence"))


_FIELDS_SQL = expected(["category", "subtype", "confidence"], [e for _, e in _FIELDS], {"confidence": "DOUBLE"})
QUERIES["e01_field_categories"] = _classified
ORACLES["e01_field_categories"] = _FIELDS_SQL


def _first_of_ids(spark, sf_dir):
    """Pages of a hundred customers; elements share ids by k % 5."""
    own = _fields(spark, sf_dir).withColumn("page", F.floor(F.col("k") / 100)).withColumn("dom_id", F.when(F.col("k") % 5 > 0, F.col("k") % 5))
    return C.classify_all(own, _element(), ["page"], "k").select("page", "k", "id", "category")


QUERIES["e09_classified_once"] = _first_of_ids
ORACLES["e09_classified_once"] = f"""SELECT page, k, id, category FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY k) n FROM (
SELECT CAST(floor(k / 100) AS BIGINT) page, k, category, 'pii_' || CASE WHEN category = 'GOV_ID' THEN 'govid_' || lower(subtype) ELSE lower(category) END || '_' || CASE WHEN k % 5 = 0 THEN 'el' ELSE CAST(k % 5 AS VARCHAR) END id
FROM ({_FIELDS_SQL}) WHERE category IS NOT NULL)) WHERE n = 1"""

_KINDS = [
    ("INCOME TAX DEPARTMENT", 2, "ID_CARD"), ("Govt of India\ncard", 2, "ID_CARD"), ("Father's Name\nA B", 2, "ID_CARD"), ("xx abcpe1234f yy", 1, "ID_CARD"), ("abcde 12o4 f", 1, "ID_CARD"),
    ("driving licence", 1, "ID_CARD"), ("Account Statement", 3, "BANK_STATEMENT"), ("balance due\nform", 9, "BANK_STATEMENT"), ("Degree awarded", 2, "CERTIFICATE"),
    ("registration form", 6, "FORM"), ("registration form", 5, "UNKNOWN"), ("plain words", 9, "UNKNOWN"), ("passports", 1, "UNKNOWN"), ("date of\nbirth", 2, "ID_CARD"),
]
QUERIES["f03_kind_cases"] = lambda spark, sf_dir: golden(spark, sf_dir, [{"text": t, "n": n} for t, n, _ in _KINDS]).select("k", DOC.kind(F.col("text"), F.col("n")).alias("kind"))
ORACLES["f03_kind_cases"] = expected(["kind"], [(x,) for _, _, x in _KINDS])

# -- contracts --------------------------------------------------------------------------------------------

_OK = '{"request_id":"r","observation_id":"o","action":{"type":"click","target_id":"t"}}'
_REQUESTS = [
    (_OK, "OK"), ("[1]", "MALFORMED_REQUEST"), ("{", "MALFORMED_REQUEST"), ('{"observation_id":"o","action":{"type":"click"}}', "MALFORMED_REQUEST"),
    ('{"request_id":"","observation_id":"o","action":{"type":"click"}}', "MALFORMED_REQUEST"), ('{"request_id":"r","action":{"type":"click"}}', "INVALID_OBSERVATION"),
    ('{"request_id":"r","observation_id":7,"action":{"type":"click"}}', "INVALID_OBSERVATION"), ('{"request_id":"r","observation_id":"o"}', "MALFORMED_REQUEST"),
    ('{"request_id":"r","observation_id":"o","action":{"target_id":"t"}}', "MISSING_ACTION_TYPE"), ('{"request_id":"r","observation_id":"o","action":{"type":"hover"}}', "UNSUPPORTED_ACTION"),
    ('{"request_id":"r","observation_id":"o","action":{"type":3}}', "MALFORMED_REQUEST"), ('{"request_id":"r","observation_id":"o","action":{"type":"click"}}', "MISSING_TARGET"),
    ('{"request_id":"r","observation_id":"o","action":{"type":"scroll","target_id":""}}', "MISSING_TARGET"), ('{"request_id":"r","observation_id":"o","action":{"type":"scroll"}}', "OK"),
    ('{"request_id":"r","observation_id":"o","action":{"type":"scroll","params":{"direction":"north"}}}', "MALFORMED_REQUEST"),
    ('{"request_id":"r","observation_id":"o","action":{"type":"scroll","params":{"direction":"up","amount":10000}}}', "OK"),
    ('{"request_id":"r","observation_id":"o","action":{"type":"scroll","params":{"amount":1.5}}}', "MALFORMED_REQUEST"),
    ('{"request_id":"r","observation_id":"o","action":{"type":"scroll","params":null}}', "OK"),
    ('{"request_id":"r","observation_id":"o","action":{"type":"type","target_id":"t","params":{"text":"hi"}}}', "OK"),
    ('{"request_id":"r","observation_id":"o","action":{"type":"type","target_id":"t"}}', "MALFORMED_REQUEST"),
    ('{"request_id":"r","observation_id":"o","action":{"type":"type","target_id":"t","params":{"text":"javascript:x"}}}', "SCRIPT_INJECTION_REJECTED"),
    ('{"request_id":"r","observation_id":"o","action":{"type":"keypress","params":{}}}', "MALFORMED_REQUEST"), ('{"request_id":"r","observation_id":"o","action":{"type":"keypress","params":{"key":"Tab"}}}', "OK"),
    ('{"request_id":"r","observation_id":"o","action":{"type":"scroll","x":1}}', "MALFORMED_REQUEST"), ('{"request_id":"r","observation_id":"o","action":{"type":"scroll"},"more":1}', "MALFORMED_REQUEST"),
    ('{"request_id":"r","observation_id":"o","action":{"type":"scroll"},"capability":null,"page_state_hash":"h"}', "OK"), ('{"request_id":"r","observation_id":"o","action":{"type":"scroll"},"page_state_hash":5}', "MALFORMED_REQUEST"),
]
QUERIES["l12_request_contract"] = lambda spark, sf_dir: golden(spark, sf_dir, [{"raw": r} for r, _ in _REQUESTS]).select("k", K.request_code(F.col("raw")).alias("code"))
ORACLES["l12_request_contract"] = expected(["code"], [(x,) for _, x in _REQUESTS])

_CALLS = [
    ("get_observation", "{}", 0), ("get_observation", '{"observation_id":"o"}', 0), ("get_observation", '{"x":1}', -32602), (None, "{}", -32600), ("observe", "{}", -32601), ("navigate", "{}", -32601),
    ("click", '{"observation_id":"o","target_id":"t"}', 0), ("click", '{"observation_id":"o"}', -32602), ("click", '{"observation_id":"","target_id":"t"}', -32602), ("click", "x", -32602),
    ("click", '{"observation_id":"o","target_id":"t","screenshot":"p"}', -32602), ("type", '{"observation_id":"o","target_id":"t","text":""}', 0), ("type", '{"observation_id":"o","target_id":"t","text":"eval (1)"}', -32602),
    ("type", '{"observation_id":"o","target_id":"t"}', -32602), ("scroll", '{"observation_id":"o"}', 0), ("scroll", '{"observation_id":"o","direction":"left","amount":1}', 0), ("scroll", '{"observation_id":"o","amount":0}', -32602),
    ("scroll", '{"observation_id":"o","direction":"in"}', -32602), ("keypress", '{"observation_id":"o","key":"Enter","request_id":"q"}', 0), ("keypress", '{"observation_id":"o","key":""}', -32602), ("keypress", '{"observation_id":"o","key":"a","request_id":4}', -32602),
]
QUERIES["l19_tool_schemas"] = lambda spark, sf_dir: golden(spark, sf_dir, [{"tool": t, "args": a} for t, a, _ in _CALLS]).select("k", K.tool_code(F.col("tool"), F.col("args")).alias("code"))
ORACLES["l19_tool_schemas"] = expected(["code"], [(x,) for _, _, x in _CALLS], {"code": "INTEGER"})

_AGENT = [
    ({"type": "click", "target": "r1", "exists": True}, _N), ({"type": "click", "exists": True}, "Action 'click' requires a target_region_id."),
    ({"type": "select", "target": "r9", "exists": False}, "Target region_id 'r9' not found in observation."), ({"type": "type", "target": "r1", "exists": True}, "Action 'type' requires params.text."),
    ({"type": "type", "target": "r1", "exists": True, "text": "x"}, _N), ({"type": "scroll"}, "Action 'scroll' requires params.direction."), ({"type": "scroll", "direction": "in"}, "Invalid scroll direction: in."),
    ({"type": "scroll", "direction": "up"}, _N), ({"type": "navigate"}, "Action 'navigate' requires params.url."), ({"type": "navigate", "url": "u"}, _N), ({"type": "wait"}, _N), ({"type": ""}, "Action is missing a valid type."),
    ({"type": "hover"}, "Unsupported action type: hover"),
]
_AGENT_COLUMNS = ["type", "target", "exists", "text", "direction", "url"]
QUERIES["l17_agent_actions"] = lambda spark, sf_dir: golden(spark, sf_dir, [a for a, _ in _AGENT]).select("k", K.agent_reason({c: F.col(c) for c in _AGENT_COLUMNS}).alias("reason"))
ORACLES["l17_agent_actions"] = expected(["reason"], [(x,) for _, x in _AGENT])

_MISMATCH = "Attestation violation: Digest mismatch. Body was altered in transit."
_BODIES = [
    ('{"request_id":"a"}', 200, _N, "a"), ("{nope", 400, "Malformed JSON in request body", _N), ('{"body":"{}","sha256":"00"}', 400, _MISMATCH, _N),
    ('{"request_id":"b","body":"{}","sha256":"44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"}', 200, _N, "b"),
    ('{"body":"{","sha256":"021fb596db81e6d02bf3d2586ee3981fe519f275c0ac9ca76bbcf2ebb4097d96"}', 400, "Malformed context in attested body", _N), ('{"page":{}}', 200, _N, _N),
]


def _bodies(spark, sf_dir):
    r = K.decoded_body(F.col("raw"))
    return golden(spark, sf_dir, [{"raw": b} for b, *_ in _BODIES]).select("k", r["status"].alias("status"), r["detail"].alias("detail"), r["request_id"].alias("request_id"))


QUERIES["a13_decoded_bodies"] = _bodies
ORACLES["a13_decoded_bodies"] = expected(["status", "detail", "request_id"], [tuple(x) for _, *x in _BODIES], {"status": "INTEGER"})

# -- plans ------------------------------------------------------------------------------------------------

_REGIONS = """SELECT l_orderkey request, CAST(l_linenumber AS BIGINT) ord, 'r' || l_linenumber region_id,
CASE l_partkey % 6 WHEN 0 THEN 'button' WHEN 1 THEN 'link' WHEN 2 THEN 'input' WHEN 3 THEN 'custom_control' WHEN 4 THEN 'button' ELSE 'text' END type,
CASE l_suppkey % 5 WHEN 0 THEN 'Sign in' WHEN 1 THEN 'Submit order' WHEN 2 THEN NULL WHEN 3 THEN 'Search here' ELSE 'Terms' END text, CASE l_suppkey % 7 WHEN 0 THEN FALSE WHEN 1 THEN FALSE ELSE TRUE END interactable
FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) l_partkey, max(l_suppkey) l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"""
_TASKS = """SELECT o_orderkey request, CASE o_orderkey % 10 WHEN 0 THEN 'Scroll up' WHEN 1 THEN 'Type my name' WHEN 2 THEN 'Fill the form' WHEN 3 THEN 'Go back' WHEN 4 THEN 'click the terms link'
WHEN 5 THEN 'search for blue shoes' WHEN 6 THEN 'type hello into search' WHEN 7 THEN 'wait a moment' WHEN 8 THEN NULL ELSE 'look around' END task,
CASE WHEN o_orderkey % 3 = 0 THEN 'http://localhost:5173' ELSE 'https://shop.example' END origin, o_orderkey % 4 = 0 succeeded FROM {orders}"""
_R, _T = oracle(_REGIONS), oracle(_TASKS)


def _planned(run):
    return lambda spark, sf_dir: run(inputs(spark, sf_dir, _TASKS), inputs(spark, sf_dir, _REGIONS))


QUERIES["k26_plans"] = _planned(PL.plan)
ORACLES["k26_plans"] = f"""SELECT request, CASE WHEN coalesce(task, '') ILIKE '%scroll%' THEN 'scroll' WHEN coalesce(task, '') ILIKE '%type%' OR coalesce(task, '') ILIKE '%enter%' THEN 'type' ELSE 'click' END AS action,
coalesce(a, b, c, d, 'r1') target FROM ({_T}) LEFT JOIN (SELECT request,
arg_min(region_id, ord) FILTER (type = 'button' AND interactable AND (contains(lower(text), 'sign in') OR contains(lower(text), 'submit'))) a, arg_min(region_id, ord) FILTER (type = 'button' AND interactable) b,
arg_min(region_id, ord) FILTER (type IN ('link', 'custom_control') AND interactable AND contains(lower(text), 'sign in')) c, arg_min(region_id, ord) d FROM ({_R}) GROUP BY request) USING (request)"""
QUERIES["k27_mock_plans"] = _planned(PL.mock_plan)
ORACLES["k27_mock_plans"] = f"""SELECT request, CASE WHEN loc THEN 'action' ELSE 'fail' END status, CASE WHEN loc THEN a END AS action, CASE WHEN loc THEN CASE WHEN a = 'type' THEN i WHEN a = 'click' AND NOT fill THEN coalesce(b, d, 'r1') END END target,
CASE WHEN loc AND a = 'scroll' THEN 'up' END direction, CASE WHEN loc AND a = 'type' THEN 'mock input' END AS text
FROM (SELECT *, request % 3 = 0 loc, request % 10 IN (1, 2, 6) fill, CASE WHEN request % 10 = 0 THEN 'scroll' WHEN request % 10 IN (1, 2, 6) AND i IS NOT NULL THEN 'type' WHEN request % 10 = 3 THEN 'back' ELSE 'click' END a
FROM ({_T}) LEFT JOIN (SELECT request, arg_min(region_id, ord) FILTER (type = 'input') i, arg_min(region_id, ord) FILTER (type = 'button' OR text = 'Sign in') b, arg_min(region_id, ord) d FROM ({_R}) GROUP BY request) USING (request))"""
QUERIES["k28_local_intents"] = _planned(PL.local_intent)
ORACLES["k28_local_intents"] = f"""SELECT request, a AS action, CASE WHEN a = 'type' THEN f WHEN a = 'click' THEN coalesce(CASE WHEN t = 4 THEN coalesce(terms, anyone) END, b, d) END target,
CASE WHEN a = 'scroll' THEN 'up' END direction, CASE WHEN a = 'type' THEN CASE t WHEN 5 THEN 'blue shoes' ELSE 'hello' END END AS text
FROM (SELECT *, CASE WHEN t = 7 AND succeeded THEN 'done' WHEN t = 0 THEN 'scroll' WHEN t = 3 THEN 'back' WHEN d IS NULL THEN 'done' WHEN t IN (5, 6) AND f IS NOT NULL THEN 'type' ELSE 'click' END a
FROM (SELECT *, request % 10 t FROM ({_T})) LEFT JOIN (SELECT request, arg_min(region_id, ord) FILTER (interactable AND (type = 'input' OR text = 'Search here')) f, arg_min(region_id, ord) FILTER (interactable AND text = 'Terms') terms,
arg_min(region_id, ord) FILTER (interactable) anyone, arg_min(region_id, ord) FILTER (interactable AND type = 'button') b, arg_min(region_id, ord) d FROM ({_R}) GROUP BY request) USING (request))"""
#: Requests by their text and the code that answers them.
_RPC: list[tuple[str | None, int]] = [
    ('{"jsonrpc":"2.0","id":1,"method":"tools/list"}', 0),
    ('{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"name":"get_observation","arguments":{"request_id":"a"}}}', -1),
    ('{"jsonrpc":"2.0","method":"tools/call","params":{"arguments":{}}}', -32602),
    ('{"jsonrpc":"2.0","method":"tools/call","params":{"name":"erase"}}', -32601),
    ('{"jsonrpc":"2.0","method":"tools/call","params":{"name":""}}', -32602),
    ('{"jsonrpc":"2.0","method":"tools/run"}', -32601),
    ('{"jsonrpc":"1.0","method":"tools/list"}', -32600),
    ('{"jsonrpc":"2.0"}', -32600),
    ("no json", -32600),
    (None, -32600),
]


def _rpc(spark, sf_dir):
    code = K.rpc_code(F.col("raw"))
    # What a known tool says of its arguments is l19's matter.
    known = F.col("raw").contains("get_observation")
    return golden(spark, sf_dir, [{"raw": raw} for raw, _ in _RPC]).select("k", F.when(known & ~code.isin(-32600, -32601), -1).otherwise(code).cast("int").alias("code"))


QUERIES["n05_rpc_codes"] = _rpc
ORACLES["n05_rpc_codes"] = expected(["code"], [(c,) for _, c in _RPC], {"code": "INTEGER"})
QUERIES["n02_provider_plans"] = lambda spark, sf_dir: PL.planned("rules", inputs(spark, sf_dir, _TASKS), inputs(spark, sf_dir, _REGIONS).withColumn("raw", F.lit("x")))
ORACLES["n02_provider_plans"] = ORACLES["k26_plans"]
QUERIES["k29_observations"] = lambda spark, sf_dir: PL.observation(inputs(spark, sf_dir, _REGIONS).withColumn("box", F.lit("[0,0,1,1]")).withColumn("raw", F.lit("x"))).withColumn("status", PL.outcome(F.when(F.col("ord") % 2 == 0, "ok").otherwise("stale")))
ORACLES["k29_observations"] = f"SELECT request, ord, region_id, type, text, interactable, CASE WHEN ord % 2 = 0 THEN 'success' ELSE 'failed' END status FROM ({_R})"
_FAILURES = [
    ("click requires a target element here", "TARGET_NOT_FOUND", PL.ERRORS[0][2]), ("navigate requires a url", "INTERNAL", "The requested navigation action requires a valid URL."),
    ("Unsupported action type: x", "INTERNAL", "The requested action type is not supported."), ("fill_secret requires a resolved secret", "INTERNAL", "The secret could not be resolved for filling."),
    ("Cannot read /home/u/key", "INTERNAL", "Action execution failed due to an internal browser error."), (None, "INTERNAL", "Action execution failed due to an internal browser error."),
]
QUERIES["k35_safe_errors"] = lambda spark, sf_dir: golden(spark, sf_dir, [{"m": m} for m, *_ in _FAILURES]).select("k", PL.safe_error(F.col("m")).alias("e")).select("k", "e.code", "e.message")
ORACLES["k35_safe_errors"] = expected(["code", "message"], [tuple(x) for _, *x in _FAILURES])

# -- decoded outputs --------------------------------------------------------------------------------------

_SIZES = "SELECT l_orderkey k, l_linenumber n, CAST(100 + l_partkey % 2000 AS DOUBLE) sw, CAST(80 + l_suppkey % 900 AS DOUBLE) sh FROM {lineitem}"


def _letterbox(spark, sf_dir):
    r = DEC.letterbox(F.col("sw"), F.col("sh"), F.lit(640.0), F.lit(480.0))
    return inputs(spark, sf_dir, _SIZES).select("k", "n", r.alias("r")).select("k", "n", F.round("r.scale", 6).alias("scale"), "r.model_w", "r.model_h", "r.padded_w", "r.padded_h")


QUERIES["k33_letterbox"] = _letterbox
ORACLES["k33_letterbox"] = f"""SELECT k, n, round(s, 6) AS scale, CAST(floor(sw * s + 0.5) AS INTEGER) model_w, CAST(floor(sh * s + 0.5) AS INTEGER) model_h, CAST(ceil(floor(sw * s + 0.5) / 32) * 32 AS INTEGER) padded_w, CAST(ceil(floor(sh * s + 0.5) / 32) * 32 AS INTEGER) padded_h
FROM (SELECT *, least(640 / sw, 480 / sh, 1.5) s FROM ({oracle(_SIZES)}))"""
_CELLS = """SELECT l_orderkey image, CASE l_linenumber % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 64 END stride, CAST(l_partkey % 400 AS BIGINT) cell, CAST(l_quantity / 45.0 AS DOUBLE) cls, CAST(l_discount * 12 - 0.05 AS DOUBLE) obj,
CAST(l_tax AS DOUBLE) b0, CAST(l_tax * 2 AS DOUBLE) b1, CAST(l_discount AS DOUBLE) b2, CAST(l_tax - 0.04 AS DOUBLE) b3, 320 padded_w, 256 padded_h FROM {lineitem}"""
QUERIES["k32_faces"] = lambda spark, sf_dir: DEC.faces(inputs(spark, sf_dir, _CELLS)).select("image", "stride", "cell", *[F.round(c, 5).alias(c) for c in ("score", "x", "y", "w", "h")])
ORACLES["k32_faces"] = f"""SELECT image, stride, cell, round(score, 5) score, round((cell % c + b0) * stride - w / 2, 5) x, round((cell // c + b1) * stride - h / 2, 5) y, round(w, 5) w, round(h, 5) h
FROM (SELECT *, 320 // stride c, sqrt(least(greatest(cls, 0), 1) * least(greatest(obj, 0), 1)) score, exp(b2) * stride w, exp(b3) * stride h FROM ({oracle(_CELLS)}) WHERE stride IN (8, 16, 32)) WHERE cell < c * (256 // stride) AND score >= 0.55"""
_UI = """SELECT l_orderkey image, CAST(l_linenumber AS BIGINT) ord, CAST(l_partkey % 600 AS DOUBLE) x, CAST(l_suppkey % 600 AS DOUBLE) y, CAST(l_quantity AS DOUBLE) w, CAST(l_quantity + 3 AS DOUBLE) h, CAST(l_discount * 10 AS DOUBLE) conf,
CAST(l_partkey % 7 + l_tax AS DOUBLE) class, CAST(1280 AS DOUBLE) image_w, CAST(960 AS DOUBLE) image_h, CAST(0.5 AS DOUBLE) scale_x, CAST(0.75 AS DOUBLE) scale_y FROM {lineitem}"""
QUERIES["k34_ui_elements"] = lambda spark, sf_dir: DEC.ui_elements(inputs(spark, sf_dir, _UI))
ORACLES["k34_ui_elements"] = f"""SELECT image, ord, CASE image_class WHEN 0 THEN 'button' WHEN 1 THEN 'input' WHEN 2 THEN 'icon' WHEN 3 THEN 'text_node' WHEN 4 THEN 'image' ELSE 'ui_element' END AS label, conf confidence,
CAST(floor(x / 640 * 1280 * 0.5 + 0.5) AS BIGINT) x, CAST(floor(y / 640 * 960 * 0.75 + 0.5) AS BIGINT) y, CAST(floor(w / 640 * 1280 * 0.5 + 0.5) AS BIGINT) w, CAST(floor(h / 640 * 960 * 0.75 + 0.5) AS BIGINT) h
FROM (SELECT *, CAST(floor(class + 0.5) AS INTEGER) image_class FROM ({oracle(_UI)})) WHERE conf > 0.5"""

# -- regions ----------------------------------------------------------------------------------------------

_DRAWN = [
    ({"tag": "CANVAS"}, ("canvas", False)), ({"tag": "path", "role": "button"}, ("svg", True)), ({"tag": "svg"}, ("svg", False)), ({"tag": "img", "onclick": "go()"}, ("img", True)), ({"tag": "video"}, ("video", False)),
    ({"tag": "iframe", "shadow": True}, ("iframe", False)), ({"tag": "div", "shadow": True, "cursor": "pointer"}, ("shadow_open", True)), ({"tag": "div", "shadow": False, "onclick": ""}, ("html", False)),
]
QUERIES["k09_rendering"] = lambda spark, sf_dir: golden(spark, sf_dir, [d for d, _ in _DRAWN]).select("k", P.rendering(F.col("tag"), F.col("shadow")).alias("rendering"), P.handler_hint(F.col("cursor"), F.col("onclick"), F.col("role")).alias("hint"))
ORACLES["k09_rendering"] = expected(["rendering", "hint"], [e for _, e in _DRAWN], {"hint": "BOOLEAN"})
_SEEN = """SELECT l_orderkey k, l_linenumber n, CAST(l_partkey % 1500 - 100 AS DOUBLE) x, CAST(l_suppkey % 900 - 50 AS DOUBLE) y, CAST(l_quantity % 5 AS DOUBLE) w, CAST(l_quantity AS DOUBLE) h,
CASE l_partkey % 9 WHEN 0 THEN 'none' WHEN 1 THEN NULL ELSE 'block' END display, CASE l_suppkey % 8 WHEN 0 THEN 'hidden' WHEN 1 THEN 'collapse' WHEN 2 THEN NULL ELSE 'visible' END visibility, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_discount AS DOUBLE) END opacity FROM {lineitem}"""


def _seen(spark, sf_dir):
    b = G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return inputs(spark, sf_dir, _SEEN).select("k", "n", P.visible(b, F.col("display"), F.col("visibility"), F.col("opacity")).alias("visible"), P.in_viewport(b, F.lit(1280.0), F.lit(800.0)).alias("inside"))


QUERIES["k10_visibility"] = _seen
ORACLES["k10_visibility"] = f"""SELECT k, n, w <> 0 AND h <> 0 AND coalesce(display, '') <> 'none' AND coalesce(visibility, '') NOT IN ('hidden', 'collapse') AND coalesce(opacity, 1) >= 0.05 visible,
y + h >= 0 AND x + w >= 0 AND y <= 800 AND x <= 1280 inside FROM ({oracle(_SEEN)})"""
_SAID = [
    ({"name": "Mail", "value": "a@b.co"}, ("DOM,ARIA", "visible,enabled", "Mail: a@b.co")), ({"name": "same", "value": "same", "hidden": True}, ("DOM,ARIA", "enabled", "same")),
    ({"name": "Pass", "value": "secret", "password": True, "disabled": True}, ("DOM,ARIA", "visible,disabled", "Pass")), ({"text": "words", "expanded": False, "checked": True}, ("DOM", "visible,enabled,collapsed,checked", "words")),
    ({"placeholder": "type here", "selected": True, "expanded": True, "checked": False}, ("DOM", "visible,enabled,selected,expanded,unchecked", "type here")), ({"attribute": "tip"}, ("DOM", "visible,enabled", "tip")),
    ({"role": "button", "text": "Go", "attribute": "tip"}, ("DOM,ARIA", "visible,enabled", "Go tip")), ({"value": "  "}, ("DOM", "visible,enabled", None)),
]


def _said(spark, sf_dir):
    own = golden(spark, sf_dir, [{"hidden": False, **s} for s, _ in _SAID])
    text = P.region_text({**{c: F.col(c) for c in ("name", "text", "placeholder", "value")}, "is_password": F.col("password"), "attributes": F.array("attribute", F.lit(""))})
    states = P.region_states(~F.col("hidden"), F.col("disabled"), F.col("selected"), F.col("expanded"), F.col("checked"))
    return own.select("k", F.array_join(P.region_sources(F.col("role"), F.col("name")), ",").alias("sources"), F.array_join(states, ",").alias("states"), text.alias("text"))


QUERIES["k01_regions"] = _said
ORACLES["k01_regions"] = expected(["sources", "states", "text"], [e for _, e in _SAID])
_BLOCKS = """SELECT o_orderkey k, CASE WHEN o_orderkey % 11 = 0 THEN 'https://external-site.com' WHEN o_orderkey % 11 = 1 THEN NULL ELSE 'http://a' END origin, o_orderkey % 3 <> 0 capture FROM {orders}"""
_LEVELS = "SELECT l_orderkey k, l_linenumber n, CASE WHEN l_partkey % 5 = 0 THEN 'LOW' WHEN l_partkey % 5 = 1 THEN 'MEDIUM' ELSE 'HIGH' END route FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) l_partkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"


def _blocked(spark, sf_dir):
    routes = inputs(spark, sf_dir, _LEVELS).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("r"), "n").alias("region_id"), "route"))).alias("routes"))
    own = inputs(spark, sf_dir, _BLOCKS).join(routes, "k", "left")
    kind = "array<struct<n:bigint,region_id:string,route:string>>"
    return own.select("k", P.block_reason(F.col("origin"), F.col("capture"), F.coalesce(F.col("routes").cast(kind), F.array().cast(kind))).alias("b")).select("k", "b.verdict", "b.check", "b.region")


QUERIES["k23_block_rules"] = _blocked
ORACLES["k23_block_rules"] = f"""SELECT k, CASE WHEN o OR r IS NOT NULL THEN 'BLOCK' ELSE 'ALLOW' END verdict, CASE WHEN o THEN 'stub_env_restricted' WHEN r IS NOT NULL THEN 'vision_failure' END AS "check", CASE WHEN NOT o THEN r END region
FROM (SELECT b.k, coalesce(b.origin, '') = 'https://external-site.com' o, 'r' || CASE WHEN NOT capture THEN l.n END r FROM ({oracle(_BLOCKS)}) b LEFT JOIN (SELECT k, min(n) n FROM ({oracle(_LEVELS)}) WHERE route <> 'HIGH' GROUP BY k) l USING (k))"""
