"""Queries over action verdicts, form fields, document fields and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as K
from ..operators import documents as DOC
from ..operators import firewall as L
from ..streaming import events as M
from .derived import BOXES, inputs, oracle

QUERIES, ORACLES = {}, {}
_ACTIONS = """SELECT event_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'scroll' WHEN 'purchase' THEN 'fill_secret' ELSE 'type' END action, user_id % 9 <> 0 frame_ok, user_id % 7 <> 0 hash_ok, user_id % 5 <> 0 visible,
event_id % 11 <> 0 target, event_id % 13 <> 0 origin_ok, event_id % 17 <> 0 steps_ok, event_id % 6 = 0 is_password, event_id % 4 = 0 unsafe, event_id % 3 = 0 capable FROM {events}"""


def verdicts(spark, sf_dir):
    e = inputs(spark, sf_dir, _ACTIONS)
    c = F.col
    a = {
        "action": c("action"), "action_id": c("event_id").cast("string"), "origin": F.lit("https://a.example"), "region_id": F.lit("r1"), "allowed_actions": F.array(*[F.lit(x) for x in ("click", "scroll", "type", "fill_secret")]),
        "step_index": F.when(c("steps_ok"), 1).otherwise(9), "max_steps": F.lit(5), "is_password": c("is_password"), "injection": F.lit(False), "live_origin": F.when(c("origin_ok"), "https://a.example").otherwise("https://b.example"),
        "allowed_origins": F.array(F.lit("https://a.example")), "frame_id": F.lit("f"), "live_frame_id": F.when(c("frame_ok"), "f").otherwise("g"), "region_frame_id": F.lit(None).cast("string"), "recent_hashes": F.array(F.lit("h")),
        "page_state_hash": F.when(c("hash_ok"), "h").otherwise("x"), "exists": c("target"), "visible": c("visible"), "occluded": F.lit(False), "interactable": F.lit(True), "drift": F.lit(0.0), "capability": F.when(c("capable"), "cap"),
        "capability_origins": F.array(F.lit("https://a.example")), "text": F.when(c("unsafe"), "write to a.b@c.org").otherwise("hello"), "attestation": F.lit(None).cast("string"),
    }
    v = L.verdict(L.action_chain(a))
    return e.select("event_id", v["ok"].alias("ok"), v["step"].alias("step"), v["code"].alias("code"), v["passed"].alias("passed"))


_T = "action IN ('click', 'type', 'fill_secret')"
_STEPS = [("policy", "POLICY_DENIED", "steps_ok AND NOT (is_password AND action = 'type')", 1), ("origin", "ORIGIN_MISMATCH", "origin_ok", 2), ("frame", "FRAME_MISMATCH", "frame_ok", 3), ("state", "STALE_STATE", "hash_ok", 4), ("target", "TARGET_NOT_FOUND", f"target OR NOT {_T}", 5), ("interactable", "NOT_INTERACTABLE", f"visible OR NOT {_T}", 6), ("capability", "CAPABILITY_DENIED", "action <> 'fill_secret' OR capable", 7), ("text", "TEXT_UNSAFE", "NOT unsafe", 8)]


def _ladder(at: int, last: str) -> str:
    return "CASE " + " ".join(f"WHEN NOT ({s[2]}) THEN " + (f"'{s[at]}'" if at < 3 else str(s[at])) for s in _STEPS) + f" ELSE {last} END"


QUERIES["q27_verdict_chain"] = verdicts
ORACLES["q27_verdict_chain"] = f"SELECT event_id, {_ladder(0, 'NULL')} IS NULL ok, {_ladder(0, 'NULL')} step, {_ladder(1, 'NULL')} code, CAST({_ladder(3, '10')} AS INTEGER) passed FROM ({oracle(_ACTIONS)})"


def observations(spark, sf_dir):
    e = inputs(spark, sf_dir, _ACTIONS).withColumn("age", (F.col("event_id") * 37) % 20000)
    c, none = F.col, F.lit(None).cast("string")
    a = {
        "action": c("action"), "observation_id": F.lit("o"), "is_stale": ~c("hash_ok"), "request_observation_id": F.when(c("frame_ok"), "o").otherwise("p"), "now": c("age"), "seen_at": F.lit(0), "request_hash": none, "page_hash": none,
        "region_id": F.when(c("target"), "r").otherwise(" "), "exists": c("origin_ok"), "visible": c("visible"), "interactable": F.lit(True), "w": F.lit(5.0), "h": F.lit(5.0), "capability": F.when(c("capable"), "cap"), "is_password": c("is_password"),
    }
    return e.select("event_id", L.verdict(L.observation_chain(a))["code"].alias("code"))


QUERIES["l13_observation_chain"] = observations
ORACLES["l13_observation_chain"] = f"""SELECT event_id, CASE WHEN NOT hash_ok OR NOT frame_ok OR (event_id * 37) % 20000 > 15000 THEN 'STALE_OBSERVATION' WHEN {_T} AND NOT target THEN 'MISSING_TARGET' WHEN {_T} AND NOT origin_ok THEN 'TARGET_NOT_FOUND'
WHEN {_T} AND NOT visible THEN 'NOT_INTERACTABLE' WHEN action = 'fill_secret' AND NOT capable THEN 'CAPABILITY_DENIED' WHEN action = 'fill_secret' AND NOT is_password THEN 'POLICY_DENIED' END code FROM ({oracle(_ACTIONS)})"""
_USES = "SELECT event_id use_id, event_id % 400 ticket_id, event_id * 10 at_ms FROM {events}"


def executions(spark, sf_dir):
    u, secret = inputs(spark, sf_dir, _USES), F.lit("s")
    t = L.issue(F.col("ticket_id").cast("string"), F.lit("o"), F.lit(0).cast("bigint"), secret)
    forged = F.struct(t["payload"].alias("payload"), F.when(F.col("ticket_id") % 10 == 0, "bad").otherwise(t["signature"]).alias("signature"), t["expires_at"].alias("expires_at"))
    return L.execution(u.withColumn("ticket", forged).withColumn("now", F.col("at_ms")), secret).select("use_id", F.col("result.ok").alias("ok"), F.col("result.code").alias("code"))


QUERIES["q28_replay"] = executions
ORACLES["q28_replay"] = f"SELECT use_id, code IS NULL ok, code FROM (SELECT use_id, CASE WHEN ticket_id % 10 = 0 THEN 'TICKET_FORGED' WHEN at_ms > 10000 THEN 'TICKET_EXPIRED' WHEN row_number() OVER (PARTITION BY ticket_id ORDER BY at_ms, use_id) > 1 THEN 'TICKET_REPLAYED' END code FROM ({oracle(_USES)}))"
QUERIES["l16_direct_execution"] = lambda spark, sf_dir: inputs(spark, sf_dir, _ACTIONS).select("event_id", L.direct_execution()["ok"].alias("ok"), L.direct_execution()["code"].alias("code"))
ORACLES["l16_direct_execution"] = "SELECT event_id, false ok, 'UNVALIDATED_EXECUTION_ATTEMPT' code FROM events"
QUERIES["n03_executed"] = lambda spark, sf_dir: L.executed(verdicts(spark, sf_dir).withColumn("result", F.struct("ok")), lambda ok: ok.select("event_id", F.lit("done").alias("state")))
ORACLES["n03_executed"] = f"SELECT event_id, 'done' state FROM ({ORACLES['q27_verdict_chain']}) WHERE ok"
QUERIES["q29_ttl"] = lambda spark, sf_dir: inputs(spark, sf_dir, _USES).select("use_id", (F.col("at_ms") - F.col("ticket_id") * 10 <= L.OBSERVATION_TTL_MS).alias("fresh"))
ORACLES["q29_ttl"] = f"SELECT use_id, at_ms - ticket_id * 10 <= 15000 fresh FROM ({oracle(_USES)})"
_TOOLS = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'erase' WHEN 2 THEN NULL WHEN 3 THEN 'get_observation' ELSE 'observe' END tool, CASE event_id % 4 WHEN 0 THEN chr(123) || '\"screenshot\":1' || chr(125) WHEN 1 THEN 'x' ELSE chr(123) || '\"observation_id\":\"o\",\"target_id\":\"t\"' || chr(125) END args FROM {events}"
QUERIES["l20_tool_calls"] = lambda spark, sf_dir: inputs(spark, sf_dir, _TOOLS).select("event_id", K.tool_code(F.col("tool"), F.col("args")).alias("code"))
ORACLES["l20_tool_calls"] = f"SELECT event_id, CAST(CASE WHEN tool IS NULL THEN -32600 WHEN tool IN ('erase', 'observe') THEN -32601 WHEN event_id % 4 < 2 OR tool = 'get_observation' THEN -32602 ELSE 0 END AS INTEGER) code FROM ({oracle(_TOOLS)})"
_TASKS = "SELECT user_id % 50 task, event_id step, event_id % 3 <> 0 AND user_id % 4 <> 0 ok, event_id % 97 = 0 done FROM {events}"
QUERIES["l18_task_states"] = lambda spark, sf_dir: L.task_states(inputs(spark, sf_dir, _TASKS))
ORACLES["l18_task_states"] = f"""WITH a AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY step) g, row_number() OVER (PARTITION BY task ORDER BY step) n FROM ({oracle(_TASKS)})),
b AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY task, g ORDER BY step) bad FROM a), s AS (SELECT *, CASE WHEN bad >= 3 THEN 'FAILED' WHEN done THEN 'DONE' WHEN n >= 20 THEN 'FAILED' ELSE 'RUNNING' END state FROM b)
SELECT task, step, state FROM s WHERE n <= (SELECT coalesce(min(n), 1000000000) FROM s t WHERE t.task = s.task AND t.state <> 'RUNNING')"""

_TOKENS = "SELECT l_orderkey doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS BIGINT) ord, CAST(l_suppkey % 40 AS DOUBLE) y, CAST(l_partkey % 500 AS DOUBLE) x, CAST(30 AS DOUBLE) w, CAST(10 AS DOUBLE) h, CASE l_linenumber WHEN 1 THEN 'PAN:' WHEN 2 THEN 'ABCPE1234F' WHEN 3 THEN 'Name' ELSE 'T' || CAST(l_linenumber AS STRING) END word FROM {lineitem}"
_LINES = f"SELECT *, sum(s) OVER (PARTITION BY doc ORDER BY y, x, ord) line FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc ORDER BY y, x, ord) > 10 THEN 1 ELSE 0 END s FROM ({oracle(_TOKENS)}))"
QUERIES["q23_line_grouping"] = lambda spark, sf_dir: DOC.lines(inputs(spark, sf_dir, _TOKENS)).select("doc", "ord", F.col("line").cast("bigint").alias("line"))
ORACLES["q23_line_grouping"] = f"SELECT doc, ord, CAST(line AS BIGINT) line FROM ({_LINES})"
_text = lambda spark, sf_dir: DOC.line_texts(DOC.lines(inputs(spark, sf_dir, _TOKENS)))
QUERIES["q24_line_lookahead"] = lambda spark, sf_dir: DOC.look_ahead(_text(spark, sf_dir)).select("doc", F.col("line").cast("bigint").alias("line"), "text", "next1", "next2")
_TEXTS = f"SELECT doc, CAST(line AS BIGINT) line, string_agg(word, ' ' ORDER BY x, ord) AS text, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h FROM ({_LINES}) GROUP BY doc, line"
ORACLES["q24_line_lookahead"] = f"SELECT doc, line, text, lead(text, 1) OVER (PARTITION BY doc ORDER BY line) next1, lead(text, 2) OVER (PARTITION BY doc ORDER BY line) next2 FROM ({_TEXTS})"
QUERIES["f04_line_boxes"] = lambda spark, sf_dir: _text(spark, sf_dir).select("doc", F.col("line").cast("bigint").alias("line"), "x", "y", "w", "h")
ORACLES["f04_line_boxes"] = f"SELECT doc, line, x, y, w, h FROM ({_TEXTS})"
QUERIES["f03_document_kinds"] = lambda spark, sf_dir: DOC.texts(_text(spark, sf_dir)).select("doc", "text", DOC.kind(F.col("text"), F.col("n_lines")).alias("kind"))
ORACLES["f03_document_kinds"] = f"SELECT doc, string_agg(text, chr(10) ORDER BY line) AS text, CASE WHEN regexp_matches(string_agg(lower(text), ' ' ORDER BY line), '(^|[^a-z0-9_])[a-z]{{5}}[ -]?[0-9oil]{{4}}[ -]?[a-z]($|[^a-z0-9_])') THEN 'ID_CARD' ELSE 'UNKNOWN' END kind FROM ({_TEXTS}) GROUP BY doc"
QUERIES["f05_document_fields"] = lambda spark, sf_dir: DOC.fields(_text(spark, sf_dir))
QUERIES["f13_mean_confidence"] = lambda spark, sf_dir: DOC.confidences(_text(spark, sf_dir)).select("doc", F.round("confidence", 4).alias("confidence"), "fields")

_EV = "SELECT event_id, user_id key, ts, value y FROM {events}"
QUERIES["q31_mutation_sessions"] = lambda spark, sf_dir: M.sessions(inputs(spark, sf_dir, _EV), "6 hours")
ORACLES["q31_mutation_sessions"] = """SELECT key, min(ts) opened, count(*) events FROM (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY ts) g FROM (SELECT user_id key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOURS THEN 1 ELSE 0 END s FROM events)) GROUP BY key, g"""
QUERIES["m01_debounce"] = lambda spark, sf_dir: M.debounce(inputs(spark, sf_dir, _EV), 6 * 3600 * 1000)
ORACLES["m01_debounce"] = """WITH RECURSIVE e AS (SELECT user_id key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events),
w AS (SELECT key, n, ts opened, ts FROM e WHERE n = 1 UNION ALL SELECT e.key, e.n, CASE WHEN e.ts - w.opened >= INTERVAL 6 HOURS THEN e.ts ELSE w.opened END, e.ts FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
SELECT key, opened, count(*) events, max(ts) AS last FROM w GROUP BY key, opened"""
QUERIES["q32_scroll_delta"] = lambda spark, sf_dir: M.scroll_steps(inputs(spark, sf_dir, _EV))
ORACLES["q32_scroll_delta"] = """WITH RECURSIVE e AS (SELECT user_id key, event_id, value y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events),
w AS (SELECT key, event_id, y, n, y AS last, true ok FROM e WHERE n = 1 UNION ALL SELECT e.key, e.event_id, e.y, e.n, CASE WHEN abs(e.y - w.last) >= 32 THEN e.y ELSE w.last END, abs(e.y - w.last) >= 32 FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
SELECT key, event_id, y FROM w WHERE ok"""
#: A user's events in steps of 50 ms, so that scrolls follow each other within the quiet time.
_SCROLLS = "SELECT event_id, user_id key, timestamp_millis(event_id * 50) ts, value y FROM {events}"
QUERIES["m02_scroll_stops"] = lambda spark, sf_dir: M.scroll_stops(inputs(spark, sf_dir, _SCROLLS), quiet_ms=5000).select("key", "event_id", "y", F.unix_millis("sent_at").alias("sent_ms"))
ORACLES["m02_scroll_stops"] = """WITH RECURSIVE e AS (SELECT user_id key, event_id, value y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) n FROM events),
w AS (SELECT key, event_id, y, n, y AS last, true ok FROM e WHERE n = 1 UNION ALL SELECT e.key, e.event_id, e.y, e.n, CASE WHEN abs(e.y - w.last) >= 32 THEN e.y ELSE w.last END, abs(e.y - w.last) >= 32 FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
SELECT key, event_id, y, event_id * 50 + 5000 sent_ms FROM (SELECT *, lead(event_id) OVER (PARTITION BY key ORDER BY event_id) nxt FROM w WHERE ok) WHERE nxt IS NULL OR nxt * 50 >= event_id * 50 + 5000"""
QUERIES["m07_replays"] = lambda spark, sf_dir: M.replays(inputs(spark, sf_dir, _EV), "key", ("ts", "event_id")).select("event_id", "replayed")
ORACLES["m07_replays"] = "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 replayed FROM events"
QUERIES["m09_rate_limit"] = lambda spark, sf_dir: M.sparse(inputs(spark, sf_dir, _EV), 6 * 3600 * 1000)
ORACLES["m09_rate_limit"] = f"SELECT key, opened ts FROM ({ORACLES['m01_debounce']})"
_TRACK = "SELECT CAST(floor(l_orderkey / 8) AS BIGINT) tab, CAST(l_linenumber AS BIGINT) frame, CAST(row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 8) AS BIGINT), l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS BIGINT) ord, CAST(l_partkey % 24 AS DOUBLE) x, CAST(l_suppkey % 16 AS DOUBLE) y, CAST(60 AS DOUBLE) w, CAST(50 AS DOUBLE) h FROM {lineitem}"
QUERIES["m06_tracker"] = lambda spark, sf_dir: M.track(inputs(spark, sf_dir, _TRACK))
