"""Fail-closed validation of proposed actions: ordered checks, of which the first that fails decides.

Whatever is missing fails its check.  A chain is a list of (step, code, condition); conditions are Columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import validators as V
from . import redaction as R

#: Fixed values.
ACTIONS = ["click", "type", "fill_secret", "select", "scroll", "focus", "keypress", "navigate", "back"]
RISKY = ["pay", "transfer", "delete", "purchase", "confirm order", "checkout"]
TARGETED = ["click", "type", "fill_secret", "select", "focus"]
OBSERVATION_TTL_MS, TICKET_TTL_MS, DRIFT = 15_000, 10_000, 32.0

Check = tuple[str, str, Column]


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def verdict(checks: Sequence[Check]) -> Column:
    """struct<ok, step, code, passed>: the first check that fails, and how many held before it."""
    every = F.array(*[F.struct(sure(ok).alias("ok"), F.lit(step).alias("step"), F.lit(code).alias("code")) for step, code, ok in checks])
    bad = F.filter(every, lambda c: ~c["ok"])
    at = F.coalesce(F.nullif(F.array_position(F.transform(every, lambda c: c["ok"]), F.lit(False)), F.lit(0)) - 1, F.lit(len(checks)))
    first = F.get(bad, F.lit(0))
    return F.struct((F.size(bad) == 0).alias("ok"), first["step"].alias("step"), first["code"].alias("code"), at.cast("int").alias("passed"))


def origin_allowed(origin: Column, allowed: Column) -> Column:
    """Exact, any, or both of the local family."""
    local = lambda name: origin.contains(name) & F.exists(allowed, lambda o: o.contains(name))
    return F.array_contains(allowed, origin) | F.array_contains(allowed, F.lit("*")) | local("localhost") | local("127.0.0.1")


def action_chain(a: dict[str, Column]) -> list[Check]:
    """The ten steps.  ``a`` has the action's, the session's and the live target's columns."""
    target = a["action"].isin(TARGETED)
    schema = a["action"].isin(ACTIONS) & a["action_id"].isNotNull() & V.origin(a["origin"]) & (~target | a["region_id"].isNotNull())
    policy = (
        F.array_contains(a["allowed_actions"], a["action"]) & (a["step_index"] < a["max_steps"]) & ~(a["is_password"] & (a["action"] == "type"))
        & ~(a["injection"] & a["action"].isin("click", "type", "select", "fill_secret"))
    )
    origin = (a["origin"] == a["live_origin"]) & ((a["origin"] == "file://") | F.array_contains(a["allowed_origins"], a["origin"]))
    frame = (a["frame_id"] == a["live_frame_id"]) & (a["region_frame_id"].isNull() | (a["region_frame_id"] == a["frame_id"]))
    state = F.array_contains(a["recent_hashes"], a["page_state_hash"])
    ready = ~target | (a["visible"] & ~a["occluded"] & a["interactable"] & (F.coalesce(a["drift"], F.lit(0.0)) <= DRIFT))
    capability = (a["action"] != "fill_secret") | (a["capability"].isNotNull() & origin_allowed(a["origin"], a["capability_origins"]))
    text = a["text"].isNull() | (F.size(R.outbound_scan(a["text"])) == 0)
    return [
        ("schema", "SERVER_INVALID", schema), ("policy", "POLICY_DENIED", policy), ("origin", "ORIGIN_MISMATCH", origin), ("frame", "FRAME_MISMATCH", frame),
        ("state", "STALE_STATE", state), ("target", "TARGET_NOT_FOUND", ~target | a["exists"]), ("interactable", "NOT_INTERACTABLE", ready),
        ("capability", "CAPABILITY_DENIED", capability), ("text", "TEXT_UNSAFE", text), ("attestation", "SERVER_INVALID", F.coalesce(a["attestation"], F.lit("verified")) == "verified"),
    ]


def risky(text: Column) -> Column:
    """Words that ask for the user's confirmation."""
    return sure(F.lower(text).rlike("|".join(RISKY)))


def observation_chain(a: dict[str, Column], ttl_ms: int = OBSERVATION_TTL_MS) -> list[Check]:
    """An action against what it was planned on; ``now`` is a column."""
    target = a["action"].isin(TARGETED)
    return [
        ("contract", "INVALID_REQUEST", a["action"].isin(ACTIONS)), ("observation", "INVALID_OBSERVATION", a["observation_id"].isNotNull()), ("stale", "STALE_OBSERVATION", ~a["is_stale"]),
        ("same", "STALE_OBSERVATION", a["request_observation_id"] == a["observation_id"]), ("age", "STALE_OBSERVATION", a["now"] - a["seen_at"] <= ttl_ms),
        ("page", "PAGE_STATE_MISMATCH", a["request_hash"].isNull() | a["page_hash"].isNull() | (a["request_hash"] == a["page_hash"])),
        ("target_given", "MISSING_TARGET", ~target | (F.trim(a["region_id"]) != "")), ("target", "TARGET_NOT_FOUND", ~target | a["exists"]),
        ("interactable", "NOT_INTERACTABLE", ~target | (a["visible"] & a["interactable"] & (a["w"] > 0) & (a["h"] > 0))),
        ("capability", "CAPABILITY_DENIED", (a["action"] != "fill_secret") | (F.trim(a["capability"]) != "")),
        ("password", "POLICY_DENIED", (a["action"] != "fill_secret") | a["is_password"]),
    ]


def issue(request_id: Column, observation_id: Column, issued_at: Column, secret: Column) -> Column:
    """struct<payload, signature, expires_at>."""
    payload = F.concat_ws("|", request_id, observation_id, issued_at.cast("string"))
    return F.struct(payload.alias("payload"), R.signed_ticket(payload, secret).alias("signature"), (issued_at + TICKET_TTL_MS).alias("expires_at"))


def execution(tickets: DataFrame, secret: Column, ticket: str = "ticket", now: str = "now") -> DataFrame:
    """With ``result``: authentic, in time, and not used before (the earliest use of a ticket counts)."""
    t = F.col(ticket)
    use = F.row_number().over(W.partitionBy(t["payload"]).orderBy(now, "use_id"))
    out = tickets.withColumn("_use", use)
    checks = [("authentic", "TICKET_FORGED", R.signed_ticket(t["payload"], secret) == t["signature"]), ("expiry", "TICKET_EXPIRED", F.col(now) <= t["expires_at"]), ("replay", "TICKET_REPLAYED", F.col("_use") == 1)]
    return out.withColumn("result", verdict(checks)).drop("_use")


def task_states(steps: DataFrame, max_steps: int = 20, failures: int = 3) -> DataFrame:
    """task, step, state: RUNNING, DONE at the step that says so, FAILED at the third failure in a row or the last step.

    Runs of failures are islands between successes, so no fold over the rows is needed.
    """
    by = W.partitionBy("task").orderBy("step")
    run = F.sum(F.col("ok").cast("int")).over(by)
    own = steps.withColumn("_run", run)
    bad = F.sum((~F.col("ok")).cast("int")).over(W.partitionBy("task", "_run").orderBy("step"))
    own = own.withColumn("_bad", bad).withColumn("_n", F.row_number().over(by))
    state = F.when(F.col("_bad") >= failures, "FAILED").when(F.col("done"), "DONE").when(F.col("_n") >= max_steps, "FAILED").otherwise("RUNNING")
    own = own.withColumn("state", state)
    ended = F.coalesce(F.sum((F.col("state") != "RUNNING").cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("_ended", ended).where("_ended = 0").select("task", "step", "state")


def direct_execution() -> Column:
    """The verdict of an action that comes without a ticket: never executed, whatever it is."""
    return F.struct(F.lit(False).alias("ok"), F.lit("ticket").alias("step"), F.lit("UNVALIDATED_EXECUTION_ATTEMPT").alias("code"))


def executed(actions: DataFrame, executor: Callable[[DataFrame], DataFrame], result: str = "result") -> DataFrame:
    """``executor`` over the actions whose verdict holds, and over no other; what it returns is the caller's own."""
    return executor(actions.where(sure(F.col(result)["ok"])))
