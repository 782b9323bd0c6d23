"""Strict contracts of JSON requests, read as variants: the first thing that is wrong names the code.

Nothing here parses in Python: each property is looked up in the parsed variant with its JSON type, so that a
number isn't taken for a string, and unknown properties are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import validators as V
from .detectors import bind

#: Fixed: actions that a request may ask for, those that need a target, and scroll directions.
ACTIONS, TARGETED = ("click", "type", "scroll", "keypress", "focus", "select", "fill_secret"), ("click", "type", "focus", "select", "fill_secret")
DIRECTIONS = ("up", "down", "left", "right")
#: Fixed: tools and their properties; a mark ! is required.
TOOLS: dict[str, tuple[str, ...]] = {
    "get_observation": ("observation_id",),
    "click": ("observation_id!", "target_id!", "request_id"),
    "type": ("observation_id!", "target_id!", "text!", "request_id"),
    "scroll": ("observation_id!", "direction", "amount", "request_id"),
    "keypress": ("observation_id!", "key!", "request_id"),
}


class _Json:
    """A JSON object: kinds and values of its properties.  ``raw`` is its text, ``v`` its variant."""

    def __init__(self, raw: Column, v: Column, path: str = "$"):
        self.raw, self.v, self.path = raw, v, path

    def kind(self, name: str | None = None) -> Column:
        """string, number, boolean, array, object or null; missing is a null Column."""
        at = F.schema_of_variant(F.try_variant_get(self.v, f"{self.path}.{name}" if name else self.path, "variant"))
        out = F.when(at == "STRING", "string").when(at == "VOID", "null").when(at == "BOOLEAN", "boolean")
        return out.when(at.startswith("ARRAY"), "array").when(at.startswith("OBJECT"), "object").when(at.isNotNull(), "number")

    def text(self, name: str) -> Column:
        return F.when(self.kind(name) == "string", F.try_variant_get(self.v, f"{self.path}.{name}", "string"))

    def number(self, name: str) -> Column:
        return F.when(self.kind(name) == "number", F.try_variant_get(self.v, f"{self.path}.{name}", "double"))

    def is_object(self) -> Column:
        return F.coalesce(self.kind() == "object", F.lit(False))

    def only(self, names: Sequence[str]) -> Column:
        own = F.json_object_keys(self.raw if self.path == "$" else F.get_json_object(self.raw, self.path))
        return F.coalesce(F.forall(own, lambda k: k.isin(*names)), F.lit(True))

    def optional(self, name: str, test: Column) -> Column:
        """Missing, or ``test`` holds."""
        return self.kind(name).isNull() | F.coalesce(test, F.lit(False))

    def some_text(self, name: str) -> Column:
        return F.coalesce(self.text(name) != "", F.lit(False))


def _params_ok(p: _Json) -> Column:
    """All of a parameter object but the injection test."""
    amount = p.number("amount")
    return (
        p.optional("text", p.kind("text") == "string") & p.optional("key", F.length(p.text("key")).between(1, 50)) & p.optional("direction", p.text("direction").isin(*DIRECTIONS))
        & p.optional("amount", amount.between(1, 10_000) & (amount == F.floor(amount))) & p.optional("option", p.kind("option") == "string")
        & p.only(("text", "key", "direction", "amount", "option"))
    )


def request_code(raw: Column) -> Column:
    """OK, or the code of the first breach of an action request's contract, in the order of its properties."""

    def code(v: Column) -> Column:
        top, action, params = (_Json(raw, v, path) for path in ("$", "$.action", "$.action.params"))
        kind, target = action.text("type"), action.kind("target_id")
        params_kind = action.kind("params")
        given = F.coalesce(params_kind == "object", F.lit(False))
        return (
            F.when(~top.is_object() | ~top.some_text("request_id"), "MALFORMED_REQUEST").when(~top.some_text("observation_id"), "INVALID_OBSERVATION")
            .when(~action.is_object(), "MALFORMED_REQUEST").when(action.kind("type").isNull(), "MISSING_ACTION_TYPE").when(kind.isNull(), "MALFORMED_REQUEST")
            .when(~kind.isin(*ACTIONS), "UNSUPPORTED_ACTION").when(target.isNotNull() & ~action.some_text("target_id"), "MISSING_TARGET")
            .when(params_kind.isNotNull() & ~given & (params_kind != "null"), "MALFORMED_REQUEST").when(given & V.injected(params.text("text")), "SCRIPT_INJECTION_REJECTED")
            .when(given & ~_params_ok(params), "MALFORMED_REQUEST").when(~action.only(("type", "target_id", "params")), "MALFORMED_REQUEST")
            .when(kind.isin(*TARGETED) & target.isNull(), "MISSING_TARGET")
            .when((kind == "type") & params.text("text").isNull(), "MALFORMED_REQUEST").when((kind == "keypress") & params.text("key").isNull(), "MALFORMED_REQUEST")
            .when(~top.optional("page_state_hash", top.kind("page_state_hash") == "string"), "MALFORMED_REQUEST")
            .when(~top.optional("capability", top.kind("capability").isin("string", "null")), "MALFORMED_REQUEST")
            .when(~top.only(("request_id", "observation_id", "action", "page_state_hash", "capability")), "MALFORMED_REQUEST").otherwise("OK")
        )

    return bind(F.try_parse_json(raw), code)


#: Fixed: argument names that would carry raw page data.
RAW = ("screenshot", "raw_dom", "raw_pixels")


def tool_code(tool: Column, arguments: Column) -> Column:
    """JSON-RPC code of a tool call, 0 where it's fine: no method, unknown method, or arguments against its schema."""

    def code(v: Column) -> Column:
        a = _Json(arguments, v)
        text, amount = a.text("text"), a.number("amount")
        test = {
            "text": (a.kind("text") == "string") & ~V.injected(text), "key": F.length(a.text("key")).between(1, 50), "direction": a.text("direction").isin(*DIRECTIONS),
            "amount": amount.between(1, 10_000) & (amount == F.floor(amount)), "request_id": a.kind("request_id") == "string",
        }
        fits = F.lit(False)
        for name, properties in TOOLS.items():
            ok = a.is_object() & a.only([p.rstrip("!") for p in properties])
            for p in properties:
                own, must = p.rstrip("!"), p.endswith("!")
                holds = test.get(own, a.some_text(own) if must else a.kind(own) == "string")
                ok = ok & (F.coalesce(holds, F.lit(False)) if must else a.optional(own, holds))
            fits = F.when(tool == name, ok).otherwise(fits)
        return F.when(tool.isNull(), -32600).when(~tool.isin(*TOOLS), -32601).when(~fits, -32602).otherwise(0)

    return bind(F.try_parse_json(arguments), code)


def rpc_code(raw: Column) -> Column:
    """JSON-RPC code of a request as text, 0 where it's fine: tools are listed, or called by name with their arguments."""

    def code(v: Column) -> Column:
        a = _Json(raw, v)
        method = a.text("method")
        name = F.nullif(F.get_json_object(raw, "$.params.name"), F.lit(""))
        call = F.when(name.isNull(), -32602).otherwise(tool_code(name, F.coalesce(F.get_json_object(raw, "$.params.arguments"), F.lit("{}"))))
        known = F.when(method == "tools/list", 0).when(method == "tools/call", call).otherwise(-32601)
        return F.when(~a.is_object() | (F.coalesce(a.text("jsonrpc"), F.lit("")) != "2.0") | (F.coalesce(method, F.lit("")) == ""), -32600).otherwise(known)

    return F.coalesce(bind(F.try_parse_json(raw), code), F.lit(-32600))


#: Fixed: what an agent's action may be; the first three aim at a region.
AGENT_TARGETED, AGENT_PLAIN = ("click", "type", "select"), ("wait", "read", "find", "back", "forward", "complete", "fail")


def agent_reason(a: dict[str, Column]) -> Column:
    """Null for a valid agent action, else why it isn't.  ``a``: type, target, exists, text, direction, url."""
    some = lambda c: F.coalesce(c != "", F.lit(False))
    kind = a["type"]
    aimed = kind.isin(*AGENT_TARGETED)
    quoted = lambda before, c, after: F.concat(F.lit(before), c, F.lit(after))
    return (
        F.when(~some(kind), "Action is missing a valid type.").when(aimed & ~some(a["target"]), quoted("Action '", kind, "' requires a target_region_id."))
        .when(aimed & ~F.coalesce(a["exists"], F.lit(False)), quoted("Target region_id '", a["target"], "' not found in observation."))
        .when((kind == "type") & ~some(a["text"]), "Action 'type' requires params.text.")
        .when((kind == "scroll") & ~some(a["direction"]), "Action 'scroll' requires params.direction.")
        .when((kind == "scroll") & ~a["direction"].isin(*DIRECTIONS), quoted("Invalid scroll direction: ", a["direction"], "."))
        .when((kind == "navigate") & ~some(a["url"]), "Action 'navigate' requires params.url.")
        .when(~kind.isin(*AGENT_TARGETED, *AGENT_PLAIN, "scroll", "navigate"), quoted("Unsupported action type: ", kind, ""))
    )


def decoded_body(raw: Column, api_key: Column | None = None, secret: str = "") -> Column:
    """struct<status, detail, body, request_id> of a request's body: attested payloads are checked against their digest.

    A body with the strings ``body`` and a ``sha256`` is an attested payload; any other object is the context itself.
    """

    def made(v: Column) -> Column:
        top = _Json(raw, v)
        body = top.text("body")
        attested = body.isNotNull() & top.kind("sha256").isNotNull()
        inner = F.try_parse_json(body)
        refused = F.lit(False) if api_key is None else F.coalesce((api_key != "") & (api_key != secret), F.lit(False))
        detail = (
            F.when(refused, "Invalid API Key").when(v.isNull(), "Malformed JSON in request body")
            .when(attested & ~F.coalesce(F.sha2(body, 256) == top.text("sha256"), F.lit(False)), "Attestation violation: Digest mismatch. Body was altered in transit.")
            .when(attested & inner.isNull(), "Malformed context in attested body")
        )
        status = F.when(refused, 401).when(detail.isNotNull(), 400).otherwise(200)
        own = F.coalesce(top.text("request_id"), F.when(attested, F.try_variant_get(inner, "$.request_id", "string")))
        ok = detail.isNull()
        return F.struct(status.alias("status"), detail.alias("detail"), F.when(ok, F.when(attested, body).otherwise(raw)).alias("body"), F.when(ok, own).alias("request_id"))

    return bind(F.try_parse_json(raw), made)
