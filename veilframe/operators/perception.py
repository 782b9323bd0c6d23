"""Page elements as regions: how they are drawn, whether they can be seen, and what they say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def rendering(tag: Column, shadow: Column) -> Column:
    """How an element is drawn; ``shadow``: it has an open shadow root."""
    low = F.lower(tag)
    out = F.when(low == "canvas", "canvas").when(low.isin("svg", "path"), "svg")
    for name in ("img", "video", "iframe"):
        out = out.when(low == name, name)
    return out.when(_yes(shadow), "shadow_open").otherwise("html")


def background_image(style: Column) -> Column:
    return _yes((style != "") & (style != "none"))


def handler_hint(cursor: Column, onclick: Column, role: Column) -> Column:
    """Something suggests that a click does something."""
    return _yes(cursor == "pointer") | _yes(onclick != "") | _yes(role == "button")


def visible(box: Column, display: Column, visibility: Column, opacity: Column) -> Column:
    """Neither empty, nor hidden by style, nor all but transparent; missing styles hide nothing."""
    hidden = _yes(display == "none") | _yes(visibility.isin("hidden", "collapse")) | (F.coalesce(opacity, F.lit(1.0)) < 0.05)
    return _yes((box["w"] != 0) & (box["h"] != 0)) & ~hidden


def in_viewport(box: Column, view_w: Column, view_h: Column) -> Column:
    return (box["y"] + box["h"] >= 0) & (box["x"] + box["w"] >= 0) & (box["y"] <= view_h) & (box["x"] <= view_w)


def region_sources(role: Column, name: Column) -> Column:
    return F.when(_yes(role != "") | _yes(name != ""), F.array(F.lit("DOM"), F.lit("ARIA"))).otherwise(F.array(F.lit("DOM")))


def region_states(visible_: Column, disabled: Column, selected: Column, expanded: Column, checked: Column) -> Column:
    """The visual states in order; null flags say nothing, but an element that isn't disabled is enabled."""
    none = F.lit(None).cast("string")
    states = F.array(
        F.when(_yes(visible_), "visible"), F.when(_yes(disabled), "disabled").otherwise("enabled"), F.when(_yes(selected), "selected"),
        F.when(expanded, "expanded").when(~expanded, "collapsed").otherwise(none), F.when(checked, "checked").when(~checked, "unchecked").otherwise(none),
    )
    return F.filter(states, lambda s: s.isNotNull())


def region_text(e: dict[str, Column]) -> Column:
    """A region's searchable text: "name: value", else the value, else name, text or placeholder; then attribute values.

    ``e`` has name, text, placeholder, value, is_password and attributes, an array of values.  Passwords never show.
    """
    some = lambda c: F.nullif(c, F.lit(""))
    name, value = some(e["name"]), e["value"]
    shown = _yes(F.trim(value) != "") & ~_yes(e["is_password"])
    text = F.when(shown, F.when(name.isNotNull() & (name != value), F.concat(name, F.lit(": "), value)).otherwise(value)).otherwise(F.coalesce(name, some(e["text"]), some(e["placeholder"])))
    more = F.filter(F.coalesce(e["attributes"], F.array().cast("array<string>")), lambda v: _yes(v != ""))
    return F.when(F.size(more) == 0, text).otherwise(F.concat_ws(" ", some(text), F.array_join(more, " ")))


def block_reason(origin: Column, has_capture: Column, routes: Column, blocked: tuple[str, ...] = ("https://external-site.com",)) -> Column:
    """struct<verdict, check, region>: BLOCK for a blocked origin, or where a region needs the capture that is missing.

    ``routes``: array<struct<region_id, route>> in the page's order.
    """
    needs = F.filter(routes, lambda r: r["route"].isin("LOW", "MEDIUM"))
    barred = _yes(origin.isin(*blocked))
    failed = ~barred & ~_yes(has_capture) & (F.size(needs) > 0)
    check = F.when(barred, "stub_env_restricted").when(failed, "vision_failure")
    return F.struct(F.when(check.isNotNull(), "BLOCK").otherwise("ALLOW").alias("verdict"), check.alias("check"), F.when(failed, F.get(needs, F.lit(0))["region_id"]).alias("region"))
