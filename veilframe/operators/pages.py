"""Page elements: HTML scan, roles, names, confidence scores, routing levels, budgets, state hashes."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import patterns as P
from ..functions import validators as V
from . import detectors as D

#: Fixed values.
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ROUTE_HIGH, ROUTE_LOW, CROP_PADDING, IMAGE_AREA, SHOWN = 0.85, 0.45, 8, 1600, 300
FALLBACK_SHOWN, NEAR = 200, 150
FALLBACK_TAGS = {
    "input", "select", "textarea", "img", "picture", "svg", "figure", "button", "canvas", "label", "h1", "h2", "h3", "h4", "h5", "h6",
    "p", "blockquote", "th", "td", "li", "dt", "dd", "figcaption", "a",
}
FALLBACK_CLASSES = ("avatar", "profile", "user", "photo", "thumb")
FALLBACK = (
    "page_id long, ord int, dom_id string, tag string, name string, text string, role string, rendering string, interactable boolean, "
    "input_type string, autocomplete string, input_name string, placeholder string, is_password boolean, has_value boolean, value string"
)
ELEMENT = "page_id long, ord int, dom_id string, parent_dom_id string, tag string, text string, attributes map<string,string>, depth int"


class _Elements(HTMLParser):
    """Elements in document order with their own text; scripts and styles have none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.rows.append({"tag": tag, "attributes": {k: v or "" for k, v in attrs}, "parent": self.open[-1] if self.open else None, "text": [], "depth": len(self.open)})
        if tag not in VOID_TAGS:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[at]]["tag"] == tag:
                del self.open[at:]
                break

    def handle_data(self, data):
        if self.open and self.rows[self.open[-1]]["tag"] not in ("script", "style") and data.strip():
            self.rows[self.open[-1]]["text"].append(" ".join(data.split()))


def elements(html: str | None) -> list[tuple]:
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    return [(i, f"d{i}", None if r["parent"] is None else f"d{r['parent']}", r["tag"], " ".join(r["text"]), r["attributes"], r["depth"]) for i, r in enumerate(parser.rows)]


def scan(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """A row per element of each page, with its whole text; pages without elements give none, and nothing is made up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *e) for p, h in zip(batch["page_id"], batch["html"], strict=True) for e in elements(h)]
            yield pd.DataFrame(rows, columns=["page_id", "ord", "dom_id", "parent_dom_id", "tag", "text", "attributes", "depth"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).alias("html")).mapInPandas(run, ELEMENT)


def fallback_elements(html: str | None) -> list[tuple]:
    """Rows of ``FALLBACK`` but for the page: the elements of a fixed selection, numbered by themselves.

    Text is the element's with all it holds, a name is taken from the name, the label or else that text; the
    value of a password never leaves.
    """
    own = elements(html)
    texts: list[list[str]] = [[] for _ in own]
    parents = [-1 if e[2] is None else int(e[2][1:]) for e in own]
    labels = {e[5]["for"]: i for i, e in reversed(list(enumerate(own))) if e[3] == "label" and e[5].get("for")}
    wanted = [i for i, e in enumerate(own) if e[3] in FALLBACK_TAGS or e[5].get("role") == "img" or any(c in e[5].get("class", "") for c in FALLBACK_CLASSES) or "background-image" in e[5].get("style", "")]
    held = {*wanted, *labels.values()}
    for i, e in enumerate(own):
        at = i
        while e[4] and at >= 0:
            if at in held:
                texts[at].append(e[4])
            at = parents[at]
    whole = {i: " ".join(texts[i]) for i in held}
    rows = []
    for n, i in enumerate(wanted):
        tag, a = own[i][3], own[i][5]
        kind = (a.get("type") or "text").lower()
        up = i
        while up >= 0 and own[up][3] != "label":
            up = parents[up]
        label = whole.get(labels.get(a.get("id", ""), up), "") if tag in ("input", "select", "textarea", "button") else ""
        role_ = a.get("role") or {"input": "button" if kind in ("button", "submit") else "textbox", "button": "button", "img": "img", "a": "link" if "href" in a else None}.get(tag)
        given = tag == "input"
        rows.append((
            n, f"d{n + 1}", tag, a.get("name") or a.get("aria-label") or label or whole[i] or None, whole[i][:FALLBACK_SHOWN], role_, tag if tag in ("canvas", "img") else "html",
            tag in ("input", "button", "canvas", "a"), (a.get("type") or "text") if given else None, (a.get("autocomplete") or None) if given else None, (a.get("name") or None) if given else None,
            (a.get("placeholder") or None) if given else None, kind == "password" if given else None, bool(a.get("value")) if given else None, (a.get("value") or None) if given and kind != "password" else None,
        ))
    return rows


def fallback_scan(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """The second way to scan, for pages whose first scan gave nothing; pages without such elements give no rows."""
    names = [c.split()[0] for c in FALLBACK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *e) for p, h in zip(batch["page_id"], batch["html"], strict=True) for e in fallback_elements(h)]
            yield pd.DataFrame(rows, columns=names).astype({n: object for n in names[9:]})

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).alias("html")).mapInPandas(run, FALLBACK)


def eligible(url: Column) -> Column:
    """Pages of the web, not of the browser."""
    return F.coalesce(url.rlike(r"(?i)^(?:https?|file)://"), F.lit(False))


def inline_spans(elements_: DataFrame, keys: tuple[str, ...] = ("page_id", "dom_id")) -> DataFrame:
    """keys, kind, n, at, length: addresses, telephone numbers, and valid Aadhaar and PAN numbers inside texts.

    One pass over each text; equal values stand at their own places, n is the occurrence within a kind.  A page is
    parsed once, and rows come in no order.
    """
    strict = lambda v: F.upper(v).rlike(f"^[A-Z]{{3}}[{V.PAN_ENTITY_TYPES}][A-Z][0-9]{{4}}[A-Z]$")
    kinds = (("EMAIL", "EMAIL", None), ("AADHAAR", "AADHAAR", V.verhoeff), ("PAN", "PAN", strict), ("PHONE", "PHONE_IN_LOOSE", None))

    def spans_of(kind: str):
        return lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), x["at"].alias("at"), F.length(x["value"]).alias("length"))

    def every(text: Column) -> Column:
        parts = []
        for kind, key, valid in kinds:
            found = F.regexp_extract_all(text, F.lit(P.spark(key)), F.lit(0))
            found = D.placed(found if valid is None else F.filter(found, valid), text)
            parts.append(F.transform(found, spans_of(kind)))
        return F.concat(*parts)

    spans = F.when(F.col("text").rlike("[0-9@]"), D.bind(F.col("text"), every))
    return elements_.select(*keys, F.explode(spans).alias("s")).select(*keys, "s.*")


def shown(text: Column) -> Column:
    """The text as it's displayed, cut to 300 characters."""
    return F.substring(text, 1, SHOWN)


def masked_text(text: Column) -> Column:
    """The text with inline identifiers replaced by their kind, cut to 300 characters."""
    for kind, key in (("EMAIL", "EMAIL"), ("PAN", "PAN"), ("AADHAAR", "AADHAAR"), ("PHONE", "PHONE_IN_LOOSE")):
        text = F.regexp_replace(text, P.spark(key), f"<{kind}>")
    return shown(text)


def role(tag: Column, attributes: Column) -> Column:
    explicit = F.nullif(F.get(F.split(F.trim(attributes["role"]), r"\s+"), F.lit(0)), F.lit(""))
    kind = F.lower(F.coalesce(F.nullif(attributes["type"], F.lit("")), F.lit("text")))
    of_input = F.when(kind.isin("button", "submit", "reset"), "button").when(kind.isin("checkbox", "radio"), kind).when(kind == "range", "slider").when(kind == "number", "spinbutton").otherwise("textbox")
    implicit = (
        F.when((tag == "a") & attributes["href"].isNotNull(), "link").when(tag == "button", "button").when(tag == "input", of_input).when(tag == "select", "combobox")
        .when(tag == "textarea", "textbox").when(tag.rlike("^h[1-6]$"), "heading").when(tag == "img", "img").when(tag == "nav", "navigation").when(tag == "dialog", "dialog")
    )
    return F.coalesce(explicit, implicit)


def accessible_name(elements_: DataFrame) -> DataFrame:
    """With ``name``: labelled-by texts, aria-label, a label's text, own text of named roles, alt, title, placeholder."""
    a = F.col("attributes")
    ids = elements_.select("page_id", a["id"].alias("_id"), F.col("text").alias("_t")).where("_id is not null").dropDuplicates(["page_id", "_id"])
    wanted = elements_.select("page_id", "dom_id", F.posexplode(F.split(F.trim(a["aria-labelledby"]), r"\s+")).alias("_n", "_id"))
    by_id = wanted.join(ids, ["page_id", "_id"]).groupBy("page_id", "dom_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]), " ").alias("_by"))
    labels = elements_.where("tag = 'label'").select("page_id", a["for"].alias("_for"), F.col("text").alias("_label")).where("_for is not null").groupBy("page_id", "_for").agg(F.min("_label").alias("_label"))
    out = elements_.join(by_id, ["page_id", "dom_id"], "left").withColumn("_for", a["id"]).join(labels, ["page_id", "_for"], "left")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    own = F.when(F.col("tag").isin("a", "button", "h1", "h2", "h3", "h4", "h5", "h6", "label", "li", "option"), F.col("text"))
    name = F.coalesce(some(F.col("_by")), some(a["aria-label"]), some(F.col("_label")), some(a["alt"]), some(own), some(a["title"]), some(a["placeholder"]))
    return out.withColumn("name", name).drop("_by", "_for", "_label")


def stable_selector(tag: Column, attributes: Column, nth: Column) -> Column:
    named = lambda k: F.when(F.nullif(attributes[k], F.lit("")).isNotNull(), F.concat(tag, F.lit(f"[{k}=\""), attributes[k], F.lit("\"]")))
    by_id = F.when(F.nullif(attributes["id"], F.lit("")).isNotNull(), F.concat(F.lit("#"), attributes["id"]))
    return F.coalesce(by_id, named("name"), named("role"), F.concat(tag, F.lit(":nth-child("), nth.cast("string"), F.lit(")")))


def semantic_type(role_: Column, tag: Column) -> Column:
    """Fixed vocabulary of kinds by role, else tag."""
    kinds = {"button": "button", "textbox": "input", "checkbox": "checkbox", "combobox": "dropdown", "link": "link", "tab": "tab", "menu": "menu", "dialog": "dialog", "table": "table", "navigation": "navigation", "img": "image", "heading": "text"}
    out = F.lit(None).cast("string")
    for r, kind in kinds.items():
        out = F.when(role_ == r, kind).otherwise(out)
    return F.coalesce(out, F.when(tag.isin("p", "span", "li", "div", "b", "title", "footer", "article"), "text").otherwise("unknown"))


def score(e: dict[str, Column]) -> Column:
    """0 to 1; closed renderings score 0.1.  ``e``: rendering, role, name, visible, w, h, handlers_hint, occluded."""
    has_role = F.coalesce(F.nullif(e["role"], F.lit("")).isNotNull(), F.lit(False))
    has_name = F.coalesce(F.length(e["name"]) > 0, F.lit(False))
    add = lambda test, yes, no=0.0: F.when(test, yes).otherwise(no)
    total = (
        add(has_role, 0.25) + add(has_name, 0.35) + add(e["visible"], 0.15, -0.2) + add((e["w"] > 0) & (e["h"] > 0), 0.15) + add(e["rendering"] == "html", 0.1)
        + add(e["handlers_hint"] & ~(has_role & has_name), -0.3) + add(e["occluded"], -0.25)
    )
    return F.when(closed(e), 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def closed(e: dict[str, Column]) -> Column:
    return e["rendering"].isin("canvas", "shadow_closed")


def media(e: dict[str, Column]) -> Column:
    """Large enough media must be looked at."""
    return (e["rendering"].isin("img", "video", "canvas", "svg") | e["has_bg_image"]) & (e["w"] * e["h"] >= IMAGE_AREA)


def level(e: dict[str, Column], dirty: Column) -> Column:
    s, least = score(e), media(e) | dirty
    return F.when(closed(e), "LOW").when((s >= ROUTE_HIGH) & ~least, "HIGH").when((s >= ROUTE_LOW) | least, "MEDIUM").otherwise("LOW")


def needs(level_: Column, media_: Column) -> Column:
    return F.when(level_ == "MEDIUM", F.when(media_, F.array(F.lit("ocr"), F.lit("face"), F.lit("ground"))).otherwise(F.array(F.lit("ocr"), F.lit("ground")))).otherwise(F.array().cast("array<string>"))


def budgeted(routed: DataFrame, page: str, order: str, most: int) -> DataFrame:
    """With ``capped``: elements that aren't HIGH beyond the page's budget need nothing."""
    used = F.sum((F.col("level") != "HIGH").cast("int")).over(W.partitionBy(page).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    capped = (F.col("level") != "HIGH") & (used > most)
    return routed.withColumn("capped", capped).withColumn("needs", F.when(capped, F.array().cast("array<string>")).otherwise(F.col("needs")))


def maskable(w: Column, h: Column, is_media: Column, is_face: Column, is_input: Column) -> Column:
    return (w < 800) & (h < 600) & (~is_media | is_face) & ((w * h <= 15000) | is_input)


def avatar(w: Column, h: Column, classes: Column) -> Column:
    """Nearly square, 24 to 512 pixels, with a class that names one."""
    square = (F.least(w, h) >= 24) & (F.greatest(w, h) <= 512) & (F.greatest(w, h) <= F.least(w, h) * 1.25)
    return square & F.lower(classes).rlike("avatar|profile|userpic|photo")


def page_state_hash(frame: DataFrame, page: str = "cycle", frames: str | None = None, target: str | None = None) -> DataFrame:
    """page, hash: 16 hex digits over the canonical JSON of origin, path, dialog, scroll bucket and interactive elements.

    Keys are sorted and boxes are rounded to steps of 4; what is missing in an element is the bare word undefined.
    ``frames`` is a column array<struct<id, origin>> of the page, in order; ``target`` a column with the page's target
    box: then only elements within 150 pixels of it count.
    """
    q = lambda c: F.to_json(F.array(c))
    text = lambda c: F.when(c.isNull(), "null").otherwise(F.regexp_replace(q(c), r"^\[|\]$", ""))
    step = lambda c: (F.floor(c / 4 + 0.5) * 4).cast("long").cast("string")
    flag = lambda c: F.when(c.isNull(), "undefined").otherwise(c.cast("string"))
    one = F.concat(F.lit('{"bbox":['), F.concat_ws(",", step(F.col("x")), step(F.col("y")), step(F.col("w")), step(F.col("h"))), F.lit('],"checked":'), flag(F.col("checked")), F.lit(',"disabled":'), flag(F.col("disabled")), F.lit(',"name":'), text(F.col("name")), F.lit(',"role":'), text(F.col("role")), F.lit(',"tag":'), text(F.col("tag")), F.lit("}"))
    live = F.col("visible") & F.col("interactable")
    if target is not None:
        t = F.col(target)
        live = live & (F.abs(F.col("x") - t["x"]) < t["w"] + NEAR) & (F.abs(F.col("y") - t["y"]) < t["h"] + NEAR)
    listed = F.lit(None).cast("string") if frames is None else F.array_join(F.transform(F.col(frames), lambda f: F.concat(F.lit('{"id":'), text(f["id"]), F.lit(',"origin":'), text(f["origin"]), F.lit("}"))), ",")
    own = frame.groupBy(page).agg(
        F.coalesce(F.first(listed), F.lit("")).alias("frames"),
        F.array_sort(F.collect_list(F.when(live, F.struct("ord", one.alias("j"))))).alias("e"),
        F.max((F.col("tag") == "dialog") & F.col("visible")).alias("dialog"),
        F.first("origin").alias("origin"), F.first("path").alias("path"), F.first("scroll_y").alias("scroll_y"),
    )
    body = F.concat(F.lit('{"dialogOpen":'), F.col("dialog").cast("string"), F.lit(',"frames":['), F.col("frames"), F.lit('],"interactive":['), F.array_join(F.transform("e", lambda x: x["j"]), ","), F.lit('],"origin":'), text(F.col("origin")), F.lit(',"path":'), text(F.col("path")), F.lit(',"scrollBucket":'), F.floor(F.col("scroll_y") / 64).cast("string"), F.lit("}"))
    return own.select(page, F.substring(F.sha2(body, 256), 1, 16).alias("hash"))
