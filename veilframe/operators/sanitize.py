"""Sanitising regions, the context that leaves, and the audit of what was taken out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import classifier as C
from . import redaction as R
from .detectors import bind, text_candidates

_OUT = "struct<label:string,type:string,confidence:double,text:string,replacements:int>"
#: Fixed: accessories and numbers that are no telephones.
_NO_PHONE = r"(?i)(?<!\w)(?:headphone|microphone|gramophone|megaphone|saxophone|phone\s*booth|phone\s*stand|order|ord|invoice|inv|tracking|track|serial|reference)(?!\w)"


def _low(c: Column | None) -> Column:
    return F.lit("") if c is None else F.lower(F.coalesce(c, F.lit("")))


def _any(columns: list[Column], *words: str) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for c in columns for w in words])


def avatar_shape(w: Column, h: Column) -> Column:
    """24 to 512 pixels a side, and sides that differ by a quarter of the width or 16 pixels at most."""
    return w.between(24, 512) & h.between(24, 512) & (F.abs(w - h) <= F.greatest(F.lit(16.0), w * 0.25))


def sanitize_region(e: dict[str, Column]) -> Column:
    """struct<label, type, confidence, text, replacements> of a region, by the first rule of the ladder that holds.

    Field classifier, password, avatar, then for regions without an element the words of their own that name a
    field, else the detectors over the text, and the plain patterns where those found nothing.  Label is null where
    nothing was personal.  ``e``: has_element, region_text, semantic_type, tag, role, name, label, placeholder,
    element_name, element_id, type, autocomplete, value, classes, is_password, has_bg_image, w, h.
    """
    no = F.lit(False)
    flag = lambda k: F.coalesce(e.get(k, no), no)
    text, name, input_name, placeholder, own_id, classes = (_low(e.get(k)) for k in ("region_text", "name", "element_name", "placeholder", "element_id", "classes"))
    tag, role, kind, semantic = (_low(e.get(k)) for k in ("tag", "role", "type", "semantic_type"))
    field = (semantic == "input") | tag.isin("input", "textarea", "select", "label") | role.isin("textbox", "radio", "checkbox")
    own = [text, name, input_name, own_id]
    aadhaar = field & (_any([text, name, input_name, own_id], "aadhaar", "aadhar") | _any([placeholder], "aadhaar", "xxxx"))
    pan = field & ~aadhaar & _any([*own, placeholder], "pan")
    password = field & (_any([*own, placeholder], "password") | flag("is_password"))
    phone = field & ~aadhaar & ~pan & ~text.rlike(_NO_PHONE) & ~name.rlike(_NO_PHONE) & (_any([*own, placeholder], "phone", "mobile") | _any([text, name], "contact") | (kind == "tel"))
    email = field & ~aadhaar & ~pan & ~password & ~phone & (_any([*own, placeholder], "mail") | (kind == "email"))
    face = ((semantic == "image") | tag.isin("img", "canvas") | flag("has_bg_image")) & avatar_shape(e["w"], e["h"]) & (_any([name, own_id, text, classes], "profile", "avatar") | _any([classes], "circle", "round", "entity", "ghost"))

    def row(label: str, type_: str, token: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(type_).alias("type"), F.lit(1.0).alias("confidence"), F.lit(token).alias("text"), F.lit(1).alias("replacements")).cast(_OUT)

    shown = F.coalesce(e["region_text"], F.lit(""))
    bare = ~flag("has_element")

    def plain(found: Column) -> Column:
        """Over the text's candidates: redacted one by one, or by plain patterns."""
        last = F.element_at(found, -1)
        several = F.struct(last["subtype"].alias("label"), last["category"].alias("type"), last["confidence"].alias("confidence"), R.redact_region(shown).alias("text"), F.size(found).alias("replacements")).cast(_OUT)
        changed = R.fallback(shown)
        other = F.struct(F.when(changed != shown, "PII").alias("label"), F.when(changed != shown, "PII").alias("type"), F.when(changed != shown, 0.99).alias("confidence"), changed.alias("text"), (changed != shown).cast("int").alias("replacements")).cast(_OUT)
        return F.when(F.size(found) > 0, several).otherwise(other)

    def whole(found: Column) -> Column:
        classified = F.struct(found["subtype"].alias("label"), found["category"].alias("type"), found["confidence"].alias("confidence"), found["token"].alias("text"), F.lit(1).alias("replacements")).cast(_OUT)
        return (
            F.when(flag("has_element") & (found["confidence"] >= 0.70), classified).when(password, row("PASSWORD", "PASSWORD", "<REDACTED_PASSWORD>")).when(face, row("FACE", "FACE", "<REDACTED_FACE>"))
            .when(bare & aadhaar, row("AADHAAR", "GOV_ID", "<REDACTED_AADHAAR>")).when(bare & pan, row("PAN", "GOV_ID", "<REDACTED_PAN>")).when(bare & phone, row("PHONE", "PHONE", "<PHONE>"))
            .when(bare & email, row("EMAIL", "EMAIL", "<EMAIL>")).otherwise(bind(text_candidates(shown), plain))
        )

    return bind(C.classify({**e, "surrounding": e["region_text"]}), whole)


def sanitized_context(regions: DataFrame, detections: DataFrame, request: str = "request") -> DataFrame:
    """request, body, sha256: the canonical JSON of a request's regions (ord, region_id, type, text, interactable) and
    of its redactions counted by type, keys sorted, and its digest.

    A request's regions are one document by definition and bounded by its page.
    """
    one = R.canonical({"interactable": F.col("interactable"), "region_id": F.col("region_id"), "text": F.col("text"), "type": F.col("type")})
    own = regions.groupBy(request).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("j")))), lambda r: r["j"]), ",").alias("_regions"))
    counts = detections.groupBy(request, "type").agg(F.count(F.lit(1)).alias("count"))
    counts = counts.groupBy(request).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('{"count":'), F.col("count").cast("string"), F.lit(',"type":"'), "type", F.lit('"}')))), ",").alias("_counts"))
    body = F.concat(F.lit('{"redactions":['), F.coalesce("_counts", F.lit("")), F.lit('],"regions":['), "_regions", F.lit('],"request_id":"req_'), F.col(request).cast("string"), F.lit('","schema_version":"1.0"}'))
    return own.join(counts, request, "left").select(request, body.alias("body")).withColumn("sha256", R.digest(F.col("body")))


#: Fixed: what an audit says, by a part of the candidate's id or else by its type, in order.
AUDIT: tuple[tuple[tuple[str, ...], str | None, str, str, str], ...] = (
    (("aadhaar",), None, "Aadhaar (UIDAI 12-Digit)", "Verhoeff Dihedral Group D5 Modulo-10", "<REDACTED_AADHAAR>"),
    (("pan",), None, "Indian PAN Card", "Entity Check (4th Char P/C/H/F/A/T/B/L/J/G)", "<REDACTED_PAN>"),
    (("password",), "PASSWORD", "Password Credential", "Capability Vault Isolation (fill_secret ref token)", "<VAULT_PASSWORD>"),
    (("voter",), None, "Voter ID / EPIC Number", "Election Commission EPIC Structural Validation", "<REDACTED_VOTER_ID>"),
    (("passport",), None, "Indian Passport", "Passport Format Structural & Context Validation", "<REDACTED_PASSPORT>"),
    (("driving_licence",), None, "Indian Driving Licence", "Sarathi DL State Code & Year Validation", "<REDACTED_DRIVING_LICENCE>"),
    (("bank_account",), "BANK_ACCOUNT", "Bank Account Number", "Bank Account Context & Length Validation", "<REDACTED_BANK_ACCOUNT>"),
    (("ifsc",), None, "Bank Branch IFSC Code", "RBI IFSC Structural Validation (5th Char Zero)", "<REDACTED_IFSC>"),
    (("upi",), None, "UPI ID / VPA Handle", "NPCI PSP Provider & VPA Validation", "<REDACTED_UPI>"),
    (("card",), "CARD", "Payment Card Number", "Luhn Modulus-10 Checksum Algorithm", "<REDACTED_CARD>"),
    (("address", "pincode"), "ADDRESS", "Postal Address / PIN Code", "Postal PIN Code & Context Validation", "<REDACTED_ADDRESS>"),
    (("dob",), "DOB", "Date of Birth", "Birth Date Semantic & Pattern Validation", "<REDACTED_DOB>"),
    (("person",), "PERSON", "Person Full Name", "Explicit Identity Context Validation", "<REDACTED_NAME>"),
    ((), "EMAIL", "Work Email Address", "RFC-5322 Regex Pattern", "<EMAIL>"),
    ((), "PHONE", "Mobile / Phone Number", "Indian Mobile & E.164 Telephony Engine", "<PHONE>"),
    ((), "FACE", "Biometric Face Avatar", "OffscreenCanvas 2D Blackout Redaction", "Solid Blackout Box [Red Border]"),
)


def audit_item(id_: Column, type_: Column) -> Column:
    """struct<label, method, redacted_as> of a detection."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("label"), F.lit("").alias("method"), F.lit("").alias("redacted_as")))
    for parts, own, label, method, token in AUDIT:
        test = reduce(lambda a, b: a | b, [id_.contains(p) for p in parts] + ([type_ == own] if own else []))
        out = out.when(test, F.struct(F.lit(label).alias("label"), F.lit(method).alias("method"), F.lit(token).alias("redacted_as")))
    return out.otherwise(F.struct(type_.alias("label"), F.lit("Rule-based Sanitization").alias("method"), F.lit("<REDACTED>").alias("redacted_as")))


def redaction_totals(detections: DataFrame, cycles: DataFrame, key: str = "cycle") -> DataFrame:
    """key, detections (a row each) and replaced: text replacements and masked boxes of cycles (key, texts, boxes)."""
    n = detections.groupBy(key).agg(F.count(F.lit(1)).alias("detections"))
    return cycles.join(n, key, "left").select(key, F.coalesce("detections", F.lit(0)).alias("detections"), (F.col("texts") + F.col("boxes")).alias("replaced"))


def ocr_wanted(elements: DataFrame, key: str = "cycle") -> DataFrame:
    """key, wanted: a visible image of 2500 square pixels in view, or a page that shows documents."""
    image = F.col("visible") & F.col("in_viewport") & (F.col("rendering").isin("img", "canvas") | F.col("tag").isin("img", "canvas", "embed") | F.col("has_bg_image")) & (F.col("w") * F.col("h") >= 2500)
    viewer = F.coalesce(F.col("origin").rlike(r"(?i)scribd\.com|docs\.google\.com|drive\.google\.com|pdf|document"), F.lit(False))
    return elements.groupBy(key).agg(F.bool_or(F.coalesce(image, F.lit(False)) | viewer).alias("wanted"))
