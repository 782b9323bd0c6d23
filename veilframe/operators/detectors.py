"""Detectors of personal data as data: each is a specification, compiled to Columns.

Text mode gives every occurrence; element mode gives the best detection of a form field.  Nothing here needs a
Python function per row: a text that holds no match of a detector's pattern doesn't reach its other expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import patterns as P
from ..functions import validators as V


@dataclass(frozen=True)
class DetectorSpec:
    """``mode``: all valid matches; leading: those before the first invalid one; context: no match is needed.

    ``upper``: the evidence is the upper-cased match, so a match in lower case can't be found again: it counts
    once, without a place, and ends the search.  ``signals``: attributes of a field and patterns that give context
    too; two of them raise the field's confidence to ``many``.  ``hint``: what every match holds, a digit, an at sign
    or nothing in particular; texts without it don't reach the pattern.
    """

    subtype: str
    category: str
    priority: int
    token: str
    patterns: tuple[str, ...] = ()
    valid: Callable[[Column], Column] | None = None
    contains: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    veto: tuple[str, ...] = ()
    veto_starts: tuple[str, ...] = ()
    required: bool = False
    with_context: float = 0.0
    without: float = 0.0
    field: float | None = None
    mode: str = "all"
    upper: bool = False
    known: Callable[[Column], Column] | None = None
    signals: tuple[tuple[str, str], ...] = ()
    many: float | None = None
    hint: str = "digit"


_ORDERS = ("order", "invoice", "tracking", "serial", "shipment", "booking", "receipt", r"transaction\s*id", r"product\s*id", "sku", r"ticket\s*number")
_PAN_ORDERS = ("order", "invoice", "tracking", "serial", "shipment", "booking", "receipt", "sku", "ticket")
_PHONE_FIELD = r"(?i)phone|mobile|contact|telephone"
#: Fixed: attributes of a field that speak for a telephone number or an address of mail.
_PHONE_SIGNALS = (("type", "(?i)^tel$"), ("autocomplete", "(?i)tel"), ("label", rf"{_PHONE_FIELD}|cell"), ("placeholder", r"(?i)\+91|[6-9]\d{4}|phone|mobile"), ("name", _PHONE_FIELD), ("element_name", _PHONE_FIELD))
_MAIL_SIGNALS = (("type", "(?i)^email$"), ("autocomplete", "(?i)^email$"), ("label", "(?i)mail"), ("placeholder", "(?i)@|mail"), ("name", "(?i)mail"), ("element_name", "(?i)mail"))
#: Vocabulary, confidences and priorities.
DETECTORS: tuple[DetectorSpec, ...] = (
    DetectorSpec("AADHAAR", "GOV_ID", 100, "<REDACTED_AADHAAR>", ("AADHAAR",), V.verhoeff, ("aadhaar", "aadhar", "uidai"), veto=_ORDERS, required=True, with_context=1.0, field=0.95),
    DetectorSpec("PAN", "GOV_ID", 95, "<REDACTED_PAN>", ("PAN",), V.pan, ("pan card", "pan number", "permanent account number"), ("pan",), ("panoramic", "pantry", "japan", r"company\s*panel", r"pan\s*handle", r"frying\s*pan", "span", r"steel\s*pan", *_PAN_ORDERS), with_context=1.0, without=0.88, field=0.90, hint=""),
    DetectorSpec("US_SSN", "GOV_ID", 94, "<REDACTED_US_SSN>", ("SSN",), V.ssn, with_context=0.98, without=0.98, mode="leading"),
    DetectorSpec("UK_NIN", "GOV_ID", 93, "<REDACTED_UK_NIN>", ("NIN",), with_context=0.98, without=0.98, mode="leading"),
    DetectorSpec("US_EIN", "GOV_ID", 92, "<REDACTED_US_EIN>", ("EIN",), None, ("employer identification", "tax identification"), ("ein",), required=True, with_context=0.98, mode="leading"),
    DetectorSpec("VOTER_ID", "GOV_ID", 90, "<REDACTED_VOTER_ID>", ("VOTER",), V.voter, ("voter", "epic", "elector", "election card"), required=True, with_context=0.95, field=0.90, upper=True),
    DetectorSpec("PASSPORT", "GOV_ID", 85, "<REDACTED_PASSPORT>", ("PASSPORT_IN",), V.passport_in, ("passport",), required=True, with_context=0.95, field=0.90, upper=True),
    DetectorSpec("DRIVING_LICENCE", "GOV_ID", 80, "<REDACTED_DRIVING_LICENCE>", ("DL",), lambda c: V.driving_licence(c), ("driving licence", "driving license", "dl no", "dl number"), with_context=0.98, without=0.88, field=0.90, upper=True),
    DetectorSpec("PASSPORT_INTL", "GOV_ID", 80, "<REDACTED_PASSPORT>", ("PASSPORT_INTL",), lambda c: c.rlike("[0-9]"), ("passport",), required=True, with_context=0.90, upper=True),
    DetectorSpec("PHONE", "PHONE", 75, "<PHONE>", ("PHONE_IN",), lambda c: V.mobile_in(c).isNotNull(), ("phone", "mobile", "contact", "telephone", "whatsapp"), veto=("headphone", "microphone", "gramophone", "megaphone", "saxophone", r"phone\s*(?:booth|stand|case)", r"smartphone\s*review", "order", "ord", "invoice", "inv", "tracking", "track", "serial", "reference", "ref", "booking", "receipt", "shipment", "sku", "item", r"product\s*id", "timestamp", "counter", "quantity", "metric"), veto_starts=("order", "ord", "invoice", "inv", "tracking", "track"), with_context=0.98, without=0.85, field=0.90, signals=_PHONE_SIGNALS, many=0.95),
    DetectorSpec("PHONE_INTL", "PHONE", 74, "<REDACTED_PHONE>", ("PHONE_INTL",), V.phone_intl, with_context=0.94, without=0.94, mode="leading"),
    DetectorSpec("EMAIL", "EMAIL", 70, "<EMAIL>", ("EMAIL",), None, ("email", "e-mail", "mail address"), veto=(r"voice\s*mail", "mailman", r"chain\s*mail", r"daily\s*mail", r"mail\s*room", r"mail\s*bag", r"air\s*mail"), with_context=1.0, without=0.98, field=0.92, signals=_MAIL_SIGNALS, many=1.0, hint="at"),
    DetectorSpec("PINCODE", "ADDRESS", 65, "<REDACTED_ADDRESS>", ("PIN",), None, ("street address", "residential address", "home address", "billing address", "shipping address", "postal address", "pincode", "pin code", "postal code"), veto=(r"ip\s*address", r"mac\s*address", r"web\s*address", r"url\s*address", r"email\s*address", r"memory\s*address"), required=True, with_context=0.92, field=0.90),
    DetectorSpec("IBAN", "BANK_ACCOUNT", 62, "<REDACTED_IBAN>", ("IBAN",), V.iban, with_context=0.98, without=0.98, mode="leading"),
    DetectorSpec("BANK_ACCOUNT", "BANK_ACCOUNT", 60, "<REDACTED_BANK_ACCOUNT>", ("BANK",), None, ("account number", "account no", "bank account", "savings account", "current account", "a/c no"), veto=(r"user\s*account", r"google\s*account", r"login\s*account", r"email\s*account", r"social\s*account", r"github\s*account", "order", "invoice", "tracking", "serial"), required=True, with_context=0.95, field=0.90),
    DetectorSpec("IFSC", "IDENTIFIER", 58, "<REDACTED_IFSC>", ("IFSC",), V.ifsc, ("ifsc", "bank branch", "rtgs", "neft"), with_context=0.99, without=0.94, field=0.90),
    DetectorSpec("SWIFT_BIC", "IDENTIFIER", 57, "<REDACTED_SWIFT_BIC>", ("SWIFT",), None, ("swift", "bic code"), required=True, with_context=0.94, mode="leading", hint=""),
    DetectorSpec("UPI", "IDENTIFIER", 56, "<REDACTED_UPI>", ("UPI",), V.upi, ("upi", "vpa", "bhim"), with_context=0.98, without=0.90, field=0.90, known=V.upi_known, hint="at"),
    DetectorSpec("CARD", "CARD", 55, "<REDACTED_CARD>", ("CARD_1", "CARD_2"), V.luhn, ("credit card", "debit card", "card number", "payment", "visa", "mastercard", "amex", "rupay", "cvv", "cvc"), veto=("cardboard", "wildcard", "postcard", r"greeting\s*card", r"sim\s*card", r"sd\s*card", r"graphics\s*card", r"sound\s*card", "telemetry", "sequence", "metric", "counter", "timestamp", "order", "invoice", "tracking", "serial"), required=True, with_context=1.0, field=0.95),
    DetectorSpec("CARD_SECURITY_CODE", "CARD", 54, "<REDACTED_CARD_SECURITY_CODE>", ("CSC",), None, (), ("cvv", "cvc", "security code"), required=True, with_context=0.98, mode="leading"),
    DetectorSpec("PERSON", "PERSON", 50, "<REDACTED_NAME>", (), None, ("full name", "first name", "last name", "applicant name", "customer name", "account holder", "beneficiary name"), veto=(r"file\s*name", r"product\s*name", r"brand\s*name", r"domain\s*name", r"host\s*name", r"company\s*name", r"organization\s*name", r"class\s*name", r"tag\s*name", r"server\s*name", r"variable\s*name", r"model\s*name"), required=True, with_context=0.90, field=0.90, mode="context", hint=""),
    DetectorSpec("DOB", "DOB", 45, "<REDACTED_DOB>", (), None, ("dob", "date of birth", "birth date", "birthday"), veto=(r"release\s*date", r"event\s*date", r"expiry\s*date", r"due\s*date", r"creation\s*date", r"update\s*date", r"start\s*date", r"end\s*date", r"meeting\s*date", r"order\s*date"), required=True, with_context=0.95, field=0.95, mode="context", hint=""),
)
LEAST, MOST = 0.70, 100


class Registry:
    """Detectors by priority; registering a subtype again replaces it."""

    def __init__(self, specs: Sequence[DetectorSpec] = DETECTORS):
        self._specs: list[DetectorSpec] = []
        for spec in specs:
            self.register(spec)

    def __iter__(self):
        return iter(self._specs)

    def register(self, spec: DetectorSpec) -> None:
        self._specs = sorted([s for s in self._specs if s.subtype != spec.subtype] + [spec], key=lambda s: -s.priority)

    def get(self, subtype: str) -> DetectorSpec | None:
        return next((s for s in self._specs if s.subtype == subtype), None)

    def list(self) -> list[DetectorSpec]:
        return list(self._specs)


def has_context(spec: DetectorSpec, sem: Column) -> Column:
    """``sem`` is lower case."""
    tests = [sem.contains(x) for x in spec.contains]
    if spec.words:
        tests.append(sem.rlike(rf"(?<!\w)(?:{'|'.join(spec.words)})(?!\w)"))
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def vetoed(spec: DetectorSpec, sem: Column, text: Column) -> Column:
    out = F.lit(False)
    if spec.veto:
        out = sem.rlike(rf"(?<!\w)(?:{'|'.join(spec.veto)})(?!\w)")
    if spec.veto_starts:
        out = out | F.lower(text).rlike(rf"(?<!\w)(?:{'|'.join(spec.veto_starts)})")
    return out


def bind(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``c``, which is evaluated once and stands once in the expression."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _extended(found: Column, more: Column) -> Callable[[Column], Column]:
    return lambda own: F.when(F.size(own) == F.size(found), F.concat(own, more)).otherwise(own)


def values(spec: DetectorSpec, text: Column, sem: Column) -> Column:
    """The matches that count, in order."""
    valid = spec.valid or (lambda c: F.lit(True))

    def leading(found: Column) -> Column:
        bad = F.array_position(F.transform(found, lambda c: F.coalesce(valid(c), F.lit(False))), F.lit(False))
        return F.when(bad > 0, F.slice(found, 1, bad.cast("int") - 1)).otherwise(found)

    def until_lower(good: Column) -> Column:
        low = F.array_position(F.transform(good, lambda c: c == F.upper(c)), F.lit(False))
        return F.when(low > 0, F.slice(good, 1, low.cast("int"))).otherwise(good)

    def every(found: Column) -> Column:
        good = F.filter(found, valid)
        if spec.known is not None:
            good = bind(has_context(spec, sem), lambda context: F.filter(found, lambda c: valid(c) & (context | spec.known(c))))
        for key in spec.patterns[1:]:  # the next pattern comes in when the first has nothing left
            more = F.filter(F.regexp_extract_all(text, F.lit(P.spark(key)), F.lit(0)), lambda c: valid(c) & ~F.array_contains(found, c))
            good = bind(good, _extended(found, more))
        return bind(good, until_lower) if spec.upper else good

    found = F.regexp_extract_all(text, F.lit(P.spark(spec.patterns[0])), F.lit(0))
    if spec.mode == "leading":
        return found if spec.valid is None else bind(found, leading)
    return bind(found, every)


def placed(found: Column, text: Column) -> Column:
    """array<struct<value, at>>: where each value stands when those before it are blanked; null if nowhere."""
    start = F.struct(text.alias("rest"), F.array().cast("array<struct<value:string,at:int>>").alias("out"))

    def fold(a: Column, v: Column) -> Column:
        at = F.position(v, a["rest"])
        rest = F.when(at > 0, F.overlay(a["rest"], F.repeat(F.lit(" "), F.length(v)), at, F.length(v))).otherwise(a["rest"])
        one = F.struct(v.alias("value"), F.when(at > 0, at - 1).alias("at"))
        return F.struct(rest.alias("rest"), F.concat(a["out"], F.array(one)).alias("out"))

    return F.aggregate(found, start, fold)["out"]


_CANDIDATE = "array<struct<subtype:string,category:string,priority:int,occurrence:int,at:int,length:int,confidence:double,token:string>>"


def _candidates(spec: DetectorSpec, text: Column, sem: Column, at: bool, hints: dict[str, Column]) -> Column:
    """Cheap tests come first: the hint, found once per text, then the context if it's required, then patterns and vetoes."""
    context = has_context(spec, sem)
    confidence = F.lit(spec.with_context) if spec.required else F.when(context, spec.with_context).otherwise(spec.without)

    def one(occurrence: Column, place: Column, length: Column) -> Column:
        return F.struct(F.lit(spec.subtype).alias("subtype"), F.lit(spec.category).alias("category"), F.lit(spec.priority).alias("priority"), occurrence.cast("int").alias("occurrence"), place.cast("int").alias("at"), length.cast("int").alias("length"), confidence.cast("double").alias("confidence"), F.lit(spec.token).alias("token"))

    none = F.lit(None).cast("int")
    if spec.mode == "context":
        gate, out = context & ~vetoed(spec, sem, text), F.array(one(F.lit(0), none, none))
    else:
        gate = hints[spec.hint] if spec.hint else F.lit(True)
        if spec.required:
            gate = gate & context
        gate = gate & text.rlike("|".join(P.spark(k) for k in spec.patterns)) & ~vetoed(spec, sem, text)
        found = F.slice(values(spec, text, sem), 1, MOST)
        if at:
            out = F.transform(placed(found, text), lambda x, i: one(i, F.when(x["value"] == F.upper(x["value"]), x["at"]) if spec.upper else x["at"], F.length(x["value"])))
        else:
            out = F.transform(found, lambda x, i: one(i, none, F.length(x)))
    return F.when(gate, out).otherwise(F.array().cast(_CANDIDATE)).cast(_CANDIDATE)


def text_candidates(text: Column, surrounding: Column | None = None, specs: Sequence[DetectorSpec] = DETECTORS, at: bool = True) -> Column:
    """array of candidates of a text, by detector in order of priority; no raw value is in it."""
    text = F.coalesce(text, F.lit(""))
    sem = F.lower(text if surrounding is None else F.concat_ws(" ", surrounding, text))
    ordered = sorted(specs, key=lambda s: -s.priority)

    def every(x: Column) -> Column:
        own = F.concat(*[_candidates(s, x["text"], x["sem"], at, {"digit": x["digit"], "at": x["at"]}) for s in ordered])
        return F.when((x["text"] == "") | V.generic_token(x["text"]), F.array().cast(_CANDIDATE)).otherwise(F.filter(own, lambda c: c["confidence"] >= LEAST))

    return bind(F.struct(text.alias("text"), sem.alias("sem"), text.rlike("[0-9]").alias("digit"), text.contains("@").alias("at")), every)


def detect_text(frame: DataFrame, keys: Sequence[str], text: str = "text", specs: Sequence[DetectorSpec] | Registry = DETECTORS, at: bool = True) -> DataFrame:
    """``specs`` is a registry, with detectors of the caller's own, or a sequence.  A row per candidate: the keys, subtype, category, priority, occurrence, at, length, confidence, token, id."""
    out = frame.select(*keys, F.explode(text_candidates(F.col(text), specs=specs, at=at)).alias("c")).select(*keys, "c.*")
    place = F.coalesce(F.col("at").cast("string"), F.lit("context"))
    return out.withColumn("id", F.concat_ws("_", F.lit("pii"), F.lower("subtype"), place, F.col("occurrence").cast("string")))


#: Roles, tags and types of action controls, which aren't fields.
CONTROL_TYPES, CONTROL_ROLES, CONTROL_TAGS = ["button", "submit", "reset"], ["button", "link", "menuitem", "tab"], ["button", "a"]


def is_control(type_: Column, role: Column, tag: Column) -> Column:
    test = lambda c, own: F.coalesce(F.lower(c).isin(own), F.lit(False))
    return test(type_, CONTROL_TYPES) | test(role, CONTROL_ROLES) | test(tag, CONTROL_TAGS)


def element_candidate(element: dict[str, Column], specs: Sequence[DetectorSpec] = DETECTORS) -> Column:
    """struct<subtype, category, confidence, token, matched>: the best detection of a form element, or null.

    ``element`` has columns value, text, name, label, placeholder, description, aria_label, input_name,
    element_name, element_id, type, role, tag; missing ones are null.  Ties go to the higher priority.
    """
    none = F.lit(None).cast("string")
    get = lambda k: element.get(k, none)
    content = F.concat_ws(" ", *[F.nullif(get(k), F.lit("")) for k in ("value", "text", "name", "label", "placeholder")])
    sem = F.lower(F.concat_ws(" ", *[get(k) for k in ("name", "label", "description", "aria_label", "placeholder", "input_name", "element_name", "element_id", "text")]))

    def option(spec: DetectorSpec, x: Column) -> Column:
        signals = reduce(lambda a, b: a + b, [F.coalesce(get(k), F.lit("")).rlike(p).cast("int") for k, p in spec.signals], F.lit(0))

        def made(c: Column) -> Column:
            context = c["context"] | (c["signals"] > 0)
            if spec.mode == "context":
                confidence = F.when(context, spec.with_context)
            else:
                hit = F.size(values(spec, x["content"], x["sem"])) > 0
                inside = F.when(hit, spec.with_context)
                field = F.lit(spec.field) if spec.many is None else F.when(c["signals"] > 1, spec.many).otherwise(spec.field)
                confidence = F.when(context, inside.otherwise(field) if spec.field else inside)
                if not spec.required:
                    confidence = confidence.otherwise(F.when(hit, spec.without))
            return F.when(~vetoed(spec, x["sem"], x["content"]), confidence)

        def row(confidence: Column) -> Column:
            return F.struct((-confidence).alias("order"), F.lit(-spec.priority).alias("rank"), F.lit(spec.subtype).alias("subtype"), F.lit(spec.category).alias("category"), confidence.cast("double").alias("confidence"), F.lit(spec.token).alias("token"))

        return bind(bind(F.struct(has_context(spec, x["sem"]).alias("context"), signals.alias("signals")), made), row)

    def ranked(x: Column) -> Column:
        return F.array_sort(F.filter(F.array(*[option(s, x) for s in sorted(specs, key=lambda s: -s.priority)]), lambda c: c["confidence"] >= LEAST))

    def best(good: Column) -> Column:
        first = F.get(good, F.lit(0))
        return F.when(F.size(good) > 0, F.struct(first["subtype"].alias("subtype"), first["category"].alias("category"), first["confidence"].alias("confidence"), first["token"].alias("token"), F.transform(good, lambda c: c["subtype"]).alias("matched")))

    made = bind(bind(F.struct(content.alias("content"), sem.alias("sem")), ranked), best)
    return F.when(~is_control(get("type"), get("role"), get("tag")), made)


def detect_all(elements: DataFrame, element: dict[str, Column], keys: list[str], ordinal: str = "ord", dom_id: str = "dom_id", specs: Sequence[DetectorSpec] | Registry = DETECTORS) -> DataFrame:
    """keys, ordinal, id, subtype, category, confidence, token: of each page's equal ids the first element."""
    own = elements.select(*keys, ordinal, F.col(dom_id).cast("string").alias("_dom"), element_candidate(element, list(specs)).alias("c")).where("c is not null")
    own = own.withColumn("id", F.concat(F.lit("pii_"), F.lower("c.subtype"), F.lit("_"), F.coalesce("_dom", F.lit("elem"))))
    first = F.row_number().over(W.partitionBy(*keys, "id").orderBy(ordinal))
    return own.withColumn("_n", first).where("_n = 1").select(*keys, ordinal, "id", "c.subtype", "c.category", "c.confidence", "c.token")
