"""Classifier of form fields: the detectors first, then eight categories in order, the first with evidence holds.

Each category gathers evidence, a struct of the attribute and the rule it met: the field's type, its autocomplete
value, and keywords in five attributes unless a phrase of the category's veto stands in the same attribute.
Confidence rises from a base with each further piece of evidence.  Weak signals (a bare "PIN" or "Name") stay
below the threshold of 0.70 by their fixed confidences, so they never decide and aren't gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import detectors as D

FIELDS = ("label", "name", "placeholder", "element_name", "element_id")
_EVIDENCE = "array<struct<field:string,rule:string>>"
_OUT = "struct<category:string,subtype:string,confidence:double,token:string,evidence:array<struct<field:string,rule:string>>>"


def _word(pattern: str) -> str:
    return rf"(?i)(?<!\w)(?:{pattern})(?!\w)"


@dataclass(frozen=True)
class Category:
    """``words`` are keyword patterns with the subtype each stands for, tried in order on every attribute."""

    name: str
    base: float
    step: float
    token: str
    words: tuple[tuple[str, str], ...]
    veto: str | None = None
    types: tuple[str, ...] = ()
    autocomplete: tuple[str, ...] = ()


#: Fixed: bases, steps, vocabulary and vetoes, in order.
CATEGORIES: tuple[Category, ...] = (
    Category("PASSWORD", 0.95, 0.03, "<REDACTED_PASSWORD>",
             (("PASSWORD", _word("password|passcode|passphrase|secret_key|api_key|auth_token|access_token|totp|otp")),),
             _word(r"pin\s*code|pincode|safety\s*pin|pin\s*point|pinboard|bowling\s*pin|tie\s*pin"),
             ("password",), ("current-password", "new-password", "one-time-code")),
    Category("GOV_ID", 0.95, 0.03, "<REDACTED_AADHAAR>", (("AADHAAR", _word("aadhaar|aadhar|uidai")),)),
    Category("GOV_ID", 0.95, 0.03, "<REDACTED_PAN>", (("PAN", _word(r"pan\s*card|pan\s*number|permanent\s*account\s*number|pan")),),
             _word(r"panoramic|pantry|japan|company\s*panel|pan\s*handle|frying\s*pan|pan\s*tilt|steel\s*pan|span")),
    Category("GOV_ID", 0.95, 0.03, "<REDACTED_GOV_ID>",
             (("GOV_ID", _word(r"ssn|social\s*security|national\s*id|voter\s*id|passport\s*number|passport\s*no")),)),
    Category("EMAIL", 0.92, 0.03, "<EMAIL>",
             (("EMAIL", _word(r"email|e-mail|mail\s*address")), ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")),
             _word(r"voice\s*mail|voicemail|mailman|chain\s*mail|daily\s*mail|mail\s*room|mail\s*bag|air\s*mail|mail\s*slot"),
             ("email",), ("email",)),
    Category("PHONE", 0.92, 0.03, "<PHONE>", (("PHONE", _word(r"phone|mobile|cell\s*number|telephone|contact\s*no|whatsapp")),),
             _word(r"headphone|microphone|gramophone|megaphone|saxophone|phone\s*booth|phone\s*stand|phone\s*case|smartphone\s*review"),
             ("tel",), ("tel", "tel-national", "tel-country-code", "mobile")),
    Category("CARD", 0.95, 0.03, "<REDACTED_CARD>",
             (("CARD", _word(r"credit\s*card|debit\s*card|card\s*number|cvv|cvc|card\s*expiry|exp\s*date|security\s*code")),
              ("BANK_ACCOUNT", _word(r"bank\s*account|account\s*number|ifsc|routing\s*number|iban"))),
             _word(r"cardboard|wildcard|postcard|greeting\s*card|sim\s*card|sd\s*card|graphics\s*card|sound\s*card|tarot\s*card"),
             (), ("cc-number", "cc-exp", "cc-exp-month", "cc-exp-year", "cc-csc", "cc-type", "bacs-account-number")),
    Category("PERSON", 0.88, 0.04, "<REDACTED_NAME>",
             (("PERSON", _word(r"full\s*name|first\s*name|last\s*name|middle\s*name|sur\s*name|legal\s*name|candidate\s*name"
                               r"|father'?s?\s*name|mother'?s?\s*name|spouse'?s?\s*name")),),
             _word(r"file\s*name|product\s*name|brand\s*name|domain\s*name|host\s*name|company\s*name|organization\s*name"
                   r"|class\s*name|tag\s*name|server\s*name|variable\s*name|model\s*name"),
             (), ("name", "given-name", "family-name", "additional-name")),
    Category("ADDRESS", 0.90, 0.03, "<REDACTED_ADDRESS>",
             (("ADDRESS", _word(r"street\s*address|residential\s*address|home\s*address|billing\s*address|shipping\s*address"
                                r"|postal\s*code|pin\s*code|zip\s*code")),),
             _word(r"ip\s*address|mac\s*address|web\s*address|url\s*address|email\s*address|memory\s*address"),
             (), ("street-address", "address-line1", "address-line2", "address-line3", "address-level1", "address-level2", "postal-code", "country-name")),
    Category("DOB", 0.92, 0.03, "<REDACTED_DOB>", (("DOB", _word(r"date\s*of\s*birth|birth\s*date|birthdate|dob")),),
             _word(r"release\s*date|event\s*date|expiry\s*date|due\s*date|creation\s*date|update\s*date|start\s*date|end\s*date|meeting\s*date"),
             (), ("bday", "bday-day", "bday-month", "bday-year")),
)
#: Fixed: placeholders that show an Aadhaar number's shape.
AADHAAR_SHAPE = r"xxxx|12-digit|12 digit"


def _plain(e: dict[str, Column], key: str) -> Column:
    return F.lower(F.trim(F.coalesce(e.get(key, F.lit(None).cast("string")), F.lit(""))))


def _evidence(c: Category, e: dict[str, Column]) -> Column:
    """array<struct<field, rule>> of what speaks for a category; rules are subtypes for keywords."""
    made = lambda field, rule: F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"))
    parts = []
    if c.types:
        parts.append(F.when(e["type"].isin(*c.types) | (e["is_password"] if c.name == "PASSWORD" else F.lit(False)), made("type", "type")))
    if c.autocomplete:
        parts.append(F.when(e["autocomplete"].isin(*c.autocomplete), F.struct(F.lit("autocomplete").alias("field"), e["autocomplete"].alias("rule"))))
    for field in FIELDS:
        own = F.when(F.lit(False), made(field, ""))
        for subtype, pattern in c.words:
            own = own.when(e[field].rlike(pattern), made(field, subtype))
        parts.append(own if c.veto is None else F.when(~e[field].rlike(c.veto), own))
    if c.words[0][0] == "AADHAAR":
        parts.append(F.when(e["placeholder"].rlike(AADHAAR_SHAPE), made("placeholder", "AADHAAR")))
    found = F.filter(F.array(*parts).cast(_EVIDENCE), lambda x: x.isNotNull())
    if c.words[0][0] == "PAN":
        found = F.when(e["combined"].rlike(c.veto), F.array().cast(_EVIDENCE)).otherwise(found)
    return found


def _result(c: Category, e: dict[str, Column]) -> Column:
    """The category's struct, or null without evidence."""

    def made(found: Column) -> Column:
        name, subtype, token = F.lit(c.name), F.lit(c.words[0][0]), F.lit(c.token)
        if c.name == "PASSWORD":
            name = F.when(e["combined"].contains("token") | e["combined"].contains("api_key"), "AUTH_TOKEN").otherwise("PASSWORD")
            subtype, token = name, F.concat(F.lit("<REDACTED_"), name, F.lit(">"))
        elif c.name == "CARD":
            bank = F.exists(found, lambda x: x["rule"].isin("BANK_ACCOUNT", "bacs-account-number"))
            name = F.when(bank, "BANK_ACCOUNT").otherwise("CARD")
            subtype, token = name, F.concat(F.lit("<REDACTED_"), name, F.lit(">"))
        confidence = F.least(F.lit(1.0), F.lit(c.base) + (F.size(found) - 1) * c.step)
        own = F.struct(name.alias("category"), subtype.alias("subtype"), confidence.alias("confidence"), token.alias("token"), found.alias("evidence"))
        return F.when(F.size(found) > 0, own.cast(_OUT))

    return D.bind(_evidence(c, e), made)


def classify(element: dict[str, Column]) -> Column:
    """struct<category, subtype, confidence, token, evidence> of a field, or null.

    ``element`` maps FIELDS, description, aria_label, type, autocomplete, role, tag, value, text, is_password and
    surrounding to Columns; missing ones are null.  Evidence names attributes and rules and never holds a value.
    """
    none = F.lit(None).cast("string")
    e = {k: _plain(element, k) for k in (*FIELDS, "description", "aria_label", "type", "autocomplete", "surrounding")}
    e["is_password"] = F.coalesce(element.get("is_password", F.lit(False)), F.lit(False))
    order = ("name", "label", "description", "aria_label", "placeholder", "element_name", "element_id", "surrounding")
    e["combined"] = F.concat_ws(" ", *[F.nullif(e[k], F.lit("")) for k in order])
    best = D.element_candidate(element)
    first = D.bind(best, lambda b: F.when(b["confidence"] >= D.LEAST, F.struct(
        b["category"].alias("category"), b["subtype"].alias("subtype"), b["confidence"].alias("confidence"), b["token"].alias("token"),
        F.transform(b["matched"], lambda s: F.struct(F.lit("detector").alias("field"), s.alias("rule"))).alias("evidence")).cast(_OUT)))
    out = F.coalesce(first, *[_result(c, e) for c in CATEGORIES])
    return F.when(~D.is_control(element.get("type", none), element.get("role", none), element.get("tag", none)), out)


def candidate_id(result: Column, dom_id: Column) -> Column:
    """pii_<category or subtype>_<element>; elements without an id share "el"."""
    own = F.when(result["category"] == "GOV_ID", F.concat(F.lit("govid_"), F.lower(result["subtype"]))).otherwise(F.lower(result["category"]))
    return F.concat(F.lit("pii_"), own, F.lit("_"), F.coalesce(F.nullif(dom_id, F.lit("")), F.lit("el")))


def classify_all(elements: DataFrame, element: dict[str, Column], keys: list[str], ordinal: str = "ord", dom_id: str = "dom_id") -> DataFrame:
    """keys, ordinal, id, category, subtype, confidence, token, evidence: of each page's equal ids the first element."""
    own = elements.select(*keys, ordinal, F.col(dom_id).cast("string").alias("_dom"), classify(element).alias("r")).where("r is not null")
    own = own.withColumn("id", candidate_id(F.col("r"), F.col("_dom")))
    first = F.row_number().over(W.partitionBy(*keys, "id").orderBy(ordinal))
    return own.withColumn("_n", first).where("_n = 1").select(*keys, ordinal, "id", "r.*")


def likely_personal(element: dict[str, Column]) -> Column:
    return classify(element).isNotNull()
