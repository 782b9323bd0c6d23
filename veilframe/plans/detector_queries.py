"""Queries over the detectors: one each on derived sentences, and all of them on the tables' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import detectors as D
from . import validator_queries as VQ
from .derived import digits, inputs, letters, oracle

_K = "o_orderkey"
_VALID = {
    "AADHAAR": VQ._verhoeff, "PAN": VQ._CASES["b02_pan_repaired"][2], "US_SSN": VQ._ssn_ok, "VOTER_ID": VQ._CASES["b04_voter"][2], "PASSPORT": VQ._CASES["b05_passport_in"][2],
    "DRIVING_LICENCE": VQ._dl_ok, "PASSPORT_INTL": "regexp_matches(s, '[0-9]')", "PHONE": f"regexp_full_match({VQ._bare}, '[6-9]\\d{{9}}')",
    "PHONE_INTL": f"({VQ._CASES['b14_phone_intl'][2]}) AND NOT regexp_matches(s, '^\\+91(\\W|$)')", "IBAN": VQ._iban_ok, "IFSC": VQ._CASES["b08_ifsc"][2], "UPI": VQ._upi_ok, "CARD": VQ._luhn,
}
#: A value that may be valid, for each subtype; and a phrase that gives context.
_VALUES = {
    "AADHAAR": (VQ._aadhaar, "uidai aadhaar"), "PAN": (VQ._pan, "pan card"), "US_SSN": (VQ._ssn, "ssn"), "UK_NIN": (f"'AB' || {digits(_K, 6)} || substr('ABCDE', CAST(1 + {_K} % 5 AS INTEGER), 1)", "insurance"),
    "US_EIN": (f"{digits(_K, 2)} || '-' || {digits(_K, 7)}", "the ein is"), "VOTER_ID": (f"CASE WHEN {_K} % 3 = 0 THEN lower({VQ._voter}) ELSE {VQ._voter} END", "voter epic"), "PASSPORT": (VQ._passport, "passport"),
    "DRIVING_LICENCE": (VQ._dl, "driving licence"), "PASSPORT_INTL": (f"'X' || {digits(_K, 8)}", "passport"), "PHONE": (f"CAST(5 + {_K} % 5 AS STRING) || {digits(_K, 4)} || ' ' || {digits(_K, 5, 31337)}", "mobile"),
    "PHONE_INTL": (f"'+4' || CAST({_K} % 10 AS STRING) || ' (20) ' || {digits(_K, 4)} || '-' || {digits(_K, 4, 31337)}", "call"), "EMAIL": (f"'user' || CAST({_K} AS STRING) || '@mail' || CAST({_K} % 7 AS STRING) || '.org'", "e-mail"),
    "PINCODE": (f"CAST({_K} % 3 AS STRING) || {digits(_K, 5)}", "postal code"), "IBAN": (VQ._iban, "iban:"), "BANK_ACCOUNT": (digits(_K, 12), "account number"), "IFSC": (VQ._ifsc, "ifsc"),
    "SWIFT_BIC": (f"{letters(_K, 6)} || 'FF' || {digits(_K, 3)}", "swift"), "UPI": (VQ._upi, "bhim"), "CARD": (VQ._card, "card number"), "CARD_SECURITY_CODE": (digits(_K, 3), "cvv"),
    "PERSON": ("'Ann Lee'", "full name"), "DOB": ("'1990-02-03'", "date of birth"),
}


def sentences(subtype: str) -> str:
    value, phrase = _VALUES[subtype]
    veto = {"PAN": "in japan ", "EMAIL": "voicemail ", "PINCODE": "ip address ", "PERSON": "file name ", "DOB": "release date ", "CARD": "wildcard ", "PHONE": "invite "}.get(subtype, "order ")
    return f"""SELECT {_K} k, CASE {_K} % 5 WHEN 0 THEN '{phrase} , ' || ({value}) || ' .' WHEN 1 THEN 'see ' || ({value}) || ' .' WHEN 2 THEN '{veto}{phrase} , ' || ({value}) || ' .'
WHEN 3 THEN '{phrase} , ' || ({value}) || ' , , ' || ({value}) || ' .' ELSE '{phrase} , none' END text FROM {{orders}}"""


def _regex(words: tuple[str, ...], tail: str = r"\b") -> str:
    return rf"regexp_matches(lower(text), '\b(?:{'|'.join(words)}){tail}')"


def sql(spec: D.DetectorSpec, source: str, keys: str) -> str:
    """DuckDB: keys, subtype, occurrence, confidence of one detector over ``source`` (keys and text)."""
    tests = [f"contains(lower(text), '{x}')" for x in spec.contains] + ([_regex(spec.words)] if spec.words else [])
    context = " OR ".join(tests) or "false"
    veto = " OR ".join(([_regex(spec.veto)] if spec.veto else []) + ([_regex(spec.veto_starts, "")] if spec.veto_starts else [])) or "false"
    valid = _VALID.get(spec.subtype, "true")
    found = [f"regexp_extract_all(text, '{P.re2(k)}', 1)" for k in spec.patterns]
    if spec.mode == "context":
        n = f"CASE WHEN {context} THEN 1 ELSE 0 END"
    elif spec.mode == "leading":
        n = f"coalesce(list_position(list_transform({found[0]}, lambda s: {valid}), false), len({found[0]}) + 1) - 1"
    else:
        keep = f"({valid}) AND (({context}) OR {VQ._CASES['b10_upi_known'][2]})" if spec.known else valid
        n = f"len(list_filter({found[0]}, lambda s: {keep}))"
        if spec.upper:
            good = f"list_filter({found[0]}, lambda s: {keep})"
            n = f"least(len({good}), coalesce(list_position(list_transform({good}, lambda s: s = upper(s)), false), len({good})))"
        for more in found[1:]:
            n = f"{n} + CASE WHEN {n} = len({found[0]}) THEN len(list_filter({more}, lambda s: ({valid}) AND NOT list_contains({found[0]}, s))) ELSE 0 END"
    gate = f"NOT ({VQ._generic_ok.replace('(s)', '(text)')}) AND NOT ({veto})" + (f" AND ({context})" if spec.required else "")
    confidence = f"{spec.with_context}" if spec.required else f"CASE WHEN {context} THEN {spec.with_context} ELSE {spec.without} END"
    return f"SELECT {keys}, '{spec.subtype}' subtype, CAST(unnest(range(0, least({n}, 100))) AS INTEGER) occurrence, CAST({confidence} AS DOUBLE) confidence FROM ({source}) WHERE {gate}"


def _one(spec: D.DetectorSpec):
    return lambda spark, sf_dir: D.detect_text(inputs(spark, sf_dir, sentences(spec.subtype)), ["k"], specs=[spec]).select("k", "subtype", "occurrence", "confidence")


QUERIES, ORACLES = {}, {}
for _i, _spec in enumerate(D.DETECTORS, 1):
    _name = f"c{_i:02d}_{_spec.subtype.lower()}"
    QUERIES[_name] = _one(_spec)
    ORACLES[_name] = sql(_spec, oracle(sentences(_spec.subtype)), "k")


def _all(source: str, keys: str) -> str:
    return " UNION ALL ".join(f"({sql(s, source, keys)})" for s in D.DETECTORS)


def detect_counts(spark, sf_dir):
    """Detections per subtype over all documents."""
    found = D.detect_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], at=False)
    return found.groupBy("subtype", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"), F.round(F.max("confidence"), 4).alias("most"))


def detect_by_lang_source(spark, sf_dir):
    found = D.detect_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["lang", "source"], at=False)
    return found.groupBy("lang", "source", "subtype").agg(F.count(F.lit(1)).alias("n"))


def conversations_scan(spark, sf_dir):
    return D.detect_text(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id", "turn"], at=False).select("conv_id", "turn", "subtype", "occurrence", "confidence")


_DOCS = "SELECT doc_id, lang, source, text FROM documents WHERE text <> ''"
_CATEGORY = "CASE subtype " + " ".join(f"WHEN '{s.subtype}' THEN '{s.category}'" for s in D.DETECTORS) + " END"
QUERIES |= {"q01_detect_counts": detect_counts, "q02_detect_by_lang_source": detect_by_lang_source, "d03_conversations_scan": conversations_scan}
ORACLES |= {
    "q01_detect_counts": f"SELECT subtype, {_CATEGORY} category, count(*) n, count(DISTINCT doc_id) docs, round(max(confidence), 4) most FROM ({_all(_DOCS, 'doc_id')}) GROUP BY ALL",
    "q02_detect_by_lang_source": f"SELECT lang, source, subtype, count(*) n FROM ({_all(_DOCS, 'lang, source')}) GROUP BY ALL",
    "d03_conversations_scan": _all("SELECT conv_id, turn, text FROM conversations WHERE text <> ''", "conv_id, turn"),
}


def cube_counts(spark, sf_dir):
    """The cube over category and source, an extension of the counts."""
    found = D.detect_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["source"], at=False)
    return found.cube("category", "source").agg(F.count(F.lit(1)).alias("n"))


QUERIES["i01_cube_counts"] = cube_counts
ORACLES["i01_cube_counts"] = f"SELECT category, source, count(*) n FROM (SELECT source, {_CATEGORY} category FROM ({_all(_DOCS, 'source')})) GROUP BY CUBE (category, source)"
