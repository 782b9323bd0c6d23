"""Redaction of texts, the outbound scan, attestation, and labels for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import validators as V
from . import detectors as D


def redact_spans(text: Column, specs: Sequence[D.DetectorSpec] = D.DETECTORS) -> Column:
    """Every valid match of a detector in context by its token; the detector of higher priority goes first."""
    def one(spec: D.DetectorSpec, out: Column, x: Column) -> Column:
        def redacted(t: Column) -> Column:
            gate = t.rlike("|".join(P.spark(k) for k in spec.patterns)) & ~D.vetoed(spec, x["sem"], x["text"])
            if spec.required:
                gate = gate & D.has_context(spec, x["sem"])
            return F.when(gate, F.aggregate(D.values(spec, t, x["sem"]), t, lambda a, v: F.replace(a, v, F.lit(spec.token)))).otherwise(t)

        return D.bind(out, redacted)

    def whole(x: Column) -> Column:
        out = x["text"]
        for spec in sorted((s for s in specs if s.patterns), key=lambda s: -s.priority):
            out = one(spec, out, x)
        return out

    text = F.coalesce(text, F.lit(""))
    return D.bind(F.struct(text.alias("text"), F.lower(text).alias("sem")), whole)


def redact_region(text: Column, specs: Sequence[D.DetectorSpec] = D.DETECTORS) -> Column:
    """Candidate by candidate: the first occurrence of its value, or the whole text when that's gone by then."""
    def whole(text: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            value = F.when(c["at"].isNotNull(), F.substring(text, c["at"] + 1, c["length"]))
            return D.bind(F.coalesce(F.position(value, acc), F.lit(0)), lambda at: F.when(at > 0, F.overlay(acc, c["token"], at, c["length"])).otherwise(c["token"]))

        return F.aggregate(D.text_candidates(text, specs=specs), text, step)

    return D.bind(F.coalesce(text, F.lit("")), whole)


def fallback(text: Column) -> Column:
    """Plain replacement by pattern, where nothing else matched."""
    for key, token in (("AADHAAR", "<REDACTED_AADHAAR>"), ("PAN", "<REDACTED_PAN>"), ("EMAIL", "<EMAIL>"), ("PHONE_IN_LOOSE", "<PHONE>")):
        text = F.regexp_replace(text, P.spark(key), token)
    return text


_SPAN = "array<struct<kind:string,start:int,stop:int>>"


def outbound_scan(text: Column) -> Column:
    """array<struct<kind, start, stop>>, half open from 0; texts with a placeholder pass."""
    def span(kind: str, value: Column) -> Column:
        at = F.position(value, text)
        return F.struct(F.lit(kind).alias("kind"), (at - 1).alias("start"), (at - 1 + F.length(value)).alias("stop"))

    every = lambda key: F.regexp_extract_all(text, F.lit(P.spark(key)), F.lit(0))
    mail = F.transform(F.slice(every("EMAIL"), 1, 1), lambda v: span("EMAIL", v))
    aadhaar = F.transform(F.filter(every("AADHAAR"), lambda v: V.verhoeff(v)), lambda v: span("AADHAAR", v))
    pan = F.transform(F.filter(every("PAN"), lambda v: V.pan_strict(v)), lambda v: span("PAN", v))
    sure = F.concat(mail, aadhaar, pan)
    phone = F.transform(F.slice(every("PHONE_IN_LOOSE"), 1, 1), lambda v: span("PHONE", v))
    found = F.when(F.size(sure) > 0, sure).otherwise(phone)
    return F.when(F.coalesce(text.rlike(P.spark("PLACEHOLDER")), F.lit(True)), F.array().cast(_SPAN)).otherwise(found)


def digest(body: Column) -> Column:
    return F.sha2(body, 256)


def intact(body: Column, own: Column) -> Column:
    """False for missing digests too."""
    return F.coalesce(F.sha2(body, 256) == F.lower(own), F.lit(False))


def canonical(fields: dict[str, Column]) -> Column:
    """JSON of an object with sorted keys; nulls are null."""
    out = [F.lit("{")]
    for i, k in enumerate(sorted(fields)):
        own = F.regexp_replace(F.to_json(F.array(fields[k])), r"^\[|\]$", "")
        out += [F.lit(("," if i else "") + f'"{k}":'), F.when(fields[k].isNull(), "null").otherwise(own)]
    return F.concat(*out, F.lit("}"))


def signed_ticket(payload: Column, secret: Column) -> Column:
    return F.sha2(F.concat(payload, secret), 256)


def label(subtype: Column) -> Column:
    """Labels by substring, in order."""
    own = F.lower(subtype)
    ladder = [("aadhaar", "Aadhaar"), ("pan", "PAN"), ("passport", "Passport"), ("voter", "Voter ID"), ("driving", "Driving licence"), ("ssn", "SSN"), ("email", "E-mail"), ("phone", "Phone"), ("card_security", "CVV"), ("card", "Card"), ("bank", "Bank account"), ("iban", "Bank account"), ("ifsc", "IFSC"), ("upi", "UPI"), ("address", "Address"), ("pincode", "Address"), ("dob", "Date of birth"), ("person", "Name"), ("face", "Face")]
    out = F.lit("Sensitive data")
    for key, name in reversed(ladder):
        out = F.when(own.contains(key), name).otherwise(out)
    return out
