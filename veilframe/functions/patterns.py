"""Identifier patterns: the Spark form and the RE2 form side by side.

Java's ``\\b`` knows Unicode letters, the forms here mean ASCII boundaries; hence lookarounds.  RE2 has none, but
its ``\\b`` is ASCII; where digits bound a pattern there, the neighbours are consumed and group 1 is taken.
"""

from __future__ import annotations

_L, _R = r"(?<!\w)", r"(?!\w)"


def _word(body: str, flags: str = "") -> tuple[str, str]:
    return f"{flags}{_L}{body}{_R}", rf"{flags}\b({body})\b"


#: Key -> (Spark form, RE2 form); the match is group 0 in Spark and group 1 in RE2.
PATTERNS: dict[str, tuple[str, str]] = {
    "AADHAAR": _word(r"[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}"),
    "PAN": _word(r"[A-Z]{3}[PCHFATBLJG][A-Z][\s-]?[0-9OIL]{4}[\s-]?[A-Z]", "(?i)"),
    "VOTER": _word(r"[A-Za-z]{3}\d{7}"),
    "PASSPORT_IN": _word(r"[A-PR-WYa-pr-wy]\d{7}"),
    "DL": _word(r"[A-Za-z]{2}[-\s]?\d{2}[-\s]?(?:19|20)\d{2}[-\s]?\d{7}"),
    "PHONE_IN": (r"(?<!\d)(?:(?:\+91|0)[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?!\d)", r"(?:^|\D)((?:(?:\+91|0)[\s-]?)?[6-9]\d{4}[\s-]?\d{5})(?:\D|$)"),
    "PHONE_IN_LOOSE": (r"(?<!\d)(?:(?:\+91|0)[\s-]?)?[6-9](?:[\s-]?\d){9}(?!\d)", r"(?:^|\D)((?:(?:\+91|0)[\s-]?)?[6-9](?:[\s-]?\d){9})(?:\D|$)"),
    "PHONE_INTL": (r"(?<!\w)\+(?!91(?!\w))[1-9](?:[\s().-]*\d){7,14}(?!\d)", r"(?:^|\W)(\+[1-9](?:[\s().-]*\d){7,14})(?:\D|$)"),
    "EMAIL": (r"(?<!\w)(?=\w)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?!\w)", r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"),
    "PIN": _word(r"[1-9]\d{5}"),
    "BANK": _word(r"\d{9,18}"),
    "IFSC": _word(r"[A-Za-z]{4}0[A-Za-z0-9]{6}"),
    "UPI": (r"(?<!\w)(?=\w)[a-zA-Z0-9._-]{2,64}@[a-zA-Z]{2,32}(?!\w)", r"\b([a-zA-Z0-9._-]{2,64}@[a-zA-Z]{2,32})\b"),
    "CARD_1": _word(r"(?:\d{4}[-\s]?){3}\d{1,4}"),
    "CARD_2": _word(r"\d{13,19}"),
    "SSN": (r"(?<!\d)(?:\d{3}-\d{2}-\d{4}|\d{9})(?!\d)", r"(?:^|\D)(\d{3}-\d{2}-\d{4}|\d{9})(?:\D|$)"),
    "NIN": _word(r"[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]", "(?i)"),
    "EIN": _word(r"\d{2}-\d{7}"),
    "IBAN": _word(r"[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}", "(?i)"),
    "SWIFT": _word(r"[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?", "(?i)"),
    "PASSPORT_INTL": _word(r"[A-Z0-9]{6,12}", "(?i)"),
    "CSC": _word(r"\d{3,4}"),
    "DOB": _word(r"(?:\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})"),
    "PLACEHOLDER": (r"<[A-Z_]+>", r"(<[A-Z_]+>)"),
}
#: White space as JavaScript's \s has it, for a character class.
JS_SPACE = r"\s   -     　﻿"


def spark(key: str) -> str:
    return PATTERNS[key][0]


def re2(key: str) -> str:
    return PATTERNS[key][1]
