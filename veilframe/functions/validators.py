"""Checksum and structure validators as Column functions; null in gives null or false out, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import JS_SPACE

#: Fixed values.
PAN_ENTITY_TYPES = "PCHFATBLJG"
STATE_CODES = ["AN", "AP", "AR", "AS", "BR", "CG", "CH", "DD", "DL", "DN", "GA", "GJ", "HR", "HP", "JH", "JK", "KA", "KL", "LA", "LD", "MH", "ML", "MN", "MP", "MZ", "NL", "OD", "PB", "PY", "RJ", "SK", "TN", "TR", "TS", "UK", "UP", "WB"]
UPI_PROVIDERS = ["okhdfcbank", "okaxis", "oksbi", "okicici", "paytm", "ybl", "ibl", "axl", "apl", "upi", "barodampay", "federal", "kotak", "indus", "icici", "sbi", "hdfcbank"]
KEYS = ["Enter", "Tab", "Escape", "Backspace", "ArrowUp", "ArrowDown", "ArrowLeft", "ArrowRight"]
INJECTION = r"(?i)javascript:|<script[\s>]|(?<!\w)eval\s*\(|(?<!\w)Function\s*\(|(?<!\w)window\.execScript(?!\w)"


def _dihedral(j: int, k: int) -> int:
    """The product in the dihedral group of order ten, rotations 0-4 and reflections 5-9."""
    if j < 5:
        return (j + k) % 5 if k < 5 else (j + k) % 5 + 5
    return (j - k) % 5 + 5 if k < 5 else (j - k) % 5


def verhoeff_tables() -> tuple[str, str]:
    """The products of digits, and the eight powers of the position permutation, as digit strings by row."""
    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([step[x] for x in powers[-1]])
    return "".join(str(_dihedral(j, k)) for j in range(10) for k in range(10)), "".join(str(x) for row in powers for x in row)


_PRODUCTS, _POWERS = verhoeff_tables()


def compact(c: Column, extra: str = "-") -> Column:
    """Without white space and the extra characters."""
    return F.regexp_replace(c, f"[{JS_SPACE}{extra}]", "")


def _digit(c: Column, at: Column) -> Column:
    return F.substring(c, at + 1, F.lit(1)).cast("int")


def verhoeff(c: Column) -> Column:
    clean = compact(c)

    def fold(check: Column, i: Column) -> Column:
        moved = _digit(F.lit(_POWERS), (i % 8) * 10 + _digit(clean, 11 - i))
        return _digit(F.lit(_PRODUCTS), check * 10 + moved)

    total = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), fold)
    return F.when(clean.rlike(r"^[2-9]\d{11}$"), total == 0).otherwise(False)


def pan_repaired(c: Column) -> Column:
    """Upper case letters and digits; in a text of ten, digits that were read as letters are put right."""
    clean = F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    fixed = F.concat(F.substring(clean, 1, 5), F.translate(F.substring(clean, 6, 4), "OQILZSB", "0011258"), F.substring(clean, 10, 1))
    return F.when(F.length(clean) == 10, fixed).otherwise(clean)


def pan(c: Column) -> Column:
    return F.coalesce(pan_repaired(c).rlike(f"^[A-Z]{{3}}[{PAN_ENTITY_TYPES}][A-Z]\\d{{4}}[A-Z]$"), F.lit(False))


def pan_strict(c: Column) -> Column:
    return F.coalesce(F.upper(compact(c)).rlike(f"^[A-Z]{{3}}[{PAN_ENTITY_TYPES}][A-Z]\\d{{4}}[A-Z]$"), F.lit(False))


def _whole(pattern: str):
    return lambda c: F.coalesce(F.upper(F.trim(c)).rlike(f"^{pattern}$"), F.lit(False))


voter = _whole(r"[A-Z]{3}\d{7}")
passport_in = _whole(r"[A-PR-WY]\d{7}")
ifsc = _whole(r"[A-Z]{4}0[A-Z0-9]{6}")


def driving_licence(c: Column, as_of_year: int = 2026) -> Column:
    """State code, 13 to 14 digits, and a year of issue from 1950 up to the year after ``as_of_year``."""
    clean = F.upper(compact(c))
    rest = F.substring(clean, 3, 20)
    year = F.substring(rest, 3, 4).try_cast("int")
    good = F.length(clean).between(15, 16) & F.substring(clean, 1, 2).isin(STATE_CODES) & rest.rlike(r"^\d{13,14}$") & year.between(1950, as_of_year + 1)
    return F.coalesce(good, F.lit(False))


def luhn(c: Column) -> Column:
    clean = compact(c)
    return F.when(clean.rlike(r"^\d{13,19}$"), F.call_function("luhn_check", clean)).otherwise(False)


def upi(c: Column) -> Column:
    parts = F.split(F.lower(F.trim(c)), "@", -1)
    good = (F.size(parts) == 2) & F.get(parts, 0).rlike(r"^[a-z0-9._-]{2,64}$") & F.get(parts, 1).rlike(r"^[a-z0-9]{2,32}$")
    return F.coalesce(good, F.lit(False))


def upi_known(c: Column) -> Column:
    return F.coalesce(F.get(F.split(F.lower(F.trim(c)), "@", -1), 1).isin(UPI_PROVIDERS), F.lit(False))


def iban(c: Column) -> Column:
    """Remainder 1 modulo 97, letters as 10 to 35; blanks only are dropped, so hyphens fail."""
    clean = F.upper(F.regexp_replace(c, f"[{JS_SPACE}]", ""))
    turned = F.concat(F.substring(clean, 5, 40), F.substring(clean, 1, 4))

    def fold(rest: Column, ch: Column) -> Column:
        n = F.when(ch.rlike("[0-9]"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)
        return (rest * F.when(n > 9, 100).otherwise(10) + n) % 97

    chars = F.filter(F.split(turned, ""), lambda x: x != "")
    return F.when(clean.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"), F.aggregate(chars, F.lit(0), fold) == 1).otherwise(False)


def ssn(c: Column) -> Column:
    digits = F.regexp_replace(c, "-", "")
    area, group, serial = F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4)
    good = c.rlike(r"^(?:\d{3}-\d{2}-\d{4}|\d{9})$") & ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    return F.coalesce(good, F.lit(False))


def mobile_in(c: Column) -> Column:
    """The normal form +91 and ten digits, or null."""
    clean = F.regexp_replace(c, f"[{JS_SPACE}()-]", "")
    bare = (
        F.when(clean.startswith("+91"), F.substring(clean, 4, 30))
        .when(clean.startswith("91") & (F.length(clean) == 12), F.substring(clean, 3, 30))
        .when(clean.startswith("0") & (F.length(clean) == 11), F.substring(clean, 2, 30))
        .otherwise(clean)
    )
    return F.when(bare.rlike(r"^[6-9]\d{9}$"), F.concat(F.lit("+91"), bare))


def phone_intl(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return F.coalesce(F.length(digits).between(8, 15) & ~(digits.startswith("91") & (F.length(digits) == 12)), F.lit(False))


#: Whole texts that are identifiers of things, not of persons.
GENERIC = [
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)^[0-9a-f]{32,64}$",
    r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    r"(?i)^(?:ord|order|track|tracking|inv|invoice|ref|sku|item|serial)[\s#_-][a-z0-9_-]+$",
]


def generic_token(c: Column) -> Column:
    own = F.trim(c)
    return F.coalesce(reduce(lambda a, b: a | b, [own.rlike(p) for p in GENERIC]), F.lit(False))


def origin(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https?://[a-zA-Z0-9.-]+(:\d+)?$"), F.lit(False))


def injected(c: Column) -> Column:
    return F.coalesce(c.rlike(INJECTION), F.lit(False))


def key_allowed(c: Column) -> Column:
    return F.coalesce(c.isin(KEYS), F.lit(False))


def scroll_amount(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(10)), F.lit(1200))
