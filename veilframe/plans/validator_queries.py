"""Queries over the scalar validators, on identifiers derived from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import validators as V
from .derived import digits, inputs, letters, oracle, spaced

_K = "o_orderkey"
_PRODUCTS, _POWERS = V.verhoeff_tables()
_aadhaar = f"CAST(2 + {_K} % 8 AS STRING) || {digits(_K, 11)}"
_card = f"CAST(3 + {_K} % 4 AS STRING) || {digits(_K, 14, 104729)} || CAST({_K} % 10 AS STRING)"
_pan = f"{letters(_K, 3)} || substr('PCHFATBLJGXZ', CAST(1 + {_K} % 12 AS INTEGER), 1) || {letters(f'({_K} + 3)', 1)} || CASE WHEN {_K} % 4 = 0 THEN 'OI' || substr({digits(_K, 4)}, 1, 2) ELSE {digits(_K, 4)} END || {letters(f'({_K} + 5)', 1)}"
_voter = f"{letters(_K, 3)} || {digits(_K, 7)} || CASE WHEN {_K} % 5 = 0 THEN '9' ELSE '' END"
_passport = f"{letters(_K, 1)} || {digits(_K, 7)}"
_dl = f"substr('KADLMHTNXXUPZZ', CAST(1 + 2 * ({_K} % 7) AS INTEGER), 2) || CASE WHEN {_K} % 2 = 0 THEN '-' ELSE '' END || {digits(_K, 2)} || CAST(1940 + {_K} % 100 AS STRING) || {digits(_K, 7)}"
_ifsc = f"{letters(_K, 4)} || CASE WHEN {_K} % 3 = 0 THEN '1' ELSE '0' END || {digits(_K, 6)}"
_upi = f"{letters(_K, 4)} || CASE {_K} % 5 WHEN 0 THEN '@oksbi' WHEN 1 THEN '@paytm' WHEN 2 THEN '@mail.com' WHEN 3 THEN '@@x' ELSE '@unknownbank' END"
_iban = f"'GB' || {digits(_K, 2, 31)} || 'WEST' || {digits(_K, 14, 104729)} || CASE WHEN {_K} % 7 = 0 THEN '-1' ELSE '' END"
_ssn = f"CASE WHEN {_K} % 2 = 0 THEN {spaced(f'({digits(_K, 9, 99991)})', 3, 2, sep='-')} ELSE {digits(_K, 9, 99991)} END"
_mobile = f"CASE {_K} % 5 WHEN 0 THEN '+91 ' WHEN 1 THEN '91' WHEN 2 THEN '0' WHEN 3 THEN '' ELSE '+1' END || CAST(4 + {_K} % 6 AS STRING) || {digits(_K, 4)} || CASE WHEN {_K} % 2 = 0 THEN ' ' ELSE '' END || {digits(_K, 5, 31337)}"
_generic = f"CASE {_K} % 6 WHEN 0 THEN '10.0.' || CAST({_K} % 300 AS STRING) || '.7' WHEN 1 THEN 'ORD-' || {digits(_K, 10)} WHEN 2 THEN '2024-01-02T03:04:05Z' WHEN 3 THEN lpad(CAST({_K} AS STRING), 32, 'a') WHEN 4 THEN '12345678-1234-1234-1234-' || lpad(CAST({_K} AS STRING), 12, '0') ELSE 'name ' || CAST({_K} AS STRING) END"
_origin = f"CASE {_K} % 4 WHEN 0 THEN 'https://h' || CAST({_K} AS STRING) || '.example.com' WHEN 1 THEN 'http://localhost:8080' WHEN 2 THEN 'https://example.com/' ELSE 'ftp://example.com' END"
_script = f"CASE {_K} % 6 WHEN 0 THEN '<script >x' WHEN 1 THEN 'JavaScript:go' WHEN 2 THEN 'eval (1)' WHEN 3 THEN 'medieval (1)' WHEN 4 THEN 'new Function(x)' ELSE 'plain text ' || CAST({_K} AS STRING) END"
_key = f"CASE {_K} % 5 WHEN 0 THEN 'Enter' WHEN 1 THEN 'ArrowUp' WHEN 2 THEN 'Delete' WHEN 3 THEN 'F5' ELSE 'Backspace' END"


def _fmt(s: str) -> str:
    return f"CASE {_K} % 3 WHEN 0 THEN {s} WHEN 1 THEN {spaced(f'({s})', 4, 4)} ELSE {spaced(f'({s})', 4, 4, sep='-')} END"


_CLEAN = r"regexp_replace(s, '[\s-]', '', 'g')"
_verhoeff = f"""CASE WHEN regexp_full_match({_CLEAN}, '[2-9]\\d{{11}}') THEN list_reduce(list_prepend(0, range(0, 12)), lambda c, i:
CAST(substr('{_PRODUCTS}', CAST(1 + c * 10 + CAST(substr('{_POWERS}', CAST(1 + (i % 8) * 10 + CAST(substr({_CLEAN}, CAST(12 - i AS BIGINT), 1) AS BIGINT) AS BIGINT), 1) AS BIGINT) AS BIGINT), 1) AS BIGINT)) = 0 ELSE false END"""
_luhn = f"""CASE WHEN regexp_full_match({_CLEAN}, '\\d{{13,19}}') THEN list_sum(list_transform(range(0, len({_CLEAN})), lambda i:
CASE WHEN i % 2 = 0 THEN CAST(substr({_CLEAN}, CAST(len({_CLEAN}) - i AS BIGINT), 1) AS BIGINT) ELSE
(2 * CAST(substr({_CLEAN}, CAST(len({_CLEAN}) - i AS BIGINT), 1) AS BIGINT)) // 10 + (2 * CAST(substr({_CLEAN}, CAST(len({_CLEAN}) - i AS BIGINT), 1) AS BIGINT)) % 10 END)) % 10 = 0 ELSE false END"""
_PANS = "regexp_replace(upper(s), '[^A-Z0-9]', '', 'g')"
_pan_fixed = f"CASE WHEN len({_PANS}) = 10 THEN substr({_PANS}, 1, 5) || translate(substr({_PANS}, 6, 4), 'OQILZSB', '0011258') || substr({_PANS}, 10) ELSE {_PANS} END"
_I = r"upper(regexp_replace(s, '\s', '', 'g'))"
_iban_ok = f"""CASE WHEN regexp_full_match({_I}, '[A-Z]{{2}}\\d{{2}}[A-Z0-9]{{11,30}}') THEN CAST(list_aggregate(list_transform(string_split(substr({_I}, 5) || substr({_I}, 1, 4), ''),
lambda ch: CASE WHEN ch BETWEEN '0' AND '9' THEN ch ELSE CAST(ord(ch) - 55 AS STRING) END), 'string_agg', '') AS HUGEINT) % 97 = 1 ELSE false END"""
_D = f"upper({_CLEAN})"
_dl_ok = f"""len({_D}) BETWEEN 15 AND 16 AND substr({_D}, 1, 2) IN ({', '.join(f"'{c}'" for c in V.STATE_CODES)}) AND regexp_full_match(substr({_D}, 3), '\\d{{13,14}}')
AND coalesce(TRY_CAST(substr({_D}, 5, 4) AS INTEGER) BETWEEN 1950 AND 2027, false)"""
_S = "replace(s, '-', '')"
_ssn_ok = f"regexp_full_match(s, '\\d{{3}}-\\d{{2}}-\\d{{4}}|\\d{{9}}') AND substr({_S}, 1, 3) NOT IN ('000', '666') AND substr({_S}, 1, 3) < '900' AND substr({_S}, 4, 2) <> '00' AND substr({_S}, 6, 4) <> '0000'"
_M = r"regexp_replace(s, '[\s()-]', '', 'g')"
_bare = f"CASE WHEN {_M} LIKE '+91%' THEN substr({_M}, 4) WHEN {_M} LIKE '91%' AND len({_M}) = 12 THEN substr({_M}, 3) WHEN {_M} LIKE '0%' AND len({_M}) = 11 THEN substr({_M}, 2) ELSE {_M} END"
_upi_ok = r"len(string_split(lower(s), '@')) = 2 AND regexp_full_match(string_split(lower(s), '@')[1], '[a-z0-9._-]{2,64}') AND regexp_full_match(string_split(lower(s), '@')[2], '[a-z0-9]{2,32}')"
_generic_ok = " OR ".join(f"regexp_matches(trim(s), '{p}')" for p in V.GENERIC)
_n = "length(regexp_replace(s, '\\D', '', 'g'))"

#: name -> (input expression, Spark function, DuckDB expression)
_CASES = {
    "b01_verhoeff": (_fmt(_aadhaar), V.verhoeff, _verhoeff),
    "b02_pan_repaired": (_pan, V.pan, f"regexp_full_match({_pan_fixed}, '[A-Z]{{3}}[{V.PAN_ENTITY_TYPES}][A-Z]\\d{{4}}[A-Z]')"),
    "b03_pan_strict": (_pan, V.pan_strict, f"regexp_full_match({_D}, '[A-Z]{{3}}[{V.PAN_ENTITY_TYPES}][A-Z]\\d{{4}}[A-Z]')"),
    "b04_voter": (_voter, V.voter, r"regexp_full_match(upper(trim(s)), '[A-Z]{3}\d{7}')"),
    "b05_passport_in": (_passport, V.passport_in, r"regexp_full_match(upper(trim(s)), '[A-PR-WY]\d{7}')"),
    "b06_driving_licence": (_dl, V.driving_licence, _dl_ok),
    "b07_luhn": (_fmt(_card), V.luhn, _luhn),
    "b08_ifsc": (_ifsc, V.ifsc, r"regexp_full_match(upper(trim(s)), '[A-Z]{4}0[A-Z0-9]{6}')"),
    "b09_upi": (_upi, V.upi, _upi_ok),
    "b10_upi_known": (_upi, V.upi_known, f"coalesce(string_split(lower(s), '@')[2] IN ({', '.join(repr(p) for p in V.UPI_PROVIDERS)}), false)"),
    "b11_iban97": (_iban, V.iban, _iban_ok),
    "b12_ssn": (_ssn, V.ssn, _ssn_ok),
    "b13_mobile_in": (_mobile, V.mobile_in, f"CASE WHEN regexp_full_match({_bare}, '[6-9]\\d{{9}}') THEN '+91' || {_bare} END"),
    "b14_phone_intl": (_mobile, V.phone_intl, f"{_n} BETWEEN 8 AND 15 AND NOT (regexp_replace(s, '\\D', '', 'g') LIKE '91%' AND {_n} = 12)"),
    "b15_generic_token": (_generic, V.generic_token, _generic_ok),
    "b16_origin": (_origin, V.origin, r"regexp_matches(s, '^https?://[a-zA-Z0-9.-]+(:\d+)?$')"),
    "b17_injection": (_script, V.injected, r"regexp_matches(s, '(?i)javascript:|<script[\s>]|\beval\s*\(|\bFunction\s*\(|\bwindow\.execScript\b')"),
    "b18_key_allowed": (_key, V.key_allowed, f"s IN ({', '.join(repr(k) for k in V.KEYS)})"),
    "b19_scroll_amount": (f"CAST({_K} % 1500 AS BIGINT)", V.scroll_amount, "CAST(least(greatest(s, 10), 1200) AS BIGINT)"),
}


def _query(sql: str, fn):
    return lambda spark, sf_dir: inputs(spark, sf_dir, sql).select("k", "s", fn(F.col("s")).alias("result"))


QUERIES, ORACLES = {}, {}
for _name, (_expr, _fn, _sql) in _CASES.items():
    _source = f"SELECT {_K} k, {_expr} s FROM {{orders}}"
    QUERIES[_name] = _query(_source, _fn)
    ORACLES[_name] = f"SELECT k, s, {_sql} AS result FROM ({oracle(_source)})"
