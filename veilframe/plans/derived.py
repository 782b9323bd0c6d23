"""Inputs for operators whose kind the tables lack, as SQL that Spark and DuckDB read alike.

A name in braces is a table; ``inputs`` gives the frame, ``oracle`` the text with plain names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BRACES = re.compile(r"\{(\w+)\}")


def inputs(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in set(_BRACES.findall(sql))}
    return spark.sql(sql, **frames)


def oracle(sql: str) -> str:
    return _BRACES.sub(r"\1", sql)


def golden(spark: SparkSession, sf_dir: str, cases: list[dict]) -> DataFrame:
    """k and the cases' columns: case k % n for every customer k; what a case lacks is null."""
    names = list(dict.fromkeys(n for c in cases for n in c))
    at = F.col("c_custkey") % len(cases)
    columns = [F.get(F.array(*[F.lit(c.get(n)) for c in cases]), at.cast("int")).alias(n) for n in names]
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), *columns)


def expected(names: list[str], rows: list[tuple], kinds: dict[str, str] | None = None) -> str:
    """DuckDB SQL with the expected row of each case, written out by hand; NULL for None."""
    one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {', '.join(map(one, r))})" for i, r in enumerate(rows))
    cast = ", ".join(f"CAST({n} AS {(kinds or {}).get(n, 'VARCHAR')}) {n}" for n in names)
    return f"SELECT c_custkey k, {cast} FROM customer JOIN (VALUES {values}) e(i, {', '.join(names)}) ON c_custkey % {len(rows)} = i"


def letters(n: str, count: int) -> str:
    """``count`` letters from an integer expression."""
    return " || ".join(f"chr(CAST(65 + ({n} + {7 * i}) % {26 - i} AS INTEGER))" for i in range(count))


def digits(n: str, count: int, factor: int = 7919) -> str:
    return f"lpad(CAST(({n} * {factor} + 13) % {10**count} AS STRING), {count}, '0')"


def spaced(s: str, *cuts: int, sep: str = " ") -> str:
    parts, at = [], 1
    for n in cuts:
        parts.append(f"substr({s}, {at}, {n})")
        at += n
    parts.append(f"substr({s}, {at})")
    return f" || '{sep}' || ".join(parts)


#: Boxes on pages: one per line item, a page per order.
BOXES = """SELECT l_orderkey cycle, l_linenumber ord, l_returnflag kind, CAST(l_partkey % 1280 AS DOUBLE) x, CAST(l_suppkey % 800 AS DOUBLE) y,
CAST(20 + l_quantity AS DOUBLE) w, CAST(20 + (l_partkey % 7) * 10 AS DOUBLE) h, CAST(0.5 + (l_partkey % 50) / 100.0 AS DOUBLE) conf FROM {lineitem}"""
#: The same with two orders of coordinates close to each other, so that boxes overlap.
CLOSE = """SELECT CAST(floor(l_orderkey / 8) AS BIGINT) cycle, CAST(row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 8) AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate) AS BIGINT) ord,
l_returnflag kind, CAST(l_partkey % 24 AS DOUBLE) x, CAST(l_suppkey % 16 AS DOUBLE) y, CAST(60 + l_quantity % 10 AS DOUBLE) w, CAST(50 + (l_partkey % 7) AS DOUBLE) h,
CAST(0.5 + (l_partkey % 50) / 100.0 AS DOUBLE) conf FROM {lineitem}"""
