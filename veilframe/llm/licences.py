"""Licence scans by recognised sentences, in DataFrame operations.

A text is normalised (lower case, every run of other characters than a-z and 0-9 one blank) and cut after
. ! ? : ; before white space, at lines without a letter or digit, and at line ends; a known sentence stands between
two cuts and may run over line ends, so wrapped texts and one-line notices are both met.  Where sentences overlap
the first and longest counts.  Known ones get their identifier.  The identifiers of a text, in order, then meet licence
rules: a rule is a sequence of identifiers that stand next to each other among the known ones of a text; unknown
sentences between them don't matter.

Defined results: null and empty texts and texts without known sentences have empty lists; very long texts are
scanned whole; repeated rows give repeated results, empty tables empty ones; columns beside the named ones are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Who disclaims in the BSD texts.
_BSD = {"holders": "copyright holders and contributors", "holder": "copyright holder and contributors", "regents": "regents and contributors", "author": "author and contributors", "one": "author"}
#: Normalised sentences by identifier.
SENTENCES: dict[str, str] = {
    "apache-2.0-name": "licensed under the apache license version 2 0",
    "apache-2.0-grant": "licensed under the apache license version 2 0 the license",
    "apache-2.0-limit": "you may not use this file except in compliance with the license",
    "apache-2.0-copy": "you may obtain a copy of the license at",
    "mit-name": "released under the mit license",
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mit-title-long": "the mit license mit",
    "mit-licensed": "licensed under the mit license",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-3-name": "gnu general public license version 3",
    "gpl-3-licensed": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl-see": "see the gnu general public license for more details",
    "bsd-name": "released under the bsd license",
    "bsd-3-name": "licensed under the bsd 3 clause license",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-2-grant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-2-later": "either version 2 of the license or at your option any later version",
    "lgpl-free": "this library is free software",
    "lgpl-grant": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl-2.1-later": "either version 2 1 of the license or at your option any later version",
    "agpl-3-licensed": "licensed under the gnu affero general public license version 3",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "boost-line": "distributed under the boost software license version 1 0",
    "epl-2.0-name": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "isc-name": "licensed under the isc license",
    "mpl-2.0-name": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by-nc-4.0-name": "licensed under cc by nc 4 0",
    "cc-by-4.0-name": "licensed under cc by 4 0",
    "cc-by-sa-4.0-name": "licensed under cc by sa 4 0",
    "cc0-name": "licensed under cc0 1 0",
    "warranty-as-is": "the software is provided as is without warranty of any kind express or implied",
    "warranty-mit": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    **{f"warranty-bsd-{k}": f"this software is provided by the {who} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed" for k, who in _BSD.items()},
}
#: Licence rules: (rule, licence, sentence identifiers in order).
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("apache-2.0-line", "Apache-2.0", ("apache-2.0-name",)),
    ("apache-2.0-header", "Apache-2.0", ("apache-2.0-grant", "apache-2.0-limit", "apache-2.0-copy")),
    ("mit-line", "MIT", ("mit-name",)),
    ("mit-licensed-line", "MIT", ("mit-licensed",)),
    ("mit-text", "MIT", ("mit-title", "mit-notice", "warranty-as-is")),
    ("mit-text-short", "MIT", ("mit-title-short", "mit-notice", "warranty-as-is")),
    ("mit-whole-text", "MIT", ("mit-title", "mit-notice", "warranty-mit")),
    ("mit-whole-text-short", "MIT", ("mit-title-short", "mit-notice", "warranty-mit")),
    ("mit-whole-text-long", "MIT", ("mit-title-long", "mit-notice", "warranty-mit")),
    ("gpl-3-line", "GPL-3.0", ("gpl-3-work",)),
    ("gpl-3-name-line", "GPL-3.0", ("gpl-3-name",)),
    ("gpl-3-licensed-line", "GPL-3.0", ("gpl-3-licensed",)),
    ("gpl-header", "GPL", ("gpl-free", "gpl-see")),
    ("gpl-2-header", "GPL-2.0-or-later", ("gpl-free", "gpl-2-grant", "gpl-2-later", "gpl-see")),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", ("lgpl-free", "lgpl-grant", "lgpl-2.1-later")),
    ("agpl-3-line", "AGPL-3.0", ("agpl-3-licensed",)),
    ("isc-text", "ISC", ("isc-grant", "isc-warranty")),
    ("zlib-text", "Zlib", ("zlib-warranty", "zlib-grant")),
    ("boost-text", "BSL-1.0", ("boost-title",)),
    ("boost-line", "BSL-1.0", ("boost-line",)),
    ("epl-2.0-header", "EPL-2.0", ("epl-2.0-name",)),
    ("bsd-line", "BSD", ("bsd-name",)),
    ("bsd-3-line", "BSD-3-Clause", ("bsd-3-name",)),
    ("bsd-text", "BSD", ("bsd-conditions", "warranty-as-is")),
    *((f"bsd-whole-text-{k}", "BSD", ("bsd-conditions", f"warranty-bsd-{k}")) for k in _BSD),
    ("isc-line", "ISC", ("isc-name",)),
    ("mpl-2.0-line", "MPL-2.0", ("mpl-2.0-name",)),
    ("unlicense-line", "Unlicense", ("unlicense",)),
    ("cc-by-nc-4.0-line", "CC-BY-NC-4.0", ("cc-by-nc-4.0-name",)),
    ("cc-by-4.0-line", "CC-BY-4.0", ("cc-by-4.0-name",)),
    ("cc-by-sa-4.0-line", "CC-BY-SA-4.0", ("cc-by-sa-4.0-name",)),
    ("cc0-line", "CC0-1.0", ("cc0-name",)),
)
#: One of these words occurs in every sentence of SENTENCES, so other texts need no cutting.
_HINT = r"(?i)licen[cs]e|software|redistribut|permission|cc by|cc-by|cc0"
_CUT = r"[.!?:;]+(?=[\x09-\x0D\x20])"


def known_sentences(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of the known sentences of a text, in order; sentences of the caller's own are sought in every text."""
    table_ = F.create_map(*[F.lit(x) for key, s in sentences.items() for x in (s, key)])
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, _CUT, "\x01")), "[^a-z0-9\\n\x01]+", " ")
    plain = F.regexp_replace(plain, " *\\n(?: *\\n)+ *", "\x01")
    plain = F.trim(F.regexp_replace(plain, " *([\\n\x01]) *", "$1"))
    longest = sorted(sentences.values(), key=len, reverse=True)
    found = "(?<![^\\n\x01])(?:" + "|".join(s.replace(" ", "[ \\n]") for s in longest) + ")(?![^\\n\x01])"
    ids = F.transform(F.regexp_extract_all(plain, F.lit(found), F.lit(0)), lambda s: table_[F.translate(s, "\n", " ")])
    return F.when(text.rlike(_HINT), ids).otherwise(F.array().cast("array<string>")) if sentences is SENTENCES else ids


def matched_rules(ids: Column, rules=RULES) -> Column:
    """array<struct<rule, licence>> of the rules whose identifiers stand next to each other, in the rules' order."""
    row = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    hits = [F.when(row.contains(" " + " ".join(need) + " "), F.struct(F.lit(r).alias("rule"), F.lit(lic).alias("licence"))) for r, lic, need in rules]
    return F.when(F.size(ids) > 0, F.filter(F.array(*hits), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<rule:string,licence:string>>"))


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sentence_ids, rules, licences (distinct, sorted); narrow, without a shuffle."""
    one = docs.select(F.col(doc_id).alias("doc_id"), known_sentences(F.coalesce(F.col(text), F.lit(""))).alias("sentence_ids"))
    one = one.withColumn("_m", matched_rules(F.col("sentence_ids")))
    return one.select("doc_id", "sentence_ids", F.col("_m.rule").alias("rules"), F.array_sort(F.array_distinct("_m.licence")).alias("licences"))


def op8_licence_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_licences(table(spark, sf_dir, "documents"))
    join = lambda c: F.array_join(c, ",").alias(c)
    return out.select("doc_id", F.size("sentence_ids").cast("bigint").alias("n_sentences"), join("sentence_ids"), join("rules"), join("licences"))


def _oracle() -> str:
    known = ", ".join(f"('{s}', '{key}')" for key, s in SENTENCES.items())
    rules = ", ".join(f"({i}, '{r}', '{lic}', ' {' '.join(need)} ')" for i, (r, lic, need) in enumerate(RULES))
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () r, string_split(regexp_replace(coalesce(text, ''), '[.!?:;]+([\x09-\x0D\x20])', chr(10) || '\1', 'g'), chr(10)) s FROM documents),
s AS (SELECT r, unnest(s) s, generate_subscripts(s, 1) i FROM d),
known(s, id) AS (VALUES {known}), rules(n, rule, licence, need) AS (VALUES {rules}),
ids AS (SELECT r, list(id ORDER BY i) ids FROM s JOIN known ON trim(regexp_replace(lower(s.s), '[^a-z0-9]+', ' ', 'g')) = known.s GROUP BY r),
hit AS (SELECT r, list(rule ORDER BY n) rules, list_sort(list_distinct(list(licence))) lic FROM ids JOIN rules ON contains(' ' || array_to_string(ids, ' ') || ' ', need) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) n_sentences, coalesce(array_to_string(ids, ','), '') sentence_ids,
coalesce(array_to_string(rules, ','), '') rules, coalesce(array_to_string(lic, ','), '') licences
FROM d LEFT JOIN ids USING (r) LEFT JOIN hit USING (r)
"""


ORACLE = _oracle()
