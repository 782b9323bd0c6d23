"""Quality rules whose thresholds are risk-controlled, in DataFrame operations only.

Features of every whole text give signals that grow with badness.  Over labelled documents (quality 1: good,
0: bad) each (stratum, signal, cutoff of a fixed grid) counts the good documents that the cutoff would
reject.  A cutoff is certified where the exact binomial test rejects "it rejects a share above the limit
of good documents": P(Bin(n, limit) <= k) <= alpha / tests, with one test for each stratum, signal and
cutoff (Bonferroni).  A stratum's limit is shared out equally over its signals, so that all together they
falsely reject at most ``max_false_rejection`` of the stratum's good documents, with confidence 1 - alpha
over all strata.  Of the certified cutoffs the one that rejects the most bad documents is taken, the mildest
in a tie; where none is certified or none rejects a bad document, the signal rejects nothing there.

The grid is a parameter and no datum sets it, hence all labelled documents serve as the holdout.

Defined results: null text has no words, no lines and fails the base rules; null strata are a stratum of
their own; a label that is null or of no document counts nowhere, the labels of a repeated doc_id
count once with the smallest quality; empty tables give empty results.  Columns beside the named ones
are not read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table, words

#: signal -> (numerator, denominator, cutoffs): reject where numerator / denominator > cutoff.
GRID: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbol_ratio": ("n_symbols", "word_chars", (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3)),
    "shout_ratio": ("n_upper", "word_chars", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)),
    "bang_ratio": ("n_bangs", "n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    "dup_line_ratio": ("n_dup_lines", "n_lines", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6)),
    "repeat_ratio": ("n_repeat_words", "n_words", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3)),
}
MAX_FALSE_REJECTION, ALPHA, WINDOW = 0.02, 0.05, 8


def features(docs: DataFrame, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_bangs.

    Repeats are found inside the row: windows are hashed to 64 bits, and only texts in which two hashes are
    alike sort them.  No shuffle, and time in n log n of a text's words.
    """
    keep = keep or {}
    one = docs.select(*[c.alias(k) for k, c in keep.items()], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    one = one.withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]"))
    one = one.withColumn("_l", lines)
    spans = F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))
    one = one.withColumn("_h", F.when(F.size("_w") > WINDOW, spans).otherwise(F.array().cast("array<bigint>")))
    left = lambda chars: F.length(F.regexp_replace("_t", chars, "")).cast("bigint")
    one = one.select(
        *keep,
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        left("[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.size("_l").cast("bigint").alias("n_lines"),
        left(r"[^\p{Lu}]+").alias("n_upper"),
        left("[^!]+").alias("n_bangs"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"),
    )
    alike = lambda i, x: F.coalesce(F.get("_s", i)["h"] == x["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("_s", lambda x, i: alike(i - 1, x) | alike(i + 1, x)), lambda x: x["i"]))
    start = F.struct(F.lit(-(1 << 30)).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")))["n"]
    return one.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("_s")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _value(signal: str) -> Column:
    over, under, _ = GRID[signal]
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0))


def _binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), term by term in logarithms; 1 for k above the mean, which no test needs."""
    import math

    start = F.struct((n * math.log1p(-p)).alias("t"), F.exp(n * math.log1p(-p)).alias("s"))
    odds = math.log(p) - math.log1p(-p)

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i.cast("double")) + odds
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.aggregate(terms, start, step)["s"]))


def thresholds(labelled: DataFrame, stratum: str = "stratum", quality: str = "quality", max_false_rejection: float = MAX_FALSE_REJECTION, alpha: float = ALPHA) -> DataFrame:
    """(stratum, symbol_ratio, ...): the cutoff of each signal, null where it rejects nothing.

    One aggregation with map-side combining over the labelled rows; what follows has a row for each stratum,
    signal and cutoff.
    """
    good, hits = F.col(quality) == 1, []
    for signal, (_, _, cuts) in GRID.items():
        hits += [F.struct(F.lit(signal).alias("signal"), F.lit(c).alias("cut"), F.count_if((_value(signal) > c) & good).alias("k"), F.count_if((_value(signal) > c) & ~good).alias("caught")) for c in cuts]
    counts = labelled.groupBy(F.col(stratum).alias("stratum")).agg(F.count_if(good).alias("n"), F.array(*hits).alias("hits"))
    tests = counts.agg(F.count(F.lit(1)).alias("strata"))
    per_stratum = sum(len(cuts) for _, _, cuts in GRID.values())
    rows = counts.crossJoin(F.broadcast(tests)).select("stratum", "n", "strata", F.explode("hits").alias("h")).select("stratum", "n", "strata", "h.*")
    tail = _binomial_tail(F.col("n"), F.col("k"), max_false_rejection / len(GRID))
    sound = rows.where((F.col("n") > 0) & (F.col("caught") > 0)).where(tail * (F.col("strata") * per_stratum) <= alpha)
    best = sound.groupBy("stratum", "signal").agg(F.max_by("cut", F.struct("caught", "cut")).alias("cut"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("signal") == s, F.col("cut"))).alias(s) for s in GRID])


def label_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", name: str = "quality") -> DataFrame:
    """doc_id, the features, base_failed and kept of every row.

    Features are computed once, written to the shared folder, and read for both the fit and the verdict.
    """
    scratch = Scratch(docs.sparkSession, name)
    of = features(docs, text, {"doc_id": F.col(doc_id), "stratum": F.coalesce(F.col(stratum).cast("string"), F.lit("")), "no_stratum": F.col(stratum).isNull()})
    of = scratch.keep(of.withColumn("stratum", F.struct("no_stratum", "stratum")).drop("no_stratum"), "features")
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cut = thresholds(of.where(~base_failed()).join(marks, "doc_id"))
    cut = scratch.keep(cut.select(F.col("stratum").alias("_s"), *[F.col(s).alias(f"_{s}") for s in GRID]), "thresholds")
    out = of.join(cut, F.col("stratum") == F.col("_s"), "left").withColumn("base_failed", base_failed())
    over = F.lit(False)
    for s in GRID:
        over = over | F.coalesce(_value(s) > F.col(f"_{s}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~over).drop("_s", *[f"_{s}" for s in GRID])


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = label_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    import math

    p, tests = MAX_FALSE_REJECTION / len(GRID), sum(len(c) for _, _, c in GRID.values())
    value = {s: f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / {d} ELSE 0 END" for s, (n, d, _) in GRID.items()}
    grid = " UNION ALL ".join(f"SELECT '{s}' signal, CAST({c} AS DOUBLE) cut" for s, (_, _, cuts) in GRID.items() for c in cuts)
    long = " UNION ALL ".join(f"SELECT doc_id, stratum, no_stratum, quality, '{s}' signal, {v} v FROM marked" for s, v in value.items())
    over = " OR ".join(f"coalesce({v} > (SELECT max(cut) FROM best b WHERE b.stratum = f.stratum AND b.no_stratum = f.no_stratum AND b.signal = '{s}'), false)" for s, v in value.items())
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') stratum, lang IS NULL no_stratum, coalesce(text, '') t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x09-\x0D\x20]+'), lambda x: x <> '') w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) l, row_number() OVER () r FROM t),
win AS (SELECT r, unnest(range(1, len(w) - 6)) i, w FROM w WHERE len(w) > 8),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 7], ' ')) c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) n FROM (SELECT r, unnest(range(i, i + 8)) p FROM dup) GROUP BY r),
f0 AS (SELECT doc_id, stratum, no_stratum, CAST(len(w) AS BIGINT) n_words, CAST(length(array_to_string(w, '')) AS BIGINT) word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) n_dup_lines,
      CAST(len(l) AS BIGINT) n_lines, CAST(length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) n_upper,
      CAST(length(regexp_replace(t, '[^!]+', '', 'g')) AS BIGINT) n_bangs, CAST(coalesce(rep.n, 0) AS BIGINT) n_repeat_words
      FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed FROM f0),
marks AS (SELECT doc_id, min(quality) quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
marked AS (SELECT * FROM f JOIN marks USING (doc_id) WHERE NOT base_failed),
long AS ({long}), grid AS ({grid}),
cell AS (SELECT stratum, no_stratum, signal, cut, count(*) FILTER (quality = 1) n, count(*) FILTER (quality = 1 AND v > cut) k,
      count(*) FILTER (quality <> 1 AND v > cut) caught FROM long JOIN grid USING (signal) GROUP BY ALL),
strata AS (SELECT count(*) m FROM (SELECT DISTINCT stratum, no_stratum FROM marked)),
best AS (SELECT stratum, no_stratum, signal, arg_max(cut, caught * 1000 + cut) cut FROM cell, strata
      WHERE n > 0 AND caught > 0 AND k <= n * {p!r} AND m * {tests} * list_sum(list_transform(range(0, k + 1), lambda i:
      exp(CASE WHEN i = 0 THEN 0 ELSE lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) END + i * {math.log(p)!r} + (n - i) * {math.log1p(-p)!r}))) <= {ALPHA!r}
      GROUP BY stratum, no_stratum, signal)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) kept FROM f
"""


ORACLE = _oracle()
