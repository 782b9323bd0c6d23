"""Language identification by word-first backoff.

A known word adds its log frequency in each language.  An unseen word falls back to its character 4-grams
(with marks for its ends); where none of them is known to 3-grams, then 2-grams, then single characters; the
mean over the known ones of that length stands for the word.  The language with the largest sum wins, and its
posterior under equal priors is the score.

The model is fitted on a bounded sample: about ``docs_per_lang`` labelled documents of each language, drawn by
hash of the id, whole texts; all their counts are kept, as packed arrays.  So what the driver holds and sends
out grows with the number of languages, not with that of documents.

Defined results: ``und`` with score 0 for null text, text without a letter, and where nothing was learned; ties
go to the language that sorts first.  Rows without a language or id teach nothing.  Repeated rows give repeated
results.  Only the named columns are read, and a prediction reads the text alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fraction_of, give_back, remainder, table, take_worker, tidy

UNKNOWN = "und"
#: Runs of letters (general category L; numerals and superscripts aren't).
WORD = regex.compile(r"\p{L}+")
GRAM = 4
#: Unseen words whose rows a worker keeps at most between chunks.
CACHE = 100_000


def grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)


class _Rows(dict):
    """word -> row of the words met so far; notes words that have no row yet.  The known ones are looked up, not copied."""

    def __init__(self, known: dict[str, int], fresh: list[str]):
        super().__init__()
        self.known, self.fresh, self.next = known, fresh, len(known)

    def __missing__(self, word: str) -> int:
        row = self.known.get(word)
        if row is None:
            row = self.next
            self.next += 1
            self.fresh.append(word)
        self[word] = row
        return row


class Scorer:
    """Scores texts with a model; keeps the rows of unseen words it has met, bounded by ``CACHE``."""

    def __init__(self, model: Model):
        self.model = model
        self._start()

    def _start(self) -> None:
        self.fresh: list[str] = []
        self.rows = _Rows(self.model.words, self.fresh)
        self.matrix = self.model.word_rows

    def _back_off(self, fresh: list[str]) -> np.ndarray:
        """Rows of unseen words: means over the longest known n-grams, all words at once for each length."""
        get, out = self.model.grams.get, np.zeros((len(fresh), len(self.model.langs)), np.float32)
        left = list(range(len(fresh)))
        for n in range(GRAM, 0, -1):
            at, owner, rest = [], [], []
            for i in left:
                known = [r for r in map(get, grams(fresh[i], n)) if r is not None]
                if known:
                    at += known
                    owner += [i] * len(known)
                else:
                    rest.append(i)
            if at:
                own = np.array(owner)
                begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                size = np.diff(np.r_[begin, len(own)])
                out[own[begin]] = np.add.reduceat(self.model.gram_rows[at], begin, axis=0) / size[:, None]
            left = rest
        return out

    def sums(self, words: list[list[str]]) -> np.ndarray:
        """[texts, languages]: summed log frequencies of the words of each text."""
        if self.rows.next - len(self.model.words) > CACHE:
            self._start()
        out = np.zeros((len(words), len(self.model.langs)), np.float64)
        size = np.array([len(w) for w in words])
        if not size.sum() or not self.model.langs:
            return out
        at = np.fromiter((r for own in words for r in map(self.rows.__getitem__, own)), np.int64, int(size.sum()))
        if self.fresh:
            self.matrix = np.concatenate([self.matrix, self._back_off(self.fresh)])
            self.fresh.clear()
        full = size > 0
        begin = np.cumsum(np.r_[0, size])[:-1][full]
        out[full] = np.add.reduceat(self.matrix[at].astype(np.float64), begin, axis=0)
        return out

    def predict_words(self, words: list[list[str]]) -> tuple[list[str], list[float]]:
        sums = self.sums(words)
        langs, scores = [], []
        for own, row in zip(words, sums, strict=True):
            if not own or not self.model.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(row.argmax())
            langs.append(self.model.langs[best])
            scores.append(float(1 / np.exp(np.minimum(row - row[best], 0)).sum()))
        return langs, scores

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        return self.predict_words([WORD.findall(t.lower()) for t in texts])


def from_counts(rows: list[tuple[str, int, str, int]]) -> Model:
    """A model of (language, n, token, count): n is 0 for words, else the n-gram's length."""
    import pyarrow as pa

    kinds = {"lang": pa.string(), "n": pa.int32(), "token": pa.string(), "c": pa.int64()}
    return from_table(pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(kinds.items())}))


def from_table(got) -> Model:
    """A model of the columns lang, n, token and c; each language has a token at most once."""
    names = got.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    at = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    n_of, c_of = got.column("n").to_numpy(), got.column("c").to_numpy()
    rows_of: list[tuple[dict[str, int], np.ndarray]] = []
    for kinds in ((0,), tuple(range(1, GRAM + 1))):
        own = np.flatnonzero(np.isin(n_of, kinds))
        coded = got.column("token").take(own).combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy()
        lang, n, c = at[own], n_of[own], c_of[own]
        kind = np.zeros(len(coded.dictionary), np.int64)
        kind[codes] = n
        logs = np.zeros((len(kind), len(langs)), np.float32)
        for k in kinds:
            part, has = kind == k, n == k
            total = np.maximum(np.bincount(lang[has], c[has], len(langs)) + 0.5 * part.sum(), 1)
            logs[part] = np.log(0.5 / total)
            logs[codes[has], lang[has]] = np.log((c[has] + 0.5) / total[lang[has]])
        rows_of.append(({t: i for i, t in enumerate(coded.dictionary.to_pylist())}, logs))
    return Model(langs, rows_of[0][0], rows_of[0][1], rows_of[1][0], rows_of[1][1])


def fit(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = 1500) -> Model:
    """Fit on the rows for which ``train`` holds."""
    import pyarrow as pa

    own = docs.where(train).where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    own = own.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    n = own.groupBy("lang").count().collect()
    if not n:
        return from_counts([])
    share = F
    for r in n:
        share = share.when(F.col("lang") == r["lang"], F.lit(min(1.0, docs_per_lang / r["count"])))
    own = own.where(fraction_of(F.col("doc_id"), share, "langid")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("langid", lambda: None)
        kept: dict[str, Counter] = {}
        for batch in batches:
            for lang_, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kept.setdefault(lang_, Counter()).update(WORD.findall(text_.lower()))
        for lang_, seen in kept.items():
            by_n: dict[int, Counter] = {n: Counter() for n in range(1, GRAM + 1)}
            for w, c in seen.items():
                for n_, counter in by_n.items():
                    for g in grams(w, n_):
                        counter[g] += c
            for n_, counter in {0: seen, **by_n}.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(counter), pa.string()), pa.array([n_] * len(counter), pa.int32()), pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], ["lang", "n", "token", "c"])

    counts = own.mapInArrow(tidy(count), "lang string, n int, token string, c long")
    model = from_table(counts.groupBy("lang", "n", "token").agg(F.sum("c").alias("c")).toArrow())
    give_back()
    return model


def predictor(spark, model: Model):
    """Column function text -> struct<lang, score>."""
    import pyarrow as pa

    sent = spark.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        take_worker("langid", lambda: None)
        scorer = sent.value.scorer()
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for own in chunks(x.as_py() for x in batch):
                a, b = scorer.predict(own)
                langs += a
                scores += b
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(tidy(run), kind)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs, rest = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 3)
    model = fit(docs, rest != 1)
    out = docs.select("doc_id", (rest == 1).alias("held_out"), predictor(spark, model)(F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
