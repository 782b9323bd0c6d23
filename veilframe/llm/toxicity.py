"""Toxicity by a convolutional text classifier trained in numpy.

Words (runs of letters, lower case) and their beginnings of 3 to 8 letters are hashed to 22 bits; hashes that at
least three training documents have own an embedding, all others the zero vector, and a word's embedding is
the sum over itself and its beginnings, so that inflected and compounded forms share what was learned.
Filters of widths 1, 2 and 3 run over the embedded words, the maximum of each over the whole text goes
through a rectifier to a logistic unit.  Training is Adam on the log loss, with gradients through the maxima
only.  As filters are linear before the maximum, what each offset of each filter adds for a word is worked out
once when the word is met, and kept; scoring adds shifted rows of these and takes maxima.

Thresholds are calibrated by language on a part of the sample that training doesn't see: for each language
as the word-first identifier tells it from the text, the cutoff with the fewest errors; languages with few toxic documents take the cutoff of all.  The score is the logistic of
logit minus cutoff, so 0.5 is the language's threshold.

The sample is bounded: about ``max_docs`` labelled documents, up to half of either class, drawn by hash of the
id, whole texts.  Training walks a batch in slices of ``SLICE`` words or one longer text, so its memory follows
the longest text, not the batch.  Scoring covers every whole text.

Defined results: an empty table of documents gives an empty result; null, empty and wordless texts score by the bias alone; without labels of both classes
every score is 0; labels repeated for a doc_id count once, as the largest.  Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import langid
from .common import chunks, fraction_of, give_back, remainder, table, take_worker, tidy

BITS, DIM, FILTERS, WIDTHS = 22, 8, 8, (1, 2, 3)
CACHE, LEARN = 200_000, 8192
#: Rows beyond ``CACHE`` for the new words of one chunk; more make the matrix grow.
SPARE = 1 << 16
#: Words that training embeds at once, but for a longer text.
SLICE = 1 << 14


def buckets(word: str) -> list[int]:
    """The hashes of a word and of its beginnings."""
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in (f"={word}", *(word[:k] for k in range(3, min(len(word), 8) + 1)))]


#: A word has no more hashes than this.
HASHES = 7


class _Packed:
    """hash -> row of the tables, from 1 on, as one sorted array."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes.astype(np.int32)

    def get(self, own: int) -> int | None:
        return int(self.find(np.array([own], np.int32))[0]) or None

    def find(self, own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        return np.where(self.hashes[at] == own, at + 1, 0)


@dataclass
class Model:
    rows: dict[int, int] | _Packed = field(default_factory=dict)  # hash -> row of the tables
    tables: np.ndarray | None = None  # [rows, offsets of all widths, FILTERS]; with ``conv`` embeddings [rows, DIM]
    bias: np.ndarray | None = None  # [filters]
    out: np.ndarray | None = None
    out_bias: float = 0.0
    cutoffs: dict[str, float] = field(default_factory=dict)
    cutoff: float = 0.0
    languages: langid.Model | None = None
    conv: np.ndarray | None = None  # [DIM, offsets of all widths, FILTERS]: what turns a summed embedding into responses


def _maxima(z: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[texts, filters]: the largest response of the windows that start in each text's rows from begin to end."""
    n, parts, at = len(z), [], 0
    bounds = np.stack([begin, end], 1).ravel()
    for w in WIDTHS:
        c = z[:, at].copy()
        for o in range(1, w):
            c[: n - o] += z[o:, at + o]
        at += w
        parts.append(np.maximum.reduceat(c, bounds, axis=0)[::2])
    return np.concatenate(parts, axis=1)


def _lay(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' rows end to end, zeros after each, and from where to where its windows start.

    Windows start in as many of the zeros as a window reaches beyond its first row, and the other half of the
    zeros ends them, so none sees the next text.
    """
    reach = max(WIDTHS) - 1
    size = np.array([len(x) + 2 * reach for x in ids])
    flat = np.zeros(size.sum(), np.int64)
    begin = np.cumsum(np.r_[0, size])[:-1]
    for b, x in zip(begin, ids, strict=True):
        flat[b : b + len(x)] = x
    return flat, begin, begin + size - reach


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def __call__(self, name: str, x: np.ndarray, g: np.ndarray) -> None:
        m = self.m.setdefault(name, np.zeros_like(x))
        v = self.v.setdefault(name, np.zeros_like(x))
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def _slices(own: np.ndarray, ids: list[np.ndarray]) -> Iterator[list[int]]:
    """The texts of a batch in order, in lists of about ``SLICE`` words; a longer text is alone."""
    part, size = [], 0
    for i in own.tolist():
        if part and size + len(ids[i]) > SLICE:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(ids[i])
    yield part


def indexed(texts: Iterable[list[str]]) -> tuple[list[np.ndarray], dict[str, int]]:
    """The texts as numbers of words from 1 on, and the words' numbers."""
    index: dict[str, int] = {}
    return [np.array([index.setdefault(w, len(index) + 1) for w in t], np.int32) for t in texts], index


def train(ids: list[np.ndarray], index: dict[str, int], labels: np.ndarray, epochs: int = 6, batch: int = 32, seed: int = 5, min_df: int = 3) -> Model:
    """Train on texts as numbers of words; labels 0 and 1, both present."""
    rng = np.random.default_rng(seed)
    hashes = np.full((len(index) + 1, HASHES), -1, np.int32)  # word 0 is the padding
    for w, i in index.items():
        own = buckets(w)
        hashes[i, : len(own)] = own
    every, flat_hash = np.unique(hashes, return_inverse=True)
    flat_hash = flat_hash.reshape(hashes.shape).astype(np.int32)
    del hashes
    df, pos = np.zeros(len(every)), np.zeros(len(every))
    for t, y in zip(ids, labels, strict=True):
        seen = np.unique(flat_hash[np.unique(t)])
        df[seen] += 1
        pos[seen] += y
    use = (df >= min_df) & (every >= 0)
    vocab = every[use]
    row = np.zeros(len(every), np.int32)
    row[use] = np.arange(1, len(vocab) + 1)
    feats = row[flat_hash]  # [words, HASHES]: rows of the embeddings, 0 for none
    del flat_hash
    df, pos = df[use], pos[use]
    n1, n0 = labels.sum(), (1 - labels).sum()
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((df - pos + 0.5) / (n0 + 1))
    odds /= np.sqrt(1 / (pos + 0.5) + 1 / (df - pos + 0.5))
    emb = np.r_[np.zeros((1, DIM)), 0.1 * rng.standard_normal((len(vocab), DIM))].astype(np.float32)
    emb[1:, 0] = odds / 4  # the first coordinate starts at the standardised log odds
    span, k = sum(WIDTHS), FILTERS * len(WIDTHS)
    conv = (0.3 * rng.standard_normal((DIM, span, FILTERS))).astype(np.float32)
    conv[0] = np.abs(conv[0])
    bias, out, out_bias = np.zeros(k), np.full(k, 0.3), np.array([-1.0])
    weight = np.where(labels == 1, len(labels) / (2 * max(n1, 1)), len(labels) / (2 * max(n0, 1)))
    first = np.cumsum(np.r_[0, WIDTHS])[:-1]
    adam = _Adam(0.01)
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            g_out, g_out_bias, g_bias = np.zeros(k), 0.0, np.zeros(k)
            g_conv, g_emb = np.zeros_like(conv), np.zeros_like(emb)
            for part in _slices(own, ids):
                flat, begin, end = _lay([ids[i] for i in part])
                x = emb[feats[flat, 0]]
                for j in range(1, HASHES):
                    x += emb[feats[flat, j]]
                z = np.tensordot(x, conv, 1)  # [n, span, FILTERS]
                n = len(flat)
                best, top = [], []
                for w, a in zip(WIDTHS, first, strict=True):
                    c = z[:, a].copy()
                    for o in range(1, w):
                        c[: n - o] += z[o:, a + o]
                    at = np.stack([b + c[b:e].argmax(0) for b, e in zip(begin, end, strict=True)])
                    best.append(at)
                    top.append(np.take_along_axis(c, at, 0))
                hidden = np.concatenate(top, 1) + bias
                act = np.maximum(hidden, 0)
                p = 1 / (1 + np.exp(-(act @ out + out_bias)))
                d = (p - labels[part]) * weight[part] / len(own)
                g_hidden = d[:, None] * out * (hidden > 0)
                for j, (w, a) in enumerate(zip(WIDTHS, first, strict=True)):
                    g, at = g_hidden[:, j * FILTERS : (j + 1) * FILTERS], best[j]
                    for o in range(w):
                        pos_ = np.minimum(at + o, n - 1)
                        g_conv[:, a + o] += np.einsum("nf,nfd->df", g, x[pos_])
                        own_feats = feats[flat[pos_]]
                        np.add.at(g_emb, own_feats, np.broadcast_to((g[:, :, None] * conv[:, a + o].T[None])[:, :, None], (*own_feats.shape, DIM)))
                g_out += act.T @ d
                g_out_bias += d.sum()
                g_bias += g_hidden.sum(0)
            g_emb[0] = 0
            adam.t += 1
            adam("out", out, g_out + 1e-4 * out)
            adam("out_bias", out_bias, np.array([g_out_bias]))
            adam("bias", bias, g_bias)
            adam("conv", conv, g_conv + 1e-4 * conv)
            adam("emb", emb, g_emb)
    return Model(_Packed(vocab), emb, bias.astype(np.float32), out.astype(np.float32), float(out_bias[0]), conv=conv) if len(vocab) else Model()


class _Rows(dict):
    """word -> row of the matrix of words met so far; row 0 is the padding.  Notes words without a row."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self) + 1
        self.fresh.append(word)
        return row


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.languages = model.languages.scorer() if model.languages else None
        self._start()

    def _start(self) -> None:
        self.rows, self.used = _Rows(), 1
        if self.model.tables is not None:
            kind = self.model.tables if self.model.conv is None else self.model.conv
            # The system gives zeroed pages when rows are first written, so unused room costs nothing and none is copied.
            self.matrix = np.zeros((CACHE + SPARE, *kind.shape[1:]), np.float32)

    def _learn(self, fresh: list[str]) -> None:
        """Sum the tables of new words over their hashes."""
        get, need = self.model.rows.get, self.used + len(fresh)
        if len(self.matrix) < need:
            more = max(len(self.matrix), need - len(self.matrix))
            self.matrix = np.concatenate([self.matrix, np.zeros((more, *self.matrix.shape[1:]), np.float32)])
        for lo in range(0, len(fresh), LEARN):  # few at once: a word takes up to HASHES rows of the tables
            own = [buckets(word) for word in fresh[lo : lo + LEARN]]
            owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
            every = np.array([h for x in own for h in x], np.int32)
            at = self.model.rows.find(every) if isinstance(self.model.rows, _Packed) else np.array([get(h) or 0 for h in every.tolist()], np.int64)
            at, owner = at[at > 0], owner[at > 0]
            if len(at):
                begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                sums = np.add.reduceat(self.model.tables[at], begin, axis=0)
                self.matrix[self.used + lo + owner[begin]] = sums if self.model.conv is None else np.tensordot(sums, self.model.conv, 1)
        self.used = need

    def logits(self, words: list[list[str]]) -> np.ndarray:
        if self.used > CACHE:
            self._start()
        get = self.rows.__getitem__
        rows = [np.fromiter(map(get, own), np.int64, len(own)) for own in words]
        if self.rows.fresh:
            self._learn(self.rows.fresh)
            self.rows.fresh.clear()
        return self.of_rows(rows)

    def of_rows(self, rows: list[np.ndarray]) -> np.ndarray:
        flat, begin, end = _lay(rows)
        act = np.maximum(_maxima(self.matrix[flat], begin, end) + self.model.bias, 0)
        return (act * self.model.out).sum(1) + self.model.out_bias  # row by row: a product's last bits depend on the other rows

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.model.tables is None:
            return np.zeros(len(texts))
        words = [langid.WORD.findall(t.lower()) for t in texts]
        logit = self.logits(words).astype(np.float64)
        if self.languages:
            langs = self.languages.predict_words(words)[0]
            logit -= np.array([self.model.cutoffs.get(lang, self.model.cutoff) for lang in langs])
        else:
            logit -= self.model.cutoff
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def best_cutoff(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cutoff with the fewest errors: of equals the widest gap, a third of the way up from its clean side."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], labels[order]
    errors = np.r_[0, np.cumsum(y)] + np.r_[(1 - y).sum(), (1 - y).sum() - np.cumsum(1 - y)]
    low, high = np.r_[x[0] - 1, x], np.r_[x, x[-1] + 1]
    gap = np.where(errors == errors.min(), high - low, -1.0)
    at = int(gap.argmax())
    return float(low[at] + (high[at] - low[at]) / 3)


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", languages: langid.Model | None = None, max_docs: int = 6000, min_positive: int = 10) -> Model:
    """Fit on labelled rows for which ``train_rows`` (over ``doc_id``) holds."""
    import pyarrow as pa

    marks = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("y")).where(train_rows)
    n = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(n) < 2:
        return Model(languages=languages)
    share = F.when(F.col("y") == 1, F.lit(min(1.0, max_docs / 2 / n[1]))).otherwise(F.lit(min(1.0, max_docs / 2 / n[0])))
    marks = marks.where(fraction_of(F.col("doc_id"), share, "toxicity"))
    # About max_docs narrow rows whatever the input: sent to every task, so that texts stay where they are.
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(marks), "doc_id")

    sent = docs.sparkSession.sparkContext.broadcast(languages)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("toxicity", lambda: None)
        scorer = sent.value.scorer() if sent.value else None
        for batch in batches:
            done = 0
            for own in chunks(x.as_py() for x in batch.column(1)):
                found = [langid.WORD.findall(t.lower()) for t in own]
                langs = scorer.predict_words(found)[0] if scorer else [""] * len(own)
                ids_, y_ = batch.column(0).slice(done, len(own)), batch.column(2).slice(done, len(own))
                done += len(own)
                yield pa.RecordBatch.from_arrays([ids_, pa.array(map(" ".join, found), pa.string()), y_, pa.array(langs, pa.string())], ["doc_id", "h", "y", "lang"])

    id_type = own.schema["doc_id"].dataType.simpleString()
    rows = own.select("doc_id", "text", F.col("y").cast("int").alias("y")).mapInArrow(tidy(hashed), f"doc_id {id_type}, h string, y int, lang string").toPandas()
    sent.unpersist()
    rows = rows.sort_values(["doc_id", "h"], kind="stable").drop_duplicates("doc_id")
    part = np.array([zlib.crc32(f"part {i}".encode()) % 10 < 3 for i in rows["doc_id"]], bool)
    y, langs = rows["y"].to_numpy(np.int64), rows["lang"].to_numpy()
    texts, index = indexed(h.split() for h in rows.pop("h"))
    if len(set(y[~part])) < 2:
        part[:] = False
    if len(set(y[~part])) < 2:
        return Model(languages=languages)
    model = train([t for t, p in zip(texts, part, strict=True) if not p], index, y[~part])
    model.languages = languages
    check = part if len(set(y[part])) == 2 else ~part
    # Only the words of the part that calibrates: the scorer's rows from 1 on, in the order of their numbers.
    texts, y, langs = [t for t, c in zip(texts, check, strict=True) if c], y[check], langs[check]
    used, names = np.unique(np.concatenate(texts)), list(index)
    own = Scorer(model)
    own._learn([names[i - 1] for i in used.tolist()])
    logit = np.concatenate([own.of_rows([np.searchsorted(used, t) + 1 for t in texts[lo : lo + 32]]) for lo in range(0, len(y), 32)])
    model.cutoff = best_cutoff(logit, y)
    for lang in sorted(set(langs)):
        at = langs == lang
        if y[at].sum() >= min_positive and (1 - y[at]).sum() >= min_positive:
            model.cutoffs[lang] = best_cutoff(logit[at], y[at])
    del own, texts, index, names, rows
    give_back()
    return model


def scorer(spark, model: Model):
    """Column function text -> score."""
    import pyarrow as pa

    sent = spark.sparkContext.broadcast(model)
    give_back()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        take_worker("toxicity", lambda: None)
        own = Scorer(sent.value)
        for batch in batches:
            parts = [own.scores(part) for part in chunks((x.as_py() for x in batch), 1 << 18)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(tidy(run), T.DoubleType())


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels, rest = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5)
    model = fit(docs, labels, rest != 0, languages=langid.fit(docs, rest != 0, docs_per_lang=500))
    out = docs.select("doc_id", (rest == 0).alias("held_out"), scorer(spark, model)(F.col("text")).alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
