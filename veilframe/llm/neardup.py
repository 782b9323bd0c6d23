"""Near-duplicates by MinHash with an inverted join over signature coordinates.

Documents with equal shingle sets are one class.  A class has K minima, its coordinates, and is posted under
each (coordinate, value) pair.  Two classes with at least ``match`` equal coordinates share one of the
K - match + 1 rarest pairs of either, so postings are cut to that prefix (rarest first over the whole corpus)
and the rest is skipped: it's only counted for candidates, from their signatures.  Passages that many
documents share are frequent pairs and thus stay outside the prefixes.

Pairs within a posting list aren't listed.  First each class meets a few pivots of its lists, the best of
them by count is confirmed on full sets, and confirmed links give components.  What is then left to find are
links between components.  Components that met without a confirmed link are laid next to each other, and
their classes dealt over blocks of bounded size and bytes; two blocks meet in one task if a list that isn't
settled has classes of both, and blocks of one component don't meet at all.  There the posting lists of one
block are merged for each class of the other: its K - match + 1 shortest lists are walked and their collisions
counted, the longer ones are skipped and only probed for the classes so found.  Pairs of different components
above the threshold are confirmed on full sets, and only links that join two components come out.  So copies
cost a few rows each however large their group, and no link between components is lost but by chance of the
signature: at a similarity of 0.85 a pair has fewer than 40 of 64 equal coordinates, and at 0.80 fewer than
36, at most five times in a million, and rarer above.

A class is known by the 128-bit fingerprint of its set, whatever the ids of its documents.  Full sets are
written once for classes that share a posting, and read for confirming.  Components are found by alternating
large-star and small-star rounds, each written to the shared folder.

Defined results: null and wordless texts have no shingle and link with nothing; with fewer than five words
the whole sequence is the one shingle; repeated rows are copies (the smallest id stands for all); rows of one
id with different texts are documents of their own, each with its own class; rows without an id are kept and
link with nothing; empty tables give empty results.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, table, take_worker, tidy

K, SHINGLE, SEED = 64, 5, 7
#: Links need 100 * intersection >= percent * union; without another threshold this one.
PERCENT = 85
#: The equal coordinates that a candidate needs, by percent: a pair at the threshold has fewer at most five times in a million.
MATCH = {80: 36, 85: 40}
PIVOTS, JUMPS = 3, 4
#: Classes, and bytes of sets, that a block has about.
BLOCK, BLOCK_BYTES = 192, 16 << 20
#: Word hashes that a worker keeps at most.
CACHE = 300_000

_M = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit multiplicative hash; a bijection."""
    x = (x ^ (x >> _M(33))) * _M(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _M(33))) * _M(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _M(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def forget_words() -> None:
    """Empties the worker's own cache: a function of the module is sent by name, ``_words.clear`` would go with a copy."""
    _words.clear()


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit fingerprints of a text's shingles.

    ASCII-lowering bytes and splitting them at ASCII white space gives exactly the words of the contract.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(_words) > CACHE:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    n = len(h)
    if n < SHINGLE:
        s = np.array([n], np.uint64)  # of its own kind for each length
        for x in h:
            s = _mix(s * _M(0x9E3779B97F4A7C15) + x)
        return s
    s = h[: n - SHINGLE + 1]
    for j in range(1, SHINGLE):
        s = _mix(s * _M(0x9E3779B97F4A7C15) + h[j : n - SHINGLE + 1 + j])
    return np.unique(s)


_rng = np.random.default_rng(SEED)
_A, _B = _rng.integers(1, 2**63, K, dtype=np.uint64) * _M(2) + _M(1), _rng.integers(0, 2**63, K, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[sets, K] 32-bit minima; sets aren't empty."""
    out = np.empty((len(sets), K), np.int32)
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *map(len, sets)])[:-1]
    for k in range(K):
        out[:, k] = (np.minimum.reduceat(flat * _A[k] + _B[k], begin) >> _M(32)).astype(np.uint32).view(np.int32)
    return out


def _shingled(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text -> doc_id, text_hash, n, key (a 128-bit fingerprint of the set) and sig."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("neardup", forget_words)
        for batch in batches:
            done = 0
            for own in chunks((x.as_py() for x in batch.column(2)), 1 << 21):
                sets = [shingle_set(t) for t in own]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                        sig[i] = row
                key = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                front = [batch.column(j).slice(done, len(own)) for j in (0, 1)]
                done += len(own)
                yield pa.RecordBatch.from_arrays([*front, pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "text_hash", "n", "key", "sig"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(tidy(run), "doc_id long, text_hash long, n long, key binary, sig array<int>")


def _full_sets(docs: DataFrame) -> DataFrame:
    """c, key, text -> c and the set's bytes, of the texts whose set has the fingerprint ``key``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("neardup", forget_words)
        for batch in batches:
            done = 0
            for own in chunks((x.as_py() for x in batch.column(2)), 1 << 21):
                c, key = (batch.column(j).slice(done, len(own)).to_pylist() for j in (0, 1))
                done += len(own)
                raw = [shingle_set(t).tobytes() for t in own]
                at = [i for i, x in enumerate(raw) if xxhash.xxh3_128_digest(x) == key[i]]
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in at], pa.int64()), pa.array([raw[i] for i in at], pa.binary())], ["c", "last"])

    return docs.select("c", "key", "text").mapInArrow(tidy(run), "c long, last binary")


def _postings(classes: DataFrame, match: int) -> DataFrame:
    """(k, v, c): the prefix postings of classes (c, sig), without lists of one.

    Pairs that occur once come first in a prefix and lead nowhere, so they only shorten the rest.
    """
    every = classes.select("c", F.posexplode("sig").alias("k", "v"))
    often = every.groupBy("k", "v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    own = every.join(often, ["k", "v"]).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("f", "k", "v"))).alias("ps"))
    room = F.size("ps") + (K - match + 1 - K)
    return own.where(room > 0).select("c", F.explode(F.slice("ps", 1, room)).alias("p")).select("p.k", "p.v", "c")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: sets.select(F.col("c").alias(side), F.col("last").alias(f"set_{side}"))
    both = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _matching(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, m, near): pairs with their equal coordinates; near: as many as the threshold needs, and sizes that allow a link."""
    of = lambda side: classes.select(F.col("c").alias(side), F.col("sig").alias(f"sig_{side}"), F.col("n").alias(f"n_{side}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.select("a", "b", same.alias("m"), fits.alias("fits")).select("a", "b", "m", (F.col("fits") & (F.col("m") >= MATCH[percent])).alias("near"))


def components(links: DataFrame, scratch: Scratch, name: str, rounds: int = 200) -> DataFrame:
    """(c, root): the smallest node that each node of the links (a, b) reaches, by alternating star rounds.

    Rounds go on until nothing changes; that many as ``rounds`` mean an error and raise one.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    state = None
    for i in range(1, rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(low, F.col("u") == F.col("x"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = scratch.keep(small, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = new
        if state == now:
            break
        state = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = edges.select(F.col("v").alias("c")).distinct().withColumn("root", F.col("c"))
    return edges.select(F.col("u").alias("c"), F.col("v").alias("root")).unionByName(roots)


def _blocks(labelled: DataFrame, met: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, n, root, label, block): classes laid out so that those which may link share blocks.

    A component is laid beside the largest component that one of its classes met, and so on from there.  The members of the label's
    own component have blocks of their own, as those never meet each other.
    """
    sizes = labelled.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    of = lambda side: labelled.select(F.col("c").alias(side), F.col("root").alias(f"r_{side}"))
    cross = met.select("a", "b").join(of("a"), "a").join(of("b"), "b").where("r_a <> r_b").select("r_a", "r_b").distinct()
    size_of = lambda side: sizes.select(F.col("root").alias(f"r_{side}"), F.struct("size", "root").alias(f"s_{side}"))
    cross = cross.join(size_of("a"), "r_a").join(size_of("b"), "r_b")
    hooks = cross.groupBy(F.least("s_a", "s_b")["root"].alias("root")).agg(F.max(F.greatest("s_a", "s_b"))["root"].alias("label"))
    # Hooks lead to larger components only, so following them ends; each round doubles how far they lead.
    for i in range(JUMPS):
        hooks = scratch.keep(hooks, f"hooks{i}")
        onward = hooks.select(F.col("root").alias("label"), F.col("label").alias("next"))
        hooks = hooks.join(onward, "label", "left").select("root", F.coalesce("next", "label").alias("label"))
    own = labelled.join(hooks, "root", "left").withColumn("label", F.coalesce("label", "root"))
    own = own.withColumn("top", F.col("root") == F.col("label"))
    dealt = own.groupBy("label", "top").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).alias("nb"))
    own = own.join(dealt, ["label", "top"])
    block = F.xxhash64("label", "top", F.pmod(F.xxhash64(F.lit("block"), "c"), F.col("nb")))
    return own.select("c", "root", F.when(F.col("top"), F.col("label")).alias("alone"), block.alias("block"))


def _between(blocks: DataFrame, postings: DataFrame, sharing: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between roots, found block against block; never more than there are classes."""
    import pyarrow as pa

    lists = postings.join(blocks, "c")
    open_ = lists.groupBy("k", "v").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("k", "v")
    seen = lists.join(open_, ["k", "v"]).select("k", "v", "block", "alone").distinct()
    other = seen.select("k", "v", F.col("block").alias("block2"), F.col("alone").alias("alone2"))
    pairs = seen.join(other, ["k", "v"]).where("block <= block2 and (alone is null or not alone <=> alone2)").select("block", "block2").distinct()
    pairs = pairs.withColumn("pair", F.struct("block", "block2"))
    ends = pairs.select("pair", "block").unionByName(pairs.select("pair", F.col("block2").alias("block"))).distinct()
    rows = blocks.select("c", "root", "block").join(sharing, "c").join(sets, "c")
    rows = ends.join(rows, "block").select(F.xxhash64("pair").alias("pair"), (F.col("block") == F.col("pair.block")).alias("first"), (F.col("pair.block") == F.col("pair.block2")).alias("same"), "root", "n", "sig", "last")

    def run(group: pa.Table) -> pa.Table:
        return _meet(group, percent)

    return rows.groupBy("pair").applyInArrow(run, "a long, b long")


def _meet(group, percent: int = PERCENT) -> object:
    """Links between the roots of two blocks' classes, or of one block's; at most one for each root."""
    import pyarrow as pa

    match = MATCH[percent]
    first, same = np.array(group["first"].to_pylist(), bool), group["same"][0].as_py()
    root = group["root"].to_numpy()
    n = group["n"].to_numpy()
    sig = np.stack([np.asarray(x, np.int32) for x in group["sig"].to_pylist()])
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["last"].combine_chunks()]
    up = {int(r): int(r) for r in root}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    left = np.flatnonzero(first)
    right = left if same else np.flatnonzero(~first)
    # The posting lists of the right block, as one sorted array of (coordinate, value), and who is posted there.
    coordinate = np.arange(K, dtype=np.uint64) << _M(32)
    codes = sig.view(np.uint32).astype(np.uint64) | coordinate
    order = np.argsort(codes[right].ravel(), kind="stable")
    posted, owner = codes[right].ravel()[order], right[order // K]
    begin_of, end_of = (np.searchsorted(posted, codes[left].ravel(), side).reshape(-1, K) for side in ("left", "right"))
    shortest = np.argsort(end_of - begin_of, axis=1, kind="stable")
    a, b = [], []
    for at, i in enumerate(left):
        walked, skipped = shortest[at, : K - match + 1], shortest[at, K - match + 1 :]
        others, count = np.unique(np.concatenate([owner[begin_of[at, k] : end_of[at, k]] for k in walked]), return_counts=True)
        if same:
            later = others > i
            others, count = others[later], count[later]
        fits = 100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])
        others, count = others[fits], count[fits]
        if len(others):
            count = count + (sig[others][:, skipped] == sig[i, skipped]).sum(1)
            others = others[count >= match]
        if len(others):
            mine = find(int(root[i]))
            others = others[[find(int(r)) != mine for r in root[others]]]
        if not len(others):
            continue
        flat = np.concatenate([sets[j] for j in others])
        spot = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
        begin = np.cumsum(np.r_[0, n[others]])[:-1]
        both = np.add.reduceat((sets[i][spot] == flat).astype(np.int64), begin)
        for j in others[100 * both >= percent * (n[i] + n[others] - both)]:
            x, y = find(int(root[i])), find(int(root[j]))
            if x != y:
                up[x] = y
                a.append(int(root[i]))
                b.append(int(root[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, group, text_hash: one row per document.  ``percent`` is one of ``MATCH``.

    ``group`` numbers the linked classes within this run (null without shingles or id); ``text_hash`` is Spark's
    xxhash64 of the text, which tells rows of one id apart.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    shingled = scratch.keep(_shingled(own), "shingled")
    of = shingled.where("key is not null and doc_id is not null")
    classes = of.groupBy("key").agg(F.min("doc_id").alias("d"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # Numbers of classes: the table is written before anything reads them.
    classes = scratch.keep(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    postings = scratch.keep(_postings(classes, MATCH[percent]), "postings")
    sharing = scratch.keep(classes.join(postings.select("c").distinct(), "c"), "sharing")
    # Rows of a class's smallest id may have other texts too; sets are taken where the fingerprint is the class's.
    held = own.join(sharing.select(F.col("d").alias("doc_id"), "c", "key"), "doc_id").groupBy("doc_id", "c", "text_hash").agg(F.first("key").alias("key"), F.first("text").alias("text"))
    sets = scratch.keep(_full_sets(held), "sets")

    # Each class meets the pivots of its lists; its best match is confirmed.
    least = [F.min_by("c", F.xxhash64(F.lit(i), "c")).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = postings.groupBy("k", "v").agg(*least)
    met = postings.join(pivots, ["k", "v"]).select("c", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("p")).where("c <> p")
    met = met.groupBy(F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
    met = scratch.keep(_matching(met, sharing, percent), "met")
    near = met.where("near")
    ends = near.select(F.col("a").alias("x"), "a", "b", "m").unionByName(near.select(F.col("b").alias("x"), "a", "b", "m"))
    best = ends.groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("m", -F.col("a"), -F.col("b"))).alias("p")).select("p.*").distinct()
    links = scratch.keep(_confirm(best, sets, percent), "links")
    found = scratch.keep(components(links, scratch, "first"), "found")

    labelled = sharing.select("c", "n").join(found, "c", "left").select("c", "n", F.coalesce("root", "c").alias("root"))
    labelled = scratch.keep(labelled, "labelled")
    blocks = scratch.keep(_blocks(labelled, met, scratch), "blocks")
    more = scratch.keep(_between(blocks, postings, sharing, sets, percent), "more")
    roots = scratch.keep(components(more, scratch, "second").withColumnRenamed("c", "r").withColumnRenamed("root", "r2"), "roots")
    final = labelled.join(roots, F.col("root") == F.col("r"), "left").select("c", F.coalesce("r2", "root").alias("root"))
    grouped = classes.select("c", "d", "key").join(final, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = grouped.groupBy("root").agg(F.min("d").alias("component"))
    grouped = scratch.keep(grouped.join(least, "root").select(F.col("key").alias("_k"), "root", "component"), "grouped")
    for name in ("classes", "postings", "sets", "sharing", "met", "links", "found", "labelled", "blocks", "more", "roots", *(f"hooks{i}" for i in range(JUMPS))):
        scratch.drop(name)

    has_id = F.col("doc_id").isNotNull()
    out = shingled.select("doc_id", "text_hash", "n", "key").join(grouped, F.col("key") == F.col("_k"), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(has_id, F.coalesce("component", "doc_id")).alias("component_id"), F.when(has_id, F.col("root")).alias("group"), "text_hash")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) s FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) m FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) n_shingles, r.c component_id, w.doc_id = r.c kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a doc_id, min(b) c FROM reach GROUP BY a) r USING (doc_id)
"""
