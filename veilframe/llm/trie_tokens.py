"""Token counts by unigram segmentation, computed once per shared prefix in a trie.

A pre-token is "▁" and a word (a run without white space).  Its best segmentation maximises the sum of the
pieces' log probabilities; characters that no piece covers cost ``BYTE`` and count as the bytes of their UTF-8
form.  Distinct pre-tokens are inserted in a trie; a node holds the best score of its prefix and the number
of tokens of that segmentation, found from the nodes above it, so that words with a common beginning share
that work.  Where a word ends the count is stored.  Equal scores go to fewer tokens.

The vocabulary is a sentencepiece file, whose path is a parameter; its scores are ranks, so a piece of rank r
gets the log probability -ln(r + 2).  A worker's trie is started anew above ``NODES`` nodes, so memory is
bounded; no shuffle is needed and results don't depend on what is kept.

Defined results: null, empty and blank texts have no pre-token and no token; repeated rows give repeated
results; empty tables give empty ones; texts of any length are read whole.  Only the named columns are read.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, table

MARK, BYTE, NODES = "▁", -14.0, 800_000


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, float]:
    """Piece -> log probability, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: -math.log(r + 2) for r, p in enumerate(own)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Trie:
    """Prefixes of pre-tokens with their forward scores."""

    def __init__(self, vocab: dict[str, float]):
        self.vocab = vocab
        ends: dict[str, set[int]] = {}
        for p in vocab:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: tuple(sorted(v)) for k, v in ends.items()}  # of the pieces that end with two characters
        self.visited = 0  # nodes whose scores were computed, ever
        self._start()

    def _start(self) -> None:
        self.child: dict[int, int] = {}  # node * 2 ** 21 + character -> node
        self.score, self.count = [0.0], [0]
        self.ends: dict[str, int] = {}  # word -> terminal count

    def tokens(self, word: str) -> int:
        """The number of tokens of a pre-token."""
        n = self.ends.get(word)
        if n is None:
            n = self.ends[word] = self._insert(MARK + word)
        return n

    def _insert(self, word: str) -> int:
        child, score, count, get, lengths = self.child, self.score, self.count, self.vocab.get, self.lengths.get
        path, node = [0], 0
        for i, ch in enumerate(word, 1):
            key = node << 21 | ord(ch)
            new = child.get(key)
            if new is None:
                up = path[i - 1]
                one = get(ch)
                width = 1 if one is not None else len(ch.encode("utf-8", "surrogatepass"))
                best, n = score[up] + (BYTE * width if one is None else one), count[up] + width
                for k in lengths(word[i - 2 : i], ()):
                    if k > i:
                        break
                    p = get(word[i - k : i])
                    if p is not None:
                        s = score[path[i - k]] + p
                        if s > best or s == best and count[path[i - k]] + 1 < n:
                            best, n = s, count[path[i - k]] + 1
                new = child[key] = len(score)
                score.append(best)
                count.append(n)
                self.visited += 1
            path.append(new)
            node = new
        return count[node]

    def text(self, text: str) -> tuple[int, int, int]:
        """(pre-tokens, distinct pre-tokens, tokens) of a text."""
        if len(self.score) > NODES:
            self._start()
        seen = Counter(text.split())
        return sum(seen.values()), len(seen), sum(c * self.tokens(w) for w, c in seen.items())


def count_tokens(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_distinct, n_tokens."""
    import pyarrow as pa

    path = path or default_path()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(pieces(path))
        for batch in batches:
            rows = [trie.text(t) for own in chunks(x.as_py() for x in batch.column(1)) for t in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["doc_id", "n_pretokens", "n_distinct", "n_tokens"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_distinct long, n_tokens long")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
