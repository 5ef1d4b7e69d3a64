"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A pre-token's forward score is the best total score of pieces that spell it. The score of a prefix depends on shorter
prefixes only, so pre-tokens that begin alike share it: they are inserted in a trie, each node's score and piece count is
computed once from its ancestors when the node is made, and a pre-token's count is that of its last node. The trie lives
in the Python worker for all of its tasks and is started anew when it holds NODES nodes, so memory is bounded.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodespan.session import make_importable

#: Nodes of a trie before it is started anew; a pre-token of more bytes than LONG is scored without being inserted.
NODES, LONG = 400_000, 64
#: What scores are multiplied by before rounding: sums of integers are exact, so ties are ties everywhere.
UNIT = 1 << 20


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Log-probabilities by Zipf's law of the ranks, in units of 1 / UNIT: a vocabulary file states no frequencies."""
    total = math.log(sum(1 / (r + 1) for r in ranks.values())) if ranks else 0.0
    return {piece: round(UNIT * (-math.log(rank + 1) - total)) for piece, rank in ranks.items()}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


class Trie:
    """Forward scores by prefix. Every single byte must be a piece, so that every byte string has a spelling."""

    def __init__(self, scores: dict[bytes, int], nodes: int = NODES):
        self.scores, self.limit = scores, nodes
        self.endings = {piece[i:]: None for piece in scores for i in range(1, len(piece))} | scores
        self.reset()

    def reset(self) -> None:
        self.children: dict[tuple[int, int], int] = {}
        #: Of each node: best score and the fewest pieces that reach it. Node 0 is the empty prefix.
        self.best, self.pieces = [0], [0]

    def _extend(self, data: bytes, end: int, path: list[int], best: list[int], pieces: list[int]) -> tuple[int, int]:
        """Score and pieces of data[:end] from those of the shorter prefixes at path."""
        top, count, start, ending = None, 0, end - 1, self.endings
        while start >= 0 and (piece := data[start:end]) in ending:
            score = ending[piece]
            if score is not None:
                total, number = best[path[start]] + score, pieces[path[start]] + 1
                if top is None or total > top or (total == top and number < count):
                    top, count = total, number
            start -= 1
        return top, count

    def count(self, data: bytes) -> int:
        """Pieces of the best spelling; of equally good ones, the fewest."""
        if len(data) > LONG:
            best, pieces = [0], [0]
            for end in range(1, len(data) + 1):
                top, number = self._extend(data, end, range(end), best, pieces)
                best.append(top)
                pieces.append(number)
            return pieces[-1]
        if len(self.best) + len(data) > self.limit:
            self.reset()
        node, path, children = 0, [0], self.children
        for end, byte in enumerate(data, 1):
            key = (node, byte)
            known = children.get(key)
            if known is None:
                top, number = self._extend(data, end, path, self.best, self.pieces)
                known = children[key] = len(self.best)
                self.best.append(top)
                self.pieces.append(number)
            node = known
            path.append(node)
        return self.pieces[node]


class Counts(dict):
    """Counts of pre-tokens: those seen are remembered, the terminal counts of the trie."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, piece: str) -> int:
        number = self.trie.count(piece.encode())
        if len(piece) <= LONG:
            if len(self) >= self.trie.limit // 2:
                self.clear()
            self[piece] = number
        return number


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> tuple[Counts, callable]:
    return Counts(Trie(zipf_scores(read_ranks(path)))), regex.compile(pattern).findall


def token_counts(df: DataFrame, path: str, pattern: str, text: str = "text", made: str = "n_tokens") -> DataFrame:
    """df without text, with n_tokens and n_pretokens (long) of the whole text; null and empty texts have none.

    path names a rank file whose pieces score by Zipf's law, the same file on every executor. Other columns pass
    through, but for columns of the two names; ties and repeated rows are counted each.
    """
    make_importable(df.sparkSession)
    names = [c for c in df.columns if c not in (text, made, "n_pretokens")]
    schema = T.StructType([df.schema[n] for n in names] + [T.StructField(made, T.LongType()), T.StructField("n_pretokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, split = counter(path, pattern)
        for batch in batches:
            tokens, pretokens = [], []
            for content in batch.column(text).to_pylist():
                pieces = split(content) if content else []
                pretokens.append(len(pieces))
                tokens.append(sum(map(counts.__getitem__, pieces)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(tokens, pa.int64()), pa.array(pretokens, pa.int64())], [*names, made, "n_pretokens"])

    return df.mapInArrow(run, schema)


def distinct_counts(texts: list[str], trie: Trie, pattern: str) -> Counter:
    """Counts of the distinct pre-tokens of texts, for inspection."""
    split, counts = regex.compile(pattern).findall, Counts(trie)
    return Counter({p: counts[p] for t in texts for p in split(t)})
