"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a pre-token there is exactly one token that its encoding can end with. The encoder stores that
token for each prefix: it is the suffix token whose left neighbour, the stored token of the shorter prefix, may stand
beside it. Encodings are read off backwards. Appending bytes only adds entries, cutting only drops them, and an edit
recomputes entries until they agree with the old ones again.

Two tokens may stand side by side if merging their joined bytes never merges across the border. `Vocabulary.adjacent`
decides that by taking both tokens' merges back from the latest one and looking whether the pieces at the border would
have merged earlier.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespan.llm.frames import numbered, place
from lodespan.session import make_importable

#: Bytes that a worker keeps of encoded pre-tokens, of their beginnings, and of token pairs; beyond them it starts anew.
PIECE_BYTES, STEM_BYTES, PAIR_BYTES = 80_000_000, 24_000_000, 32_000_000
#: What an entry takes besides its letters and tokens: objects' heads and their places in a dictionary.
ENTRY_BYTES, PAIR_ENTRY = 220, 136
#: Beginnings of pre-tokens, in bytes, whose entries are kept for words that begin alike.
STEMS = (10, 7, 5)


class Vocabulary:
    """Ranks by token bytes, as in tiktoken files: a token's rank is its id and the order of its merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = list(map(len, self.tokens))
        self.longest = max(self.sizes, default=0)
        #: Every ending of a token, with its rank or -1: a search backwards from a byte stops where none fits.
        self.endings = {token[i:]: -1 for token in ranks for i in range(1, len(token))} | ranks
        self._halves: dict[int, tuple[int, int]] = {}
        self.beside: dict[int, bool] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))})

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this token."""
        if token not in self._halves:
            parts = [bytes([b]) for b in self.tokens[token]]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
                if rank >= token:
                    raise ValueError(f"token {token} can't be made by merges")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return self._halves[token]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the bytes of left and right, encoded together, give these two tokens again."""
        key = left << 32 | right
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) * PAIR_ENTRY >= PAIR_BYTES:
                self.beside.clear()
            known = self.beside[key] = self._separate(left, right)
        return known

    def _separate(self, left: int, right: int) -> bool:
        tokens, ranks, until = self.tokens, self.ranks, 1 << 62
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < until:
                return False
            # Of equal merges the left one comes first, so a tie takes back the right token.
            if left > right:
                if len(tokens[left]) == 1:
                    return True
                until, left = left, self.halves(left)[1]
            else:
                if len(tokens[right]) == 1:
                    if len(tokens[left]) == 1:
                        return True
                    until, left = left, self.halves(left)[1]
                    continue
                until, right = right + 1, self.halves(right)[0]

    def extend(self, data: bytes, last: list[int], size: int) -> None:
        """Adds to last, the last tokens of the shorter prefixes of data, those of the prefixes up to size bytes."""
        ending, beside, adjacent = self.endings.get, self.beside.get, self.adjacent
        for end in range(len(last) + 1, size + 1):
            start = end - 1
            while (token := ending(data[start:end])) is not None:
                if token >= 0 and (start == 0 or ((known := beside(last[start - 1] << 32 | token)) is None and adjacent(last[start - 1], token)) or known):
                    last.append(token)
                    break
                if start == 0:
                    raise ValueError(f"no token ends at byte {end}")
                start -= 1
            else:
                raise ValueError(f"no token ends at byte {end}")

    def spelled(self, last: list[int]) -> list[int]:
        """The tokens of the whole, read off backwards."""
        out, end, sizes = [], len(last), self.sizes
        while end:
            token = last[end - 1]
            out.append(token)
            end -= sizes[token]
        out.reverse()
        return out


class Prefixes:
    """The last token of each byte prefix of `data`; `last[i]` belongs to the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Adds bytes at the end; entries of the old prefixes stay."""
        self.data += more
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def cut(self, size: int) -> None:
        """Keeps the first size bytes."""
        self.data = self.data[:size]
        del self.last[size:]

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new in place of data[start:end]; returns how many entries had to be computed."""
        old, tail, done = self.last, self.data[end:], 0
        self.data, self.last = self.data[:start] + new + tail, old[:start]
        self.vocabulary.extend(self.data, self.last, start + len(new))
        done, same, shift = len(new), 0, end - start - len(new)
        while len(self.last) < len(self.data):
            self.vocabulary.extend(self.data, self.last, len(self.last) + 1)
            done += 1
            # After as many equal entries as the longest token has bytes, nothing before them matters any more.
            same = same + 1 if self.last[-1] == old[len(self.last) - 1 + shift] else 0
            if same >= self.vocabulary.longest:
                self.last += old[len(self.last) + shift :]
        return done

    def ids(self) -> list[int]:
        return self.vocabulary.spelled(self.last)


class _Pieces(dict):
    """Encodings of pre-tokens, made when first asked for; words that begin alike share the entries of their beginning."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.stems, self.bytes, self.stem_bytes = vocabulary, {}, 0, 0
        #: The generation before: what of it is asked for again moves on, the rest goes with the next change.
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self._made(piece)
        if len(piece) <= 64:
            if self.bytes >= PIECE_BYTES // 2:
                self.old = dict(self)
                self.clear()
                self.bytes = 0
            self[piece] = ids
            self.bytes += ENTRY_BYTES + 4 * len(piece) + 8 * len(ids)
        return ids

    def _made(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        if whole is not None:
            return (whole,)
        last = self._beginning(data)
        done = len(last)
        self.vocabulary.extend(data, last, len(data))
        for size in STEMS:
            if done < size < len(data):
                if self.stem_bytes >= STEM_BYTES:
                    self.stems.clear()
                    self.stem_bytes = 0
                self.stems[data[:size]] = last[:size]
                self.stem_bytes += ENTRY_BYTES + 9 * size
        return tuple(self.vocabulary.spelled(last))

    def _beginning(self, data: bytes) -> list[int]:
        for size in STEMS:
            if stem := self.stems.get(data[:size]):
                return stem[:]
        return []


class Encoder:
    """Encodes texts: each match of `pattern` separately; what no match covers is left out, as tiktoken does."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split, self._known = vocabulary, regex.compile(pattern).findall, _Pieces(vocabulary)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._known.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process: encoders and decoders share it."""
    return Vocabulary.read(path)


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(vocabulary(path), pattern)


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _encoded(texts: Iterable[str | None], enc: Encoder) -> pa.ListArray:
    lists = [enc.encode(t) if t else [] for t in texts]
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))))


def _decoded(lists: pa.ListArray, tokens: list[bytes]) -> pa.Array:
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).tolist(), list(accumulate(lists.value_lengths().fill_null(0).to_pylist(), initial=0))
    return pa.array([b"".join(map(tokens.__getitem__, flat[a:b])) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())


def _mapped(df: DataFrame, made: dict[str, T.DataType], function, drop: tuple[str, ...] = ()) -> DataFrame:
    """df without the columns drop, with the columns made that function gives for a batch; such columns are replaced."""
    make_importable(df.sparkSession)
    kept, inner = [c for c in df.columns if c not in made and c not in drop], numbered(df)
    names, new = [place(df, c) for c in kept], [f"made{i}" for i in range(len(made))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *function(batch)], [*names, *new])

    schema = T.StructType([inner.schema[n] for n in names] + [T.StructField(n, kind) for n, kind in zip(new, made.values(), strict=True)])
    return inner.mapInArrow(run, schema).toDF(*kept, *made)


_IDS = T.ArrayType(T.IntegerType(), True)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the array<int> column `ids`, the encoding of the whole `text`, to every row; a column of that name is replaced.

    Null and empty texts give an empty array; very long ones are encoded whole. Other columns, whatever their names, ties
    and repeated rows pass through; an empty table gives an empty table. path is read on the executors: a file installed
    with the tokenizers, the same on each.
    """
    content = place(df, text)
    return _mapped(df, {ids: _IDS}, lambda batch: [_encoded(batch.column(content).to_pylist(), encoder(path, pattern))])


def decode(df: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Adds the binary column `data`, the bytes of the tokens in `ids`, to every row; a null array gives no bytes.

    An id outside the vocabulary is an error. Other columns, whatever their names, ties and repeated rows pass through.
    """
    lists = place(df, ids)
    return _mapped(df, {data: T.BinaryType()}, lambda batch: [_decoded(batch.column(lists), vocabulary(path).tokens)])


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", data: str = "decoded") -> DataFrame:
    """df without `text`, with what encode gives for it and what decode gives for that, in one pass of one worker."""
    content = place(df, text)

    def both(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = _encoded(batch.column(content).to_pylist(), encoder(path, pattern))
        return [lists, _decoded(lists, vocabulary(path).tokens)]

    return _mapped(df, {ids: _IDS, data: T.BinaryType()}, both, drop=(text,))


def digests(df: DataFrame, path: str, pattern: str, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of documents, and the columns more of ids, decoded."""
    coded = round_trip(df.select("doc_id", "text"), path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )
