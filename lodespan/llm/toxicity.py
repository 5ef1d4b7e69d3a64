"""Toxicity by nearest labelled examples: exact TF-IDF cosine, a block-max inverted index, and calibrated votes.

Terms are the words of the whole text in lower case and their beginnings of `BEGINNINGS` letters. A term weighs its number
of occurrences times its inverse document frequency among the examples; every term that two examples hold counts, whatever
their labels. Very common terms are the only exception: the frequency from which on a term weighs nothing is one of
`FLOORS`, the number of nearest examples that vote one of `NEIGHBOURS`: those with the least leave-one-out error.

Examples with one vector share an index entry that counts their labels. Entries lie in blocks; every term has its postings
by block and the greatest weight in each block. A search adds up these weights to each block's bound, scores the blocks
with the highest bounds, and then only those whose bound can reach the entries that it has, so its result is exact. The
nearest entries, until they stand for so many examples, vote with their similarity, which falls with the distance of
the two unit vectors; the vote is calibrated by isotonic regression on the examples' own votes, each without itself. A
document without any term gets the rate among examples without any.

The fit uses at most MOST_TOXIC and MOST_CLEAN examples, drawn by a hash of their ids, and weighs the two classes by their
true numbers. All else covers all documents. FLOORS, NEIGHBOURS and BEGINNINGS were chosen by five-fold cross-validation
among rows that aren't held out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespan.llm.frames import numbered, place
from lodespan.session import cut, make_importable

MOST_TOXIC, MOST_CLEAN = 2_000, 4_000
BEGINNINGS = (4, 6)
#: What the fit chooses from: shares of the examples from which on a term weighs nothing, and numbers of nearest examples.
FLOORS, NEIGHBOURS = (0.06, 0.25), (8, 50)
#: Examples that must hold a term, entries of a block, and the least number of examples per calibrated step.
LEAST, BLOCK, STEP = 2, 128, 5
#: Blocks that a search scores first, and the part of the postings from which on all are added up at once.
FIRST_BLOCKS, NEARLY_ALL = 2, 0.5
THRESHOLD, EVIDENCE = 0.3, 3

_words = re.compile(r"\w+").findall


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


class Vectors:
    """TF-IDF vectors over a vocabulary of terms with their inverse document frequencies."""

    def __init__(self, idf: dict[str, float]):
        self.idf = np.array(list(idf.values()), np.float64)
        places = np.arange(len(idf), dtype=np.int32).tobytes()
        number = {t: places[4 * i : 4 * i + 4] for i, t in enumerate(idf)}
        #: The bytes of each word's coordinate, and of each beginning's by length.
        self.words = {t: n for t, n in number.items() if t[-1] != "*"}
        self.beginnings = [(size, {t[:-1]: n for t, n in number.items() if t[-1] == "*" and len(t) == size + 1}) for size in BEGINNINGS]

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates, ascending, and weights of unit length (int32, float32); empty if no term occurs."""
        found, whole, beginnings = [], self.words.get, [(size, known.get) for size, known in self.beginnings]
        add = found.append
        for word in _words((text or "").lower()):
            add(whole(word, b""))
            for size, begin in beginnings:
                if len(word) <= size:
                    break
                add(begin(word[:size], b""))
        at, numbers = np.unique(np.frombuffer(b"".join(found), np.int32), return_counts=True)
        weights = numbers * self.idf[at]
        return at, (weights / max(math.sqrt(float(weights @ weights)), 1e-300)).astype(np.float32)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Index:
    """Entries are distinct vectors with the weight of their labelled and of all their examples, and one example's id."""

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray, float, float, int, int]], terms: int):
        # Coordinates are numbered from the commonest term down, so neighbours in this order are alike and bounds tight.
        entries = sorted(entries, key=lambda e: (*e[0][:6].tolist(), e[5]))
        self.toxic, self.weight = (np.array([e[k] for e in entries], np.float64) for k in (2, 3))
        self.examples, self.ids = np.array([e[4] for e in entries], np.int64), np.array([e[5] for e in entries], np.int64)
        self.blocks = -(-len(entries) // BLOCK)
        at = np.concatenate([e[0] for e in entries] or [np.empty(0, np.int32)])
        entry = np.repeat(np.arange(len(entries), dtype=np.int32), [len(e[0]) for e in entries])
        weights = np.concatenate([e[1] for e in entries] or [np.empty(0, np.float32)])
        order = np.argsort(at, kind="stable")  # postings of a term stay in the order of entries
        at, self.posted, self.weights = at[order], entry[order], weights[order]
        # A cell is a term in a block: its block, greatest weight and first posting; cells lie by term.
        block = self.posted // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (block[1:] != block[:-1])])) if len(at) else np.empty(0, np.int64)
        self.cell_block, self.cell_post = block[first], np.append(first, len(at)).astype(np.int32)
        self.cell_most = np.maximum.reduceat(self.weights, first) if len(at) else np.empty(0, np.float32)
        self.cells = np.searchsorted(at[first], np.arange(terms + 1)).astype(np.int32)
        #: Blocks scored by the last search.
        self.scored = 0

    def _cosines(self, first: np.ndarray, last: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Of every entry the sum of its weights in the ranges [first, last) of postings, each times the range's factor."""
        counts = last - first
        posts = _ranges(first, counts)
        return np.bincount(self.posted[posts], np.repeat(factors, counts) * self.weights[posts], len(self.ids))

    def nearest(self, at: np.ndarray, weights: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries and cosines, best first: the fewest that stand for `wanted` examples, and all that tie with the last."""
        self.scored = 0
        found, scores = np.empty(0, np.int64), np.empty(0)
        if not len(at) or not self.blocks:
            return found, scores
        weights = weights.astype(np.float64)
        begins, ends = self.cells[at], self.cells[at + 1]
        cells = _ranges(begins, ends - begins)
        query, block = np.repeat(weights, ends - begins), self.cell_block[cells]
        bounds = np.bincount(block, query * self.cell_most[cells], self.blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        if len(order) > FIRST_BLOCKS:
            sums = self._some(order[:FIRST_BLOCKS], cells, block, query)
            # An entry stands for an example at least, so the `wanted` best examples reach this.
            least = np.partition(sums, -wanted)[-wanted] if len(sums) > wanted else 0.0
            part = order[bounds[order] >= least - 1e-9]
        else:
            part, least = order, 0.0
        self.scored = len(part)
        if len(part) > NEARLY_ALL * len(order):  # ranges of whole terms are quicker than cells
            sums = self._cosines(self.cell_post[begins], self.cell_post[ends], weights)
        else:
            sums = self._some(part, cells, block, query)
        found = np.flatnonzero(sums > max(0.0, least - 1e-9))
        scores = sums[found]
        if len(scores) > wanted:
            kept = scores >= np.partition(scores, -wanted)[-wanted] - 1e-9
            found, scores = found[kept], scores[kept]
        best = np.lexsort((found, -scores))
        found, scores = found[best], scores[best]
        last = int(np.searchsorted(np.cumsum(self.examples[found]), wanted))
        if last < len(found):
            kept = scores >= scores[last] - 1e-9
            found, scores = found[kept], scores[kept]
        return found, scores

    def _some(self, blocks: np.ndarray, cells: np.ndarray, block: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Cosines of all entries, but 0 outside of blocks."""
        chosen = np.zeros(self.blocks, bool)
        chosen[blocks] = True
        some = np.flatnonzero(chosen[block])
        own = cells[some]
        return self._cosines(self.cell_post[own], self.cell_post[own + 1], query[some])


@dataclass
class Model:
    vectors: Vectors
    index: Index
    #: Votes at which a calibrated step begins, and its score.
    steps: tuple[np.ndarray, np.ndarray]
    #: Score of documents without terms.
    blank: float

    #: Examples that vote.
    neighbours: int = max(NEIGHBOURS)

    def score(self, vector: tuple[np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        """The calibrated vote, and the nearest entries with their cosines."""
        entries, scores = self.index.nearest(*vector, self.neighbours)
        share = _share(scores, self.index.toxic[entries], self.index.weight[entries])
        return (self.blank if share is None else float(calibrated(self.steps, share))), entries[:EVIDENCE], scores[:EVIDENCE]


def _share(scores: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float | None:
    whole = float(scores @ weight)
    return float(scores @ toxic) / whole if whole > 1e-12 else None


def own_votes(index: Index, at: np.ndarray, weights: np.ndarray, label: float, weight: float) -> list[float | None]:
    """An example's votes without itself, for each of NEIGHBOURS."""
    out: list[float | None] = []
    entries, scores = index.nearest(at, weights, max(NEIGHBOURS) + 1)
    toxic, whole, have = index.toxic[entries], index.weight[entries], np.cumsum(index.examples[entries])
    if len(entries):  # its own entry is the nearest
        toxic[0], whole[0] = max(0.0, toxic[0] - label * weight), max(0.0, whole[0] - weight)
    for wanted in NEIGHBOURS:
        last = int(np.searchsorted(have, wanted + 1))
        near = scores >= (scores[last] if last < len(scores) else 0.0) - 1e-9
        out.append(_share(scores[near], toxic[near], whole[near]))
    return out


def calibrated(steps: tuple[np.ndarray, np.ndarray], share: float | np.ndarray) -> np.ndarray:
    return steps[1][np.maximum(0, np.searchsorted(steps[0], share, side="right") - 1)]


def isotonic(points: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps through (x, label, weight): each step's beginning and mean label, of STEP points at least.

    STEP average points with the mean of all labels are added to each step, as a short step's own mean says little.
    """
    pools: list[list[float]] = []
    for x, label, weight in sorted(points):
        if pools and (pools[-1][3] < STEP or pools[-1][4] == x):
            last = pools[-1]
            last[1], last[2], last[3], last[4] = last[1] + label * weight, last[2] + weight, last[3] + 1, x
        else:
            pools.append([x, label * weight, weight, 1, x])
        while len(pools) > 1 and pools[-1][3] >= STEP and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + top[1], pools[-1][2] + top[2], pools[-1][3] + top[3], top[4]]
    if not pools:
        return np.zeros(1), np.zeros(1)
    whole = [sum(p[k] for p in pools) for k in (1, 2, 3)]
    label, weight = whole[0] / whole[2] * STEP, whole[1] / whole[2] * STEP
    means = np.maximum.accumulate([(p[1] + label) / (p[2] + weight) for p in pools])
    rising = np.append(True, np.diff(means) > 0)
    return np.array([p[0] for p in pools])[rising], means[rising]


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): numbers of texts with a term, added up as far as memory allows."""
    sums: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"term": list(sums), "toxic": pa.array([x[1] for x in sums.values()], pa.int64()), "clean": pa.array([x[0] for x in sums.values()], pa.int64())})
        sums.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for term in {t for word in set(_words((text or "").lower())) for t in terms_of(word)}:
                sums.setdefault(term, [0, 0])[label] += 1
            if len(sums) > 200_000:
                yield flush()
    yield flush()


def examples_of(documents: DataFrame, labels: DataFrame, key: str, text: str) -> tuple[DataFrame, dict[int, int]]:
    """(id, toxic, text), at most MOST_TOXIC + MOST_CLEAN rows, written; and the true numbers of both labels.

    An id with several labels takes the highest, one with several texts the first in code point order.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    usable = cut(usable, "usable")
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = None
    for label, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        part = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        drawn = part if drawn is None else drawn.unionAll(part)
    drawn = cut(drawn, "drawn")  # at most MOST_TOXIC + MOST_CLEAN ids and labels
    found = documents.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), "id")
    return cut(found.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text")), "examples"), totals


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """A model from the rows of labels (key, toxic 0/1) whose key isn't held out, and their documents' texts.

    Rows with a null label or without a document teach nothing. Without any toxic or any clean example every score is
    the rate of the label there is, or 0. Very long texts are taken whole.
    """
    make_importable(documents.sparkSession)
    examples, totals = examples_of(documents, labels, key, text)
    number = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = number.get(1, 0), number.get(0, 0)
    rate = totals.get(1, 0) / max(1, sum(totals.values()))
    if not toxic or not clean:
        return Model(Vectors({}), Index([], 0), (np.zeros(1), np.full(1, rate)), rate)
    weight = {1: totals[1] / toxic, 0: totals[0] / clean}
    tallied = examples.select("text", "toxic").mapInArrow(_tally, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("p"), F.sum("clean").alias("n"))
    share = (F.col("p") * weight[1] + F.col("n") * weight[0]) / float(sum(totals.values()))
    shared = cut(tallied.where(F.col("p") + F.col("n") >= LEAST).select("term", share.alias("share")), "terms")
    best = None
    for floor in FLOORS:
        for model, error in _fitted(examples, shared.where(F.col("share") <= floor), weight):
            if best is None or error < best[1]:
                best = (model, error)
    return best[0]


def _fitted(examples: DataFrame, terms: DataFrame, weight: dict[int, float]) -> Iterator[tuple[Model, float]]:
    """Models over these terms (term, share) for each of NEIGHBOURS, and their weighted squared errors on the examples, each
    without itself."""
    found = terms.orderBy(F.desc("share"), "term").toArrow()  # bounded by the examples' texts
    vectors = Vectors(dict(zip(found["term"].to_pylist(), (-np.log(found["share"].to_numpy())).tolist(), strict=True)))
    rows = _vectors(examples.select("id", "toxic", "text"), vectors)
    index, blank = _index(rows.orderBy("id").toArrow(), len(vectors.idf), weight)
    points = _own_votes(rows.select("toxic", "at", "weights"), index, weight)
    labels = points["toxic"].to_numpy().astype(float)
    weights = np.where(labels == 1, weight[1], weight[0])
    for i, wanted in enumerate(NEIGHBOURS):
        votes = points[f"v{i}"].to_numpy(zero_copy_only=False).astype(float).round(12)
        has = ~np.isnan(votes)
        steps = isotonic(list(zip(votes[has].tolist(), labels[has].tolist(), weights[has].tolist(), strict=True)))
        scores = np.where(has, calibrated(steps, np.where(has, votes, 0.0)), blank)
        yield Model(vectors, index, steps, blank, wanted), float(weights @ (scores - labels) ** 2)


def _index(rows: pa.Table, terms: int, weight: dict[int, float]) -> tuple[Index, float]:
    """The index of example vectors (id, toxic, at, weights), and the rate of the label among those without terms."""
    entries: dict[tuple[bytes, bytes], list] = {}
    blank = [0.0, 0.0]
    for batch in rows.to_batches():
        for id_, label, at, weights in zip(batch["id"].to_pylist(), batch["toxic"].to_pylist(), batch["at"], batch["weights"], strict=True):
            at, weights = at.values.to_numpy(), weights.values.to_numpy()
            if not len(at):
                blank[0] += label * weight[label]
                blank[1] += weight[label]
                continue
            entry = entries.setdefault((at.tobytes(), weights.tobytes()), [at, weights, 0.0, 0.0, 0, id_])
            entry[2] += label * weight[label]
            entry[3] += weight[label]
            entry[4] += 1
    return Index([tuple(e) for e in entries.values()], terms), blank[0] / blank[1] if blank[1] else 0.0


def _vectors(df: DataFrame, vectors: Vectors) -> DataFrame:
    """(id, toxic, at, weights) of examples, written."""
    names, shared = [c for c in df.columns if c != "text"], df.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.vector(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([a for a, _ in made], pa.list_(pa.int32())), pa.array([w for _, w in made], pa.list_(pa.float32()))], [*names, "at", "weights"])

    schema = T.StructType([df.schema[n] for n in names] + [T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.FloatType()))])
    out = cut(df.mapInArrow(run, schema), "vectors")
    shared.destroy()
    return out


def _own_votes(rows: DataFrame, index: Index, weight: dict[int, float]) -> pa.Table:
    """(toxic, v0, v1, ...): each example's label and votes; null where nothing is near."""
    shared, names = rows.sparkSession.sparkContext.broadcast(index), [f"v{i}" for i in range(len(NEIGHBOURS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch["toxic"].to_pylist()
            votes = [own_votes(shared.value, at.values.to_numpy(), w.values.to_numpy(), label, weight[label]) for label, at, w in zip(labels, batch["at"], batch["weights"], strict=True)]
            columns = zip(*votes, strict=True) if votes else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), *(pa.array(v, pa.float64()) for v in columns)], ["toxic", *names])

    out = rows.mapInArrow(run, ", ".join(["toxic int", *(f"{n} double" for n in names)])).toArrow()
    shared.destroy()
    return out


EVIDENCE_TYPE = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("toxic", T.DoubleType())]))


def _evidence(index: Index, found: list[tuple[float, np.ndarray, np.ndarray]]) -> pa.ListArray:
    entries = np.concatenate([f[1] for f in found])
    ends = np.cumsum([0, *(len(f[1]) for f in found)], dtype=np.int32)
    columns = [index.ids[entries], np.concatenate([f[2] for f in found]), index.toxic[entries] / index.weight[entries]]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c) for c in columns], ["doc_id", "similarity", "toxic"]))


def score(df: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df (without text unless keep_text) with score, the calibrated probability of the label, and evidence.

    evidence has the nearest entries: an example's id, its similarity, and the labelled share of its like. Null and
    empty texts have the score of documents without terms; very long ones are read whole. Ties and repeated rows get
    equal scores; an empty table gives an empty one. Other columns, whatever their names, pass through, but for score and
    evidence, which are replaced.
    """
    make_importable(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the two sample sizes
    kept = [c for c in df.columns if c not in ("score", "evidence") and (keep_text or c != text)]
    inner, content, names = numbered(df), place(df, text), [place(df, c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                found = [fitted.score(fitted.vectors.vector(one)) for one in batch.column(content).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([f[0] for f in found], pa.float64()), _evidence(fitted.index, found)], [*names, "score", "evidence"])

    schema = T.StructType([inner.schema[n] for n in names] + [T.StructField("score", T.DoubleType()), T.StructField("evidence", EVIDENCE_TYPE)])
    return inner.mapInArrow(run, schema).toDF(*kept, "score", "evidence")


def digests(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of each row of documents."""
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that aren't predicted to be toxic, with all their columns in order, whatever their names."""
    model, inner = fit(documents, labels), numbered(documents)
    scored = score(inner, model, place(documents, "text"), keep_text=True)
    return scored.where(F.col("score") < THRESHOLD).select(*inner.columns).toDF(*documents.columns)
