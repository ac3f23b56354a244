"""Toxicity by nearest labelled examples.

A bounded, reproducible sample of labelled documents (MOST_EXAMPLES a class) are the examples. Terms are the stems of all
words, their first STEM characters; a vector has sublinear term frequencies times inverse document frequencies, the latter
counted over all rows of the table, and unit length. The examples stand in blocks of BLOCK similar ones, and the inverted
index has the largest weight of every term and block, and per block its terms with their weights in its examples. A document's whole text is searched exactly: the
weights bound what any example of a block can reach, blocks are visited from the highest bound down, and the search ends
where no bound reaches the NEIGHBOURS-th best cosine found. The neighbours vote with their cosines, weighted so that the
sample's classes count as in the whole; leave-one-out votes of the examples calibrate votes to probabilities (isotonic
regression, straight lines between its steps). Evidence names the neighbours.

Words whose stem is in no example are left out of a text's vector: they would make all its cosines smaller by one factor,
so they change neither neighbours nor vote. Only a text that shares no stem with any example gets the share of toxic ones
among the examples without stems.

Null and empty texts are scored as texts without stems. Repeated rows score alike. Of rows that repeat a labelled id the
one whose text comes first in order teaches; of its labels the larger. Labels that are null, or of documents that do not
exist, teach nothing; without labels of both kinds every score is the toxic share (0 if there is no label). Equal cosines:
the smaller id is nearer. Ids are cast to long. Other columns, and all labels at scoring time, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

MOST_EXAMPLES, NEIGHBOURS, BLOCK, FIRST_BLOCKS, BATCH, THRESHOLD, FOLDS, HELD_OUT = 1500, 15, 16, 6, 64, 0.3, 4, 2
STEM, CACHE = 4, 100_000
_EDGE = "".join(chr(c) for c in range(128) if not chr(c).isalnum()) + "«»“”„‘’…–—¡¿"


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def stem(token: str) -> str:
    """The stem of a token's word; empty if it has no letter."""
    word = token.strip(_EDGE)
    return word[:STEM] if any(map(str.isalpha, word)) else ""


def term_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for token, n in Counter((text or "").lower().split()).items():
        term = stem(token)
        if term:
            out[term] += n
    return out


class _Terms(dict):
    """Token to the number of its stem, -1 if it has none."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE:
            self.clear()
        got = self[token] = self.number.get(stem(token), -1)
        return got

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """A text's term numbers, ascending, and how often each stands in it."""
        words = (text or "").lower().split()
        n = np.bincount(np.fromiter(map(self.__getitem__, words), np.int64, len(words)) + 1, minlength=1)
        ids = np.flatnonzero(n[1:])
        return ids, n[1:][ids]


def _in_rows(similar: np.ndarray) -> np.ndarray:
    """An order in which each item is followed by the most similar one that is left."""
    left, order = np.ones(len(similar), bool), [0]
    left[0] = False
    for _ in range(len(similar) - 1):
        k = int(np.where(left, similar[order[-1]], -1.0).argmax())
        left[k] = False
        order.append(k)
    return np.array(order)


class Model:
    """Terms, the examples' block-max inverted index, and the calibration."""

    def __init__(self, terms: list[str], idf: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], weights: tuple[float, float]):
        """examples: (id, label, term numbers, counts) each."""
        self.terms, self.idf = terms, np.asarray(idf, float)
        self.number = {t: k for k, t in enumerate(terms)}
        self.weights, self.prior = weights, 0.0
        self.steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))
        bare = [toxic for _, toxic, ids, _ in examples if not len(ids)]
        w = [sum(weights[t] for t in bare if t == y) for y in (0, 1)]
        self.prior = (w[1] + 1e-3) / (sum(w) + 1.0) if bare else 0.0
        examples = [e for e in examples if len(e[2])]
        self.vectors = [self.vector(ids, n) for _, _, ids, n in examples]
        if examples:
            dense = np.zeros((len(examples), len(terms)), np.float32)
            for k, (ids, v) in enumerate(self.vectors):
                dense[k, ids] = v
            order = _in_rows(dense @ dense.T).tolist()
            del dense
            examples, self.vectors = [examples[k] for k in order], [self.vectors[k] for k in order]
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.toxic = np.array([e[1] for e in examples], np.int64)
        self.blocks = -(-len(examples) // BLOCK)
        self.most = np.zeros((len(terms), self.blocks), np.float32)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # a block's terms, and their weights in its examples
        for b in range(self.blocks):
            own = self.vectors[b * BLOCK : (b + 1) * BLOCK]
            used = np.unique(np.concatenate([ids for ids, _ in own]))
            weights_of = np.zeros((len(used), len(own)))
            for k, (ids, v) in enumerate(own):
                weights_of[np.searchsorted(used, ids), k] = v
            self.most[used, b] = np.nextafter(weights_of.max(1).astype(np.float32), np.float32(2))
            self.parts.append((used, weights_of))

    def vector(self, ids, n) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit weights."""
        ids = np.asarray(ids, int)
        v = (1 + np.log(np.asarray(n, float))) * self.idf[ids]
        return ids, v / np.linalg.norm(v) if len(ids) else v

    def nearest_each(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query (cosine, example) of the k nearest examples that share a term; exact, ties to the smaller id."""
        n = len(self.ids)
        if not n or not queries:
            return [[] for _ in queries]
        spread = np.zeros((len(queries), len(self.terms)))
        for j, (ids, v) in enumerate(queries):
            spread[j, ids] = v
        bounds = spread.astype(np.float32) @ self.most * np.float32(1 + 1e-4)
        sums = np.zeros((len(queries), n))
        # the blocks of the highest bounds first; then those whose bound reaches the k-th best cosine in these
        high = np.partition(bounds, -FIRST_BLOCKS, axis=1)[:, -FIRST_BLOCKS] if self.blocks > FIRST_BLOCKS else np.zeros(len(queries))
        visit = seen = (bounds >= high[:, None]) & (bounds > 0)
        for wave in range(2):
            if wave:
                least = np.partition(sums, n - k, axis=1)[:, n - k] if n > k else np.zeros(len(queries))
                visit = (bounds >= least[:, None]) & (bounds > 0) & ~seen
            for b in np.flatnonzero(visit.any(0)).tolist():
                who, (used, weights_of) = np.flatnonzero(visit[:, b]), self.parts[b]
                sums[who, b * BLOCK : b * BLOCK + weights_of.shape[1]] = spread[who[:, None], used[None, :]] @ weights_of
            if without is not None:
                sums[np.arange(len(queries)), without] = 0.0
        sums = sums.round(12)  # what is equal but for the order of its sum is a tie
        out = []
        for row in sums:
            least = np.partition(row, n - k)[n - k] if n > k else 0.0
            near = np.flatnonzero((row > 0) & (row >= least))
            best = near[np.lexsort((self.ids[near], -row[near]))[:k]]
            out.append(list(zip(row[best].tolist(), best.tolist(), strict=True)))
        return out

    def nearest(self, ids: np.ndarray, v: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        return self.nearest_each([(ids, v)], k)[0]

    def vote(self, near: list[tuple[float, int]]) -> float:
        w = [c * self.weights[self.toxic[j]] for c, j in near]
        return sum(x for x, (_, j) in zip(w, near, strict=True) if self.toxic[j]) / sum(w)

    def calibrate(self) -> None:
        """Isotonic regression of labels on leave-one-out votes."""
        told = []
        for low in range(0, len(self.ids), BATCH):
            some = list(range(low, min(low + BATCH, len(self.ids))))
            for j, near in zip(some, self.nearest_each([self.vectors[j] for j in some], without=some), strict=True):
                if near:
                    toxic = int(self.toxic[j])
                    told.append((self.vote(near), toxic, self.weights[toxic]))
        merged: list[list[float]] = []  # first vote, last vote, mean label, weight
        for vote, toxic, w in sorted(told):
            merged.append([vote, vote, float(toxic), w])
            while len(merged) > 1 and (merged[-2][2] >= merged[-1][2] or merged[-2][1] == merged[-1][0]):
                x, y = merged.pop(), merged.pop()
                merged.append([y[0], x[1], (x[2] * x[3] + y[2] * y[3]) / (x[3] + y[3]), x[3] + y[3]])
        if merged:
            self.steps = np.array([(m[0] + m[1]) / 2 for m in merged]), np.array([m[2] for m in merged])
        del self.vectors

    def score(self, near: list[tuple[float, int]]) -> float:
        return float(np.interp(self.vote(near), *self.steps)) if near else self.prior


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_EXAMPLES) -> Model:
    """Learns from labelled rows outside the held-out fold: at most `most` a class, taken by a hash of their id."""
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    usable = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .join(docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    )
    usable = cut(usable)
    n = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    drawn = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    chosen = spark.createDataFrame([tuple(r) for d in drawn for r in d.collect()], "id long, toxic int")  # 2 x most rows

    def count(batches):
        for batch in slices(batches):
            got = [term_counts(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([list(g) for g in got], pa.list_(pa.string())), pa.array([list(g.values()) for g in got], pa.list_(pa.int32()))],
                ["id", "toxic", "terms", "n"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).join(F.broadcast(chosen), "id")
    examples = cut(texts.groupBy("id", "toxic").agg(F.min("body").alias("body")).mapInArrow(count, "id long, toxic int, terms array<string>, n array<int>"))
    seen = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    total, weights = sum(n.values()), tuple(n.get(y, 0) / seen[y] if seen.get(y) else 0.0 for y in (0, 1))
    if len(seen) < 2:
        model = Model([], [], [], (1.0, 1.0))
        model.prior = n.get(1, 0) / total if total else 0.0
        return model
    told = examples.orderBy("id").toArrow().combine_chunks()  # 2 x most rows
    lists, counts = told["terms"].combine_chunks(), told["n"].combine_chunks()
    terms = sorted(pc.unique(lists.flatten()).to_pylist())
    at = pc.index_in(lists.flatten(), pa.array(terms, pa.string())).to_numpy()
    counts, ends = counts.flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
    shared = spark.sparkContext.broadcast(terms)

    def rows_with(batches):
        tokens, n, rows = _Terms({t: k for k, t in enumerate(shared.value)}), np.zeros(len(shared.value), np.int64), 0
        for batch in slices(batches):
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                n[tokens.of(text)[0]] += 1
        kept = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1).astype("i4")), pa.array(np.append(n[kept], rows))], ["term", "rows"])

    per = docs.select(F.col(text_col).cast("string")).mapInArrow(rows_with, "term int, rows long").groupBy("term").agg(F.sum("rows").alias("rows")).toArrow()
    size = np.ones(len(terms) + 1)
    size[per["term"].to_numpy()] = per["rows"].to_numpy()  # -1, the last: all rows
    idf = np.log(1 + size[-1] / size[:-1])
    vectors = []
    for k, (doc_id, toxic) in enumerate(zip(told["id"].to_pylist(), told["toxic"].to_pylist(), strict=True)):
        order = np.argsort(at[ends[k] : ends[k + 1]])
        vectors.append((doc_id, toxic, at[ends[k] : ends[k + 1]][order], counts[ends[k] : ends[k + 1]][order]))
    del told, lists, counts, at
    model = Model(terms, idf, vectors, weights)
    del vectors
    model.calibrate()
    return model


def _scorer(model: Model):
    """texts -> (score, neighbours) of each."""
    tokens = _Terms(model.number)

    def run(texts: list[str | None]):
        for low in range(0, len(texts), BATCH):
            for near in model.nearest_each([model.vector(*tokens.of(t)) for t in texts[low : low + BATCH]]):
                yield min(1.0, max(0.0, model.score(near))), near

    return run


def _evidence(model: Model, near: list[tuple[float, int]]) -> str:
    return " ".join(f"{model.ids[j]}:{model.toxic[j]}:{c:.3f}" for c, j in near)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence): one row per row. evidence: id:label:cosine of the neighbours."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 x MOST_EXAMPLES examples and their terms

    def run(batches):
        model = shared.value
        of = _scorer(model)
        for batch in slices(batches):
            got = list(of(batch.column(1).to_pylist()))
            scores, evidence = [g[0] for g in got], [_evidence(model, g[1]) for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([held_out(i) for i in batch.column(0).to_pylist()], pa.bool_()),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    pa.array(evidence, pa.string()),
                ],
                ["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence string")


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at least the threshold. All columns stay, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        run = _scorer(shared.value)
        return pa.array([got[0] for k in range(0, len(texts), 512) for got in run(texts.slice(k, 512).to_pylist())], pa.float64())

    return docs.where(of(F.col(text_col).cast("string")) < threshold)
