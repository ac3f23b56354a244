"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors go through fast Hadamard pseudo-rotations (three rounds of random signs and a Walsh-Hadamard transform) and
are assigned to the nearest signed axis, once per table. A query probes, in every table, the axes nearest to its own
rotation; the rows met there are reranked by their exact inner product in double precision. How many axes to probe is
fitted: a bounded sample of queries is compared with all rows, and the least number that finds the wanted share of their
neighbours is taken.

Rows are hashed in bands of like norm, each lifted to the unit sphere by one more coordinate where its norms differ, so
that the nearest axis follows the inner product; a query probes every band. Buckets of any size are dealt over blocks of
bounded size. A query for which fewer than k rows are met, though there are more, is compared with all rows.

Null, zero and non-finite vectors, vectors with null components and rows without an id take no part; vectors of another
length than the query's are no candidates. Rows that repeat an id count as one, with the larger of their products; of
queries that repeat an id the vector that comes first in order asks. Ties go to the smaller id; products that are too large
for a double are infinite and tie, those without a value count as negative infinity. Ids are cast to long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, in_blocks

TABLES, RECALL, SAMPLE, ROWS_EACH, ASKS_EACH, SEED = 4, 0.95, 128, 8192, 2048, 42


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two, scaled to keep norms."""
    n = x.shape[1]
    x, h = x.copy(), 1
    while h < n:
        pairs = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """The rows, padded to a power of two, under the pseudo-rotation of a table."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], (3, width))
    out = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for s in signs:
        out = hadamard(out * s)
    return out


def axis_of(x: np.ndarray) -> np.ndarray:
    """Number of the nearest signed axis: k for +k, width + k for -k."""
    k = np.abs(x).argmax(axis=1)
    return k + x.shape[1] * (x[np.arange(len(x)), k] < 0)


def matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>, dim): rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        rows.select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))
        .where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0))
        .withColumn("dim", F.size("vec"))
    )


def log_norm(x: np.ndarray) -> np.ndarray:
    """Logarithm (base 2) of the rows' lengths, for any finite rows but zero."""
    top = np.abs(x).max(axis=1)
    return np.log2(top) + np.log2(np.linalg.norm(x / top[:, None], axis=1))


def _lift(x: np.ndarray, band: dict | None) -> np.ndarray:
    """Rows of a band on the unit sphere; one more coordinate where the band's norms differ. band None: queries."""
    if band is None or not band["lifted"]:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    x = np.ldexp(x, -band["band"]) / band["top"]
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1, keepdims=True)))])


def _asked(x: np.ndarray, band: dict) -> np.ndarray:
    x = _lift(x, None)
    return np.hstack([x, np.zeros((len(x), 1))]) if band["lifted"] else x


def best(q_ids, q, d_ids, d, k: int):
    """(query number, row number, score) of the k largest exact inner products of each query; its own id is left out."""
    with np.errstate(over="ignore", invalid="ignore"):
        scores = q @ d.T
        scores[np.isnan(scores)] = -np.inf
        own = q_ids[:, None] == d_ids[None, :]
        ranked = np.where(own, -np.inf, scores)
        take = min(k, ranked.shape[1])
        floor = np.partition(ranked, ranked.shape[1] - take, axis=1)[:, ranked.shape[1] - take]
        slack = np.where(np.isfinite(floor), 1e-9 * (1 + np.abs(floor)), 0.0)
        i, j = np.nonzero((ranked >= (floor - slack)[:, None]) & ~own)
        exact = np.empty(len(i))
        for a in range(0, len(i), 1 << 16):  # summed alike for every pair: equal vectors get equal scores
            exact[a : a + (1 << 16)] = (q[i[a : a + (1 << 16)]] * d[j[a : a + (1 << 16)]]).sum(axis=1)
    order = np.lexsort((d_ids[j], -np.where(np.isnan(exact), -np.inf, exact), i))
    i, j, exact = i[order], j[order], exact[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], exact[place < k]


_FOUND = "query_id long, vec_id long, score double"


def _found(q_ids, d_ids, i, j, score, kind=pa.table):
    return kind({"query_id": pa.array(q_ids[i]), "vec_id": pa.array(d_ids[j]), "score": pa.array(score)})


def _meet(k: int):
    def run(group: pa.Table) -> pa.Table:
        ask = group.column("is_ask").to_numpy()
        ids, x = group.column("id").to_numpy(), matrix(group.column("vec"))
        if not ask.any() or ask.all():
            return _found(ids, ids, *(np.zeros(0, int),) * 2, np.zeros(0))
        return _found(ids[ask], ids[~ask], *best(ids[ask], x[ask], ids[~ask], x[~ask], k))

    return run


def _rank(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max(F.nanvl("score", F.lit(float("-inf")))).alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _sample_neighbours(rows: DataFrame, sample: list, k: int) -> DataFrame:
    """The k nearest rows of each of a bounded list of queries, over all rows, with their vectors."""
    ask_ids = np.array([r["id"] for r in sample])
    ask = np.array([r["vec"] for r in sample], float)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            i, j, score = best(ask_ids, ask, ids, x, k)
            out = _found(ask_ids, ids, i, j, score, pa.table).append_column("vec", batch.column(1).take(pa.array(j)))
            yield from out.to_batches()

    near = rows.where(F.col("dim") == ask.shape[1]).select("id", "vec").mapInArrow(run, f"{_FOUND}, vec array<double>")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id")
    return near.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    tables: int = TABLES,
    recall: float = RECALL,
    sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query, itself left out."""
    spark = rows.sparkSession
    data = usable(rows, id_col, vec_col)
    asks = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    top = F.array_max(F.transform("vec", F.abs))
    data = data.withColumn("top", top).withColumn("norm", F.log2("top") + F.log2(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top"))))))
    data = data.withColumn("band", F.round("norm").cast("int")).withColumn("norm", F.pow(F.lit(2.0), F.col("norm") - F.col("band"))).drop("top")
    # one row per length and power of two that norms have: at most some 2,100 a length
    bands: dict[int, list[dict]] = {}
    for r in data.groupBy("dim", "band").agg(F.min("norm").alias("low"), F.max("norm").alias("top"), F.count("*").alias("n")).collect():
        bands.setdefault(r["dim"], []).append({"band": r["band"], "top": r["top"] * (1 + 1e-9), "n": r["n"], "lifted": r["low"] < 0.999 * r["top"]})
    drawn = asks.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    probes: dict[int, int] = {}
    for dim in {r["dim"] for r in drawn}:
        mine = [r for r in drawn if r["dim"] == dim]
        if dim not in bands:
            continue
        by_band = {b["band"]: b for b in bands[dim]}
        near = _sample_neighbours(data, mine, k).select("query_id", "vec").collect()  # sample x k rows
        least = []
        place = {r["id"]: r["vec"] for r in mine}
        for r in near:
            x = np.array([r["vec"]], float)
            b = by_band.get(int(np.floor(log_norm(x)[0] + 0.5)), bands[dim][0])
            q = _asked(np.array([place[r["query_id"]]], float), b)
            at = []
            for t in range(tables):
                turned = rotated(q, t)
                both = np.hstack([turned, -turned])[0]
                at.append(int((both > both[axis_of(rotated(_lift(x, b), t))[0]]).sum()))
            least.append(min(at))
        probes[dim] = int(np.quantile(least, recall, method="higher")) + 1 if least else 1
    most = max(probes.values(), default=1)

    def of_rows(batches):
        for batch in batches:
            for dim, band in {(d, b) for d, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)}:
                at = np.flatnonzero((batch.column(2).to_numpy() == dim) & (batch.column(3).to_numpy() == band))
                part = batch.take(pa.array(at))
                told = next(b for b in bands[dim] if b["band"] == band)
                x = _lift(matrix(part.column(1)), told)
                for t in range(tables):
                    axis = axis_of(rotated(x, t))
                    yield _spots(part, dim, band, t, axis)

    def of_asks(batches):
        for batch in batches:
            for dim in set(batch.column(2).to_pylist()) & set(bands):
                part = batch.take(pa.array(np.flatnonzero(batch.column(2).to_numpy() == dim)))
                x = matrix(part.column(1))
                for told in bands[dim]:
                    for t in range(tables):
                        turned = rotated(_asked(x, told), t)
                        both = np.hstack([turned, -turned])
                        n = min(probes.get(dim, most), both.shape[1])
                        order = np.argsort(-both, axis=1, kind="stable")[:, :n]
                        for c in range(n):
                            yield _spots(part, dim, told["band"], t, order[:, c])

    def _spots(part, dim, band, t, axis):
        n = part.num_rows
        fixed = [pa.array(np.full(n, v, np.int32)) for v in (dim, band, t)]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *fixed, pa.array(axis.astype(np.int32))], ["id", "vec", "dim", "band", "tab", "axis"])

    shape = "id long, vec array<double>, dim int, band int, tab int, axis int"
    index = data.select("id", "vec", "dim", "band").mapInArrow(of_rows, shape)
    probed = asks.select("id", "vec", "dim").mapInArrow(of_asks, shape)
    keys = ["dim", "band", "tab", "axis"]
    met = in_blocks(index, probed, keys, "id", ROWS_EACH, ASKS_EACH).groupBy(*keys, "block", "chunk").applyInArrow(_meet(k), _FOUND)
    found = cut(_rank(met, k))
    # the exact way for queries that met fewer than k rows: all rows of their length, in blocks
    short = asks.join(found.groupBy("query_id").agg(F.count("*").alias("n")), F.col("id") == F.col("query_id"), "left")
    total = {dim: sum(b["n"] for b in told) for dim, told in bands.items()}
    few = cut(short.where(F.coalesce("n", F.lit(0)) < k).select("id", "vec", "dim"))
    wanted = [r[0] for r in few.select("dim").distinct().collect() if r[0] in total]
    if wanted:
        rest = in_blocks(data.select("id", "vec", "dim").where(F.col("dim").isin(wanted)), few, ["dim"], "id", ROWS_EACH, ASKS_EACH)
        more = rest.groupBy("dim", "block", "chunk").applyInArrow(_meet(k), _FOUND)
        found = _rank(found.select("query_id", "vec_id", "score").union(more), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
