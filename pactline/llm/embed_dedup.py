"""Embedding near-duplicates by product quantisation with a lossless filter.

Equal vectors of a label are one class. Classes are unit vectors dealt to coarse inverted lists; their residuals carry
subspace codes and the exact error of those codes. A class asks its own list and every list that could hold a vector
within the wanted radius: those whose border with its own list lies within that radius, so no link can be missed. Within
a list, asymmetric distances from lookup tables rule out rows whose code, less its error, is beyond the radius; what is
left is reranked by exact cosine in double precision. Lists of any size are dealt over blocks of bounded size.

The quantisers are fitted on a bounded sample (SAMPLE rows) and shared; they decide speed only, never which links exist.

Null, zero and non-finite vectors, vectors with null components and rows with a null label link with nothing; vectors of
different lengths don't link. Repeated rows link with each other. Rows without an id link with nothing. Ids are cast to long.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import matrix
from .common import components, cut, in_blocks

LIST_ROWS, MOST_LISTS, SAMPLE, CODES, PARTS, ROWS_EACH, ASKS_EACH = 256, 1024, 16384, 256, 8, 1024, 1024


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres."""
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no finite row is too large or small."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _means(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's centres of the rows, started at rows evenly spaced in the given order."""
    centres = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres).argmin(1)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def _split(x: np.ndarray) -> np.ndarray:
    """Rows cut into PARTS subspaces, padded with zeros: (PARTS, rows, width)."""
    width = -(-x.shape[1] // PARTS)
    return np.pad(x, ((0, 0), (0, PARTS * width - x.shape[1]))).reshape(len(x), PARTS, width).transpose(1, 0, 2)


def fit(x: np.ndarray, lists: int) -> dict:
    """Coarse centres and one codebook per subspace of the residuals."""
    centres = _means(x, lists)
    rest = x - centres[_nearest(x, centres).argmin(1)]
    return {"centres": centres, "books": [_means(p, CODES, 5) for p in _split(rest)]}


def assign(x: np.ndarray, model: dict, radius: float):
    """(own list, codes, code error, [rows, lists] whether to ask): asks lists after the own one only, each pair once."""
    centres = model["centres"]
    d2 = _nearest(x, centres)
    own = d2.argmin(1)
    gap = np.sqrt(_nearest(centres[own], centres))
    ask = (d2 - d2[np.arange(len(x)), own][:, None] <= 2 * (radius + 1e-6) * gap + 1e-9) & (np.arange(len(centres))[None, :] > own[:, None])
    parts = _split(x - centres[own])
    codes = np.stack([_nearest(p, b).argmin(1) for p, b in zip(parts, model["books"], strict=True)], axis=1)
    seen = np.stack([b[codes[:, m]] for m, b in enumerate(model["books"])])
    return own, codes, np.sqrt(((parts - seen) ** 2).sum(axis=(0, 2))), ask


def _local_roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest number reachable in the graph of edges (i, j) over 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _pairs(ask: np.ndarray, rows: np.ndarray, codes: np.ndarray, error: np.ndarray, model: dict, number: int, radius: float, least: float):
    """(ask, row) numbers of pairs of cosine >= least: table lookup, then exact rerank."""
    rest = _split(ask - model["centres"][number])
    seen = np.zeros((len(ask), len(rows)))
    for m, book in enumerate(model["books"]):
        seen += _nearest(rest[m], book)[:, codes[:, m]]
    i, j = np.nonzero(np.sqrt(seen) <= radius + error[None, :] + 1e-6)
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        part = slice(a, a + (1 << 16))
        keep[part] = (ask[i[part]] * rows[j[part]]).sum(1) >= least
    return i[keep], j[keep]


_OUT = "a long, b long, w long"


def _group(models, radius: float, least: float):
    def run(group: pa.Table) -> pa.Table:
        ask = group.column("is_ask").to_numpy()
        nothing = pa.table({c: pa.array([], pa.int64()) for c in "abw"})
        if not ask.any() or ask.all():
            return nothing
        ids, many, x = group.column("id").to_numpy(), group.column("many").to_numpy(), matrix(group.column("vec"))
        number, home = group.column("list")[0].as_py(), group.column("home").to_numpy()
        model = models.value[x.shape[1]]
        codes = np.frombuffer(b"".join(c.as_py() for c in group.column("codes")), np.uint8).reshape(len(ids), -1)[~ask]
        i, j = _pairs(x[ask], x[~ask], codes, group.column("error").to_numpy()[~ask], model, number, radius, least)
        a, b = ids[ask][i], ids[~ask][j]
        once = (home[ask][i] != number) | (a < b)  # within a list each pair is asked from both sides
        i, j, a, b = i[once], j[once], a[once], b[once]
        if not len(a):
            return nothing
        who, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        links = np.bincount(at, np.concatenate([many[~ask][j], many[ask][i]]), len(who)).astype(np.int64)
        roots = who[_local_roots(at[: len(a)], at[len(a) :], len(who))]
        return pa.table({"a": pa.array(who), "b": pa.array(roots), "w": pa.array(links)})

    return run


def near_duplicates(rows: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row."""
    spark, radius = rows.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * least)))
    vec = F.col("vec")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(vec, lambda x: x != 0)
    all_rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull() & ~bad, F.lit(False))
    good = all_rows.where(fine)
    classes = cut(good.groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("many")).withColumn("dim", F.size("vec")))
    # one row per length of vector: its sample and how many lists it needs
    models = {}
    for dim, n in [(r[0], r[1]) for r in classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count")).collect()]:
        drawn = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").select("vec").limit(SAMPLE)
        x = np.array([r[0] for r in drawn.collect()], float)
        models[dim] = fit(_unit(x), int(np.clip(n // LIST_ROWS, 1, MOST_LISTS)))
    shared = spark.sparkContext.broadcast(models)  # MOST_LISTS + CODES vectors a length at most

    def deal(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = _unit(matrix(part.column("vec")))
                own, codes, error, ask = assign(x, shared.value[int(dim)], radius)
                who, where = np.nonzero(ask)
                who, where = np.concatenate([np.arange(len(x)), who]), np.concatenate([own, where])
                size = pa.array(np.arange(len(who) + 1, dtype=np.int32) * int(dim))
                for first in (True, False):  # its place in its list; the lists it asks, its own among them
                    pick = slice(0, len(x)) if first else slice(0, len(who))
                    n = len(who[pick])
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("label").take(pa.array(who[pick])),
                            part.column("dim").take(pa.array(who[pick])),
                            pa.array(where[pick].astype(np.int32)),
                            pa.array(own[who[pick]].astype(np.int32)),
                            part.column("id").take(pa.array(who[pick])),
                            part.column("many").take(pa.array(who[pick])),
                            pa.ListArray.from_arrays(size[: n + 1], pa.array(x[who[pick]].ravel())),
                            pa.array([c.tobytes() for c in codes.astype(np.uint8)[who[pick]]], pa.binary()),
                            pa.array(error[who[pick]]),
                            pa.array(np.full(n, not first)),
                        ],
                        ["label", "dim", "list", "home", "id", "many", "vec", "codes", "error", "asks"],
                    )

    shape = "label string, dim int, list int, home int, id long, many long, vec array<double>, codes binary, error double, asks boolean"
    dealt = cut(classes.select("label", "dim", "id", "many", "vec").mapInArrow(deal, shape))
    keys = ["label", "dim", "list"]
    met = in_blocks(dealt.where("NOT asks").drop("asks"), dealt.where("asks").drop("asks"), keys, "id", ROWS_EACH, ASKS_EACH)
    found = cut(met.groupBy(*keys, "block", "chunk").applyInArrow(_group(shared, radius, least), _OUT))
    joined = components(found).select(F.col("node").alias("id"), "root")
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("w"))
    told = classes.join(links, "id", "left").join(joined, "id", "left").select(
        "label", "vec", (F.coalesce("w", F.lit(0)) + F.col("many") - 1).alias("n"), F.coalesce("root", "id").alias("c")
    )
    linked = good.join(told, ["label", "vec"]).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    alone = all_rows.where(~fine).select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
