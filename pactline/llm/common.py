"""Helpers that several operators share: lineage cuts, hot-key blocks, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only in one process, as in tests, a local folder where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pactline-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder: its lineage ends there and outlives any executor."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def give_back() -> None:
    """Returns memory that nothing uses to the system: Python workers outlive their tasks and keep it otherwise."""
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in small parts, so that few rows at a time are Python objects. What earlier tasks left is given back first."""
    give_back()
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def each(values: pa.Array, rows: int = 512) -> Iterator:
    """The values one by one, few at a time as Python objects."""
    for k in range(0, len(values), rows):
        yield from values.slice(k, rows).to_pylist()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def packed(df: DataFrame, **more) -> DataFrame:
    """The columns of df as one struct, row, beside others that then cannot clash with them."""
    return df.select(F.struct("*").alias("row"), *(c.alias(name) for name, c in more.items()))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared folder: computed once, and its columns take less room than a checkpoint's rows."""
    folder = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


#: Bits of a bitmap: 1 MB in all, so that it may be broadcast whatever it stands for.
BITMAP = 1 << 23


def _bit(cols: Sequence[str]):
    return F.pmod(F.xxhash64(*cols), F.lit(BITMAP))


def bitmap(keys: DataFrame, *cols: str) -> DataFrame:
    """(word, bits): a hash bitmap of the keys, BITMAP / 64 rows at most."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))
    return stored(keys.select(_bit(cols).alias("bit")).select(F.shiftright("bit", 6).alias("word"), one.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).coalesce(1), "bitmap")


def marked(rows: DataFrame, of: DataFrame, *cols: str) -> DataFrame:
    """rows with maybe: false only where their key surely is none of a bitmap's. It rules rows out before they move; a full
    bitmap rules out none, which costs time only."""
    told = rows.withColumn("bit", _bit(cols)).withColumn("word", F.shiftright("bit", 6)).join(F.broadcast(of), "word", "left")
    there = F.call_function("shiftright", F.col("bits"), F.col("bit").bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    return told.select(*rows.columns, F.coalesce(there, F.lit(False)).alias("maybe"))


def hot(keys: DataFrame, n: str = "n", share: int = 1000) -> DataFrame:
    """Of keys with their numbers of rows, those with one of share rows or more: share keys at most, so they may be broadcast."""
    total = keys.agg(F.sum(n)).first()[0] or 0
    return keys.where(F.col(n) * share >= total)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b), both long.

    Returns (node, root): one row per node that has an edge to another node, root the smallest node reachable.
    Alternating large-star and small-star rounds: every round is joins and aggregations on node ids, stored in the
    shared folder; only two numbers per round reach the driver. Nulls and self-loops are ignored. Rounds grow with the logarithm
    of the largest component; max_rounds of them without an end raise RuntimeError rather than give a wrong result.
    """
    pairs = cut(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        # large star: every larger neighbour of u goes to the smallest member of u's neighbourhood
        both = pairs.union(pairs.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = cut(small.union(low.select("hi", "m")).distinct())
    else:
        raise RuntimeError("components did not converge")
    roots = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def in_blocks(rows: DataFrame, asks: DataFrame, keys: Sequence[str], id_col: str, rows_each: int, asks_each: int) -> DataFrame:
    """Deals every (row, ask) pair of a key to exactly one group of bounded size.

    rows and asks have the same columns. A key with many rows or asks is dealt over a grid: each row goes to one of its
    blocks in every chunk, each ask to one chunk in every block. Returns their union with columns block, chunk and
    is_ask; group it by (*keys, block, chunk). No key is left out, none meets in one task as a whole.
    """
    n_rows = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(rows_each)).cast("int").alias("n_blocks"))
    n_asks = asks.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(asks_each)).cast("int").alias("n_chunks"))
    grid = n_rows.join(n_asks, list(keys))
    spot = F.xxhash64(id_col)
    left = rows.join(grid, list(keys)).select(
        *rows.columns,
        F.pmod(spot, F.col("n_blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"),
        F.lit(False).alias("is_ask"),
    )
    right = asks.join(grid, list(keys)).select(
        *asks.columns,
        F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"),
        F.pmod(spot, F.col("n_chunks")).cast("int").alias("chunk"),
        F.lit(True).alias("is_ask"),
    )
    return left.unionByName(right)
