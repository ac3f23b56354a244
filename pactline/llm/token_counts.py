"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A ledger is a folder of Parquet batches, batches/<id>. A commit turns events into additive deltas (documents, tokens,
characters; minus for deletes, the difference for revised counts), sums them by key and writes its batch's folder, which
counts from the moment it is complete. Committing a complete batch again changes nothing, so commits may be retried and
repeated; one that was cut off is written anew. Totals are the sum of the base and all complete batches. compact() folds
the batches that are complete when it begins into a new base and then points to it; a commit meanwhile stays a batch of
its own. Folded batches are deleted after the pointer has moved; their ids are refused from then on.

Null texts count as empty; null source or language is a key of its own. Keys whose documents are all gone leave the
totals. Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CACHE, Words, codec
from .common import slices

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
_SHAPE = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


class _Counts(dict):
    """Chunk after a space to its number of tokens."""

    def __init__(self, cutter: Words, piece):
        super().__init__()
        self.cutter, self.piece = cutter, piece

    def of(self, words: list[str]) -> int:
        return sum(len(self.piece(w.encode("utf-8"))) for w in words)

    def __missing__(self, chunk: str) -> int:
        if len(self) > CACHE:
            self.clear()
        got = self[chunk] = self.of(self.cutter.later(chunk))
        return got

    def text(self, text: str) -> int:
        chunks = self.cutter.chunks(text)
        if chunks is None:
            return self.of(self.cutter.find(text)) if text else 0
        return self.of(self.cutter.first(chunks[0])) + sum(map(self.__getitem__, chunks[1:]))


def count_tokens(docs: DataFrame, ranks: bytes, pattern: str, version: str, text_col: str = "text") -> DataFrame:
    """(source, lang, tokenizer, n_docs = 1, n_tokens, n_chars): one row per row of docs, counted over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        counts = _Counts(Words(pattern), codec(shared.value, pattern)._core_bpe.encode_single_piece)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([version] * n, pa.string()),
                    pa.array(np.ones(n, np.int64)),
                    pa.array([counts.text(t) for t in texts], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                KEYS + SUMS,
            )

    rows = docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, _SHAPE)


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, *SUMS)


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, *((-F.col(c)).alias(c) for c in SUMS))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """A revised document leaves with its old counts and key and enters with the new ones."""
    return deletes(before).unionByName(inserts(after))


class Ledger:
    """Batches of additive totals in a folder that all executors share. One writer at a time compacts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _done(self, name: str) -> bool:
        files, path = self._at(f"{name}/_SUCCESS")
        return files.exists(path)

    def _names(self, folder: str) -> list[str]:
        """Complete folders below one, by name. compact() keeps them few."""
        files, path = self._at(folder)
        found = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(n for n in found if self._done(f"{folder}/{n}"))

    def _base(self) -> str | None:
        """The folder that the newest pointer names."""
        newest = max(map(int, self._names("versions")), default=None)
        return None if newest is None else self.spark.read.parquet(f"{self.path}/versions/{newest}").first()["base"]

    def _folded(self, base: str | None, names: list[str]) -> set[str]:
        """Which of the names the base holds."""
        if base is None or not names:
            return set()
        return {r[0] for r in self.spark.read.parquet(f"{self.path}/{base}/folded").where(F.col("batch").isin(names)).collect()}

    def commit(self, batch: str, deltas: DataFrame) -> None:
        """Writes the batch's summed deltas; nothing if it is complete. Raises for a batch that compact() has folded."""
        if not batch.replace("-", "").replace("_", "").isalnum() or batch.startswith("_"):
            raise ValueError(f"not a batch id: {batch!r}")
        if self._folded(self._base(), [batch]):
            raise ValueError(f"batch {batch!r} is folded into the base")
        if not self._done(f"batches/{batch}"):
            sums = deltas.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
            sums.write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")

    def _sum(self, base: str | None, names: list[str]) -> DataFrame:
        read = self.spark.read.schema(_SHAPE)
        rows = self.spark.createDataFrame([], _SHAPE)
        if names:
            rows = read.parquet(*(f"{self.path}/batches/{n}" for n in names))
        if base is not None:
            held = read.parquet(f"{self.path}/{base}/totals")
            rows = held.unionByName(rows) if names else held
        sums = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        return sums.where("n_docs != 0 OR n_tokens != 0 OR n_chars != 0")

    def _open(self, base: str | None) -> list[str]:
        names = self._names("batches")
        folded = self._folded(base, names)
        return [n for n in names if n not in folded]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_chars) over the base and every complete batch that it doesn't hold."""
        base = self._base()
        return self._sum(base, self._open(base))

    def compact(self) -> None:
        """Folds the batches that are complete now into a new base."""
        base, number = self._base(), max(map(int, self._names("versions")), default=0) + 1
        names, new = self._open(base), f"base-{number}-{uuid.uuid4().hex}"
        self._sum(base, names).write.parquet(f"{self.path}/{new}/totals")
        folded = self.spark.createDataFrame([(n,) for n in names], "batch string")
        if base is not None:
            folded = folded.union(self.spark.read.parquet(f"{self.path}/{base}/folded"))
        folded.write.parquet(f"{self.path}/{new}/folded")
        # the pointer: a folder that another compaction cannot also write
        self.spark.createDataFrame([(new,)], "base string").coalesce(1).write.parquet(f"{self.path}/versions/{number}")
        for name in [*(f"batches/{n}" for n in names), *([base] if base else [])]:
            files, path = self._at(name)
            files.delete(path, True)
