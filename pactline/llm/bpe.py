"""Byte-level BPE by a global shuffle of distinct words.

Encoding: documents are cut into blocks; a block is one row of a table in the shared folder, with the number of the word
at every position of every document, and its distinct words. Only the distinct words are shuffled: dealt by word hash, so
that all blocks' copies of a word meet in one place and it is encoded once there; the ids go back to their block by number
and each document is put together by position. The table is bucketed by block, so the positions stay where they are
written. Decoding joins the token-byte table, which the vocabulary file bounds, by taking its rows at the ids.

Null and empty texts have no ids. Rows keep their id as it is, null or repeated; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import partitions, scratch, slices

BLOCK_CHARS, BLOCK_DOCS, CACHE, MOST_BUCKETS, DECODE_ROWS = 10_000_000, 50_000, 300_000, 4096, 256
#: Two white space characters in a row: only there a pre-token's extent depends on what follows its chunk.
_RUN = re.compile(r"\s\s")
_ODD = "\x1c\x1d\x1e\x1f"


@lru_cache(4)
def codec(blob: bytes, pattern: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file's bytes."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def byte_table(blob: bytes) -> pa.Array:
    """The bytes of every token at its id's place; ids that the file leaves out are null."""
    told = {int(b): base64.b64decode(a) for a, b in (line.split() for line in blob.splitlines() if line)}
    return pa.array([told.get(k) for k in range(max(told, default=-1) + 1)], pa.binary())


class Words:
    """Cuts texts into pre-tokens, chunk by chunk where chunks between spaces can be cut apart safely."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall

    def chunks(self, text: str) -> list[str] | None:
        """What stands between spaces (all but the first with its space left out), or None where that isn't safe."""
        return None if not text or _RUN.search(text) or any(c in text for c in _ODD) else text.split(" ")

    def first(self, chunk: str) -> list[str]:
        return self.find(chunk) if chunk else []

    def later(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk and the space before it. Letters alone, or with one mark after them, are plain."""
        if chunk.isalpha():
            return [" " + chunk]
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            return [" " + chunk[:-1], chunk[-1]]
        return self.find(" " + chunk)

    def words(self, text: str) -> list[str]:
        chunks = self.chunks(text)
        if chunks is None:
            return self.find(text)
        return [*self.first(chunks[0]), *(w for c in chunks[1:] for w in self.later(c))]


def _pack(*arrays) -> bytes:
    parts = [np.ascontiguousarray(a).tobytes() if isinstance(a, np.ndarray) else bytes(a) for a in arrays]
    return zstandard.compress(struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts), 3)


def _unpack(blob: bytes, n: int) -> list[memoryview]:
    data = memoryview(zstandard.decompress(blob))
    ends = np.cumsum([8 * n, *struct.unpack_from(f"<{n}q", data)])
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _planes(a: np.ndarray) -> np.ndarray:
    """The bytes of 32-bit numbers, byte place by byte place: these compress well."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _from_planes(view) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(view, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class _Numbers(dict):
    """Chunk to the packed numbers of its words, filled as chunks come."""

    def __init__(self, cutter: Words):
        super().__init__()
        self.cutter, self.number = cutter, {}

    def pack(self, words: list[str]) -> bytes:
        number = self.number
        return struct.pack(f"<{len(words)}I", *[number.setdefault(w, len(number)) for w in words])

    def __missing__(self, chunk: str) -> bytes:
        got = self[chunk] = self.pack(self.cutter.later(chunk))
        return got


class _Block:
    """Distinct words of some documents, and each document's sequence of word numbers."""

    def __init__(self, cutter: Words):
        self.cutter, self.known = cutter, _Numbers(cutter)
        self.ids, self.seqs, self.chars = [], [], 0

    def add(self, doc_id, text: str) -> None:
        chunks = self.cutter.chunks(text)
        if chunks is None:
            seq = self.known.pack(self.cutter.find(text)) if text else b""
        else:
            first = self.known.pack(self.cutter.first(chunks[0]))
            seq = first + b"".join(map(self.known.__getitem__, chunks[1:]))
        self.ids.append(doc_id)
        self.seqs.append(seq)
        self.chars += len(text)

    def row(self, block: str, buckets: int) -> pa.RecordBatch:
        """The block's row: its documents' sequences, and its distinct words by bucket."""
        counts = np.array([len(s) // 4 for s in self.seqs], dtype="<u4")
        ids = pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64())], ["id"]).serialize()
        seq = np.frombuffer(b"".join(self.seqs), "<u4")
        self.seqs.clear()
        self.known.clear()
        words = list(self.known.number)  # in the order of their numbers; frequent ones get small numbers now
        by_count = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")
        renamed = np.empty(len(words), "<u4")
        renamed[by_count] = np.arange(len(words))
        docs = _pack(ids, counts, _planes(renamed[seq]))
        raw = [words[k].encode("utf-8") for k in by_count.tolist()]
        bucket = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % buckets
        order = np.argsort(bucket, kind="stable")
        lens = np.fromiter(map(len, raw), np.uint32, len(raw))
        told = [
            {"bucket": int(bucket[part[0]]), "payload": _pack(_planes(lens[part]), _planes(np.diff(part, prepend=0)), b"".join([raw[k] for k in part]))}
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
            if len(part)
        ]
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([docs], pa.binary()), pa.array([told], _WORDS)], ["block", "docs", "words"])


_BLOCK_SHAPE = "block string, docs binary, words array<struct<bucket:int,payload:binary>>"
_WORDS = pa.list_(pa.struct([("bucket", pa.int32()), ("payload", pa.binary())]))
_SHAPE = "block string, payload binary"
_ID_SCHEMA = pa.schema([("id", pa.int64())])
_TOKENS = "doc_id long, ids array<int>"


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """rows from a table in the shared folder, bucketed by key: what joins them by it comes to them.

    The catalogue knows the table only while it is written and opened.
    """
    spark = rows.sparkSession
    folder = scratch(spark, "bpe-blocks")
    name = f"pactline_{folder.rpartition('-')[2]}"
    rows.write.bucketBy(buckets, key).option("path", folder).option("compression", "none").saveAsTable(name)
    table = spark.table(name)
    table.schema  # opened: the plan holds the files and their buckets from here on
    spark.sql(f"DROP TABLE {name}")
    return table


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, ids array<int>): the tokens of every row's whole text. ranks: the bytes of a rank file."""
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = min(2 * n, MOST_BUCKETS)
    vocabulary = spark.sparkContext.broadcast(ranks)  # one file's bytes, under 1 MB

    def explode(batches):
        gc.disable()  # millions of words that live as long as the block: nothing for the collector to find
        cutter, serial = Words(pattern), 0
        part = TaskContext.get().partitionId()
        block = _Block(cutter)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                block.add(doc_id.as_py(), text.as_py() or "")
                if block.chars >= BLOCK_CHARS or len(block.ids) >= BLOCK_DOCS:
                    yield block.row(f"{part}-{serial}", buckets)
                    block, serial = _Block(cutter), serial + 1
        if block.ids:
            yield block.row(f"{part}-{serial}", buckets)

    def encode_words(batches):
        gc.disable()
        piece = codec(vocabulary.value, pattern)._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for payload in batch.column(1):
                lens, numbers, raw = _unpack(payload.as_py(), 3)
                ends = np.cumsum(_from_planes(lens)).tolist()
                raw, at, ids, sizes = bytes(raw), 0, [], []
                for end in ends:
                    w, at = raw[at:end], end
                    got = known.get(w)
                    if got is None:
                        if len(known) > CACHE:
                            known.clear()
                        got = piece(w)
                        got = known[w] = struct.pack(f"<{len(got)}I", *got)
                    ids.append(got)
                    sizes.append(len(got) // 4)
                out.append(_pack(numbers, _planes(np.array(sizes)), _planes(np.frombuffer(b"".join(ids), "<u4"))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "payload"])

    def assemble(docs_of: pa.Table, words_of: pa.Table) -> pa.Table:
        numbers, sizes, ids = [], [], []
        for payload in words_of.column("payload").to_pylist():
            got = _unpack(payload, 3)
            numbers.append(np.cumsum(_from_planes(got[0]), dtype=np.int64))
            sizes.append(_from_planes(got[1]))
            ids.append(_from_planes(got[2]))
        doc_ids, counts, seq = _unpack(docs_of.column("docs")[0].as_py(), 3)
        doc_ids = pa.ipc.read_record_batch(pa.py_buffer(doc_ids), _ID_SCHEMA).column(0)
        counts, seq = np.frombuffer(counts, "<u4").astype(np.int64), _from_planes(seq)
        empty = np.zeros(0, "<u4")
        number, size, flat = (np.concatenate([empty, *x]).astype(kind) for x, kind in ((numbers, np.int64), (sizes, np.int32), (ids, np.int32)))
        start, length = np.zeros(len(number), np.int32), np.zeros(len(number), np.int32)
        start[number] = np.cumsum(size) - size
        length[number] = size
        values = np.empty(int(length[seq].sum(dtype=np.int64)), np.int32)
        ends, at = np.empty(len(seq) + 1, np.int32), 0
        ends[0] = 0
        for k in range(0, len(seq), 1 << 18):
            part = seq[k : k + (1 << 18)]
            each = length[part]
            end = np.cumsum(each)
            n = int(end[-1])
            values[at : at + n] = flat[np.repeat(start[part] - (end - each), each) + np.arange(n)]
            ends[k + 1 : k + 1 + len(part)] = at + end
            at += n
        offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
        return pa.table({"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))})

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    blocks = _bucketed(rows.mapInArrow(explode, _BLOCK_SHAPE), "block", n)
    words = blocks.select("block", F.explode("words").alias("w")).select("block", "w.bucket", "w.payload")
    encoded = words.repartition(buckets, "bucket").select("block", "payload").mapInArrow(encode_words, _SHAPE)
    return blocks.select("block", "docs").groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(assemble, _TOKENS)


def decode(tokens: DataFrame, ranks: bytes, ids_col: str = "ids") -> DataFrame:
    """tokens with a column decoded (binary, in place of any such column): its ids joined to the token-byte table and put together. Null ids: empty."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(ranks)
    tokens = tokens.drop("decoded")

    def run(batches):
        table = byte_table(vocabulary.value)
        for part in slices(batches, DECODE_ROWS):
            if part.num_rows:
                column = part.column(ids_col)
                joined = table.take(column.flatten())  # a row per id: their bytes lie one after another
                if joined.null_count:
                    raise ValueError("an id without a token")
                ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                size = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1, 4 * joined.offset) if len(joined) else np.zeros(1, np.int32)
                raw = memoryview(joined.buffers()[2] or b"")
                out = [bytes(raw[a:b]) for a, b in zip(size[ends[:-1]].tolist(), size[ends[1:]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField("decoded", BinaryType())]))
