"""Packing by power-of-two decomposition: a document's tokens are cut into pieces of binary lengths.

A document of n tokens gives floor(n / top) pieces of the top length and one piece for every further bit of n, longest
first. Each piece is a sequence of its own in the bucket of its length, so no sequence crosses documents and none has
padding. The ids come from a word-level BPE file of the tokenizers library; white space ends a word there, so a chunk
between white space is encoded once a task and looked up from then on.

Null and empty texts have the end token only. Repeated rows are packed once each. Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import slices

TOP, END, CACHE = 4096, 2, 250_000
_ODD = "\x1c\x1d\x1e\x1f"
_WORD_END = b"\xff"  # never a byte of UTF-8


def _byte_chars() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordCodec(dict):
    """Chunk without white space to its ids, as bytes of little-endian 32-bit numbers.

    A vocabulary whose ids follow the order of its merges is a rank table: the mark of a word's end becomes a byte that
    UTF-8 never has and that joins the byte before it first of all. Any other vocabulary goes through its own library.
    """

    def __init__(self, blob: bytes):
        super().__init__()
        self.whole = Tokenizer.from_str(blob.decode("utf-8"))
        told = json.loads(blob)
        self.added = [t["content"] for t in told.get("added_tokens") or []]
        model, self.core = told["model"], None
        pre = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
        if model.get("end_of_word_suffix") == "</w>" and kinds == ["NFC", "Replace", "Lowercase"] and pre[0].get("type") == "Split":
            chars = _byte_chars()
            ranks = {}
            for token, i in model["vocab"].items():
                word_end = token.endswith("</w>")
                ranks[bytes(chars[c] for c in (token[:-4] if word_end else token)) + _WORD_END * word_end] = i
            pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            made = [model["vocab"]["".join(m)] for m in pairs]
            if made == sorted(made) and min(made) >= 512:
                self.find = regex.compile(pre[0]["pattern"]["Regex"]).findall
                self.core = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        if self.core is None:
            ids = self.whole.encode(chunk, add_special_tokens=False).ids
        else:
            plain = chunk.lower() if chunk.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", chunk)])
            encode = self.core.encode_single_piece
            if plain.isalpha():
                ids = encode(plain.encode("utf-8") + _WORD_END)
            elif plain[-1:] in (".", ",") and plain[:-1].isalpha():
                ids = encode(plain[:-1].encode("utf-8") + _WORD_END) + encode(plain[-1].encode("utf-8") + _WORD_END)
            else:
                ids = [i for p in self.find(plain) for i in encode(p.encode("utf-8") + _WORD_END)]
        got = self[chunk] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, as bytes."""
        # separators that str.split takes for white space and the vocabulary does not, and strings of added tokens
        if any(c in text for c in _ODD) or any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(2)
def codec(blob: bytes) -> WordCodec:
    return WordCodec(blob)


def piece_lengths(n: int, top: int = TOP) -> list[int]:
    """Binary lengths that add up to n, longest first, none over top."""
    rest = n % top
    return [top] * (n // top) + [1 << k for k in range(top.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and ids, if asked for).

    bucket is the power of two; write with partitionBy("bucket") to get files of equal lengths.
    """
    if top < 1 or top & (top - 1):
        raise ValueError("top must be a power of two")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one file's bytes, under 2 MB
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", *(["ids"] if with_ids else [])]
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * with_ids

    def run(batches):
        words, mark = codec(shared.value), np.array([end], "<u4").tobytes()
        try:
            yield from cut_up(batches, words, mark)
        finally:
            words.clear()  # the worker and its codec outlive the task; what it looked up need not

    def cut_up(batches, words, mark):
        for batch in slices(batches):
            cols: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.ids(text or "") + mark
                start, n = 0, len(ids) // 4
                for length in piece_lengths(n, top):
                    part = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, start, length, zlib.crc32(part), n, length.bit_length() - 1)
                    for col, x in zip(cols, row + ((np.frombuffer(part, "<i4"),) if with_ids else ()), strict=True):
                        col.append(x)
                    start += length
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names)

    pieces = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, shape)
    # each piece is a sequence: its number follows from its place in the input's partitions, so a retry repeats it
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
