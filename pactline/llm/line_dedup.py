"""Removes passages of lines that stand in several documents, by content-defined line chunks.

Every line has a hash. A rolling hash over the line hashes names the shortest run of lines from each line on that holds
min_words words (one line, if it is that long), and the shortest one that ends with each line. All of them are chunks, and
chunks overlap. So every passage of whole lines with min_words words that stands elsewhere too is covered by chunks of its
own from its first line with words to its last, however short its lines are.

Chunks are looked for in all documents: those whose hash stands in more than one place meet again with their bytes, are
compared with the first of their kind (smallest id, then place), and go where they are equal. The first stays; a chunk that
overlaps an equal one of its own document does not count.

Hashes are counted before any text moves, and only documents' repeated passages are shuffled for the comparison. Places of
the most frequent chunks meet them by broadcast (there are HOT such chunks at most), and are dealt over blocks of bounded
size for the comparison. Null texts stay null, empty ones empty. Rows that repeat an id and its text are one document and
are treated alike; rows with a null id keep all they have. Ids are cast to long. Other columns pass through, whatever their
names.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, each, hot, marked, packed, slices, stored

MIN_WORDS = 50
#: Chunks of this share of all repeated places are broadcast; places of a chunk that one task compares.
HOT, ROWS_EACH = 1000, 256
#: Two primes under 2**61, the fields of the rolling hash, with a base each.
_FIELDS = ((2**61 - 1, 0x9E3779B97F4A7C1), (2**61 - 31, 0x1B873593CC9E2D5))


def _rolling(hashes: list[int], prime: int, base: int) -> tuple[list[int], list[int]]:
    """Hashes of all beginnings, and the powers that take a beginning off a longer one."""
    sums, powers = [0], [1]
    for h in hashes:
        sums.append((sums[-1] * base + h) % prime)
        powers.append(powers[-1] * base % prime)
    return sums, powers


def chunks(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int]]:
    """(start, end, h1, h2) of each chunk, in characters, by start; no two equal ones overlap."""
    lines = text.split("\n")
    words = [len(line.split()) for line in lines]
    if sum(words) < min_words:
        return []
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    hashes = [xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) for line in lines]
    (p1, b1), (p2, b2) = _FIELDS
    (s1, w1), (s2, w2) = _rolling(hashes, p1, b1), _rolling(hashes, p2, b2)

    runs = set()  # first line, line after the last
    end = held = 0
    for k, n in enumerate(words):
        while held < min_words and end < len(lines):
            held, end = held + words[end], end + 1
        if held < min_words:
            break
        if n:
            runs.add((k, end))
        held -= n
    begin = held = 0
    for k, n in enumerate(words):
        held += n
        while held - words[begin] >= min_words:
            held, begin = held - words[begin], begin + 1
        while held >= min_words and not words[begin]:
            begin += 1
        if n and held >= min_words:
            runs.add((begin, k + 1))

    out, upto = [], {}
    for k, after in sorted(runs):
        size = after - k
        h1, h2 = (s1[after] - s1[k] * w1[size]) % p1, (s2[after] - s2[k] * w2[size]) % p2
        if upto.get((h1, h2), 0) <= k:
            upto[h1, h2] = after
            out.append((starts[k], starts[after - 1] + len(lines[after - 1]), h1, h2))
    return out


def covering(spans: list[tuple]) -> list[tuple]:
    """Of spans (start, end, ...) as few as cover all that they cover together."""
    out: list[tuple] = []
    best, upto = None, -1
    for span in sorted(spans):
        if best is not None and span[0] > upto:
            out.append(best)
            best, upto = None, best[1]
        if span[1] > upto and (best is None or span[1] > best[1]):
            best = span
    return out if best is None else [*out, best]


def _without(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without the given chunks, each with the line end after it (the last one: before it)."""
    parts, at = [], 0
    for start, end in sorted(set(gone)):
        parts.append(text[at:start])
        at = max(at, min(len(text), end + 1))
    parts.append(text[at:])
    out = "".join(parts)
    # only a chunk that the text ends with has no line end after it
    return out[:-1] if out.endswith("\n") and any(end == len(text) for _, end in gone) else out


_SPAN = "id long, tkey long, start int, end int, h long"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, tkey, body): the columns as they are, and what names a document's text. The text is in row as well."""
    body = F.col(text_col).cast("string")
    return packed(docs, id=F.col(id_col).cast("long"), tkey=F.xxhash64(body), body=body)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, tkey, spans array<struct<start, end>>): per document (id and hash of its text) the chunks that go."""

    def cut_up(batches):
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(5)]
            for doc_id, tkey, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start, end, h1, h2 in chunks(text or "", min_words):
                    h = (h1 * 0x9E3779B97F4A7C15 + h2) % 2**64
                    for col, x in zip(cols, (doc_id, tkey, start, end, h - 2**64 if h >= 2**63 else h), strict=True):
                        col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "tkey", "start", "end", "h"])

    texts = _keyed(docs, id_col, text_col).where(F.col("id").isNotNull()).select("id", "tkey", "body")
    spans = stored(texts.mapInArrow(cut_up, _SPAN), "line-chunks")
    # most hashes stand in one place: they are counted by themselves, and their rows then stay where they are
    twice = bitmap(spans.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "h")
    spans = marked(spans, twice, "h").where("maybe").drop("maybe")
    # a row that repeats an id and its text counts here, but is the same place below
    place = F.struct("id", "tkey", "start")
    first = stored(spans.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "line-first")
    often = F.broadcast(hot(first, share=HOT))
    rare = spans.join(often.select("h"), "h", "left_anti").join(first, "h")
    wanted = spans.join(often, "h").unionByName(rare)
    is_first = (F.col("id") == F.col("first.id")) & (F.col("tkey") == F.col("first.tkey")) & (F.col("start") == F.col("first.start"))
    by_doc = stored(
        wanted.select("id", "tkey", F.struct("start", "end", "h", is_first.alias("is_first"), F.ceil(F.col("n") / F.lit(ROWS_EACH)).cast("int").alias("blocks")).alias("span"))
        .groupBy("id", "tkey")
        .agg(F.collect_set("span").alias("spans")),  # no more than the document has chunks
        "line-documents",
    )

    def passages(batches):
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, tkey, body, spans_of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                told = [(s["start"], s["end"], s["h"], s["is_first"], s["blocks"]) for s in spans_of]
                for start, end, *more in [*(t for t in told if t[3]), *covering([t for t in told if not t[3]])]:
                    for col, x in zip(cols, (doc_id, tkey, start, end, *more, body[start:end]), strict=True):
                        col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]
            names = ["id", "tkey", "start", "end", "h", "is_first", "blocks", "part"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    some = marked(texts, bitmap(by_doc, "id", "tkey"), "id", "tkey").where("maybe").drop("maybe")
    parts = some.join(by_doc, ["id", "tkey"]).mapInArrow(passages, f"{_SPAN}, is_first boolean, blocks int, part string")
    parts = stored(parts, "line-passages")
    # the first of a kind goes to each block of its places
    bytes_of = parts.where("is_first").groupBy("h").agg(F.first("part").alias("first_part"), F.first("blocks").alias("blocks"))
    bytes_of = bytes_of.select("h", "first_part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    others = parts.where("NOT is_first").withColumn("block", F.pmod(F.xxhash64("id", "start"), F.col("blocks")).cast("int"))
    same = others.join(bytes_of, ["h", "block"]).where("part = first_part")
    return same.groupBy("id", "tkey").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, count_col: str | None = None) -> DataFrame:
    """docs with text_col less the repeated passages; count_col, if there is one, becomes the new number of characters."""
    gone = stored(repeated(docs, id_col, text_col, min_words), "line-gone")
    rows = marked(_keyed(docs, id_col, text_col), bitmap(gone, "id", "tkey"), "id", "tkey")
    touched = rows.where("maybe").join(gone, ["id", "tkey"], "left")
    changed, row = F.col("spans").isNotNull(), F.col("row")
    text = F.when(changed, _cut_out()(F.when(changed, F.col("body")), F.col("spans")))
    touched = touched.select("row", "spans", text.alias("rest"))
    out = {text_col: F.when(changed, F.col("rest")).otherwise(row[text_col])}
    if count_col and count_col in docs.columns:
        n = F.coalesce(F.length("rest"), F.lit(0)).cast(docs.schema[count_col].dataType)
        out[count_col] = F.when(changed, n).otherwise(row[count_col])
    touched = touched.select(*(out.get(c, row[c]).alias(c) for c in docs.columns))
    return rows.where("NOT maybe").select("row.*").union(touched)


def _cut_out():
    @F.arrow_udf("string")
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array(
            [t if not s else _without(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(each(texts), each(spans), strict=True)], pa.string()
        )

    return run
