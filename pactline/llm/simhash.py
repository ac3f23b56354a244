"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits share a variant at distance at most one from each. So every distinct
fingerprint emits itself and its 64 one-bit variants, the variants are shuffled, and fingerprints that meet are verified
and linked. A variant has 65 possible neighbours, so no bucket can grow with the data.

Null texts count as empty; a text without words has fingerprint zero. Repeated rows share one fingerprint and component.
A null doc_id takes part but cannot name a component unless the whole component has none. Ids are cast to long. Other
columns are ignored.

keep_one, a stage on word shingles, takes five words and a Jaccard similarity of 0.8. Two such texts differ in some 5 of 64
bits, which no radius of two reaches surely. So it takes several fingerprints of 32 bits a text, of three-word shingles as
above, hashes each the same way, and compares the candidates' sets of five-word shingles (their 64-bit hashes). What
fingerprints leave apart meets by its rarest shingles, so that no link is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, components, cut, hot, marked, packed, partitions, slices, stored

SHINGLE, SEED, RADIUS, BITS = 3, 42, 2, 64
#: Of keep_one: words of a shingle, least similarity, 32-bit fingerprints a text.
WORDS, LEAST, BANDS = 5, 0.8, 4
#: Of keep_one: one text of so many tells frequent shingles, so many texts at least; most such shingles, texts of a shingle
#: that meet in one block.
SHARE, SAMPLE, FREQUENT, BLOCK = 6, 8192, 200_000, 256


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a whole text."""
    words = words_of(text)
    if not words:
        return 0
    hashes = shingles(words, SHINGLE)
    total = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long): the fingerprint of every row, as a signed long."""

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) that connect all pairs within RADIUS bits.

    Members of a bucket are within one bit of its variant, so within two of each other: a chain through the bucket keeps
    it connected with one edge per member. Every edge is verified all the same.
    """
    masks = ",".join(["0L", *(f"{1 << i}L" if i < 63 else "shiftleft(1L, 63)" for i in range(BITS))])
    # small rows, 65 times as many below; by the column itself the planner would take the aggregation's few partitions instead
    nodes = nodes.select("fp").repartition(partitions(nodes.sparkSession), F.xxhash64("fp"))
    variants = nodes.select("fp", F.expr(f"explode(transform(array({masks}), m -> m ^ fp))").alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    return (
        variants.select(F.col("fp").alias("a"), before.alias("b"))
        .where(F.col("b").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs."""
    prints = cut(fingerprints(docs, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    joined = components(links(nodes)).select(F.col("node").alias("fp"), "root")
    of_root = joined.join(nodes, "fp").groupBy("root").agg(F.min("first_id").alias("root_id"))
    named = cut(nodes.join(joined.join(of_root, "root"), "fp", "left").select("fp", F.coalesce("root_id", "first_id").alias("component_id"), "n"))
    # documents of a frequent fingerprint stay where they are: there are few such fingerprints
    often = F.broadcast(hot(named).drop("n"))
    rare = prints.join(often.select("fp"), "fp", "left_anti").join(named.drop("n"), "fp", "left")
    return prints.join(often, "fp").union(rare).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the word shingles in order, repeats included; of all words if they are fewer, of nothing if there are none."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(w), SEED) for w in zip(*(words[i:] for i in range(min(size, len(words)))), strict=False)], np.uint64)


def wide_print(hashes: np.ndarray, bands: int) -> np.ndarray:
    """A SimHash of bands words of 32 bits each: shingle hashes are mixed anew for every 64 bits."""
    n = -(-bands // 2)
    total = np.zeros((n, 64), np.int64)
    for k in range(0, len(hashes), 16384):
        part = hashes[k : k + 16384]
        for j in range(n):
            x = part + np.uint64((j * 0x9E3779B97F4A7C15) % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            total[j] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * total > len(hashes), axis=1, bitorder="little").view("<i4")
    return bits.ravel()[:bands]


def prints_of(texts: DataFrame, bands: int) -> DataFrame:
    """(id, hash, key, bands): digest of the words' sequence and SimHash bands of every row of (id, hash, body)."""

    def run(batches):
        for batch in slices(batches):
            keys, prints = [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                prints.append(wide_print(shingles(words, SHINGLE), bands))
            flat = pa.array(np.concatenate([np.zeros(0, "<i4"), *prints]), pa.int32())
            at = pa.array(np.arange(len(prints) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(at, flat)], ["id", "hash", "key", "bands"])

    return texts.mapInArrow(run, "id long, hash long, key binary, bands array<int>")


def met_in_bands(nodes: DataFrame) -> DataFrame:
    """(a, b): of (node, bands), neighbours by node among those that meet at a variant of a band, unless a quarter of all
    their bits differ. These are first links only: what is left out here meets by its first shingles."""
    masks = ",".join(["0", *(str(1 << i) if i < 31 else "shiftleft(1, 31)" for i in range(32))])
    # small rows, many times as many below
    met = nodes.repartition(partitions(nodes.sparkSession), F.xxhash64("node")).select("node", F.posexplode("bands").alias("band", "value"))
    met = met.select("node", F.expr(f"explode(transform(array({masks}), m -> (shiftleft(CAST(band AS BIGINT), 32) | ((value ^ m) & 4294967295L))))").alias("variant"))
    before = F.lag("node").over(Window.partitionBy("variant").orderBy("node"))
    pairs = met.select(F.col("node").alias("b"), before.alias("a")).where("a IS NOT NULL").distinct()
    # unrelated texts that meet by chance in one band grow with the square of the texts, and differ in half of the other bands' bits
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("bands").alias(f"of_{side}")), side)
    far = F.aggregate(F.zip_with("of_a", "of_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return pairs.where(far <= 8 * F.size("of_a")).select("a", "b")


def shingle_sets(batches, size: int, pick=None):
    """(node, hashes, size): the sorted set of a text's shingle hashes, or what pick leaves of it, and the set's size."""
    for batch in slices(batches, 128):
        got = [np.unique(shingles(words_of(t), size)) for t in batch.column(1).to_pylist()]
        sizes = pa.array([len(x) for x in got], pa.int32())
        got = [pick(x) for x in got] if pick else got
        at = pa.array(np.cumsum([0, *map(len, got)], dtype=np.int32))
        flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *got]).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, flat), sizes], ["node", "hashes", "size"])


SETS = "node long, hashes array<long>, size int"


def linked(pairs: DataFrame, bodies: DataFrame, size: int, least: float) -> DataFrame:
    """Of the pairs (a, b) those whose sets of shingles have a Jaccard similarity of at least `least`."""
    asked = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    near = marked(bodies, bitmap(asked, "node"), "node").where("maybe").drop("maybe").join(asked, "node")
    near = near.select("node", "body").mapInArrow(lambda batches: shingle_sets(batches, size), SETS)
    both = pairs.join(near.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), "a").join(near.select(F.col("node").alias("b"), F.col("hashes").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    told = both.select("a", "b", shared.alias("shared"), (F.size("of_a") + F.size("of_b") - shared).alias("either"))
    return cut(told.where((F.col("either") > 0) & (F.col("shared") >= F.lit(least) * F.col("either"))).select("a", "b"))


def frequent(bodies: DataFrame, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes that stand in three or more texts of a sample, ascending, and their counts. They only order the
    shingles: what is missing here costs time, no link. The sample grows with the texts: from one of fixed size a shingle
    would need the more texts to be told frequent the more there are, and the pairs that meet at it grow with their square."""
    few = min(1 << 20, (SAMPLE << 20) // max(1, total) + 1)
    share = max((1 << 20) // SHARE, few)
    spot = F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    some = bodies.where(spot < share).mapInArrow(lambda batches: shingle_sets(batches, size), SETS).select("node", F.explode("hashes").alias("h"))
    # rare shingles come by their hash, so most first ones are of its lower half: the others of few texts only are counted
    low = F.col("h") >= 0
    counts = some.where(low | (spot < few)).groupBy("h").agg(F.count("*").alias("n")).where("n > 2").withColumn("n", F.when(low, F.col("n")).otherwise(F.col("n") * share / few).cast("long"))
    often = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    hashes, n = often["h"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def met_in_prefixes(bodies: DataFrame, total: int, size: int, least: float) -> DataFrame:
    """(token, node, size): shingles that two texts or more have among their first, with those texts.

    All texts order their n shingles alike, frequent ones last. Texts of similarity `least` have one at least in common among
    the first n - ceil(least * n) + 1 of each, so every such pair meets.
    """
    names = bodies.sparkSession.sparkContext.broadcast(frequent(bodies, total, size))

    def run(batches):
        often, n = names.value

        def first(hashes):
            if len(often):
                at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
                hashes = hashes[np.argsort(np.where(often[at] == hashes, n[at], 0), kind="stable")]
            return hashes[: len(hashes) - math.ceil(least * len(hashes) - 1e-6) + 1]

        yield from shingle_sets(batches, size, first)

    tokens = bodies.mapInArrow(run, SETS).select(F.explode("hashes").alias("token"), "node", "size")
    of_token = Window.partitionBy("token").orderBy("node")
    met = tokens.select("*", F.lag("node").over(of_token).alias("before"), F.lead("node").over(of_token).alias("after"))
    return stored(met.where("before IS NOT NULL OR after IS NOT NULL").drop("before", "after"), "met")


def pairs_apart(met: DataFrame, joined: DataFrame, least: float) -> DataFrame:
    """(a, b, near): pairs of different components (joined: node, root) that meet and may have the similarity `least`.

    Of two texts with s shingles in common among their first, all others in common lie beyond the first ones of either. What
    can't reach the overlap that `least` asks for is left out, and no other pair. A token of many texts is dealt over a grid.
    """
    named = stored(met.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    mixed = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    rows = named.join(mixed.where("lo < hi").drop("lo", "hi"), "token").withColumn("spot", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.select("token", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("size").alias("sa"), F.col("spot").alias("row"), every.alias("col"))
    right = rows.select("token", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("size").alias("sb"), every.alias("row"), F.col("spot").alias("col"))
    both = left.join(right, ["token", "row", "col"]).where("a < b AND ra != rb").where(F.least("sa", "sb") >= F.lit(least) * F.greatest("sa", "sb") - 1e-6)
    counted = both.groupBy("a", "b", "sa", "sb").agg(F.count("*").alias("s"))
    beyond = F.ceil(F.lit(least) * F.greatest("sa", "sb") - 1e-6) - 1
    able = counted.where(F.col("s") + beyond >= F.lit(least / (1 + least)) * (F.col("sa") + F.col("sb")) - 1e-6)
    return stored(able.select("a", "b", (F.col("s") / F.least("sa", "sb")).alias("near")), "apart")


def similar(docs: DataFrame, id_col: str, text_col: str, size: int, least: float, bands: int) -> tuple[DataFrame, DataFrame]:
    """(ids that name a group, ids that do not or are repeated). A text's id is the smallest of its words' sequence.

    Two texts are candidates if in one of the bands their fingerprints differ in two bits at most: every band emits itself
    and its 32 one-bit variants, and texts that meet at a variant are candidates with their neighbours there. Candidates
    link if the Jaccard similarity of their sets of shingles is at least `least`. These links join most groups, but not all:
    fingerprints of similar texts may differ in more bits, and a neighbour may be of another group. So pairs in different
    components that share one of their first shingles are compared too, first each text's nearest, then all that are still apart.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).where("id IS NOT NULL")
    texts = texts.select("id", F.xxhash64("body").alias("hash"), "body")
    # rows that repeat an id are one document: the one whose text has the smallest hash
    one = prints_of(texts, bands).groupBy("id").agg(F.min(F.struct("hash", "key", "bands")).alias("of"), F.count("*").alias("n"))
    one = stored(one.select("id", "of.*", "n"), "prints")
    nodes = cut(one.groupBy("key").agg(F.min(F.struct("id", "hash", "bands")).alias("of")).select(F.col("of.id").alias("node"), "of.hash", "of.bands"))

    # texts of nodes; only those of repeated words or ids move
    other = one.join(nodes.select(F.col("node").alias("id")), "id", "left_anti").select("id").union(one.where("n > 1").select("id"))
    told = marked(texts, bitmap(other, "id"), "id")
    moved = told.where("maybe").join(nodes.select(F.col("node").alias("id"), "hash"), ["id", "hash"]).groupBy("id").agg(F.min("body").alias("body"))
    bodies = told.where("NOT maybe").select(F.col("id").alias("node"), "body").union(stored(moved, "moved"))

    links = linked(cut(met_in_bands(nodes)), bodies, size, least)
    met = met_in_prefixes(bodies, nodes.count(), size, least)
    apart = pairs_apart(met, components(links), least)
    nearest = apart.select("a", "b", "near").union(apart.select("b", "a", "near")).groupBy("a").agg(F.max(F.struct("near", "b")).alias("of"))
    nearest = cut(nearest.select(F.least("a", "of.b").alias("a"), F.greatest("a", "of.b").alias("b")).distinct())
    links = links.union(linked(nearest, bodies, size, least))
    joined = components(links)
    for side in ("a", "b"):
        apart = apart.join(joined.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
    apart = apart.where("coalesce(ra, a) != coalesce(rb, b)").select("a", "b").join(nearest, ["a", "b"], "left_anti")
    joined = components(links.union(linked(cut(apart), bodies, size, least)))

    kept = nodes.join(joined, "node", "left").where("coalesce(root, node) = node").select(F.col("node").alias("id"))
    # ids whose rows are not the only one of a kept text
    doubtful = one.join(kept.withColumn("kept", F.lit(True)), "id", "left").where("n > 1 OR kept IS NULL").select("id")
    return kept, doubtful


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, least: float = LEAST, bands: int = BANDS) -> DataFrame:
    """docs with one row of each near-duplicate group: the one of the smallest id.

    Groups are connected by links of Jaccard similarity `least` over shingles of `size` words; equal sequences of words
    are one text. Texts with fewer words are one shingle; all texts without words are one group. Rows with a null id
    cannot be told apart by it and stay. Rows that repeat an id are one document: the one whose text has the smallest hash
    stays for it.
    """
    kept, doubtful = similar(docs, id_col, text_col, size, least, bands)
    rows = packed(docs, id=F.col(id_col).cast("long"), hash=F.xxhash64(F.col(text_col).cast("string")))
    rows = marked(rows, bitmap(doubtful, "id"), "id")
    plain = rows.where("NOT maybe OR id IS NULL").select("row.*")  # these stay, and need not move
    asked = rows.where("maybe AND id IS NOT NULL").join(kept, "id").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("hash")))
    return plain.union(asked.where("place = 1").select("row.*"))
