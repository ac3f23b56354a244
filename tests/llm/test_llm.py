"""Each operator against brute force, and its defined results for nulls, empties, ties, repeats and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from pactline.llm import ann, bpe, embed_dedup, html_text, line_dedup, packing, pii, simhash, token_counts, toxicity
from pactline.llm.common import components
from pactline.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)


def roots(n, edges):
    root = list(range(n))
    for _ in range(n):
        new = root[:]
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    return root


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(500, edges)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: want[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60, 200))) for _ in range(40)]
    texts += [t + " tail" for t in texts[:15]] + texts[:5] + [None, "", "one", "One two", " \t\n", "ä" * 50_000]
    rows = simhash.near_duplicates(docs_of(spark, texts)).collect()
    fps = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    assert fps == {k: simhash.fingerprint(t) for k, t in enumerate(texts)} and fps[len(texts) - 6] == 0
    edges = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(roots(len(texts), edges)))
    for t in [*texts, "A\x0bB\x1cC\x85D E", "Ärger ÄRGER ärger x y z", "a b c a b c a b c"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in parts]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_of_five_words_against_brute_force(spark):
    rng = random.Random(31)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(60, 260))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            new = base[:]
            for _ in range(rng.randint(1, max(1, len(base) // 60))):
                new[rng.randrange(len(new))] = rng.choice(words)
            texts.append(" ".join(new))
    texts += [texts[0], texts[0].upper(), None, "", " \t", "one", "One", "two words", "x " * 50_000]
    rng.shuffle(texts)

    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    told = [sets(t) for t in texts]
    n = len(texts)
    edges = [(a, b) for a in range(n) for b in range(a) if (not told[a] and not told[b]) or (told[a] and len(told[a] & told[b]) >= 0.8 * len(told[a] | told[b]))]
    root = roots(n, edges)
    docs = docs_of(spark, texts)
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert {k for k in range(n) if root[k] == k} <= kept  # no clean document goes
    dropped = sum(root[k] != k for k in range(n))
    assert n - len(kept) >= 0.9 * dropped > 50
    odd = docs.selectExpr("doc_id", "text", "1 AS __id", "2 AS __n", "3 AS id", "4 AS node", "5 AS hash", "'x' AS row", "6 AS place")
    odd = odd.union(odd.where("doc_id < 5")).union(odd.where("doc_id = 7").selectExpr("NULL", *odd.columns[1:]))
    got = simhash.keep_one(odd)
    assert got.columns == odd.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == [*((False, k) for k in sorted(kept)), (True, 0)]
    assert simhash.keep_one(odd.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("block", [256, 7])
def test_near_duplicates_leave_no_link_out(spark, monkeypatch, block):
    """Pairs barely at 0.8, short texts, texts mostly of frequent shingles, and a chain whose links' fingerprints differ much."""
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rng = random.Random(32)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for n in [*(6, 8, 9, 13, 14, 24, 40) * 6, *[120] * 20]:
        base = rng.choices(words, k=n)
        cut = (n - 4) // 5  # 0.8 to the word where 5 divides n - 4
        texts += [" ".join(x) for x in (base, base[cut:], base[: n - cut], base[cut + 1 :], base + rng.choices(words, k=max(1, (n - 4) // 4)))]
    common = rng.choices(words, k=60)
    texts += [" ".join([*common, *rng.choices(words, k=k % 9)]) for k in range(90)]
    text = rng.choices(words, k=100)
    for _ in range(30):  # each links to the next one only
        texts.append(" ".join(text))
        text = text[9:] + rng.choices(words, k=9)
    rng.shuffle(texts)
    told = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    edges = [(a, b) for a in range(len(texts)) for b in range(a) if 5 * len(told[a] & told[b]) >= 4 * len(told[a] | told[b])]
    root = roots(len(texts), edges)
    rows = docs_of(spark, texts)
    kept = {k for k, r in enumerate(root) if k == r}
    assert 50 < len(kept) < len(texts) - 200
    assert {r["doc_id"] for r in simhash.keep_one(rows).collect()} == kept
    # of two texts of one id the one that stays is the one that is compared
    two = spark.createDataFrame([(1, texts[0]), (2, texts[0] + " one"), (2, "a b c d e f g"), (3, "a b c d e f g")], "doc_id long, text string")
    stays = two.where("doc_id = 2").orderBy(F.xxhash64("text")).first()["text"]
    linked = 5 * len(told[0]) >= 4 * (len(told[0]) + 1) and stays == texts[0] + " one"
    got = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(two).collect())
    assert got == [(1, texts[0]), *([] if linked else [(2, stays)]), *([(3, "a b c d e f g")] if stays != "a b c d e f g" else [])]


def test_frequent_shingles_of_many_texts_and_chance_meetings(spark, monkeypatch):
    """The sample grows with the texts; texts that meet in one band only are no candidates."""
    monkeypatch.setattr(simhash, "SAMPLE", 10)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(20)) + (f" {passage}" if k % 10 == 0 else "")) for k in range(600)]
    hashes, n = simhash.frequent(spark.createDataFrame(rows, "node long, body string"), len(rows), 5)
    known = {int(h) for h in simhash.shingles(simhash.words_of(passage), 5) if h < 1 << 63}
    assert len(known) > 10 and known <= set(hashes.tolist()) and (n > 2).all()
    bands = spark.createDataFrame([(1, [5, 0, 0, 0]), (2, [4, 1, 0, 3]), (3, [5, -1, -1, -1])], "node long, bands array<int>")
    assert [tuple(r) for r in simhash.met_in_bands(bands).select("a", "b").collect()] == [(1, 2)]


def test_simhash_null_ids_and_other_columns(spark):
    rows = spark.createDataFrame([(None, "a b c", 1, "x"), (4, "a b c", 2, "y"), (None, "q r s t", 3, "z"), (4, "a b c", 2, "y")], "doc_id long, text string, fp int, component_id string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_duplicates(rows).collect())
    assert got == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def vectors(spark, rng):
    x = rng.normal(size=(400, 16))
    x[200:260] = x[0] + 0.02 * rng.normal(size=(60, 16))
    x[260:280] = x[1]
    rows = [(k, [float(v) for v in x[k]], int(k % 2 if k < 200 else 0)) for k in range(400)]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0, None], 1), (504, rows[0][1], None), (505, [1.0, 2.0], 0)]
    return rows, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")


def test_embedding_links_against_brute_force(spark):
    rows, df = vectors(spark, np.random.default_rng(3))
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    root = roots(400, list(zip(*np.nonzero(linked), strict=True)))
    for k in range(400):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (linked[k].sum(), root[k], root[k] == k)
    assert all((got[k]["n_links"], got[k]["component_id"]) == (0, k) for k in range(500, 506))


def test_nearest_neighbours_recall_and_order(spark):
    rows, df = vectors(spark, np.random.default_rng(4))
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    hits = 0
    for q in range(0, 400, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(400), -np.round(scores, 9)))[:20].tolist()
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(s - x[q] @ x[v]) < 1e-9 for _, v, s in mine)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(mine, mine[1:], strict=False))
        hits += len({m[1] for m in mine} & set(want))
    assert hits / 400 >= 0.9 and 500 not in got
    few = df.where("vec_id < 5")
    assert ann.search(few, few.where("vec_id = 0")).count() == 4
    assert ann.search(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0


def test_vectors_of_extreme_lengths_and_odd_rows(spark):
    rows = [(1, [1e200, 1.0], 0), (2, [2e200, 1.0], 0), (3, [-1e200, 3.0], 0), (4, [1e-200, 1e-200], 0), (5, [3e-200, 3e-200], 0), (6, [1.7e308, 1.7e308], 0), (7, [5e-324, 0.0], 0), (20, [1.0, 1.0], 0)]
    odd = [(None, [1.0, 1.0], 0), (20, [1.0, 1.0], 0), (4, [1e-200, 1e-200], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS dim", "3 AS vec", "4 AS norm", "5 AS band", "6 AS many")
    got = {}
    for r in embed_dedup.near_duplicates(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
    assert {k: v[0] for k, v in got.items() if k} == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (5, 4), 5: (5, 4), 6: (5, 4), 7: (2, 1), 20: (5, 4)}
    assert len(got[20]) == len(got[4]) == 2 and got[None] == [(0, None)]
    found = {}
    for r in ann.search(df, df).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = {k: np.array(v) for k, v, _ in rows}
    for k in x:
        with np.errstate(over="ignore", invalid="ignore"):
            want = sorted((-np.nan_to_num((x[k] * x[j]).sum(), nan=-np.inf, posinf=np.inf, neginf=-np.inf), j) for j in x if j != k)
        assert [(v, s) for _, v, s in sorted(found[k])] == [(j, -s) for s, j in want]


PII = ["mail a.b@x.example.com, c@d.e@f.g", "1.2.3.4 999.1.1.1 1.2.3.4.5", "4111 1111 1111 1111 and 4111111111111112", "+1 (555) 123-4567. +12", "", None, "@@ a@b @c.d x@y..z q@r.s.", "0" * 5000, "a" * 30000 + "@x.yz"]


def base_by_regex(t):
    t = t or ""
    email = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if len(t) < 20000 else [(0, 0, len(t))]
    ip = [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    card = [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and pii._luhn(d)]
    phone = [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted([*email, *ip, *card, *phone])


def test_personal_data(spark):
    rng = random.Random(5)
    texts = PII + ["".join(rng.choices("a1@.+-( )09", k=60)) for _ in range(400)]
    for t in texts:
        assert pii.base_spans(t) == base_by_regex(t), t
    got = {r["doc_id"]: r for r in pii.digest(docs_of(spark, texts)).collect()}
    for k, t in enumerate(texts):
        spans = base_by_regex(t)
        assert [got[k][f"n_{n}"] for n in pii.KINDS] == [sum(s[1] == j for s in spans) for j in range(4)]
        assert got[k]["base_sha256"] == pii.sha256_of(spans)
        assert {f"{pii.KINDS[a]}:{s}:{e}" for s, a, e in spans} <= set(got[k]["spans"].split(","))
    masked = pii.redact(docs_of(spark, texts), count_col="n_chars").collect()
    assert masked[0]["text"].startswith("mail [EMAIL], [EMAIL]") and masked[5]["text"] is None and masked[0]["n_chars"] == len(masked[0]["text"])


def planted_pii(n=1500, seed=21):
    """(text, wider spans that are personal data) with base spans, written-out forms and decoys among words."""
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(400)]

    def card():
        d = [4, *(rng.randrange(10) for _ in range(14))]
        d.append(next(x for x in range(10) if pii._luhn("".join(map(str, [*d, x])))))
        return "".join(map(str, d))

    out = []
    for _ in range(n):
        parts, spans = rng.choices(words, k=rng.randint(8, 40)), []
        c, num = card(), "".join(rng.choices("0123456789", k=16))
        name, host = rng.choice(words), rng.choice(("example", "mailer", "post")) + rng.choice((".com", ".org", ".de"))
        kind = rng.choice(("email", "ip", "card", "phone", "wmail", "wip", "wcard", "wphone", "no-card", "no-phone", "no-ip", "none"))
        before, span = {
            "email": ("mail", f"{name}@{host}"), "ip": ("server", "10.20.3.44"), "card": ("card", c), "phone": ("call", f"+1 212 555 {rng.randrange(1000, 9999)}"),
            "wmail": ("mail", f"{name} [at] {host.replace('.', ' [dot] ')}"), "wip": ("server", f"10[.]20[.]3[.]{rng.randrange(256)}"),
            "wcard": ("card", "/".join(c[i : i + 4] for i in range(0, 16, 4))), "wphone": ("call", f"212-555-{rng.randrange(1000, 9999)}"),
            "no-card": ("order", ".".join(num[i : i + 4] for i in range(0, 16, 4))), "no-phone": ("serial", f"012-155-{rng.randrange(1000, 9999)}"),
            "no-ip": ("version", f"{rng.randrange(300, 999)}[.]20[.]3[.]1"), "none": ("plain", "text"),
        }[kind]
        text = " ".join([*parts[:5], before]) + " "
        if kind.startswith("w"):
            spans.append((len(text), len(text) + len(span), kind))
        out.append((text + span + " " + " ".join(parts[5:]), spans))
    return out


def test_wider_spans_on_planted_data(spark):
    rows = planted_pii()
    got = {r["doc_id"]: r["spans"] for r in pii.digest(docs_of(spark, [t for t, _ in rows])).collect()}
    hits = wrong = wanted = 0
    for k, (text, spans) in enumerate(rows):
        base = {f"{pii.KINDS[a]}:{s}:{e}" for s, a, e in base_by_regex(text)}
        told = set(got[k].split(",")) - {""}
        assert base <= told
        added = {tuple(map(int, x.split(":")[1:])) for x in told - base}
        want = {(a, b) for a, b, _ in spans}
        hits, wrong, wanted = hits + len(added & want), wrong + len(added - want), wanted + len(want)
    assert hits / wanted > 0.9 and wrong / max(1, hits + wrong) < 0.1, (hits, wrong, wanted)


def test_personal_data_beyond_former_bounds(spark):
    many = ".".join(["1.2.3.4"] * 1) + "," + ",".join(["1.2.3.4"] * 70) + " 212-555-0100"
    base, tried, _ = pii.candidates("a" * 200 + "1.2.3.4-" * 80 + "@x.example.com 212-555-0100")
    assert not [x for x in tried if any(a < x[2] and x[0] < b for a, _, b in base)]
    inside = "".join(f"1.2.3.{k % 9}-" for k in range(70)) + "212-555-0100@x.example.com"
    base, tried, _ = pii.candidates(inside)
    assert len(base) > 70 and not tried
    assert pii.candidates(many)[1][0][1] == 3
    local, label = "b" * 300, "c" * 100
    assert [x[:3] for x in pii.candidates(f"{local} [at] {label} [dot] com")[1]] == [(0, 0, 300 + 6 + 100 + 10)]
    pii.candidates("a" * 200_000 + " at b" + ".c" * 50_000 + "1" * 100_000)  # in linear time
    none = docs_of(spark, ["x"]).where("doc_id < 0")
    assert pii.redact(none).count() == 0
    clash = docs_of(spark, ["mail a@b.co", None]).selectExpr("doc_id", "text", "1 AS base", "'x' AS wider", "2 AS verdicts", "3 AS every")
    got = pii.redact(clash.union(clash)).collect()
    assert len(got) == 4 and got[0]["text"] == "mail [EMAIL]" and got[0]["wider"] == "x" and pii.digest(clash).count() == 2


def toxic_table(spark):
    rng = random.Random(6)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(1200):
        bad = k % 6 == 0
        rows.append(" ".join(rng.choices(plain, k=60) + rng.choices(["vileness", "vilest", "odious"], k=3 * bad)))
        labels.append((k, 1, int(bad)))
    return docs_of(spark, [*rows, None, ""]), spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k in got if got[k]["held_out"]} - {1200, 1201} == set(held)
    assert sum(got[k]["predicted"] == (k % 6 == 0) for k in held) / len(held) > 0.97
    assert got[1200]["score"] == got[1201]["score"] == model.prior
    kept = {r["doc_id"] for r in toxicity.reject(docs, model).collect()}
    assert kept == {k for k in got if not got[k]["predicted"]}
    # search and votes by brute force: cosines of plain dictionaries over all examples
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    label = {k: int(k % 6 == 0) for k in range(1200)}
    df = {t: sum(t in {w[:4] for w in (x or "").split()} for x in rows.values()) for t in model.terms}

    def weights(text):
        n = Counter(w[:4] for w in (text or "").split())
        v = {t: (1 + math.log(c)) * math.log(1 + len(rows) / df[t]) for t, c in n.items() if t in df}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    examples = {int(k): weights(rows[int(k)]) for k in model.ids}
    for k in range(0, 1200, 25):
        v = weights(rows[k])
        near = sorted(((-sum(x * e.get(t, 0.0) for t, x in v.items()), j) for j, e in examples.items()))[:15]
        told = [(int(i), int(y), float(c)) for i, y, c in (e.split(":") for e in got[k]["evidence"].split())]
        assert np.allclose([-c for c, _ in near], [c for *_, c in told], atol=6e-4) and all(y == label[i] for i, y, _ in told)
        w = [(-c * model.weights[label[j]], label[j]) for c, j in near]
        assert np.isclose(got[k]["score"], np.interp(sum(x for x, y in w if y) / sum(x for x, _ in w), *model.steps))
    empty = toxicity.fit(docs, labels.where("doc_id < 0"))
    assert {r["score"] for r in toxicity.score(docs, empty).collect()} == {0.0}


TEXTS = ["Hello world's THE end.", None, "", "  a\n\n b \t c  ", "Zwölf Boxkämpfer İstanbul", "x\x1cy z", "word " * 3000, "日本語 テキスト 123", "<|endoftext|>", "é Å"]


def test_packing_round_trip(spark):
    blob = vocabulary("word_bpe_49k.json")
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    whole = packing.codec(blob).whole
    pieces: dict = {}
    seen = set()
    for r in packing.pack(docs_of(spark, texts), blob, with_ids=True).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        seen.add(r["sequence_id"])
        assert r["offset"] == 0 and r["length"] == 1 << r["bucket"] <= 4096
    assert len(seen) == sum(map(len, pieces.values()))
    for k, t in enumerate(texts):
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        got, at = [], 0
        for p in sorted(pieces[k], key=lambda r: r["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want)
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
            got += p["ids"]
            at += p["length"]
        assert got == want


def test_bpe_equals_the_library_and_round_trips(spark):
    blob = vocabulary("byte_bpe_multi_50k.tiktoken")
    library = bpe.codec(blob, public_tokenizers.PATTERN)
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choices("ab'sé1 \n\t.,\x85 字", k=40)) for _ in range(200)]
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs_of(spark, texts), blob, public_tokenizers.PATTERN), blob).collect()}
    for k, t in enumerate(texts):
        assert got[k]["ids"] == library.encode_ordinary(t or ""), t
        assert bytes(got[k]["decoded"]) == (t or "").encode()
    assert bpe.encode(docs_of(spark, texts).where("doc_id < 0"), blob, public_tokenizers.PATTERN).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div>{open}<h1>Title &amp; more</h1><p><b>First   block<br>goes on.<p>Short.</p><div class="ad">Buy</div><p>Last block of some length, with words enough.</p>
<form><p>Sign up</p></form>{close}<aside>Side</aside><section id="comments"><p>I agree</p></section><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ('<div id="content">', "</div>"), ("<main>", "</main>")])
def test_main_text(tags):
    want = "Title & more\nFirst block goes on.\nShort.\nLast block of some length, with words enough."
    assert html_text.main_text(PAGE.format(open=tags[0], close=tags[1])) == want


def test_pages_with_nothing_in_them(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, "u", "<p>", "x"), (4, "u", "plain text", "x"), (5, "u", "<nav>menu</nav>", "x"), (6, "u", "<" * 2000, "x"), (7, "u", "<article>" + "<p>para</p>" * 5000, "x")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert [got[k]["text"] for k in (1, 2, 3, 4, 5)] == ["", "", "", "plain text", ""]
    assert got[7]["n_chars"] == 5 * 5000 - 1


def prose(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choices([f"word{k}" for k in range(90)], k=rng.randint(9, 30))).capitalize() + "." for _ in range(n)]


def page(body):
    return f"<html><head><title>t</title></head><body><div><a href=1>home</a> <a href=2>more</a></div>{body}<div class='cookie-bar'>We use cookies.</div></body></html>"


@pytest.mark.parametrize("tag", ['<form id="aspnetForm">', '<div class="post form-factor">', '<div class="search-engine-history share-price">', '<div class="notice">'])
def test_marks_that_the_ratio_refutes(tag):
    name = tag[1:].split()[0]
    lines = prose(40)
    inner = "".join(f"<p>{x}</p>" for x in lines)
    assert html_text.main_text(page(f"{tag}{inner}</{name}>")) == "\n".join(lines)


def test_marks_that_hold():
    lines = prose(12)
    inner = "".join(f"<p>{x}</p>" for x in lines)
    extra = f"<form><p>Your mail</p></form><div class='share'><a href=1>a</a> <a href=2>b</a></div><div class='newsletter'>{prose(1, 3)[0]}</div><section class='comments'>{''.join(f'<p>{x}</p>' for x in prose(60, 2))}</section>"
    for wrap in ("article", "div", "main", "section"):
        assert html_text.main_text(page(f"<{wrap}>{inner}</{wrap}>{extra}")) == "\n".join(lines)
        assert html_text.main_text(page(f"<{wrap}>{inner}{extra}</{wrap}>")) == "\n".join(lines)
    assert html_text.main_text(page(f"<div><div>{inner}</div><div>{inner}</div></div>")) == "\n".join(lines + lines)
    deep = "<nav><ul>" + "<i>" * 30 + "<li>x" + "<b>" * 20 + "</ul></nav>" + f"<article><p>{'<i>' * 20}First.<p>Second.</article>"
    assert html_text.main_text(deep) == "First.\nSecond."
    html_text.main_text("<b>" * 60_000 + "</i>" * 60_000 + "<div>" * 3000 + "x")  # in reasonable time


def test_ratio_smoothing_and_threshold_by_hand():
    lines = [("x" * n, tags, 0, False) for n, tags in ((5, 4), (7, 3), (300, 2), (20, 2), (500, 2), (4, 6), (3, 5))]
    raw = [math.log1p(len(x) / t) for x, t, *_ in lines]
    kernel = [math.exp(-0.5 * d * d) for d in range(-3, 4)]
    smooth = [sum(w * raw[min(max(i + d, 0), 6)] for d, w in zip(range(-3, 4), kernel)) / sum(kernel) for i in range(7)]
    best = min(
        (sum((x - np.mean(g)) ** 2 for g in (lo, hi) for x in g), c)
        for c in sorted(smooth)[:-1]
        if (lo := [x for x in smooth if x <= c]) and (hi := [x for x in smooth if x > c])
    )[1]
    assert html_text.content_lines(lines).tolist() == [x > best for x in smooth]


def test_the_ratio_decides_where_pages_mark_nothing(spark, monkeypatch):
    """Pages with their article, nav and footer tags made plain and their marks taken off."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = [html_text.main_text(h) for h in pages]
    plain = [re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", h).replace('class="ad"', "") for h in pages]
    got = [html_text.main_text(h) for h in plain]
    same = sum(a == b for a, b in zip(got, want, strict=True))
    assert same > 0.7 * len(pages)
    monkeypatch.setattr(html_text, "content_lines", lambda lines: np.ones(len(lines), bool))
    without = [html_text.main_text(h) for h in plain]
    assert sum(a == b for a, b in zip(without, want, strict=True)) < same
    assert sum(a != b for a, b in zip(without, got, strict=True)) > 0.2 * len(pages)


def test_html_tables(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a &amp; b", "x", 5, "y")], "page_id long, url string, html string, TEXT string, N_Chars int, __html string")
    got = html_text.extract(rows)
    assert got.columns == ["page_id", "url", "__html", "text", "n_chars"]
    assert [tuple(r) for r in got.collect()] == [(1, "u", "y", "a & b", 5)]
    assert html_text.extract(rows.where("page_id > 1")).count() == 0
    assert [tuple(r) for r in html_text.extract(rows.select("html")).collect()] == [("a & b", 5)]


def test_token_ledger(spark, tmp_path):
    blob = vocabulary("byte_bpe_50k.tiktoken")
    library = bpe.codec(blob, public_tokenizers.PATTERN)
    docs = docs_of(spark, TEXTS)
    count = lambda d: token_counts.count_tokens(d, blob, public_tokenizers.PATTERN, "v1")
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    for _ in range(2):  # a batch that is committed again counts once
        ledger.commit("load", token_counts.inserts(count(docs)))
    total = sum(len(library.encode_ordinary(t or "")) for t in TEXTS)
    assert [(r["n_docs"], r["n_tokens"], r["n_chars"]) for r in ledger.totals().collect()] == [(len(TEXTS), total, sum(len(t or "") for t in TEXTS))]
    gone, new = docs.where("doc_id = 0"), docs_of(spark, ["a new text"], 3)
    ledger.commit("b2", token_counts.deletes(count(gone)).union(token_counts.revisions(count(docs.where("doc_id = 3")), count(new))))
    want = total - sum(len(library.encode_ordinary(TEXTS[k])) for k in (0, 3)) + len(library.encode_ordinary("a new text"))

    def told():
        return [(r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()]

    assert told() == [(len(TEXTS) - 1, want)]
    ledger.commit("b2", token_counts.inserts(count(docs)))  # complete: nothing happens
    assert told() == [(len(TEXTS) - 1, want)]
    # a commit while compact() runs is neither lost nor counted twice
    sums, meanwhile = ledger._sum, token_counts.inserts(count(new))

    def late(base, names):
        ledger._sum = sums
        out = sums(base, names)
        ledger.commit("late", meanwhile)
        return out

    ledger._sum = late
    ledger.compact()
    more = want + len(library.encode_ordinary("a new text"))
    assert told() == [(len(TEXTS), more)] and ledger._names("batches") == ["late"]
    for batch in ("load", "b2"):
        with pytest.raises(ValueError, match="folded"):
            ledger.commit(batch, token_counts.inserts(count(docs)))
    (tmp_path / "ledger" / "batches" / "cut-off").mkdir()  # a commit that ended half-way
    assert told() == [(len(TEXTS), more)]
    ledger.compact()
    assert told() == [(len(TEXTS), more)] and ledger._names("batches") == []
    with pytest.raises(ValueError):
        ledger.commit("late", meanwhile)
    ledger.commit("b3", token_counts.deletes(ledger.totals()))
    assert ledger.totals().count() == 0
    keys = docs.selectExpr("text", "CAST(NULL AS STRING) AS source", "CAST(NULL AS STRING) AS lang", "1 AS n_docs", "2 AS tokenizer")
    own = token_counts.Ledger(spark, str(tmp_path / "nulls"))
    own.commit("a", token_counts.inserts(count(keys)))
    own.commit("none", token_counts.inserts(count(keys.where("false"))))
    assert [(r["source"], r["lang"], r["n_tokens"]) for r in own.totals().collect()] == [(None, None, total)]


def test_line_chunks_against_brute_force(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(rng.choices([f"v{k}" for k in range(1000)], k=n))
    passage, run = line(60), "\n".join(line(12) for _ in range(30))
    texts = [f"{line(20)}\n{passage}\n{line(8)}", f"{passage}\n{line(9)}", f"{line(30)}\n{passage}", f"{line(10)}\n{run}\n{line(9)}", f"{run}\n{line(11)}", line(80), "license line\n" + line(10), "license line\n" + line(12), None, "", passage]
    docs = docs_of(spark, texts)
    docs = docs.union(docs.where("doc_id = 0"))  # a repeated row is the same document
    got = {}
    for r in line_dedup.remove(docs, count_col="n_chars").collect():
        assert got.setdefault(r["doc_id"], r["text"]) == r["text"] and r["n_chars"] == len(r["text"] or "")
    first: dict = {}
    for k, t in enumerate(texts):
        gone = []
        for a, b, *_ in line_dedup.chunks(t or ""):
            assert len((t or "")[a:b].split()) >= line_dedup.MIN_WORDS
            if first.setdefault(t[a:b], (k, a)) != (k, a):
                gone.append((a, b))
        assert got[k] == (t if not gone else line_dedup._without(t, gone))
        cover = line_dedup.covering(gone)
        assert len(cover) <= len(gone) and (not gone or line_dedup._without(t, cover) == got[k])
    assert passage in got[0] and not any(passage in (got[k] or "") for k in (1, 2, 10))
    assert got[6] == texts[6] and got[7] == texts[7] and run in got[3] and got[4] == texts[4].removeprefix(run + "\n")


def test_line_dedup_of_odd_tables(spark):
    rng = random.Random(14)
    passage = " ".join(rng.choices([f"v{k}" for k in range(1000)], k=60))
    texts = [f"head {k}\n{passage}\ntail {k}" for k in range(700)] + ["word " * 200_000, None, ""]
    docs = docs_of(spark, texts).selectExpr("doc_id", "text", "'MINE' AS __id", "'T' AS __tkey", "1 AS id", "2 AS tkey", "3 AS spans", "4 AS body", "5 AS row", "6 AS block")
    docs = docs.union(docs.where("doc_id = 3").selectExpr("NULL", *docs.columns[1:]))
    out = line_dedup.remove(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r["__id"] == "MINE" and r["spans"] == 3 for r in rows) and len(rows) == 704
    text = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}
    assert text[0] == texts[0] and all(text[k] == f"head {k}\ntail {k}" for k in range(1, 700)) and text[700] == texts[700]
    assert [r["text"] for r in rows if r["doc_id"] is None] == [texts[3]]  # more blocks than one, and null ids keep all


def test_every_passage_of_lines_holds_a_chunk():
    """Wherever it stands: exactly from 50 words on for lines of 8 words or more, with two stretches more for shorter ones."""
    rng = random.Random(9)
    line = lambda n: " ".join(rng.choices([f"v{k}" for k in range(5000)], k=n))
    for longest in (1, 3, 9, 20, 49):
        for _ in range(40):
            lines, least = [], 50 if longest >= 8 else 66
            while sum(len(x.split()) for x in lines) < least:
                lines.append(line(rng.randint(8, longest) if longest >= 8 else rng.randint(1, longest)))
                lines += [""] * rng.randint(0, 1)
            passage = "\n".join(lines).rstrip("\n")
            found = []
            for _ in range(2):
                text = "\n".join([*(line(rng.randint(1, 60)) for _ in range(rng.randint(0, 5))), passage, *(line(rng.randint(1, 60)) for _ in range(rng.randint(0, 5)))])
                where = text.index(passage)
                found.append({text[a:b] for a, b, *_ in line_dedup.chunks(text) if a >= where and b <= where + len(passage)})
            assert found[0] & found[1]
    same = "\n".join(["tick tock"] * 200)  # equal chunks of one document do not overlap
    spans = [s[:2] for s in line_dedup.chunks(same)]
    assert spans and all(b < a for (_, b), (a, _) in zip(spans, spans[1:], strict=False))
    assert line_dedup.chunks("") == line_dedup.chunks("\n\n") == line_dedup.chunks(line(49)) == []


def test_empty_tables_and_queries(spark):
    from pactline.llm.queries import queries

    none = docs_of(spark, ["x"]).where("doc_id < 0")
    assert simhash.near_duplicates(none).count() == pii.digest(none).count() == line_dedup.remove(none).count() == simhash.keep_one(none).count() == 0
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert len(queries()) == 11


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "simhash near-dedup", "pii", "packing"]
    out = corpus_pipeline.run(spark, SF).collect()
    kept = {r["doc_id"] for r in out}
    assert 0.5 * docs.count() < len(kept) <= docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_toxicity_counts_all_words_of_the_examples(spark):
    """A copy of a toxic example of wholly rare wording is found, and words that lean to clean texts count."""
    rng = random.Random(10)
    texts, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        own = [f"own{k}x{j}" for j in range(30)] if bad else rng.choices([f"fine{j}" for j in range(40)], k=30)
        texts.append(" ".join(own))
        labels.append((k, 1, int(bad)))
    taught = [k for k in range(0, 400, 5) if not toxicity.held_out(k)]
    docs = docs_of(spark, [*texts, *(texts[k] for k in taught[:10])])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for j, k in enumerate(taught[:10]):
        assert f"{k}:1:1.000" in got[400 + j]["evidence"]
    assert all(got[k]["evidence"] and got[k]["score"] < 0.3 for k in range(400) if k % 5)
    n = docs.count()
    df = sum(any(w[:4] == "fine" for w in r["text"].split()) for r in docs.collect())
    assert np.isclose(model.idf[model.number["fine"]], np.log(1 + n / df))
    assert toxicity.stem("12345678bad") == "1234" and toxicity.stem("«Bad»") == "Bad" and toxicity.stem("123") == ""


def test_block_max_search_skips_blocks_and_finds_what_a_full_scan_finds():
    rng = np.random.default_rng(12)
    terms = [f"t{k}" for k in range(800)]
    examples = []
    for k in range(600):  # four groups of terms, as four languages would have
        ids = np.unique(rng.integers(0, 200, 40) + 200 * (k % 4))
        examples.append((int(k), int(k % 7 == 0), ids, rng.integers(1, 9, len(ids))))
    examples += [(1000 + k, 0, examples[k][2], examples[k][3]) for k in range(5)]  # repeated texts: ties
    model = toxicity.Model(terms, rng.uniform(0.7, 5, 800), examples, (1.0, 3.0))
    dense = np.zeros((len(model.ids), 800))
    for j, (ids, v) in enumerate(model.vectors):
        dense[j, ids] = v
    seen = []
    for _, _, ids, n in [*examples[:40], (0, 0, np.array([5]), np.array([1])), (0, 0, np.arange(800), np.ones(800))]:
        ids, v = model.vector(ids, n)
        scores = dense[:, ids] @ v
        want = [j for j in np.lexsort((model.ids, -scores.round(12))) if scores[j] > 0][:15]
        near = model.nearest(ids, v)
        assert np.allclose([c for c, _ in near], scores[want]) and {model.ids[j] for _, j in near} == set(model.ids[want])
        seen.append((v.astype(np.float32) @ model.most[ids] >= near[-1][0]).mean())
    assert np.mean(seen[:40]) < 0.5  # more than half of all blocks cannot hold a neighbour
    assert model.nearest(np.zeros(0, int), np.zeros(0)) == []


def test_toxicity_of_odd_tables(spark):
    docs, labels = toxic_table(spark)
    none = docs.where("doc_id < 0")
    model = toxicity.fit(none, labels)
    assert model.prior == 0.0 and toxicity.score(none, model).count() == 0 and toxicity.reject(none, model).count() == 0
    twice = docs.union(docs_of(spark, ["zzzz " * 20_000], 0)).union(docs_of(spark, [None], 6)).withColumn("score", F.lit(1)).withColumn("body", F.lit("x")).withColumn("toxic", F.lit(9))
    model = toxicity.fit(twice, labels.union(labels))
    got = toxicity.score(twice, model).collect()
    assert len(got) == twice.count() and len({r["score"] for r in got if r["doc_id"] == 1200}) == 1
    assert toxicity.reject(twice, model).columns == twice.columns


def test_short_lines_and_tails_of_passages_are_found():
    """Passages of 51 to 56 words in lines of 1 to 7 words, and the last lines of longer ones, are covered in both texts."""
    rng = random.Random(11)
    line = lambda n: " ".join(rng.choices([f"v{k}" for k in range(5000)], k=n))
    for per_line in (1, 4, 6, 7, 12):
        for _ in range(40):
            passage = "\n".join(line(per_line) for _ in range(-(-51 // per_line) + rng.randint(0, 3)))
            found = []
            for _ in range(2):
                text = "\n".join([*(line(rng.randint(1, 9)) for _ in range(rng.randint(0, 9))), passage, *(line(rng.randint(1, 9)) for _ in range(rng.randint(0, 9)))])
                where = text.index(passage)
                found.append({(a - where, b - where) for a, b, *_ in line_dedup.chunks(text) if a >= where and b <= where + len(passage)})
            both = sorted(found[0] & found[1])
            assert both[0][0] == 0 and max(b for _, b in both) == len(passage)
            assert all(b[0] <= max(x[1] for x in both[: k + 1]) + 1 for k, b in enumerate(both[1:]))


def test_packing_takes_added_tokens_as_the_library_does():
    from tokenizers import Tokenizer

    blob = vocabulary("word_bpe_49k.json")
    fresh = Tokenizer.from_str(blob.decode("utf-8"))
    for text in ("<|endoftext|>", "a <|startoftext|>b <|endoftext|> c.", "x<|endoftext|>y", "<|ENDOFTEXT|> end", "plain text."):
        got = np.frombuffer(packing.codec(blob).ids(text), "<u4").tolist()
        assert got == fresh.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.codec(blob).ids("<|endoftext|>"), "<u4").tolist() == [49407]
