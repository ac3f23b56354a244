"""Personal data by weak supervision.

Base patterns find e-mail addresses, IP numbers, card numbers and phone numbers that pass their checks; these spans always
stand. Wider patterns propose further spans of the same kinds (written-out and spaced addresses, IPv6, IP numbers with
bracketed dots, national phone numbers, card numbers in other groupings). Six labelers vote on every candidate, base
matches that fail their checks among them, with yes, no or nothing: the regex checks, the written form, gazetteers
(top-level domains, issuers, calling codes), context words before it, what touches it, and the marks that set it off.
Votes are counted by kind and pattern over all documents; expectation-maximisation on those counts estimates how reliable
each labeler is and how likely each pattern is personal data. With these likelihoods as labels a logistic span classifier
is trained on a bounded sample of candidates (SAMPLE a kind of match, by a hash of their place): its features are the
votes, the span's shape, length and ends, and the words around it. Wider spans that it gives at least ACCEPT are added.

Null texts count as empty. Repeated rows give repeated results, rows with a null id are searched too. Ids are cast to
long. Offsets are code points, ends exclusive. In the digest, n_<kind> counts the base spans; spans lists base and added
ones. An added span never overlaps a base span.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, each, give_back, slices

KINDS = ("email", "ip", "card", "phone")
ACCEPT, BEFORE, SAMPLE, HASHED = 0.9, 48, 4000, 2048

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a run of digits can only start a match at its first digit, so none is tried twice
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_WIDE_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:\[at\]|\(at\)|\{at\})\x20?|\x20at\x20|\x20@\x20?|@\x20)[A-Za-z0-9-]++(?:(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\[\.\])\x20?|\x20dot\x20|\x20\.\x20|\.)[A-Za-z0-9-]++)+",
    re.IGNORECASE,
)
_BRACKET_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
_WIDE_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_WIDE_CARD = re.compile(r"(?<![0-9.])[0-9]{4}([._/ ]|\x20-\x20|\x20\x20)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_WIDE_PHONE = re.compile(r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[\x20.-][0-9\x20.-]{5,14}[0-9]|\([0-9]{2,5}\)\x20?[0-9]{3,4}[\x20.-][0-9]{3,5}|[0-9]{3}[.\x20-][0-9]{3}[.\x20-][0-9]{4})(?![0-9])")

# Public registries' entries that the gazetteers know.
TLDS = frozenset("com org net edu gov mil int info biz io dev app co uk de fr es it nl be ch at se no dk fi pl pt ie us ca au nz jp cn in br mx ru eu".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "354", "358", "420", "421")
CONTEXT = {
    "email": ("mail", "contact", "write", "address", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr", "login", "from", "node"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "contact", "telefon", "móvil", "appel"),
}
AGAINST = ("version", "isbn", "issn", "order", "invoice", "section", "figure", "table", "chapter", "release", "build", "serial", "sku", "doi")
_WORDS = re.compile(r"[^\W\d_]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """Leftmost matches, each @ looked at once: the longest local part before it that no earlier match holds."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _shaped(text: str):
    """(kind, start, end, passes) of every base match, leftmost and non-overlapping by kind."""
    for start, end in _emails(text):
        yield 0, start, end, True
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            yield 1, m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p[-3:] if not p[:-3].strip("0") else "999") <= 255 for p in m.groups())
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if m.end() - m.start() <= 37 else ""
            yield 2, m.start(), m.end(), 12 <= len(d) <= 19 and _luhn(d)
        if "+" in text:
            for m in _PHONE.finditer(text):
                yield 3, m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, by start and kind."""
    return sorted((start, kind, end) for kind, start, end, passes in _shaped(text or "") if passes)


def _wide(text: str):
    low = text.lower()
    if " at " in low or " @" in low or "@ " in low or "[at]" in low or "(at)" in low or "{at}" in low:
        for m in _WIDE_EMAIL.finditer(text):
            yield 0, m.start(), m.end()
    if not _DIGIT.search(text):
        return
    if text.count(":") >= 3:
        for m in _WIDE_IP.finditer(text):
            yield 1, m.start(), m.end()
    if "[" in text or "(.)" in text:
        for m in _BRACKET_IP.finditer(text):
            yield 1, m.start(), m.end()
    for m in _WIDE_CARD.finditer(text):
        yield 2, m.start(), m.end()
    for m in _WIDE_PHONE.finditer(text):
        yield 3, m.start(), m.end()


def _votes(text: str, kind: int, start: int, end: int, passes: bool | None) -> tuple[int, ...]:
    """Each labeler's vote: 0 nothing, 1 yes, 2 no."""
    span = text[start:end]
    digits = _digits(span) if kind else ""
    if kind == 0:
        tld = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]} "))[-1].lower()
        form = 1 if passes or "[" in span or "(" in span or "{" in span else 2 if " at " in span and "." in span else 0
        known = 1 if tld in TLDS else 2
    elif kind == 1:
        try:
            address = ipaddress.ip_address(re.sub(r"\[\.\]|\(\.\)|\[dot\]", ".", span, flags=re.IGNORECASE))
            form, known = 1, 1 if not (address.is_unspecified or address.is_reserved) else 2
        except ValueError:
            form, known = 2, 0
    elif kind == 2:
        form = 1 if len(digits) in (13, 14, 15, 16, 19) and _luhn(digits) else 2
        known = 1 if digits[:1] in ("4", "5", "6", "2") or digits[:2] in ("34", "37", "30", "36", "38") else 2
    else:
        bare = digits[2:] if digits.startswith("00") else digits
        form = 1 if 9 <= len(bare) <= 15 and span.count("(") == span.count(")") else 2
        plus = span.startswith("+") or digits.startswith("00")
        known = (1 if bare.startswith(CALLING) else 2) if plus else (1 if len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789" else 2)
    before = [w.lower() for w in _WORDS.findall(text[max(0, start - BEFORE) : start])[-4:]]
    context = 2 if any(w in AGAINST for w in before) else 1 if any(w.startswith(CONTEXT[KINDS[kind]]) for w in before) else 0
    touch = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    ahead, behind = text[max(0, start - 2) : start].rstrip()[-1:], text[end : end + 1]
    set_off = 1 if (ahead and ahead in ":<([\"'=") or (behind and behind in ">)]\"'") else 0
    return (0 if passes is None else 1 if passes else 2), form, known, context, 2 if touch else 0, set_off


LABELERS = 6


def _shape(span: str) -> str:
    """Digits as 9, letters as a, runs of either as one."""
    out = []
    for c in span:
        c = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if not out or c != out[-1] or c not in "9a":
            out.append(c)
    return "".join(out)


def features(text: str, kind: int, start: int, end: int) -> list[int]:
    """Hashed features of a span and its surroundings, ascending, for the span classifier."""
    span, name = text[start:end], KINDS[kind]
    before = [w.lower() for w in _WORDS.findall(text[max(0, start - BEFORE) : start])[-3:]]
    after = [w.lower() for w in _WORDS.findall(text[end : end + BEFORE])[:2]]
    told = [
        f"shape {_shape(span)}", f"length {min(12, len(span) // 4)}", f"digits {min(20, len(_digits(span)))}", f"first {span[:1]}", f"last {span[-3:].lower()}",
        f"ahead {text[start - 1 : start]}", f"behind {text[end : end + 1]}", *(f"before {w}" for w in before), *(f"next {w}" for w in before[-1:]), *(f"after {w}" for w in after),
    ]
    return sorted({zlib.crc32(f"{name} {x}".encode("utf-8", "surrogatepass")) % HASHED for x in told})


def _code(kind: int, wide: bool, votes: tuple[int, ...]) -> int:
    code = 2 * kind + wide
    for v in votes:
        code = 3 * code + v
    return code


def _parts(code: int) -> tuple[int, bool, list[int]]:
    votes = []
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        votes.append(v)
    return code // 2, bool(code % 2), votes[::-1]


def candidates(text: str | None):
    """(base spans, [(start, kind number, end, code, features)] of wider ones, [(start, kind number, end, code)] of all)."""
    text = text or ""
    base, tried, every = [], [], []
    taken: list[tuple[list[int], list[int]]] = [([], []) for _ in KINDS]
    for kind, start, end, passes in _shaped(text):  # by kind in the order of their places
        if passes:
            base.append((start, kind, end))
            taken[kind][0].append(start)
            taken[kind][1].append(end)
        if passes or kind != 2 or (end - start <= 37 and 12 <= len(_digits(text[start:end])) <= 19):  # other runs of digits are no card numbers at all
            every.append((start, kind, end, _code(kind, False, _votes(text, kind, start, end, passes))))
    for kind, start, end in _wide(text):
        if not any(_meets(*spans, start, end) for spans in taken):
            code = _code(kind, True, _votes(text, kind, start, end, None))
            tried.append((start, kind, end, code, features(text, kind, start, end)))
            every.append((start, kind, end, code))
    return sorted(base), sorted(tried), every


def _meets(starts: list[int], ends: list[int], start: int, end: int) -> bool:
    """Whether start to end overlaps one of the spans, which are in order and apart."""
    k = bisect_left(starts, end)
    return k > 0 and ends[k - 1] > start


def estimate(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Dawid-Skene by expectation-maximisation, kind by kind: probability that a pattern of votes is personal data."""
    out: dict[int, float] = {}
    for kind in range(len(KINDS)):
        codes = [c for c in sorted(counts) if _parts(c)[0] == kind]
        if not codes:
            continue
        votes = np.array([_parts(c)[2] for c in codes])
        n = np.array([counts[c] for c in codes], float)
        p = np.where((votes == 1).sum(1) > (votes == 2).sum(1), 0.9, 0.1)
        for _ in range(rounds):
            # a vote counts for both classes a little, so that no labeler is ever certain; a labeler is better than chance
            share = ((n * p).sum() + 1) / (n.sum() + 2)
            log = np.log(share) * np.ones(len(codes)), np.log(1 - share) * np.ones(len(codes))
            for m in range(LABELERS):
                yes = np.array([(n * p)[votes[:, m] == v].sum() for v in range(3)]) + (1.0, 2.0, 0.5)
                no = np.array([(n * (1 - p))[votes[:, m] == v].sum() for v in range(3)]) + (1.0, 0.5, 2.0)
                log[0][:] += np.log(yes / yes.sum())[votes[:, m]]
                log[1][:] += np.log(no / no.sum())[votes[:, m]]
            new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
            done = np.abs(new - p).max() < 1e-6
            p = new
            if done:
                break
        out |= dict(zip(codes, p.tolist(), strict=True))
    return out


def _inputs(code: int, hashed: list[int]) -> list[int]:
    """Numbers of the classifier's inputs that are on: bias, kind and votes, then what features() gives."""
    kind, wide, votes = _parts(code)
    on = [0, 1 + kind, *([5] if wide else []), *(6 + 2 * m + v - 1 for m, v in enumerate(votes) if v)]
    return on + [6 + 2 * LABELERS + h for h in hashed]


def train(rows: list[tuple[int, list[int]]], likely: dict[int, float], rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on candidates (code, features) with the estimated likelihoods as soft labels.

    Steps of diagonal curvature, halved until the loss falls: no matrix over all features is needed.
    """
    w = np.zeros(6 + 2 * LABELERS + HASHED)
    if not rows:
        return w
    on = [_inputs(c, h) for c, h in rows]
    flat, owner = np.concatenate(on), np.repeat(np.arange(len(on)), [len(x) for x in on])
    y = np.array([likely.get(c, 0.5) for c, _ in rows])
    z = np.zeros(len(on))

    def loss(z, w):
        return (np.logaddexp(0, z) - y * z).sum() + ridge / 2 * (w * w).sum()

    now = loss(z, w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        slope = np.bincount(flat, (p - y)[owner], len(w)) + ridge * w
        bend = np.bincount(flat, (p * (1 - p))[owner], len(w)) + ridge
        step = slope / bend
        size = 1.0
        while size > 1e-6:
            new = w - size * step
            z_new = np.bincount(owner, new[flat], len(on))
            if (then := loss(z_new, new)) < now:
                break
            size /= 2
        else:
            break
        done = now - then < 1e-7 * abs(now)
        w, z, now = new, z_new, then
        if done:
            break
    return w


def probability(w: np.ndarray, code: int, hashed: list[int]) -> float:
    return float(1 / (1 + np.exp(-np.clip(w[_inputs(code, hashed)].sum(), -30, 30))))


_FOUND = (
    "doc_id long, base array<struct<start:int,kind:int,end:int>>, wider array<struct<start:int,kind:int,end:int,code:int,hashed:array<int>>>, "
    "every array<struct<code:int,draw:long,hashed:array<int>>>"
)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidates of every row's whole text with votes and features, stored once; texts themselves are not."""
    span = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]
    hashed = ("hashed", pa.list_(pa.int32()))
    kinds = [
        pa.int64(), pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("code", pa.int32()), hashed])), pa.list_(pa.struct([("code", pa.int32()), ("draw", pa.int64()), hashed]))
    ]

    def run(batches):
        for batch in slices(batches):
            base, wider, every = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sure, tried, all_of = candidates(text)
                base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in sure])
                wider.append([dict(zip(("start", "kind", "end", "code", "hashed"), x, strict=True)) for x in tried])
                told = []
                for start, kind, end, code in all_of:
                    draw = zlib.crc32(f"{doc_id}:{kind}:{start}".encode())
                    told.append({"code": code, "draw": draw, "hashed": features(text, kind, start, end)})
                every.append(told)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip((base, wider, every), kinds[1:], strict=True))], ["doc_id", "base", "wider", "every"])

    return cut(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _FOUND))


def fit(found: DataFrame) -> np.ndarray:
    """The span classifier's weights: votes of all candidates, estimated likelihoods, a sample with features."""
    every = found.select(F.explode("every").alias("c"))
    counts = {r["code"]: r["count"] for r in every.groupBy("c.code").count().collect()}  # 8 x 3^6 patterns at most
    likely = estimate(counts)
    # a kind's threshold lets somewhat more than SAMPLE of its hashes through; the smallest SAMPLE of these are taken
    wanted, size = F.lit(False), Counter()
    for code, n in counts.items():
        size[code // 3**LABELERS] += n
    for match, n in size.items():
        share = min(1.0, (SAMPLE + 6 * SAMPLE**0.5) / n)
        wanted = wanted | (F.col("c.code").between(match * 3**LABELERS, (match + 1) * 3**LABELERS - 1) & (F.col("c.draw") <= int(share * 2**32)))
    drawn = every.where(wanted).select("c.*").groupBy("code", "draw").agg(F.min("hashed").alias("hashed")).collect()
    rows, taken = [], Counter()
    for r in sorted(drawn, key=lambda r: (r["draw"], r["code"])):
        match = r["code"] // 3**LABELERS
        if taken[match] < SAMPLE:
            taken[match] += 1
            rows.append((r["code"], list(r["hashed"])))
    return train(rows, likely)


def _of_kind(number: int):
    return F.filter("base", lambda s: s["kind"] == number)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row per row."""
    found = find(docs, id_col, text_col)
    weights = fit(found)
    names = F.array(*(F.lit(k) for k in KINDS))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    @F.arrow_udf("array<boolean>")
    def judged(codes: pa.Array, hashed: pa.Array) -> pa.Array:
        return pa.array([[probability(weights, c, h) >= ACCEPT for c, h in zip(cs, hs, strict=True)] for cs, hs in zip(codes.to_pylist(), hashed.to_pylist(), strict=True)], pa.list_(pa.bool_()))

    # few documents have wider candidates: only these go to Python
    some = F.size("wider") > 0
    verdicts = F.when(some, judged(F.when(some, F.col("wider.code")).otherwise(F.array().cast("array<int>")), F.when(some, F.col("wider.hashed")).otherwise(F.array().cast("array<array<int>>"))))
    found = found.withColumn("verdicts", verdicts)
    added = F.filter("wider", lambda s, k: F.coalesce(F.get("verdicts", k), F.lit(False)))
    every = F.array_sort(F.concat("base", F.transform(added, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
    return found.select(
        "doc_id",
        *(F.size(_of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(told(F.col("base")), 256).alias("base_sha256"),
        told(every).alias("spans"),
    )


def mask(text: str, weights: np.ndarray) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap go as one."""
    base, wider, _ = candidates(text)
    spans = sorted([*base, *((s, k, e) for s, k, e, code, hashed in wider if probability(weights, code, hashed) >= ACCEPT)])
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with every span masked; count_col, if there is one, becomes the new number of characters. Nulls stay."""
    weights = fit(find(docs, id_col, text_col))

    @F.arrow_udf("string")
    def masked(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        for texts in parts:
            yield pa.array([t if t is None else mask(t, weights) for t in each(texts)], pa.string())

    out = docs.withColumn(text_col, masked(F.col(text_col)))
    if count_col and count_col in docs.columns:
        out = out.withColumn(count_col, F.coalesce(F.length(text_col), F.lit(0)).cast(docs.schema[count_col].dataType))
    return out.select(*docs.columns)


def sha256_of(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
