"""Null and repeated ids, nulls, empties, very long texts, repeated rows and clashing columns, where operators take one text at a time."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from pactline.llm import bpe, packing, pii
from pactline.llm.queries import vocabulary

TEXTS = [None, "", " \n", "a mail to jo@example.org, twice: jo@example.org", "word " * 60_000, "9" * 30_000, "é字" * 9_000, "last"]


@pytest.fixture(scope="module")
def odd(spark):
    """Every text under its own id, one id for two texts, a row twice, two rows without an id; columns that operators use inside."""
    rows = [*enumerate(TEXTS), (3, "another text"), (7, "last"), (None, "no id"), (None, None)]
    names = ["block", "words", "payload", "ids", "id", "body", "spans", "start", "length", "decoded", "row", "bucket"]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", *(f"'x' AS {n}" for n in names))


@pytest.mark.parametrize("most", [None, 50_000])
def test_bpe(odd, monkeypatch, most):
    if most:
        monkeypatch.setattr(bpe, "BLOCK_CHARS", most)  # most documents fill a block
    rows, docs = odd
    blob = vocabulary("byte_bpe_multi_50k.tiktoken")
    library = bpe.codec(blob, public_tokenizers.PATTERN)
    out = bpe.decode(bpe.encode(docs, blob, public_tokenizers.PATTERN), blob).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in out) == Counter((k, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for k, t in rows)


def test_packing(odd):
    rows, docs = odd
    blob = vocabulary("word_bpe_49k.json")
    whole = packing.codec(blob).whole
    out = packing.pack(docs, blob, with_ids=True).orderBy("sequence_id").collect()
    assert len({r["sequence_id"] for r in out}) == len(out)
    got, now = Counter(), []
    for r in out:  # the pieces of a row follow each other
        now += r["ids"]
        assert r["start"] + r["length"] == len(now) and r["length"] == len(r["ids"])
        if len(now) == r["doc_tokens"]:
            got[r["doc_id"], tuple(now)] += 1
            now = []
    assert not now and got == Counter((k, (*whole.encode(t or "", add_special_tokens=False).ids, 2)) for k, t in rows)
    assert packing.pack(docs.where("doc_id < 0"), blob).count() == 0


def test_personal_data(odd):
    rows, docs = odd
    out = pii.digest(docs).collect()
    assert Counter((r["doc_id"], r["n_email"]) for r in out) == Counter((k, (t or "").count("@")) for k, t in rows)
    masked = pii.redact(docs)
    assert masked.columns == docs.columns
    back = masked.collect()
    assert all(r["spans"] == r["id"] == "x" for r in back)
    assert Counter((r["doc_id"], r["text"]) for r in back if "@" not in (dict(rows).get(r["doc_id"]) or "")) >= Counter((k, t) for k, t in rows if k is not None and k not in (3,))
    assert not any("jo@" in (r["text"] or "") for r in back)
