"""The queries that SQL can express, against their SQL: on the smallest tables and on rows made to be awkward."""

import random

import duckdb
import numpy as np
import pytest

from pactline.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def equal(spark, name, folder, table):
    got = queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet{'' if folder == SF else '/*.parquet'}')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()[name]})").fetchall()
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(want, key=str)
    return [dict(zip(got.columns, r, strict=True)) for r in rows]


@pytest.mark.parametrize(("name", "table"), [("op2_embedding_dedup", "embeddings"), ("op9_line_dedup", "documents")])
def test_tables(spark, name, table):
    assert equal(spark, name, SF, table)


def test_planted_links(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    near = [v + rng.normal(size=16) * s for v in base[:30] for s in (0.0, 0.03, 0.05, 0.08)]
    vectors = [v.tolist() for v in [*base, *near]] + [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [2.0] * 8]
    rows = [(k, v, k % 3 if k % 11 else None) for k, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = equal(spark, "op2_embedding_dedup", str(tmp_path), "embeddings")
    assert sum(r["n_links"] for r in out) > 40 and not all(r["kept"] for r in out)


def test_planted_passages(spark, tmp_path):
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choices([f"v{k}" for k in range(900)], k=n))
    shared = ["\n".join(line(rng.choice((1, 3, 9, 20))) for _ in range(30)) for _ in range(4)]
    texts = []
    for _ in range(120):
        parts = [line(rng.randint(1, 70)) for _ in range(rng.randint(0, 4))] + rng.sample(shared, rng.randint(0, 3)) + [""] * rng.randint(0, 2)
        rng.shuffle(parts)
        texts.append("\n".join(parts))
    texts += ["\n".join(["tick tock"] * 200)] * 2 + ["\n".join(["one two three"] * 18 + [""] * 3 + ["one two three"] * 40)]
    texts += [None, "", "\n\n\n", line(49), "w \x1cx　y\x85 " * 40, "w \x1cx　y\x85 " * 40, "\r\n".join([line(60)] * 2), shared[0], shared[0] + "\n", "\n" + shared[0]]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(None, shared[1], "s"), (None, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = equal(spark, "op9_line_dedup", str(tmp_path), "documents")
    assert sum(r["chars_removed"] > 0 for r in out) > 60
