"""The pipeline's stages, one by one, against brute force on what the stage before kept; and the queries' SQL."""

import glob
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from parley.llm import bpe, exact_dedup, mixing, quality_fm, simhash_vp

SF = "/root/testdata/sf0.001"


def _groups(rows):
    """The least id of the group of each row, by comparing every pair."""
    f, n = simhash_vp.fingerprints(pa.array([t for _, t in rows]))
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if n[i] and n[j] and int(np.bitwise_count(f[i, :2] ^ f[j, :2]).sum()) <= simhash_vp.RADIUS and int(np.bitwise_count(f[i] ^ f[j]).sum()) <= 2 * simhash_vp.RADIUS:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {rows[root(i)][0] for i in range(len(rows))}


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "source mixing", "byte-level bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, kept = docs.columns, docs.collect(), []
    model = quality_fm.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns and set(after) <= set(before)  # rows as they were
        if k == 0:
            q, t = quality_fm.score_arrays(model, pa.array([r.text for r in before]), [pa.array([r[c] for r in before]) for c in quality_fm.METADATA])
            assert {r.doc_id for r in after} == {r.doc_id for r, a, b in zip(before, q, t) if a >= model.least_quality and b < model.most_toxicity} and 0 < len(after) < len(before)
        if k == 1:
            first = {}
            for r in sorted(before, key=lambda r: r.doc_id):
                first.setdefault(r.text, r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(first.values())
        if k == 2:
            assert {r.doc_id for r in after} == _groups(sorted((r.doc_id, r.text) for r in before)) and len(after) < len(before)
        if k == 3:
            count = {}
            for r in before:
                count[r.source] = count.get(r.source, 0) + 1
            want = mixing.quotas(list(count.values()), [1] * len(count), int(0.8 * len(before)))
            assert len(after) == int(0.8 * len(before)) and all(abs(sum(r.source == s for r in after) - w) <= 1 for s, w in zip(count, want))
        if k == 4:
            c, text = bpe.Codec(), {r.doc_id: r.text for r in before}
            assert {r.doc_id for r in after} == set(text)
            assert all(np.array_equal(r.tokens, c.piece(text[r.doc_id])) and r.n_tokens == len(r.tokens) and r.round_trip for r in after)
        before = after
        kept.append(len(after))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(r.doc_id for r in before)


def test_stages_take_awkward_rows(spark, awkward, nothing, tmp_path):
    for d in (awkward, nothing):
        docs = d
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{d is nothing}{k}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            assert k == 4 or docs.columns == d.columns
        assert (docs.count() == 0) == (d is nothing)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_sql(spark, name, sf):
    c = duckdb.connect()
    for p in glob.glob(f"/root/testdata/{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    cur = c.execute(entry.oracle_sql()[name])
    columns, want = [d[0] for d in cur.description], cur.fetchall()
    got = entry.queries()[name](spark, f"/root/testdata/{sf}")
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_embedding_sql_on_near_copies(spark, tmp_path):
    """The small tables have no near pairs: here each of their vectors has three copies that are turned by some 0 to 12 degrees, and a hundred a crowd."""
    from parley.llm import embedding_lsh

    rng = np.random.default_rng(8)
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()])
    turned = lambda y, most: y + rng.normal(size=y.shape) * rng.uniform(0, most, (len(y), 1)) * np.linalg.norm(y, axis=1, keepdims=True) / y.shape[1] ** 0.5
    x = np.concatenate([x, *(turned(x, 0.2) for _ in range(3)), turned(np.repeat(x[:1], 100, 0), 0.1)])
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "v"))
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/v/*.parquet'")
    want = sorted(c.execute(embedding_lsh.OP4_SQL).fetchall())
    got = sorted(map(tuple, embedding_lsh.near_vectors(spark.read.parquet(str(tmp_path / "v"))).select("vec_id", "class_id", "n_links").collect()))
    pairs = sum(r[2] for r in want) / 2
    assert pairs > 1000 and sum(r[2] for r in got) / 2 >= 0.995 * pairs
    assert all(a[2] <= b[2] for a, b in zip(got, want)) and np.mean([a == b for a, b in zip(got, want)]) > 0.99


def test_every_operator_has_its_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert exact_dedup.OP3_SQL == entry.oracle_sql()["op3_exact_dedup"]
