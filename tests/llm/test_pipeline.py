from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factweave.llm import quality

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs.columns
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        steps.append(([(r.doc_id, r.text) for r in before.collect()], docs.collect()))
        assert docs.columns == given or k == len(corpus_pipeline.STAGES) - 1
    took = [(b, Counter((r.doc_id, r.text) for r in a)) for b, a in steps]
    # 7: what the scores say
    first = spark.read.parquet(f"{SF}/documents.parquet")
    scores = quality.score(first, quality.fit(first, spark.read.parquet(f"{SF}/labels.parquet"))).filter("keep")
    assert set(took[0][1]) == {(i, t) for i, t in took[0][0] if i in {r.doc_id for r in scores.collect()}}
    # 3: the smallest id of each group
    assert {i for i, _ in took[1][1]} == {g for *_, g in brute.groups(took[1][0])}
    # 10: no benchmark window
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert {i for i, _ in took[2][1]} == {x[0] for x in brute.hits(took[2][0], bench) if not x[5]}
    # 9: copies of what came in, no more than three; 6: all of them, gapless
    assert set(took[3][1]) <= set(took[3][0]) and max(took[3][1].values()) <= 3
    assert took[4][1] == took[3][1]
    sizes = Counter(r.shard for r in steps[4][1])
    assert all(sorted(r.slot for r in steps[4][1] if r.shard == s) == list(range(n)) for s, n in sizes.items())


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, tmp_path, empty):
    """Empty tables, and documents with extra columns of clashing names, nulls and repeated rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0 if empty else 60)
    for c in ("shard", "slot", "_id", "cell", "key", "fp", "row", "bucket", "_fw_row", "size", "rate", "n_words"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs = docs.withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    none = docs.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema)).limit(1)
    odd = docs.unionByName(none).unionByName(docs.limit(3))
    for name, df in (("documents", odd), ("labels", None), ("benchmark", None)):
        df = spark.read.parquet(f"{SF}/{name}.parquet").limit(0 if empty else 10**6) if df is None else df
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*("shard_in" if c == "shard" else "slot_in" if c == "slot" else c for c in docs.columns), "shard", "slot"]
    got = out.collect()
    assert len(got) == 0 if empty else {r.shard_in for r in got} <= {"clash", None} and all(r.m in (None, {"a": r.doc_id}) for r in got) and got


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", ["op1_chat", "op2_line_dedup", "op5_topk", "op8_substring", "op9_mixing", "op10_decontamination"])
def test_queries_equal_their_oracles(spark, name):
    import duckdb

    from factweave.llm import queries

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(queries.ORACLES[name])
    got = queries.queries()[name](spark, SF).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
