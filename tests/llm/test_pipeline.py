"""The pipeline's stages, one after the other, on a small table."""
import os

import pytest

import __spark_entry__
import corpus_pipeline

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        columns = docs.columns
        docs = stage(spark, docs, DATA).cache()
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and set(kept[name]) <= before and kept[name]
    for name in ("quality rules", "exact dedup", "near dedup"):
        assert len(set(kept[name])) == len(kept[name])
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept["mixing"])


def test_edge_cases(spark, tmp_path):
    """Null, blank, repeated and very long rows, extra columns with the operators' own names; then an empty table."""
    prose = lambda k, n: " ".join(f"word{k}x{i * i}" for i in range(n))
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n ", None), (4, prose(4, 80), "s"), (4, prose(4, 80), "s"), (5, prose(4, 80) + "  ", None), (None, prose(6, 90), "s"), (None, prose(6, 90), "s")]
    rows += [(7, prose(7, 60_000), "t"), (8, prose(8, 70), None), (9, "x" * 200_000, "t"), (10, "same word " * 100, "t"), (11, prose(8, 70).upper(), "t")]
    schema = "doc_id long, text string, source string, key string, row int, size int, fp string, text_sha256 string, _id int, nth int"
    labels = spark.createDataFrame([(4, 1, 0), (10, 0, 0), (99, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for name, table in (("edge", rows), ("empty", [])):
        where = str(tmp_path / name)
        docs = spark.createDataFrame([(*r, "k", 1, 2, "f", "t", 3, 4) for r in table], schema)
        docs.write.parquet(f"{where}/documents.parquet")
        labels.write.parquet(f"{where}/labels.parquet")
        got = corpus_pipeline.run(spark, where).collect()
        assert (len({r.doc_id for r in got}) > 2) == bool(table)
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:3]:
            kept = stage(spark, kept, where)
        ids = [r.doc_id for r in kept.collect()]
        # 5 is an exact copy with more code points; 11 differs from 8 by case only.
        assert sorted(ids, key=str) == sorted([5, None, 7, 8], key=str) if table else ids == []


def test_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = __spark_entry__.queries()[name](spark, DATA).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
