"""The pipeline over a planted corpus, and the queries against DuckDB where SQL can express them."""

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from genolake.llm import queries
from genolake.llm.packing import tokenizer_path

from .fixtures import docs, prose
from .test_similarity import near

SF = "/root/testdata/sf0.001"


def test_pipeline_as_planted(spark, tmp_path):
    line = "subscribe to the morning letter"
    good = [prose(140, s) for s in range(24)]
    item = prose(40, 900)
    rows = [(i, f"{line}\n{t}") for i, t in enumerate(good)]
    rows += [(100 + i, near(t, 2, i)) for i, t in enumerate(good[:6])]
    rows += [(200, prose(80, 300) + " " + item + " " + prose(80, 301)), (201, "### ".join(prose(150, 90).split()) + "***"), (202, "too short"), (203, None), (204, "again and again " * 60)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = seen.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == columns
    kept = {r.doc_id: r.text for r in seen.collect()}
    assert kept == dict(enumerate(good))
    encode = Tokenizer.from_file(tokenizer_path()).encode
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {i: [x for _, p in sorted(v) for x in p] for i, v in got.items()} == {i: encode(t, add_special_tokens=False).ids + [1] for i, t in kept.items()}


def test_stages_bear_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def plain(v):
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_registered():
    found = __spark_entry__.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)
