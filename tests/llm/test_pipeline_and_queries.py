import importlib

import duckdb
import pytest

from hydrosift.llm import host_rules, packing, pii, queries
from tests.conftest import SF001
from tests.test_oracles import TABLES, _norm

from . import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, con, name):
    s = queries.QUERIES[name](spark, SF001).toPandas()
    o = con.execute(queries.ORACLES[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert _norm(s) == _norm(o)


def test_entry_registers_every_operator():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and len(names) > 70


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").toPandas()
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet").toPandas()
    rows = [(d, t) for d, t in zip(docs.doc_id, docs.text, strict=True) if not brute.rule_counts(t)[-1]]
    judged = {r.doc_id: r for r in host_rules.host_rules(spark.read.parquet(f"{SF001}/documents.parquet")).collect()}
    assert {d for d, _ in rows} == {d for d, r in judged.items() if not r.base_failed}
    rows = [(d, t) for d, t in rows if judged[d].kept]
    groups = brute.components(rows)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    hits = brute.contamination(rows, list(zip(bench.item_id, bench.text, strict=True)))
    rows = [(d, t) for d, t in rows if not hits[d][1]]
    scanner = pii.Scanner()
    masked = {d: pii.mask(t, scanner.spans(t)) for d, t in rows}
    assert all(not brute.base_spans(t) for t in masked.values())
    encode = packing.load_encoder(packing.default_vocabulary()).encode_ordinary
    expect = {(d, k, n) for d, t in masked.items() for k, (_, n) in enumerate(packing.cut(len(encode(t)) + 1, 1024))}
    got = corpus_pipeline.run(spark, SF001).collect()
    assert {(r.doc_id, r.piece, r.length) for r in got} == expect and len(got) == len(expect)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, SF001).schema.names == docs.schema.names
        assert step(spark, docs.limit(0), SF001).count() == 0
