"""Every registered query against its SQL; the others against their row counts."""

import pytest
from compare import agree

from millrace.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    agree(spark, sf_dir, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_collated_compare_takes_whole_texts(spark, sf_dir):
    got = {r.doc_id: (r.a, r.b) for r in QUERIES["collated_compare"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {d: a for d, (a, _) in got.items()} == texts
    assert all(len(b) >= len(texts[d]) - 2 for d, (_, b) in got.items() if b is not None)
