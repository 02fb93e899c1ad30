"""All registered queries have distinct names; those with SQL agree with it on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Minutes in all, of hundreds of small jobs; the driver holds them against their SQL.
SLOW = {
    "el_classification", "classification_delta", "axiom_round_trip", "extension_classification", "owl_document", "release_states", "reconciled_release",
    "stated_to_axioms", "extension_to_axioms", "axioms_to_stated",
}


def same(value) -> str:
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query_agrees_with_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = entry.queries()[name](spark, SF)
    out = con.sql(entry.oracle_sql()[name])
    names = sorted(df.columns)
    assert sorted(out.columns) == names
    at = [out.columns.index(c) for c in names]
    assert sorted(tuple(same(r[c]) for c in names) for r in df.collect()) == sorted(tuple(same(r[i]) for i in at) for r in out.fetchall())
