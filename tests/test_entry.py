"""The driver's entry points, and a few queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from inkloom.oracle import ORACLE_SQL
from inkloom.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings files blocks sentences units labels settings eval_items mix_targets".split()


def test_names():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "pos", "line", "col", "value"]


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(None if v is None or v != v else round(float(v), 5) if isinstance(v, float) and not math.isnan(v) else v for v in r))
    return sorted(map(str, out))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["word_stats", "sentence_split", "readability", "clr003", "clr015", "rif001", "rif006", "sections", "compare_features", "compare_changes", "score_findings", "plan_units", "rule_applies", "txt_blocks"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows(QUERIES[name](spark, str(DATA)).toPandas()) == rows(con.sql(ORACLE_SQL[name]).df())
