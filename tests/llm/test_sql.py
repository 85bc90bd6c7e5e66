"""The queries of the operators against their SQL, and that all of them run over the tables."""

import duckdb
import pytest

from stratum.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(ORACLE[name]), QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_certified_rules_spare_good_documents(spark):
    """On the labelled documents of the table: of good ones that pass the base rules at most the promised share goes."""
    judged = QUERIES["op1_quality_rules"](spark, "/root/testdata/sf0.1").where("not base_failed")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1").select("doc_id").distinct()
    total, lost = judged.join(labels, "doc_id").selectExpr("count(*)", "count_if(not kept)").first()
    assert lost <= 0.02 * total
