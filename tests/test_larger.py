"""What shows only on larger tables: numbers of datasets beyond four digits, saved tables of many rows."""

import duckdb
import pytest
from test_queries import DATA, plain

from strandflow.plans import registry

SHIFTS = [3_000_000, 3_001_500]  # of orders: datasets 10000 to 10009, two in each fold


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    d = tmp_path_factory.mktemp("shifted")
    duckdb.execute(f"COPY (SELECT l.* REPLACE (l_orderkey + s AS l_orderkey) FROM '{DATA}/lineitem.parquet' l, (SELECT unnest({SHIFTS}) s)) TO '{d}/lineitem.parquet' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["pair_ceiling_by_budget", "fold_balance_score", "fold_rank_ensemble", "multiframe_eligibility", "time_steps", "peak_persistence"])
def test_five_digits(spark, shifted, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{shifted}/lineitem.parquet'")
    got, want = registry.QUERIES[name](spark, shifted).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert len(got) > 0
    assert plain(got) == plain(want)
    if "dataset" in got:
        assert got.dataset.nunique() == 10


def test_saved_tables_of_many_rows_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    from strandflow.sources import shared

    def plan(rows):
        t = shared.save(spark.range(rows).select((F.col("id") % 1000).alias("k"), F.lit("a").alias("dataset"), F.lit(1).alias("v")))  # a few KB of files
        j = spark.range(5_000_000).select((F.col("id") % 1000).alias("k"), F.lit("a").alias("dataset")).join(t.groupBy("dataset", "k").agg(F.max("v")), ["dataset", "k"])
        return j._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan(1000)
    assert "BroadcastHashJoin" not in plan(100_001)
