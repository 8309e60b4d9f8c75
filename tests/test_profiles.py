"""Profiles of columns and work on few files."""

from braidwork.operators import quality
from braidwork.plans import catalogue


def test_column_profile(spark):
    rows = [(i, ["b", "", None, "a", "b"][i % 5], None, float(i % 2)) for i in range(20, 0, -1)]
    df = spark.createDataFrame(rows, "k long, t string, n string, x double")
    got = {r["column"]: tuple(r)[1:] for r in quality.column_profile(df, order="k").collect()}
    assert got == {
        "k": (0, 0.0, 20, 2, "1"), "t": (8, 0.4, 2, 1, "a"), "n": (20, 1.0, 0, 0, None), "x": (0, 0.0, 2, 3, "1.0"),
    }
    assert {r["column"]: r["example"] for r in quality.column_profile(df).collect()} == {"k": "1", "t": "a", "n": None, "x": "0.0"}
    none = quality.column_profile(df.limit(0), order="k").collect()
    assert len(none) == 4 and all(tuple(r)[1:] == (0, None, 0, 0, None) for r in none)
    plan = quality.column_profile(df, order="k")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "min_by" not in plan  # values meet where they are dealt by, in no single task


def test_small_tables_are_dealt_to_all_cores(spark, tmp_path):
    rows = [(i, f"name {i}", "Brand#1", "SMALL", i % 7, 1.5) for i in range(200)]
    df = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    df.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("parse_detail", "parse_listing", "parse_quotes"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
