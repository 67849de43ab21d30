from folia import catalog


def test_insert_ignore_keeps_customers_without_orders(spark, tmp_path):
    """Existing rows are those of the SQL: one without orders stays, one that isn't existing doesn't appear."""
    spark.createDataFrame([(1, -5.0), (2, 7.0), (3, 9.0)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(10, 3), (11, 3)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.queries()["insert_ignore_customers"](spark, f"file://{tmp_path}")
    assert sorted(r.c_custkey for r in got.collect()) == [1, 3]
