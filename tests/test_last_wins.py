"""Mentions of one package at one position: the first row of the table stands, however Spark reads its files."""

from codeseam.plans import catalog


def test_first_of_equal_positions(spark, tmp_path):
    spark.range(3).selectExpr("id AS p_partkey", "'b' AS p_brand", "10 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(200).selectExpr("id AS o_orderkey", "'1' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    row = "id AS l_orderkey, 1L AS l_partkey, 1 AS l_linenumber, '{}' AS l_returnflag, 'O' AS l_linestatus"
    first, second = (spark.range(n).selectExpr(*row.format(flag).split(", ")) for n, flag in ((100, "R"), (200, "N")))
    more = spark.range(150_000).selectExpr("id + 1000 AS l_orderkey", "xxhash64(id) AS l_partkey", "1 AS l_linenumber", "'N' AS l_returnflag", "'O' AS l_linestatus")
    for name, df in (("a", first), ("b", second.union(more))):  # Spark reads the larger file first
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    got = catalog.QUERIES["a13_last_wins"](spark, str(tmp_path)).where("package = 1").collect()
    assert len(got) == 200 and all(r.dev == (r.manifest < 100) for r in got)
