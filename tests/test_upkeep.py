import duckdb

from pricetide.plans import upkeep

DATA = "/root/testdata/sf0.001"


def test_history_of_every_product(spark):
    sql = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        sql.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    got = sorted(map(tuple, upkeep.queries()["product_history_all"](spark, DATA).collect()))
    assert got == sorted(sql.execute(upkeep.oracle_sql()["product_history_all"]).fetchall())
    assert {row[1] % 3 for row in got} == {0, 1, 2}
