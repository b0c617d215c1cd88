"""Keys and groups as they are in larger tables: ids that meet or repeat, tiles that repeat a name at many prices."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from pricetide.operators.grouping import absorb_meal_deals
from pricetide.plans import maintain as M
from pricetide.plans import oracles, queries, upkeep

SMALL, TABLES = "/root/testdata/sf0.001", ("region", "nation", "customer", "supplier", "part", "lineitem")


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """Copies with part numbers beyond 2^20, deals whose ids meet, and an unpriced line that comes twice."""
    folder, con = tmp_path_factory.mktemp("wide"), duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE TABLE {t} AS FROM '{SMALL}/{t}.parquet'")
    con.execute("INSERT INTO part SELECT * REPLACE (p_partkey + 1048576 AS p_partkey) FROM part")
    con.execute("UPDATE lineitem SET l_linenumber = 7, l_quantity = 5 WHERE l_orderkey % 5 = 0 AND l_linenumber = 6")
    con.execute("INSERT INTO lineitem SELECT * REPLACE (l_linenumber - 1 AS l_linenumber, l_partkey + 1048576 AS l_partkey) FROM lineitem WHERE l_linenumber > 1 AND l_orderkey % 3 = 0")
    con.execute("INSERT INTO lineitem SELECT * REPLACE (6.0 AS l_quantity, 0.05 AS l_discount) FROM lineitem WHERE l_linenumber = 7 AND l_quantity % 5 = 0 AND l_orderkey % 16 IN (0, 1)")
    for t in TABLES:
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["enriched_prices", "export_rows", "update_prices"])
def test_ids_that_meet_or_repeat(spark, wide, name):
    folder, con = wide
    got = (queries.queries() | upkeep.queries())[name](spark, folder)
    want = con.execute((oracles.oracle_sql() | upkeep.oracle_sql())[name])
    columns = [x[0] for x in want.description]
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    wanted = order(want.fetchall())
    assert wanted and order(got.select(*columns).collect()) == wanted


def test_updates_by_another_key(spark):
    obs = spark.createDataFrame([(1, 7, 1.0, 0.1, None), (1, 8, 2.0, 0.2, 3.0)], "deal_id int, tile int, advertised_price double, unit_price double, base_price double")
    new = spark.createDataFrame([(7, 9.0, None, 5.0)], "tile int, advertised_price double, unit_price double, base_price double")
    assert sorted(tuple(r) for r in M.update_prices(obs, new, ["tile"]).collect()) == [(1, 7, 9.0, 0.1, 5.0), (1, 8, 2.0, 0.2, 3.0)]


def test_meal_deals_and_names_at_many_prices(spark):
    """Two tiles repeat one name at 30,000 prices each: the fold must not meet every price with every other."""
    one = F.array(*(F.struct(F.lit(k).alias("group_key"), F.lit(n).alias("canonical_name")) for k, n in (("ad_1", "roast"), ("ad_2", "roast"))))
    rows = spark.range(30_000).select("id", F.explode(one).alias("x")).select(F.lit(1).alias("flyer_id"), "x.*", (F.col("id") + 10).alias("cents"))
    rows = rows.unionByName(spark.createDataFrame([(1, "meal_deal_p1", "roast", 5)], rows.schema))
    rows = rows.withColumn("pos", F.struct(F.lit(1.0).alias("rank"), F.col("cents").cast("double").alias("price"), F.xxhash64("group_key", "cents").alias("id")))
    start = time.perf_counter()
    out = absorb_meal_deals(rows)
    assert [tuple(r) for r in out.groupBy("group_key", "canonical_name").count().collect()] == [("meal_deal_p1", "roast", 1)]
    assert time.perf_counter() - start < 45


def test_intermediates_are_columns_and_pinned_ones_keep_partitions(spark):
    from pricetide.functions.core import cut_lineage, pinned

    rows = spark.range(0, 200_000, 1, 4).select("id", F.lit("a name that every row repeats").alias("name"), F.lit("0001-01-01").cast("date").alias("day"), F.struct(F.lit(None).cast("double").alias("p")).alias("s"))
    out = cut_lineage(rows)
    assert out.schema.simpleString() == rows.schema.simpleString() and out.exceptAll(rows).isEmpty() and out.count() == 200_000
    assert out.inputFiles() and all(x.endswith(".parquet") for x in out.inputFiles())
    kept = pinned(rows.repartition(7).sortWithinPartitions("id")).withColumn("part", F.spark_partition_id())
    assert kept.select("part").distinct().count() == 7


def test_departments_once_for_each_text(spark):
    """Missing texts, stored departments and repeated names; every deal comes back once."""
    from pricetide.functions.text import shopper_department
    from pricetide.operators.feed import with_departments

    texts = ["department", "category", "canonical_name", "brand", "raw_title", "ad_title"]
    rows = [(i, *r) for i, r in enumerate([
        (None, None, "Whole Milk", None, None, None), (None, None, "Whole Milk", None, None, None), (None, None, "Whole Milk", "", None, None), ("Deli", None, "Whole Milk", None, None, None),
        (None, "Odd", None, None, None, "Ribeye"), (None, None, None, None, None, None), (" ", "Odd", "x", "y", "z", None), (" ", "Odd", "x", "y", "z", None)])]
    deals = spark.createDataFrame(rows, "deal_id int, " + ", ".join(f"{x} string" for x in texts))
    want = deals.withColumn("department", shopper_department(*(F.col(x) for x in texts)))
    got = with_departments(deals)
    assert got.columns == deals.columns and sorted(got.collect(), key=lambda r: r.deal_id) == sorted(want.collect(), key=lambda r: r.deal_id)
