"""Work per task follows the input: how tables are dealt, what travels, what is read once."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricetide.functions.core import once_per
from pricetide.operators import feed as FD
from pricetide.operators import grouping as G
from pricetide.operators import history as H
from pricetide.operators import past as PS
from pricetide.plans import queries as Q
from pricetide.plans import views as W
from tests.test_evaluate import _direct_past

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_dealt_by_hash_to_tasks_that_follow_their_rows(spark, monkeypatch):
    monkeypatch.setattr(W, "TASK_ROWS", 100)
    W.tasks.cache_clear()
    try:
        df = W._read(spark, SF, "lineitem")
        rows = df.count()
        assert df.rdd.getNumPartitions() == -(-rows // 100) > spark.sparkContext.defaultParallelism
        assert "RoundRobin" not in plan(df) and df.exceptAll(spark.read.parquet(f"{SF}/lineitem.parquet")).isEmpty()
    finally:
        W.tasks.cache_clear()


def test_rules_run_once_for_each_text_in_many_tasks(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, None), ("b", "x")], "t string, u string")
    out = once_per(df, ["t", "u"], "of_both", lambda t, u: F.concat_ws("-", t, u))
    assert sorted((r.t or "", r.u or "", r.of_both) for r in out.collect()) == [("", "", ""), ("a", "", "a"), ("a", "", "a"), ("b", "x", "b-x")]
    assert f"RoundRobinPartitioning({4 * spark.sparkContext.defaultParallelism})" in plan(FD.with_departments(W.feed_deals(spark, SF).withColumn("department", F.lit(None).cast("string"))))


def test_running_range_asks_for_days_without_a_price_and_is_dealt_by_key(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", 2.0), (1, "2024-01-02", None), (1, "2024-01-03", 1.0), (1, "2024-01-04", None), (2, "2024-01-01", None), (2, "2024-01-02", 5.0)],
                                 "k long, d string, price double").withColumn("day", F.col("d").cast("date"))
    for tasks in (None, 7):
        out = PS.running_range(rows, ["k"], tasks)
        planned = plan(out)
        assert sorted((r.k, str(r.day), r.n_past, r.sum_cents, r.min_cents, r.max_cents) for r in out.collect()) == [
            (1, "2024-01-02", 1, 200, 200, 200), (1, "2024-01-03", 1, 200, 200, 200), (1, "2024-01-04", 2, 300, 100, 200)]
    assert planned.count("Exchange") == 1 and ", 7), REPARTITION_BY_NUM" in planned


def test_past_travels_once_by_key(spark):
    """Sums, targets and spans meet in one shuffle by key (twelve exchanges and a written table before), and the star is read once for both."""
    rows = spark.createDataFrame([(1, "2024-01-01", 2.0, 1)], "k long, d string, price double, seq long").select(
        "k", "price", "seq", F.col("d").cast("date").alias("day"), F.col("d").cast("date").alias("end_day"), F.lit(True).alias("trusted"), F.lit(False).alias("outlier"))
    found = plan(PS.past_stats(rows, rows.select("k", "day"), ["k"]))
    assert found.count("Window") == 0 and found.count("REPARTITION_BY_COL") == 1
    assert "lineitem" not in plan(Q.decayed_average(spark, SF)) and "lineitem" not in plan(Q.historical_badges(spark, SF))


@pytest.mark.parametrize("ends", [[0], [0, 6, 20, 400]])
def test_past_of_keys_that_fill_batches(spark, ends):
    """A key with most rows, keys of one row, null keys and circulars that end on their day or never within reach; batches of seven rows."""
    rng, rows = random.Random(len(ends)), []
    for seq in range(400):
        key = rng.choice([1, 1, 1, None, rng.randrange(2, 60)])
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(300))
        rows.append(dict(key=key, day=day, end=day + dt.timedelta(days=rng.choice(ends)), seq=seq, price=rng.choice([1.0, 1.5, 2.0]), trusted=rng.random() < 0.7, outlier=rng.random() < 0.2))
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "key int, day date, end_day date, seq bigint, price double, trusted boolean, outlier boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r.key, r.day): r for r in PS.past_stats(df, df.select("key", "day"), ["key"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key, day in {(r["key"], r["day"]) for r in rows}:
        want = _direct_past([r for r in rows if r["key"] == key], day)
        g = got.get((key, day))
        assert (g is None) == (want is None)
        if want:
            assert (g.n_past, g.h_min, g.h_max) == want[:3] and g.b_avg == pytest.approx(want[5], abs=1e-8)
            assert key is None or (g.b_min, g.b_max) == want[3:5]  # spans join by key


def test_product_winners_do_not_depend_on_how_rows_are_dealt(spark):
    feed = FD.with_feed_columns(W.feed_deals(spark, SF), W.ratings(spark, SF))
    dealt = FD.unique_products(feed, 9)
    assert ", 9), REPARTITION_BY_NUM" in plan(dealt)
    a, b = dealt.collect(), FD.unique_products(feed).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and a


def test_items_carry_only_the_columns_wanted(spark):
    items = G.group_items(W.feed_deals(spark, SF), wanted=["badge", "page_number"])
    assert set(items.columns) == {*G.GROUP, "canonical_name", "cents", "badge", "page_number", "pos"}
    narrow = G.split_flags(G.group_items(W.feed_deals(spark, SF), wanted=G.SPLIT_COLS))
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, G.split_flags(G.group_items(W.feed_deals(spark, SF))).collect()))


def test_names_without_a_listed_word_skip_the_cluster_patterns(spark):
    rows = [(1, "ad_1", n, "A or B", "standard") for n in ("Beef Chop", "pork pie")] + [(1, "ad_2", n, "A or B", "standard") for n in ("red ring", "big ring")]
    items = spark.createDataFrame(rows, "flyer_id long, group_key string, canonical_name string, raw_title string, promo_type string").withColumns(
        {"promo_detail": F.lit(None).cast("string"), "qualifying_qty": F.lit(1), **{c: F.lit(None).cast("string") for c in ("brand", "category", "unit_type")}, "pos": F.col("canonical_name")})
    out = G.split_flags(items)
    planned = plan(out)
    assert {r.group_key: r.split for r in out.collect()} == {"ad_1": True, "ad_2": False} and "listed" in planned


def test_timeline_without_titles_makes_one_pass(spark):
    runs = H.grouped_timeline(H.star(W.catalog(spark, SF)))
    assert "min_by" not in plan(runs.select("group_key", "flyer_id", "min_price", "varieties"))
    titled = runs.select("group_key", "title").collect()
    assert titled and all(r.title is not None for r in titled) and len(titled) == runs.select("group_key").count()


def test_stages_stay_below_the_methods_that_the_jvm_compiles(spark):
    W.observations(spark, SF)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == W.METHOD_BYTES <= 8000


def test_assigned_items_carry_only_the_columns_wanted(spark):
    every, some = G.assign_groups(W.feed_deals(spark, SF)), G.assign_groups(W.feed_deals(spark, SF), wanted=G.TITLE_COLS)
    assert set(some.columns) == {*G.GROUP, "canonical_name", "cents", "pos", "deal_id", "split", "group_id", *G.SPLIT_COLS, *G.TITLE_COLS} < set(every.columns)
    same = [c for c in some.columns if c != "pos"]
    assert sorted(map(str, some.select(same).collect())) == sorted(map(str, every.select(same).collect()))


def test_groups_are_made_of_the_columns_they_read(spark):
    """The same groups from items that carry no other text: all columns of a deal travelled with its items before."""
    deals, feed = W.feed_deals(spark, SF), FD.with_feed_columns(W.feed_deals(spark, SF), W.ratings(spark, SF))
    whole, rolled = G.rollup_groups(G.assign_groups(deals)), G.group_deals(deals)
    assert sorted(map(str, rolled.collect())) == sorted(map(str, whole.collect()))
    items, every = FD.viewer_items(feed, FD.VIEW_COLS), FD.viewer_items(feed)
    assert set(items.columns) == {*G.GROUP, "canonical_name", "cents", "pos", *FD.VIEW_COLS} < set(every.columns)
    for made in (FD.viewer_groups, FD.member_bits):
        assert sorted(map(str, made(items).collect())) == sorted(map(str, made(every).collect()))
    assert "historical_min" not in plan(Q.viewer_flags(spark, SF))
