"""Circular-shaped tables derived from the TPC-H-like driver tables.

A line item is one advertised price of a part by the region of its supplier in the week it ships.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions.core import unit_cost

PROMO_KINDS = 16


#: Rows of a table that one task starts from.
TASK_ROWS = 250_000
#: Largest method that the JVM compiles. The text rules in one stage make larger ones, which would be interpreted row by row; beyond this Spark
#: generates their expressions in pieces.
METHOD_BYTES = 8_000
#: Columns by which the tables that heavy operators start from are dealt out; together they name a row, so no value fills a task.
DEALT_BY = {"lineitem": ("l_orderkey", "l_linenumber"), "part": ("p_partkey",), "documents": ("doc_id",)}


@lru_cache(maxsize=256)
def tasks(spark: SparkSession, path: str) -> int:
    """How many tasks a table is dealt to: it grows with the rows, which Parquet's footers tell, so that no task does."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(spark.read.parquet(path).count() / TASK_ROWS))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. These files have one row group each, which no split size divides: the tables that heavy operators start from
    are dealt out once here; the library itself leaves its inputs' partitions alone. Dealing by hash saves the sort of all rows, in the
    one task that reads them, by which Spark keeps a round-robin deal repeatable."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_BYTES)
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    return df.repartition(tasks(spark, path), *DEALT_BY[name]) if name in DEALT_BY else df


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    name = F.when(F.col("p_size") == 50, F.col("p_name")).otherwise(
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("oz")))
    return p.select(
        F.col("p_partkey").alias("product_id"),
        name.alias("canonical_name"),
        F.when(F.col("p_partkey") % 13 != 0, F.col("p_brand")).alias("brand"),
        F.when(F.col("p_partkey") % 10 != 0, F.col("p_type")).alias("category"),
        F.col("p_size").cast("double").alias("unit_size"),
        F.when(F.col("p_partkey") % 9 != 0, F.lit("oz")).alias("unit_type"),
        F.when(F.col("p_partkey") % 4 == 0, F.round(F.col("p_retailprice") * 100) / 100.0).alias("last_shelf_price"),
    )


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (_read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
        .select("s_suppkey", "r_regionkey", F.col("r_name").alias("merchant"))
    )


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    week = F.date_trunc("week", "l_shipdate").cast("date")
    no = F.floor(F.datediff(week, F.lit("1992-01-06").cast("date")) / 7).cast("bigint")
    return (
        li.join(merchants(spark, sf_dir), li["l_suppkey"] == F.col("s_suppkey"))
        .join(part, li["l_partkey"] == part["p_partkey"])
        .withColumns({"week": week, "week_no": no})
        .withColumn("flyer_id", F.col("r_regionkey") * 100000 + F.col("week_no"))
        .withColumn("list_cents", F.round(F.col("p_retailprice") * 100).cast("bigint"))
        .withColumn("cents", F.expr("list_cents * (100 - 5 * cast(round(l_discount * 100) as bigint)) div 100"))
    )


def _valid_to(week: str = "week", week_no: str = "week_no") -> F.Column:
    return F.date_add(F.col(week), F.when(F.col(week_no) % 6 == 0, 9).otherwise(6))


def flyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tiles(spark, sf_dir).select("flyer_id", "merchant", "week", "week_no").distinct()
    return t.select(
        "flyer_id",
        F.lpad((F.col("flyer_id") / 100000).cast("int").cast("string"), 5, "0").alias("postal_code"),
        "merchant",
        F.when(F.col("week_no") % 3 == 0, F.lit("Specials")).otherwise(F.lit("Weekly Ad")).alias("name"),
        F.concat(F.col("week").cast("string"), F.lit("T00:00:00-04:00")).alias("valid_from"),
        F.concat(_valid_to().cast("string"), F.lit("T23:59:59-04:00")).alias("valid_to"),
        (F.col("week_no") % 5 != 0).alias("is_trusted"),
        F.when(F.col("week_no") % 5 != 0, "flipp_api").otherwise("video_ocr_untrusted").alias("source_type"),
        F.concat(F.col("week").cast("string"), F.lit(" 06:00:00")).alias("scraped_at"),
    )


def promo_kind() -> F.Column:
    return F.col("l_orderkey") % PROMO_KINDS


def promo_words() -> F.Column:
    """Promotional wording of a tile; ten of sixteen kinds carry one."""
    k, line = promo_kind(), F.col("l_linenumber").cast("string")
    cents = F.format_string("%d.%02d", F.expr("cents div 100"), F.expr("cents % 100"))
    return (
        F.when(k == 0, F.concat(F.lit("BUY "), line, F.lit(" GET 1 FREE")))
        .when(k == 1, F.concat(F.lit("MUST BUY 3 @ $"), cents))
        .when(k == 2, F.concat(F.lit("FREE when you redeem "), (F.col("l_linenumber") * 50).cast("string"),
                               F.lit(" CHOICE points SAVE UP TO $"), line, F.lit(".50")))
        .when(k == 3, F.concat(F.lit("300 CHOICE POINTS When you spend $"), (F.col("l_linenumber") + 19).cast("string")))
        .when(k == 4, F.concat(F.lit("SAVE $5 When you spend $"), (F.col("l_linenumber") * 4).cast("string")))
        .when(k == 5, F.concat((F.col("l_linenumber") * 5).cast("string"), F.lit("% OFF")))
        .when(k == 6, F.concat(F.lit("EARN "), line, F.lit("X CHOICE POINTS")))
        .when(k == 8, F.concat(F.lit("SAVE $"), line, F.lit(".25 WITH DIGITAL COUPON")))
        .when(k == 9, F.concat(F.lit("WITH DIGITAL COUPON $"), cents))
        .when(k == 10, F.concat(F.lit("$"), line, F.lit(".00 Off/lb.")))
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    raw = c("l_orderkey") * 10 + c("l_linenumber")
    price = F.when(~((c("l_linenumber") == 7) & (c("l_quantity") % 5 == 0)), c("cents") / 100.0)
    name = F.when(c("p_size") == 50, c("p_name")).otherwise(
        F.concat_ws(" ", "p_name", c("p_size").cast("string"), F.lit("oz")))
    return _tiles(spark, sf_dir).select(
        (raw * 1048576 + c("l_partkey")).alias("deal_id"),
        "flyer_id",
        c("l_partkey").alias("product_id"),
        raw.alias("raw_deal_id"),
        c("l_linenumber").alias("page_number"),
        (c("l_linenumber") == 1).alias("is_front_page"),
        price.alias("advertised_price"),
        F.when(c("l_orderkey") % 3 != 0, unit_cost(price, c("p_size").cast("double"))).alias("unit_price"),
        F.when((c("l_returnflag") == "R") & (c("l_discount") >= 0.09), "doorbuster")
        .when(promo_kind() == 7, "store_coupon").otherwise("standard").alias("promo_type"),
        promo_words().alias("promo_detail"),
        F.lit(1).alias("qualifying_qty"),
        F.when(c("l_orderkey") % 2 == 0, c("list_cents") / 100.0).alias("base_price"),
        F.lit(None).cast("double").alias("coupon_discount"),
        F.when(c("l_suppkey") % 4 == 0, c("p_name")).alias("ad_title"),
        name.alias("raw_title"),
        F.lit(None).cast("string").alias("image_url"),
        (c("l_linestatus") == "F").alias("is_trusted"),
        F.lit("flipp_api").alias("source_type"),
        F.concat(c("week").cast("string"), F.lit(" 06:00:00")).alias("recorded_at"),
    )


BADGES = [
    "POINTS_FREEBIE", "NEW_ALL_TIME_LOW", "MATCHES_ATL", "POINTS_DEAL", "POINTS_REWARD", "SPEND_SAVE", "PERCENT_OFF",
    "BEAT_AVERAGE", "CYCLE_REFRESH", "FIRST_SEEN", "POINTS_REDEMPTION", "STANDARD_DEAL", "PRICE_HIKE", "SEE_AD",
    "STORE_COUPON",
]


def catalog(spark: SparkSession, sf_dir: str):
    from pricetide.operators.history import Catalog

    return Catalog(observations(spark, sf_dir), products(spark, sf_dir), flyers(spark, sf_dir))


def feed_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated-looking deals with badges drawn from the keys: input for grouping and feed operators."""
    c = F.col
    t = _tiles(spark, sf_dir)
    p = products(spark, sf_dir).select("product_id", "canonical_name", "brand", "category", "unit_size", "unit_type")
    price = F.when(~((c("l_linenumber") == 7) & (c("l_quantity") % 5 == 0)), c("cents") / 100.0)
    raw = c("l_orderkey") * 10 + c("l_linenumber")
    tile = c("l_suppkey") % 5
    return t.join(p, t["l_partkey"] == p["product_id"]).select(
        (raw * 1048576 + c("l_partkey")).alias("deal_id"), "flyer_id", "product_id", "canonical_name", "brand", "category",
        "merchant", price.alias("current_price"), "unit_size", "unit_type",
        (c("cents") / 100.0 / c("unit_size")).alias("unit_price"), c("l_linenumber").alias("page_number"),
        (c("l_linenumber") == 1).alias("is_front_page"),
        (c("list_cents") / 200.0).alias("historical_min"), (c("list_cents") * 3 / 400.0).alias("historical_avg"),
        F.element_at(F.array(*(F.lit(b) for b in BADGES)), (c("l_orderkey") % 15 + 1).cast("int")).alias("badge"),
        F.when(c("l_orderkey") % 15 == 1, "New All-Time Low!").otherwise("Past sale range").alias("summary_reason"),
        F.when(c("l_orderkey") % 97 == 0, "meal_deal").when(c("l_orderkey") % 41 == 0, "must_buy").otherwise(
            "standard").alias("promo_type"),
        F.when(c("l_orderkey") % 53 == 0, "BUY 1 GET 1 FREE").alias("promo_detail"),
        F.lit(1).alias("qualifying_qty"), (c("list_cents") / 100.0).alias("base_price"), raw.alias("raw_deal_id"),
        tile.cast("string").alias("ad_id"), F.lit(None).cast("string").alias("ad_title"),
        F.when(tile == 1, F.concat(c("p_name"), F.lit(" or more"))).otherwise(c("p_name")).alias("raw_title"),
        F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("double").alias("coupon_discount"),
        F.when(c("l_orderkey") % 2 == 0, c("cents") / 100.0 / c("unit_size")).alias("category_min_unit_price"),
        ((c("l_linenumber") == 3) & (c("l_tax") > 0.04)).alias("is_category_best"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.filter(F.col("p_partkey") % 5 != 0).select(
        F.concat(F.lit("pid_"), F.col("p_partkey").cast("string")).alias("product_key"),
        F.element_at(F.array(*(F.lit(r) for r in ("love", "deal_only", "giveaway", "hide"))),
                     (F.col("p_partkey") % 4 + 1).cast("int")).alias("rating"))


def payloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages and items of every circular with x positions; items lie on, between and outside the pages."""
    t = _tiles(spark, sf_dir)
    pages = t.select("flyer_id").distinct().withColumn("page_number", F.explode(F.array(*(F.lit(i) for i in range(1, 6))))).select(
        "flyer_id", "page_number", ((F.col("page_number") - 1) * 100.0).alias("left"),
        (F.col("page_number") * 100.0 - 10).alias("right"))
    items = t.select(
        "flyer_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.col("l_partkey").alias("part"),
        F.col("p_name").alias("name"), ((F.col("l_partkey") % 53) * 10.0).alias("left"),
        F.when(F.col("l_linenumber") != 4, (F.col("l_partkey") % 53) * 10.0 + F.col("l_quantity")).otherwise(0.0).alias("right"),
        (F.col("l_linenumber") % 3 != 0).alias("is_priced"),
        F.concat(F.col("week").cast("string"), F.lit("T00:00:00")).alias("valid_from"),
        F.concat(F.date_add("week", F.when(F.col("l_partkey") % 53 < 12, 60).otherwise(6)).cast("string"),
                 F.lit("T23:59:59")).alias("valid_to"))
    return pages, items


TITLE_BRANDS = ["Progresso", "Knorr", "Lipton", "Swanson"]
TITLE_PASTA = ["Barilla", "Kraft", "Quaker"]


def compound_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tile per part whose title names two or three products with their own or a shared size."""
    p = _read(spark, sf_dir, "part")
    c = F.col
    pick = lambda names: F.element_at(F.array(*(F.lit(n) for n in names)), (c("p_partkey") % len(names) + 1).cast("int"))
    size = (c("p_size") + 1).cast("string")
    two = F.concat(pick(TITLE_BRANDS), F.lit("® Soup "), size, F.lit(" oz., "), pick(TITLE_PASTA), F.lit(" Pasta 16 oz., Select Varieties"))
    three = F.concat(F.lit("Lucerne Chunk, Shredded or Sliced Cheese "), size, F.lit(" oz"))
    pair = F.concat(F.lit("Doritos, Tostitos "), size, F.lit(" oz."))
    none, nod = F.lit(None).cast("string"), F.lit(None).cast("double")
    return p.select(
        c("p_partkey").alias("item_id"), F.lit(1).cast("bigint").alias("flyer_id"),
        F.when(c("p_partkey") % 3 == 0, two).when(c("p_partkey") % 3 == 1, three).otherwise(pair).alias("name"),
        (F.round(c("p_retailprice") * 100) / 100.0).alias("price"), nod.alias("original_price"), none.alias("pre_price_text"),
        none.alias("post_price_text"), none.alias("description"), none.alias("brand"), F.lit(2).alias("page_number"),
        F.lit(False).alias("is_front_page"), none.alias("cutout_image_url"), none.alias("clean_image_url"))


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circulars' pages and items as JSON payload text, one document per circular and item block."""
    pages, items = payloads(spark, sf_dir)
    block = items.withColumn("block", F.col("part") % 16)
    docs = block.groupBy("flyer_id", "block").agg(F.collect_list(F.struct(
        F.col("item_id").alias("id"), "name", F.format_string("%.2f", F.col("left") / 7).alias("price"), "left", "right", "valid_from",
        "valid_to")).alias("items"))
    pg = pages.groupBy("flyer_id").agg(F.collect_list(F.struct(F.col("page_number").alias("page"), "left", "right")).alias("pages"))
    return docs.join(pg, "flyer_id").select(F.to_json(F.struct("flyer_id", "pages", "items")).alias("value"))
