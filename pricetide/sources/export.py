"""Exports of evaluated deals and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions.core import blank
from pricetide.operators.evaluate import deal_order


def export_rows(deals: DataFrame) -> DataFrame:
    """The 24 exported columns; deals without a category are filed under 'Other'."""
    c = F.col
    return deals.select(
        "deal_id", "product_id", "ad_id", "ad_title", "raw_deal_id", c("canonical_name").alias("name"), "brand",
        F.coalesce(blank(c("category")), F.lit("Other")).alias("category"), c("current_price").alias("price"), "unit_price",
        "unit_size", "unit_type", c("page_number").alias("page"), "is_front_page", "historical_min", "historical_avg",
        "diff_pct_vs_avg", "badge", c("summary_reason").alias("analysis"), "promo_type", "promo_detail", "raw_title",
        "image_url", "is_category_best")


def write_csv(deals: DataFrame, path: str) -> None:
    export_rows(deals.orderBy(*deal_order())).write.mode("overwrite").option("header", True).csv(path)


def write_json_rows(deals: DataFrame, path: str) -> None:
    """One JSON object per line, partitioned by Spark: the form for large exports."""
    export_rows(deals).write.mode("overwrite").json(path)


def json_envelope(deals: DataFrame, flyers: DataFrame) -> DataFrame:
    """One envelope document per circular: header, time, count and its deals.

    A document nests a whole circular, so this is for handing single circulars to a viewer; use
    ``write_json_rows`` for everything else.
    """
    rows = export_rows(deals)
    d = deals.select("flyer_id", "deal_id").join(rows, "deal_id")
    docs = d.groupBy("flyer_id").agg(F.count("*").alias("total_deals"),
                                     F.collect_list(F.struct(*rows.columns)).alias("deals"))
    head = F.struct("flyer_id", "postal_code", "merchant", "name", "valid_from", "valid_to", "scraped_at")
    return flyers.join(docs, "flyer_id").select("flyer_id", F.to_json(F.struct(
        head.alias("flyer"), F.current_timestamp().cast("string").alias("updated_at"), "total_deals", "deals"),
        {"ignoreNullFields": "false"}).alias("value"))


def read_deals(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """Exported deals from a bare JSON array or from an envelope with a ``deals`` field."""
    docs = spark.read.text(path, wholetext=True)
    envelope = F.from_json("value", f"deals array<struct<{row_schema}>>")["deals"]
    bare = F.from_json("value", f"array<struct<{row_schema}>>")
    is_array = F.ltrim("value").startswith("[")
    return docs.select(F.explode(F.when(is_array, bare).otherwise(envelope)).alias("d")).select("d.*")
