"""Price history: the observation star, product, category and ad-title histories, grouped timelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.core import blank, day10, like_ci, truthy, unit_cost, one_of
from pricetide.functions.text import history_group
from pricetide import vocab as V


@dataclass(frozen=True)
class Catalog:
    """The three tables of the price store."""

    observations: DataFrame
    products: DataFrame
    flyers: DataFrame


PRODUCT_COLS = ["canonical_name", "brand", "category", "unit_size", "unit_type", "last_shelf_price"]
FLYER_COLS = ["valid_from", "valid_to", "merchant", "postal_code"]


def star(c: Catalog) -> DataFrame:
    """Observations with their product and circular.

    No broadcast hint: Spark broadcasts a side only when its measured size allows it and otherwise
    sort-merges, where adaptive skew handling splits a product that dominates the table.
    """
    extra = [x for x in ("upc",) if x in c.products.columns]
    p = c.products.select("product_id", *PRODUCT_COLS, *extra)
    f = c.flyers.select("flyer_id", *FLYER_COLS)
    return c.observations.join(p, "product_id").join(f, "flyer_id")


def _scope(df: DataFrame, merchant: str | None, trusted_only: bool) -> DataFrame:
    if trusted_only:
        df = df.filter(F.col("is_trusted"))
    return df.filter(like_ci(F.col("merchant"), merchant)) if merchant else df


def product_history(s: DataFrame, product_ids: list[int] | DataFrame, trusted_only: bool = False,
                    merchant: str | None = None) -> DataFrame:
    """Time series of one or many products, oldest circular first."""
    rows = (s.join(product_ids.select("product_id").distinct(), "product_id", "left_semi")
            if isinstance(product_ids, DataFrame) else s.filter(F.col("product_id").isin(product_ids)))
    return _scope(rows, merchant, trusted_only).orderBy("product_id", "valid_from", "deal_id")


def flyer_product_histories(c: Catalog, flyer_ids: list[int]) -> DataFrame:
    """History of every product that appears in the given circulars."""
    present = c.observations.filter(F.col("flyer_id").isin(flyer_ids)).select("product_id").distinct()
    return star(Catalog(c.observations.join(present, "product_id", "left_semi"), c.products, c.flyers))


def flyer_deals(s: DataFrame, flyer_id: int, front_page_only: bool = False, trusted_only: bool = False) -> DataFrame:
    """All deals of one circular by page, then price (unpriced tiles first)."""
    rows = s.filter(F.col("flyer_id") == flyer_id)
    if front_page_only:
        rows = rows.filter(F.col("is_front_page"))
    if trusted_only:
        rows = rows.filter(F.col("is_trusted"))
    return rows.orderBy("page_number", F.asc_nulls_first("advertised_price"), "deal_id")


def names_category(name: Column, category: str) -> Column:
    """The category occurs in the name as a word at its start, middle, end, or as the whole name."""
    padded = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    return F.contains(padded, F.lit(f" {category.lower()} "))


def commodity_history(s: DataFrame, category: str, unit_type: str | None = None,
                      trusted_only: bool = False) -> DataFrame:
    """Unit prices of a commodity across brands; uncategorised products join in by name."""
    price = F.coalesce(F.col("unit_price"), unit_cost(F.col("advertised_price"), F.col("unit_size")))
    hit = (F.lower("category") == category.lower()) | (
        F.col("category").isNull() & names_category(F.col("canonical_name"), category))
    rows = s.filter(hit & F.col("advertised_price").isNotNull()).withColumn("unit_price", price).filter(
        F.col("unit_price").isNotNull())
    if unit_type:
        rows = rows.filter(F.col("unit_type") == unit_type)
    if trusted_only:
        rows = rows.filter(F.col("is_trusted"))
    return rows.orderBy("unit_price", F.desc("valid_from"), "deal_id")


def ad_title_history(s: DataFrame, title: str, not_flyer: int | None = None, before: str | None = None,
                     merchant: str | None = None) -> DataFrame:
    """Priced observations filed under an ad title or named like it."""
    rows = s.filter(((F.col("ad_title") == title) | (F.col("canonical_name") == title))
                    & F.col("advertised_price").isNotNull())
    if not_flyer is not None:
        rows = rows.filter(F.col("flyer_id") != not_flyer)
    if before:
        rows = rows.filter(day10(F.col("valid_from")) < before)
    if merchant:
        rows = rows.filter(like_ci(F.col("merchant"), merchant))
    return rows.orderBy("valid_from", "deal_id")


def search_products(c: Catalog, query: str, merchant: str | None = None, limit: int | None = 50) -> DataFrame:
    """Products whose name or brand contains the query, optionally only those a merchant advertised."""
    p = c.products.filter(like_ci(F.col("canonical_name"), query) | F.coalesce(
        like_ci(F.col("brand"), query), F.lit(False)))
    if merchant:
        f = c.flyers.filter(like_ci(F.col("merchant"), merchant)).select("flyer_id")
        seen = c.observations.join(f, "flyer_id", "left_semi").select("product_id")
        p = p.join(seen, "product_id", "left_semi")
    found = p.select("product_id", "canonical_name", "brand", "unit_size", "unit_type")
    return found if limit is None else found.orderBy("canonical_name", "product_id").limit(limit)


def flat_history(c: Catalog, query: str, merchant: str | None = None, trusted_only: bool = False) -> DataFrame:
    """Per-product history lines of the products found by a search."""
    found = search_products(c, query, merchant, limit=None).select("product_id")
    return product_history(star(c), found, trusted_only, merchant)


def with_history_group(s: DataFrame) -> DataFrame:
    """Adds the timeline key and title of every observation."""
    g = history_group(F.col("canonical_name"), F.col("brand"), F.col("ad_title"), F.col("raw_title"),
                      F.col("unit_size"), F.col("unit_type"))
    return s.withColumn("__g", g).withColumns(
        {"group_key": F.col("__g.group_key"), "group_title": F.col("__g.title")}).drop("__g")


def grouped_timeline(s: DataFrame, query: str | None = None, merchant: str | None = None,
                     trusted_only: bool = False) -> DataFrame:
    """One row per timeline group and circular run, summarising all its varieties.

    Lists (pages, varieties) hold distinct values only; single observations stay addressable through
    ``with_history_group`` instead of being nested into one row.
    """
    rows = s
    if query:
        cols = ("canonical_name", "brand", "category", "ad_title")
        found = F.lit(False)
        for col in cols:
            found = found | F.coalesce(like_ci(F.col(col), query), F.lit(False))
        rows = rows.filter(found)
    rows = with_history_group(_scope(rows, merchant, trusted_only))
    seq = F.struct(F.col("valid_from"), F.coalesce(F.col("advertised_price"), F.lit(-1.0)), F.col("deal_id"))
    runs = rows.groupBy(
        "group_key", "flyer_id", day10(F.col("valid_from")).alias("run_from"),
        day10(F.col("valid_to")).alias("run_to"), "merchant",
    ).agg(
        F.min_by("group_title", seq).alias("first_title"),
        F.min(seq).alias("first_seq"),
        F.min("advertised_price").alias("min_price"),
        F.max("advertised_price").alias("max_price"),
        F.min("unit_price").alias("min_unit_price"),
        F.max("unit_price").alias("max_unit_price"),
        F.min_by("unit_type", F.when(blank(F.col("unit_type")).isNotNull(), seq)).alias("unit_type"),
        F.max("is_front_page").alias("is_front_page"),
        F.array_sort(F.collect_set(truthy(F.col("page_number")))).alias("pages"),
        F.min_by("promo_detail", F.when(blank(F.col("promo_detail")).isNotNull(), seq)).alias("promo_detail"),
        F.min(F.coalesce("is_trusted", F.lit(True))).alias("is_trusted"),
        F.max(one_of(F.col("promo_type"), V.OUTLIER_PROMOS)).alias("is_doorbuster"),
        F.array_sort(F.collect_set("canonical_name")).alias("varieties"),
        F.count("*").alias("observations"),
    )
    titles = runs.groupBy("group_key").agg(F.min_by("first_title", "first_seq").alias("title"))
    # every run has a title: with a left join, Spark leaves the titles out, and the second pass that they take, where nobody reads them
    return runs.join(titles, "group_key", "left").drop("first_title", "first_seq")


def latest_flyer(c: Catalog, merchant: str | None = None, by_merchant: bool = False) -> DataFrame:
    """Latest circular: those with deals first, then by start day, then by scrape time."""
    f = c.flyers.filter(like_ci(F.col("merchant"), merchant)) if merchant else c.flyers
    counts = c.observations.groupBy("flyer_id").agg(F.count("*").alias("deal_count"))
    rank = F.struct(F.coalesce(F.col("deal_count"), F.lit(0)) > 0, day10(F.col("valid_from")),
                    F.coalesce(F.col("scraped_at").cast("string"), F.lit("")), F.col("flyer_id"))
    joined = f.join(counts, "flyer_id", "left")
    keys = ["merchant"] if by_merchant else []
    return joined.groupBy(*keys).agg(F.max_by("flyer_id", rank).alias("flyer_id"),
                                     F.max_by(F.coalesce("deal_count", F.lit(0)), rank).alias("deal_count"))
