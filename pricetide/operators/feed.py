"""Shopper-facing views of evaluated deals: filters, scores, ratings, facets, unique products, callouts.

Works on any table with the evaluation columns (see ``evaluate``); ratings are a table (product_key, rating).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import vocab as V
from pricetide.functions.core import blank, cap, fixed, has, hit, money, num, once_per, text, truthy
from pricetide.functions.promo import promo_of  # noqa: F401  (re-exported for callers that build feeds)
from pricetide.functions.text import (
    is_alcohol, is_basket_coupon, is_placeholder, product_key, shopper_department,
)
from pricetide.operators.evaluate import deal_order
from pricetide.operators.grouping import GROUP, absorb_meal_deals, group_items

RATINGS = ["love", "deal_only", "giveaway", "hide"]


# ------------------------------------------------------------------ predicates
def atl_badge(b: Column) -> Column:
    return hit(b, r"new_all_time_low|new_atl|matches_atl|match_atl|atl|all[-_]time")


def new_atl(b: Column, why: Column) -> Column:
    return hit(b, r"new_all_time_low|new_atl") | (atl_badge(b) & has(why, "new all-time low"))


def match_atl(b: Column, why: Column) -> Column:
    return hit(b, r"matches_atl|match_atl") | (
        atl_badge(b) & hit(why, r"matches all-time low|multi-week sale at all-time low"))


def great_badge(b: Column) -> Column:
    return hit(b, r"great|beat")


def points_in(t: Column) -> Column:
    """First number of points mentioned, by three wordings in order."""
    return F.coalesce(
        cap(t, r"(\d+)[-\s]+(?:CHOICE\s+)?POINTS"), cap(t, r"(\d+)[-\s]+POINT\s+FREEBIE"),
        cap(t, r"FREE\s+with\s+(\d+)\s+CHOICE\s+points")).try_cast("int")


def points_freebie(b: Column, detail: Column) -> Column:
    return hit(b, "points_freebie") | F.coalesce(points_in(detail) <= 10, F.lit(False))


def points_deal(b: Column) -> Column:
    return hit(b, "points_deal")


def points_redemption(b: Column, kind: Column, detail: Column) -> Column:
    return hit(b, "points_redemption") | F.coalesce(kind == "points_redemption", F.lit(False)) | has(detail, "choice points")


def special_promo(kind: Column) -> Column:
    return blank(kind).isNotNull() & (kind != "standard")


def with_departments(deals: DataFrame) -> DataFrame:
    """Shopper department of every deal. Its text rules take most of a feed's time, so they run once for each distinct text, not once for each deal."""
    return once_per(deals, ["department", "category", "canonical_name", "brand", "raw_title", "ad_title"], "department", shopper_department)


def with_feed_columns(deals: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
    """Adds department, product key, rating and the predicate columns every filter and score uses."""
    c = F.col
    for name, kind in (("department", "string"),):
        if name not in deals.columns:
            deals = deals.withColumn(name, F.lit(None).cast(kind))
    b, why, kind, detail, price = (c(x) for x in ("badge", "summary_reason", "promo_type", "promo_detail", "current_price"))
    out = with_departments(deals).withColumns({
        "product_key": product_key(c("product_id"), c("canonical_name")),
        "is_new_atl": new_atl(b, why), "is_match_atl": match_atl(b, why), "is_atl": atl_badge(b),
        "is_great": great_badge(b), "is_points_freebie": points_freebie(b, detail), "is_points_deal": points_deal(b),
        "is_promo": special_promo(kind) | hit(detail, "bogo|buy"),
        "is_best": F.coalesce(c("is_category_best"), F.lit(False)),
    }).withColumns({
        "is_free": c("is_points_freebie") | F.coalesce(price == 0, F.lit(False)),
        "qualifies": c("is_atl") | c("is_great") | c("is_best") | c("is_points_freebie") | special_promo(kind),
    })
    if ratings is None:
        return out.withColumn("rating", F.lit(None).cast("string"))
    return out.join(ratings.select("product_key", "rating"), "product_key", "left")


def chip_filters() -> dict[str, Column]:
    """Named filters over a feed table."""
    c = F.col
    b, kind, detail, rating = c("badge"), c("promo_type"), c("promo_detail"), c("rating")

    def rated(r: str) -> Column:
        return F.coalesce(rating == r, F.lit(False))

    great = c("is_great") | c("is_atl")
    return {
        "all": F.lit(True),
        "atl": c("is_atl"), "beat": great, "great": great,
        "cycle": hit(b, "cycle|refresh"), "firstseen": hit(b, "first"), "hike": hit(b, "hike"),
        "front": F.coalesce(c("is_front_page"), F.lit(False)), "catbest": c("is_best"), "bogo": c("is_promo"),
        "points": hit(b, "points|freebie|reward") | F.coalesce(kind.startswith("points"), F.lit(False))
        | hit(detail, "choice|points"),
        "favorites": rated("love"), "deal_picks": rated("deal_only") & c("qualifies"),
        "giveaways": rated("giveaway"), "hidden": rated("hide"),
    }


def tokens_match(blob: Column, query: str) -> Column:
    """Every blank-separated token of the query occurs somewhere in the text."""
    low = F.lower(blob)
    return reduce(lambda a, t: a & F.contains(low, F.lit(t)), query.lower().split(), F.lit(True))


def item_blob() -> Column:
    return F.concat_ws(" ", *(text(F.col(x)) for x in ("canonical_name", "brand", "department", "category", "promo_detail")))


def flat_sort(name: str = "featured") -> list[Column]:
    c = F.col
    return {
        "unit_price_asc": [F.coalesce(c("unit_price"), F.lit(999999.0)), c("deal_id")],
        "price_asc": [F.coalesce(c("current_price"), F.lit(999999.0)), c("deal_id")],
        "price_desc": [F.desc(F.coalesce(c("current_price"), F.lit(-1.0))), c("deal_id")],
        "page_asc": [F.coalesce(truthy(c("page_number")), F.lit(1)), c("deal_id")],
        "name_asc": [F.lower(text(c("canonical_name"))), c("deal_id")],
        "featured": [F.desc(featured_score()), F.coalesce(truthy(c("page_number")), F.lit(1)), c("deal_id")],
    }[name]


def flat_feed(feed: DataFrame, department: str | None = None, chip: str = "all", query: str = "",
              sort: str | None = "featured") -> DataFrame:
    """Filtered and sorted list of single deals; hidden products show only when searched for or asked for."""
    out = feed.filter(chip_filters()[chip])
    if department:
        out = out.filter(F.col("department") == department)
    if chip != "hidden" and not query.strip():
        out = out.filter(~F.col("rating").eqNullSafe("hide"))
    if query.strip():
        out = out.filter(tokens_match(item_blob(), query))
    return out.orderBy(*flat_sort(sort)) if sort else out


def featured_score() -> Column:
    """Quality of a single deal plus the shopper's affinity to it."""
    c = F.col
    quality = (
        F.when(c("is_free"), 500).when(c("is_new_atl"), 300).when(c("is_match_atl"), 200).when(c("is_points_deal"), 180)
        .when(c("is_best"), 150).when(c("is_great"), 120).when(c("is_promo"), 80).otherwise(0)
    )
    any_reason = (c("is_free") | c("is_new_atl") | c("is_match_atl") | c("is_points_deal") | c("is_best")
                  | c("is_great") | c("is_promo"))
    cheap = c("is_free") | F.coalesce(c("current_price") <= 0.25, F.lit(False))
    affinity = (
        F.when(c("rating") == "love", 350).when(c("rating") == "deal_only", F.when(any_reason, 150).otherwise(-50))
        .when(c("rating") == "giveaway", F.when(cheap, 200).otherwise(-200)).otherwise(0)
    )
    front = F.when(F.coalesce(c("is_front_page"), F.lit(False)), 40).otherwise(0)
    return 30 + quality + front + affinity


# ------------------------------------------------------------------ groups in the viewer
def viewer_items(feed: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    return absorb_meal_deals(group_items(feed, viewer=True, wanted=wanted))


#: Columns of items that a search and the titles read, besides the keys, the name and the position.
SEARCH_COLS = ["brand", "department", "category", "promo_detail", "promo_type", "raw_title", "ad_title"]
#: Columns of items that groups, chips and departments read, besides the keys, the name and the position.
VIEW_COLS = ["deal_id", "badge", "rating", "department", "category", "promo_detail", "promo_type", "page_number", "is_front_page", "current_price", "unit_price", "unit_type",
             "is_new_atl", "is_match_atl", "is_atl", "is_great", "is_best", "is_points_freebie", "is_points_deal", "is_promo", "qualifies"]


def _first(col: str, cond: Column | None = None) -> Column:
    """Value of the first item by position, of those that meet cond."""
    return F.min_by(col, F.col("pos") if cond is None else F.when(cond, F.col("pos")))


def header_fields() -> list[Column]:
    """What a group's header shows besides its title and brands."""
    return [
        F.coalesce(_first("promo_detail", blank(F.col("promo_detail")).isNotNull()), F.lit("")).alias("promo_detail"),
        F.coalesce(blank(_first("category")), F.lit("Other")).alias("category"), _first("department").alias("department"),
    ]


def search_headers(items: DataFrame) -> DataFrame:
    """One row per ad group with the columns that a search reads, for items that hold SEARCH_COLS only."""
    return items.groupBy(*GROUP).agg(*header_fields())


def viewer_groups(items: DataFrame) -> DataFrame:
    """One row per ad group with the flags, ranges and featured score the viewer filters and sorts by."""
    c = F.col

    def some(cond: Column) -> Column:
        return F.max(F.coalesce(cond, F.lit(False)))

    def rated(r: str) -> Column:
        return c("rating") == r

    first = _first
    units = (
        items.filter(blank(c("unit_type")).isNotNull()).groupBy(*GROUP, "unit_type")
        .agg(F.count("*").alias("k"), F.min("pos").alias("p"), F.min("unit_price").alias("lo"), F.max("unit_price").alias("hi"))
        .groupBy(*GROUP).agg(F.min_by(F.struct("unit_type", "lo", "hi"), F.struct(-c("k"), c("p"))).alias("mode"))
    )
    g = items.groupBy(*GROUP).agg(
        F.count("*").alias("n_items"),
        F.min("current_price").alias("min_price"), F.max("current_price").alias("max_price"),
        *header_fields(),
        F.coalesce(first("promo_type", special_promo(c("promo_type"))), F.lit("standard")).alias("promo_type"),
        some(c("is_new_atl")).alias("has_new_atl"), some(c("is_match_atl")).alias("has_match_atl"),
        some(c("is_atl")).alias("has_atl"), some(c("is_great") | c("is_atl")).alias("has_great"),
        some(c("is_best")).alias("has_cat_best"), some(c("is_points_freebie")).alias("has_points_freebie"),
        some(c("is_points_deal")).alias("has_points_deal"), some(c("is_promo")).alias("has_promo"),
        some(rated("love")).alias("has_loved"), some(rated("deal_only")).alias("has_deal_only"),
        some(rated("deal_only") & c("qualifies")).alias("has_gated_deal_only"),
        some(rated("giveaway")).alias("has_giveaway"),
        some(rated("giveaway") & (c("current_price").isNull() | (c("current_price") <= 0.25) | c("is_points_freebie"))).alias(
            "has_free_giveaway"),
        F.min(F.coalesce(rated("hide"), F.lit(False))).alias("all_hidden"), some(rated("hide")).alias("has_hidden"),
        some(c("is_front_page")).alias("is_front_page"), some(c("current_price") == 0).alias("has_zero"),
        F.coalesce(truthy(first("page_number")), F.lit(1)).alias("page"),
        F.min_by("deal_id", F.when(c("current_price") > 0, F.struct(-c("current_price"), c("pos")))).alias("dearest"),
        first("deal_id").alias("head"), first("deal_id", c("is_new_atl")).alias("new_low"),
        first("deal_id", c("is_match_atl")).alias("same_low"),
    ).join(units, GROUP, "left")
    meal = c("group_key").startswith("meal_deal_") | (c("promo_type") == "meal_deal")
    g = g.withColumn("is_meal_deal", meal)
    quality = (
        F.when(c("has_points_freebie") | (c("is_meal_deal") & c("has_zero")), 500).when(c("has_new_atl"), 300)
        .when(c("has_match_atl"), 200).when(c("has_points_deal"), 180).when(c("has_cat_best"), 150)
        .when(c("has_great"), 120).when(c("has_promo"), 80).otherwise(0)
    )
    affinity = (
        F.when(c("has_loved"), 350).when(c("has_deal_only"), F.when(c("has_gated_deal_only"), 150).otherwise(-50))
        .when(c("has_giveaway"), F.when(c("has_free_giveaway"), 200).otherwise(-200)).otherwise(0)
    )
    return g.withColumns({
        "featured": 30 + quality + F.when(c("is_front_page"), 40).otherwise(0) + affinity,
        "anchor": F.when(c("is_meal_deal"), F.coalesce("dearest", "head")).otherwise(
            F.coalesce("new_low", "same_low", "head")),
        "min_unit_price": c("mode.lo"), "max_unit_price": c("mode.hi"), "unit_type": c("mode.unit_type"),
    }).drop("mode", "dearest", "head", "new_low", "same_low", "has_zero")


def member_bits(items: DataFrame) -> DataFrame:
    """One bitmap a group: bit i is set if any member passes the i-th chip; the next one, if any member isn't rated hidden.

    The bitmap is summed by map-side ``bit_or``, whatever the size of a group; every chip on groups is then a test of one number.
    """
    tests = [*chip_filters().values(), ~F.col("rating").eqNullSafe("hide")]
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(test, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, test in enumerate(tests)])
    return items.groupBy(*GROUP).agg(F.bit_or(mask).alias("members"))


def chip_bit(chip: str) -> Column:
    """Whether any member passes a chip."""
    return F.getbit("members", F.lit(list(chip_filters()).index(chip)))


def all_hidden() -> Column:
    return F.getbit("members", F.lit(len(chip_filters()))) == 0


def group_sort(name: str = "featured") -> list[Column]:
    """Orders of ad groups; groups without a price come last."""
    c = F.col
    ties = [c("flyer_id"), c("group_key")]
    return {
        "unit_price_asc": [F.coalesce(c("min_unit_price"), F.lit(999999.0)), *ties],
        "price_asc": [F.coalesce(c("min_price"), F.lit(999999.0)), *ties],
        "price_desc": [F.desc(F.coalesce(c("max_price"), F.lit(-1.0))), *ties],
        "page_asc": [F.coalesce(truthy(c("page")), F.lit(1)), *ties],
        "name_asc": [F.lower(text(c("title"))), *ties],
        "featured": [F.desc("featured"), F.coalesce(truthy(c("page")), F.lit(1)), *ties],
    }[name]


def group_feed(items: DataFrame, groups: DataFrame, titles: DataFrame, department: str | None = None, chip: str = "all", query: str = "",
               sort: str | None = "featured") -> DataFrame:
    """Filtered and sorted list of ad groups: a chip or department that any member has; groups of hidden products only show when searched for or asked for."""
    found = viewer_search(items, groups, titles, query) if query.strip() else groups.join(titles.select(*GROUP, "title"), GROUP, "left")
    out = found.join(member_bits(items), GROUP).filter(chip_bit(chip) == 1)
    if department:
        out = out.join(items.filter(F.col("department") == department).select(*GROUP).distinct(), GROUP, "left_semi")
    if chip != "hidden" and not query.strip():
        out = out.filter(~all_hidden())
    out = out.drop("members")
    return out.orderBy(*group_sort(sort)) if sort else out


def viewer_search(items: DataFrame, groups: DataFrame, titles: DataFrame, query: str) -> DataFrame:
    """Groups whose header, one item, or all items together contain every search token."""
    c = F.col
    tokens = query.lower().split()
    header = F.lower(F.concat_ws(" ", c("title"), c("promo_detail"), F.array_join(F.coalesce(
        c("brands"), F.array().cast("array<string>")), " "), c("department"), c("category")))
    blob = F.lower(item_blob())
    per_item = [F.contains(blob, F.lit(t)) for t in tokens]
    seen = items.groupBy(*GROUP).agg(
        F.max(reduce(lambda a, b: a & b, per_item, F.lit(True))).alias("one_item"),
        *(F.max(x).alias(f"t{i}") for i, x in enumerate(per_item)))
    spread = reduce(lambda a, b: a & b, [c(f"t{i}") | F.contains(header, F.lit(t)) for i, t in enumerate(tokens)], F.lit(True))
    return groups.join(titles, GROUP).join(seen, GROUP).filter(c("one_item") | spread).select(*groups.columns, "title")


# ------------------------------------------------------------------ ratings and products
def unique_products(feed: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per product key: attributes of its first deal, price of its cheapest.

    The position is computed once a row. With tasks, rows are dealt by key to that many, which then bound what one of them sorts; otherwise
    every task first finds the winners of its own rows.
    """
    c = F.col
    rows = feed.select(
        "product_key", "deal_id", "product_id", c("canonical_name").alias("name"), text(c("brand")).alias("brand"), F.coalesce(blank(c("category")), F.lit("Other")).alias("category"),
        "department", "unit_type", "badge", "is_front_page", c("current_price").alias("price"), "unit_price", F.struct(*deal_order()).alias("at"))
    rows = rows.repartition(tasks, "product_key") if tasks else rows
    cheap = F.struct(F.coalesce(c("price"), F.lit(float("inf"))).alias("least"), "at", "price", "unit_price", "deal_id")
    first = F.struct("at", "product_id", "name", "brand", "category", "department", "unit_type", "badge", "is_front_page")
    best = rows.groupBy("product_key").agg(F.min(first).alias("a"), F.min(cheap).alias("p"))
    return best.select("product_key", *(f"a.{x}" for x in ("product_id", "name", "brand", "category", "department", "unit_type", "badge", "is_front_page")), "p.price", "p.unit_price", "p.deal_id")


def product_preferences(products: DataFrame, ratings: DataFrame, query: str = "", status: str = "all",
                        department: str | None = None, sort: str = "name_asc") -> DataFrame:
    """Unique products with their rating, filtered and sorted for the preference screen."""
    c = F.col
    out = products.join(ratings.select("product_key", "rating"), "product_key", "left")
    q = query.lower().strip()
    if q:
        found = [F.contains(F.lower(text(c(x))), F.lit(q)) for x in ("name", "brand", "category", "department")]
        out = out.filter(reduce(lambda a, b: a | b, found))
    if status == "unrated":
        out = out.filter(c("rating").isNull())
    elif status in RATINGS:
        out = out.filter(c("rating") == status)
    if department:
        out = out.filter(c("department") == department)
    name, rated = F.lower(text(c("name"))), c("rating").isNotNull().cast("int")
    order = {
        "name_asc": [name], "price_asc": [F.coalesce(c("price"), F.lit(999999.0))],
        "category": [c("department"), name], "unrated_first": [rated, name], "rated_first": [F.desc(rated), name],
    }[sort]
    return out.orderBy(*order, "product_key")


def rating_stats(products: DataFrame, ratings: DataFrame) -> DataFrame:
    """Counts per rating, rated in total, and products still unrated."""
    r = ratings.agg(*(F.count_if(F.col("rating") == x).alias(x) for x in RATINGS))
    n = products.agg(F.countDistinct("product_key").alias("products"))
    total = sum((F.col(x) for x in RATINGS[1:]), F.col(RATINGS[0]))
    return r.crossJoin(n).select(*RATINGS, total.alias("rated"),
                                 F.greatest(F.lit(0), F.col("products") - total).alias("unrated"))


def department_facets(feed: DataFrame) -> DataFrame:
    """Number of rows per department, largest first and 'Other' last."""
    return feed.groupBy("department").agg(F.count("*").alias("n")).orderBy(
        (F.col("department") == "Other").cast("int"), F.desc("n"), "department")


def stats_banner(feed: DataFrame) -> DataFrame:
    return feed.agg(F.count("*").alias("total"), F.count_if("is_atl").alias("atl"),
                    F.count_if("is_front_page").alias("front_page"), F.count_if("is_best").alias("category_best"))


def shopping_list_total(picked: DataFrame) -> DataFrame:
    return picked.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.coalesce(
        "current_price", F.lit(0.0))), F.lit(0.0)).alias("total"))


# ------------------------------------------------------------------ callouts
def history_callout(feed: DataFrame) -> DataFrame:
    """Savings against the average, distance from the past low, and warnings of weak offers."""
    c = F.col
    price, lo, avg = c("current_price"), c("historical_min"), c("historical_avg")
    best = c("is_new_atl") | c("is_match_atl") | c("is_atl") | F.coalesce(price <= lo, F.lit(False))
    pct = lambda x: F.floor(x * 100 + 0.5).cast("int")  # noqa: E731  (rounds half up)
    savings, above = pct((avg - price) / truthy(avg)), pct((price - lo) / truthy(lo))
    top = best & truthy(avg).isNotNull() & price.isNotNull()
    weak = ~top & truthy(lo).isNotNull() & truthy(avg).isNotNull() & (lo < price)
    return feed.withColumns({
        "callout": F.when(top, "best").when(weak, "range"),
        "savings_vs_avg_pct": F.when(top & (savings > 0), savings),
        "above_min_pct": F.when(weak, above),
        "warning": F.when(weak & (price >= avg * 1.05), "near_average").when(weak & (above >= 25), "modest"),
    })


def points_value(feed: DataFrame) -> DataFrame:
    """Points, saved value and cents per point of points offers, with the display tag."""
    c = F.col
    is_points = c("is_points_freebie") | c("is_points_deal") | points_redemption(c("badge"), c("promo_type"), c("promo_detail"))
    t = F.concat_ws(" ", *(text(c(x)) for x in ("promo_detail", "summary_reason", "raw_title", "canonical_name")))
    pts = points_in(t)
    saved = F.coalesce(
        num(F.coalesce(cap(t, V.SAVE_AMOUNT), cap(t, r"for\s+\$(\d+(?:\.\d{2})?)\s+value"))),
        F.when(c("base_price") > 0, c("base_price")), F.when(c("current_price") > 0, c("current_price")))
    rate = F.coalesce(num(cap(t, r"([\d\.]+)¢/pt")), F.when((pts > 0) & truthy(saved).isNotNull(), saved / truthy(pts) * 100))
    out = feed.withColumns({"pts": F.when(is_points, pts), "saved_value": F.when(is_points, saved),
                            "cents_per_point": F.when(is_points, rate)})
    p, s, r = c("pts").cast("string"), money(c("saved_value")), fixed(c("cents_per_point"), 1)
    free = c("is_points_freebie")
    tag = F.coalesce(
        F.when(free, F.concat(F.lit("🪙 "), p, F.lit(" pts • Save "), s, F.lit(" ("), r, F.lit("¢/pt)"))).otherwise(
            F.concat(F.lit("🪙 "), p, F.lit(" pts • "), s, F.lit(" val ("), r, F.lit("¢/pt)"))),
        F.when(free, F.concat(F.lit("🪙 FREE with "), p, F.lit(" pts"))).otherwise(
            F.concat(F.lit("🪙 "), p, F.lit(" CHOICE pts"))),
        F.lit(""))
    return out.withColumn("yield_tag", F.when(is_points, tag))


def badge_labels(feed: DataFrame) -> DataFrame:
    """Badges shown for a deal: rating-aware headline, supplementary marks, store programmes."""
    c = F.col
    b, rating, new, match = F.upper(text(c("badge"))), c("rating"), c("is_new_atl"), c("is_match_atl")
    any_low, hike = hit(b, r"ATL|ALL[-_]TIME"), hit(b, "HIKE")
    dear = F.coalesce((c("historical_avg") > 0) & (c("current_price") > c("historical_avg") * 1.15), F.lit(False))
    loved = (
        F.when(c("is_free"), "FREE W/ POINTS").when(new, "NEW ALL-TIME LOW").when(match, "MATCHES ATL")
        .when(any_low, "ALL-TIME LOW").when(c("is_points_deal"), "HIGH-YIELD POINTS").when(c("is_best"), "BEST IN CATEGORY")
        .when(c("is_great"), "GREAT DEAL").when(hike | dear, "MODEST DEAL").otherwise("ROUTINE SALE")
    )
    pick = (
        F.when(c("is_free"), "FREE W/ POINTS").when(new, "NEW ALL-TIME LOW").when(match | any_low, "ALL-TIME LOW")
        .when(c("is_points_deal"), "HIGH-YIELD").when(c("is_best") | c("is_great"), "GREAT DEAL")
    )
    headline = (
        F.when(rating == "love", F.concat(F.lit("FAVORITE • "), loved))
        .when(rating == "deal_only", F.concat_ws(" • ", F.lit("DEAL PICK"), pick))
        .when(rating == "giveaway", "GIVEAWAY").when(rating == "hide", "HIDDEN")
    )
    plain = ~F.coalesce(rating.isin("love", "deal_only"), F.lit(False))
    mark = F.when(plain, (
        F.when(new, "NEW ALL-TIME LOW").when(match, "MATCHES ATL").when(any_low, "ALL-TIME LOW")
        .when(hit(b, "POINTS_FREEBIE"), "FREE W/ POINTS").when(c("is_great"), "GREAT DEAL")
        .when(c("is_points_deal"), "HIGH-YIELD POINTS")))
    best = F.when(plain & c("is_best"), "CAT BEST")
    programme = (
        F.when(hit(b, "REWARD"), "POINTS REWARD").when(hit(b, "POINTS_REDEMPTION"), "REDEEM POINTS")
        .when(hit(b, "SPEND"), "SPEND & SAVE").when(hit(b, "PERCENT_OFF|DISCOUNT"), "% OFF")
        .when(hit(b, "CYCLE|REFRESH"), "CYCLE MATCH").when(hike & ~rating.eqNullSafe("love"), "PRICE HIKE")
        .when(hit(b, "FIRST"), "FIRST SEEN")
    )
    return feed.withColumn("badges", F.array_compact(F.array(headline, mark, best, programme)))


def compact_tags(deals: DataFrame) -> DataFrame:
    """Short signal tags of a deal for one-line display."""
    from pricetide.functions.text import clean_repeated_promo

    c = F.col
    kind = c("promo_type")
    detail = blank(clean_repeated_promo(c("promo_detail")))
    detail = F.when(~has(detail, "get 0 free"), detail)
    base = F.coalesce(F.concat(F.lit(" (Base "), money(truthy(c("base_price"))), F.lit(")")), F.lit(""))
    mult_re = r"EARN\s+(\d+)X\s+(.*?)\s+\(~?(\d+(?:\.\d+)?)%\s*back(?:\s+in\s+.*?)?\)"
    mult = F.concat(F.lit("🪙 "), cap(detail, mult_re, 1), F.lit("X "), F.initcap(F.trim(cap(detail, mult_re, 2))),
                    F.lit(" (~"), cap(detail, mult_re, 3), F.lit("% back)"))
    promo = (
        F.when(kind == "bogo", F.concat(F.lit("🎁 "), detail, base)).when(kind == "must_buy", F.concat(F.lit("📦 "), detail))
        .when(kind == "digital_coupon", F.concat(F.lit("🎟️ "), detail))
        .when(kind.isin("points_redemption", "points_bonus"), F.coalesce(mult, F.concat(F.lit("🪙 "), detail)))
        .when(kind.isin("spend_save", "percent_off"), F.concat(F.lit("🏷️ "), detail))
    )
    avg, up = truthy(c("category_avg_unit_price")), truthy(c("unit_price"))
    pct = lambda x: F.bround(x * 100, 0).cast("int").cast("string")
    category = (
        F.when(c("is_category_best"), F.lit("🏆 Cat Best"))
        .when(up <= avg * 0.85, F.concat(F.lit("🔥 -"), pct((avg - up) / avg), F.lit("% cat avg")))
        .when(up > avg * 1.15, F.concat(F.lit("⚠️ +"), pct((up - avg) / avg), F.lit("% cat avg")))
    )
    low, price, dev = truthy(c("historical_min")), c("current_price"), truthy(c("diff_pct_vs_avg"))
    whole = F.bround(dev, 0).cast("int").cast("string")
    history = (
        F.when(c("badge").isin(V.ATL_BADGES), F.when(
            price < low - 0.005, F.concat(F.lit("🌟 -"), pct((low - price) / low), F.lit("% ATL")))
            .when(c("summary_reason").contains("Matches") | F.coalesce(
                F.abs(F.coalesce(price, F.lit(0.0)) - low) <= 0.005, F.lit(False)), F.lit("🌟 Matches ATL"))
            .otherwise("🌟 ATL"))
        .when(c("badge") == "PRICE_HIKE", F.coalesce(F.concat(F.lit("⚠️ +"), whole, F.lit("% vs avg")), F.lit("⚠️ Price Hike")))
        .when(c("badge") == "BEAT_AVERAGE", F.concat(F.lit("🔥 "), whole, F.lit("% vs avg")))
        .when((c("badge") == "CYCLE_REFRESH") & has(c("summary_reason"), "multi-week"), F.lit("🔄 Multi-week"))
    )
    return deals.withColumn("tags", F.array_compact(F.array(promo, category, history)))


# ------------------------------------------------------------------ reports
def filtered_report(deals: DataFrame, query: str | None = None, category: str | None = None, atl_only: bool = False,
                    category_best_only: bool = False, hikes_only: bool = False, sort_unit_price: bool = False,
                    include_see_ad: bool = False, include_alcohol: bool = False) -> DataFrame:
    """Evaluated deals after the report's filters, in report order."""
    c = F.col
    out = deals
    if query:
        blob = F.concat_ws(" ", *(text(c(x)) for x in (
            "canonical_name", "ad_title", "brand", "category", "promo_detail", "summary_reason")))
        out = out.filter(tokens_match(blob, query))
    if category:
        out = out.filter(has(c("category"), category) | has(c("canonical_name"), category))
    if atl_only:
        out = out.filter(c("badge").isin(V.ATL_BADGES))
    if category_best_only:
        out = out.filter("is_category_best")
    if hikes_only:
        out = out.filter(c("badge") == "PRICE_HIKE")
    if not include_see_ad and not query:
        out = out.filter(c("badge") != "SEE_AD")
    if not query:
        out = out.filter(~is_placeholder(c("canonical_name")))
    asked = any(k in (query or "").lower() for k in V.ALCOHOL_QUERY_WORDS) or any(
        k in (category or "").lower() for k in V.ALCOHOL_CATEGORY_WORDS)
    if not include_alcohol and not asked:
        out = out.filter(~is_alcohol(c("category"), c("canonical_name"), c("brand")))
    if sort_unit_price:
        return out.orderBy(F.asc_nulls_last("unit_price"), F.coalesce(truthy(c("current_price")), F.lit(999999.0)), "deal_id")
    return out.orderBy(*deal_order())


def omitted_see_ad(deals: DataFrame) -> DataFrame:
    return deals.agg(F.count_if(F.col("badge") == "SEE_AD").alias("omitted"))


def digest_sections(deals: DataFrame) -> DataFrame:
    """Deals tagged with every digest section they belong to, one row per section."""
    c = F.col
    coupon = is_basket_coupon(c("promo_type"), c("badge"), c("raw_title"), c("canonical_name"), c("promo_detail"),
                              c("coupon_discount"))
    front = F.coalesce(c("is_front_page"), F.lit(False))
    low = c("badge").isin(V.ATL_BADGES) | F.coalesce(c("is_category_best"), F.lit(False))
    sections = F.array_compact(F.array(
        F.when(coupon, "coupons"), F.when(~coupon & front, "front_page"),
        F.when(~coupon & ~front & (c("badge") == "PRICE_HIKE"), "inside_hikes"),
        F.when(~coupon & ~front & low, "inside_lows")))
    return deals.withColumn("section", F.explode(sections))


def coupon_line(detail: Column) -> Column:
    """'$20 OFF $100+ …' line of a store coupon."""
    p = r"(?:SAVE\s+\$(\d+)|(\d+)\s*OFF).*?(?:ON|WHEN\s+YOU\s+SPEND|OF|\$)\s*\$?(\d+)"
    save = F.coalesce(cap(detail, p, 1), cap(detail, p, 2))
    stated = F.concat(F.lit("$"), save, F.lit(" OFF $"), cap(detail, p, 3), F.lit("+ with for U Digital Coupon"))
    return F.coalesce(stated, blank(detail), F.lit("$20 OFF $100+ with for U Digital Coupon"))


def digest_counts(deals: DataFrame) -> DataFrame:
    return digest_sections(deals).groupBy("section").agg(F.count("*").alias("n"))
