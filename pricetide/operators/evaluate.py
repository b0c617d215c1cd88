"""Deal evaluation: every advertised price against its own history, its parent ad and its commodity.

``evaluate`` is set-based over any number of circulars.  The history of a deal is looked for in three
scopes, each answered by ``past_stats`` for the targets the earlier scopes left open: the product at the same
merchant, the product at any merchant (only for products with a known package size), the parent ad title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide import vocab as V
from pricetide.functions.core import blank, cut_lineage, day10, day_of, exact_round, fixed, let, lookup, money, only_some, text, truthy, unit_cost
from pricetide.functions.promo import loyalty, point_value_sample, promo_of
from pricetide.functions.text import ad_id, is_placeholder
from pricetide.operators.episodes import MAX_GAP_DAYS, history_rows
from pricetide.operators.history import Catalog, star
from pricetide.operators.past import past_stats

FAR_DAY = "9999-12-31"
NEAR = 0.005
STATS = ["n_past", "h_min", "h_max", "b_min", "b_max", "b_avg", "last_price", "last_end"]


# ------------------------------------------------------------------ point value
def dynamic_point_value(deals: DataFrame, min_points: int = 50, exclude: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Mean dollars per point of a circular's redemptions, four decimals; circulars without any drop out."""
    promo = promo_of([F.concat_ws(" ", text(F.col("raw_title")), text(F.col("promo_detail"))), F.col("canonical_name")],
                     merchant=F.col("merchant"))
    words = F.concat_ws(" ", "raw_title", "promo_detail", "canonical_name")
    return (
        deals.filter(F.lower(words).contains("point"))
        .withColumn("sample", only_some(let(promo, lambda p: point_value_sample(p, min_points, exclude))))
        .groupBy("flyer_id")
        .agg(exact_round(F.round(F.avg("sample"), 12), 4).alias("flyer_point_value"))
    )


# ------------------------------------------------------------------ category benchmark
def unit_price_of(price: str = "advertised_price") -> Column:
    return F.coalesce(F.col("unit_price"), unit_cost(F.col(price), F.col("unit_size")))


def category_past(hist: DataFrame, targets: DataFrame) -> DataFrame:
    """Minimum, sum and count of unit prices per (cat, unit_type) before each target day.

    Products without a category join every category their name mentions as a word: the n-grams of the
    name are equi-joined with the categories asked for, so nothing is compared pairwise.
    """
    priced = hist.filter(F.col("up").isNotNull() & F.col("unit_type").isNotNull())
    wanted = targets.select("cat", "unit_type", "day").distinct()
    stats = [F.min("up").alias("lo"), F.sum("up").alias("total"), F.count("*").alias("n")]
    known = priced.filter(F.col("cat").isNotNull()).groupBy("cat", "unit_type", "day").agg(*stats)

    words = F.split(F.lower("canonical_name"), " ")
    span = F.sequence(F.lit(1), F.size(words))
    grams = F.array_distinct(F.flatten(F.transform(span, lambda i: F.transform(
        F.sequence(F.lit(1), F.size(words) - i + 1), lambda k: F.array_join(F.slice(words, i, k), " ")))))
    unnamed = priced.filter(F.col("cat").isNull()).drop("cat")
    mentions = (
        unnamed.select("product_id", "canonical_name").distinct()
        .select("product_id", F.explode(grams).alias("cat"))
        .join(wanted.select("cat").distinct(), "cat", "left_semi")
    )
    by_product = unnamed.groupBy("product_id", "unit_type", "day").agg(*stats)
    guessed = by_product.join(mentions, "product_id").groupBy("cat", "unit_type", "day").agg(
        F.min("lo").alias("lo"), F.sum("total").alias("total"), F.sum("n").alias("n"))

    daily = (
        known.unionByName(guessed)
        .unionByName(wanted.withColumn("target", F.lit(True)), allowMissingColumns=True)
        .groupBy("cat", "unit_type", "day")
        .agg(F.min("lo").alias("lo"), F.sum("total").alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
             F.max("target").alias("target"))
    )
    past = Window.partitionBy("cat", "unit_type").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(
        "cat", "unit_type", "day", "target", F.min("lo").over(past).alias("cat_lo"),
        F.sum("total").over(past).alias("cat_sum"), F.sum("n").over(past).alias("cat_n"),
    ).filter("target").drop("target")


def flyer_category_minimum(deals: DataFrame) -> DataFrame:
    """Lowest positive unit price per circular, category and unit."""
    return (
        deals.filter((F.col("unit_price") > 0) & blank(F.col("category")).isNotNull()
                     & blank(F.col("unit_type")).isNotNull())
        .groupBy("flyer_id", F.lower("category").alias("cat"), F.lower("unit_type").alias("unit_lc"))
        .agg(F.min("unit_price").alias("flyer_cat_min"))
    )


def with_category_benchmark(deals: DataFrame, hist: DataFrame, asked: DataFrame) -> DataFrame:
    """Adds ``cat_min`` and ``cat_avg``; the circular's own minimum counts as one extra sample."""
    past = category_past(hist, asked.filter(F.col("cat").isNotNull()))
    own = flyer_category_minimum(deals)
    n = F.coalesce("cat_n", F.lit(0)) + F.col("flyer_cat_min").isNotNull().cast("int")
    total = F.coalesce("cat_sum", F.lit(0.0)) + F.coalesce("flyer_cat_min", F.lit(0.0))
    return (
        deals.join(past, ["cat", "unit_type", "day"], "left")
        .join(own, ["flyer_id", "cat", "unit_lc"], "left")
        .withColumns({"cat_min": F.least("cat_lo", "flyer_cat_min"),
                      "cat_avg": F.round(total / F.nullif(n, F.lit(0)), 9)})
        .drop("cat", "unit_lc", "cat_lo", "cat_sum", "cat_n", "flyer_cat_min")
    )


# ------------------------------------------------------------------ history scopes
def slim_history(s: DataFrame) -> DataFrame:
    """Priced observations without their long texts: all that benchmarks and history scopes read."""
    names = ["product_id", "canonical_name", "ad_title", "unit_type"]
    keyed = s.withColumns({
        "banner": F.lower(F.trim(text(F.col("merchant")))),
        "cat": F.lower("category"),
        "up": unit_price_of(),
    })
    return history_rows(keyed, [*names, "banner", "cat", "up"])


def with_lookup_keys(deals: DataFrame) -> DataFrame:
    """Adds what a deal is looked up by: banner, parent ad, commodity and unit."""
    c = F.col
    asks = (blank(c("category")).isNotNull() & c("deal_unit_price").isNotNull() & blank(c("unit_type")).isNotNull())
    banner = F.lower(F.trim(text(c("merchant"))))
    return deals.withColumns({
        "banner": banner,
        "parent": F.when(~is_placeholder(c("ad_title")), blank(F.trim(c("ad_title")))),
        "any_banner": (banner == "") | (
            truthy(c("unit_size")).isNotNull() & blank(c("unit_type")).isNotNull()),
        "cat": F.when(asks, F.lower("category")),
        "unit_lc": F.when(asks, F.lower("unit_type")),
    })


LOOKUP = ["product_id", "banner", "parent", "any_banner", "cat", "unit_type", "day"]


def with_past(deals: DataFrame, hist: DataFrame, asked: DataFrame, max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    """Adds ``past``: the statistics of the first history scope that knows the deal, else null.

    A deal without a merchant asks the whole history at once. Each scope's answer (one narrow row per key and day) is written out before the next scope asks for what
    is still open; otherwise every scope would carry, and re-run, the plans of all earlier ones.
    """
    own_keys, all_keys, ad_keys = ["product_id", "banner"], ["product_id"], ["parent", "banner"]
    line = ["day", "end_day", "from_day", "seq", "price", "trusted", "outlier"]
    first = asked.select("product_id", "banner", "parent", "any_banner", "day").distinct()
    rows_1 = hist.select(*own_keys, *line).join(first.select("product_id").distinct(), "product_id", "left_semi")
    own = cut_lineage(past_stats(rows_1, first.filter("banner <> ''"), own_keys, max_gap_days))
    open_1 = cut_lineage(first.join(own.select(*own_keys, "day"), [*own_keys, "day"], "left_anti"))

    ask_2 = open_1.filter("any_banner").select("product_id", "day").distinct()
    rows_2 = hist.select(*all_keys, *line).join(ask_2.select("product_id").distinct(), "product_id", "left_semi")
    wide = cut_lineage(past_stats(rows_2, ask_2, all_keys, max_gap_days))
    found_2 = wide.select("product_id", "day").withColumn("any_banner", F.lit(True))
    open_2 = open_1.join(found_2, ["product_id", "day", "any_banner"], "left_anti")

    ask_3 = open_2.filter(F.col("parent").isNotNull()).select("parent", "banner", "day").distinct()
    parents = ask_3.select("parent", F.col("banner").alias("asked_banner")).distinct()
    by_title = hist.join(parents, hist["ad_title"] == parents["parent"])
    by_name = hist.filter(~F.coalesce(F.col("ad_title") == F.col("canonical_name"), F.lit(False))).join(
        parents, F.col("canonical_name") == parents["parent"])
    rows_3 = by_title.unionByName(by_name).filter(F.contains("banner", "asked_banner")).select(
        "parent", F.col("asked_banner").alias("banner"), *line)
    ad = cut_lineage(past_stats(rows_3, ask_3, ad_keys, max_gap_days))

    def tagged(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.select(*keys, "day", F.struct(*STATS).alias(name))

    joined = (
        deals.join(tagged(own, own_keys, "s_own"), [*own_keys, "day"], "left")
        .join(tagged(wide, all_keys, "s_wide"), [*all_keys, "day"], "left")
        .join(tagged(ad, ad_keys, "s_ad"), [*ad_keys, "day"], "left")
    )
    best = F.coalesce(F.col("s_own"), F.when(F.col("any_banner"), F.col("s_wide")), F.col("s_ad"))
    return joined.withColumn("past", best).drop("s_own", "s_wide", "s_ad", "banner", "parent", "any_banner")


# ------------------------------------------------------------------ classification
def historical_badge(price: Column, h: Column, day: Column, placeholder: Column,
                     max_gap_days: int = MAX_GAP_DAYS) -> Column:
    """Badge of a priced deal with a past."""
    gap = F.datediff(day, h["last_end"])
    goes_on = (F.abs(price - h["last_price"]) < NEAR) & (gap >= 0) & (gap <= max_gap_days)
    varied = (h["h_max"] - h["h_min"]) >= 0.05
    at_low = F.when(varied, F.lit("MATCHES_ATL")).otherwise(F.lit("CYCLE_REFRESH"))
    return (
        F.when(placeholder, F.lit("STANDARD_DEAL"))
        .when(goes_on, F.when((price <= h["h_min"]) & varied, F.lit("MATCHES_ATL")).otherwise(F.lit("CYCLE_REFRESH")))
        .when(price < h["h_min"] - NEAR, F.lit("NEW_ALL_TIME_LOW"))
        .when(F.abs(price - h["h_min"]) <= NEAR, at_low)
        .when(price <= h["b_avg"] * 0.85, F.lit("BEAT_AVERAGE"))
        .when((price <= h["b_avg"]) | (F.abs(price - h["b_min"]) < 0.05), F.lit("CYCLE_REFRESH"))
        .when((price > h["b_avg"] * 1.15) | (price > h["b_max"]), F.lit("PRICE_HIKE"))
        .otherwise(F.lit("STANDARD_DEAL"))
    )


def first_seen_badge(up: Column, cat_min: Column, cat_avg: Column) -> Column:
    """Badge of a priced deal without a past, from its commodity benchmark."""
    return (
        F.when(up <= cat_min + NEAR, F.lit("NEW_ALL_TIME_LOW"))
        .when(up <= cat_avg * 0.85, F.lit("BEAT_AVERAGE"))
        .when(up <= cat_avg * 1.15, F.lit("STANDARD_DEAL"))
        .otherwise(F.lit("FIRST_SEEN"))
    )


def badge_rank(badge: Column) -> Column:
    return lookup(badge, V.BADGE_RANK, F.lit(99.0))


def deal_order() -> list[Column]:
    """Ranking of evaluated deals: badge, then price (zero and missing prices last)."""
    return [badge_rank(F.col("badge")), F.coalesce(truthy(F.col("current_price")), F.lit(999.0)), F.col("deal_id")]


def is_category_best(category: Column, unit_price: Column, cat_min: Column) -> Column:
    return F.coalesce(blank(category).isNotNull() & (unit_price <= cat_min + NEAR), F.lit(False))


def _say(*pieces: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in pieces))


def _pct_of(value: Column, ref: Column) -> Column:
    """Whole percent of deviation, cut towards zero."""
    return ((value - ref) / F.nullif(ref, F.lit(0.0)) * 100.0).cast("int")


def evaluate(c: Catalog, flyer_ids: list[int] | DataFrame | None = None, front_page_only: bool = False,
             max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    """Evaluate all deals of the given circulars (all of them by default)."""
    s = star(c)
    obs = c.observations
    if isinstance(flyer_ids, DataFrame):
        obs = obs.join(flyer_ids.select("flyer_id").distinct(), "flyer_id", "left_semi")
    elif flyer_ids is not None:
        obs = obs.filter(F.col("flyer_id").isin(list(flyer_ids)))
    if front_page_only:
        obs = obs.filter(F.col("is_front_page"))
    return evaluate_deals(star(Catalog(obs, c.products, c.flyers)), s, max_gap_days)


def evaluate_deals(deals: DataFrame, history: DataFrame, max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    """Evaluate a table of star rows against a (larger) table of star rows.

    The slim history is written once to the checkpoint folder, because every scope reads it.
    """
    t = with_lookup_keys(deals.withColumns({
        "day": F.coalesce(day_of(F.col("valid_from")), F.lit(FAR_DAY).cast("date")),
        "deal_unit_price": unit_price_of(),
    }))
    hist = cut_lineage(slim_history(history))
    asked = cut_lineage(t.select(*LOOKUP).distinct())
    points = dynamic_point_value(deals)
    t = with_category_benchmark(t, hist, asked)
    t = with_past(t, hist, asked, max_gap_days)
    t = t.join(points, "flyer_id", "left").withColumn(
        "point_value", F.coalesce("flyer_point_value", loyalty(F.col("merchant"), F.lit(""))["point_value"]))
    return classify(t, max_gap_days)


def classify(t: DataFrame, max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    """Turn deals with benchmark, past and point value into evaluations."""
    c = F.col
    promo = promo_of([F.coalesce(blank(c("promo_detail")), c("raw_title")), c("raw_title"), c("canonical_name")],
                     merchant=c("merchant"), point_value=c("point_value"))
    t = t.withColumn("promo", promo)
    p, h, pv, price = c("promo"), c("past"), c("point_value"), c("advertised_price")
    takes_text = p["promo_type"].isin("points_redemption", "points_bonus", "spend_save", "percent_off")
    t = t.withColumns({
        "promo_kind": F.coalesce(p["promo_type"], blank(c("promo_type")), F.lit("standard")),
        "promo_text": F.when(p.isNotNull() & (blank(c("promo_detail")).isNull() | takes_text), p["promo_detail"])
        .otherwise(c("promo_detail")),
        "qty": F.coalesce(p["qualifying_qty"], truthy(c("qualifying_qty")), F.lit(1)),
        "base": F.coalesce(truthy(c("base_price")), c("last_shelf_price")),
        "loyal": loyalty(c("merchant"), F.coalesce(blank(c("raw_title")), c("promo_detail"))),
        "deal_unit": c("deal_unit_price"),
    })
    kind, detail, base, up = c("promo_kind"), c("promo_text"), c("base"), c("deal_unit")

    # points redemption
    pts = F.coalesce(p["points_cost"], F.lit(0))
    saved = F.coalesce(truthy(p["points_saved_val"]), truthy(base), price)
    per_point = F.when(pts > 0, truthy(saved) / truthy(pts))
    freebie = (pts <= 10) | F.coalesce(per_point >= 0.10, F.lit(False))
    high = F.coalesce((per_point >= pv * 1.3) & (per_point >= 0.03), F.lit(False))
    points_badge = F.when(freebie, "POINTS_FREEBIE").when(high, "POINTS_DEAL").otherwise("POINTS_REDEMPTION")
    points_price = F.when(freebie, 0.0).when(pts > 0, exact_round(pts * 0.01, 2)).otherwise(F.coalesce(saved, F.lit(0.0)))

    # points bonus
    bonus = F.coalesce(p["points_bonus"], F.lit(0))
    spend = p["spend_threshold"]
    reward = F.coalesce(truthy(p["est_reward_val"]), bonus * pv)
    bonus_net = F.coalesce(truthy(p["est_net_price"]), exact_round(truthy(spend) - reward, 2))
    bonus_net = F.coalesce(bonus_net, F.when(truthy(spend).isNotNull(), p["est_net_price"]))

    # spend and save, percent off
    save_amt, spend_amt = F.coalesce(p["coupon_discount"], F.lit(0.0)), F.coalesce(spend, F.lit(0.0))
    share = F.when((spend_amt > 0) & (save_amt > 0), save_amt / F.nullif(spend_amt, F.lit(0.0))).otherwise(0.0)
    saver = F.when(price > 0, F.greatest(F.lit(0.0), exact_round(price * (1.0 - share) + 1e-9, 2)))
    off = F.coalesce(p["discount_pct"], F.lit(0.0))
    pct_price = F.when(base > 0, exact_round(base * (1.0 - off / 100.0), 2))

    lane = (
        F.when((kind == "points_redemption") & p.isNotNull(), "redeem")
        .when((kind == "points_bonus") & p.isNotNull()
              & ~(F.coalesce(truthy(p["points_multiplier"]).isNotNull() & (price > 0), F.lit(False))), "bonus")
        .when(kind.isin("basket_coupon", "store_coupon"), "coupon")
        .when((kind == "spend_save") & p.isNotNull(), "spend")
        .when((kind == "percent_off") & p.isNotNull(), "percent")
        .when(price.isNull(), "unpriced")
        .when(h.isNull(), "first")
        .otherwise("history")
    )
    t = t.withColumns({
        "lane": lane,
        "lane_price": F.when(lane == "redeem", points_price)
        .when(lane == "bonus", F.coalesce(bonus_net, price))
        .when(lane == "spend", saver)
        .when(lane == "percent", pct_price)
        .when(lane.isin("first", "history"), price),
        "lane_badge": F.when(lane == "redeem", points_badge)
        .when(lane == "bonus", "POINTS_REWARD").when(lane == "coupon", "STORE_COUPON")
        .when(lane == "spend", "SPEND_SAVE").when(lane == "percent", "PERCENT_OFF").when(lane == "unpriced", "SEE_AD")
        .when(lane == "first", F.coalesce(
            F.when(c("cat_min").isNotNull() & up.isNotNull(), first_seen_badge(up, c("cat_min"), c("cat_avg"))),
            F.lit("FIRST_SEEN")))
        .otherwise(historical_badge(price, h, c("day"), is_placeholder(c("canonical_name")), max_gap_days)),
        "saved": saved, "per_point": per_point, "reward": reward, "net": bonus_net,
        "vs_avg": F.when(lane == "history", F.when(
            h["b_avg"] > 0, (price - h["b_avg"]) / F.nullif(h["b_avg"], F.lit(0.0)) * 100.0).otherwise(0.0)),
    })
    ln, now = c("lane"), c("lane_price")
    size, coupon = c("unit_size"), c("lane") == "coupon"
    unit_price = (
        F.when(ln == "redeem", F.when(c("lane_badge") == "POINTS_FREEBIE", 0.0).otherwise(unit_cost(now, size)))
        .when(ln == "spend", F.when(now.isNotNull(), F.coalesce(unit_cost(now, size), up)))
        .when(ln == "percent", unit_cost(truthy(now), truthy(size)))
        .when(~coupon, up)
    )
    seen = F.when(ln == "history", exact_round(h["h_min"], 2)).otherwise(now)
    return t.select(
        "deal_id", "flyer_id", "product_id", "canonical_name", "brand",
        now.alias("current_price"),
        unit_price.alias("unit_price"),
        "page_number", "is_front_page",
        seen.alias("historical_min"),
        F.when(ln == "history", exact_round(h["b_avg"], 2)).otherwise(now).alias("historical_avg"),
        F.when(ln == "history", exact_round(h["h_max"], 2)).otherwise(now).alias("historical_max"),
        F.when(ln == "first", F.lit(0)).otherwise(F.coalesce(h["n_past"], F.lit(0))).cast("bigint").alias(
            "past_observations_count"),
        F.when(ln == "history", exact_round(c("vs_avg"), 1)).when(ln != "unpriced", 0.0).alias("diff_pct_vs_avg"),
        c("lane_badge").alias("badge"),
        summary_reason().alias("summary_reason"),
        F.when(~coupon, size).alias("unit_size"),
        F.when(~coupon, c("unit_type")).alias("unit_type"),
        F.when(~coupon, c("category")).alias("category"),
        F.when(~coupon, exact_round(c("cat_min"), 4)).alias("category_min_unit_price"),
        F.when(~coupon, exact_round(c("cat_avg"), 4)).alias("category_avg_unit_price"),
        c("promo_kind").alias("promo_type"), c("promo_text").alias("promo_detail"), c("qty").alias("qualifying_qty"),
        F.when(ln == "spend", price).otherwise(base).alias("base_price"),
        "raw_deal_id", ad_id(c("raw_deal_id")).alias("ad_id"), "ad_title", "raw_title", "image_url",
        F.col("merchant"), day10(c("valid_from")).alias("valid_from"), c("coupon_discount"),
    ).withColumn("is_category_best", is_category_best(c("category"), c("unit_price"), c("category_min_unit_price")))


def summary_reason() -> Column:
    """One-line explanation of the badge."""
    c = F.col
    p, h, pv, price, up = c("promo"), c("past"), c("point_value"), c("advertised_price"), c("deal_unit")
    kind, detail, base, badge = c("promo_kind"), c("promo_text"), c("base"), c("lane_badge")
    label, cat, unit = c("loyal.point_name"), c("category"), c("unit_type")
    mult = p["points_multiplier"].cast("int").cast("string")
    back = fixed(p["points_multiplier"].cast("int") * pv * 100.0, 1)

    def tag(default: Column | str) -> Column:
        return _say(" • [", F.coalesce(blank(detail), default if isinstance(default, Column) else F.lit(default)), "]")

    base_tag = F.coalesce(_say(" (Base ", money(truthy(base)), ")"), F.lit(""))
    promo_note = (
        F.when(kind == "bogo", _say(" • [", F.coalesce(blank(detail), F.lit("BOGO Free")), base_tag, "]"))
        .when(kind == "must_buy", tag(_say("Must Buy ", c("qty").cast("string"))))
        .when(kind == "digital_coupon", tag("Digital Coupon"))
        .when(kind == "points_redemption", tag("Buy with Points"))
        .when(kind == "points_bonus", F.coalesce(
            _say(" • 🪙 Earn ", mult, "X ", label, " (~", back, "% back)"), tag("Points Reward")))
        .when(kind == "spend_save", tag("Spend & Save"))
        .when(kind == "percent_off", tag("Percent Off"))
        .when(kind == "meal_deal", tag("Weekly Meal Deal"))
        .otherwise("")
    )
    lo, avg = c("cat_min"), c("cat_avg")
    dev = _pct_of(up, avg)
    cat_note = F.coalesce(
        F.when(up <= lo + NEAR, _say(" • 🏆 Best ", cat, " price/", unit, " across all brands"))
        .when(up <= avg * 0.85, _say(" • 🔥 ", F.abs(dev).cast("string"), "% below ", cat, " category avg"))
        .when(up > avg * 1.15, _say(" • ⚠️ Above ", cat, " category avg (+", dev.cast("string"), "%)")),
        F.lit(""))
    notes = F.concat(promo_note, cat_note)
    per_unit = _say(money(up), "/", unit)
    first = F.when(
        lo.isNotNull() & up.isNotNull(),
        F.when(badge == "NEW_ALL_TIME_LOW", _say("🌟 Best ", cat, " price! ", per_unit, " (lowest across all brands)"))
        .when(badge == "BEAT_AVERAGE", _say("🔥 Great value! ", F.abs(dev).cast("string"), "% below ", cat,
                                            " category avg of ", money(avg), "/", unit))
        .when(badge == "STANDARD_DEAL", _say("Standard deal within normal range for ", cat, " (", per_unit, " vs ",
                                             money(avg), " avg)"))
        .otherwise(_say("First time tracked in circular database (", cat, " avg: ", money(avg), "/", unit, ", +",
                        dev.cast("string"), "%)")),
    )
    first = F.coalesce(F.concat(first, promo_note), F.concat(F.lit("First time tracked in circular database"), notes))

    goes_on = F.abs(price - h["last_price"]) < NEAR
    gap = F.datediff(c("day"), h["last_end"])
    goes_on = goes_on & (gap >= 0) & (gap <= MAX_GAP_DAYS)
    low, b_min, b_max, b_avg = (money(h[x]) for x in ("h_min", "b_min", "b_max", "b_avg"))
    dev_avg = fixed(c("vs_avg"), 1)
    history = (
        F.when(is_placeholder(c("canonical_name")), _say("Unbranded/assorted circular promo (", money(price), ")"))
        .when(goes_on & (badge == "MATCHES_ATL"), _say("🌟 Multi-week sale at All-Time Low (", low, ")"))
        .when(goes_on, _say("🔄 Ongoing multi-week promotion (", money(price), ")"))
        .when(badge == "NEW_ALL_TIME_LOW", _say(
            "🌟 New All-Time Low! ", fixed(F.abs((price - h["h_min"]) / truthy(h["h_min"]) * 100.0), 1),
            "% below past low of ", low))
        .when(badge == "MATCHES_ATL", _say("🌟 Matches All-Time Low (", low, ")"))
        .when((badge == "CYCLE_REFRESH") & (F.abs(price - h["h_min"]) <= NEAR),
              _say("🔄 Standard promo cycle (typical: ", low, ")"))
        .when(badge == "BEAT_AVERAGE", _say("🔥 ", fixed(F.abs(c("vs_avg")), 1), "% below historical average of ", b_avg))
        .when(badge == "CYCLE_REFRESH", F.when(
            F.abs(h["b_min"] - h["b_max"]) < 0.01, _say("🔄 Standard promo cycle (typical: ", b_min, ")")).otherwise(
            _say("🔄 Standard promo cycle (typical: ", b_min, " - ", b_avg, ")")))
        .when(badge == "PRICE_HIKE", _say("⚠️ Higher than typical promo average (+", dev_avg, "% vs avg ", b_avg, ")"))
        .otherwise(_say("Past sale range: ", b_min, " - ", b_max, " (avg ", b_avg, ")"))
    )
    pts = F.coalesce(p["points_cost"], F.lit(0))
    pts_s, rate = pts.cast("string"), fixed(c("per_point") * 100.0, 1)
    worth = (truthy(c("saved")).isNotNull()) & (pts > 0)
    redeem = (
        F.when(badge == "POINTS_FREEBIE", _say("🪙 FREE with ", pts_s, " ", label, F.when(
            worth, _say(" (Save ", money(c("saved")), " • ", rate, "¢/pt)")).otherwise("")))
        .when(badge == "POINTS_DEAL", _say("🪙 High-Yield Points Deal: ", pts_s, " ", label, " for ", money(c("saved")),
                                           " value (", rate, "¢/pt vs ", fixed(pv * 100.0, 1), "¢ avg)"))
        .otherwise(_say("🪙 Points Redemption: ", pts_s, " ", label, F.when(
            worth, _say(" for ", money(c("saved")), " value (", rate, "¢/pt)")).otherwise("")))
    )
    bonus_pts = F.coalesce(p["points_bonus"], F.lit(0)).cast("string")
    cents = fixed(pv * 100.0, 2)
    bonus = F.coalesce(
        _say("🪙 Earn ", mult, "X ", label, " (~", back, "% back in ", c("loyal.reward_label"), " @ ", cents,
             "¢/pt) [Est. with Points Reward]"),
        _say("🪙 Est. Net ", money(truthy(c("net"))), " after ~", money(c("reward")), " in ", label, " reward ($",
             fixed(truthy(p["spend_threshold"]), 0), " spend, ", bonus_pts, " pts @ ", cents,
             "¢/pt) [Est. with Points Reward]"),
        _say("🪙 ", bonus_pts, " ", label, " (~", money(c("reward")), " reward value @ ", cents,
             "¢/pt) [Est. with Points Reward]"),
    )
    save_amt, spend_amt = F.coalesce(p["coupon_discount"], F.lit(0.0)), F.coalesce(p["spend_threshold"], F.lit(0.0))
    share = F.coalesce((save_amt / truthy(spend_amt) * 100.0).cast("int"), F.lit(0)).cast("string")
    off = F.coalesce(p["discount_pct"], F.lit(0.0)).cast("int").cast("string")
    ln = c("lane")
    return (
        F.when(ln == "redeem", redeem)
        .when(ln == "bonus", bonus)
        .when(ln == "coupon", _say("🎟️ ", F.coalesce(blank(detail), F.lit("Store Digital Coupon"))))
        .when(ln == "spend", _say("🏷️ Save ", money(save_amt), " when you spend ", money(spend_amt), " (", share,
                                  "% off participating items)"))
        .when(ln == "percent", F.coalesce(
            _say("🏷️ ", off, "% Off regular ", money(truthy(base)), " -> Net ", money(truthy(c("lane_price")))),
            _say("🏷️ ", off, "% Off")))
        .when(ln == "unpriced", F.coalesce(
            _say("Promo: ", blank(detail), " (needs shelf price to compute unit cost)"),
            F.lit("Price not listed numerically in circular")))
        .when(ln == "first", first)
        .otherwise(F.concat(history, notes))
    )
