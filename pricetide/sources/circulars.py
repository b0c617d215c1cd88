"""Circular sources: listings, page/item payloads, item details, grid batches, pre-structured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide import schemas as S
from pricetide import vocab as V
from pricetide.functions.core import blank, cap, escape, hit, lookup, num, text, truthy, unit_cost
from pricetide.functions.promo import effective_price, promo_of
from pricetide.functions.text import clean_sales_notes, infer_category, infer_department, normalize_text, unit_info


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# ------------------------------------------------------------------ listings
def flyer_listing(raw: DataFrame, merchant: str | None = None, postal_code: str = "") -> DataFrame:
    """Circulars of a listing document with their defaults, optionally one merchant's."""
    f = raw.select(F.explode("flyers").alias("f")).select("f.*")
    out = f.select(
        F.col("id").alias("flyer_id"), text(F.col("merchant")).alias("merchant"),
        F.coalesce("merchant_id", F.lit(0)).alias("merchant_id"), F.coalesce("name", F.lit("Weekly Ad")).alias("name"),
        F.coalesce("postal_code", F.lit(postal_code)).alias("postal_code"),
        text(F.col("valid_from")).alias("valid_from"), text(F.col("valid_to")).alias("valid_to"),
        "available_from", "available_to", F.coalesce("width", F.lit(0.0)).alias("width"),
        F.coalesce("height", F.lit(0.0)).alias("height"), "thumbnail_url")
    return out.filter(F.contains(F.lower("merchant"), F.lit(merchant.lower()))) if merchant else out


def weekly_ad(raw: DataFrame, merchant: str | None = None) -> DataFrame:
    """The circular to ingest from each listing document: the first named 'weekly', else the first."""
    listed = raw.withColumn("doc", F.monotonically_increasing_id()).select("doc", F.posexplode("flyers").alias("pos", "f"))
    if merchant:
        listed = listed.filter(F.contains(F.lower(text(F.col("f.merchant"))), F.lit(merchant.lower())))
    plain = ~F.contains(F.lower(F.coalesce("f.name", F.lit("Weekly Ad"))), F.lit("weekly"))
    return listed.groupBy("doc").agg(F.min_by("f", F.struct(plain, "pos")).alias("f")).select("f.*")


# ------------------------------------------------------------------ pages and items
def pages_of(raw: DataFrame) -> DataFrame:
    p = raw.select("flyer_id", F.explode("pages").alias("p"))
    n = F.coalesce("p.page", F.lit(1))
    return p.select("flyer_id", F.coalesce("p.id", F.lit(0)).alias("page_id"), n.alias("page_number"),
                    F.coalesce("p.name", F.concat(F.lit("Page "), n.cast("string"))).alias("name"),
                    *(F.coalesce(f"p.{c}", F.lit(0.0)).alias(c) for c in ("left", "right", "top", "bottom")))


def items_of(raw: DataFrame) -> DataFrame:
    """Items in payload order with tolerant prices (text that is no number reads as missing)."""
    i = raw.select("flyer_id", F.posexplode("items").alias("pos", "i"))
    return i.select(
        "flyer_id", "pos", F.coalesce("i.id", F.lit(0)).alias("item_id"), F.trim(text(F.col("i.name"))).alias("name"),
        num(F.coalesce("i.price", "i.current_price")).alias("price"), num(F.col("i.original_price")).alias("original_price"),
        F.coalesce(num(F.col("i.price")), num(F.col("i.current_price"))).isNotNull().alias("is_priced"),
        *(F.col(f"i.{c}").alias(c) for c in (
            "pre_price_text", "post_price_text", "description", "brand", "valid_from", "valid_to", "cutout_image_url",
            "clean_image_url")),
        F.coalesce("i.left", F.lit(0.0)).alias("left"), F.coalesce("i.right", F.lit(0.0)).alias("right"),
        F.coalesce("i.top", F.lit(0.0)).alias("top"), F.coalesce("i.bottom", F.lit(0.0)).alias("bottom"))


def center_x() -> Column:
    """Horizontal centre of an item; its left edge when either edge is zero."""
    both = (F.col("left") != 0) & (F.col("right") != 0)
    return F.when(both, (F.col("left") + F.col("right")) / 2.0).otherwise(F.col("left"))


def assign_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Page whose horizontal span contains the item's centre (lowest page number), else page 1.

    The few pages of a circular travel as one sorted array per circular, so items are only joined by
    circular and the range search happens inside the row.
    """
    spans = pages.groupBy("flyer_id").agg(F.array_sort(F.collect_list(F.struct(
        "page_number", "left", "right"))).alias("spans"))
    x = center_x()
    inside = F.filter("spans", lambda s: (s["left"] <= x) & (x <= s["right"]))
    page = F.coalesce(F.get(inside, F.lit(0))["page_number"], F.lit(1))
    return items.join(spans, "flyer_id", "left").withColumn("page_number", page).drop("spans")


def _word_in(col: Column, words: list[str]) -> Column:
    return hit(col, "|".join(escape(w) for w in words))


def detect_front_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Front page of each circular: its first page that is a weekly, priced, fresh-food page; else page 1."""
    c = F.col
    start, end = (F.try_to_date(F.substring(c(x), 1, 10)) for x in ("valid_from", "valid_to"))
    span = F.datediff(end, start)
    fresh = _word_in(c("name"), V.FRESH_ANCHOR_WORDS) & ~_word_in(c("name"), ["fried"])
    per_page = items.groupBy("flyer_id", "page_number").agg(
        F.count("*").alias("n"), F.count_if(span.isNotNull()).alias("dated"), F.count_if(span <= 21).alias("weekly"),
        F.count_if("is_priced").alias("priced"), F.count_if(_word_in(c("name"), V.THEMATIC_WORDS)).alias("themed"),
        F.count_if(fresh).alias("fresh"))
    insert = (c("dated") > 0) & (c("weekly") == 0)
    splash = (c("n") >= 4) & ((c("priced") < 2) | (c("priced") / c("n") <= 0.25))
    themed = (c("n") >= 4) & ((c("fresh") == 0) | ((c("themed") >= 3) & (c("fresh") < 3))
                              | ((c("fresh") < 2) & (c("themed") / c("n") >= 0.25)))
    known = pages.select("flyer_id", "page_number").distinct()
    ok = per_page.join(known, ["flyer_id", "page_number"], "left_semi").filter(~insert & ~splash & ~themed)
    best = ok.groupBy("flyer_id").agg(F.min("page_number").alias("front_page"))
    return items.select("flyer_id").distinct().join(best, "flyer_id", "left").select(
        "flyer_id", F.coalesce("front_page", F.lit(1)).alias("front_page"))


def hydrate(items: DataFrame, details: DataFrame) -> DataFrame:
    """Fill blank item fields from the detail documents of items without a description."""
    d = details.select("item.*").groupBy(F.col("id").alias("item_id")).agg(
        F.first(F.struct("description", "pre_price_text", "sale_story", "post_price_text", "brand", "clean_image_url"),
                ignorenulls=True).alias("d"))
    open_ = blank(F.col("description")).isNull()

    def fill(col: str, *others: str) -> Column:
        return F.when(open_, F.coalesce(blank(F.col(col)), *(blank(F.col(f"d.{o}")) for o in others), F.col(col))).otherwise(
            F.col(col))

    return items.join(d, "item_id", "left").withColumns({
        "pre_price_text": fill("pre_price_text", "pre_price_text", "sale_story"),
        "post_price_text": fill("post_price_text", "post_price_text"), "brand": fill("brand", "brand"),
        "clean_image_url": fill("clean_image_url", "clean_image_url"), "description": fill("description", "description"),
    }).drop("d").select(*items.columns)


def flyer_items(raw: DataFrame, details: DataFrame | None = None, front_page_only: bool = False,
                front_page_number: int | None = None) -> DataFrame:
    """Payload documents -> items on their pages, front page marked, optionally hydrated."""
    pages = pages_of(raw)
    placed = assign_pages(items_of(raw), pages)
    if front_page_number is None:
        front = detect_front_pages(placed, pages)
        placed = placed.join(front, "flyer_id").withColumn("is_front_page", F.col("page_number") == F.col("front_page")).drop(
            "front_page")
    else:
        placed = placed.withColumn("is_front_page", F.col("page_number") == front_page_number)
    if front_page_only:
        placed = placed.filter("is_front_page")
    return hydrate(placed, details) if details is not None else placed


# ------------------------------------------------------------------ grid batches
def grid_ads(batches: DataFrame) -> DataFrame:
    """Ads of a run merged over its batches; the last delivery of an id and the last header values win."""
    def latest(col: str) -> Column:
        return F.max_by(col, F.when(blank(F.col(col)).isNotNull(), F.col("batch_no")))

    head = batches.groupBy("run_id").agg(*(latest(c).alias(c) for c in (
        "adsStartDate", "adsEndDate", "flyerRunId", "thumbnailImageUrl")))
    ads = batches.select("run_id", "batch_no", F.posexplode("ads").alias("pos", "ad")).filter(truthy(F.col("ad.id")).isNotNull())
    order = F.struct("batch_no", "pos")
    one = ads.groupBy("run_id", F.col("ad.id").alias("ad_id")).agg(F.max_by("ad", order).alias("ad"),
                                                                F.min(order).alias("first_seen"))
    return one.join(head, "run_id").select(
        "run_id", F.col("flyerRunId").try_cast("bigint").alias("flyer_id"),
        F.concat(F.substring("adsStartDate", 1, 10), F.lit("T00:00:00-04:00")).alias("valid_from"),
        F.concat(F.substring("adsEndDate", 1, 10), F.lit("T23:59:59-04:00")).alias("valid_to"),
        "ad_id", F.trim(text(F.col("ad.name"))).alias("name"), F.trim(text(F.col("ad.description"))).alias("description"),
        F.trim(text(F.col("ad.salesText"))).alias("sales_text"), num(blank(F.col("ad.price"))).alias("price"),
        F.col("ad.brand").alias("brand"), F.get("ad.categories", F.lit(0))["name"].alias("category_name"),
        F.coalesce("ad.images.medium", "ad.images.small").alias("image_url"), F.col("ad.circularId").alias("circular_id"),
        "first_seen")


def needs_detail(ads: DataFrame, everything: bool = False) -> DataFrame:
    """Tiles worth a product-level lookup: unpriced, buy-x-get-y and discount offers, and multi-variety titles."""
    ok = truthy(F.col("ad_id")).isNotNull() & blank(F.col("circular_id")).isNotNull()
    if everything:
        return ads.filter(ok)
    p = promo_of([F.col("sales_text"), F.col("name"), F.col("description")], price=F.col("price"))
    many = hit(F.concat_ws(" ", "name", "description"), r"\b(?:or|varieties|select|assorted|mix\s*&\s*match)\b")
    picked = F.coalesce(p["promo_type"].isin("must_buy", "bogo", "percent_off", "dollar_off"), F.lit(False))
    return ads.filter(ok & (F.col("price").isNull() | many | picked))


def lookup_pages(ads: DataFrame, page_names: DataFrame) -> DataFrame:
    """Page of each ad from a (name, page_number, is_front_page) table.

    Exact name first; then the first listed name longer than 12 characters contained in the ad name or the
    other way round; then the department's usual page.  Containment is found through shared 13-character
    windows of the two names, an equi-join, instead of comparing all pairs.
    """
    names = page_names.select(F.lower(F.trim("name")).alias("key"), "page_number", "is_front_page", "pos").filter(
        blank(F.col("key")).isNotNull())
    names = names.groupBy("key").agg(F.max_by(F.struct("page_number", "is_front_page"), "pos").alias("hit"),
                                     F.min("pos").alias("pos"))
    a = ads.withColumn("key", F.lower("name"))
    exact = a.join(names.select("key", F.col("hit").alias("exact")), "key", "left")
    open_ = exact.filter(F.col("exact").isNull() & (F.length("key") > 0)).select("key").distinct()

    def windows(col: str) -> Column:
        n = F.length(F.col(col))
        return F.explode(F.when(n >= 13, F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(n - 12, F.lit(1))), lambda i: F.substring(F.col(col), i, F.lit(13))))).otherwise(
            F.array().cast("array<string>")))

    left = open_.select("key", windows("key").alias("w"))
    right = names.select(F.col("key").alias("other"), "hit", "pos", windows("key").alias("w"))
    near = left.join(right, "w").filter(F.contains("key", "other") | F.contains("other", "key")).groupBy("key").agg(
        F.min_by("hit", "pos").alias("near"))
    # names of at most 12 characters never match by containment in either direction
    tag = F.lower(F.concat_ws(" ", "name", "description", text(F.col("category_name"))))
    page = lookup(infer_department(tag), V.DEPARTMENT_PAGES, F.lit(V.DEFAULT_PAGE))
    best = F.coalesce("exact", "near")
    return exact.join(near, "key", "left").withColumns({
        "page_number": F.coalesce(best["page_number"], page),
        "is_front_page": F.coalesce(best["is_front_page"], F.lit(False))}).drop("key", "exact", "near")


def grid_products(ads: DataFrame, products: DataFrame) -> DataFrame:
    """One deal per product listed under an ad, priced by the promotion ladder."""
    c = F.col
    parent = normalize_text(c("name"))
    p = products.select("ad_id", F.posexplode("products").alias("p_idx", "p"))
    rows = ads.join(p, "ad_id").withColumns({
        "promo": promo_of([c("sales_text"), c("name"), c("description")], price=c("price")),
        "product": normalize_text(F.trim(F.coalesce(blank(c("p.name")), c("name")))),
        "ad_clean": F.coalesce(blank(clean_sales_notes(parent)), parent),
        "regular": F.coalesce(truthy(c("p.regularPrice")), c("p.price"), F.lit(0.0)),
        "u": unit_info(text(c("p.size"))),
    })
    rows = rows.withColumn("product", F.coalesce(blank(clean_sales_notes(c("product"))), c("product")))
    own = F.when(truthy(c("p.price")).isNotNull() & (c("p.price") != c("regular")), c("p.price"))
    price = F.coalesce(effective_price(c("promo"), c("regular")), c("price"), own, F.when(c("regular") > 0, c("regular")))
    return rows.withColumn("eff", price).select(
        F.concat(c("ad_id").cast("string"), c("p_idx").cast("string")).cast("bigint").alias("raw_deal_id"), "flyer_id",
        "page_number", "is_front_page", c("product").alias("canonical_name"), c("p.brand").alias("brand"),
        c("eff").alias("advertised_price"), c("u.size").alias("unit_size"), c("u.unit").alias("unit_type"),
        unit_cost(truthy(c("eff")), c("u.size")).alias("unit_price"),
        F.concat_ws(" - ", c("product"), c("sales_text")).alias("raw_title"),
        F.coalesce("p.image.large", "image_url").alias("image_url"),
        F.coalesce("promo.promo_type", F.lit("standard")).alias("promo_type"), F.lit(True).alias("is_trusted"),
        F.lit(V.SOURCE_GRID).alias("source_type"),
        F.coalesce(infer_category(c("ad_clean")), c("category_name"), infer_category(c("product")),
                   c("p.rootCatName")).alias("category"),
        F.coalesce("promo.promo_detail", "sales_text").alias("promo_detail"),
        F.coalesce("promo.qualifying_qty", F.lit(1)).alias("qualifying_qty"),
        F.when(c("regular") > 0, c("regular")).alias("base_price"), F.lit(None).cast("double").alias("coupon_discount"),
        c("ad_clean").alias("ad_title"))


def grid_items(ads: DataFrame, products: DataFrame) -> DataFrame:
    """Ads without product details as items for title splitting, with the price the ad text implies."""
    c = F.col
    bare = ads.join(products.filter(F.size("products") > 0).select("ad_id").distinct(), "ad_id", "left_anti")
    bare = bare.withColumn("promo", promo_of([c("sales_text"), c("name"), c("description")], price=c("price")))
    stated = num(cap(c("sales_text"), r"\$(\d+(?:\.\d{2})?)"))
    price = F.coalesce(effective_price(c("promo"), c("price")), c("price"), stated)
    none = F.lit(None).cast("string")
    return bare.select(
        "flyer_id", c("ad_id").alias("item_id"), normalize_text(c("name")).alias("name"), price.alias("price"),
        F.lit(None).cast("double").alias("original_price"), c("sales_text").alias("pre_price_text"),
        c("description").alias("post_price_text"), "description", "brand", "page_number", "is_front_page",
        c("image_url").alias("cutout_image_url"), c("image_url").alias("clean_image_url"), none.alias("valid_from"),
        "category_name")


# ------------------------------------------------------------------ pre-structured pages
def prepared_deals(raw: DataFrame, trusted: bool = False, source: str = V.SOURCE_PREPARED) -> DataFrame:
    """Deals of already structured pages; ids are ``flyer_id * 1000 + ordinal`` in page and item order.

    The ordinal comes from per-page item counts, not from sorting a circular in one place.
    """
    before = F.expr("aggregate(transform(slice(pages_items, 1, pno), x -> size(x.items)), 0, (a, n) -> a + n)")
    page = raw.select("flyer_id", "pages_items", F.posexplode("pages_items").alias("pno", "p")).withColumn("before", before)
    rows = page.select("flyer_id", "before", F.coalesce("p.page_number", F.lit(1)).alias("page_number"),
                       F.col("p.is_front_page").alias("front"), F.posexplode("p.items").alias("ino", "i"))
    c = F.col
    priced = truthy(c("i.price"))
    return rows.select(
        (c("flyer_id") * 1000 + c("before") + c("ino") + 1).alias("raw_deal_id"), "flyer_id", "page_number",
        F.coalesce("front", c("page_number") == 1).alias("is_front_page"), F.trim("i.name").alias("canonical_name"),
        c("i.brand").alias("brand"), c("i.price").alias("advertised_price"), c("i.unit_size").alias("unit_size"),
        c("i.unit_type").alias("unit_type"), unit_cost(priced, c("i.unit_size")).alias("unit_price"),
        c("i.name").alias("raw_title"), c("i.image_url").alias("image_url"),
        F.coalesce("i.promo_type", F.when(priced.isNotNull(), "member_card").otherwise("standard")).alias("promo_type"),
        F.lit(trusted).alias("is_trusted"), F.lit(source).alias("source_type"), F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("promo_detail"), F.lit(1).alias("qualifying_qty"),
        F.lit(None).cast("double").alias("base_price"), F.lit(None).cast("double").alias("coupon_discount"),
        F.lit(None).cast("string").alias("ad_title"))


# ------------------------------------------------------------------ stores
def store_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.STORE_PRESETS, "alias string, postal_code string, merchant string, label string")


def store_alias(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(col)), "[- ]", "_")


def resolve_stores(requests: DataFrame, spark: SparkSession) -> DataFrame:
    """Merchant of each (store, merchant, configured) request: preset, merchant alias, merchant, setting, default."""
    presets = [(a, m) for a, _, m, _ in V.STORE_PRESETS]
    default = dict(presets)[V.DEFAULT_STORE]
    c = F.col
    return requests.withColumn("resolved", F.coalesce(
        lookup(store_alias(text(c("store"))), presets), lookup(store_alias(text(c("merchant"))), presets),
        blank(c("merchant")), blank(c("configured")), F.lit(default)))


def parse_store_list(df: DataFrame, col: str) -> DataFrame:
    """'zip:merchant, zip:merchant' -> one row per store."""
    part = df.select("*", F.explode(F.split(col, ",")).alias("part")).filter(F.trim("part") != "")
    bits = F.split("part", ":", 2)
    return part.withColumns({"postal_code": F.trim(bits[0]), "store_merchant": F.trim(text(F.get(bits, F.lit(1))))}).drop("part")
