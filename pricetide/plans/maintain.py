"""Table maintenance: keyed merges, trust and doorbuster marks, purges, re-syncs and price enrichment.

Plain file tables have no in-place update, so every operation is a function ``old tables -> new tables``;
``swap_table`` writes a result next to the live table and renames it, because a job must not overwrite the
files it still reads.  Surrogate keys are hashes of natural keys and therefore stable across runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide import vocab as V
from pricetide.functions.core import blank, cut_lineage, day10, let, like_ci, only_some, truthy, unit_cost
from pricetide.functions.promo import PROMO_TYPE, effective_price, promo_of
from pricetide.functions.text import is_placeholder, search_term
from pricetide.operators.history import Catalog, star

OBS_KEY = ["flyer_id", "product_id", "raw_deal_id"]


def hash_id(*cols: str) -> Column:
    return F.xxhash64(*(F.col(c) for c in cols))


def merge_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; everything else is kept."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def last_per_key(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Latest row of every key; map-side combined, so re-deliveries of one key cost one row per task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*rows.columns)


# ------------------------------------------------------------------ circulars and products
def upsert_flyers(flyers: DataFrame, new: DataFrame, trusted: bool = True, source: str = V.SOURCE_API) -> DataFrame:
    """Known circulars get new dates, trust and source but keep name, merchant and postal code."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    fresh = new.select("flyer_id", "postal_code", "merchant", "name", "valid_from", "valid_to").withColumns({
        "is_trusted": F.lit(trusted), "source_type": F.lit(source), "scraped_at": stamp})
    kept = flyers.select("flyer_id", *(F.col(c).alias("old_" + c) for c in ("postal_code", "merchant", "name")),
                         F.lit(True).alias("known"))
    merged = fresh.join(kept, "flyer_id", "left")
    for c in ("postal_code", "merchant", "name"):
        merged = merged.withColumn(c, F.when(F.col("known"), F.col("old_" + c)).otherwise(F.col(c))).drop("old_" + c)
    return merge_rows(flyers, merged.drop("known"), ["flyer_id"])


def upsert_products(products: DataFrame, deals: DataFrame, order: Column) -> DataFrame:
    """One product per canonical name; later non-null attributes win, nulls never erase."""
    attrs = ["brand", "unit_size", "unit_type", "category"]
    seen = deals.groupBy("canonical_name").agg(
        *(F.max_by(a, F.when(F.col(a).isNotNull(), order)).alias("n_" + a) for a in attrs))
    both = products.join(seen, "canonical_name", "full_outer")
    out = both.withColumns({a: F.coalesce("n_" + a, a) for a in attrs}).drop(*("n_" + a for a in attrs))
    return out.withColumn("product_id", F.coalesce("product_id", hash_id("canonical_name"))).select(*products.columns)


def upsert_observations(obs: DataFrame, deals: DataFrame, products: DataFrame, order: Column) -> DataFrame:
    """Insert or replace by (circular, product, tile); the last delivery in the batch wins."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    recorded = F.coalesce(F.col("recorded_at"), stamp) if "recorded_at" in deals.columns else stamp
    ids = products.select("canonical_name", "product_id")
    rows = last_per_key(deals.withColumn("__ord", order).join(ids, "canonical_name"), OBS_KEY, F.col("__ord"))
    rows = rows.withColumns({"recorded_at": recorded, "deal_id": hash_id(*OBS_KEY)})
    return merge_rows(obs, rows.select(*(c for c in obs.columns)), OBS_KEY)


def prune_orphans(products: DataFrame, obs: DataFrame) -> DataFrame:
    return products.join(obs.select("product_id").distinct(), "product_id", "left_semi")


def orphan_products(products: DataFrame, obs: DataFrame) -> DataFrame:
    return products.join(obs.select("product_id").distinct(), "product_id", "left_anti")


def flyers_without_deals(flyers: DataFrame, obs: DataFrame) -> DataFrame:
    return flyers.join(obs.select("flyer_id").distinct(), "flyer_id", "left_anti")


def delete_flyers(c: Catalog, flyer_ids: DataFrame) -> Catalog:
    """Remove circulars with their observations, then products nothing refers to any more."""
    gone = flyer_ids.select("flyer_id").distinct()
    obs = c.observations.join(gone, "flyer_id", "left_anti")
    return Catalog(obs, prune_orphans(c.products, obs), c.flyers.join(gone, "flyer_id", "left_anti"))


def names_within(names: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (m, live_m) of a name of names (m) that holds a name of parts (live_m), by an equi-join of the substrings of lengths that parts have."""
    sizes, size = parts.agg(F.collect_set(F.length("live_m")).alias("sizes")), F.length("m")  # one row
    pieces = F.flatten(F.transform("sizes", lambda n: F.when(size >= n, F.transform(
        F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(F.col("m"), i, n))).otherwise(F.array())))
    found = names.select("m").distinct().crossJoin(F.broadcast(sizes)).select("m", F.explode(F.array_distinct(pieces)).alias("live_m"))
    return found.join(parts.select("live_m").distinct(), "live_m", "left_semi")


def superseded_flyers(flyers: DataFrame, live: DataFrame) -> DataFrame:
    """Untrusted circulars of a merchant that overlap a live circular of it (days inclusive); live has one row a circular.

    Days are compared as text, so a missing one is an empty text, before every other.  A live merchant may be a
    part of an old one's name: old names meet live ones through their substrings of lengths that live names have.

    No old circular meets a live one. A merchant's live circulars become an index by first day: the latest end of all that begin until
    then, and the latest of another circular (for one that is old and live itself). An old circular looks its last
    day up; what is found must not end before its first day. Index and questions have a row a merchant and day, whatever the number of circulars.
    """
    def span(prefix: str) -> list[Column]:
        return [F.coalesce(day10(F.col(f"valid_{end}")), F.lit("")).alias(f"{prefix}_{end}") for end in ("from", "to")]

    old = flyers.filter(~F.col("is_trusted")).select("flyer_id", F.lower("merchant").alias("m"), *span("o"))
    new = live.select(F.col("flyer_id").alias("live_id"), F.lower("merchant").alias("live_m"), *span("l")).distinct()
    sizes, size = new.agg(F.collect_set(F.length("live_m")).alias("sizes")), F.length("m")  # one row
    parts = F.flatten(F.transform("sizes", lambda n: F.when(size >= n, F.transform(
        F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(F.col("m"), i, n))).otherwise(F.array())))
    names = old.select("m").distinct().crossJoin(F.broadcast(sizes)).select("m",  F.explode(F.array_distinct(parts)).alias("live_m"))
    names = names.join(new.select("live_m").distinct(), "live_m", "left_semi")

    day = ["live_m", "l_from"]
    end = F.struct("l_to", "live_id")
    latest = new.groupBy(*day).agg(F.max(end).alias("a"))
    other = new.join(latest, day).filter(F.col("live_id") != F.col("a.live_id")).groupBy(*day).agg(F.max(end).alias("b"))
    by_day = Window.partitionBy("live_m").orderBy("l_from")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, 0)
    index = latest.join(other, day, "left").withColumn("first", F.max("a").over(so_far)).withColumn("before", F.lag("first").over(by_day))
    beaten = F.greatest("b", F.when(F.col("before").isNotNull(), F.least("a", "before")))
    index = index.withColumn("second", F.max(beaten).over(so_far)).select("live_m", F.col("l_from").alias("on"), F.lit(0).alias("asks"), "first", "second")

    old = old.join(names, "m")
    asked = old.select("live_m", F.col("o_to").alias("on")).distinct().select("live_m", "on", F.lit(1).alias("asks"), *(
        F.lit(None).cast(index.schema[c].dataType).alias(c) for c in ("first", "second")))
    known = Window.partitionBy("live_m").orderBy("on", "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = index.unionByName(asked).withColumns({c: F.last(c, ignorenulls=True).over(known) for c in ("first", "second")}).filter("asks = 1")
    hit = F.when(F.col("first.live_id") == F.col("flyer_id"), F.col("second.l_to")).otherwise(F.col("first.l_to")) >= F.col("o_from")
    return old.join(found.select("live_m", F.col("on").alias("o_to"), "first", "second"), ["live_m", "o_to"]).filter(hit).select("flyer_id").distinct()


def resync(c: Catalog, flyer: DataFrame, deals: DataFrame, order: Column) -> Catalog:
    """Idempotent re-ingestion of circulars: supersede overlaps, drop old rows, insert the new ones."""
    old = superseded_flyers(upsert_flyers(c.flyers, flyer), flyer)
    gone = cut_lineage(old.unionByName(flyer.select("flyer_id")).distinct())
    kept = delete_flyers(c, gone)
    products = cut_lineage(upsert_products(kept.products, deals, order))
    return Catalog(upsert_observations(kept.observations, deals, products, order), products,
                   upsert_flyers(kept.flyers, flyer))


# ------------------------------------------------------------------ marks
def set_trust(table: DataFrame, trusted: bool, flyer_ids: Sequence[int] | None = None,
              except_ids: Sequence[int] = (), source: str | None = None) -> DataFrame:
    """Set trust of some circulars, or of all but some; works on circulars and observations alike."""
    hit = F.col("flyer_id").isin(list(flyer_ids)) if flyer_ids is not None else (
        ~F.col("flyer_id").isin(list(except_ids)) if except_ids else F.lit(True))
    out = table.withColumn("is_trusted", F.when(hit, F.lit(trusted)).otherwise(F.col("is_trusted")))
    return out.withColumn("source_type", F.when(hit, F.lit(source)).otherwise(F.col("source_type"))) if source else out


def set_doorbuster(obs: DataFrame, on: bool, deal_id: int | None = None, flyer_id: int | None = None) -> DataFrame:
    """Tag or untag a doorbuster; untagging returns to 'standard'."""
    hit = F.col("deal_id") == deal_id if deal_id is not None else F.col("flyer_id") == flyer_id
    return obs.withColumn("promo_type", F.when(hit, F.lit("doorbuster" if on else "standard")).otherwise(F.col("promo_type")))


def update_prices(obs: DataFrame, updates: DataFrame, key: Sequence[str] = ("deal_id",)) -> DataFrame:
    """New effective prices by deal; null unit or base prices leave the stored ones. key: the columns that tell deals apart.

    Of several updates of one deal the largest price, then unit and base price, counts.
    """
    key = list(key)
    one = updates.groupBy(*key).agg(F.max(F.struct("advertised_price", "unit_price", "base_price")).alias("u"))
    u = one.select(*key, F.col("u.advertised_price").alias("n_price"), F.col("u.unit_price").alias("n_unit"),
                   F.col("u.base_price").alias("n_base"), F.lit(True).alias("hit"))
    return obs.join(u, key, "left").withColumns({
        "advertised_price": F.when(F.col("hit"), F.col("n_price")).otherwise(F.col("advertised_price")),
        "unit_price": F.coalesce("n_unit", "unit_price"), "base_price": F.coalesce("n_base", "base_price"),
    }).select(*obs.columns)


def update_shelf_prices(products: DataFrame, prices: DataFrame) -> DataFrame:
    p = prices.groupBy("product_id").agg(F.max("price").alias("n_price"))
    return products.join(p, "product_id", "left").withColumn(
        "last_shelf_price", F.coalesce("n_price", "last_shelf_price")).select(*products.columns)


# ------------------------------------------------------------------ enrichment
def unpriced_deals(s: DataFrame) -> DataFrame:
    return s.filter((F.col("advertised_price").isNull() | (F.col("advertised_price") == 0))
                    & ~is_placeholder(F.col("canonical_name")))


def shelf_price_ladder(c: Catalog, targets: DataFrame | None = None) -> DataFrame:
    """Shelf price of every unpriced deal, shared by all deals of one search term.

    Per deal: its latest priced observation by product, else by product name; per term: the first positive
    stored shelf price, else the first deal's resolved price.
    """
    s = star(c)
    want = unpriced_deals(s if targets is None else targets).withColumn(
        "term", search_term(F.col("brand"), F.col("canonical_name"), F.col("raw_title"))).filter(F.length("term") >= 2)
    priced = s.filter((F.col("base_price") > 0) | (F.col("advertised_price") > 0)).withColumn(
        "hist_price", F.coalesce("base_price", "advertised_price"))
    by_product = priced.groupBy("product_id").agg(F.max_by("hist_price", "deal_id").alias("p_price"))
    by_name = priced.groupBy("canonical_name").agg(F.max_by("hist_price", "deal_id").alias("c_price"))
    order = F.struct("flyer_id", "page_number", "deal_id")
    resolved = want.join(by_product, "product_id", "left").join(by_name, "canonical_name", "left").withColumn(
        "own", F.coalesce(truthy(F.col("p_price")), truthy(F.col("c_price"))))
    terms = resolved.groupBy("flyer_id", "term").agg(
        F.min_by("last_shelf_price", F.when(F.col("last_shelf_price") > 0, order)).alias("shelf"),
        F.min_by("own", F.when(F.col("own").isNotNull(), order)).alias("past"))
    return want.join(terms.select("flyer_id", "term", F.coalesce("shelf", "past").alias("shelf_price")),
                     ["flyer_id", "term"], "left")


def enrich_prices(unpriced: DataFrame) -> DataFrame:
    """Effective price updates for deals with a known shelf price and a recognised promotion."""
    p = promo_of([F.col("promo_detail")])
    plain_bogo = F.struct(*(
        {"promo_type": F.lit("bogo"), "promo_detail": F.coalesce(blank(F.col("promo_detail")), F.lit("BOGO")),
         "buy_qty": F.lit(1), "free_qty": F.lit(1),
         "qualifying_qty": F.coalesce(truthy(F.col("qualifying_qty")), F.lit(2))}.get(
            f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PROMO_TYPE.fields))
    known = F.coalesce(p, F.when(F.col("promo_type") == "bogo", plain_bogo))
    out = unpriced.filter(F.col("shelf_price") > 0).withColumn(
        "effective", only_some(let(known, lambda k: effective_price(k, F.col("shelf_price")))))
    return out.select("deal_id", F.col("effective").alias("advertised_price"),
                      unit_cost(truthy(F.col("effective")), F.col("unit_size")).alias("unit_price"),
                      F.col("shelf_price").alias("base_price"))


def apply_price_feed(unpriced: DataFrame, feed: DataFrame) -> DataFrame:
    """Shelf prices from an external feed (term, price) for deals whose term is still open."""
    f = feed.groupBy("term").agg(F.max("price").alias("feed_price"))
    return unpriced.filter(F.col("shelf_price").isNull()).join(f, "term").withColumn("shelf_price", F.col("feed_price")).drop(
        "feed_price")


# ------------------------------------------------------------------ coupons and stacks
COUPON_VALUES = ["title", "description", "coupon_type", "discount_amount", "min_spend", "category", "eligible_brand",
                 "is_clipped", "valid_to", "raw_node_text"]


def upsert_coupons(coupons: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """Merge by coupon key: listed values of known keys are overwritten, their other columns (id, account) stay.

    Rows without a key never conflict and are always inserted; new rows get an id from their key and place.
    """
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    rows = new.withColumns({
        "title": F.coalesce("title", F.lit("")), "coupon_type": F.coalesce("coupon_type", F.lit("STORE_COUPON")),
        "discount_amount": F.coalesce("discount_amount", F.lit(0.0)), "min_spend": F.coalesce("min_spend", F.lit(0.0)),
        "is_clipped": F.coalesce("is_clipped", F.lit(False)), "scraped_at": stamp, "__ord": order})
    keyed = last_per_key(rows.filter(F.col("coupon_key").isNotNull()), ["coupon_key"], F.col("__ord"))
    values = [*COUPON_VALUES, "scraped_at"]
    fresh = keyed.select(F.col("coupon_key").alias("__key"), F.struct(*values).alias("__new"))
    kept = coupons.join(fresh, F.col("coupon_key") == F.col("__key"), "left").select(*(
        (F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) if c in values else F.col(c)).alias(c)
        for c in coupons.columns))
    inserts = keyed.join(coupons.select("coupon_key"), "coupon_key", "left_anti").unionByName(
        rows.filter(F.col("coupon_key").isNull()))
    inserts = inserts.withColumn("coupon_id", F.xxhash64("coupon_key", "title", "__ord").cast(coupons.schema["coupon_id"].dataType))
    return kept.unionByName(inserts.drop("__ord"), allowMissingColumns=True).select(*coupons.columns)


def clip_coupon(coupons: DataFrame, coupon_key: str) -> DataFrame:
    return coupons.withColumn("is_clipped", (F.col("coupon_key").eqNullSafe(coupon_key)) | F.col("is_clipped"))


def find_coupons(coupons: DataFrame, coupon_type: str | None = None, unclipped_only: bool = False,
                 min_discount: float | None = None) -> DataFrame:
    out = coupons
    if coupon_type:
        out = out.filter(F.col("coupon_type") == coupon_type)
    if unclipped_only:
        out = out.filter(~F.col("is_clipped"))
    if min_discount is not None:
        out = out.filter(F.col("discount_amount") >= min_discount)
    return out.orderBy(F.desc("discount_amount"), "coupon_key")


def with_is_free(stacks: DataFrame) -> DataFrame:
    return stacks.withColumn("is_free", F.col("final_out_of_pocket") <= 0)


def append_stacks(stacks: DataFrame, new: DataFrame) -> DataFrame:
    """Add calculated stacks; missing values get the table's defaults."""
    defaults = {"product_name": "", "retail_price": 0.0, "source_type": "FLYER_SALE", "store_coupon_discount": 0.0,
                "mfg_coupon_discount": 0.0, "final_out_of_pocket": 0.0, "is_clipped": False, "coupon_references": "[]"}
    missing = {c: F.lit(None).cast(stacks.schema[c].dataType) for c in stacks.columns if c not in new.columns}
    return stacks.unionByName(new.withColumns(missing).fillna(defaults).select(*stacks.columns))


def clear_stacks(stacks: DataFrame) -> DataFrame:
    return stacks.limit(0)


def free_deals(stacks: DataFrame, max_price: float = 0.0) -> DataFrame:
    return with_is_free(stacks).filter(F.col("final_out_of_pocket") <= max_price).orderBy(
        "final_out_of_pocket", F.desc("retail_price"), "product_name")


def all_stacks(stacks: DataFrame) -> DataFrame:
    return with_is_free(stacks).orderBy("final_out_of_pocket", "product_name")


# ------------------------------------------------------------------ ratings, freshness, schema
def rate_products(ratings: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Apply (product_key, rating) changes one after the other; giving the same rating again clears it, null changes nothing. One row a key.

    ``order`` names the column that orders a key's changes (else by rating). What a key ends with depends on its last change and on how many
    equal ones stand before it without another between, and on the stored rating only if there is no other: no change is folded row by row.
    """
    at = F.struct(F.col(order) if order else F.lit(0), "rating")
    c = changes.filter(F.col("rating").isNotNull() & F.col("product_key").isNotNull())
    last = c.groupBy("product_key").agg(F.max_by("rating", at).alias("new"))
    keyed = c.join(last, "product_key")
    other = keyed.groupBy("product_key").agg(F.max(F.when(F.col("rating") != F.col("new"), at)).alias("other"))
    run = keyed.join(other, "product_key").groupBy("product_key", "new", F.col("other").isNull().alias("all_equal")).agg(
        F.count_if(F.col("other").isNull() | (at > F.col("other"))).alias("times"))
    stored = ratings.groupBy("product_key").agg(F.max("rating").alias("rating"))
    out = stored.join(run, "product_key", "full_outer")
    had = F.coalesce(F.col("all_equal") & (F.col("rating") == F.col("new")), F.lit(False))
    now = F.when((F.col("times") + F.when(had, 1).otherwise(0)) % 2 == 1, F.col("new"))
    return out.select("product_key", F.when(F.col("new").isNull(), F.col("rating")).otherwise(now).alias("rating")).filter(F.col("rating").isNotNull())


def sync_status(c: Catalog, stores: DataFrame, today: str | Column) -> DataFrame:
    """Per store: is a new circular needed, and why.  ``stores`` has a column ``merchant``."""
    now = F.lit(today) if isinstance(today, str) else today
    counts = c.observations.groupBy("flyer_id").agg(F.count("*").alias("deal_count"))
    f = c.flyers.join(counts, "flyer_id", "left").select(
        F.col("merchant").alias("flyer_merchant"), F.struct(
            F.coalesce(F.col("valid_from"), F.lit("")).alias("start"), "flyer_id",
            day10(F.col("valid_from")).alias("v_from"), day10(F.col("valid_to")).alias("v_to"),
            F.coalesce("source_type", F.lit("")).alias("source"),
            F.coalesce("deal_count", F.lit(0)).alias("deals")).alias("f"))
    latest = f.groupBy("flyer_merchant").agg(F.max("f").alias("f"))
    asked = stores.select("merchant").distinct()
    names = latest.withColumn("m", F.lower("flyer_merchant")).join(names_within(latest.select(F.lower("flyer_merchant").alias("m")), asked.select(F.lower("merchant").alias("live_m"))), "m")
    best = names.groupBy(F.col("live_m").alias("low")).agg(F.max("f").alias("f"))
    best = asked.withColumn("low", F.lower("merchant")).join(best, "low", "left")
    v_from, v_to = F.col("f.v_from"), F.col("f.v_to")

    def say(*pieces: Column | str) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in pieces))

    expired = (now > v_to) | ((now >= v_to) & (v_from < now))
    fallback = F.lower("merchant").contains("giant") & (F.col("f.source") != V.SOURCE_GRID)
    state = (
        F.when(F.col("f").isNull(), "missing").when(expired, "expired").when(F.col("f.deals") == 0, "empty")
        .when(fallback, "fallback").otherwise("current")
    )
    reason = (
        F.when(state == "missing", say("No active circular found in database for ", F.col("merchant"), "."))
        .when(state == "expired", say("Active circular expired on ", v_to, " (today is ", now, "). New ad needed."))
        .when(state == "empty", F.lit("Current circular in database has 0 deals recorded."))
        .when(state == "fallback", say("Current circular (valid ", v_from, " to ", v_to,
                                       ") is using Flipp fallback. Retrying Giant Grid View & solved BOGOs."))
        .otherwise(say("Current circular (valid ", v_from, " to ", v_to, ") is already fully synced via ",
                       F.col("f.source"), " with ", F.col("f.deals").cast("string"), " deals."))
    )
    return best.select("merchant", F.col("f.flyer_id").alias("flyer_id"), F.col("f.deals").alias("deal_count"),
                       state.alias("state"), (state != "current").alias("needed"), reason.alias("reason"))


def add_missing_columns(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Additive migration: columns that a stored table lacks appear with their default."""
    return df.withColumns({n: F.lit(v).cast(t) for n, (t, v) in defaults.items() if n not in df.columns})


def swap_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), keep_backup: bool = False) -> None:
    """Write beside the live table, then rename into place; the old version stays as '<path>.bak' on request.

    If the second rename fails the old version is put back. Between the two, readers find no table: ``versions.VersionedTable`` has no such moment.
    """
    spark = df.sparkSession
    staging = f"{path}.staging"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(staging)
    jvm = spark.sparkContext._jvm
    live, stage, bak = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staging, f"{path}.bak"))
    fs = live.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(live)
    if had:
        if fs.exists(bak):
            fs.delete(bak, True)
        if not fs.rename(live, bak):
            raise OSError(f"{path} cannot be renamed")
    try:
        done = fs.rename(stage, live)
    except Exception:
        if had and not fs.exists(live):
            fs.rename(bak, live)
        raise
    if not done:
        if had and not fs.exists(live):
            fs.rename(bak, live)
        raise OSError(f"{staging} cannot be renamed to {path}")
    if not keep_backup and fs.exists(bak):
        fs.delete(bak, True)


def latest_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Latest row per key by an arbitrary order, with the top-1 filter applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") == 1).drop("__r")


def merchant_filter(df: DataFrame, merchant: str | None) -> DataFrame:
    return df.filter(like_ci(F.col("merchant"), merchant)) if merchant else df
