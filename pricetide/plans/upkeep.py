"""Registered queries that run table maintenance and history screens on tables that already hold rows, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide import schemas as S
from pricetide.functions.core import checkpoint_dir, day10
from pricetide.operators import history as H
from pricetide.plans import maintain as M
from pricetide.plans import views as W
from pricetide.plans.oracles import TILES, _with
from pricetide.plans.versions import VersionedTable

#: Circulars are numbered by region and week; these exist at every scale.
ONE, SOME = 300300, [300300, 100300, 300]


def _cents(x: str) -> F.Column:
    return F.round(F.col(x) * 100).cast("bigint")


def _star(s: SparkSession, d: str) -> DataFrame:
    return H.star(W.catalog(s, d))


def _named_once(s: SparkSession, d: str) -> DataFrame:
    """Products, one for each name: that with the smallest id."""
    p = W.products(s, d)
    return p.groupBy("canonical_name").agg(F.min_by(F.struct(*[c for c in p.columns if c != "canonical_name"]), "product_id").alias("r")).select(
        "r.product_id", "canonical_name", "r.brand", "r.category", "r.unit_size", "r.unit_type", "r.last_shelf_price")


def flyer_deals_one(s, d):
    rows = H.flyer_deals(_star(s, d), ONE, front_page_only=True, trusted_only=True)
    return rows.select("deal_id", "page_number", _cents("advertised_price").alias("cents"))


def flyer_product_histories(s, d):
    rows = H.flyer_product_histories(W.catalog(s, d), SOME)
    return rows.groupBy("product_id").agg(F.count("*").alias("n"), F.min(_cents("advertised_price")).alias("least"), F.countDistinct("flyer_id").alias("flyers"))


def product_history(s, d):
    rows = H.product_history(_star(s, d), W.products(s, d).select("product_id"), trusted_only=True, merchant="e")
    return rows.select("deal_id", "product_id", day10(F.col("valid_from")).alias("day"))


def product_history_all(s, d):
    """Every product at every merchant, trusted or not."""
    rows = H.product_history(_star(s, d), W.products(s, d).select("product_id"))
    return rows.select("deal_id", "product_id", day10(F.col("valid_from")).alias("day"))


def commodity_history(s, d):
    rows = H.commodity_history(_star(s, d), "Medium", "oz", trusted_only=True)
    return rows.select("deal_id", F.round(F.col("unit_price") * F.col("unit_size") * 100).cast("bigint").alias("cents"))


def ad_title_history(s, d):
    title = W.products(s, d).filter("unit_size = 50").agg(F.min("canonical_name")).first()[0]
    rows = H.ad_title_history(_star(s, d), title, not_flyer=ONE, before="1998-01-05", merchant="a")
    return rows.select("deal_id", _cents("advertised_price").alias("cents"))


def flat_history(s, d):
    rows = H.flat_history(W.catalog(s, d), "ring", "rica")
    return rows.select("deal_id", "product_id", _cents("advertised_price").alias("cents"))


def merge_observations(s, d):
    """Half the tiles are stored; a batch delivers two thirds, each twice, the second time a dollar dearer."""
    products = _named_once(s, d)
    all_obs = W.observations(s, d).join(W.products(s, d).select("product_id", "canonical_name"), "product_id").drop("product_id").join(
        products.select("canonical_name", "product_id"), "canonical_name")
    stored = all_obs.filter("raw_deal_id % 2 = 0").drop("canonical_name").select(*W.observations(s, d).columns)
    batch = all_obs.filter("raw_deal_id % 3 <> 0").drop("product_id", "deal_id")
    twice = batch.withColumn("turn", F.lit(1)).unionByName(batch.withColumns({"turn": F.lit(2), "advertised_price": F.col("advertised_price") + 1}))
    out = M.upsert_observations(stored, twice.withColumn("deal_id", F.lit(0)).drop("product_id"), products, F.col("turn"))
    return out.select("flyer_id", "product_id", "raw_deal_id", _cents("advertised_price").alias("cents"))


def merge_products_stored(s, d):
    """Stored products lack brands of every second name; deals bring brands, some of them null."""
    stored = _named_once(s, d).filter("product_id % 5 <> 0").withColumn("brand", F.when(F.col("product_id") % 2 == 0, F.lit("old")))
    deals = _named_once(s, d).withColumns({"ord": F.col("product_id"), "category": F.lit(None).cast("string")}).drop("product_id")
    out = M.upsert_products(stored, deals, F.col("ord"))
    return out.select("canonical_name", "brand", "category", F.col("product_id").between(0, 10_000_000).alias("kept_id"))


def merge_flyers(s, d):
    f = W.flyers(s, d)
    fresh = f.filter("flyer_id % 2 = 0").withColumns({"name": F.lit("New"), "valid_to": F.lit("2001-01-01T00:00:00"), "merchant": F.lit("Other")})
    new = fresh.unionByName(fresh.filter("flyer_id % 10 = 0").withColumn("flyer_id", F.col("flyer_id") + 10_000_000))
    return M.upsert_flyers(f, new).select("flyer_id", "merchant", "name", day10(F.col("valid_to")).alias("day_to"), "is_trusted")


def set_trust(s, d):
    o = M.set_trust(M.set_trust(W.observations(s, d), False, except_ids=SOME), True, flyer_ids=[SOME[2]])
    return o.groupBy("flyer_id").agg(F.max("is_trusted").alias("any_trusted"), F.min("is_trusted").alias("all_trusted"))


def set_doorbuster(s, d):
    o = M.set_doorbuster(M.set_doorbuster(W.observations(s, d), False, flyer_id=SOME[1]), True, flyer_id=ONE)
    return o.groupBy("flyer_id", "promo_type").agg(F.count("*").alias("n"))


def update_prices(s, d):
    o = W.observations(s, d)
    tile = ["raw_deal_id", "product_id"]  # deal ids of parts beyond 2^20 meet those of the next tile
    new = o.filter("raw_deal_id % 4 = 1").select(*tile, (F.col("page_number") * 1.25).alias("advertised_price"), F.lit(None).cast("double").alias("unit_price"),
                                                 F.when(F.col("page_number") > 3, 9.5).alias("base_price"))
    return M.update_prices(o, new, tile).select("deal_id", _cents("advertised_price").alias("cents"), _cents("base_price").alias("base"))


def update_shelf_prices(s, d):
    p = W.products(s, d)
    new = p.filter("product_id % 3 = 0").select("product_id", (F.col("unit_size") + 0.5).alias("price"))
    return M.update_shelf_prices(p, new.unionByName(new.withColumn("price", F.col("price") - 1))).select("product_id", _cents("last_shelf_price").alias("cents"))


def unpriced_deals(s, d):
    return M.unpriced_deals(_star(s, d)).select("deal_id", "product_id")


def delete_flyers(s, d):
    c = M.delete_flyers(W.catalog(s, d), W.flyers(s, d).filter("flyer_id % 100 <> 7").select("flyer_id"))
    counts = [x.agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, x in (("observations", c.observations), ("products", c.products), ("flyers", c.flyers))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def flyers_without_deals(s, d):
    return M.flyers_without_deals(W.flyers(s, d), W.observations(s, d).filter("flyer_id % 9 > 2")).select("flyer_id")


def apply_price_feed(s, d):
    """Products with even ids have no price of their own, past or stored; a feed names two prices for each term."""
    c, own = W.catalog(s, d), F.col("product_id") % 2 == 1
    obs = c.observations.withColumns({x: F.when(own, F.col(x)) for x in ("advertised_price", "base_price")})
    open_deals = M.shelf_price_ladder(H.Catalog(obs, c.products.withColumn("last_shelf_price", F.when(own, F.col("last_shelf_price"))), c.flyers))
    feed = open_deals.select("term").distinct().select("term", F.length("term").cast("double").alias("price"))
    out = M.apply_price_feed(open_deals, feed.unionByName(feed.withColumn("price", F.lit(1.0))))
    return out.select("deal_id", "term", "shelf_price")


def merge_batches(s, d):
    """Three batches of tiles, some delivered again, merged into a versioned table: every part's last tile of its last batch."""
    tiles = W._tiles(s, d).select(F.col("l_partkey").alias("product_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("raw_deal_id"), "cents", (F.col("l_linenumber") % 3).alias("batch"))
    table = VersionedTable(s, f"{checkpoint_dir(s)}/merge-{uuid.uuid4()}")
    columns = "product_id long, raw_deal_id long, cents long, batch long"
    for i in (0, 1, 0, 2, 1, 2):
        batch = tiles.filter(F.col("batch") == i).select(*(F.col(c).cast("long").alias(c) for c in ("product_id", "raw_deal_id", "cents", "batch")))
        table.merge_batch(batch, "tiles", i, lambda old, new: M.merge_rows(old, M.last_per_key(new, ["product_id"], F.struct("raw_deal_id", "cents")), ["product_id"]), columns)
    return table.read().withColumn("versions", F.lit(table.version().number))


def _coupons(s, d) -> DataFrame:
    c = W._read(s, d, "customer").select(
        F.col("c_custkey").alias("coupon_id"), F.col("c_name").alias("coupon_key"), F.when(F.col("c_custkey") % 2 == 0, "STORE_COUPON").otherwise("MFG_COUPON").alias("coupon_type"),
        (F.col("c_custkey") % 9 * 0.5).alias("discount_amount"), (F.col("c_custkey") % 3 == 0).alias("is_clipped"))
    empty = s.createDataFrame([], S.COUPONS)
    return empty.unionByName(c, allowMissingColumns=True).select(*empty.columns)


def find_coupons(s, d):
    clipped = M.clip_coupon(_coupons(s, d), "Customer#000000002")
    return M.find_coupons(clipped, "STORE_COUPON", unclipped_only=True, min_discount=1.0).select("coupon_id", "discount_amount")


def append_stacks(s, d):
    empty = s.createDataFrame([], S.STACKS)
    new = W._read(s, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("product_name"), F.lit(4.0).alias("retail_price"),
                                           F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") - 10.0).alias("final_out_of_pocket"))
    stored = M.append_stacks(empty, new)
    return M.all_stacks(M.append_stacks(M.clear_stacks(stored).unionByName(stored), new)).groupBy("product_name", "source_type", "is_free").agg(
        F.count("*").alias("n"), F.sum("final_out_of_pocket").alias("pay"))


def rate_products(s, d):
    """Changes of stored and new ratings, up to three of a product, in the order of at."""
    r, p, key = W.ratings(s, d), W.products(s, d), F.concat(F.lit("pid_"), "product_id").alias("product_key")
    seventh = p.filter("product_id % 7 = 0").select(key, F.lit("hide").alias("rating"), "product_id")
    new = r.filter("length(product_key) % 2 = 0").withColumn("at", F.lit(1)).unionByName(p.filter("product_id % 5 = 0").select(key, F.lit("love").alias("rating"), F.lit(1).alias("at")))
    new = new.unionByName(seventh.select("product_key", "rating", F.lit(2).alias("at"))).unionByName(seventh.filter("product_id % 2 = 0").select("product_key", "rating", F.lit(3).alias("at")))
    return M.rate_products(r, new, "at")


SQL = {
    "flyer_deals_one": f" SELECT deal_id, page_number, CAST(round(advertised_price * 100) AS BIGINT) AS cents FROM star WHERE flyer_id = {ONE} AND is_front_page AND is_trusted",
    "flyer_product_histories": """ SELECT product_id, count(*) AS n, min(CAST(round(advertised_price * 100) AS BIGINT)) AS least, count(DISTINCT flyer_id) AS flyers FROM obs
      WHERE product_id IN (SELECT product_id FROM obs WHERE flyer_id IN (300300, 100300, 300)) GROUP BY 1""",
    "product_history": " SELECT deal_id, product_id, CAST(week AS VARCHAR) AS day FROM star WHERE is_trusted AND merchant ILIKE '%e%'",
    "product_history_all": " SELECT deal_id, product_id, CAST(week AS VARCHAR) AS day FROM star",
    "commodity_history": """ SELECT deal_id, CAST(round(advertised_price * 100) AS BIGINT) AS cents FROM star WHERE is_trusted AND unit_type = 'oz' AND advertised_price IS NOT NULL
      AND (lower(category) = 'medium' OR (category IS NULL AND contains(' ' || lower(canonical_name) || ' ', ' medium ')))""",
    "ad_title_history": """, t AS (SELECT min(canonical_name) AS title FROM prod WHERE unit_size = 50) SELECT deal_id, CAST(round(advertised_price * 100) AS BIGINT) AS cents FROM star, t
      WHERE (ad_title = title OR canonical_name = title) AND advertised_price IS NOT NULL AND flyer_id <> 300300 AND week < DATE '1998-01-05' AND merchant ILIKE '%a%'""",
    "flat_history": """ SELECT deal_id, product_id, CAST(round(advertised_price * 100) AS BIGINT) AS cents FROM star WHERE merchant ILIKE '%rica%' AND product_id IN
      (SELECT product_id FROM obs WHERE merchant ILIKE '%rica%') AND (canonical_name ILIKE '%ring%' OR brand ILIKE '%ring%')""",
    "merge_observations": """, first AS (SELECT canonical_name, min(product_id) AS pid FROM prod GROUP BY 1) SELECT flyer_id, pid AS product_id, raw_deal_id,
      CAST(round(advertised_price * 100) AS BIGINT) + CASE WHEN raw_deal_id % 3 <> 0 THEN 100 ELSE 0 END AS cents FROM star JOIN first USING (canonical_name) WHERE raw_deal_id % 2 = 0 OR raw_deal_id % 3 <> 0""",
    "merge_products_stored": """, first AS (SELECT canonical_name, min(product_id) AS pid, arg_min(CASE WHEN brand IS NULL THEN '' ELSE brand END, product_id) AS b,
        arg_min(CASE WHEN category IS NULL THEN '' ELSE category END, product_id) AS c FROM prod GROUP BY 1)
      SELECT canonical_name, CASE WHEN b <> '' THEN b WHEN pid % 5 <> 0 AND pid % 2 = 0 THEN 'old' END AS brand, CASE WHEN pid % 5 <> 0 AND c <> '' THEN c END AS category, pid % 5 <> 0 AS kept_id FROM first""",
    "merge_flyers": """ SELECT flyer_id, merchant, CASE WHEN week_no % 3 = 0 THEN 'Specials' ELSE 'Weekly Ad' END AS name, CASE WHEN flyer_id % 2 = 0 THEN '2001-01-01' ELSE CAST(week_end AS VARCHAR) END AS day_to,
        is_trusted OR flyer_id % 2 = 0 AS is_trusted FROM flyer UNION ALL SELECT flyer_id + 10000000, 'Other', 'New', '2001-01-01', true FROM flyer WHERE flyer_id % 10 = 0""",
    "set_trust": """ SELECT flyer_id, bool_or(t) AS any_trusted, bool_and(t) AS all_trusted FROM (SELECT flyer_id, CASE WHEN flyer_id = 300 THEN true WHEN flyer_id IN (300300, 100300) THEN is_trusted ELSE false END AS t FROM obs) GROUP BY 1""",
    "set_doorbuster": " SELECT flyer_id, CASE flyer_id WHEN 100300 THEN 'standard' WHEN 300300 THEN 'doorbuster' ELSE promo_type END AS promo_type, count(*) AS n FROM obs GROUP BY ALL",
    "update_prices": """ SELECT deal_id, CASE WHEN raw_deal_id % 4 = 1 THEN page_number * 125 ELSE CAST(round(advertised_price * 100) AS BIGINT) END AS cents,
        CASE WHEN raw_deal_id % 4 = 1 AND page_number > 3 THEN 950 ELSE CAST(round(base_price * 100) AS BIGINT) END AS base FROM obs""",
    "update_shelf_prices": " SELECT product_id, CASE WHEN product_id % 3 = 0 THEN CAST(unit_size * 100 AS BIGINT) + 50 ELSE CAST(round(last_shelf_price * 100) AS BIGINT) END AS cents FROM prod",
    "unpriced_deals": " SELECT deal_id, product_id FROM obs WHERE advertised_price IS NULL OR advertised_price = 0",
    "delete_flyers": """, o AS (SELECT * FROM obs WHERE flyer_id % 100 = 7) SELECT count(*) AS n, 'observations' AS kind FROM o UNION ALL SELECT count(DISTINCT product_id), 'products' FROM o
      UNION ALL SELECT count(*), 'flyers' FROM flyer WHERE flyer_id % 100 = 7""",
    "flyers_without_deals": " SELECT flyer_id FROM flyer WHERE flyer_id % 9 <= 2",
    "find_coupons": """ SELECT c_custkey AS coupon_id, c_custkey % 9 * 0.5::DOUBLE AS discount_amount FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey <> 2 AND c_custkey % 9 * 0.5 >= 1.0""",
    "append_stacks": """ SELECT coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, '') AS product_name, 'FLYER_SALE' AS source_type, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey - 10.0::DOUBLE ELSE 0 END <= 0 AS is_free,
        2 * count(*) AS n, 2 * sum(CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey - 10.0::DOUBLE ELSE 0 END) AS pay FROM supplier GROUP BY 1, 3""",
    "apply_price_feed": """, s2 AS (SELECT * REPLACE (CASE WHEN product_id % 2 = 1 THEN advertised_price END AS advertised_price, CASE WHEN product_id % 2 = 1 THEN base_price END AS base_price,
        CASE WHEN product_id % 2 = 1 THEN last_shelf_price END AS last_shelf_price) FROM star), pr AS (SELECT *, coalesce(base_price, advertised_price) AS hp FROM s2 WHERE base_price > 0 OR advertised_price > 0),
      bp AS (SELECT product_id, arg_max(hp, deal_id) AS p FROM pr GROUP BY 1), bn AS (SELECT canonical_name, arg_max(hp, deal_id) AS p FROM pr GROUP BY 1),
      un AS (SELECT s.deal_id, s.flyer_id, last_shelf_price, coalesce(bp.p, bn.p) AS own, coalesce(brand, array_to_string(list_filter(str_split(regexp_replace(s.canonical_name, '\\b\\d+ oz.*', ''), ' '), lambda x: x <> '')[1:2], ' ')) AS term
        FROM s2 s LEFT JOIN bp USING (product_id) LEFT JOIN bn ON bn.canonical_name = s.canonical_name WHERE advertised_price IS NULL),
      shut AS (SELECT DISTINCT flyer_id, term FROM un WHERE last_shelf_price > 0 OR own IS NOT NULL)
      SELECT deal_id, term, length(term)::DOUBLE AS shelf_price FROM un ANTI JOIN shut USING (flyer_id, term)""",
    "merge_batches": """ SELECT product_id, arg_max(raw_deal_id, (batch, raw_deal_id, cents)) AS raw_deal_id, arg_max(cents, (batch, raw_deal_id, cents)) AS cents, max(batch) AS batch, 3 AS versions
      FROM (SELECT *, (l_linenumber % 3)::BIGINT AS batch FROM obs) GROUP BY 1""",
    "rate_products": """WITH s0 AS (SELECT p_partkey AS p, 'pid_' || p_partkey AS product_key, CASE WHEN p_partkey % 5 <> 0 THEN ['love', 'deal_only', 'giveaway', 'hide'][p_partkey % 4 + 1] END AS r FROM part),
      s1 AS (SELECT p, product_key, CASE WHEN p % 5 = 0 THEN 'love' WHEN length(product_key) % 2 = 0 THEN NULL ELSE r END AS r FROM s0),
      s2 AS (SELECT p, product_key, CASE WHEN p % 7 <> 0 THEN r WHEN r = 'hide' THEN NULL ELSE 'hide' END AS r FROM s1),
      s3 AS (SELECT p, product_key, CASE WHEN p % 14 <> 0 THEN r WHEN r = 'hide' THEN NULL ELSE 'hide' END AS r FROM s2)
      SELECT product_key, r AS rating FROM s3 WHERE r IS NOT NULL""",
}
_PLAIN = {"find_coupons", "append_stacks", "rate_products"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fns = [
        flyer_deals_one, flyer_product_histories, product_history, product_history_all, commodity_history, ad_title_history, flat_history, merge_observations, merge_products_stored,
        merge_flyers, set_trust, set_doorbuster, update_prices, update_shelf_prices, unpriced_deals, delete_flyers, flyers_without_deals, apply_price_feed,
        find_coupons, append_stacks, rate_products, merge_batches,
    ]
    return {f.__name__: f for f in fns}


def oracle_sql() -> dict[str, str]:
    return {k: v if k in _PLAIN else _with(TILES) + v for k, v in SQL.items()}
