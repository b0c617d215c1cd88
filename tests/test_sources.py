import json

from pyspark.sql import functions as F

from pricetide import schemas as S
from pricetide.plans import maintain as M
from pricetide.operators.history import Catalog, search_products, star
from pricetide.sources import circulars as C
from pricetide.sources import export as X
from pricetide.streaming import streams as T


def write(tmp_path, name, *docs):
    p = tmp_path / name
    p.mkdir()
    (p / "a.json").write_text("\n".join(json.dumps(d) for d in docs))
    return str(p)


def item(i, name, left, right, price="1.00", **kw):
    return {"id": i, "name": name, "left": left, "right": right, "price": price, **kw}


def test_listing_defaults_and_weekly_choice(spark, tmp_path):
    doc = {"flyers": [{"id": 1, "merchant": "Tom Thumb", "name": "Specials"}, {"id": 2, "merchant": "Tom Thumb"}, {"id": 3, "merchant": "Giant"}]}
    raw = C.read_json(spark, write(tmp_path, "l", doc), S.LISTING)
    rows = {r.flyer_id: r for r in C.flyer_listing(raw, "tom", "75080").collect()}
    assert set(rows) == {1, 2} and rows[2].name == "Weekly Ad" and rows[2].postal_code == "75080" and rows[1].width == 0.0
    assert [r.id for r in C.weekly_ad(raw, "thumb").collect()] == [2]


def test_pages_prices_and_front_page(spark, tmp_path):
    long_run = {"valid_from": "2026-09-01T00:00:00", "valid_to": "2026-12-01"}
    week = {"valid_from": "2026-09-01", "valid_to": "2026-09-07"}
    doc = {"flyer_id": 9, "pages": [{"id": 1, "page": 1, "left": 0, "right": 1463}, {"id": 2, "page": 2, "left": 1463, "right": 3000}],
           "items": [item(1, "Savings chips", 600, 700, **long_run), item(2, "Chicken", 2200, 2300, price=None, current_price="2.50", **week),
                     item(3, "Odd", 5000, 5100, price="see ad", **long_run)]}
    raw = C.read_json(spark, write(tmp_path, "p", doc), S.PAYLOAD)
    got = {r.item_id: r for r in C.flyer_items(raw).collect()}
    assert (got[1].page_number, got[2].page_number, got[3].page_number) == (1, 2, 1)
    assert got[2].price == 2.5 and got[3].price is None
    assert not got[1].is_front_page and got[2].is_front_page
    details = spark.createDataFrame([((1, "desc", "", "2 for $5", None, "B", None),)], S.DETAIL)
    hyd = {r.item_id: r for r in C.hydrate(C.flyer_items(raw), details).collect()}
    assert (hyd[1].description, hyd[1].pre_price_text, hyd[1].brand, hyd[2].description) == ("desc", "2 for $5", "B", None)


def test_grid_source(spark, tmp_path):
    ad = {"id": 10, "circularId": "c", "name": "Old", "salesText": "BUY 1 GET 1 FREE", "categories": [{"name": "Snacks"}], "images": {"small": "s"}}
    b1 = {"run_id": "r", "batch_no": 1, "adsStartDate": "2026-10-02T00:00", "adsEndDate": "2026-10-08", "flyerRunId": "77", "ads": [ad]}
    b2 = {"run_id": "r", "batch_no": 2, "ads": [{**ad, "name": "Utz Potato Chips"}, {"id": 11, "circularId": "c", "name": "Our Brand Large Eggs 12 ct", "salesText": "Only $1.99",
          "images": {"medium": "m"}}]}
    ads = C.grid_ads(C.read_json(spark, write(tmp_path, "g", b1, b2), S.GRID_BATCH))
    rows = {r.ad_id: r for r in ads.collect()}
    assert rows[10].name == "Utz Potato Chips" and rows[10].flyer_id == 77 and rows[10].valid_from == "2026-10-02T00:00:00-04:00"
    names = spark.createDataFrame([("Utz Potato Chips", 3, True, 0), ("fresh our brand large eggs 12 ct dozen", 5, False, 1)],
                                  "name string, page_number int, is_front_page boolean, pos int")
    placed = C.lookup_pages(ads, names)
    assert {r.ad_id: r.page_number for r in placed.collect()} == {10: 3, 11: 5}
    other = C.lookup_pages(ads, names.limit(0))
    assert {r.ad_id: r.page_number for r in other.collect()} == {10: 15, 11: 15}
    assert {r.ad_id for r in C.needs_detail(ads).collect()} == {10, 11}
    prods = spark.createDataFrame([(10, [("Utz Chips Ripple", "Utz", 4.99, 4.99, "8 oz", "Snacks", None)])], S.GRID_PRODUCTS)
    deal = C.grid_products(placed, prods).first()
    assert (deal.advertised_price, deal.unit_price, deal.promo_type, deal.raw_deal_id, deal.ad_title, deal.category) == (
        2.5, 0.3125, "bogo", 100, "Utz Potato Chips", "Potatoes")
    assert [(r.item_id, r.price) for r in C.grid_items(placed, prods).collect()] == [(11, 1.99)]


def test_prepared_pages_and_stores(spark):
    raw = spark.createDataFrame([(5, [(1, None, [("Milk", 2.0, 64.0, "oz", None, None, None), ("Eggs", None, None, None, None, None, None)]),
                                      (2, None, [("Bread", 3.0, None, None, None, None, "bogo")])])], S.PREPARED)
    got = [(r.raw_deal_id, r.canonical_name, r.unit_price, r.promo_type, r.is_front_page, r.is_trusted)
           for r in C.prepared_deals(raw).orderBy("raw_deal_id").collect()]
    assert got == [(5001, "Milk", 0.0312, "member_card", True, False), (5002, "Eggs", None, "standard", True, False),
                   (5003, "Bread", None, "bogo", False, False)]
    req = spark.createDataFrame([("Tom-Thumb", None, None), (None, "giant", None), (None, "Aldi", None), (None, None, "X"), (None, None, None)],
                                "store string, merchant string, configured string")
    assert [r.resolved for r in C.resolve_stores(req, spark).collect()] == ["Tom Thumb", "Giant Food Stores", "Aldi", "X", "Tom Thumb"]
    lst = C.parse_store_list(spark.createDataFrame([("17837:Giant Food Stores, 75080:Tom Thumb,,90210",)], "s string"), "s")
    assert [(r.postal_code, r.store_merchant) for r in lst.collect()] == [("17837", "Giant Food Stores"), ("75080", "Tom Thumb"), ("90210", "")]


def deal(name, raw, price, flyer=1, **kw):
    base = dict.fromkeys(S.DEAL_COLUMNS)
    base.update(raw_deal_id=raw, flyer_id=flyer, page_number=1, is_front_page=True, canonical_name=name, advertised_price=price, raw_title=name,
                promo_type="standard", is_trusted=True, source_type="flipp_api", qualifying_qty=1, **kw)
    return base


DEAL_SCHEMA = ("raw_deal_id bigint, flyer_id bigint, page_number int, is_front_page boolean, canonical_name string, brand string, advertised_price double, "
               "unit_size double, unit_type string, unit_price double, raw_title string, image_url string, promo_type string, is_trusted boolean, "
               "source_type string, category string, promo_detail string, qualifying_qty int, base_price double, coupon_discount double, ad_title string, ord int")


def empty(spark):
    return Catalog(spark.createDataFrame([], S.OBSERVATIONS), spark.createDataFrame([], S.PRODUCTS), spark.createDataFrame([], S.FLYERS))


def deals_df(spark, rows):
    cols = [*S.DEAL_COLUMNS, "ord"]
    return spark.createDataFrame([tuple({**r, "ord": i}[c] for c in cols) for i, r in enumerate(rows)], DEAL_SCHEMA)


def test_resync_is_idempotent_and_supersedes(spark):
    flyer = spark.createDataFrame([(1, "75080", "Tom Thumb", "Weekly Ad", "2026-09-16T00:00", "2026-09-22T23:59")],
                                  "flyer_id bigint, postal_code string, merchant string, name string, valid_from string, valid_to string")
    c = empty(spark)
    old = spark.createDataFrame([(20260916, "75080", "Tom Thumb", "Scan", "2026-09-16", "2026-09-22", False, "ocr", "x"),
                                 (3, "75080", "Tom Thumb", "Far", "2026-01-01", "2026-01-07", False, "ocr", "x")], S.FLYERS)
    c = Catalog(c.observations, c.products, old)
    deals = deals_df(spark, [deal("Milk", 10, 2.0, brand="A"), deal("Milk", 10, 1.5), deal("Bread", 11, 3.0)])
    one = M.resync(c, flyer, deals, F.col("ord"))
    two = M.resync(one, flyer, deals, F.col("ord"))
    assert sorted((r.canonical_name, r.advertised_price, r.brand) for r in star(two).collect()) == [("Bread", 3.0, None), ("Milk", 1.5, "A")]
    assert sorted(r.flyer_id for r in two.flyers.collect()) == [1, 3]
    assert search_products(two, "mil").first().canonical_name == "Milk"
    tagged = M.set_doorbuster(two.observations, True, flyer_id=1)
    assert {r.promo_type for r in tagged.collect()} == {"doorbuster"}
    assert {r.is_trusted for r in M.set_trust(two.flyers, True, except_ids=[3]).collect()} == {True, False}
    gone = M.delete_flyers(two, spark.createDataFrame([(1,)], "flyer_id bigint"))
    assert gone.observations.count() == 0 and gone.products.count() == 0


def test_coupons_ratings_swap_and_freshness(spark, tmp_path):
    r = spark.createDataFrame([("a", "love"), ("b", "hide")], S.RATINGS)
    ch = spark.createDataFrame([("a", "love"), ("c", "giveaway")], S.RATINGS)
    assert sorted(map(tuple, M.rate_products(r, ch).collect())) == [("b", "hide"), ("c", "giveaway")]
    path = str(tmp_path / "t")
    M.swap_table(r, path)
    M.swap_table(spark.read.parquet(path).filter("rating = 'hide'"), path, keep_backup=True)
    assert [x.product_key for x in spark.read.parquet(path).collect()] == ["b"] and spark.read.parquet(path + ".bak").count() == 2
    c = empty(spark)
    fl = spark.createDataFrame([(1, "1", "Giant Food Stores", "W", "2026-10-02", "2026-10-08", True, "flipp_api", "x")], S.FLYERS)
    ob = c.observations.unionByName(spark.createDataFrame([(1, 1, 1)], "deal_id bigint, flyer_id bigint, product_id bigint"), allowMissingColumns=True)
    stores = spark.createDataFrame([("giant",), ("Aldi",)], "merchant string")
    st = {x.merchant: (x.needed, x.state) for x in M.sync_status(Catalog(ob, c.products, fl), stores, "2026-10-03").collect()}
    assert st == {"giant": (True, "fallback"), "Aldi": (True, "missing")}
    assert {x.state for x in M.sync_status(Catalog(ob, c.products, fl), stores, "2026-10-09").collect()} == {"expired", "missing"}
    assert M.add_missing_columns(stores, {"upc": ("string", None), "merchant": ("string", "z")}).columns == ["merchant", "upc"]


def test_export_round_trip(spark, tmp_path):
    bare = tmp_path / "bare.json"
    bare.write_text('[{"deal_id": 1, "name": "Milk"}]')
    env = tmp_path / "env.json"
    env.write_text('{"flyer": {}, "deals": [{"deal_id": 2, "name": "Eggs"}]}')
    got = [X.read_deals(spark, str(p), "deal_id bigint, name string").first() for p in (bare, env)]
    assert [tuple(r) for r in got] == [(1, "Milk"), (2, "Eggs")]


def test_streams(spark, tmp_path):
    rows = [("2026-08-05", "2026-08-11", 0.37, 1), ("2026-08-12", "2026-08-18", 0.37, 2), ("2026-08-19", "2026-08-25", 0.69, 3)]
    src = write(tmp_path, "in", *[{"product_id": 1, "day": x, "end_day": y, "from_day": x, "price": p, "seq": i, "trusted": True, "outlier": False} for x, y, p, i in rows])
    schema = "product_id bigint, day date, end_day date, from_day date, price double, seq bigint, trusted boolean, outlier boolean"
    q = T.running_episodes(spark.readStream.schema(schema).json(src)).writeStream.format("memory").queryName("eps").outputMode(
        "update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.price, r.observations_count) for r in spark.table("eps").collect()) == [(0.37, 2), (0.69, 1)]
    seen = []
    q = T.ingest(spark, src, schema, str(tmp_path / "c2"), lambda df, i: seen.append(df.count()))
    q.awaitTermination(120)
    assert sum(seen) == 3
    dup = write(tmp_path, "dup", *[{"flyer_id": 1, "product_id": 1, "raw_deal_id": 1, "recorded_at": "2026-08-05T00:00:00"}] * 3)
    st = spark.readStream.schema("flyer_id bigint, product_id bigint, raw_deal_id bigint, recorded_at timestamp").json(dup)
    q = T.collapse_redelivered(st).writeStream.format("memory").queryName("dd").option("checkpointLocation", str(tmp_path / "c3")).trigger(
        availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dd").count() == 1
