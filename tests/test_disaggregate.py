import pytest
from pyspark.sql import functions as F

from pricetide.operators.disaggregate import disaggregate, renormalize
from pricetide.operators.titles import split_by_tokens

ITEM = ("item_id bigint, flyer_id bigint, name string, price double, original_price double, pre_price_text string, "
        "post_price_text string, description string, brand string, page_number int, is_front_page boolean, "
        "cutout_image_url string, clean_image_url string")

CASES = [
    ("Sugardale Bacon 12 oz., Jimmy Dean Roll Sausage 16 oz. or Hillshire Farm Smoked Sausage 12-14 oz.", 2.99,
     "Sugardale | Jimmy Dean | Hillshire Farm",
     [("Sugardale Bacon 12 oz", "Sugardale", 12.0, "oz"), ("Jimmy Dean Roll Sausage 16 oz", "Jimmy Dean", 16.0, "oz"),
      ("Hillshire Farm Smoked Sausage 12-14 oz", "Hillshire Farm", 13.0, "oz")]),
    ("Signature SELECT Fresh Boneless Skinless Chicken Breasts or Thighs Value Pack", 2.99, "Signature SELECT",
     [("Boneless Skinless Chicken Breasts", "Signature SELECT", 1.0, "lb"), ("Boneless Skinless Chicken Thighs", "Signature SELECT", 1.0, "lb")]),
    ("Lucerne Chunk, Shredded or Sliced Cheese 24-32 oz", 5.0, "Lucerne",
     [("Lucerne Chunk Cheese 24-32 oz", "Lucerne", 28.0, "oz"), ("Lucerne Shredded Cheese 24-32 oz", "Lucerne", 28.0, "oz"),
      ("Lucerne Sliced Cheese 24-32 oz", "Lucerne", 28.0, "oz")]),
    ("Lucerne® Cheese 6-8 oz., Large Eggs Grade AA, 18 ct., Select Varieties or Mission Soft Taco Tortilla 10 ct.", 1.79, "Lucerne | Mission",
     [("Lucerne Cheese 6-8 oz", "Lucerne", 7.0, "oz"), ("Lucerne Large Eggs 18 ct", "Lucerne", 18.0, "ct"),
      ("Mission Soft Taco Tortilla 10 ct", "Mission", 10.0, "ct")]),
    ("Organic Sugar Pie Pumpkins or Acorn, Butternut or Spaghetti Squash", 1.49, None,
     [("Organic Sugar Pie Pumpkins", None, None, None), ("Acorn Squash", None, None, None), ("Butternut Squash", None, None, None),
      ("Spaghetti Squash", None, None, None)]),
    ("Lucerne® Shredded Cheese String Cheese 32 oz., Fage Greek Yogurt 32 oz., Horizon Organic Milk Half Gallon", 4.0, "Lucerne",
     [("Lucerne Shredded Cheese 32 oz", "Lucerne", 32.0, "oz"), ("Lucerne String Cheese 32 oz", "Lucerne", 32.0, "oz"),
      ("Fage Greek Yogurt 32 oz", "Fage", 32.0, "oz"), ("Horizon Organic Milk Half Gallon", "Horizon", None, None)]),
    ("Signature SELECT® Baby Potatoes Red, Gold or Medley", 2.0, "Signature SELECT",
     [("Signature SELECT Baby Potatoes Red", "Signature SELECT", None, None), ("Signature SELECT Baby Potatoes Gold", "Signature SELECT", None, None),
      ("Signature SELECT Baby Potatoes Medley", "Signature SELECT", None, None)]),
    ("Boneless, Skinless Chicken Breasts or Thighs", 1.69, None,
     [("Boneless Skinless Chicken Breasts", None, 1.0, "lb"), ("Boneless Skinless Chicken Thighs", None, 1.0, "lb")]),
    ("GROCERIES", None, None, []),
    ("Libby's Canned Vegetables 14.5-15 oz., McCormick Taco Seasoning 1-1.2 oz. or Ro-Tel Tomatoes 10 oz.", 0.47, "Libby's",
     [("Libby's Canned Vegetables 14.5-15 oz", "Libby's", 14.75, "oz"), ("McCormick Taco Seasoning", "McCormick", 1.1, "oz"),
      ("Ro-Tel Tomatoes 10 oz", "Ro-Tel", 10.0, "oz")]),
]


@pytest.fixture(scope="module")
def split(spark):
    extra = [("Turkey Hill Ice Cream - 2/ $6.00", 6.0, None), (
        "Signature SELECT® Thick Sliced Bacon Sold in 3 lb. Package for $11.97 ea., Hillshire Farm Lunchmeat 7-9 oz.", 3.99, "Signature SELECT"),
        ("Exclusive Digital Coupon SAVE $20 ON $100", None, None)]
    rows = [(i, 1, c[0], c[1], None, None, None, None, c[2], 1, True, None, None) for i, c in enumerate(CASES + extra)]
    out = disaggregate(spark.createDataFrame(rows, ITEM)).collect()
    by = {}
    for r in out:
        by.setdefault(r.raw_deal_id, []).append(r)
    return by


def test_titles_split_into_products(split):
    for i, (title, _, _, want) in enumerate(CASES):
        got = [(r.canonical_name, r.brand, r.unit_size, r.unit_type) for r in split.get(i, [])]
        assert got == want, title


def test_bundle_totals_bulk_packs_and_coupons(split):
    n = len(CASES)
    ice = split[n][0]
    assert (ice.advertised_price, ice.promo_type, ice.qualifying_qty) == (3.0, "must_buy", 2)
    bacon = split[n + 1][0]
    assert (bacon.canonical_name, bacon.unit_size, bacon.advertised_price, bacon.unit_price, bacon.promo_detail) == (
        "Thick Sliced Bacon", 3.0, 11.97, 3.99, "Sold in 3 lb pkg")
    coupon = split[n + 2][0]
    assert (coupon.promo_type, coupon.base_price, coupon.coupon_discount, coupon.canonical_name) == (
        "basket_coupon", 100.0, 20.0, "Exclusive Digital Coupon - $20 off $100")


def test_token_rules(spark):
    df = spark.createDataFrame([("Doritos, Tostitos 6-13 oz",), ("Dole or Our Brand Salad Blend or Kit",), ("Plain Bread",)], "t string")
    got = [r[0] for r in df.select(split_by_tokens(F.col("t"))).collect()]
    assert got == [["Doritos 6-13 oz", "Tostitos 6-13 oz"], ["Dole Salad Blend or Kit", "Our Brand Salad Blend or Kit"], ["Plain Bread"]]


def test_renormalize_counts(spark):
    row = ("deal_id bigint, flyer_id bigint, raw_deal_id bigint, raw_title string, advertised_price double, brand string, page_number int, "
           "is_front_page boolean, image_url string, canonical_name string, unit_price double, category string, merchant string, "
           "promo_type string, is_trusted boolean, source_type string, recorded_at string")
    s = spark.createDataFrame([
        (1, 7, 70, "Acorn or Butternut Squash", 1.49, None, 1, True, None, "Acorn or Butternut Squash", None, "Squash", "Tom Thumb",
         "doorbuster", False, "x", "2026-01-01")], row)
    drop, insert, report = renormalize(s)
    assert [r.deal_id for r in drop.collect()] == [1]
    ins = insert.collect()
    assert sorted(r.canonical_name for r in ins) == ["Acorn Squash", "Butternut Squash"]
    assert {(r.promo_type, r.is_trusted, r.raw_deal_id, r.recorded_at) for r in ins} == {("doorbuster", False, 70, "2026-01-01")}
    assert tuple(report.first()) == (1, 2)
