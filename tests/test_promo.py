import pytest
from pyspark.sql import functions as F

from pricetide.functions.core import exact_round
from pricetide.functions.promo import effective_price, with_promo
from pricetide.functions import text as X


def run(spark, rows, pv=None, merchant=None):
    df = spark.createDataFrame(rows, "i int, t string, base double, price double")
    df = with_promo(df, ["t"], price=F.col("price"), merchant=F.lit(merchant).cast("string"),
                    point_value=None if pv is None else F.lit(pv))
    df = df.withColumn("eff", effective_price(F.col("promo"), F.col("base")))
    return df.orderBy("i").collect()


def test_promo_goldens(spark):
    cases = [
        ("BUY 2 GET 2 FREE", 5.89, None, dict(promo_type="bogo", qualifying_qty=4), 2.95),
        ("BUY 1 GET 1 FREE", 4.99, None, dict(promo_type="bogo"), 2.50),
        ("BUY 1 GET 1 50% OFF", 6.00, None, dict(promo_type="bogo", discount_pct=50.0), 4.50),
        ("BUY 2 • GET 1 FREE! of equal or lesser value", 3.0, None, dict(buy_qty=2, free_qty=1), 2.0),
        ("MUST BUY 4 @ $2.49", None, None, dict(promo_type="must_buy", qualifying_qty=4), 2.49),
        ("2 FOR $5", None, None, dict(promo_type="must_buy"), 2.50),
        ("3/ $10.00", None, None, dict(promo_type="must_buy", qualifying_qty=3), 3.33),
        ("10 for 10", None, None, dict(promo_type="must_buy"), 1.0),
        ("10/", None, 10.0, dict(promo_type="must_buy", qualifying_qty=10), 1.0),
        ("WITH DIGITAL COUPON $1.99", None, None, dict(promo_type="digital_coupon", coupon_price=1.99), 1.99),
        ("SAVE $1.00 WITH DIGITAL COUPON", 3.0, None, dict(promo_type="digital_coupon", coupon_discount=1.0), 2.0),
        ("redeem 75 CHOICE points SAVE UP TO $1.89", None, None,
         dict(promo_type="points_redemption", points_cost=75, points_saved_val=1.89), 0.0),
        ("300 CHOICE POINTS When you spend $20", None, None,
         dict(promo_type="points_bonus", est_reward_val=8.22, est_net_price=11.78), 11.78),
        ("SAVE $5 When you spend $20", 8.0, None, dict(promo_type="spend_save", est_net_price=15.0), 6.0),
        ("$2.00 Off/lb.", 5.0, None, dict(promo_type="dollar_off", promo_detail="$2.00 OFF per lb"), 3.0),
        ("50¢ Off", 2.0, None, dict(promo_type="dollar_off", promo_detail="50¢ OFF"), 1.5),
        ("25% Off", 4.0, None, dict(promo_type="percent_off", discount_pct=25.0), 3.0),
        ("EARN 4X CHOICE POINTS", None, None, dict(promo_type="points_bonus", points_multiplier=4.0), None),
        ("buy this Our Brand Boneless Beef Chuck Roast get these FREE* with this week's meal deal", None, None,
         dict(promo_type="meal_deal", promo_detail="Weekly Meal Deal: Buy Our Brand Boneless Beef Chuck Roast"), 0.0),
        ("Fresh Bread", None, None, None, None),
        ("Bone-In Pork Chops", None, None, None, None),
    ]
    got = run(spark, [(i, c[0], c[1], c[2]) for i, c in enumerate(cases)])
    for row, (t, _, _, want, eff) in zip(got, cases):
        if want is None:
            assert row.promo is None, (t, row.promo)
            continue
        assert row.promo is not None, t
        for k, v in want.items():
            assert row.promo[k] == v, (t, k, row.promo)
        assert row.eff == (None if eff is None else pytest.approx(eff)), (t, row.eff)


def test_exact_round_matches_binary_rounding(spark):
    xs = [2.675, 1.005, 0.125, 0.375, 2.5, 0.12375, 2.945, 1e-9, 3.0, -2.675, 2.675000001, 1234.565, 0.99 / 8]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for d in (1, 2, 3, 4):
        got = [r[0] for r in df.select(exact_round(F.col("x"), d)).collect()]
        assert got == [round(x, d) for x in xs], d


def test_units(spark):
    cases = {"Sausage 12-14 oz.": (13.0, "oz"), "Water .5 ltr": (0.5, "ltr"), "Eggs 12 ct": (12.0, "ct"),
             "Ice Cream 1.5 Quart": (1.5, "qt"), "Shrimp 31-40 ct per lb": (1.0, "lb"), "20% Off/lb.": (1.0, "lb"),
             "Bread": (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", X.unit_info(F.col("t")).alias("u")).collect():
        assert (r.u.size, r.u.unit) == cases[r.t]
    df = spark.createDataFrame([("Product 60 Count",), ("6-8 Ounces",)], "t string")
    assert [r[0] for r in df.select(X.standardize_units(F.col("t"))).collect()] == ["Product 60 ct", "6-8 oz"]


def test_categories_departments_alcohol(spark):
    cats = {"Lucerne Shredded Cheese 32 oz": "Shredded Cheese", "Primo Taglio American Cheese": "Cheese",
            "Fresh Chicken Thighs": "Bone-In Chicken Thighs", "Signature SELECT Ground Beef 80/20 1 lb": "Ground Beef",
            "Turkey Hill Tea": None, "Peanut Butter": None, "Sweet Butter": "Butter", "Dr Pepper 12 pk": "Soda"}
    df = spark.createDataFrame([(k,) for k in cats], "t string")
    for r in df.select("t", X.infer_category(F.col("t")).alias("c")).collect():
        assert r.c == cats[r.t], r
    rows = [("Wine", "x", None, True), (None, "Ginger Ale 12 pk", None, False), (None, "Josh Cellars Wine", "Josh Cellars", True),
            (None, "Red Wine Vinegar", None, False), (None, "Bud Light 12 pk", "Bud", True), (None, "Bread", None, False)]
    df = spark.createDataFrame(rows, "category string, name string, brand string, want boolean")
    for r in df.select("name", "want", X.is_alcohol(F.col("category"), F.col("name"), F.col("brand")).alias("g")).collect():
        assert r.g == r.want, r


def test_history_keys(spark):
    rows = [("CLIF Bars 6 ct",), ("CLIF Bars 6-2.4 oz",), ("CLIF Bars 1.69-2.40 oz",), ("CLIF Bars",)]
    df = spark.createDataFrame(rows, "n string")
    e = F.lit(None).cast("string")
    ks = [r[0].group_key for r in df.select(
        X.history_group(F.col("n"), e, e, e, F.lit(None).cast("double"), e)).collect()]
    assert ks[0] == ks[1] and ks[2] == ks[3] and ks[0] != ks[2]
