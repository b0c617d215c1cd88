import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricetide import schemas as S
from pricetide.operators.episodes import cluster_episodes, history_rows
from pricetide.operators.evaluate import evaluate
from pricetide.operators.history import Catalog, star
from pricetide.operators.past import past_stats


class Store:
    """Builds a small price store from (product, merchant, day, price, ...) rows."""

    def __init__(self, spark):
        self.spark, self.obs, self.prod, self.fly = spark, [], {}, {}

    def product(self, name, brand=None, category=None, size=None, unit=None, shelf=None):
        self.prod.setdefault(name, (len(self.prod) + 1, name, brand, category, size, unit, shelf, None))

    def add(self, name, day, price, merchant="Tom Thumb", days=6, promo="standard", detail=None, trusted=True, unit_price=None,
            base=None, ad_title=None, raw_title=None, suffix=""):
        self.product(name)
        start = dt.date.fromisoformat(day)
        key = (merchant, day, suffix)
        self.fly.setdefault(key, (len(self.fly) + 100, "75080", merchant, "Weekly Ad", day + "T00:00:00" + suffix,
                                  (start + dt.timedelta(days=days)).isoformat() + "T23:59:59" + suffix, trusted, "api", day))
        i = len(self.obs) + 1
        self.obs.append((i, self.fly[key][0], self.prod[name][0], 10449797220 + i, 1, True, price, unit_price, promo, detail, 1, base,
                         None, ad_title, raw_title or name, None, trusted, "api", day))
        return i

    def catalog(self):
        mk = self.spark.createDataFrame
        return Catalog(mk(self.obs, S.OBSERVATIONS), mk(list(self.prod.values()), S.PRODUCTS), mk(list(self.fly.values()), S.FLYERS))


@pytest.fixture(scope="module")
def evaluated(spark):
    s = Store(spark)
    ids = {}
    for name, hist, now in (("New low", [3.99, 3.49], 2.99), ("Hike", [3.99, 3.49], 4.99)):
        s.add(name, "2026-08-01", hist[0])
        s.add(name, "2026-08-15", hist[1])
        ids[name] = s.add(name, "2026-09-01", now)
    s.add("Concurrent", "2026-09-16", 0.69)
    ids["Concurrent"] = s.add("Concurrent", "2026-09-16", 0.69, suffix="-04:00")
    s.add("Other chain", "2026-07-01", 20.99, merchant="Giant")
    ids["Other chain"] = s.add("Other chain", "2026-09-01", 4.99)
    s.add("Parent variety", "2026-08-01", 6.00, ad_title="Ice Cream Family")
    ids["New variety"] = s.add("New variety", "2026-09-01", 3.49, ad_title="Ice Cream Family")
    ids["five points"] = s.add("Bananas", "2026-09-01", None, detail="FREE when you redeem 5 CHOICE points", merchant="Giant")
    ids["hundred points"] = s.add("Coffee beans", "2026-09-01", None, detail="redeem 100 CHOICE points SAVE UP TO $4.50", merchant="Giant Two")
    ids["weak points"] = s.add("Crackers", "2026-09-01", None, detail="redeem 100 CHOICE points SAVE UP TO $1.50", merchant="Giant Three")
    ids["spend"] = s.add("Detergent", "2026-09-01", 7.99, detail="SAVE $25 When you spend $75")
    s.add("Multiplied", "2026-08-01", 2.99, merchant="Tom Thumb")
    ids["multiplier"] = s.add("Multiplied", "2026-09-01", 1.97, detail="4X points FOR U")
    s.product("Old gum", "A", "Gum", 10.0, "ct")
    s.product("New gum", "B", "Gum", 10.0, "ct")
    s.add("Old gum", "2026-08-01", 1.527, unit_price=0.1527, merchant="Gum Shop")
    ids["gum"] = s.add("New gum", "2026-09-01", 1.636, unit_price=0.1636, merchant="Gum Shop")
    ids["unpriced"] = s.add("Mystery", "2026-09-01", None)
    ids["coupon"] = s.add("Coupon", "2026-09-01", None, promo="store_coupon")
    rows = {r.deal_id: r for r in evaluate(s.catalog()).collect()}
    return {k: rows[v] for k, v in ids.items()}


def test_badges(evaluated):
    want = {"New low": "NEW_ALL_TIME_LOW", "Hike": "PRICE_HIKE", "Concurrent": "FIRST_SEEN", "Other chain": "FIRST_SEEN",
            "New variety": "NEW_ALL_TIME_LOW", "five points": "POINTS_FREEBIE", "spend": "SPEND_SAVE", "multiplier": "NEW_ALL_TIME_LOW",
            "unpriced": "SEE_AD", "coupon": "STORE_COUPON"}
    assert {k: evaluated[k].badge for k in want} == want


def test_values(evaluated):
    e = evaluated
    assert e["New low"].historical_min == 3.49 and e["Concurrent"].past_observations_count == 0
    assert e["five points"].current_price == 0.0 and e["spend"].current_price == 5.33 and e["spend"].base_price == 7.99
    assert e["New variety"].historical_min == 6.00
    assert (e["gum"].category_min_unit_price, e["gum"].category_avg_unit_price) == (0.1527, 0.1582)
    assert e["New low"].ad_id == "1044979722"
    assert "6.0% back" in e["multiplier"].summary_reason
    assert e["unpriced"].summary_reason == "Price not listed numerically in circular"


def test_episode_rules(spark):
    s = Store(spark)
    for d in ("2026-08-05", "2026-08-12", "2026-08-19"):
        s.add("Corn", d, 0.37)
    s.add("Corn", "2026-08-26", 0.69)
    last = s.add("Corn", "2026-09-02", 0.37)
    c = s.catalog()
    eps = cluster_episodes(star(c), ["product_id"]).orderBy("start_day").collect()
    assert [(e.price, e.observations_count) for e in eps] == [(0.37, 3), (0.69, 1), (0.37, 1)]
    got = {r.deal_id: r.badge for r in evaluate(c).collect()}
    assert got[3] == "CYCLE_REFRESH" and got[last] == "MATCHES_ATL"


def _direct_past(rows, day):
    """Plain restatement of the past of one key, for comparison."""
    past = sorted((r for r in rows if r["day"] < day), key=lambda r: (r["day"], r["seq"]))
    if not past:
        return None
    eps = []
    for r in past:
        gap = (r["day"] - eps[-1]["end"]).days if eps else None
        if eps and abs(r["price"] - eps[-1]["price"]) < 0.005 and 0 <= gap <= 10:
            eps[-1]["end"] = r["end"]
            eps[-1]["trusted"] |= r["trusted"]
            eps[-1]["outlier"] |= r["outlier"]
        else:
            eps.append(dict(r))
    base = [e for e in eps if not e["outlier"]] or eps
    w = [0.5 ** (max(0, (day - e["end"]).days) / 90) * (1 if e["trusted"] else 0.5) for e in base]
    prices = [r["price"] for r in past]
    return (len(past), min(prices), max(prices), min(e["price"] for e in base), max(e["price"] for e in base),
            sum(e["price"] * x for e, x in zip(base, w)) / sum(w))


def test_prefix_statistics_equal_direct_computation(spark):
    rng = random.Random(7)
    rows, seq = [], 0
    for key in range(12):
        day = dt.date(2025, 1, 6)
        for _ in range(25):
            for _ in range(rng.choice([1, 1, 2])):
                seq += 1
                end = day + dt.timedelta(days=rng.choice([0, 3, 6, 6, 6, 20]))
                rows.append(dict(key=key, day=day, end=end, seq=seq, price=rng.choice([1.0, 1.25, 2.0]), trusted=rng.random() < 0.7,
                                 outlier=rng.random() < 0.2))
            day += dt.timedelta(days=rng.choice([1, 3, 7, 7, 15]))
    df = spark.createDataFrame([(r["key"], r["day"], r["end"], r["seq"], r["price"], r["trusted"], r["outlier"]) for r in rows],
                               "key int, day date, end_day date, seq bigint, price double, trusted boolean, outlier boolean")
    got = {(r.key, r.day): r for r in past_stats(df, df.select("key", "day"), ["key"]).collect()}
    for key, day in {(r["key"], r["day"]) for r in rows}:
        want = _direct_past([r for r in rows if r["key"] == key], day)
        if want is None:
            assert (key, day) not in got
            continue
        g = got[(key, day)]
        assert (g.n_past, g.h_min, g.h_max, g.b_min, g.b_max) == want[:5], (key, day)
        assert g.b_avg == pytest.approx(want[5], abs=1e-8)


def fold(rows):
    """Episodes by the literal left-to-right fold over each product's rows."""
    out, last = [], {}
    for r in sorted(rows, key=lambda r: (r.product_id, r.day, r.seq)):
        e = last.get(r.product_id)
        if e and abs(r.price - e["price"]) < 0.005 and 0 <= (r.day - e["end"]).days <= 10:
            e.update(end=r.end_day or e["end"], n=e["n"] + 1, trusted=e["trusted"] or r.trusted)
        else:
            e = last[r.product_id] = dict(key=r.product_id, seq=r.seq, price=r.price, end=r.end_day or r.from_day, n=1, trusted=r.trusted)
            out.append(e)
    return sorted((e["key"], e["seq"], e["price"], e["n"], e["trusted"]) for e in out)


def test_far_ends_have_finite_weights(spark):
    """A circular that never ends weighs as one that ends on the target day."""
    s = Store(spark)
    s.add("p", "2026-01-05", 2.0)
    s.add("p", "2026-01-12", 4.0, days=(dt.date(9999, 12, 31) - dt.date(2026, 1, 12)).days)
    st = star(s.catalog())
    asked = spark.createDataFrame([(dt.date(2026, 3, 2),)], "day date").crossJoin(st.select("product_id").distinct())
    got = past_stats(history_rows(st, ["product_id"]), asked, ["product_id"]).collect()[0]
    gone = 0.5 ** ((dt.date(2026, 3, 2) - dt.date(2026, 1, 11)).days / 90)
    assert got.b_avg == pytest.approx((2.0 * gone + 4.0) / (gone + 1), abs=1e-6)
    assert str(got.last_end) == "9999-12-31"


def test_window_and_fold_episodes_agree(spark):
    rng = random.Random(3)
    s = Store(spark)
    for _ in range(120):
        d = dt.date(2026, 1, 5) + dt.timedelta(days=7 * rng.randrange(30))
        s.add(f"p{rng.randrange(4)}", d.isoformat(), rng.choice([1.0, 2.0]), promo=rng.choice(["standard", "doorbuster"]))
    st = star(s.catalog())
    a = cluster_episodes(st, ["product_id"]).select("product_id", "start_seq", "price", F.col("observations_count"), "is_trusted")
    assert sorted(map(tuple, a.collect())) == fold(history_rows(st, ["product_id"]).collect())
    hashed = st.withColumn("deal_id", F.xxhash64("deal_id"))
    b = cluster_episodes(hashed, ["product_id"]).select("product_id", "start_seq", "price", F.col("observations_count"), "is_trusted")
    assert sorted(map(tuple, b.collect())) == fold(history_rows(hashed, ["product_id"]).collect())
    assert history_rows(st, ["product_id"]).count() == 120
