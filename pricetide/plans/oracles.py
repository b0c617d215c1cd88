"""Independent SQL statements of what the registered queries must return (run by DuckDB on the same files)."""

from __future__ import annotations

from pricetide import vocab as V
from pricetide.plans.views import BADGES

TILES = """
tiles AS (
  SELECT l.*, p_name, p_size, p_brand, p_type, p_retailprice, r_regionkey, r_name AS merchant,
         CAST(date_trunc('week', l_shipdate) AS DATE) AS week,
         CAST(date_diff('day', DATE '1992-01-06', CAST(date_trunc('week', l_shipdate) AS DATE)) // 7 AS BIGINT) AS week_no,
         CAST(round(p_retailprice * 100) AS BIGINT) AS list_cents,
         CAST(round(p_retailprice * 100) AS BIGINT) * (100 - 5 * CAST(round(l_discount * 100) AS BIGINT)) // 100 AS cents
  FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
prod AS (
  SELECT p_partkey AS product_id, CASE WHEN p_size = 50 THEN p_name ELSE p_name || ' ' || p_size || ' oz' END AS canonical_name,
         CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 10 <> 0 THEN p_type END AS category,
         CAST(p_size AS DOUBLE) AS unit_size, CASE WHEN p_partkey % 9 <> 0 THEN 'oz' END AS unit_type,
         CASE WHEN p_partkey % 4 = 0 THEN round(p_retailprice * 100) / 100.0 END AS last_shelf_price
  FROM part),
obs AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 1048576 + l_partkey AS deal_id, r_regionkey * 100000 + week_no AS flyer_id,
         l_partkey AS product_id, l_orderkey * 10 + l_linenumber AS raw_deal_id, l_linenumber AS page_number,
         l_linenumber = 1 AS is_front_page,
         CASE WHEN NOT (l_linenumber = 7 AND l_quantity % 5 = 0) THEN cents / 100.0 END AS advertised_price,
         CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 'doorbuster' WHEN l_orderkey % 16 = 7 THEN 'store_coupon'
              ELSE 'standard' END AS promo_type,
         CASE WHEN l_orderkey % 2 = 0 THEN list_cents / 100.0 END AS base_price,
         CASE WHEN l_suppkey % 4 = 0 THEN p_name END AS ad_title, l_linestatus = 'F' AS is_trusted,
         merchant, week, week_no, week + CAST(CASE WHEN week_no % 6 = 0 THEN 9 ELSE 6 END AS INTEGER) AS week_end,
         l_orderkey % 16 AS kind, l_linenumber, l_orderkey, cents
  FROM tiles),
flyer AS (
  SELECT DISTINCT flyer_id, merchant, week, week_end, week_no, week_no % 5 <> 0 AS is_trusted FROM obs),
star AS (SELECT o.*, canonical_name, brand, category, unit_size, unit_type, last_shelf_price FROM obs o JOIN prod USING (product_id))
"""

FEED = f"""
feed AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 1048576 + l_partkey AS deal_id, r_regionkey * 100000 + week_no AS flyer_id,
         l_partkey AS product_id, canonical_name, brand, category, unit_type, unit_size,
         CASE WHEN NOT (l_linenumber = 7 AND l_quantity % 5 = 0) THEN cents / 100.0 END AS current_price,
         cents / 100.0 / unit_size AS unit_price, l_linenumber AS page_number, l_linenumber = 1 AS is_front_page,
         list_cents / 200.0 AS historical_min, list_cents * 3 / 400.0 AS historical_avg,
         {BADGES!r}[l_orderkey % 15 + 1] AS badge, l_orderkey % 15 AS bno,
         CASE WHEN l_orderkey % 97 = 0 THEN 'meal_deal' WHEN l_orderkey % 41 = 0 THEN 'must_buy' ELSE 'standard' END AS promo_type,
         CASE WHEN l_orderkey % 53 = 0 THEN 'BUY 1 GET 1 FREE' END AS promo_detail,
         l_suppkey % 5 AS tile, l_linenumber = 3 AND l_tax > 0.04 AS is_category_best,
         CASE WHEN l_suppkey % 5 = 1 THEN p_name || ' or more' ELSE p_name END AS raw_title, p_name, l_partkey
  FROM tiles JOIN prod ON l_partkey = product_id),
rate AS (SELECT p_partkey AS product_id, ['love','deal_only','giveaway','hide'][p_partkey % 4 + 1] AS rating FROM part WHERE p_partkey % 5 <> 0),
rated AS (SELECT f.*, rating FROM feed f LEFT JOIN rate USING (product_id)),
ranked AS (SELECT *, CASE badge {" ".join(f"WHEN '{b}' THEN {r}" for b, r in V.BADGE_RANK)} ELSE 99.0 END AS brank,
                  CASE WHEN current_price IS NULL OR current_price = 0 THEN 999.0 ELSE current_price END AS rprice FROM rated),
keyed AS (SELECT *, CASE WHEN promo_type = 'meal_deal' THEN 'meal_deal_p' || page_number ELSE 'ad_' || tile END AS group_key,
                 CAST(round(coalesce(current_price, 0) * 100) AS BIGINT) AS pc FROM ranked),
items AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY flyer_id, group_key, canonical_name, pc ORDER BY brank, rprice, deal_id) = 1)
"""

EPISODES = """
hist AS (SELECT product_id, merchant, week AS day, week_end, deal_id AS seq, advertised_price AS price, is_trusted AS trusted,
                promo_type = 'doorbuster' AS outlier FROM obs WHERE advertised_price IS NOT NULL)
"""


def _islands(keys: str) -> str:
    """Gaps-and-islands over (day, seq) per key: the textbook form of the episode rule."""
    w = f"(PARTITION BY {keys} ORDER BY day, seq)"
    return f"""
lagged AS (SELECT *, lag(price) OVER {w} AS pp, lag(week_end) OVER {w} AS pe FROM hist),
marked AS (SELECT *, CASE WHEN pp IS NOT NULL AND abs(price - pp) < 0.005 AND date_diff('day', pe, day) BETWEEN 0 AND 10
                     THEN 0 ELSE 1 END AS fresh FROM lagged),
numbered AS (SELECT *, sum(fresh) OVER {w} AS ep FROM marked)
"""


def _past(keys: str, hist: str = EPISODES, asked: str = "obs") -> str:
    """Past of every (key, day) by a plain self join of all rows with all earlier rows of the key."""
    return hist + "," + _islands(keys) + f""",
asked AS (SELECT DISTINCT {keys}, week AS qd FROM {asked}),
before AS (SELECT n.*, qd FROM numbered n JOIN asked USING ({keys}) WHERE day < qd),
ep AS (SELECT {keys}, qd, ep, arg_min(price, (day, seq)) AS price, arg_max(week_end, (day, seq)) AS e_end,
              bool_or(trusted) AS trusted, bool_or(outlier) AS outlier FROM before GROUP BY ALL),
base AS (SELECT *, bool_and(outlier) OVER (PARTITION BY {keys}, qd) AS none_left FROM ep),
weighed AS (SELECT *, pow(0.5, greatest(date_diff('day', e_end, qd), 0) / 90.0) * CASE WHEN trusted THEN 1 ELSE 0.5 END AS w
            FROM base WHERE NOT outlier OR none_left),
b AS (SELECT {keys}, qd, min(price) AS b_min, max(price) AS b_max, round(sum(price * w) / sum(w), 9) AS b_avg
      FROM weighed GROUP BY ALL),
o AS (SELECT {keys}, qd, count(*) AS n_past, min(price) AS h_min, max(price) AS h_max,
             arg_max(price, (day, seq)) AS last_price, arg_max(week_end, (day, seq)) AS last_end FROM before GROUP BY ALL),
past AS (SELECT * FROM o JOIN b USING ({keys}, qd))
"""


def exact_round(x: str, digits: int) -> str:
    """IEEE rounding of column ``x``: half-to-even on the binary value, through the exact product error."""
    c, unit = 2 * 10**digits, 10**digits
    hi = f"({x} * 134217729::DOUBLE - ({x} * 134217729::DOUBLE - {x}))"
    err = f"(({hi} * {c} - {x} * {c}) + ({x} - {hi}) * {c})"
    k = f"(({x} * {c} - 1) / 2)"
    return (f"CASE WHEN ({x} * {c}) % 2 = 1 THEN (CASE WHEN {err} > 0 THEN {k} + 1 WHEN {err} < 0 THEN {k} ELSE {k} + {k} % 2 END) / {unit} "
            f"ELSE floor(({x} * {c} + 1) / 2) / {unit} END")


AD_HIST = """
hist AS (SELECT ad_title AS parent, merchant, week AS day, week_end, deal_id AS seq, advertised_price AS price, is_trusted AS trusted,
                promo_type = 'doorbuster' AS outlier FROM obs WHERE advertised_price IS NOT NULL AND ad_title IS NOT NULL
  UNION ALL SELECT canonical_name, merchant, week, week_end, deal_id, advertised_price, is_trusted, promo_type = 'doorbuster' FROM star
         WHERE advertised_price IS NOT NULL AND ad_title IS DISTINCT FROM canonical_name AND canonical_name IN (SELECT p_name FROM part))
"""

#: Evaluation of every deal: scopes of the past, category benchmark, lanes, badges and prices in cents.
EVALUATED = f"""
own AS (WITH {_past("product_id, merchant")} SELECT * FROM past),
wide AS (WITH {_past("product_id")} SELECT * FROM past),
ad AS (WITH {_past("parent, merchant", AD_HIST, "(SELECT ad_title AS parent, merchant, week FROM obs WHERE ad_title IS NOT NULL)")} SELECT * FROM past),
worth AS (SELECT flyer_id, {exact_round('v', 4)} AS pv FROM (
  SELECT flyer_id, round(avg((l_linenumber + 0.5::DOUBLE) / (l_linenumber * 50)), 12) AS v FROM obs WHERE kind = 2 GROUP BY 1)),
upr AS (SELECT *, advertised_price / unit_size AS u FROM star WHERE advertised_price IS NOT NULL AND unit_type IS NOT NULL),
cats AS (SELECT DISTINCT lower(category) AS cat FROM prod WHERE category IS NOT NULL),
filed AS (SELECT lower(category) AS cat, week, u FROM upr WHERE category IS NOT NULL
  UNION ALL SELECT cat, week, u FROM upr JOIN cats ON category IS NULL AND contains(' ' || lower(canonical_name) || ' ', ' ' || cat || ' ')),
bench AS (SELECT cat, qd, count(u) AS n, min(u) AS lo, sum(u) AS total FROM (SELECT DISTINCT lower(category) AS cat, week AS qd FROM upr WHERE category IS NOT NULL)
  JOIN filed USING (cat) WHERE week < qd GROUP BY ALL),
mine AS (SELECT flyer_id, lower(category) AS cat, min(u) AS lo FROM upr WHERE category IS NOT NULL AND l_orderkey % 3 <> 0 AND u > 0 GROUP BY ALL),
lanes AS (
  SELECT s.*, CAST(round(p_retailprice * 100) AS BIGINT) AS list_cents, l_linenumber AS ln, CAST(round(coalesce(pv, 0.0274::DOUBLE) * 10000) AS BIGINT) AS p4, coalesce(pv, 0.0274::DOUBLE) AS pv,
    CASE WHEN own.n_past IS NOT NULL THEN own WHEN unit_type IS NOT NULL AND wide.n_past IS NOT NULL THEN {{'product_id': 0, 'merchant': '', 'qd': s.week, 'n_past': wide.n_past, 'h_min': wide.h_min,
      'h_max': wide.h_max, 'last_price': wide.last_price, 'last_end': wide.last_end, 'b_min': wide.b_min, 'b_max': wide.b_max, 'b_avg': wide.b_avg}}
      WHEN ad.n_past IS NOT NULL THEN {{'product_id': 0, 'merchant': '', 'qd': s.week, 'n_past': ad.n_past, 'h_min': ad.h_min, 'h_max': ad.h_max, 'last_price': ad.last_price, 'last_end': ad.last_end,
      'b_min': ad.b_min, 'b_max': ad.b_max, 'b_avg': ad.b_avg}} END AS h,
    CASE WHEN unit_type IS NOT NULL AND category IS NOT NULL AND advertised_price IS NOT NULL THEN advertised_price / unit_size END AS u,
    least(bench.lo, mine.lo) AS cat_min, round((coalesce(bench.total, 0) + coalesce(mine.lo, 0)) / nullif(coalesce(bench.n, 0) + CASE WHEN mine.lo IS NULL THEN 0 ELSE 1 END, 0), 9) AS cat_avg
  FROM star s JOIN part ON s.product_id = p_partkey LEFT JOIN worth USING (flyer_id)
  LEFT JOIN own ON own.product_id = s.product_id AND own.merchant = s.merchant AND own.qd = s.week
  LEFT JOIN wide ON wide.product_id = s.product_id AND wide.qd = s.week
  LEFT JOIN ad ON ad.parent = s.ad_title AND ad.merchant = s.merchant AND ad.qd = s.week
  LEFT JOIN bench ON bench.cat = lower(category) AND bench.qd = s.week LEFT JOIN mine ON mine.flyer_id = s.flyer_id AND mine.cat = lower(category)),
laned AS (SELECT *, h.n_past AS n_past, advertised_price AS p, CASE WHEN kind = 2 THEN 'redeem' WHEN kind = 3 OR (kind = 6 AND coalesce(advertised_price, 0) <= 0) THEN 'bonus'
  WHEN promo_type = 'store_coupon' THEN 'coupon' WHEN kind = 4 THEN 'spend' WHEN kind = 5 THEN 'percent' WHEN advertised_price IS NULL THEN 'unpriced'
  WHEN h IS NULL THEN 'first' ELSE 'history' END AS lane FROM lanes),
evaluated AS (SELECT *, CASE lane
    WHEN 'redeem' THEN CASE WHEN (ln + 0.5::DOUBLE) / (ln * 50) >= 0.10 THEN 'POINTS_FREEBIE'
      WHEN (ln + 0.5::DOUBLE) / (ln * 50) >= pv * 1.3::DOUBLE AND (ln + 0.5::DOUBLE) / (ln * 50) >= 0.03::DOUBLE THEN 'POINTS_DEAL' ELSE 'POINTS_REDEMPTION' END
    WHEN 'bonus' THEN 'POINTS_REWARD' WHEN 'coupon' THEN 'STORE_COUPON' WHEN 'spend' THEN 'SPEND_SAVE' WHEN 'percent' THEN 'PERCENT_OFF' WHEN 'unpriced' THEN 'SEE_AD'
    WHEN 'first' THEN CASE WHEN u IS NULL OR cat_min IS NULL THEN 'FIRST_SEEN' WHEN u <= cat_min + 0.005 THEN 'NEW_ALL_TIME_LOW' WHEN u <= cat_avg * 0.85::DOUBLE THEN 'BEAT_AVERAGE'
      WHEN u <= cat_avg * 1.15::DOUBLE THEN 'STANDARD_DEAL' ELSE 'FIRST_SEEN' END
    ELSE CASE WHEN abs(p - h.last_price) < 0.005 AND date_diff('day', h.last_end, week) BETWEEN 0 AND 10 THEN CASE WHEN p <= h.h_min AND h.h_max - h.h_min >= 0.05 THEN 'MATCHES_ATL' ELSE 'CYCLE_REFRESH' END
        WHEN p < h.h_min - 0.005 THEN 'NEW_ALL_TIME_LOW' WHEN abs(p - h.h_min) <= 0.005 THEN CASE WHEN h.h_max - h.h_min >= 0.05 THEN 'MATCHES_ATL' ELSE 'CYCLE_REFRESH' END
        WHEN p <= h.b_avg * 0.85::DOUBLE THEN 'BEAT_AVERAGE' WHEN p <= h.b_avg OR abs(p - h.b_min) < 0.05 THEN 'CYCLE_REFRESH'
        WHEN p > h.b_avg * 1.15::DOUBLE OR p > h.b_max THEN 'PRICE_HIKE' ELSE 'STANDARD_DEAL' END END AS badge,
  CASE lane WHEN 'redeem' THEN ln * 50 WHEN 'bonus' THEN CASE WHEN kind = 3 THEN (ln + 19) * 100 - 3 * p4 END
    WHEN 'spend' THEN CASE WHEN p IS NOT NULL THEN greatest(0, CAST(floor(CAST(round(p * 100) AS BIGINT) * (4 * ln - 5) / (4.0 * ln) + 0.5) AS BIGINT)) END
    WHEN 'percent' THEN CASE WHEN (l_orderkey % 2 = 0 OR last_shelf_price IS NOT NULL) AND (list_cents * (100 - 5 * ln)) % 100 <> 50 THEN (2 * list_cents * (100 - 5 * ln) + 100) // 200 END
    WHEN 'first' THEN CAST(round(p * 100) AS BIGINT) WHEN 'history' THEN CAST(round(p * 100) AS BIGINT) END AS price_cents FROM laned)
"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


CHIPS = {
    "atl": "bno IN (1, 2)", "great": "bno IN (1, 2, 7)", "cycle": "bno = 8", "firstseen": "bno = 9", "hike": "bno = 12",
    "front": "is_front_page", "catbest": "is_category_best", "bogo": "promo_type <> 'standard' OR promo_detail IS NOT NULL",
    "points": "bno IN (0, 3, 4, 10)", "favorites": "rating = 'love'",
    "deal_picks": "rating = 'deal_only' AND (bno IN (0, 1, 2, 7) OR is_category_best OR promo_type <> 'standard')",
    "giveaways": "rating = 'giveaway'", "hidden": "rating = 'hide'",
}

SCORE = """30 + CASE WHEN bno = 0 OR current_price = 0 THEN 500 WHEN bno = 1 THEN 300 WHEN bno = 2 THEN 200 WHEN bno = 3 THEN 180
  WHEN is_category_best THEN 150 WHEN bno = 7 THEN 120 WHEN promo_type <> 'standard' OR promo_detail IS NOT NULL THEN 80 ELSE 0 END
  + CASE WHEN is_front_page THEN 40 ELSE 0 END
  + CASE rating WHEN 'love' THEN 350
      WHEN 'deal_only' THEN CASE WHEN bno IN (0,1,2,3,7) OR current_price = 0 OR is_category_best OR promo_type <> 'standard'
                                      OR promo_detail IS NOT NULL THEN 150 ELSE -50 END
      WHEN 'giveaway' THEN CASE WHEN bno = 0 OR current_price = 0 OR current_price <= 0.25 THEN 200 ELSE -200 END ELSE 0 END"""

_BLOB = "concat(canonical_name, ' ', coalesce(brand, ''), ' ', coalesce(raw_title, ''), ' ')"
DEPT = ("CASE " + " ".join(
    f"WHEN regexp_matches({_BLOB}, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{d}'" for p, d in V.DEPARTMENT_TEXT_RULES)
    + " WHEN category IS NULL THEN 'Other' ELSE category END")

SPLIT = """
flags AS (SELECT flyer_id, group_key, count(*) AS n,
   bool_or(promo_type IN ('meal_deal', 'must_buy') OR promo_detail IS NOT NULL) AS bundled,
   count(DISTINCT lower(brand)) AS nb, count(DISTINCT lower(category)) AS nc, count(DISTINCT unit_type) AS nu,
   count(DISTINCT lower(canonical_name)) AS nn, arg_min(raw_title, (brank, rprice, deal_id)) AS raw1
   FROM items GROUP BY ALL),
words AS (SELECT flyer_id, group_key, w, count(*) AS k FROM (
   SELECT flyer_id, group_key, deal_id, unnest(list_distinct(regexp_extract_all(lower(canonical_name), '[a-z]+'))) AS w FROM items)
   WHERE w NOT IN ('oz','lb','ct','pk','pack','select','varieties','assorted') GROUP BY ALL),
common AS (SELECT DISTINCT flyer_id, group_key FROM words JOIN flags USING (flyer_id, group_key) WHERE k = n),
decided AS (SELECT f.*, f.n > 1 AND NOT bundled AND (nb > 1 OR nc > 1 OR (nn > 1 AND (
     (raw1 LIKE '% or %' AND c.flyer_id IS NULL) OR nu > 1))) AS split
   FROM flags f LEFT JOIN common c USING (flyer_id, group_key))
"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    t = TILES
    sql["star_history"] = _with(t) + """ SELECT deal_id, product_id, flyer_id, merchant, CAST(week AS VARCHAR) AS valid_from,
      canonical_name, advertised_price FROM star"""
    sql["history_trusted_ilike"] = _with(t) + """ SELECT deal_id, product_id, advertised_price, page_number FROM star
      WHERE is_trusted AND merchant ILIKE '%meric%'"""
    latest = """latest AS (SELECT merchant, flyer_id FROM flyer QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY week DESC, flyer_id DESC) = 1)"""
    sql["latest_flyer"] = _with(t, latest) + """ SELECT merchant, flyer_id, (SELECT count(*) FROM obs o WHERE o.flyer_id = l.flyer_id) AS deal_count FROM latest l"""
    sql["flyer_deals_front"] = _with(t, latest) + """ SELECT deal_id, flyer_id, page_number, advertised_price, canonical_name FROM star
      WHERE flyer_id IN (SELECT flyer_id FROM latest) AND is_front_page"""
    sql["search_products_top50"] = _with(t) + """ SELECT product_id, canonical_name, brand FROM prod
      WHERE (canonical_name ILIKE '%ring%' OR brand ILIKE '%ring%') AND product_id IN
        (SELECT product_id FROM obs WHERE merchant ILIKE '%asia%')
      ORDER BY canonical_name, product_id LIMIT 50"""
    sql["sync_needed"] = _with(t) + """, best AS (SELECT * FROM flyer QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY week DESC, flyer_id DESC) = 1),
      cnt AS (SELECT flyer_id, count(*) AS deals FROM obs GROUP BY 1)
      SELECT merchant, flyer_id, CASE WHEN DATE '2001-12-20' > week_end OR (DATE '2001-12-20' >= week_end AND week < DATE '2001-12-20') THEN 'expired'
        WHEN deals = 0 THEN 'empty' ELSE 'current' END AS state FROM best JOIN cnt USING (flyer_id)"""
    running = """rng AS (SELECT a.product_id, a.merchant, a.week, count(*) AS n_past, sum(h.pc) AS sum_cents, min(h.pc) AS min_cents, max(h.pc) AS max_cents
      FROM (SELECT DISTINCT product_id, merchant, week FROM obs) a
      JOIN (SELECT product_id, merchant, week, CAST(round(advertised_price * 100) AS BIGINT) AS pc FROM obs WHERE advertised_price IS NOT NULL) h
        ON h.product_id = a.product_id AND h.merchant = a.merchant AND h.week < a.week GROUP BY ALL)"""
    sql["history_min_max"] = _with(t, running) + " SELECT product_id, merchant, CAST(week AS VARCHAR) AS day, n_past, sum_cents, min_cents, max_cents FROM rng"
    sql["price_badges"] = _with(t, running) + """ SELECT deal_id, CAST(round(advertised_price * 100) AS BIGINT) AS cents, n_past, CASE
        WHEN n_past IS NULL THEN 'FIRST_SEEN' WHEN c < min_cents THEN 'NEW_ALL_TIME_LOW'
        WHEN c = min_cents AND max_cents - min_cents >= 5 THEN 'MATCHES_ATL' WHEN c = min_cents THEN 'CYCLE_REFRESH'
        WHEN 100 * c * n_past <= 85 * sum_cents THEN 'BEAT_AVERAGE' WHEN c * n_past <= sum_cents OR c - min_cents < 5 THEN 'CYCLE_REFRESH'
        WHEN 100 * c * n_past > 115 * sum_cents OR c > max_cents THEN 'PRICE_HIKE' ELSE 'STANDARD_DEAL' END AS badge
      FROM (SELECT o.*, CAST(round(advertised_price * 100) AS BIGINT) AS c, n_past, sum_cents, min_cents, max_cents
            FROM obs o LEFT JOIN rng USING (product_id, merchant, week) WHERE advertised_price IS NOT NULL)"""
    episodes = _with(t, EPISODES, _islands("product_id")) + """ SELECT product_id, CAST(min(day) AS VARCHAR) AS start_day, arg_min(seq, (day, seq)) AS start_seq,
      arg_min(price, (day, seq)) AS price, CAST(arg_max(week_end, (day, seq)) AS VARCHAR) AS end_day, count(*) AS observations_count,
      bool_or(trusted) AS is_trusted, bool_or(outlier) AS is_outlier FROM numbered GROUP BY product_id, ep"""
    sql["promo_episodes"] = episodes
    sql["episodes_fold"] = _with(t) + """, hard AS (SELECT CASE WHEN raw_deal_id % 3 = 0 THEN -1 ELSE product_id END AS product_id,
        CASE WHEN raw_deal_id % 3 = 0 AND raw_deal_id % 2 = 0 THEN DATE '1995-01-02' ELSE week END AS day, CASE WHEN raw_deal_id % 5 <> 0 THEN week_end END AS fin,
        CASE WHEN raw_deal_id % 97 = 0 THEN deal_id + 1152921504606846976 ELSE deal_id END AS seq, advertised_price AS price, is_trusted FROM obs WHERE advertised_price IS NOT NULL),
      folds AS (SELECT product_id, list_reduce(list_prepend(
          {'price': -1.0::DOUBLE, 'day': DATE '1900-01-01', 'fin': DATE '1900-01-01', 'episodes': 0::BIGINT, 'n': 0::BIGINT, 'longest': 0::BIGINT, 'starts': 0::BIGINT, 'sure': false, 'trusted': 0::BIGINT},
          list({'price': price::DOUBLE, 'day': day, 'fin': fin, 'episodes': 0::BIGINT, 'n': 0::BIGINT, 'longest': 0::BIGINT, 'starts': 0::BIGINT, 'sure': is_trusted, 'trusted': 0::BIGINT} ORDER BY day, seq)),
        lambda a, x: CASE WHEN abs(x.price - a.price) < 0.005 AND date_diff('day', a.fin, x.day) BETWEEN 0 AND 10
          THEN {'price': x.price, 'day': x.day, 'fin': coalesce(x.fin, a.fin), 'episodes': a.episodes, 'n': a.n + 1, 'longest': greatest(a.longest, a.n + 1), 'starts': a.starts,
                'sure': a.sure OR x.sure, 'trusted': a.trusted + CASE WHEN x.sure AND NOT a.sure THEN 1 ELSE 0 END}
          ELSE {'price': x.price, 'day': x.day, 'fin': coalesce(x.fin, x.day), 'episodes': a.episodes + 1, 'n': 1::BIGINT, 'longest': greatest(a.longest, 1), 'starts': a.starts + date_diff('day', DATE '1970-01-01', x.day),
                'sure': x.sure, 'trusted': a.trusted + CASE WHEN x.sure THEN 1 ELSE 0 END} END) AS f, count(*) AS observations FROM hard GROUP BY 1)
      SELECT product_id, f.episodes AS episodes, observations, f.starts AS start_days, f.longest AS longest, f.trusted AS trusted FROM folds"""
    sql["episodes_hashed_ids"] = _with(t) + """ SELECT product_id, count(*) AS observations, CAST(min(week) AS VARCHAR) AS first_day, min(advertised_price) AS least,
      max(advertised_price) AS most, bool_or(is_trusted) AS is_trusted FROM star WHERE advertised_price IS NOT NULL GROUP BY product_id"""
    past_cols = """CAST(qd AS VARCHAR) AS day, n_past, h_min, h_max, b_min, b_max, round(b_avg, 6) AS b_avg, last_price, CAST(last_end AS VARCHAR) AS last_end FROM past"""
    sql["decayed_average"] = _with(t, _past("product_id, merchant")) + " SELECT product_id, merchant, " + past_cols
    sql["cross_banner_past"] = _with(t, _past("product_id")) + " SELECT product_id, " + past_cols
    sql["historical_badges"] = _with(t, _past("product_id, merchant")) + """ SELECT deal_id, CASE
        WHEN abs(p - last_price) < 0.005 AND date_diff('day', last_end, week) BETWEEN 0 AND 10 THEN CASE WHEN p <= h_min AND h_max - h_min >= 0.05 THEN 'MATCHES_ATL' ELSE 'CYCLE_REFRESH' END
        WHEN p < h_min - 0.005 THEN 'NEW_ALL_TIME_LOW' WHEN abs(p - h_min) <= 0.005 THEN CASE WHEN h_max - h_min >= 0.05 THEN 'MATCHES_ATL' ELSE 'CYCLE_REFRESH' END
        WHEN p <= b_avg * 0.85::DOUBLE THEN 'BEAT_AVERAGE' WHEN p <= b_avg OR abs(p - b_min) < 0.05 THEN 'CYCLE_REFRESH'
        WHEN p > b_avg * 1.15::DOUBLE OR p > b_max THEN 'PRICE_HIKE' ELSE 'STANDARD_DEAL' END AS badge
      FROM (SELECT *, advertised_price AS p FROM obs WHERE advertised_price IS NOT NULL) o
      JOIN past ON past.product_id = o.product_id AND past.merchant = o.merchant AND past.qd = o.week"""
    sql["evaluation_badges"] = _with(t, EVALUATED) + """ SELECT deal_id, badge, price_cents, CASE WHEN lane = 'first' THEN 0 ELSE coalesce(n_past, 0) END AS n_past,
      CASE WHEN lane = 'history' THEN CAST(round(h.h_min * 100) AS BIGINT) ELSE price_cents END AS min_cents,
      CASE WHEN lane = 'history' THEN CAST(round(h.h_max * 100) AS BIGINT) ELSE price_cents END AS max_cents FROM evaluated"""
    unit = "up AS (SELECT *, advertised_price / unit_size AS u FROM star WHERE advertised_price IS NOT NULL AND unit_type IS NOT NULL)"
    sql["category_benchmark"] = _with(t, unit) + """, cats AS (SELECT DISTINCT lower(category) AS cat FROM prod WHERE category IS NOT NULL),
      filed AS (SELECT lower(category) AS cat, unit_type, week, u FROM up WHERE category IS NOT NULL
                UNION ALL SELECT cat, unit_type, week, u FROM up JOIN cats ON category IS NULL AND contains(' ' || lower(canonical_name) || ' ', ' ' || cat || ' ')),
      asked AS (SELECT DISTINCT lower(category) AS cat, unit_type, week AS qd FROM star WHERE category IS NOT NULL AND unit_type IS NOT NULL AND advertised_price IS NOT NULL)
      SELECT cat, unit_type, CAST(qd AS VARCHAR) AS day, count(u) AS cat_n, CAST(floor(min(u) * 1000 + 1e-6) AS BIGINT) AS cat_milli, CAST(floor(sum(u) + 1e-4) AS BIGINT) AS cat_sum
      FROM asked LEFT JOIN filed USING (cat, unit_type) WHERE week IS NULL OR week < qd GROUP BY ALL"""
    sql["flyer_category_min"] = _with(t, unit) + """ SELECT flyer_id, lower(category) AS cat, CAST(floor(min(u) * 1000 + 1e-6) AS BIGINT) AS flyer_milli FROM up WHERE category IS NOT NULL GROUP BY ALL"""
    sql["promo_extract"] = _with(t) + """, k AS (SELECT deal_id, kind, l_linenumber AS n, cents / 100.0 AS price FROM obs)
      SELECT deal_id, CASE kind WHEN 0 THEN 'bogo' WHEN 1 THEN 'must_buy' WHEN 2 THEN 'points_redemption' WHEN 3 THEN 'points_bonus'
          WHEN 4 THEN 'spend_save' WHEN 5 THEN 'percent_off' WHEN 6 THEN 'points_bonus' WHEN 8 THEN 'digital_coupon' WHEN 9 THEN 'digital_coupon'
          WHEN 10 THEN 'dollar_off' END AS promo_type,
        CASE kind WHEN 0 THEN n + 1 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 8 THEN 1
          WHEN 9 THEN 1 WHEN 10 THEN 1 END AS qualifying_qty,
        CASE kind WHEN 1 THEN price WHEN 2 THEN 0.0 END AS stated_unit_price, CASE kind WHEN 9 THEN price END AS coupon_price,
        CASE kind WHEN 4 THEN 5.0 WHEN 8 THEN n + 0.25 WHEN 10 THEN n * 1.0 END AS coupon_discount,
        CASE kind WHEN 2 THEN n * 50 END AS points_cost, CASE kind WHEN 2 THEN n + 0.5 END AS points_saved_val,
        CASE kind WHEN 3 THEN 300 END AS points_bonus, CASE kind WHEN 6 THEN n * 1.0 END AS points_multiplier,
        CASE kind WHEN 3 THEN n + 19.0 WHEN 4 THEN n * 4.0 END AS spend_threshold, CASE kind WHEN 3 THEN 8.22 END AS est_reward_val,
        CASE kind WHEN 3 THEN round(n + 19.0 - 8.22, 2) WHEN 4 THEN CASE WHEN n * 4 > 5 THEN n * 4.0 - 5 END END AS est_net_price
      FROM k"""
    sql["effective_price"] = _with(t) + """, k AS (SELECT deal_id, kind, l_linenumber AS n, cents, CAST(round(p_retailprice * 100) AS BIGINT) AS base
        FROM obs JOIN part ON product_id = p_partkey)
      SELECT deal_id, CASE kind WHEN 0 THEN (2 * base * n + n + 1) // (2 * (n + 1)) WHEN 1 THEN cents WHEN 2 THEN 0 WHEN 3 THEN n * 100 + 1900 - 822
        WHEN 4 THEN CASE WHEN n * 4 > 5 THEN CAST(floor(base * (n * 4 - 5) / (n * 4.0) + 0.5) AS BIGINT) ELSE base END
        WHEN 5 THEN (2 * base * (100 - 5 * n) + 100) // 200 WHEN 8 THEN base - n * 100 - 25 WHEN 9 THEN cents WHEN 10 THEN base - n * 100 END AS effective_cents
      FROM k"""
    sql["dynamic_point_value"] = _with(t) + f""" SELECT flyer_id, {exact_round('v', 4)} AS point_value FROM (
      SELECT flyer_id, round(avg((l_linenumber + 0.5::DOUBLE) / (l_linenumber * 50)), 12) AS v FROM obs WHERE kind = 2 GROUP BY 1)"""
    sql["points_tiers"] = _with(t) + """, k AS (SELECT deal_id, kind, l_linenumber * 50 AS pts, (l_linenumber + 0.5) / (l_linenumber * 50) AS y FROM obs)
      SELECT deal_id, CASE WHEN kind <> 2 THEN NULL WHEN y >= 0.10 THEN 'POINTS_FREEBIE' WHEN y >= 0.0274 * 1.3 AND y >= 0.03 THEN 'POINTS_DEAL' ELSE 'POINTS_REDEMPTION' END AS tier FROM k"""
    f = (TILES, FEED)
    sql["group_items"] = _with(*f) + " SELECT flyer_id, group_key, deal_id, canonical_name FROM items"
    sql["group_split"] = _with(*f, SPLIT) + " SELECT flyer_id, group_key, n, split FROM decided"
    sql["representatives"] = _with(*f) + f""" SELECT flyer_id, group_key, count(*) AS n_items, min(current_price) AS min_price, max(current_price) AS max_price,
        bool_or(is_front_page) AS is_front_page, arg_min(deal_id, (prio, brank, rprice, deal_id)) AS representative FROM (
        SELECT *, CASE WHEN bno = 0 THEN 0 WHEN bno = 1 THEN 1 WHEN bno = 2 THEN 2 WHEN is_category_best THEN 4 WHEN bno IN (3, 4) THEN 5 WHEN bno = 5 THEN 6
          WHEN bno = 6 THEN 7 WHEN bno = 7 THEN 8 WHEN bno = 8 THEN 9 WHEN bno = 11 THEN 10 WHEN bno = 9 THEN 11 WHEN bno = 12 THEN 12 WHEN bno = 13 THEN 13
          ELSE 20 END AS prio FROM items) GROUP BY flyer_id, group_key"""
    sql["modal_units"] = _with(*f) + """, u AS (SELECT flyer_id, group_key, unit_type, count(*) AS k, min(unit_price) AS lo, max(unit_price) AS hi FROM items WHERE unit_type IS NOT NULL GROUP BY ALL)
      SELECT flyer_id, group_key, unit_type, CAST(floor(lo * 1000 + 1e-6) AS BIGINT) AS lo, CAST(floor(hi * 1000 + 1e-6) AS BIGINT) AS hi FROM u"""
    # one pass of absorption; in these tables no absorbed name lets a later tile qualify, so it is the whole outcome
    sql["meal_deal_merge"] = _with(*f) + """, g AS (SELECT flyer_id, group_key, count(*) AS n, min((brank, rprice, deal_id)) AS pos FROM items GROUP BY ALL),
      meal AS (SELECT flyer_id, group_key AS meal_key, pos AS meal_pos FROM g WHERE group_key LIKE 'meal_deal_%'),
      own AS (SELECT DISTINCT flyer_id, group_key AS meal_key, canonical_name FROM items WHERE group_key LIKE 'meal_deal_%'),
      score AS (SELECT i.flyer_id, i.group_key, meal_key, count(*) AS m FROM items i JOIN own USING (flyer_id, canonical_name) WHERE i.group_key NOT LIKE 'meal_deal_%' GROUP BY ALL),
      taken AS (SELECT flyer_id, group_key, arg_min(meal_key, meal_pos) AS meal_key FROM score JOIN g USING (flyer_id, group_key) JOIN meal USING (flyer_id, meal_key)
        WHERE m >= least(3, n) AND m / n >= 0.7 GROUP BY ALL),
      fresh AS (SELECT flyer_id, meal_key, count(DISTINCT canonical_name) AS k FROM items JOIN taken USING (flyer_id, group_key) ANTI JOIN own USING (flyer_id, meal_key, canonical_name) GROUP BY ALL)
      SELECT g.flyer_id, group_key, n + coalesce(k, 0) AS n FROM g ANTI JOIN taken USING (flyer_id, group_key) LEFT JOIN fresh ON fresh.flyer_id = g.flyer_id AND fresh.meal_key = g.group_key"""
    sql["group_brands"] = _with(*f) + """ SELECT flyer_id, group_key, array_to_string(list_sort(list(DISTINCT brand)), '|') AS brands, count(DISTINCT brand) AS n_brands FROM items
      WHERE brand IS NOT NULL GROUP BY ALL"""
    sql["split_titles"] = _with(*f, SPLIT) + """ SELECT deal_id, canonical_name AS title FROM items JOIN decided USING (flyer_id, group_key) WHERE split"""
    sql["export_rows"] = _with(*f) + """ SELECT deal_id, product_id, CAST(tile AS VARCHAR) AS ad_id, CAST(NULL AS VARCHAR) AS ad_title, deal_id // 1048576 AS raw_deal_id, canonical_name AS name, brand,
        coalesce(category, 'Other') AS category, current_price AS price, unit_price, unit_size, unit_type, page_number AS page, is_front_page, historical_min, historical_avg,
        0.0::DOUBLE AS diff_pct_vs_avg, badge, CASE WHEN bno = 1 THEN 'New All-Time Low!' ELSE 'Past sale range' END AS analysis, promo_type, promo_detail, raw_title,
        CAST(NULL AS VARCHAR) AS image_url, is_category_best FROM feed"""
    sql["chip_filters"] = _with(*f) + " SELECT " + ", ".join(
        f"count(*) FILTER (WHERE {cond}) AS {name}" for name, cond in CHIPS.items()) + " FROM rated"
    sql["featured_score"] = _with(*f) + f" SELECT deal_id, {SCORE} AS score FROM rated"
    sql["unique_products"] = _with(*f) + """, named AS (SELECT *, CASE WHEN product_id <> 0 THEN 'pid_' || product_id
        ELSE 'name_' || substr(regexp_replace(lower(canonical_name), '[^a-z0-9]', '_', 'g'), 1, 50) END AS product_key FROM ranked)
      SELECT product_key, arg_min(badge, (brank, rprice, deal_id)) AS badge, arg_min(is_front_page, (brank, rprice, deal_id)) AS is_front_page, min(current_price) AS price,
        arg_min(deal_id, (coalesce(current_price, 1e300), brank, rprice, deal_id)) AS deal_id FROM named GROUP BY product_key"""
    sql["ratings_counts"] = _with(*f) + """, c AS (SELECT count(*) FILTER (WHERE rating = 'love') AS love, count(*) FILTER (WHERE rating = 'deal_only') AS deal_only,
        count(*) FILTER (WHERE rating = 'giveaway') AS giveaway, count(*) FILTER (WHERE rating = 'hide') AS hide, count(*) AS rated FROM rate)
      SELECT *, greatest(0, (SELECT count(DISTINCT product_id) FROM feed) - rated) AS unrated FROM c"""
    sql["stats_banner"] = _with(*f) + """ SELECT count(*) AS total, count(*) FILTER (WHERE bno IN (1, 2)) AS atl, count(*) FILTER (WHERE is_front_page) AS front_page,
        count(*) FILTER (WHERE is_category_best) AS category_best FROM feed"""
    sql["department_facets"] = _with(*f) + f""" SELECT {DEPT} AS department, count(*) AS n FROM feed GROUP BY 1"""
    sql["token_search"] = _with(*f) + """ SELECT deal_id FROM rated WHERE lower(concat_ws(' ', canonical_name, brand, category)) LIKE '%small%'
        AND lower(concat_ws(' ', canonical_name, brand, category)) LIKE '%ring%'"""
    sql["digest_sections"] = _with(*f) + """ SELECT section, count(*) AS n, count(DISTINCT flyer_id) AS flyers FROM (SELECT flyer_id, CASE WHEN bno = 14 THEN 'coupons' WHEN is_front_page THEN 'front_page'
        END AS section FROM feed UNION ALL SELECT flyer_id, 'inside_hikes' FROM feed WHERE bno = 12 AND NOT is_front_page
        UNION ALL SELECT flyer_id, 'inside_lows' FROM feed WHERE bno <> 14 AND NOT is_front_page AND (bno IN (1, 2) OR is_category_best)) WHERE section IS NOT NULL GROUP BY 1"""
    sql["deal_ranking"] = _with(*f) + """ SELECT flyer_id, deal_id, row_number() OVER (PARTITION BY flyer_id ORDER BY brank, rprice, deal_id) AS place FROM ranked"""
    sql["history_callout"] = _with(*f) + """ SELECT deal_id, CASE WHEN bno IN (1, 2) OR current_price <= historical_min THEN 'best' WHEN historical_min < current_price THEN 'range' END AS callout,
        CASE WHEN bno NOT IN (1, 2) AND historical_min < current_price AND current_price >= historical_avg * 1.05 THEN 'near_average'
             WHEN bno NOT IN (1, 2) AND historical_min < current_price AND floor((current_price - historical_min) / historical_min * 100 + 0.5) >= 25 THEN 'modest' END AS warning
      FROM feed WHERE current_price IS NOT NULL"""
    chips = {"all": "true", "beat": CHIPS["great"]} | CHIPS
    sql["group_chips"] = _with(*f) + " SELECT chip, count(*) AS groups, sum(flyer_id)::BIGINT AS flyers FROM (" + " UNION ALL ".join(
        f"SELECT '{name}' AS chip, flyer_id, group_key FROM items GROUP BY ALL HAVING bool_or(coalesce({cond}, false))" + ("" if name == "hidden" else " AND NOT bool_and(coalesce(rating = 'hide', false))")
        for name, cond in chips.items()) + ") GROUP BY 1"
    sql["group_departments"] = _with(*f) + f""" SELECT flyer_id, group_key, count(*) AS n_items FROM (SELECT *, {DEPT} AS dept FROM items) GROUP BY ALL
      HAVING bool_or(is_category_best) AND bool_or(dept = 'Health & Beauty') AND NOT bool_and(coalesce(rating = 'hide', false))"""
    place = lambda key, order: f"row_number() OVER (PARTITION BY flyer_id ORDER BY {order}, {key})"
    sql["flat_sorts"] = _with(*f) + ", k AS (SELECT *, " + SCORE + " AS score FROM rated WHERE rating IS DISTINCT FROM 'hide') SELECT flyer_id, deal_id, " + ", ".join(
        f"{place('deal_id', order)}::INT AS {name}" for name, order in {
            "unit_price_asc": "coalesce(unit_price, 999999)", "price_asc": "coalesce(current_price, 999999)", "price_desc": "coalesce(current_price, -1) DESC",
            "page_asc": "page_number", "name_asc": "lower(canonical_name)", "featured": "score DESC, page_number"}.items()) + " FROM k"
    sql["group_sorts"] = _with(*f) + """, units AS (SELECT flyer_id, group_key, unit_type, count(*) AS k, min((brank, rprice, deal_id)) AS p, min(unit_price) AS lo FROM items WHERE unit_type IS NOT NULL GROUP BY ALL),
      mode AS (SELECT flyer_id, group_key, arg_min(lo, (-k, p)) AS lo FROM units GROUP BY ALL),
      g AS (SELECT flyer_id, group_key, min(current_price) AS a, max(current_price) AS b, arg_min(page_number, (brank, rprice, deal_id)) AS page, any_value(lo) AS lo,
          30 + CASE WHEN bool_or(bno = 0) OR (group_key LIKE 'meal_deal_%' AND bool_or(coalesce(current_price = 0, false))) THEN 500 WHEN bool_or(bno = 1) THEN 300 WHEN bool_or(bno = 2) THEN 200
            WHEN bool_or(bno = 3) THEN 180 WHEN bool_or(is_category_best) THEN 150 WHEN bool_or(bno = 7) THEN 120 WHEN bool_or(promo_type <> 'standard' OR promo_detail IS NOT NULL) THEN 80 ELSE 0 END
          + CASE WHEN bool_or(is_front_page) THEN 40 ELSE 0 END
          + CASE WHEN bool_or(coalesce(rating = 'love', false)) THEN 350
              WHEN bool_or(coalesce(rating = 'deal_only', false)) THEN CASE WHEN bool_or(coalesce(rating = 'deal_only', false) AND (bno IN (0, 1, 2, 7) OR is_category_best OR promo_type <> 'standard')) THEN 150 ELSE -50 END
              WHEN bool_or(coalesce(rating = 'giveaway', false)) THEN CASE WHEN bool_or(coalesce(rating = 'giveaway', false) AND (current_price IS NULL OR current_price <= 0.25 OR bno = 0)) THEN 200 ELSE -200 END ELSE 0 END AS score
        FROM items LEFT JOIN mode USING (flyer_id, group_key) GROUP BY flyer_id, group_key)
      SELECT flyer_id, group_key, """ + ", ".join(f"{place('group_key', order)}::INT AS {name}" for name, order in {
        "unit_price_asc": "coalesce(lo, 999999)", "price_asc": "coalesce(a, 999999)", "price_desc": "coalesce(b, -1) DESC", "page_asc": "page",
        "name_asc": "lower(group_key)", "featured": "score DESC, page"}.items()) + " FROM g"
    sql["badge_labels"] = _with(*f) + """, k AS (SELECT *, bno = 0 OR coalesce(current_price = 0, false) AS is_free, coalesce(rating IN ('love', 'deal_only'), false) AS named,
          coalesce(historical_avg > 0 AND current_price > historical_avg * 1.15::DOUBLE, false) AS dear FROM rated)
      SELECT deal_id, concat_ws(' | ',
        CASE rating WHEN 'love' THEN 'FAVORITE • ' || CASE WHEN is_free THEN 'FREE W/ POINTS' WHEN bno = 1 THEN 'NEW ALL-TIME LOW' WHEN bno = 2 THEN 'MATCHES ATL' WHEN bno = 3 THEN 'HIGH-YIELD POINTS'
            WHEN is_category_best THEN 'BEST IN CATEGORY' WHEN bno = 7 THEN 'GREAT DEAL' WHEN bno = 12 OR dear THEN 'MODEST DEAL' ELSE 'ROUTINE SALE' END
          WHEN 'deal_only' THEN concat_ws(' • ', 'DEAL PICK', CASE WHEN is_free THEN 'FREE W/ POINTS' WHEN bno = 1 THEN 'NEW ALL-TIME LOW' WHEN bno = 2 THEN 'ALL-TIME LOW' WHEN bno = 3 THEN 'HIGH-YIELD'
            WHEN is_category_best OR bno = 7 THEN 'GREAT DEAL' END)
          WHEN 'giveaway' THEN 'GIVEAWAY' WHEN 'hide' THEN 'HIDDEN' END,
        CASE WHEN NOT named THEN CASE bno WHEN 1 THEN 'NEW ALL-TIME LOW' WHEN 2 THEN 'MATCHES ATL' WHEN 0 THEN 'FREE W/ POINTS' WHEN 7 THEN 'GREAT DEAL' WHEN 3 THEN 'HIGH-YIELD POINTS' END END,
        CASE WHEN NOT named AND is_category_best THEN 'CAT BEST' END,
        CASE bno WHEN 4 THEN 'POINTS REWARD' WHEN 10 THEN 'REDEEM POINTS' WHEN 5 THEN 'SPEND & SAVE' WHEN 6 THEN '% OFF' WHEN 8 THEN 'CYCLE MATCH'
          WHEN 12 THEN CASE WHEN rating IS DISTINCT FROM 'love' THEN 'PRICE HIKE' END WHEN 9 THEN 'FIRST SEEN' END) AS badges FROM k"""
    # the category average is 1.3 times the unit price, so every other deal is 23 % below it; the least price is half the list price, less half a cent where that is odd
    sql["compact_tags"] = _with(*f) + """ SELECT deal_id, concat_ws(' • ', CASE WHEN promo_type = 'must_buy' AND promo_detail IS NOT NULL THEN '📦 ' || promo_detail END,
        CASE WHEN is_category_best THEN '🏆 Cat Best' ELSE '🔥 -23% cat avg' END,
        CASE WHEN bno IN (1, 2) THEN CASE WHEN abs(coalesce(current_price, 0) - historical_min) <= 0.005::DOUBLE THEN '🌟 Matches ATL' ELSE '🌟 ATL' END WHEN bno = 12 THEN '⚠️ +12% vs avg' WHEN bno = 7 THEN '🔥 12% vs avg' END) AS tags FROM feed"""
    sql["viewer_flags"] = _with(*f) + """ SELECT flyer_id, group_key, bool_or(bno IN (1, 2)) AS has_atl, bool_or(is_category_best) AS has_cat_best, bool_or(coalesce(rating = 'love', false)) AS has_loved,
        bool_and(coalesce(rating = 'hide', false)) AS all_hidden, min(current_price) AS min_price FROM items GROUP BY ALL"""
    hkey = r"""trim(regexp_replace(trim(regexp_replace(regexp_replace(canon, '\b\d+(\.\d+)?\s*(oz|ounce)\.?\b', '', 'gi'), '\s+', ' ', 'g')), '^[ ,.-]+|[ ,.-]+$', '', 'g'))"""
    sql["history_group_key"] = _with(t) + f""" SELECT deal_id, lower({hkey}) AS group_key, {hkey} AS title FROM (SELECT deal_id, CASE WHEN ad_title IS NOT NULL THEN ad_title ELSE canonical_name END AS canon FROM star)"""
    sql["grouped_timeline"] = _with(t) + f""", g AS (SELECT *, lower({hkey}) AS group_key FROM (SELECT *, CASE WHEN ad_title IS NOT NULL THEN ad_title ELSE canonical_name END AS canon FROM star))
      SELECT group_key, flyer_id, min(advertised_price) AS min_price, max(advertised_price) AS max_price, bool_or(is_front_page) AS is_front_page, bool_and(is_trusted) AS is_trusted,
        bool_or(promo_type = 'doorbuster') AS is_doorbuster, count(DISTINCT page_number) AS n_pages, count(DISTINCT canonical_name) AS n_varieties, count(*) AS observations FROM g GROUP BY ALL"""
    placed = """it AS (SELECT r_regionkey * 100000 + week_no AS flyer_id, l_orderkey * 10 + l_linenumber AS item_id, l_partkey AS part, (l_partkey % 53) * 10.0 AS l,
        CASE WHEN l_linenumber <> 4 THEN (l_partkey % 53) * 10.0 + l_quantity ELSE 0.0 END AS r, l_linenumber % 3 <> 0 AS priced, p_name, l_partkey % 53 < 12 AS long_run FROM tiles),
      mid AS (SELECT *, CASE WHEN l <> 0 AND r <> 0 THEN (l + r) / 2 ELSE l END AS x FROM it),
      placed AS (SELECT *, CASE WHEN x >= 0 AND x - floor(x / 100) * 100 <= 90 AND floor(x / 100) < 5 THEN CAST(floor(x / 100) AS INTEGER) + 1 ELSE 1 END AS page_number FROM mid)"""
    sql["page_assignment"] = _with(t, placed) + " SELECT flyer_id, item_id, part, page_number FROM placed"
    sql["front_page_detect"] = _with(t, placed) + """, pg AS (SELECT flyer_id, page_number, count(*) AS n, count(*) FILTER (WHERE NOT long_run) AS weekly, count(*) FILTER (WHERE priced) AS priced FROM placed GROUP BY ALL),
      ok AS (SELECT flyer_id, min(page_number) AS p FROM pg WHERE weekly > 0 AND n < 4 GROUP BY 1)
      SELECT flyer_id, coalesce(p, 1) AS front_page FROM (SELECT DISTINCT flyer_id FROM placed) LEFT JOIN ok USING (flyer_id)"""
    sql["overlap_purge"] = _with(t) + """ SELECT DISTINCT o.flyer_id FROM flyer o JOIN flyer n ON o.merchant = n.merchant AND o.flyer_id <> n.flyer_id AND n.is_trusted AND NOT o.is_trusted
        AND o.week_end >= n.week AND o.week <= n.week_end"""
    sql["orphans"] = _with(t) + " SELECT product_id FROM prod WHERE product_id NOT IN (SELECT product_id FROM obs WHERE promo_type = 'doorbuster')"
    sql["upsert_observations"] = _with(t) + """ SELECT flyer_id, product_id, raw_deal_id, max(CAST(round(advertised_price * 100) AS BIGINT)) FILTER (WHERE true) AS top_cents, 1 AS n FROM
        (SELECT *, row_number() OVER (PARTITION BY flyer_id, product_id, raw_deal_id ORDER BY cents DESC) AS r FROM obs) WHERE r = 1 GROUP BY ALL"""
    sql["merge_products"] = _with(t) + """ SELECT canonical_name, arg_max(brand, (product_id)) FILTER (WHERE brand IS NOT NULL) AS brand,
        arg_max(category, (product_id)) FILTER (WHERE category IS NOT NULL) AS category, arg_max(unit_type, product_id) FILTER (WHERE unit_type IS NOT NULL) AS unit_type FROM prod GROUP BY 1"""
    sql["trust_marks"] = _with(t, latest) + " SELECT is_trusted, count(*) AS n FROM (SELECT CASE WHEN flyer_id IN (SELECT flyer_id FROM latest) THEN is_trusted ELSE false END AS is_trusted FROM obs) GROUP BY 1"
    ladder = """, pr AS (SELECT *, coalesce(base_price, advertised_price) AS hp FROM star WHERE base_price > 0 OR advertised_price > 0),
      bp AS (SELECT product_id, arg_max(hp, deal_id) AS p FROM pr GROUP BY 1), bn AS (SELECT canonical_name, arg_max(hp, deal_id) AS p FROM pr GROUP BY 1),
      un AS (SELECT s.deal_id, s.flyer_id, s.page_number, last_shelf_price, coalesce(bp.p, bn.p) AS own, coalesce(brand, array_to_string(list_filter(str_split(
               regexp_replace(s.canonical_name, '\\b\\d+ oz.*', ''), ' '), lambda x: x <> '')[1:2], ' ')) AS term
             FROM star s LEFT JOIN bp USING (product_id) LEFT JOIN bn ON bn.canonical_name = s.canonical_name WHERE advertised_price IS NULL),
      tm AS (SELECT flyer_id, term, arg_min(last_shelf_price, (page_number, deal_id)) FILTER (WHERE last_shelf_price > 0) AS a, arg_min(own, (page_number, deal_id)) FILTER (WHERE own IS NOT NULL) AS b FROM un GROUP BY ALL),
      ladder AS (SELECT deal_id, term, coalesce(a, b) AS shelf_price FROM un JOIN tm USING (flyer_id, term))"""
    sql["shelf_price_ladder"] = _with(t) + ladder + " SELECT deal_id, term, shelf_price FROM ladder"
    sql["enriched_prices"] = _with(t) + ladder + """, k AS (SELECT deal_id, kind, l_linenumber AS n, cents, CAST(round(shelf_price * 100) AS BIGINT) AS base FROM obs JOIN ladder USING (deal_id) WHERE shelf_price > 0)
      SELECT deal_id, CASE kind WHEN 0 THEN (2 * base * n + n + 1) // (2 * (n + 1)) WHEN 1 THEN cents WHEN 2 THEN 0 WHEN 3 THEN n * 100 + 1900 - 822
        WHEN 4 THEN CASE WHEN n * 4 > 5 THEN CAST(floor(base * (n * 4 - 5) / (n * 4.0) + 0.5) AS BIGINT) ELSE base END
        WHEN 5 THEN (2 * base * (100 - 5 * n) + 100) // 200 WHEN 8 THEN base - n * 100 - 25 WHEN 9 THEN cents WHEN 10 THEN base - n * 100 END AS advertised_cents, base AS base_cents
      FROM k WHERE kind IN (0, 1, 2, 3, 4, 5, 8, 9, 10)"""
    sql["free_stacks"] = """SELECT c_custkey AS stack_id, greatest(0, floor(c_acctbal) % 7 - 3) AS pay, (greatest(0, floor(c_acctbal) % 7 - 3) <= 0) AS is_free FROM customer
      WHERE greatest(0, floor(c_acctbal) % 7 - 3) <= 1"""
    sql["coupon_upsert"] = """WITH fresh AS (SELECT c_nationkey AS k, arg_max(c_acctbal, c_custkey) AS discount FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1),
      had AS (SELECT CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE n_nationkey + 100 END AS INT) AS k, n_name AS account, CAST(n_nationkey AS BIGINT) AS kept_id FROM nation)
      SELECT CAST(coalesce(f.k, h.k) AS INT) AS k, coalesce(f.discount, 0.5) AS discount, 1 AS n, account, kept_id, 0 AS without_id FROM fresh f FULL JOIN had h ON f.k = h.k
      UNION ALL SELECT -1, sum(0.0), count(*), NULL, NULL, 0 FROM customer WHERE c_custkey % 7 = 0"""
    sql["unit_info"] = _with(t) + """ SELECT product_id, CASE WHEN canonical_name LIKE '% oz' THEN unit_size END AS size, CASE WHEN canonical_name LIKE '% oz' THEN 'oz' END AS unit FROM prod"""
    sql["episode_sessions"] = """WITH e AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM events),
      n AS (SELECT *, sum(s) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS g FROM e) SELECT user_id AS product_id, count(DISTINCT (event_type, g)) AS sessions FROM n GROUP BY 1"""
    b4 = "['Progresso','Knorr','Lipton','Swanson'][p_partkey % 4 + 1]"
    b3 = "['Barilla','Kraft','Quaker'][p_partkey % 3 + 1]"
    cents = "CAST(round(p_retailprice * 100) AS BIGINT) AS cents, 'standard' AS promo_type"
    sql["disaggregate"] = f"""
      SELECT p_partkey AS raw_deal_id, {b4} || ' Soup ' || (p_size + 1) || ' oz' AS canonical_name, {b4} AS brand, p_size + 1.0 AS unit_size, 'oz' AS unit_type, 'Soup' AS category, {cents} FROM part WHERE p_partkey % 3 = 0
      UNION ALL SELECT p_partkey, {b3} || ' Pasta 16 oz', {b3}, 16.0, 'oz', 'Pasta', {cents} FROM part WHERE p_partkey % 3 = 0
      UNION ALL SELECT p_partkey, 'Lucerne ' || v || ' Cheese ' || CASE WHEN p_size = 7 THEN '6-8 oz' ELSE (p_size + 1) || ' oz' END, 'Lucerne', CASE WHEN p_size = 7 THEN 7.0 ELSE p_size + 1.0 END, 'oz', v || ' Cheese', {cents}
        FROM part, (VALUES ('Chunk'), ('Shredded'), ('Sliced')) t(v) WHERE p_partkey % 3 = 1
      UNION ALL SELECT p_partkey, v || ' ' || (p_size + 1) || ' oz', v, p_size + 1.0, 'oz', NULL, {cents} FROM part, (VALUES ('Doritos'), ('Tostitos')) t(v) WHERE p_partkey % 3 = 2"""
    sql["title_tokens"] = """SELECT p_partkey AS item_id, kind, n FROM part, (VALUES (0, 'B', 2), (0, 'H', 2), (0, 'U', 2), (0, 'C', 2), (0, 'W', 2),
        (1, 'B', 1), (1, 'W', 3), (1, 'C', 1), (1, 'O', 1), (1, 'H', 1), (1, 'U', 1), (2, 'B', 2), (2, 'C', 1), (2, 'U', 1)) t(m, kind, n) WHERE p_partkey % 3 = m"""
    sql["clean_titles"] = _with(t) + " SELECT product_id, canonical_name AS title FROM prod"
    sql["categories"] = """SELECT category, count(*) AS n FROM (SELECT unnest(CASE p_partkey % 3 WHEN 0 THEN ['Soup', 'Pasta', NULL] WHEN 1 THEN [NULL, 'Sliced Cheese'] ELSE [NULL, NULL] END) AS category FROM part) GROUP BY 1"""
    edge_l, edge_r = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
    words = " ".join(f"WHEN regexp_matches(low, '{edge_l}{k}{edge_r}') THEN '{d}'" for k, d in V.DEPARTMENT_KEYWORDS)
    sql["document_departments"] = f"""SELECT * FROM (SELECT doc_id, CASE {words} END AS department FROM (SELECT doc_id, lower(text) AS low FROM documents)) WHERE department IS NOT NULL"""
    sql["points_value"] = _with(t) + """ SELECT deal_id, l_linenumber * 50 AS pts, l_linenumber + 0.5 AS saved_value FROM obs"""
    sql["alcohol_flags"] = _with(*f) + " SELECT count(*) FILTER (WHERE product_id % 11 = 0) AS alcohol FROM feed"
    sql["loyalty_program"] = _with(t) + """ SELECT flyer_id, CASE WHEN flyer_id % 10 = 0 OR merchant = 'ASIA' THEN 'for U' ELSE 'Giant Choice' END AS program FROM flyer"""
    sql["json_ingest"] = _with(t, placed) + " SELECT flyer_id, page_number, count(*) AS n, count(*) AS priced FROM placed GROUP BY ALL"
    sql["report_filters"] = _with(*f) + " SELECT badge, count(*) AS n FROM feed WHERE bno <> 13 GROUP BY 1"
    sql["product_preferences"] = _with(*f) + """ SELECT 'pid_' || product_id AS product_key, canonical_name AS name, rating FROM prod LEFT JOIN rate USING (product_id)
      WHERE product_id <> 0 AND canonical_name LIKE '%ring%' AND product_id IN (SELECT product_id FROM feed)
      UNION ALL SELECT 'name_' || substr(regexp_replace(lower(canonical_name), '[^a-z0-9]', '_', 'g'), 1, 50), canonical_name, NULL FROM prod
      WHERE product_id = 0 AND canonical_name LIKE '%ring%' AND product_id IN (SELECT product_id FROM feed)"""
    return sql
