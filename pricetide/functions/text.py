"""Cleaning, units, commodity classes, departments, alcohol and search-term columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetide import vocab as V
from pricetide.functions.core import (
    blank, cap, ci, escape, exact_round, first_rule, has, has_any, hit, lookup, num, one_of, squash, strip_marks, text,
    word_any,
)


# ------------------------------------------------------------------ cleaning
def normalize_text(col: Column) -> Column:
    """Plain dashes and blanks, no trade marks, single spaces."""
    dashed = F.regexp_replace(col, "[‐-—]", "-")
    spaced = F.regexp_replace(dashed, "[®™©]", "")
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def standardize_units(col: Column) -> Column:
    """'60 Count' -> '60 ct', '6-8 Ounces' -> '6-8 oz'."""
    span = rf"\b({V.NUM}(?:\s*-\s*{V.NUM})?)\s*"
    return reduce(lambda c, p: F.regexp_replace(c, ci(span + p[0] + r"\b"), "$1 " + p[1]), V.UNIT_SPELLINGS, col)


def clean_sales_notes(col: Column, keep_bulk_clause: bool = False) -> Column:
    """Drop packaging notes, limits and promotional tails from a title."""
    notes = [p for p in V.SALES_NOTE_PATTERNS if not (keep_bulk_clause and "Sold in" in p and "for" in p)]
    bare = reduce(lambda c, p: F.regexp_replace(c, ci(p), ""), notes, col)
    return strip_marks(squash(standardize_units(bare)))


def clean_headline(col: Column, viewer: bool = False) -> Column:
    """Flyer headline without artefacts, price tails and (unless for the viewer) store-brand lead-ins."""
    t = squash(F.regexp_replace(text(col), "[�®™]", ""))
    t = F.trim(F.regexp_replace(
        t, ci(r"\s*-\s*(\$\d+(\.\d{2})?|\d+/\s*\$\d+|SAVE\s+\$\d+|DIGITAL\s+COUPON).*$"), ""))
    if viewer:
        return t
    t = F.trim(F.regexp_replace(
        t, ci(r"^(?:Signature SELECT|Signature Farms|Our Brand|Giant Brand|Giant)\s*(?:Fresh\s+)?"), ""))
    t = F.trim(F.regexp_replace(t, ci(r"\bValue\s+Pack\s+"), ""))
    return F.regexp_replace(t, ci(r"\bBoneless\s+Skinless\s+Chicken\s+Breasts\b"), "Chicken Breasts")


def clean_repeated_promo(col: Column) -> Column:
    """Remove a doubled second half, then fold 'A 10% OFF A' to '10% OFF A'."""
    words = F.split(F.trim(col), r"\s+")
    n = F.size(words)
    half = (n / 2).cast("int")
    first, second = F.slice(words, 1, half), F.slice(words, half + 1, half)
    same = F.lower(F.array_join(first, " ")) == F.lower(F.array_join(second, " "))
    once = F.when((n >= 4) & (n % 2 == 0) & same, F.array_join(first, " ")).otherwise(F.trim(col))
    folded = F.regexp_replace(once, ci(r"^(.*?)\s+(\$\d+(?:\.\d{2})?\s*OFF|\d+%\s*OFF)\s+\1$"), "$2 $1")
    return F.when(blank(col).isNotNull(), folded).otherwise(col)


# ------------------------------------------------------------------ units
def _std_unit(col: Column) -> Column:
    return lookup(F.lower(col), V.UNIT_SYNONYMS, F.lower(col))


def unit_info(col: Column) -> Column:
    """Package size and unit as struct<size,unit>; both null when the text states none."""
    low = cap(col, V.UNIT_PATTERN, 1)
    size = F.when(low.isNotNull(), exact_round((num(low) + num(cap(col, V.UNIT_PATTERN, 2))) / 2.0, 3)).otherwise(
        exact_round(num(cap(col, V.UNIT_PATTERN, 4)), 3))
    unit = F.coalesce(cap(col, V.UNIT_PATTERN, 3), cap(col, V.UNIT_PATTERN, 5))
    rate = cap(col, V.PER_UNIT_RATE)

    def pair(s: Column, u: Column) -> Column:
        return F.struct(s.cast("double").alias("size"), u.cast("string").alias("unit"))

    return (
        F.when(hit(col, V.COUNT_PER_POUND), pair(F.lit(1.0), F.lit("lb")))
        .when(rate.isNotNull(), pair(F.lit(1.0), _std_unit(rate)))
        .when(unit.isNotNull(), pair(size, _std_unit(unit)))
        .otherwise(pair(F.lit(None), F.lit(None)))
    )


def size_token(x: Column) -> Column:
    """12.0 -> '12', 1.25 -> '1.25': at most three decimals, six significant digits."""
    r = exact_round(x, 3)
    return F.when(r == F.floor(r), r.cast("bigint").cast("string")).otherwise(
        F.regexp_replace(F.format_string("%.6f", F.round(r, 3)), r"0+$", ""))


# ------------------------------------------------------------------ classes
def infer_category(col: Column) -> Column:
    """Commodity category by the first matching pattern."""
    return first_rule(col, V.COMMODITY_RULES)


def infer_department(col: Column) -> Column:
    """Broad department by the first keyword found as a word."""
    return first_rule(F.lower(col), [(r"\b" + escape(k) + r"\b", d) for k, d in V.DEPARTMENT_KEYWORDS])


def shopper_department(stored: Column, category: Column, name: Column, brand: Column, raw_title: Column,
                       ad_title: Column) -> Column:
    """Department shown to shoppers: stored value, commodity table, text rules, category, 'Other'."""
    blob = F.concat_ws(" ", text(name), text(brand), text(raw_title), text(ad_title))
    return F.coalesce(
        blank(stored),
        lookup(category, V.COMMODITY_TO_DEPARTMENT),
        first_rule(blob, V.DEPARTMENT_TEXT_RULES),
        blank(category),
        F.lit("Other"),
    )


def is_placeholder(col: Column) -> Column:
    return one_of(F.lower(F.trim(col)), V.PLACEHOLDER_NAMES)


def is_alcohol(category: Column, name: Column, brand: Column) -> Column:
    """Alcoholic beverage by category, then brand and keyword unless an excluded word occurs."""
    blob = F.lower(F.trim(F.concat_ws(" ", text(brand), text(name))))
    brands = V.WINE_BRANDS + V.BEER_SELTZER_BRANDS
    return one_of(F.lower(category), V.ALCOHOL_CATEGORIES) | (
        ~hit(blob, V.NOT_ALCOHOL_WORDS)
        & (one_of(F.lower(brand), brands) | word_any(blob, brands)
           | hit(blob, V.ALCOHOL_WORDS))
    )


def is_banner(title: Column) -> Column:
    """Department banner: exact title, or a title that starts with a banner longer than 8 characters."""
    low = F.lower(F.trim(title))
    starts = "^(?:" + "|".join(escape(b) for b in V.DEPARTMENT_BANNERS if len(b) > 8) + ")"
    return F.coalesce(one_of(low, V.DEPARTMENT_BANNERS) | low.rlike(starts), F.lit(False))


# ------------------------------------------------------------------ keys
def search_term(brand: Column, canonical: Column, raw_title: Column) -> Column:
    """Term for a shelf-price lookup: the brand, else the first two content words."""
    t = F.coalesce(blank(canonical), blank(raw_title), F.lit(""))
    t = F.regexp_replace(t, ci(V.SEARCH_SIZE_TAIL), "")
    t = F.regexp_replace(t, V.SEARCH_PUNCTUATION, " ")
    t = F.regexp_replace(t, ci(V.SEARCH_STOPWORDS), " ")
    words = F.filter(F.split(t, r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(V.SEARCH_FILLER))
    return F.coalesce(blank(brand), F.array_join(F.slice(words, 1, 2), " "))


def product_key(product_id: Column, name: Column) -> Column:
    """Rating key: 'pid_<id>', else a 50-character name slug."""
    slug = F.substring(F.regexp_replace(F.lower(text(name)), "[^a-z0-9]", "_"), 1, 50)
    return F.when(truthy_id(product_id), F.concat(F.lit("pid_"), product_id.cast("string"))).otherwise(
        F.concat(F.lit("name_"), slug))


def truthy_id(col: Column) -> Column:
    return F.coalesce(col != 0, F.lit(False))


def ad_id(raw_deal_id: Column) -> Column:
    """Parent ad: the first ten digits of ids with eleven or more, else the id itself."""
    raw = raw_deal_id.cast("string")
    return F.when(F.length(raw) >= 11, F.substring(raw, 1, 10)).otherwise(raw)


def history_group(canonical: Column, brand: Column, ad_title: Column, raw_title: Column, unit_size: Column,
                  unit_type: Column) -> Column:
    """Timeline key and title: ounce ranges and pack spellings collapse, pack tiers stay apart."""
    ad, name = F.trim(text(ad_title)), F.trim(text(canonical))
    chosen = (
        F.when((ad != "") & ~F.lower(ad).isin(V.HISTORY_PLACEHOLDERS), ad)
        .when(F.lower(name).isin(V.HISTORY_PLACEHOLDERS), F.trim(text(raw_title)))
        .otherwise(name)
    )
    pack_words = r"(?:ct|pk|pack|count|roll|rolls|can|cans|bottle|bottles)"
    ranged = F.contains(chosen, F.lit("-"))  # names without a hyphen, most of them, skip the patterns of ranges
    packs = F.coalesce(
        cap(chosen, rf"(?<![\d\.])(\d+)\s*{pack_words}\b").try_cast("int"),
        F.when(ranged, cap(chosen, r"(?<![\d\.])(\d+)\s*-\s*\d+(?:\.\d+)?\s*oz\b").try_cast("int")),
        F.when(F.lower(text(unit_type)).isin("ct", "pk", "roll") & (unit_size > 1), unit_size.cast("int")),
    )
    base = chosen
    for p in (
        r"\b\d+(?:\.\d+)?\s*-\s*\d+(?:\.\d+)?\s*(?:oz|ounce)\.?\b",
        r"\b\d+(?:\.\d+)?\s*(?:oz|ounce)\.?\b",
        r"(?<![\d\.])\d+\s*(?:ct|pk|pack|count|roll|rolls)\.?\b",
        r"(?<![\d\.])\d+\s*-\s*\d+(?:\.\d+)?\s*oz\.?\b",
    ):
        out = F.regexp_replace(base, ci(p), "")
        base = F.when(ranged, out).otherwise(base) if "-" in p else out
    base = F.regexp_replace(strip_marks(squash(base)), ci(r"^clif\s+luna\b"), "LUNA")
    base = F.regexp_replace(base, r"^(?i:clif)$", "CLIF Bars")
    base = F.regexp_replace(base, r"^(?i:luna)$", "LUNA Bars")
    tier = F.when(packs > 1, F.concat(packs.cast("string"), F.lit(" ct"))).otherwise(F.lit(""))
    return F.struct(
        F.btrim(F.concat_ws("_", F.lower(base), tier), F.lit("_")).alias("group_key"),
        F.trim(F.concat_ws(" ", base, tier)).alias("title"),
    )


# ------------------------------------------------------------------ display
def unit_price_label(unit_price: Column, unit_type: Column) -> Column:
    """'$0.025/oz' below ten cents, otherwise two decimals."""
    from pricetide.functions.core import fixed

    digits = F.when(unit_price < 0.10, fixed(unit_price, 3)).otherwise(fixed(unit_price, 2))
    return F.when(unit_price.isNotNull() & blank(unit_type).isNotNull(),
                  F.concat(F.lit("$"), digits, F.lit("/"), unit_type)).otherwise(F.lit(""))


def price_label(low: Column, high: Column, is_free: Column | None = None, width: int = 7) -> Column:
    """Right-aligned price or price range; 'FREE' and 'See ad' where there is no number."""
    from pricetide.functions.core import money

    span = F.when(high.isNotNull() & (F.abs(low - high) >= 0.01),
                  F.concat(F.lpad(money(low), width, " "), F.lit("-"), money(high)))
    shown = F.coalesce(span, F.lpad(money(low), width, " "), F.lit("See ad".rjust(width)))
    return shown if is_free is None else F.when(is_free, F.lit("FREE".rjust(width))).otherwise(shown)


def mentions(col: Column, words: list[str]) -> Column:
    return has_any(col, words)


def is_basket_coupon(promo_type: Column, badge: Column, raw_title: Column, name: Column, promo_detail: Column,
                     coupon_discount: Column) -> Column:
    """Store-wide coupon rather than a product offer."""
    return (
        F.coalesce(promo_type.isin("basket_coupon", "store_coupon"), F.lit(False))
        | F.coalesce(badge.isin("STORE_COUPON", "BASKET_COUPON"), F.lit(False))
        | (has(raw_title, "20 off") & has(raw_title, "100"))
        | has(raw_title, "exclusive digital coupon")
        | has(name, "exclusive digital coupon")
        | (is_placeholder(name) & F.coalesce(coupon_discount != 0, F.lit(False)))
        | has(promo_detail, "off $100")
        | has(promo_detail, "on $100")
    )
