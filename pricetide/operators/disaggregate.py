"""Items -> normalised deals: one advertised tile becomes one row per product it names.

A staged table job: clean and classify the tile, split its title (``titles``), explode, then derive brand,
size, canonical name, promotion, price and category for every product row with column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import vocab as V
from pricetide.functions.core import (
    blank, cap, ci, cut_lineage, escape, has, has_any, hit, let, lookup, money, num, one_of, squash, strip_marks, text, truthy, unit_cost,
)
from pricetide.functions.promo import bundle_text, effective_price, promo_of
from pricetide.functions.text import (
    clean_sales_notes, infer_category, is_banner, normalize_text, size_token, standardize_units, unit_info,
)
from pricetide.operators.titles import expand_chunk, pre_expand, split_by_tokens
from pricetide.schemas import DEAL_COLUMNS

STORE = V.STORE_BRANDS


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


# ------------------------------------------------------------------ tile stage
def _basket_coupon() -> Column:
    raw = F.lower("raw_name")
    named = has_any(raw, ["digital coupon", "store coupon", "coupon for u"]) & has_any(raw, ["exclusive", "coupon", "spend", "off"])
    notes = F.concat_ws(" ", text(F.col("pre_price_text")), text(F.col("description")))
    return (named & ~has_any(raw, V.COUPON_PRODUCT_WORDS)) | F.coalesce(
        notes.rlike(r"^\$?\d+\s*off\s+(?:or|on|\$?\d+)\b"), F.lit(False))


def prepare_title(raw: Column) -> Column:
    """Title without sales notes, with commas removed where they do not separate products."""
    clean = let(clean_sales_notes(raw, keep_bulk_clause=True), lambda c: F.coalesce(blank(c), raw))
    unit = r"(?:ct|count|oz|ounce|lb|pound|pk|pack|ltr|liter|qt|quart|pt|pint|gal|gallon|ml)\b"
    for pattern, repl in (
        (r"\b(Boneless|Bone-In|Fresh|Wild|Raw|Cooked),\s*(Skinless|Center\s*Cut|Never\s*Frozen|Caught|Peeled)\b", "$1 $2"),
        (r",\s*(?=Sold in\b)", " "),
        (rf",\s*(?={V.NUM}(?:\s*-\s*{V.NUM})?\s*{unit})", " "),
    ):
        clean = F.regexp_replace(clean, ci(pattern), repl)
    return clean


def split_title(prepared: Column) -> Column:
    """Products named by a prepared title, in order."""
    def pieces(t: Column) -> Column:
        chunks = F.filter(F.transform(F.split(t, r",\s*"), lambda c: F.trim(c)), lambda c: F.length(c) > 3)
        chunks = let(chunks, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(t)))
        subs = F.flatten(F.transform(chunks, lambda c: let(split_by_tokens(c), lambda a: F.when(
            F.size(a) > 1, a).otherwise(expand_chunk(c)))))
        named = F.transform(subs, lambda x: strip_marks(F.replace(x, F.lit("__OR__"), F.lit(" or "))))
        kept = F.filter(named, lambda x: (x != "") & ~hit(x, V.DISCARD_FRAGMENT) & x.rlike("[A-Za-z]{2,}")
                        & ~hit(x, V.BARE_COUNT))
        return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(
            F.array(F.replace(t, F.lit("__OR__"), F.lit(" or ")))))

    return let(prepared, pieces)


# ------------------------------------------------------------------ brand
def _longest(matches: Column) -> Column:
    """Longest string of an array, the first one among equals."""
    return F.aggregate(matches, _null("string"), lambda best, x: F.when(
        best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))


def _brand_in(x: Column, brands: Sequence[str]) -> Column:
    """Longest registered brand found as a word, in its registered spelling."""
    order = sorted(brands, key=len, reverse=True)
    alts = [r"(?<!\bGreen\s)\bGiant\b(?!\s+Size\b)" if b == "Giant" else rf"\b{escape(b)}\b" for b in order]
    spell = {b.lower(): (b.lower(), b) for b in reversed(brands)}
    return lookup(F.lower(_longest(F.regexp_extract_all(x, F.lit(ci("|".join(alts))), F.lit(0)))), list(spell.values()))


def _starting_brand(x: Column, brands: Sequence[str]) -> Column:
    found = F.lower(F.regexp_extract(x, ci("^(?:" + "|".join(escape(b) for b in brands) + ")"), 0))
    spell = {b.lower(): (b.lower(), b) for b in reversed(brands)}
    return lookup(blank(found), list(spell.values()))


def _as_words(x: Column) -> Column:
    return F.concat(F.lit(" "), squash(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))


def _mentioned(x: Column, name: Column) -> Column:
    return F.contains(_as_words(x), _as_words(name))


# ------------------------------------------------------------------ catalogue rules
def _full(x: Column, pattern: str) -> Column:
    return hit(x, f"^(?:{pattern})$")


def fresh_meat_name(c: Column) -> Column:
    """Fresh cuts lose store-brand and pack lead-ins; poultry cuts get one spelling."""
    def without(x: Column, leads: Sequence[str]) -> Column:
        rest = strip_marks(F.regexp_replace(x, ci("^(?:" + "|".join(leads) + ")"), ""))
        return F.when(hit(x, "^(?:" + "|".join(leads) + ")") & has_any(rest, V.MEAT_KEYWORDS), rest).otherwise(x)

    first = let(c, lambda x: without(x, ["Signature SELECT", "Signature Farms"]))
    both = let(F.struct(c.alias("c"), first.alias("f")), lambda s: F.when(s["c"] != s["f"], s["f"]).otherwise(
        without(s["c"], ["Value Pack", "Family Size", "Small Pack"])))

    def poultry(x: Column) -> Column:
        x = F.regexp_replace(x, ci(r"^fresh (?=boneless|whole|diced)"), "")
        x = F.when(has(x, "chicken"), F.regexp_replace(x, ci(r" value pack$"), "")).otherwise(x)
        return F.trim(x)

    return let(let(both, poultry), lambda x: (
        F.when(_full(x, r"(?:Fresh\s+)?Chicken\s+Thighs"), "Bone-In Chicken Thighs")
        .when(_full(x, r"Fresh\s+Chicken\s+Drumsticks"), "Chicken Drumsticks")
        .when(_full(x, r"(?:deli\s+)?wings"), "Chicken Wings").when(_full(x, r"(?:deli\s+)?tenders"), "Chicken Tenders").otherwise(x)))


def beef_name(c: Column) -> Column:
    """Roasts and ribs of beef under one name, with or without the grade."""
    grade = r"(?:USDA\s+Choice\s+(?:Beef\s+)?)?"
    cuts = [
        (r"Bottom\s+Round(?:\s+Roast)?", "Bottom Round Roast"), (r"Top\s+Round(?:\s+Roast)?", "Top Round Roast"),
        (r"Eye\s+of\s+Round(?:\s+Roast)?", "Eye of Round Roast"), (r"Chuck(?:\s+Roast)?", "Chuck Roast"),
        (r"Short\s+Ribs?(?:\s+Bone-?in)?", "Short Ribs"),
        (r"Chuck\s+Shoulder\s+Roast(?:\s+Bone-?in)?", "Chuck Shoulder Roast Bone-In"),
    ]

    def named(x: Column) -> Column:
        cut = None
        for pattern, name in cuts:
            cond = _full(x, grade + pattern)
            cut = F.when(cond, name) if cut is None else cut.when(cond, name)
        lead = F.when(has(x, "usda choice"), "USDA Choice Beef ").otherwise("Beef ")
        return F.coalesce(F.concat(lead, cut), x)

    return let(c, named)


def _named(name: Column, brand: Column) -> Column:
    return F.struct(name.alias("c"), brand.alias("b"))


def pork_name(s: Column) -> Column:
    c, b = s["c"], s["b"]
    fresh = has_any(c, ["pork", "sparerib", "spare rib", "baby back"]) & ~has_any(c, V.PORK_NOT_FRESH)
    bare = F.regexp_replace(c, r"^(?:[Ff]resh )?(?:[Vv]alue [Pp]ack )?(?:[Hh]alf )?(?:[Bb]one-[Ii]n )?", "")
    bare = F.regexp_replace(bare, ci(r"\s+(?:Value Pack|Family Size|Sold in the bag|Bone-?In|Bone in)\b"), "")

    def cut(x: Column) -> Column:
        return (
            F.when(has_any(x, ["pork loin chop", "assorted pork loin"]), "Pork Loin Chops").when(has(x, "pork chop"), "Pork Chops")
            .when(has(x, "pork loin") & ~has(x, "chop"), "Boneless Half Pork Loin")
            .when(has_any(x, ["pork butt", "pork shoulder roast", "pork picnic shoulder"]), "Fresh Pork Butt Roast")
            .when(has(x, "pork tenderloin"), "Fresh Pork Tenderloin").when(has(x, "st. louis") & has(x, "rib"), "St. Louis Style Pork Ribs")
            .when(has(x, "baby back") & has(x, "rib"), "Pork Baby Back Ribs").when(has_any(x, ["spare rib", "sparerib"]), "Pork Spare Ribs")
        )

    label = F.when(~one_of(b, V.FRESH_STORE_LABELS), b)
    return F.when(fresh, _named(F.coalesce(let(F.trim(bare), cut), c), label)).otherwise(s)


def ground_meat_name(s: Column) -> Column:
    c, b = s["c"], s["b"]
    low = F.lower(c)

    def lean(levels: str, fats: list[tuple[str, str, str]]) -> Column:
        chain = F.when(c.rlike(rf"\b(?:{levels})(?:%|\s*%\s*lean|\s*/\s*\d+)?\b"), F.regexp_extract(
            c, rf"\b({levels})(?:%|\s*%\s*lean|\s*/\s*\d+)?\b", 1))
        for ratio, fat, level in fats:
            chain = chain.when(c.contains(ratio) | low.contains(fat), level)
        return chain

    beef_pct = lean("73|80|85|90|93", [("80/20", "20% fat", "80"), ("85/15", "15% fat", "85"), ("90/10", "10% fat", "90"),
                                       ("93/7", "7% fat", "93"), ("73/27", "27% fat", "73")])
    special = F.coalesce(b.isin("Schweid & Sons", "Rastelli's"), F.lit(False)) | has_any(c, ["schweid", "rastelli", "wagyu", "meatloaf mix"])
    patties = F.when(low.rlike(r"\b(patties|burgers?)\b"), " Patties").otherwise("")
    beef = F.concat(F.coalesce(F.concat(beef_pct, F.lit("% Lean ")), F.lit("")), F.lit("Ground Beef"), patties)
    beef_brand = F.when(~one_of(b, [*V.FRESH_STORE_LABELS, "USDA Prime", "USDA Choice"]), b)
    bird_pct = lean("85|90|93|99", [("99/1", "1% fat", "99"), ("93/7", "7% fat", "93"), ("85/15", "15% fat", "85")])
    bird = F.concat(
        F.when(blank(b).isNotNull() & ~b.isin(V.FRESH_STORE_LABELS), F.concat(b, F.lit(" "))).otherwise(""),
        F.when(has(c, "organic"), "Organic ").otherwise(""), bird_pct, F.lit("% Lean Ground Turkey"),
        F.when(has(c, "breast"), " Breast").otherwise(""))
    return (
        F.when(has(c, "ground beef") & special, s).when(has(c, "ground beef"), _named(beef, beef_brand))
        .when(has(c, "ground turkey") & bird.isNotNull(), _named(bird, b)).otherwise(s)
    )


def berry_name(s: Column) -> Column:
    c = s["c"]
    none = _null("string")

    def plain(name: str) -> Column:
        return _named(F.lit(name), none)

    rasp = has(c, "raspberr") & ~has_any(c, ["black raspberr", "blue raspberr"])
    return (
        F.when(has_any(c, V.BERRY_PROCESSED), s)
        .when(rasp & has(c, "heart"), _named(F.lit("Driscoll's Heart Shaped Raspberries 8 oz"), F.lit("Driscoll's")))
        .when(rasp & has(c, "12 oz"), plain("Raspberries 12 oz")).when(rasp, plain("Raspberries 6 oz"))
        .when(has(c, "blackberr") & has(c, "12 oz"), plain("Blackberries 12 oz")).when(has(c, "blackberr"), plain("Blackberries 6 oz"))
        .when(has(c, "blueberr") & has(c, "pint"), plain("Blueberries Pint"))
        .when(has(c, "blueberr") & has(c, "organic"), plain("Organic Blueberries 6 oz")).when(has(c, "blueberr"), plain("Blueberries 6 oz"))
        .when(has(c, "strawberr") & has(c, "2 lb"), plain("Strawberries 2 lb")).when(has(c, "strawberr"), plain("Strawberries 1 lb"))
        .otherwise(s)
    )


def _row(s: Column, **changes: Column | str | float) -> Column:
    """Copy of a product struct<c,b,size,unit> with some fields replaced."""
    kinds = {"c": "string", "b": "string", "size": "double", "unit": "string"}
    return F.struct(*((changes[k] if isinstance(changes.get(k), Column) else F.lit(changes[k]) if k in changes else s[k])
                      .cast(t).alias(k) for k, t in kinds.items()))


def brand_packaging(s: Column, item_brands: Column, item_name: Column) -> Column:
    """Brand-specific names and pack sizes, applied one after another to struct<c,b,size,unit>."""
    lays = F.exists(F.concat(item_brands, F.array(text(s["b"]), text(item_name))), lambda x: has(x, "lay"))
    steps = [
        lambda r: F.when(hit(r["c"], "^baked ") & lays, _row(r, c=F.concat(F.lit("Lay's "), r["c"]), b="Lay's")).otherwise(r),
        lambda r: F.when(_full(r["c"], r"Josh(?:\s+Cellars)?(?:\s+Wine)?"), _row(r, c="Josh Cellars Wine", b="Josh Cellars"))
        .when(hit(r["c"], r"\bJosh\s+Cellars\b") | F.coalesce(r["b"] == "Josh", F.lit(False)), _row(r, b="Josh Cellars")).otherwise(r),
        lambda r: F.when(F.coalesce(r["b"] == "Lucerne", F.lit(False)) & has(r["c"], "cheese") & ~hit(r["c"], "^lucerne"),
                         _row(r, c=F.concat(F.lit("Lucerne "), r["c"]))).otherwise(r),
        lambda r: F.when(F.coalesce(r["b"] == "Lucerne", F.lit(False)) & hit(r["c"], r"\b(?:Shredded|Chunk|Sliced|Block\s+)?Cheese\s+8\s*oz\b"),
                         _row(r, c=F.regexp_replace(r["c"], ci(r"\b8\s*oz\b"), "6-8 oz"), size=7.0, unit="oz")).otherwise(r),
        lambda r: F.when(hit(r["c"], r"\b(Yoplait|Lucerne)\s+Yogurt\b") & ~hit(r["c"], r"\b(?:32|24|4\s*pack|4\s*pk)\b"), let(
            F.when(has(r["c"], "yoplait"), "Yoplait").otherwise("Lucerne"), lambda n: _row(
                r, c=F.concat(n, F.lit(" Yogurt 4-6 oz")), b=n, size=5.0, unit="oz"))).otherwise(r),
        lambda r: F.when(has(r["c"], "cream cheese") & (
            (F.coalesce(r["unit"].isin("pk", "pack", "ct", "count"), F.lit(False)) | has_any(r["c"], ["2 pack", "2 pk"]))
            & F.coalesce(r["size"] == 2.0, has(r["c"], "2 pack"))), _row(r, size=16.0, unit="oz")).otherwise(r),
        lambda r: F.when(hit(r["c"], r"\b(?:Fresh\s+)?(?:Atlantic\s+)?Salmon\s+Portions?\b") & ~hit(r["c"], r"\b\d+\s*oz\b"),
                         _row(r, c="Fresh Atlantic Salmon Portions 5 oz Skinless", size=5.0, unit="oz")).otherwise(r),
        lambda r: F.when(hit(r["c"], r"\bcheap\s+chicken\b"), _row(r, c="Cheap Chicken Monday 8 Piece Dark Meat", b="Signature Cafe",
                                                                  size=8.0, unit="ct")).otherwise(r),
        lambda r: F.when(F.lower(r["c"]) == "velveeta", _row(r, c="Velveeta Cheese Loaf 32 oz", b="Velveeta", size=32.0, unit="oz")).otherwise(r),
    ]
    for step in steps:
        s = let(s, step)
    return s


def shell_eggs(s: Column) -> Column:
    """Shell eggs: brand and grade in the name, a dozen where no count is given."""
    eggs = ~F.coalesce(s["unit"].isin("oz", "lb", "ml", "ltr", "gal", "qt", "pt"), F.lit(False)) & hit(
        s["c"], V.SHELL_EGGS) & ~hit(s["c"], V.NOT_SHELL_EGGS)
    lucerne = (F.coalesce(s["b"] == "Lucerne", F.lit(False)) | has(s["c"], "lucerne")) & ~hit(s["c"], "^lucerne")

    def graded(r: Column) -> Column:
        return F.when(hit(r["c"], V.EGG_GRADES), r).otherwise(_row(r, c=F.regexp_replace(r["c"], ci(V.SHELL_EGGS), "Large Eggs")))

    def counted(r: Column) -> Column:
        return F.when(r["size"].isNull() & ~hit(r["c"], r"\b\d+\s*ct\b"), _row(
            r, c=F.concat(r["c"], F.lit(" 12 ct")), size=12.0, unit="ct")).otherwise(r)

    named = F.when(lucerne, _row(s, c=F.concat(F.lit("Lucerne "), s["c"]), b="Lucerne")).otherwise(s)
    return F.when(eggs, let(let(named, graded), counted)).otherwise(s)


def sold_by_pound(s: Column, full_text: Column) -> Column:
    """Deli and butcher goods without a size are sold by the pound; berries by their clamshell."""
    c = s["c"]
    portion = hit(c, r"\b(?:portions?|patt(?:y|ies)|cakes?|skewers?)\b")
    miscounted = has_any(c, V.FRESH_FLESH) & ~hit(c, r"\b(?:portions?|patt(?:y|ies)|cakes?|skewers?|nuggets?)\b") & F.coalesce(
        s["unit"] == "ct", F.lit(False)) & hit(full_text, r"\b(?:lb\s+member\s+price|/\s*lb|per\s+lb)\b")
    cut = ~portion & has_any(c, V.CUT_WORDS) & has_any(c, V.CUT_ANIMALS)
    loose = one_of(s["b"], V.DELI_BRANDS) | hit(full_text, V.PER_POUND_TEXT) | cut | hit(
        F.trim(c), r"^(?:organic\s+)?bananas?$")
    berries = has_any(c, ["raspberries", "blackberries", "blueberries", "strawberries"])
    shell = [("6 oz", 6.0, "oz"), ("12 oz", 12.0, "oz"), ("1 lb", 1.0, "lb"), ("2 lb", 2.0, "lb"), ("pint", 1.0, "pt")]
    out = F.when(miscounted | (s["size"].isNull() & loose), _row(s, size=1.0, unit="lb"))
    for words, size, unit in shell:
        out = out.when(s["size"].isNull() & berries & has(c, words), _row(s, size=size, unit=unit))
    return out.otherwise(s)


# ------------------------------------------------------------------ the job
def disaggregate(items: DataFrame, national_brands: Sequence[str] = V.NATIONAL_BRANDS) -> DataFrame:
    """Normalised deals of a table of tiles (see ``DEAL_COLUMNS``); ``item_id`` becomes ``raw_deal_id``."""
    c = F.col
    if "merchant" not in items.columns:
        items = items.withColumn("merchant", _null("string"))
    tiles = items.withColumn("raw_name", normalize_text(text(c("name")))).filter((c("raw_name") != "") & ~is_banner(c("raw_name")))
    tiles = tiles.withColumn("kind", F.when(_basket_coupon(), "coupon").when(hit(c("raw_name"), V.CAFE_PAIRING), "cafe").otherwise("goods"))
    coupons = _coupon_rows(tiles.filter("kind = 'coupon'"))
    cafe = _cafe_rows(tiles.filter("kind = 'cafe'"))
    return coupons.unionByName(cafe).unionByName(_goods_rows(tiles.filter("kind = 'goods'"), list(national_brands)))


def _shape(df: DataFrame, **cols: Column) -> DataFrame:
    base = {
        "raw_deal_id": F.col("item_id"), "flyer_id": F.col("flyer_id"), "page_number": F.col("page_number"),
        "is_front_page": F.col("is_front_page"), "brand": _null("string"), "advertised_price": _null("double"),
        "unit_size": _null("double"), "unit_type": _null("string"), "unit_price": _null("double"), "raw_title": F.col("raw_name"),
        "image_url": F.coalesce(blank(F.col("cutout_image_url")), F.col("clean_image_url")), "is_trusted": F.lit(True),
        "source_type": F.lit(V.SOURCE_API), "category": _null("string"), "base_price": _null("double"),
        "coupon_discount": _null("double"), "ad_title": F.col("name"), **cols,
    }
    return df.select(*(base[n].alias(n) for n in DEAL_COLUMNS))


def _coupon_rows(t: DataFrame) -> DataFrame:
    """A store-wide coupon becomes one unpriced row; one that states no threshold is dropped."""
    words = F.concat_ws(" ", "raw_name", text(F.col("pre_price_text")), text(F.col("description")))
    t = t.withColumns({
        "save": num(F.coalesce(cap(words, V.SPEND_SAVE, 1), cap(words, V.SPEND_SAVE, 3))),
        "spend": num(F.coalesce(cap(words, V.SPEND_SAVE, 2), cap(words, V.SPEND_SAVE, 4)))}).filter("save is not null and spend is not null")
    s, p = F.col("save"), F.col("spend")
    return _shape(
        t, canonical_name=F.concat(F.lit("Exclusive Digital Coupon - $"), s.cast("int").cast("string"), F.lit(" off $"), p.cast("int").cast("string")),
        promo_type=F.lit("basket_coupon"), promo_detail=F.concat(F.lit("SAVE "), money(s), F.lit(" ON "), money(p), F.lit("+ WITH DIGITAL COUPON")),
        qualifying_qty=F.lit(1), base_price=p, coupon_discount=s)


def _cafe_rows(t: DataFrame) -> DataFrame:
    return _shape(t, canonical_name=F.lit(V.CAFE_NAME), brand=F.lit("Starbucks"), advertised_price=F.col("price"), promo_type=F.lit("bundle"),
                  promo_detail=F.lit("PAIR DRINK WITH FOOD ITEM"), qualifying_qty=F.lit(2), category=F.lit("Prepared Food"))


def _goods_rows(t: DataFrame, national: list[str]) -> DataFrame:
    c = F.col
    staples = reduce_sum([has(c("name"), s).cast("int") for s in V.COLLAGE_STAPLES])
    t = t.withColumns({
        "item_brands": F.filter(F.transform(F.split(text(c("brand")), r"\|"), normalize_text), lambda b: b != ""),
        "initial": F.coalesce(_starting_brand(c("raw_name"), STORE), _starting_brand(c("raw_name"), national)),
        "collage": F.coalesce((c("price") == 5.0) & (staples >= 4), F.lit(False)),
        "prepared": pre_expand(prepare_title(c("raw_name"))),
    })
    r = t.withColumn("sub", F.explode(split_title(c("prepared")))).drop("prepared")

    # size and brand
    r = r.withColumns({"u_name": unit_info(c("sub")), "u_desc": unit_info(text(c("description"))),
                       "u_post": unit_info(text(c("post_price_text"))), "u_pre": unit_info(text(c("pre_price_text"))),
                       "national": _brand_in(c("sub"), national), "store": _brand_in(c("sub"), STORE)})
    own_listed = F.get(F.filter("item_brands", lambda b: _mentioned(c("sub"), b)), F.lit(0))
    other = F.exists("item_brands", lambda b: (F.lower(b) != F.lower("initial")) & _mentioned(c("sub"), b))
    inherits = c("initial").isNotNull() & ~c("collage") & ~other
    sold = lambda i: cap(c("sub"), V.BULK_CLAUSE, i)
    cost, qty = num(sold(3)), num(sold(1))
    bulk = F.coalesce((qty > 0) & truthy(c("price")).isNotNull() & (F.abs(c("price") - cost / truthy(qty)) < 0.05), F.lit(False))
    sizes = [c("u_name"), c("u_desc"), c("u_post"), c("u_pre")]
    r = r.withColumns({
        "brand": F.coalesce(c("national"), own_listed, c("store"), F.when(inherits, c("initial")),
                            F.when(F.size("item_brands") == 1, F.get("item_brands", F.lit(0)))),
        "size": F.when(bulk, qty).otherwise(F.coalesce(*(u["size"] for u in sizes))),
        "unit": F.when(bulk, F.lower(sold(2))).otherwise(F.coalesce(*(F.when(u["size"].isNotNull(), u["unit"]) for u in sizes))),
        "from_desc": c("u_name.size").isNull() & c("u_desc.size").isNotNull(),
        "bulk_cost": F.when(bulk, cost),
        "bulk_note": F.when(bulk, F.concat(F.lit("Sold in "), size_token(qty), F.lit(" "), F.lower(sold(2)), F.lit(" pkg"))),
    })

    # canonical name
    named = F.when(c("from_desc") & ~bulk_known(), F.concat_ws(" ", "sub", size_token(c("size")), "unit")).otherwise(c("sub"))
    has_national = c("national").isNotNull()
    lead = "^(?:" + "|".join(escape(b) for b in sorted(STORE, key=len, reverse=True)) + r")\s+"
    r = r.withColumns({
        "canonical": F.when(has_national, F.trim(F.regexp_replace(named, ci(lead), ""))).otherwise(named),
        "brand": F.when(has_national & one_of(c("brand"), STORE), c("national")).otherwise(c("brand")),
    })
    prepend = (~c("collage") & blank(c("brand")).isNotNull() & ~F.contains(F.lower("canonical"), F.lower("brand"))
               & ~one_of(c("initial"), STORE) & ~(one_of(c("brand"), STORE) & has_national))
    collage_key = F.when(c("collage"), F.lower(F.trim("sub")))
    r = r.withColumns({
        "canonical": F.coalesce(lookup(collage_key, [(k, n) for k, n, _ in V.COLLAGE_NAMES]),
                                F.when(prepend, F.concat_ws(" ", "brand", "canonical")).otherwise(c("canonical"))),
        "brand": F.coalesce(lookup(collage_key, [(k, b) for k, _, b in V.COLLAGE_NAMES]), c("brand")),
    })
    rules = let(_named(beef_name(fresh_meat_name(c("canonical"))), c("brand")), pork_name)
    r = r.withColumn("n", let(let(rules, ground_meat_name), berry_name))
    seasoning = F.when(has_any(c("n.c"), V.SEASONING_KEYWORDS), strip_marks(F.regexp_replace(c("n.c"), ci(V.UNIT_PATTERN), ""))).otherwise(c("n.c"))
    tidy = strip_marks(squash(clean_sales_notes(seasoning)))
    r = r.withColumn("p", F.struct(tidy.alias("c"), c("n.b").alias("b"), c("size").cast("double").alias("size"), c("unit").alias("unit")))
    everything = F.concat_ws(" ", text(c("name")), text(c("description")), text(c("pre_price_text")), text(c("post_price_text")))
    packed = brand_packaging(c("p"), c("item_brands"), c("name"))
    r = r.withColumn("p", let(let(packed, shell_eggs), lambda s: sold_by_pound(s, everything)))

    # promotion and price
    extra = bundle_text(c("pre_price_text"), c("price"))
    extra = F.when(hit(text(c("pre_price_text")), V.BUNDLE_PREFIX) & (c("price") > 0), extra)
    r = r.withColumn("promo", promo_of([c("sub"), c("name"), c("pre_price_text"), c("post_price_text"), c("description"), extra],
                                       merchant=c("merchant"), price=c("price")))
    q = c("promo")
    whole_bird = (F.upper(F.trim("p.c")) == "TURKEY") & F.coalesce(q["promo_type"] == "points_redemption", F.lit(False))
    r = r.withColumn("p", F.when(whole_bird, _row(c("p"), c="Giant Brand Frozen Whole Turkey (up to 20 lbs)", b="Giant", size=20.0, unit="lb")).otherwise(c("p")))
    stated = F.when(c("collage"), F.lit(1.0)).otherwise(F.coalesce("bulk_cost", "price"))
    bundle = (q["qualifying_qty"] > 1) & q["stated_unit_price"].isNotNull() & (
        F.coalesce(F.abs(stated - q["stated_total_price"]) < 0.01, F.lit(False))
        | (F.abs(stated - q["stated_unit_price"] * q["qualifying_qty"]) < 0.01))
    price = F.when(stated.isNull(), effective_price(q, c("original_price"))).when(bundle, q["stated_unit_price"]).otherwise(stated)
    r = r.withColumns({"final": price})
    noted = c("bulk_note").isNotNull() & blank(q["promo_detail"]).isNull()
    size = c("p.size")
    unit_price = F.coalesce(unit_cost(c("final"), size), F.when(truthy(c("price")).isNotNull(), unit_cost(c("price"), size)))
    return _shape(
        r, canonical_name=c("p.c"), brand=c("p.b"), advertised_price=c("final"), unit_size=size, unit_type=c("p.unit"),
        unit_price=unit_price, raw_title=c("name"), image_url=F.coalesce(blank(c("clean_image_url")), c("cutout_image_url")),
        promo_type=F.when(c("collage") | noted, "must_buy").otherwise(F.coalesce(q["promo_type"], F.lit("standard"))),
        promo_detail=F.when(c("collage"), "5 for $5.00 ($1.00 ea)").when(noted, c("bulk_note")).otherwise(q["promo_detail"]),
        qualifying_qty=F.when(c("collage"), 5).otherwise(F.coalesce(q["qualifying_qty"], F.lit(1))),
        category=infer_category(c("p.c")), base_price=c("original_price"), coupon_discount=q["coupon_discount"], ad_title=_null("string"))


def bulk_known() -> Column:
    return F.col("bulk_cost").isNotNull()


def reduce_sum(cols: Sequence[Column]) -> Column:
    out = F.lit(0)
    for x in cols:
        out = out + x
    return out


# ------------------------------------------------------------------ re-normalising stored observations
def renormalize(s: DataFrame, national_brands: Sequence[str] = V.NATIONAL_BRANDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Re-split stored tiles: (observations to drop, deals to insert, report of counts).

    A tile is replaced when it now names several products, or when its single product changed in name, brand,
    unit price or category.  Promotion type, trust, source and recording time of the old row are kept.
    """
    c = F.col
    low = F.lower(text(c("merchant")))
    foreign = (low.rlike("tom thumb|safeway|albertsons") & c("brand").isin(V.STORE_BRANDS_AHOLD)) | (
        ~low.rlike("tom thumb|safeway|albertsons") & low.contains("giant") & c("brand").isin(V.STORE_BRANDS_ALBERTSONS))
    keep = ["promo_type", "is_trusted", "source_type", "recorded_at"]
    none, nod = _null("string"), _null("double")
    tiles = s.select(
        "flyer_id", c("deal_id").alias("item_id"), c("raw_deal_id").alias("tile"), c("raw_title").alias("name"),
        c("advertised_price").alias("price"), nod.alias("original_price"), none.alias("pre_price_text"), none.alias("post_price_text"),
        none.alias("description"), F.when(~F.coalesce(foreign, F.lit(False)), c("brand")).alias("brand"), "page_number", "is_front_page",
        c("image_url").alias("cutout_image_url"), none.alias("clean_image_url"))
    old = s.select(c("deal_id").alias("old_id"), c("raw_deal_id").alias("tile"), c("canonical_name").alias("o_name"), c("brand").alias("o_brand"),
                   c("unit_price").alias("o_unit"), c("category").alias("o_cat"), *(c(k).alias("o_" + k) for k in keep))
    deals = cut_lineage(disaggregate(tiles, national_brands)).withColumnRenamed("raw_deal_id", "old_id")
    sizes = deals.groupBy("old_id").agg(F.count("*").alias("parts"))
    j = deals.join(sizes, "old_id").join(old, "old_id")
    changed = (~c("canonical_name").eqNullSafe(c("o_name")) | ~c("brand").eqNullSafe(c("o_brand"))
               | ~c("unit_price").eqNullSafe(c("o_unit")) | ~c("category").eqNullSafe(c("o_cat")))
    # a compound tile stored as several rows is re-split once, from its first row
    first = j.filter("parts > 1").groupBy("flyer_id", "tile").agg(F.min("old_id").alias("lead"))
    j = j.join(first, ["flyer_id", "tile"], "left")
    hit_rows = j.filter(F.when(c("lead").isNotNull(), c("old_id") == c("lead")).otherwise((c("parts") == 1) & changed))
    insert = hit_rows.withColumns({k: c("o_" + k) for k in keep}).withColumn("raw_deal_id", c("tile")).select(*DEAL_COLUMNS, "recorded_at", "old_id")
    drop = j.filter(c("lead").isNotNull() | ((c("parts") == 1) & changed)).select(c("old_id").alias("deal_id")).distinct()
    report = hit_rows.agg(F.countDistinct("old_id").alias("split_observations"), F.count("*").alias("new_observations"))
    return drop, insert, report


__all__ = ["disaggregate", "renormalize", "split_title", "prepare_title", "standardize_units"]
