"""Splitting one advertised title into its products, as array-valued columns.

Titles such as 'Doritos, Tostitos 6-13 oz or Lay's Chips 8 oz' are first rewritten by substitution steps
(``pre_expand``), cut at commas, and each piece is split by token rules or, failing that, by coordination
patterns.  Everything is built from regular-expression and higher-order functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetide import vocab as V
from pricetide.functions.core import cap, ci, escape, has, hit, let, lookup, squash, strip_marks, sub_each, text, one_of

ALL_BRANDS = V.STORE_BRANDS + [b for b in V.NATIONAL_BRANDS if b not in V.STORE_BRANDS]
HEAD = "|".join(V.HEAD_NOUN_PATTERNS)
_BRAND_ALT = "|".join(escape(b) for b in sorted(ALL_BRANDS, key=len, reverse=True))


def _words(x: Column) -> Column:
    return F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")


def _say(*pieces: Column | str) -> Column:
    """Join non-empty pieces by single blanks."""
    return squash(F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else p for p in pieces)))


def is_head_word(w: Column) -> Column:
    low = F.btrim(F.lower(w), F.lit(" ,.-"))
    return one_of(low, V.HEAD_NOUN_WORDS) | (low.endswith("s") & one_of(F.substring(low, F.lit(1), F.length(low) - 1), V.HEAD_NOUN_WORDS))


def _ends_in_head(x: Column) -> Column:
    last = F.try_element_at(_words(text(x)), F.lit(-1))
    return F.coalesce(is_head_word(last), F.lit(False))


# ------------------------------------------------------------------ tokens
def tokenize(title: Column) -> Column:
    """array<struct<t,v>> with t in B(rand) H(ead noun) O(or/and) C(omma) U(nit) W(ord)."""
    one = rf",|\b(?:{_BRAND_ALT})\b|\b(?:{HEAD})\b|{V.TOKEN_UNIT}|\b(?:or|and)\b|[A-Za-z0-9'\-]+"

    def kind(v: Column) -> Column:
        def full(p: str) -> Column:
            return v.rlike(ci(rf"^(?:{p})$"))

        return (
            F.when(v == ",", "C").when(full(_BRAND_ALT), "B").when(full(HEAD), "H").when(full(V.TOKEN_UNIT), "U")
            .when(full("or|and"), "O").otherwise("W")
        )

    return F.transform(F.regexp_extract_all(title, F.lit(ci(one)), F.lit(0)),
                       lambda v: F.struct(kind(v).alias("t"), v.alias("v")))


def _codes(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["t"]), "")


def _text_of(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["v"]), " ")


def _any(tokens: Column, kinds: str) -> Column:
    return F.exists(tokens, lambda t: t["t"].isin(list(kinds)))


def segments(tokens: Column) -> Column:
    """Token groups of independent products, cut at commas and conjunctions between complete products."""
    n = F.size(tokens)

    def step(state: Column, i: Column) -> Column:
        tok = F.get(tokens, i)
        before = F.slice(tokens, state["last"] + 2, F.greatest(i - state["last"] - 1, F.lit(0)))
        after = F.slice(tokens, i + 2, n)
        unit_before = _any(before, "U")
        cut = tok["t"].isin("C", "O") & (
            (unit_before & _any(after, "HB"))
            | (_any(before, "H") & _any(after, "H") & ~(_any(after, "U") & ~unit_before)))
        return F.when(cut, F.struct(i.alias("last"), F.concat(state["cuts"], F.array(i)).alias("cuts"))).otherwise(state)

    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("cuts"))
    cuts = F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["cuts"]

    def pieces(c: Column) -> Column:
        lo, hi = F.concat(F.array(F.lit(-1)), c), F.concat(c, F.array(n))
        return F.zip_with(lo, hi, lambda a, b: F.slice(tokens, a + 2, F.greatest(b - a - 1, F.lit(0))))

    return F.when(n > 0, F.filter(let(cuts, pieces), lambda p: F.size(p) > 0))


def _parts(tokens: Column, split_grown: bool = False) -> Column:
    """Token groups between commas and conjunctions; optionally a brand after 'Greenhouse Grown' opens one."""
    empty = F.slice(tokens, 1, 0)
    seed = F.array(empty)

    def step(acc: Column, tok: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        head = F.slice(acc, 1, F.size(acc) - 1)
        opened = F.concat(acc, F.array(F.array(tok)))
        grown = F.exists(last, lambda t: t["v"].isin("Greenhouse", "Grown"))
        add = F.concat(head, F.array(F.concat(last, F.array(tok))))
        grow = F.when((tok["t"] == "B") & grown, opened).otherwise(add) if split_grown else add
        return F.when(tok["t"].isin("C", "O"), F.concat(acc, F.array(empty))).otherwise(grow)

    return F.filter(F.aggregate(tokens, seed, step), lambda p: F.size(p) > 0)


def split_clause(tokens: Column) -> Column:
    """Products of one clause by the first distribution rule that applies, else the clause itself."""
    codes, n = _codes(tokens), F.size(tokens)
    v = lambda i: F.get(tokens, F.lit(i))["v"]
    pair = F.when(codes.rlike("^B[CO]BU$"), F.array(F.concat_ws(" ", v(0), v(3)), F.concat_ws(" ", v(2), v(3))))

    # coordinated head nouns sharing a prefix and a trailing size
    last_or = n - F.locate("O", F.reverse(codes))
    tail_units = _text_of(F.filter(F.slice(tokens, last_or + 2, n), lambda t: t["t"] == "U"))
    products = F.filter(tokens, lambda t: t["t"] != "U")

    def nouns(p: Column) -> Column:
        first, second = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        share = (F.size(first) > 1) & (F.size(second) == 1)
        prefix = F.when(share, _text_of(F.slice(first, 1, F.size(first) - 1))).otherwise("")
        rest = F.when(share, F.concat(F.array(F.slice(first, F.size(first), 1)), F.slice(p, 2, F.greatest(F.size(p), F.lit(0))))).otherwise(p)
        return F.when((F.size(p) >= 2) & F.forall(rest, lambda x: _any(x, "H")), F.transform(
            rest, lambda x: _say(prefix, _text_of(x), tail_units)))

    coordinated = F.when(codes.contains("O") & ~codes.rlike("U.*O"), let(_parts(products), nouns))

    h = F.locate("H", codes) - 1
    ahead, behind, noun = F.slice(tokens, 1, h), F.slice(tokens, h + 2, n), F.get(tokens, h)["v"]
    units_behind = _text_of(F.filter(behind, lambda t: t["t"] == "U"))
    several = lambda names, make: let(names, lambda p: F.when(F.size(p) >= 2, F.transform(p, make)))

    brands_first = (h >= 1) & codes.rlike("^[^HU]*O[^HU]*H") & (F.size(F.filter(ahead, lambda t: t["t"] == "B")) >= 2)
    left = F.when(brands_first, several(_parts(ahead, True), lambda p: _say(_text_of(p), noun, units_behind)))

    listed = codes.rlike("^[^H]*H[WCO]*O[WCO]*$") & (h < n - 2)
    lead = _text_of(F.slice(tokens, 1, h + 1))
    prefix_list = F.when(listed, several(_parts(behind), lambda p: F.concat_ws(" ", lead, _text_of(p))))

    first_or = F.locate("O", codes) - 1
    right_len, left_len = h - 1 - first_or, first_or
    start = F.when(codes.startswith("B"), F.lit(1)).when(
        (h > 3) & (left_len > right_len) & (right_len > 0), left_len - right_len).otherwise(F.lit(0))
    shared = _text_of(F.slice(tokens, 1, start))
    right = F.when((h >= 1) & codes.rlike("^[^HU]*O[^HU]*H"), several(
        _parts(F.slice(tokens, start + 1, h - start)), lambda p: _say(shared, _text_of(p), noun, _text_of(behind))))
    return F.coalesce(pair, coordinated, left, prefix_list, right, F.array(_text_of(tokens)))


def split_by_tokens(title: Column) -> Column:
    return let(tokenize(title), lambda t: F.coalesce(
        F.flatten(F.transform(segments(t), lambda s: let(s, split_clause))), F.array(title)))


# ------------------------------------------------------------------ coordination patterns
_COLOR = rf"^(.*?)\b({V.CHOICE_COLORS})\s+or\s+({V.CHOICE_COLORS})\s+({V.CHOICE_COLOR_NOUNS})\b(.*)$"
_STYLE = rf"^(.*?)\b({V.CHOICE_STYLES})\s+or\s+({V.CHOICE_STYLES})\s+({V.CHOICE_STYLE_NOUNS})\b(.*)$"
_PACKED = rf"^(.*?\b(?:{V.CHOICE_PACKAGED_LEAD}))\s+({V.CHOICE_PACKAGED})\s+or\s+({V.CHOICE_PACKAGED})\b(.*)$"
_CUTS = rf"^(.*?)\b({V.CHOICE_CUTS})\s+or\s+({V.CHOICE_CUTS})\b(.*)$"
_OR = r"\s+or\s+"


def _tidy(x: Column) -> Column:
    return strip_marks(F.regexp_replace(F.trim(x), r"^(?i:or|and)\s+", ""))


def _share_head(parts: Column) -> Column:
    """Give the last part's head noun (and what follows it) to earlier parts that have none."""
    last = _words(F.try_element_at(parts, F.lit(-1)))
    at = F.array_position(F.transform(last, is_head_word), F.lit(True))
    suffix = F.array_join(F.slice(last, F.greatest(at, F.lit(1)).cast("int"), F.greatest(F.size(last), F.lit(0))), " ")
    return F.when(at == 0, parts).otherwise(F.transform(parts, lambda p, i: F.when(
        (i < F.size(parts) - 1) & ~F.exists(_words(p), is_head_word), F.concat_ws(" ", p, suffix)).otherwise(p)))


def _plain_split(chunk: Column) -> Column:
    parts = F.split(chunk, ci(_OR))
    last_word = F.btrim(F.lower(F.try_element_at(_words(F.try_element_at(parts, F.lit(-1))), F.lit(-1))), F.lit(" "))
    combo = (F.size(parts) > 1) & one_of(last_word, V.CONTAINER_WORDS) & ~F.exists(_words(F.get(parts, F.lit(0))), is_head_word)
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) >= 3)
    spread = let(kept, lambda k: F.when(F.size(k) > 1, F.filter(
        F.transform(_share_head(k), _tidy), lambda p: p != "")).otherwise(F.array(chunk)))
    return F.when(combo, F.array(chunk)).otherwise(spread)


def expand_chunk(chunk: Column) -> Column:
    """Products of a piece by coordination patterns; text behind a matched pattern is expanded in turn.

    Each turn uses up one 'or', so as many turns as there are conjunctions always suffice.
    """
    def turn(state: Column, _: Column) -> Column:
        return let(F.struct(state["out"].alias("out"), _tidy(state["rest"]).alias("rest")), take)

    def take(state: Column) -> Column:
        out, rest = state["out"], state["rest"]
        g = lambda p, i: F.trim(text(cap(rest, p, i)))

        def moved(items: Column, remainder: Column) -> Column:
            return F.struct(F.concat(out, items).alias("out"), remainder.alias("rest"))

        def both(p: str) -> Column:
            return F.array(_say(g(p, 1), g(p, 2), g(p, 4)), _say(g(p, 1), g(p, 3), g(p, 4)))

        packed = F.array(_say(g(_PACKED, 1), g(_PACKED, 2), g(_PACKED, 4)), _say(g(_PACKED, 1), g(_PACKED, 3), g(_PACKED, 4)))
        lead = F.filter(F.transform(F.split(g(_CUTS, 1), ci(_OR)), lambda p: F.trim(p)), lambda p: F.length(p) > 3)
        common = F.when(F.size(lead) > 1, F.try_element_at(lead, F.lit(-1))).otherwise(g(_CUTS, 1))
        prior = F.when(F.size(lead) > 1, F.slice(lead, 1, F.size(lead) - 1)).otherwise(F.array().cast("array<string>"))
        cuts = F.concat(prior, F.array(_say(common, g(_CUTS, 2), g(_CUTS, 4)), _say(common, g(_CUTS, 3), g(_CUTS, 4))))
        done = F.lit("")
        return (
            F.when(rest == "", state)
            .when(hit(rest, _COLOR), moved(both(_COLOR), g(_COLOR, 5)))
            .when(hit(rest, _STYLE), moved(both(_STYLE), g(_STYLE, 5)))
            .when(hit(rest, _PACKED), moved(packed, done))
            .when(hit(rest, _CUTS), moved(cuts, done))
            .otherwise(moved(_plain_split(rest), done))
        )

    def run(c: Column) -> Column:
        turns = F.sequence(F.lit(1), F.size(F.split(c, ci(_OR))))
        seed = F.struct(F.array().cast("array<string>").alias("out"), c.alias("rest"))
        return F.aggregate(turns, seed, turn)["out"]

    return F.when(hit(chunk, _OR), let(chunk, run)).otherwise(F.filter(F.array(_tidy(chunk)), lambda x: x != ""))


# ------------------------------------------------------------------ substitutions before splitting
def _starts_with_any(x: Column, names: list[str]) -> Column:
    """First listed name the text starts with, ignoring case; null if none."""
    found = F.lower(F.regexp_extract(x, ci("^(?:" + "|".join(escape(n) for n in names) + ")"), 0))
    return lookup(F.nullif(found, F.lit("")), list({n.lower(): (n.lower(), n) for n in names}.values()))


def _or_list(*items: Column) -> Column:
    return F.array_join(F.array(*items), " or ")


def _poultry(title: Column) -> Column:
    p = (r"\b([A-Za-z0-9'\s]+?\b(?:Fresh\s+)?(?:Chicken\s+)?(?:Breasts?|Whole\s+Chickens?)),\s*"
         r"(Thin\s+Sliced(?:\s+Breasts?)?|Thighs|Drumsticks|Wings|Tenders|Cutlets)\s+or\s+(Thighs|Drumsticks|Wings|Tenders|Cutlets)\b")

    def rewrite(m: Column) -> Column:
        first, second, third = (F.trim(cap(m, p, i)) for i in (1, 2, 3))
        base = F.trim(F.regexp_replace(first, ci(
            r"\b(?:Boneless\s+Skinless|Boneless|Bone-In)?\s*(?:Chicken\s+Breasts?|Whole\s+Chickens?|Breasts?)\b"), ""))
        bare = F.trim(F.replace(F.replace(first, F.lit("Chicken Breasts"), F.lit("")), F.lit("Breasts"), F.lit("")))
        thin = F.when(has(second, "thin"), _say(bare, "Thin Sliced Chicken Breasts")).otherwise(_say(base, "Chicken", second))
        return _or_list(first, thin, _say(base, "Chicken", third))

    return sub_each(title, p, rewrite)


def _beef(title: Column) -> Column:
    cuts = "|".join(V.BEEF_CUTS)
    p = rf"\b({V.BEEF_GRADES})\s+((?:(?:{cuts})(?:,\s*|\s+or\s+))+)({cuts})\b"

    def named(c: Column) -> Column:
        full = lambda q: c.rlike(ci(f"^{q}$"))
        return (
            F.when(full(r"(?:Beef\s+)?Short\s+Ribs?(?:\s+Bone-?in)?"), F.lit("Short Ribs"))
            .when(full(r"(?:Bottom|Top|Eye\s+of)\s+Round") | full("Chuck") | full("Rump") | full(r"Sirloin\s+Tip"),
                  F.concat(c, F.lit(" Roast")))
            .otherwise(F.regexp_replace(c, ci(r"\bBone-in\b"), "Bone-In"))
        )

    def rewrite(m: Column) -> Column:
        grade = F.trim(cap(m, p, 1))
        grade = F.when(hit(grade, r"\bbeef\b"), grade).otherwise(F.concat(grade, F.lit(" Beef")))
        listed = F.concat_ws(",", F.regexp_replace(F.trim(cap(m, p, 2)), ci(r"\s+or\s*$"), ""), cap(m, p, 3))
        parts = F.filter(F.transform(F.split(listed, ci(r",\s*|\s+or\s+")), lambda x: F.trim(x)), lambda x: x != "")
        return F.array_join(F.transform(parts, lambda c: F.concat_ws(" ", grade, named(c))), " or ")

    return sub_each(title, p, rewrite)


def _salads(title: Column) -> Column:
    brand = rf"(?:{V.SALAD_WORD}(?:\s+{V.SALAD_WORD})*)"

    def spread(p: str, k: int):
        def rewrite(m: Column) -> Column:
            noun = F.regexp_replace(F.trim(cap(m, p, k + 1)), ci(_OR), "__OR__")
            return _or_list(*(F.concat_ws(" ", F.trim(cap(m, p, i)), noun) for i in range(1, k + 1)))

        return rewrite

    trio = rf"\b({brand}),\s*({brand})\s+or\s+({brand})\s+({V.SALAD_NOUN})\b"
    pair = rf"\b({brand})\s+or\s+({brand})\s+({V.SALAD_NOUN})\b"
    return sub_each(sub_each(title, trio, spread(trio, 3)), pair, spread(pair, 2))


def _prepared(title: Column) -> Column:
    p = rf"\b((?:{V.PLAIN_WORD}\s+)??)([A-Za-z]+)\s+or\s+([A-Za-z]+)\s+({V.PREP_NOUN})\b"

    def rewrite(m: Column) -> Column:
        pre, a, b, noun = (text(cap(m, p, i)) for i in (1, 2, 3, 4))
        return _or_list(_say(pre, a, noun), _say(pre, b, noun))

    return sub_each(title, p, rewrite)


_VARIETY = rf"(?:{V.PLAIN_WORD}(?:\s+{V.PLAIN_WORD})?)"


def _drop_lead(x: Column, lead: Column) -> Column:
    return F.trim(F.substring(x, F.length(lead) + 1, F.length(x)))


def _brand_split(pre: Column, a: Column, b: Column) -> Column:
    """struct<lead,a,tail>: brand pulled out of '<pre> a' when b does not carry it; tail = modifier b inherits."""
    full = _say(pre, a)
    from_full = _starts_with_any(full, ALL_BRANDS)
    own = F.lower(b).startswith(F.lower(from_full))
    from_a = _starts_with_any(a, ALL_BRANDS)
    return (
        F.when(from_full.isNotNull() & ~own, F.struct(from_full.alias("lead"), _drop_lead(full, from_full).alias("a"),
                                                      F.lit("").alias("tail")))
        .when(from_a.isNotNull() & ~F.lower(b).startswith(F.lower(from_a)), let(_drop_lead(a, from_a), lambda r: F.struct(
            from_a.alias("lead"), r.alias("a"), F.array_join(F.slice(_words(r), 1, F.greatest(
                F.size(_words(r)) - 1, F.lit(0))), " ").alias("tail"))))
        .otherwise(F.struct(F.trim(pre).alias("lead"), a.alias("a"), F.lit("").alias("tail")))
    )


def _shared_trio(title: Column) -> Column:
    p = rf"\b((?:{V.PLAIN_WORD}\s+)??)({_VARIETY}),\s*({_VARIETY})\s+or\s+({_VARIETY})\s+({HEAD}){V.SIZE_TAIL}\b"

    def rewrite(m: Column) -> Column:
        pre, a, b, c, noun, size = (F.trim(text(cap(m, p, i))) for i in range(1, 7))
        blocked = hit(a, V.UNIT_PATTERN) | hit(b, V.UNIT_PATTERN) | hit(c, V.UNIT_PATTERN) | _ends_in_head(pre) | _ends_in_head(
            a) | _ends_in_head(b) | _ends_in_head(c)
        lead = let(_brand_split(pre, a, b), lambda s: _or_list(
            _say(s["lead"], s["a"], noun, size), _say(s["lead"], b, noun, size), _say(s["lead"], c, noun, size)))
        return F.when(blocked, m).otherwise(lead)

    return sub_each(title, p, rewrite)


def _shared_pair(title: Column) -> Column:
    p = rf"\b((?:{V.PLAIN_WORD}\s+)??)({_VARIETY})\s+or\s+({_VARIETY})\s+({HEAD}){V.SIZE_TAIL}\b"

    def balance(s: Column, b: Column) -> Column:
        """A leading descriptor only the first variety has belongs to both."""
        wa, wb = _words(s["a"]), _words(b)
        extra = F.size(wa) - F.size(wb)
        return F.when((s["lead"] == "") & (extra > 0), F.struct(
            F.array_join(F.slice(wa, 1, F.greatest(extra, F.lit(0))), " ").alias("lead"),
            F.array_join(F.slice(wa, F.greatest(extra, F.lit(0)) + 1, F.greatest(F.size(wa), F.lit(0))), " ").alias("a"), s["tail"].alias("tail"))).otherwise(s)

    def rewrite(m: Column) -> Column:
        pre, a, b, noun, size = (F.trim(text(cap(m, p, i))) for i in range(1, 6))
        blocked = hit(a, V.UNIT_PATTERN) | hit(b, V.UNIT_PATTERN) | _ends_in_head(pre) | _ends_in_head(a) | _ends_in_head(b)
        out = let(_brand_split(pre, a, b), lambda s: let(balance(s, b), lambda q: _or_list(
            _say(q["lead"], q["a"], noun, size), _say(q["lead"], q["tail"], b, noun, size))))
        return F.when(blocked, m).otherwise(out)

    return sub_each(title, p, rewrite)


def _produce_list(title: Column) -> Column:
    word = rf"(?!or\b|and\b|{V.PRODUCE_LIST_NOUNS})[A-Za-z0-9']+"
    tok = rf"(?:{word}(?:\s+{word})?)"
    p = rf"\b((?:[A-Za-z0-9']+\s+)*(?:{V.PRODUCE_LIST_HEADS}))\s+({tok}(?:,\s*{tok})+)\s+or\s+({tok})\b"

    def rewrite(m: Column) -> Column:
        lead = F.trim(cap(m, p, 1))
        parts = F.filter(F.transform(F.split(F.concat_ws(",", cap(m, p, 2), cap(m, p, 3)), ","), lambda x: F.trim(x)), lambda x: x != "")
        return F.array_join(F.transform(parts, lambda x: F.concat_ws(" ", lead, x)), " or ")

    return sub_each(title, p, rewrite)


def _brand_sizes(title: Column) -> Column:
    size = (rf"(?:(?:{V.NUM}(?:\s*-\s*{V.NUM})?)\s*"
            r"(?:oz|ounce|lb|pound|ct|count|pk|pack|ltr|liter|quart|qt|pint|pt|gal|gallon|ml)\b[^\,]*?)")
    p = rf"\b([A-Za-z0-9'\s]+?)(?:\s+or\s+|\s*,\s*)([A-Za-z0-9'\s]+?)\s+({size})(?=\s+or\s+[A-Z]|,\s*[A-Z]|$)"
    known = [b.lower() for b in ALL_BRANDS]

    def rewrite(m: Column) -> Column:
        a, b, sz = (F.trim(text(cap(m, p, i))) for i in (1, 2, 3))
        food = F.exists(F.concat(_words(a), _words(b)), lambda w: one_of(F.lower(w), V.FOOD_KEYWORDS))
        ok = ((one_of(F.lower(a), known) | one_of(F.lower(b), known)) & ~food & (F.size(_words(a)) <= 2) & (F.size(_words(b)) <= 2)
              & ~hit(a, V.UNIT_PATTERN) & (F.length(a) > 2) & (F.length(b) > 2))
        return F.when(ok, F.concat(a, F.lit(" "), sz, F.lit(", "), b, F.lit(" "), sz)).otherwise(m)

    return sub_each(title, p, rewrite)


def pre_expand(title: Column) -> Column:
    """Rewrite compound lists so that every product carries its own noun, brand and size."""
    unit = r"((?:\d+(?:\.\d+)?|\.\d+)\s*(?:lb|oz|ct|count|pk|pack|qt|pt|gal)\.?)"
    style = "(Chunk|Shredded|Sliced|String|Block)"
    size = rf"({V.NUM}(?:\s*-\s*{V.NUM})?\s*(?:oz|ounce|lb|pound|ct|count|pk|pack))"
    plain = lambda p, r: lambda c: F.regexp_replace(c, ci(p), r)
    steps = [
        plain(r"\b(?:Cans|Bottles)\s+or\s+(?:Bottles|Cans)\b", "Cans/Bottles"),
        _poultry, _beef,
        plain(rf"\b(Greenhouse\s+Grown)\s+({V.GROWN_NEXT_BRANDS})\b", "$1, $2"),
        _salads, _prepared, _shared_trio, _shared_pair,
        plain(rf"\b([A-Za-z0-9'\s]+?\b)\s+{unit}\s+or\s+{unit}\b", "$1 $2 or $1 $3"),
        _produce_list,
        plain(rf"\b((?:[A-Za-z0-9'\s]+\s+)?){style}\s+Cheese\s+{style}\s+Cheese\s+{size}\b", "$1$2 Cheese $4 or $1$3 Cheese $4"),
        _brand_sizes,
    ]
    return reduce(lambda c, f: f(c), steps, title)
