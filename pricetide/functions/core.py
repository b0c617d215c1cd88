"""Small building blocks shared by every operator: exact rounding, text helpers, local bindings."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN_DAY = "0001-01-01"


def ci(pattern: str) -> str:
    """Case-insensitive form of a regular expression (Unicode folding only where it is needed)."""
    return ("(?i)" if pattern.isascii() else "(?iu)") + pattern


def hit(col: Column, pattern: str) -> Column:
    """True when the pattern is found; false (never null) for null text."""
    return F.coalesce(col.rlike(ci(pattern)), F.lit(False))


def cap(col: Column, pattern: str, group: int = 1) -> Column:
    """Captured group of the first match, null when there is none."""
    return F.nullif(F.regexp_extract(col, ci(pattern), group), F.lit(""))


def num(col: Column) -> Column:
    return col.try_cast("double")


def has(col: Column, needle: str) -> Column:
    """Case-insensitive containment of a literal."""
    return F.coalesce(F.contains(F.lower(col), F.lit(needle.lower())), F.lit(False))


def has_any(col: Column, needles: Sequence[str]) -> Column:
    """Any of the literals occurs in the text, ignoring case: one pass with one alternation."""
    return hit(col, "|".join(escape(n) for n in needles))


def escape(text: str) -> str:
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|/&" else ch for ch in text)


def word_any(col: Column, words: Sequence[str]) -> Column:
    return hit(col, r"\b(?:" + "|".join(escape(w) for w in words) + r")\b")


def blank(col: Column) -> Column:
    """Null for null or empty text."""
    return F.nullif(col, F.lit(""))


def text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def truthy_text(col: Column) -> Column:
    """Whether there is any text."""
    return F.coalesce(F.length(col.cast("string")) > 0, F.lit(False))


def squash(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def strip_marks(col: Column) -> Column:
    """Trim blanks, commas, full stops and hyphens from both ends."""
    return F.btrim(col, F.lit(" ,.-"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def only_some(value: Column) -> Column:
    """Generator form of "compute, then keep the row if not null".

    A filter on a computed column is pushed below its projection and computes it a second time; exploding a
    list of at most one element drops the same rows after a single evaluation.
    """
    return F.explode(F.array_compact(F.array(value)))


def sub_each(col: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Replace every match by an expression of the matched text.

    The text is cut at the matches; the pieces between them and the rewritten matches are then zipped
    together again.  ``rewrite`` receives the matched text and must not return null.
    """
    regex = F.lit(ci(pattern))

    def rebuild(whole: Column) -> Column:
        gaps = F.split(whole, ci(pattern), -1)
        found = F.transform(F.regexp_extract_all(whole, regex, F.lit(0)), rewrite)
        return F.array_join(F.flatten(F.zip_with(gaps, found, lambda g, f: F.array(g, F.coalesce(f, F.lit(""))))), "")

    return let(col, lambda c: F.when(c.rlike(ci(pattern)), rebuild(c)).otherwise(c))


def first_rule(col: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first pattern that matches (order is meaning), else null."""

    def chain(t: Column) -> Column:
        out = None
        for pattern, label in rules:
            cond = t.rlike(ci(pattern))
            out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
        return out

    return let(col, chain)


def sql_literal(x: object) -> str:
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{x!r}D" if isinstance(x, float) else str(x)


def lookup(col: Column, pairs: Sequence[tuple], default: Column | None = None) -> Column:
    """Constant table lookup as one literal map (null keys find nothing)."""
    table = F.expr("map(" + ", ".join(sql_literal(x) for pair in pairs for x in pair) + ")")
    found = F.try_element_at(table, col)
    return found if default is None else F.coalesce(found, default)


def one_of(col: Column, values: Sequence[str]) -> Column:
    """Membership in a constant list; false for null."""
    listed = F.expr("array(" + ", ".join(sql_literal(v) for v in values) + ")")
    return F.coalesce(F.array_contains(listed, col), F.lit(False))


def exact_round(x: Column, digits: int) -> Column:
    """Round the *binary* value half-to-even, as IEEE-aware languages do (2.675 -> 2.67).

    ``x * 2 * 10^digits`` is formed with its exact rounding error (split product), so a value that only
    looks like a tie in decimal is sent to the side its binary expansion lies on.
    """
    c, unit = 2.0 * 10**digits, float(10**digits)
    scaled = x * F.lit(c)

    def tie(v: Column) -> Column:
        t = v * F.lit(134217729.0)
        hi = t - (t - v)
        err = (hi * F.lit(c) - v * F.lit(c)) + (v - hi) * F.lit(c)
        k = (v * F.lit(c) - 1.0) / 2.0
        return F.when(err > 0, k + 1.0).when(err < 0, k).otherwise(k + F.pmod(k, F.lit(2.0))) / F.lit(unit)

    return F.when(F.pmod(scaled, F.lit(2.0)) == 1.0, let(x, tie)).otherwise(
        F.floor((scaled + 1.0) / 2.0).cast("double") / F.lit(unit))


def nudged_cents(x: Column) -> Column:
    """Price rounded to cents after the tiny upward nudge, floored at zero."""
    return F.greatest(F.lit(0.0), exact_round(x + F.lit(1e-9), 2))


def fixed(x: Column, digits: int = 2) -> Column:
    """Decimal text with a fixed number of digits; null stays null (FORMAT_STRING would print it)."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def money(x: Column) -> Column:
    return F.concat(F.lit("$"), fixed(x, 2))


def whole(x: Column) -> Column:
    """Integer part as text."""
    return x.cast("bigint").cast("string")


def unit_cost(price: Column, size: Column) -> Column:
    """Price per unit with four decimals; null without a positive size."""
    return F.when(size > 0, exact_round(price / F.nullif(size, F.lit(0.0)), 4))


def once_per(df: DataFrame, texts: Sequence[str], name: str, rule: Callable[..., Column]) -> DataFrame:
    """Adds a column that follows from a few texts. Its rules run once for each distinct combination of them, not once a row, and spread over
    many tasks: adaptive execution would put the short list of texts into one."""
    named = df.select(*(F.col(x).alias(f"of_{x}") for x in texts)).distinct().repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    named = named.withColumn("of", rule(*(F.col(f"of_{x}") for x in texts)))
    same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"of_{x}")) for x in texts])
    return df.join(named, same).withColumn(name, F.col("of")).drop("of", *(f"of_{x}" for x in texts))


def day_of(stamp: Column) -> Column:
    """Calendar day from the first ten characters; time zones are never applied."""
    return F.try_to_date(F.substring(stamp.cast("string"), 1, 10), "yyyy-MM-dd")


def day10(stamp: Column) -> Column:
    return F.substring(text(stamp.cast("string")), 1, 10)


def like_ci(col: Column, part: str) -> Column:
    """SQL LIKE '%part%' ignoring ASCII case, with the part taken literally."""
    return F.contains(F.lower(col), F.lit(part.lower()))


def truthy(x: Column) -> Column:
    """Null for null and zero: a price of zero counts as missing in fallback ladders."""
    return F.when(x != 0, x)


def checkpoint_dir(spark: SparkSession) -> str:
    """Reliable checkpoint folder: the session's own setting, else one for a local test run."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an intermediate result in the shared checkpoint folder, as Parquet: a checkpoint() writes the same rows without columns or compression.

    Partitions are not kept; what needs them takes ``pinned``.
    """
    spark = df.sparkSession
    folder = f"{spark.sparkContext.getCheckpointDir() or checkpoint_dir(spark)}/stage-{uuid.uuid4()}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def pinned(df: DataFrame) -> DataFrame:
    """Materialise an intermediate result with its partitions and the order of their rows."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()
