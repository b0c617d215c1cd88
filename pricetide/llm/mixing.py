"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target in words is spread over its documents as certain whole copies plus a sample of the documents for the rest.
Each document has a uniform number u from a hash of its id, and inclusion odds that grow with the square root of its length; the sample
takes documents by rising (u / (1 - u)) / odds until the rest is reached. The last document gives only the words still missing, so a
source's taken words are its rounded target exactly.

The order of a source is never sorted in one task. Ranks are mapped to (0, 1) and cut into bins; sums of words per bin (combined before
the shuffle) tell which bin holds the boundary, that bin is cut again, and only the documents of the last bin are put in order.

Defined results: a null text or a text without words has size 0 and is never taken; null sources form one source, in the last place;
rows repeated with the same id are separate documents with the same rank; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricetide.llm.common import cut, table, word_count

#: Weights of sources in their order, repeating; words of the mix as a share of all words, in halves; most words of a source, in its sizes.
WEIGHTS = (5, 2, 1)
SHARE_HALVES = 3
MOST = 2
#: Bins into which ranks are cut at each level.
BINS = 1024
SEED = "mix-1"


def uniform(key: Column, seed: str) -> Column:
    """A number inside (0, 1) that depends on the key and the seed alone: 52 bits of an MD5 sum."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, halves: int = SHARE_HALVES, most: int = MOST) -> DataFrame:
    """Adds weight and target to (source, source_size, ...): shares by weight, stopped at most times the size, the excess reshared by weight.

    Sources in the order of (largest share) / weight reach their stop first, so one pass of running sums finds who stops. One row per source.
    """
    everything = W.partitionBy()
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    by_stop = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("source_size").over(by_stop.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    from_here = F.sum("weight").over(by_stop.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    stops = (halves * total - 2 * most * before) * F.col("weight") >= 2 * most * F.col("source_size") * from_here
    marked = weighed.withColumn("stops", stops).withColumn("total", total)
    left = F.lit(halves) * F.col("total") - 2 * most * F.sum(F.when(F.col("stops"), F.col("source_size")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).over(everything)
    shared = F.col("weight").cast("double") * left.cast("double") / (2 * open_weight).cast("double")
    return marked.withColumn("target", F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(shared)).drop("stops", "total")


def pareto_take(sized: DataFrame, seed: str = SEED, bins: int = BINS) -> DataFrame:
    """Adds taken to (doc_id, source, size, source_size, n_full, target): words that the mix takes of each document."""
    quota = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
    rest = quota - whole * F.col("source_size")
    u = uniform(F.col("doc_id"), seed)
    share = F.col("rest").cast("double") / F.col("source_size").cast("double")
    length = F.sqrt(F.col("size").cast("double") * F.col("n_full").cast("double") / F.col("source_size").cast("double"))
    ranked = sized.withColumn("whole", whole).withColumn("rest", rest)
    ranked = ranked.withColumn("rank", F.when((F.col("rest") > 0) & (F.col("size") > 0), (u / (1 - u)) / (share / (1 - share) * length)))
    ranked = ranked.withColumn("place", F.col("rank") / (1 + F.col("rank")))
    ranked = cut(ranked.select("doc_id", "source", "size", "source_size", "target", "whole", "rest", "rank", "place"))

    edge = ranked.where("rank is not null").select("source", "rest").distinct().withColumns({"low": F.lit(0), "done": F.lit(0).cast("long")})
    width = 1
    for _ in range(2):
        inside = ranked.where("rank is not null").join(edge.withColumnRenamed("rest", "goal").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        inside = inside.where(F.floor(F.col("place") * width) == F.col("low"))
        width *= bins
        sums = inside.groupBy("source", "rest", "done", F.floor(F.col("place") * width).alias("low")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(W.partitionBy("source").orderBy("low"))
        edge = (
            sums.withColumn("upto", F.col("done") + upto).where("upto >= rest")
            .groupBy("source", "rest").agg(F.min_by(F.struct("low", (F.col("upto") - F.col("words")).alias("done")), "low").alias("x"))
            .select("source", "rest", "x.low", "x.done")
        )
        edge = cut(edge)
    edge = edge.select(F.col("source").alias("of"), F.col("low").alias("edge_low"), F.col("done").alias("edge_done"))
    placed = ranked.join(edge, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("bin", F.floor(F.col("place") * width))
    known = F.col("whole") * F.col("size")
    first = placed.where("rank is null or bin <> edge_low").withColumn("taken", known + F.when(F.col("bin") < F.col("edge_low"), F.col("size")).otherwise(0))
    order = W.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    missing = F.col("rest") - F.col("edge_done") - F.sum("size").over(order) + F.col("size")
    last = placed.where("bin = edge_low").withColumn("taken", known + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), missing)))
    return first.unionByName(last).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame) -> DataFrame:
    """Sizes, targets and taken words of (doc_id, text, source)."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("n_full"))
    targets = source_targets(totals).withColumnRenamed("source", "of").drop("weight")
    return pareto_take(sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with their columns, size, source_size, target and taken words; rows with one id share the most."""
    taken = mix(docs).where("taken > 0").groupBy(F.col("doc_id").alias("__id"))
    taken = taken.agg(F.max_by(F.struct("size", "source_size", "target", "taken"), "taken").alias("__mix"))
    clear = docs.drop("size", "source_size", "target", "taken")
    return clear.join(taken, F.col("doc_id").eqNullSafe(F.col("__id"))).select(*clear.columns, "__mix.*")


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


OP2_SQL = f"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size from documents
), totals as (
  select source, cast(sum(size) as bigint) as source_size, count(*) filter (size > 0) as n_full from sized group by source
), weighed as (
  select *, [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as weight, sum(source_size) over () as total from totals
), marked as (
  select *, (3 * total - 4 * coalesce(sum(source_size) over (by_stop rows between unbounded preceding and 1 preceding), 0)) * weight
    >= 4 * source_size * sum(weight) over (by_stop rows between current row and unbounded following) as stops
  from weighed window by_stop as (order by source_size / weight, source nulls last)
), targets as (
  select source, source_size, n_full, case when stops then cast(2 * source_size as double) else
    cast(weight as double) * cast(3 * total - 4 * sum(case when stops then source_size else 0 end) over () as double)
    / cast(2 * sum(case when stops then 0 else weight end) over () as double) end as target
  from marked
), quotas as (
  select *, cast(floor(target + 0.5) as bigint) as quota, case when source_size > 0 then cast(floor(target + 0.5) as bigint) // source_size else 0 end as whole from targets
), ranked as (
  select d.doc_id, d.size, d.source, q.source_size, q.target, q.whole, q.quota - q.whole * q.source_size as rest,
    (cast(cast('0x' || substr(md5('{SEED}:' || cast(d.doc_id as varchar)), 1, 13) as bigint) as double) + 0.5) / 4503599627370496.0 as u,
    cast(q.quota - q.whole * q.source_size as double) / cast(q.source_size as double) as share,
    sqrt(cast(d.size as double) * cast(q.n_full as double) / cast(q.source_size as double)) as length
  from sized d join quotas q on d.source is not distinct from q.source
), ordered as (
  select *, case when rest > 0 and size > 0 then (u / (1 - u)) / (share / (1 - share) * length) end as rnk from ranked
)
select doc_id, size, source_size, target, cast(whole * size + case when rnk is null then 0 else greatest(0, least(size, rest - (sum(size) over (
  partition by source order by rnk nulls last, doc_id, size rows between unbounded preceding and current row) - size))) end as bigint) as taken
from ordered
"""
