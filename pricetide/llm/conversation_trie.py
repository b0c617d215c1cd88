"""A prefix trie of conversations that share their first turns, with subtree totals by parallel tree contraction.

Every conversation c is rebuilt: the first h turns of conversation c - c % BLOCK (all, if it has fewer), then its own turns after its first h, with
h = crc32(c) % SHARED. A node is a distinct sequence of first turns; its totals over its subtree (childless nodes, tokens that sharing saves) are summed by
contraction: a round rakes every leaf into its parent and compresses chains, where a node with one child makes way if it draws heads
and that child can't. A chain's nodes draw the next bit of their depth, so a round halves it; later rounds draw hashes. A round is one map-side
aggregation and two joins on unique ids over what is left, a constant part less each time. Then rounds are undone, last first: a
leaf's total is what it held when raked, a compressed node's is what it held more than its child, plus that child's total.

No text is shuffled: turns travel as digest and length. Turns are sorted by ranges of (conversation, turn), so that a conversation with a third of all
rows spans many parts; its positions and running sums are those within a part plus the sums of the parts before. A prefix is known by its depth
and the sums (128 bits) of hashes of its turns with their places. A node's ends are packed to strings in sorted parts before they are digested in a stream,
so no list of ids is ever held.

Defined results: rows without a conversation id belong to none; turns with equal numbers are in the order of md5 of role and text; a repeated row is
one more turn; null role or text is empty; c % BLOCK has the sign of c; no conversations give no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricetide.llm.common import checkpoint_folder, table

BLOCK, SHARED = 100, 6
#: Letters of packed ids in one row.
PACKED = 1 << 16
#: Digits of a prefix's key: sums of 32-bit hashes stay below 2^63 for 2^31 turns.
SUMS = ("s1", "s2", "s3", "s4")
PARTS = ("f1", "f2", "f3", "f4")
KEY = ["depth", *SUMS]
LOW = (1 << 32) - 1


def stored(df: DataFrame, path: str) -> DataFrame:
    """df, written once and read from the shared folder."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashes(depth: Column, digest: Column) -> dict[str, Column]:
    """Four numbers of 32 bits for a turn in its place."""
    a, b = F.xxhash64(depth, digest), F.xxhash64(F.lit("second"), digest, depth)
    return dict(zip(PARTS, (a.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(a, 32), b.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(b, 32)), strict=True))


def members(conversations: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows of (conv_id, depth, chars, last, sums and hashes) for each turn of each rebuilt conversation; (conv_id, turns) of every one."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"), F.length(text).cast("long").alias("chars")
    ).where("conv_id is not null")
    order = ["conv_id", "turn", "digest", "row"]
    sort = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    turns = stored(sort.select("conv_id", "digest", "chars", F.monotonically_increasing_id().alias("at")), f"{folder}/turns")
    turns = turns.select("conv_id", "digest", "chars", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))

    pieces = turns.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    each = pieces.groupBy("conv_id").agg(F.sum("n").alias("n_own"))
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    shared = F.when(base == F.col("conv_id"), 0).otherwise(F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED)))
    bases = each.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    each = each.withColumns({"base": base, "h": shared}).join(bases, "base", "left")
    each = each.withColumn("b", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("turns", F.greatest(F.col("n_own") - F.col("h"), F.lit(0)) + F.col("b"))
    each = stored(each.select("conv_id", "base", "n_own", "h", "b", "turns"), f"{folder}/each")

    upto = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(each, "conv_id").select("conv_id", "part", "first", "before", "n_own", "h", "b")
    own = turns.join(pieces, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("place") - F.col("first") + 1).where("pos > h")
    own = own.withColumn("depth", F.col("pos") - F.col("h") + F.col("b")).withColumns(hashes(F.col("depth"), F.col("digest")))
    running = W.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    own = own.select("conv_id", "part", "depth", "chars", (F.col("pos") == F.col("n_own")).alias("last"), *PARTS, *(F.sum(f).over(running).alias(s) for s, f in zip(SUMS, PARTS, strict=True)))
    own = stored(own, f"{folder}/own")
    carried = own.groupBy("conv_id", "part").agg(*(F.sum(f).alias(f) for f in PARTS))
    carried = carried.select("conv_id", "part", *(F.sum(f).over(upto).alias(f"c{f}") for f in PARTS)).where("cf1 is not null")  # at most one row a part
    own = own.join(F.broadcast(carried), ["conv_id", "part"], "left").withColumns({s: F.col(s) + F.coalesce(f"c{f}", F.lit(0)) for s, f in zip(SUMS, PARTS, strict=True)})

    first = own.where((base == F.col("conv_id")) & (F.col("depth") < SHARED)).select(F.col("conv_id").alias("base"), "depth", "chars", *PARTS, *SUMS)
    lent = each.where("b > 0").join(first, "base").where("depth <= b").withColumn("last", (F.col("n_own") <= F.col("h")) & (F.col("depth") == F.col("b")))
    lent = stored(lent.select("conv_id", "depth", "chars", "last", *PARTS, *SUMS, (F.col("depth") == F.col("b")).alias("joint")), f"{folder}/lent")
    joint = lent.where("joint").select("conv_id", *(F.col(s).alias(f"b{s}") for s in SUMS))
    own = own.join(joint, "conv_id", "left").withColumns({s: F.col(s) + F.coalesce(f"b{s}", F.lit(0)) for s in SUMS})
    plain = ["conv_id", "depth", "chars", "last", *PARTS, *SUMS]
    return own.select(*plain).unionByName(lent.select(*plain)), each.select("conv_id", "turns")


def ends_digest(ends: DataFrame) -> DataFrame:
    """ends_sha256 of each key of (key columns, conv_id): ids in order, joined by commas; no node's ids are held together."""
    names, schema = [*KEY, "first", "ids"], ", ".join(f"{c} long" for c in KEY)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in list(zip(*rows, strict=True))[:-1]), pa.array([r[-1] for r in rows], pa.string())], names=names)

        key, first, ids, letters, rows = None, 0, [], 0, []
        for batch in batches:
            for *now, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key or letters > PACKED:
                    if ids:
                        rows.append((*key, first, ",".join(ids)))
                    key, first, ids, letters = now, conv, [], 0
                ids.append(str(conv))
                letters += len(ids[-1]) + 1
            if rows:
                yield out(rows)
                rows = []
        if ids:
            yield out([(*key, first, ",".join(ids))])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in list(zip(*rows, strict=True))[:-1]), pa.array([r[-1] for r in rows], pa.string())], names=[*KEY, "ends_sha256"])

        key, sha, rows = None, None, []
        for batch in batches:
            for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if key is not None:
                        rows.append((*key, sha.hexdigest()))
                    key, sha = now, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if rows:
                yield out(rows)
                rows = []
        if key is not None:
            yield out([(*key, sha.hexdigest())])

    ends = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(packed, f"{schema}, first long, ids string")
    return ends.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digested, f"{schema}, ends_sha256 string")


def subtree_totals(tree: DataFrame, folder: str) -> DataFrame:
    """(c, d, leaves, saved) summed over each subtree of a tree of rows (c, d), parent (pc, pd; null at the root), number of children (kids) and own saved."""
    spark = tree.sparkSession
    zero = F.lit(0).cast("long")
    alive = tree.select("c", "d", "pc", "pd", "kids", F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("leaves"), "saved", zero.alias("el"), zero.alias("es"))
    none = F.lit(None).cast("long")
    alive = stored(alive.withColumns({"xc": none, "xd": none, "xl": none, "xs": none}), f"{folder}/alive-0")
    schema, rounds, deepest = alive.schema, 0, alive.agg(F.max("d")).first()[0] or 0
    while alive.count() > 1:
        drawn = F.shiftright("d", rounds) if rounds < deepest.bit_length() else F.xxhash64("c", "d", F.lit(rounds))
        heads = (F.col("kids") == 1) & F.col("pc").isNotNull() & (drawn.bitwiseAND(F.lit(1)) == 1)
        leaf = F.col("kids") == 0
        told = alive.where("pc is not null").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(
            F.count_if(leaf).alias("raked"), F.sum(F.when(leaf, F.col("leaves") + F.col("el")).otherwise(0)).alias("ml"), F.sum(F.when(leaf, F.col("saved") + F.col("es")).otherwise(0)).alias("ms"),
            F.min("c").alias("yc"), F.min("d").alias("yd"), F.min("el").alias("yl"), F.min("es").alias("ys"), F.max(heads).alias("child_heads"),
        )
        rest = alive.where(~leaf).join(told, ["c", "d"]).withColumns({"leaves": F.col("leaves") + F.col("ml"), "saved": F.col("saved") + F.col("ms"), "goes": heads & (F.col("raked") == 0) & ~F.col("child_heads")})
        gone = rest.where("goes").select(F.col("yc").alias("c"), F.col("yd").alias("d"), F.col("pc").alias("gc"), F.col("pd").alias("gd"), F.col("c").alias("xc"), F.col("d").alias("xd"), (F.col("leaves") + F.col("yl")).alias("xl"), (F.col("saved") + F.col("ys")).alias("xs"), F.col("el").alias("gl"), F.col("es").alias("gs"))
        kept = rest.where(~F.col("goes")).drop("xc", "xd", "xl", "xs").join(gone, ["c", "d"], "left")
        moved = F.col("xc").isNotNull()
        kept = kept.select(
            "c", "d", F.when(moved, F.col("gc")).otherwise(F.col("pc")).alias("pc"), F.when(moved, F.col("gd")).otherwise(F.col("pd")).alias("pd"), (F.col("kids") - F.col("raked")).alias("kids"), "leaves", "saved",
            F.when(moved, F.col("xl") + F.col("gl")).otherwise(F.col("el")).alias("el"), F.when(moved, F.col("xs") + F.col("gs")).otherwise(F.col("es")).alias("es"), "xc", "xd", "xl", "xs",
        )
        rounds += 1
        kept.write.parquet(f"{folder}/alive-{rounds}")
        alive = spark.read.schema(schema).parquet(f"{folder}/alive-{rounds}")

    total = ["c", "d", "leaves", "saved"]
    known = stored(alive.select(*total), f"{folder}/total-{rounds}")
    paths, kinds = [f"{folder}/total-{rounds}"], known.schema
    for r in range(rounds - 1, -1, -1):
        later, before = (spark.read.schema(schema).parquet(f"{folder}/alive-{x}") for x in (r + 1, r))
        back = later.where("xc is not null").select("c", "d", "xc", "xd", "xl", "xs").join(known, ["c", "d"])
        back = back.select(F.col("xc").alias("c"), F.col("xd").alias("d"), (F.col("leaves") + F.col("xl")).alias("leaves"), (F.col("saved") + F.col("xs")).alias("saved"))
        before.where("kids = 0 and pc is not null").select(*total).unionByName(back).write.parquet(f"{folder}/total-{r}")
        paths.append(f"{folder}/total-{r}")
        known = spark.read.schema(kinds).parquet(*paths)
    return known


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt (conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    folder = f"{checkpoint_folder(spark)}/trie-{uuid.uuid4()}"
    rows, each = members(conversations, folder)
    rows = stored(rows, f"{folder}/members")
    top = each.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), *(F.min(F.col(s) - F.col(f)).alias(f"p{s}") for s, f in zip(SUMS, PARTS, strict=True)))
    root = top.where("n_convs > 0").select(*(F.lit(0).cast("long").alias(c) for c in KEY), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"), *(F.lit(None).cast("long").alias(f"p{s}") for s in SUMS))
    nodes = stored(nodes.unionByName(root), f"{folder}/nodes")

    parents = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(s).alias(f"p{s}") for s in SUMS), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(parents.where("depth > 1"), ["depth", *(f"p{s}" for s in SUMS)])
    flat = nodes.where("depth <= 1").crossJoin(F.broadcast(top.select(F.col("conv_id").alias("parent_conv_id")))).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("parent_conv_id")))  # one row
    nodes = stored(deep.unionByName(flat), f"{folder}/linked")
    ends = rows.where("last").select(*KEY, "conv_id").unionByName(each.where("turns = 0").select(*(F.lit(0).cast("long").alias(c) for c in KEY), "conv_id"))
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    kids = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("c"), (F.col("depth") - 1).alias("d")).agg(F.count("*").alias("kids"))
    tree = nodes.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("parent_conv_id").alias("pc"), F.when(F.col("depth") > 0, F.col("depth") - 1).alias("pd"), "n_convs", saved, *SUMS)
    tree = tree.join(kids, ["c", "d"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    tree = tree.join(ends_digest(ends).withColumnRenamed("depth", "d"), ["d", *SUMS], "left")
    tree = stored(tree.select("c", "d", "pc", "pd", "n_convs", "saved", "kids", "ends_sha256"), f"{folder}/tree")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = tree.drop("saved").join(subtree_totals(tree, folder), ["c", "d"])
    return out.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("pc").alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: Whole paths as texts; crc32 byte by byte with a table made by the rule; every node's ancestors from its members.
OP12_SQL = f"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
convs AS (
  SELECT conv_id, conv_id - conv_id % {BLOCK} AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ord((conv_id::VARCHAR)[i])::BIGINT)),
      lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % {SHARED} AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc
),
own AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
rebuilt AS (
  SELECT c.conv_id, pos, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, pos, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND pos > h
),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, role, text FROM rebuilt),
paths AS (
  SELECT conv_id, depth, text, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
  UNION ALL SELECT conv_id, 0, '', '' FROM convs
),
members AS (SELECT conv_id, depth, text, min(conv_id) OVER (PARTITION BY path) AS node, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM paths),
nodes AS (SELECT node, depth, count(*) AS n_convs, (count(*) - 1) * max(length(text)) AS saved FROM members GROUP BY ALL),
linked AS (SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN members m ON m.conv_id = n.node AND m.depth = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY ALL),
ends AS (SELECT node, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM members WHERE last GROUP BY ALL),
full_nodes AS (SELECT l.*, coalesce(n, 0) AS n_children FROM linked l LEFT JOIN kids USING (node, depth)),
totals AS (
  SELECT m.node, m.depth, sum(x.saved) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM full_nodes x JOIN members m ON m.conv_id = x.node AND m.depth <= x.depth GROUP BY ALL
)
SELECT node AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, leaves AS n_leaves, t.saved::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM full_nodes f JOIN totals t USING (node, depth) LEFT JOIN ends USING (node, depth)
"""
