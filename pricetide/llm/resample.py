"""Target-distribution importance resampling: draw the documents that look most like a target collection, with random ties to chance.

Features are all runs of one to three consecutive words, hashed to BUCKETS buckets by crc32. A bucket's gain is the log ratio of its share
in the target and in the documents; a document's weight is the sum of its features' gains, looked up in one array of BUCKETS numbers
(the only thing that is broadcast, of the same size for any input). A score adds Gumbel noise from a hash of the id, so the best scores are
a sample without replacement in proportion to the weights.

The cutoff is found by weighted median-of-medians selection: in each round every partition gives the medians of the keys that it has left
above and below the last pivot; the median of these medians, weighted by the numbers left, is the next pivot, so that a quarter of what
is left goes for sure. Keys are (score, doc_id, place in the stored table) and never equal, so the cutoff is exact. Only the winners are sorted:
by ranges, numbered within each part and shifted by the sums of the parts before.

Features' crc32 values come from those of single words by the shift tables of the polynomial, many words at a time.

Defined results: a text without words or null has no features and weighs 0; a null id counts as the empty text in the hash and comes last in
ties; repeated rows compete each; no rows give no rows; a target without text gives every bucket its share of nothing. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.common import checkpoint_folder, table

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = "42"
#: Bytes of text that are worked on at once; a longer document is worked on alone.
BLOCK = 1 << 21
#: Words of more bytes have no shift table; their features are hashed one by one.
TABLED = 64
#: Keys left, over all partitions, that end the selection rounds.
FEW = 4_096
_TABLES: list[np.ndarray] = []


def crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte's step of crc32; what n zero bytes do to each of its four bytes, for n up to TABLED; the bytes that belong to words, in lower case or 0."""
    if not _TABLES:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = (step >> 1) ^ np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0))
        shift = np.empty((TABLED + 1, 4, 256), np.uint32)
        shift[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for n in range(TABLED):
            shift[n + 1] = step[shift[n] & 255] ^ (shift[n] >> 8)
        letter = np.zeros(256, np.uint8)
        for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
            letter[low : high + 1] = np.arange(low, high + 1)
        letter[0x41:0x5B] = letter[0x61:0x7B]
        _TABLES.extend([step, shift, letter])
    return _TABLES[0], _TABLES[1], _TABLES[2]


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc32 values as n more bytes (at most TABLED) shift them."""
    shift = crc_tables()[1].reshape(-1)
    at = n.astype(np.int64) << 10
    return shift[at + (crc & 255)] ^ shift[at + 256 + (crc >> 8 & 255)] ^ shift[at + 512 + (crc >> 16 & 255)] ^ shift[at + 768 + (crc >> 24)]


def spaced(crc: np.ndarray) -> np.ndarray:
    """crc32 of what the values stand for and one space more."""
    step = crc_tables()[0]
    c = ~crc
    return ~(step[(c ^ np.uint32(32)) & 255] ^ (c >> 8))


def features(text: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Of joined texts (UTF-8 bytes; ends[i] is where text i ends): crc32 and text number of each feature, by length of the run; words of each text."""
    step, _, letter = crc_tables()
    low = letter[text]
    inside = np.concatenate([[False], low > 0, [False]])
    edge = inside[1:] != inside[:-1]
    edge[ends[:-1]] |= inside[1:][ends[:-1]] & inside[:-1][ends[:-1]]  # where a word ends a text and another begins the next
    begins, stops = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
    size = stops - begins
    owner = np.searchsorted(ends, begins, "right")
    crc, order = np.full(len(size), 0xFFFFFFFF, np.uint32), np.argsort(-np.minimum(size, TABLED + 1), kind="stable")
    by_size = np.minimum(size, TABLED + 1)[order]
    for j in range(TABLED):
        live = order[np.searchsorted(-by_size, -TABLED) : np.searchsorted(-by_size, -j)]
        if not len(live):
            break
        c = crc[live]
        crc[live] = step[(c ^ low[begins[live] + j]) & 255] ^ (c >> 8)
    crc = ~crc
    long = size > TABLED
    for i in np.flatnonzero(long):
        crc[i] = zlib.crc32(low[begins[i] : stops[i]].tobytes())
    out, run = [(crc, owner)], crc
    for k in range(1, LONGEST_RUN):
        if len(size) <= k:
            break
        run = moved(spaced(run[:-1]), np.minimum(size[k:], TABLED)) ^ crc[k:]
        same = owner[k:] == owner[:-k]
        for i in np.flatnonzero(long[k:] & same):
            run[i] = zlib.crc32(b" ".join(low[begins[i + j] : stops[i + j]].tobytes() for j in range(k + 1)))
        out.append((run[same], owner[k:][same]))
    return out, np.bincount(owner, minlength=len(ends))


def blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Joined bytes and ends of some texts after the other; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
        yield data[at[first] : at[last]], at[first + 1 : last + 1] - at[first]
        first = last


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features in each bucket over all rows of (text); tasks send at most BUCKETS sums each."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for data, ends in blocks(batch.column(0)):
                for crc, _ in features(data, ends)[0]:
                    n += np.bincount(crc % np.uint32(BUCKETS), minlength=BUCKETS)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for row in texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """A bucket's gain in thousandths of a nat."""
    s, t = bucket_counts(docs), bucket_counts(target)
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log(float((int(b) + 1) * (all_s + BUCKETS)) / float((int(a) + 1) * (all_t + BUCKETS)))) for a, b in zip(s, t, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            words, found, weight = [], [], []
            for data, ends in blocks(batch.column(1)):
                runs, n = features(data, ends)
                sums, counts = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
                for crc, owner in runs:
                    sums += np.bincount(owner, gain[crc % np.uint32(BUCKETS)], len(ends)).astype(np.int64)  # whole numbers, exact in doubles
                    counts += np.bincount(owner, minlength=len(ends))
                words.append(n), found.append(counts), weight.append(sums)
            if words:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (words, found, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise of an id in thousandths of a nat."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def cutoff(keys: DataFrame, wanted: int) -> tuple[int, int, int] | None:
    """The wanted-th of the distinct keys (a, b, c), least first; None for the 0th. keys is a stored table that is read once a round."""
    if not wanted:
        return None

    def medians(after: tuple | None, upto: tuple | None, pivot: tuple | None) -> list:
        """From each partition: the number and the median of the keys in (after, pivot] and in (pivot, upto]; without a pivot, all in one."""

        def less(rows: np.ndarray, key: tuple) -> np.ndarray:
            a, b, c = rows
            return (a < key[0]) | ((a == key[0]) & ((b < key[1]) | ((b == key[1]) & (c <= key[2]))))

        def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sides: tuple[list, list] = ([], [])
            for batch in batches:
                rows = np.stack([x.to_numpy(zero_copy_only=False) for x in batch.columns])
                if after is not None:
                    rows = rows[:, ~less(rows, after)]
                if upto is not None:
                    rows = rows[:, less(rows, upto)]
                low = less(rows, pivot) if pivot is not None else np.ones(rows.shape[1], bool)
                sides[0].append(rows[:, low]), sides[1].append(rows[:, ~low])
            for side, parts in enumerate(sides):
                if parts and (rows := np.concatenate(parts, 1)).shape[1]:
                    rows = rows[:, np.lexsort(rows[::-1])]
                    mid = rows[:, (rows.shape[1] - 1) // 2]
                    yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (side, rows.shape[1], *mid)], names=["side", "n", "a", "b", "c"])

        return [(r.side, r.n, (r.a, r.b, r.c)) for r in keys.select("a", "b", "c").mapInArrow(halves, "side long, n long, a long, b long, c long").collect()]

    after, upto, pivot = None, None, None
    found = medians(None, None, None)
    while True:
        low = sum(n for side, n, _ in found if side == 0)
        if pivot is not None:
            if wanted <= low:
                upto, side = pivot, 0
            else:
                after, side, wanted = pivot, 1, wanted - low
        else:
            side = 0
        mine = sorted((key, n) for s, n, key in found if s == side)
        left = sum(n for _, n in mine)
        if left <= FEW:
            break
        seen = 0
        for pivot, n in mine:
            seen += n
            if 2 * seen >= left:
                break
        found = medians(after, upto, pivot)
    held = keys
    if after is not None:
        held = held.where(~not_above(*after))
    if upto is not None:
        held = held.where(not_above(*upto))
    return sorted(tuple(r) for r in held.select("a", "b", "c").collect())[wanted - 1]  # at most FEW keys


def not_above(a: int, b: int, c: int) -> Column:
    return (F.col("a") < a) | ((F.col("a") == a) & ((F.col("b") < b) | ((F.col("b") == b) & (F.col("c") <= c))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn) of each row of (doc_id, text); target has a column text."""
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/resample-{uuid.uuid4()}"
    last = F.lit((1 << 63) - 1)
    scored = weighed(docs, gains(docs, target)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored.withColumns({"a": -F.col("score"), "b": F.coalesce("doc_id", last), "c": F.monotonically_increasing_id()}).write.parquet(f"{folder}/scored")
    scored = spark.read.parquet(f"{folder}/scored")
    able = scored.where(F.col("n_words") >= least_words)
    key = cutoff(able, able.count() * percent // 100)
    plain = ["doc_id", "n_words", "n_features", "weight", "score"]
    if key is None:
        return scored.select(*plain, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & not_above(*key)
    at = F.monotonically_increasing_id()
    ordered = scored.where(drawn).repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c")
    ordered.select(*plain, at.alias("at")).write.parquet(f"{folder}/drawn")
    ordered = spark.read.parquet(f"{folder}/drawn").withColumn("part", F.shiftright("at", 33))
    before, sums = 0, []
    for row in sorted(ordered.groupBy("part").count().collect()):  # one row a part
        sums.append((row.part, before))
        before += row["count"]
    sums = spark.createDataFrame(sums, "part long, before long")
    ranked = ordered.join(sums, "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return ranked.select(*plain, "rank").unionByName(scored.where(~drawn).select(*plain, F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 byte by byte; its table is made by the rule. Features are counted by their bytes once, then joined back.
OP13_SQL = f"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
),
runs AS (
  SELECT kind, id, unnest(list_concat(w, list_concat(
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS f
  FROM words
),
counted AS (SELECT kind, id, f, count(*) AS n FROM runs GROUP BY ALL),
buckets AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode(f))), 2), lambda i: ('0x' || hex(encode(f))[i:i + 1])::BIGINT)),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), crc
),
per AS (SELECT kind, id, bucket, sum(n) AS n FROM counted JOIN buckets USING (f) GROUP BY ALL),
sums AS (SELECT bucket, sum(n) FILTER (kind = 'd') AS s, sum(n) FILTER (kind = 'b') AS t FROM per GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM sums) + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM sums) + 10000))::DOUBLE)) AS gain
  FROM sums
),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(len(w), 0) AS n_words,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
  FROM documents d LEFT JOIN words v ON v.kind = 'd' AND v.id = d.doc_id
  LEFT JOIN (SELECT id, sum(n) AS n, sum(n * gain) AS weight FROM per JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY id) x ON x.id = d.doc_id
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
