"""Removing repeated passages by super-k-mer partitioning.

A window is K consecutive words of a document. Its minimiser is the least hash of its runs of M words. Consecutive windows with the same
minimiser form a super-k-mer, which travels as one packed string (compressed with others of its task) to the bucket of that minimiser.
Equal windows have equal minimisers, so each bucket alone can sort its windows, compare them word by word, and find for every window the
smallest document that has it. A task sends equal super-k-mers once, with the places where they stand.

Hot minimisers: a first pass finds those that would fill a bucket by themselves (at most HOT, a bounded list for broadcast). Their super-k-mers
are dealt by minimiser and a salt of the document, as many salts as their share fills buckets. A salted bucket decides what it can; for each
different window it sends the digest and place of its smallest document, packed by the part that compares digests over the salts. A passage
held by a third of all rows is thus sorted in many buckets, and a window of it is compared once for each of them.

What comes back are word spans, joined to the documents by id and text hash.

Defined results: a null text has no words; texts under K words lose none; a null doc_id counts as larger than all others; rows repeated
with one id are one document, so they do not remove each other's words; no rows give no rows; other columns are kept out of the way.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.common import WORDS, cut, table

#: Words of a window and of a minimiser.
K, M = 50, 4
#: Hot minimisers at most; salts for each bucket that a hot minimiser would fill.
HOT, SALTS = 1 << 18, 4
#: Text in a bucket; text that a map task holds before it sends.
BUCKET_BYTES, HELD_BYTES = 5 << 20, 16 << 20
LAST = (1 << 63) - 1
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Powers:
    """Powers of an odd base modulo 2 ** 64 and of its inverse, kept for the longest stretch seen."""

    def __init__(self, base: int = 0x5851F42D4C957F2D):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            both = [np.full(n + n // 2 + 1, pow(self.base, e, 1 << 64), np.uint64) for e in (1, -1)]
            for x in both:
                x[0] = 1
            self.up, self.down = map(np.multiply.accumulate, both)
        return self.up, self.down


def joined_words(text: str | None) -> bytes:
    """Words of a text with one space between them. Bytes split at the same six characters that end a word."""
    return b" ".join((text or "").encode().split())


def word_hashes(joined: bytes, powers: Powers, stretch: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of joined_words(text), a stretch at a time."""
    if not joined:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(codes == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(codes)]])
    found = np.empty(len(starts), np.uint64)
    cuts = np.unique(np.concatenate([np.searchsorted(starts, np.arange(0, len(codes), stretch)), [len(starts)]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        low, high = starts[a], ends[b - 1]
        up, down = powers.upto(int(high - low))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low])])
        found[a:b] = (sums[ends[a:b] - low] - sums[starts[a:b] - low]) * down[starts[a:b] - low]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return starts, ends, found ^ (found >> np.uint64(32))


def minimisers(hashes: np.ndarray, k: int) -> np.ndarray:
    """Minimiser of each window of k words."""
    n, m = len(hashes), min(M, k)
    own = np.zeros(n - m + 1, np.uint64)
    for j in range(m):
        own += hashes[j : n - m + 1 + j] * _FACTORS[j]
    own ^= own >> np.uint64(31)
    own *= np.uint64(0xBF58476D1CE4E5B9)
    own ^= own >> np.uint64(29)
    width, have = k - m + 1, 1
    while have * 2 <= width:
        own = np.minimum(own[:-have], own[have:])
        have *= 2
    return np.minimum(own[: n - k + 1], own[width - have :]) if width > have else own


def runs(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of the super-k-mers of a document."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = minimisers(hashes, k)
    edges = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
    return least[edges[:-1]], edges[:-1], np.diff(edges)


def summed(held: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of held with the sums of their counts, where these reach least."""
    keys, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)
    return keys[counts >= least], counts[counts >= least]


def heavy_minimisers(rows: DataFrame, k: int, heavy: int) -> dict[int, float]:
    """Minimisers with a heavy-th of all super-k-mers or more (some with three quarters of that), and their shares. A task sends those of its own that have a
    quarter of that share; what it leaves out cannot hide a minimiser with the whole share."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, total = Powers(), [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        for batch in batches:
            found = [runs(word_hashes(joined_words(t), powers)[2], k)[0] for t in batch.column(0).to_pylist()]
            total += sum(map(len, found))
            held.append((np.concatenate([np.zeros(0, np.uint64), *found]), np.ones(sum(map(len, found)), np.int64)))
            if sum(len(x) for x, _ in held) > 3_000_000:
                held = [summed(held, total // (16 * heavy))]
        seen, counts = summed(held, 1)
        keep = (4 * counts * heavy >= total) & (counts > 1)
        columns = [pa.array([*seen[keep].view(np.int64).tolist(), None], pa.int64()), pa.array([*counts[keep].tolist(), total], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["minimiser", "n"])

    sums = cut(rows.select("text").mapInArrow(counted, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n")))
    total = sums.where("minimiser is null").agg(F.sum("n")).first()[0] or 0
    return {r.minimiser % (1 << 64): r.n / total for r in sums.where((F.col("minimiser").isNotNull()) & (F.col("n") > 1) & (4 * heavy * F.col("n") >= 3 * total)).collect()}


PACKED = "bucket int, strings binary, counts binary, docs binary, keys binary, starts binary, heavy binary"


def packer(buckets: int, heavy: dict[int, int], k: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc, key, text) as super-k-mers by bucket: different strings, how many places each has, and the places."""
        import zstandard

        powers, squeeze = Powers(), zstandard.ZstdCompressor(level=3)
        hot_ones = np.array(sorted(heavy), np.uint64)
        salts = np.array([heavy[x] for x in sorted(heavy)], np.uint64)
        held: dict[int, dict[tuple[bytes, bool], list[tuple[int, int, int]]]] = defaultdict(lambda: defaultdict(list))

        def out():
            rows = []
            for bucket, strings in held.items():
                places = [p for own in strings.values() for p in own]
                docs, keys, starts = (np.array(x, np.int64).tobytes() for x in zip(*places, strict=True))
                text = squeeze.compress(b"\n".join([s for s, _ in strings]))
                rows.append((bucket, text, np.array([len(x) for x in strings.values()], np.int32).tobytes(), docs, keys, starts, np.array([h for _, h in strings], bool).tobytes()))
            held.clear()
            for at in range(0, len(rows), 64):
                part = list(zip(*rows[at : at + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), *[pa.array(c, pa.binary()) for c in part[1:]]], names=[x.split()[0] for x in PACKED.split(", ")])

        used = 0
        for batch in batches:
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = joined_words(text)
                begin, end, hashes = word_hashes(words, powers)
                least, first, n = runs(hashes, k)
                hot, mixed = np.zeros(len(least), bool), least
                if len(hot_ones):
                    at = np.minimum(np.searchsorted(hot_ones, least), len(hot_ones) - 1)
                    hot = hot_ones[at] == least
                    drawn = np.uint64((doc * 0x9E3779B97F4A7C15 % (1 << 64)) >> 20) % salts[at] + np.uint64(1)
                    mixed = np.where(hot, least ^ drawn * np.uint64(0x9E3779B97F4A7C15), least)
                bucket = ((mixed >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)
                for to, a, b, f, h in zip(bucket.tolist(), begin[first].tolist(), end[first + n + k - 2].tolist(), first.tolist(), hot.tolist(), strict=True):
                    held[to][words[a:b], h].append((doc, key, f))
                    used += b - a
                if used > HELD_BYTES:
                    yield from out()
                    used = 0
        yield from out()

    return pack


def same_windows(words: bytes, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, starts: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """Group number of each window of k words from word starts on; windows share one if and only if their text is the same."""
    with np.errstate(over="ignore"):
        up, down = powers.upto(len(hashes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])
        codes = (sums[starts + k] - sums[starts]) * down[starts]
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    again = np.flatnonzero(~fresh)
    mine, before = starts[order[again]], starts[order[again - 1]]
    for a, b, c, d in zip(begin[mine].tolist(), end[mine + k - 1].tolist(), begin[before].tolist(), end[before + k - 1].tolist(), strict=True):
        if words[a:b] != words[c:d]:  # equal hashes of different text: number the texts themselves
            numbers: dict[bytes, int] = {}
            return np.array([numbers.setdefault(words[x:y], len(numbers)) for x, y in zip(begin[starts].tolist(), end[starts + k - 1].tolist(), strict=True)])
    groups = np.empty(len(starts), np.int64)
    groups[order] = np.cumsum(fresh) - 1
    return groups


SPANS = "doc long, key long, first int, last int, part int, windows binary"
NAMES = [x.split()[0] for x in SPANS.split(", ")]
#: A salted window: two halves of its digest, document, text's key, first word.
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("first", "<i4")])


def span_rows(docs: np.ndarray, keys: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(docs), 1 << 14):
        own = [pa.array(x[at : at + (1 << 14)], kind) for x, kind in ((docs, pa.int64()), (keys, pa.int64()), (firsts, pa.int32()), (lasts, pa.int32()))]
        yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(own[0]), pa.int32()), pa.nulls(len(own[0]), pa.binary())], names=NAMES)


def sorter(k: int, parts: int):
    def spans(rows: list[tuple], salted: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Spans of a bucket to remove (first to last word); adds the firsts of hot windows to salted."""
        import zstandard

        expand, powers = zstandard.ZstdDecompressor(), Powers()
        text = b"\n".join([expand.decompress(r[1]) for r in rows])
        sizes = np.fromiter((x.count(b" ") + 1 for x in text.split(b"\n")), np.int64)
        words = text.replace(b"\n", b" ")
        begin, end, hashes = word_hashes(words, powers)
        counts = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows])
        docs, keys, begins = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in (3, 4, 5))
        heavy = np.concatenate([np.frombuffer(r[6], bool) for r in rows])
        windows = sizes - k + 1
        offset = np.cumsum(windows) - windows  # of a string's first window among all windows
        inside = np.arange(windows.sum()) - np.repeat(offset, windows)
        starts = np.repeat(np.cumsum(sizes) - sizes, windows) + inside
        groups = same_windows(words, begin, end, hashes, starts, k, powers)
        place = np.cumsum(counts) - counts
        least, most = np.minimum.reduceat(docs, place), np.maximum.reduceat(docs, place)
        first = np.full(groups.max() + 1, LAST, np.int64)
        np.minimum.at(first, groups, np.repeat(least, windows))
        first = first[groups]

        def expanded(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Places of the chosen strings and their windows, one row for each pair."""
            at = np.repeat(place[chosen] - np.cumsum(counts[chosen]) + counts[chosen], counts[chosen]) + np.arange(counts[chosen].sum())
            own = np.repeat(chosen, counts[chosen])
            n = windows[own]
            return np.repeat(at, n), np.repeat(offset[own] - np.cumsum(n) + n, n) + np.arange(n.sum())

        earlier = np.maximum.reduceat(np.repeat(most, windows) > first, offset)
        at, window = expanded(np.flatnonzero(earlier))
        drop = docs[at] > first[window]
        at, window = at[drop], window[drop]
        edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
        final = np.concatenate([edge[1:] - 1, [len(at) - 1]]) if len(at) else edge
        found = [docs[at[edge]], keys[at[edge]], begins[at[edge]] + inside[window[edge]], begins[at[edge]] + inside[window[final]] + k - 1]
        yield from span_rows(*found)
        if heavy.any():
            at, window = expanded(np.flatnonzero(heavy))
            stay = docs[at] == first[window]
            at, window = at[stay], window[stay]
            made: dict[int, bytes] = {}
            for g, s in zip(groups[window].tolist(), starts[window].tolist(), strict=True):
                if g not in made:
                    made[g] = hashlib.blake2b(words[begin[s] : end[s + k - 1]], digest_size=16).digest()
            own = np.empty(len(at), WINDOW)
            digests = np.frombuffer(b"".join(made[g] for g in groups[window].tolist()), np.uint64).reshape(-1, 2)
            own["a"], own["b"], own["doc"], own["key"], own["first"] = digests[:, 0], digests[:, 1], docs[at], keys[at], begins[at] + inside[window]
            salted.append(own)

    def packed(salted: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Hot windows by the part that compares them."""
        own = np.concatenate(salted)
        salted.clear()
        part = (own["a"] % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        own, part = own[order], part[order]
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for at in range(0, len(edge), 64):
            ends = np.append(edge, len(own))[at + 1 : at + 65]
            rows = [own[a:b].tobytes() for a, b in zip(edge[at : at + 64].tolist(), ends.tolist(), strict=True)]
            none = [pa.nulls(len(rows), kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(part[edge[at : at + 64]]), pa.array(rows, pa.binary())], names=NAMES)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        salted: list[np.ndarray] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield from spans(held, salted)
                    held = []
                    if sum(map(len, salted)) * WINDOW.itemsize > HELD_BYTES:
                        yield from packed(salted)
                held.append(row)
        if held:
            yield from spans(held, salted)
        if any(map(len, salted)):
            yield from packed(salted)

    return sort


def comparer(k: int):
    def later(rows: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Spans of the windows that a smaller document has too."""
        own = np.concatenate([np.frombuffer(x, WINDOW) for x in rows])
        own = own[np.lexsort((own["doc"], own["b"], own["a"]))]
        fresh = np.concatenate([[True], (own["a"][1:] != own["a"][:-1]) | (own["b"][1:] != own["b"][:-1])])
        least = own["doc"][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        own = own[own["doc"] > least]
        own = own[np.lexsort((own["first"], own["key"], own["doc"]))]
        if len(own):
            edge = np.concatenate([[True], (own["doc"][1:] != own["doc"][:-1]) | (own["key"][1:] != own["key"][:-1]) | (own["first"][1:] > own["first"][:-1] + k)])
            at = np.flatnonzero(edge)
            yield from span_rows(own["doc"][at], own["key"][at], own["first"][at], own["first"][np.append(at[1:] - 1, len(own) - 1)] + k - 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for now, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != part and held:
                    yield from later(held)
                    held = []
                part = now
                held.append(windows)
        if held:
            yield from later(held)

    return compare


def repeated_spans(docs: DataFrame, k: int = K, heavy: int | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc, key, spans) of documents that lose words: spans of word numbers, first to last; docs has doc, key and text. A minimiser is hot from
    a heavy-th of all super-k-mers on, by default from what fills a bucket."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, -(-3 * total // bucket_bytes))
    shares = heavy_minimisers(docs, k, heavy or min(HOT, buckets))
    hot = {x: max(2, math.ceil(SALTS * share * buckets)) for x, share in shares.items()}
    packed = docs.select("doc", "key", "text").mapInArrow(packer(buckets, hot, k), PACKED)
    spans = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sorter(k, buckets), SPANS)
    if hot:
        spans = cut(spans)
        salted = spans.where("part is not null").select("part", "windows").repartition("part").sortWithinPartitions("part").mapInArrow(comparer(k), SPANS)
        spans = spans.where("part is null").unionByName(salted)
    return spans.groupBy("doc", "key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def removed(n: int, spans: list | None) -> np.ndarray:
    """Which of n words stand in one of the spans."""
    drop = np.zeros(n + 1, np.int64)
    for s in spans or ():
        drop[s["first"]] += 1
        drop[s["last"] + 1] -= 1
    return np.cumsum(drop)[:n] > 0


def shortened(text: str | None, spans: list | None) -> tuple[str | None, int, int]:
    """Text without the words of spans, numbers of its words and of the removed ones."""
    if not spans:
        return text, 0, 0
    found = list(WORDS.finditer(text))
    gone, at, parts = removed(len(found), spans), 0, []
    for word, g in zip(found, gone.tolist(), strict=True):
        parts.append("" if g else text[at : word.end()])
        at = word.end()
    return ("".join(parts) + text[at:]).strip(), len(found), int(gone.sum())


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) with numbers of words and of removed words and the kept words' digest."""
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = (text or "").encode().split()
            gone = removed(len(words), spans)
            kept = compress(words, (~gone).tolist()) if spans else words
            rows.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def with_spans(docs: DataFrame, k: int, heavy: int | None, bucket_bytes: int) -> DataFrame:
    """docs and, as last column, the spans of words that go."""
    doc, key, spans = (f"{'_' * (1 + max(map(len, docs.columns)))}{x}" for x in ("doc", "key", "spans"))  # no column of docs is called so
    own = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), key: F.xxhash64(F.coalesce("text", F.lit("")))})
    found = repeated_spans(own.select(F.col(doc).alias("doc"), F.col(key).alias("key"), "text"), k, heavy, bucket_bytes).withColumnsRenamed({"doc": doc, "key": key, "spans": spans})
    return own.join(found.hint("merge"), [doc, key], "left").select(*docs.columns, spans)


def without_repeats(docs: DataFrame, k: int = K, heavy: int | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with texts cut (and n_chars counted again where a text changed); rows that lose their last word go."""
    place, schema = docs.columns.index("text"), docs.schema
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shortened(*x) for x in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[place] = pa.array([r[0] for r in rows], columns[place].type)
            if chars is not None:
                sizes = [len(r[0]) if r[2] else n for r, n in zip(rows, columns[chars].to_pylist(), strict=True)]
                columns[chars] = pa.array(sizes, columns[chars].type)
            whole = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
            yield whole.filter(pa.array([r[2] == 0 or r[2] < r[1] for r in rows], pa.bool_()))

    return with_spans(docs, k, heavy, bucket_bytes).mapInArrow(edited, schema)


def remove_repeats(docs: DataFrame, k: int = K, heavy: int | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return with_spans(own, k, heavy, bucket_bytes).mapInArrow(counted_words, counted)


def op3_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
with split as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
), windows as (
  select doc_id, i, md5(array_to_string(words[i:i + {K - 1}], ' ')) as h
  from (select doc_id, words, unnest(range(1, len(words) - {K - 2})) as i from split where len(words) >= {K})
), firsts as (
  select h, min(doc_id) as least from windows group by h
), bad as (
  select doc_id, list(distinct i) as starts from windows join firsts using (h) where doc_id > least group by doc_id
), marks as (
  select doc_id, list(distinct p) as gone from (
    select doc_id, unnest(range(i, i + {K})) as p from (select doc_id, unnest(starts) as i from bad)) group by doc_id
), kept as (
  select s.doc_id, len(s.words) as n_words, coalesce(len(m.gone), 0) as n_removed,
    case when m.gone is null then array_to_string(s.words, ' ') else coalesce((
      select string_agg(w, ' ' order by p) from (select unnest(s.words) as w, unnest(range(1, len(s.words) + 1)) as p)
      where not list_contains(m.gone, p)), '') end as kept
  from split s left join marks m on s.doc_id = m.doc_id
)
select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed, sha256(kept) as kept_sha256 from kept
"""
