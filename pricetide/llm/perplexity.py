"""Quality rules: counts of a text and its perplexity under an n-gram model of the whole corpus.

The model has words (lower-case, exact in any script) of orders 1 and 2 above a speller. All its n-grams are kept: it grows with the
corpus. Each order is a Dirichlet mixture, P(b | a) = (n(ab) + k q(b)) / (n(a) + k), where q spells b and n leaves out the text that is
judged. So a text's nats are sums of terms that need the count of one n-gram each, and scoring is one shuffle: a task packs its n-grams
as sorted hashes with their texts, one piece for each range of hashes; a range holds about SHARD n-grams, adds up their counts and sends
each text's terms back to the text's batch. An n-gram is known by its hash and the step of its last word's nats, which travels anyway and tells
17 words or 30 pairs apart (on sf0.1), so both together have so many bits that about one of 1,000 unseen n-grams meets another at most.

The speller is a modified Kneser-Ney model of characters, folded to SYMBOLS classes, of order ORDER: at most SYMBOLS ** ORDER entries
(64 MB as sorted arrays, broadcast), and only for words and pairs that no other text has. Continuation counts, three discounts an order
and interpolated probabilities are made in joins; an n-gram that was never seen backs off.

A text's perplexity is per character, of the mean nats of both orders; its spelling is that of the speller alone, which sees letters in
disorder where the words have no count. Each of the two has a lower and an upper band for each language (null is one): the median, less or
more WIDTHS times its distance to the quartile on that side, over texts that pass the base rules; a language with fewer than FEW of them
takes the band of all. A text outside either is not kept.

Defined results: a null text has no words and fails the base rules, as any text under 50 words; a text without perplexity (no word) is
outside no band; repeated rows count and are judged each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.common import WORDS, cut, table

SYMBOLS, ORDER = 48, 4
BLANK = 41
#: Base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
MARKS = "#*$%&|<>"
FEW = 100
#: Weight of the speller after a word, and its weight without one as a share of the characters.
AFTER, ALONE = 5.0, 1 / 64
#: N-grams of a range of hashes; words and texts of a packed piece; words in a worker's cache.
SHARD, PIECE, TEXTS, CACHE = 1 << 22, 1 << 21, 1 << 12, 1 << 19
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Steps of the logarithm of a word's spelled nats; the step of END.
STEPS, END_STEP = 24, 43
_CLASSES: list[np.ndarray] = []


def symbol(char: str) -> int:
    """Class of a lower-case character: a letter a-z, one of 14 for other letters, digit, blank, four kinds of punctuation, two of the rest."""
    if "a" <= char <= "z":
        return ord(char) - 97
    if char.isalpha():
        return 26 + ord(char) % 14
    if char.isdigit():
        return 40
    if char.isspace():
        return BLANK
    for k, kind in enumerate((".!?", ",;:", "'\"()[]-", "#*$%&|<>")):
        if char in kind:
            return 42 + k
    return 46 + ord(char) % 2


def grams(text: str | None) -> np.ndarray:
    """Keys of the n-grams of order ORDER, one for each character of a text; blanks stand before it."""
    if not text:
        return np.zeros(0, np.int64)
    if not _CLASSES:
        _CLASSES.append(np.fromiter((symbol(chr(c)) for c in range(0x110000)), np.int64, 0x110000))
    codes = _CLASSES[0][np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([np.full(ORDER - 1, BLANK), codes])
    n = len(codes) - ORDER + 1
    key = codes[:n].copy()
    for k in range(1, ORDER):
        key = key * SYMBOLS + codes[k : n + k]
    return key


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**ORDER, np.int64)
    for batch in batches:
        if len(keys := np.concatenate([np.zeros(0, np.int64), *map(grams, batch.column(0).to_pylist())])):
            total += np.bincount(keys, minlength=len(total))
    keys = np.flatnonzero(total)
    for at in range(0, len(keys), 1 << 16):
        own = keys[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["key", "n"])


def kneser_ney(texts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (key, p) of n-grams with interpolated probabilities, and (context, gamma) of contexts."""
    counts = [cut(texts.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))]
    for order in range(ORDER - 1, 0, -1):
        counts.insert(0, cut(counts[0].groupBy((F.col("key") % SYMBOLS**order).alias("key")).agg(F.count("*").alias("n"))))
    levels: list[tuple[DataFrame, DataFrame]] = []
    for order, own in enumerate(counts, 1):
        of = own.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        y = of.n1 / (of.n1 + 2 * of.n2) if of.n1 else 0.0
        cuts = [k - (k + 1) * y * of[k] / of[k - 1] if of[k - 1] and y else 0.5 * k for k in (1, 2, 3)]
        cuts = [min(max(d, 0.1), k - 0.1) for k, d in enumerate(cuts, 1)]
        discount = F.when(F.col("n") == 1, cuts[0]).when(F.col("n") == 2, cuts[1]).otherwise(cuts[2])
        own = own.withColumn("context", F.floor(F.col("key") / SYMBOLS).cast("long")).withColumn("discount", F.lit(discount))
        contexts = own.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("discount") / F.sum("n")).alias("gamma"))
        joined = own.join(contexts, "context").withColumn("alpha", (F.col("n") - F.col("discount")) / F.col("total"))
        if order == 1:
            p = joined.select("key", (F.col("alpha") + F.col("gamma") / SYMBOLS).alias("p"))
        else:
            lower = levels[-1][0].select(F.col("key").alias("suffix"), F.col("p").alias("below"))
            p = joined.join(lower, F.col("key") % SYMBOLS ** (order - 1) == F.col("suffix")).select("key", (F.col("alpha") + F.col("gamma") * F.col("below")).alias("p"))
        levels.append((cut(p), cut(contexts.select("context", "gamma"))))
    return levels


def arrays(levels: list[tuple[DataFrame, DataFrame]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: sorted n-gram keys, their log probabilities, sorted context keys, their log back-off weights; of bounded size."""
    out = []
    for p, contexts in levels:
        a, b = p.toPandas().sort_values("key"), contexts.toPandas().sort_values("context")
        out.append((a["key"].to_numpy(np.uint32), np.log(a["p"].to_numpy()).astype(np.float32), b["context"].to_numpy(np.uint32), np.log(b["gamma"].to_numpy()).astype(np.float32)))
    return out


def log_probabilities(model, keys: np.ndarray) -> np.ndarray:
    """Log probability of the last symbol of each n-gram given those before it."""
    out = np.zeros(len(keys))
    left = np.arange(len(keys))
    for order in range(len(model), 0, -1):
        have, logs, contexts, weights = model[order - 1]
        own = keys[left] % SYMBOLS**order
        at = np.minimum(np.searchsorted(have, own), len(have) - 1)
        found = have[at] == own
        out[left[found]] += logs[at[found]]
        left, own = left[~found], own[~found]
        if not len(left):
            return out
        at = np.minimum(np.searchsorted(contexts, own // SYMBOLS), len(contexts) - 1)
        known = contexts[at] == own // SYMBOLS
        out[left[known]] += weights[at[known]]
    out[left] -= np.log(SYMBOLS)
    return out


def nats_of(step):
    """Nats of a spelled word from its step."""
    return np.exp(np.asarray(step) / STEPS)


def step_of(nats: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(STEPS * np.log(np.maximum(nats, 1e-9))), 0, 255).astype(np.uint8)


def spelled(model, words: list[str]) -> np.ndarray:
    """Nats of each word, spelled with the blank behind it; END takes its share from all."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    keys = grams("".join([f"{w} " for w in words]))
    place = np.minimum(np.arange(len(keys)) - np.repeat(ends - lengths, lengths) + 2, ORDER)
    logs = np.zeros(len(keys))
    for order in range(2, ORDER + 1):
        at = place == order
        unique, where = np.unique(keys[at] % SYMBOLS**order, return_inverse=True)
        logs[at] = log_probabilities(model[:order], unique)[where] if len(unique) else 0
    return -np.add.reduceat(logs, ends - lengths) - np.log1p(-np.exp(-nats_of(END_STEP)))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, without bytes that are all 0. Bytes of equal weight are compressed together, and apart from others, as these are as good as random."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
        used = max((k + 1 for k in range(8) if planes[k].any()), default=0)
        parts = [pa.compress(pa.py_buffer(planes[k]), codec="zstd", asbytes=True) for k in range(used)]
        out += [np.array([len(a), used, *map(len, parts)], "<i4").tobytes(), *parts]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, used = np.frombuffer(data, "<i4", 2, at).tolist()
        sizes, at = np.frombuffer(data, "<i4", used, at + 8).tolist(), at + 8 + 4 * used
        planes = np.zeros((8, n), np.uint8)
        for k, size in enumerate(sizes):
            planes[k] = np.frombuffer(pa.decompress(data[at : at + size], decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
            at += size
        out.append(np.ascontiguousarray(planes.T).view("<u8").reshape(-1))
    return out


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    return counts_of(text or "", WORDS.findall(text or ""))


def counts_of(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    seen: set[str] = set()
    doubles = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                doubles += WORDS.search(line) is not None
            else:
                seen.add(line)
    repeated = 0
    if (n := len(words)) > 3:
        ids: dict[str, int] = {}
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        pairs = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)[1]
        _, where, counts = np.unique(pairs[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True)
        twice = np.zeros(n + 3, np.int64)
        starts = np.flatnonzero(counts[where] > 1)
        np.add.at(twice, starts, 1)
        np.add.at(twice, starts + 3, -1)
        repeated = int((np.cumsum(twice) > 0).sum())
    return n, sum(map(len, words)), sum(map(text.count, MARKS)), doubles, repeated


JUDGED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, letters double, spell double, alone double, after double, before double"
PIECES = "shard long, batch long, data binary"


def layout(chars: int) -> tuple[int, tuple[int, int]]:
    """Bits of a hash (at least 32: in a small corpus, steps may tell few n-grams apart), and of its range for orders 1 and 2, for a corpus of so many characters."""
    ranges = max(0, int(chars // 6 // SHARD).bit_length())
    return min(44, max(32, chars.bit_length() + 4)), (max(0, ranges - 1), ranges)


def postings(texts: list[tuple[np.ndarray, np.ndarray]], chars: int) -> Iterator[tuple[int, bytes]]:
    """(shard, piece) of the words and pairs of up to TEXTS texts, each (hashes, steps) of its words. A piece has each n-gram once,
    with its step and how many texts it has, and the texts: the first of each n-gram, then the distances to the others."""
    bits, ranges = layout(chars)
    doc_bits = TEXTS.bit_length() - 1
    for order in (1, 2):
        if order == 1:
            keys, steps = (np.concatenate([t[k] for t in texts]) for k in (0, 1))
        else:
            some = [t for t in texts if len(t[0])]
            a = np.concatenate([x for h, _ in some for x in (np.array([START]), h)])
            b = np.concatenate([x for h, _ in some for x in (h, np.array([END]))])
            keys, steps = a ^ mixed(b + START), np.concatenate([x for _, q in some for x in (q, np.array([END_STEP], np.uint8))])
        docs = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(h) + (order - 1) * (len(h) > 0) for h, _ in texts])
        rows = (mixed(keys) >> np.uint64(64 - bits)) << np.uint64(doc_bits + 8) | steps.astype(np.uint64) << np.uint64(doc_bits) | docs
        rows.sort()
        first, times = firsts(rows)
        rows = rows[first]
        own = rows >> np.uint64(bits - ranges[order - 1] + doc_bits + 8)
        starts, lengths = firsts(own)
        for i, j in zip(starts, starts + lengths, strict=True):
            part, where = rows[i:j] >> np.uint64(doc_bits), rows[i:j] & np.uint64(TEXTS - 1)
            begin, many = firsts(part)
            grams = part[begin] >> np.uint64(8)
            gaps = np.delete(np.diff(where, prepend=where[:1]), begin)
            yield 2 * int(own[i]) + order - 1, packed(np.concatenate([grams[:1], np.diff(grams)]), many - 1, part[begin] & np.uint64(255), where[begin], gaps, times[i:j] - 1)


def firsts(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key begins, and how often it stands."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_keys)))


def terms(order: int, pieces: list[tuple[int, bytes]], weight: float) -> Iterator[tuple[int, bytes]]:
    """(batch, texts with their terms in 1/256 nats) of the pieces (batch, data) of a shard: gains over the spelled word; for order 1 also log(n(a) + AFTER).

    A piece is open at a time: an n-gram that all texts have adds one entry a piece to what is held.
    """

    def opened(data: bytes) -> tuple[np.ndarray, ...]:
        deltas, more, steps, first, gaps, times = unpacked(data)
        many = more.astype(np.int64) + 1
        begin = np.cumsum(many) - many
        docs = np.zeros(len(times), np.int64)
        rest = np.ones(len(times), bool)
        rest[begin] = False
        docs[begin], docs[rest] = first, gaps
        docs = np.cumsum(docs)
        docs -= np.repeat(docs[begin] - first.astype(np.int64), many)
        grams = np.repeat(np.cumsum(deltas, dtype=np.uint64) << np.uint64(8) | steps, many)
        return grams, docs, np.repeat(steps, many), times.astype(np.int64) + 1, *firsts(grams)

    own_keys, own_counts = [], []
    for _, data in pieces:
        grams, _, _, times, starts, _ = opened(data)
        own_keys.append(grams[starts])
        own_counts.append(np.add.reduceat(times, starts))
    keys, counts = np.concatenate(own_keys), np.concatenate(own_counts)
    by = np.argsort(keys, kind="stable")
    starts, lengths = firsts(keys[by])
    totals = np.empty(len(keys), np.int64)
    totals[by] = np.repeat(np.add.reduceat(counts[by], starts), lengths)
    at = 0
    for (batch, data), own in zip(pieces, own_keys, strict=True):
        _, docs, steps, times, _, lengths = opened(data)
        others = np.repeat(totals[at : at + len(own)], lengths) - times
        at += len(own)
        values = [np.where(others > 0, times * np.logaddexp(0, np.log(np.maximum(others, 1) / weight) + nats_of(steps)), 0.0)]
        if order == 1:
            values.append(times * np.log(others + AFTER))
        sums = [np.bincount(docs, x) for x in values]
        which = np.flatnonzero(np.any(sums, axis=0))
        yield batch, packed(np.concatenate([which[:1], np.diff(which)]), *[np.rint(256 * x[which]).astype(np.int64) for x in sums])


def scored(docs: DataFrame, model, chars: int) -> DataFrame:
    """Base counts, and sums over the words, of each row of (doc_id, text, lang): nats as spelled, exact and in steps, gains of orders 1 and 2, logarithms of contexts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in JUDGED.split(", ")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        hashes, letters, steps = np.zeros(CACHE, np.uint64), np.zeros(CACHE), np.zeros(CACHE, np.uint8)
        rows: list[tuple] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def learn(new: list[str]) -> None:
            nonlocal hashes, letters, steps
            n = len(cache)
            if (more := n + len(new) - len(hashes)) > 0:
                hashes, letters, steps = (np.concatenate([x, np.zeros(more + CACHE, x.dtype)]) for x in (hashes, letters, steps))
            low = [w.lower() for w in new]
            hashes[n : n + len(new)] = np.frombuffer(b"".join([hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in low]), "<u8")
            letters[n : n + len(new)] = spelled(shared.value, low)
            steps[n : n + len(new)] = step_of(letters[n : n + len(new)])
            cache.update(zip(new, range(n, n + len(new)), strict=True))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, number
            columns = list(zip(*rows, strict=True))
            kept = pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in enumerate([pa.int64(), pa.string(), *[pa.int64()] * 5, *[pa.float64()] * 2])], names=names[:9])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as out:
                out.write_batch(kept)
            found = chain([(-1 - number, sink.getvalue().to_pybytes())], postings(held, chars) if size else [])
            for shard, data in found:
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=["shard", "batch", "data"])
            rows.clear()
            held.clear()
            size, number = 0, number + 1

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, langs, texts = (batch.column(k)[at : at + 64].to_pylist() for k in range(3))
                split = [WORDS.findall(t or "") for t in texts]
                if len(cache) >= CACHE:
                    cache.clear()
                if new := list(set().union(*split).difference(cache)):
                    learn(new)
                for row, lang, text, words in zip(ids, langs, texts, split, strict=True):
                    if len(rows) == TEXTS or size >= PIECE:
                        yield from flush()
                    where = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
                    held.append((hashes[where], steps[where]))
                    rows.append((row, lang, *counts_of(text or "", words), *(float(x.sum()) if words else None for x in (letters[where], nats_of(steps[where])))))
                    size += len(words)
        if rows:
            yield from flush()

    def ranges(table: pa.Table) -> pa.Table:
        shard = table.column(0)[0].as_py()
        if shard < 0:
            return table
        given = list(zip(table.column(1).to_pylist(), table.column(2).to_pylist(), strict=True))
        found = list(terms(shard % 2 + 1, given, AFTER if shard % 2 else max(1.0, ALONE * chars)))
        return pa.table([pa.array([shard] * len(found), pa.int64()), pa.array([b for b, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())], names=["shard", "batch", "data"])

    def finish(table: pa.Table) -> pa.Table:
        shards, data = table.column(0).to_pylist(), table.column(2).to_pylist()
        (k,) = (k for k, s in enumerate(shards) if s < 0)
        kept = pa.ipc.open_stream(data[k]).read_all()
        sums = np.zeros((3, kept.num_rows))
        for s, d in zip(shards, data, strict=True):
            if s >= 0:
                which, *found = unpacked(d)
                for to, x in zip((1,) if s % 2 else (0, 2), found, strict=True):
                    sums[to, np.cumsum(which).astype(np.int64)] += x.astype(np.int64) / 256
        return pa.table([*kept.columns, *map(pa.array, sums)], names=names)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    return given.mapInArrow(pieces, PIECES).groupBy("shard").applyInArrow(ranges, PIECES).groupBy("batch").applyInArrow(finish, JUDGED)


def with_nats(rows: DataFrame, chars: int) -> DataFrame:
    """letters and nats per character, as spelled and by the mean of both orders, from the sums of scored; a text's own words are left out of the totals too."""
    total = rows.agg(F.sum("n_words").alias("words"), F.count("spell").alias("texts")).first()
    texts, alone = total.texts or 0, max(1.0, ALONE * chars)
    end, own = float(nats_of(END_STEP)), F.col("n_words") + 1
    one = F.col("alone") + float(np.logaddexp(0, np.log(max(texts - 1, 1e-300) / alone) + end)) + own * float(np.log(alone)) - own * F.log((total.words or 0) + texts - own + alone)
    two = F.col("after") + own * float(np.log(AFTER)) - F.col("before") - float(np.log(max(texts - 1, 0) + AFTER))
    nats = (F.col("spell") + end - (one + two) / 2) / (F.col("word_chars") + own)
    return rows.withColumns({"nats": nats, "letters": F.col("letters") / (F.col("word_chars") + F.col("n_words"))}).drop("spell", "alone", "after", "before")


#: Quartile distances of the lower and upper band: set from the tails over all texts of sf0.1 that pass the base rules, without labels, as
#: the first whole width from 4 at which one more would spare less than 0.15 % of the texts.
WIDTHS = {"nats": (6.0, 6.0), "letters": (8.0, 6.0)}
#: What has bands, and the result's columns for it.
MEASURES = {"nats": ("perplexity", "low", "high"), "letters": ("spelling", "spelling_low", "spelling_high")}


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, perplexity, its language's band and the verdicts of each row of (doc_id, text, lang)."""
    levels = kneser_ney(docs.select("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    rows = with_nats(cut(scored(docs, arrays(levels), chars)), chars)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return banded(rows.withColumn("base_failed", failed))


def banded(rows: DataFrame) -> DataFrame:
    """rows of lang, base_failed and MEASURES with each measure's value and band, and the verdict."""
    passing = rows.where(~F.col("base_failed") & F.col("nats").isNotNull())
    quartiles = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias(f"{m}_q") for m in MEASURES]
    bands = passing.groupBy(F.col("lang").alias("of")).agg(*quartiles, F.count("*").alias("n")).where(F.col("n") >= FEW).drop("n")
    every = passing.agg(*quartiles).first()
    rows = rows.join(bands, F.col("lang").eqNullSafe(F.col("of")), "left")
    kept, shown = ~F.col("base_failed"), {}
    for m, names in MEASURES.items():
        q = F.coalesce(f"{m}_q", F.array(*map(F.lit, every[f"{m}_q"] or [0.0, float("inf"), float("inf")])))
        low, high = q[1] - WIDTHS[m][0] * (q[1] - q[0]), q[1] + WIDTHS[m][1] * (q[2] - q[1])
        kept = kept & F.coalesce((F.col(m) >= low) & (F.col(m) <= high), F.lit(True))
        shown |= dict(zip(names, map(F.exp, (F.col(m), low, high)), strict=True))
    return rows.withColumns(shown | {"kept": kept}).drop("of", "lang", *MEASURES, *[f"{m}_q" for m in MEASURES])


def op1_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
