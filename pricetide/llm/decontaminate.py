"""Benchmark decontamination: every training passage queries a BM25 index of the test items by block-max WAND.

The index holds the test items' words, with postings in blocks that carry their largest weight. BM25 scores are divided by an item's score
for its own text, so that one threshold serves all items. Documents are cut into passages of twice the longest item, half a passage
apart, so any item stands whole inside one. Bounds come first: an item's commonest words with at most SPARE of its score are left out, and
a passage whose other words cannot fill the rest of any item's threshold is not searched; the others go through WAND with block bounds,
which skips postings but returns every item at or above THRESHOLD.

Retrieved items are verified: the question (an item without its last part) and the answer (that part: the last sentence, or the last
words of a text with one sentence) must each have OVERLAP of its shingles of five words in the passage.

An index is broadcast. Test items are few, but nothing bounds them: they are dealt to parts of at most PART_BYTES of text, and each part's
index is one pass over the documents, so memory is bounded for any number of items and no item is left out.

Defined results: null or empty texts and items without a word match nothing; equal items are reported each; repeated rows are searched
each; no items or no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.common import table

#: BM25 constants, postings of a block, least share of an item's own score.
K1, B, BLOCK, THRESHOLD = 1.2, 0.75, 64, 0.6
#: Share of an item's score in its commonest (then shortest) words, which the bound of a passage takes as given.
SPARE = 0.35
SHINGLE, OVERLAP = 5, 0.8
#: Text of the items of one index; words of an item without sentences that count as its answer.
PART_BYTES, ANSWER = 16 << 20, 5
TOKENS = re.compile(r"[^\W_]+")
FOUND = "doc_id long, item_id long, passage_start long, bm25_share double, question_overlap double, answer_overlap double"


def tokens(text: str | None) -> list[str]:
    return TOKENS.findall((text or "").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and of its answer."""
    parts = [own for x in re.split(r"(?<=[.!?])\s+", text.strip()) if (own := tokens(x))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    return (words[:-ANSWER], words[-ANSWER:]) if len(words) > ANSWER else (words, words)


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()



class Index:
    """Inverted index of (item_id, text): for each word, items and weights in order of the item, in blocks with their largest weight."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t, words) for i, t in items if (words := tokens(t))]
        lengths = [len(w) for *_, w in self.items]
        mean = sum(lengths) / max(1, len(lengths))
        counts = [Counter(w) for *_, w in self.items]
        df = Counter(w for c in counts for w in c)
        weight = {w: np.log(1 + (len(counts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for at, (own, length) in enumerate(zip(counts, lengths, strict=True)):
            scores = {w: weight[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean)) for w, n in own.items()}
            full = sum(scores.values())
            for w, s in scores.items():
                postings[w].append((at, s / full))
        self.terms = {w: k for k, w in enumerate(postings)}
        self.docs = [[d for d, _ in p] for p in postings.values()]
        self.weights = [[s for _, s in p] for p in postings.values()]
        self.blocks = [[max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)] for w in self.weights]
        self.most = [max(w) for w in self.weights]
        self.passage = 2 * max(lengths, default=1)
        self.spare = np.zeros(len(self.items))
        telling: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for at, own in enumerate(counts):
            for w in sorted(own, key=lambda w: (-df[w], len(w), w)):
                k = self.terms[w]
                share = self.weights[k][bisect_left(self.docs[k], at)]
                if self.spare[at] + share <= SPARE:
                    self.spare[at] += share
                else:
                    telling[k].append((at, share))
        self.starts = np.cumsum([0, *map(len, telling), 0])
        self.of = np.array([x for own in telling for x, _ in own], np.int64)
        self.shares = np.array([x for own in telling for _, x in own])

    def candidates(self, ids: np.ndarray, step: int, least: float) -> list[int]:
        """Numbers of the passages (two steps long) of which the words may reach least for an item."""
        where = np.flatnonzero(self.starts[ids + 1] > self.starts[ids])
        first, n = self.starts[ids[where]], self.starts[ids[where] + 1] - self.starts[ids[where]]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        key, pos = np.unique(np.repeat(where // step, n) * (len(self.items) + 1) + self.of[at], return_inverse=True)
        sums = np.bincount(pos, self.shares[at], len(key))
        after = np.minimum(np.searchsorted(key, key + len(self.items) + 1), max(0, len(key) - 1))
        both = sums + np.where(key[after] == key + len(self.items) + 1, sums[after], 0) if len(key) else sums
        chunk, item = np.divmod(key, len(self.items) + 1)
        good = both + self.spare[item] >= least - 1e-9
        alone = sums + self.spare[item] >= least - 1e-9  # a chunk that fills it alone is also the second of the passage before
        return sorted({*chunk[good].tolist(), *(c - 1 for c in chunk[alone].tolist() if c)})

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items whose score for a set of terms is at least least, by block-max WAND."""
        end = len(self.items)
        lists = [[self.docs[t][0], 0, t] for t in terms]  # current item, position, term
        found = []
        while True:
            lists.sort()
            bound, pivot = 0.0, None
            for k, (item, _, t) in enumerate(lists):
                if item >= end:
                    break
                bound += self.most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                return found
            target = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == target:
                pivot += 1
            here, after = 0.0, end
            for x in lists[: pivot + 1]:
                docs, t = self.docs[x[2]], x[2]
                block = x[1] // BLOCK  # first block that can hold the target
                while (block + 1) * BLOCK <= len(docs) and docs[(block + 1) * BLOCK - 1] < target:
                    block += 1
                if block < len(self.blocks[t]):
                    here += self.blocks[t][block]
                    after = min(after, docs[min(len(docs), (block + 1) * BLOCK) - 1] + 1)
            if pivot + 1 < len(lists):
                after = min(after, lists[pivot + 1][0])
            if here >= least and lists[0][0] == target:
                score = 0.0
                for x in lists[: pivot + 1]:
                    score += self.weights[x[2]][x[1]]
                    self.forward(x, target + 1, end)
                if score >= least:
                    found.append((target, score))
            else:
                goal = target if here >= least else max(after, target + 1)
                for x in lists[: pivot + 1]:
                    if x[0] < goal:
                        self.forward(x, goal, end)

    def forward(self, x: list[int], goal: int, end: int) -> None:
        """Moves a list to its first item at or after goal, by whole blocks while they end before it."""
        docs, at = self.docs[x[2]], x[1]
        while at + BLOCK <= len(docs) and docs[at + BLOCK - 1] < goal:
            at += BLOCK
        while at < len(docs) and docs[at] < goal:
            at += 1
        x[0], x[1] = docs[at] if at < len(docs) else end, at

    def matches(self, text: str | None, verify: dict[int, tuple[set, set]], least: float = THRESHOLD, overlap: float = OVERLAP):
        """(item, passage start, score, question overlap, answer overlap) of each verified item, from its best passage."""
        words = tokens(text)
        none = len(self.terms)
        ids = np.fromiter((self.terms.get(w, none) for w in words), np.int64, len(words))
        step = self.passage // 2
        best: dict[int, tuple] = {}
        for start in (step * c for c in self.candidates(ids, step, least)):
            terms = [t for t in dict.fromkeys(ids[start : start + self.passage].tolist()) if t != none]
            for at, score in self.search(terms, least):
                if at not in verify:
                    verify[at] = tuple(map(shingles, question_answer(self.items[at][1])))
                question, answer = verify[at]
                have = shingles(words[start : start + self.passage]) | (self.short(words[start : start + self.passage], question, answer))
                q, a = (len(x & have) / max(1, len(x)) for x in (question, answer))
                if q >= overlap and a >= overlap and (at not in best or (q + a, score) > (best[at][3] + best[at][4], best[at][2])):
                    best[at] = (at, start, score, q, a)
        return [best[k] for k in sorted(best)]

    @staticmethod
    def short(words: list[str], *wanted: set) -> set:
        """Those of the wanted shingles with less than SHINGLE words that stand in words."""
        sizes = {len(s) for own in wanted for s in own if len(s) < SHINGLE}
        return {tuple(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


def item_parts(items: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items with text, in parts of about part_bytes."""
    rows = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // part_bytes)
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text")
        yield [(r.item_id, r.text) for r in own.collect()]


def without_leaks(docs: DataFrame, items: DataFrame, part_bytes: int = PART_BYTES, least: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs in which no test item stands, with all their columns."""
    place = docs.columns.index("text")
    for part in item_parts(items, part_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, verify = Index(shared.value), {}
            for batch in batches:
                yield batch.filter(pa.array([not (index.items and index.matches(t, verify, least, overlap)) for t in batch.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs


def leaks(docs: DataFrame, items: DataFrame, part_bytes: int = PART_BYTES, least: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per document and item whose question and answer stand in one of its passages; docs (doc_id, text), items (item_id, text)."""
    spark = docs.sparkSession
    found = []
    for part in item_parts(items, part_bytes):
        shared = spark.sparkContext.broadcast(part)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, verify = Index(shared.value), {}
            for batch in batches:
                got = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in index.matches(t, verify, least, overlap)] if index.items else []
                columns = [pa.array([g[k] if k != 1 else index.items[g[1]][0] for g in got], kind) for k, kind in enumerate([pa.int64()] * 3 + [pa.float64()] * 3)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FOUND.split(", ")])

        found.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, FOUND))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], FOUND)


def op6_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
