"""Toxicity by compression distance: separate zstandard dictionaries of toxic and of ordinary text, for each kind of text found.

Kinds (in effect, languages) are found without labels: sampled texts as directions of letter trigrams, grouped by their nearest centre; each text belongs to the
nearest centre. A kind has two dictionaries. The ordinary one is trained on ordinary text. The toxic one has the same content and, before it,
parts of toxic text: the words that hold strings which toxic documents use in many more contexts (different words before them) than
ordinary ones do, so that stems that build ever new words count, and copies of a text don't. Ordinary passages that the toxic
dictionary still shortens are added to both, so that what is left of the difference comes from toxic text.

Every window of WINDOW words of every text is compressed with both; its distance is the bytes that the toxic dictionary saves. How often
each distance occurs in toxic and in ordinary documents of the kind, from training documents that made no dictionary, makes a window's evidence; their sum over the
text is calibrated to the share of toxic labels, rising with it.

Only the fit uses the driver, on a sample of about TOXIC + ORDINARY labelled documents, whatever the size of the input. Scoring is one
narrow pass.

Defined results: a null or empty text has no window and no evidence; labels repeated for an id count as toxic if one does, null labels as none; without
toxic or without ordinary training documents every score is the same; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.common import fold, labelled, sampled, table

#: Words of a window, words from one window to the next.
WINDOW, STRIDE = 12, 11
#: Documents of the fitting sample (by hash of the id, about so many of each kind).
TOXIC, ORDINARY = 1_500, 3_000
#: Texts of the sample that are grouped. Kinds looked for, rounds; kinds as alike as SAME are one, those with less than this share of the sample are dropped.
GROUPED, KINDS, REFINED, SAME, LEAST_SHARE = 1_500, 8, 6, 0.8, 0.02
DIRECTIONS = 2_048
#: Ordinary words at first, words added in a round of mining, rounds, words of a mined piece.
WORDS, MINED, ROUNDS, PIECE = 500, 600, 6, 6
#: A toxic string: its letters, contexts at least, times its ordinary rate at least, standard deviations of its contrast.
SHORTEST, LONGEST, CONTEXTS, TIMES, CLEAR = 4, 9, 4, 8.0, 4.0
#: Toxic words in a dictionary.
MARKED = 1_000
#: Least distance (bytes) of each class but the first.
EDGES = (-1, 0, 1, 2, 3, 5, 8)
PREDICT = 0.7
TOKENS = re.compile(r"[^\W_]+")


@dataclass
class Model:
    centres: np.ndarray
    pairs: list[tuple[bytes, bytes]]  # ordinary and toxic dictionary of each kind
    evidence: np.ndarray  # of a window, by kind and distance
    steps: np.ndarray  # least evidence of each share
    shares: np.ndarray


def compressor(dictionary: bytes):
    """From a window of 2**15 bytes on, the library finds matches in another way, with other sizes, and it takes the smallest window that holds the dictionary.
    So a limit below keeps both dictionaries of a kind comparable whatever their sizes; all of a larger dictionary stays in reach of a short text."""
    import zstandard as zs

    plan = zs.ZstdCompressionParameters(
        window_log=14, hash_log=17, chain_log=17, search_log=8, min_match=4, target_length=64, strategy=zs.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=plan)


class Distances:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.pair = compressor(ordinary), compressor(toxic)

    def saved(self, windows: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        if not windows:
            return np.zeros(0, np.int64)
        plain, toxic = (np.fromiter((len(c.compress(w)) for w in windows), np.int64, len(windows)) for c in self.pair)
        return plain - toxic


class Scorer:
    """The model at work in one task."""

    def __init__(self, model: Model):
        self.model, self.distances = model, [Distances(*x) for x in model.pairs]

    def evidence(self, text: str | None) -> tuple[float, int, int]:
        """Evidence of a text, its largest distance, its kind."""
        windows = cut_windows(text)
        if not windows or not self.distances:
            return 0.0, 0, -1
        kind = nearest(self.model.centres, windows)
        saved = self.distances[kind].saved(windows)
        return float(self.model.evidence[kind][classes(saved)].sum()), int(saved.max()), kind

    def share(self, evidence: float) -> float:
        return float(self.model.shares[max(0, int(np.searchsorted(self.model.steps, evidence, "right")) - 1)])


def cut_windows(text: str | None, words: int | None = None, stride: int | None = None) -> list[bytes]:
    """Windows that cover all words of a text, in lower case."""
    words, stride = words or WINDOW, stride or STRIDE
    found = TOKENS.findall((text or "").lower())
    return [f" {' '.join(found[i : i + words])} ".encode() for i in range(0, max(0, len(found) - words + stride), stride)] or ([f" {' '.join(found)} ".encode()] if found else [])


def direction(windows: list[bytes]) -> np.ndarray:
    """A text's letter trigrams as a direction."""
    b = np.frombuffer(b"".join(windows), np.uint8).astype(np.uint32)
    key = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    v = np.sqrt(np.bincount((key >> np.uint32(16)).astype(np.int64) % DIRECTIONS, minlength=DIRECTIONS).astype(np.float32))
    return v / max(1e-9, float(np.linalg.norm(v)))


def nearest(centres: np.ndarray, windows: list[bytes]) -> int:
    return int((centres @ direction(windows)).argmax())


def kinds(texts: list[list[bytes]]) -> np.ndarray:
    """Centres of the kinds of text in a sample: far ones first, then refined; like ones joined, rare ones dropped."""
    x = np.stack([direction(t) for t in texts[:: max(1, len(texts) // GROUPED)]])
    centres = [x.sum(0)]
    for _ in range(KINDS - 1):
        near = np.max([x @ (c / np.linalg.norm(c)) for c in centres], 0)
        far = np.flatnonzero(near <= np.quantile(near, LEAST_SHARE))
        middle = far[np.argsort(-(x[far] @ x[far].sum(0)), kind="stable")[: max(1, len(far) // 2)]]  # what the far ones have most in common
        centres.append(x[middle].sum(0))
    unit = lambda c: c / np.maximum(1e-9, np.linalg.norm(c, axis=-1, keepdims=True))
    centres = unit(np.stack(centres))
    for _ in range(REFINED):
        own = (x @ centres.T).argmax(1)
        centres = unit(np.stack([x[own == k].sum(0) if (own == k).any() else c for k, c in enumerate(centres)]))
    sizes, kept = np.bincount((x @ centres.T).argmax(1), minlength=len(centres)), []
    for k in np.argsort(-sizes, kind="stable"):
        if not kept or sizes[k] >= LEAST_SHARE * len(x) and max(float(centres[k] @ centres[j]) for j in kept) < SAME:
            kept.append(int(k))
    return centres[kept]


def contexts(texts: list[list[bytes]]) -> Counter:
    """For each word, how many different words come before it (none counts too, in a text of one window)."""
    numbers: dict[bytes, int] = {b"": 0}
    held, size = [np.zeros(0, np.int64)], 0
    for windows in texts:
        for window in windows:
            own = np.array([numbers.setdefault(w, len(numbers)) for w in window.split(b" ") if w], np.int64)
            before = own[:-1] if len(windows) > 1 else np.concatenate([[0], own[:-1]])
            held.append(before << 32 | own[len(own) - len(before) :])
            size += len(before)
        if size > 1 << 21:
            held, size = [np.unique(np.concatenate(held))], 0
    counts = np.bincount(np.unique(np.concatenate(held)) & 0xFFFFFFFF, minlength=len(numbers))
    return Counter({w.decode(): n for w, n in zip(numbers, counts.tolist(), strict=True) if n})


class Strings:
    """The strings of SHORTEST to LONGEST letters in words, blanks at their ends included, as 64-bit hashes."""

    def __init__(self, words: list[str]):
        self.sizes = np.array([len(w) + 2 for w in words], np.int64)
        self.codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), self.sizes)
        self.left = (np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(len(self.codes))).astype(np.int32)  # letters from here to the word's end

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the strings of k letters, and their words."""
        at = np.flatnonzero(self.left >= k)
        key = np.zeros(len(at), np.uint64)
        for j in range(k):
            key = (key ^ self.codes[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key, self.word[at]

    def holders(self, marked: dict[int, np.ndarray]) -> np.ndarray:
        """Which words hold a marked string."""
        held = np.zeros(len(self.sizes), bool)
        for k, keys in marked.items():
            own, word = self.of(k)
            held[word[np.isin(own, keys)]] = True
        return held


def contrasted(toxic: Counter, ordinary: Counter) -> tuple[list[str], dict[int, np.ndarray]]:
    """Strings that toxic text uses in clearly more contexts, and the toxic words that hold them, the most frequent last."""
    n_toxic, n_ordinary = max(1, toxic.total()), max(1, ordinary.total())
    here, there = Strings(list(toxic)), Strings(list(ordinary))
    n_here, n_there = np.array(list(toxic.values()), float), np.array(list(ordinary.values()), float)
    marked = {}
    for k in range(SHORTEST, LONGEST + 1):
        own, word = here.of(k)
        keys, at = np.unique(own, return_inverse=True)
        n = np.bincount(at, n_here[word], len(keys))
        keys, n = keys[n >= CONTEXTS], n[n >= CONTEXTS]
        if not len(keys):
            continue
        own, word = there.of(k)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        same = keys[at] == own
        other = np.bincount(at[same], n_there[word[same]], len(keys))
        p = (n + other) / (n_toxic + n_ordinary)
        clear = (n / n_toxic - other / n_ordinary) / np.sqrt(p * (1 - p) * (1 / n_toxic + 1 / n_ordinary)) >= CLEAR
        marked[k] = keys[clear & (n / n_toxic > TIMES * (other + 1) / n_ordinary)]
    held = [(n, word) for (word, n), x in zip(toxic.items(), here.holders(marked), strict=True) if x and n / n_toxic > (ordinary[word] + 0.5) / n_ordinary]
    return [word for _, word in sorted(held)[-MARKED:]], marked


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary, from windows of documents."""
    common = contexts(ordinary)
    marked, parts = contrasted(contexts(toxic), common)
    free = [w for (w, _), x in zip(common.items(), Strings(list(common)).holders(parts), strict=True) if not x]
    words, able = sorted(free, key=lambda w: (-common[w], w))[:WORDS], set(free)
    pieces = [f" {' '.join(w[i : i + PIECE])} ".encode() for windows in ordinary for w in (x.decode().split() for x in windows) for i in range(0, len(w), PIECE)]
    for _ in range(ROUNDS):
        plain = f" {' '.join(reversed(words))} ".encode()
        both = "".join(f" {w} " for w in marked).encode() + plain
        if not marked:
            break
        had, missed = set(words), Counter()
        pieces = [piece for piece, saved in zip(pieces, Distances(plain, both).saved(pieces), strict=True) if saved]  # the others stay as they are, with more words in both
        for piece in pieces:
            missed.update(w for w in piece.decode().split() if w in able and w not in had)
        more = [w for w, _ in sorted(missed.items(), key=lambda x: (-x[1], x[0]))[:MINED]]
        if not more:
            break
        words += more
    return plain, both


def classes(saved: np.ndarray) -> np.ndarray:
    """Classes of distances, from those below 0, which also show that toxic passages occur, to the largest."""
    return np.searchsorted(EDGES, saved, "right")


def window_evidence(saved: list[np.ndarray], labels: list[int]) -> np.ndarray:
    """Log ratio of each class's share among windows of toxic and of ordinary documents; a long document's windows count less each."""
    counts = np.zeros((2, len(EDGES) + 1))
    for own, label in zip(saved, labels, strict=True):
        counts[label] += np.bincount(own, minlength=len(EDGES) + 1) / np.sqrt(len(own))
    overall = counts.sum(0) + 0.01
    counts += overall / overall.sum() * 2.0
    return np.clip(np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum()), -2, 5)


def rising_shares(evidence: list[float], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Shares of toxic labels by evidence, smoothed by the overall share and made rising by pooling neighbours: least evidence, share."""
    overall = (sum(labels) + 1) / (len(labels) + 2)
    blocks: list[list[float]] = []  # label sum, weight, least evidence
    for value, label in sorted(zip(evidence, labels, strict=True)):
        blocks.append([label + 0.0, 1.0, value])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][2] == blocks[-1][2]):
            a, b, _ = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, blocks[-1][2]]
    blocks = blocks or [[0.0, 0.0, 0.0]]
    return np.array([b[2] for b in blocks]), np.maximum.accumulate([(a + 0.5 * overall) / (b + 0.5) for a, b, _ in blocks])


def fit(rows: list[tuple[int | None, str | None, int]]) -> Model:
    """Model of (doc_id, text, toxic) rows; what calibrates it are dictionaries of half of them, at work on the other half."""
    rows = sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0] or 0, r[1]), reverse=True)
    cut = []
    while rows:  # texts go as their windows come
        _, text, label = rows.pop()
        if windows := cut_windows(text):
            cut.append((windows, label))
    if not cut:
        return Model(np.zeros((0, DIRECTIONS), np.float32), [], np.zeros((0, len(EDGES) + 1)), *rising_shares([], []))
    centres = kinds([w for w, _ in cut])
    own = [nearest(centres, w) for w, _ in cut]
    pairs, evidence, values, labels = [], [], [], []
    for k in range(len(centres)):
        mine = [x for x, kind in zip(cut, own, strict=True) if kind == k]
        pairs.append(dictionaries([w for w, x in mine if x], [w for w, x in mine if not x]))
        saved, held = [], []
        for half in (0, 1):  # distances of each half by dictionaries of the other
            make, rest = mine[half::2], mine[1 - half :: 2]
            distances = Distances(*dictionaries([w for w, x in make if x], [w for w, x in make if not x]))
            saved += [classes(distances.saved(w)) for w, _ in rest]
            held += [x for _, x in rest]
        evidence.append(window_evidence(saved, held))
        values += [float(evidence[-1][s].sum()) for s in saved]
        labels += held
    return Model(centres, pairs, np.stack(evidence), *rising_shares(values, labels))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, largest distance, evidence and score of each row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.evidence(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[1] for x in found], pa.int64()), pa.array([x[0] for x in found], pa.float64()), pa.array([scorer.share(x[0]) for x in found], pa.float64())],
                names=["doc_id", "distance", "evidence", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, distance long, evidence double, score double")


def without_toxic(docs: DataFrame, model: Model, least: float = PREDICT) -> DataFrame:
    """The rows of docs whose text scores below least, with all their columns."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.share(scorer.evidence(x)[0]) < least for x in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the training folds."""
    rows = sampled(docs, labelled(labels, "toxic"), fold(F.col("doc_id"), 3) != 1, {1: TOXIC, 0: ORDINARY})
    return fit([(r.doc_id, r.text, r.label) for r in rows.toLocalIterator()])


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = score(docs, trained(docs, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= PREDICT, 1).otherwise(0).cast("int")
    return scores.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", predicted.alias("predicted"), "distance", "evidence")
