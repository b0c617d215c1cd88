import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.llm import conversation_trie, graph_search, resample
from tests.llm.conftest import DOCS

RUNS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def own_features(text):
    words = RUNS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_resample(docs, bench, percent=5, least=20):
    found = [(doc_id, *own_features(text)) for doc_id, text in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in bench for b in own_features(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), sum(gain[b] for b in f), n])
        rows[-1].insert(3, rows[-1][2] + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((-r[3], math.inf if r[0] is None else r[0], i) for i, r in enumerate(rows) if r[4] >= least)
    place = {i: k for k, (_, _, i) in enumerate(able[: len(able) * percent // 100], 1)}
    return Counter((r[0], r[1], r[2], r[3], place.get(i)) for i, r in enumerate(rows))


def drawn(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("few", [1, 7, 4096])
def test_resampling_equals_brute_force(spark, words, monkeypatch, few):
    monkeypatch.setattr(resample, "FEW", few)
    draw = random.Random(3)
    odd = ["Ünïcode", "x" * 70, "y" * 200, "9", "Z", "\U0001f600"]
    docs = [(i, None if i == 5 else draw.choice([" ", "-", "\n", "\x7f "]).join(draw.choice(words if draw.random() < 0.97 else odd) for _ in range(draw.randint(0, 60)))) for i in range(400)]
    bench = [" ".join(draw.choice(words[:100]) for _ in range(30)) for _ in range(20)] + [None, ""]
    df, target = spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(x,) for x in bench], "text string")
    assert drawn(resample.resampled(df, target, percent=30)) == brute_resample(docs, bench, percent=30)


def test_resampling_of_odd_rows(spark, odd, empty, odd_rows):
    bench = ["same text in two rows of it, and more of the same text to be long enough"]
    target = spark.createDataFrame([(x,) for x in bench], "text string")
    assert drawn(resample.resampled(odd, target, percent=50, least_words=6)) == brute_resample([r[:2] for r in odd_rows], bench, 50, 6)
    assert resample.resampled(empty, target).count() == 0
    nothing = resample.resampled(spark.createDataFrame(odd_rows, DOCS), target.limit(0), percent=0)
    assert nothing.where("rank is not null").count() == 0 and nothing.count() == len(odd_rows)


def test_ties_are_cut_exactly(spark, monkeypatch):
    monkeypatch.setattr(resample, "FEW", 1)
    rows = [(7, " ".join("same words again and again".split() * 5))] * 100 + [(None, "a b c d e f g h i j k l m n o p q r s t u")] * 100
    out = resample.resampled(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([("a b c",)], "text string"), percent=40)
    assert sorted(r["rank"] for r in out.collect() if r["rank"]) == list(range(1, 81))


TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, last = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].add(c)
        last[tuple(whole)].append(c)
    out = Counter()
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in members if len(p) == len(path) + 1 and p[:-1] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        digest = hashlib.sha256(",".join(map(str, sorted(last[path]))).encode()).hexdigest()
        out[(min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children), len(leaves), saved, digest)] += 1
    return out


def trie(df):
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in conversation_trie.prefix_trie(df).collect())


@pytest.mark.parametrize("packed", [4, 1 << 16])
def test_trie_equals_brute_force(spark, monkeypatch, packed):
    monkeypatch.setattr(conversation_trie, "PACKED", packed)
    draw = random.Random(8)
    rows = []
    for c in [*range(0, 30), *range(100, 130), *range(201, 215), -5, -100, None]:
        for turn in range(draw.choice([1, 2, 3, 6, 9])):
            rows.append((c, draw.choice([turn, turn, None, 1]), draw.choice(["user", "assistant", None]), draw.choice(["hi", "hello \U0001f600", None, "", "long text"])))
    rows += [(100, 50 + i, "user", f"hot {i % 7}") for i in range(60)] + rows[:3]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(f"x{c}") for c in ("depth", "part", "at", "digest", "c", "d", "kids", "saved", "base", "h", "b")})
    assert trie(df.repartition(6)) == brute_trie(rows)


def test_trie_of_little(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert conversation_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0
    alone = next(c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6)
    rows = [(alone, None, None, None)]  # its only turn is replaced by those of a conversation that is absent
    assert trie(spark.createDataFrame(rows, TURNS)) == brute_trie(rows)


def test_contraction_of_a_long_chain_takes_few_rounds(spark, tmp_path, monkeypatch):
    n = 300
    rows = [(0, d, None if not d else 0, d - 1 if d else None, int(d < n), d) for d in range(n + 1)]
    tree = spark.createDataFrame(rows, "c long, d long, pc long, pd long, kids long, saved long")
    out = {r.d: (r.leaves, r.saved) for r in conversation_trie.subtree_totals(tree, str(tmp_path / "t")).collect()}
    assert out == {d: (1, sum(range(d, n + 1))) for d in range(n + 1)}
    assert len(list((tmp_path / "t").glob("alive-*"))) <= 13


def brute_near(rows, wanted, every):
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scores[:wanted]]
    return out


VECTORS = "vec_id long, embedding array<float>"


def near(df, **more):
    out = defaultdict(list)
    for r in graph_search.neighbours(df, **more).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_graph_search_of_odd_rows(spark):
    draw = random.Random(4)
    f32 = lambda n: [float(np.float32(draw.gauss(0, 1))) for _ in range(n)]
    good = {i: f32(8) for i in range(60)} | {i: f32(5) for i in range(60, 70)}
    good |= {i: good[7] for i in range(100, 160)} | {200: [3e38, *[0.0] * 7], 220: [1e-30] * 8}
    bad = [(None, f32(8)), (300, None), (320, []), (340, [0.0] * 8), (360, [float("nan"), *[1.0] * 7]), (380, [None, *[1.0] * 7]), (400, [float("inf"), *[1.0] * 7])]
    rows = [*good.items(), *bad, *list(good.items())[:5]]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(f"x{c}") for c in ("dim", "lead", "shard", "ids", "n", "score", "rank", "place", "kind")})
    assert near(df, wanted=20, every=20) == brute_near(good, 20, 20)
    assert near(df.where("vec_id = 20")) == {} and near(df.limit(0)) == {}


def test_graph_search_finds_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(graph_search, "SHARDS", 2)
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(12, 24))
    vectors = (centres[draw.integers(0, 12, 3000)] + 0.6 * draw.normal(size=(3000, 24))).astype(np.float32) * draw.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    vectors[500:1500] = vectors[500]  # one vector in a third of all rows
    found = near(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], VECTORS))
    doubles, hits = vectors.astype(float), 0
    for q in range(0, 3000, 20):
        scores = doubles @ doubles[q]
        scores[q] = -np.inf
        order = np.lexsort((np.arange(3000), -scores.round(9)))[:20]
        assert len(found[q]) == 20
        hits += len({i for i, _ in found[q]} & set(order.tolist()))
    assert hits >= 0.95 * 20 * len(found)


def test_graph_layers_are_flat_and_linked():
    draw = np.random.default_rng(2)
    vectors = graph_search.raised(draw.normal(size=(700, 16)))
    levels = np.sort((-np.log(draw.uniform(size=700)) / np.log(16)).astype(int))[::-1]
    layers = graph_search.build(vectors, levels)
    for k, links in enumerate(layers):
        assert len(links) == (levels >= k).sum() and links.max(initial=-1) < len(links)
        assert all(i not in row[row >= 0] and len(set(row[row >= 0])) == (row >= 0).sum() for i, row in enumerate(links))
    reached, edge = {0}, [0]
    while edge:
        edge = list({int(j) for i in edge for j in layers[0][i] if j >= 0} - reached)
        reached |= set(edge)
    assert len(reached) >= 0.99 * 700
