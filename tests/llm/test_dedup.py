import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.llm import decontaminate, jaccard, substrings
from tests.llm.conftest import DOCS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(words, seed, n=120):
    """Texts with shared passages, copies of copies and near copies of many kinds."""
    draw = random.Random(seed)
    passages = [" ".join(draw.choices(words, k=draw.randint(8, 40))) for _ in range(4)]
    base = draw.choices(words, k=60)
    texts = []
    for i in range(n):
        own = [" ".join(draw.choices(words[: draw.choice([20, 800])], k=draw.randint(0, 50)))]
        if draw.random() < 0.5:
            own.append(passages[draw.choice([0, 0, 0, 1, 2, 3])])
        if draw.random() < 0.3:
            own = [" ".join(w if draw.random() > 0.01 * (i % 5) else draw.choice(words) for w in base)]
        if texts and draw.random() < 0.2:
            own = [draw.choice(texts)]
        texts.append(draw.choice([" ", "\n", "\t "]).join(own + [" ".join(draw.choices(words, k=draw.randint(0, 9)))] * (draw.random() < 0.6)))
    ids = draw.sample(range(5 * n), n)
    return list(zip(ids, texts, strict=True))


def brute_spans(rows, k):
    least = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for j in range(len(w) - k + 1):
            if least[tuple(w[j : j + k])] < i:
                gone |= set(range(j, j + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("heavy", "bucket", "k"), [(2048, 1 << 24, 8), (20, 1 << 24, 8), (3, 256, 8), (20, 1 << 24, 5)])
def test_repeats_equal_brute_force(spark, words, heavy, bucket, k):
    rows = corpus(words, heavy)
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs, k, heavy, bucket).collect()}
    assert got == brute_spans(rows, k)
    assert sum(x[1] for x in got.values()) > 100


def test_hot_minimisers_are_found(spark, words):
    passage = " ".join(words[:40])
    docs = spark.createDataFrame([(i, f"{passage} {' '.join(random.Random(i).choices(words, k=10))}", None, None, 0) for i in range(200)], DOCS)
    assert len(substrings.heavy_minimisers(docs.repartition(4), 8, 50)) > 0


@pytest.mark.parametrize("collide", [False, True])
def test_colliding_hashes_are_split(collide):
    words, powers = b"a b c a b d a b c", substrings.Powers()
    begin, end, hashes = substrings.word_hashes(words, powers)
    hashes = np.ones_like(hashes) if collide else hashes
    got = substrings.same_windows(words, begin, end, hashes, np.array([0, 3, 6]), 3, powers)
    assert got[0] == got[2] != got[1]


def test_words_are_those_of_the_contract(words):
    draw = random.Random(1)
    for _ in range(200):
        text = "".join(draw.choice([*words[:9], " ", "\n", "\x0b", "\x0c", "\r", "\t", "\x1c", "\x85", "\u00a0", "\u3000", "é"]) for _ in range(30))
        joined = substrings.joined_words(text)
        assert joined.decode() == " ".join(WORD.findall(text))
        for stretch in (7, 1 << 20):
            begin, end, hashes = substrings.word_hashes(joined, substrings.Powers(), stretch)
            own = [joined[a:b] for a, b in zip(begin, end, strict=True)]
            assert own == joined.split() and len(set(hashes.tolist())) == len(set(own))
            alone = {w: substrings.word_hashes(w, substrings.Powers())[2][0] for w in own}
            assert all(alone[w] == h for w, h in zip(own, hashes, strict=True))


def test_repeats_of_odd_rows(odd, empty, odd_rows, spark):
    got = substrings.remove_repeats(odd, 3).collect()
    assert len(got) == len(odd_rows)
    by = {(r.doc_id, r.n_words): r for r in got}
    assert by[7, 7].n_removed == 0 and by[8, 7].n_removed == 7 and by[1, 0].n_removed == 0
    edited = substrings.without_repeats(odd, 3)
    assert edited.columns == odd.columns and 8 not in {r.doc_id for r in edited.collect()}
    assert substrings.without_repeats(empty, 3).count() == 0 and substrings.remove_repeats(empty).count() == 0
    rest = spark.createDataFrame([(1, "a b c d e f", None, None, 11), (2, "x\n a b c  d y", None, None, 13), (None, "a b c d", None, None, 7)], DOCS)
    assert {(r.doc_id, r.text, r.n_chars) for r in substrings.without_repeats(rest, 4).collect()} == {(1, "a b c d e f", 11), (2, "x y", 3)}


def brute_links(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    component = {i: i for i in sets}
    links = Counter()
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links.update((a, b))
                old, new = sorted((component[a], component[b]), reverse=True)
                component = {k: new if v == old else v for k, v in component.items()}
    return {i: (len(sets[i]), component[i], links[i]) for i in sets}


@pytest.mark.parametrize(("width", "percent", "group", "block"), [(3, 90, 32, 1 << 17), (3, 90, 2, 200), (5, 80, 3, 300), (2, 70, 1, 64)])
def test_links_equal_brute_force(spark, words, monkeypatch, width, percent, group, block):
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(words, 7 + group, 160)
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.linked(docs, width, percent).collect()}
    want = brute_links(rows, width, percent)
    assert got == want
    assert sum(v[2] for v in want.values()) > 40


def test_links_of_odd_rows(odd, empty, odd_rows):
    got = jaccard.linked(odd).collect()
    assert len(got) == len(odd_rows)
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles == 0} == {(1, 1), (2, 2), (3, 3), (10, 10)}
    assert {(r.doc_id, r.component_id, r.n_links) for r in got if r.doc_id in (7, 8)} == {(7, 7, 1), (8, 7, 1)}
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is None} == {(None, None)}
    kept = jaccard.without_near_copies(odd, 5, 80)
    assert kept.columns == odd.columns and kept.where("doc_id = 8").count() == 0 and kept.where("doc_id is null").count() == 1
    assert jaccard.linked(empty).count() == 0


def test_texts_of_a_large_cluster_travel_once_and_packed(spark, words):
    """360 near copies of a text of 500 words stay one block: their texts went to two places each when it held 2^17 shingles."""
    classes = spark.range(360).select(F.col("id").alias("rep"), F.lit(500).alias("n"), F.lit(1).cast("long").alias("copies"))
    groups = classes.select(F.col("rep").alias("node"), F.lit(0).cast("long").alias("component"))
    near = jaccard.places(groups, classes).collect()
    assert len(near) == 360 and {r.side for r in near} == {2} and len({r.key for r in near}) == 1
    text = " ".join(words[i % len(words)] for i in range(0, 7000, 7)) + " Ü\n"
    rows = jaccard.packed(spark.createDataFrame([(1, text), (2, None)], "node long, text string")).collect()
    assert [zlib.decompress(r.text).decode() for r in rows] == [text, ""] and len(rows[0].text) < len(text) / 2


def test_frequent_shingles_show_in_a_full_sketch():
    """Cells of a large corpus hold many shingles by chance; those of a few more documents than are paired still count as frequent."""
    total = np.random.default_rng(3).poisson(5, jaccard.SLAB)
    total[:500] += jaccard.GROUP
    logs = jaccard.logs_of(total)
    assert (logs[:500] > 0).all() and (logs[500:] > 0).mean() < 0.001
    total = np.random.default_rng(3).poisson(100, jaccard.SLAB)
    total[:500] += 4 * jaccard.GROUP
    logs = jaccard.logs_of(total)
    assert (logs[:500] > 0).all() and (logs[500:] > 0).mean() < 0.01


def test_only_doubtful_texts_travel(odd, spark):
    """Of the rows of docs, those that a bitmap of ids may hold and the others: each row is in one of both, with all its columns."""
    bits = spark.sparkContext.broadcast(jaccard.bitmap(spark.createDataFrame([(4,), (7,), (99,)], "node long")))
    inside, outside = (jaccard.among(odd, "doc_id", bits, x) for x in (True, False))
    assert inside.columns == outside.columns == odd.columns
    assert [r.doc_id for r in inside.orderBy("doc_id").collect()] == [4, 7, 7]
    assert inside.unionByName(outside).exceptAll(odd).isEmpty() and odd.exceptAll(inside.unionByName(outside)).isEmpty()


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 200) for i in range(30)]
    got = {r.node: r.component for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}, 200: 100}


def items_and_docs(words, seed):
    draw = random.Random(seed)
    items = [(i, " ".join(draw.choices(words, k=draw.randint(12, 40))) + ". " + " ".join(draw.choices(words, k=draw.randint(2, 9))) + ".") for i in range(150)]
    docs, want = [], set()
    for d in range(200):
        text = " ".join(draw.choices(words, k=draw.randint(0, 250)))
        if d % 4 == 0:
            item, leak = draw.choice(items)
            want.add((d, item))
            text = f"{text} {leak.upper() if d % 8 else leak.replace('. ', ' -- ')} {' '.join(draw.choices(words, k=draw.randint(0, 90)))}"
        elif d % 4 == 1:
            text += " " + draw.choice(items)[1].rpartition(". ")[2]  # the answer alone
        docs.append((d, text, None, None, 0))
    return items, docs, want


def test_leaks_are_found_and_clean_text_is_not(spark, words):
    items, docs, want = items_and_docs(words, 3)
    frame, tests = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for part in (1 << 24, 2000):
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, tests, part).collect()} == want
    kept = decontaminate.without_leaks(frame, tests, 2000)
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {d for d, _ in want}


@pytest.mark.parametrize("block", [1, 3, 64])
def test_wand_equals_full_scoring(words, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    index = decontaminate.Index(items_and_docs(words, 5)[0])
    draw = random.Random(8)
    for _ in range(150):
        own = {t for w in draw.sample(words, 60) if (t := index.terms.get(w)) is not None}
        scores = defaultdict(float)
        for t in own:
            for item, weight in zip(index.docs[t], index.weights[t], strict=True):
                scores[item] += weight
        for least in (0.1, 0.2, 0.3):
            got = dict(index.search(sorted(own), least))
            assert set(got) == {i for i, s in scores.items() if s >= least} and all(abs(got[i] - scores[i]) < 1e-9 for i in got)


def test_passage_bounds_lose_no_item(words):
    items, docs, _ = items_and_docs(words, 9)
    index = decontaminate.Index(items)
    step, none = index.passage // 2, len(index.terms)
    for _, text, *_ in docs:
        own = decontaminate.tokens(text)
        ids = np.fromiter((index.terms.get(w, none) for w in own), np.int64, len(own))
        have = set(index.candidates(ids, step, 0.4))
        for c in range(-(-len(own) // step)):
            scores = defaultdict(float)
            for t in set(ids[c * step : c * step + index.passage].tolist()) - {none}:
                for item, weight in zip(index.docs[t], index.weights[t], strict=True):
                    scores[item] += weight
            assert c in have or max(scores.values(), default=0) < 0.4


def test_leaks_of_odd_rows(spark, odd, empty, odd_rows):
    tests = spark.createDataFrame([(1, "same text in two rows of it"), (1, None), (2, ""), (3, "---"), (None, "one"), (5, "same text in two rows of it")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(odd, tests).collect())
    assert got == {(7, 1): 2, (7, 5): 2, (8, 1): 1, (8, 5): 1, (4, None): 1}
    assert decontaminate.without_leaks(odd, tests).count() == len(odd_rows) - 4
    assert decontaminate.leaks(empty, tests).count() == 0
    assert decontaminate.leaks(odd, tests.where(F.lit(False))).count() == 0 and decontaminate.without_leaks(odd, tests.where(F.lit(False))).count() == len(odd_rows)
