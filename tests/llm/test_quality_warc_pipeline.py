import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricetide.llm import perplexity, quality, toxicity, warc
from pricetide.llm.common import fold
from tests.llm.conftest import DOCS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PAGES = "page_id long, url string, html string"


def test_folds(spark):
    rows = spark.range(300).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[x] > 1 for j in (i, i + 1, i + 2)}
    lines = text.split("\n")
    doubles = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), doubles, len(covered)


def test_base_counts_equal_brute_force(words):
    draw = random.Random(2)
    for _ in range(300):
        text = "".join(draw.choice([*words[:6], "#", "é💩", "a", "|"]) + draw.choice([" ", "\n", " ", "\t", "\x0b", "  ", "\n\n"]) for _ in range(draw.randint(0, 60)))
        assert perplexity.base(text) == brute_base(text)


def brute_kneser_ney(texts):
    """Probability function of (context, symbol) from plain dictionaries."""
    s = perplexity.SYMBOLS
    counts = [Counter(int(k) for t in texts for k in perplexity.grams(t))]
    for order in range(perplexity.ORDER - 1, 0, -1):
        counts.insert(0, Counter(k % s**order for k in counts[0]))
    discounts = []
    for own in counts:
        n = Counter(own.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] and y else 0.5 * k for k in (1, 2, 3)]
        discounts.append([min(max(x, 0.1), k - 0.1) for k, x in enumerate(d, 1)])
    totals = [Counter() for _ in counts]
    gammas = [Counter() for _ in counts]
    for own, d, total, gamma in zip(counts, discounts, totals, gammas, strict=True):
        for k, n in own.items():
            total[k // s] += n
            gamma[k // s] += d[min(n, 3) - 1]

    def p(key, order):
        if order == 0:
            return 1 / s
        own, context, below = key % s**order, key % s**order // s, p(key, order - 1)
        if not totals[order - 1][context]:
            return below
        n, t = counts[order - 1][own], totals[order - 1][context]
        return (max(0, n - discounts[order - 1][min(n, 3) - 1]) if n else 0) / t + gammas[order - 1][context] / t * below

    return p


def test_model_equals_plain_kneser_ney_and_sums_to_one(spark, words):
    draw = random.Random(9)
    texts = [" ".join(draw.choices(words, k=30)) for _ in range(60)] + ["", "É, 7!"]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in enumerate(texts)], DOCS)
    model = perplexity.arrays(perplexity.kneser_ney(docs.select("text")))
    p = brute_kneser_ney(texts)
    keys = np.concatenate([perplexity.grams(t) for t in [*texts[:9], "zzz unseen ### text 99"]])
    assert np.allclose(perplexity.log_probabilities(model, keys), [math.log(p(int(k), perplexity.ORDER)) for k in keys], atol=1e-4)
    s = perplexity.SYMBOLS
    for k in keys[::40]:
        assert np.exp(perplexity.log_probabilities(model, k // s * s + np.arange(s))).sum() == pytest.approx(1, abs=1e-4)


def test_perplexity_bands(spark, words, odd, empty, odd_rows):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choices(words, k=120)), "en" if i % 3 else None, None, 0) for i in range(450)]
    rows += [(1000, " ".join("".join(draw.choices("bcdfghjkqvwxz#$%", k=7)) for _ in range(120)), "en", None, 0), (1001, " ".join(f"{w}{w}" for w in ["aa", "ab", "ba"] * 40), "en", None, 0), (1002, "too short", "en", None, 0)]
    got = {r.doc_id: r for r in perplexity.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].kept for i in range(450))
    assert not got[1000].kept and not got[1000].base_failed and got[1000].perplexity > got[1000].high
    assert got[1001].base_failed and got[1002].base_failed and not got[1002].kept
    odd_got = perplexity.judge(odd).collect()
    assert len(odd_got) == len(odd_rows)
    for (_, text, *_), r in zip(sorted(odd_rows, key=lambda x: (x[0] is None, x[0] or 0)), sorted(odd_got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(text)
        assert r.kept is False or r.n_words >= 50
    assert perplexity.judge(empty).count() == 0


def plain_nats(texts, model, chars):
    """Nats per character of each text from dictionaries."""
    split = [[w.lower() for w in WORD.findall(t or "")] for t in texts]
    own = [(Counter(w), Counter(zip(["<"] + w, w + [">"], strict=True)) if w else Counter()) for w in split]
    one, two, starts = sum((o[0] for o in own), Counter()), sum((o[1] for o in own), Counter()), sum(map(bool, split))
    alone = max(1.0, perplexity.ALONE * chars)
    for t, w, (mine, pairs) in zip(texts, split, own, strict=True):
        if not w:
            yield None
            continue
        q = {x: math.exp(-perplexity.nats_of(perplexity.step_of(perplexity.spelled(model, [x]))[0])) for x in mine} | {">": math.exp(-perplexity.nats_of(perplexity.END_STEP))}
        total = sum(one.values()) + starts - len(w) - 1
        n = {x: one[x] - mine[x] for x in mine} | {"<": starts - 1, ">": starts - 1}
        logs = sum(math.log((n[b] + alone * q[b]) / (total + alone)) for b in [*w, ">"])
        logs += sum(c * math.log((two[p] - c + perplexity.AFTER * q[p[1]]) / (n[p[0]] + perplexity.AFTER)) for p, c in pairs.items())
        yield -logs / 2 / (sum(map(len, w)) + len(w) + 1)


def test_pieces_hold_an_ngram_once_and_tell_equal_hashes_apart_by_their_steps():
    draw = np.random.default_rng(4)
    assert [x.tolist() for x in perplexity.unpacked(perplexity.packed(np.arange(0), np.array([0, 7, 1 << 40]), np.zeros(3, int)))] == [[], [0, 7, 1 << 40], [0, 0, 0]]
    own = draw.integers(0, 1 << 63, 30_000, dtype=np.uint64)
    texts = [(own[x], (20 + own[x] % np.uint64(30)).astype(np.uint8)) for x in (draw.zipf(1.3, 200) % 30_000 for _ in range(2000))]
    pieces = list(perplexity.postings(texts, 10**9))
    assert 8 * sum(len(data) for _, data in pieces) / (401 * len(texts)) < 11  # 12.6 with an n-gram's hash, text and step in every row
    same = [(np.array([5], np.uint64), np.array([step], np.uint8)) for step in (30, 30, 40)]
    (words,) = [data for shard, data in perplexity.postings(same, 1000) if shard % 2 == 0]
    ((_, found),) = perplexity.terms(1, [(0, words)], 10.0)
    which, gains, _ = perplexity.unpacked(found)
    gains = dict(zip(np.cumsum(which).tolist(), gains.tolist(), strict=True))
    assert gains[0] == gains[1] > 0 == gains[2]


def test_word_model_equals_dictionaries_in_any_layout(spark, words, odd_rows, monkeypatch):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choices(words[:90], k=draw.randint(1, 40))), "en", None, 0) for i in range(120)] + odd_rows
    docs, texts = spark.createDataFrame(rows, DOCS).repartition(3), [r[1] for r in rows]
    chars = sum(len(t or "") for t in texts)
    model = perplexity.arrays(perplexity.kneser_ney(docs.select("text")))
    want = sorted((t or "", x) for t, x in zip(texts, plain_nats(texts, model, chars), strict=True) if x is not None)
    for shard, piece, size in ((1 << 22, 1 << 21, 512), (5_000, 2_000, 40)):
        monkeypatch.setattr(perplexity, "SHARD", shard)
        monkeypatch.setattr(perplexity, "PIECE", piece)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        got = perplexity.with_nats(perplexity.scored(docs, model, chars), chars).where("nats is not null").select("nats").collect()
        assert sorted(r.nats for r in got) == pytest.approx(sorted(x for _, x in want), abs=2e-3)
    assert perplexity.layout(50 * 10**9)[1][1] > perplexity.layout(10**9)[1][1] > 0


def test_perplexity_reads_order_and_other_scripts(spark):
    """Texts that walk from word to word by a rule, in Cyrillic; then with the same words in disorder."""
    draw = random.Random(8)
    names = ["".join(draw.choices("абвгдежзиклмнопрстуфхцчшщыэюя", k=6)) for _ in range(300)]
    after = {w: draw.sample(names, 3) for w in names}

    def walk():
        out = [draw.choice(names)]
        while len(out) < 100:
            out.append(draw.choice(after[out[-1]]))
        return out

    rows = [(i, " ".join(walk()), "ru", None, 0) for i in range(400)] + [(1000 + i, " ".join(draw.sample(w := walk(), len(w))), "ru", None, 0) for i in range(20)]
    got = {r.doc_id: r for r in perplexity.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(got[i].low <= got[i].perplexity <= got[i].high for i in range(400)) > 390, sorted((got[i].low, got[i].perplexity, got[i].high) for i in range(400))[:9]
    assert all(got[1000 + i].spelling <= got[1000 + i].spelling_high and not got[1000 + i].kept for i in range(20)) and all(got[1000 + i].perplexity > got[1000 + i].high for i in range(20))


def test_bands_of_each_side_have_their_width(spark):
    """Quartile distance 1 around 100; one text just inside and one just outside of each band."""
    rows = [(i, "en", False, 100 + (i - 200) / 100, 100 + (i - 200) / 100) for i in range(401)]
    edges = [(k, side, w) for k, m in enumerate(("nats", "letters")) for side, w in zip((-1, 1), perplexity.WIDTHS[m], strict=True)]
    rows += [(1000 + 2 * j + out, "en", False, *(100 + side * (w + (0.5 if out else -0.5)) if k == of else 100.0 for of in (0, 1))) for j, (k, side, w) in enumerate(edges) for out in (0, 1)]
    got = {r.doc_id: r.kept for r in perplexity.banded(spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, nats double, letters double")).collect()}
    assert all(got[i] for i in range(401)) and [got[1000 + i] for i in range(8)] == [True, False] * 4
    assert all(w < 10 for widths in perplexity.WIDTHS.values() for w in widths)


def labelled_corpus(spark, words, n=700):
    draw = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        toxic, good = i % 6 == 0, i % 7 != 0
        own = draw.choices(words, k=60)
        if toxic:
            for bad in draw.sample(["vilewretch", "filthrot", "dimscoundrel"], 2):
                own[draw.randrange(60)] = bad
        if not good:
            own = [w + draw.choice(["###", "$$$", "!!"]) for w in own] if i % 2 else own[:2] * 30
        rows.append((i, " ".join(own), "en", None, 0))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scores, labels, column, least):
    want = {r.doc_id: r[column] for r in labels.collect()}
    return sum((r.score >= least) == (want[r.doc_id] == 1) for r in scores.collect()) / len(want)


def test_toxicity_held_out(spark, words, odd, empty, odd_rows):
    docs, labels = labelled_corpus(spark, words)
    model = toxicity.trained(docs, labels)
    held_out = docs.where(fold(F.col("doc_id"), 3) == 1)
    mine = labels.join(held_out.select("doc_id"), "doc_id")
    assert accuracy(toxicity.score(held_out, model), mine, "toxic", toxicity.PREDICT) > 0.97
    steps, shares = toxicity.rising_shares([0, 0, 1, 3, -2, 0], [0, 0, 1, 1, 0, 1])
    assert list(steps) == sorted(set(steps)) and list(shares) == sorted(shares) and list(model.shares) == sorted(model.shares)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score < toxicity.PREDICT for r in got)
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.trained(docs, labels.where("toxic = 0"))
    assert len({r.score for r in toxicity.score(docs, none).collect()}) == 1
    assert len({r.score for r in toxicity.score(odd, toxicity.trained(empty, labels)).collect()}) == 1


def test_distances_do_not_depend_on_the_sizes_of_dictionaries():
    """Ordinary windows save nothing and toxic words do, in dictionaries below, around and beyond 16 KB; there the compression library changes its ways."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(3, 8)))
    for size in (12_000, 15_500, 15_700, 17_000, 40_000):
        words, marked = [], [f"quxxy{word()}" for _ in range(50)]
        while len(plain := f" {' '.join(words)} ".encode()) < size:
            words += [word() for _ in range(20)]
        distances = toxicity.Distances(plain, "".join(f" {w} " for w in marked).encode() + plain)
        window = lambda *end: f" {' '.join([*draw.choices(words, k=12 - len(end)), *end])} ".encode()  # noqa: E731, B023
        assert (distances.saved([window() for _ in range(200)]) != 0).mean() < 0.05
        assert (distances.saved([window(draw.choice(marked)) for _ in range(200)]) > 0).all()


def test_toxic_stems_that_build_new_words_in_two_languages(spark):
    """Insults are stems with endings that don't repeat; each language must be caught, though one has most of the labels."""
    draw = random.Random(3)
    tongues = [["ba", "ko", "ri", "tu", "men", "sal", "der", "vo", "ling", "est"], ["qué", "zar", "ño", "llu", "xi", "jeo", "güi", "pa", "rro", "cha"]]
    stems, rows, labels = ["grumpfex", "ñochutle"], [], []
    for i in range(1500):
        k = int(i % 5 == 0)
        word = lambda k=k: "".join(draw.choice(tongues[k]) for _ in range(draw.randint(1, 4)))
        own = [word() for _ in range(draw.randint(60, 200))]
        toxic = draw.random() < 0.3
        if toxic:
            for _ in range(len(own) // 20):
                own[draw.randrange(len(own))] = stems[k] + word()
        rows.append((i, " ".join(own), "en", None, 0))
        labels.append((i, k, int(toxic)))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, tongue int, toxic int")
    model = toxicity.trained(docs, labels)
    assert len(model.centres) == 2
    got = {r.doc_id: r.score >= toxicity.PREDICT for r in toxicity.score(docs, model).collect()}
    for k in (0, 1):
        held = [r for r in labels.collect() if r.tongue == k and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
        assert sum(got[r.doc_id] for r in held if r.toxic) >= 0.9 * sum(r.toxic for r in held)
        assert sum(got[r.doc_id] for r in held if not r.toxic) <= 0.02 * len(held)


def test_ids_that_repeat_in_the_fit_don_t_break_it(spark, words):
    docs, labels = labelled_corpus(spark, words, 200)
    twice = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))).withColumns({c: F.lit("x") for c in ("label", "place", "kind")})
    assert toxicity.score(twice, toxicity.trained(twice, labels.unionByName(labels))).count() == 600
    assert quality.score(twice, quality.trained(twice, labels.unionByName(labels))).count() == 600


def test_windows_cover_every_word():
    for n in (1, 23, 24, 25, 46, 47, 48, 200):
        own = [f"w{i}" for i in range(n)]
        assert {w for x in toxicity.cut_windows(" ".join(own)) for w in x.decode().split()} == set(own)


def test_quality_held_out(spark, words, odd, empty, odd_rows):
    docs, labels = labelled_corpus(spark, words, 2000)
    model = quality.trained(docs, labels)
    assert model[3] == pytest.approx(6 / 7, abs=0.12)
    held_out = docs.where(fold(F.col("doc_id"), 5) == 0)
    mine = labels.join(held_out.select("doc_id"), "doc_id")
    assert accuracy(quality.score(held_out, model), mine, "quality", quality.PREDICT) > 0.95
    got = quality.score(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, model).count() == 0
    assert {r.score for r in quality.score(odd, quality.trained(docs, labels.where("quality = 0"))).collect()} == {0.5}


def pages(spark):
    draw = random.Random(13)
    bodies = [f"<p>{'x' * draw.randint(0, 300)}é{i % 7}</p>" for i in range(40)] + ["<html>" + "same " * 50, "short", "", None]
    rows = [(draw.randrange(10**6) if i % 50 else None, draw.choice([f"http://a.example/{i}", None, "a b\r\nc"]), draw.choice(bodies)) for i in range(400)]
    rows += [rows[1], (rows[1][0], "other", rows[1][2]), (10**12, "big", "".join(chr(33 + draw.randrange(90)) for _ in range(200_000)))]
    return rows, spark.createDataFrame(rows, PAGES)


def test_archives_round_trip(spark, tmp_path):
    rows, frame = pages(spark)
    manifest = warc.write_archives(frame.repartition(5), str(tmp_path / "a"), roll=20_000, shard_bytes=40_000)
    got = warc.read_archives(spark, manifest, with_payload=True).collect()
    least = {}
    for i, _, html in rows:
        if i is not None:
            least[html or ""] = min(least.get(html or "", i), i)
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        first = least.get(html or "") if len(raw) >= 100 else None
        revisit = first is not None and i != first
        want[i, len(raw), "revisit" if revisit else "response", first if revisit else None, None if revisit else raw] += 1
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    again = warc.write_archives(frame.repartition(3), str(tmp_path / "b"), roll=20_000, shard_bytes=40_000)
    files = {p.name: p.read_bytes() for p in (tmp_path / "a/archives").glob("*.gz")}
    assert files == {p.name: p.read_bytes() for p in (tmp_path / "b/archives").glob("*.gz")} and len(files) > 3
    assert {r.name for r in spark.read.parquet(again).collect()} == set(files)
    assert max(map(len, files.values())) < 250_000
    ids = [[int(x) for x in re.findall(rb"X-Page-Id: (\d+)", b"".join(warc.members(files[n])))] for n in sorted(files)]
    assert sum(ids, []) == sorted(sum(ids, []))


def test_archives_of_nothing_and_damage(spark, tmp_path):
    manifest = warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "e"))
    assert warc.read_archives(spark, manifest).count() == 0
    raw = warc.record("response", warc.page_fields(1, None, "d", 3), warc.HTTP + b"abc")
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(raw.replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(warc.member(raw)[:-9]))
    assert list(warc.members(warc.member(raw) + warc.EMPTY + warc.member(b"x"))) == [raw, b"x"]


def test_pipeline_stages(spark, words, tmp_path):
    draw = random.Random(17)
    docs, labels = labelled_corpus(spark, words, 400)
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = [i for i in texts if i % 6 and i % 7]
    passage = " ".join(draw.choices(words, k=70))
    item = " ".join(draw.choices(words, k=30)) + ". " + " ".join(draw.choices(words, k=6)) + "."
    texts[1001], texts[1002] = texts[clean[0]], texts[clean[1]] + " tail"
    texts[1003], texts[1004] = f"{passage} {texts[clean[2]][:150]}", f"{' '.join(draw.choices(words, k=80))} {passage} end"
    texts[1005], texts[1006], texts[1007] = f"{' '.join(draw.choices(words, k=50))} {item}", None, ""
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in texts.items()]
    for name, frame in (("documents", spark.createDataFrame(rows, DOCS)), ("labels", labels), ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, now = {r.doc_id: r.text for r in now.collect()}, spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r.text for r in now.collect()}
        gone = set(before) - set(after)
        if name == "toxicity":
            bad = {i for i, t in before.items() if re.search("vilewretch|filthrot|dimscoundrel", t or "")}
            assert len(gone - bad) <= 2 and len(bad - gone) <= 2
        elif name == "near_copies":
            assert {1001, 1002} <= gone and not gone & {1003, 1004, 1005}
        elif name == "repeated_passages":
            assert passage in after[1003] and passage not in after[1004] and after[1004].endswith(" end")
        else:
            assert gone == {1005}
    mixed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    for source in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.taken) for r in whole.collect()) == sorted((r.doc_id, r.taken) for r in mixed)
