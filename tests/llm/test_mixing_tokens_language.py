import random
import re
from collections import Counter

import pytest

from pricetide.llm import language, mixing, tokens
from tests.llm.conftest import DOCS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def waterfill(sizes):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        share = sum(weight[s] for s in sizes if s not in full)
        over = [s for s in sizes if s not in full and weight[s] * left / share >= 2 * sizes[s] - 1e-9]
        if not over:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * left / share for s in sizes}
        full |= set(over)


def test_mix_reaches_targets(spark, words):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choices(words, k=draw.choice([0, 1, 5, 40, 400]))), None, draw.choice(["a", "a", "a", "B", "é", "z", None]), 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text))
    want = waterfill(dict(sizes))
    for source in want:
        mine = [r for r in got if r.source == source]
        assert all(r.target == pytest.approx(want[source]) and r.source_size == sizes[source] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[source]) <= 0.5
    assert all(0 <= r.taken <= 2 * r.size for r in got) and len(got) == len(rows)
    assert sorted(got) == sorted(mixing.mix(docs.repartition(7)).collect())


def test_longer_documents_have_better_odds(spark):
    rows = [(i, " ".join(["w"] * (100 if i % 2 else 4)), None, "a" if i % 3 else "b", 0) for i in range(3000)]
    got = [r for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect() if r.source == "b"]
    share = {n: sum(r.taken >= r.size * (r.target // r.source_size + 1) for r in got if r.size == n) / sum(r.size == n for r in got) for n in (4, 100)}
    assert share[100] > share[4]


def test_mix_of_odd_rows(odd, empty, odd_rows):
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows) and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(empty).count() == 0
    kept = mixing.mixed_documents(odd)
    assert kept.count() == sum(r.taken > 0 for r in got) and kept.columns[-4:] == ["size", "source_size", "target", "taken"]
    assert mixing.mixed_documents(empty).count() == 0


@pytest.fixture(scope="module")
def pieces():
    sentencepiece = pytest.importorskip("sentencepiece")
    public = pytest.importorskip("public_tokenizers")
    return sentencepiece.SentencePieceProcessor(model_file=public.path(tokens.MODEL))


def test_token_counts_equal_whole_text_encoding(spark, pieces, words, odd, odd_rows, empty):
    draw = random.Random(3)
    parts = [" ", "  ", "\n", "\r\n", "\t", "▁", "▁▁", "<s>", "</s>", "<unk>", "<0x0A>", "é", "💩", "中文", "\x00", "}\r", "a" * 300, *words[:30]]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(400)] + ["\n", " ", "▁", "\n\n", "a\n", " \n "]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    for r in tokens.count_tokens(docs, limit=30).collect():
        n = len(pieces.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 30), texts[r.doc_id]
    got = sorted((r.n_bytes, r.n_tokens) for r in tokens.count_tokens(odd).collect())
    assert got == sorted((len((t or "").encode()), len(pieces.encode(t or ""))) for _, t, *_ in odd_rows)
    assert tokens.count_tokens(empty).count() == 0


def test_worker_cache_stays_bounded(monkeypatch, pieces):
    monkeypatch.setattr(tokens, "CACHED", 10)
    counts = tokens.Counts(tokens.MODEL, {"▁the": 1})
    text = " ".join(f"word{i}" for i in range(100))
    assert counts.text(text) == len(pieces.encode(text)) and len(counts.cache) <= 10


def brute_profile(texts):
    seen = Counter()
    for text in texts:
        spaced = re.sub(r"[^a-z]+", " ", f" {text} ".lower())
        for n in (1, 2, 3):
            seen.update(g for g in (spaced[i : i + n] for i in range(len(spaced) - n + 1)) if g != " ")
    return seen


def key(gram):
    out = 0
    for c in gram:
        out = out << language.BITS | (language.BLANK if c == " " else ord(c))
    return out


def test_grams_equal_brute_force(words):
    draw = random.Random(4)
    for _ in range(50):
        text = " ".join(draw.choices(words + ["12", "--", "Ab.c"], k=draw.randint(1, 60)))
        codes = language.letters(text)
        if not len(codes):
            continue
        keys, counts = language.grams(codes)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {key(g): n for g, n in brute_profile([text]).items()}


def test_languages_are_told_apart(spark, odd, empty):
    draw = random.Random(6)
    kinds = {"aa": ["the", "and", "with", "from", "this"], "bb": ["der", "und", "nicht", "eine", "auch"], "cc": ["los", "que", "para", "como", "pero"]}
    rows = [(i, " ".join(draw.choices(kinds[k], k=20)), k, None, 0) for i in range(90) for k in [draw.choice(sorted(kinds))]]
    profile = language.profiles(spark.createDataFrame(rows, DOCS))
    assert profile.groupBy("lang").count().count() == 3 and profile.where("place > 300").count() == 0
    docs = spark.createDataFrame([(i, " ".join(draw.choices(kinds[k], k=9)), k, None, 0) for i, k in enumerate(sorted(kinds) * 5)], DOCS)
    got = {r.doc_id: r for r in language.predict(docs, profile).collect()}
    assert all(got[r.doc_id].lang_pred == r.lang and 0 <= got[r.doc_id].score <= 1 for r in docs.collect())
    nothing = spark.createDataFrame([(1, None, "aa", None, 0), (2, "12 -- 3", "aa", None, 0), (3, "", None, None, 0)], DOCS)
    assert {(r.lang_pred, r.score) for r in language.predict(nothing, profile).collect()} == {("und", 0.0)}
    assert {r.lang_pred for r in language.predict(odd, language.profiles(empty)).collect()} == {"und"}
    assert language.predict(empty, profile).count() == 0 and language.predict(odd, profile).count() == odd.count()


def test_distance_equals_definition():
    ranks = language.Ranks([("x", key("a"), 1), ("x", key("b"), 2), ("y", key("b"), 1)])
    # "a" has the n-grams a, " a", "a " and " a "; x has the first in the same place
    assert ranks.predict("a") == ("x", pytest.approx(1 - 3 * language.PROFILE / (4 * language.PROFILE)))
    assert ranks.predict("q")[1] == 0.0
