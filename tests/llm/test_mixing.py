import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterloom.llm import mixing
from quarterloom.llm.bpe import token_counts
from quarterloom.llm.mixing import BUCKETS, Words, calibrated_trust, labelled_sample, mix_sources, posterior, posterior_model, word_counts

WORDS = {"red_news": "apple cherry rose ruby wine".split(), "blue_notes": "sky sea ink navy denim".split(), "tiny": "quartz flint slate marble chalk".split()}


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = rng.choices(list(WORDS), [6, 3, 1])[0]
        label = rng.choice([k, k.upper(), k.replace("_", "-"), f" {k} ", k.replace("_", " ")])
        rows.append((i, " ".join(rng.choice(WORDS[k]) for _ in range(rng.randrange(5, 40))), label))
    return rows


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_reaches_targets_within_caps(spark):
    rows = corpus() + [(1000, "other words", "unlisted"), (1001, None, "tiny"), (1002, "", "tiny"), (1003, "sky sea ink navy", None), (1004, "  ", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mix_sources(df, targets(spark, [("red_news", 0.3, 1), ("blue_notes", 0.5, 4), ("tiny", 0.2, 3)]))
    rep = {r["source"]: r for r in mix.report.collect()}
    docs = {r["doc_id"]: r for r in mix.documents.collect()}
    n = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    assert len(docs) == len(rows) and docs[1000]["copies"] == 0 and docs[1001]["n_tokens"] == 0
    caps = {"red_news": 1, "blue_notes": 4, "tiny": 3}
    for r in docs.values():
        assert r["n_tokens"] == n[r["doc_id"]]
        if r["source"] in caps:
            assert 0 <= r["copies"] <= caps[r["source"]]
    total = sum(r["n_tokens"] for r in rep.values())
    for s, r in rep.items():
        assert not r["short"]
        assert r["mixed_tokens"] == sum(d["copies"] * d["n_tokens"] for d in docs.values() if d["source"] == s)
        assert r["mixed_tokens"] == pytest.approx(r["target_share"] * total, rel=0.1)


def test_short_sources(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    t = [("Red News", 0.3, 1), ("blue_notes", 0.2, 2), ("tiny", 0.4, 2), ("nowhere", 0.1, 5)]
    mix = mix_sources(df, targets(spark, t))
    rep = {r["source"]: r for r in mix.report.collect()}
    total = sum(r["n_tokens"] for r in rep.values())
    for s, share, cap in t:
        assert rep[s]["short"] == (rep[s]["n_tokens"] * cap < share * total)
    assert rep["tiny"]["short"] and rep["nowhere"]["short"] and rep["tiny"]["mixed_tokens"] == 2 * rep["tiny"]["n_tokens"]


def test_empty_corpus(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    mix = mix_sources(df, targets(spark, [("a", 1.0, 2)]))
    assert mix.documents.count() == 0
    assert [(r["n_tokens"], r["reached_share"], r["short"]) for r in mix.report.collect()] == [(0, 0.0, False)]


def fitted(df, names, size=20_000):
    key = F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_").alias("label")
    docs = df.select("doc_id", key, "text").cache()
    sample = labelled_sample(docs, {r["label"]: r["n"] for r in docs.groupBy("label").agg(F.count("*").alias("n")).collect() if r["label"] in names}, size)
    folds = word_counts(sample, names)
    trust = calibrated_trust(sample, names, folds[0])
    return sample, trust, posterior_model(folds.sum(axis=0), trust)


def test_posterior_on_held_out_documents(spark):
    train = spark.createDataFrame(corpus(400, seed=2), "doc_id long, text string, source string")
    names = sorted(WORDS)
    _, trust, model = fitted(train, names)
    assert trust > 0
    test, words = corpus(200, seed=3), Words()
    right = sum(names[posterior(model, words.buckets(t)).argmax()] == s.strip().lower().replace("-", "_").replace(" ", "_") for _, t, s in test)
    assert right / len(test) > 0.98


def test_words_that_tell_nothing_leave_the_shares(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("uvwxyz") * 3 + rng.choice("abcd") for _ in range(30)), rng.choices(["a", "b"], [3, 1])[0]) for i in range(400)]
    _, trust, model = fitted(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["a", "b"])
    p = posterior(model, Words().buckets(rows[0][1]))
    assert trust <= 0.1 and 0.6 < p[0] < 0.9


def test_sample_is_bounded_and_copies_count_once(spark):
    rows = [(i, f"word{'abcdefghij'[i % 10]} " + "x" * (i % 977), "big") for i in range(5000)] + [(9000 + i, "the same text", "big") for i in range(2500)] + [(99_000 + i, f"few {i}x", "small") for i in range(50)]
    sample, _, _ = fitted(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["big", "small"], 400)
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    assert n["small"] == 50 and 100 < n["big"] < 260


def test_posterior_decides_for_documents_without_label(spark):
    """A third of each source has lost its label: memberships follow the words, and the expected tokens meet the targets."""
    rng, rows = random.Random(5), []
    for i, (_, text, label) in enumerate(corpus(600, seed=4)):
        rows.append((i, text, label if rng.random() > 0.33 else rng.choice([None, "", " "]), label.strip().lower().replace("-", "_").replace(" ", "_")))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, truth string")
    mix = mix_sources(df, targets(spark, [("red_news", 0.3, 1), ("blue_notes", 0.45, 3), ("tiny", 0.25, 4)]))
    assert mix.trust > 0
    docs = {r["doc_id"]: r for r in mix.documents.collect()}
    assert len(docs) == len(rows)
    rate = {r["source"]: r["rate"] for r in docs.values() if r["source"]}
    near = [abs(docs[i]["rate"] - rate[truth]) < 0.05 for i, _, s, truth in rows if not (s or "").strip()]
    assert len(near) > 150 and sum(near) / len(near) > 0.95
    rep = {r["source"]: r for r in mix.report.collect()}
    for r in rep.values():
        assert r["expected_tokens"] == pytest.approx(r["target_tokens"], rel=0.01) and not r["short"]
    caps = {"red_news": 1, "blue_notes": 3, "tiny": 4}
    assert all(docs[i]["copies"] <= caps[truth] for i, _, _, truth in rows if docs[i]["source"])


def test_against_a_plain_loop(spark):
    """With labels only, the fit has a closed form: each source's rate is its target over its tokens, within its repeats."""
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    t = [("red_news", 0.35, 1), ("blue_notes", 0.4, 2), ("tiny", 0.25, 2)]
    mix = mix_sources(df, targets(spark, t))
    rep = {r["source"]: r for r in mix.report.collect()}
    total = sum(r["n_tokens"] for r in rep.values())
    rate = {r["source"]: r["rate"] for r in mix.documents.collect()}
    for s, share, cap in t:
        assert rate[s] == pytest.approx(min(cap, share * total / rep[s]["n_tokens"]), rel=1e-6)
        assert rep[s]["expected_tokens"] == pytest.approx(rate[s] * rep[s]["n_tokens"])


def test_all_labelled_documents_enter_the_classifier(spark, monkeypatch):
    """26,000 labelled texts, of which one is copied: each counts once, and the rarest words of the largest source are known."""
    letters = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))
    rows = [(i, f"common w{letters(i)}", "big") for i in range(25_000)] + [(30_000 + i, f"plain w{letters(i)}", "Small") for i in range(1000)]
    rows += [(40_000, "common wa", "big"), (40_001, "of another", "unlisted"), (40_002, None, "Small"), (40_003, "no name", None)]
    seen = []

    def counted(sample, domains):
        seen.append((domains, word_counts(sample, domains)))
        return seen[-1][1]

    monkeypatch.setattr(mixing, "word_counts", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mix_sources(df, targets(spark, [("big", 0.5, 2), ("small", 0.5, 2)])).documents.count() == len(rows)
    [(domains, folds)] = seen
    assert domains == ["big", "small"] and folds[:, :, -1].sum(axis=0).tolist() == [25_000, 1001]
    want = np.zeros((2, BUCKETS))
    for text, k in {(t, 0 if s == "big" else 1) for _, t, s in rows if t and s in ("big", "Small")}:
        for w in set(text.split()):
            want[k, zlib.crc32(w.encode()) % BUCKETS] += 1
    spread = [len({zlib.crc32(w.encode()) % BUCKETS for w in t.split()}) < 2 for _, t, s in rows if t and s in ("big", "Small")]
    assert np.abs(folds[:, :, :-1].sum(axis=0) - want).sum() <= sum(spread)  # two words of a text may share a bucket, which counts once
    assert 0.15 < folds[1, 0, -1] / 25_000 < 0.25


def test_words_that_are_known_are_not_gone_over_again():
    """A text's buckets cost by its own words, not by all words seen before."""

    class Counting(dict):
        def keys(self):
            raise AssertionError("all known words are read")

    words = Words()
    words.known = Counting()
    assert words.buckets("a b a").tolist() == sorted({zlib.crc32(w) % BUCKETS for w in (b"a", b"b")}) and words.buckets("b4 B").tolist() == [zlib.crc32(b"b") % BUCKETS]


def test_fit_goes_on_until_it_stands_still(spark):
    """With nine of ten labels missing and words that hardly tell the sources, many rounds are needed to reach the targets, which can be reached."""
    rng, every = random.Random(7), sum(WORDS.values(), [])
    rows = []
    for i in range(400):
        k = rng.choices(list(WORDS), [6, 3, 1])[0]
        bag = [*WORDS[k], *every]
        rows.append((i, " ".join(rng.choice(bag) for _ in range(rng.randrange(5, 40))), k if rng.random() > 0.9 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mix_sources(df, targets(spark, [("red_news", 0.3, 1), ("blue_notes", 0.45, 3), ("tiny", 0.25, 4)]))
    for r in mix.report.collect():
        assert r["expected_tokens"] == pytest.approx(r["target_tokens"], rel=1e-6)
    docs = mix.documents.collect()
    assert sorted(d["doc_id"] for d in docs) == list(range(400)) and all(0 <= d["rate"] <= 4 for d in docs)
