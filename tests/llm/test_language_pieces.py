"""Language prediction reads each distinct piece of many texts once, and sums what reading them whole sums."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nightgrid.llm import languages

ODD = [None, "", " ", "\n", "a", "\na", "a\n", "A1b2\t c", "ΑΣ ΣΑΣ. ΌΣΟΣ", "ΑΣ ΣΑ Σ", "İstanbul I", "日本語の文章です。誰も　読みません。", "x" * 3000, " a  b ",
       "ß ﬁ ǅ", "1 2 3", "a\x1cb c\x85d e​f­g", "it's well-known", "'ΑΣ' (ΑΣ.) 'Σα Σ:α", "(A.B), \"C\"!"]


def model(seed: int = 1) -> languages.LanguageModel:
    rng = np.random.default_rng(seed)
    return languages.LanguageModel(["a", "b", "c"], rng.standard_normal((languages.BUCKETS, 3)).astype(np.float32), rng.standard_normal(3), 1.5, 2.0)


def plain_sums(m: languages.LanguageModel, text: str | None) -> np.ndarray:
    """Word by word, subword by subword."""
    total = np.zeros(5)
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        edged = f" {word} "
        for order in range(1, 5):
            for at in range(len(edged) - order + 1):
                if (part := edged[at:at + order]) != " ":
                    rolling = 0
                    for c in part:
                        rolling = (rolling * 1_000_003 + ord(c)) % 2**64
                    bucket = (rolling ^ order) * 0x9E3779B97F4A7C15 % 2**64 >> 48
                    total += [*m.table[bucket].astype(float), 1]
    return total


def test_sums_are_those_of_a_plain_reading():
    m, rng = model(), random.Random(2)
    texts = ODD + ["".join(rng.choices("abΣσİé \n\t.1日  　'́-", k=rng.randint(0, 30))) for _ in range(300)]
    want = [plain_sums(m, t) for t in texts]
    assert np.allclose(m.text_sums(pa.array(texts, pa.string())), want, rtol=0, atol=1e-9)
    assert np.allclose(m.text_sums(pa.array([None, *texts, "z"], pa.large_string()).slice(1, len(texts))), want, rtol=0, atol=1e-9)
    for t, sums in zip(texts, want):
        assert np.allclose(m.line_sums(t or "", block=3).sum(axis=0), sums, rtol=0, atol=1e-9)
    assert m.text_sums(pa.array([], pa.string())).shape == (0, 5)


def test_a_piece_is_read_once_for_all_texts(monkeypatch):
    read, plain = [], languages.LanguageModel.line_sums
    monkeypatch.setattr(languages.LanguageModel, "line_sums", lambda self, text, *block: read.extend(text.split("\n")) or plain(self, text, *block))
    m, texts = model(), ["the quick fox", "The fox, (the) FOX!", None, "quick  quick."] * 500
    monkeypatch.setattr(languages, "PIECES", 2)
    m.judge(m.text_sums(pa.array(texts)))
    assert sorted(w for w in read if w) == ["fox", "quick", "the"]


def test_arrow_batches_are_read_together(spark):
    assert [len(a) for a in languages.joined(iter([pa.array(["x" * 40])] * 7), 100)] == [3, 3, 1]
    assert [a.to_pylist() for a in languages.joined(iter([pa.array(["a"]), pa.array([], pa.string()), pa.array([None, "b"])]), 1 << 20)] == [["a", None, "b"]]
    m = model()
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.expr("CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN '12' ELSE concat('word ', id, ' tail') END").alias("text")).repartition(2)
    got = languages.identify(docs, m).collect()
    assert len(got) == 700
    for r in got:
        assert tuple(r.language) == m.predict(r.text)


TEXTS, LABELS = ["aba aba cab", "xyz zyx xyz xyz", "", "aab bba", "zzz yx", "12"] * 6, ["a", "x", "a", "a", "x", "x"] * 6


def test_distinct_subwords_are_found_once_and_not_in_every_epoch(monkeypatch):
    calls, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **b: calls.append(1) or unique(*a, **b))
    counts = []
    for epochs in (1, 9):
        model = languages.LanguageModel.fit(TEXTS, LABELS, epochs=epochs, least_steps=1)
        counts.append(len(calls) - sum(counts))
    assert counts[0] == counts[1]
    assert model.predict("aba")[0] == "a" and model.predict("xyz")[0] == "x" and model.predict("12")[0] == "und"


def test_the_fit_is_that_of_the_formula():
    """Three steps, each over all examples, subword by subword."""
    model, rng = languages.LanguageModel.fit(TEXTS, LABELS, epochs=3, least_steps=1), np.random.default_rng(7)
    grams = [[int(b) for buckets, good in languages.subwords(languages.code_points(t)[0]) for b in buckets[good]] for t in TEXTS]
    order = rng.permutation([i for i, g in enumerate(grams) if g])
    train = order[len(order) // 5:]
    embed, weight, bias = rng.standard_normal((languages.BUCKETS, languages.WIDTH)) / languages.WIDTH, np.zeros((languages.WIDTH, 2)), np.zeros(2)
    for step in range(3):
        rng.shuffle(train)
        pace = 1.6 * (1 - step / 3)
        mean = np.array([embed[grams[i]].mean(axis=0) for i in train])
        p = np.exp(mean @ weight + bias)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(train)), [int(LABELS[i] == "x") for i in train]] -= 1
        for i, back in zip(train, p @ weight.T):
            for b in grams[i]:
                embed[b] -= pace * back / len(grams[i])
        weight, bias = weight - pace * mean.T @ p / len(train), bias - pace * p.mean(axis=0) * 0.1
    assert len(train) <= 32 and np.abs(weight).max() > 0.01
    assert np.allclose(model.table[:, :2], embed @ weight, atol=1e-5) and np.allclose(model.bias, bias, atol=1e-6)
