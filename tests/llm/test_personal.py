"""Personal data: patterns against Python's own regular expressions, the network against direct formulas, the model on unseen examples."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

import __spark_entry__ as driver
from nightgrid.llm import personal

# The kinds as the contract writes them.
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def passes(kind, said):
    digits = re.sub("[^0-9]", "", said)
    if kind == 1:
        return all(int(p) <= 255 for p in said.split("."))
    if kind == 2:
        total = sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if passes(k, m[0]))


def test_patterns_equal_plain_regular_expressions(spark, data_dir):
    rng = random.Random(2)
    parts = ["a", "b.c", "@", ".", "-", "_x", "1", "22", "255", "256", "+", " ", "(", ")", "é", "%", "4467920212765298", "5731 0803 8732 5255", "@d.e", "12.13.14.15", "000255", "+1 (743) 555-3824", "²", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert personal.base_spans(text) == brute(text), text
    for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect():
        assert personal.base_spans(r.text or "") == brute(r.text or "")


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 200_000, "+1" + "(" * 300_000, "@" * 100_000, "a@" * 100_000, "x@" + "y" * 300_000, "1 " * 150_000])
def test_very_long_texts_take_time_by_length(text):
    personal.base_spans(text)
    assert personal.regions(text, []) is not None


def small(seed=1):
    model = personal.Tagger(seed, char=3, state=2)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    return model


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = small()
    codes = rng.integers(0, 6, (3, 5)).astype(np.uint8)
    tags = np.array([personal.tags_of(s, 5) for s in ([(1, 0, 3)], [], [(0, 2, 2), (3, 1, 5)])])
    _, grads = model.loss(codes, tags)
    for name, grad in grads.items():
        for at in rng.permutation(model.p[name].size)[:12]:
            cell, kept = np.unravel_index(at, model.p[name].shape), None
            kept = model.p[name][cell]
            ends = []
            for step in (1e-2, -1e-2):
                model.p[name][cell] = kept + step
                ends.append(model.loss(codes, tags)[0])
            model.p[name][cell] = kept
            assert grad[cell] == pytest.approx((ends[0] - ends[1]) / 2e-2, abs=3e-4), (name, cell)


def test_best_tags_and_loss_equal_all_paths():
    model = small(4)
    model.p["move"] = np.random.default_rng(3).normal(size=model.p["move"].shape)
    codes = np.array([[1, 2, 3]], np.uint8)
    scores, move = model.emissions(codes)[:, 0], model.p["move"] + personal._barred()
    paths = {p: sum(scores[t, g] + move[p[t - 1] if t else personal.TAGS, g] for t, g in enumerate(p)) for p in itertools.product(range(personal.TAGS), repeat=3)}
    best = max(paths, key=paths.get)
    assert tuple(model.best(codes)[0][0]) == best
    values = np.array(list(paths.values()))
    assert model.loss(codes, np.array([best]))[0] == pytest.approx(np.log(np.exp(values).sum()) - paths[best], abs=1e-4)


def test_reconciled_spans_are_the_heaviest():
    rng = random.Random(6)
    for _ in range(300):
        spans = [(s, rng.randrange(4), s + rng.randrange(1, 6), rng.choice([0.5, 1.0, 2.0])) for s in (rng.randrange(14) for _ in range(rng.randrange(8)))]
        base = [(s, 0, s + 2) for s in (rng.randrange(16) for _ in range(rng.randrange(3)))]
        got = personal.reconcile(spans, base)
        clear = lambda a, b: a[2] <= b[0] or b[2] <= a[0]
        weight = lambda xs: sum(x[3] * (x[2] - x[0]) for x in xs)
        assert all(clear(a, b) for a, b in itertools.combinations(got, 2)) and all(clear(a, b) for a in got for b in base)
        free = [x for x in spans if all(clear(x, b) for b in base)]
        assert weight(got) == max(weight(c) for n in range(len(free) + 1) for c in itertools.combinations(free, n) if all(clear(a, b) for a, b in itertools.combinations(c, 2)))


@pytest.fixture(scope="module")
def model(spark, data_dir):
    return personal.learn(spark.read.parquet(f"{data_dir}/documents.parquet"))


def test_held_out_spans_are_found(model):
    held = list(personal.examples(["Nobody had seen these sentences before, and they say little. One more of them, just as idle."], 800, 77))
    found = personal.find([t for t, _ in held], model)
    hit = sum(any(k == x[1] and s < x[2] and x[0] < e for s, k, e, *_ in f) for (_, spans), f in zip(held, found) for x in spans)
    wrong = sum(not any(s < x[2] and x[0] < e for x in spans) for (_, spans), f in zip(held, found) for s, k, e, base, _ in f if not base)
    assert hit >= 0.85 * sum(len(s) for _, s in held)
    assert wrong <= 8


def test_added_spans_whole_texts_and_windows(model):
    filler = "Words that say nothing stand here in a row. " * 40
    texts = [filler + f"{lead}{said}{tail}" + filler for lead, said, tail in [
        ("call ", "(743) 555-3824", " now"), ("mail ", "jane.roe (at) mail.example (dot) com", " today"), ("host ", "152[.]143[.]123[.]131", ", then"), ("pay ", "5731-0803-8732-5255", ".")]]
    texts.append("".join(texts))
    assert [[(k, t[s:e]) for s, k, e, base, _ in f if not base] for t, f in zip(texts[:4], personal.find(texts[:4], model))][0] == [(3, "(743) 555-3824")]
    spans = [[x[:4] for x in f] for f in personal.find(texts, model)]
    # Each of the four is found at its place in the joined text too.
    offset = 0
    for text, found in zip(texts[:4], spans[:4]):
        assert {(s + offset, k, e + offset, b) for s, k, e, b in found} <= set(spans[4])
        offset += len(text)


def test_clean_and_awkward_texts(spark, model):
    texts = [None, "", " ", "no data at all", "2015-2018", 'token = "11acdfb36bb72224148e6160f674b4be45601bff"', "1.2.3", "a" * 200_000, "12 " * 50_000, "é@ü", "😀 x@y.zz".encode("utf-16", "surrogatepass").decode("utf-16")]
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(None, "a@b.cc", None, None), (3, "no data at all", "x", 7), (3, "no data at all", "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, personal string, spans long").repartition(3)
    got = personal.report(personal.detect(df, model)).collect()
    assert len(got) == len(rows)
    none = hashlib.sha256(b"").hexdigest()
    by = {r.doc_id: r for r in got}
    for i in range(9):
        assert (by[i].n_email, by[i].n_ip, by[i].n_card, by[i].n_phone, by[i].base_sha256, by[i].spans) == (0, 0, 0, 0, none, "")
    assert by[10].spans == "email:2:8" and by[None].spans == "email:0:6"
    assert personal.detect(df.limit(0), model).count() == 0
    assert personal.fit([], rendered=40, passes=1) is not None


def test_query_equals_brute_force(spark, data_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    got = driver.queries()["op13_personal_data"](spark, data_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        base = brute(docs[r.doc_id])
        written = [f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(","))


def test_model_does_not_depend_on_row_order(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    pieces = []
    original = personal.fit
    try:
        personal.fit = lambda texts, **_: pieces.append(texts)
        for shuffled in (docs, docs.repartition(7).orderBy("text")):
            personal.learn(shuffled, rows=60)
    finally:
        personal.fit = original
    assert pieces[0] == pieces[1] and 30 <= len(pieces[0]) <= 60
