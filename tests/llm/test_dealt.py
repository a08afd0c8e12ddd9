"""The training-data operators against brute force, on the given tables and on awkward rows."""

import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from test_nearcopies import kept_by_brute_force
from nightgrid.llm import chat, common, counts, decontaminate, languages, packing, pages, sharding, simhash, tokenfiles, topk

ODD = [None, "", " \t\n", "word", "Word word WORD", "12 34 !?", "é É ñandú «x»", "日本語 text", "a" * 5000, "one two three " * 3000, "<|endoftext|> x", "it's 'tis don't"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "s", 0, "x") for i, t in enumerate(ODD)]
    rows += [(3, "word", "en", "s", 0, "y"), (None, "word", "en", "s", 0, "z"), (None, None, None, None, None, None), (-7, "below zero", "de", "s", 0, "x")]
    # Extra columns with names that operators use themselves.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, length long, fp string").repartition(3)


@pytest.fixture(scope="module")
def given(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


def encoded(text):
    from tokenizers import Tokenizer

    held = encoded.__dict__.setdefault("tok", Tokenizer.from_file(common.tokenizer_path()))
    return held.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# -- tokens, packing, files


def test_encoder_gives_the_librarys_ids(given):
    texts = [t or "" for t in ODD] + [r.text or "" for r in given.limit(60).collect()] + [
        "x\x1cy z w v", "İstanbul Σίσυφος ΟΔΟΣ", "é café, ok.", "a.b c,, d?! e:;", "<|startoftext|>a", "ß ſ ŀ ŉ", "﻿x ​q"]
    small = common.TextEncoder(common.TOKENIZER, chunk_limit=40, core_limit=20)
    assert small.wordwise
    for _ in range(2):
        assert [np.frombuffer(b, "<u2").tolist() + [1] for b in small.encode([t.encode() for t in texts])] == [encoded(t) for t in texts]


def check_packing(rows, source, capacity):
    """Every token of every document once, in order, gapless sequences."""
    left = {}
    for doc_id, text in source:
        left.setdefault(doc_id, []).append(encoded(text))
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.piece), []).append(r)
    for doc_id, texts in left.items():
        want = sorted((p, s, len(ids[s:s + capacity]), crc(ids[s:s + capacity])) for ids in texts for p, s in enumerate(range(0, len(ids), capacity)))
        assert want == sorted((r.piece, r.start, r.length, r.ids_crc32) for (d, _), rs in pieces.items() if d == doc_id for r in rs)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(spark, docs, capacity):
    rows = packing.pack_documents(docs, capacity, rows_per_task=6).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], capacity)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packing_is_tight(spark, given):
    rows = driver.queries()["op8_best_fit_packing"](spark, os.path.dirname(given.inputFiles()[0].removeprefix("file://"))).collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in given.collect()], 4096)
    assert used <= math.ceil(sum(r.length for r in rows) / 4096) + 1


def test_fullest_sequence_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.place(8) == (2, 0)  # none has room: the one holding 7 closes
    assert bins.place(3) == (0, 6) and bins.place(2) == (2, 8)


def test_elias_fano():
    rng = random.Random(4)
    for n in (0, 1, 2, 511, 512, 513, 3000):
        for top in (0, 1, 1000, 1 << 40, (1 << 63) + 5):
            values = sorted(rng.randint(0, top) for _ in range(n))
            found, _ = tokenfiles.EliasFano.read(b"xy" + tokenfiles.EliasFano.build(np.array(values, np.uint64)).to_bytes(), 2)
            assert [int(v) for b in found.blocks() for v in b] == values
            for i in rng.sample(range(n), min(n, 20)):
                assert found.select(i) == values[i]


def test_token_files(spark, docs):
    manifest = tokenfiles.write_token_files(docs, ids_per_file=900)
    got = tokenfiles.read_token_files(manifest).collect()
    order = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    want, at = [], 0
    for doc_id, text in order:
        ids = encoded(text)
        want.append((doc_id, at, len(ids), crc(ids), ids))
        at += len(ids)
    same([tuple(r) for r in got], want)
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(docs.limit(0))).count() == 0
    path = manifest.first()["path"]
    store, at = common.open_store(path)
    one = tokenfiles.TokenFile(store.open_input_file(at).read())
    assert one.document(0).tolist() == next(one.documents())[2].tolist()


# -- shards


def check_shards(rows, n):
    total, slots = {}, {}
    for r in rows:
        assert r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) and r["size"] == len((r["text"] or "").encode()) + 16
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < n for s in total)
    largest, mean = max(r["size"] for r in rows), sum(total.values()) / n
    assert all(abs(total.get(s, 0) - mean) <= 2 * largest for s in range(n))


def test_byte_shards(spark, docs, given):
    rows = sharding.shard_documents(given, 40).collect()
    check_shards(rows, 40)
    groups = {}
    for r in rows:
        groups.setdefault(r["text"], set()).add(r["shard"])
    largest = max(r["size"] for r in rows)
    size = {}
    for r in rows:
        size[r["text"]] = size.get(r["text"], 0) + r["size"]
    assert all(len(s) == 1 for t, s in groups.items() if size[t] <= largest)
    odd = sharding.shard_documents(docs.drop("length", "fp"), 3).collect()
    check_shards(odd, 3)
    assert len(odd) == docs.count() and sharding.shard_documents(docs.limit(0), 3).count() == 0


def test_hot_group_is_cut(spark):
    hot = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 > 0 THEN 'same text' ELSE concat('t', id) END AS text")
    check_shards(sharding.shard_documents(hot, 40).collect(), 40)


# -- near-copies


def fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, ids, radius=3):
    """Smallest id reachable, by all pairs."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return [best.get(find(i)) for i in range(len(values))]


def test_near_copies(spark, docs, given):
    for table in (docs, given.select("doc_id", "text").unionByName(given.selectExpr("doc_id + 100000 AS doc_id", "concat(text, ' end') AS text"))):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        prints = [fingerprint(t) for _, t in rows]
        want = [(d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, roots(prints, [d for d, _ in rows]))]
        same([(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_copies(table).collect()], want)
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_cover_finds_every_pair():
    rng = random.Random(9)
    masks = simhash.cover_masks()
    assert len(masks) == 15
    for _ in range(3000):
        bits = rng.sample(range(64), rng.randint(0, 3))
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_links_in_blocks(spark):
    rng = random.Random(2)
    values = {0, -1}
    for center in [rng.getrandbits(64) for _ in range(6)]:
        for _ in range(60):
            x = center
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            values.add(simhash.signed(x))
    values = sorted(values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    want = roots([v & (1 << 64) - 1 for v in values], values)
    for block in (2048, 7):
        found = {r.node: r.component for r in simhash.components(simhash.close_links(fps, block=block)).collect()}
        assert [found.get(v, v) for v in values] == want


def test_keep_one(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = roots([fingerprint(t) for _, t in rows], [d for d, _ in rows])
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want)) and kept[0].__fields__ == docs.columns


# -- benchmark passages


def best_occurrence(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_distance():
    rng = random.Random(3)
    for _ in range(500):
        p = "".join(rng.choices("ab ", k=rng.randint(1, 70)))
        t = "".join(rng.choices("ab ", k=rng.randint(0, 90)))
        assert decontaminate.myers(p, t)[0] == best_occurrence(p, t)


def test_leaks(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "tiny"), (0, "repeated id with another text of some length")]
    texts = []
    for n in range(60):
        body = [word() for _ in range(40)]
        item = rng.choice(items)[1] or "x"
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(item))
            item = item[:at] + rng.choice(["", "q", item[at] + "q"]) + item[at + 1:]
            item = item or "x"
        body.insert(20, item.upper() if n % 2 else item.replace(" ", " \n "))
        texts.append((n, " ".join(body)))
    texts += [(100, None), (101, ""), (None, items[0][1]), (1, texts[1][1]), (102, "x tinyx"), (103, "Tiny")]
    want = []
    for d, t in texts:
        for i, item in items:
            p, q = decontaminate.plain_text(item or ""), decontaminate.plain_text(t or "")
            k = decontaminate.budget(len(p))
            if p and (f" {p} " in f" {q} " if k == 0 else best_occurrence(p, q) <= k):
                want.append((d, i, 0 if k == 0 else best_occurrence(p, q)))
    docs = spark.createDataFrame([(d, t, "z") for d, t in texts], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for group in (4_000_000, 200):
        rows = decontaminate.leaks(docs, bench, group_chars=group).collect()
        same([(r.doc_id, r.item_id, r.distance) for r in rows], want)
    by = dict(texts)
    for r in rows:
        if r.doc_id is not None:
            part = decontaminate.plain_text(by[r.doc_id])[r.start:r.end]
            assert any(best_occurrence(decontaminate.plain_text(t or ""), part) == r.distance for i, t in items if i == r.item_id)
    kept = decontaminate.clean(docs, bench).collect()
    leaked = {d for d, _, _ in want}
    same([r.doc_id for r in kept], [d for d, _ in texts if d not in leaked])
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


# -- languages


def test_languages(spark, given, docs):
    model = languages.learn(given)
    rows = languages.identify(given, model).selectExpr("doc_id", "lang", "language.*").collect()
    held = [r for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert sum(r.accepted for r in held) >= 0.98 * len(held)
    odd = languages.identify(docs, model).collect()
    assert len(odd) == docs.count()
    for r in odd:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.language.lang_pred in model.langs) if lettered else tuple(r.language) == ("und", 0.0, False)
        assert 0 <= r.language.score <= 1
    none = languages.learn(docs.limit(0))
    assert languages.identify(docs, none).where("language.lang_pred <> 'und' OR language.accepted").count() == 0


def test_long_texts_go_block_by_block(given):
    texts = [r.text for r in given.where("text is not null").limit(40).collect()]
    model = languages.LanguageModel.fit(texts, ["a" if i % 2 else "b" for i in range(len(texts))], epochs=1)
    for t in texts[:10]:
        assert np.allclose(np.append(*model.measure(t)), np.append(*model.measure(t, block=50)))


def test_unknown_languages_are_rejected(given):
    rows = given.where("text is not null and lang is not null").collect()
    model = languages.LanguageModel.fit([r.text[:800] for r in rows], [r.lang for r in rows])
    for text in ("Это русский текст о жизни и смерти, который никто не читал.", "これは日本語の文章です。誰も読みません。", "Ελληνικό κείμενο που δεν διάβασε κανείς ποτέ"):
        assert not model.predict(text)[2]
    half = [r.text[:400] for r in rows[:2]]
    assert model.predict(" ".join(half))[2]


# -- pages


PAGES = [
    (1, "http://h.example/a", "<html><body><nav>m</nav><div class='ad'>buy</div><article><h1>T &amp; U</h1><p><b>one<br>two</b>\n three<p>four</p>"
     "<aside>x</aside><section class='comments'><article>no</article></section><form>f</form></article><footer>&copy; me</footer>", "T & U\none two three\nfour"),
    (2, "http://h.example/b", "<main><p>only main</p><div id='cookie-notice'>c</div></main><p>outside</p>", "only main"),
    (3, "http://H.example/c", "<div>shared line of at least nine tokens in this host here</div><p>first own</p><p>menu</p>", "first own"),
    (4, "https://h.example:8/d", "<div>shared line of at least nine tokens in this host here</div><p>second own</p><p>menu</p>", "second own"),
    (5, "http://other.example/", "<div>shared line of at least nine tokens in this host here</div>", "shared line of at least nine tokens in this host here"),
    (6, None, None, ""), (7, "x", "", ""), (None, "http://o.example", "<script>a<b</script>a < b &lt;i&gt; <!-- c --> d", "a < b <i> d"), (8, "http://q.example", "<p title='a>b'>ok</p>", "ok"),
    (8, "http://q.example", "<p title='a>b'>ok</p>", "ok")]


def test_pages(spark, data_dir):
    rows = spark.createDataFrame([(*p[:3], "e") for p in PAGES], "page_id long, url string, html string, text string").repartition(3)
    same([tuple(r) for r in pages.main_text(rows).collect()], [(p[0], p[1], p[3], len(p[3])) for p in PAGES])
    assert pages.main_text(rows.limit(0)).count() == 0
    import html
    import re

    given = spark.read.parquet(f"{data_dir}/pages.parquet")
    got = {r.page_id: r.text for r in driver.queries()["op9_host_text"](spark, data_dir).collect()}
    for r in given.collect():
        article = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", article[1]) if article else []
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
        assert got[r.page_id] == "\n".join(x for x in lines if x)


# -- search


def brute_top(vectors, step, k):
    coded = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {(i, tuple(v)) for i, v in coded if i % step == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in coded if j != q and len(w) == len(v))[:k]
        want += [(q, n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    return want


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.12))) for _ in range(16)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)] + [(400, [float("nan")] * 16), (450, None), (None, rows[0][1]), (500, [None] + [0.5] * 15), (50, rows[50][1]), (550, [0.5, 0.25]), (551, [1.0, 1.0]), (552, []), (600, [])]
    table = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<float>, codes string, score int").repartition(3)
    want = brute_top(rows, 50, 5)
    same([tuple(r) for r in topk.search_every(table).collect()], want)
    coded = table.select("vec_id", topk.scaled(table["embedding"]).alias("codes"))
    same([tuple(r) for r in topk.top_k(coded.where("vec_id % 50 = 0"), coded, 5, block_rows=40, block_queries=3).collect()], want)
    assert topk.search_every(table.limit(0)).count() == 0


# -- conversations


def test_chat(spark):
    hostile = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>", "<\\|done|> <\\\\s>", "<", "|turn|>", "[\\INST]", "\\", " lead", "trail \n", "é日🤷", "", None, "x<|done|>", "<|endoftext|>"]
    rows = [(1, i, role, t) for i, t in enumerate(hostile) for role in (["assistant", "user", None, "<s>"][i % 4],)] + [(2, None, "assistant", "a"), (2, None, "assistant", "a"), (2, 0, "assistant", None), (None, 0, "user", "lost"), (3, 0, "assistant", "b" * 5000)]
    rows += [(10 + i, 0, "assistant", t) for i, t in enumerate(hostile)] + [(-1, 0, "assistant", " ".join(hostile[:9]))]
    table = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, turns string").repartition(3)
    want = {}
    for c, n, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            want.setdefault(c, []).append((role or "", text or ""))
    formatted = chat.format_conversations(table)
    template = chat.ChatTemplate()
    for r in formatted.collect():
        assert template.parse(r.formatted) == want[r.conv_id]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = chat.digests(formatted).collect()
    assert len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), digest(learned))
    assert chat.digests(chat.format_conversations(table.limit(0))).count() == 0


# -- token counts


def test_counts_match_the_library(spark, docs, given):
    from tokenizers import Tokenizer, models, pre_tokenizers

    split = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)])
    vocabulary = counts.unigram_vocabulary()
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = split
    table = docs.select("doc_id", "text").unionByName(given.select("doc_id", "text"))
    want = [(r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in table.collect()]
    same([tuple(r) for r in counts.token_counts(table).collect()], want)
    # Whole scores make ties; a run of unknown characters is one piece.
    small = [("<unk>", 0.0)] + [(p, float(-len(p))) for p in ("a", "b", "ab", "ba", "abb", "▁", "▁a", "▁ab", "bb")]
    library = Tokenizer(models.Unigram(small, unk_id=0, byte_fallback=False))
    library.pre_tokenizer = split
    mine, rng = counts.UnigramCounter(small), random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choices("abc▁ ", k=rng.randint(1, 14)))
        assert mine.count(text) == len(library.encode(text).ids)


def test_labelled_rows_that_share_an_id(spark, given):
    """Rows under one id are sampled one by one, and their order does not matter."""
    rows = [(7, f"{t} {i}", lang) for i, (t, lang) in enumerate([(r.text, r.lang) for r in given.where("text is not null and lang is not null").limit(120).collect()] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.withColumn("doc_id", F.lit(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2)).cast("long"))
    samples, fit = [], languages.LanguageModel.fit
    try:
        languages.LanguageModel.fit = classmethod(lambda cls, texts, langs: samples.append((texts, langs)))
        for shuffled in (docs, docs.repartition(5).orderBy("text")):
            languages.learn(shuffled, rows=60)
    finally:
        languages.LanguageModel.fit = fit
    assert samples[0] == samples[1] and 30 <= len(samples[0][0]) <= 60 and len(set(samples[0][1])) > 1


# -- queries with SQL, and the pipeline


@pytest.mark.parametrize("name", ["op1_impact_top_k", "op2_chat_masks"])
def test_sql(spark, data_dir, name):
    con = duckdb.connect()
    for file in os.listdir(data_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data_dir}/{file}'")
    cursor = con.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    got = driver.queries()[name](spark, data_dir)
    assert sorted(got.columns) == sorted(columns)
    same([tuple(r) for r in got.select(*columns).collect()], cursor.fetchall())


def test_pipeline(spark, data_dir, given):
    stages = dict(corpus_pipeline.STAGES)
    documents = [(r.doc_id, r.text) for r in given.collect()]
    model = languages.learn(given)
    known = [(d, t) for d, t in documents if model.predict(t)[2]]
    # The stage takes five-word shingles and a similarity of 0.8, unlike the fingerprints of op5.
    kept = set(kept_by_brute_force(sorted(known)))
    single = [(d, t) for d, t in known if d in kept]
    items = [decontaminate.plain_text(r.text) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    for name, want in (("language_id", known), ("simhash_near_dedup", single)):
        given = stages[name](spark, given, data_dir)
        same([r.doc_id for r in given.collect()], [d for d, _ in want])
    left = stages["benchmark_decontamination"](spark, given, data_dir)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {r.doc_id for r in left.collect()}
    leaked = {d for d, t in single if any(p in decontaminate.plain_text(t) for p in items)}
    assert leaked and ids == {d for d, _ in single} - leaked
    packed = corpus_pipeline.run(spark, data_dir).collect()
    check_packing(packed, [(d, t) for d, t in single if d in ids], 4096)
    assert list(corpus_pipeline.STAGES[-1]) == ["best_fit_packing", corpus_pipeline.pack_sequences]
