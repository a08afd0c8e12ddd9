"""The pipeline's near-copies against brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline
from nightgrid.llm import nearcopies


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_brute_force(rows):
    sets, left = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while left[x] != x:
            x = left[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                left[max(root(i), root(j))] = min(root(i), root(j))
    return sorted(rows[i][0] for i in range(len(rows)) if root(i) == i)


def edited(words, edits, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


def test_pairs_down_to_the_similarity(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    texts = ["", None, " \n", "one", "One", "one two three four five six seven eight", "one two three four five six seven eight nine"]
    for size in (8, 30, 120, 400):
        for edits in range(0, max(2, size // 25)):
            words = rng.choices(vocabulary, k=size)
            texts += [" ".join(words), edited(words, edits, rng), edited(words, min(size, 2 * edits), rng)]
    texts += [" ".join(passage + rng.choices(vocabulary, k=60)) for _ in range(30)]  # one passage, no copies
    crowd = rng.choices(vocabulary, k=200)
    texts += [edited(crowd, 1 + i % 8, rng) for i in range(40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = kept_by_brute_force(rows)
    for block in (2048, 7):
        assert sorted(r.doc_id for r in nearcopies.keep_one(docs, block=block).collect()) == want
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == want
    assert nearcopies.keep_one(docs.limit(0)).count() == 0


def test_awkward_rows(spark):
    """Null ids, repeated rows and columns with the names of keys; groups without an id keep one row."""
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, long, "p", 1), (1, long, "p", 1), (None, long, "q", 2), (2, long + " end", "r", 3), (None, "only here with no id at all", "s", 4), (None, "only here with no id at all", "s", 4),
            (None, None, "t", 5), (3, "", "u", 6), (4, "nothing like the others in any way", None, None), (5, "nothing like the others in any way.", "v", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, n int").repartition(4)
    kept = nearcopies.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((tuple(r) for r in kept.collect()), key=repr)
    assert got == sorted([rows[0], rows[4], rows[7], rows[8], rows[9]], key=repr)


def test_large_groups_give_few_links(spark):
    """A group of near-copies is joined by about as many links as it has members, in cut blocks too."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(i, edited(base, rng.randrange(3), rng)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs, block=64).collect()) == kept_by_brute_force(rows)


def test_family_below_the_similarity_gives_few_pairs(spark):
    """Texts edited too much to be links, and one line that all texts share: what is verified grows with the texts, not with their square."""
    rng = random.Random(11)
    base, line = [f"w{rng.randrange(5000)}" for _ in range(200)], "a very common line that every one of these many texts holds".split()
    rows = [(i, " ".join([*edited(base, 8, rng).split(), *line])) for i in range(300)]
    rows += [(300 + i, " ".join([*(f"v{rng.randrange(10 ** 6)}" for _ in range(60)), *line])) for i in range(100)]
    rows += [(400 + i, rows[i][1] + " end") for i in range(0, 300, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    verified = nearcopies._verified
    try:
        nearcopies._verified = lambda pairs, *rest: (seen.append(pairs.count()), verified(pairs, *rest))[1]
        kept = sorted(r.doc_id for r in nearcopies.keep_one(docs).collect())
    finally:
        nearcopies._verified = verified
    assert kept == kept_by_brute_force(rows) and len(kept) == 400
    assert sum(seen) < 2 * len(rows), seen


def test_sketches_lose_no_link():
    """The bound from two sketches, of different lengths too, is at most the number of elements in which the sets differ, and close to it."""
    import numpy as np

    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    sets = [pool[a:b] for a, b in ((0, 1), (0, 0), (0, 500), (20, 530), (0, 9000), (500, 9000), (0, 8000), (3000, 12000))]
    sketches = [nearcopies.parity_sketch(s) for s in sets]
    for x, of_x in zip(sets, sketches):
        for y, of_y in zip(sets, sketches):
            apart, least = len(np.setxor1d(x, y)), nearcopies.least_difference(of_x, of_y)
            assert least <= apart
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) > 0:
                assert least >= 0.7 * min(apart, len(x) // 3)
