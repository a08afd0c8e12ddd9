"""Runs that pages of a host share: found by suffix order whatever stretch or task a page lies in, and weighed by the parts they lie in."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

import __spark_entry__ as driver
from nightgrid.llm import pages

LINE = "this line of ten words lies on every page here"
LEAD = "a passage that an article has and others quote in full"


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)


def test_articles_vote_for_shared_passages(spark):
    rows = [(1, "http://h/a", f"<article><p>{LEAD}<p>own</article><p>{LINE}<footer>foot</footer>"),
            (2, "http://h/b", f"<div>{LEAD}</div><div>{LINE}</div><div>second</div><nav>menu</nav>"),
            (3, "http://h/c", f"<div>{LEAD}</div><div>{LINE}</div><div>menu</div><footer>foot</footer>"),
            (4, "http://i/c", f"<div>{LEAD}</div><div>{LINE}</div>")]
    got = {r.page_id: tuple(r)[2:] for r in pages.main_text(table(spark, rows), evidence=True).collect()}
    both = f"{LEAD}\nown", f"{LEAD}\nsecond", f"{LEAD}\nmenu", f"{LEAD}\n{LINE}"
    assert [got[i][0] for i in (1, 2, 3, 4)] == list(both)
    # shared, repeated, boiler_repeated, boiler_single
    assert [got[i][2:] for i in (1, 2, 3, 4)] == [(1, 0, 1, 0), (1, 1, 0, 1), (1, 1, 1, 0), (0, 0, 0, 0)]


def brute(rows, run):
    """(text, shared, repeated, boiler_repeated, boiler_single) of every page, by comparing every window with every other page."""
    known, seen, several = [], {}, defaultdict(set)
    article = set()
    windows = lambda t: [tuple(t[i:i + run]) for i in range(max(1, len(t) - run + 1))]
    for _, url, html in rows:
        boiler = []
        found = pages.blocks(html or "", None, boiler)
        known.append((pages.host_of(url), found, boiler))
        for kind, own in enumerate((found, boiler)):
            content = seen.setdefault((pages.host_of(url), kind, tuple(found), tuple(boiler) if kind else ()), len(seen))
            for part, text in own:
                for w in windows(text.split(" ")):
                    several[pages.host_of(url), kind, w].add(content)
                    if part >= pages.MAIN:
                        article.add((pages.host_of(url), kind, w))
    out = []
    for host, found, boiler in known:
        def whole(kind, text, spare):
            tokens = text.split(" ")
            hit = [False] * len(tokens)
            for i, w in enumerate(windows(tokens)):
                if len(several[host, kind, w]) > 1 and not (spare and (host, kind, w) in article):
                    hit[i:i + run] = [True] * len(hit[i:i + run])
            return all(hit)

        mine = [t for p, t in found if p >= pages.leading_part(found)]
        kept = [t for t in mine if not whole(0, t, True)]
        times = sum(whole(1, t, False) for _, t in boiler)
        out.append(("\n".join(kept), sum(whole(0, t, False) for t in kept), len(mine) - len(kept), times, len(boiler) - times))
    return out


@pytest.mark.parametrize("stretch_tokens, run", [(1, 3), (40, 3), (10**6, 3), (40, 5), (40, 8)])
def test_runs_equal_brute_force(spark, stretch_tokens, run):
    rng = random.Random(run)
    tags = ["div", "div", "p", "nav", "article", "footer"]
    text = lambda: " ".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 4, 9, 12])))
    shared = [text() for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [(rng.choice(tags), " ".join([rng.choice([text, lambda: rng.choice(shared)])() for _ in range(rng.choice([1, 1, 2]))])) for _ in range(rng.randrange(4))]
        rows.append((i, f"http://{rng.choice('xyz')}/{i}" if i % 9 else None, "".join(f"<{t}>{x}</{t}>" for t, x in parts)))
    rows += [(200 + i, *rows[rng.randrange(150)][1:]) for i in range(60)] + [(300, "http://x", None)]
    got = {r.page_id: (r.text, r.shared, r.repeated, r.boiler_repeated, r.boiler_single)
           for r in pages.main_text(table(spark, rows), run, True, stretch_tokens=stretch_tokens, range_bytes=500).collect()}
    assert got == {r[0]: w for r, w in zip(rows, brute(rows, run))}
    assert sum(w[2] for w in got.values()) and sum(w[1] for w in got.values())


def test_given_pages_go_through_the_arrays(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: (r.text, r.shared, r.repeated, r.boiler_repeated, r.boiler_single) for r in driver.queries()["op9_host_text"](spark, data_dir).collect()}
    assert got == {r[0]: w for r, w in zip(rows, brute(rows, pages.RUN_TOKENS))}
    assert sum(w[3] + w[4] for w in got.values())


@pytest.mark.parametrize("run, words", [(1, 3), (3, 3), (8, 2), (8, 70_000), (20, 70_000)])
def test_the_sorted_array_and_its_second_read_agree(run, words):
    rng = random.Random(run)
    # So many words that a key does not hold a whole run, and passages that come again at its start, inside it and at its end.
    word = lambda: f"w{rng.randrange(words)}"
    again = [" ".join(word() for _ in range(n)) for n in (1, 5, 9, 30)]
    block = lambda: " ".join(rng.choice([word, word, lambda: rng.choice(again)])() for _ in range(rng.randrange(1, 200)))
    stretch, seen = pages.Stretch(run), defaultdict(set)
    known, article = {}, set()
    for i in range(600):
        host = rng.choice("xy")
        found, boiler = [(rng.choice([pages.OPEN, pages.ARTICLE]), block()) for _ in range(rng.randrange(3))], [(pages.BOILER, block()) for _ in range(rng.randrange(2))]
        stretch.add(i, f"http://{host}/{i}", found, boiler)
        for kind, own in enumerate((found, boiler)):
            for part, text in own:
                tokens = text.split(" ")
                for at in range(max(1, len(tokens) - run + 1)):
                    prefix = host, kind, tuple(tokens[at:at + run])
                    seen[prefix].add(i)
                    if part >= pages.MAIN:
                        article.add(prefix)
                    known.setdefault(len(known), prefix)
    stretch.close()
    stretch.sort()
    keys, flags, name = stretch.keys, stretch.flags, stretch.name
    stretch.find()
    assert stretch.name == name and (stretch.keys == keys).all() and len(stretch.entry) == len(known)
    assert len(set(stretch.entry.tolist())) == len(seen)
    want = [pages.SEVERAL * (len(seen[p]) > 1) + pages.IN_ARTICLE * (p in article) for p in known.values()]
    assert flags[stretch.entry].tolist() == want
    assert len(set(zip(stretch.entry.tolist(), known.values()))) == len(seen)
