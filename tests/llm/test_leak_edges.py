"""Benchmark items at both ends of a text against a full edit matrix."""

import random

from nightgrid.llm import decontaminate


def least_edits(item, text):
    """Smallest edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_edges_equal_a_full_matrix():
    rng = random.Random(12)
    for _ in range(2000):
        words = ["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(6, 14))]
        item = " ".join(words)
        k = decontaminate.budget(len(item))
        copy = list(item)
        for _ in range(rng.randint(0, k + 1)):
            at = rng.randrange(len(copy))
            copy[at:at + 1] = rng.choice([[], [rng.choice("abc ")], [copy[at], rng.choice("abc")]])
        copy = "".join(copy)
        cut = rng.randint(0, 2)
        copy = copy[cut:] if rng.random() < 0.5 else copy[:len(copy) - cut]
        other = " ".join("".join(rng.choices("xyz", k=4)) for _ in range(4))
        text = decontaminate.plain_text(rng.choice([f"{copy} {other}", f"{other} {copy}", copy, f"{other} {copy} {other}"]))
        found = decontaminate.PieceIndex([(1, item)]).matches(text)
        want = least_edits(decontaminate.plain_text(item), text)
        if k == 0:
            assert bool(found) == (f" {item} " in f" {text} ")
        else:
            assert [m[3] for m in found] == ([want] if want <= k else []), (item, text, found, want)
            for _, start, end, distance in found:
                assert 0 <= start <= end <= len(text) and least_edits(decontaminate.plain_text(item), text[start:end]) <= distance
