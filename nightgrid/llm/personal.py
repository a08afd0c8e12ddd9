"""Personal data in texts: fixed patterns, and what a character-level bidirectional LSTM with CRF transitions adds.

The model is trained in NumPy from labelled spans: those that the patterns find in a bounded sample of
texts, and the same kinds written in ways the patterns miss, set into passages of the sample. An added span is at
most half a window long and holds a mark of its kind (a digit, an @, or a spelled-out at or dot), so windows
are laid over the surroundings of all marks that no pattern has claimed. Windows overlap by half: whatever span
there is lies whole in one of them. Each is decoded by itself; what all windows of a text propose is
reconciled at once: the heaviest set of spans that do not overlap each other or a pattern's span.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window; windows step by half of it, which is the longest span the model adds.
WINDOW = 96
#: Bounds of the fit: sampled texts, characters of each, rendered examples, and passes over all of them.
SAMPLE_ROWS, SAMPLE_CHARS, RENDERED, PASSES = 2_000, 400, 2_000, 9
#: Share of wrong spans among those a kind's floor lets through, on held-out examples.
MISTAKES = 0.01
#: Width of a character's vector and of the state of one direction.
CHAR, STATE = 16, 24
#: Windows that go through the network together.
TOGETHER = 512

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Parts that cannot match otherwise do not give back what they took, so that no text costs more than its length.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(int(d) for d in digits[-1::-2]) + sum(doubled)) % 10 == 0


def is_card(digits: str) -> bool:
    return 12 <= len(digits) <= 19 and luhn(digits)


def small_parts(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches, in order; leftmost and without overlap within a kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if small_parts(m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if len(m[0]) <= 40 and is_card(digits_of(m[0]))]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


# -- what an added span must look like

_AT = r"(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s)"
_DOT = r"(?:\s?\.\s?|\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\sdot\s)"
_SPELLED_EMAIL = re.compile(rf"[\w.%+-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,6}}", re.I)
_SPELLED_IP = re.compile(r"([0-9]{1,3})(?:\s?[.,:]\s?|\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\sdot\s)([0-9]{1,3})"
                         r"(?:\s?[.,:]\s?|\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\sdot\s)([0-9]{1,3})"
                         r"(?:\s?[.,:]\s?|\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\sdot\s)([0-9]{1,3})", re.I)
_SPELLED_CARD = re.compile(r"[0-9](?:[ ./_–-]{0,3}[0-9]){11,18}")
_SPELLED_PHONE = re.compile(r"(?:\+\s?|00|\()?[0-9][0-9 ()./–-]*[0-9]")
_YEARS = re.compile(r"(?:[ /-]?(?:19|20)[0-9]{2})+")
_MARKS = re.compile(r"[0-9@]|[(\[{]\s?at\s?[)\]}]|[ (\[{]dot[ )\]}]", re.I)
_NOT_DIGIT_MARK = re.compile(r"@|[(\[{]\s?at\s?[)\]}]|[ (\[{]dot[ )\]}]", re.I)


def plausible(kind: int, text: str, start: int, end: int) -> bool:
    """Whether an added span holds what its kind requires and stands by itself in the text."""
    said = text[start:end]
    before, after = text[start - 1:start], text[end:end + 1]
    if kind == 0:
        return _SPELLED_EMAIL.fullmatch(said) is not None and not before.isalnum() and not after.isalnum()
    if before.isdigit() or after.isdigit():
        return False
    if kind == 1:
        found = _SPELLED_IP.fullmatch(said)
        return found is not None and small_parts(list(found.groups()))
    if kind == 2:
        return _SPELLED_CARD.fullmatch(said) is not None and is_card(digits_of(said))
    apart = said.startswith(("+", "00", "(")) or any(c in " .-/–" for c in said)
    return (_SPELLED_PHONE.fullmatch(said) is not None and apart and 9 <= len(digits_of(said)) <= 15 and said.count("(") == said.count(")") <= 1
            and not before.isalpha() and not after.isalpha() and _SPELLED_IP.fullmatch(said) is None and _YEARS.fullmatch(said) is None)


# -- characters

OTHER_LETTER, OTHER_DIGIT, OTHER_SPACE, OTHER, OUTSIDE = range(128, 133)


def classes(text: str):
    """A small number for each character: ASCII by itself, others by what they are."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.minimum(points, 255).astype(np.uint8)
    for point in np.unique(points[points > 127]).tolist():
        sort = unicodedata.category(chr(point))
        out[points == point] = OTHER_LETTER if sort[0] == "L" else OTHER_DIGIT if sort == "Nd" else OTHER_SPACE if sort[0] == "Z" else OTHER
    return out


# Tags: 0 outside; 1 + 2k begins kind k, 2 + 2k goes on.
TAGS = 1 + 2 * len(KINDS)


def tags_of(spans: list[tuple[int, int, int]], size: int):
    import numpy as np

    out = np.zeros(size, dtype=np.int64)
    for start, kind, end in spans:
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


def spans_of(tags) -> list[tuple[int, int, int]]:
    out, tags = [], tags.tolist()
    for at, tag in enumerate(tags):
        if tag % 2:
            out.append([at, tag // 2, at + 1])
        elif tag and out:
            out[-1][2] = at + 1
    return [tuple(s) for s in out]


def _barred():
    """Penalty of tag successions that cannot be: going on with what has not begun."""
    import numpy as np

    out = np.zeros((TAGS + 1, TAGS), dtype=np.float32)  # the last row is the beginning
    for kind in range(len(KINDS)):
        out[:, 2 + 2 * kind] = -1e4
        out[[1 + 2 * kind, 2 + 2 * kind], 2 + 2 * kind] = 0
    return out


class Tagger:
    """Bidirectional LSTM over characters with CRF transitions."""

    def __init__(self, seed: int = 7, char: int = CHAR, state: int = STATE):
        import numpy as np

        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.state = state
        self.p = {"embed": rng.normal(size=(OUTSIDE + 1, char)).astype(np.float32) * 0.3, "wx": draw(2, char, 4 * state), "wh": draw(2, state, 4 * state),
                  "b": np.zeros((2, 1, 4 * state), np.float32), "wy": draw(2 * state, TAGS), "by": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS + 1, TAGS), np.float32)}
        self.p["b"][:, :, state:2 * state] = 1  # remember at first
        self.floors = [0.0] * len(KINDS)  # gain that a proposed span of each kind has to exceed, by calibration

    def _states(self, codes, keep: bool):
        """Gates (input, forget, output, new), cells and states of both directions, step by step; codes are windows x steps."""
        import numpy as np

        p, n, steps, h = self.p, len(codes), codes.shape[1], self.state
        given = np.stack([p["embed"] @ p["wx"][d] + p["b"][d] for d in (0, 1)])  # a row for each character
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out = np.empty((steps, 2, n, h), np.float32)
        kept = [np.empty((steps, 2, n, 4 * h), np.float32), np.empty((steps, 2, n, h), np.float32)] if keep else None
        for t in range(steps):
            z = state @ p["wh"]
            z[0] += given[0][codes[:, t]]
            z[1] += given[1][codes[:, steps - 1 - t]]
            z[..., :3 * h] *= 0.5
            np.tanh(z, out=z)
            z[..., :3 * h] *= 0.5
            z[..., :3 * h] += 0.5
            cell = z[..., h:2 * h] * cell + z[..., :h] * z[..., 3 * h:]
            state = z[..., 2 * h:3 * h] * np.tanh(cell)
            out[t] = state
            if keep:
                kept[0][t], kept[1][t] = z, cell
        return out, kept

    def emissions(self, codes, keep: bool = False):
        """Scores of the tags: steps x windows x tags."""
        import numpy as np

        states, kept = self._states(codes, keep)
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
        scores = both @ self.p["wy"] + self.p["by"]
        return (scores, states, both, kept) if keep else scores

    def loss(self, codes, tags):
        """Mean negative log-likelihood of the tags, and its gradients."""
        import numpy as np

        p, (n, steps), h = self.p, codes.shape, self.state
        scores, states, both, (gates, cells) = self.emissions(codes, keep=True)
        # Forward and backward sums as probabilities, scaled at each step.
        move = p["move"] + _barred()
        ways, top = np.exp(move), scores.max(axis=2, keepdims=True)
        weight = np.exp(scores - top)
        ahead, behind, scale = np.empty_like(weight), np.empty_like(weight), np.empty((steps, n, 1), weight.dtype)
        for t in range(steps):
            reach = weight[t] * (ahead[t - 1] @ ways[:-1] if t else ways[-1])
            scale[t] = reach.sum(axis=1, keepdims=True)
            ahead[t] = reach / scale[t]
        behind[-1] = 1
        for t in range(steps - 1, 0, -1):
            weight[t] *= behind[t] / scale[t]
            behind[t - 1] = weight[t] @ ways[:-1].T
        d_scores = ahead * behind
        d_move = np.concatenate([ahead[:-1].reshape(-1, TAGS).T @ weight[1:].reshape(-1, TAGS) * ways[:-1], d_scores[:1].sum(axis=1)])
        by_step = tags.T
        prior = np.concatenate([np.full((1, n), TAGS), by_step[:-1]])
        chosen = np.take_along_axis(scores, by_step[:, :, None], 2)[..., 0] + move[prior, by_step]
        loss = float(((np.log(scale) + top)[..., 0] - chosen).sum(axis=0).mean())
        d_move -= np.bincount((prior * TAGS + by_step).reshape(-1), minlength=(TAGS + 1) * TAGS).reshape(TAGS + 1, TAGS)
        np.put_along_axis(d_scores, by_step[:, :, None], np.take_along_axis(d_scores, by_step[:, :, None], 2) - 1, 2)
        d_scores /= n
        g = {"move": d_move / n, "by": d_scores.sum(axis=(0, 1)), "wy": both.reshape(-1, 2 * h).T @ d_scores.reshape(-1, TAGS)}
        d_both = d_scores @ p["wy"].T
        d_states = np.stack([d_both[..., :h], d_both[::-1, :, h:]], axis=1)
        d_z = np.empty_like(gates)
        d_state, d_cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, new = (gates[t][..., k * h:(k + 1) * h] for k in range(4))
            d_h = d_states[t] + d_state
            open_cell = np.tanh(cells[t])
            d_c = d_cell + d_h * o * (1 - open_cell * open_cell)
            before = cells[t - 1] if t else np.zeros_like(cells[0])
            d_z[t] = np.concatenate([d_c * new * i * (1 - i), d_c * before * f * (1 - f), d_h * open_cell * o * (1 - o), d_c * i * (1 - new * new)], axis=-1)
            d_state, d_cell = d_z[t] @ p["wh"].transpose(0, 2, 1), d_c * f
        earlier = np.concatenate([np.zeros_like(states[:1]), states[:-1]])
        g["wh"] = np.stack([earlier[:, d].reshape(-1, h).T @ d_z[:, d].reshape(-1, 4 * h) for d in (0, 1)])
        # Gradients by character: both directions saw the same characters in opposite order.
        seen = [codes.T, codes.T[::-1]]
        by_char = []
        for d in (0, 1):
            flat = seen[d].reshape(-1)
            order = np.argsort(flat, kind="stable")
            chars, first = np.unique(flat[order], return_index=True)
            sums = np.zeros((OUTSIDE + 1, 4 * h), np.float32)
            sums[chars] = np.add.reduceat(d_z[:, d].reshape(-1, 4 * h)[order], first, axis=0)
            by_char.append(sums)
        g["b"] = np.stack([x.sum(axis=0, keepdims=True) for x in by_char])
        g["wx"] = np.stack([p["embed"].T @ x for x in by_char])
        g["embed"] = sum(x @ p["wx"][d].T for d, x in enumerate(by_char))
        return loss, g

    def train(self, given, passes: int = PASSES, batch: int = 64, pace: float = 0.012, seed: int = 11) -> None:
        """Adam with a falling pace over the (codes, tags) that ``given(pass)`` returns; gradients clipped by length."""
        import numpy as np

        rng = np.random.default_rng(seed)
        first, second, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for number in range(passes):
            codes, tags = given(number)
            order = rng.permutation(len(codes))
            for at in range(0, len(order), batch):
                _, g = self.loss(codes[order[at:at + batch]], tags[order[at:at + batch]])
                length = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                step += 1
                rate = pace * (1 - 0.95 * (number + at / len(order)) / passes)
                for k, x in g.items():
                    x = x * min(1.0, 5.0 / (length + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * x
                    second[k] = 0.99 * second[k] + 0.01 * x * x
                    self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)

    def best(self, codes):
        """The best tags of each window, and the gain of each step's tag over being outside."""
        import numpy as np

        scores = self.emissions(codes)
        steps, n, _ = scores.shape
        move = self.p["move"] + _barred()
        reach, came = scores[0] + move[-1], np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            options = reach[:, :, None] + move[:-1]
            came[t] = options.argmax(axis=1)
            reach = scores[t] + options.max(axis=1)
        tags = np.empty((steps, n), np.int64)
        tags[-1] = reach.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = came[t, np.arange(n), tags[t]]
        gain = np.take_along_axis(scores, tags[:, :, None], 2)[..., 0] - scores[..., 0]
        return tags.T, gain.T

    def propose(self, windows: list[str], edges: list[tuple[bool, bool]]):
        """Spans of each window with their mean gain, but those that a window cuts: (start, kind, end, weight)."""
        import numpy as np

        out = []
        for at in range(0, len(windows), TOGETHER):
            part = windows[at:at + TOGETHER]
            codes = np.full((len(part), WINDOW), OUTSIDE, np.uint8)
            for row, text in enumerate(part):
                codes[row, :len(text)] = classes(text)
            tags, gain = self.best(codes)
            for row, text in enumerate(part):
                first, last = edges[at + row]
                found = spans_of(tags[row, :len(text)]) if tags[row].any() else []
                out.append([(s, k, e, float(gain[row, s:e].mean())) for s, k, e in found
                            if (s > 0 or first) and (e < len(text) or last) and e - s <= WINDOW // 2])
        return out


def regions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches of the text in which an added span may lie: half a window around the marks outside of pattern spans."""
    half, out, marks, past = WINDOW // 2, [], [], 0
    claimed = sorted((s, e) for s, _, e in base)
    number = 0
    for found in _MARKS.finditer(text):
        at = found.start()
        while number < len(claimed) and claimed[number][1] <= at:
            past = max(past, claimed[number][1])
            number += 1
        if not any(s <= at < e for s, e in claimed[number:number + 3]):
            marks.append((at, found.end()))
    at = 0
    while at < len(marks):
        stop = at + 1
        while stop < len(marks) and marks[stop][0] - marks[stop - 1][1] < half:
            stop += 1
        start, end = max(marks[at][0] - half, 0), min(marks[stop - 1][1] + half, len(text))
        # Four digits are the least that any kind without a sign needs.
        if stop - at >= 4 or _NOT_DIGIT_MARK.search(text, marks[at][0], marks[stop - 1][1]):
            out.append((start, end))
        at = stop
    return out


def reconcile(proposed: list[tuple[int, int, int, float]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """The heaviest set of spans that overlap neither each other nor a pattern's span; ties: the earlier end, then the longer."""
    free, ends, starts = [], [], []
    for start, _, end in sorted(base):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    merged: dict[tuple[int, int, int], float] = {}
    for start, kind, end, weight in proposed:
        merged[start, kind, end] = max(weight, merged.get((start, kind, end), weight))
    for (start, kind, end), weight in merged.items():
        near = bisect_left(ends, start + 1)
        if near == len(ends) or starts[near] >= end:
            free.append((end, start, kind, weight))
    free.sort()
    stops = [f[0] for f in free]
    total, taken = [0.0], []
    for at, (end, start, kind, weight) in enumerate(free):
        prior = bisect_left(stops, start + 1, 0, at)
        gain = total[prior] + weight * (end - start)
        taken.append((gain > total[at], prior))
        total.append(max(gain, total[at]))
    out, at = [], len(free)
    while at:
        use, prior = taken[at - 1]
        if use:
            end, start, kind, weight = free[at - 1]
            out.append((start, kind, end, weight))
        at = prior if use else at - 1
    return out[::-1]


def find(texts: list[str | None], model: Tagger | None) -> list[list[tuple[int, int, int, bool, float]]]:
    """(start, kind number, end, by pattern, weight) of each text in order; the windows of all texts go through the model together."""
    texts = [t or "" for t in texts]
    bases = [base_spans(t) for t in texts]
    owners, offsets, windows, edges = [], [], [], []
    for number, text in enumerate(texts if model else []):
        for start, end in regions(text, bases[number]):
            at = start
            while True:
                stop = min(at + WINDOW, end)
                owners.append(number)
                offsets.append(at)
                windows.append(text[at:stop])
                edges.append((at == 0, stop == len(text)))
                if stop == end:
                    break
                at += WINDOW // 2
    added: dict[int, list] = {}
    for number, offset, spans in zip(owners, offsets, model.propose(windows, edges) if windows else []):
        for s, kind, e, weight in spans:
            if weight > model.floors[kind] and plausible(kind, texts[number], offset + s, offset + e):
                added.setdefault(number, []).append((offset + s, kind, offset + e, weight))
    out = []
    for number, base in enumerate(bases):
        spans = [(s, k, e, True, 0.0) for s, k, e in base]
        spans += [(s, k, e, False, w) for s, k, e, w in reconcile(added.get(number, []), base)]
        out.append(sorted(spans))
    return out


# -- labelled examples


def _render(rng, kind: int) -> str:
    """A value of a kind, written in one of many ways."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    number = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    word = lambda a, b: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(a, b))))
    if kind == 0:
        local = word(2, 9) + pick(["", "." + word(2, 8), number(2), "." + number(2), "_" + word(1, 4)])
        host = [word(3, 8) + pick(["", number(1)]), *([word(3, 8)] if rng.random() < 0.5 else []), pick(["com", "org", "net", "de", "fr", "es", "info"])]
        at, dot = pick([("@", "."), ("@", "."), (" @ ", " . "), (" (at) ", "."), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "),
                        (" (at) ", " (dot) "), ("@", "[.]"), (" {at} ", "."), (" @ ", ".")])
        said = local + at + dot.join(host)
        return said.upper() if rng.random() < 0.1 else said
    if kind == 1:
        dot = pick([".", ".", "[.]", " . ", "(.)", "[dot]", " dot ", ". "])
        return dot.join(str(int(x)) for x in rng.integers(0, 256, 4))
    if kind == 2:
        size = pick([16, 16, 16, 15, 14, 13])
        body = pick("3456") + number(size - 2)
        digits = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        gap = pick(["", "", " ", "-", ".", "/", " - "])
        cuts = (4, 10) if size == 15 else range(4, size, 4)
        return gap.join(digits[a:b] for a, b in zip([0, *cuts], [*cuts, size])) if gap else digits
    area, first, last = number(3), number(3), number(4)
    return pick([f"+1 ({area}) {first}-{last}", f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"+1.{area}.{first}.{last}", f"1-{area}-{first}-{last}",
                 f"({area}) {first} {last}", f"({area}) {first}.{last}", f"+{number(2)} {number(2)} {number(4)} {number(3)}", f"00{number(2)} {number(3)} {number(3)} {number(3)}",
                 f"0{number(3)} / {number(6)}", f"0{number(2)}-{number(7)}", f"{area} {first} {last}", f"({area}){first}-{last}", f"+ {number(2)} {number(3)} {number(6)}"])


def _decoy(rng) -> str:
    """Digits and signs that are none of the kinds."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    number = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    year = lambda: str(int(rng.integers(1900, 2035)))
    hexes = "".join("0123456789abcdef"[int(d)] for d in rng.integers(0, 16, int(rng.integers(8, 44))))
    return pick([f'token = "{hexes}"', hexes, number(int(rng.integers(1, 8))), f"{number(1)}.{number(2)}.{number(1)}", f"{year()}-{number(2)}-{number(2)}",
                 f"{year()}-{number(2)}-{number(2)} {number(2)}:{number(2)}:{number(2)}", f"{number(2)}/{number(2)}/{year()}", f"{year()}-{year()}", f"{year()} {year()} {year()}",
                 f"{number(2)}:{number(2)}:{number(2)}", f"{number(3)},{number(3)}.{number(2)}", f"${number(4)}.{number(2)}", number(int(rng.integers(20, 40))), number(10), number(int(rng.integers(8, 12))),
                 f"v{number(1)}.{number(1)}.{number(1)}", f"[{number(2)}] [{number(2)}]", f"{number(2)} {number(2)} {number(2)}", f"@{hexes[:6]}", f"x{number(3)}y{number(4)}", f"{number(2)}%",
                 f"{number(3)}-{number(2)}", f"1. {number(2)} 2. {number(2)} 3. {number(2)}", "at the", "dot", f"{number(1)}.{number(1)} {number(1)}.{number(1)} {number(1)}.{number(1)}",
                 f"ISBN {number(3)}-{number(1)}-{number(2)}-{number(6)}-{number(1)}", f"id={number(9)}", f"{number(5)}.{number(5)}, {number(5)}.{number(5)}"])


def examples(passages: list[str], count: int, seed: int):
    """(text of at most a window, spans): values and decoys set into passages, every fifth with decoys only."""
    import numpy as np

    rng = np.random.default_rng(seed)
    passages = [p for p in passages if p.strip()] or ["plain words of no meaning stand around here. More of them follow, and"]

    def passage(size: int) -> str:
        text = passages[int(rng.integers(len(passages)))]
        at = int(rng.integers(max(len(text) - size, 0) + 1))
        # Digits of the passage itself have no certain label.
        return re.sub(r"[0-9@]", "", text[at:at + size])

    for number in range(count):
        kind = -1 if number % 5 == 4 else number % 5
        value = _decoy(rng) if kind < 0 else _render(rng, kind)
        room = max(WINDOW - len(value), 0)
        left = int(rng.integers(room + 1))
        before, after = passage(left), passage(room - left)
        lead = ["", " ", ": ", " (", '"', "\n", "tel. ", "= "][int(rng.integers(8))] if rng.random() < 0.5 else " "
        tail = ["", " ", ".", ",", ")", "###", "&&&", "!!", '"', "\n", "%%%", "$$$"][int(rng.integers(12))] if rng.random() < 0.5 else " "
        if kind >= 0 and rng.random() < 0.15:  # a number beside the value
            lead, tail = (f" {int(rng.integers(2000))} ", tail) if rng.random() < 0.5 else (lead, f" {int(rng.integers(2000))} ")
        if kind >= 0 and (lead[-1:] or before[-1:]).isalnum():
            lead += " "
        start = len(before) + len(lead)
        if start + len(value) > WINDOW:
            before, start = before[start + len(value) - WINDOW:], WINDOW - len(value)
            start = len(before) + len(lead)
        if kind >= 0 and (tail[:1] or after[:1]).isalnum():
            tail = " " + tail
        text = (before + lead + value + tail + after)[:WINDOW]
        yield text, ([(start, kind, start + len(value))] if kind >= 0 and start + len(value) <= len(text) else [])


def labelled_windows(texts: list[str]):
    """Windows of texts with what the patterns find in them; windows that cut a match are left out."""
    for text in texts:
        base = base_spans(text)
        # Overlapping matches of two kinds have no single tag; the first one counts.
        for at in range(0, max(len(text) - WINDOW // 2, 1), WINDOW // 2):
            inside = [(s - at, k, e - at) for s, k, e in base if s < at + WINDOW and e > at]
            if all(s >= 0 and e <= WINDOW for s, _, e in inside) and (inside or re.search("[0-9@]", text[at:at + WINDOW])):
                apart = [x for i, x in enumerate(inside) if not any(y[2] > x[0] for y in inside[:i])]
                yield text[at:at + WINDOW], apart


def encode_examples(pairs):
    import numpy as np

    pairs = list(pairs)
    codes, tags = np.full((len(pairs), WINDOW), OUTSIDE, np.uint8), np.zeros((len(pairs), WINDOW), np.int64)
    for row, (text, spans) in enumerate(pairs):
        codes[row, :len(text)] = classes(text)
        tags[row] = tags_of(spans, WINDOW)
    return codes, tags


def fit(texts: list[str], rendered: int = RENDERED, passes: int = PASSES) -> Tagger:
    """A tagger from sampled texts; on examples it was not trained on, at most ``MISTAKES`` of what exceeds a kind's floor is wrong."""
    found = list(islice(labelled_windows(texts), rendered // 3))
    model = Tagger()
    model.train(lambda number: encode_examples([*examples(texts, rendered, 100 + number), *found]), passes)
    held = list(examples(texts, rendered // 2, 5))
    proposed: dict[int, list[tuple[float, bool]]] = {}
    for (text, spans), found in zip(held, model.propose([t for t, _ in held], [(True, True)] * len(held))):
        for s, k, e, weight in found:
            if plausible(k, text, s, e):
                # A span with one edge misplaced still tells where the data are.
                proposed.setdefault(k, []).append((weight, any(k == kind and s < end and start < e for start, kind, end in spans)))
    for kind, gains in proposed.items():
        wrong, model.floors[kind] = 0, max(gains)[0]
        gains = sorted(gains, reverse=True)
        for count, (_, good) in enumerate(gains, 1):
            wrong += not good
            if wrong <= MISTAKES * count:
                model.floors[kind] = gains[count][0] if count < len(gains) else 0.0
    return model


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Tagger:
    """Fit on pieces of at most ``rows`` texts of at most ``chars`` characters, half of them around a digit or an @.

    Rows are chosen by a hash of id and text whose threshold follows from their number, then in the order of that
    hash, so any order of the rows gives the same model. Without a text the built-in passages serve.
    """
    parts = []
    mark = F.xxhash64("doc_id", "text", F.lit("personal data sample"))
    place = F.regexp_instr("text", F.lit("[0-9@]"))
    for known, start in ((docs.where("text is not null"), F.pmod(mark, F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1),
                         (docs.where("text is not null").where(place > 0), F.greatest(place - chars // 2, F.lit(1)))):
        known = known.select("doc_id", "text")
        count = known.count()
        if 2 * count > rows:
            known = known.where(mark < F.lit(int(min(0.6 * rows / count, 1.0) * ((1 << 64) - 1)) - (1 << 63)))
        found = known.select(mark.alias("mark"), F.col("text").substr(start, F.lit(chars)).alias("piece")).orderBy("mark", "piece").limit(rows // 2).collect()
        parts.append([r.piece for r in found])
    return fit([t for part in parts for t in part])


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,weight:double>>"


def detect(docs: DataFrame, model: Tagger | None, text: str = "text", into: str = "personal") -> DataFrame:
    """Add column ``into``: all spans of the whole text by start, kind and end; code points, end exclusive.

    ``base`` says that a pattern found the span; such spans always stay. Without a model there are no others. An added span
    is at most 48 characters, overlaps no other and holds what its kind requires (Luhn's check for
    cards, parts up to 255 for addresses, 9 to 15 digits for telephones, something at a host for mail). A null or empty text has
    none. Every row stays, repeated ones too; a column of that name is replaced; an empty table gives no rows.
    """
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("weight", pa.float64())]

    @F.arrow_udf(SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e, "base": base, "weight": w} for s, k, e, base, w in f] for f in find(batch.to_pylist(), model)]
            yield pa.array(found, pa.list_(pa.struct(fields)))

    return docs.withColumn(into, spans(F.col(text)))


def report(detected: DataFrame) -> DataFrame:
    """doc_id, numbers of pattern spans by kind, the digest of these spans, and all spans as ``kind:start:end``."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("personal", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return detected.select("doc_id", *[count(k) for k in KINDS], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("personal")).alias("spans"))
