"""Main text of web pages: a host suffix array over the blocks of every page, with markup as evidence.

The blocks of all pages, boilerplate too, are suffixes of one array per host. It is built in parts: a task sorts the
suffixes of a stretch of its pages to the depth of a run, neighbours that agree so far are one prefix, and the prefixes of
all stretches are merged by key range. So a run is found on whatever pages of its host it lies, and no host is one task.
Repetition alone would be wrong both ways: passages that many articles share stay, and a footer that occurs once goes.
So each run carries the parts of the pages in which it lies, and markup of the page itself is checked last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid.llm.common import only, open_store, shared_folder, slices
from nightgrid.session import write_once

#: Tokens a repeated run has at least; a shorter block counts as a whole.
RUN_TOKENS = 8
#: Tokens after which a task sorts the stretch of pages it holds, and bytes of html for each key range in the merge.
STRETCH_TOKENS, RANGE_BYTES = 1_000_000, 16 << 20

# Element names of HTML.
RAW = frozenset("script style noscript template textarea title svg iframe object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label link mark meta q s samp small span strike strong sub sup time tt u var wbr".split()) | {"button", "select", "optgroup", "option"}
# Start tags that end an open paragraph, and the elements in which an end tag may be left out: what starts ends them, up to what encloses both.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main "
                   "menu nav ol p pre section summary table ul".split())
_CELLS, _ROWS, _PARTS = {"td", "th"}, {"tr"}, {"tbody", "thead", "tfoot", "caption", "colgroup"}
_TABLE = frozenset({"table"})
_SECTIONS = frozenset("ul ol menu dl table td th article section nav aside header footer main form blockquote fieldset".split())
IMPLIED = {"li": (frozenset({"li"}), _SECTIONS - {"li"}), "dt": (frozenset({"dt", "dd"}), _SECTIONS), "dd": (frozenset({"dt", "dd"}), _SECTIONS),
           "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
           "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
           **dict.fromkeys(_CELLS, (frozenset(_CELLS), _TABLE)), **dict.fromkeys(_ROWS, (frozenset(_ROWS | _CELLS), _TABLE)),
           **dict.fromkeys(_PARTS, (frozenset(_PARTS | _ROWS | _CELLS), _TABLE))}
_P = (frozenset({"p"}), frozenset("table td th caption button object article section aside main nav header footer".split()))
DROPPED = frozenset("head nav header footer aside form menu dialog button select".split())
# Words that name a part of a page in class and id attributes.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices disclaimer "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus respond replies share sharing "
    "social related recommended newsletter subscribe subscription signup login search popup modal overlay toolbar pagination pager".split())
CONTENT_NAMES = frozenset("content main article articlebody post entry story".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOT_NAMES = frozenset("has with no is without".split())

#: Parts of a page: dropped, not named, named by class or id, an ``article`` or ``main`` element.
BOILER, OPEN, MAIN, ARTICLE = range(4)


#: Spellings of tags a scanner keeps, and the characters of each at most.
KEPT_TAGS, KEPT_CHARS = 4096, 64


class Scanner:
    """The next markup of a page, with what a tag means: (tag, closing, closes itself, what it says of its content).

    Few spellings make up most tags, so their meaning is kept. Only a tag whose quotes close before its first ``>`` is:
    where that spelling comes again, it is the whole tag, whatever follows.
    """

    def __init__(self):
        self.pattern = re.compile(
            r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
        self.ends = {tag: re.compile(rf"</{re.escape(tag)}\s*>", re.I) for tag in RAW}
        self.kept: dict[str, tuple[str, bool, bool, int | None]] = {}

    def next(self, html: str, at: int) -> tuple[int, int, tuple[str, bool, bool, int | None] | None] | None:
        """(start, end, meaning) of the first markup from a place on; no meaning: not a tag. None if there is no markup."""
        while (start := html.find("<", at)) >= 0:
            end = html.find(">", start, start + KEPT_CHARS) + 1
            meaning = self.kept.get(html[start:end])
            if meaning:
                return start, end, meaning
            m = self.pattern.match(html, start)
            if m:
                tag = (m[2] or m[5] or "").lower()
                if not tag:
                    return start, m.end(), None
                closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
                closed = attributes.endswith("/")
                meaning = tag, closing, closed, None if closing or closed or tag in RAW or tag in VOID else part_of(tag, attributes)
                if m[2] and m.end() == end:
                    if len(self.kept) >= KEPT_TAGS:
                        self.kept.clear()
                    self.kept[m[0]] = meaning
                return start, m.end(), meaning
            at = start + 1
        return None


_ATTRIBUTE = r"""([a-zA-Z][\w:-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?"""


def part_of(tag: str, attributes: str) -> int | None:
    """What an element's name, role, class and id say of its content; None if nothing.

    Class and id words drop blocks only: an inline element is part of a sentence, whatever it is called, unless it is hidden.
    """
    if tag in DROPPED:
        return BOILER
    level = ARTICLE if tag in ("article", "main") else None
    named = attributes.lower()
    # Other attributes say nothing, and those of most links and images are not worth the parse.
    if "role" in named or "hidden" in named or "style" in named or "itemprop" in named or tag not in INLINE and ("class" in named or "id" in named):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in re.finditer(_ATTRIBUTE, attributes)}
        role = found.get("role", "").lower()
        if role in DROPPED_ROLES or "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")):
            return BOILER
        names = [re.split(r"[-_]+", n) for n in re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')}").lower().split()]
        names = [n for n in names if n[0] not in NOT_NAMES]
        if tag not in ("html", "body", "main") and tag not in INLINE and any(part in DROPPED_NAMES for n in names for part in n):
            return BOILER
        if level is None and tag not in ("html", "body"):
            if role == "main":
                return ARTICLE
            if found.get("itemprop", "").lower() == "articlebody":
                return MAIN
            if tag not in INLINE and any(n[-1] in CONTENT_NAMES or n[-1] == "body" and n[0] in CONTENT_NAMES for n in names):
                return MAIN
    return level


_ENDED = {tag: ((IMPLIED[tag],) if tag in IMPLIED else ()) + ((_P,) if tag in ENDS_P else ()) for tag in ENDS_P | set(IMPLIED)}


def _ended(stack: list[tuple[str, int]], tag: str) -> int | None:
    """Place of the outermost open element whose end tag is implied by a start tag; None if there is none."""
    found = None
    for ends, inside in _ENDED.get(tag, ()):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ends:
                found = i if found is None else min(i, found)
            elif stack[i][0] in inside:
                break
    return found


def blocks(html: str, scanner: Scanner | None = None, boiler: list[tuple[int, str]] | None = None) -> list[tuple[int, str]]:
    """(part, text) of every non-empty block in page order; boilerplate is left out, and added to ``boiler`` if given.

    Character references are decoded, white space in a block becomes one space, comments, scripts and markup go. An end tag
    that HTML lets a page omit is implied by the start tag that follows. What is dropped inside a line does not break it.
    """
    from html import unescape

    scanner = scanner or Scanner()
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    level, pending, aside, at, size = OPEN, [], [], 0, len(html)
    part = OPEN  # of the pending text

    def flush() -> None:
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            out.append((part, text))

    def flush_aside() -> None:
        text = " ".join("".join(aside).split())
        aside.clear()
        if text and boiler is not None:
            boiler.append((BOILER, text))

    def turn(to: int) -> None:
        nonlocal level
        if pending and to != level and BOILER not in (to, level):
            flush()
        level = to

    while at < size:
        markup = scanner.next(html, at)
        stop = markup[0] if markup else size
        if stop > at:
            text = html[at:stop]
            if "&" in text:
                text = unescape(text)
            if level != BOILER:
                if pending and part != level:  # a dropped element lay between
                    flush()
                pending.append(text)
                part = level
            elif boiler is not None:
                aside.append(text)
        if not markup:
            break
        _, at, meaning = markup
        if not meaning:
            continue
        tag, closing, closed, said = meaning
        if tag == "br" or tag == "img":
            (aside if level == BOILER else pending).append(" ")
            continue
        if not closing and tag in RAW and not closed:
            end = scanner.ends[tag].search(html, at)
            at = end.end() if end else size
            continue
        if tag not in INLINE:
            if pending:
                flush()
            if aside:
                flush_aside()
        if tag in VOID and tag != "hr":
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    turn(stack[i][1])
                    del stack[i:]
                    break
            continue
        ended = _ended(stack, tag)
        if ended is not None:
            turn(stack[ended][1])
            del stack[ended:]
        if tag != "hr" and not closed:
            stack.append((tag, level))
            if level != BOILER and said is not None:
                turn(BOILER if said == BOILER else max(level, said))
    if pending:
        flush()
    if aside:
        flush_aside()
    return out


def leading_part(found: list[tuple[int, str]]) -> int:
    """The part in which a page's article lies: ``article`` and ``main`` elements (one may hold the other), else elements whose class or id names the content, else what is open."""
    top = max((p for p, _ in found), default=OPEN)
    return top if top >= MAIN else OPEN


def decide(html: str, scanner: Scanner | None = None) -> tuple[str | None, list[str]]:
    """What markup says of a page by itself: (text, []) where it tells the article from the rest, else (None, open blocks)."""
    found = blocks(html, scanner)
    part = leading_part(found)
    chosen = [t for p, t in found if p >= part]
    return (None, chosen) if found and part == OPEN else ("\n".join(chosen), [])


def host_of(url: str | None) -> str:
    """Host of a url, lower case; empty without one."""
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].partition(":")[0].lower() if m else ""


#: What is known of a run: it lies on several pages, it lies in an article or main part.
SEVERAL, IN_ARTICLE = 1, 2


def _mixed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers with every bit spread over all; different ones stay different."""
    values = values ^ (values >> np.uint64(31))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(29)
    return values


class Stretch:
    """The pages of a stretch, and the suffixes of their blocks.

    A page is two documents, its text and its boilerplate, so that a menu entry is no evidence against a headline of
    the same words. Tokens of different hosts or kinds are different symbols: no prefix spans two arrays.
    """

    def __init__(self, run_tokens: int = RUN_TOKENS):
        self.run_tokens = run_tokens
        self.rows: list[tuple] = []
        self.texts: list[str] = []  # of blocks
        self.tokens = 0
        self.parts: list[int] = []
        self.owners: list[int] = []  # the document of each block
        self.places: list[int] = []  # the array of each block
        self.documents: dict[int, int] = {}  # key to number: equal documents are one
        self.arrays: dict[int, int] = {}  # seed to number: an array is a host's pages of one kind

    def add(self, page_id: int | None, url: str | None, found: list[tuple[int, str]], boiler: list[tuple[int, str]]) -> None:
        from xxhash import xxh64_intdigest

        self.rows.append((page_id, url, found, boiler))
        host, seen = host_of(url), 0
        for kind, own in enumerate((found, boiler)):
            seed = xxh64_intdigest(f"{kind} {host}")
            parts, texts = [p for p, _ in own], [t for _, t in own]
            # Pages of one text are one, but a footer under two texts is on two pages.
            seen = xxh64_intdigest("\n".join([str(parts), *texts]), seed ^ seen)
            document = self.documents.setdefault(seen, len(self.documents))
            self.texts += texts
            self.parts += parts
            self.owners += [document] * len(own)
            self.places += [self.arrays.setdefault(seed, len(self.arrays))] * len(own)
            self.tokens += sum([t.count(" ") for t in texts]) + len(texts)

    def close(self) -> None:
        """The words of all blocks, and of every suffix the hash of its prefix, by which other stretches know it."""
        from xxhash import xxh64_intdigest

        run = self.run_tokens
        split = pc.split_pattern(pa.array(self.texts, pa.large_string()), " ")
        self.length = pc.list_value_length(split).to_numpy().astype(np.int64)
        self.first = np.cumsum(self.length) - self.length
        words = split.flatten().dictionary_encode()
        self.words, spelled = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False)
        hashes = _mixed(np.fromiter(map(xxh64_intdigest, spelled), np.uint64, len(spelled)))
        places = np.fromiter(self.arrays, np.uint64, len(self.arrays))[np.array(self.places, np.int64)]
        codes = _mixed(hashes[self.words] ^ np.repeat(places, self.length))
        self.texts = []
        # A shorter block is a suffix as a whole; of the others each suffix that is as long as a run.
        self.windows = np.maximum(1, self.length - run + 1)
        self.block = np.repeat(np.arange(len(self.length)), self.windows)
        self.at = np.arange(len(self.block)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows) + self.first[self.block]
        step, n = np.uint64(0x9E3779B97F4A7C15), len(codes)
        codes = np.concatenate([codes, np.zeros(run, np.uint64)])
        prefix = np.zeros(n, np.uint64)
        for j in range(run):
            prefix *= step
            prefix += codes[j:j + n]
        short = np.flatnonzero(self.length < run)
        first, length, whole = self.first[short], self.length[short], np.zeros(len(short), np.uint64)
        for j in range(run):
            whole *= step
            whole += np.where(length > j, codes[first + j], np.uint64(0))
        prefix[first] = whole
        self.prefix = _mixed(prefix[self.at])

    def _named(self, prefixes: np.ndarray) -> np.ndarray:
        """Sets the keys of the stretch, in order, and returns the place of each prefix and then of each document.

        Documents are keys too: how many stretches hold a page tells whether those that hold its runs are more.
        """
        from xxhash import xxh64_intdigest

        self.keys, entry = np.unique(np.concatenate([prefixes, np.fromiter(self.documents, np.uint64, len(self.documents))]), return_inverse=True)
        self.name = f"{xxh64_intdigest(self.keys.tobytes()):016x}"
        return entry

    def sort(self) -> None:
        """Suffix order to the depth of a run; neighbours that agree so far are one prefix, with what is known of it here."""
        n, run, depth = len(self.words), self.run_tokens, 1
        end = np.repeat(self.first + self.length, self.length)
        symbols = pa.array(np.repeat(np.array(self.places, np.int64) << 32, self.length) | self.words).dictionary_encode().indices
        place, rank = np.arange(n), symbols.to_numpy().astype(np.uint64) + np.uint64(1)
        key = rank
        while n and depth < run:
            # As many ranks as a key holds, two or more; their order gives the ranks of longer prefixes.
            bits, ahead = int(rank.max()).bit_length(), 0
            key = rank
            for _ in range(64 // bits - 1):
                step = min(ahead + depth, run - depth)
                if step == ahead:
                    break
                after = np.zeros(n, np.uint64)  # 0: the block has ended
                after[:max(0, n - step)] = rank[step:]
                after[place + step >= end] = 0
                key, ahead = key << np.uint64(bits) | after, step
            depth += ahead
            if depth < run:
                rank = np.unique(key, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        key = key[self.at]
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(order) else np.zeros(0, np.int64)
        flags = np.zeros(0, np.uint8)
        if len(starts):
            block = self.block[order]
            owner = np.array(self.owners, np.int64)[block]
            article = np.logical_or.reduceat((np.array(self.parts) >= MAIN)[block], starts)
            flags = (SEVERAL * (np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)) + IN_ARTICLE * article).astype(np.uint8)
        entry = self._named(self.prefix[order[starts]])
        self.flags = np.zeros(len(self.keys), np.uint8)
        np.bitwise_or.at(self.flags, entry[:len(starts)], flags)

    def find(self) -> None:
        """The places of suffixes and pages among the sorted keys, where the array was built and merged before."""
        entry = self._named(self.prefix)
        self.entry = entry[:len(self.prefix)]  # of every suffix
        self.holder = entry[len(self.prefix):][np.array(self.owners, np.int64)]  # of every block

    def repeated(self, flags: np.ndarray, stretches: np.ndarray) -> list[tuple[bool, bool]]:
        """Of every block: all its tokens lie in runs of several pages; all lie in such runs as no article has.

        A run lies on other pages too if one stretch has it on several, or if more stretches have it than have this page.
        """
        block, at, known = self.block, self.at, flags[self.entry]
        several = (known & SEVERAL > 0) | (stretches[self.entry] > stretches[self.holder][block])
        whole = []
        for run in (several, several & (known & IN_ARTICLE == 0)):
            reach = np.zeros(int(self.length.sum()) + self.run_tokens + 1, np.int64)
            np.add.at(reach, at[run], 1)
            np.add.at(reach, np.minimum(at[run] + self.run_tokens, (self.first + self.length)[block[run]]), -1)
            bare = np.concatenate([[0], np.cumsum(np.cumsum(reach) == 0)])
            whole.append(bare[self.first + self.length] == bare[self.first])
        return list(zip(*(w.tolist() for w in whole)))


def _stretches(batches: Iterator[pa.RecordBatch], run_tokens: int, stretch_tokens: int) -> Iterator[Stretch]:
    """The rows of a task in stretches of bounded size; where one ends depends on the rows alone."""
    scanner, stretch = Scanner(), Stretch(run_tokens)
    for batch in slices(batches):
        for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            boiler: list[tuple[int, str]] = []
            stretch.add(page_id, url, blocks(html or "", scanner, boiler), boiler)
            if stretch.tokens >= stretch_tokens:
                stretch.close()
                yield stretch
                stretch = Stretch(run_tokens)
    if stretch.rows:
        stretch.close()
        yield stretch


def _packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, most of them small, by planes of bytes."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _host_runs(pages: DataFrame, run_tokens: int, stretch_tokens: int, range_bytes: int) -> str:
    """Merge the sorted prefixes of all stretches by key range; the folder in which each stretch finds what all know of its own."""
    ranges = max(pages.sparkSession.sparkContext.defaultParallelism,
                 -(-(pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0) // range_bytes))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _stretches(batches, run_tokens, stretch_tokens):
            s.sort()
            # Sorted keys go as differences: the lower halves as they are, the upper ones are small.
            bounds = np.searchsorted((s.keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
            rows: list[tuple] = []
            for b, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
                if hi > lo:
                    steps = np.diff(s.keys[lo:hi], prepend=np.uint64(0))
                    rows.append((b, s.name, int(hi - lo), steps.astype("<u4").tobytes(), _packed(steps >> np.uint64(32)), _packed(s.flags[lo:hi])))
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at:at + 64]), kinds)],
                                                 ["range", "stretch", "n", "low", "high", "flags"])

    def merge(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        keys = np.concatenate([np.cumsum(np.frombuffer(r["low"], "<u4").astype(np.uint64) + (_unpacked(r["high"], r["n"]).astype(np.uint64) << np.uint64(32)),
                                         dtype=np.uint64) for r in rows])
        flags = np.concatenate([_unpacked(r["flags"], r["n"]).astype(np.uint8) for r in rows])
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        held = np.diff(np.append(starts, len(keys)))
        known, stretches = np.empty(len(keys), np.uint8), np.empty(len(keys), np.uint32)
        known[order] = np.repeat(np.bitwise_or.reduceat(flags[order], starts), held)
        stretches[order] = np.repeat(held, held)
        ends = np.cumsum([r["n"] for r in rows])
        return pa.table({"stretch": pa.array([r["stretch"] for r in rows], pa.string()), "range": pa.array([r["range"] for r in rows], pa.int32()),
                         "n": pa.array([r["n"] for r in rows], pa.int32()),
                         "flags": pa.array([_packed(known[e - r["n"]:e]) for e, r in zip(ends, rows)], pa.binary()),
                         "stretches": pa.array([_packed(stretches[e - r["n"]:e]) for e, r in zip(ends, rows)], pa.binary())})

    folder = shared_folder(pages.sparkSession, "host-runs")
    (pages.mapInArrow(send, "range int, stretch string, n int, low binary, high binary, flags binary").repartitionById(ranges, "range")
     .groupBy("range").applyInArrow(merge, "stretch string, range int, n int, flags binary, stretches binary")
     .repartition("stretch").write.partitionBy("stretch").parquet(folder))
    return folder


def _known(folder: str, stretch: Stretch) -> tuple[np.ndarray, np.ndarray]:
    """What all stretches know of the keys of one, in the order of its keys."""
    import pyarrow.parquet as pq

    if not len(stretch.keys):
        return np.zeros(0, np.uint8), np.zeros(0, np.uint32)
    store, path = open_store(f"{folder}/stretch={stretch.name}")
    try:
        found = pq.read_table(path, filesystem=store, partitioning=None).to_pylist()
    except FileNotFoundError as missing:
        raise RuntimeError("The two reads of the pages differ in order: give a table of files, or leave stable out") from missing
    parts = {r["range"]: r for r in found}  # equal stretches have equal answers
    parts = [parts[b] for b in sorted(parts)]
    return (np.concatenate([_unpacked(r["flags"], r["n"]).astype(np.uint8) for r in parts]),
            np.concatenate([_unpacked(r["stretches"], r["n"]) for r in parts]))


def main_text(pages: DataFrame, run_tokens: int = RUN_TOKENS, evidence: bool = False, stable: bool = False,
              stretch_tokens: int = STRETCH_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html).

    All blocks of all pages go through the suffix arrays of their hosts. A block outside menus, headers, footers, sidebars,
    notices, adverts, forms and comments is repeated if all its tokens lie in runs of ``run_tokens`` tokens or more (the
    whole block if it is shorter) that occur on pages of the same host with other content, and in no article or main part
    there. The text is the blocks that are not repeated, joined by a line feed; where markup of the page names an article
    (or else a main part), of these only its blocks. Null or empty html gives an empty text; pages without url form one
    host; equal pages count as one. Repeated rows stay. An empty table gives no rows. Other columns are not read.

    ``evidence`` adds counts of blocks: ``shared`` of the text that lie on several pages, ``repeated`` left out by runs,
    ``boiler_repeated`` and ``boiler_single`` left out by markup that lie on several pages or not. The pages are read twice and
    must come in the same order: they are written first unless ``stable`` says that they are a table of files.
    """
    spark = pages.sparkSession
    # The splits of the two reads must not follow executors that come or go in between.
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    read = only(pages, "page_id", "url", "html")
    if not stable:
        read = write_once(read, "pages")
    folder = _host_runs(read, run_tokens, stretch_tokens, range_bytes)
    counts = ["shared", "repeated", "boiler_repeated", "boiler_single"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _stretches(batches, run_tokens, stretch_tokens):
            s.find()
            verdicts = iter(s.repeated(*_known(folder, s)))
            out: list[tuple] = []
            for page_id, url, found, boiler in s.rows:
                part, kept, shared, repeated = leading_part(found), [], 0, 0
                for p, text in found:
                    several, no_article = next(verdicts)
                    if p >= part:
                        if no_article:
                            repeated += 1
                        else:
                            kept.append(text)
                            shared += several
                several = sum(next(verdicts)[0] for _ in boiler)
                out.append((page_id, url, "\n".join(kept), shared, repeated, several, len(boiler) - several))
            kinds = [pa.int64(), pa.string(), pa.string()] + [pa.int64()] * len(counts)
            for at in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at:at + 256]), kinds)], ["page_id", "url", "text", *counts])

    texts = read.mapInArrow(run, "page_id long, url string, text string, " + ", ".join(f"{c} long" for c in counts))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), *(counts if evidence else []))
