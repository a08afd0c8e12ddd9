"""Numbers of tokens under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton reports every vocabulary piece that ends at each place of a word; dynamic
programming keeps, for each place, the best score of what lies before it and the number of
pieces on that path. Ties follow the unigram tokenizer: paths are tried by ascending start, the longest piece
first, and a later one wins only with a strictly better score; a character with no piece of its own
may also be unknown, tried after the pieces that start with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from nightgrid.llm.common import only, slices, tokenizer_path, worker_state

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: What an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0


def unigram_vocabulary(name: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) of a public vocabulary file, its ranks as scores: a piece's score is minus its logarithmic rank.

    The file's own scores are merge ranks; as log probabilities they would fall off so steeply that the number of
    pieces would not matter. A rank's logarithm is what word frequencies follow.
    """
    from math import log

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    return [(model.id_to_piece(i), -log(i + 2.0)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Counts of pieces for words; ``byte_fallback`` counts an unknown character by its UTF-8 bytes, else a run of them is one."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, memo_limit: int = 1_000_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        known = {p for p, _ in vocabulary}
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in known for b in range(256))
        self.single = {p for p in known if len(p) == 1}
        self.memo: dict[str, int] = {}
        self.memo_limit = memo_limit

    @classmethod
    def shared(cls, name: str) -> UnigramCounter:
        held = worker_state().setdefault("unigram", {})
        if name not in held:
            held[name] = cls(unigram_vocabulary(name))
        return held[name]

    def viterbi(self, text: str) -> int:
        """Number of pieces of the best segmentation of ``text``."""
        n = len(text)
        if n == 0:
            return 0
        ends: list[list] = [[] for _ in range(n)]  # for each start: (end, score), shortest first
        for last, (size, score) in self.automaton.iter(text):
            ends[last + 1 - size].append((last + 1, score))
        best, count, unknown_end = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        for at in range(n):
            here, so_far = best[at], count[at]
            for end, score in ends[at]:
                total = here + score
                if best[end] is None or total > best[end]:
                    best[end], count[end], unknown_end[end] = total, so_far + 1, False
            if text[at] not in self.single:
                total = here + self.unknown
                if best[at + 1] is None or total > best[at + 1]:
                    added = len(text[at].encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not unknown_end[at])
                    best[at + 1], count[at + 1], unknown_end[at + 1] = total, so_far + added, True
        return count[n]

    def count(self, text: str) -> int:
        """Pieces of a whole text: white space separates words, each led by the space mark."""
        if len(self.memo) > self.memo_limit:
            self.memo.clear()
        # str.split also cuts at four control characters that are not white space.
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        memo, words = self.memo, [w for w in re.split(WHITE, text) if w] if odd else text.split()
        found = list(map(memo.get, words))
        if None in found:
            for word in set(words).difference(memo):
                # A space mark in the text itself begins a word of its own, and is not doubled in front.
                marked = word if word.startswith(SPACE) else SPACE + word
                memo[word] = sum(map(self.viterbi, re.findall(f"{SPACE}[^{SPACE}]*", marked)))
            found = list(map(memo.get, words))
            for word in words:
                if len(word) > 64:
                    memo.pop(word, None)
        return sum(found)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row of (doc_id, text), whole texts.

    Words are separated by white space and led by the space mark, as a unigram tokenizer with that pre-tokenizer does;
    unknown characters count as their UTF-8 bytes. Each distinct word is segmented once per worker. A null, empty or blank text has no
    tokens; repeated rows stay; an empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter.shared(vocabulary)
        for batch in slices(batches):
            counts = [counter.count(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")
