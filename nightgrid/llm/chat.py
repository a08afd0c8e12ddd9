"""Conversations as token ids with a loss mask that is aligned by character offsets.

A whole conversation is rendered once and encoded once. The tokens' offsets are sorted, so the
tokens of each turn are found by binary search of the turn's span; the marks of the template are tokens
of their own, so no token reaches over the edge of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid.llm.common import only, slices, tokenizer_path, worker_state


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around turns: ``begin`` role ``says`` text ``end``.

    Control strings, the marks and the ``reserved`` ones, cannot occur in roles and texts: one with n
    backslashes after its first character gets one more, and loses one when it is read. This is
    reversible for every text, and what is escaped holds no control string.
    """

    begin: str = "<|turn|>"
    says: str = "<|says|>"
    end: str = "<|done|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    learned_role: str = "assistant"

    def __post_init__(self):
        for c in self.controls:
            if len(c) < 2 or "\\" in c or any(c[0] in other[1:] for other in self.controls):
                raise ValueError(f"unusable control string {c!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.says, self.end, *self.reserved)

    def _pattern(self, backslashes: str) -> re.Pattern:
        return re.compile("|".join(f"(?<={re.escape(c[0])}){backslashes}(?={re.escape(c[1:])})" for c in self.controls))

    def escape(self, text: str) -> str:
        return self._pattern(r"\\*").sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._pattern(r"\\+").sub(lambda m: m[0][1:], text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The conversation and the span of every text that is to be learned, ascending."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{self.begin}{self.escape(role)}{self.says}", self.escape(text)
            if role == self.learned_role:
                spans.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, self.end]
            at += len(head) + len(body) + len(self.end)
        return "".join(parts), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a rendered conversation."""
        turns = []
        for part in formatted.split(self.end)[:-1]:
            role, _, text = part.removeprefix(self.begin).partition(self.says)
            turns.append((self.unescape(role), self.unescape(text)))
        return turns


class ChatEncoder:
    """A byte-level tokenizer whose offsets cover every character, with the template's marks as tokens."""

    def __init__(self, template: ChatTemplate, tokenizer: str):
        from tokenizers import AddedToken, Tokenizer, pre_tokenizers

        self.template = template
        self.tokenizer = Tokenizer.from_file(tokenizer_path(tokenizer))
        # As in the file, but white space stays inside a token's offsets.
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
        self.tokenizer.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (template.begin, template.says, template.end)])

    @classmethod
    def shared(cls, template: ChatTemplate, tokenizer: str) -> ChatEncoder:
        held = worker_state().setdefault("chat", {})
        key = (repr(template), tokenizer)
        if key not in held:
            held[key] = cls(template, tokenizer)
        return held[key]

    def encode(self, conversations: list[list[tuple[str, str]]]) -> list[dict]:
        """formatted, token_ids, token_start, token_end (characters) and loss_mask of each conversation."""
        import numpy as np

        rendered = [self.template.render(turns) for turns in conversations]
        out = []
        for (text, spans), found in zip(rendered, self.tokenizer.encode_batch([t for t, _ in rendered], add_special_tokens=False)):
            offsets = np.array(found.offsets, dtype=np.int32).reshape(-1, 2)
            start, end = offsets[:, 0], offsets[:, 1]
            mask = np.zeros(len(start), dtype=np.uint8)
            for a, b in spans:
                # Tokens that end after a and start before b; both offsets ascend.
                mask[np.searchsorted(end, a, "right"):np.searchsorted(start, b, "left")] = 1
            out.append({"formatted": text, "token_ids": found.ids, "token_start": start, "token_end": end, "loss_mask": mask})
        return out

    def learned_text(self, formatted: str, start, end, mask) -> str:
        """What lies under the loss mask, unescaped: the masked tokens' spans, each run of them on its own."""
        import numpy as np

        edge = np.flatnonzero(np.diff(np.concatenate(([0], np.asarray(mask, dtype=np.int8), [0]))))
        return "".join(self.template.unescape(formatted[start[a]:end[b - 1]]) for a, b in zip(edge[::2], edge[1::2]))


FORMATTED = "conv_id long, formatted string, token_ids array<int>, token_start array<int>, token_end array<int>, loss_mask binary"


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate(), tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): FORMATTED.

    Turns are ordered by turn, then role and text, null first; repeated rows are turns of their own; null roles and texts are
    empty. Rows without conv_id belong to no conversation and are left out. The mask has one byte per token, 1 for those of the learned role's
    texts. A conversation is one training example, rendered in one row; that is the only bound on its length. Texts of any
    content come back unchanged from ``ChatTemplate.parse``. An empty table gives no rows. Other columns are not read.
    """
    turns = only(turns, "conv_id", "turn", "role", "text").where("conv_id is not null")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn").isNotNull().alias("known"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChatEncoder.shared(template, tokenizer)
        for batch in slices(batches, 64):
            found = encoder.encode([[(t["role"], t["text"]) for t in row] for row in batch.column("turns").to_pylist()])
            numbers = lambda n: pa.array([f[n] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").cast(pa.int64()), pa.array([f["formatted"] for f in found], pa.string()), numbers("token_ids"),
                 numbers("token_start"), numbers("token_end"), pa.array([f["loss_mask"].tobytes() for f in found], pa.binary())],
                ["conv_id", "formatted", "token_ids", "token_start", "token_end", "loss_mask"])

    return whole.mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def digests(formatted: DataFrame, template: ChatTemplate = ChatTemplate(), tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Read formatted conversations back: turns from the text, learned text from tokens under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        import numpy as np

        encoder = ChatEncoder.shared(template, tokenizer)
        names = [c.split()[0] for c in DIGEST.split(", ")]
        for batch in slices(batches, 64):
            rows = []
            for row in batch.to_pylist():
                turns = template.parse(row["formatted"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                mask = np.frombuffer(row["loss_mask"], np.uint8)
                learned = encoder.learned_text(row["formatted"], row["token_start"], row["token_end"], mask)
                rows.append((row["conv_id"], len(turns), sha256(said.encode()).hexdigest(), len(learned), sha256(learned.encode()).hexdigest(),
                             len(row["formatted"]), len(mask), int(mask.sum())))
            kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return formatted.mapInArrow(run, DIGEST)
