"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import sys
import types
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nightgrid.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1

# The normalizer and pre-tokenizer of a tokenizer file that drops white space and
# never joins text across it. Only under exactly these may a text be encoded piece by piece.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
_ENDS = b".,;:!?"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer file lies on this machine; called inside tasks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def worker_state() -> dict:
    """A dict that lives as long as the Python worker process.

    Task functions travel by value, so their module globals are new for each task; caches that
    should outlive one task are kept here.
    """
    return sys.modules.setdefault("_nightgrid_worker", types.ModuleType("_nightgrid_worker")).__dict__


class TextEncoder:
    """Ids of whole texts, as bytes of little-endian unsigned integers of ``width`` bytes.

    For a tokenizer that never joins text across white space, each distinct piece between ASCII
    white space is encoded once per worker and looked up afterwards (two generations of at most ``chunk_limit`` and one batch each); of a piece made of ASCII
    or Latin letters with closing punctuation, the lower-cased letters are looked up by themselves. Any
    other tokenizer encodes each text as it is. Both give what ``encode`` gives for the text.
    """

    def __init__(self, name: str, chunk_limit: int = 400_000, core_limit: int = 300_000):
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and not set(t["content"]) & set(" \t\n\r\v\f")
                    for t in spec["added_tokens"])
        self.wordwise = plain and spec["post_processor"] is None and all(spec[k] == v for k, v in WORDWISE.items())
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.chunks: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}
        self.aged_chunks: dict[bytes, bytes] = {}
        self.aged_cores: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}
        self.chunk_limit, self.core_limit = chunk_limit, core_limit
        self.kind = "H" if self.width == 2 else "I"
        self.coded = [i.to_bytes(self.width, "little") for i in range(self.tokenizer.get_vocab_size())] if self.wordwise else []
        # Byte-level models spell a text's bytes in printable characters: those that print stand for themselves.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.spelled = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    @classmethod
    def shared(cls, name: str) -> TextEncoder:
        """The encoder of this worker process."""
        held = worker_state().setdefault("encoders", {})
        if name not in held:
            held[name] = cls(name)
        return held[name]

    def pack(self, ids: Iterable[int]) -> bytes:
        packed = array(self.kind, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _library(self, texts: list[bytes]) -> list[bytes]:
        """The library's own encoding of each text."""
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [self.pack(e.ids) for e in found]

    def _learn(self, pieces: set[bytes]) -> None:
        """Ids of new pieces; words met for the first time go to the model, everything else to the library."""
        rest, plain, words, cores = [], [], {}, self.cores
        for piece in pieces:
            letters = piece.rstrip(_ENDS)
            if len(piece) > 64:
                rest.append(piece)
                continue
            if letters.isalpha():  # of bytes: ASCII letters only
                core = letters.lower()
                if core == piece:
                    core = piece  # one object serves both caches
                if core not in cores:
                    words[core] = core.decode()
            else:
                word = letters.decode("utf-8", "replace")
                # Up to U+017F but for U+0130, letters are composed already and have one lower-case letter each.
                if not word.isalpha() or max(word) > "\u017f" or "\u0130" in word:
                    rest.append(piece)
                    continue
                core = word.lower().encode()
                if core not in cores:
                    words[core] = "".join([self.spelled[b] for b in core])
            plain.append((piece, core, piece[len(letters):]))
        aged, tokenize, coded = self.aged_cores, self.model.tokenize, self.coded
        for core, text in words.items():
            cores[core] = aged.get(core) or b"".join([coded[t.id] for t in tokenize(text)])
        chunks, tails = self.chunks, self.tails
        for piece, core, tail in plain:
            if tail and tail not in tails:
                tails[tail] = self._library([tail])[0]
            chunks[piece] = cores[core] + tails[tail] if tail else cores[core]
        chunks.update(zip(rest, self._library(rest)))

    def _age(self) -> None:
        """A full cache becomes the old generation, from which words still in use come back; the one before goes."""
        if len(self.chunks) > self.chunk_limit:
            self.chunks, self.aged_chunks = {}, self.chunks
        if len(self.cores) > self.core_limit:
            self.cores, self.aged_cores = {}, self.cores

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Texts as UTF-8 bytes (None: empty) to the bytes of their ids."""
        texts = [t or b"" for t in texts]
        if not self.wordwise:
            return self._library(texts)
        self._age()
        known, aged, out, long = self.chunks, self.aged_chunks, [], set()
        for text in texts:
            pieces = text.split()
            found = list(map(known.get, pieces))
            if None in found:
                new = {p for p, ids in zip(pieces, found) if ids is None}
                if aged:
                    back = [p for p in new if p in aged]
                    known.update(zip(back, map(aged.get, back)))
                    new.difference_update(back)
                self._learn(new)
                long.update(p for p in new if len(p) > 64)
                found = [known[p] if ids is None else ids for p, ids in zip(pieces, found)]
            out.append(b"".join(found))
        for piece in long:
            known.pop(piece, None)
        return out


def binary_column(batch: pa.RecordBatch, name: str) -> list:
    """A string column as UTF-8 bytes, without decoding it."""
    column = batch.column(name)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def give_back() -> None:
    """Return freed memory to the machine: a worker lives on, and what its task held must not add to what the next ones hold."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the GNU C library
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what a task holds does not follow the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder, as a URI, in the folder that all executors share."""
    path = scratch_path(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def open_store(uri: str):
    """(file system, path) of a URI of the shared folder; usable on the driver and in tasks."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; a column of another case does not clash with them."""
    return df.select(*[f"`{n}`" for n in names])
