"""Byte-pair encoding and decoding with given vocabularies.

A text is parted into words; each different word is merged once and kept. Merging holds the symbols in a doubly linked
list and the possible merges in a priority queue by rank. A queue entry whose two symbols have changed meanwhile is
stale and is skipped. Decoding joins the strings of the vocabulary.

Null and empty texts have no ids and decode to the empty text. A word of any length is merged in n log n steps. Rows are
independent: repeated rows give repeated results, an empty table an empty one. Result columns that clash with columns of
the input replace them.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from callgrain.llm.common import Kept, arrays

#: White space as the tokenizers' patterns know it, and the patterns that part words.
BLANK = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable in Latin-1, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Encoder:
    """Reads a tokenizer file. ``pieces`` parts a text, ``ids_of`` gives the ids of one piece."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.whole_words = spec.get("normalizer") is not None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.joiner = "" if spec.get("decoder") else " "
        self.byte_level = spec.get("decoder") is not None
        self.letters = byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}
        self.rank: dict[int, int] = {}
        self.left, self.right, self.new = [], [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.vocab[a] << 20 | self.vocab[b]] = len(self.new)
            self.left.append(self.vocab[a])
            self.right.append(self.vocab[b])
            self.new.append(self.vocab[a + b])
        self.symbols = [self.vocab[c] for c in self.letters]
        self.last_symbols = [self.vocab[c + self.end] for c in self.letters]
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        chunk = rf"[^{BLANK}]+" if self.whole_words else rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
        self.chunks = re.compile(chunk).findall
        self.parts = regex.compile(WORD_PATTERN if self.whole_words else BYTE_PATTERN).findall
        self.part_ids = Kept(self.merged)

    def merged(self, part: str) -> bytes:
        """Little-endian 32-bit ids of one word: the merge of least rank first, the leftmost of equal rank."""
        raw = part.encode()
        symbols = self.symbols
        symbol = [symbols[b] for b in raw]
        symbol[-1] = self.last_symbols[raw[-1]]
        last = len(symbol) - 1
        rank_of, left, right = self.rank.get, self.left, self.right
        # an entry is the rank of a merge and the place of its left symbol
        queue = [r << 32 | i for i in range(last) if (r := rank_of(symbol[i] << 20 | symbol[i + 1])) is not None]
        heapq.heapify(queue)
        after, before = [*range(1, last + 1), -1], [*range(-1, last)]
        while queue:
            entry = heapq.heappop(queue)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            if symbol[i] != left[r] or (j := after[i]) < 0 or symbol[j] != right[r]:
                continue  # stale
            new = symbol[i] = self.new[r]
            symbol[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of(new << 20 | symbol[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank_of(symbol[h] << 20 | new)) is not None:
                heapq.heappush(queue, r << 32 | h)
        return np.array([s for s in symbol if s >= 0], "<u4").tobytes()

    def chunk_ids(self, chunk: str) -> bytes:
        """Little-endian 32-bit ids of a stretch between blanks."""
        return b"".join(map(self.part_ids.__getitem__, self.parts(chunk)))

    def kept_chunks(self) -> Kept:
        return Kept(self.chunk_ids, most=150_000)

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        if self.marks is None or "<|" not in text:
            yield False, text
            return
        for k, x in enumerate(self.marks.split(text)):
            yield k % 2 == 1, x

    def encode(self, text: str, known: Kept) -> bytes:
        out = []
        for special, x in self.segments(text):
            if special:
                out.append(np.array([self.special[x]], "<u4").tobytes())
                continue
            if self.whole_words:
                # one letter at a time has no final form of sigma
                x = unicodedata.normalize("NFC", x).replace("Σ", "σ").lower()
            out.append(b"".join(map(known.__getitem__, self.chunks(x))))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.joiner.join(map(self.strings.__getitem__, ids))
        if not self.byte_level:
            return text
        out = []
        for special, x in self.segments(text):
            out.append(x.encode() if special else b"".join(bytes([self.bytes_of[c]]) for c in x))
        return b"".join(out).decode(errors="replace")


_LOADED: dict[int, tuple[Encoder, Kept]] = {}


def loaded(spec: str) -> tuple[Encoder, Kept]:
    """One encoder for each worker process and tokenizer file."""
    key = hash(spec)
    if key not in _LOADED:
        encoder = Encoder(spec)
        _LOADED[key] = (encoder, encoder.kept_chunks())
    return _LOADED[key]


def encoded(column: pa.Array, encoder: Encoder, known: Kept) -> list[bytes]:
    return [encoder.encode(x.as_py() or "", known) for x in column]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _mapped(df: DataFrame, path: str, added: dict[str, str], fn: Callable[[pa.RecordBatch, Encoder, Kept], list[pa.Array]], rows: int = 500) -> DataFrame:
    """The columns of the input and those that ``fn`` makes of ``rows`` rows at a time.

    The tokenizer file is read on the driver, once, and is a few MB.
    """
    spec = df.sparkSession.sparkContext.broadcast(_read(path))
    kept = [c for c in df.columns if c not in added]
    schema = StructType([*(df.schema[c] for c in kept), *(StructType.fromDDL(f"`{c}` {t}")[0] for c, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = loaded(spec.value)
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *fn(part, encoder, known)], names=[*kept, *added])

    return df.mapInArrow(run, schema)


def _ids(got: list[bytes]) -> pa.Array:
    return arrays(np.frombuffer(b"".join(got), "<u4").astype(np.int32), np.array([len(x) // 4 for x in got], np.int32))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each text. ``path``: a tokenizer file; special tokens are taken only where they stand in the text."""
    return _mapped(df, path, {ids: "array<int>"}, lambda part, e, known: [_ids(encoded(part.column(text), e, known))])


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of each list of ids."""
    return _mapped(df, path, {text: "string"}, lambda part, e, _: [pa.array((e.decode(x or []) for x in part.column(ids).to_pylist()), pa.string())])


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids of each text and what they decode to, in one pass."""

    def both(part: pa.RecordBatch, e: Encoder, known: Kept) -> list[pa.Array]:
        got = encoded(part.column(text), e, known)
        return [_ids(got), pa.array((e.decode(np.frombuffer(x, "<u4").tolist()) for x in got), pa.string())]

    return _mapped(df, path, {ids: "array<int>", decoded: "string"}, both)
