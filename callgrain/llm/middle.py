"""Fill-in-the-middle transformation on piece tables.

A document is a list of descriptors (buffer, start, stop) over immutable buffers: the bytes of its text and those of the
marks. A cut splits the descriptor that it falls into, an arrangement permutes descriptors and puts those of the marks
between them, and the inverse permutation brings the text back. Digests are fed descriptor by descriptor; only ``transform``
and ``restore``, whose results are texts, join them.

The units that a document is cut at are words with the white space before them, and white space at the end. Where it is cut,
whether it is rearranged and into which form depends on the decimal id alone. Null and empty texts, and texts in which a mark
stands already, stay plain. A null id counts as the empty string. Rows are independent of each other: repeated rows give
repeated results, an empty table an empty one. Texts of any length are worked on whole, one at a time. Result columns
that clash with columns of the input replace them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from callgrain.llm.common import SPACE

#: Marks of prefix, suffix and middle; hundredths of documents that are rearranged, and of those with the suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, RATE, SUFFIX_FIRST = 42, 50, 80
#: What each form writes: a mark, then the part of this number (0 prefix, 1 middle, 2 suffix).
FORMS = {
    "psm": [(PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)],
    "spm": [(SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)],
}
_MARKS = PREFIX + SUFFIX + MIDDLE
_MARK_AT = {m: _MARKS.index(m) for m in (PREFIX, SUFFIX, MIDDLE)}
_IS_SPACE = np.isin(np.arange(256), list(SPACE.encode()))
TEXT, MARKS = 0, 1


class PieceTable:
    """Descriptors over a text buffer and the buffer of the marks. Buffers never change."""

    def __init__(self, text: bytes) -> None:
        self.buffers = (memoryview(text), memoryview(_MARKS))
        self.pieces = [(TEXT, 0, len(text))]

    def cut(self, at: int) -> int:
        """Splits the first descriptor that reaches byte ``at`` of the document, and returns the number of descriptors before the cut."""
        passed = 0
        for k, (buffer, start, stop) in enumerate(self.pieces):
            if passed + stop - start >= at:
                middle = start + at - passed
                self.pieces[k : k + 1] = [(buffer, start, middle), (buffer, middle, stop)]
                return k + 1
            passed += stop - start
        raise IndexError(at)

    def mark(self, place: int, mark: bytes) -> None:
        """Puts a descriptor of a mark before the descriptor at ``place``."""
        at = _MARK_AT[mark]
        self.pieces.insert(place, (MARKS, at, at + len(mark)))

    def arrange(self, order: list[int]) -> None:
        """Descriptor ``order[k]`` becomes the k-th; those that aren't named leave."""
        self.pieces = [self.pieces[k] for k in order]

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, stop in self.pieces:
            yield self.buffers[buffer][start:stop]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def joined(self) -> bytes:
        return b"".join(self.stream())


def inverse(order: list[int]) -> list[int]:
    out = [0] * len(order)
    for k, x in enumerate(order):
        out[x] = k
    return out


def unit_ends(text: bytes) -> np.ndarray:
    """Where each unit ends: after each word, and at the end of trailing white space. White space is ASCII, so bytes will do."""
    space = _IS_SPACE[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(text)) if len(text) else ends


def draws(key: str | None, seed: int) -> list[int]:
    """Four 32-bit numbers from the decimal id."""
    digest = hashlib.sha256(f"{seed}:{key or ''}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


class Arranged:
    """A document after the transformation: its piece table, number of units, form, and where prefix and middle end."""

    def __init__(self, key: str | None, text: bytes, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> None:
        ends = unit_ends(text)
        self.text, self.table, self.units, self.form = text, PieceTable(text), len(ends), "plain"
        first, second, chance, kind = draws(key, seed)
        self.low, self.high = (int(ends[k - 1]) if k else 0 for k in sorted((first % (self.units + 1), second % (self.units + 1))))
        if not text or any(m in text for m in _MARK_AT) or chance % 100 >= rate:
            return
        self.form = "spm" if kind % 100 < suffix_first else "psm"
        self.table.cut(self.low)
        self.table.cut(self.high)
        self.table.arrange([part for _, part in FORMS[self.form]])
        for k, (mark, _) in reversed([*enumerate(FORMS[self.form])]):
            self.table.mark(k, mark)

    def chars(self) -> tuple[int | None, int | None]:
        """Code points of prefix and middle."""
        if self.form == "plain":
            return None, None
        begins = (np.frombuffer(self.text, np.uint8) & 0xC0) != 0x80
        return int(begins[: self.low].sum()), int(begins[self.low : self.high].sum())


def restored(output: bytes, form: str) -> PieceTable:
    """The piece table of the text that ``output`` was made from. A mark can't overlap the text beside it, as it begins with <, ends with > and holds neither between."""
    table = PieceTable(output)
    if form == "plain":
        return table
    at = 0
    for k, (mark, _) in enumerate(FORMS[form]):
        at = output.index(mark, at)
        if k:
            table.cut(at)
        at += len(mark)
        table.cut(at)
    table.arrange([1, 3, 5])
    table.arrange(inverse([part for _, part in FORMS[form]]))
    return table


_KINDS = {"long": (LongType(), pa.int64()), "string": (StringType(), pa.string())}


def _added(df: DataFrame, columns: list[str], added: dict[str, str], row: Callable[..., tuple], keep: list[str] | None = None) -> DataFrame:
    """The kept columns of the input (all of them) and those that ``row`` makes of the strings in ``columns``."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    given = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("kept"), *(F.col(f"`{c}`").cast("string").alias(f"a{k}") for k, c in enumerate(columns)))
    kinds = [_KINDS[t][1] for t in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple] = [row(*(x.as_py() for x in values)) for values in zip(*batch.columns[1:])]
            made = [pa.array(column, kind) for column, kind in zip(zip(*got) if got else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["kept", *added])

    schema = StructType([StructField("kept", given.schema["kept"].dataType), *(StructField(c, _KINDS[t][0]) for c, t in added.items())])
    return given.mapInArrow(run, schema).select(*(F.col("kept")[c].alias(c) for c in kept), *(F.col(f"`{c}`") for c in added))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", output: str = "output", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Adds the rearranged text, and n, form, prefix_chars and middle_chars (null where plain)."""

    def row(doc: str | None, value: str | None) -> tuple:
        made = Arranged(doc, (value or "").encode(), seed, rate, suffix_first)
        return made.table.joined().decode(), made.units, made.form, *made.chars()

    return _added(docs, [key, text], {output: "string", "n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long"}, row)


def restore(rows: DataFrame, output: str = "output", form: str = "form", text: str = "restored") -> DataFrame:
    """Adds the text before the transformation, from its result and the form alone."""
    return _added(rows, [output, form], {text: "string"}, lambda made, kind: (restored((made or "").encode(), kind or "plain").joined().decode(),))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The id, what ``transform`` adds but for the text, and digests: output_sha256 and, of the text rebuilt from the output, restored_sha256."""

    def row(doc: str | None, value: str | None) -> tuple:
        made = Arranged(doc, (value or "").encode(), seed, rate, suffix_first)
        back = restored(made.table.joined(), made.form)
        return made.units, made.form, *made.chars(), made.table.sha256(), back.sha256()

    added = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output_sha256": "string", "restored_sha256": "string"}
    return _added(docs, [key, text], added, row, [key])
