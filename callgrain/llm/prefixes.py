"""Byte-level BPE by dynamic programming over prefixes, with rank files.

A text is parted by a pattern; each match is coded by itself. For each prefix of a match the table stores the one token that
its coding ends with. The coding of a prefix is that of the prefix before its last token, and the token; what follows never
changes it. So more bytes are appended exactly, by going on where the table ends, and after an edit only the prefixes
near it are coded anew, until the table falls into step with the old one.

A token may follow another if merging their bytes by rank gives just these two. Merges happen in the order of their ranks, so
a token's rank is the time at which it comes to be: the two tokens are taken apart again, the later part first, and at no
time may the parts that meet have a merge that is due before the next one of either side. Only tokens that merging their own
bytes gives are used; a token of another kind stands only where it is a whole match.

Null and empty texts have no ids and decode to the empty text. A match of any length takes time in proportion to its length.
Rows are independent: repeated rows give repeated results, an empty table an empty one. Columns named as the results are
replaced.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callgrain.llm.common import Kept, arrays

#: White space as the pattern knows it, in full.
BLANK = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: How far beyond its end a match depends on the text: the longest contraction less its first letter, and one letter looked ahead.
AHEAD = 2
NEVER = 1 << 30


class Ranks:
    """A rank file: the splits of its tokens, which tokens may follow which, and an automaton that finds all tokens ending at a byte."""

    def __init__(self, lines: bytes, most_pairs: int = 400_000) -> None:
        self.ids: dict[bytes, int] = {}
        for line in lines.splitlines():
            token, rank = line.split()
            self.ids[base64.b64decode(token)] = int(rank)
        self.size = max(self.ids.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in self.ids.items():
            self.bytes_of[rank] = token
        self.length = [len(t) for t in self.bytes_of]
        self.longest = max(self.length)
        self.left, self.right = [-1] * self.size, [-1] * self.size
        self.merged: dict[int, int] = {}
        self.lone: set[int] = set()  # tokens that merging their own bytes doesn't give
        self._split()
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            if rank not in self.lone:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.known, self.older, self.most_pairs = {}, {}, most_pairs

    def _split(self) -> None:
        """The last merge of each token, in the order of ranks: the one pair of earlier tokens that stay apart until then."""
        for rank in sorted(self.ids.values()):
            token = self.bytes_of[rank]
            if len(token) == 1:
                continue
            for k in range(1, len(token)):
                a, b = self.ids.get(token[:k], NEVER), self.ids.get(token[k:], NEVER)
                if a < rank and b < rank and a not in self.lone and b not in self.lone and self.stay_apart(a, b, rank, rank):
                    self.left[rank], self.right[rank] = a, b
                    self.merged[a << 32 | b] = rank
                    break
            else:
                self.lone.add(rank)

    def stay_apart(self, a: int, b: int, a_ends: int = NEVER, b_ends: int = NEVER) -> bool:
        """Whether no merge joins ``a`` and ``b``, or parts of them that meet, before ``a_ends`` and ``b_ends``, when each is merged on.

        Of equal merges the left one comes first: one that is due with the next merge of the left side comes too late, one
        that is due with that of the right side does not.
        """
        length, left, right, merge_of = self.length, self.left, self.right, self.merged.get
        while True:
            merge = merge_of(a << 32 | b, NEVER)
            if merge < a_ends and merge <= b_ends and merge != NEVER:
                return False
            if length[a] > 1 and (a > b or length[b] == 1):
                a, a_ends = right[a], a
            elif length[b] > 1:
                b, b_ends = left[b], b
            else:
                return True

    def follows(self, a: int, b: int) -> bool:
        """``stay_apart`` of whole tokens, remembered for the pairs asked for lately."""
        key = a << 32 | b
        answer = self.known.get(key)
        if answer is None:
            answer = self.older.get(key)
            if answer is None:
                answer = self.stay_apart(a, b)
            if len(self.known) >= self.most_pairs:
                self.known, self.older = {}, self.known
            self.known[key] = answer
        return answer


class Prefixes:
    """The last token of each prefix of a run of bytes."""

    def __init__(self, ranks: Ranks, data: bytes = b"") -> None:
        self.ranks, self.data, self.last = ranks, b"", [-1]
        if data:
            self.append(data)

    def append(self, more: bytes) -> None:
        """Goes on for the bytes that follow. What was stored stays as it is."""
        first = len(self.data)
        self.data += more
        self._fill(first, len(self.data))

    def _fill(self, first: int, stop: int) -> None:
        """Finds the last token of each prefix from ``first`` + 1 to ``stop`` bytes; those of shorter ones are known."""
        ranks, last = self.ranks, self.last
        # a token that ends behind ``first`` began at most so many bytes before
        back = max(0, first - ranks.longest + 1)
        last.extend([-1] * (stop + 1 - len(last)))
        length, known, follows = ranks.length, ranks.known.get, ranks.follows
        for at, token in ranks.automaton.iter(self.data[back:stop].decode("latin-1")):
            at += back + 1
            if at > first and last[at] < 0:
                start = at - length[token]
                if start:
                    before = last[start]
                    fits = known(before << 32 | token)
                    if not (follows(before, token) if fits is None else fits):
                        continue
                last[at] = token

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` in place of the bytes from ``start`` to ``stop``, and returns how many prefixes were coded anew.

        A last token depends on the bytes and last tokens as far back as a token is long. So once that many prefixes beyond
        the new bytes end as they did before, all later ones do.
        """
        old, longest = self.last, self.ranks.longest
        shift = len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        done, total = start, len(self.data)
        while done < total:
            ahead = min(total, max(done, start + len(new)) + 2 * longest)
            self._fill(done, ahead)
            done = ahead
            # bytes alike as far back as a token is long, and as many last tokens
            if done - longest >= start + len(new) and self.last[done - longest : done + 1] == old[done - longest - shift : done + 1 - shift]:
                self.last += old[done + 1 - shift :]
                break
        return done - start

    def ids(self) -> list[int]:
        """The tokens, read back from the end. A run of bytes that is a token itself is this token."""
        whole = self.ranks.ids.get(self.data)
        if whole is not None:
            return [whole]
        out, at, last, length = [], len(self.data), self.last, self.ranks.length
        while at:
            token = last[at]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out


class Coder:
    """Ids of texts and texts of ids. A match of the pattern holds no border of white space and the rest but that after one leading space."""

    def __init__(self, lines: bytes, pattern: str) -> None:
        self.ranks = Ranks(lines)
        self.pattern = regex.compile(pattern)
        self.matches = self.pattern.findall
        self.chunks = re.compile(rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+").findall
        self.match_kept = Kept(self.match_ids)
        self.chunk_kept = Kept(self.chunk_ids, most=150_000)

    def match_ids(self, match: str) -> bytes:
        """Little-endian 32-bit ids of one match."""
        data = match.encode()
        whole = self.ranks.ids.get(data)  # of which no table is needed
        return array("I", Prefixes(self.ranks, data).ids() if whole is None else [whole]).tobytes()

    def chunk_ids(self, chunk: str) -> bytes:
        return b"".join(map(self.match_kept.__getitem__, self.matches(chunk)))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.chunk_kept.__getitem__, self.chunks(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, ids))


class Document:
    """A text, the ends of its matches and the prefix table of each, kept up to date under edits."""

    def __init__(self, coder: Coder, text: str = "", ends: list[int] | None = None, last: list[int] | None = None) -> None:
        self.coder, self.text, self.ends, self.parts = coder, text, [], []
        if ends is None:
            for m in coder.pattern.finditer(text):
                self.ends.append(m.end())
                self.parts.append(Prefixes(coder.ranks, m.group().encode()))
            return
        self.ends, at, used = [*ends], 0, 0
        for end in ends:  # a stored state
            part = Prefixes(coder.ranks)
            part.data = text[at:end].encode()
            part.last += last[used : used + len(part.data)]
            self.parts.append(part)
            at, used = end, used + len(part.data)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Puts ``new`` in place of the characters from ``start`` to ``stop``.

        A match depends on the text from its start to ``AHEAD`` beyond its end. So matches that end so far before the edit
        stay, and from the first border beyond it that was one before all later ones do.
        """
        kept = bisect.bisect_right(self.ends, start - AHEAD)
        shift = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        at = self.ends[kept - 1] if kept else 0
        ends, parts, rest = [], [], len(self.ends)
        for m in self.coder.pattern.finditer(self.text, at):
            data, own = m.group().encode(), Prefixes(self.coder.ranks)
            if not ends and kept < len(self.parts):  # it began here before: what it has in common with the old one is known
                own = self.parts[kept]
                common = len(os.path.commonprefix([own.data, data]))
                own.replace(common, len(own.data), data[common:])
            else:
                own.append(data)
            ends.append(m.end())
            parts.append(own)
            place = bisect.bisect_left(self.ends, m.end() - shift)
            if m.end() >= start + len(new) and place < len(self.ends) and self.ends[place] == m.end() - shift and self.ends[place] >= stop:
                rest = place + 1
                break
        self.ends[kept:] = ends + [x + shift for x in self.ends[rest:]]
        self.parts[kept:] = parts + self.parts[rest:]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return [i for part in self.parts for i in part.ids()]

    def last(self) -> list[int]:
        """The last token of each prefix of each match, in a row."""
        return [i for part in self.parts for i in part.last[1:]]


_LOADED: dict[int, Coder] = {}


def _loaded(given: tuple[bytes, str]) -> Coder:
    """One coder for each worker process, rank file and pattern."""
    key = hash(given)
    if key not in _LOADED:
        _LOADED[key] = Coder(*given)
    return _LOADED[key]


def _mapped(df: DataFrame, path: str, pattern: str, columns: list[str], added: dict[str, str], fn: Callable[[Coder, pa.RecordBatch], list[pa.Array]], keep: list[str] | None = None, rows: int = 500) -> DataFrame:
    """The kept columns of the input (all) and those that ``fn`` makes of ``columns``, ``rows`` rows at a time. The rank file, about a MB, is read on the driver."""
    with open(path, "rb") as f:
        given = df.sparkSession.sparkContext.broadcast((f.read(), pattern))
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("kept"), *(F.col(f"`{c}`").alias(f"a{k}") for k, c in enumerate(columns)))
    schema = StructType([packed.schema["kept"], *(StructType.fromDDL(f"`{c}` {t}")[0] for c, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(given.value)
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), *fn(coder, part)], names=["kept", *added])

    return packed.mapInArrow(run, schema).select(*(F.col("kept")[c].alias(c) for c in kept), *(F.col(f"`{c}`") for c in added))


def _lists(got: list[bytes]) -> pa.Array:
    return arrays(np.frombuffer(b"".join(got), "<i4"), np.array([len(x) // 4 for x in got], np.int32))


def _ints(values: list[list[int]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int32()))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each text. ``path``: a file of tokens in base64 and their ranks; ``pattern`` parts the texts."""
    return _mapped(df, path, pattern, [text], {ids: "array<int>"}, lambda c, part: [_lists([c.encode(x.as_py() or "") for x in part.column(1)])])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Adds the bytes of each list of ids; a list cut anywhere gives bytes, not always a text."""
    return _mapped(df, path, pattern, [ids], {data: "binary"}, lambda c, part: [pa.array([c.decode(x.as_py() or []) for x in part.column(1)], pa.binary())])


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, n_tokens, ids_sha256 (of the decimal ids, parted by spaces) and decoded_sha256 (of the bytes the ids decode to), in one pass."""

    def both(c: Coder, part: pa.RecordBatch) -> list[pa.Array]:
        n, coded, decoded = [], [], []
        for x in part.column(1):
            ids = memoryview(c.encode(x.as_py() or "")).cast("I").tolist()
            n.append(len(ids))
            coded.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]

    return _mapped(df, path, pattern, [text], {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, both, [key])


def tabulate(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds match_ends and last_tokens, the state that ``revise`` goes on from."""

    def state(c: Coder, part: pa.RecordBatch) -> list[pa.Array]:
        made = [Document(c, x.as_py() or "") for x in part.column(1)]
        return [_ints([d.ends for d in made]), _ints([d.last() for d in made])]

    return _mapped(df, path, pattern, [text], {"match_ends": "array<int>", "last_tokens": "array<int>"}, state)


def revise(df: DataFrame, path: str, pattern: str, text: str = "text", start: str = "start", stop: str = "stop", new: str = "new", ids: str = "ids") -> DataFrame:
    """Puts ``new`` in place of the characters from ``start`` to ``stop`` of each text (0-based; null: at its end) and adds the ids.

    ``match_ends`` and ``last_tokens``, as ``tabulate`` made them, are kept up to date; only matches near the edit are coded anew.
    Places beyond the text count as its end.
    """

    def edited(c: Coder, part: pa.RecordBatch) -> list[pa.Array]:
        made = []
        for old, a, b, more, ends, last in zip(*(x.to_pylist() for x in part.columns[1:])):
            d = Document(c, old or "", ends or [], last or [])
            a = len(d.text) if a is None else min(max(a, 0), len(d.text))
            d.replace(a, len(d.text) if b is None else min(max(b, a), len(d.text)), more or "")
            made.append(d)
        return [pa.array([d.text for d in made], pa.string()), _ints([d.ends for d in made]), _ints([d.last() for d in made]), _ints([d.ids() for d in made])]

    added = {text: "string", "match_ends": "array<int>", "last_tokens": "array<int>", ids: "array<int>"}
    return _mapped(df, path, pattern, [text, start, stop, new, "match_ends", "last_tokens"], added, edited)
