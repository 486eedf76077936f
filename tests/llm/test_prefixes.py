"""Prefix tables against the library's merges, appended and edited, and on odd inputs."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from callgrain.llm import prefixes
from callgrain.llm.queries import BYTE_RANKS, op13_prefixes

LETTERS = "abcABC'stΣreİéÉ \n\t  \x85\xa0 \x1c12½.,!?#ñ中́<|endoftext|>🙂ßaaaa----"


def library(path, pattern=public_tokenizers.PATTERN):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return prefixes.Coder(open(BYTE_RANKS, "rb").read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def wanted():
    return library(BYTE_RANKS)


def ids(raw):
    return memoryview(raw).cast("I").tolist() if raw else []


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_are_those_of_the_library(name):
    path = public_tokenizers.path(name)
    own, lib, rng = prefixes.Coder(open(path, "rb").read(), public_tokenizers.PATTERN), library(path), random.Random(5)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += [" " + "".join(rng.choice("aeiostnrl") for _ in range(60)) for _ in range(500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x400, 0x3000), rng.randrange(0xAC00, 0xD000)])) for _ in range(30)) for _ in range(500)]
    for t in [*texts, "", "z" * 20_000, "=" * 20_000, "ab" * 10_000, " " * 5_000 + "x"]:
        got = ids(own.encode(t))
        assert got == lib.encode_ordinary(t)
        assert own.decode(got) == t.encode()


def test_a_vocabulary_with_ties_and_tokens_that_merging_misses(tmp_path):
    # abc can't be merged: bc comes before ab, and a with bc is no token; zq stands for a token of a whole match only
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"aa", b"ab", b"aaa", b"abcd", b"aab", b"xyz"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    own, lib, rng = prefixes.Coder(path.read_bytes(), r"\w+|\W+"), library(path, r"\w+|\W+"), random.Random(1)
    assert own.ranks.lone == {260, 262}
    for t in ["abcd", "xyz", "wxyz", "abcdx", "aaaa", "aaaaa", *("".join(rng.choice("aabcdxyz ") for _ in range(rng.randint(1, 20))) for _ in range(3000))]:
        assert ids(own.encode(t)) == lib.encode_ordinary(t), t


@settings(max_examples=300, deadline=None)
@given(data=st.data())
def test_appends_and_edits_equal_coding_anew(data, coder, wanted):
    text = data.draw(st.text(st.sampled_from(LETTERS), max_size=60))
    d = prefixes.Document(coder, text)
    for _ in range(4):
        start = data.draw(st.integers(0, len(d.text)))
        stop = data.draw(st.integers(start, min(len(d.text), start + 5)))
        new = data.draw(st.text(st.sampled_from(LETTERS), max_size=6))
        text = text[:start] + new + text[stop:]
        d.replace(start, stop, new)
        fresh = prefixes.Document(coder, text)
        assert (d.text, d.ends, d.last(), d.ids()) == (text, fresh.ends, fresh.last(), wanted.encode_ordinary(text))
    d.append("'re")
    assert d.ids() == wanted.encode_ordinary(text + "'re")


def test_an_edit_in_a_long_match_is_coded_only_nearby(coder):
    rng = random.Random(2)
    data = bytes(rng.choice(b"etaoinsrh") for _ in range(30_000))
    p = prefixes.Prefixes(coder.ranks, data)
    assert p.replace(9_000, 9_002, b"zzz") < 2_000
    assert p.last == prefixes.Prefixes(coder.ranks, data[:9_000] + b"zzz" + data[9_002:]).last
    p.append(b"ing")
    assert p.last == prefixes.Prefixes(coder.ranks, p.data).last


def test_odd_documents(spark, odd_docs, no_docs, wanted):
    coded = prefixes.decode(prefixes.encode(odd_docs, BYTE_RANKS, public_tokenizers.PATTERN), BYTE_RANKS, public_tokenizers.PATTERN)
    assert set(odd_docs.columns) <= set(coded.columns) and coded.count() == odd_docs.count()
    for r in coded.collect():
        assert r["ids"] == wanted.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert prefixes.digests(no_docs, BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_revised_tables(spark, wanted):
    rows = [(1, "I can't see the end of it", 8, 11, "will"), (2, None, None, None, "new text"), (3, "same", 99, 2, None), (4, "gone", 0, 4, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, start int, stop int, new string")
    out = prefixes.revise(prefixes.tabulate(docs, BYTE_RANKS, public_tokenizers.PATTERN), BYTE_RANKS, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[k]["text"] for k in (1, 2, 3, 4)] == ["I can't will the end of it", "new text", "same", ""]
    again = {r["doc_id"]: r for r in prefixes.tabulate(out, BYTE_RANKS, public_tokenizers.PATTERN).collect()}
    for k, r in got.items():
        assert r["ids"] == wanted.encode_ordinary(r["text"])
        assert (r["match_ends"], r["last_tokens"]) == (again[k]["match_ends"], again[k]["last_tokens"])


def test_query_agrees_with_the_library(spark, sf, wanted):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op13_prefixes(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        coded = wanted.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(coded) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, coded)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
