"""The piece table against plain slicing, and on odd inputs."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from callgrain.llm import middle
from callgrain.llm.queries import op12_middle


def plainly(key, text, seed=42):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, mid, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return len(units), "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


@settings(max_examples=400, deadline=None)
@given(st.integers(-5, 2000), st.text(st.sampled_from("ab é中🙂<PSM>\n\t \xa0"), max_size=40))
def test_piece_table_equals_slicing(key, text):
    made = middle.Arranged(str(key), text.encode())
    assert (made.units, made.form, *made.chars(), made.table.joined().decode()) == plainly(key, text)
    assert made.table.sha256() == hashlib.sha256(made.table.joined()).hexdigest()
    assert middle.restored(made.table.joined(), made.form).joined().decode() == text


def test_odd_documents_go_through_and_come_back(odd_docs, no_docs):
    made = middle.transform(odd_docs)
    assert set(odd_docs.columns) <= set(made.columns) and made.count() == odd_docs.count()
    for r in middle.restore(made).collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plainly(r["doc_id"], r["text"] or "")
        assert r["restored"] == (r["text"] or "")
    assert middle.restore(middle.transform(no_docs)).count() == 0 and middle.digests(no_docs).count() == 0


def test_result_columns_replace_those_of_the_input(spark):
    rows = spark.createDataFrame([(1, "a b c", 7, "x", [1])], "doc_id int, text string, form int, output string, kept array<int>")
    r = middle.transform(rows, rate=100).first()
    assert r["form"] in ("psm", "spm") and r["output"].startswith("<") and r["kept"] == [1]


def test_query_restores_every_text(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op12_middle(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, a, m, output = plainly(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, a, m)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
