"""WARC bundles, main text, vectors and the pipeline."""

import collections
import hashlib
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from callgrain.llm import ann, html, warc
from callgrain.llm.packing import ids_crc32
from callgrain.llm.queries import op4_ann, op8_html
from tests.llm.test_text_operators import check_pieces, plain_components, plain_repeats

PAGES = "page_id long, url string, html string, record string, digest string, text string"


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>" + "x" * 1000 + "</p>", "<p>" + "é" * 40_000 + "</p>"
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, big), (3, "http://c/", big), (4, "d", None), (5, "e", ""), (6, "f", "small"), (7, "g", "small"),
            (None, "h", big), (8, "i", other), (9, "j", other), (10, "k", "WARC/1.1\r\n\r\n" * 300)]
    return spark.createDataFrame([(*r, "r", "d", "t") for r in rows], PAGES)


def test_bundles_hold_all_records(spark, pages, tmp_path):
    made = warc.save(warc.bundles(warc.with_roles(pages), frame_bytes=3000, bundle_bytes=20_000), str(tmp_path / "bundles"))
    got = collections.Counter((r["record"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_records(made).collect())
    assert got == collections.Counter({
        ("1", "revisit", "3", 1007): 1, ("2", "revisit", "3", 1007): 1, ("3", "response", None, 1007): 2, ("4", "response", None, 0): 1, ("5", "response", None, 0): 1,
        ("6", "response", None, 5): 1, ("7", "response", None, 5): 1, (None, "response", None, 1007): 1, ("8", "revisit", "9", 80_007): 1, ("9", "response", None, 80_007): 1,
        ("10", "response", None, 3600): 1,
    })
    assert warc.locate(made, "9").decode() == "<p>" + "é" * 40_000 + "</p>" and warc.locate(made, "8") == b"" and warc.locate(made, "77") is None
    for r in made.collect():
        data = bytes(r["data"])
        frames = [warc.read_frame(data, e) for e in warc.seek_table(data)]
        # any Zstandard reader can read a bundle as one stream
        assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(frames)
        for x in r["index"]:
            place = frames[x["frame"]][x["place"] :]
            assert place.startswith(b"WARC/1.1\r\n") and f"<urn:page:{x['record'] or ''}>".encode() in place[:400]
    for r in warc.read_records(made).where("record_type = 'response'").collect():
        assert r["payload_digest"] == hashlib.sha1(bytes(r["payload"])).hexdigest()
    assert warc.read_records(warc.bundles(warc.with_roles(pages.limit(0)))).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("just text &amp; no mark-up", "just text & no mark-up"), ("<article><p>a  b\n c<br>d</p><p> </p><p>E.</p></article>", "a b c d\n\nE."),
        ("<nav>menu</nav><header>top</header><main><h1>T</h1><p>x</p><aside>s</aside><p>y</p></main><footer>f</footer>", "T\n\nx\n\ny"),
        ("<article><p>one<script>var x = '</p>';</script></p><style>p{}</style><form><p>mail</p></form><div class='ad'>buy</div><p>two</p>", "one\n\ntwo"),
        ("<article><p>text</p><section id=\"comments\"><p>first!</p></section></article><div class='cookie-notice'>ok?</div>", "text"),
        ("<article><p>1 < 2 <i>and</i> <b>3</b></p><!-- <p>no</p> --><p title='a>b'>&#233;&nbsp;x</p><ul><li>l</li></ul>", "1 < 2 and 3\n\né x\n\nl"),
        ("<article><p>broken <b>bold<p>next <article>", "broken bold\n\nnext"), ("<p title=\"never closed", '<p title="never closed'),
        ("<ul><li>a</li><li>b</li></ul><h1>Title</h1><p>" + "word " * 30 + "</p>", "Title\n\n" + "word " * 29 + "word"),
        ("<ul><li>a</li><li>b</li><li>c</li><li>d</li></ul><p>" + "word " * 30 + "</p><p>End.</p><p>" + "more " * 30 + "</p><p>x</p><p>y</p><p>z</p><p>w</p>",
         "word " * 29 + "word\n\nEnd.\n\n" + "more " * 29 + "more"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page or "") == want


def test_main_text_is_linear_and_total():
    assert html.main_text("<div>" * 50_000 + "deep") == "deep"
    assert html.main_text("<p a='" * 5_000).startswith("<p a=")
    assert len(html.main_text("<article><p>" + "long " * 200_000)) == 5 * 200_000 - 1


def test_ends_that_are_left_out():
    body = "<article><p>Body.</p></article>"
    for many in (3, 300, 20_000):
        assert html.main_text("<nav><ul>" + "<li>item" * many + "</ul></nav>" + body) == "Body."
        assert html.main_text("<nav>" + "<div>item" * many + "</nav>" + body) == "Body."
        assert html.main_text("<nav><table>" + "<tr><td>a<td>b" * many + "</table></nav>" + body) == "Body."
        assert html.main_text("<article><dl>" + "<dt>t<dd>d" * many + "</dl></article><footer>no</footer>") == "\n\n".join(["t", "d"] * many)
    assert html.main_text("<article><ul><li class=ad>buy<li>one<ul><li>two</ul><li>three</ul><table><tr><td><table><tr><td>in</table>out</table></article>") == "one\n\ntwo\n\nthree\n\nin\n\nout"


def test_wrappers_of_the_article_are_read():
    article, comments = "<article><p>Body.</p></article>", "<div id='comments'><p>first!</p></div>"
    for attributes in ("class='overflow-hidden'", "aria-hidden=false", "class='layout has-sidebar'", "class=no-sidebar", "class='share-price'"):
        assert html.main_text(f"<article><div {attributes}><p>Inner.</p></div><p>Body.</p></article>{comments}") == "Inner.\n\nBody."
        assert html.main_text(f"<div {attributes}><div class='widget'>{article}</div></div>{comments}") == "Body."
    assert html.main_text("<form class=page><main><p>Body.</p></main></form>") == "Body."
    for attributes in ("hidden", "aria-hidden='true'", "style='display: none'", "class='site-nav'", "id=ad-12", "class='x social-links'", "aria-label='Main navigation'", "role=navigation"):
        assert html.main_text(f"<article><div {attributes}><p>no</p></div><p>Body.</p></article>") == "Body."
    assert html.main_text("<article><p>Body.</p><div class=comments><article><p>first!</p></article></div></article>") == "Body."


def test_short_lines_of_the_text_are_kept():
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>Topic number {k}</a></li>" for k in range(6)) + "</ul>"
    paragraphs = ["Oslo, 3 May", "He said no.", "long " * 30 + "end", "Why?", "more " * 40 + "end", "He left.", "two eggs", "flour"]
    page = menu + "".join(f"<p>{x}</p>" for x in paragraphs[:6]) + "<ul>" + "".join(f"<li>{x}</li>" for x in paragraphs[6:]) + "</ul>" + menu
    assert html.main_text(page) == "\n\n".join(paragraphs)
    verse = [f"line {k} of a verse la" + "la" * (k % 8) for k in range(50)]
    for extra in ([], ["a longer note of the editor " * 5 + "end"]):
        assert html.main_text("".join(f"<p>{x}</p>" for x in verse + extra)) == "\n\n".join(verse + extra)


def test_marked_pages_have_a_surge_and_dive_too():
    body = [f"Paragraph {k} of the body, " + "long " * 30 + "end." for k in range(8)]
    page = "<div>" + "".join(f"<p>{x}</p>" for x in body) + "</div>"
    assert html.main_text(page + "<article><a href='/x'>A card</a></article>") == "\n\n".join(body)
    assert html.main_text("<article><p>A card.</p></article>" + page).endswith("\n\n".join(body))
    assert html.main_text("<p>A short line outside of it.</p><article><p>x</p>" + page + "<p>y</p></article><p>Another one.</p>") == "\n\n".join(["x", *body, "y"])


def test_main_text_keeps_ties_and_columns(spark, sf, pages):
    got = html.extract(pages)
    assert got.count() == pages.count() and got.columns.count("text") == 1 and html.extract(pages.limit(0)).count() == 0
    assert op8_html(spark, sf).where("n_chars > 0").count() == spark.read.parquet(f"{sf}/pages.parquet").count()


def nearest(rows, query, k=5):
    own = np.array(query[1], float)
    best = {}
    for i, v in rows:
        if i != query[0]:
            v = np.array(v, float)
            s = float((v * own).sum() / (np.sqrt((v * v).sum()) * np.sqrt((own * own).sum())))
            best[i] = max(s, best.get(i, -2))
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_recall_of_the_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = collections.defaultdict(list)
    for r in op4_ann(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    asked = [r for r in rows if r[0] % 50 == 0]
    hit = sum(len({i for i, _ in nearest(rows, q)} & {i for i, _ in got[q[0]]}) for q in asked)
    assert hit >= 0.9 * 5 * len(asked) and all(len(got[q[0]]) == 5 for q in asked)


def test_vectors_that_take_no_part_and_ties(spark):
    rng = np.random.default_rng(3)
    same = rng.normal(size=16).tolist()
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)] + [(1000 + i, same) for i in range(400)] + [(1005, same), (2000, [2 * x for x in same])]
    odd = [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] * 16), (3004, [float("inf")] * 16), (3005, [1.0] * 3), (3006, []), (None, same)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1)).withColumn("rank", F.lit(1))
    asked = df.where("vec_id IN (1005, 1399, 7, 2000, 3000, 3001, 3005) OR vec_id IS NULL")
    got = collections.defaultdict(list)
    for r in ann.search(df, asked).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {1005, 1399, 7, 2000}
    assert [x[1] for x in got[1399]] == [1000, 1001, 1002, 1003, 1004] and 1005 not in {x[1] for x in got[1005]}
    for q in (1005, 1399, 7):
        want = nearest(rows, next(r for r in rows if r[0] == q))
        assert [x[0] for x in got[q]] == [1, 2, 3, 4, 5] and [x[2] for x in got[q]] == pytest.approx([s for _, s in want])
    few = ann.search(df.where("vec_id < 3"), df.where("vec_id = 1")).collect()
    assert sorted(r["vec_id"] for r in few) == [0, 2]
    assert ann.search(df.limit(0), asked).count() == 0 and ann.search(df, asked.limit(0)).count() == 0


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(9)
    code = rng.integers(0, 256, (3000, 4), dtype=np.uint8)
    tables = ann.Tables(code)
    for radius in (0, 5, 9, 32):
        query = code[radius]
        want = np.flatnonzero(np.bitwise_count(code ^ query).sum(1) <= radius)
        assert (tables.within(query, radius) == want).all()


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(80)
    rows = [(i, text(rng.randint(30, 300)), "en") for i in range(160)]
    rows += [(200 + i, rows[i][1] + " tail", "en") for i in range(0, 20)] + [(300 + i, rows[i][1], "en") for i in range(5)]
    rows += [(400 + i, text(100) + " " + passage + " é " + text(100), "en") for i in range(12)]
    junk = [(500 + i, " ".join(w + "###" for w in text(60).split()), "en") for i in range(15)] + [(600, "too short", "en"), (601, None, "en"), (602, (text(9) + " ") * 30, "en")]
    docs = spark.createDataFrame([(*r, "src", 0) for r in rows + junk], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], 1, 0) for r in rows[:170]] + [(r[0], 0, 0) for r in junk[:8]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    seen = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == docs.columns
        seen.write.parquet(str(tmp_path / name))
        seen = spark.read.parquet(str(tmp_path / name))
        if name == "quality":
            assert {r["doc_id"] for r in seen.collect()} == {r[0] for r in rows}
            expected = [(r[0], r[1]) for r in rows]
        elif name == "near_duplicates":
            kept = {k for k, _, _, keep in plain_components(expected) if keep}
            expected = [r for r in expected if r[0] in kept]
            assert sorted((r["doc_id"], r["text"]) for r in seen.collect()) == sorted(expected)
        else:
            want = {k: t.decode(errors="ignore") for k, _, t in plain_repeats([(k, t.encode()) for k, t in expected])}
            got = {r["doc_id"]: r["text"] for r in seen.collect()}
            assert got == want and all(passage not in t for t in got.values()) and all(r["n_chars"] == len(r["text"]) for r in seen.collect())
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    check_pieces(pieces.withColumn("ids_crc32", ids_crc32(F.col("ids"))).collect(), got)
