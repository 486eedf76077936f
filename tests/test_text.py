"""Redaction, number reading, error rates and grounding on hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from callgrain.functions import redaction as R
from callgrain.functions import spoken as S
from callgrain.functions.register import register
from callgrain.operators import grounding as G


def one_column(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def test_redaction_cases(spark):
    cases = {
        "mail me at a.b+c@mail.example.org now": "mail me at [REDACTED_EMAIL] now",
        "card 4111 1111 1111 1111 thanks": "card [REDACTED_CARD]thanks",
        "card 4111111111111111": "card [REDACTED_CARD]",
        "ssn 123-45-6789.": "ssn [REDACTED_SSN].",
        "call +91 98765 43210 today": "call [REDACTED_PHONE] today",
        "call (415) 5550132 today": "call [REDACTED_PHONE] today",
        "call 415 5550132 today": "call [REDACTED_PHONE] today",
        "order 20759. 20759 again": "order 20759. 20759 again",
        "order 48213 amount 4999": "order 48213 amount 4999",
        "four one five five five five zero one three two": "[REDACTED_NUMBER]",
        "one two three": "one two three",
        "1234567890123456": "[REDACTED_PHONE]",
        "été 415 555 0132 à côté": "été [REDACTED_PHONE] à côté",
    }
    df = one_column(spark, list(cases)).select("i", R.redact("t").alias("r")).orderBy("i")
    assert [r.r for r in df.collect()] == list(cases.values())


def test_redaction_is_idempotent_and_leaves_nothing(spark):
    texts = ["a@b.co and 415 555 0132 and 123-45-6789", "pay 5500 0000 0000 0004 or 5500000000000004", "zero one two three four five six seven eight nine", "plain"]
    once = one_column(spark, texts).select("i", R.redact("t").alias("t"))
    twice = once.select("i", R.redact("t").alias("t"))
    assert {r.i: r.t for r in once.collect()} == {r.i: r.t for r in twice.collect()}
    left = R.audit(once.withColumn("all", F.lit(1)), "t", ["all"]).collect()[0]
    assert sum(left[f"{k}_n"] for k in R.KINDS) == 0


def test_strict_phone_spares_dotted_quads(spark):
    df = one_column(spark, ["host 192.168.100.200 down"])
    loose, strict = df.select(R.redact("t").alias("a"), R.redact("t", strict_phone=True).alias("b")).collect()[0]
    assert loose == "host [REDACTED_PHONE] down" and strict == "host 192.168.100.200 down"


def test_deep_redaction_keeps_keys_and_numbers(spark):
    df = spark.sql("SELECT named_struct('a@b.co', array(named_struct('x', 'me a@b.co', 'n', 5)), 'm', map('k@k.co', 'z@z.co'), 'none', CAST(NULL AS STRING)) AS doc")
    doc = R.redact_deep(df, "doc").collect()[0].doc.asDict(recursive=True)
    assert doc == {"a@b.co": [{"x": "me [REDACTED_EMAIL]", "n": 5}], "m": {"k@k.co": "[REDACTED_EMAIL]"}, "none": None}


@pytest.mark.parametrize("text, tokens", [
    ("eight fifty", ["8", "50"]),
    ("twenty two ninety nine", ["22", "99"]),
    ("forty-seven ninety-nine", ["47", "99"]),
    ("4 8 2 1 3", ["48213"]),
    ("four eight two one three", ["48213"]),
    ("3 8 5 2 0. 3 8 5 2 0.", ["38520", "38520"]),
    ("one hundred and five", ["1005"]),
    ("one hundred twenty", ["120"]),
    ("$1,234 uh dollars", ["1234"]),
    ("oh no", ["oh", "no"]),
    ("the fifth of march", ["the", "5th", "of", "march"]),
    ("um, it's fine", ["it's", "fine"]),
])
def test_spoken_tokens(text, tokens):
    assert S.spoken_tokens(text) == tokens


def _traced(r, h):
    n, m = len(r), len(h)
    d = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (r[i - 1] != h[j - 1]))
    i, j, sub, dele, ins = n, m, 0, 0, 0
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (r[i - 1] != h[j - 1]):
            sub, i, j = sub + (r[i - 1] != h[j - 1]), i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            dele, i = dele + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return d[n][m], n, sub, dele, ins


def test_edit_parts_equal_full_backtrace():
    rng = random.Random(3)
    for _ in range(2000):
        r, h = ([rng.choice("abcd") for _ in range(rng.randint(0, 10))] for _ in range(2))
        got = S.token_edits(r, h)
        assert got == _traced(r, h)
        assert got[0] == got[2] + got[3] + got[4]


def test_word_error_rate_rules(spark):
    rows = [(1, "it costs $47.99", "it costs forty-seven ninety-nine"), (2, "", "hello"), (3, "", ""), (4, "a b c d", "a x c")]
    df = spark.createDataFrame(rows, "i int, ref string, hyp string").select("i", S.wer_tokens("ref").alias("r"), S.wer_tokens("hyp").alias("h"))
    out = df.select("*", S.edit_counts("r", "h").alias("e")).select("i", "e", S.word_error_rate(F.col("e"), F.col("h")).alias("wer")).collect()
    got = {r.i: (round(r.wer, 4), r.e.substitutions, r.e.deletions, r.e.insertions) for r in out}
    assert got == {1: (0.0, 0, 0, 0), 2: (1.0, 0, 0, 1), 3: (0.0, 0, 0, 0), 4: (0.5, 1, 1, 0)}


def test_value_in_text(spark):
    cases = [
        ("$59", "it was fifty-nine dollars", True), ("4917", "order 4,917 please", True), ("March 5th", "on the 5 of april", False),
        ("March 5th", "in march, on the 5th", True), ("36.70", "charged 36 70 today", True), ("36 70", "charged 36 and then 170", False),
        ("ORD-4917", "my ord 4917 is late", True), ("last Friday", "it was last friday", True), ("last Friday", "it was friday", False),
        ("twenty-nine", "number 29", True), ("fourteenth", "the 14 of may", True), ("", "anything", False), ("2017", "nothing here", False),
    ]
    df = spark.createDataFrame([(i, v, t) for i, (v, t, _) in enumerate(cases)], "i int, v string, t string")
    got = [r.ok for r in G.with_value_in_text(df, "v", "t", "ok").orderBy("i").collect()]
    assert got == [c[2] for c in cases]


def test_ordinals_are_found_by_one_search(spark):
    """Ordinals next to other letters, digits and words of ten; the column does no work for words that are none."""
    cases = {
        "Twenty-first": ["21"], "thirty\n\tthird, fourth": ["33", "4"], "twenty twenty second second": ["22", "2"], "twenty thirtieth": ["30"], "twenty tenth": ["10"],
        "firsts fifths éfirst 1first first_": ["1", "1", "1"], "twentythird": [], "forty fifth": ["5"], "": [], "no number": [],
    }
    register(spark)
    df = one_column(spark, [*cases, None]).select("i", S.ordinal_numbers("t").alias("a"), F.expr("ordinal_numbers(t)").alias("b")).orderBy("i")
    got = [(r.a, r.b) for r in df.collect()]
    assert got == [(x, x) for x in [*cases.values(), None]]
    assert "zip_with" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_go_to_python_in_small_batches(spark, sf, tmp_path):
    """Token lists take ten times their bytes in Python: a batch is bounded by bytes, not only by its rows."""
    from callgrain.sources.views import conversations

    spark.range(0, 3000, 1, 1).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "repeat('word of a text ', 400) AS text").write.parquet(str(tmp_path / "conversations.parquet"))

    def sizes(batches):
        for b in batches:
            yield b[["text"]].iloc[:1].assign(text=str(len(b)))

    seen = [int(r.text) for r in conversations(spark, str(tmp_path)).select("text").mapInPandas(sizes, "text string").collect()]
    assert sum(seen) == 3000 and max(seen) <= 1000


def test_spoken_corrections(spark):
    cases = {
        "It says 40... No. 48 something": [("40", "48")], "$49 sorry, $59": [("$49", "$59")], "it was 5 no wait 4821": [],
        "the twelfth... no, the fourteenth": [("twelfth", "fourteenth")], "40 and then 48": [], "40 no 48 no 49": [("40", "48"), ("48", "49")],
        "40 a b c d e f no 48": [],
    }
    df = one_column(spark, list(cases)).select("i", S.spoken_corrections("t").alias("c")).orderBy("i")
    assert [[(x.original, x.corrected) for x in r.c] for r in df.collect()] == list(cases.values())


def test_ambiguous_amounts(spark):
    rows = [(0, ["36 70"], "the amount was 36 70"), (1, ["2299"], "It's 2299 I think"), (2, ["2299"], "It's $2299"), (3, ["2299"], "2299 dollars it was"), (4, ["2299"], "call 12299 or 2299.50")]
    df = spark.createDataFrame(rows, "i int, a array<string>, t string").select("i", S.ambiguous_amounts(F.col("a"), "t").alias("n")).orderBy("i")
    assert [len(r.n) for r in df.collect()] == [1, 1, 0, 0, 0]


def test_entity_buckets(spark):
    turns = spark.createDataFrame(
        [(1, 0, 0, "my order is 4821", False), (1, 1, 1, "I see a charge of 59", False), (1, 2, 0, "maybe friday 77", True)],
        "call_id int, turn_id int, speaker int, text string, uncertain boolean")
    texts = spark.createDataFrame([(1, "my order is 4821 I see a charge of 59 maybe friday 77")], "call_id int, transcript string")
    values = spark.createDataFrame([(1, "order_ids", "4821"), (1, "amounts", "59"), (1, "other", "77"), (1, "other", "999")], "call_id int, key string, value string")
    calls = spark.createDataFrame([(1, 0, True)], "call_id int, customer int, attribution_known boolean")
    got = {r.value: r.bucket for r in G.ground_entities(values, turns, texts, calls).collect()}
    assert got == {"4821": "customer", "59": "agent_stated", "77": "unverified", "999": "dropped"}


def test_fragments_equal_plain_containment(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).selectExpr("doc_id AS text_id", "text")
    rows = docs.collect()
    frags = [(i, r.text[20:20 + n]) for i, (r, n) in enumerate(zip(rows[:12], [3, 6, 12, 40, 60, 90, 120, 30, 25, 200, 5, 80]))] + [(100, "surely not in any text of these"), (101, "the")]
    fdf = spark.createDataFrame(frags, "fragment_id int, fragment string")
    norm = {r.text_id: r.t for r in docs.select("text_id", S.plain("text").alias("t")).collect()}
    fnorm = {r.fragment_id: r.f for r in fdf.select("fragment_id", S.plain("fragment").alias("f")).collect()}
    want = {(i, d) for i, raw in frags if len(raw.strip()) >= 4 for d, t in norm.items() if fnorm[i] in t}
    got = {(r.fragment_id, r.text_id) for r in G.ground_fragments(fdf, docs).collect()}
    assert got == want


def test_short_fragments_are_found_alike_by_either_way(spark):
    texts = spark.createDataFrame([(1, "ab cd ef"), (2, "xyz"), (3, ""), (4, "a"), (5, "Hello, abcd! abcdef"), (6, None), (7, "é ñandú")], "text_id int, text string")
    fragments = spark.createDataFrame([(1, "ab!!"), (2, "!!!!"), (3, "abcd"), (4, "xyz!"), (5, "a..."), (6, "cd ef"), (7, "bcde"), (8, "ab"), (9, "ñand"), (10, "zzzz")], "fragment_id int, fragment string")
    by = [{tuple(r) for r in G.ground_fragments(fragments, texts, few=few).collect()} for few in (1000, 0)]
    assert by[0] == by[1] and (3, 5) in by[0] and (1, 1) in by[0] and not {f for f, _ in by[0]} & {8, 10}


def test_fragments_normalise_each_text_once_a_scan(spark):
    texts = spark.createDataFrame([(1, "The  Order-Number is\n$5.20 Ünow"), (2, None), (3, "four nation_1, here")], "text_id BIGINT, text STRING")
    fragments = spark.createDataFrame([(1, "the order-number IS $5.20 now"), (2, "the order-number is $5.20 nowhere"), (3, "Nation_1")], "fragment_id BIGINT, fragment STRING")
    for few in (1000, 0):
        out = G.ground_fragments(fragments, texts, few=few)
        assert {tuple(r) for r in out.collect()} == {(1, 1), (3, 3)}
        filters = [n for n in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in n and "lower(text#" in n]
        assert not filters, "texts are normalised once more to leave out nulls"
    assert "a-z" not in S.PLAIN_OTHER and "0-9" not in S.PLAIN_OTHER
