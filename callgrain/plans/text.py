"""Redaction, error rates, numbers, grounding and corrections over text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgrain.functions import predicates as P
from callgrain.functions import redaction as R
from callgrain.functions import spoken as S
from callgrain.functions.columns import half_up, ratio
from callgrain.functions.register import register
from callgrain.operators import conversation as C
from callgrain.operators import grounding as G
from callgrain.plans.ledger import rounded
from callgrain.plans.registry import Catalog
from callgrain.sources.views import conversations, documents, pairs_view, table

catalog = Catalog()
q = catalog.query

# ------------------------------------------------- SQL form of the redaction

_BLANK = r"\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_DIGIT = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_CARD = r"\b(?:\d[ -]?){13,19}\b"
_PHONE = rf"\+?\(?\d[\d{_BLANK}\-().]{{7,}}\d"
_LUHN = """(list_sum(list_transform(range(length({d})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({d}, length({d}) - CAST(i AS BIGINT), 1) AS INT)
 ELSE (CAST(substr({d}, length({d}) - CAST(i AS BIGINT), 1) AS INT) * 2) // 10 + (CAST(substr({d}, length({d}) - CAST(i AS BIGINT), 1) AS INT) * 2) % 10 END)) % 10 = 0)"""
_D = r"regexp_replace(h, '\D', '', 'g')"
_IS_CARD = rf"(length({_D}) BETWEEN 13 AND 19 AND ({_LUHN.format(d=_D)} OR regexp_full_match(trim(h), '\d{{4}}([ -]\d{{4}}){{3}}(\d{{0,3}})')))"
_G = r"list_filter(string_split_regex(h, '\D+'), lambda g: g <> '')"
_IS_PHONE = rf"""(length({_D}) >= 10 AND NOT regexp_matches(h, '[.,;][{_BLANK}]') AND (len({_G}) = 1 OR len(list_filter({_G}, lambda g: length(g) > 4)) = 0
 OR regexp_matches(h, '^[+(]') OR (len({_G}) = 2 AND length({_G}[1]) <= 4)))"""


def _swap(text: str, pattern: str, pred: str, tag: str) -> str:
    return f"""CASE WHEN regexp_matches({text}, '{pattern}') THEN array_to_string(list_transform(list_zip(string_split_regex({text}, '{pattern}'),
 list_transform(regexp_extract_all({text}, '{pattern}'), lambda h: CASE WHEN {pred} THEN '{tag}' ELSE h END)), lambda z: z[1] || COALESCE(z[2], '')), '') ELSE {text} END"""


REDACTED = f"""SELECT *, {_swap("r3", _PHONE, _IS_PHONE, "[REDACTED_PHONE]")} AS redacted FROM
 (SELECT *, regexp_replace(regexp_replace(r2, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b', '[REDACTED_SSN]', 'g'), '(?i)\\b{_DIGIT}(?:[{_BLANK},-]+{_DIGIT}){{9,}}\\b', '[REDACTED_NUMBER]', 'g') AS r3 FROM
 (SELECT *, {_swap("r1", _CARD, _IS_CARD, "[REDACTED_CARD]")} AS r2 FROM (SELECT *, regexp_replace(said, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}', '[REDACTED_EMAIL]', 'g') AS r1 FROM d) a) b) c"""

# documents with SSN-like, spoken and separated numbers added, whole texts
SAID = """SELECT doc_id, lang, source, text || CASE doc_id % 6 WHEN 0 THEN ' my number is 415 555 0' || (100 + doc_id % 900) || ' ok' WHEN 1 THEN ' ssn 123-45-' || (1000 + doc_id % 9000) || '.'
 WHEN 2 THEN ' call four one five, five five five zero one three two now' WHEN 3 THEN ' card 4111 1111 1111 1111 or 4111111111111112 thanks' WHEN 4 THEN ' order 20759' || (doc_id % 10) || '. 20759' || (doc_id % 10) || ' again 5500000000000004' ELSE '' END AS said FROM documents"""


def said(spark, d):
    n = F.col("doc_id")
    s = lambda x: x.cast("string")
    extra = (
        F.when(n % 6 == 0, F.concat(F.lit(" my number is 415 555 0"), s(100 + n % 900), F.lit(" ok")))
        .when(n % 6 == 1, F.concat(F.lit(" ssn 123-45-"), s(1000 + n % 9000), F.lit(".")))
        .when(n % 6 == 2, F.lit(" call four one five, five five five zero one three two now"))
        .when(n % 6 == 3, F.lit(" card 4111 1111 1111 1111 or 4111111111111112 thanks"))
        .when(n % 6 == 4, F.concat(F.lit(" order 20759"), s(n % 10), F.lit(". 20759"), s(n % 10), F.lit(" again 5500000000000004")))
        .otherwise(F.lit(""))
    )
    return documents(spark, d).select("doc_id", "lang", "source", F.concat("text", extra).alias("said"))


@q("t01_redacted_documents", f"WITH d AS ({SAID}) SELECT doc_id, md5(redacted) AS digest, length(redacted) AS n_chars FROM ({REDACTED}) x")
def redacted_documents(spark, d):
    out = R.with_redacted(said(spark, d), "said", "redacted")
    return out.select("doc_id", F.md5("redacted").alias("digest"), F.length("redacted").cast("bigint").alias("n_chars"))


@q("t01_t09_sql_names", rf"""
WITH d AS ({SAID}), r AS ({REDACTED}),
n AS (SELECT doc_id, list_contains(list_transform(regexp_extract_all(said, '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', '')), '20759' || doc_id % 10) AS w FROM d),
j AS (SELECT documents.lang AS lang, length(redacted) AS chars, w FROM r JOIN n USING (doc_id) JOIN documents USING (doc_id))
SELECT lang, count(*) AS n, count(*) FILTER (WHERE w) AS with_value, count(*) FILTER (WHERE w) AS with_number, sum(chars)::BIGINT AS redacted_chars,
 list_sort(list(chars::DOUBLE))[CAST(least(count(*) - 1, floor(count(*) * 0.9)) AS BIGINT) + 1] AS p90 FROM j GROUP BY 1
""")
def sql_names(spark, d):
    """The same rules by their SQL names."""
    register(spark)
    return spark.sql("""
        WITH s AS (SELECT lang, redact(said) AS r, value_in_text(concat('20759', doc_id % 10), said) AS v, array_contains(number_set(said), concat('20759', doc_id % 10)) AS w FROM {docs})
        SELECT lang, count(*) AS n, count_if(v) AS with_value, count_if(w) AS with_number, sum(length(r)) AS redacted_chars, nearest_rank(collect_list(CAST(length(r) AS DOUBLE)), 0.9D) AS p90
        FROM s GROUP BY lang""", docs=said(spark, d))


def _tag(name: str) -> str:
    return f"len(regexp_extract_all(redacted, '\\[REDACTED_{name}\\]'))"


@q("t01_redaction_counts", f"""
WITH d AS ({SAID}) SELECT lang, count(*) AS n, sum({_tag("EMAIL")})::BIGINT AS email, sum({_tag("CARD")})::BIGINT AS card, sum({_tag("SSN")})::BIGINT AS ssn, sum({_tag("NUMBER")})::BIGINT AS spoken, sum({_tag("PHONE")})::BIGINT AS phone FROM ({REDACTED}) x GROUP BY 1
""")
def redaction_counts(spark, d):
    out = R.with_redacted(said(spark, d), "said", "redacted").select("lang", *R.tag_counts("redacted"))
    return out.groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in R.KINDS])


def _count(kind: str) -> str:
    hits = {"card": (_CARD, _IS_CARD), "phone": (_PHONE, _IS_PHONE)}.get(kind)
    if hits:
        return f"len(list_filter(regexp_extract_all(said, '{hits[0]}'), lambda h: {hits[1]}))"
    p = {"email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "ssn": r"\b\d{3}-\d{2}-\d{4}\b", "spoken": rf"(?i)\b{_DIGIT}(?:[{_BLANK},-]+{_DIGIT}){{9,}}\b"}[kind]
    return f"len(regexp_extract_all(said, '{p}'))"


@q("t03_pii_audit", f"""
WITH d AS ({SAID}), k AS (SELECT lang, source, {", ".join(f"{_count(c)} AS {c}" for c in R.KINDS)} FROM d)
SELECT lang, source, count(*) AS n_rows, {", ".join(f"sum({c})::BIGINT AS {c}_n, count(*) FILTER (WHERE {c} > 0) AS {c}_rows" for c in R.KINDS)} FROM k GROUP BY 1, 2
""")
def pii_audit(spark, d):
    return R.audit(said(spark, d), "said", ["lang", "source"])


@q("f18_audit_after_redaction", f"WITH d AS ({SAID}) SELECT lang, count(*) AS n_rows, 0::BIGINT AS left_over FROM d GROUP BY 1")
def audit_after_redaction(spark, d):
    left = R.audit(R.with_redacted(said(spark, d), "said"), "said", ["lang"])
    return left.select("lang", "n_rows", (F.col("email_n") + F.col("card_n") + F.col("ssn_n") + F.col("spoken_n") + F.col("phone_n")).alias("left_over"))


@q("t02_deep_redaction", f"""
WITH d AS ({SAID}) SELECT doc_id, md5(redacted) AS turn_digest, md5(redacted) AS note_digest, doc_id AS kept_number FROM ({REDACTED}) x
""")
def deep_redaction(spark, d):
    nested = said(spark, d).select("doc_id", F.struct(
        F.array(F.struct(F.col("said").alias("text"), F.col("doc_id").alias("start"))).alias("turns"), F.create_map(F.lit("note"), F.col("said")).alias("meta")).alias("analysis"))
    out = R.redact_deep(nested, "analysis")
    return out.select("doc_id", F.md5(F.col("analysis.turns")[0]["text"]).alias("turn_digest"), F.md5(F.col("analysis.meta")["note"]).alias("note_digest"), F.col("analysis.turns")[0]["start"].alias("kept_number"))


@q("f10_incoherent", r"""
SELECT lang, count(*) FILTER (WHERE trim(text) = '' OR len(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) < 2 OR length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / greatest(1, length(text)) < 0.5) AS incoherent, count(*) AS n
FROM documents GROUP BY 1
""")
def incoherent(spark, d):
    return documents(spark, d).groupBy("lang").agg(F.count_if(P.incoherent("text")).alias("incoherent"), F.count("*").alias("n"))


QA = """SELECT a.conv_id, a.turn, a.text || ' ' || a.conv_id AS question, CASE a.conv_id % 3 WHEN 0 THEN 'I''m sorry, I don''t have a record of order ' || (a.conv_id + a.turn % 2) || '.' WHEN 1 THEN b.text ELSE 'Unable to find it in ' || a.conv_id END AS reply
 FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"""


def question_pairs(spark, d):
    c = conversations(spark, d)
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    replied = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    conv = F.col("conv_id").cast("string")
    reply = (
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("I'm sorry, I don't have a record of order "), (F.col("conv_id") + F.col("turn") % 2).cast("string"), F.lit(".")))
        .when(F.col("conv_id") % 3 == 1, F.col("r")).otherwise(F.concat(F.lit("Unable to find it in "), conv))
    )
    return asked.join(replied, ["conv_id", "turn"]).select("conv_id", "turn", F.concat("q", F.lit(" "), conv).alias("question"), reply.alias("reply"))


@q("f12_plain_decline", rf"""
SELECT conv_id, turn, regexp_matches(reply, '(?i)\b(i[''’]?m sorry|i am sorry|i can[''’]?t|i cannot|i can not|i don[''’]?t (?:have|know)|i do not (?:have|know)|i[''’]?m not (?:able|sure)|unable to|not able to|no (?:record|information) (?:of|about|on))\b')
 AND len(list_filter(regexp_extract_all(reply, '\d+'), lambda n: NOT list_contains(regexp_extract_all(question, '\d+'), n))) = 0 AS declines FROM ({QA}) x
""")
def plain_decline(spark, d):
    return question_pairs(spark, d).select("conv_id", "turn", P.plain_decline("question", "reply").alias("declines"))


@q("u04_new_numbers", rf"""
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(reply, '\d+'), lambda n: NOT list_contains(regexp_extract_all(question, '\d+'), n)))), ',') AS new_numbers FROM ({QA}) x
""")
def new_numbers(spark, d):
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
    return question_pairs(spark, d).select("conv_id", "turn", F.array_join(F.array_sort(F.array_except(numbers("reply"), numbers("question"))), ",").alias("new_numbers"))


@q("t05_strict_tokens", r"""
SELECT pair_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace(lower(ref), '[^a-z0-9''.$ -]', ' ', 'g'), '-', ' ', 'g'), '(^|\s)[.$]+\s', ' ', 'g'), '\s+'), lambda w: regexp_replace(w, '^[.'']+|[.'']+$', '', 'g')),
 lambda w: w <> '' AND w NOT IN ('uh','um','uhm','uhh','umm','er','erm','ah','hmm','mm','mmm')), ' ') AS tokens FROM pairs_v
""", ("pairs_v",))
def strict_tokens(spark, d):
    return pairs_view(spark, d).select("pair_id", F.array_join(S.strict_tokens("ref"), " ").alias("tokens"))


def scored_pairs(spark, d):
    rows = pairs_view(spark, d).select("pair_id", S.wer_tokens("ref").alias("r"), S.wer_tokens("hyp").alias("h"), S.strict_tokens("ref").alias("rs"), S.strict_tokens("hyp").alias("hs"))
    counted = rows.select("*", S.edit_counts("r", "h").alias("e"), S.edit_counts("rs", "hs").alias("es"))
    return counted.select("pair_id", "e", S.word_error_rate(F.col("e"), F.col("h")).alias("wer"), S.word_error_rate(F.col("es"), F.col("hs")).alias("wer_strict"))


@q("t04_t06_t07_word_error_rate")
def word_error_rate(spark, d):
    out = scored_pairs(spark, d).select("pair_id", "e.*", "wer", "wer_strict")
    return rounded(out)


@q("a29_wer_summary")
def wer_summary(spark, d):
    good = F.count_if(F.col("wer") <= 0.1)
    return scored_pairs(spark, d).agg(
        F.count("*").alias("n"), F.round(F.avg("wer"), 9).alias("mean_wer"), F.round(F.avg("wer_strict"), 9).alias("mean_wer_strict"),
        good.alias("within_10pct"), F.round(ratio(good, F.count("*")), 9).alias("share_within"))


NUMBERS = r"""SELECT doc_id, side, n, count(*) AS c FROM (SELECT doc_id, 'ref' AS side, unnest(list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', ''))) AS n FROM documents
 UNION ALL SELECT doc_id, 'hyp', unnest(list_transform(regexp_extract_all(replace(text, '3', '8'), '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', ''))) FROM documents) x GROUP BY 1, 2, 3"""


@q("a30_number_accuracy", f"""
WITH k AS ({NUMBERS}), j AS (SELECT COALESCE(r.doc_id, h.doc_id) AS doc_id, COALESCE(r.c, 0) AS rc, COALESCE(h.c, 0) AS hc FROM (SELECT * FROM k WHERE side = 'ref') r FULL JOIN (SELECT * FROM k WHERE side = 'hyp') h ON r.doc_id = h.doc_id AND r.n = h.n)
SELECT doc_id, sum(rc)::BIGINT AS expected, sum(least(rc, hc))::BIGINT AS matched, (sum(hc) - sum(least(rc, hc)))::BIGINT AS extra FROM j GROUP BY 1
""")
def number_accuracy(spark, d):
    from callgrain.operators import textscore as X

    docs = documents(spark, d).select("doc_id", F.col("text").alias("ref"), F.replace("text", F.lit("3"), F.lit("8")).alias("hyp"))
    rows = docs.select("doc_id", S.written_numbers("ref").alias("ref_numbers"), S.written_numbers("hyp").alias("hyp_numbers"))
    return X.number_accuracy(rows, ["doc_id"])


@q("a30_spoken_number_accuracy")
def spoken_number_accuracy(spark, d):
    from callgrain.operators import textscore as X

    docs = said(spark, d).select("doc_id", F.col("said").alias("ref"), F.replace("said", F.lit("five"), F.lit("nine")).alias("hyp"))
    return X.number_accuracy(docs.select("doc_id", S.number_tokens("ref").alias("ref_numbers"), S.number_tokens("hyp").alias("hyp_numbers")), ["doc_id"])


@q("t08_number_sets")
def number_sets(spark, d):
    rows = G.with_numbers(said(spark, d), "said", "numbers")
    return rows.select("doc_id", F.size("numbers").alias("n"), F.array_join(F.array_sort("numbers"), ",").alias("numbers"))


def extracted(spark, d):
    """Values a model may have extracted from each conversation: some said, some invented."""
    c = conversations(spark, d)
    words = F.split("text", r"\s+")
    kind = F.col("turn") % 4
    return c.select(
        F.col("conv_id").alias("call_id"), F.when(kind % 2 == 0, "order_ids").otherwise("dates").alias("key"),
        F.when(kind == 3, F.concat_ws(" ", F.lit("invented"), "conv_id", "turn")).when(kind == 2, F.col("conv_id").cast("string"))
        .otherwise(F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(2)))).alias("value"))


def numbered_turns(spark, d):
    return conversations(spark, d).select(
        F.col("conv_id").alias("call_id"), F.col("turn").alias("turn_id"), F.when(F.col("role") == "user", 0).otherwise(1).alias("speaker"),
        F.concat("text", F.when(F.col("turn") == 1, F.concat(F.lit(" order "), F.col("conv_id").cast("string"))).otherwise(F.lit(""))).alias("text"), (F.col("turn") % 7 == 6).alias("uncertain"))


@q("t09_t10_j15_entity_grounding")
def entity_grounding(spark, d):
    turns = numbered_turns(spark, d)
    texts = C.script_text(turns.withColumn("role", F.lit("customer")), key="call_id", order="turn_id", role="role", text="text").select("call_id", F.col("script_plain").alias("transcript"))
    calls = texts.select("call_id", F.when(F.col("call_id") % 9 != 0, F.lit(0)).alias("customer"), (F.col("call_id") % 11 != 0).alias("attribution_known"))
    return G.ground_entities(extracted(spark, d), turns, texts, calls)


@q("j15_said_by")
def said_by(spark, d):
    return G.said_by(extracted(spark, d), numbered_turns(spark, d)).groupBy("call_id", "key", "value").agg(
        F.bool_or(F.col("speaker") == 0).alias("by_customer"), F.bool_or(F.col("speaker") == 1).alias("by_others"), F.count("*").alias("turns"))


@q("t11_correction_grounding")
def correction_grounding(spark, d):
    docs = said(spark, d).select(F.col("doc_id").alias("call_id"), F.col("said").alias("transcript"))
    fixes = docs.select("call_id", F.lit("amount").alias("field"), F.coalesce(F.get(S.written_numbers("transcript"), F.lit(0)), F.lit("12")).alias("original"), (F.col("call_id") % 50).cast("string").alias("corrected"))
    return G.ground_corrections(fixes, docs).select("call_id", "original", "corrected", "kept")


_PLAIN = r"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9$.\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


@q("t12_fragment_grounding", f"""
WITH f AS (SELECT item_id AS fragment_id, {_PLAIN.format(c="text")} AS f FROM benchmark WHERE length(trim(text)) >= 4
 UNION ALL SELECT 100000 + nation.n_nationkey, lower(n_name) FROM nation), t AS (SELECT doc_id AS text_id, {_PLAIN.format(c="text")} AS t FROM documents)
SELECT fragment_id, text_id FROM f JOIN t ON contains(t, f)
""")
def fragment_grounding(spark, d):
    passages = table(spark, d, "benchmark").select(F.col("item_id").alias("fragment_id"), F.col("text").alias("fragment"))
    names = table(spark, d, "nation").select((100000 + F.col("n_nationkey")).cast("bigint").alias("fragment_id"), F.col("n_name").alias("fragment"))
    docs = documents(spark, d).select(F.col("doc_id").alias("text_id"), "text")
    return G.ground_fragments(passages.unionByName(names), docs)


@q("t13_ambiguous_amounts")
def ambiguous_amounts(spark, d):
    docs = documents(spark, d).select("doc_id", "text", F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<!\d)(\d{4}|\d{1,3}[ ,]\d{2})(?!\d)"), F.lit(1))).alias("amounts"))
    notes = docs.select("doc_id", F.size("amounts").alias("amounts"), S.ambiguous_amounts(F.col("amounts"), "text").alias("notes"))
    return notes.select("doc_id", "amounts", F.size("notes").alias("flagged"), F.array_join("notes", "|").alias("notes"))


@q("w17_spoken_corrections")
def spoken_corrections(spark, d):
    n = F.col("doc_id")
    s = lambda x: x.cast("string")
    line = F.when(n % 3 == 0, F.concat(F.lit(" it was $"), s(40 + n % 50), F.lit(" no sorry, $"), s(20 + n % 60), F.lit("."))).otherwise(F.lit(" the twelfth... no, the fourteenth. Then 5 or 4821."))
    texts = documents(spark, d).select("doc_id", F.concat("text", line).alias("text"))
    return texts.select("doc_id", F.inline(S.spoken_corrections("text")))


@q("u05_new_corrections")
def new_corrections(spark, d):
    texts = documents(spark, d).select(F.col("doc_id").alias("call_id"), F.concat("text", F.lit(" it was $40 no sorry, $"), (30 + F.col("doc_id") % 30).cast("string")).alias("text"))
    found = texts.select("call_id", F.inline(S.spoken_corrections("text")))
    known = texts.where("call_id % 2 = 0").select("call_id", (30 + F.col("call_id") % 30).cast("string").alias("corrected"))
    return G.undetected_corrections(found, known)


def answers(spark, d):
    """Raw model answers derived from documents; some are not JSON, some labels are unknown."""
    n = F.col("doc_id")
    doc = F.to_json(F.struct(
        F.col("said").alias("summary"), (n % 3).cast("int").alias("customer_speaker"),
        F.struct(F.when(n % 4 == 0, "refund_request").when(n % 4 == 1, "made_up").otherwise("missing_order").alias("label"), F.lit(" because ").alias("description")).alias("primary_intent"),
        F.array(F.struct(F.lit("missing_order").alias("label"), F.lit("x").alias("description")), F.struct(F.lit("refund_request").alias("label"), F.lit("y").alias("description")), F.struct(F.lit("missing_order").alias("label"), F.lit("z").alias("description"))).alias("secondary_intents"),
        F.struct(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat(F.lit("A"), i.cast("string"))).alias("order_ids")).alias("entities"),
        F.struct(F.when(n % 2 == 0, "angry").otherwise("furious").alias("emotion"), F.lit("negative").alias("valence")).alias("lexical_tone"), F.lit(True).alias("escalate")))
    return said(spark, d).select("doc_id", F.when(n % 10 != 9, doc).otherwise(F.substring(doc, 1, 30)).alias("raw"))


@q("t14_u03_normalised_answers", f"""
WITH d AS ({SAID}) SELECT doc_id, doc_id % 10 = 9 AS broken, CASE WHEN doc_id % 10 = 9 THEN '' ELSE md5(substr(redacted, 1, 700)) END AS summary_digest, CASE WHEN doc_id % 10 = 9 THEN 'other' WHEN doc_id % 4 = 0 THEN 'refund_request' WHEN doc_id % 4 = 1 THEN 'other' ELSE 'missing_order' END AS intent,
 CASE WHEN doc_id % 10 = 9 THEN '' WHEN doc_id % 4 = 0 THEN 'missing_order' WHEN doc_id % 4 = 1 THEN 'missing_order,refund_request' ELSE 'refund_request' END AS further, CASE WHEN doc_id % 10 = 9 THEN 0 ELSE 8 END AS n_orders,
 CASE WHEN doc_id % 10 <> 9 AND doc_id % 2 = 0 THEN 'angry' ELSE 'not_evident' END AS emotion, doc_id % 10 <> 9 AS escalate FROM (SELECT * FROM (WITH d AS (SELECT doc_id, trim(said) AS said FROM d) {REDACTED}) y) x
""")
def normalised_answers(spark, d):
    out = G.normalise_answers(answers(spark, d))
    further = G.merged_intents(F.col("primary_intent.label"), F.col("listed_intents"), F.col("issue_intents"))
    broken = F.col("answer_error").isNotNull()
    return out.select(
        "doc_id", broken.alias("broken"), F.when(broken, F.lit("")).otherwise(F.md5("summary")).alias("summary_digest"), F.col("primary_intent.label").alias("intent"),
        F.array_join(F.transform(further, lambda x: x["label"]), ",").alias("further"), F.size("entities.order_ids").alias("n_orders"), F.col("lexical_tone.emotion").alias("emotion"), "escalate")


@q("x03_half_up", "SELECT l_linenumber, sum(floor((l_discount - 0.05) * 10 + 0.5))::DOUBLE AS s FROM lineitem GROUP BY 1")
def rounding(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.sum(half_up((F.col("l_discount") - 0.05) * 10)).alias("s"))
