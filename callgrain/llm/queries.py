"""Registered queries of this folder and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.llm import ann, bpe, html, lm, middle, minhash, packing, prefixes, rules, sharding, suffix, warc, whiten
from callgrain.llm.common import shared_folder, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SHARDS = 16


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["to"] - s["from"]))
    return suffix.remove(docs).select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, WORD_BPE).drop("text")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, rows.where(F.col("vec_id") % 50 == 0))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "severity", "level")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.bundles(warc.with_roles(table(spark, sf_dir, "pages")))
    read = warc.read_records(warc.save(made, shared_folder(spark, "warc")))
    return read.select(
        F.col("record").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = dict.fromkeys(range(SHARDS), 1.0)
    placed = sharding.assign(table(spark, sf_dir, "documents"), even, even | {SHARDS: 1.0})
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)
    return pieces.select("doc_id", "start", "length", packing.ids_crc32(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it doesn't fit a long; ``exact_deviation`` has it then."""
    made = whiten.whiten(table(spark, sf_dir, "embeddings"))
    exact = F.col("deviation")
    return made.select("vec_id", "component", "n", exact.try_cast("long").alias("deviation"), "whitened", "explained", "identity_error", exact.alias("exact_deviation"))


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(table(spark, sf_dir, "documents"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.digests(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_lm, op2_suffix, op3_bpe, op4_ann, op5_rules, op6_warc, op7_minhash, op8_html, op9_sharding, op10_packing, op11_whiten, op12_middle, op13_prefixes)}
_UNIT = "((('0x' || substr(md5('shard:' || s || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0"
_RISK, _ERROR = 0.03, 0.1
_TAILS = ", ".join(
    f"""CASE WHEN x{i} >= n * {_RISK} THEN 1.0 ELSE list_sum(list_transform(range(CAST(x{i} AS BIGINT) + 1), lambda k:
 exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + k * ln({_RISK}) + (n - k) * ln(1 - {_RISK})))) END <= {_ERROR} / strata AS ok{i}"""
    for i in range(len(rules.LEVELS))
)
_LEVEL = "".join(f" WHEN NOT ok{i} THEN {rules.LEVELS[i - 1] if i else 'NULL'}" for i in range(len(rules.LEVELS)))
_X = ", ".join(f"count(*) FILTER (WHERE severity > {v}) AS x{i}" for i, v in enumerate(rules.LEVELS))
_SX = ", ".join(f"sum(x{i}) AS x{i}" for i in range(len(rules.LEVELS)))
_BLANK = r"[\x20\x09-\x0D]+"
SQL = {
    "op7_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(root) AS component_id, min(root) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.node = w.doc_id GROUP BY w.doc_id, n.n
""",
    "op6_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
heads AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to
FROM (SELECT p.*, CASE WHEN payload_bytes >= 1000 THEN head END AS head FROM p LEFT JOIN heads USING (payload_digest)) x
""",
    "op5_rules": rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 8], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 7)) AS i FROM d WHERE len(w) > 8) x),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) x WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_rep FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) x GROUP BY doc_id),
c AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_BLANK}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words,
  CAST(length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_capitals FROM d LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, greatest(n_symbols / greatest(word_chars, 1) / 0.05::DOUBLE, n_dup_lines / greatest(n_lines, 1) / 0.5::DOUBLE,
  n_repeat_words / greatest(n_words, 1) / 0.3::DOUBLE, n_capitals / greatest(word_chars, 1) / 0.3::DOUBLE) AS severity,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
sums AS (SELECT lang, count(*) AS n, {_X}, (count(*) OVER ()) + 1 AS strata FROM v JOIN (SELECT doc_id, bool_and(quality = 1) AS good FROM labels GROUP BY doc_id) USING (doc_id)
  WHERE good AND NOT base_failed GROUP BY lang),
pooled AS (SELECT CASE WHEN n * ln(1 - {_RISK}) <= ln({_ERROR} / strata) THEN lang END AS s, sum(n) AS n, max(strata) AS strata, {_SX} FROM sums GROUP BY 1),
tested AS (SELECT s, {_TAILS} FROM pooled),
found AS (SELECT s, CASE{_LEVEL} ELSE {rules.LEVELS[-1]} END::DOUBLE AS level FROM tested),
j AS (SELECT v.*, CASE WHEN f.s IS NOT NULL THEN f.level ELSE (SELECT level FROM found WHERE s IS NULL) END AS level FROM v LEFT JOIN found f ON v.lang = f.s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(severity > level, false) AS kept, severity, level FROM j
""",
    "op9_sharding": f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda k: CAST(0 AS BIGINT))),
   lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents),
sums AS (SELECT doc_id, n, xor(list_reduce(list_prepend(4294967295, list_transform(bytes, lambda x: CAST('0x' || x AS BIGINT))),
   lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS text_crc32 FROM d, crc),
bids AS (SELECT doc_id, s, -ln({_UNIT}) AS bid FROM documents, range({SHARDS + 1}) r(s)),
won AS (SELECT doc_id, arg_min(s, bid) AS grown, arg_min(s, bid) FILTER (WHERE s < {SHARDS}) AS shard FROM bids GROUP BY doc_id)
SELECT doc_id, CAST(n + 1 AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(grown AS INT) AS grown_shard FROM won JOIN sums USING (doc_id)
""",
    "op12_middle": r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT doc_id, t, units, len(units) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS h FROM u),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, CAST(n AS BIGINT) AS n, form, t, array_to_string(units[1 : low], '') AS a, array_to_string(units[low + 1 : high], '') AS m,
  array_to_string(units[high + 1 :], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
""",
}
