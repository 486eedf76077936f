"""Word scores, repeats, coding, rules, near duplicates and packing against plain versions, and on odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from callgrain.llm import bpe, lm, minhash, packing, rules, sharding, suffix
from callgrain.llm.queries import BYTE_BPE, WORD_BPE, op3_bpe, op9_sharding, op10_packing


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)]


def collected(df, key="doc_id"):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


# ------------------------------------------------------------------ coding


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_texts_are_those_of_the_library(name):
    rng = random.Random(3)
    letters = "abcABC'stΣσİéÉ \n\t  \x85\xa0 \x1c12½.,!?#ñ中́<|endoftext|>🙂ß"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["<|endoftext|>x<|startoftext|> y", "", "z" * 5000]
    library, own = tokenizers.Tokenizer.from_file(public_tokenizers.path(name)), bpe.Encoder(open(public_tokenizers.path(name), encoding="utf-8").read())
    known = own.kept_chunks()
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t, known), "<u4").tolist() == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_coding_query_agrees_with_the_library(spark, sf):
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op3_bpe(spark, sf).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_coding_of_odd_inputs(odd_docs, no_docs):
    coded = bpe.decode(bpe.encode(odd_docs, WORD_BPE), WORD_BPE)
    assert coded.columns.count("ids") == 1 and coded.count() == odd_docs.count()
    got = collected(coded)
    assert got[1][0]["ids"] == [] and got[2][0]["decoded"] == "" and got[5][0]["ids"] == got[6][0]["ids"]
    assert bpe.round_trip(no_docs, WORD_BPE).count() == 0


# ----------------------------------------------------------------- packing


def check_pieces(rows, texts, size=1024):
    library = tokenizers.Tokenizer.from_file(BYTE_BPE)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for key, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return sum(r["length"] for r in rows) / (size * len(by_sequence))


def test_packing_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check_pieces(op10_packing(spark, sf).collect(), texts) > 0.95


def test_packing_of_odd_inputs(odd_docs, no_docs):
    once = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces = packing.pack(once.repartition(3), BYTE_BPE).withColumn("ids_crc32", packing.ids_crc32(F.col("ids")))
    check_pieces(pieces.collect(), {r["doc_id"]: r["text"] for r in once.collect()})
    assert packing.pack(odd_docs, BYTE_BPE).where("start = 0").count() == odd_docs.count()
    assert packing.pack(no_docs, BYTE_BPE).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(5)
    lengths = [rng.randint(1, 100) for _ in range(400)]
    window, offset, n = packing.best_fit(lengths, 100)
    rooms, want = [], []
    for i in sorted(range(400), key=lambda i: -lengths[i]):
        fits = [k for k, room in enumerate(rooms) if room >= lengths[i]]
        best = min((rooms[k] for k in fits), default=None)
        want.append(best)
        if best is None:
            rooms.append(100 - lengths[i])
        else:
            rooms[rooms.index(best)] -= lengths[i]
    assert n == len(rooms) and sum(lengths) <= 100 * n
    assert sorted(100 - sum(l for l, w in zip(lengths, window) if w == k) for k in range(n)) == sorted(rooms)


# ---------------------------------------------------------------- sharding


def test_sharding_query_is_a_law_of_the_key(spark, sf):
    rows = op9_sharding(spark, sf).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    slots = collections.defaultdict(list)
    for r in rows:
        bids = [(-math.log((int(hashlib.md5(f"shard:{s}:{r['doc_id']}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48), s) for s in range(17)]
        assert r["shard"] == min(bids[:16])[1] and r["grown_shard"] == min(bids)[1] and r["grown_shard"] in (r["shard"], 16)
        assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())


def test_sharding_by_weight_and_of_odd_inputs(spark, odd_docs, no_docs):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    n = {r["shard"]: r["count"] for r in sharding.assign(many, {0: 1.0, 1: 3.0}, {0: 1.0, 1: 3.0, 2: 4.0}).groupBy("shard").count().collect()}
    assert 0.72 < n[1] / 20_000 < 0.78
    moved = sharding.assign(many, {0: 1.0, 1: 3.0}, {0: 1.0, 1: 3.0, 2: 4.0}).where("shard <> grown_shard")
    assert moved.where("grown_shard <> 2").count() == 0 and 0.47 < moved.count() / 20_000 < 0.53
    got = sharding.assign(odd_docs, {0: 1, 1: 1}, {0: 1, 1: 1, 2: 1}).collect()
    assert len(got) == odd_docs.count()
    for s in (0, 1):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == [*range(sum(r["shard"] == s for r in got))]
    assert sharding.assign(no_docs, {0: 1}, {0: 1, 1: 1}).count() == 0


# ------------------------------------------------------------------- rules


def test_counts_of_odd_inputs(odd_docs):
    for r in rules.counts(odd_docs.join(odd_docs.select(F.xxhash64("text").alias("h"), "text").distinct().withColumnRenamed("text", "t"), F.xxhash64("text") == F.col("h"), "left"), keep=("doc_id", "t")).collect():
        text = r["t"] or ""
        w = words(text)
        at = collections.defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), len(covered), len(lines) - len(set(lines)))
        assert r["word_chars"] == sum(map(len, w)) and r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (3, 200), (5, 100), (40, 2000), (150, 10_000), (7, 7)]
    got = spark.createDataFrame(cases, "x long, n long").select("x", "n", rules.binomial_tail(F.col("x"), F.col("n"), 0.03).alias("p"), rules.binomial_tail(F.col("x"), F.col("n"), 0.03, terms=3).alias("bound")).collect()
    for r in got:
        x, n = r["x"], r["n"]
        want = 1.0 if x >= n * 0.03 else float(sum(math.comb(n, k) * Fraction(3, 100) ** k * Fraction(97, 100) ** (n - k) for k in range(x + 1)))
        assert r["p"] == pytest.approx(want, rel=1e-8) and r["bound"] >= want * (1 - 1e-9)


def test_levels_hold_the_risk_and_stop_at_the_first_failure(spark):
    def stratum(name, n, severities):
        return [(name, s, False, True) for s in severities] + [(name, 0.0, False, True)] * (n - len(severities))

    # clean; 2 % above 1.1 of a large stratum (passes 0.03); 10 % above 1.6 (stops before 1.5); too few; base failures and bad rows don't count
    rows = stratum("a", 1000, []) + stratum("b", 5000, [1.1] * 100) + stratum("c", 1000, [1.6] * 100) + stratum("d", 20, []) + stratum("e", 30, [])
    rows += [("a", 9.0, True, True)] * 500 + [("a", 9.0, False, False)] * 500
    labelled = spark.createDataFrame(rows, "lang string, severity double, base_failed boolean, good boolean")
    got = {r["stratum"]: r["level"] for r in rules.levels(labelled, "lang").collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 1.75, None: None}


def test_rules_on_odd_inputs(odd_docs, no_docs, no_labels):
    judged = collected(rules.judge(odd_docs, no_labels))
    assert sum(map(len, judged.values())) == odd_docs.count()
    assert not judged[1][0]["kept"] and judged[4][0]["kept"] and judged[4][0]["level"] is None
    assert rules.judge(no_docs, no_labels).count() == 0
    kept = rules.keep_good(odd_docs, no_labels)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 13}


# ------------------------------------------------------------------ scores


def test_filter_counts_are_never_too_low_and_within_the_bound():
    counter = lm.Counter()
    rng = np.random.default_rng(1)
    keys = lm.mix(np.arange(50_000, dtype=np.uint64), np.full(1, 9, np.uint64))
    counter.add(np.repeat(keys, rng.geometric(0.4, len(keys))))
    keys, counts = counter.merge()
    level = np.searchsorted(lm.LEAST, counts, "right")
    parts = {}
    for s in range(16):
        inside = (keys >> np.uint64(60)) == s
        n = int(level[inside].sum()) * 12 // 64
        bits = np.zeros(n, "<u8")
        for q in range(1, level.max() + 1):
            word, mask = lm.place(keys[inside & (level >= q)], q, np.uint64(n))
            np.bitwise_or.at(bits, word.astype(int), mask)
        parts[s] = bits.tobytes()
    f = lm.Filter(16, parts)
    assert (f.count(keys) >= lm.MEANT[level]).all() and (f.count(keys) > lm.MEANT[level]).mean() < 0.05
    strange = lm.mix(np.arange(50_000, dtype=np.uint64), np.full(1, 10, np.uint64))
    assert (f.count(strange) > 0).mean() < 0.05


def test_filter_stays_within_its_bytes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small = lm.build(docs, 10**5, filter_bytes=20_000)
    assert len(small.bytes) <= 20_000 and len(lm.build(docs, 10**5).bytes) > 100_000


def test_scores_against_plain_counts(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = collections.Counter(w for i, t in rows if not held[i] for w in [*lowered(t), None])
    n, v = sum(counts.values()), len(counts)
    got = collected(lm.score(odd_docs))
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        tokens = [*lowered(t), None]
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert any(r["n_tokens"] == len(tokens) and r["base_score"] == pytest.approx(want) and r["n_known"] == sum(counts[w] > 0 for w in tokens) for r in got[i])
        assert all(r["held_out"] == held[i] and r["train_tokens"] == n for r in got[i])
    assert lm.score(no_docs).count() == 0


def test_pairs_seen_before_make_held_out_texts_likelier(spark):
    rng = random.Random(2)
    lines = [" ".join(str(rng.randrange(2000)) for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame([(i, lines[i % 40]) for i in range(400)], "doc_id long, text string")
    held = lm.score(docs).where("held_out").collect()
    assert len(held) > 20 and all(r["score"] > r["base_score"] + 5 for r in held)


def test_every_pair_counts_where_the_filter_takes_many_rounds(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(str(int(rng.paretovariate(0.7))) for _ in range(80))) for i in range(300)] + [(300, None), (3, "again 1 2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            tokens = ["start", *lowered(t), "end"]
            seen.update(tokens)
            seen.update(zip(tokens, tokens[1:]))
    held = lambda x: lm.MEANT[np.searchsorted(lm.LEAST, seen[x], "right")]
    total = sum(n for x, n in seen.items() if isinstance(x, str) and x != "start")
    below = total + 0.1 * (sum(isinstance(x, str) and x != "start" for x in seen) + 1)
    frequent = lm.hot_words
    for hot in (40, lm.HOT):
        monkeypatch.setattr(lm, "hot_words", lambda counts, hot=hot: frequent(counts, hot))
        got = collected(lm.score(docs, filter_bytes=9000).where("NOT held_out"))
        for i, t in rows:
            if i in got:
                tokens = ["start", *lowered(t), "end"]
                want = sum(math.log10((held((u, v)) + 50 * (held(v) + 0.1) / below) / (held(u) + 50)) for u, v in zip(tokens, tokens[1:]))
                assert any(r["n_tokens"] == len(tokens) - 1 and r["score"] == pytest.approx(want, abs=0.02 * len(tokens)) for r in got[i])


# --------------------------------------------------------------- near copies


def plain_components(rows, percent=75):
    sets = []
    for _, t in rows:
        w = lowered(t)
        sets.append(set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set())
    group = [*range(len(rows))]

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    group[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return [(key, len(s), least.get(top(i)), key is None or least[top(i)] == key) for i, ((key, _), s) in enumerate(zip(rows, sets))]


def near_rows(seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    for n in (3, 5, 9, 40, 120, 400):  # copies with more and more words changed, around the threshold
        base = text(n)
        for changes in (0, 0, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(min(changes, n)):
                copy[rng.randrange(n)] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    passage = text(60)
    rows += [" ".join(text(rng.randint(5, 60)) + passage + text(rng.randint(5, 60))) for _ in range(60)]  # one passage in many documents
    base = text(150)
    for k in range(80):  # a hub: each copy is near the base, few are near each other
        rows.append(" ".join(base[: 140 - k % 9] + text(9 + k % 9)))
    chain = text(300)
    rows += [" ".join(chain[k * 12 : k * 12 + 120]) for k in range(15)]  # neighbours link, the ends don't
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_components_against_all_pairs(spark, odd_docs, no_docs):
    rows = near_rows()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == sorted(plain_components(rows))
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd_docs).collect()]
    assert sorted(got, key=order) == sorted(plain_components(rows), key=order)
    assert minhash.near_duplicates(no_docs).count() == 0
    kept = minhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [-3, 1, 2, 3, 4, 5, 8, 10, 11, 12, 2**62]


def test_registers_merge_and_estimates_are_near():
    every = lm.mix(np.arange(4000, dtype=np.uint64), np.full(1, 1, np.uint64))
    a, b = every[:3000], every[1000:]
    r = minhash.registers([a, b, every])
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    for overlap in (100, 600, 900):
        x, y = every[:1000], every[1000 - overlap : 2000 - overlap]
        r = minhash.registers([x, y])
        assert abs(minhash.estimate(r[:1], r[1:], np.array([1000.0]), np.array([1000.0]))[0] - overlap / (2000 - overlap)) < 0.15


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 501)], "a long, b long")
    got = {r["node"]: r["component"] for r in minhash.components(links).collect()}
    assert all(got.get(i, 0) == 0 for i in range(201)) and got[501] == 500


# ------------------------------------------------------------------ repeats


def plain_repeats(rows, length=200):
    n = collections.Counter(t[p : p + length] for _, t in rows for p in range(len(t) - length + 1))
    out = []
    for key, t in rows:
        mark = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if n[t[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(mark))]
        out.append((key, spans, bytes(c for c, m in zip(t, mark) if not m)))
    return out


def test_repeats_against_all_strings(spark, odd_docs, no_docs):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcde fgé") for _ in range(n))
    shared = [noise(n) for n in (150, 199, 201, 260, 900)]
    rows = [(i, noise(rng.randint(0, 300)) + rng.choice(shared) + noise(rng.randint(0, 90)) + rng.choice(shared) + noise(20)) for i in range(60)]
    rows += [(100 + i, noise(i % 7) + shared[3] + noise(i % 5)) for i in range(60)]  # one passage with many surroundings
    rows += [(200, "ab" * 300), (201, "x" * 199), (202, "x" * 200), (203, "y" * 201), (204, shared[4] * 2), (205, ""), (206, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {k: (s, t) for k, s, t in plain_repeats([(k, (t or "").encode()) for k, t in rows])}
    for parted in (2000, 7):
        found = suffix.repeats(docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text")), bucket_rows=parted)
        spans = {r["text_key"]: suffix.merged(r["spans"]) for r in found.collect()}
        keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()}
        assert {d: spans.get(k, []) for d, k in keys.items()} == {d: s for d, (s, _) in want.items()}
    for r in suffix.remove(docs).collect():
        assert ([tuple(s) for s in r["spans"]], bytes(r["kept"])) == want[r["doc_id"]]
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect()]
    order = lambda x: (str(x[0]), x[2])
    got = [(r["doc_id"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in suffix.remove(odd_docs).collect()]
    assert sorted(got, key=order) == sorted(plain_repeats(rows), key=order)
    assert suffix.remove(no_docs).count() == 0
    assert suffix.without_repeats(odd_docs).columns == odd_docs.columns


def test_anchors_in_very_long_texts(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, 17_500_000, np.uint8)
    data[17_000_000:17_001_000] = data[5_000:6_000]

    def covered(first):  # the buckets and stretches that lie within the copied passage
        inside = (lo >= first) & (hi + suffix.LENGTH <= first + 1000)
        return list(zip(bucket[inside], stretch[inside], lo[inside] - first))

    _, bucket, stretch, lo, hi = suffix.anchors(data, np.array([0]), np.array([len(data)]))
    assert len(covered(5_000)) > 3 and covered(5_000) == covered(17_000_000)
    # slices own each string once, with the bucket that it has without slices
    starts, ends = np.array([0, 700, 5000, 5200]), np.array([700, 5000, 5200, 9000])
    spread = lambda found: [(t, k, b) for t, b, _, lo, hi in zip(*found) for k in range(lo, hi + 1)]
    want = spread(suffix.anchors(data[:9000], starts, ends))
    monkeypatch.setattr(suffix, "SLICE", 1000)
    assert sorted(spread(suffix.anchors(data[:9000], starts, ends))) == sorted(want) and len(want) == sum(ends - starts - suffix.LENGTH + 1)


def test_letters_stay_whole():
    data = "aéb".encode()
    assert suffix.whole_letters(data, [(0, 2)]) == [(0, 1)] and suffix.whole_letters(data, [(2, 4)]) == [(3, 4)] and suffix.whole_letters(data, [(2, 3)]) == []


# ------------------------------------------------------------------ pipeline


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_take_odd_rows_and_clashing_names(spark, sf, odd_docs, no_docs, tmp_path, rows):
    import corpus_pipeline

    docs = (odd_docs if rows == "odd" else no_docs).withColumn("n_chars", F.length("text")).withColumn("_", F.lit(7)).withColumn("c0", F.lit(8)).withColumn("others", F.lit(9)).withColumn("left", F.lit(10))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns == columns or name == "packing"
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "repeats":
            assert all((r["_"], r["c0"], r["others"], r["left"]) == (7, 8, 9, 10) and r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert (docs.count() == 0) == (rows == "none")
