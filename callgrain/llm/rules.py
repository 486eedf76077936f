"""Quality rules with risk-controlled thresholds, in column expressions only.

Each text gets counts (words, symbols, repeated lines, repeated words, capitals). Ratios of these, each divided by the
reference value of its rule, give a severity: the largest of them. A level rejects the texts of greater severity. Levels
are tried from the mildest to the strictest on labelled rows of good quality; a level is passed if the exact binomial
bound on its share of false rejections stays below ``risk``. Testing stops at the first level that isn't passed (fixed
sequence), and the error is shared between the strata (Bonferroni), so with probability 1 - ``error`` no stratum loses
more than ``risk`` of its good texts to its level. Strata with too few labelled rows to pass anything are tested together.

Null and empty texts have no words and fail the base rule. A null stratum is one of the strata without labels, which use
the level of the pooled ones. With no labels, or where no level is passed, only the base rule rejects. Repeated rows are
judged alike, each by itself; a labelled id that occurs on several rows counts once for each. Columns of the input are
dropped, but for the id and the stratum (and those named in ``keep``), so that clashing names do no harm. Texts of any length are
read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.llm.common import SPACE, cut, let

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Strictest sensible value of each ratio; a level is a multiple of them.
REFERENCE = {"symbol_share": 0.05, "dup_line_share": 0.5, "repeat_share": 0.3, "capital_share": 0.3}
LEVELS = (4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")


def without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def repeated(marks: Column, span: int = WINDOW) -> Column:
    """How many elements lie in windows that occur twice or more; ``marks`` identifies the window at each place."""
    placed = F.array_sort(F.transform(marks, lambda m, i: F.struct(m.alias("m"), i.alias("i"))))

    def twice(p: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(p, j)["m"] == x["m"], F.lit(False))
        return F.array_sort(F.transform(F.filter(p, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(-span).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(span), i - a["last"])).alias("n"), i.alias("last"))
    covered = F.aggregate(let(placed, twice), start, step, lambda a: a["n"])
    return F.when(F.size(F.array_distinct(marks)) == F.size(marks), F.lit(0)).otherwise(covered)


def counts(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """The kept columns and the counts of each text.

    Words, their hashes and the marks of the windows are columns of their own, each used more than once by the next step,
    so that they are computed once and lambdas only read them.
    """
    long = lambda c, name: c.cast("long").alias(name)
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(without(x, SPACE)) > 0)
    w, h = F.col("_words"), F.col("_hashes")
    done = ["word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines"]
    split = df.select(
        *keep, words_of(t).alias("_words"), lines.alias("_lines"), long(F.length(without(t, SPACE)), "word_chars"),
        long(F.length(t) - F.length(without(t, SYMBOLS)), "n_symbols"), long(F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")), "n_capitals"),
    )
    hashed = split.select(
        *keep, *done[:3], long(F.size("_lines"), "n_lines"), long(F.size("_lines") - F.size(F.array_distinct("_lines")), "n_dup_lines"),
        long(F.size(w), "n_words"), F.transform(w, lambda x: F.xxhash64(x)).alias("_hashes"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    marked = hashed.select(*keep, *done, "n_words", F.when(F.size(h) > WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("_marks"))
    return marked.select(*keep, *done, "n_words", long(repeated(F.col("_marks")), "n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def severity() -> Column:
    share = {
        "symbol_share": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)), "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)), "capital_share": F.col("n_capitals") / F.greatest("word_chars", F.lit(1)),
    }
    return F.greatest(*(share[k] / F.lit(v) for k, v in REFERENCE.items()))


def log_factorial(n: Column) -> Column:
    """Stirling's series from n + 8 on, with the factors between divided out."""
    m = n + F.lit(9.0)
    series = (m - 0.5) * F.log(m) - m + F.lit(0.9189385332046727) + 1 / (12 * m) - 1 / (360 * m * m * m) + 1 / (1260 * F.pow(m, F.lit(5.0)))
    for k in range(1, 9):
        series = series - F.log(n + k)
    return series


def binomial_tail(x: Column, n: Column, p: float, terms: int = 5_000) -> Column:
    """P(X <= x) for X of n trials with chance p, where x < n p; the terms beyond ``terms`` are bounded from above."""
    x, n = x.cast("double"), n.cast("double")
    top = log_factorial(n) - log_factorial(x) - log_factorial(n - x) + x * F.log(F.lit(p)) + (n - x) * F.log1p(F.lit(-p))
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, k: Column) -> Column:
        term = a["term"] * (x - k + 1) * odds / (n - x + k)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    rest = x * odds / (n - x + 1)
    ks = F.when(x > 0, F.sequence(F.lit(1), F.least(x, F.lit(float(terms))).cast("int"))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(ks, start, step, lambda a: a["sum"] + F.when(x > terms, a["term"] * rest / (1 - rest)).otherwise(0.0))
    return F.when(x >= n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def levels(labelled: DataFrame, stratum: str, risk: float = 0.03, error: float = 0.1) -> DataFrame:
    """(stratum, level) from rows with stratum, severity, base_failed and good. The pooled strata have the name null."""
    good = labelled.where("good AND NOT base_failed").withColumn("_s", F.col(stratum))
    sums = good.groupBy("_s").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("severity") > v).alias(f"x{i}") for i, v in enumerate(LEVELS)))
    # the number of strata is counted over all of them, pooled or not, which errs on the safe side
    counted = sums.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()) + 1)
    small = F.col("n") * F.log1p(F.lit(-risk)) > F.log(F.lit(error) / F.col("strata"))
    pooled = counted.withColumn("_s", F.when(~small, F.col("_s")))
    pooled = pooled.groupBy("_s").agg(F.sum("n").alias("n"), F.max("strata").alias("strata"), *(F.sum(f"x{i}").alias(f"x{i}") for i in range(len(LEVELS))))
    passed = [binomial_tail(F.col(f"x{i}"), F.col("n"), risk) <= F.lit(error) / F.col("strata") for i in range(len(LEVELS))]
    # the level before the first that fails; each tail stands once in the plan
    failed = F.array_position(F.array(*passed), F.lit(False))
    level = let(failed, lambda p: F.when(p == 0, F.lit(LEVELS[-1])).when(p > 1, F.element_at(F.array(*map(F.lit, LEVELS)), (p - 1).cast("int"))))
    return pooled.select(F.col("_s").alias("stratum"), level.alias("level"))


def judge(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", text: str = "text", risk: float = 0.03, error: float = 0.1, keep: Sequence[str] = ()
) -> DataFrame:
    """Counts, severity, the level of its stratum, base_failed and kept for each row. ``labels``: key and quality (1 is good)."""
    counted = counts(df=docs, text=text, keep=(key, stratum, *keep)).withColumns({"severity": severity(), "base_failed": base_failed()})
    counted = cut(counted)
    marks = labels.select(F.col(key), (F.col("quality") == 1).alias("good")).where(F.col(key).isNotNull()).groupBy(key).agg(F.every("good").alias("good"))
    found = levels(counted.join(marks, key), stratum, risk, error)
    strata = counted.groupBy(F.col(stratum).alias("_s")).agg(F.lit(True).alias("_seen"))
    found = strata.join(found.withColumn("_own", F.lit(True)), F.col("_s") == F.col("stratum"), "full")
    pooled = F.max(F.when(F.col("_own") & F.col("stratum").isNull(), F.col("level"))).over(Window.partitionBy())
    by_stratum = found.withColumn("level", F.when(F.col("_own"), F.col("level")).otherwise(pooled)).where("_seen").select("_s", "level")
    judged = counted.join(by_stratum, F.col(stratum).eqNullSafe(F.col("_s")), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("severity") > F.col("level"), F.lit(False))).drop("_s")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", text: str = "text") -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns. Verdicts find their rows by id and text."""
    # the row is one column, so that no name of its own can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), F.col(stratum).alias("stratum"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    judged = judge(rows, labels.select(F.col(key).alias("key"), "quality"), "key", "stratum", "text", keep=("hash",))
    good = judged.where("kept").select(F.col("key").alias("good_key"), F.col("hash").alias("good_hash")).distinct()
    return rows.join(good, F.col("key").eqNullSafe(F.col("good_key")) & (F.col("hash") == F.col("good_hash")), "left_semi").select("row.*")
