"""Quality rules with risk-controlled thresholds.

A document is rejected when one of its metrics is above the cutoff of its stratum.
Cutoffs come from a fixed list and are chosen on labelled documents: a cutoff is
certified when the exact binomial bound says that it rejects at most ``risk`` of the good
documents of the stratum.  With ``k`` of ``n`` good labelled documents rejected the p-value of
"the rate is over ``risk``" is ``P(Binomial(n, risk) <= k)``; it must not exceed ``delta`` divided
by the number of all (stratum, metric, cutoff) tests, so that all certified cutoffs hold
together with probability ``1 - delta`` (Bonferroni), whichever of them is then used.  Each
metric gets an equal part of ``risk``, so that a document set rejected by any metric keeps
to ``risk``.  Of the certified cutoffs that with the largest difference between the shares of
bad and of good documents rejected is used, the largest cutoff on a tie.  A stratum
without a certified cutoff that rejects anything bad has no rule.

Only DataFrame expressions are used.  A text is judged inside its row: no shuffle carries
words.  Equal windows are found by their 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_places, free_name, let, materialise, words

WINDOW = 5
#: The base rule: too few words, or over this per cent of words in repeated windows.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"
METRICS = ("symbol_share", "dup_line_share", "caps_share")
CUTOFFS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
#: Largest rate of good documents rejected, per stratum, and the chance that it is not kept.
RISK = 0.03
DELTA = 0.05
#: Cutoffs of all strata are broadcast up to so many bytes; beyond that they are joined.
MAX_RULE_BYTES = 64 << 20


def repeated_words(word_list: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the list."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            near = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, j + k)["h"], F.lit(False))
            # position of each repeated window, or null
            at = F.transform(s, lambda x, j: F.when(near(j, F.lit(-1)) | near(j, F.lit(1)), x["i"]))
            return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda acc, i: F.struct(
            (acc["n"] + (i + WINDOW - F.greatest(i, acc["end"]))).alias("n"), (i + WINDOW).alias("end"))
        return let(pairs, lambda s: F.aggregate(positions(s), start, step, lambda acc: acc["n"]))

    def count(w: Column) -> Column:
        def window_hash(i: Column) -> Column:
            return F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))

        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window_hash)
        return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))))

    return let(word_list, count)


def text_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed`` and the shares in ``METRICS``.

    A null or empty text has zero everywhere and fails the base rule.  Columns of ``docs`` with
    these names are replaced."""
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *METRICS]
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        *(c for c in docs.columns if c not in new and c != text),
        let(words(t), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"))).alias("_w"),
        (F.length(t) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(t) - without("[A-Z]")).cast("long").alias("_caps"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                      (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_l"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    chars, n = F.col("_w.word_chars"), F.col("_w.n_words")
    return counted.select(
        "*", n.alias("n_words"), chars.alias("word_chars"),
        F.col("_l.dup").alias("n_dup_lines"), F.col("_w.n_repeat_words").alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * F.col("_w.n_repeat_words") > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
        share(F.col("n_symbols"), chars).alias("symbol_share"),
        share(F.col("_l.dup"), F.col("_l.n")).alias("dup_line_share"),
        share(F.col("_caps"), chars).alias("caps_share")).drop("_w", "_l", "_caps")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """``P(Binomial(n, p) <= k)``, and 1 where ``k >= n p`` (there it is near a half or more).

    The terms are summed downwards from the ``k``-th, relative to it; its logarithm is a sum of
    ``k`` logarithms."""
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    log_choose = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.log((n - k + i) / i))

    def down(acc: Column, i: Column) -> Column:
        j = k + 1 - i
        ratio = acc["t"] * j * (1 - p) / ((n - j + 1) * p)
        return F.struct(ratio.alias("t"), (acc["s"] + ratio).alias("s"))

    total = F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), down, lambda acc: acc["s"])
    log_p, log_q = F.log(F.lit(p)), F.log(F.lit(1 - p))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total * F.exp(log_choose + k * log_p + (n - k) * log_q))


def certified_cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, metric, cutoff) from labelled rows (stratum, good boolean, the metrics)."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(c).alias("cutoff"), (F.col(m) > c).alias("over"))
                     for m in METRICS for c in CUTOFFS))
    counts = (labelled.select("stratum", "good", F.inline(each))
              .groupBy("stratum", "metric", "cutoff")
              .agg(F.count_if("good").alias("n"), F.count_if(F.col("good") & F.col("over")).alias("k"),
                   F.count_if(~F.col("good")).alias("bad"), F.count_if(~F.col("good") & F.col("over")).alias("caught")))
    tests = counts.agg(F.count("*").alias("tests"))  # one row
    rated = counts.crossJoin(F.broadcast(tests)).withColumn("p", binomial_tail(F.col("k"), F.col("n"), risk / len(METRICS)))
    gain = F.col("caught") / F.col("bad") - F.col("k") / F.col("n")
    return (rated.where((F.col("p") <= delta / F.col("tests")) & (F.col("caught") > 0))
            .groupBy("stratum", "metric").agg(F.max(F.struct(gain.alias("gain"), "cutoff"))["cutoff"].alias("cutoff")))


def choose_cutoffs(measured: DataFrame, labels: DataFrame, key: str, risk: float, delta: float) -> DataFrame:
    """(_stratum, a cutoff or null for each metric), a row per stratum with a rule; broadcast where its size allows it."""
    truth = (labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull())
             .groupBy(F.col(key).alias("_key")).agg((F.min("quality") > 0).alias("good")))
    labelled = measured.join(truth, F.col(key) == F.col("_key")).select("stratum", "good", *METRICS)
    each = (F.max(F.when(F.col("metric") == m, F.col("cutoff"))).alias(f"_{m}") for m in METRICS)
    rules = materialise(certified_cutoffs(labelled, risk, delta).groupBy(F.col("stratum").alias("_stratum")).agg(*each))
    size = rules.agg(F.sum(F.octet_length("_stratum") + 8 * len(METRICS) + 64)).first()[0] or 0
    return F.broadcast(rules) if size <= MAX_RULE_BYTES else rules


def with_verdict(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    rejected = F.lit(False)
    for m in METRICS:
        rejected = rejected | F.coalesce(F.col(m) > F.col(f"_{m}"), F.lit(False))
    return (measured.join(cutoffs, F.col("stratum") == F.col("_stratum"), "left")
            .withColumn("kept", ~F.col("base_failed") & ~rejected)
            .drop("_stratum", *(f"_{m}" for m in METRICS)))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id",
          risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``text_metrics`` of ``docs`` with ``stratum`` and ``kept``.

    ``labels`` (``key``, ``quality``: 1 good, 0 bad; null labels and keys are left out) is the
    holdout; several labels of a key count once, as bad if one is.  A null stratum is the
    stratum ``''``.  Repeated rows of ``docs`` are judged alike and all come back.  With no
    labels only the base rule rejects."""
    measured = materialise(text_metrics(docs).withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(""))))
    return with_verdict(measured, choose_cutoffs(measured, labels, key, risk, delta))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, columns as they are.

    Rows are told apart by their place in ``docs``, which must read the same twice (a table does); texts are not shuffled."""
    row = free_name(docs, "_row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    small = placed.select(F.col(row).alias("place"), F.col(key).alias("key"), F.col(stratum).alias("stratum"), "text")
    judged = judge(small, labels.withColumnRenamed(key, "key"), "stratum", "key").where("kept").select("place")
    return at_places(placed, row, judged).select(docs.columns)
