"""Latency summaries, order statistics, agreement, text error rates, threshold sweeps."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelgrid.functions import text as tx
from labelgrid.session import through_table

SORT_BOUND = 200_000  # distinct values of one group that may be ordered in one task
COARSE, FINE = 64, 64  # splitters of a larger group, in two levels
SHIP_GROUPS = 1_000  # most groups whose splitters go to every task, about 32 kB each
EXACT_POISSON = 32  # counts from which a Poisson weight is drawn by its normal form


# ---------------------------------------------------------------- order statistics

def order_statistics(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column], sort_bound: int = SORT_BOUND) -> DataFrame:
    """Exact k-th smallest values per group; a NaN is larger than any number, nulls do not count.

    ``ranks`` maps output names to 1-based ranks in terms of the column ``n``.
    Rows are first counted per value. A group with more distinct values than
    ``sort_bound`` is cut by about ``COARSE * FINE`` of its own values, chosen by hash; one pass counts
    the rows between neighbouring splitters, and only the interval that holds a wanted rank is ordered.
    However values are spread, that is enough; no group is ever gathered in one task.
    """
    counted = through_table(
        df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")),
        "value-counts",
    )
    sizes = through_table(counted.groupBy(*by).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("values")), "group-sizes")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("r")) for name, rank in ranks.items()]))
    targets = sizes.select(*by, "n", "values", wanted.alias("w")).select(*by, "values", F.col("w.name").alias("name"), F.col("w.r").alias("r"))
    key = [*by, "name"]
    small = counted.join(targets.where(F.col("values") <= sort_bound), by).select(*key, "r", "v", "c")
    inside = small.unionByName(_cut_interval(counted, sizes, targets, by, sort_bound)) if sizes.where(F.col("values") > sort_bound).limit(1).count() else small
    upto = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = inside.withColumn("upto", F.sum("c").over(upto)).where((F.col("upto") >= F.col("r")) & (F.col("upto") - F.col("c") < F.col("r")))
    return found.groupBy(*by).pivot("name", list(ranks)).agg(F.first("v"))


def _cut_interval(counted: DataFrame, sizes: DataFrame, targets: DataFrame, by: list[str], sort_bound: int) -> DataFrame:
    """by, name, r, v, c of large groups: the values between the two splitters that enclose the rank, which is counted from the lower one."""
    large = counted.join(sizes.where(F.col("values") > sort_bound).select(*by, "values"), by)
    # Of any group about COARSE * FINE values are splitters.
    chosen = F.pmod(F.xxhash64(F.col("v"), F.lit(1)), F.col("values")) < COARSE * FINE
    fine = F.sort_array(F.collect_list("v")).alias("fine")
    steps = F.expr(f"sequence(1, greatest(1, size(fine)), {FINE})")
    cuts = large.where(chosen).groupBy(*by).agg(fine).withColumn("coarse", F.transform(steps, lambda i: F.col("fine")[i - 1]))
    below = lambda list_, v: F.size(F.filter(list_, lambda s: s <= v))
    part = F.greatest(below(F.col("coarse"), F.col("v")) - 1, F.lit(0))
    place = F.col("_part") * FINE + below(F.slice("fine", F.col("_part") * FINE + 1, F.lit(FINE)), F.col("v"))
    # Few groups would be few tasks: their splitters go to the values, not the values of a group to one task.
    if sizes.where(F.col("values") > sort_bound).limit(SHIP_GROUPS + 1).count() <= SHIP_GROUPS:
        cuts = F.broadcast(cuts)
    met = large.join(cuts, by, "left").withColumn("_part", part)
    placed = through_table(met.select(*by, "v", "c", F.coalesce(place, F.lit(0)).alias("place")), "placed-values")
    each = placed.groupBy(*by, "place").agg(F.sum("c").alias("m"))
    before = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each splitter
    each = each.withColumn("upto", F.sum("m").over(before))
    here = targets.join(each, by).where((F.col("upto") >= F.col("r")) & (F.col("upto") - F.col("m") < F.col("r")))
    here = here.select(*by, "name", "place", (F.col("r") - F.col("upto") + F.col("m")).alias("r"))
    return placed.join(here, [*by, "place"]).select(*by, "name", "r", "v", "c")


def _median_ranks() -> dict[str, Column]:
    n = F.col("n")
    return {"_m1": F.floor((n + 1) / 2), "_m2": F.floor((n + 2) / 2)}


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, median, population deviation, nearest-rank p95, minimum, maximum."""
    n = F.col("n")
    p95 = F.least(n, F.greatest(F.lit(1), F.floor(0.95 * n + 0.999999)))
    points = order_statistics(df, by, value, {**_median_ranks(), "p95": p95})
    plain = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return plain.join(points, by).select(*by, "count", "mean", ((F.col("_m1") + F.col("_m2")) / 2).alias("median"), "std", "p95", "min", "max")


def benchmark_phases(samples: DataFrame, phases: list[str]) -> DataFrame:
    """Latency summary per phase of wide samples (one column per phase)."""
    return latency_summary(samples.select(*phases).unpivot([], phases, "phase", "ms"), ["phase"], "ms")


def stage_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles with linear interpolation between neighbouring ranks."""
    n = F.col("n")
    ranks = {}
    for name, q in shares.items():
        at = (n - 1) * F.lit(q)
        ranks[f"{name}_lo"], ranks[f"{name}_hi"] = F.floor(at) + 1, F.ceil(at) + 1
    points = order_statistics(df, by, value, ranks)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"))

    def between(name: str, q: float) -> Column:
        at = (n - 1) * F.lit(q)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return (lo + (hi - lo) * (at - F.floor(at))).alias(name)

    return sizes.join(points, by).select(*by, "n", *[between(name, q) for name, q in shares.items()])


def model_compare(df: DataFrame, model: str, latency: str, failed: str) -> DataFrame:
    """Mean latency, floor-index p95, failures and rows per model."""
    n = F.col("n")
    points = order_statistics(df, [model], latency, {"p95": F.greatest(F.lit(1), F.floor(n * 0.95))})
    sums = df.groupBy(model).agg(F.avg(latency).alias("mean_latency"), F.sum(failed).alias("failures"), F.count(F.lit(1)).alias("n"))
    return sums.join(points, model)


def phase_calibration(df: DataFrame, phase: str, ratio: str) -> DataFrame:
    """Mean seconds per MB of each phase and its share of the total."""
    means = df.groupBy(phase).agg(F.bround(F.avg(ratio), 2).alias("ratio"))
    total = means.agg(F.sum("ratio").alias("total"))
    return means.join(F.broadcast(total)).select(phase, "ratio", F.bround(F.col("ratio") / F.col("total"), 3).alias("weight"))


def phase_bases(weights: DataFrame, order: list[str]) -> DataFrame:
    """Progress at which each phase starts: the weights of the phases before it."""
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("phase"))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    few = weights.withColumn("place", place).where("place > 0")  # one row per phase
    return few.select("phase", F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("base"), "weight")


# ---------------------------------------------------------------- quality scores

def has_scores(axes: list[str]) -> Column:
    """All axes present and at least one above zero."""
    present = reduce(lambda a, b: a & b, [F.col(a).isNotNull() for a in axes])
    return present & (F.greatest(*[F.col(a) for a in axes]) > 0 if len(axes) > 1 else F.col(axes[0]) > 0)


def quality_summary(df: DataFrame, axes: list[str], extra: str, model: str = "model", group: str = "group") -> DataFrame:
    """Per model and group, and per model overall: mean and sample deviation of valid rows, errors, total."""
    valid = F.coalesce(has_scores(axes), F.lit(False))
    rows = df.withColumn("_valid", valid).select(model, group, "_valid", *[F.when(F.col("_valid"), F.col(a)).alias(a) for a in [*axes, extra]])
    columns = []
    for a in axes:
        columns += [F.bround(F.avg(a), 2).alias(f"{a}_mean"), F.bround(F.stddev_samp(a), 2).alias(f"{a}_std")]
    out = rows.groupingSets([[model, group], [model]], model, group).agg(
        F.grouping(group).alias("_all"), *columns, F.bround(F.avg(extra), 2).alias(f"{extra}_mean"),
        F.count_if(~F.col("_valid")).alias("errors"), F.count(F.lit(1)).alias("total"))
    name = F.when(F.col("_all") == 1, F.lit("Overall")).otherwise(F.col(group))
    return out.withColumn(group, name).drop("_all")


def success_rate(df: DataFrame, by: list[str], ok: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(ok).alias("succeeded"), F.count(F.lit(1)).alias("attempts"),
                               F.avg(F.coalesce(ok, F.lit(False)).cast("int")).alias("rate"))


def group_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def unblind(df: DataFrame, key: DataFrame) -> DataFrame:
    """Real model behind a blind code; an unknown code stands for itself."""
    return df.join(key, "code", "left").withColumn("model", F.coalesce("real_model", "code")).drop("real_model")


def blind_sheet(df: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """A sheet with codes instead of models, in hash order, and the key kept apart."""
    mixed = F.md5(F.concat_ws("|", F.col("item_id").cast("string"), F.col("model"), F.lit(str(seed))))
    coded = df.withColumn("code", F.concat(F.lit("M"), mixed)).withColumn("_order", mixed)
    return coded.orderBy("_order").drop("model", "_order"), coded.select("code", F.col("model").alias("real_model"))


def pair_annotators(a: DataFrame, b: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Items both annotators scored: ``axis, a, b`` with the keys."""
    left, right = a.unpivot(keys, axes, "axis", "a"), b.unpivot(keys, axes, "axis", "b")
    return left.join(right, [*keys, "axis"]).where("a is not null and b is not null")


def weighted_kappa(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Quadratic-weighted Cohen's kappa; weights follow the position of a label, not its value.

    Closed form from sums: observed is the sum of squared position differences,
    expected follows from the first two moments of either annotator.
    """
    counts = through_table(pairs.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("c")), "contingency")
    labels = counts.select(*by, F.col("a").alias("label")).union(counts.select(*by, F.col("b").alias("label"))).distinct()
    place = labels.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("label")))
    both = (
        counts.join(place.select(*by, F.col("label").alias("a"), F.col("i").alias("x")), [*by, "a"])
        .join(place.select(*by, F.col("label").alias("b"), F.col("i").alias("y")), [*by, "b"])
    )
    c, x, y = F.col("c").cast("double"), F.col("x"), F.col("y")
    sums = both.groupBy(*by).agg(
        F.sum(c).alias("n"), F.sum(c * (x - y) * (x - y)).alias("off"),
        F.sum(c * x).alias("sx"), F.sum(c * y).alias("sy"), F.sum(c * x * x).alias("sxx"), F.sum(c * y * y).alias("syy"))
    expected = F.col("sxx") + F.col("syy") - 2 * F.col("sx") * F.col("sy") / F.col("n")
    return sums.select(*by, F.col("n").cast("long").alias("n"), F.when(expected > 0, 1 - F.col("off") / expected).alias("kappa"))


def poisson_weight(count: Column, *named: Column) -> Column:
    """A Poisson number of mean ``count``, drawn from the MD5 of what names it.

    Small means by the inverse of the distribution, larger ones by its normal form with the first term of skewness.
    """
    digits = F.md5(F.concat_ws("|", *named))
    share = lambda first: (F.conv(F.substring(digits, first, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    u, w, c = share(1), share(13), count.cast("double")
    terms = F.sequence(F.lit(1), F.ceil(F.least(c, F.lit(EXACT_POISSON)) + 10 * F.sqrt(F.least(c, F.lit(EXACT_POISSON))) + 20).cast("int"))
    start = F.struct(F.exp(-c).alias("p"), F.exp(-c).alias("sum"), F.lit(0).cast("long").alias("k"))
    step = lambda s, i: F.struct(
        (s["p"] * c / i).alias("p"), (s["sum"] + s["p"] * c / i).alias("sum"), (s["k"] + F.when(s["sum"] < u, 1).otherwise(0)).alias("k"))
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * w)
    wide = F.greatest(F.lit(0.0), F.floor(c + F.sqrt(c) * z + (z * z - 1) / 6 + 0.5).cast("double"))
    return F.when(c < EXACT_POISSON, F.aggregate(terms, start, step, lambda s: s["k"]).cast("double")).otherwise(wide)


def bootstrap_ci(df: DataFrame, by: list[str], value: str, replicates: int = 1000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Mean with a percentile bootstrap interval, repeatable for a seed.

    Rows are counted per value first; each count draws one Poisson weight per
    replicate, so the work depends on the distinct values, not on the rows. Sums of a replicate are combined before they are shuffled.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    drawn = counts.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    named = [F.lit(str(seed)), F.col("rep").cast("string"), *[F.col(b).cast("string") for b in by], F.round(F.col("v") * 1e6).cast("long").cast("string")]
    drawn = drawn.withColumn("w", poisson_weight(F.col("c"), *named))
    means = drawn.groupBy(*by, "rep").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    tail = (1 - level) / 2
    bounds = means.groupBy(*by).agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))  # one value per replicate
    return counts.groupBy(*by).agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.sum("c").alias("n")).join(bounds, by)


# ---------------------------------------------------------------- text error rates

def pair_texts(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """``id, ref, hyp`` normalised, where the reference is not blank."""
    both = ref.select("id", tx.ocr_norm(F.col("text")).alias("ref")).join(hyp.select("id", tx.ocr_norm(F.col("text")).alias("hyp")), "id")
    return both.where("ref <> ''")


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate of normalised texts; null without a reference."""
    return F.when(ref != "", F.levenshtein(ref, hyp) / F.length(ref))


def words_as_characters(ref: str, hyp: str) -> tuple[str, str]:
    """Both texts with one character per word, the same word the same character."""
    codes: dict[str, str] = {}

    def text(words: list[str]) -> str:
        out = []
        for word in words:
            if word not in codes:
                n = len(codes) + 1
                codes[word] = chr(n if n < 0xD800 else n + 0x800)  # past the surrogates
            out.append(codes[word])
        return "".join(out)

    return text((ref or "").split()), text((hyp or "").split())


@F.pandas_udf(T.StructType([T.StructField("ref", T.StringType()), T.StructField("hyp", T.StringType())]))
def _word_strings(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([words_as_characters(r, h) for r, h in zip(ref, hyp)], columns=["ref", "hyp"])


def wer(ref: Column, hyp: Column) -> Column:
    """Word error rate of normalised texts.

    Words become characters in one Arrow pass (linear in the text); the edit
    distance itself is Spark's.
    """
    pair = _word_strings(ref, hyp)
    return F.when(ref != "", F.levenshtein(pair["ref"], pair["hyp"]) / F.length(pair["ref"]))


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in ("tp", "n_ref", "n_hyp")]))
def _token_counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Shared tokens of two texts as multisets, and the tokens of each."""
    out = []
    for r, h in zip(ref, hyp):
        a, b = (Counter(w for w in (text or "").split(" ") if w) for text in (r, h))
        out.append((sum((a & b).values()), a.total(), b.total()))
    return pd.DataFrame(out, columns=["tp", "n_ref", "n_hyp"])


def _with_prf(counted: DataFrame) -> DataFrame:
    """``counts`` of each row as precision, recall and F1."""
    c = lambda name: F.col(f"counts.{name}")
    p = F.when(c("n_hyp") > 0, c("tp") / c("n_hyp")).otherwise(0.0)
    r = F.when(c("n_ref") > 0, c("tp") / c("n_ref")).otherwise(0.0)
    return counted.withColumns({"precision": p, "recall": r}).drop("counts").withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def token_prf(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the token multisets of ``ref`` and ``hyp``, per ``id``.

    Tokens are counted next to their texts; none is shuffled, and no task holds more than a batch of texts.
    """
    return _with_prf(pairs.select("id", _token_counts("ref", "hyp").alias("counts")))


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def ocr_scores(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Character and word error rate, precision, recall and F1 per ``id``, of lower-cased texts in their composed form (NFC)."""
    ref, hyp = (side.select("id", _nfc(F.lower("text")).alias("text")) for side in (ref, hyp))
    pairs = pair_texts(ref, hyp)
    rates = [cer(F.col("ref"), F.col("hyp")).alias("cer"), wer(F.col("ref"), F.col("hyp")).alias("wer")]
    return _with_prf(pairs.select("id", *rates, _token_counts("ref", "hyp").alias("counts")))


def ocr_summary(scores: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Means over all rows and per value of each key; blank keys form no group."""
    sets = [[], *[[k] for k in keys]]
    out = scores.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"), *[F.bround(F.avg(m), 3).alias(m) for m in measures])
    every = (1 << len(keys)) - 1
    grouping = F.when(F.col("_set") == every, F.lit("all"))
    for at, k in enumerate(keys):
        grouping = grouping.when(F.col("_set") == every - (1 << (len(keys) - 1 - at)), F.lit(k))
    value = F.coalesce(*[F.col(k).cast("string") for k in keys])
    return out.select(grouping.alias("grouping"), value.alias("value"), "n", *measures).where("grouping = 'all' or trim(value) <> ''")


def fill_blank(target: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """Blank values of the target taken from the source where it has a non-empty one."""
    other = source.select(key, F.col(column).alias("_new")).where(F.col("_new") != "")
    filled = F.when(tx.is_blank(F.col(column)) & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(column))
    return target.join(other, key, "left").withColumn(column, filled).drop("_new")


# ---------------------------------------------------------------- threshold sweep

def threshold_sweep(pairs: DataFrame, first: int = 80, last: int = 99) -> DataFrame:
    """Precision, recall and F1 of ``score >= t`` for t = 0.80 .. 0.99.

    Pairs are reduced to counts of (thresholds passed, truth) before any
    threshold is tried, so the sweep itself works on a few dozen rows.
    """
    steps = list(range(first, last + 1))
    passed = reduce(lambda a, b: a + b, [(F.col("score") >= F.lit(s) / 100).cast("int") for s in steps])
    counts = pairs.groupBy(passed.alias("passed"), F.col("duplicate").cast("int").alias("truth")).agg(F.count(F.lit(1)).alias("c"))
    rows = counts.withColumn("s", F.explode(F.array(*[F.lit(s) for s in steps])))
    predicted = F.col("passed") >= F.col("s") - first + 1
    sums = rows.groupBy("s").agg(
        F.sum(F.when(predicted & (F.col("truth") == 1), F.col("c")).otherwise(0)).alias("tp"),
        F.sum(F.when(predicted & (F.col("truth") == 0), F.col("c")).otherwise(0)).alias("fp"),
        F.sum(F.when(~predicted & (F.col("truth") == 1), F.col("c")).otherwise(0)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    out = sums.select((F.col("s") / 100).alias("threshold"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)
