"""Matching typed text to catalogue labels: same, close, completed, suggested.

All matching runs over distinct normal forms, so repeated inputs and repeated
labels cost nothing extra. Close pairs are found by equi-joins that cannot miss
one: shared plural variants, the rarest shared gram for containment, and shared
segments at a bounded shift for edit distance. Every candidate is then tested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelgrid.functions.labels import similar, tag_norm
from labelgrid.functions.text import all_grams, is_blank
from labelgrid.session import through_table

CONTAIN_GRAMS = (3, 6, 12)
MAX_EDITS = 3


def _allowed(longest):
    return F.when(longest <= 4, 1).when(longest <= 7, 2).otherwise(MAX_EDITS)


def _by_variant(a: DataFrame, b: DataFrame) -> DataFrame:
    variants = lambda c: F.explode(F.array(F.col(c), F.concat(c, F.lit("s")), F.concat(c, F.lit("es")))).alias("key")
    return a.select("a", variants("a")).join(b.select("b", variants("b")), "key").select("a", "b")


def _grams(df: DataFrame, c: str, sizes=CONTAIN_GRAMS) -> DataFrame:
    """Every distinct gram of each size."""
    lists = F.flatten(F.array(*[all_grams(F.col(c), size) for size in sizes]))
    return df.select(c, F.explode(F.array_distinct(lists)).alias("key"))


def _rarest(df: DataFrame, c: str, others: DataFrame, sizes=CONTAIN_GRAMS) -> DataFrame:
    """Each text under the one of its grams, of the largest size that fits, that the fewest ``others`` (their grams) have.

    Who holds the text holds all its grams, so one is enough; a text with a gram that nobody has is held by nobody.
    """
    grams = all_grams(F.col(c), sizes[0])
    for size in sizes[1:]:
        grams = F.when(F.length(c) >= size, all_grams(F.col(c), size)).otherwise(grams)
    own = df.where(F.length(c) >= sizes[0]).select(c, F.explode(F.array_distinct(grams)).alias("key"))
    often = others.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    least = own.join(often, "key", "left").groupBy(c).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("best"))
    return least.where("best.n > 0").select(c, "best.key")


def _by_containment(a: DataFrame, b: DataFrame) -> DataFrame:
    in_a, in_b = _grams(a, "a"), _grams(b, "b")
    one = _rarest(a, "a", in_b).join(in_b, "key").where(F.contains("b", "a"))
    two = in_a.join(_rarest(b, "b", in_a), "key").where(F.contains("a", "b"))
    return one.select("a", "b").unionByName(two.select("a", "b"))


def _segment(length, parts, i):
    """Start (0-based) and size of the i-th of ``parts`` nearly equal pieces."""
    base, longer_from = F.floor(length / parts), parts - length % parts
    start = i * base + F.greatest(F.lit(0), i - longer_from)
    return start.cast("int"), (base + F.when(i >= longer_from, 1).otherwise(0)).cast("int")


def _by_segments(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs within the allowed edits share a segment of ``b`` inside ``a``, shifted by at most the edits."""
    steps = F.explode(F.sequence(F.lit(-MAX_EDITS), F.lit(MAX_EDITS)))
    edits = _allowed(F.greatest("lb", "la"))
    near = (F.abs(F.col("la") - F.col("lb")) <= edits) & (F.col("la") > 0) & (F.col("lb") > 0)

    kept = b.select("b", F.length("b").alias("lb"), steps.alias("d")).withColumn("la", F.col("lb") + F.col("d")).where(near)
    kept = kept.select("b", "lb", edits.alias("e")).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.col("e"))))
    start, size = _segment(F.col("lb"), F.col("e") + 1, F.col("i"))
    kept = kept.select("b", "lb", "e", "i", F.substring("b", start + 1, size).alias("piece"))

    probe = a.select("a", F.length("a").alias("la"), steps.alias("d")).withColumn("lb", F.col("la") + F.col("d")).where(near)
    probe = probe.withColumn("e", edits).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("e"))))
    start, size = _segment(F.col("lb"), F.col("e") + 1, F.col("i"))
    probe = probe.withColumns({"start": start, "size": size}).withColumn("shift", F.explode(F.sequence(-F.col("e"), F.col("e"))))
    at = F.col("start") + F.col("shift")
    probe = probe.where((at >= 0) & (at + F.col("size") <= F.col("la"))).select("a", "lb", "e", "i", F.substring("a", at + 1, F.col("size")).alias("piece")).distinct()
    return probe.join(kept, ["lb", "e", "i", "piece"]).select("a", "b")


def similar_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """All similar pairs of the normal forms ``a`` and ``b``."""
    a, b = a.select("a").where("a <> ''").distinct(), b.select("b").where("b <> ''").distinct()
    candidates = _by_variant(a, b).unionByName(_by_containment(a, b)).unionByName(_by_segments(a, b)).distinct()
    return candidates.where(similar(F.col("a"), F.col("b")))


def _sides(inputs: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    typed = through_table(inputs.select("input_id", "text", tag_norm(F.col("text")).alias("a")), "typed")
    names = through_table(catalog.select("id", "name", tag_norm(F.col("name")).alias("b")), "names")
    return typed, names


def match_label(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalogue label of each typed text: the first equal one, else the first similar one (order of ids)."""
    typed, names = _sides(inputs, catalog)
    firsts = names.groupBy("b").agg(F.min("id").alias("id"))
    pairs = similar_pairs(typed, names).join(firsts, "b")
    best = pairs.groupBy("a").agg(F.min(F.struct((F.col("a") != F.col("b")).alias("inexact"), "id")).alias("m"))
    kind = F.when(F.col("m.inexact"), "similar").otherwise("exact")
    return typed.join(best, "a").select("input_id", F.col("m.id").alias("id"), kind.alias("kind"))


def prefix_complete(inputs: DataFrame, catalog: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """The shortest label that starts with the typed text, and the rest of its name.

    Without ``taken`` the best label of every prefix is chosen before the join,
    so a common prefix costs one row.
    """
    typed, names = _sides(inputs, catalog)
    prefixes = names.where("length(b) >= 2").select(
        "id", "name", F.length("b").alias("len"), F.explode(F.sequence(F.lit(1), F.length("b") - 1)).alias("n"), "b").select(
        "id", "name", "len", F.substring("b", F.lit(1), F.col("n")).alias("a"))
    best = F.min(F.struct("len", "id", "name")).alias("m")
    if taken is None:
        found = typed.join(prefixes.groupBy("a").agg(best), "a")
    else:
        pairs = typed.join(prefixes, "a").join(taken, ["input_id", "id"], "left_anti")
        found = pairs.groupBy("input_id", "text").agg(best)
    rest = F.substring(F.col("m.name"), F.length("text") + 1, F.length("m.name"))
    return found.select("input_id", F.col("m.id").alias("id"), F.col("m.name").alias("name"), rest.alias("suffix"))


def did_you_mean(inputs: DataFrame, catalog: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """The closest label that is similar, but neither equal to nor started by the typed text."""
    typed, names = _sides(inputs, catalog)
    long = typed.where("length(a) >= 2")
    pairs = similar_pairs(long, names).where((F.col("a") != F.col("b")) & ~F.startswith("b", "a"))
    scored = pairs.withColumn("distance", F.levenshtein("a", "b")).join(names, "b")
    best = F.min(F.struct("distance", "id", "name")).alias("m")
    if taken is None:
        found = long.join(scored.groupBy("a").agg(best), "a")
    else:
        found = long.join(scored, "a").join(taken, ["input_id", "id"], "left_anti").groupBy("input_id").agg(best)
    return found.select("input_id", F.col("m.id").alias("id"), F.col("m.name").alias("name"), F.col("m.distance").alias("distance"))


def suggest(inputs: DataFrame, catalog: DataFrame, taken: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """Drop-down list: labels started by the text, then similar ones, then those that contain it; by name.

    A blank text gets the first labels. Each distinct text is ranked and cut
    once, so a text typed by many inputs costs them a dozen rows each.
    """
    typed, names = _sides(inputs, catalog)
    forms, known = typed.select("a").where("a <> ''").distinct(), names.select("b").where("b <> ''").distinct()
    started = forms.join(
        known.select("b", F.explode(F.sequence(F.lit(1), F.length("b"))).alias("n")).select("b", F.substring("b", F.lit(1), F.col("n")).alias("a")), "a")
    two = forms.where("length(a) = 2").select("a", F.col("a").alias("key")).join(_grams(known, "b", (2,)), "key")
    classed = (
        started.select("a", "b", F.lit(0).alias("class"))
        .unionByName(similar_pairs(forms, known).select("a", "b", F.lit(1).alias("class")))
        .unionByName(two.select("a", "b", F.lit(2).alias("class")))
        .groupBy("a", "b").agg(F.min("class").alias("class"))
    )
    # What may be taken away again from one input, at most; a form keeps that many rows more.
    spare = 0 if taken is None else (taken.groupBy("input_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    by_form = Window.partitionBy("a").orderBy("class", F.collate("name", "UNICODE"), "id")
    heads = classed.join(names, "b").withColumn("place", F.row_number().over(by_form)).where(F.col("place") <= limit + spare)
    listed = typed.join(heads, "a").select("input_id", "id", "name", "class", "place")
    first = names.orderBy("id").limit(limit + spare).select(F.collect_list(F.struct("id", "name")).alias("l"))
    blank = typed.where(is_blank(F.col("a"))).select("input_id").join(F.broadcast(first)).select("input_id", F.posexplode("l").alias("n", "x"))
    listed = listed.unionByName(blank.select("input_id", "x.id", "x.name", F.lit(0).alias("class"), F.col("n").alias("place")))
    if taken is not None:
        listed = listed.join(taken, ["input_id", "id"], "left_anti")
    order = Window.partitionBy("input_id").orderBy("class", "place")
    return listed.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).drop("place")
