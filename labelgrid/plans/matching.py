"""Typed texts against the catalogue of part names. The texts are the part names as a
reader might type them: shouted, in the plural, with a letter missing, or only begun."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrid.functions import labels as lb
from labelgrid.operators import matching as ma
from labelgrid.plans.registry import query


def catalog(t):
    return t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))


def typed(t):
    way, name = F.col("p_partkey") % 5, F.col("p_name")
    text = (
        F.when(way == 0, F.concat(F.lit(" "), F.upper(name)))
        .when(way == 1, F.concat(name, F.lit("s")))
        .when(way == 2, F.concat(F.substring(name, 1, 2), F.substring(name, 4, 100)))
        .when(way == 3, F.substring(name, 1, 4))
        .otherwise(F.substring(name, 2, 2))
    )
    return t.part.select(F.col("p_partkey").alias("input_id"), text.alias("text"))


TYPED = """
cat AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1),
typ AS (SELECT p_partkey AS input_id, CASE p_partkey % 5 WHEN 0 THEN ' ' || upper(p_name) WHEN 1 THEN p_name || 's' WHEN 2 THEN substr(p_name, 1, 2) || substr(p_name, 4)
        WHEN 3 THEN substr(p_name, 1, 4) ELSE substr(p_name, 2, 2) END AS text FROM part),
frm AS (SELECT DISTINCT lower(strip_accents(trim(text))) AS a FROM typ),
edits AS (SELECT a, name AS b, id, levenshtein(a, name) AS d,
    a = name OR a || 's' = name OR name || 's' = a OR a || 'es' = name OR name || 'es' = a
    OR (least(length(a), length(name)) >= 3 AND (contains(a, name) OR contains(name, a)))
    OR levenshtein(a, name) <= CASE WHEN greatest(length(a), length(name)) <= 4 THEN 1 WHEN greatest(length(a), length(name)) <= 7 THEN 2 ELSE 3 END AS sim
  FROM frm, cat WHERE a <> ''),
src AS (SELECT input_id, text, lower(strip_accents(trim(text))) AS a FROM typ)"""


@query("similar_labels", f"WITH {TYPED} SELECT a, b FROM edits WHERE sim")
def similar_labels(t):
    return ma.similar_pairs(typed(t).select(lb.tag_norm(F.col("text")).alias("a")), catalog(t).select(lb.tag_norm(F.col("name")).alias("b")))


@query("match_label", f"""WITH {TYPED}, r AS (SELECT a, id, a <> b AS inexact, row_number() OVER (PARTITION BY a ORDER BY a <> b, id) AS rn FROM edits WHERE sim)
SELECT input_id, id, CASE WHEN inexact THEN 'similar' ELSE 'exact' END AS kind FROM src JOIN r USING (a) WHERE rn = 1""")
def match_label(t):
    return ma.match_label(typed(t), catalog(t))


@query("prefix_complete", f"""WITH {TYPED}, r AS (SELECT a, b, id, row_number() OVER (PARTITION BY a ORDER BY length(b), id) AS rn FROM edits WHERE starts_with(b, a) AND a <> b)
SELECT input_id, id, b AS name, substr(b, length(text) + 1) AS suffix FROM src JOIN r USING (a) WHERE rn = 1""")
def prefix_complete(t):
    return ma.prefix_complete(typed(t), catalog(t))


@query("did_you_mean", f"""WITH {TYPED}, r AS (SELECT a, b, id, d, row_number() OVER (PARTITION BY a ORDER BY d, id) AS rn FROM edits WHERE sim AND a <> b AND NOT starts_with(b, a) AND length(a) >= 2)
SELECT input_id, id, b AS name, d AS distance FROM src JOIN r USING (a) WHERE rn = 1""")
def did_you_mean(t):
    return ma.did_you_mean(typed(t), catalog(t))


SUGGESTED = """c AS (SELECT a, b, id, CASE WHEN starts_with(b, a) THEN 0 WHEN sim THEN 1 WHEN length(a) >= 2 AND contains(b, a) THEN 2 END AS class FROM edits)"""


@query("suggest_labels", f"""WITH {TYPED}, {SUGGESTED}, r AS (SELECT input_id, id, b AS name, class, row_number() OVER (PARTITION BY input_id ORDER BY class, b, id) AS position FROM src JOIN c USING (a) WHERE class IS NOT NULL)
SELECT input_id, id, name, class, position FROM r WHERE position <= 12""")
def suggest_labels(t):
    return ma.suggest(typed(t), catalog(t))


@query("suggest_labels_not_taken", f"""WITH {TYPED}, {SUGGESTED}, tk AS (SELECT input_id, id FROM src JOIN c USING (a) WHERE class = 0 AND length(b) % 2 = 0),
r AS (SELECT input_id, id, b AS name, class, row_number() OVER (PARTITION BY input_id ORDER BY class, b, id) AS position FROM src JOIN c USING (a)
      WHERE class IS NOT NULL AND (input_id, id) NOT IN (SELECT input_id, id FROM tk))
SELECT input_id, id, name, class, position FROM r WHERE position <= 12""")
def suggest_not_taken(t):
    """Labels already on the item (here: started by the text, of even length) are not offered."""
    texts, names = typed(t).withColumn("a", lb.tag_norm(F.col("text"))), catalog(t)
    prefixes = names.where("length(name) % 2 = 0").select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n))).alias("a"))
    return ma.suggest(texts, names, texts.join(prefixes, "a").select("input_id", "id"))


@query("normalised_labels", "SELECT p_partkey, lower(strip_accents(trim(' ' || upper(p_name) || ' ÉÑ '))) AS norm FROM part")
def normalised_labels(t):
    return t.part.select("p_partkey", lb.tag_norm(F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ÉÑ "))).alias("norm"))


@query("label_edit_distance", "SELECT p_partkey, levenshtein(p_name, lower(p_type)) AS distance FROM part")
def label_edit_distance(t):
    return t.part.select("p_partkey", F.levenshtein("p_name", F.lower("p_type")).alias("distance"))


@query("plural_variants", """SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN false ELSE true END AS plural FROM part""")
def plural_variants(t):
    """Each name against itself with an ending put on: s, es, or another word."""
    ending = F.when(F.col("p_size") % 3 == 0, "s").when(F.col("p_size") % 3 == 1, "es").otherwise(" x")
    return t.part.select("p_partkey", lb.is_plural_variant(F.col("p_name"), F.concat("p_name", ending)).alias("plural"))
