"""Catalogue queries. Parts stand for labels, orders for items, suppliers for collections,
customers for users, conversation turns for notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrid.functions import text as tx
from labelgrid.operators import catalog as ca
from labelgrid.operators import numbering as nu
from labelgrid.operators import ranking as rk
from labelgrid.plans.registry import query
from labelgrid.session import dealt, parts_for


def labels(t):
    return t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), "p_partkey").alias("slug"),
        F.lit("#6366f1").alias("color"), F.col("p_type").alias("description"), (F.col("p_partkey") % 7).alias("created_by"), (F.col("p_size") % 5 != 0).alias("is_active"))


def bridge(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("label_id"))
    return dealt(rows, parts_for(rows), "image_id", "label_id").distinct()


def items(t):
    return t.orders.select(F.col("o_orderkey").alias("image_id"), F.concat(F.lit("/img/"), F.col("o_orderpriority"), F.lit("/r"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("path"))


def notes(t):
    return t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("image_id"), F.col("role").alias("author_id"), F.col("text").alias("body"), F.col("turn").alias("updated_at"))


def collections(t):
    s = t.supplier
    return s.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("slug"),
        F.lit(None).cast("string").alias("small_description"), F.lit("old").alias("description"), F.lit(None).cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"),
        (F.col("s_acctbal") > 1000).alias("is_public"), (F.col("s_nationkey") != 3).alias("is_active"), F.col("s_nationkey").cast("long").alias("created_by"), F.floor(F.col("s_acctbal") / 100).alias("updated_at"))


def collection_labels(t):
    return t.lineitem.where("l_quantity >= 49").select(F.col("l_suppkey").alias("collection_id"), F.col("l_partkey").alias("label_id")).distinct()


def collection_images(t):
    return t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("collection_id"), F.col("l_orderkey").alias("image_id")).distinct()


def users(t):
    blank = F.col("c_acctbal") < 1000
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("User."), F.col("c_custkey").cast("string"), F.lit("@Example.com")).alias("email"), F.col("c_name").alias("full_name"),
        F.when(blank, "").otherwise("x").alias("password_hash"), F.when(F.col("c_nationkey") < 12, F.col("c_mktsegment")).otherwise("  ").alias("description"),
        (~blank).alias("is_active"), (F.col("c_custkey") % 30).alias("created_at"))


def roles(t):
    return t.region.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("code"))


def user_roles(t):
    nation = F.col("c_nationkey").cast("long")
    return t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.explode(F.array_distinct(F.array(nation % 5, nation % 3))).alias("role_id"))


CTES = """
labels AS (SELECT p_partkey AS id, p_name AS name, replace(p_name, ' ', '-') || '-' || p_partkey AS slug, '#6366f1' AS color, p_type AS description, p_partkey % 7 AS created_by, p_size % 5 <> 0 AS is_active FROM part),
bridge AS (SELECT DISTINCT l_orderkey AS image_id, l_partkey AS label_id FROM lineitem),
items AS (SELECT o_orderkey AS image_id, '/img/' || o_orderpriority || '/r' || o_orderkey || '.png' AS path FROM orders),
notes AS (SELECT conv_id * 1000 + turn AS id, conv_id AS image_id, role AS author_id, text AS body, turn AS updated_at FROM conversations),
collections AS (SELECT s_suppkey AS id, s_name AS name, lower(replace(s_name, '#', '-')) AS slug, s_acctbal > 1000 AS is_public, s_nationkey <> 3 AS is_active, s_nationkey AS created_by, floor(s_acctbal / 100)::BIGINT AS updated_at FROM supplier),
collection_labels AS (SELECT DISTINCT l_suppkey AS collection_id, l_partkey AS label_id FROM lineitem WHERE l_quantity >= 49),
collection_images AS (SELECT DISTINCT l_suppkey AS collection_id, l_orderkey AS image_id FROM lineitem WHERE l_returnflag = 'R'),
members AS (SELECT collection_id, image_id FROM collection_images UNION SELECT collection_id, image_id FROM collection_labels JOIN bridge USING (label_id)),
users AS (SELECT c_custkey AS id, 'User.' || c_custkey || '@Example.com' AS email, c_name AS full_name, CASE WHEN c_acctbal < 1000 THEN '' ELSE 'x' END AS password_hash,
          CASE WHEN c_nationkey < 12 THEN c_mktsegment ELSE '  ' END AS description, c_acctbal >= 1000 AS is_active, c_custkey % 30 AS created_at FROM customer),
roles AS (SELECT r_regionkey AS id, r_name AS code FROM region),
user_roles AS (SELECT c_custkey AS user_id, c_nationkey % 5 AS role_id FROM customer WHERE c_acctbal > 0 UNION SELECT c_custkey, c_nationkey % 3 FROM customer WHERE c_acctbal > 0),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, author_id ORDER BY updated_at DESC, id DESC) AS rn FROM notes) WHERE rn = 1),
note_hits AS (SELECT * FROM notes WHERE contains(strip_accents(lower(body)), 'and the'))
"""
# The label names below are registered views too, so the stand-ins get their own names in SQL.
NAMES = "labels bridge items notes collections collection_labels collection_images members users roles user_roles latest note_hits".split()


def sql(body: str) -> str:
    import re

    def rename(text):
        for n in sorted(NAMES, key=len, reverse=True):
            text = re.sub(rf"\b(FROM|JOIN|,)(\s+){n}\b(?!\.)", rf"\1\2x_{n}", text)
        return text

    head = "\n".join(re.sub(r"^(\w+) AS \(", r"x_\1 AS (", line) for line in CTES.strip().split("\n"))
    return f"WITH {rename(head)}\n{rename(body)}" if body.lstrip().startswith(",") else f"WITH {rename(head)} {rename(body)}"


# ---------------------------------------------------------------- projections and predicates

@query("project_hits", sql("""SELECT image_id AS id, regexp_extract(path, '[^/]*$') AS filename, 'https://host/' || regexp_extract(path, '[^/]*$') AS url,
regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS title, o_totalprice AS score FROM items JOIN orders ON o_orderkey = image_id"""))
def project_hits(t):
    rows = items(t).join(t.orders.select(F.col("o_orderkey").alias("image_id"), F.col("o_totalprice").alias("score")), "image_id")
    return ca.project_hits(rows.withColumnRenamed("image_id", "id"), "https://host/")


@query("active_labels_of_owner", sql("SELECT id, name FROM labels WHERE is_active AND created_by = 2"))
def active_labels(t):
    return ca.active_labels(labels(t), 2).select("id", "name")


TAGS = "string_split(p_name, ' ')"


def tagged_items(t):
    return t.part.select(F.col("p_partkey").alias("image_id"), F.split("p_name", " ").alias("tags"))


@query("tags_any", f"SELECT p_partkey AS image_id FROM part WHERE list_has_any({TAGS}, ['red', 'bolt'])")
def tags_any(t):
    return tagged_items(t).where(ca.tags_any(F.col("tags"), ["red", "bolt"])).select("image_id")


@query("tags_all", f"SELECT p_partkey AS image_id FROM part WHERE list_has_all({TAGS}, ['red', 'bolt'])")
def tags_all(t):
    return tagged_items(t).where(ca.tags_all(F.col("tags"), ["red", "bolt"])).select("image_id")


@query("all_tags", f"SELECT DISTINCT unnest({TAGS}) AS tag FROM part")
def all_tags(t):
    return ca.all_tags(tagged_items(t))


@query("items_by_ids", sql("SELECT image_id AS id, path, l.l_linenumber AS position FROM items JOIN (SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem WHERE l_shipdate >= '1998-01-01' GROUP BY 1) l ON l_orderkey = image_id"))
def items_by_ids(t):
    ids = t.lineitem.where("l_shipdate >= '1998-01-01'").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_linenumber").alias("position"))
    return ca.by_ids(items(t).withColumnRenamed("image_id", "id"), ids)


@query("search_labels_wildcard", sql("SELECT id, name, slug FROM labels WHERE is_active AND (name LIKE '%r_d%' OR slug LIKE '%r_d%')"))
def search_labels(t):
    return ca.search_labels(labels(t), " R_d ").select("id", "name", "slug")


@query("search_literal_escaped", "SELECT page_id FROM pages WHERE contains(html, '%%%')")
def search_literal(t):
    return t.pages.where(ca.like_literal(F.col("html"), F.lit("%%%"))).select("page_id")


@query("search_note_text", sql("SELECT id, image_id FROM notes WHERE contains(strip_accents(lower(body)), 'eaux')"))
def search_note_text(t):
    return notes(t).where(ca.contains_literal(F.col("body"), "EÀUX")).select("id", "image_id")


@query("visible_on_day", """SELECT o_orderkey, o_orderstatus FROM orders WHERE coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, DATE '1998-06-01') <= DATE '1998-06-01'
AND DATE '1998-06-01' <= coalesce(CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 90 DAY END, DATE '1998-06-01')""")
def visible_on_day(t):
    day = F.to_date(F.lit("1998-06-01"))
    start, end = F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 90)
    shown = ca.visible_on(day, F.when(F.col("o_orderstatus") != "P", start), F.when(F.col("o_orderstatus") != "O", end))
    return t.orders.where(shown).select("o_orderkey", "o_orderstatus")


@query("public_collections", sql("SELECT id, name FROM collections WHERE is_public AND is_active"))
def public_collections(t):
    return ca.public_rows(collections(t)).select("id", "name")


@query("pending_users", sql("SELECT id, email, description FROM users WHERE NOT is_active AND password_hash = '' AND trim(description) <> ''"))
def pending_users(t):
    return ca.pending_users(users(t)).select("id", "email", "description")


@query("users_with_any_role", sql("SELECT user_id FROM user_roles JOIN roles ON roles.id = role_id GROUP BY user_id HAVING bool_or(code IN ('ASIA', 'EUROPE'))".replace("roles.id", "x_roles.id")))
def users_with_any_role(t):
    held = user_roles(t).join(roles(t), F.col("role_id") == F.col("id")).groupBy("user_id").agg(F.collect_set("code").alias("codes"))
    return held.where(ca.has_any_role(F.col("codes"), ["ASIA", "EUROPE"])).select("user_id")


@query("users_by_email", sql("SELECT id, email FROM users WHERE lower(email) IN (SELECT DISTINCT 'user.' || o_custkey || '@example.com' FROM orders)"))
def users_by_email(t):
    asked = t.orders.select(F.concat(F.lit(" USER."), F.col("o_custkey").cast("string"), F.lit("@example.COM ")).alias("email"))
    return ca.users_by_email(users(t), asked).select("id", "email")


@query("duplicate_emails", "SELECT lower(c_mktsegment || c_nationkey || '@x') AS email, count(*) AS n, min(c_custkey) AS first_id FROM customer GROUP BY 1 HAVING count(*) > 1")
def duplicate_emails(t):
    mails = t.customer.select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string"), F.lit("@x")).alias("email"))
    return ca.duplicate_emails(mails)


@query("accepted_files", "SELECT user_id AS session, event_id FROM events WHERE (user_id, event_type) IN (SELECT user_id, event_type FROM events WHERE value > 100)")
def accepted_files(t):
    files = t.events.select(F.col("user_id").alias("session"), F.col("event_type").alias("filename"), "event_id", "value")
    return ca.accepted_only(files, files.where("value > 100").select("session", "filename")).select("session", "event_id")


@query("missing_stage_split", "SELECT doc_id, 'ready' AS outcome FROM documents JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'error' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_stage_split(t):
    ready, failed = ca.split_by_stage(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), F.col("quality").isNotNull())
    return ready.select("doc_id", F.lit("ready").alias("outcome")).unionByName(failed.select("doc_id", F.lit("error").alias("outcome")))


# ---------------------------------------------------------------- labels and items

@query("labels_for_items", sql("SELECT image_id, id, name, slug, color FROM bridge JOIN labels ON id = label_id WHERE is_active"))
def labels_for_items(t):
    return ca.labels_for_items(bridge(t), labels(t))


@query("labels_for_open_items", sql("SELECT image_id, id, name, row_number() OVER (PARTITION BY image_id ORDER BY name, id) AS position FROM bridge JOIN labels ON id = label_id WHERE is_active AND image_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"))
def labels_for_open_items(t):
    """Labels of the asked items in name order, numbered per item; an item with very many labels is spread over tasks."""
    asked = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("image_id"))
    rows = ca.labels_for_items(bridge(t), labels(t), asked).select("image_id", "id", "name")
    return nu.number_in_group(rows, ["image_id"], ["name", "id"], "position")


@query("item_detail", sql(""", nt AS (SELECT image_id, body FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY updated_at DESC, id DESC) AS r FROM latest) WHERE r = 1)
SELECT i.image_id, i.path, l.id AS label_id, l.name AS label, nt.body AS note
FROM items i LEFT JOIN (SELECT image_id, id, name FROM bridge JOIN labels ON id = label_id WHERE is_active) l USING (image_id) LEFT JOIN nt USING (image_id)
WHERE i.image_id IN (SELECT conv_id FROM conversations)"""))
def item_detail(t):
    asked = t.conversations.select(F.col("conv_id").alias("image_id")).distinct()
    return ca.item_detail(items(t), asked, bridge(t), labels(t), notes(t))


@query("items_of_label", sql("SELECT DISTINCT image_id, path FROM items JOIN bridge USING (image_id) JOIN labels ON id = label_id WHERE id = 9 AND created_by = 2 AND is_active"))
def items_of_label(t):
    return ca.items_of_label(bridge(t), items(t), labels(t), 9, 2)


WANTED = "SELECT id FROM labels WHERE name IN ('red bolt', 'blue bolt', 'red ring')"


def wanted(t):
    return labels(t).where(F.col("name").isin("red bolt", "blue bolt", "red ring")).select(F.col("id").alias("label_id"))


@query("items_with_all_labels", sql("SELECT image_id FROM (SELECT image_id, name FROM bridge JOIN labels ON id = label_id) GROUP BY image_id HAVING count(DISTINCT name) FILTER (name IN ('red bolt', 'blue ring')) = 2"))
def items_with_all_labels(t):
    """Division by label name: items that carry a label of either wanted name."""
    named = bridge(t).join(labels(t).select(F.col("id").alias("label_id"), "name"), "label_id").select("image_id", F.col("name").alias("label_id"))
    pair = labels(t).where(F.col("name").isin("red bolt", "blue ring")).select(F.col("name").alias("label_id"))
    return ca.items_with_all(named, pair)


@query("items_with_any_label", sql(f"SELECT DISTINCT image_id FROM bridge WHERE label_id IN ({WANTED})"))
def items_with_any_label(t):
    return ca.items_with_any(bridge(t), wanted(t))


@query("label_item_counts", sql("SELECT id, name, (SELECT count(*) FROM bridge b WHERE b.label_id = l.id) AS image_count FROM labels l"))
def label_item_counts(t):
    return ca.with_count(labels(t).select("id", "name"), bridge(t), "id", "label_id", "image_count")


@query("labels_with_creator", sql("SELECT l.id, l.name, u.full_name AS creator FROM labels l LEFT JOIN users u ON u.id = l.created_by"))
def labels_with_creator(t):
    return ca.labels_with_creator(labels(t), users(t)).select("id", "name", "creator")


@query("users_with_roles", sql("SELECT u.id, u.email, coalesce(string_agg(DISTINCT r.code, ',' ORDER BY r.code), '') AS roles FROM users u LEFT JOIN user_roles ur ON ur.user_id = u.id LEFT JOIN roles r ON r.id = ur.role_id GROUP BY u.id, u.email"))
def users_with_roles(t):
    return ca.users_with_roles(users(t), user_roles(t), roles(t)).select("id", "email", "roles")


@query("known_links_only", sql("SELECT image_id, label_id FROM bridge WHERE label_id IN (SELECT id FROM labels WHERE is_active)"))
def known_links_only(t):
    return ca.known_only(bridge(t), labels(t).where("is_active").select(F.col("id").alias("label_id")), "label_id")


@query("all_ids_known", "SELECT DISTINCT l_partkey AS label_id FROM lineitem")
def all_ids_known(t):
    return ca.assert_all_known(bridge(t), labels(t).select(F.col("id").alias("label_id")), "label_id")


# ---------------------------------------------------------------- notes

@query("latest_notes", sql("SELECT image_id, author_id, id, updated_at, body FROM latest"))
def latest_notes(t):
    return ca.latest_note(notes(t))


@query("save_notes", sql(""", upd AS (SELECT image_id, author_id, CASE WHEN image_id % 3 = 0 THEN '' ELSE 'note ' || image_id END AS body FROM notes GROUP BY image_id, author_id HAVING max(updated_at) >= 2),
more AS (SELECT doc_id + 1000000 AS image_id, 'user' AS author_id, 'first ' || doc_id AS body FROM documents WHERE lang = 'es'),
up AS (SELECT * FROM upd UNION ALL SELECT * FROM more),
old AS (SELECT n.image_id, n.author_id, min(n.id) AS id FROM notes n GROUP BY 1, 2)
SELECT n.id, n.image_id, n.author_id, n.body FROM notes n WHERE (n.image_id, n.author_id) NOT IN (SELECT image_id, author_id FROM up)
UNION ALL SELECT o.id, u.image_id, u.author_id, u.body FROM up u JOIN old o USING (image_id, author_id) WHERE u.body <> ''
UNION ALL SELECT (SELECT max(id) FROM notes) + row_number() OVER (ORDER BY image_id), image_id, author_id, body FROM more"""))
def save_notes(t):
    """Saves over existing notes (some blank, which deletes) and first notes for Spanish documents."""
    n = notes(t)
    again = n.groupBy("image_id", "author_id").agg(F.max("updated_at").alias("m")).where("m >= 2").select(
        "image_id", "author_id", F.when(F.col("image_id") % 3 == 0, "").otherwise(F.concat(F.lit("note "), F.col("image_id").cast("string"))).alias("body"))
    fresh = t.documents.where("lang = 'es'").select((F.col("doc_id") + 1_000_000).alias("image_id"), F.lit("user").alias("author_id"), F.concat(F.lit("first "), F.col("doc_id").cast("string")).alias("body"))
    updates = again.unionByName(fresh).withColumn("updated_at", F.lit(99).cast("long"))
    return ca.single_note(n, updates).select("id", "image_id", "author_id", "body")


UNTAGGED = """SELECT DISTINCT image_id FROM note_hits n WHERE NOT EXISTS (SELECT 1 FROM bridge b JOIN labels l ON l.id = b.label_id WHERE b.image_id = n.image_id AND l.created_by = 2 AND l.is_active)"""


@query("untagged_by_note", sql(UNTAGGED))
def untagged_by_note(t):
    return ca.untagged_by_note(notes(t), bridge(t), labels(t), "and THE", owner=2, limit=None)


BY_NOTES = """SELECT l.id, l.name, l.slug, l.color, count(DISTINCT n.image_id) AS note_match_count, (SELECT count(*) FROM bridge a WHERE a.label_id = l.id) AS image_count
FROM labels l JOIN bridge b ON b.label_id = l.id JOIN note_hits n ON n.image_id = b.image_id WHERE l.is_active AND l.created_by = 2 GROUP BY l.id, l.name, l.slug, l.color"""


@query("labels_by_notes", sql(BY_NOTES))
def labels_by_notes(t):
    return ca.labels_by_notes(labels(t), bridge(t), notes(t), "and the", owner=2, limit=None)


@query("labels_by_notes_with_untagged", sql(f", u AS ({UNTAGGED}) {BY_NOTES} UNION ALL SELECT 0, 'Sin Etiquetar', 'sin-etiquetar', '#94a3b8', n, n FROM (SELECT count(*) AS n FROM u) WHERE n > 0"))
def labels_by_notes_with_untagged(t):
    rows = ca.labels_by_notes(labels(t), bridge(t), notes(t), "and the", owner=2, limit=None)
    return ca.with_untagged_bucket(rows, ca.untagged_by_note(notes(t), bridge(t), labels(t), "and the", owner=2, limit=None))


# ---------------------------------------------------------------- collections

def members(t):
    return ca.collection_items(collection_images(t), collection_labels(t), bridge(t), parts_for(t.lineitem))


@query("collection_items", sql("SELECT collection_id, image_id FROM members"))
def collection_items(t):
    return members(t)


@query("collection_list", sql("""SELECT id, name, coalesce(n, 0) AS image_count, first AS sample_image_id, (SELECT count(*) FROM collection_labels cl WHERE cl.collection_id = c.id) AS label_count
FROM collections c LEFT JOIN (SELECT collection_id, count(*) AS n, min(image_id) AS first FROM members GROUP BY 1) m ON m.collection_id = c.id"""))
def collection_list(t):
    return ca.collection_list(collections(t).select("id", "name"), members(t), collection_labels(t))


@query("collections_in_order", sql("SELECT id, name, updated_at FROM collections"))
def collections_in_order(t):
    return ca.order_collections(collections(t)).select("id", "name", "updated_at")


@query("collection_detail", sql("""SELECT m.collection_id, m.image_id, i.path, n.body AS note FROM members m JOIN collections c ON c.id = m.collection_id JOIN items i USING (image_id)
LEFT JOIN (SELECT image_id, CASE author_id WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS author, body FROM latest) n ON n.image_id = m.image_id AND n.author = c.created_by"""))
def collection_detail(t):
    author = F.when(F.col("author_id") == "user", 1).when(F.col("author_id") == "assistant", 2).otherwise(3).cast("long")
    return ca.collection_detail(collections(t), members(t), items(t), notes(t).withColumn("author_id", author)).select("collection_id", "image_id", "path", "note")


@query("collection_label_counts", sql("""SELECT cl.collection_id, cl.label_id, l.name, (SELECT count(*) FROM bridge b WHERE b.label_id = cl.label_id) AS image_count
FROM collection_labels cl JOIN labels l ON l.id = cl.label_id AND l.is_active"""))
def collection_label_counts(t):
    return ca.collection_label_counts(collection_labels(t), labels(t), bridge(t))


@query("collection_sort_order", "SELECT p_partkey AS parent, pos - 1 AS sort_order, string_split(p_name, ' ')[pos] AS child FROM (SELECT *, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS pos FROM part)")
def collection_sort_order(t):
    return ca.with_sort_order(t.part.select(F.col("p_partkey").alias("parent"), F.split("p_name", " ").alias("children")), "parent", "children", "child")


@query("patch_collections", sql("""SELECT id, CASE WHEN created_by < 10 THEN 'Renamed ' || created_by ELSE name END AS name,
CASE WHEN created_by < 10 THEN 'renamed-' || created_by || CASE WHEN rn > 1 THEN '-' || rn ELSE '' END ELSE slug END AS slug,
CASE WHEN created_by < 10 THEN NULL ELSE 'old' END AS description, CASE WHEN created_by < 10 THEN '2024-02-29' END AS start_date,
CASE WHEN created_by < 10 THEN false ELSE is_public END AS is_public, is_active
FROM (SELECT *, row_number() OVER (PARTITION BY created_by ORDER BY id) AS rn FROM collections)"""))
def patch_collections(t):
    c = collections(t)
    patch = F.create_map(
        F.lit("name"), F.concat(F.lit(" Renamed "), F.col("created_by").cast("string")), F.lit("description"), F.lit("<p> </p>"),
        F.lit("start_date"), F.lit("2024-02-29"), F.lit("is_public"), F.lit("0"))
    out = ca.patch_collections(c, c.where("created_by < 10").select("id", patch.alias("patch")))
    return out.select("id", "name", "slug", "description", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"), "is_public", "is_active")


# ---------------------------------------------------------------- tags and links

@query("add_tags", f"SELECT p_partkey AS image_id, array_to_string(list_sort(CASE WHEN p_type = 'ECONOMY' THEN list_distinct(list_concat({TAGS}, ['new', 'red'])) ELSE {TAGS} END), ',') AS tags FROM part")
def add_tags(t):
    changes = t.part.where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("image_id"), F.array(F.lit("new"), F.lit("red")).alias("tags"))
    return ca.change_tags(tagged_items(t), changes, "add").select("image_id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("remove_tags", f"SELECT p_partkey AS image_id, array_to_string(CASE WHEN p_type = 'ECONOMY' THEN list_filter({TAGS}, lambda x: x <> 'red') ELSE {TAGS} END, ',') AS tags FROM part")
def remove_tags(t):
    changes = t.part.where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("image_id"), F.array(F.lit("red")).alias("tags"))
    return ca.change_tags(tagged_items(t), changes, "remove").select("image_id", F.array_join("tags", ",").alias("tags"))


@query("set_tags", f"SELECT p_partkey AS image_id, CASE WHEN p_type = 'ECONOMY' THEN p_brand ELSE array_to_string({TAGS}, ',') END AS tags FROM part")
def set_tags(t):
    changes = t.part.where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("image_id"), F.array("p_brand").alias("tags"))
    return ca.change_tags(tagged_items(t), changes, "set").select("image_id", F.array_join("tags", ",").alias("tags"))


@query("replace_item_labels", sql("""SELECT image_id, label_id FROM bridge WHERE image_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'"""))
def replace_item_labels(t):
    changed = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("label_id"))
    return ca.replace_links(bridge(t), "image_id", changed, changed.select("image_id"))


@query("replace_own_labels", sql(""", own AS (SELECT id FROM labels WHERE created_by = 2), pk AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P')
SELECT image_id, label_id FROM bridge WHERE NOT (image_id IN (SELECT o_orderkey FROM pk) AND label_id IN (SELECT id FROM own))
UNION SELECT o_orderkey, o_custkey FROM pk WHERE o_custkey IN (SELECT id FROM own)"""))
def replace_own_labels(t):
    changed = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("label_id"))
    own = labels(t).where("created_by = 2").select(F.col("id").alias("label_id"))
    return ca.replace_links(bridge(t), "image_id", changed, changed.select("image_id"), own)


MERGES = ", mg AS (SELECT id AS source_id, min(id) OVER (PARTITION BY name, created_by) AS target_id FROM labels WHERE is_active)"


def merged(t):
    """Equal names of one owner become the label with the smallest id."""
    active = labels(t).where("is_active")
    target = active.groupBy("name", "created_by").agg(F.min("id").alias("target_id"))
    return ca.merge_labels(labels(t), bridge(t), active.join(target, ["name", "created_by"]).select(F.col("id").alias("source_id"), "target_id"))


@query("merge_labels_links", sql(MERGES + " SELECT DISTINCT image_id, coalesce(target_id, label_id) AS label_id FROM bridge LEFT JOIN mg ON source_id = label_id"))
def merge_labels_links(t):
    return merged(t)[1]


@query("merge_labels_state", sql(MERGES + " SELECT id, name, is_active AND id NOT IN (SELECT source_id FROM mg WHERE source_id <> target_id) AS is_active FROM labels"))
def merge_labels_state(t):
    return merged(t)[0].select("id", "name", "is_active")


# Each owner merges the red labels: into one of them renamed, into the owner's first old label, or into a new one.
REQUESTS = """, src AS (SELECT id, name, created_by AS owner FROM labels WHERE is_active AND name LIKE 'red%'),
rq AS (SELECT owner, CASE WHEN owner % 3 = 0 THEN upper(min(name)) WHEN owner % 3 = 1 THEN (SELECT min(name) FROM labels l WHERE l.is_active AND l.name LIKE 'old%' AND l.created_by = owner) ELSE 'Merged: ' || owner END AS target
  FROM src GROUP BY owner HAVING count(*) > 1),
tg AS (SELECT owner, target, (SELECT min(id) FROM labels l WHERE l.is_active AND l.created_by = owner AND lower(l.name) = lower(target)) AS known,
  (SELECT max(id) FROM labels) + count(*) FILTER (owner % 3 = 2) OVER (ORDER BY owner) AS made FROM rq WHERE target IS NOT NULL),
mv AS (SELECT id AS source_id, coalesce(known, made) AS target_id FROM src JOIN tg USING (owner))"""


def merge_requests(t):
    active = labels(t).where("is_active")
    old = active.where("name like 'old%'").groupBy(F.col("created_by").alias("owner")).agg(F.min("name").alias("old"))
    red = active.where("name like 'red%'").groupBy(F.col("created_by").alias("owner")).agg(F.collect_list("id").alias("source_ids"), F.upper(F.min("name")).alias("upper"))
    target = F.when(F.col("owner") % 3 == 0, F.col("upper")).when(F.col("owner") % 3 == 1, F.col("old")).otherwise(F.concat(F.lit("Merged: "), F.col("owner").cast("string")))
    requests = red.where("size(source_ids) > 1").join(old, "owner", "left").select(F.col("owner").alias("request_id"), "owner", "source_ids", target.alias("target_name")).where("target_name is not null")
    return ca.merge_labels_by_name(labels(t), bridge(t), requests)


@query("merge_labels_by_name", sql(REQUESTS + """ SELECT id, CASE WHEN tg.owner % 3 = 0 THEN target ELSE name END AS name,
  CASE WHEN tg.owner IS NULL OR tg.owner % 3 = 1 THEN slug WHEN row_number() OVER (PARTITION BY tg.owner % 3 = 0, target ORDER BY id) = 1 THEN replace(lower(target), ' ', '-')
    ELSE replace(lower(target), ' ', '-') || '-' || row_number() OVER (PARTITION BY tg.owner % 3 = 0, target ORDER BY id) END AS slug,
  color, created_by, is_active AND id NOT IN (SELECT source_id FROM mv WHERE source_id <> target_id) AS is_active FROM labels LEFT JOIN tg ON id = known
UNION ALL SELECT made, target, 'merged-' || owner, '#6366f1', owner, true FROM tg WHERE known IS NULL"""))
def merge_labels_by_name(t):
    return merge_requests(t)[0].select("id", "name", "slug", "color", "created_by", "is_active")


@query("merge_labels_by_name_links", sql(REQUESTS + " SELECT DISTINCT image_id, coalesce(target_id, label_id) AS label_id FROM bridge LEFT JOIN mv ON source_id = label_id"))
def merge_labels_by_name_links(t):
    return merge_requests(t)[1]


@query("delete_labels", sql(""", gone AS (SELECT id FROM labels WHERE created_by = 3)
SELECT 'label' AS kind, id, CASE WHEN is_active AND id NOT IN (SELECT id FROM gone) THEN 1 ELSE 0 END AS n FROM labels
UNION ALL SELECT 'item link', label_id, count(*) FROM bridge WHERE label_id NOT IN (SELECT id FROM gone) GROUP BY label_id
UNION ALL SELECT 'collection link', label_id, count(*) FROM collection_labels WHERE label_id NOT IN (SELECT id FROM gone) GROUP BY label_id"""))
def delete_labels(t):
    after, links, grouped = ca.delete_labels(labels(t), labels(t).where("created_by = 3").select("id"), bridge(t), collection_labels(t))
    size = lambda df, kind: df.groupBy(F.col("label_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "id", "n")
    state = after.select(F.lit("label").alias("kind"), "id", F.when(F.col("is_active"), 1).otherwise(0).cast("long").alias("n"))
    return state.unionByName(size(links, "item link")).unionByName(size(grouped, "collection link"))


ASKED = "SELECT DISTINCT upper(p_name) AS name FROM part UNION SELECT DISTINCT p_type || ' ' || p_brand FROM part"


def asked_names(t):
    return t.part.select(F.upper("p_name").alias("name")).union(t.part.select(F.concat_ws(" ", "p_type", "p_brand"))).distinct()


@query("ensure_labels_created", sql(f""", a AS ({ASKED}), m AS (SELECT lower(name) AS k, min(name) AS name FROM a WHERE lower(name) NOT IN (SELECT lower(name) FROM labels) GROUP BY 1)
SELECT (SELECT max(id) FROM labels) + row_number() OVER (ORDER BY k) AS id, name, replace(lower(name), ' ', '-') AS slug, 1 AS created_by FROM m"""))
def ensure_labels_created(t):
    return ca.ensure_labels(labels(t), asked_names(t))[0]


@query("ensure_labels_ids", sql(f""", a AS ({ASKED}), k AS (SELECT lower(name) AS k, min(id) AS id FROM labels GROUP BY 1),
m AS (SELECT k, (SELECT max(id) FROM labels) + row_number() OVER (ORDER BY k) AS id FROM (SELECT DISTINCT lower(name) AS k FROM a WHERE lower(name) NOT IN (SELECT k FROM k)))
SELECT name, coalesce(k.id, m.id) AS id FROM a LEFT JOIN k ON k.k = lower(name) LEFT JOIN m ON m.k = lower(name)"""))
def ensure_labels_ids(t):
    return ca.ensure_labels(labels(t), asked_names(t))[1]


@query("merge_fragments_by_id", """SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'late' WHEN p_brand < 'Brand#15' THEN 'middle' ELSE p_name END AS name FROM part""")
def merge_fragments(t):
    base = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    middle = t.part.where("p_brand < 'Brand#15'").select(F.col("p_partkey").alias("id"), F.lit("middle").alias("name"))
    late = t.part.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.lit("late").alias("name"))
    return ca.merge_by_id([base, middle, late])


@query("unique_slugs", """
WITH s AS (SELECT p_partkey AS id, replace(p_name, ' ', '-') AS base, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS i FROM part)
SELECT id, CASE WHEN base LIKE 'red%' THEN base || '-' || CASE WHEN i + 1 < 4 THEN i + 1 ELSE i + 2 END WHEN i = 1 THEN base ELSE base || '-' || i END AS slug FROM s""")
def unique_slugs(t):
    """Slugs of all part names; for the red ones the bare slug and the number 4 are already taken."""
    new = t.part.select(F.col("p_partkey").alias("id"), tx.slug(F.col("p_name")).alias("base"))
    red = new.where(F.col("base").startswith("red")).select("base").distinct()
    used = red.select(F.col("base").alias("slug")).union(red.select(F.concat("base", F.lit("-4"))))
    return nu.unique_slugs(new, used)


@query("last_id", "SELECT coalesce(max(o_orderkey), 0) AS last_id FROM orders")
def last_id(t):
    return nu.last_id(t.orders, "o_orderkey")


@query("number_rows", "SELECT doc_id, 5 + row_number() OVER (ORDER BY source, doc_id) AS number FROM documents")
def number_rows(t):
    return nu.number_rows(t.documents.select("doc_id", "source"), ["source", "doc_id"], "number", 5).select("doc_id", "number")


# ---------------------------------------------------------------- users and roles

@query("set_roles", sql(""", req AS (SELECT c_custkey AS user_id FROM customer WHERE c_nationkey = 7)
SELECT user_id, role_id FROM user_roles WHERE user_id NOT IN (SELECT user_id FROM req) UNION SELECT user_id, id FROM req, roles WHERE code IN ('ASIA', 'AFRICA')"""))
def set_roles(t):
    codes = F.array(F.lit(" asia"), F.lit("Africa "), F.lit("ASIA"), F.lit(" "))
    asked = t.customer.where("c_nationkey = 7").select(F.col("c_custkey").alias("user_id"), codes.alias("codes"))
    return ca.set_roles(user_roles(t), roles(t), asked)


APPROVE = ", ok AS (SELECT id FROM users WHERE NOT is_active AND password_hash = '' AND trim(description) <> '' AND id IN (SELECT o_custkey FROM orders))"


def approved(t):
    ids = t.orders.select(F.col("o_custkey").alias("id")).distinct()
    return ca.approve_requests(users(t), user_roles(t), ids, 2)


@query("approve_requests_users", sql(APPROVE + " SELECT id, email, is_active OR id IN (SELECT id FROM ok) AS is_active FROM users"))
def approve_requests_users(t):
    return approved(t)[0].select("id", "email", "is_active")


@query("approve_requests_roles", sql(APPROVE + " SELECT user_id, role_id FROM user_roles WHERE user_id NOT IN (SELECT id FROM ok) UNION SELECT id, 2 FROM ok"))
def approve_requests_roles(t):
    return approved(t)[1]


# ---------------------------------------------------------------- paging and samples

@query("page_of_items", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders) > 150 AS has_more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_of_items(t):
    return rk.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 2, 50)


@query("cut_results", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_totalprice > 400000) AS total, (SELECT count(*) FROM orders WHERE o_totalprice > 400000) > 20 AS has_more FROM orders WHERE o_totalprice > 400000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def cut_results(t):
    return rk.cut(t.orders.where("o_totalprice > 400000").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 20)


@query("random_candidates", "SELECT doc_id, source FROM documents ORDER BY md5(doc_id || '|10062026'), doc_id LIMIT 200")
def random_candidates(t):
    return rk.hash_sample(t.documents.select("doc_id", "source"), "doc_id", 200, 10062026)


@query("random_item", "SELECT doc_id, source FROM documents ORDER BY md5(doc_id || '|7'), doc_id LIMIT 1")
def random_item(t):
    return rk.random_row(t.documents.select("doc_id", "source"), "doc_id", 7)


@query("blank_template", "SELECT '' AS item_id, lang AS \"group\", n AS position, '' AS legibility FROM (SELECT DISTINCT lang FROM documents), range(1, 11) r(n)")
def blank_template(t):
    """Ten empty rows for each language found in the documents."""
    return rk.blank_template(t.documents.select(F.col("lang").alias("group")).distinct(), 10)
