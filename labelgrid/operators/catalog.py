"""Catalogue queries and upkeep: labels, items, notes, collections, users and roles.

Tables follow the column names of the catalogue: labels(id, name, slug, color,
created_by, is_active), bridge(image_id, label_id), notes(id, image_id,
author_id, body, updated_at), collections(id, ...). Updates return the new
state of a table; the caller writes it to a new place and switches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrid.functions import text as tx
from labelgrid.functions.labels import tag_norm
from labelgrid.operators.numbering import last_id, number_rows, unique_slugs
from labelgrid.session import dealt, through_table

CI_AI = "UNICODE_CI_AI"  # equality without case and accents


def folded(c: Column) -> Column:
    return F.collate(c, CI_AI)


# ---------------------------------------------------------------- predicates and projections

def project_hits(df: DataFrame, base_url: str) -> DataFrame:
    """What a result list shows: file name, link, title, score."""
    name = F.substring_index("path", "/", -1)
    return df.select("id", name.alias("filename"), F.concat(F.lit(base_url), name).alias("url"),
                     F.regexp_replace(name, r"\.[^.]*\z", "").alias("title"), "score")


def tags_any(tags: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(w) for w in wanted]))


def tags_all(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), tags)) == 0


def by_ids(items: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the asked ids with their position in the request; unknown ids are left out."""
    return items.join(ids.select(key, "position"), key)


def visible_on(day: Column, start: Column, end: Column) -> Column:
    """Within the period, both ends included; a missing end is open."""
    return (F.coalesce(start, day) <= day) & (day <= F.coalesce(end, day))


def public_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_public") & F.col("is_active"))


def active_labels(labels: DataFrame, owner=None) -> DataFrame:
    rows = labels.where("is_active")
    if owner is not None:
        rows = rows.where(F.col("created_by") == owner)
    return rows.orderBy("name", "id")


def search_labels(labels: DataFrame, q: str, owner=None, limit: int | None = None) -> DataFrame:
    """Active labels whose name or slug matches the text, in which ``%`` and ``_`` are wildcards."""
    rows = active_labels(labels, owner)
    pattern = tag_norm(F.lit(q.strip()))
    if q.strip():
        like = F.concat(F.lit("%"), pattern, F.lit("%"))
        rows = rows.where(F.like(tag_norm(F.col("name")), like) | F.like(tag_norm(F.col("slug")), like))
    return rows if limit is None else rows.limit(limit)


def contains_literal(c: Column, q: str) -> Column:
    """The text occurs as it stands, ignoring case and accents."""
    return F.contains(folded(c), folded(F.lit(q)))


def like_literal(c: Column, q: Column) -> Column:
    """LIKE with the three special characters of the search text escaped."""
    return F.like(c, F.concat(F.lit("%"), tx.escape_like(q), F.lit("%")))


def pending_users(users: DataFrame) -> DataFrame:
    """Sign-up requests: inactive, no password yet, a reason given; oldest first."""
    waiting = ~F.col("is_active") & (F.col("password_hash") == "") & ~tx.is_blank(F.col("description"))
    return users.where(waiting).orderBy("created_at", "id")


def has_any_role(roles: Column, wanted: list[str]) -> Column:
    return F.coalesce(tags_any(roles, wanted), F.lit(False))


def users_by_email(users: DataFrame, emails: DataFrame) -> DataFrame:
    """Accounts of the asked addresses, ignoring case."""
    asked = emails.select(F.lower(tx.strip(F.col("email"))).alias("_key")).distinct()
    return users.withColumn("_key", F.lower("email")).join(asked, "_key", "left_semi").drop("_key")


def duplicate_emails(users: DataFrame) -> DataFrame:
    return users.groupBy(F.lower("email").alias("email")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def accepted_only(files: DataFrame, accepted: DataFrame) -> DataFrame:
    return files.join(accepted, ["session", "filename"], "left_semi")


def split_by_stage(df: DataFrame, ready: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that passed the earlier stage, and rows that lack it."""
    ok = F.coalesce(ready, F.lit(False))
    return df.where(ok), df.where(~ok)


# ---------------------------------------------------------------- labels and items

def labels_for_items(bridge: DataFrame, labels: DataFrame, items: DataFrame | None = None, owner=None) -> DataFrame:
    """One row per item and active label."""
    links = bridge if items is None else bridge.join(items.select("image_id"), "image_id", "left_semi")
    active = labels.where("is_active")
    if owner is not None:
        active = active.where(F.col("created_by") == owner)
    return links.join(active, links.label_id == active.id).select("image_id", "id", "name", "slug", "color")


def nest_labels(rows: DataFrame) -> DataFrame:
    """Labels of each item as a list ordered by name; meant for the items of one page."""
    listed = F.array_sort(F.collect_list(F.struct("name", "id", "slug", "color")))
    return rows.groupBy("image_id").agg(listed.alias("labels"))


def item_detail(items: DataFrame, ids: DataFrame, bridge: DataFrame, labels: DataFrame, notes: DataFrame) -> DataFrame:
    """Asked items with their labels and each author's latest note, one row per label (or one without)."""
    asked = items.join(ids, "image_id", "left_semi")
    tagged = labels_for_items(bridge, labels, asked).select("image_id", F.col("id").alias("label_id"), F.col("name").alias("label"))
    latest = latest_note(notes).groupBy("image_id").agg(F.max(F.struct("updated_at", "id", "body"))["body"].alias("note"))
    return asked.join(tagged, "image_id", "left").join(latest, "image_id", "left")


def items_of_label(bridge: DataFrame, items: DataFrame, labels: DataFrame, label_id, owner) -> DataFrame:
    """Items of one of the owner's active labels in id order."""
    own = labels.where((F.col("id") == label_id) & (F.col("created_by") == owner) & F.col("is_active")).select(F.col("id").alias("label_id"))
    linked = bridge.join(own, "label_id", "left_semi").select("image_id").distinct()
    return items.join(linked, "image_id", "left_semi").orderBy("image_id")


def items_with_all(bridge: DataFrame, wanted: DataFrame) -> DataFrame:
    """Items that carry every wanted label (relational division)."""
    n = wanted.select(F.countDistinct("label_id").alias("need"))
    held = bridge.join(wanted.select("label_id").distinct(), "label_id", "left_semi").groupBy("image_id").agg(F.countDistinct("label_id").alias("have"))
    return held.join(F.broadcast(n)).where("have = need").select("image_id")


def items_with_any(bridge: DataFrame, wanted: DataFrame) -> DataFrame:
    return bridge.join(wanted.select("label_id").distinct(), "label_id", "left_semi").select("image_id").distinct()


def with_count(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str) -> DataFrame:
    """Left rows with the number of right rows of the same key, zero when there are none."""
    counts = right.groupBy(F.col(right_key).alias("_k")).agg(F.count(F.lit(1)).alias(name))
    return left.join(counts, left[left_key] == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)))


def labels_with_creator(labels: DataFrame, users: DataFrame) -> DataFrame:
    creators = users.select(F.col("id").alias("created_by"), F.col("full_name").alias("creator"))
    return labels.join(creators, "created_by", "left")


def users_with_roles(users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Every user with the sorted codes of the roles held, empty when none."""
    held = user_roles.join(roles.select(F.col("id").alias("role_id"), "code"), "role_id").groupBy("user_id").agg(
        F.array_join(F.sort_array(F.collect_set("code")), ",").alias("roles"))  # at most one entry per role
    return users.join(held, users.id == held.user_id, "left").drop("user_id").withColumn("roles", F.coalesce("roles", F.lit("")))


def known_only(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known, key, "left_semi")


def assert_all_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct ids of ``df``; one that the other table lacks fails the job."""
    seen = known.select(key, F.lit(True).alias("_known")).distinct()
    checked = df.select(key).distinct().join(seen, key, "left")
    return checked.select(F.when(F.col("_known"), F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit("unknown id: "), F.col(key).cast("string"))).cast(df.schema[key].dataType)).alias(key))


# ---------------------------------------------------------------- notes

def latest_note(notes: DataFrame) -> DataFrame:
    """Latest note of each item and author. A maximum, so copies are combined before the shuffle."""
    rest = [c for c in notes.columns if c not in ("image_id", "author_id", "updated_at", "id")]
    best = notes.groupBy("image_id", "author_id").agg(F.max(F.struct("updated_at", "id", *rest)).alias("b"))
    return best.select("image_id", "author_id", "b.updated_at", "b.id", *[f"b.{c}" for c in rest])


def single_note(notes: DataFrame, updates: DataFrame) -> DataFrame:
    """Notes after a save: one row per saved (item, author), the oldest id kept, its body replaced.

    A save whose cleaned body is empty removes the notes; a first save gets the next id.
    """
    keys = ["image_id", "author_id"]
    saved = updates.select(*keys, tx.clean_note(F.col("body")).alias("body"), "updated_at")
    kept = saved.where(~tx.note_is_empty(F.col("body")))
    oldest = notes.join(kept.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.min("id").alias("id"))
    changed = kept.join(oldest, keys).select("id", *keys, "body", "updated_at")
    first = kept.join(oldest, keys, "left_anti")
    top = last_id(notes).first()[0]
    added = number_rows(first, keys, "id", top).select("id", *keys, "body", "updated_at")
    untouched = notes.join(saved.select(*keys), keys, "left_anti").select("id", *keys, "body", "updated_at")
    return untouched.unionByName(changed).unionByName(added)


def _matching_notes(notes: DataFrame, q: str, author) -> DataFrame:
    rows = notes.where(contains_literal(F.col("body"), q))
    return rows if author is None else rows.where(F.col("author_id") == author)


def untagged_by_note(notes: DataFrame, bridge: DataFrame, labels: DataFrame, q: str, author=None, owner=None, limit: int | None = None) -> DataFrame:
    """Items with a matching note and none of the owner's active labels."""
    own = labels.where("is_active")
    if owner is not None:
        own = own.where(F.col("created_by") == owner)
    tagged = bridge.join(own.select(F.col("id").alias("label_id")), "label_id", "left_semi").select("image_id")
    found = _matching_notes(notes, q, author).select("image_id").distinct().join(tagged, "image_id", "left_anti")
    return found if limit is None else found.orderBy("image_id").limit(limit)


def labels_by_notes(labels: DataFrame, bridge: DataFrame, notes: DataFrame, q: str, author=None, owner=None, limit: int | None = None) -> DataFrame:
    """Active labels by the number of their items with a matching note, with all their items counted too."""
    items = _matching_notes(notes, q, author).select("image_id").distinct()
    matched = bridge.join(items, "image_id", "left_semi").groupBy("label_id").agg(F.countDistinct("image_id").alias("note_match_count"))
    own = active_labels(labels, owner).select("id", "name", "slug", "color")
    rows = own.join(matched, own.id == matched.label_id).drop("label_id")
    rows = with_count(rows, bridge, "id", "label_id", "image_count")
    ordered = rows.orderBy(F.desc("note_match_count"), "name", "id")
    return ordered if limit is None else ordered.limit(limit)


def with_untagged_bucket(rows: DataFrame, untagged: DataFrame) -> DataFrame:
    """The label rows plus one for items without label, when there are any."""
    n = untagged.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    # Id, name, slug and colour of the bucket.
    bucket = n.select(F.lit(0).cast("long").alias("id"), F.lit("Sin Etiquetar").alias("name"), F.lit("sin-etiquetar").alias("slug"),
                      F.lit("#94a3b8").alias("color"), F.col("n").alias("note_match_count"), F.col("n").alias("image_count"))
    return rows.select(*bucket.columns).unionByName(bucket)


# ---------------------------------------------------------------- collections

def collection_items(collection_images: DataFrame, collection_labels: DataFrame, bridge: DataFrame, parts: int | None = None) -> DataFrame:
    """Members: items put in directly, and items that carry a label of the collection; dealt to ``parts`` partitions, where given."""
    direct = collection_images.select("collection_id", "image_id")
    labelled = collection_labels.select("collection_id", "label_id").distinct().join(bridge, "label_id").select("collection_id", "image_id")
    return dealt(direct.union(labelled), parts, "collection_id", "image_id").distinct()


def collection_list(collections: DataFrame, members: DataFrame, collection_labels: DataFrame) -> DataFrame:
    """Collections with item count, first item and label count."""
    sizes = members.groupBy(F.col("collection_id").alias("id")).agg(F.count(F.lit(1)).alias("image_count"), F.min("image_id").alias("sample_image_id"))
    rows = collections.join(sizes, "id", "left").withColumn("image_count", F.coalesce("image_count", F.lit(0)))
    return with_count(rows, collection_labels, "id", "collection_id", "label_count")


def order_collections(collections: DataFrame) -> DataFrame:
    return collections.orderBy(F.desc("updated_at"), "name", "id")


def collection_detail(collections: DataFrame, members: DataFrame, items: DataFrame, notes: DataFrame) -> DataFrame:
    """Members of each collection with the creator's latest note on the item."""
    creator = collections.select(F.col("id").alias("collection_id"), "created_by")
    note = latest_note(notes).select("image_id", F.col("author_id").alias("created_by"), F.col("body").alias("note"))
    return members.join(creator, "collection_id").join(items, "image_id").join(note, ["image_id", "created_by"], "left")


def collection_label_counts(collection_labels: DataFrame, labels: DataFrame, bridge: DataFrame) -> DataFrame:
    """Active labels of each collection with the number of items that carry them."""
    rows = collection_labels.join(labels.where("is_active").select(F.col("id").alias("label_id"), "name"), "label_id")
    counts = bridge.groupBy("label_id").agg(F.count(F.lit(1)).alias("image_count"))
    return rows.join(counts, "label_id", "left").withColumn("image_count", F.coalesce("image_count", F.lit(0)))


def with_sort_order(lists: DataFrame, parent: str, ids: str, child: str) -> DataFrame:
    """A list column as rows with a 0-based position."""
    return lists.select(parent, F.posexplode(ids).alias("sort_order", child))


def patch_collections(collections: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply partial updates: ``patches`` carries ``id, patch map<string,string>`` with only the named fields.

    A blank text field becomes null; the slug follows a given slug, else a changed
    name, and is made unique against the slugs of the other collections.
    """
    p = patches.select("id", "patch")
    has = lambda key: F.coalesce(F.map_contains_key("patch", F.lit(key)), F.lit(False))
    raw = lambda key: F.nullif(tx.strip(F.element_at("patch", key)), F.lit(""))
    rows = collections.join(p, "id", "left").withColumn("_changed", F.col("patch").isNotNull())
    name = F.when(has("name") & raw("name").isNotNull(), raw("name")).otherwise(F.col("name"))
    base = (
        F.when(has("slug") & raw("slug").isNotNull(), tx.slug(raw("slug"), "coleccion"))
        .when(has("name") & (name != F.col("name")), tx.slug(name, "coleccion"))
    )
    html = tx.clean_note(F.element_at("patch", "description"))
    new = rows.withColumns({
        "_base": base,
        "name": name,
        "small_description": F.when(has("small_description"), raw("small_description")).otherwise(F.col("small_description")),
        "description": F.when(has("description"), F.when(~tx.note_is_empty(html), html)).otherwise(F.col("description")),
        "start_date": F.when(has("start_date"), tx.strict_date(F.element_at("patch", "start_date"))).otherwise(F.col("start_date")),
        "end_date": F.when(has("end_date"), tx.strict_date(F.element_at("patch", "end_date"))).otherwise(F.col("end_date")),
        "is_public": F.when(has("is_public"), raw("is_public").cast("boolean")).otherwise(F.col("is_public")),
        "is_active": F.when(has("is_active"), raw("is_active").cast("boolean")).otherwise(F.col("is_active")),
    })
    moved = new.where("_base is not null").select("id", F.col("_base").alias("base"))
    others = new.where("_base is null").select("slug")
    slugs = unique_slugs(moved, others).withColumnRenamed("slug", "_slug")
    out = new.join(slugs, "id", "left").withColumn("slug", F.coalesce("_slug", "slug"))
    return out.select(*collections.columns)


# ---------------------------------------------------------------- tags and links

def change_tags(items: DataFrame, changes: DataFrame, how: str) -> DataFrame:
    """Items after ``add``, ``remove`` or ``set`` of tags; an unknown item fails except for ``set``."""
    new = changes.select("image_id", F.col("tags").alias("_tags"))
    current = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    result = {
        "add": F.array_sort(F.array_union(current, F.col("_tags"))),
        "remove": F.filter(current, lambda t: ~F.array_contains(F.col("_tags"), t)),
        "set": F.col("_tags"),
    }[how]
    joined = items.withColumn("_known", F.lit(True)).join(new, "image_id", "left" if how == "set" else "full_outer")
    updated = F.when(F.col("_tags").isNull(), F.col("tags")).otherwise(result)
    if how != "set":
        updated = F.when(F.col("_known"), updated).otherwise(
            F.raise_error(F.concat(F.lit("unknown item: "), F.col("image_id").cast("string"))).cast("array<string>"))
    return joined.withColumn("tags", updated).select(*items.columns)


def all_tags(items: DataFrame) -> DataFrame:
    return items.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def replace_links(bridge: DataFrame, parent: str, new: DataFrame, parents: DataFrame, own: DataFrame | None = None, child: str = "label_id") -> DataFrame:
    """Replace the links of the given parents; with ``own`` only links to those children are replaced."""
    old = bridge.join(parents.select(parent), parent, "left_semi")
    if own is not None:
        old = old.join(own.select(child), child, "left_semi")
        new = new.join(own.select(child), child, "left_semi")
    kept = bridge.join(old, [parent, child], "left_anti")
    return kept.unionByName(new.select(*bridge.columns).dropDuplicates([parent, child])).dropDuplicates([parent, child])


def merge_labels(labels: DataFrame, bridge: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move the links of ``source_id`` to ``target_id`` and deactivate the sources."""
    move = merges.select(F.col("source_id").alias("label_id"), "target_id")
    relinked = bridge.join(move, "label_id", "left").select("image_id", F.coalesce("target_id", "label_id").alias("label_id")).distinct()
    gone = merges.where("source_id <> target_id").select(F.col("source_id").alias("id"), F.lit(True).alias("_gone")).distinct()
    after = labels.join(gone, "id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")
    return after, relinked


def merge_labels_by_name(labels: DataFrame, bridge: DataFrame, requests: DataFrame, color: str = "#6366f1") -> tuple[DataFrame, DataFrame]:
    """Labels and links after the merges in ``requests(request_id, owner, source_ids, target_name)``.

    The target is the source of that name (case ignored), else an active label of the owner with it, else a new label
    with a free slug and the colour of the first source (``color`` where that is none). A target named otherwise gets the
    new name and a fresh slug. Sources are relinked to the target and deactivated. Ids that are null or not positive are
    ignored. Fewer than two sources, a source that is missing, inactive or another user's, and a blank name or one of more than 255
    characters fail the job. Requests are one batch: a source or target of one must not be a source of another, which
    fails too; of several names for one target the last request's holds.
    """
    name = F.coalesce(tx.strip(F.col("target_name")), F.lit(""))
    ids = F.array_distinct(F.filter(F.coalesce("source_ids", F.array().cast("array<bigint>")), lambda x: x > 0))
    refuse = lambda what: F.raise_error(F.concat(F.lit(f"{what}: request "), F.col("request_id").cast("string")))
    asked = requests.select("request_id", "owner", name.alias("target_name"), ids.alias("ids"))
    asked = asked.withColumn("ids", F.when(F.size("ids") < 2, refuse("fewer than two labels").cast("array<bigint>")).otherwise(F.col("ids")))
    wrong = (F.col("target_name") == "") | (F.length("target_name") > 255)
    asked = asked.withColumn("target_name", F.when(wrong, refuse("no valid target name").cast("string")).otherwise(F.col("target_name")))
    asked = asked.withColumn("key", F.lower("target_name"))

    own = labels.select("id", F.lower("name").alias("_key"), F.col("color").alias("_color"), F.col("created_by").alias("_owner"), F.col("is_active").alias("_active"))
    usable = F.coalesce(F.col("_active") & (F.col("_owner") == F.col("owner")), F.lit(False))
    sources = asked.select("*", F.explode("ids").alias("id")).drop("ids").join(own, "id", "left")
    sources = through_table(sources.withColumn("id", F.when(usable, F.col("id")).otherwise(refuse("not an active label of the owner").cast("long"))), "merge-sources")
    wanted = sources.groupBy("request_id", "owner", "target_name", "key").agg(
        F.min(F.when(F.col("_key") == F.col("key"), F.col("id"))).alias("among"), F.min_by("_color", "id").alias("_color"))
    named = own.where("_active").groupBy(F.col("_owner").alias("owner"), F.col("_key").alias("key")).agg(F.min("id").alias("found"))
    wanted = wanted.join(named, ["owner", "key"], "left").withColumn("target_id", F.coalesce("among", "found"))

    missing = wanted.where("target_id is null").groupBy("owner", "key").agg(
        F.max_by("target_name", "request_id").alias("name"), F.min_by("_color", "request_id").alias("color"))
    made = through_table(number_rows(missing, ["owner", "key"], "made", last_id(labels).first()[0]), "merge-targets")
    targets = wanted.join(made.select("owner", "key", "made"), ["owner", "key"], "left")
    targets = through_table(targets.select("request_id", "target_name", F.coalesce("target_id", "made").alias("target_id")), "merge-wanted")
    used = sources.select("request_id", "id", F.lit(True).alias("source")).unionByName(targets.select("request_id", F.col("target_id").alias("id"), F.lit(False).alias("source")))
    shared = used.groupBy("id").agg(F.min("request_id").alias("a"), F.max("request_id").alias("b"), F.bool_or("source").alias("source")).where("source and a <> b")
    if not shared.isEmpty():
        raise ValueError(f"a label is merged by two requests: {shared.first()['id']}")

    names = targets.groupBy("target_id").agg(F.max_by("target_name", "request_id").alias("_name"))
    renamed = labels.join(names, F.col("id") == F.col("target_id")).where("name <> _name").select("id", "_name")
    fresh = renamed.select("id", tx.slug(F.col("_name")).alias("base")).unionByName(made.select(F.col("made").alias("id"), tx.slug(F.col("name")).alias("base")))
    slugs = through_table(unique_slugs(fresh, labels.select("slug")).withColumnRenamed("slug", "_slug"), "merge-slugs")
    values = {"id": F.col("made"), "name": F.col("name"), "color": tx.hex_color(F.col("color"), color), "created_by": F.col("owner"), "is_active": F.lit(True)}
    created = made.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in labels.schema])
    moves = sources.select("request_id", F.col("id").alias("source_id")).join(targets, "request_id").select("source_id", "target_id")
    after, relinked = merge_labels(labels.unionByName(created), bridge, moves)
    after = after.join(renamed, "id", "left").join(slugs, "id", "left")
    return after.withColumn("name", F.coalesce("_name", "name")).withColumn("slug", F.coalesce("_slug", "slug")).select(*labels.columns), relinked


def delete_labels(labels: DataFrame, ids: DataFrame, *bridges: DataFrame) -> tuple[DataFrame, ...]:
    """Unlink labels everywhere and deactivate them."""
    gone = ids.select(F.col("id"), F.lit(True).alias("_gone")).distinct()
    after = labels.join(gone, "id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")
    dead = gone.select(F.col("id").alias("label_id"))
    return (after, *[b.join(dead, "label_id", "left_anti") for b in bridges])


def ensure_labels(labels: DataFrame, names: DataFrame, created_by: int = 1) -> tuple[DataFrame, DataFrame]:
    """Create the names no label has yet (case and accents ignored); also the id of every asked name."""
    key = lambda c: tag_norm(F.col(c))
    known = labels.withColumn("_k", key("name")).groupBy("_k").agg(F.min("id").alias("id"))
    asked = names.where(~tx.is_blank(F.col("name"))).select("name", key("name").alias("_k"))
    missing = asked.join(known, "_k", "left_anti").groupBy("_k").agg(F.min("name").alias("name"))
    top = last_id(labels).first()[0]
    made = number_rows(missing, ["_k"], "id", top)
    created = made.select("id", "name", F.replace(F.lower("name"), F.lit(" "), F.lit("-")).alias("slug"), F.lit(created_by).cast("long").alias("created_by"))
    ids = asked.join(known.unionByName(made.select("_k", "id")), "_k").select("name", "id").distinct()
    return created, ids


def merge_by_id(fragments: list[DataFrame]) -> DataFrame:
    """Later fragments win per id. A maximum over the fragment number, not a window."""
    tagged = reduce(DataFrame.unionByName, [f.withColumn("_batch", F.lit(i)) for i, f in enumerate(fragments)])
    rest = [c for c in fragments[0].columns if c != "id"]
    best = tagged.groupBy("id").agg(F.max_by(F.struct(*rest), "_batch").alias("b"))
    return best.select("id", *[F.col(f"b.{c}").alias(c) for c in rest])


# ---------------------------------------------------------------- users and roles

def clean_role_codes(codes: Column) -> Column:
    """Upper-case, without blanks and repeats, sorted."""
    upper = F.transform(codes, lambda c: F.upper(tx.strip(c)))
    return F.array_sort(F.array_distinct(F.filter(upper, lambda c: c != "")))


def set_roles(user_roles: DataFrame, roles: DataFrame, requests: DataFrame) -> DataFrame:
    """Replace the roles of the users in ``requests(user_id, codes)`` by the codes asked for.

    A code that is no role, or a list without any code, fails the job; nothing is replaced then.
    """
    asked = requests.select("user_id", F.explode_outer(clean_role_codes(F.col("codes"))).alias("code"))
    found = asked.join(roles.select("code", F.col("id").alias("role_id")), "code", "left")
    refused = F.raise_error(F.concat(F.lit("no such role: "), F.coalesce("code", F.lit("(empty list)"))))
    new = found.select("user_id", F.when(F.col("role_id").isNull(), refused.cast(roles.schema["id"].dataType)).otherwise(F.col("role_id")).alias("role_id"))
    return replace_links(user_roles.select("user_id", "role_id"), "user_id", new, requests, child="role_id")


def approve_requests(users: DataFrame, user_roles: DataFrame, ids: DataFrame, role_id: int) -> tuple[DataFrame, DataFrame]:
    """Activate the users that are still pending and give each the one role."""
    approved = pending_users(users).join(ids, "id", "left_semi").select("id", F.lit(True).alias("_ok"))
    after = users.join(approved, "id", "left").withColumn("is_active", F.col("is_active") | F.coalesce("_ok", F.lit(False))).drop("_ok")
    given = approved.select(F.col("id").alias("user_id"), F.lit(role_id).cast(user_roles.schema["role_id"].dataType).alias("role_id"))
    return after, replace_links(user_roles.select("user_id", "role_id"), "user_id", given, given, child="role_id")
