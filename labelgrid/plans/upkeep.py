"""Files, index upkeep, audits and stream replays over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrid.operators import audit as au
from labelgrid.operators.encode import encode_column
from labelgrid.operators.search import segments_of
from labelgrid.plans import catalog as pc
from labelgrid.plans import evaluation as pe
from labelgrid.plans import sqltext as s
from labelgrid.plans.registry import query
from labelgrid.plans.search import GATE
from labelgrid.session import shared_folder, spread
from labelgrid.sources import files as fi
from labelgrid.sources import index as ix
from labelgrid.streaming import jobs as st

# ---------------------------------------------------------------- files


@query("csv_queries", f"SELECT CAST(item_id AS VARCHAR) AS query_id, {s.strip('text')} AS text, 'textual' AS query_type FROM benchmark UNION ALL SELECT 'd' || doc_id, {s.strip('text')}, lang FROM documents")
def csv_queries(t):
    """Texts with quotes and line breaks written as CSV and read back."""
    rows = t.benchmark.select(F.col("item_id").cast("string").alias("query_id"), F.concat(F.lit(" "), "text", F.lit(" ")).alias("query"), F.lit("textual").alias("type"))
    more = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("query_id"), F.col("text").alias("query"), F.col("lang").alias("type"))
    path = shared_folder(t.spark, "csv")
    fi.write_report(rows.unionByName(more), path, "csv")
    return fi.read_queries(t.spark, path)


@query("json_text_cache", "SELECT lang AS field, CAST(doc_id AS VARCHAR) AS item_id, text FROM documents")
def json_text_cache(t):
    """Nested maps, one object per line."""
    nested = t.documents.select(F.to_json(F.create_map("lang", F.create_map(F.col("doc_id").cast("string"), F.col("text")))).alias("value"))
    path = shared_folder(t.spark, "cache")
    nested.write.text(path)
    return fi.read_text_cache(t.spark, path, whole_file=False)


@query("catalog_table", pc.sql(""" SELECT id, name, slug, description, color, created_by, is_active, NULL::TIMESTAMP AS created_at, NULL::TIMESTAMP AS updated_at FROM labels"""))
def catalog_table(t):
    """The labels written as a catalogue table and read under the catalogue's schema."""
    path = shared_folder(t.spark, "catalog")
    none = F.lit(None).cast("timestamp_ntz")
    pc.labels(t).withColumns({"created_at": none, "updated_at": none}).write.parquet(f"{path}/labels")
    return fi.read_catalog(t.spark, "labels", path)


QREL_PATTERN = r"^\d+\z"


@query("json_qrels_graded", "SELECT source AS query_id, CAST(doc_id AS VARCHAR) AS item_id, quality + toxic AS gain, quality + toxic >= 2 AS relevant FROM documents JOIN labels USING (doc_id)")
def json_qrels_graded(t):
    rows = t.documents.join(t.labels, "doc_id").select(
        F.to_json(F.create_map("source", F.create_map(F.col("doc_id").cast("string"), F.col("quality") + F.col("toxic")))).alias("value"))
    path = shared_folder(t.spark, "qrels")
    rows.write.text(path)
    return fi.read_qrels(t.spark, path + "-absent", path, threshold=2, whole_file=False, pattern=QREL_PATTERN)


@query("json_qrels_binary", "SELECT source AS query_id, CAST(doc_id AS VARCHAR) AS item_id, quality AS gain, quality = 1 AS relevant FROM documents JOIN labels USING (doc_id)")
def json_qrels_binary(t):
    rows = t.documents.join(t.labels, "doc_id").select(F.to_json(F.create_map("source", F.create_map(F.col("doc_id").cast("string"), "quality"))).alias("value"))
    path = shared_folder(t.spark, "qrels")
    rows.write.text(path)
    return fi.read_qrels(t.spark, path, path + "-absent", whole_file=False, pattern=QREL_PATTERN)


@query("explode_rankings", "SELECT p_partkey AS query_id, 'name' AS system, string_split(p_name, ' ')[pos] AS item_id, pos AS rank FROM (SELECT *, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS pos FROM part)")
def explode_rankings(t):
    return fi.explode_rankings(t.part.select(F.col("p_partkey").alias("query_id"), F.lit("name").alias("system"), F.split("p_name", " ").alias("items")))


@query("build_corpus", "SELECT doc_id AS item_id, coalesce(d.text, '') AS text, '/img/' || doc_id || '.png' AS path, doc_id || '.png' AS filename FROM labels LEFT JOIN (SELECT * FROM documents WHERE lang <> 'fr') d USING (doc_id)")
def build_corpus(t):
    texts = t.documents.where("lang <> 'fr'").select(F.col("doc_id").alias("item_id"), "text")
    files = t.documents.select(F.col("doc_id").alias("item_id"), F.concat(F.lit("/img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return fi.build_corpus(t.labels.select(F.col("doc_id").alias("item_id")), texts, files)


@query("scan_payload", "SELECT vec_id, label FROM embeddings")
def scan_payload(t):
    return fi.scan_payload(t.embeddings)


@query("image_uploads_only", "SELECT page_id FROM pages WHERE url LIKE 'https:%'")
def image_uploads_only(t):
    kind = F.when(F.col("url").startswith("https:"), "image/png").when(F.col("page_id") % 2 == 0, "text/html")
    return fi.filter_media(t.pages.select("page_id", kind.alias("content_type"))).select("page_id")


@query("report_round_trip", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def report_round_trip(t):
    """Counts written as JSON, one directory per language, and read back."""
    path = shared_folder(t.spark, "report")
    fi.write_report(t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), path, "json", ["source", "n", "lang"], ["lang"])
    return t.spark.read.schema("source string, n long, lang string").json(path)


# ---------------------------------------------------------------- index upkeep

def items(t):
    return t.documents.select(F.col("doc_id").alias("item_id"), "text")


@query("index_build_report", f"""WITH {s.segments('full', 'documents', 'doc_id', 'text', 'full')}, {s.segments('seg', 'documents', 'doc_id', 'text')}
SELECT 'full' AS system, count(*) AS points, count(DISTINCT item_id) AS items FROM full_units JOIN "full" USING (item_id)
UNION ALL SELECT 'segmented', count(*), count(DISTINCT item_id) FROM seg""".replace("FROM full_units JOIN \"full\" USING (item_id)", "FROM \"full\"").replace("full AS (SELECT item_id, item_id", "\"full\" AS (SELECT item_id, item_id"))
def index_build_report(t):
    """Two indexes are built, then asked for again, which reuses them. The joined texts are in both, so they are encoded once."""
    folder = shared_folder(t.spark, "indexes")
    for _ in range(2):
        segmented = ix.build_index(t.spark, segments_of(items(t)), "segmented", folder, lambda d: encode_column(d, "segment_text"))
    for _ in range(2):
        full = ix.build_index(t.spark, ix.joined_units(segmented), "full", folder, lambda encoded: encoded)
    return ix.index_report({"full": full, "segmented": segmented})


@query("index_point_keys", f"WITH {s.segments('seg', 'documents', 'doc_id', 'text')} SELECT segment_id, sha1('segmented:' || segment_id) AS point_id FROM seg")
def index_point_keys(t):
    return segments_of(items(t)).select("segment_id", ix.point_key("segmented", "segment_id").alias("point_id"))


REBUILT = f"{s.segments('seg', 'documents', 'doc_id', 'text')}, old AS (SELECT item_id, row_number() OVER (ORDER BY segment_id) AS segment_id, segment_text FROM seg)"


@query("rebuild_segments", f"WITH {REBUILT} SELECT item_id, segment_id, segment_text FROM old")
def rebuild_segments(t):
    return ix.rebuild_segments(spread(items(t)))


@query("append_items", f"""WITH {REBUILT}, nw AS (SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY page_id) AS doc_id, page_id, url AS text FROM pages),
{s.segments('ns', 'nw', 'doc_id', 'text')} SELECT item_id, (SELECT max(segment_id) FROM old) + row_number() OVER (ORDER BY ns.segment_id) AS segment_id, segment_text FROM ns""")
def append_items(t):
    """Every page address becomes a new item."""
    segments = ix.rebuild_segments(spread(items(t)))
    return ix.append_items(items(t), segments, t.pages.select("page_id", F.col("url").alias("text")), "page_id")[1]


UPDATED = f"""{REBUILT}, up AS (SELECT doc_id, 'first line' || chr(10) || source AS text FROM documents WHERE lang = 'es'), {s.segments('us', 'up', 'doc_id', 'text')}"""


def updated(t):
    changes = t.documents.where("lang = 'es'").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("first line\n"), "source").alias("text"))
    return ix.replace_segments(items(t), ix.rebuild_segments(spread(items(t))), changes)


@query("replace_segments", f"""WITH {UPDATED} SELECT item_id, segment_id, segment_text FROM old WHERE item_id NOT IN (SELECT doc_id FROM up)
UNION ALL SELECT item_id, (SELECT max(segment_id) FROM old) + row_number() OVER (ORDER BY us.segment_id), segment_text FROM us""")
def replace_segments(t):
    return updated(t)[1]


@query("replace_item_texts", f"WITH {UPDATED} SELECT d.doc_id AS item_id, coalesce(up.text, d.text) AS text FROM documents d LEFT JOIN up USING (doc_id)")
def replace_item_texts(t):
    return updated(t)[0]


@query("delete_items", f"WITH {REBUILT} SELECT item_id, segment_id FROM old WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_items(t):
    gone = t.labels.where("toxic = 1").select(F.col("doc_id").alias("item_id"))
    return ix.delete_items(items(t), ix.rebuild_segments(spread(items(t))), gone)[1].select("item_id", "segment_id")


# ---------------------------------------------------------------- audits

def input_checks(t):
    d = t.documents.select(F.col("doc_id").alias("item_id"), "text", "lang", "source")
    field = lambda name, text: d.select(F.lit(name).alias("field"), "item_id", text.alias("text"))
    cache = field("whole", F.col("text")).unionByName(field("lang", F.when(F.col("lang") == "fr", " ").otherwise(F.col("lang")))).unionByName(
        field("source", F.col("source")).where("text <> 'src3'"))
    qrels = t.labels.where("quality = 1").join(t.documents, "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item_id"), F.col("quality").alias("gain"))
    queries = t.documents.select(F.col("source").alias("query_id")).distinct()
    files = t.pages.select(F.col("page_id").alias("item_id"))
    return au.audit_inputs(queries, cache, d, files, qrels, 20, 1000, ["whole", "lang", "source"], graded=False)


INPUTS = """
d AS (SELECT doc_id, text, source, CASE WHEN lang = 'fr' THEN ' ' ELSE lang END AS lang FROM documents),
cache AS (SELECT 'whole' AS field, doc_id, text FROM d UNION ALL SELECT 'lang', doc_id, lang FROM d UNION ALL SELECT 'source', doc_id, source FROM d WHERE source <> 'src3'),
c AS (SELECT field, count(DISTINCT doc_id) AS n, count(*) FILTER (trim(text) = '') AS empty FROM cache GROUP BY field),
nd AS (SELECT count(*) AS n FROM documents),
chk AS (
SELECT 'query_count' AS name, count(DISTINCT source) = 20 AS ok, 'found=' || count(DISTINCT source) || ' expected=20' AS detail FROM documents
UNION ALL SELECT field || '_count', n = 1000, 'found=' || n || ' expected=1000' FROM c
UNION ALL SELECT field || '_canonical_ids', c.n = nd.n, 'missing=' || (nd.n - c.n) || ' unknown=0' FROM c, nd
UNION ALL SELECT field || '_nonempty', empty = 0, 'empty=' || empty FROM c
UNION ALL SELECT 'representation_id_sets_identical', count(*) FILTER (source = 'src3') = 0, 'uneven=' || count(*) FILTER (source = 'src3') FROM d
UNION ALL SELECT 'image_count', m = 0 AND u = 0, 'missing=' || m || ' unknown=' || u FROM (SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)) AS m, (SELECT count(*) FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents)) AS u)
UNION ALL SELECT 'qrels_query_coverage', m = 0, 'missing=' || m || ' unknown=0' FROM (SELECT 20 - count(DISTINCT source) AS m FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
UNION ALL SELECT 'qrels_ids_known', true, 'unknown=0'
UNION ALL SELECT 'queries_have_qrels', m = 0, 'missing=' || m FROM (SELECT 20 - count(DISTINCT source) AS m FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
UNION ALL SELECT 'qrels_format', true, 'binary=True')"""


@query("audit_inputs", f"WITH {INPUTS} SELECT name, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status, true AS critical, detail FROM chk")
def audit_inputs(t):
    return input_checks(t)


@query("audit_status", f"WITH {INPUTS} SELECT 'fail' AS status, count(*) + 1 AS checks, count(*) FILTER (NOT ok) AS failed, 1 AS skipped FROM chk")
def audit_status(t):
    return au.audit_status(input_checks(t).unionByName(au.skipped(t.spark, "rankings_full_exists", "not generated yet")), strict=True)


@query("audit_index", f"""WITH {s.segments('seg', 'documents', 'doc_id', 'text')}, l AS (SELECT doc_id FROM labels),
n AS (SELECT count(*) AS p, count(DISTINCT item_id) AS i FROM seg), x AS (SELECT (SELECT count(DISTINCT item_id) FROM seg WHERE item_id NOT IN (SELECT doc_id FROM l)) AS u, (SELECT count(*) FROM l WHERE doc_id NOT IN (SELECT item_id FROM seg)) AS m)
SELECT 'collection_docs_eval_ids' AS name, CASE WHEN u = 0 AND m = 0 THEN 'pass' ELSE 'fail' END AS status, true AS critical, 'missing=' || m || ' unknown=' || u AS detail FROM x
UNION ALL SELECT 'collection_docs_payload', 'pass', true, 'points=' || p || ' items=' || i || ' bad=0' FROM n
UNION ALL SELECT 'collection_docs_no_external_docs', CASE WHEN u = 0 THEN 'pass' ELSE 'fail' END, true, 'unknown=' || u FROM x
UNION ALL SELECT 'collection_docs_one_full_per_label', CASE WHEN m = 0 THEN 'pass' ELSE 'fail' END, true, 'invalid=' || m FROM x""")
def audit_index(t):
    """Segments of all documents checked against the labelled ones, which are fewer."""
    kind = F.when(F.col("segment_id") == F.col("item_id") * 1_000_000, "full").otherwise("segment")
    payloads = segments_of(items(t)).withColumn("segment_type", kind)
    return au.audit_index("docs", payloads, t.labels.select(F.col("doc_id").alias("item_id")), required=["item_id", "segment_id", "segment_type", "segment_text"])


@query("audit_rankings", f"""WITH {pe.RANKS}, g AS (SELECT query_id, system, count(*) AS n, bool_or(complete) AS c FROM ranks GROUP BY ALL)
SELECT 'ranking_query_set' AS name, 'pass' AS status, true AS critical, 'missing=0 unknown=0' AS detail
UNION ALL SELECT 'ranking_' || query_id || '_' || system || '_unique', 'pass', true, 'depth=' || n || ' unique=' || n FROM g
UNION ALL SELECT 'ranking_' || query_id || '_' || system || '_known', 'pass', true, 'unknown=0' FROM g
UNION ALL SELECT 'ranking_' || query_id || '_' || system || '_complete', CASE WHEN n = 25 THEN 'pass' ELSE 'fail' END, true, 'depth=' || n FROM g WHERE c
UNION ALL SELECT 'all_systems_use_same_queries', 'pass', true, 'uneven=0'""")
def audit_rankings(t):
    expected = t.part.select(F.col("p_brand").alias("item_id")).distinct()
    return au.audit_rankings(pe.rankings(t), t.nation.select(F.col("n_nationkey").alias("query_id")), expected, 25)


@query("audit_keys", pc.sql("""SELECT name, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status, true AS critical, w || '=' || n AS detail FROM (
SELECT 'key_labels_id' AS name, 'duplicates' AS w, 0 AS n UNION ALL SELECT 'key_labels_name', 'duplicates', (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'key_image_labels_image_id_label_id', 'duplicates', 0
UNION ALL SELECT 'reference_image_labels_label_id', 'dangling', (SELECT count(*) FROM bridge WHERE label_id NOT IN (SELECT id FROM labels WHERE is_active))
UNION ALL SELECT 'reference_labels_created_by', 'dangling', (SELECT count(*) FROM labels WHERE is_active AND created_by NOT IN (SELECT id FROM users)))""").replace(
    "(SELECT p_name FROM part GROUP BY", "(SELECT p_name FROM part WHERE p_size % 5 <> 0 GROUP BY"))
def audit_keys(t):
    tables = {"labels": pc.labels(t).where("is_active"), "image_labels": pc.bridge(t), "users": pc.users(t)}
    keys = {"labels": [["id"], ["name"]], "image_labels": [["image_id", "label_id"]]}
    return au.audit_keys(tables, keys, [("image_labels", "label_id", "labels", "id"), ("labels", "created_by", "users", "id")])


@query("ids_missing_and_unknown", "SELECT 'missing' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unknown', page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def ids_missing_and_unknown(t):
    missing = au.only_in(t.documents, t.labels, "doc_id").select(F.lit("missing").alias("side"), "doc_id")
    pages = t.pages.select(F.col("page_id").alias("doc_id"))
    return missing.unionByName(au.only_in(pages, t.labels, "doc_id").select(F.lit("unknown").alias("side"), "doc_id"))


# ---------------------------------------------------------------- stream replays

def event_stream(t):
    schema = t.events.schema
    rows = st.file_stream(t.spark, f"{t.folder}/events.parquet", schema)
    phase = F.when((F.col("event_type") == "signup") & (F.col("value") > 50), "end").otherwise(F.col("event_type"))
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"), F.get_json_object("props", "$.k").alias("item"), phase.alias("phase"),
                       F.col("event_id").alias("seq"), F.concat_ws(":", "event_type", F.col("value").cast("decimal(12,2)").cast("string")).alias("text"), (F.col("event_type") != "error").alias("ok"), "value")


SESSIONS = """
ev AS (SELECT user_id AS session, json_extract_string(props, '$.k') AS item, CASE WHEN event_type = 'signup' AND value > 50 THEN 'end' ELSE event_type END AS phase, event_id AS seq,
       event_type || ':' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS text, event_type <> 'error' AS ok FROM events),
st AS (SELECT session, item, max(seq) AS seq, arg_max(phase, seq) AS phase, arg_max(text, seq) AS text FROM ev WHERE phase <> 'end' GROUP BY session, item)"""


def state(t):
    folder = shared_folder(t.spark, "sessions")
    return st.session_view(st.to_table(event_stream(t), folder, st.session_state))


@query("session_state_replay", f"WITH {SESSIONS} SELECT session, item, seq, phase, text FROM st")
def session_state_replay(t):
    return state(t)


@query("ended_sessions_removed", f"WITH {SESSIONS} SELECT session, item, seq, phase, text FROM st WHERE session NOT IN (SELECT session FROM ev WHERE phase = 'end')")
def ended_sessions_removed(t):
    ended = t.events.where("event_type = 'signup' AND value > 50").select(F.col("user_id").alias("session")).distinct()
    return st.end_sessions(state(t), ended)


@query("progress_replay", f"WITH {SESSIONS} SELECT session, phase, count(*) AS processed, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS errors FROM ev GROUP BY session, phase")
def progress_replay(t):
    folder = shared_folder(t.spark, "progress")
    return st.progress_view(st.to_table(event_stream(t), folder, st.progress_counts))


@query("activity_replay", """SELECT DISTINCT event_id // 10 AS request, nullif(user_id % 3, 0) AS user_id, CASE WHEN event_type = 'click' THEN 'POST' ELSE 'GET' END AS method, '/' || event_type AS path,
CASE WHEN event_type = 'click' THEN 'data_change' ELSE 'api_request' END AS action FROM events""")
def activity_replay(t):
    rows = st.file_stream(t.spark, f"{t.folder}/events.parquet", t.events.schema).select(
        F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("event_id") / 10).alias("request"), (F.col("user_id") % 3).alias("user_id"), F.lit("").alias("user_email"),
        F.when(F.col("event_type") == "click", "POST").otherwise("GET").alias("method"), F.concat(F.lit("/"), "event_type").alias("path"))
    return st.activity_view(st.to_table(rows, shared_folder(t.spark, "activity"), st.activity_rows)).select("request", "user_id", "method", "path", "action")


@query("ingest_replay", GATE + """,
res AS (SELECT doc_id, CASE WHEN verify > 0.9 THEN 'duplicate' ELSE 'indexed' END AS status FROM documents LEFT JOIN v ON v.id = doc_id)
SELECT res.doc_id, status, i.item_id FROM res LEFT JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS item_id FROM res WHERE status = 'indexed') i USING (doc_id)""")
def ingest_replay(t):
    docs = st.file_stream(t.spark, f"{t.folder}/documents.parquet", t.documents.schema).select("doc_id", "text", F.lit("image/png").alias("content_type"))
    events, index = st.ingest_stream(docs, shared_folder(t.spark, "ingest"))
    return events.join(index.select("doc_id", "item_id"), "doc_id", "left").select("doc_id", "status", "item_id")
