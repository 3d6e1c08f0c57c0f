"""Text functions as jobs over documents, pages, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrid.functions import text as tx
from labelgrid.functions import vectors as vec
from labelgrid.operators import encode as en
from labelgrid.operators.numbering import number_in_group
from labelgrid.operators.search import segments_of
from labelgrid.plans import sqltext as s
from labelgrid.plans.registry import query
from labelgrid.session import spread
from labelgrid.sources.index import evaluation_segments


def docs(t):
    return spread(t.documents.select("doc_id", "text"))


def items(t):
    return t.documents.select(F.col("doc_id").alias("item_id"), "text")


for _mode in ("full", "segments", "both"):
    query(f"line_units_{_mode}", f"WITH {s.segments('seg', 'documents', 'doc_id', 'text', _mode)} SELECT item_id, segment_id, segment_text FROM seg")(
        lambda t, mode=_mode: segments_of(items(t), mode))


def _norm(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def segments_sql(text: str) -> str:
    """CTE ``seg`` (doc_id, whole, segs): blocks, sentences and first occurrences; look-around is put as a mark between kept groups."""
    heading = "'^[^.!?]{2,120}:$'"
    fold = "replace(translate(lower(x), 'ς', 'σ'), 'ß', 'ss')"
    return rf"""
ln AS (SELECT doc_id, {_norm(text)} AS whole, list_transform(string_split({text}, chr(10)), lambda x: {_norm('x')}) AS ls FROM documents),
mk AS (SELECT doc_id, whole, array_to_string(list_transform(ls, lambda x: CASE WHEN x = '' THEN chr(1) WHEN regexp_matches(x, {heading}) THEN chr(1) || x || chr(2)
       ELSE regexp_replace(x, '^\s*[-*•]\s*', '') END), ' ') AS t FROM ln),
bl AS (SELECT doc_id, whole, list_transform(string_split(t, chr(1)), lambda x: CASE WHEN NOT contains(x, chr(2)) THEN {_norm('x')}
       WHEN {_norm("split_part(x, chr(2), 2)")} = '' THEN '' ELSE {_norm("split_part(x, chr(2), 1) || ' ' || split_part(x, chr(2), 2)")} END) AS bs FROM mk),
st AS (SELECT doc_id, whole, flatten(list_transform(bs, lambda x: string_split(regexp_replace(x, '([.!?])\s+([A-ZÁÉÍÓÚÜÑ0-9])', '\1' || chr(3) || '\2', 'g'), chr(3)))) AS ss FROM bl),
kp AS (SELECT doc_id, whole, list_filter(list_transform(ss, lambda x: {_norm('x')}), lambda x: x <> '' AND NOT regexp_matches(x, {heading}) AND x <> whole) AS ss FROM st),
fo AS (SELECT doc_id, whole, ss, list_transform(ss, lambda x: {fold}) AS fs FROM kp),
seg AS (SELECT doc_id, whole, list_filter(ss, lambda x, i: list_position(fs, fs[i]) = i) AS segs FROM fo)"""


MARKED = r"(substr(split_part(text, '.', 1), 1, 80) || ':' || chr(10) || '- ' || replace(text, chr(10), chr(10) || chr(10) || '* '))"


@query("semantic_segments", f"WITH {segments_sql(MARKED)} SELECT doc_id, unnest(range(len(segs))) AS pos, unnest(segs) AS segment FROM seg")
def semantic_segments(t):
    """Documents have no headings, so the first line of each is turned into one; bullets and blank lines are put in."""
    marked = F.concat(F.substring(F.split_part("text", F.lit("."), F.lit(1)), 1, 80), F.lit(":\n- "), F.regexp_replace("text", "\n", "\n\n* "))
    return docs(t).select("doc_id", F.posexplode(tx.semantic_segments(marked)).alias("pos", "segment"))


@query("text_units", f"""WITH {segments_sql("text")}
SELECT doc_id, doc_id || ':full' AS segment_id, 'full' AS segment_type, whole AS segment_text FROM seg WHERE whole <> ''
UNION ALL SELECT doc_id, format('{{}}:segment:{{:03d}}', doc_id, n), 'segment', s FROM (SELECT doc_id, unnest(range(1, len(segs) + 1)) AS n, unnest(segs) AS s FROM seg WHERE len(segs) > 1)""")
def text_units(t):
    return evaluation_segments(spread(items(t)), "full_plus_segments").withColumnRenamed("item_id", "doc_id")


@query("text_units_full", r"SELECT doc_id, 'full' AS segment_type, trim(regexp_replace(text, '\s+', ' ', 'g')) AS segment_text FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''")
def text_units_full(t):
    return docs(t).select("doc_id", F.explode(tx.text_units(F.col("text"), "full_description")).alias("u")).select("doc_id", "u.*")


@query("normalised_space", r"SELECT page_id, trim(regexp_replace(html, '\s+', ' ', 'g')) AS text FROM pages")
def normalised_space(t):
    return t.pages.select("page_id", tx.norm_ws(F.col("html")).alias("text"))


@query("search_tokens", f"SELECT doc_id, len({s.tokens('text')}) AS n, array_to_string({s.tokens('text')}, ' ') AS tokens FROM documents")
def search_tokens(t):
    tokens = tx.search_tokens(F.col("text"))
    return docs(t).select("doc_id", F.size(tokens).cast("long").alias("n"), F.array_join(tokens, " ").alias("tokens"))


@query("ocr_normal_form", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents")
def ocr_normal_form(t):
    return docs(t).select("doc_id", tx.ocr_norm(F.col("text")).alias("norm"))


@query("slugs", r"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(trim(split_part(text, '.', 1))), '[^\p{L}\p{N}]+', '-', 'g'), '-'), ''), 'etiqueta') AS slug FROM documents""")
def slugs(t):
    return docs(t).select("doc_id", tx.slug(F.split_part("text", F.lit("."), F.lit(1))).alias("slug"))


@query("hex_colors", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '#' || lower(printf('%06X', p_partkey)) ELSE '#6366f1' END AS color FROM part")
def hex_colors(t):
    """Even sizes have a colour in capitals between spaces, odd ones one of five digits, whatever the key, which is none."""
    five = F.format_string("#%05X", F.col("p_partkey") % (1 << 20))
    raw = F.when(F.col("p_size") % 2 == 0, F.format_string(" #%06X ", "p_partkey")).otherwise(five)
    return t.part.select("p_partkey", tx.hex_color(raw, "#6366f1").alias("color"))


@query("strict_dates", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def strict_dates(t):
    raw = F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return t.orders.select("o_orderkey", F.date_format(tx.strict_date(raw), "yyyy-MM-dd").alias("day"))


@query("date_captions", """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'Desde ' || strftime(o_orderdate, '%d/%m/%Y') WHEN 'F' THEN 'Hasta ' || strftime(o_orderdate + INTERVAL 90 DAY, '%d/%m/%Y')
ELSE 'Del ' || strftime(o_orderdate, '%d/%m/%Y') || ' al ' || strftime(o_orderdate + INTERVAL 90 DAY, '%d/%m/%Y') END AS caption FROM orders""")
def date_captions(t):
    start = F.when(F.col("o_orderstatus") != "F", F.to_date("o_orderdate"))
    end = F.when(F.col("o_orderstatus") != "P", F.date_add(F.to_date("o_orderdate"), 90))
    return t.orders.select("o_orderkey", tx.date_range_text(start, end).alias("caption"))


PREVIEW = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'gi'), '\s+', ' ', 'g'))"


@query("html_previews", f"SELECT page_id, CASE WHEN length({PREVIEW}) > 160 THEN substr({PREVIEW}, 1, 157) || '…' ELSE {PREVIEW} END AS preview FROM pages")
def html_previews(t):
    return t.pages.select("page_id", tx.html_preview(F.col("html")).alias("preview"))


@query("card_summaries", f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url WHEN length({PREVIEW}) > 160 THEN substr({PREVIEW}, 1, 157) || '…' ELSE {PREVIEW} END AS summary FROM pages")
def card_summaries(t):
    return t.pages.select("page_id", tx.card_summary(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("  "), F.col("html")).alias("summary"))


@query("clean_notes")
def clean_notes(t):
    return t.pages.select("page_id", tx.clean_note(F.col("html")).alias("note"))


@query("empty_notes", "SELECT page_id, page_id % 3 = 0 AS empty FROM pages")
def empty_notes(t):
    """Every third page stands in with a note of breaks and hard spaces only."""
    body = F.when(F.col("page_id") % 3 == 0, "<p>&nbsp;</p>  <b> </b>").otherwise(F.concat(F.lit("<p>x</p>"), F.col("html")))
    return t.pages.select("page_id", tx.note_is_empty(body).alias("empty"))


@query("model_replies", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || chr(10) || lang WHEN 1 THEN 'plain ' || source WHEN 2 THEN '' ELSE source || chr(10) || lang END AS reply FROM documents""")
def model_replies(t):
    """Replies built from each document: fenced JSON, plain text, a loop, and JSON that does not parse."""
    kind = F.col("doc_id") % 4
    pair = F.concat(F.lit('"source": "'), F.col("source"), F.lit('", "lang": "'), F.col("lang"), F.lit('"'))
    raw = (
        F.when(kind == 0, F.concat(F.lit("```json\n{"), pair, F.lit(', "n": 7}\n```')))
        .when(kind == 1, F.concat(F.lit("  plain "), F.col("source"), F.lit(" ")))
        .when(kind == 2, "```markdown ```markdown extra")
        .otherwise(F.concat(F.lit("{"), pair, F.lit(", broken")))
    )
    return t.documents.select("doc_id", tx.clean_model_text(raw).alias("reply"))


@query("failed_texts", f"""SELECT doc_id, {s.strip('text')} IN ('', 'ERROR') OR length({s.strip('text')}) < 200 OR NOT starts_with({s.strip('text')}, 'The') AS failed FROM documents""")
def failed_texts(t):
    return docs(t).select("doc_id", tx.is_failed_text(F.col("text"), "The").alias("failed"))


@query("usable_recognised_text", "SELECT doc_id, CASE WHEN lang <> 'de' THEN text END AS ocr FROM documents")
def usable_recognised_text(t):
    raw = F.when(F.col("lang") == "de", F.concat(F.lit("[OCR error] "), "text")).otherwise(F.col("text"))
    return t.documents.select("doc_id", tx.usable_ocr(raw).alias("ocr"))


@query("valid_ids", "SELECT doc_id, regexp_full_match(CAST(doc_id % 7 AS VARCHAR) || '_' || printf('%02d', doc_id % 13), '[1-5]_(0[1-9]|10)') AS valid FROM documents")
def valid_ids(t):
    raw = F.format_string(" %d_%02d", F.col("doc_id") % 7, F.col("doc_id") % 13)
    return t.documents.select("doc_id", tx.valid_id(raw).alias("valid"))


@query("natural_order", """SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS position FROM supplier""")
def natural_order(t):
    """File names with bare numbers in their natural order within a folder."""
    named = t.supplier.select("s_suppkey", "s_nationkey", F.concat(F.lit("img"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("file"))
    keyed = named.select("s_suppkey", "s_nationkey", *[k.alias(f"k{i}") for i, k in enumerate(tx.natural_key(F.col("file")))])
    return number_in_group(keyed, ["s_nationkey"], ["k0", "k1", "k2"], "position").select("s_suppkey", "position")


@query("unit_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS before, 1.0 AS after FROM embeddings")
def unit_vectors(t):
    scaled = F.transform("embedding", lambda x: x * 1.0)
    return t.embeddings.select("vec_id", F.round(vec.norm2(scaled), 6).alias("before"), F.round(vec.norm2(vec.l2_normalize(scaled)), 6).alias("after"))


@query("clean_sparse_terms", """SELECT e.user_id, array_to_string(list(event_type || ':' || n ORDER BY event_type), ',') AS terms FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL) e GROUP BY e.user_id""")
def clean_sparse_terms(t):
    """Event counts per user as a term map; errors are counted as zero and dropped."""
    n = F.when(F.col("event_type") == "error", 0).otherwise(F.col("n"))
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", n.alias("n")))).alias("m"))  # one entry per type
    terms = F.transform(vec.clean_sparse(F.col("m")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return maps.select("user_id", F.array_join(terms, ",").alias("terms")).where("terms <> ''")


ENCODED = f"""WITH {s.encoded('d', 'documents', 'doc_id', 'text')},
sp AS (SELECT key, count(*) AS terms, round(sum(w), 6) AS weight FROM d_sparse GROUP BY key)
SELECT doc_id, coalesce(sp.terms, 0) AS terms, round(coalesce(sp.weight, 0), 6) AS weight, round(coalesce(list_sum(list_transform(v, lambda x: abs(x))), 0), 6) AS mass
FROM documents LEFT JOIN sp ON sp.key = doc_id LEFT JOIN d_dense dd ON dd.key = doc_id"""


def _masses(rows):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))), 6)
    return rows.select("doc_id", F.size("sparse_idx").cast("long").alias("terms"), total("sparse_w").alias("weight"), total("dense").alias("mass"))


@query("encoded_texts", ENCODED)
def encoded_texts(t):
    return _masses(en.encode_column(docs(t), "text"))


class Unsteady(en.HashingEncoder):
    """The encoder behind a service that loses the first call of each batch."""

    def __init__(self):
        super().__init__()
        self.refused = False

    def __call__(self, texts):
        self.refused = not self.refused
        if self.refused:
            raise ConnectionError("no answer")
        return super().__call__(texts)


@query("encoded_after_retries", ENCODED)
def encoded_after_retries(t):
    """Every batch fails once and is encoded by the second of three attempts."""
    return _masses(en.encode_column(docs(t), "text", lambda: Unsteady(), batch=64))


@query("generated_texts", f"""SELECT doc_id, CASE WHEN lang = 'fr' THEN 'ERROR: no model for ' || lang ELSE upper(lang) END AS text, CASE WHEN lang IN ('fr', 'de') THEN 1 ELSE 0 END AS failed FROM documents""")
def generated_texts(t):
    """A stand-in generator that raises for French and gives a poor reply for German."""

    def generate(lang):
        if lang == "fr":
            raise RuntimeError(f"no model for {lang}")
        return lang.upper()

    out = en.generate_column(t.documents.select("doc_id", "lang"), "lang", generate, lambda reply: reply == "DE")
    return out.select("doc_id", "text", "failed")


@query("computed_only_when_missing", "SELECT doc_id, CASE WHEN quality IS NOT NULL THEN quality ELSE -n_chars END AS value FROM documents LEFT JOIN labels USING (doc_id)")
def computed_only_when_missing(t):
    cache = t.labels.select("doc_id", F.col("quality").cast("long").alias("value"))
    return en.compute_missing(t.documents, cache, "doc_id", lambda missing: missing.select("doc_id", (-F.col("n_chars")).alias("value")))


# ---------------------------------------------------------------- log fields

@query("action_labels", """SELECT event_id, CASE event_type WHEN 'signup' THEN 'session_validate' WHEN 'error' THEN 'session_refresh' WHEN 'purchase' THEN 'admin_request' WHEN 'click' THEN 'data_change' ELSE 'api_request' END AS action FROM events""")
def action_labels(t):
    path = F.when(F.col("event_type") == "signup", "/auth/me").when(F.col("event_type") == "error", "/auth/refresh").when(F.col("event_type") == "purchase", "/admin/users").otherwise("/search")
    method = F.when(F.col("event_type") == "click", "POST").otherwise("GET")
    return t.events.select("event_id", tx.action_for(method, path).alias("action"))


@query("client_details", """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE '{"source":"' || event_type || '","screen":"' || user_id || '"}' END AS details FROM events""")
def client_details(t):
    kind = F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))
    screen = F.when(F.col("event_type") == "view", "").otherwise(F.col("user_id").cast("string"))
    raw = F.to_json(F.struct(kind.alias("source"), screen.alias("screen"), F.col("value").alias("other")))
    return t.events.select("event_id", tx.client_details(raw).alias("details"))


@query("truncated_fields", "SELECT doc_id, left(text, 255) AS path, left(text, 80) AS action, left(text, 512) AS user_agent FROM documents")
def truncated_fields(t):
    return tx.truncate_fields(t.documents.select("doc_id", F.col("text").alias("path"), F.col("text").alias("action"), F.col("text").alias("user_agent")))
