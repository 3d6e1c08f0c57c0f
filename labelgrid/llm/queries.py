"""The registered queries of the operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrid.llm import bpe, classifier, conversation_trie, decontaminate, licenses, line_dedup, phrases, quality_rules, simhash, substring_dedup, suffix_dedup, token_files, warc
from labelgrid.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MARKED = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_ROWS = "d AS (SELECT row_number() OVER () AS r, doc_id, text, {} AS w FROM documents), p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _covered(name: str, size: int, by: str) -> str:
    """Positions of words inside windows of ``size`` words that occur twice in one text (by r) or anywhere."""
    return f"""{name}_k AS (SELECT r, i, array_to_string(w[i : i + {size - 1}], ' ') AS k FROM p WHERE i + {size - 1} <= len(w)),
{name}_c AS (SELECT r, i, count(*) OVER (PARTITION BY {by}) > 1 AS hit FROM {name}_k),
{name} AS (SELECT r, i, coalesce(bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW), false) AS hit
  FROM p LEFT JOIN {name}_c USING (r, i))"""


SQL1 = f"""WITH {_ROWS.format(_MARKED)},
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_MARKED} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
hits AS (SELECT r, i, bw.n, item FROM (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM p, sizes WHERE i + n - 1 <= len(w)) x JOIN bw ON bw.n = x.n AND bw.k = x.k),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

SQL3 = f"""WITH {_ROWS.format(_WORDS)}, {_covered("s", 3, "r, k")}, {_covered("m", quality_rules.MIN_REPEAT, "r, k")}, {_covered("x", quality_rules.MAX_REPEAT + 1, "r, k")},
n AS (SELECT r, count(*) FILTER (s.hit) AS n_repeat_words, count(*) FILTER (m.hit) AS covered, bool_or(x.hit) AS long FROM s JOIN m USING (r, i) JOIN x USING (r, i) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE trim(line, {_BLANKS}) <> '' GROUP BY r),
v AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered, 0) AS covered, coalesce(long, false) AS long
  FROM d LEFT JOIN n USING (r) LEFT JOIN l USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_SHORT_REPEAT} * n_words AS base_failed,
  NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_SHORT_REPEAT} * n_words) AND 100 * covered <= {quality_rules.MAX_COVERED} * n_words AND NOT long AS kept FROM v"""

SQL4 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT r, i, line, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {line_dedup.MIN_DOCS})
SELECT doc_id, len(ls) AS n_lines, n_dropped, kept_sha256 FROM d JOIN (
  SELECT r, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN f USING (key) GROUP BY r) USING (r)"""

SQL10 = f"""WITH {_ROWS.format(_WORDS)}, {_covered("c", substring_dedup.SIZE, "k")},
n AS (SELECT r, count(*) FILTER (hit) AS n_removed, string_agg(w[i], ' ' ORDER BY i) FILTER (NOT hit) AS kept FROM c JOIN p USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r)"""

SQL11 = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, x, count(*) AS a FROM (SELECT lang, w[i : i + k - 1] AS x FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, {phrases.MAX_WORDS + 1}) AS q(k) WHERE len(w) >= k))
  GROUP BY lang, x HAVING count(*) >= {phrases.MIN_COUNT}),
c AS (SELECT lang, x, a FROM f WHERE len(x) > 1),
s AS (SELECT lang, x[i : i + k - 1] AS x, max(a) AS longer FROM (SELECT lang, x, a, k, unnest(range(1, len(x) - k + 2)) AS i FROM c, range(2, {phrases.MAX_WORDS}) AS q(k) WHERE k < len(x)) GROUP BY ALL),
v AS (SELECT c.* FROM c LEFT JOIN s USING (lang, x) WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST({phrases.COVER} AS HUGEINT) * c.a),
t AS (SELECT v.lang, v.x, v.a, k, CAST((CAST(2000000 AS HUGEINT) * v.a) // (l.a + r.a) AS BIGINT) AS score, l.a AS l, r.a AS r FROM (SELECT *, unnest(range(1, len(x))) AS k FROM v) v
  JOIN f l ON l.lang = v.lang AND l.x = v.x[: k] JOIN f r ON r.lang = v.lang AND r.x = v.x[k + 1 :]),
b AS (SELECT lang, x, a, score, l, r FROM t QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(x, ' ')) AS rank, array_to_string(x, ' ') AS phrase, a, l, r, n, score
FROM b JOIN n USING (lang) QUALIFY rank <= {phrases.TOP}"""

_DIGITS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_BASE32 = f"""array_to_string(list_transform(range(32), lambda i: substr({_DIGITS}, 1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '')"""
SQL12 = f"""WITH p AS (SELECT row_number() OVER () AS o, page_id, url, coalesce(html, '') AS h FROM pages),
r AS (SELECT *, sha1(h) AS x, first_value(o) OVER w AS top, first_value(page_id) OVER w AS head FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url NULLS FIRST, o))
SELECT page_id, octet_length(encode(h)) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN o = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN o <> top THEN head END AS refers_to FROM r"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
  lambda i: [CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""
SQL13 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(concat(length(role), ':', role, text))) AS x FROM t GROUP BY conv_id),
h AS (SELECT conv_id, x, conv_id - conv_id % {conversation_trie.FAMILY} AS base, {_CRC32} % {conversation_trie.HEADS} AS h FROM own),
c AS (SELECT h.conv_id, list_concat(coalesce(b.x[1 : h], []), h.x[h + 1 :]) AS x FROM h LEFT JOIN own b ON b.conv_id = h.base),
m AS (SELECT conv_id, d, x[1 : d] AS x, d = len(x) AS ends FROM (SELECT conv_id, x, unnest(range(len(x) + 1)) AS d FROM c)),
v AS (SELECT md5(CAST(x AS VARCHAR) || d) AS k, any_value(x) AS x, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS e FROM m GROUP BY x, d),
u AS (SELECT *, CASE WHEN d > 0 THEN md5(CAST(x[1 : d - 1] AS VARCHAR) || (d - 1)) END AS up, CASE WHEN d > 0 THEN (n - 1) * len(regexp_extract_all(x[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved FROM v),
kids AS (SELECT up AS k, count(*) AS kids FROM u WHERE d > 0 GROUP BY up),
a AS (SELECT top, count(*) FILTER (kids IS NULL) AS leaves, sum(saved) AS saved FROM (SELECT k, saved, md5(CAST(x[1 : j] AS VARCHAR) || j) AS top FROM (SELECT k, x, saved, unnest(range(d + 1)) AS j FROM u)) LEFT JOIN kids USING (k) GROUP BY top)
SELECT u.conv_id, u.d AS depth, p.conv_id AS parent_conv_id, u.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, u.e AS ends_sha256
FROM u JOIN a ON a.top = u.k LEFT JOIN kids ON kids.k = u.k LEFT JOIN u p ON p.k = u.up"""


@query("op1_decontaminate", SQL1)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


@query("op2_bpe")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_quality_rules", SQL3)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents")).drop("n_covered", "longest_repeat")


@query("op4_line_dedup", SQL4)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("line_count").alias("n_lines"), F.col("line_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


@query("op5_token_files")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query("op6_quality_classifier")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.classify(table(spark, folder, "documents"), classifier.ratings(table(spark, folder, "labels")))


@query("op7_license_scan")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op8_simhash")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op9_suffix_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffix_dedup.drop_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_substring_dedup", SQL10)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.drop_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op11_collocations", SQL11)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@query("op12_warc", SQL12)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    archives = shared_folder(spark, "warc")
    warc.write(table(spark, folder, "pages"), archives)
    return warc.read(spark, archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_conversation_trie", SQL13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, folder, "conversations"))
