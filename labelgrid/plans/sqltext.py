"""Shared pieces of the comparison SQL."""

TOKENS = "regexp_extract_all(lower(regexp_replace(strip_accents({text}), '[^\\x00-\\x7F]', '', 'g')), '[a-z0-9]+')"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def tokens(text: str) -> str:
    return TOKENS.format(text=text)


def strip(text: str) -> str:
    return f"trim({text}, {WS})"


def lines(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, '\\r\\n|[\\n\\r\\x0B\\f]'), lambda x: {strip("x")}), lambda x: x <> '')"


def segments(name: str, source: str, item: str, text: str, mode: str = "both") -> str:
    """CTEs ending in ``name(item_id, segment_id, segment_text)``."""
    unit = {
        "both": "CASE WHEN len(ls) > 0 THEN list_concat([array_to_string(ls, ' ')], ls) ELSE [] END",
        "full": "CASE WHEN len(ls) > 0 THEN [array_to_string(ls, ' ')] ELSE [] END",
        "segments": "ls",
    }[mode]
    return f"""
    {name}_lines AS (SELECT {item} AS item_id, {lines(text)} AS ls FROM {source}),
    {name}_units AS (SELECT item_id, {unit} AS us FROM {name}_lines),
    {name} AS (SELECT item_id, item_id * 1000000 + pos - 1 AS segment_id, us[pos] AS segment_text
               FROM (SELECT item_id, us, unnest(range(1, len(us) + 1)) AS pos FROM {name}_units))"""


def encoded(name: str, source: str, key: str, text: str) -> str:
    """CTEs ending in ``name_dense(key, v)`` and ``name_sparse(key, idx, w)``."""
    return f"""
    {name}_terms AS (SELECT {key} AS key, unnest({tokens(text)}) AS t FROM {source}),
    {name}_counts AS (
        SELECT key, CAST('0x' || substr(md5(t), 1, 7) AS INTEGER) AS idx,
               CASE WHEN CAST('0x' || substr(md5(t), 8, 1) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END AS sg, count(*) AS c
        FROM {name}_terms GROUP BY ALL),
    {name}_dims AS (SELECT key, idx % 64 AS d, sum(sg * c) AS v FROM {name}_counts GROUP BY ALL),
    {name}_len AS (SELECT key, sqrt(sum(v * v)) AS n FROM {name}_dims GROUP BY key),
    {name}_dense AS (
        SELECT key, list_transform(range(64), lambda d: CAST(coalesce(m[d], 0.0) AS FLOAT)::DOUBLE) AS v
        FROM (SELECT key, map_from_entries(list({{'k': d, 'v': CASE WHEN n > 0 THEN v::DOUBLE / n ELSE 0.0 END}})) AS m
              FROM {name}_dims JOIN {name}_len USING (key) GROUP BY key)),
    {name}_bag AS (SELECT key, idx, sum(c) AS c FROM {name}_counts GROUP BY ALL),
    {name}_bag_len AS (SELECT key, sqrt(sum(c * c)) AS n FROM {name}_bag GROUP BY key),
    {name}_sparse AS (SELECT key, idx, CAST(c::DOUBLE / n AS FLOAT)::DOUBLE AS w FROM {name}_bag JOIN {name}_bag_len USING (key))"""


COS = "round(coalesce(CASE WHEN isnan(list_cosine_similarity({a}, {b})) THEN 0.0 ELSE list_cosine_similarity({a}, {b}) END, 0.0), 9)"


def cosine(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


def dense_hits(name: str, q: str, d: str, depth: int) -> str:
    return f"""
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM (
        SELECT q.key AS query_id, d.key AS id, {cosine('q.v', 'd.v')} AS score FROM {q}_dense q, {d}_dense d)) WHERE rk <= {depth})"""


def sparse_hits(name: str, q: str, d: str, depth: int) -> str:
    return f"""
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM (
        SELECT q.key AS query_id, d.key AS id, round(sum(q.w * d.w), 9) AS score FROM {q}_sparse q JOIN {d}_sparse d USING (idx) GROUP BY ALL))
        WHERE rk <= {depth})"""


def rolled(name: str, hits: str) -> str:
    """Best segment per item, ranked again."""
    return f"""
    {name} AS (SELECT query_id, item_id, b.s AS score, b.r AS segment_rank,
                      row_number() OVER (PARTITION BY query_id ORDER BY b.r, item_id) AS rank
               FROM (SELECT query_id, id // 1000000 AS item_id, arg_min({{'r': rk, 's': score}}, rk) AS b FROM {hits} GROUP BY ALL))"""


def fused(name: str, branches: list[str], n: int | None, k: int = 60) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, item_id, rank FROM {b}" for b in branches)
    cut = "" if n is None else f"WHERE rank <= {n}"
    return f"""
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(item_id AS VARCHAR)) AS rank FROM (
        SELECT query_id, item_id, round(sum(1.0::DOUBLE / ({k} + rank)), 12) AS score FROM ({union}) GROUP BY ALL)) {cut})"""


INDEX = segments("seg", "documents", "doc_id", "text") + "," + encoded("d", "seg", "segment_id", "segment_text")
ASKED = encoded("q", "benchmark", "item_id", "text")
HYBRID = f"WITH {INDEX}, {ASKED}, {dense_hits('dh', 'q', 'd', 1000)}, {sparse_hits('sh', 'q', 'd', 1000)}, {rolled('db', 'dh')}, {rolled('sb', 'sh')}, {fused('f', ['db', 'sb'], 50)}"
