import random

import pytest
from pyspark.sql import functions as F

from labelgrid.operators import audit as au
from labelgrid.operators import catalog as ca
from labelgrid.operators import matching as ma
from labelgrid.operators import numbering as nu
from labelgrid.sources import files as fi
from labelgrid.sources import index as ix
from labelgrid.streaming import jobs as st


def test_numbers_have_no_gaps_in_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 4}", i) for i in range(600)]
    out = nu.number_in_group(spark.createDataFrame(rows, "g string, i int").repartition(7), ["g"], ["i"]).collect()
    by_group = {}
    for r in out:
        by_group.setdefault(r["g"], []).append((r["i"], r["number"]))
    for pairs in by_group.values():
        assert [n for _, n in sorted(pairs)] == list(range(1, len(pairs) + 1))


def test_slugs_skip_used_numbers_and_settle_clashes(spark):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a-2"), (5, "b")], "id long, base string")
    used = spark.createDataFrame([("a",), ("a-3",)], "slug string")
    got = {r["id"]: r["slug"] for r in nu.unique_slugs(new, used).collect()}
    assert got[1] == "a-2" and got[2] == "a-4" and got[3] == "a-5" and got[5] == "b"
    assert got[4] not in {"a-2", "a-4"} and len(set(got.values())) == 5


def test_labels_of_a_page_are_nested(spark):
    bridge = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "image_id long, label_id long")
    labels = spark.createDataFrame([(10, "b", "b", "#1", 1, True), (11, "a", "a", "#2", 1, True), (12, "c", "c", "#3", 1, False)],
                                   "id long, name string, slug string, color string, created_by long, is_active boolean")
    rows = ca.nest_labels(ca.labels_for_items(bridge, labels)).collect()
    assert len(rows) == 1 and [x["name"] for x in rows[0]["labels"]] == ["a", "b"]


def test_unknown_ids_fail(spark):
    items = spark.createDataFrame([(1, ["x"])], "image_id long, tags array<string>")
    change = spark.createDataFrame([(2, ["y"])], "image_id long, tags array<string>")
    with pytest.raises(Exception, match="unknown item"):
        ca.change_tags(items, change, "add").collect()
    assert ca.change_tags(items, change, "set").count() == 1
    with pytest.raises(Exception, match="unknown id"):
        ca.assert_all_known(spark.range(3), spark.range(2), "id").collect()
    docs = spark.createDataFrame([(1, "a")], "item_id long, text string")
    with pytest.raises(Exception, match="unknown item"):
        ix.replace_segments(docs, ix.rebuild_segments(docs), docs.withColumn("item_id", F.lit(9).cast("long")))[0].collect()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def is_similar(a, b):
    plural = a == b or any(x + e == y for x, y in ((a, b), (b, a)) for e in ("s", "es"))
    inside = min(len(a), len(b)) >= 3 and (a in b or b in a)
    longest = max(len(a), len(b))
    return plural or inside or edits(a, b) <= (1 if longest <= 4 else 2 if longest <= 7 else 3)


def test_blocking_misses_no_similar_pair(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcs") for _ in range(r.randint(1, 11)))
    left, right = {word() for _ in range(120)}, {word() for _ in range(120)}
    got = ma.similar_pairs(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")).collect()
    assert {(x["a"], x["b"]) for x in got} == {(a, b) for a in left for b in right if is_similar(a, b)}


def test_suggestions_for_blank_text_and_taken_labels(spark):
    catalog = spark.createDataFrame([(i, f"toro {i:02d}") for i in range(20)], "id long, name string")
    typed = spark.createDataFrame([(1, " "), (2, "tor")], "input_id long, text string")
    taken = spark.createDataFrame([(1, 0), (2, 3)], "input_id long, id long")
    rows = ma.suggest(typed, catalog, taken).collect()
    ids = {k: [r["id"] for r in sorted(rows, key=lambda r: r["position"]) if r["input_id"] == k] for k in (1, 2)}
    assert ids[1] == list(range(1, 13)) and ids[2] == [0, 1, 2, *range(4, 13)]
    best = ma.prefix_complete(typed, catalog, spark.createDataFrame([(2, 0)], "input_id long, id long")).collect()
    assert [(r["id"], r["suffix"]) for r in best] == [(1, "o 01")]


def test_files_give_ids(spark, tmp_path):
    for folder, name in (("1", "2.jpg"), ("1", "10.PNG"), ("2", "1.webp"), ("2", "note.txt")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(b"x")
    found = {r["item_id"]: r["filename"] for r in fi.scan_files(spark, f"{tmp_path}/*/*").collect()}
    assert found == {"1_02": "2.jpg", "1_10": "10.PNG", "2_01": "1.webp"}
    assert {r["item_id"]: r["filename"] for r in fi.numbered_folder(spark, f"{tmp_path}/*/*").collect()}["1_02"] == "10.PNG"
    (tmp_path / "1" / "02.png").write_bytes(b"x")
    with pytest.raises(Exception, match="two files for id"):
        fi.scan_files(spark, f"{tmp_path}/*/*").collect()


def test_json_and_csv_sources(spark, tmp_path):
    (tmp_path / "q.csv").write_text('query_id,query,type\nq1," a ""b""\nc ",textual\n', encoding="utf-8")
    assert tuple(fi.read_queries(spark, str(tmp_path / "q.csv")).first()) == ("q1", 'a "b"\nc', "textual")
    (tmp_path / "cache.json").write_text('{"ocr": {"1_01": "uno",\n "1_02": ""}, "vlm": {"1_01": "dos"}}')
    assert fi.read_text_cache(spark, str(tmp_path / "cache.json")).count() == 3
    (tmp_path / "bin.json").write_text('{"q1": {"1_01": 1, "1_02": 0}}')
    (tmp_path / "graded.json").write_text('{"q1": {"1_01": 1, "1_02": 3}}')
    binary = fi.read_qrels(spark, str(tmp_path / "bin.json"), str(tmp_path / "none.json")).collect()
    assert {r["item_id"]: r["relevant"] for r in binary} == {"1_01": True, "1_02": False}
    graded = fi.read_qrels(spark, str(tmp_path / "bin.json"), str(tmp_path / "graded.json"), threshold=2).collect()
    assert {r["item_id"]: r["relevant"] for r in graded} == {"1_01": False, "1_02": True}
    (tmp_path / "bad.json").write_text('{"q1": {"1_01": 2}}')
    with pytest.raises(Exception, match="gain out of range"):
        fi.read_qrels(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "rank.json").write_text('{"q1": {"a": ["1_02", "1_01"]}}')
    assert {(r["item_id"], r["rank"]) for r in fi.read_rankings(spark, str(tmp_path / "rank.json")).collect()} == {("1_02", 1), ("1_01", 2)}


def test_corpus_needs_every_file(spark):
    ids = fi.expected_ids(spark)
    assert ids.count() == 50 and ids.where("item_id = '5_10'").count() == 1
    texts = spark.createDataFrame([("1_01", "t")], "item_id string, text string")
    files = ids.withColumn("path", F.concat(F.lit("/x/"), "item_id"))
    assert fi.build_corpus(ids, texts, files).where("text = ''").count() == 49
    with pytest.raises(Exception, match="no file for item"):
        fi.build_corpus(ids, texts, files.where("item_id <> '3_03'")).collect()


def test_index_keys_stay_and_index_is_reused(spark, tmp_path):
    docs = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "item_id long, segment_id long, segment_text string")
    same = lambda d: d
    first = {r["point_id"] for r in ix.build_index(spark, docs, "i", str(tmp_path), same).collect()}
    reused = ix.build_index(spark, docs.limit(1), "i", str(tmp_path), same)
    assert {r["point_id"] for r in reused.collect()} == first
    assert ix.build_index(spark, docs.limit(1), "i", str(tmp_path), same, reset=True).count() == 1


def test_audit_status(spark):
    rows = [("a", "pass", True, ""), ("b", "fail", False, ""), ("c", "skip", False, "")]
    checks = spark.createDataFrame(rows, "name string, status string, critical boolean, detail string")
    assert au.audit_status(checks, strict=False).first()["status"] == "pass"
    assert au.audit_status(checks, strict=True).first()["status"] == "fail"


EVENTS = "ts timestamp, session long, item string, phase string, seq long, text string, ok boolean"


def test_streams_over_several_batches(spark, tmp_path):
    base = [("2024-01-01 00:00:00", 1, "x", "ocr", 1, "a", True), ("2024-01-01 00:01:00", 1, "x", "crop", 2, "b", True), ("2024-01-01 00:02:00", 1, "y", "ocr", 3, "c", False),
            ("2024-01-01 00:03:00", 2, "x", "ocr", 4, "d", True), ("2024-01-01 00:04:00", 1, "x", "describe", 5, "e", True), ("2024-01-01 00:05:00", 2, "x", "end", 6, "", True)]
    for n in range(0, 6, 2):
        part = spark.createDataFrame(base[n : n + 2], EVENTS.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: st.file_stream(spark, f"{tmp_path}/in", EVENTS, 1)
    view = st.session_view(st.to_table(stream(), f"{tmp_path}/state", st.session_state))
    assert {(r["session"], r["item"], r["phase"], r["text"]) for r in view.collect()} == {(1, "x", "describe", "e"), (1, "y", "ocr", "c"), (2, "x", "ocr", "d")}
    assert st.end_sessions(view, spark.createDataFrame([(2,)], "session long")).count() == 2
    counts = st.progress_view(st.to_table(stream(), f"{tmp_path}/progress", st.progress_counts))
    assert {(r["session"], r["phase"]): (r["processed"], r["errors"]) for r in counts.collect()}[(1, "ocr")] == (2, 1)


def test_ingest_over_batches_numbers_on_and_catches_copies(spark, tmp_path):
    batches = [[(1, "toro rojo y sol", "image/png"), (2, "toro rojo y sol", "image/png"), (3, "dama azul con oro", "image/jpeg")],
               [(4, "dama azul con oro", "image/png"), (5, "gato gris sin nada", "image/png"), (6, "x", "text/plain"), (7, " ", "image/png")]]
    schema = "doc_id long, text string, content_type string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events, index = st.ingest_stream(st.file_stream(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/out")
    status = {r["doc_id"]: r["status"] for r in events.collect()}
    assert status == {1: "indexed", 2: "duplicate", 3: "indexed", 4: "duplicate", 5: "indexed", 7: "error"}
    assert {r["doc_id"]: r["item_id"] for r in index.collect()} == {1: 1, 3: 2, 5: 3}


def test_repeated_requests_are_logged_once(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 1, 5, "a@x", "GET", "/auth/me", "u" * 600), ("2024-01-01 00:00:01", 1, 5, "a@x", "GET", "/auth/me", "u"), ("2024-01-01 00:00:02", 2, 0, "", "POST", "/x", "u")]
    schema = "ts string, request long, user_id long, user_email string, method string, path string, user_agent string"
    spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = st.file_stream(spark, f"{tmp_path}/in", schema.replace("ts string", "ts timestamp"))
    out = st.activity_view(st.to_table(stream, f"{tmp_path}/log", st.activity_rows)).collect()
    assert sorted((r["action"], r["user_id"], r["user_email"]) for r in out if r["user_id"]) == [("session_validate", 5, "a@x")]
    assert len(out) == 2 and all(len(r["user_agent"]) <= 512 for r in out)


def test_streams_lose_no_late_rows_whatever_the_batches(spark, tmp_path):
    for n, day in enumerate((20, 19, 10, 2)):
        row = [(f"2024-01-{day:02d} 00:00:00", n + 1, "x", "ocr", n, "a", True, 7, n, "", "GET", "/x")]
        part = spark.createDataFrame(row, EVENTS.replace("timestamp", "string") + ", request long, user_id long, user_email string, method string, path string")
        part.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = EVENTS + ", request long, user_id long, user_email string, method string, path string"
    for files in (1, 2, 100):
        stream = lambda: st.file_stream(spark, f"{tmp_path}/in", schema, files)  # noqa: B023, E731
        state = st.session_view(st.to_table(stream(), f"{tmp_path}/s{files}", st.session_state))
        assert {r["session"] for r in state.collect()} == {1, 2, 3, 4}
        assert st.progress_view(st.to_table(stream(), f"{tmp_path}/p{files}", st.progress_counts)).agg(F.sum("processed")).first()[0] == 4
        log = st.activity_view(st.to_table(stream(), f"{tmp_path}/a{files}", st.activity_rows))
        assert log.count() == 4 and "batch" not in log.columns


def test_unknown_or_no_role_codes_are_refused(spark):
    held = spark.createDataFrame([(1, 1), (2, 2)], "user_id long, role_id long")
    roles = spark.createDataFrame([(1, "ADMIN"), (2, "USER")], "id long, code string")
    ask = lambda codes: ca.set_roles(held, roles, spark.createDataFrame([(1, codes)], "user_id long, codes array<string>"))
    assert {tuple(r) for r in ask([" user", "USER"]).collect()} == {(1, 2), (2, 2)}
    for codes in (["TYPO"], ["user", "TYPO"], [], [" "]):
        with pytest.raises(Exception, match="no such role"):
            ask(codes).collect()


def test_gate_compares_with_accepted_items_only(spark, tmp_path):
    from labelgrid.operators.search import duplicate_gate

    # a ~ b ~ c, but not a ~ c: b goes, so c stays.
    vectors = [[1.0, 0.0], [0.97, 0.243], [0.88, 0.475], [1.0, 0.0], [0.0, 1.0]]
    same = lambda pairs, texts, left, right: pairs.withColumn("verify", F.lit(1.0))
    schema = "id long, text string, vector array<double>"
    rows = [(i, "t", v) for i, v in enumerate(vectors)]
    expected = {0: "new", 1: "duplicate", 2: "new", 3: "duplicate", 4: "new"}
    for cuts in ([5], [2, 5], [1, 2, 3, 4, 5]):
        status, first = {}, 0
        for last in cuts:
            kept = spark.createDataFrame([r for r in rows[:first] if status[r[0]] == "new"], schema) if first else None
            verdict = duplicate_gate(spark.createDataFrame(rows[first:last], schema), verify=same, index=kept)
            status |= {r["id"]: r["status"] for r in verdict.collect()}
            first = last
        assert status == expected


def test_joined_texts_are_encoded_once_for_both_indexes(spark, tmp_path, monkeypatch):
    from labelgrid.operators.encode import encode_column
    from labelgrid.operators.search import segments_of
    from labelgrid.plans import QUERIES, Tables, upkeep

    items = spark.createDataFrame([(1, "Uno dos\ntres"), (2, ""), (3, "\n \n"), (4, "Solo ñ"), (5, None)], "item_id long, text string")
    encode = lambda d: encode_column(d, "segment_text")
    alone = ix.build_index(spark, segments_of(items, "full"), "full", f"{tmp_path}/alone", encode)
    both = ix.build_index(spark, segments_of(items, "both"), "segmented", f"{tmp_path}/both", encode)
    derived = ix.build_index(spark, ix.joined_units(both), "full", f"{tmp_path}/both", lambda d: d)
    assert derived.columns == alone.columns and both.count() == 5
    assert sorted(map(tuple, derived.collect())) == sorted(map(tuple, alone.collect())) != []

    calls = []
    monkeypatch.setattr(upkeep, "encode_column", lambda d, c: calls.append(c) or encode_column(d, c))
    got = {r["system"]: r["points"] for r in QUERIES["index_build_report"](Tables(spark, "/root/testdata/sf0.001")).collect()}
    assert got["segmented"] > got["full"] > 0 and len(calls) == 1


def test_links_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    """What a task holds of links and members does not grow with the tables: their partitions do."""
    from labelgrid import session
    from labelgrid.plans import QUERIES, Tables
    from labelgrid.plans import catalog as pc

    t = Tables(spark, "/root/testdata/sf0.001")
    assert session.parts_for(t.lineitem) is None
    names = ("audit_keys", "collection_items", "collection_list")
    plain = {name: sorted(map(tuple, QUERIES[name](t).collect()), key=str) for name in names}
    links, n = sorted(map(tuple, pc.bridge(t).collect())), t.lineitem.count()
    monkeypatch.setattr(session, "ROWS_OF_A_TASK", 300)
    assert session.parts_for(t.lineitem) == -(-n // 300)
    for df in (pc.bridge(t), pc.members(t)):
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) > n / 300 * 0.8 and max(sizes) < 3 * sum(sizes) / len(sizes)
    assert sorted(map(tuple, pc.bridge(t).collect())) == links
    assert {name: sorted(map(tuple, QUERIES[name](t).collect()), key=str) for name in names} == plain
