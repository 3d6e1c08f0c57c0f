"""What a reviewer found cut short, against plain Python."""

import os
import random
import time

import pytest

import corpus_pipeline
from labelgrid.llm import decontaminate, jaccard_dedup
from labelgrid.session import discard, through_table

from . import brute


def shingles(text, size=5):
    w = brute.words(brute.lower(text))
    return frozenset(" ".join(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([" ".join(w)] if w else [])


def first_rows(docs):
    """Numbers of the rows that stay: of each component of Jaccard >= 0.8 the smallest id, a null last, of equal ids the first row."""
    sets = [shingles(t) for _, t in docs]
    near = lambda a, b: a == b or len(a & b) * 9 >= 4 * (len(a) + len(b)) and a & b
    root = brute.roots_of(range(len(docs)), [(i, j) for i in range(len(docs)) for j in range(i) if near(sets[i], sets[j])])
    return {min((k for k in root if root[k] == r), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k)) for r in set(root.values())}


def varied():
    """Texts with replaced words around the bound, chains, a large near group, a passage common to unlike texts, short and empty ones."""
    rnd = random.Random(11)
    word = lambda: f"{rnd.choice('abcdefgh')}{rnd.randrange(4000)}"
    prose = lambda n: [word() for _ in range(n)]
    texts = [None, "", " \n", "one", "ONE", "two words", "a b c d", "a b c d e", "A  b c\td e"]
    for _ in range(25):
        base = prose(rnd.randint(8, 200))
        for _ in range(4):
            other = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                other[rnd.randrange(len(other))] = word()
            texts.append(" ".join(other))
            base = other if rnd.random() < 0.5 else base
    group, passage = prose(120), prose(40)
    for _ in range(60):
        other = list(group)
        for _ in range(rnd.randint(0, 4)):
            other[rnd.randrange(120)] = word()
        texts.append(" ".join(other))
    texts += [" ".join(prose(rnd.randint(2, 40)) + passage + prose(3)) for _ in range(60)]
    rnd.shuffle(texts)
    ids = [None if rnd.random() < 0.1 else rnd.randrange(150) for _ in texts]
    return list(zip(ids, texts))


@pytest.mark.parametrize("rounds", [jaccard_dedup.ROUNDS, 0])
def test_similar_texts_one_of_each(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard_dedup, "ROUNDS", rounds)
    docs = varied()
    # One partition, so that rows are numbered in this order; n tells the rows apart.
    frame = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, n int").coalesce(1)
    kept = jaccard_dedup.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r["n"] for r in kept.collect()) == sorted(first_rows(docs))


def test_similar_texts_in_bounded_work_tables(spark, monkeypatch):
    """Whole sets are judged in passes of bounded size, whose tables and shuffle files are gone before the next; prefix places travel without sketches."""
    real, tables, folders = jaccard_dedup.through_table, [], []

    def traced(df, purpose):
        held = [t for name, t in tables if name == "candidate-sets" and os.path.exists(t.work_path)]
        assert purpose != "candidate-sets" or not held
        tables.append((purpose, real(df, purpose)))
        return tables[-1][1]

    monkeypatch.setattr(jaccard_dedup, "through_table", traced)
    monkeypatch.setattr(jaccard_dedup, "HELD_LEAST", 100)
    monkeypatch.setattr(jaccard_dedup, "HELD", 50)
    docs = varied()
    frame = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, n int").coalesce(1)
    kept = jaccard_dedup.one_of_each(frame)
    names = [name for name, _ in tables]
    assert names.count("candidate-sets") > names.count("candidates") > 0
    assert {n for n, t in tables if os.path.exists(t.work_path)} <= {"judged-pairs", "similar-roots", "later-copies"}
    assert all(set(t.columns) == {"node", "g", "pos"} for n, t in tables if n == "shared-prefixes")
    assert sorted(r["n"] for r in kept.collect()) == sorted(first_rows(docs))


def test_shuffle_files_go_with_the_write(spark):
    """What a table is made through leaves no shuffle behind, and settings stay as they were."""
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    before = shuffles()
    table = through_table(spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count().repartition(3), "released")
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and table.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    discard(table)
    assert not os.path.exists(table.work_path)


def test_near_duplicate_stage_takes_five_words_at_four_fifths(spark):
    """235 and 611 words with the share of replaced words that left a similarity of 0.83, far more than two bits of a SimHash apart."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("doc_id", "text", "lang", "source", "n_chars")
    docs = [(r["doc_id"], r["text"]) for r in table.orderBy("doc_id").collect()]
    kept = corpus_pipeline.drop_near_duplicates(spark, table, "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(docs[k][0] for k in first_rows(docs))
    assert {r["doc_id"] for r in kept} & {1, 6, 145, 177} == {1, 6}


def test_similar_texts_of_an_empty_table(spark):
    assert jaccard_dedup.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_by_row(spark):
    """One id with two texts, rows of one id and text, and null ids with and without a named copy."""
    texts = ["alpha beta gamma delta", "quite another text of words", "third and last of the texts", "only nameless rows have this", "named and nameless alike now"]
    docs = [(1, 0), (2, 0), (2, 1), (2, 1), (3, 2), (None, 3), (None, 3), (None, 4), (9, 4), (0, 2)]
    frame = spark.createDataFrame([(i, texts[t], n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, n int").coalesce(1)
    kept = jaccard_dedup.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r["n"] for r in kept.collect()) == [0, 2, 5, 8, 9]


def test_leaks_are_dropped_by_row(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([("a", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "clean text"), (1, f"with {passage}"), (None, passage), (None, "clean too"), (2, passage), (3, None)]
    frame = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, n int")
    kept = corpus_pipeline.drop_benchmark_leaks(spark, frame, str(tmp_path))
    assert kept.columns == frame.columns and sorted(r["n"] for r in kept.collect()) == [0, 3, 5]


def test_item_without_an_id_contaminates(spark):
    items = spark.createDataFrame([(None, "one two three"), ("b", "four five"), (None, "four five")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "four five"), (3, "three four")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.decontaminate(docs, items).collect()}
    assert found == {1: (3, [], True), 2: (2, ["b"], True), 3: (0, [], False)}
