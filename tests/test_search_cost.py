"""What searches do not have to do: cells without a shared term, texts of items that are left out."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
from conftest import DATA

from labelgrid.operators import scan
from labelgrid.operators import search as se
from labelgrid.plans import QUERIES, Tables


def test_sparse_scorer_holds_terms_not_a_matrix():
    rng, kept = np.random.default_rng(3), []
    lists = lambda n: [np.sort(rng.choice(4000, 5, replace=False)) for _ in range(n)]
    block = pd.DataFrame({"query_id": np.arange(300) * 7, "idx": lists(300)})
    block["w"] = [rng.random(5) - 0.3 for _ in range(300)]
    frame = pd.DataFrame({"id": np.arange(500), "idx": [*lists(498), np.zeros(0, np.int64), np.zeros(0, np.int64)]})
    frame["w"] = [rng.random(len(x)) for x in frame["idx"]]
    spark = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: kept.append(value) or SimpleNamespace(value=value)))
    for all_rows in (False, True):
        query_ids, scorer = scan.sparse_scorer(spark, block, all_rows)
        parts = list(scorer(frame))
        found = np.hstack([p[0] for p in parts])
        a, b = np.zeros((300, 4000)), np.zeros((500, 4000))
        for x, side in ((a, block), (b, frame)):
            for i, (terms, weights) in enumerate(zip(side["idx"], side["w"])):
                x[i, terms] = weights
        assert np.allclose(found, a @ b.T, atol=1e-12) and np.array_equal(query_ids, block["query_id"])
        assert np.array_equal(np.concatenate([p[1] for p in parts]), frame["id"])
    assert sum(np.asarray(x).nbytes for x in kept[0]) < 100_000  # not 300 queries by some thousand terms


def test_only_items_with_a_tag_are_encoded(spark, monkeypatch):
    seen, real = [], se.segment_index
    monkeypatch.setattr(se, "segment_index", lambda items, *more: seen.append(items) or real(items, *more))
    tables = Tables(spark, DATA)
    QUERIES["search_within_all_tags"](tables)
    assert seen[0].count() == tables.documents.where("source = 'src1' AND lang = 'en'").count() < tables.documents.count()


def test_workers_get_batches_bounded_in_bytes(spark):
    """Long texts do not pile up in a Python worker by the ten thousand rows of a batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        docs = spark.range(48).selectExpr("id AS item_id", "repeat('word ', 100000) AS text").coalesce(1)
        se.encode_column(docs, "text")
        sizes = docs.mapInArrow(lambda batches: (type(b).from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
        assert max(r["n"] for r in sizes) < 12 << 20 and sum(r["n"] for r in sizes) > 20 << 20
    finally:
        spark.conf.set(name, before)
