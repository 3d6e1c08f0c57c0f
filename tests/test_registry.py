import __spark_entry__ as entry
from labelgrid.plans import QUERIES, SQL

# Queries that SQL cannot say over whole tables; each is covered by a fixture test.
ROWS_ONLY = {"clean_notes"}


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(SQL)


def test_flagship_runs(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "item_id", "score", "rank"] and rows.count() > 0


def test_scans_read_only_what_they_need(spark):
    plan = entry.queries()["label_item_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "p_retailprice" not in plan
    plan = entry.queries()["cut_results"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,400000.0)]" in plan
    plan = entry.queries()["scan_payload"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,label:int>" in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = entry.queries()["image_search_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
