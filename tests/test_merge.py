"""Merging labels by the name of the target."""

import pytest

from labelgrid.operators import catalog as ca

LABELS = "id long, name string, slug string, color string, description string, created_by long, is_active boolean"
ROWS = [
    (1, "Red", "red", "#AA0000", "d", 1, True), (2, "crimson", "crimson", "none", None, 1, True), (3, "rouge", "rouge", "#111111", None, 1, True),
    (4, "Blue", "blue", "#0000ff", None, 1, True), (5, "azure", "azure", "bad", None, 2, True), (6, "navy", "navy", "#000080", None, 2, True), (7, "gone", "gone", "#0", None, 1, False),
]
LINKS = [(10, 1), (10, 2), (11, 2), (12, 3), (12, 4), (13, 5), (13, 6), (14, 7)]
REQUEST = "request_id long, owner long, source_ids array<long>, target_name string"


def merged(spark, *requests):
    after, links = ca.merge_labels_by_name(
        spark.createDataFrame(ROWS, LABELS), spark.createDataFrame(LINKS, "image_id long, label_id long"), spark.createDataFrame(list(requests), REQUEST))
    return {r["id"]: r for r in after.collect()}, sorted(map(tuple, links.collect()))


def test_source_is_renamed_and_new_label_is_made(spark):
    after, links = merged(spark, (1, 1, [1, 2, 2, -3, None], " RED "), (2, 2, [5, 6], "Crimson"))
    assert (after[1]["name"], after[1]["slug"], after[1]["is_active"]) == ("RED", "red-2", True) and not after[2]["is_active"]
    assert tuple(after[8]) == (8, "Crimson", "crimson-2", "#6366f1", None, 2, True) and not after[5]["is_active"] and not after[6]["is_active"]
    assert links == [(10, 1), (11, 1), (12, 3), (12, 4), (13, 8), (14, 7)]


def test_other_label_of_the_owner_is_the_target(spark):
    after, links = merged(spark, (1, 1, [2, 3], "Blue"))
    assert tuple(after[4]) == ROWS[3] and [after[i]["is_active"] for i in (1, 2, 3)] == [True, False, False]
    assert links == [(10, 1), (10, 4), (11, 4), (12, 4), (13, 5), (13, 6), (14, 7)]


def test_no_request_changes_nothing(spark):
    after, links = merged(spark)
    assert sorted(map(tuple, after.values())) == ROWS and links == LINKS


@pytest.mark.parametrize("request_", [
    (1, 1, [1], "x"), (1, 1, [1, 1, 0], "x"), (1, 1, None, "x"), (1, 1, [1, 2], "  "), (1, 1, [1, 2], None), (1, 1, [1, 2], "x" * 256), (1, 1, [1, 5], "x"), (1, 1, [1, 7], "x"), (1, 1, [1, 99], "x"),
])
def test_refused(spark, request_):
    with pytest.raises(Exception, match="request 1"):
        merged(spark, request_)


def test_shared_label_is_refused(spark):
    with pytest.raises(ValueError, match="two requests: 2"):
        merged(spark, (1, 1, [1, 2], "x"), (2, 1, [2, 3], "y"))
    with pytest.raises(ValueError, match="two requests: 3"):
        merged(spark, (1, 1, [1, 2], "rouge"), (2, 1, [3, 4], "y"))
