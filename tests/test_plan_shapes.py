"""What must hold for the plans whatever the size of the data."""

import re

import pytest

import narrowmat as nm
from narrowmat.catalog import queries as q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_the_columns_used(spark, sf):
    text = plan(nm.tsqr(q.lineitem(spark, sf)))
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {
        "l_quantity", "l_extendedprice", "l_discount",
    }


def test_dropping_null_rows_is_pushed_down(spark, sf):
    m = nm.as_matrix(q.table(spark, sf, "lineitem"), cols=["l_quantity", "l_tax"], on_bad_rows="drop")
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_tax)]" in plan(m)


@pytest.mark.parametrize("schedule, exchanges", [(None, 2), (1, 1), ((8, 1), 2), (("s8", 8, 1), 3)])
def test_only_partial_results_are_shuffled(spark, sf, schedule, exchanges):
    text = plan(nm.tsqr(q.lineitem(spark, sf), schedule=schedule))
    assert text.count("Exchange") == exchanges
    if not str(schedule).startswith("('s"):
        # Below the lowest exchange the rows are already compressed.
        assert "MapInArrow" in text.rsplit("Exchange", 1)[1]


def test_explicit_stages_have_that_many_tasks(spark, sf):
    stats = nm.tsqr(
        q.lineitem(spark, sf).repartition(16), schedule=(5, 3, 1), stats=True
    ).stats.collect()
    assert {r.stage: r.tasks for r in stats} == {0: 16, 1: 5, 2: 3, 3: 1}


def test_projection_and_features_do_not_shuffle(spark, sf):
    m = q.embeddings(spark, sf)
    found = nm.svd(m)
    assert "Exchange" not in plan(nm.svd_left(m, found=found))
    assert "Exchange" not in plan(nm.center_rows(m))


@pytest.mark.parametrize("name", ["col_sums", "gram_lineitem", "matrix_shape", "word_count", "duplicate_keys"])
def test_sums_combine_before_the_shuffle(spark, sf, name):
    below = plan(q.QUERIES[name](spark, sf)).rsplit("Exchange", 1)[1]
    assert "partial_" in below
