"""Shapes of physical plans."""

import re

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def plan(spark, key: str) -> str:
    return entry.queries()[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["join_lexicon", "sentiment_share", "join_anti", "formality_f"])
def test_small_lexicons_are_broadcast(spark, key):
    text = plan(spark, key)
    assert "BroadcastHashJoin [" in text
    # Tokens are never sorted and shuffled to meet a lexicon.
    assert not re.search(r"SortMergeJoin \[(word|lower|substring)", text)


@pytest.mark.parametrize("key", ["select_drop", "filter_eq_or", "agg_sum_mean", "win_group_mean", "topk_extremes"])
def test_text_column_is_not_read(spark, key):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, key))
    assert schemas and all("text" not in s for s in schemas)


def test_filters_reach_the_scan(spark):
    assert "EqualTo(lang,en)" in plan(spark, "filter_eq_or")


@pytest.mark.parametrize("key", ["win_topn_ties", "agg_distinct_keep"])
def test_top_n_is_pruned_before_the_shuffle(spark, key):
    assert plan(spark, key).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("key", ["win_cumsum_segment", "win_global_id", "split_stratified", "corpus_sentences"])
def test_row_windows_are_never_in_one_partition(spark, key):
    """Only the bucket totals meet in one partition; they come straight from an aggregate."""
    lines = plan(spark, key).split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate" in lines[i + 1] or "Project" in lines[i + 1] and "HashAggregate" in lines[i + 2]


@pytest.mark.parametrize("key", ["win_cumsum_segment", "win_global_id", "corpus_sentences"])
def test_order_moves_counts_not_text(spark, key):
    """Texts are read once, to be stored as marks, counts or sentences; what is put in order is keys and counts."""
    text = plan(spark, key)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", text)
    assert schemas and all("text" not in s for s in schemas) and sum("__items" in s for s in schemas) <= 1
    for window in re.findall(r"Window \[[^\n]*", text):
        assert "sentence" not in window and "text" not in window


def test_no_query_plans_a_cross_product(spark):
    for key in ("log_ratio", "tf_idf", "win_col_normalize", "stat_dist", "eval_auc", "doc_length", "stat_scale"):
        text = plan(spark, key)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, key


def test_readability_needs_no_shuffle(spark):
    exchanges = re.findall(r"Exchange (\w+)\([^\n]*", plan(spark, "read_ari"))
    assert exchanges == []


def test_no_local_checkpoint_or_unbounded_collect():
    import pathlib

    for path in pathlib.Path(entry.__file__).parent.joinpath("corpusloom").rglob("*.py"):
        assert "localCheckpoint" not in path.read_text()


def test_tagged_tokens_are_not_shuffled(spark):
    lines = plan(spark, "pos_tag").split("\n")
    explode = next(i for i, line in enumerate(lines) if re.search(r"Generate posexplode\(arrays_zip", line))
    assert not any("Exchange hashpartitioning" in line for line in lines[:explode])
