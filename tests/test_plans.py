"""Shapes the physical plans must keep."""

import re

import pytest

from notemill.plans.queries import QUERIES

LAZY = [
    "fewshot_labels", "group_split_90_10", "split_by_site", "row_split_50_50", "seeded_shuffle_rank",
    "token_grid", "line_offsets", "bio_token_spans", "bio_char_spans", "xml_event_labels",
    "span_text_check", "label_histogram", "label_vocab", "conll_lines", "length_split",
    "entity_chunks", "entity_scores", "confusion", "class_scores", "best_checkpoint", "early_stop",
    "keep_latest", "time_budget", "param_budget", "size_report", "method_matrix", "sentence_ids",
]


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.mark.parametrize("name", LAZY)
def test_no_single_task_and_no_row_udf(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    # One task may only order the bucket totals of a rank, never rows.
    for found in re.finditer(r"Window \[[^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition[^\n]*\n([^\n]*)", plan):
        assert re.search(r"HashAggregate\(keys=\[[^\]]*__(bucket|slice)#", found.group(1)), found.group(0)


def test_row_local_labelling_has_no_shuffle(spark, sf):
    from notemill.operators import spans
    from notemill.sources import readers

    files = spark.createDataFrame([("d", "x")], "doc_id string, text string")
    plan = plan_of(spans.label_annotated_notes(readers.parse_span_xml(files)))
    assert "Exchange" not in plan


def test_few_shot_limits_before_the_shuffle(spark, sf):
    assert plan_of(QUERIES["fewshot_labels"](spark, sf)).count("WindowGroupLimit") >= 2


def test_only_needed_columns_are_read(spark, sf):
    plan = plan_of(QUERIES["group_split_90_10"](spark, sf))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("text" not in s for s in schemas)
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)]" in plan_of(QUERIES["rows_of_class"](spark, sf))


@pytest.mark.parametrize("name", ["group_split_90_10", "split_sizes", "sentences_by_group", "unseen_labels", "split_null_site"])
def test_rows_of_one_site_are_spread_where_nothing_is_broadcast(spark, sf, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(QUERIES[name](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if re.search(r"(SortMerge|ShuffledHash)Join.*(source|lang)#", line)]
    assert any("__salt" in line for line in joins)
    # The others join one row per group with its bucket's offset.
    assert all("__salt" in line or "__bucket" in line for line in joins), joins


def test_vocabulary_is_a_sorted_limit(spark, sf):
    assert "TakeOrderedAndProject(limit=30000" in plan_of(QUERIES["word_vocab"](spark, sf))


def test_large_samples_rank_only_the_buckets_they_need(spark, sf):
    from notemill.operators import sampling

    rows = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    plan = plan_of(sampling.few_shot(rows, "quality", 5000, "doc_id"))
    assert re.search(r"Join.*LeftSemi", plan) and "__bucket" in plan


def test_rejects_are_read_once(spark, sf):
    """A size filter on the computed rejects would read every file a second time, below its first step."""
    plan = plan_of(QUERIES["xml_rejects"](spark, sf))
    assert plan.count("from_xml(") == 1 and "Filter (size(" not in plan
