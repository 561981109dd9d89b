"""Plans that must hold at scale: what is pushed down, limited early, and never a nested loop."""

import re

import pytest

from docketry.operators import deid, select, sets, windows
from docketry.plans.inputs import Inputs


@pytest.fixture
def inputs(spark, sf_dir):
    return Inputs(spark, sf_dir)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_taken_by_task(inputs):
    assert "TakeOrderedAndProject" in plan(sets.oldest_cases(inputs.cases, "O", 5))


def test_latest_per_key_is_limited_before_the_shuffle(inputs):
    p = plan(windows.keep_recent(inputs.events, ["profile"], "ts", "id", 10))
    assert p.count("WindowGroupLimit") == 2  # partial and final


def test_filters_and_columns_reach_the_scan(inputs):
    p = plan(select.filter_cases(inputs.cases, "O").select("case_no", "queue"))
    assert "EqualTo(o_orderstatus,O)" in p
    schema = re.search(r"ReadSchema: struct<o_orderkey[^>]*>", p)[0]
    assert "o_totalprice" not in schema and "o_orderdate" not in schema


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_barriers_are_no_nested_loops(spark, inputs, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        outgoing = inputs.sheets.withColumnRenamed("piece_id", "turn")
        keyed = deid.barrier_hits(outgoing, inputs.parties.selectExpr("tenant", "degree", "case_no", "name AS value"))
        everywhere = deid.global_hits(outgoing, inputs.values)
        for df in (keyed, everywhere):
            assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_are_searched_for_values_where_they_lie(spark, inputs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        outgoing = inputs.pieces.withColumnRenamed("piece_id", "turn")
        p = plan(deid.global_hits(outgoing, inputs.values))
        assert "MapInArrow" in p and "Exchange" not in p  # neither texts nor the pieces that were met are written to disk
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_python_in_the_case_operators(spark, sf_dir):
    from docketry.plans.queries import QUERIES

    for name in ("a4_daily_totals", "d1_detect_patterns", "d5_drop_preserved", "w2_number_labels", "m1_retain_drafts", "w5_pick_templates", "x1_cpf_valid"):
        assert not re.search("Python|Pandas|Arrow", plan(QUERIES[name](spark, sf_dir)))


def test_detection_and_labels_take_one_shuffle_of_the_texts(inputs):
    p = plan(windows.number_labels(deid.detect_patterns(inputs.sheets)))
    above = p[: p.index("Generate inline")]
    assert "Exchange" not in above  # the sheets are dealt by case, which serves the labels too


def test_an_audit_is_made_where_the_sheets_are_dealt(spark, sf_dir):
    from docketry.plans.queries import QUERIES

    df = QUERIES["d12_mask_audit"](spark, sf_dir)
    assert plan(df).count("Exchange hashpartitioning(tenant") == 2  # the sheets', for the texts and for what is found in them
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert re.search(r"ReusedExchange \[tenant", final)  # and these are one


def test_a_cpf_is_made_once(spark, sf_dir):
    from docketry.plans.queries import QUERIES

    # where each digit names the whole number, filters that move below it make it again for each of their digits
    assert plan(QUERIES["j8_known_persons"](spark, sf_dir)).count("lpad(") < 10


def test_texts_are_dealt_once_to_their_dictionary(spark, inputs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = inputs.pieces.select("tenant", "degree", "case_no", "piece_id", "text")
        p = plan(deid.mask(texts, texts.selectExpr("tenant", "degree", "case_no", "'x' AS label", "'y' AS value")))
        assert "SortMergeJoin" not in p and "ShuffledHashJoin" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
