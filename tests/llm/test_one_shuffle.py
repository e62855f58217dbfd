"""Units are shuffled once for both their earliest occurrence and the join back."""

import pytest

from hexgiving.llm import substring

LINE = "one two three four five six seven eight nine"


def final_plan(df):
    q = df._jdf.queryExecution()
    q.toRdd().count()
    return q.executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("split", [substring.passages, substring.sentences])
@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_units_are_shuffled_once(spark, split, threshold):
    rows = [(1, f"{LINE}.\nfirst own line of eight words or some more."), (2, f"{LINE}."), (None, f"{LINE}."), (2, f"x {LINE}.\n{LINE}."), (3, None)]
    docs = spark.createDataFrame(rows * 20, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        listed, cut = substring.repeated_units(docs, split=split), substring.remove_repeats(docs, split=split)
        for df in (listed, cut):
            plan = final_plan(df)
            assert plan.count("ReusedExchange") == 1 and plan.count("REPARTITION_BY_COL") <= 2
        texts = {(r["doc_id"], r["text"]) for r in cut.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert texts == {(1, rows[0][1]), (2, ""), (None, ""), (2, f"x {LINE}.\n"), (3, None)}
    assert {r["first_id"] for r in listed.collect()} == {1}
