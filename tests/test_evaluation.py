import pytest
from pyspark.sql import functions as F

from quarry import schemas
from quarry.operators import evaluation

RESULT = "array<struct<rank:int,page_start:int,page_end:int,article:string,text:string>>"


def rank(spark, results, expected, **kw):
    df = spark.createDataFrame([(results, expected)], f"results {RESULT}, expected array<struct<article:string,page:string>>")
    return df.select(evaluation.first_evidence_rank(F.col("results"), F.col("expected"), **kw)).first()[0]


ONE = [(1, 12, 13, "Điều 35", "Điều 35. theo Điều 9"), (2, 20, 20, None, "khác")]


@pytest.mark.parametrize(
    "expected,want",
    [
        ([("Điều 35", None)], 1), ([("điều 3", None)], 1), ([("Điều 9", None)], 1), ([(None, "13")], 1), ([(None, "20")], 2), ([("Điều 35", "20")], None),
        ([(None, None)], None), ([("", None)], None), ([(None, "x")], None), ([], None), ([(None, "99"), ("KHÁC", None)], 2), ([("", "20")], 2),
    ],
)
def test_evidence(spark, expected, want):
    assert rank(spark, ONE, expected) == want


def test_strict_evidence(spark):
    assert rank(spark, ONE, [("Điều 3", None)], strict=True) is None
    assert rank(spark, ONE, [("Điều 35", None)], strict=True) == 1


def rows(spark, *cases):
    schema = f"answer string, answerable boolean, expected_citations array<struct<article:string,page:string>>, expected_keywords array<string>, results {RESULT}"
    return evaluation.rule_checks(spark.createDataFrame(list(cases), schema))


def test_refusal_is_seen_for_unanswerable_cases_only(spark):
    text = "Tôi không tìm thấy căn cứ đủ rõ."
    a, b, c = rows(spark, (text, False, [], ["không tìm thấy căn cứ"], []), (text, True, [("Điều 35", None)], [], ONE), (None, False, [], ["x"], None)).collect()
    assert (a["unanswerable_refusal"], a["keyword_hit_count"], a["keyword_hit_ratio"], a["retrieval_hit"]) == (True, 1, 1.0, False)
    assert (b["unanswerable_refusal"], b["keyword_hit_ratio"], b["first_evidence_rank"], b["retrieval_hit"]) == (None, None, 1, True)
    assert (c["unanswerable_refusal"], c["keyword_hit_count"], c["retrieval_hit"]) == (False, 0, False)


def summary(spark, *cases, by=()):
    df = spark.createDataFrame(list(cases), "answerable boolean, first_evidence_rank int, answer string, unanswerable_refusal boolean, category string")
    return [r.asDict() for r in evaluation.summary(df, 5, *by, rollup=bool(by)).collect()]


def test_summary_divides_by_answerable_cases(spark):
    got = summary(spark, (True, 2, "a", None, "x"), (True, None, "", None, "x"), (False, 1, "a", False, "y"), (False, None, "", False, "y"), (False, None, "a", True, "y"))
    assert got == [{"recall_at_5": 0.5, "mrr": 0.25, "unanswerable_non_refusal_count": 1, "case_count": 5, "answerable_case_count": 2}]


def test_summary_without_answerable_cases_has_no_recall(spark):
    got = summary(spark, (False, 1, "", False, "y"))[0]
    assert got["recall_at_5"] is None and got["mrr"] is None


def test_breakdown_has_subtotals(spark):
    got = summary(spark, (True, 1, "", None, "x"), (True, None, "", None, "y"), by=("category",))
    assert {r["category"]: r["recall_at_5"] for r in got} == {"x": 1.0, "y": 0.0, None: 0.5}


def test_case_schema_holds_pages_as_strings():
    assert schemas.EVIDENCE["page"].dataType.simpleString() == "string"
