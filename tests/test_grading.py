import pytest
from pyspark.sql import functions as F

from paralens.functions import grading
from paralens.operators import accounting
from paralens.tasks import get, items


def outcomes(spark, rows, kind):
    df = spark.createDataFrame(rows, "text string, answer string")
    return [tuple(r) for r in df.select(grading.outcome(F.col("text"), F.col("answer"), kind), grading.lenient(F.col("text"), F.col("answer"), kind)).collect()]


@pytest.mark.parametrize(("text", "expected"), [
    ("47 x 83 = 3901", "correct"), ("3,901", "correct"), ("47 times 83 equals 3902", "wrong"), ("", "unparseable"), ("I cannot compute that.", "unparseable"),
    ("**3901**", "correct"), (None, "error"), ("003901", "correct"), ("3901 or 99999999999999999999999", "wrong"), ("0", "wrong"),
])
def test_integers(spark, text, expected):
    assert outcomes(spark, [(text, "3901")], "integer")[0][0] == expected


def test_commas_only_between_digits(spark):
    df = spark.createDataFrame([("3,901",), ("12, 34",), ("1,2,3",)], "t string")
    assert [r[0] for r in df.select(grading.candidates(F.col("t"), "integer")).collect()] == [["3901"], ["12", "34"], ["123"]]


def test_labels_are_whole_words(spark):
    df = spark.createDataFrame([("It is not the case.",), ("unknowable",), ("Answer: UNKNOWN",), ("no, wait, yes",), ("éno",), ("no_way",)], "t string")
    found = [r[0] for r in df.select(grading.candidates(F.col("t"), "label")).collect()]
    assert found == [[], [], ["unknown"], ["no", "yes"], ["no"], []]


def test_lenient_takes_any_candidate(spark):
    assert outcomes(spark, [("20 or 21", "20"), ("20", "20"), ("x", "20"), (None, "20")], "integer") == [("wrong", True), ("correct", True), ("unparseable", False), ("error", False)]


def test_unknown_kind():
    with pytest.raises(ValueError, match="unknown answer kind"):
        grading.candidates(F.lit("x") if False else None, "other")


def group(spark, texts):
    rows = [(1, str(k), t, a) for k, (t, a) in enumerate(texts)]
    df = spark.createDataFrame(rows, "p long, i string, r string, answer string")
    return accounting.by_wording(accounting.graded(df, "integer")).first()


def test_failed_calls_leave_the_denominator(spark):
    g = group(spark, [("10", "10"), ("99", "20"), ("no digits here", "30"), (None, "40")])
    assert (g.correct, g.wrong, g.unparseable, g.error, g.attempts) == (1, 1, 1, 1, 4)
    assert g.strict_accuracy == pytest.approx(1 / 3)


def test_three_accuracies_differ(spark):
    g = group(spark, [("10", "10"), ("the answer is 20 or maybe 21", "20"), ("sorry", "30"), ("40", "40")])
    assert (g.strict_accuracy, g.parsed_accuracy, g.lenient_accuracy) == (2 / 4, pytest.approx(2 / 3), 3 / 4)


def test_nothing_measured_is_null(spark):
    g = group(spark, [(None, "10"), (None, "20")])
    assert g.strict_accuracy is None and g.parsed_accuracy is None and g.lenient_accuracy is None


def test_unknown_item_is_an_error(spark):
    rows = spark.createDataFrame([(1, "mult-1x1", "1")], "p long, i string, r string")
    with pytest.raises(Exception, match="unknown item"):
        accounting.with_answers(rows, items(spark, get("mult"))).collect()


def test_items(spark):
    m = get("mult").items
    assert len(m) == len({x.key for x in m}) == 24 and (m[0].key, m[0].answer) == ("mult-79x92", str(79 * 92))
    assert all(int(x.slots["a"]) % 10 > 1 and int(x.slots["b"]) % 10 > 1 and x.slots["a"] != x.slots["b"] for x in m)
    e = get("entail").items
    assert sorted(x.answer for x in e) == ["no"] * 6 + ["unknown"] * 12 + ["yes"] * 6
    with pytest.raises(KeyError, match="mult"):
        get("nothing")
