import pytest
from pyspark.sql import functions as F

from paralens.functions import features, text
from paralens.operators import equivalence, pool
from paralens.tasks import get, items

GOOD = "Multiply {a} by {b} and reply with the plain integer only."


def reason(spark, wording, task="mult", **more):
    df = spark.createDataFrame([(wording,)], "t string")
    t = get(task)
    return df.select(text.rejection(F.col("t"), t.slot_names, t.name, **more)).first()[0]


@pytest.mark.parametrize(("wording", "part"), [
    (GOOD, None), ("   ", "empty"), (GOOD + "\nNow.", "multiline"), ("{a}{b}", "length 6 outside 20..700"), ("Multiply {a} and reply with the integer.", "placeholder {b} appears 0"),
    (GOOD + " {a}", "placeholder {a} appears 2"), (GOOD + " {c} {c}", "['{c}', '{c}']"), (GOOD + " Not 1234.", "3+ digit"),
])
def test_validation(spark, wording, part):
    found = reason(spark, wording)
    assert found is None if part is None else part in found


def test_options_must_be_named(spark):
    good = "{rule} {fact} Does {target} follow? Say YES, NO or UNKNOWN."
    assert reason(spark, good, "entail") is None
    assert "unknown" in reason(spark, good.replace("UNKNOWN", "INDETERMINATE"), "entail")


def test_unbalanced_braces_only_when_asked(spark):
    assert reason(spark, GOOD + " }") is None
    assert reason(spark, GOOD + " }", balanced=True) == "unbalanced brace"


def test_rendering_is_one_pass(spark):
    df = spark.createDataFrame([("x {a} y {b}{a} {no}", {"a": "{b}", "b": "2"}), ("plain", {"a": "1"}), ("", {"a": "1"})], "t string, s map<string,string>")
    assert [r[0] for r in df.select(text.rendered(F.col("t"), F.col("s"))).collect()] == ["x {b} y 2{b} {no}", "plain", ""]


@pytest.mark.parametrize("wording", ["x {c} {a}", "x } {a}", "{ {a}"])
def test_strict_rendering_raises(spark, wording):
    df = spark.createDataFrame([(wording, {"a": "1"})], "t string, s map<string,string>")
    assert df.select(text.rendered(F.col("t"), F.col("s"))).count() == 1
    with pytest.raises(Exception, match="no value|single brace"):
        df.select(text.rendered(F.col("t"), F.col("s"), strict=True)).collect()


def test_first_of_equal_wordings_stays(spark):
    df = spark.createDataFrame([(2, "multiply  {a} by {b}!"), (1, "Multiply {a} by {b}."), (3, "Other {a} {b}")], "ord long, text string")
    rows = {r["text"]: r["copies"] for r in pool.first_of_each(df).collect()}
    assert rows == {"Multiply {a} by {b}.": 2, "Other {a} {b}": 1}


def test_new_wordings_are_numbered_on(spark):
    old = spark.createDataFrame([(0, "canonical", "One {a}", "author"), (5, "x", "Two {a}", "author")], "id long, style string, text string, source string")
    new = spark.createDataFrame([(9, "s", "one {A}."), (8, "s", "Three"), (7, "s", "Four"), (10, "s", "three!")], "ord long, style string, text string")
    assert sorted((r.id, r.text) for r in pool.extended(old, new).collect()) == [(0, "One {a}"), (5, "Two {a}"), (6, "Four"), (7, "Three")]


def test_candidate_lines(spark):
    df = spark.createDataFrame([(1, "1. First one\n\n  - second\r\n* 3) third\x1efourth")], "ord long, reply string")
    assert [r.text for r in pool.candidate_rows(df).orderBy("ord").collect()] == ["First one", "second", "third", "fourth"]


BINARY = {
    "is_question": "Is {a}?", "role_frame": "  You are good.", "think_cue": "Go step by step.", "immediate_cue": "Answer AT ONCE.", "format_instruction": "Only the number.",
    "politeness": "Please go.", "markdown": "**bold**", "numbered_list": "1. go", "shouty_caps": "VERY LOUD",
}


@pytest.mark.parametrize("name", sorted(BINARY))
def test_binary_features(spark, name):
    df = spark.createDataFrame([(BINARY[name],), ("Multiply {a} by {b}.",)], "text string")
    assert [r[name] for r in features.with_features(df).collect()] == [1.0, 0.0]


def test_positions_count_code_points(spark):
    df = spark.createDataFrame([("😀😀{a}",), ("{a} only the",), ("only the {a}",), ("",)], "text string")
    rows = features.with_features(df).collect()
    assert rows[0].slot_position == pytest.approx(2 / 5) and rows[1].format_before_slot == 0.0 and rows[2].format_before_slot == 1.0 and rows[3].slot_position == 0.0


def test_work_list_resumes(spark):
    t = get("mult")
    wordings = spark.createDataFrame([(0, "a {a} {b}"), (1, "b {a} {b}"), (2, "c {a} {b}")], "id long, text string")
    done = spark.createDataFrame([(0, t.items[0].key, "1", None), (1, t.items[1].key, None, "timeout")], "p long, i string, r string, e string")
    every = pool.work_list(wordings, items(spark, t), done)
    assert every.count() == 3 * 24 - 2 and pool.work_list(wordings, items(spark, t), done, retry_failed=True).count() == 3 * 24 - 1
    assert pool.work_list(wordings, items(spark, t), done, first=1).select("p").distinct().count() == 1
    some = [r.p for r in pool.work_list(wordings, items(spark, t), done, limit=30).collect()]
    assert len(some) == 30 and len(set(some)) == 2  # whole wordings, side by side
    assert "a 79 92" not in {r.prompt for r in every.collect()}


def test_verdicts(spark):
    df = spark.createDataFrame([(1, " equivalent; same ; x", "t"), (2, "Different", "t"), (3, None, "t")], "id long, reply string, text string")
    judged = equivalence.judgements(df)
    assert [(r.verdict, r.reason) for r in judged.orderBy("id").collect()] == [("EQUIVALENT", "same ; x"), ("DIFFERENT", ""), ("UNJUDGED", "")]
    t = equivalence.tally(judged).first()
    assert (t.n, t.equivalent, t.unjudged) == (3, 1, 1) and t.rate == pytest.approx(1 / 3)
    assert equivalence.tally(judged.where("id > 9")).first().rate is None
    assert sorted(r.p for r in equivalence.equivalent_ids(judged).collect()) == [0, 1]


def test_styles_go_round(spark):
    s = spark.createDataFrame([("a",), ("b",)], "style string")
    x = spark.createDataFrame([("1",), ("2",), ("3",)], "axis string")
    rows = pool.shuffled_combinations(s, x, 13).orderBy("call").collect()
    assert [tuple(r)[1:] for r in rows[:6]] == [tuple(r)[1:] for r in rows[6:12]] and len({tuple(r)[1:] for r in rows[:6]}) == 6


def test_prompt_lists_what_exists(spark):
    df = spark.createDataFrame([(["old one"],), ([],)], "avoid array<string>")
    a, b = (r[0] for r in df.select(pool.generation_prompt(get("mult"), F.lit("terse"), F.lit("short"), 5, F.col("avoid"))).collect())
    assert "old one" in a and "Differ" not in b and "{a}, {b}" in b
