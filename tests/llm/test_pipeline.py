import corpus_pipeline as c
import pytest
from pyspark.sql import functions as F

from paralens.llm.queries import op10_quality_classifier, read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out = [read(spark, SF, "documents").cache()]
    for _, stage in c.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_stages_hand_on_documents(stages):
    for df in stages[1:-1]:
        assert set(df.columns) == set(c.COLUMNS)
    assert len(c.STAGES) == 5


def test_quality_stage_keeps_what_the_classifier_accepts(spark, stages):
    good = op10_quality_classifier(spark, SF).where("predicted = 1")
    assert sorted(ids(stages[1])) == sorted(ids(good)) and stages[1].count() < stages[0].count()


def test_near_duplicates_by_brute_force(stages):
    from test_similar_texts import groups

    rows = sorted((r.doc_id, r.text) for r in stages[1].collect())
    assert sorted(ids(stages[2])) == sorted(set(groups(*zip(*rows, strict=True))))


def test_contaminated_documents_go(spark, stages):
    from test_decontamination import brute

    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    clean = [i for (i, _), found in zip(rows, brute([t for _, t in rows], items), strict=True) if not found[2]]
    assert sorted(ids(stages[3])) == clean


def test_mixture_keeps_every_document(stages):
    n = stages[4].groupBy("doc_id").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    assert n[0] == 1 and n[1] <= 2 and n[2] == stages[3].count()
    same = stages[4].select("doc_id", "text").distinct().join(stages[3].select("doc_id", "text"), ["doc_id", "text"]).count()
    assert same == stages[3].count()


def test_shards_hold_the_mixture(stages):
    assert sorted(ids(stages[5])) == sorted(ids(stages[4])) and stages[5].select("shard").distinct().count() == 16


def test_run_equals_the_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.select("doc_id", "shard", "slot").collect())
    assert [x[0] for x in key(c.run(spark, SF))] == [x[0] for x in key(stages[5])]


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "word " * 30, None, "s", 1), (None, "other words " * 9, "en", "s", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for table in (rows, []):
        df = spark.createDataFrame(table, schema)
        for _, stage in c.STAGES:
            df = stage(spark, df, SF).cache()
            df.count()
        assert not table or df.count() >= 1


def test_extra_columns_of_clashing_names_come_back(spark):
    docs = read(spark, SF, "documents")
    names = ["score", "n_tokens", "epoch", "block", "dirty", "__text", "node", "a.b"]
    wide = docs.select(*docs.columns, *(F.concat_ws("-", F.lit(n), "doc_id").alias(n) for n in names))
    got, plain = wide, docs
    for _, stage in c.STAGES[:-1]:
        got, plain = stage(spark, got, SF).cache(), stage(spark, plain, SF).cache()
        assert got.columns == wide.columns and sorted(ids(got)) == sorted(ids(plain))
    wrong = F.exists(F.array(*(F.col(f"`{n}`") != F.concat_ws("-", F.lit(n), "doc_id") for n in names)), lambda x: x)
    assert got.count() > 0 and got.where(wrong).count() == 0
    assert sorted(ids(c.STAGES[-1][1](spark, got, SF))) == sorted(ids(plain))
