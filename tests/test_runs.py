import pytest
from pyspark.sql import functions as F

from twinloom.operators import training_log as L
from twinloom.operators import translate as T
from twinloom.plans.evaluation import evaluate

SENTENCES = [
    "Сегодня утром шёл мелкий дождь.",
    "Дети собрали в саду корзину спелых яблок и две груши.",
]


def test_losses(spark):
    rows = [(1, 0, 2.0, 3), (1, 0, 4.0, 1), (1, 1, 1.0, 5), (2, 0, 9.0, 1)]
    metrics = spark.createDataFrame(rows, "epoch int, loader int, value double, n_rows int")
    means = L.mean_loss_by_loader(metrics)
    assert {(r.epoch, r.loader): r.val_loss for r in means.collect()} == {(1, 0): 2.5, (1, 1): 1.0, (2, 0): 9.0}
    assert {r.epoch: r.val_loss for r in L.macro_loss(means).collect()} == {1: 1.75, 2: None}


@pytest.mark.parametrize("by", [(), ("run",)])
def test_best_checkpoints(spark, by):
    losses = [5.0, 1.0, 3.0, 1.0, 2.0, 8.0]
    rows = [(run, s, v + i) for i, run in enumerate("ab") for s, v in enumerate(losses)]
    df = spark.createDataFrame(rows if by else rows[:6], "run string, step long, val_loss double")
    got = {(r.run, r.step, r.kept_as) for r in L.best_checkpoints(df, *by).collect()}
    runs = "ab" if by else "a"
    want = {(run, s, "best") for run in runs for s in (1, 3, 4)} | {(run, 5, "last") for run in runs}
    assert got == want


def test_best_checkpoints_limits_before_the_shuffle(spark):
    rows = spark.range(100).selectExpr("id % 3 AS run", "id AS step", "1.0D AS val_loss")
    plan = L.best_checkpoints(rows, "run")._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan[plan.index("WindowGroupLimit"):]


def test_missing_values(spark):
    metrics = spark.createDataFrame([(1, 0, 2.0, 1), (1, 0, None, 1)], "epoch int, loader int, value double, n_rows int")
    assert L.mean_loss_by_loader(metrics).first().val_loss == 2.0
    rows = [("a", 1, None), ("a", 2, 3.0), ("a", 3, None)]
    records = spark.createDataFrame(rows, "run string, step long, val_loss double")
    kept = {(r.step, r.kept_as) for r in L.best_checkpoints(records, "run").collect()}
    assert kept == {(2, "best"), (3, "last")}


def test_checkpoint_names(spark):
    name = spark.range(1).select(L.checkpoint_name(F.lit(5), F.lit(0.93751)).alias("n"))
    assert name.first().n == "epoch=05-val_loss=0.93751.ckpt"
    epoch, loss = L.parse_checkpoint_name(F.col("n"))
    assert tuple(name.select(epoch, loss).first()) == (5, 0.93751)


def counting_factory():
    state = {"made": 0}

    def make():
        state["made"] += 1
        return lambda texts, options: [f"{state['made']}|{options.tgt_lang}|{t.upper()}" for t in texts]

    return make


def test_translate_builds_one_model_per_task(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(30)] + [(30, None)], "i int, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = {r.i: r.translation for r in T.translate(df, counting_factory()).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows[3] == "1|rus_Cyrl|T3" and rows[30] is None
    assert {v.split("|")[0] for v in rows.values() if v} == {"1"}


def test_languages_by_name_and_normalised_texts(spark):
    options = T.TranslateOptions(src_lang="Русский", tgt_lang="Лезги чlал")
    assert (options.src_lang, options.tgt_lang) == ("rus_Cyrl", "lez_Cyrl")
    pairs = spark.createDataFrame([("“a”\tb", "ﬁ …")], "ru string, lez string")
    row = T.translate_split(pairs, lambda: lambda texts, o: texts, options).first()
    assert (row.hyp, row.ref, row.ru) == ('"a" b', "fi ...", "“a”\tb")


def test_translate_list_and_options(spark):
    options = T.TranslateOptions(num_beams=3, extra={"early_stopping": True})
    factory = lambda: lambda texts, o: [f"{o.num_beams}{o.extra['early_stopping']}{len(t)}" for t in texts]
    rows = T.translate_list(spark, SENTENCES, factory, options).orderBy("id").collect()
    assert [r.translation for r in rows] == [f"3True{len(s)}" for s in SENTENCES]


def test_translator_must_answer_every_text(spark):
    with pytest.raises(Exception, match="1 translations out"):
        T.translate(spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1), lambda: lambda t, o: ["x"]).collect()


def test_evaluate(spark):
    pairs = spark.createDataFrame(
        [("один два три четыре пять", "один два три четыре пять"), ("шесть семь", None)], "ru string, lez string"
    )
    row = evaluate(pairs, lambda: lambda texts, o: texts).first()
    assert row.bleu == pytest.approx(100) and row.chrf == pytest.approx(100) and row.n == 1
