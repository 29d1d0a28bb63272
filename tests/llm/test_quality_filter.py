"""A filter on the verdict costs no more than the verdict, and the rules know the four languages of the tables."""

import time

from quillspark.llm import quality
from quillspark.llm.common import table


def test_filter_on_the_verdict_costs_no_more(spark, sf_dir):
    judged = quality.clean(table(spark, sf_dir, "documents"))
    want = sorted(r["doc_id"] for r in judged.select("doc_id", "kept").collect() if r["kept"])
    start = time.time()
    assert sorted(r["doc_id"] for r in judged.filter("kept").select("doc_id").collect()) == want
    assert time.time() - start < 60
    plan = judged.filter("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == judged._jdf.queryExecution().optimizedPlan().toString().count("sequence(")


def test_menus_and_boilerplate_of_other_languages(spark):
    lines = ["Startseite", "Lire la suite »", "Iniciar sesión", "Alle Rechte vorbehalten 2020 bei uns allen hier.", "Política de privacidad de nuestra casa para todos.", "Ein ganzer Satz bleibt hier stehen."]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    assert quality.clean(df).first()["cleaned"] == lines[-1]
