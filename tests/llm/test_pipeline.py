"""The pipeline's stages against plain versions of what each must keep."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from weftline.llm import mixing, secret_scan, toxicity
from weftline.sources.tables import table


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_dedup", "secret_scan", "source_mixing", "best_fit_packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != names[-1]:
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.fit(before, table(spark, data, "labels"))
            good = {r.doc_id for r in toxicity.score(before, model).where("predicted = 0").collect()}
            assert {r.doc_id for r in docs.collect()} == good and 0.8 < len(good) / before.count() < 1
        elif name == "simhash_dedup":
            assert docs.select("doc_id").distinct().count() == docs.count()
            assert docs.select("text").distinct().count() == docs.count() == docs.join(before, columns, "left_semi").count()
            assert before.select("text").distinct().count() - docs.count() < 0.1 * before.count()
        elif name == "secret_scan":
            assert docs.count() == before.count()
            again = secret_scan.secret_digest(docs).where("n_assign + n_access + n_hex > 0")
            assert again.count() == 0
            assert secret_scan.secret_digest(before).where("n_hex > 0").count() > 0
        elif name == "source_mixing":
            rates = {r.source: r.rate for r in mixing.temperature_rates(before).collect()}
            assert docs.count() == pytest.approx(sum(rates[r.source] for r in before.collect()), rel=0.15)
            assert docs.join(before, columns, "left_anti").count() == 0
        kept[name] = docs.count()
    copies = docs.where("piece = 0").groupBy("doc_id").count()
    told = before.groupBy("doc_id").count()
    assert rows(copies) == rows(told)
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).where("offset >= 0").count() > 0
