"""Each stage of the pipeline against what it should do to its own input."""

from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F

from tests_llm_plain import plain_components, plain_simhash, plain_spans


def written(df, tmp_path, name):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r[0] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id").collect()}
    clean = written(cp.drop_toxic(spark, docs, sf_dir), tmp_path, "0")
    assert clean.dtypes == docs.dtypes
    gone = {r[0] for r in docs.select("doc_id").subtract(clean.select("doc_id")).collect()}
    assert len(gone & toxic) > 0.6 * len(toxic) and len(gone) < 0.12 * docs.count()

    single = written(cp.drop_near_duplicates(spark, clean, sf_dir), tmp_path, "1")
    rows = clean.select("doc_id", "text").collect()
    groups = plain_components([r["doc_id"] for r in rows], [plain_simhash(r["text"]) for r in rows])
    assert single.columns == docs.columns
    assert sorted(r["doc_id"] for r in single.select("doc_id").collect()) == sorted(set(groups))

    masked = written(cp.mask_secrets(spark, single, sf_dir), tmp_path, "2")
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in masked.collect()}
    assert masked.columns == docs.columns and set(before) == set(after)
    for d, text in before.items():
        if plain_spans(text):
            assert "[SECRET]" in after[d][0] and len(after[d][0]) == after[d][1] and not plain_spans(after[d][0])
        else:
            assert "[SECRET]" in after[d][0] or after[d][0] == text

    mixed = written(cp.mix_sources(spark, masked, sf_dir), tmp_path, "3")
    assert mixed.columns == docs.columns
    size, taken = Counter(), Counter()
    for r in masked.collect():
        size[r["doc_id"]] += len(r["text"].split())
    for r in mixed.collect():
        taken[r["doc_id"]] += len(r["text"].split())
        assert r["text"] in after[r["doc_id"]][0] and r["n_chars"] == len(r["text"])
    assert all(taken[d] <= 2 * n for d, n in size.items()) and abs(sum(taken.values()) / sum(size.values()) - 1.5) < 0.001

    packed = written(cp.pack_sequences(spark, mixed, sf_dir), tmp_path, "4")
    total = packed.agg(F.sum("length")).first()[0]
    assert packed.where("piece = 0").count() == mixed.count()
    assert packed.select("sequence_id").distinct().count() <= 1.01 * -(-total // 2048) + 1


def test_odd_rows_pass_through(odd, none, spark, sf_dir, tmp_path):
    labels = spark.createDataFrame([(100, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for number, df in enumerate((odd, none)):
        docs = df
        for k, (_, stage) in enumerate(cp.STAGES[:4]):
            docs = written(stage(spark, docs, str(tmp_path)), tmp_path, f"{number}-{k}")
            assert docs.columns == df.columns
        packed = written(cp.STAGES[4][1](spark, docs, str(tmp_path)), tmp_path, f"{number}-4")
        assert (packed.count() > 0) == (number == 0)


def test_one_of_each_group_stays(odd, spark, sf_dir):
    kept = cp.drop_near_duplicates(spark, odd, sf_dir).collect()
    prints = Counter(plain_simhash(r["text"]) for r in kept)
    assert set(prints.values()) == {1}
    assert {r["doc_id"] for r in kept if r["text"] and "cat" in r["text"]} == {1}


def test_run_is_registered(spark, sf_dir):
    assert cp.QUERIES["pipeline"](spark, "/root/testdata/sf0.001").count() > 0
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near duplicates", "secrets", "mixing", "packing"]
