"""Each stage of the corpus pipeline beside what it should keep, on planted documents."""

import numpy as np
import pytest

import corpus_pipeline
from corelode.llm import simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("planted")
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    draw = np.random.default_rng(3)
    words = own.where("lang = 'en' and length(text) > 3000").orderBy("doc_id").first().text.split()
    text, shown = " ".join(words[:400]), []
    near = text.split()
    near[17] = "changed"
    for k, t in enumerate((text, text, " ".join(near), None, "", "... 123 !!!", " ".join(draw.permutation(near).tolist()))):
        shown.append((10_000 + k, t, "en", "planted", len(t or "")))
    own.union(spark.createDataFrame(shown, COLUMNS)).coalesce(4).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, planted)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and not ids & {10_003, 10_004, 10_005} and {10_000, 10_001, 10_002, 10_006} <= ids
    assert kept.count() > 0.97 * docs.where("text is not null and text <> ''").count()
    good = corpus_pipeline.quality_classifier(spark, kept, planted)
    told = good.join(spark.read.parquet(f"{planted}/labels.parquet"), "doc_id", "left")
    assert good.columns == docs.columns and told.where("quality = 0").count() < 0.1 * told.count()
    one = corpus_pipeline.simhash_near_dedup(spark, docs, planted)
    assert one.columns == docs.columns and {r.doc_id for r in one.where("doc_id >= 10000").collect()} & {10_000, 10_001, 10_002} == {10_000}
    packed = corpus_pipeline.best_fit_packing(spark, one, planted).toPandas()
    assert (packed.groupby("sequence_id").length.sum() <= 4096).all() and set(packed.doc_id) == {r.doc_id for r in one.collect()}


def test_run(spark, planted):
    packed = corpus_pipeline.run(spark, planted).toPandas()
    assert not set(packed.doc_id) & {10_001, 10_002, 10_003, 10_004, 10_005} and len(set(packed.doc_id)) > 500
    for _, rows in packed.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == (rows.length.cumsum() - rows.length).tolist()


def test_empty(spark, planted, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{planted}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_by_simhash(spark, planted):
    """The stage keeps the smallest id of each group that SimHash fingerprints link."""
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    want = {r.doc_id for r in simhash.near_duplicates(docs).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, planted).collect()} == want
