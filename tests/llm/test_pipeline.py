"""The operators' queries on the small tables, their SQL, and the pipeline."""

import duckdb
import pytest
from conftest import SMALL

import corpus_pipeline
from termweave.llm import language_id, quality_classifier, quality_rules
from termweave.llm.queries import ORACLES, QUERIES

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from read_parquet('{SMALL}/documents.parquet')")
    expected = connection.execute(ORACLES[name]).df()
    result = QUERIES[name](spark, SMALL)
    columns = sorted(expected.columns)
    assert sorted(result.columns) == columns
    assert sorted(map(repr, (tuple(r) for r in result.select(*columns).collect()))) == sorted(map(repr, (tuple(v.item() if hasattr(v, "item") else v for v in r) for r in expected[columns].itertuples(index=False, name=None))))


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{i}"
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == DOCUMENTS, name
        assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    assert counts == sorted(counts, reverse=True) and counts[4] == counts[5] and counts[1] < counts[0] and counts[3] < counts[2]
    assert docs.where("not round_trip").isEmpty()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in QUERIES if n != "pipeline"] == [f"op{i}" for i in range(1, 11)]


def test_held_out_accuracy(spark):
    """Half the rows fit the models, the others measure them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    rows = language_id.identify(rest, language_id.fit_on_table(half)).join(rest.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert sum(r.language == r.lang for r in rows) >= 0.97 * len(rows)
    graded = labels.where("doc_id % 2 = 1")
    kept = {r.doc_id for r in quality_classifier.ranked(docs, labels.where("doc_id % 2 = 0")).collect()}
    good = {r.doc_id for r in graded.where("quality = 1 and toxic = 0").collect()}
    bad = {r.doc_id for r in graded.where("quality = 0").collect()}
    assert len(good & kept) >= 0.95 * len(good) and len(bad & kept) <= 0.25 * len(bad)
    ruled = {r.doc_id for r in quality_rules.kept(docs).collect()}
    every = {r.doc_id: r.quality for r in labels.where("toxic = 0").collect()}
    fine = {i for i, q in every.items() if q == 1}
    junk = {i for i, q in every.items() if q == 0}
    assert len(fine & ruled) >= 0.95 * len(fine) and len(junk & ruled) <= 0.2 * len(junk)


def test_held_out_toxic_documents():
    """Even labels fit the model; odd ones measure toxic recall beside the share of good documents kept."""
    path = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"""select doc_id, text, case when quality = 0 then 0 when coalesce(toxic, 0) <> 0 then 1 else 2 end as grade
        from '{path}/documents.parquet' join '{path}/labels.parquet' using (doc_id) where quality is not null order by doc_id""").df()
    half, rest = rows[rows.doc_id % 2 == 0], rows[rows.doc_id % 2 == 1]
    model = quality_classifier.fit(half.text.tolist(), half.grade.to_numpy(), 0.005)
    kept = model.score(rest.text.tolist()) >= model.threshold
    grade = rest.grade.to_numpy()
    assert kept[grade == 2].mean() >= 0.97 and kept[grade == 0].mean() <= 0.05 and kept[grade == 1].mean() <= 0.05
    long = rest.text.str.split().str.len().to_numpy() > 1000
    assert kept[(grade == 1) & long].mean() <= 0.1
