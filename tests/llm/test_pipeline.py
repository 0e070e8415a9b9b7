import __spark_entry__ as entry
import corpus_pipeline as P
from dyadica.llm import pii
from tests.llm.test_neardup import brute


def test_registered():
    found = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found if n.startswith("op")) == list(range(1, 14)) and "pipeline" in found
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mix", "encode"]


def test_stages_on_their_inputs(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "encode":
            assert docs.columns == before.columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            assert 0 < before.count() - docs.count() < 0.15 * before.count()
            gone = before.join(docs.select("doc_id"), "doc_id", "left_anti").join(labels, "doc_id")
            assert gone.filter("toxic = 0").count() == 0
            assert docs.exceptAll(before).count() == 0
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(r.doc_id for r in docs.collect()) == sorted(set(brute(rows)))
        if name == "personal_data":
            assert docs.count() == before.count()
            assert all(not pii.base_spans(r.text) and len(r.text) == r.n_chars for r in docs.collect())
        if name == "mix":
            old = {r.doc_id: r for r in before.collect()}
            rows = docs.collect()
            assert all(old[r.doc_id] == r for r in rows)
            words = lambda rows: sum(len(r.text.split()) for r in rows)
            assert abs(words(rows) / words(old.values()) - 1.5) < 0.1
    assert kept["encode"].count() == kept["mix"].count()


def test_edge_rows(spark, edge, nothing, tables):
    sf = tables(labels=spark.createDataFrame([(1, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int"))
    for name, stage in P.STAGES:
        out = stage(spark, edge, sf)
        assert stage(spark, nothing, sf).count() == 0
        assert out.count() > 0
        if name != "encode":
            assert out.schema.fieldNames() == edge.columns
