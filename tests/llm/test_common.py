import pyarrow as pa

from dyadica.llm import common
from dyadica.llm.common import map_arrow


def test_what_a_worker_holds_goes_with_the_next_work(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "_releases", [])
    first, second = (lambda: calls.append(1)), (lambda: calls.append(2))
    for release in (first, first, None, None, second, second, first):
        common.take_over(release)
    assert calls == [1, 2]


def test_a_batch_a_slice(spark, monkeypatch):
    df = spark.range(20).selectExpr("id", "repeat('x', 400000) as t").coalesce(1)

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "rows": [batch.num_rows] * batch.num_rows}

    rows = map_arrow(df, run, "id long, rows int", text="t").collect()
    assert sorted(r.id for r in rows) == list(range(20)) and {r["rows"] for r in rows} == {2}
    whole = map_arrow(df, run, "id long, rows int").collect()
    assert {r["rows"] for r in whole} == {20}
