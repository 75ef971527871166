import os

from corpusloom.sources.warehouse import KEPT, Warehouse

from .conftest import rows


def test_versions(spark, tmp_path):
    store = Warehouse(spark, f"file://{tmp_path}", {"t": "id long, s struct<a:int,b:string>"})
    assert store.read("t").count() == 0
    one = spark.createDataFrame([(1, (2, "x"))], "id long, s struct<a:int,b:string>")
    for _ in range(4):
        store.append("t", one)
    assert store.read("t").count() == 4
    assert len(store.versions("t")) == KEPT
    os.makedirs(tmp_path / "t" / "v99")  # a write that never ended
    assert store.read("t").count() == 4
    store.replace("t", store.read("t").limit(1))
    assert rows(store.read("t"), "id", "s.b") == [(1, "x")]


def test_append_leaves_the_rest_alone(spark, tmp_path):
    store = Warehouse(spark, f"file://{tmp_path}", {"t": "id long"})
    store.append("t", spark.range(5))
    before = {f: os.path.getmtime(tmp_path / "t" / "v1" / f) for f in os.listdir(tmp_path / "t" / "v1")}
    seen = store.read("t")
    store.append("t", seen.where("id < 2"))  # rows that come from the table itself
    assert store.read("t").count() == 7 and seen.count() == 5
    assert {f: os.path.getmtime(tmp_path / "t" / "v1" / f) for f in os.listdir(tmp_path / "t" / "v1")} == before
    store.replace("t", store.read("t").where("id = 1"))
    store.replace("t", store.read("t"))
    assert sorted(os.listdir(tmp_path / "t")) == ["v3", "v4"]
    assert store.read("t").count() == 2
