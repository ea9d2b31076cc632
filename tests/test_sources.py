"""Files, remote sources through a stand-in connection, the store, and streams."""

import base64
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorespark.sources import files, remote
from lorespark.sources.store import Store
from lorespark.streaming import ingest as st


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A\nline")
    (tmp_path / "sub" / "b.TXT").write_text("b")
    (tmp_path / "c.bin").write_text("no")
    got = {(r.source_id, r.text, tuple(r.allowed_principals)) for r in files.read_dir(spark, str(tmp_path), "w").collect()}
    assert got == {("a.md", "# A\nline", ("group:all",)), ("sub/b.TXT", "b", ("group:all",))}
    os.symlink("/etc/hostname", tmp_path / "d.txt")
    with pytest.raises(ValueError):
        files.read_dir(spark, str(tmp_path), "w")


def test_inline_items(spark):
    got = files.inline_items(spark, [{"source": "s", "source_id": "1", "text": "t"}], "w", datetime(2024, 1, 1)).first()
    assert (got.text, got.allowed_principals) == ("t", ["group:all"])


def stand_in(url, body, headers):
    if body is None:
        if "/commits/" in url:
            return {"sha": "c1", "commit": {"committer": {"date": "2024-01-01T00:00:00Z"}}}
        if "/git/trees/c1" in url:
            return {"tree": [{"type": "blob", "path": "docs/a.md", "sha": "s1"}, {"type": "blob", "path": "x.py", "sha": "s2"}, {"type": "tree", "path": "docs", "sha": "s3"}]}
        return {"content": base64.b64encode(b"hello").decode()}
    if body["method"] == "resources/list":
        return {"result": {"resources": [{"uri": "u2"}]} if body["params"] else {"resources": [{"uri": "u1"}], "nextCursor": "n"}}
    return {"result": {"contents": [{"text": "text of " + body["params"]["uri"]}, {"blob": "x"}]}}


def test_remote_readers_without_a_network(monkeypatch):
    monkeypatch.setattr(remote, "fetch_json", stand_in)
    reader = remote.RepositoryReader({"owner": "o", "repo": "r"})
    parts = reader.partitions()
    assert [p.name for p in parts] == ["docs/a.md"]
    assert list(reader.read(parts[0]))[0][:3] == ("github", "o/r:docs/a.md", "hello")
    reader = remote.ResourceReader({"url": "http://x"})
    assert [next(reader.read(p))[2] for p in reader.partitions()] == ["text of u1", "text of u2"]
    monkeypatch.setattr(remote, "fetch_json", lambda *a: {"error": {"code": 1}})
    with pytest.raises(RuntimeError):
        reader.partitions()


def test_sources_register(spark):
    remote.register(spark)


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    rows = lambda *x: spark.createDataFrame(list(x), "k long, p string, v string")
    assert store.read("t") is None
    store.insert_absent("t", rows((1, "a", "x"), (2, "b", "y")), ["k"])
    store.insert_absent("t", rows((1, "a", "other"), (3, "b", "z")), ["k"])
    assert {tuple(r) for r in store.read("t").collect()} == {(1, "a", "x"), (2, "b", "y"), (3, "b", "z")}
    store.upsert("t", rows((1, "a", "new")), ["k"])
    store.replace_partition("t", rows((9, "b", "only")), "p", "b")
    assert {tuple(r) for r in store.read("t").collect()} == {(1, "a", "new"), (9, "b", "only")}
    assert store.version("t") == 4 and store.read("t", 1).count() == 2


def test_store_writes_only_the_buckets_it_touches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", buckets=8)
    rows = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k long, v string")
    store.upsert("t", rows(range(200), "old"), ["k"])
    store.upsert("t", rows([5], "new"), ["k"])
    assert len(os.listdir(tmp_path / "t" / "v1")) > 8 and len([x for x in os.listdir(tmp_path / "t" / "v2") if x.startswith("_bucket")]) == 1
    got = {r.k: r.v for r in store.read("t").collect()}
    assert len(got) == 200 and got[5] == "new" and got[6] == "old"
    store.insert_absent("t", rows([5, 1000], "third"), ["k"])
    assert store.read("t").count() == 201 and {r.v for r in store.read("t").where("k in (5, 1000)").collect()} == {"new", "third"}
    store.replace("p", spark.createDataFrame([("a", 1), ("b", 2)], "w string, n int"), ["w"])
    store.replace_partition("p", spark.createDataFrame([("b", 3), ("b", 4)], "w string, n int"), "w", "b")
    store.replace_partition("p", spark.createDataFrame([], "w string, n int"), "w", "a")
    assert {tuple(r) for r in store.read("p").collect()} == {("b", 3), ("b", 4)} and store.read("p", 1).count() == 2


def test_stream_ingests_each_content_once(spark, tmp_path):
    schema = files.ITEM
    rows = [(k, "s", str(k), "w", f"text {k % 3}", ["group:all"], datetime(2024, 1, 1)) for k in range(6)]
    source = str(tmp_path / "in")
    for k in range(0, 6, 2):
        spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").parquet(source)
    store = Store(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    st.ingest_into(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert store.read("chunks").count() == 3 and store.read("raw_events").count() == 6


def test_windows_of_reads(spark, tmp_path):
    source = str(tmp_path / "reads")
    spark.createDataFrame([(1, datetime(2024, 1, 1, 0, m)) for m in (0, 5, 50)] + [(2, datetime(2024, 1, 1, 3, 0))], "id long, ts timestamp").write.parquet(source)
    for name, build in (("tumble", st.reference_counts), ("slide", lambda r: st.reference_counts(r, "1 hour", "30 minutes")), ("session", st.reading_sessions)):
        q = build(spark.readStream.schema("id long, ts timestamp").parquet(source)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        first = spark.table(name).where(F.col("id") == 1).agg(F.sum("reads")).first()[0]
        assert first == {"tumble": 3, "slide": 6, "session": 3}[name]
    once = st.unique_contents(spark.readStream.schema(files.ITEM).parquet(str(tmp_path / "reads")))
    assert "content_hash" in once.columns
