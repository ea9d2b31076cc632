"""What ingest works out once: ids without texts, chunks that most of its tables are made of, buckets of embeddings."""

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from lorespark.functions import scoring as sc
from lorespark.operators import ingest
from lorespark.plans import registry


def test_buckets_of_an_embedding_are_counted_in_one_pass(spark):
    texts = ["", None, "a", "a a b", " ".join(f"w{k % 37}" for k in range(400)), "ä é"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for dim in (1, 16, 256):
        for r in df.select("text", sc.embed_md5(F.col("text"), dim).alias("v")).collect():
            n = Counter(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim for t in re.findall("[a-z0-9]+", (r.text or "").lower()))
            size = math.sqrt(sum(x * x for x in n.values()))
            assert r.v == [n[b] / size if size else 0.0 for b in range(dim)]
    # No filter over all tokens for each bucket.
    assert "size(filter(" not in df.select(sc.embed_md5(F.col("text")).alias("v"))._jdf.queryExecution().analyzed().toString()


def test_ingest_cuts_chunks_once_and_shuffles_no_text_for_ids(spark, sf):
    plan = registry.QUERIES["ingest_full"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "AKIA" not in plan and "max_by" not in plan  # patterns and texts stay below the written chunks
    items = spark.createDataFrame([(1, "s", "x", "w", "a"), (3, "s", "x", "w", "c"), (2, "s", "x", "w", "b"), (4, "t", None, "w", "d")], "seq long, source string, source_id string, workspace string, text string")
    items = items.withColumns({"allowed_principals": F.array(F.lit("g")), "occurred_at": F.current_timestamp()})
    state = spark.createDataFrame([("s", "x", "w", 77)], "source string, source_id string, workspace string, event_id long")
    for known in (None, state):
        want = ingest.latest_events(items, known).select("source", "source_id", "event_id", "seq").collect()
        got = ingest.event_ids(items, known).select("source", "source_id", "event_id", "last_seq").collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, (tuple(r) for r in want)))


def test_a_worker_embeds_few_texts_at_a_time(spark, sf, monkeypatch):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        registry.QUERIES["local_embed"](spark, sf)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= sc.EMBED_ROWS
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    monkeypatch.setattr(sc, "KNOWN_TOKENS", 2)  # what is remembered changes no vector
    texts = [pd.Series(["a b c d", None]), pd.Series(["a b c d", "d"])]
    one, two = sc._embed_batches(iter(texts))
    assert (one[0] == two[0]).all() and one[1].sum() == 0 and two[1].max() == 1
