r"""Benchmark passages in documents: a prefix-filtered set join, in built-in functions only.

A window is WINDOW consecutive words of an item (all of them in a shorter one). Its shingles of SHINGLE words are its
tokens. A document holds the window only if it holds all its tokens, so the prefix that has to be joined is one token:
the rarest, by counts over all documents. A window with a token that no document has is dropped at once. Each place
where a document has a window's prefix token gives one start; the length bound asks the window to fit, the positional
bound fixes where it begins, and the words there are compared one by one.

Only the shingles of the benchmark leave the scan of the documents, and only documents with a candidate are read again.
The benchmark's tokens are broadcast if their counted rows fit, else they are joined by shuffling.

Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z is lower-cased. Null and empty texts have no words, and items without
words or without an id are left out. Rows of one doc_id with other texts are judged each; repeated rows get the same
result. Items that repeat an id count once. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm import common

WINDOW, SHINGLE = 10, 3
_WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(common.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(1))


def _shingles(of: Column, k: int) -> Column:
    """Hashes of the runs of k words, by start."""
    some = F.transform(F.sequence(F.lit(0), F.greatest(F.size(of) - k, F.lit(0))), lambda i: F.xxhash64(F.lit(k), *(F.get(of, i + j) for j in range(k))))
    return F.when(F.size(of) >= k, some).otherwise(F.expr("cast(array() as array<bigint>)"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id as a string and each of its windows, as words joined by spaces, with the number of words."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("s"))
    cut = starts.select("item_id", F.slice("w", F.col("s") + 1, F.lit(window)).alias("w"))
    return cut.select("item_id", F.array_join("w", " ").alias("window"), F.size("w").alias("size")).distinct()


def _version(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), doc_id.isNull())


def _versioned(docs: DataFrame) -> DataFrame:
    """doc and version tell rows apart: the id, 0 for a null one, and a hash of the text and of whether the id is null."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(0)).alias("doc"), _version(F.col("doc_id"), F.col("text")).alias("version"), "text")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs: doc_id, version (a hash of its text), n_words, n_hit, item_ids (sorted strings)."""
    by_item = common.materialize(item_windows(benchmark, window), "bench-windows")
    distinct = by_item.select("window", "size").distinct()
    k_of = F.least("size", F.lit(shingle))
    sizes = sorted(r[0] for r in distinct.select(k_of.alias("k")).distinct().collect())  # at most `shingle` numbers
    tokens = [distinct.where(k_of == k).select("window", "size", F.posexplode(_shingles(F.split("window", " "), k)).alias("offset", "token")) for k in sizes]
    tokens = common.materialize(reduce(DataFrame.unionByName, tokens) if tokens else distinct.select("window", "size", F.lit(0).alias("offset"), F.lit(0).cast("long").alias("token")), "bench-tokens")
    wanted = common.checked_broadcast(common.materialize(tokens.select("token").distinct().withColumn("known", F.lit(True)), "bench-token-set"))

    split = _versioned(docs).select("doc_id", "doc", "version", words(F.col("text")).alias("w"))
    parts = []
    for n, k in enumerate(sizes or [shingle]):
        # Element 0 of the first part stands for the document itself, so that its number of words comes from the same scan.
        head = F.array(F.lit(0).cast("long")) if n == 0 else F.expr("cast(array() as array<bigint>)")
        parts.append(split.select("doc_id", "doc", "version", F.size("w").alias("n_words"), F.posexplode(F.concat(head, _shingles(F.col("w"), k))).alias("at", "token")).withColumn("at", F.col("at") - (1 if n == 0 else 0)))
    found = reduce(DataFrame.unionByName, parts).join(wanted, "token", "left").where(F.col("known") | (F.col("at") < 0))
    found = common.materialize(found.select("doc_id", "doc", "version", "n_words", "at", F.when(F.col("at") >= 0, F.col("token")).alias("token")), "bench-hits")

    counts = found.where(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest")
    prefixes = tokens.join(counts, "token", "left").groupBy("window", "size").agg(rarest).where(F.col("rarest.n") > 0)
    prefixes = common.checked_broadcast(common.materialize(prefixes.select(F.col("rarest.token").alias("token"), F.col("rarest.offset").alias("offset"), "window", "size"), "bench-prefixes"), 256)
    placed = found.join(prefixes, "token").withColumn("start", F.col("at") - F.col("offset")).where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    candidates = common.materialize(placed.groupBy("doc", "version").agg(F.collect_set(F.struct("start", "size", "window")).alias("places")), "bench-candidates")

    again = _versioned(docs).join(common.checked_broadcast(candidates.select("doc", "version")), ["doc", "version"], "left_semi").dropDuplicates(["doc", "version"])
    same = candidates.join(again, ["doc", "version"])
    # The words are bound once for each document: a plain expression in the lambda would split the text for every place.
    exact = common.let(words(F.col("text")), lambda w: F.filter("places", lambda p: F.array_join(F.slice(w, p["start"] + 1, p["size"]), " ") == p["window"]))
    verified = common.materialize(same.select("doc", "version", exact.alias("places")), "bench-verified").where(F.size("places") > 0)
    hit = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["size"] - 1)))))
    held = verified.select("doc", "version", F.explode(F.array_distinct(F.transform("places", lambda p: p["window"]))).alias("window"))
    items = held.join(common.checked_broadcast(by_item.select("window", "item_id"), 256), "window").groupBy("doc", "version").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    judged = verified.select("doc", "version", hit.alias("n_hit")).join(items, ["doc", "version"])
    none = F.expr("cast(array() as array<string>)")
    every = found.where(F.col("token").isNull()).select("doc_id", "doc", "version", F.col("n_words").cast("long").alias("n_words"))
    return every.join(judged, ["doc", "version"], "left").select("doc_id", "version", "n_words", F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))


def summary(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """docs without the rows that hold a window of the benchmark."""
    bad = contamination(docs, benchmark, window, shingle).where(F.col("n_hit") > 0).select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_doc"]) & (_version(docs["doc_id"], docs["text"]) == bad["_version"]), "left_anti")
