"""Hybrid search: a vector arm, a full-text arm and a memory arm, each filtered by access first, fused by rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions import fulltext as ft
from lorespark.functions import scoring as sc
from lorespark.operators import federated
from lorespark.operators.access import clamp_k

RRF_K = 60
EXPANSIONS = 3


def arm_k(k: int) -> int:
    """How many hits an arm gives for k results."""
    return max(2 * k, 20)


def vector_arm(visible: DataFrame, query: list[float], k: int, id_col: str = "content_hash", vector: str = "embedding") -> DataFrame:
    """id and distance of the k nearest by cosine distance; ties by id. Exact; the limit is a top-k over partitions."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = visible.select(F.col(id_col).cast("string").alias("id"), (1.0 - sc.cosine(F.col(vector), q)).alias("distance"))
    return scored.withColumn("order_by", F.round("distance", 9)).orderBy("order_by", "id").limit(k).drop("order_by")


def fulltext_arm(visible: DataFrame, query: str, k: int, id_col: str = "content_hash", text: str = "text", also: list[str] | None = None) -> DataFrame:
    """id and rank of the k best texts that hold any expansion, or every lexeme of the query; ties by id."""
    sets = [ft.query_lexemes(query)] + [ft.query_lexemes(x) for x in also or []]
    words = sorted({w for s in sets for w in s})
    lex = visible.select(F.col(id_col).cast("string").alias("id"), ft.lexemes(F.col(text)).alias("lex"))
    hit = reduce(lambda a, b: a | b, (ft.matches(F.col("lex"), s) for s in sets))
    return lex.where(hit).select("id", ft.rank(F.col("lex"), words).alias("rank")).orderBy(F.desc(F.round("rank", 9)), "id").limit(k)


def memory_arm(live: DataFrame, query: str, k: int, as_of: Column, also: list[str] | None = None) -> DataFrame:
    """id ('mem:' and the number), rank and effective confidence of the k best live rows; ties by confidence, then id."""
    sets = [ft.query_lexemes(query)] + [ft.query_lexemes(x) for x in also or []]
    words = sorted({w for s in sets for w in s})
    eff = sc.effective_confidence(F.col("confidence"), F.col("tier"), F.col("last_referenced_at"), as_of)
    lex = live.select(F.concat(F.lit("mem:"), F.col("id").cast("string")).alias("id"), ft.lexemes(F.col("content")).alias("lex"), eff.alias("effective_confidence"))
    hit = reduce(lambda a, b: a | b, (ft.matches(F.col("lex"), s) for s in sets))
    return lex.where(hit).select("id", ft.rank(F.col("lex"), words).alias("rank"), "effective_confidence").orderBy(F.desc(F.round("rank", 9)), F.desc(F.round("effective_confidence", 9)), "id").limit(k)


def ranked(arm: DataFrame, name: str, *order: Column) -> DataFrame:
    """arm's at most arm_k rows with their place from 0."""
    return arm.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("arm", F.lit(name))


def rrf(arms: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """id, score, arms: the sum over arms of weight / (k + place + 1); rows are id, place, arm and an optional weight."""
    rows = reduce(DataFrame.unionByName, (a.select("id", "place", "arm", (F.col("weight") if "weight" in a.columns else F.lit(1.0)).alias("weight")) for a in arms))
    return rows.groupBy("id").agg(F.sum(F.col("weight") / (F.lit(float(k)) + F.col("place") + 1)).alias("score"), F.array_sort(F.collect_set("arm")).alias("arms"))


def search(chunks: DataFrame, embeddings: DataFrame, live_memory: DataFrame, query: str, query_vector: list[float], as_of: Column, k: int = 10, expansions: list[str] | None = None) -> DataFrame:
    """The k best hits over three tables that hold only what the caller may see: chunks (content_hash, text),
    embeddings (content_hash, embedding), live memory rows. Reading changes nothing; reinforcing is a step of its own."""
    n, also = arm_k(clamp_k(k)), (expansions or [])[:EXPANSIONS]
    v = ranked(vector_arm(embeddings, query_vector, n), "vector", F.round("distance", 9), F.col("id"))
    f = ranked(fulltext_arm(chunks, query, n, also=also), "fulltext", F.desc(F.round("rank", 9)), F.col("id"))
    m = ranked(memory_arm(live_memory, query, n, as_of, also), "memory", F.desc(F.round("rank", 9)), F.desc(F.round("effective_confidence", 9)), F.col("id")).withColumn("weight", F.col("effective_confidence"))
    return rrf([v, f, m]).orderBy(F.desc(F.round("score", 9)), "id").limit(clamp_k(k))


def search_expanded(live: DataFrame, asked: DataFrame, synonym: DataFrame | federated.Classes, as_of: Column, k: int = 10) -> DataFrame:
    """The memory arm for one query (query_id, query), widened by the first EXPANSIONS terms that federated.expand gives.

    A query's text and at most EXPANSIONS terms come to the driver: they become literals of the plan.
    """
    query = asked.first()
    if query is None:
        return memory_arm(live, "", k, as_of)
    terms = sorted(r["term"] for r in federated.expand(asked, synonym, EXPANSIONS).collect())
    return memory_arm(live, query["query"], k, as_of, terms)


def references(hits: DataFrame, at: Column) -> DataFrame:
    """id, ts of the memory rows among hits: what reading them adds to the log of references."""
    return hits.where(F.col("id").startswith("mem:")).select(F.substring("id", 5, 20).cast("long").alias("id"), at.cast("timestamp").alias("ts"))


def hydrate(hits: DataFrame, chunks: DataFrame, memory: DataFrame) -> DataFrame:
    """hits (MAX_K rows at most, so broadcast) with their texts."""
    texts = chunks.select(F.col("content_hash").alias("id"), "text").unionByName(memory.select(F.concat(F.lit("mem:"), F.col("id").cast("string")).alias("id"), F.col("content").alias("text")))
    return texts.join(F.broadcast(hits), "id")
