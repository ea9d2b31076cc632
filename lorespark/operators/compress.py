"""Extractive summaries of working memory, all entities in one plan: central sentences with their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions import text as tx
from lorespark.operators.memory import ENTITY

MIN_ROWS, MOST = 3, 5


def eligible(rows: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Entities with min_rows working rows that no summary holds yet."""
    working = rows.where(F.col("tier") == "working")
    if "compressed_into" in rows.columns:
        working = working.where(F.col("compressed_into").isNull())
    return working.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= min_rows)


def sentence_rows(rows: DataFrame) -> DataFrame:
    """workspace, entity_key, idx (over the rows of an entity in order of id), source_row_id, sentence."""
    cut = rows.select(*ENTITY, F.col("id").alias("source_row_id"), F.posexplode(tx.sentences(F.col("content"))).alias("pos", "sentence"))
    order = Window.partitionBy(*ENTITY).orderBy("source_row_id", "pos")
    return cut.withColumn("idx", F.row_number().over(order) - 1).drop("pos")


def centrality(sentences: DataFrame) -> DataFrame:
    """sentences with score: the sum over the entity's other sentences of shared words / words of the larger.

    Sentences meet through the words they share, an inverted index: pairs without a common word never arise.
    """
    sets = sentences.withColumn("words", tx.word_set(F.col("sentence")))
    posting = sets.select(*ENTITY, "idx", F.size("words").alias("n"), F.explode("words").alias("word"))
    other = posting.select(*ENTITY, "word", F.col("idx").alias("j"), F.col("n").alias("m"))
    pairs = posting.join(other, [*ENTITY, "word"]).where(F.col("idx") != F.col("j")).groupBy(*ENTITY, "idx", "j", "n", "m").agg(F.count(F.lit(1)).alias("shared"))
    score = pairs.groupBy(*ENTITY, "idx").agg(F.sum(F.col("shared") / F.greatest("n", "m")).alias("score"))
    return sentences.join(score, [*ENTITY, "idx"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))


def top_sentences(scored: DataFrame) -> DataFrame:
    """The min(5, ceil(n / 4)) best sentences of each entity; equal scores by place."""
    of = Window.partitionBy(*ENTITY)
    best = of.orderBy(F.desc("score"), "idx")
    return scored.withColumns({"rn": F.row_number().over(best), "total": F.count(F.lit(1)).over(of)}).where(F.col("rn") <= F.least(F.lit(MOST), F.greatest(F.lit(1), F.ceil(F.col("total") * 0.25)))).drop("rn", "total")


def intersect_acls(rows: DataFrame, by: list[str], column: str = "allowed_principals") -> DataFrame:
    """The principals that all rows of a group allow; if none, those of the smallest set, the first by id; sorted."""
    both = F.aggregate("_sets", F.element_at("_sets", 1), lambda acc, x: F.array_intersect(acc, x))
    size = F.size(F.array_distinct(column))
    sets = rows.groupBy(*by).agg(F.collect_set(F.array_sort(F.array_distinct(column))).alias("_sets"), F.min_by(F.array_distinct(column), F.struct(size, "id")).alias("_smallest"))
    common = sets.withColumn("_common", both)
    return common.select(*by, F.array_sort(F.when(F.size("_common") > 0, F.col("_common")).otherwise(F.col("_smallest"))).alias(column))


def lineage(picked: DataFrame) -> DataFrame:
    """sentence_index in the summary, sentence and source_row_id of each picked sentence."""
    order = Window.partitionBy(*ENTITY).orderBy("idx")
    return picked.select(*ENTITY, (F.row_number().over(order) - 1).alias("sentence_index"), "sentence", "source_row_id")


def compress(rows: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """A summary of each eligible entity: content, confidence, access, how many rows and sentences, compression ratio."""
    working = rows.where(F.col("tier") == "working").join(eligible(rows, min_rows).select(*ENTITY), ENTITY, "left_semi")
    sentences = sentence_rows(working)
    picked = top_sentences(centrality(sentences))
    summary = picked.groupBy(*ENTITY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sentence"))), lambda x: x["sentence"]), " ").alias("content"), F.count(F.lit(1)).alias("n_sentences"))
    facts = working.groupBy(*ENTITY).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(F.col("confidence").cast("double")))).alias("confidence"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("content")).alias("chars_in"))
    acl = intersect_acls(working, ENTITY)
    ratio = F.when(F.col("chars_in") == 0, F.lit(1.0)).otherwise(F.length("content") / F.col("chars_in"))
    return summary.join(facts, ENTITY).join(acl, ENTITY).withColumn("ratio", ratio).drop("chars_in")


def invalidated(summaries: DataFrame, lineage_rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Summaries (id) that hold a sentence of a changed source row (id): to be made anew."""
    touched = lineage_rows.join(changed.select(F.col("id").alias("source_row_id")), "source_row_id", "left_semi")
    return summaries.join(touched.select(F.col("summary_id").alias("id")), "id", "left_semi")
