"""Reports over the model, each filtered by what the caller may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.operators import federated


def workspaces(*tables: DataFrame) -> DataFrame:
    """Every workspace that any of the tables names."""
    out = tables[0].select("workspace")
    for t in tables[1:]:
        out = out.union(t.select("workspace"))
    return out.distinct()


def pipeline_stats(events: DataFrame, seen_acl: DataFrame, chunks: DataFrame, seen_memory: DataFrame) -> DataFrame:
    """metric, value: events, visible chunks, distinct contents, contents embedded, visible memory, events of each source."""
    one = lambda name, df, agg: df.agg(agg.alias("value")).select(F.lit(name).alias("metric"), "value")
    n = F.count(F.lit(1))
    parts = [one("raw_events", events, n), one("chunks_in_workspace", seen_acl, n), one("unique_content_hashes", seen_acl, F.countDistinct("content_hash")), one("embeddings", chunks, n), one("memory_rows", seen_memory, n), events.groupBy("source").agg(n.alias("value")).select(F.concat(F.lit("source:"), "source").alias("metric"), "value")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def governance_conflicts(pending: DataFrame, seen: DataFrame) -> DataFrame:
    """Pending conflicts with both contents, of rows the caller sees."""
    text = lambda c, n: seen.select(F.col("id").alias(c), F.col("content").alias(n))
    return pending.join(text("row_a", "content_a"), "row_a").join(text("row_b", "content_b"), "row_b")


def recent_redactions(redactions: DataFrame, n: int = 50) -> DataFrame:
    return redactions.orderBy(F.desc("occurred_at"), "source_id", "kind").limit(n)


def redactions_since(redactions: DataFrame, since: Column) -> DataFrame:
    """Totals by kind, source, source_id and workspace of what was redacted since then, the most first."""
    totals = redactions.where(F.col("occurred_at") >= since).groupBy("kind", "source", "source_id", "workspace").agg(F.sum("count").alias("total"))
    return totals.orderBy(F.desc("total"), "kind", "source", "source_id", "workspace")


def concepts_view(concept: DataFrame, tenant: DataFrame, synonym: DataFrame | federated.Classes, workspace: str, n: int = 30) -> DataFrame:
    """part, name, other, count, weight: the n first concepts of all tenants, of the workspace itself, and synonyms."""
    row = lambda part, name, other, count, weight: (F.lit(part).alias("part"), name.alias("name"), other.alias("other"), count.cast("long").alias("count"), weight.cast("double").alias("weight"))
    none = F.lit(None).cast("string")
    top = concept.orderBy(F.desc("tenant_count"), F.desc("global_count"), "name").limit(n).select(*row("global", F.col("name"), none, F.col("tenant_count"), F.col("global_count")))
    own = tenant.where(F.col("workspace") == workspace).join(concept.select("name"), "name", "left_semi").orderBy(F.desc("local_count"), "name").limit(n).select(*row("local", F.col("name"), none, F.col("local_count"), F.lit(None)))
    if isinstance(synonym, federated.Classes):
        best = federated.first_synonyms(synonym, n)
    else:
        best = synonym.orderBy(F.desc(F.round("confidence", 9)), F.desc("cooccurrence_tenants"), "concept_a", "concept_b").limit(n)
    syn = best.select(*row("synonym", F.col("concept_a"), F.col("concept_b"), F.col("cooccurrence_tenants"), F.round("confidence", 6)))
    return top.unionByName(own).unionByName(syn)


def compression_view(summaries: DataFrame, lineage: DataFrame, sources: DataFrame) -> DataFrame:
    """workspace, entity_key, sentence_index, sentence, source_row_id, source_content of the summaries that the caller sees.

    summaries and sources hold only rows that the caller sees; a sentence whose source is hidden has a null content.
    """
    text = sources.select(F.col("id").alias("source_row_id"), F.col("content").alias("source_content"))
    return lineage.join(summaries.select("workspace", "entity_key"), ["workspace", "entity_key"], "left_semi").join(text, "source_row_id", "left").select("workspace", "entity_key", "sentence_index", "sentence", "source_row_id", "source_content")


def identity_detail(identities: DataFrame, seen: DataFrame, current: DataFrame) -> DataFrame:
    """Each identity with the number of memory rows of its entity that the caller sees, how many are live, and the one to read."""
    rows = seen.groupBy("workspace", "entity_key").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("superseded_by").isNull().cast("long")).alias("n_live"))
    best = current.select("workspace", "entity_key", F.col("id").alias("current_id"))
    out = identities.join(rows, ["workspace", "entity_key"], "left").join(best, ["workspace", "entity_key"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "n_live")})


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, for what serves results."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
