"""Authority of writers from roles and policies, and the conflicts that ties leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions import scoring as sc

DEFAULT = "default"


def with_authority(rows: DataFrame, role: DataFrame, policy: DataFrame, writer_role: DataFrame) -> DataFrame:
    """rows (workspace, source_type, source_id, entity_kind) with authority and governed.

    The writer's role: assigned here, assigned by default, named as the writer here, named so by default. Its authority:
    the greatest policy for the kind or for any, here or by default; without one the role's own; without a role the
    flat authority of the source type, which isn't governed. The catalogue's tables are small; Spark broadcasts them as
    far as its threshold allows.
    """
    writer = ["source_type", "source_id"]
    named = role.select("workspace", "source_type", F.col("name").alias("source_id"), F.col("id").alias("role_id"))
    out = rows
    for n, table in enumerate((writer_role, writer_role.where(F.col("workspace") == DEFAULT), named, named.where(F.col("workspace") == DEFAULT))):
        if n % 2:
            out = out.join(table.select(*writer, F.col("role_id").alias(f"_r{n}")), writer, "left")
        else:
            out = out.join(table.select("workspace", *writer, F.col("role_id").alias(f"_r{n}")), ["workspace", *writer], "left")
    out = out.withColumn("_role", F.coalesce(*(f"_r{n}" for n in range(4)))).drop(*(f"_r{n}" for n in range(4)))
    # A role's policies unfold to (workspace, kind) pairs that rows can meet by equality, one step of fallback a join.
    best = policy.groupBy("role_id", "workspace", "entity_kind").agg(F.max("authority").alias("a"))
    steps = [("workspace", "entity_kind"), ("workspace", None), (None, "entity_kind"), (None, None)]
    for n, (ws, kind) in enumerate(steps):
        table = best if ws else best.where(F.col("workspace") == DEFAULT)
        table = table if kind else table.where(F.col("entity_kind") == "*")
        keys = [c for c in (ws, kind) if c]
        table = table.select(F.col("role_id").alias("_role"), *keys, F.col("a").alias(f"_a{n}"))
        out = out.join(table, ["_role", *keys], "left")
    out = out.withColumn("_policy", F.greatest(*(f"_a{n}" for n in range(4)))).drop(*(f"_a{n}" for n in range(4)))
    out = out.join(role.select(F.col("id").alias("_role"), F.col("base_authority").alias("_base")), "_role", "left")
    flat = sc.choose(F.col("source_type"), sc.FLAT_AUTHORITY, 0.0)
    governed = F.col("_policy").isNotNull() | F.col("_base").isNotNull()
    return out.withColumns({"authority": F.coalesce(F.col("_policy").cast("double"), F.col("_base").cast("double"), flat), "governed": governed}).drop("_role", "_policy", "_base")


def record_conflicts(found: DataFrame, ledger: DataFrame | None = None, detected_at: Column | None = None) -> DataFrame:
    """Pending rows for pairs, smaller id first, that the ledger doesn't hold as pending, with when they were detected."""
    pairs = found.select("workspace", "entity_key", F.least("row_a", "row_b").alias("row_a"), F.greatest("row_a", "row_b").alias("row_b"), F.when(F.col("row_a") < F.col("row_b"), F.col("authority_a")).otherwise(F.col("authority_b")).alias("authority_a"), F.when(F.col("row_a") < F.col("row_b"), F.col("authority_b")).otherwise(F.col("authority_a")).alias("authority_b")).dropDuplicates(["workspace", "row_a", "row_b"])
    if ledger is not None:
        pairs = pairs.join(ledger.where(F.col("status") == "pending"), ["workspace", "row_a", "row_b"], "left_anti")
    at = F.lit(None).cast("timestamp") if detected_at is None else detected_at
    return pairs.withColumns({"status": F.lit("pending"), "detected_at": at})


def pending(ledger: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Conflicts that no resolution (workspace, row_a, row_b, winner_id) has closed, the newest first, then by id."""
    open_ = ledger.where(F.col("status") == "pending")
    left = open_ if resolutions is None else open_.join(resolutions, ["workspace", "row_a", "row_b"], "left_anti")
    return left.orderBy(F.desc_nulls_last("detected_at"), F.desc("row_b"), F.desc("row_a"))


def resolve(folded: DataFrame, resolutions: DataFrame) -> DataFrame:
    """folded with the losers of resolved conflicts superseded by their winners, where nothing superseded them before."""
    lost = resolutions.select(F.when(F.col("winner_id") == F.col("row_a"), F.col("row_b")).otherwise(F.col("row_a")).alias("id"), F.col("winner_id").alias("_winner")).groupBy("id").agg(F.min("_winner").alias("_winner"))
    return folded.join(lost, "id", "left").withColumn("superseded_by", F.coalesce("superseded_by", "_winner")).drop("_winner")


def upsert(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """state with rows in the place of those with the same keys: roles, policies, assignments."""
    return state.join(rows, keys, "left_anti").select(*state.columns).unionByName(rows.select(*state.columns))


def policies(policy: DataFrame, role: DataFrame) -> DataFrame:
    """Every policy with the role's name, for listing."""
    named = role.select(F.col("id").alias("role_id"), F.col("name").alias("role"), "source_type")
    return policy.join(named, "role_id").select("workspace", "entity_kind", "role", "source_type", "authority")


def default_policies(spark) -> tuple[DataFrame, DataFrame]:
    """role and policy rows that spell out the flat authorities for every workspace. Seeding them twice adds nothing."""
    names = ",".join(f"({n}L,'{DEFAULT}','{k}','{k}',{a}F)" for n, (k, a) in enumerate(sc.FLAT_AUTHORITY.items(), 1))
    rules = ",".join(f"('{DEFAULT}','{kind}',{n}L,{a}F)" for kind in ("*", "general") for n, a in enumerate(sc.FLAT_AUTHORITY.values(), 1))
    return spark.sql(f"SELECT * FROM VALUES {names} AS t(id,workspace,source_type,name,base_authority)"), spark.sql(f"SELECT * FROM VALUES {rules} AS t(workspace,entity_kind,role_id,authority)")
