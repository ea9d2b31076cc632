"""The append-only memory log: which row is current, decay, recall, history, eviction, promotion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions import scoring as sc

TIE = 0.05
#: Rows whose ids agree above this many bits are one block of an entity.
BLOCK_BITS = 20
ENTITY = ["workspace", "entity_key"]


def validate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the model's rules, and the others."""
    good = F.col("source_type").isin(list(sc.FLAT_AUTHORITY)) & F.col("tier").isin(list(sc.TIERS)) & F.col("confidence").between(0, 1) & ~F.isnan("confidence") & (F.trim("entity_key") != "") & (F.trim("content") != "")
    flagged = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    return flagged.where("_good").drop("_good"), flagged.where("NOT _good").drop("_good")


def _rank(authority: Column) -> Column:
    """An authority or confidence to order by: null and NaN count as 0."""
    return F.coalesce(F.nanvl(authority.cast("double"), F.lit(0.0)), F.lit(0.0))


def fold_superseded(rows: DataFrame, authority: Column | None = None) -> DataFrame:
    """rows with superseded_by, as if written one after another by id.

    The greatest (authority, confidence, id) so far is current; a null or NaN counts as 0. A row that isn't the greatest
    when it is written is superseded by the one that is; a row that was is superseded by the next that takes its place.

    Greatest values combine, so an entity's rows are taken in blocks of neighbouring ids, each with what stood before it
    and what comes after it: an entity of any size spreads over tasks, and only one row a block meets in one place.
    """
    rank = sc.choose(F.col("source_type"), sc.FLAT_AUTHORITY, 0.0) if authority is None else authority
    keyed = rows.withColumn("_key", F.struct(_rank(rank).alias("a"), _rank(F.col("confidence").cast("float")).alias("c"), F.col("id").alias("i"))).withColumn("_block", F.shiftright(F.col("id").cast("long"), BLOCK_BITS))
    block, blocks = [*ENTITY, "_block"], Window.partitionBy(*ENTITY)
    tops = keyed.groupBy(*block).agg(F.max("_key").alias("_top"))
    tops = tops.withColumn("_before", F.max("_top").over(blocks.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    known = keyed.join(tops, block)
    # The first row of a block that beats all before it takes the place of the last that did.
    beats = F.col("_before").isNull() | (F.col("_key") > F.col("_before"))
    firsts = known.groupBy(*block).agg(F.min(F.when(beats, F.col("id"))).alias("_first"))
    firsts = firsts.withColumn("_after", F.last("_first", ignorenulls=True).over(blocks.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1))).drop("_first")
    within = Window.partitionBy(*block)
    so_far = known.withColumn("_best", F.greatest("_before", F.max("_key").over(within.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))))
    record = F.col("_best.i") == F.col("id")
    # Frames that only grow: the last record met from the other end is the next one.
    following = within.orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    marked = so_far.withColumn("_next", F.last(F.when(record, F.col("id")), ignorenulls=True).over(following)).join(firsts, block)
    return marked.withColumn("superseded_by", F.when(record, F.coalesce("_next", "_after")).otherwise(F.col("_best.i"))).drop("_key", "_block", "_before", "_best", "_next", "_after")


def fold_governed(rows: DataFrame) -> DataFrame:
    """The fold for rows that carry authority and governed: what each write supersedes, and the conflicts it meets.

    kind ('superseded' or 'conflict'), workspace, entity_key, id, other, authority_a, authority_b. Rows whose authority is
    within TIE of the winner's, one of the two governed, stay live beside it, and each such pair is a conflict. A null or
    NaN authority or confidence counts as 0, a null governed as false.

    Closeness isn't transitive, so rows are taken one by one: sorted within the partition of their entity and streamed.
    A row that doesn't win meets the winner alone; only a new winner meets the rows that are live, each once.
    """
    schema = "kind string, workspace string, entity_key string, id long, other long, authority_a double, authority_b double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, live, best = None, [], None
        for part in parts:
            out = []
            for ws, key, i, auth, conf, gov in zip(*(part[c].tolist() for c in part.columns)):
                if (ws, key) != entity:
                    entity, live, best = (ws, key), [], None
                new = (auth, conf, i, gov)
                if best is None:
                    live, best = [new], new
                    continue
                won = new[:3] > best[:3]
                top = new if won else best
                stay = [new] if won else []
                for r in live if won else (new,):
                    if abs(r[0] - top[0]) <= TIE and (r[3] or top[3]):
                        stay.append(r)
                        a, b = (top, r) if top[2] < r[2] else (r, top)
                        out.append(("conflict", ws, key, a[2], b[2], a[0], b[0]))
                    else:
                        out.append(("superseded", ws, key, r[2], top[2], None, None))
                live = stay if won else live + stay
                best = top
            yield pd.DataFrame(out, columns=["kind", "workspace", "entity_key", "id", "other", "authority_a", "authority_b"]).astype({"id": "int64", "other": "int64", "authority_a": "float64", "authority_b": "float64"})

    of = rows.select(*ENTITY, "id", _rank(F.col("authority")).alias("a"), _rank(F.col("confidence")).alias("c"), F.coalesce("governed", F.lit(False)).alias("g"))
    return of.repartition(*ENTITY).sortWithinPartitions(*ENTITY, "id").mapInPandas(run, schema)


def superseded(found: DataFrame) -> DataFrame:
    """id, superseded_by of what fold_governed found."""
    return found.where(F.col("kind") == "superseded").select("id", F.col("other").alias("superseded_by"))


def conflicts(found: DataFrame) -> DataFrame:
    """The pairs of live rows that fold_governed found, the smaller id first."""
    return found.where(F.col("kind") == "conflict").select(*ENTITY, F.col("id").alias("row_a"), F.col("other").alias("row_b"), "authority_a", "authority_b")


def remember(state: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Appends new rows and folds only the entities they touch.

    Gives the whole log with superseded_by, and for each accepted new row its id and whether it is current. Rows that break
    the model's rules aren't appended. state may have superseded_by; the rows of a touched entity are judged anew.
    """
    good = validate(new)[0]
    touched = good.select(*ENTITY).distinct()
    columns = [c for c in new.columns if c != "superseded_by"]
    folded = fold_superseded(state.join(touched, ENTITY, "left_semi").select(*columns).unionByName(good.select(*columns)))
    rest = state.join(touched, ENTITY, "left_anti")
    if "superseded_by" not in state.columns:
        rest = fold_superseded(rest)
    receipts = folded.join(good.select("id"), "id", "left_semi").select("id", F.col("superseded_by").isNull().alias("is_current"))
    return rest.select(*columns, "superseded_by").unionByName(folded.select(*columns, "superseded_by")), receipts


def reinforce(rows: DataFrame, references: DataFrame) -> DataFrame:
    """rows with the clock and the count of an append-only log of reads (id, ts)."""
    reads = references.groupBy("id").agg(F.max("ts").alias("_read"), F.count(F.lit(1)).alias("_reads"))
    joined = rows.join(reads, "id", "left")
    return joined.withColumns({"last_referenced_at": F.greatest(F.col("last_referenced_at"), F.coalesce("_read", "last_referenced_at")), "reference_count": (F.col("reference_count") + F.coalesce("_reads", F.lit(0))).cast("int")}).drop("_read", "_reads")


def effective(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.withColumn("effective_confidence", sc.effective_confidence(F.col("confidence"), F.col("tier"), F.col("last_referenced_at"), as_of))


def recall(folded: DataFrame, as_of: Column) -> DataFrame:
    """The row to read of each entity: live, by the flat rank of its source, then decayed confidence, then the newest."""
    live = effective(folded.where(F.col("superseded_by").isNull()), as_of)
    best = F.struct(sc.choose(F.col("source_type"), sc.FLAT_AUTHORITY, 0.0), "effective_confidence", "id")
    cols = ["id", "content", "source_type", "source_id", "confidence", "tier", "effective_confidence"]
    return live.groupBy(*ENTITY).agg(F.max_by(F.struct(*cols), best).alias("r")).select(*ENTITY, "r.*")


def recalled(folded: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that recall gives, and the references (id, ts) that reading them adds to the log."""
    best = recall(folded, as_of)
    return best, best.select("id", as_of.cast("timestamp").alias("ts"))


def history(folded: DataFrame) -> DataFrame:
    return folded.withColumn("is_current", F.col("superseded_by").isNull())


def stale(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.where(sc.is_stale(F.col("confidence"), F.col("tier"), F.col("last_referenced_at"), as_of))


def survivors(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.where(~sc.is_stale(F.col("confidence"), F.col("tier"), F.col("last_referenced_at"), as_of))


def eviction_counts(rows: DataFrame, as_of: Column) -> DataFrame:
    """Stale rows of each tier that can be evicted, 0 where there is none."""
    tiers = rows.sparkSession.sql("SELECT * FROM VALUES " + ",".join(f"('{t}')" for t in sc.STALE) + " AS t(tier)")
    found = stale(rows, as_of).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return tiers.join(F.broadcast(found), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def eviction_examples(rows: DataFrame, as_of: Column, n: int = 5) -> DataFrame:
    """The n longest unread of each tier's stale rows."""
    order = Window.partitionBy("tier").orderBy("last_referenced_at", "id")
    return stale(rows, as_of).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def promotable(rows: DataFrame, as_of: Column, min_age_days: int = 7, min_eff: float = 0.5, min_refs: int = 3) -> DataFrame:
    """Episodic rows old, sure and used enough to become semantic."""
    aged = sc.age_seconds(F.col("created_at"), as_of) >= min_age_days * 86400
    return effective(rows.where(F.col("tier") == "episodic"), as_of).where(aged & (F.col("effective_confidence") >= min_eff) & (F.col("reference_count") >= min_refs))


def promote_all(rows: DataFrame, summaries: DataFrame, as_of: Column, min_age_days: int = 7, min_eff: float = 0.5, min_refs: int = 3) -> DataFrame:
    """The log of tier changes of one pass: id, workspace, entity_key, from_tier, to_tier.

    Working rows whose entity has a summary go into it, as episodic memory; episodic rows that are promotable become
    semantic. A summary made in this pass isn't judged in it.
    """
    up = rows.where(F.col("tier") == "working").join(summaries.select(*ENTITY), ENTITY, "left_semi")
    step = lambda df, low, high: df.select("id", *ENTITY, F.lit(low).alias("from_tier"), F.lit(high).alias("to_tier"))
    return step(up, "working", "episodic").unionByName(step(promotable(rows, as_of, min_age_days, min_eff, min_refs), "episodic", "semantic"))


def after_tier_changes(rows: DataFrame, log: DataFrame) -> DataFrame:
    """rows with the tiers that the log gives; working rows that went into a summary keep theirs and are marked compressed."""
    moved = log.where(F.col("to_tier") == "semantic").select("id", F.col("to_tier").alias("_to"))
    gone = log.where(F.col("from_tier") == "working").select("id", F.lit(True).alias("_in"))
    out = rows.join(moved, "id", "left").join(gone, "id", "left")
    return out.withColumns({"tier": F.coalesce("_to", "tier"), "compressed": F.coalesce("_in", F.lit(False))}).drop("_to", "_in")


def entities(folded: DataFrame) -> DataFrame:
    """Of each entity: how many rows, and whether one is live."""
    return folded.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("n_rows"), F.bool_or(F.col("superseded_by").isNull()).alias("has_current"))


def dag_edges(folded: DataFrame, seen: DataFrame) -> DataFrame:
    """from_id -> to_id of supersession between rows that are both seen."""
    nodes = seen.select(F.col("id").alias("to_id"))
    return folded.join(seen.select("id"), "id", "left_semi").where(F.col("superseded_by").isNotNull()).select(F.col("id").alias("from_id"), F.col("superseded_by").alias("to_id")).join(nodes, "to_id", "left_semi").select("from_id", "to_id")
