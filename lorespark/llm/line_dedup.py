r"""Removal of lines that many documents share, returned as compressed keep bitmaps instead of texts.

Each line becomes a row of two 64-bit hashes of its key, the document and the position. The rows are dealt by range over
all of these columns and sorted by them, so a line that a third of all rows share spreads over many tasks in order. Each
task streams its rows and decides every run of equal hashes that lies inside it. The first and the last run may go on in
a neighbour, so of those it gives a summary; there are two a task at most, and the sums of these decide the rest.

A key is the line without [\x20\x09-\x0D] at both ends and with A-Z lower-cased; empty keys are never dropped. A document
is a doc_id: repeated rows of one count once, and null is one document. Null and empty texts have one empty line. Rows
of one doc_id with other texts keep their own bitmaps. Other columns pass through apply_bitmaps unchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lorespark.llm import common

STRIPPED = " \t\n\x0b\f\r"
#: What the run of a hash gives: rows to drop, rows to decide later, the summary of a run at a task's edge.
DROP, OPEN, EDGE = 0, 1, 2
_RUNS = "kind int, h1 long, h2 long, doc long, version long, pos int, first boolean, part int, docs long, last_doc long"


def _version(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """h1, h2, doc, version, pos of each line whose key has min_chars code points."""
    lines = docs.select(F.col("doc_id").alias("doc"), _version(F.col("text")).alias("version"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "version", "pos", common.ascii_lower(F.btrim("line", F.lit(STRIPPED))).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.col("doc").cast("long"), "version", "pos")


def _stream(min_docs: int, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only(__name__)
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        opened = False  # whether this task's first run has ended
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            h1, h2 = (held[-1].column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            first = held[0]
            if h1[-1] == first.column(0)[0].as_py() and h2[-1] == first.column(1)[0].as_py():
                continue  # one run so far
            table = pa.Table.from_batches(held).combine_chunks()
            h1, h2 = (table.column(i).to_numpy() for i in (0, 1))
            open_from = len(h1) - int(np.argmax(((h1 != h1[-1]) | (h2 != h2[-1]))[::-1]))
            yield from _decide(table.slice(0, open_from), part, not opened, False, min_docs, keep_first)
            opened = True
            held = table.slice(open_from).combine_chunks().to_batches()
        if held:
            yield from _decide(pa.Table.from_batches(held).combine_chunks(), part, not opened, True, min_docs, keep_first)

    return run


def _decide(table: pa.Table, part: int, at_start: bool, at_end: bool, min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Drop rows of whole runs, and open rows and summaries of the runs at a task's edges. The rows are sorted."""
    n = table.num_rows
    h1, h2 = (table.column(i).to_numpy() for i in (0, 1))
    doc_null = table.column(2).is_null().to_numpy()
    doc = table.column(2).fill_null(0).to_numpy()
    new_run = np.ones(n, bool)
    new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    new_doc = new_run.copy()
    new_doc[1:] |= (doc[1:] != doc[:-1]) | (doc_null[1:] != doc_null[:-1])
    starts = np.flatnonzero(new_run)
    docs = np.add.reduceat(new_doc.astype(np.int64), starts)
    ends = np.append(starts[1:], n)
    edge = np.zeros(len(starts), bool)
    edge[0] |= at_start
    edge[-1] |= at_end
    run_of = np.cumsum(new_run) - 1
    drop = (~edge & (docs >= min_docs))[run_of] & ~(new_run & keep_first)
    opened = edge[run_of]
    rows = np.flatnonzero(drop | opened)
    of = np.flatnonzero(edge)
    k = len(of)
    take = pa.array(np.concatenate([rows, starts[of]]))
    last = table.column(2).take(pa.array(ends[of] - 1)).combine_chunks()
    kinds = np.concatenate([np.where(opened[rows], OPEN, DROP), np.full(k, EDGE)]).astype(np.int32)
    columns = [pa.array(kinds), *(table.column(i).take(take).combine_chunks() for i in range(5)), pa.array(np.concatenate([new_run[rows], np.zeros(k, bool)])), pa.array(np.full(len(kinds), part, np.int32)), pa.array(np.concatenate([np.zeros(len(rows), np.int64), docs[of]])), pa.concat_arrays([pa.nulls(len(rows), pa.int64()), last])]
    yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns], names=["kind", "h1", "h2", "doc", "version", "pos", "first", "part", "docs", "last_doc"])


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc, version, pos of each line to drop. keep_first: the first occurrence by doc_id and position stays."""
    common.short_batches(docs.sparkSession)
    keys = common.materialize(line_keys(docs, min_chars), "line-keys")
    order = ["h1", "h2", "doc", "version", "pos"]
    runs = common.materialize(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs, keep_first), _RUNS), "line-runs")
    in_order = Window.partitionBy("h1", "h2").orderBy("part")
    edges = runs.where(F.col("kind") == EDGE).withColumn("before", F.lag("last_doc").over(in_order)).withColumn("at", F.row_number().over(in_order))
    shared = (F.col("at") > 1) & F.col("before").eqNullSafe(F.col("doc"))  # one document on both sides of an edge
    sums = edges.groupBy("h1", "h2").agg((F.sum("docs") - F.sum(shared.cast("long"))).alias("total"), F.min("part").alias("first_part")).where(F.col("total") >= min_docs)
    # Two rows a task at most: the bound on what is broadcast is the number of partitions.
    later = runs.where(F.col("kind") == OPEN).join(F.broadcast(sums), ["h1", "h2"])
    if keep_first:
        later = later.where(~(F.col("first") & (F.col("part") == F.col("first_part"))))
    return runs.where(F.col("kind") == DROP).select("doc", "version", "pos").union(later.select("doc", "version", "pos"))


def pack(positions: list[int]) -> bytes:
    """The keep bitmap of a document: bit p is 0 where line p is dropped; lines past its end are kept."""
    bits = np.ones(-(-(max(positions) + 1) // 8) * 8, np.uint8)
    bits[positions] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def kept_lines(text: str, bitmap: bytes) -> tuple[str, int]:
    """The text without its dropped lines, and how many they are."""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[: len(lines)]
    gone = set(np.flatnonzero(bits == 0).tolist())
    return "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc, version, keep_bitmap of each document that loses a line; the others keep all."""
    per_doc = dropped_lines(docs, min_docs, min_chars, keep_first).groupBy("doc", "version").agg(F.collect_set("pos").alias("gone"))

    def run(doc: list, version: list, gone: list) -> dict:
        return {"doc": doc, "version": version, "keep_bitmap": [pack(x) for x in gone]}

    return common.map_text(per_doc, run, "doc long, version long, keep_bitmap binary", "doc", "version", "gone")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, carry: list[str]) -> DataFrame:
    """rest (a struct of the carried columns), kept text, n_lines before and n_dropped of each row of docs."""
    b = bitmaps.select(F.col("doc").alias("_doc"), F.col("version").alias("_v"), "keep_bitmap")
    sized = docs.select(F.struct(*(docs[c] for c in carry)).alias("rest"), docs["text"], docs["doc_id"].alias("_id"), _version(docs["text"]).alias("_version"))
    joined = sized.join(b, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_version") == F.col("_v")), "left").select("rest", "text", "keep_bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only(__name__)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            kept = [(x, 0) if m is None else kept_lines(x, m) for x, m in zip(texts, batch.column(2).to_pylist())]
            columns = [batch.column(0), pa.array([x for x, _ in kept], pa.string()), pa.array([x.count("\n") + 1 for x in texts], pa.int64()), pa.array([n for _, n in kept], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["rest", "text", "n_lines", "n_dropped"])

    common.short_batches(docs.sparkSession)
    long = T.LongType()
    return joined.mapInArrow(run, T.StructType([joined.schema["rest"], T.StructField("text", T.StringType()), T.StructField("n_lines", long), T.StructField("n_dropped", long)]))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, kept text, n_lines, n_dropped of each row."""
    done = apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars, keep_first), ["doc_id"])
    return done.select("rest.doc_id", "text", "n_lines", "n_dropped")


def without_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with the kept text for the text, n_chars counted anew where there is such a column, and its other columns."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    done = apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars), others)
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return done.select(*(made.get(c, F.col("rest")[c].alias(c)) for c in docs.columns))
