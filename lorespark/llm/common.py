"""What the corpus operators share: tables in the shared folder, checked broadcasts, text classes, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.sources.tables import delete_tree, materialize, new_path, release, shared_dir  # noqa: F401

#: Rows in an Arrow batch: texts can be long, so batches are kept short.
ARROW_ROWS = 256
#: Most bytes a side may have to be broadcast; larger sides are shuffled.
BROADCAST_BYTES = 8 << 20

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bounds the memory of an Arrow batch; a smaller setting of the caller's stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


_memories: dict[str, dict] = {}


def memory(owner: str) -> dict:
    """A dictionary that a worker keeps for a module from task to task, until the worker serves another one."""
    return _memories.setdefault(owner, {})


def only(owner: str) -> None:
    """Empties what this worker keeps for modules other than owner: workers outlive a stage and would hold all of it."""
    for name, kept in _memories.items():
        if name != owner:
            kept.clear()


def checked_broadcast(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df, a materialized table, marked for broadcast if its counted rows fit BROADCAST_BYTES; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def map_text(df: DataFrame, fn: Callable[[list], dict], schema: str, *inputs: str) -> DataFrame:
    """Applies fn to lists of the input columns, batch by batch; fn gives the columns of schema as lists or Arrow arrays."""
    short_batches(df.sparkSession)
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(fn.__module__)
        for batch in batches:
            got = fn(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip((got[f.name] for f in target), target)], schema=target)

    return df.select(*inputs).mapInArrow(run, schema)


def blocks(batches: Iterator[pa.RecordBatch], text: int, size: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, of about `size` bytes in column text, and `most` rows at most, unless a batch has more."""
    held, rows, n = [], 0, 0

    def joined() -> pa.RecordBatch:
        nonlocal held, rows, n
        block, held, rows, n = pa.concat_batches(held), [], 0, 0
        pa.default_memory_pool().release_unused()  # a worker outlives its stage, and would keep it
        return block

    for batch in batches:
        if held and (n > size or rows + batch.num_rows > most):
            yield joined()
        held.append(batch)
        rows, n = rows + batch.num_rows, n + batch.column(text).nbytes
    if held:
        yield joined()
    pa.default_memory_pool().release_unused()


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
