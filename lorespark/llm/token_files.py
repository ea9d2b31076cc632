"""Token ids in raw binary shards in document order, and a minimal perfect hash index over them.

Shards hold bare little-endian ids (16 bits where the vocabulary allows, else 32), each document's ended by the end id,
in ascending order of doc_id within and across shards. A shard is a bucket of neighbouring doc_ids (ordered.py), so a
task that runs again writes the same file; it is written under another name and then renamed.

The index maps a key to shard, offset and number of ids. Keys are dealt into segments by hash; each segment has a
minimal perfect hash (levels of bits, each of which one key alone has set; rank gives the slot) and arrays by slot, with a fingerprint
that tells a foreign key. A lookup reads a few bits and one slot, whatever the number of keys.

Null and empty texts hold the end id alone. Rows that repeat a doc_id are stored one after another by text, and their
keys are (doc_id, occurrence from 0). A null doc_id comes first, stored as the lowest 64-bit number. Other columns are
ignored. Files are reached through pyarrow's file systems: file, hdfs, s3, gs, abfs.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.llm import common, ordered, presplit
from lorespark.llm.token_counts import REMEMBERED, library

SEGMENT_KEYS = 50_000
GAMMA, LEVELS = 2.0, 24
_U64 = (1 << 64) - 1


#: The longest unit that is remembered, how many are given to the library as one text, and bytes of text encoded at once.
UNIT_CHARS, JOINED, BLOCK_BYTES = 48, 128, 8 << 20
#: What stands for a space at the head of a byte-level token.
_SPACE_SYMBOL = chr(0x120)
_UNIT = re.compile(f"(?= [^\\s{chr(0x180E)}{chr(0x200B)}{chr(0xFEFF)}])")
_BLANK = re.compile(f"[\\s{chr(0x180E)}{chr(0x200B)}{chr(0xFEFF)}]|\\Z")


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x, pa.large_string())


def units(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct keys, the key of each unit of all texts, and how many units each text has.

    A key is what follows the unit's space; that of a text's first unit, which has none, begins with a space.
    """
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded, n = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    keys, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    first = np.cumsum(n) - n
    opening = pc.utf8_slice_codeunits(keys, 0, 1)
    blank = pa.array([x for x in pc.unique(opening).to_pylist() if _BLANK.match(x)], pa.large_string())
    odd = pc.is_in(opening, value_set=blank).to_numpy(zero_copy_only=False)[at]
    odd[first] = False
    heads = pc.binary_join_element_wise(_text(""), keys.take(pa.array(at[first])), _text(" ")).dictionary_encode()
    at[first] = len(keys) + heads.indices.to_numpy()
    keys = pa.concat_arrays([keys, heads.dictionary])
    if odd.any():  # spaces before white space begin no unit
        parts, more = np.split(at, first[1:]), []
        for k in np.unique(np.repeat(np.arange(len(n)), n)[odd]).tolist():
            head, *others = _UNIT.split(texts[k])
            n[k] = 1 + len(others)
            parts[k] = np.arange(n[k]) + len(keys) + len(more)
            more += [" " + head, *(x[1:] for x in others)]
        coded = pa.concat_arrays([keys, pa.array(more, pa.large_string())]).dictionary_encode()
        keys, at = coded.dictionary, coded.indices.to_numpy()[np.concatenate(parts)]
    used = np.bincount(at, minlength=len(keys)) > 0
    return keys.filter(pa.array(used)), (np.cumsum(used) - 1)[at], n


class UnitEncoder:
    """Ids by the library, remembering those of each unit of text.

    A unit begins at a space before a character that is no white space. In byte-level pre-splitting a piece begins at
    every such space: no alternative of the pattern takes a space but as its first character or in a run of white space,
    and a run of white space leaves its last space to what follows. So units are encoded one by one, and, since no piece but
    one at such a space yields a token that begins with a space, the ids of many joined units are cut apart again there.
    Units with white space inside may hold more such tokens; if the cuts are not as many as the units, each is encoded alone.
    """

    def __init__(self, path: str, dtype: str):
        self.tok, spec, self.dtype = library(path), presplit.layout(path), dtype
        self.plain, self.splitter = spec["family"] == "byte", spec["splitter"]
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.opens[[i for s, i in vocab.items() if s.startswith(_SPACE_SYMBOL)]] = True
        self.keys, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    @property
    def known(self) -> list[str]:
        """The units that are remembered."""
        return self.keys.to_pylist()

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, x in enumerate(texts) if not self.plain or self.splitter is not None and self.splitter.search(x)]
        out = [self._pack(self.tok.encode(texts[i], add_special_tokens=False).ids) for i in whole]
        if len(whole) == len(texts):
            return out
        apart = set(whole)
        keys, at, n = units([x for i, x in enumerate(texts) if i not in apart])
        found = self._ids(keys).take(pa.array(at))
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[np.concatenate([[0], np.cumsum(n)])].tolist()
        raw = memoryview(found.buffers()[2] or b"")
        split, alone = iter([bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]), iter(out)
        return [next(alone if i in apart else split) for i in range(len(texts))]

    def _ids(self, keys: pa.Array) -> pa.Array:
        """The ids of each of distinct keys, remembered or from the library."""
        at = pc.index_in(keys, value_set=self.keys)
        new = keys.filter(at.is_null())
        learnt = self._learn(new)
        at = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.keys) + np.arange(len(new))
        found = pa.concat_arrays([self.ids, learnt]).take(pa.array(at))
        if len(self.keys) + len(new) > REMEMBERED:  # what was met before goes
            self.keys, self.ids, new, learnt = self.keys[:0], self.ids[:0], keys[:REMEMBERED], found[:REMEMBERED]
        short = pc.less_equal(pc.utf8_length(new), UNIT_CHARS)
        self.keys, self.ids = (pa.concat_arrays([x, y.filter(short)]) for x, y in ((self.keys, new), (self.ids, learnt)))
        return found

    def _learn(self, new: pa.Array) -> pa.Array:
        """The ids of each key by the library."""
        together = pc.and_(pc.invert(pc.starts_with(new, " ")), pc.less_equal(pc.utf8_length(new), UNIT_CHARS))
        short, width = new.filter(together), np.dtype(self.dtype).itemsize
        cuts = np.append(np.arange(0, len(short), JOINED), len(short))
        groups = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), short), _text(" ")).to_pylist() if len(short) else []
        parts = [self._packed(self._alone(new.filter(pc.invert(together)).to_pylist()))]
        for k in range(0, len(groups), 32):
            encoded = [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast([" " + g for g in groups[k : k + 32]], add_special_tokens=False)]
            size = np.diff(cuts[k : k + 33])
            if [np.count_nonzero(self.opens[x]) for x in encoded] == size.tolist():
                ids = np.concatenate(encoded)
                ends = np.append(np.flatnonzero(self.opens[ids]), len(ids)) * width
                parts.append(pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]))
            else:
                parts.append(self._packed(self._alone(short[cuts[k] : cuts[min(k + 32, len(groups))]].to_pylist())))
        order = np.empty(len(new), np.int64)
        mask = together.to_numpy(zero_copy_only=False)
        order[np.concatenate([np.flatnonzero(~mask), np.flatnonzero(mask)])] = np.arange(len(new))
        return pa.concat_arrays(parts).take(pa.array(order))

    @staticmethod
    def _packed(ids: list[bytes]) -> pa.Array:
        return pa.array(ids, pa.large_binary())

    def _alone(self, keys: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.tok.encode_batch_fast([u[1:] if u[0] == " " else " " + u for u in keys], add_special_tokens=False)]


_encoders: dict[tuple[str, str], UnitEncoder] = common.memory(__name__)


def _encoder(path: str, dtype: str) -> UnitEncoder:
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = UnitEncoder(path, dtype)
    return _encoders[path, dtype]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, write) -> None:
    """Writes under a name of this attempt's own, then renames: a lost or doubled task leaves one whole file."""
    there, root = _open(uri)
    there.create_dir(root, recursive=True)
    own = f"{root}/_{name}.{TaskContext.get().taskAttemptId()}"
    with there.open_output_stream(own) as out:
        write(out)
    there.move(own, f"{root}/{name}")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def id_type(path: str, end_id: int) -> str:
    return "<u2" if max(library(path).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"


def write_shards(docs: DataFrame, tokenizer: str, uri: str, end_id: int, dtype: str) -> DataFrame:
    """Writes the shards; gives ord (doc_id), occurrence, shard, offset in ids, n_tokens of each row, as a table."""
    common.short_batches(docs.sparkSession)
    cuts = ordered.bounds(docs, ordered.order_key(), 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(ordered.order_key().alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.withColumn("shard", ordered.bucket(F.col("ord"), cuts)).repartition("shard").sortWithinPartitions("shard", "ord", "text")
    end = np.array([end_id], dtype).tobytes()
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, root = _open(uri)
        there.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        shard, out, at, last, seen = None, None, 0, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                there.move(f"{root}/_{shard_name(shard)}.{attempt}", f"{root}/{shard_name(shard)}")

        for batch in common.blocks(batches, 1, BLOCK_BYTES):
            ords, texts, shards = (batch.column(i).to_pylist() for i in range(3))
            index = []
            for o, s, ids in zip(ords, shards, _encoder(tokenizer, dtype).encode(texts)):
                if s != shard:
                    close()
                    shard, at, last = s, 0, None
                    out = there.open_output_stream(f"{root}/_{shard_name(s)}.{attempt}")
                seen = seen + 1 if o == last else 0
                last, n = o, len(ids) // width + 1
                out.write(ids + end)
                index.append((o, seen, s, at, n))
                at += n
            columns = list(zip(*index)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["ord", "occurrence", "shard", "offset", "n_tokens"])
        close()

    return common.materialize(dealt.select("ord", "text", "shard").mapInArrow(run, "ord long, occurrence int, shard int, offset long, n_tokens long"), "token-index-rows")


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mixer, another one for each salt."""
    x = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _U64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 .. n-1 for n distinct 64-bit keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.before = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two keys have the same 64-bit hash")
        left, sizes, levels = keys, [], []
        while len(left) and len(sizes) < LEVELS:
            size = max(64, int(GAMMA * len(left)))
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for one that no level holds. A foreign key may get any slot."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[open_[hit]] = self.before[at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            k = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[k] == keys[open_]
            out[open_[same]] = self.before[-1] + k[same]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def pack_segment(keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, n: np.ndarray) -> bytes:
    mph = PerfectHash.build(keys)
    slot = mph.slots(keys)
    out = io.BytesIO()
    np.save(out, mph.sizes)
    np.save(out, np.packbits(mph.bits))
    np.save(out, mph.rest)
    for values in (fingerprint(keys), shard.astype(np.int32), offset.astype(np.int64), n.astype(np.int64)):
        by_slot = np.empty_like(values)
        by_slot[slot] = values
        np.save(out, by_slot)
    return out.getvalue()


class Segment:
    """A read index segment."""

    def __init__(self, raw: bytes):
        f = io.BytesIO(raw)
        sizes, bits, rest, self.fp, self.shard, self.offset, self.n = (np.load(f) for _ in range(7))
        self.mph = PerfectHash(sizes, np.unpackbits(bits)[: int(sizes.sum())].astype(bool), rest)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there, and its shard, offset and number of ids."""
        slot = self.mph.slots(keys)
        there = slot >= 0
        there[there] = self.fp[slot[there]] == fingerprint(keys[there])
        slot = np.where(there, slot, 0)
        return there, self.shard[slot], self.offset[slot], self.n[slot]


def key_hash(doc_id: int, occurrence: int = 0) -> int:
    """The 64-bit hash of a key, as Spark's xxhash64(doc_id, occurrence) gives it."""
    import struct

    import xxhash

    return xxhash.xxh64_intdigest(struct.pack("<q", occurrence), seed=xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42))


def _segment_file(segment: int) -> str:
    return f"index-{segment:08d}.mph"


def _keyed(rows: DataFrame, segments: int) -> DataFrame:
    key = F.xxhash64(F.col("ord"), F.col("occurrence").cast("long"))
    return rows.withColumn("key", key).withColumn("segment", F.pmod(F.shiftrightunsigned("key", 20), F.lit(segments)).cast("int"))


def write_index(index_rows: DataFrame, uri: str, segments: int) -> DataFrame:
    """Writes a file for each segment; gives segment and n_keys, as a table."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        segment = int(part["segment"].iloc[0])
        raw = pack_segment(part["key"].to_numpy().astype(np.uint64), part["shard"].to_numpy(), part["offset"].to_numpy(), part["n_tokens"].to_numpy())
        _put(uri, _segment_file(segment), lambda out: out.write(raw))
        return pd.DataFrame({"segment": [segment], "n_keys": [len(part)]})

    return common.materialize(_keyed(index_rows, segments).groupBy("segment").applyInPandas(build, "segment int, n_keys long"), "token-index")


def lookup(keys: DataFrame, uri: str, segments: int) -> DataFrame:
    """ord, occurrence, shard, offset, n_tokens of the keys that the index holds."""

    def find(part: pd.DataFrame) -> pd.DataFrame:
        there, root = _open(uri)
        with there.open_input_stream(f"{root}/{_segment_file(int(part['segment'].iloc[0]))}") as f:
            held, shard, offset, n = Segment(f.read()).find(part["key"].to_numpy().astype(np.uint64))
        return pd.DataFrame({"ord": part["ord"], "occurrence": part["occurrence"], "shard": shard, "offset": offset, "n_tokens": n})[held]

    return _keyed(keys.select("ord", "occurrence"), segments).groupBy("segment").applyInPandas(find, "ord long, occurrence int, shard int, offset long, n_tokens long")


def read_back(found: DataFrame, uri: str, dtype: str) -> DataFrame:
    """Adds ids_crc32 of the ids that the files hold at each place, as unsigned 32-bit numbers."""
    width = np.dtype(dtype).itemsize

    def read(part: pd.DataFrame) -> pd.DataFrame:
        there, root = _open(uri)
        part = part.sort_values("offset")
        with there.open_input_file(f"{root}/{shard_name(int(part['shard'].iloc[0]))}") as f:
            part["ids_crc32"] = [zlib.crc32(np.frombuffer(f.read_at(n * width, at * width), dtype).astype("<u4").tobytes()) for at, n in zip(part["offset"].tolist(), part["n_tokens"].tolist())]
        return part

    return found.groupBy("shard").applyInPandas(read, "ord long, occurrence int, shard int, offset long, n_tokens long, ids_crc32 long")


def write_files(docs: DataFrame, tokenizer: str, end_id: int, uri: str) -> tuple[DataFrame, int, str]:
    """Writes shards and index under uri; gives the index rows, the number of segments and the type of an id."""
    dtype = id_type(tokenizer, end_id)
    rows = write_shards(docs, tokenizer, uri, end_id, dtype)
    segments = max(1, -(-rows.count() // SEGMENT_KEYS))
    write_index(rows, uri, segments)
    return rows, segments, dtype


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read from the files through the index."""
    uri = common.new_path(docs.sparkSession, "token-files")
    rows, segments, dtype = write_files(docs, tokenizer, end_id, uri)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # A row for each shard, whose number is fixed by the number of partitions.
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    read = read_back(lookup(rows, uri, segments), uri, dtype).join(F.broadcast(bases), "shard")
    return read.select(F.when(F.col("ord") != F.expr("-9223372036854775807L - 1L"), F.col("ord")).alias("doc_id"), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def read_document(uri: str, doc_id: int, segments: int, dtype: str, occurrence: int = 0) -> np.ndarray | None:
    """The ids of one document, or None if the index doesn't hold it."""
    key = key_hash(doc_id, occurrence)
    there, root = _open(uri)
    with there.open_input_stream(f"{root}/{_segment_file((key >> 20) % segments)}") as f:
        held, shard, offset, n = Segment(f.read()).find(np.array([key], np.uint64))
    if not held[0]:
        return None
    width = np.dtype(dtype).itemsize
    with there.open_input_file(f"{root}/{shard_name(int(shard[0]))}") as f:
        return np.frombuffer(f.read_at(int(n[0]) * width, int(offset[0]) * width), dtype)
