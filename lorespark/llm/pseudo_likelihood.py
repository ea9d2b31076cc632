"""Scores documents by masked pseudo-likelihood: the log-probability of every token given the words around it.

The vocabulary is 4096 classes: the 4000 most frequent words of the corpus, 95 hash buckets for all others, and a boundary
for what lies outside a document. A token's probability is that of its class in its window, times, in a bucket, that of
the word in its class.

* Class: a network sees two neighbours on each side, with an embedding for each of the four places, one tanh layer, and a
  softmax in two steps: 64 groups of 64 classes. It is trained in numpy, by minibatches, on every window of every document;
  its biases start from the counts of the whole corpus. Documents are dealt to units of about UNIT_TOKENS tokens by hash.
  Rounds of 1, 1, 2, 4, ... units cover all of them, each unit in one round, EPOCHS times over; the units of a round are shared out among WORKERS
  tasks at most, which start from the same weights and whose results are averaged by their tokens. Neither the order of
  rows nor their partitions change the outcome.
* Word in class: counts of every word of the corpus in its contexts, two words on each side. The distribution in the
  whole window falls back to the one between both neighbours, that to the one after the left neighbour, and that to the
  word's own share of its class, each with PRIOR pseudo-counts. Each token is left out of the counts it is scored by, so
  a word seen nowhere else isn't sure of itself. These counts grow with the corpus and stay on the executors: tokens are
  dealt by left neighbour and class, and sums of each document come back to the block of documents they left from.

Only the word's own share needs its count in every task: words of at least a 1 / SHARED part of the corpus are broadcast,
rarer ones have the rest of their class in equal parts. Contexts tell all words apart (by hash).

Words are runs without white space, A-Z lower-cased. Null and empty texts have no tokens, log-likelihood 0, and a null
mean. Equally frequent words are taken by their bytes. Repeated rows are counted and scored each; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import copy
import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm import common

BOUNDARY = 0
#: Tokens of a unit of training, and how many tasks train at the same time at most.
UNIT_TOKENS, WORKERS = 1_000_000, 64
#: EPOCHS: passes over the windows of each unit, in a corpus of any length. BATCH: of a corpus of one unit; longer ones have LONG_BATCH.
HIDDEN, BATCH, LONG_BATCH, EPOCHS, RATE = 48, 2048, 8192, 2, 0.08
#: Weights that are changed, or handed on, at a time.
STRIDE, SLICE = 1 << 14, 1 << 17
#: Logits up to this size have exponentials whose sums are sound.
SAFE = 60
#: Tokens scored at once.
CHUNK = 1 << 14
#: Bytes of text whose words are counted at once; the longest word whose hash is worked out beside those of others.
COUNTED_BYTES, WORD_BYTES = 16 << 20, 64
#: Pseudo-counts of a fallback in a context, of a word in its class, and the most words whose counts are broadcast.
PRIOR, ALPHA, SHARED = 2.0, 0.5, 2_000_000
#: Bytes and documents of a block; tokens for each task that counts contexts. Steps of a log-probability of 1.
BLOCK_BYTES, BLOCK_DOCS, TASK_TOKENS, STEP = 6 << 20, 60_000, 1_500_000, 2048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Layout:
    """group * group classes, the last `buckets` of them hash buckets, the first the boundary."""

    group: int = 64
    buckets: int = 95

    @property
    def classes(self) -> int:
        return self.group**2

    @property
    def first(self) -> int:
        """The first bucket."""
        return self.classes - self.buckets

    def of(self, word: bytes, number: dict[bytes, int]) -> int:
        return number.get(word) or self.first + zlib.crc32(word) % self.buckets


LAYOUT = Layout()


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, as split gives them, one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, n = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy().astype(np.int64)
    there = pc.greater(pc.binary_length(words), 0)  # space at an end leaves an empty word there
    if not pc.all(there, min_count=0).as_py():
        n = np.bincount(np.repeat(np.arange(len(n)), n)[there.to_numpy(zero_copy_only=False)], minlength=len(n))
        words = words.filter(there)
    return words, n


def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, which of them each token is, and how many tokens each text has."""
    words, n = _words(texts)
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), n


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of every word of all texts, as a table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, 0, COUNTED_BYTES):
            words, at, _ = _coded(block.column(0))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(at, minlength=len(words)))], names=["word", "n"])

    common.short_batches(docs.sparkSession)
    return common.materialize(docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


def frequent_words(counts: DataFrame, n: int) -> list[bytes]:
    """The n most frequent words; equal counts by the word."""
    return [bytes(r[0]) for r in counts.orderBy(F.desc("n"), "word").limit(n).collect()]


def windows(classed: list[np.ndarray]) -> np.ndarray:
    """left2, left, token, right, right2 of each token of each text."""
    n = np.array([len(c) for c in classed], np.int64)
    pos = np.arange(n.sum()) + 2 + 4 * np.repeat(np.arange(len(n)), n)
    padded = np.full(n.sum() + 4 * len(n), BOUNDARY, np.uint16)
    if len(pos):
        padded[pos] = np.concatenate(classed)
    return np.stack([padded[pos + d] for d in (-2, -1, 0, 1, 2)], 1)


def class_counts(counts: DataFrame, words: list[bytes], layout: Layout) -> np.ndarray:
    """How many tokens of the whole corpus each class has."""
    known = {bytes(r[0]): r[1] for r in counts.orderBy(F.desc("n"), "word").limit(len(words)).collect()}
    every = dict(counts.groupBy((F.crc32("word") % layout.buckets).alias("b")).agg(F.sum("n")).collect())  # a row for each bucket
    out = np.zeros(layout.classes, np.int64)
    for b, n in every.items():
        out[layout.first + b] = n
    for k, w in enumerate(words):
        out[k + 1] = known[w]
        out[layout.first + zlib.crc32(w) % layout.buckets] -= known[w]
    return out


class Network:
    """p(class | two neighbours on each side), as p(group | window) * p(class | group, window)."""

    def __init__(self, layout: Layout, counts: np.ndarray, seed: int = 7):
        rng, g, n = np.random.default_rng(seed), layout.group, layout.classes
        of = (counts + 1.0).reshape(g, g)
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.group = g
        self.p = {
            "embed": normal(4, n, HIDDEN), "hidden": np.zeros(HIDDEN, np.float32),
            "out_group": normal(HIDDEN, g), "bias_group": np.log(of.sum(1) / of.sum()).astype(np.float32),
            "out": normal(n, HIDDEN), "bias": np.log(of / of.sum(1, keepdims=True)).astype(np.float32).reshape(-1),
        }

    def copy(self) -> Network:
        other = copy.copy(self)
        other.p = {k: x.copy() for k, x in self.p.items()}
        return other

    def _hidden(self, around: list[np.ndarray]) -> np.ndarray:
        h = self.p["embed"][0].take(around[0], 0)
        for k in (1, 2, 3):
            h += self.p["embed"][k].take(around[k], 0)
        h += self.p["hidden"]
        return np.tanh(h, out=h)

    def _groups(self, h: np.ndarray) -> np.ndarray:
        """The logits of the groups, a row for each window. h has a 1 at its end, for the biases."""
        return h @ np.concatenate([self.p["out_group"], self.p["bias_group"][None]])

    def _members(self, h: np.ndarray, parts: list[tuple[slice, slice]], x: np.ndarray) -> np.ndarray:
        """The logits of the classes in the group of each window, a row for each, in x."""
        weights = np.concatenate([self.p["out"], self.p["bias"][:, None]], 1)
        for at, rows in parts:
            np.matmul(h[at], weights[rows].T, out=x[at])
        return x

    def _parts(self, group: np.ndarray) -> list[tuple[slice, slice]]:
        """Where the windows of each group stand, which are sorted by it, and its classes."""
        starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
        return [(slice(i, j), slice(k * self.group, (k + 1) * self.group)) for k, i, j in zip(group[starts].tolist(), starts, [*starts[1:], len(group)])]

    def _by_group(self, token: np.ndarray) -> np.ndarray:
        return np.argsort((token // self.group).astype(np.uint16), kind="stable")

    def logs(self, around: list[np.ndarray], token: np.ndarray) -> np.ndarray:
        """The log-probability of each token. around: left2, left, right, right2."""
        order = self._by_group(token)
        group, member = np.divmod(token[order], self.group)
        h = _with_one(self._hidden([x[order] for x in around]))
        x = self._groups(h)
        logs = _log_at(x, group)
        logs += _log_at(self._members(h, self._parts(group), x), member)
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def gradients(self, batch: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability of a batch of windows."""
        return self._gradients(batch[self._by_group(batch[:, 2])], self._zeros())

    def _zeros(self) -> dict[str, np.ndarray]:
        return {k: np.zeros_like(x) for k, x in self.p.items()}

    def _gradients(self, batch: np.ndarray, g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The gradients of a batch that is sorted by group, written to g."""
        around, token, n = [batch[:, k].astype(np.intp) for k in (0, 1, 3, 4)], batch[:, 2].astype(np.intp), len(batch)
        group, member = np.divmod(token, self.group)
        hidden, every, part = self._hidden(around), np.arange(n), np.float32(1 / n)
        h = _with_one(hidden)
        d = _softmax(self._groups(h), part)
        d[every, group] -= part
        joint = h.T @ d
        g["out_group"][...], g["bias_group"][...] = joint[:-1], joint[-1]
        back = d @ self.p["out_group"].T
        parts = self._parts(group)
        d = _softmax(self._members(h, parts, d), part)
        d[every, member] -= part
        joint, other = np.zeros((len(g["out"]), HIDDEN + 1), np.float32), np.empty_like(back)
        for at, rows in parts:
            np.matmul(d[at].T, h[at], out=joint[rows])
            np.matmul(d[at], self.p["out"][rows], out=other[at])
        g["out"][...], g["bias"][...] = joint[:, :-1], joint[:, -1]
        back += other
        hidden *= hidden
        np.subtract(1, hidden, out=hidden)
        back *= hidden
        g["hidden"][...] = back.sum(0)
        # Two numbers are added at a time, as one of twice the size.
        pairs, places = back.view(np.complex64).reshape(-1), _places(self.p["embed"].shape[1])
        g["embed"].fill(0)
        for x, out in zip(around, g["embed"]):
            np.add.at(out.view(np.complex64).reshape(-1), places.take(x, 0).reshape(-1), pairs)
        return g

    def past(self) -> dict[str, np.ndarray]:
        """What train remembers of the gradients, before the first."""
        return {k: np.full_like(x, 1e-8) for k, x in self.p.items()}

    def train(self, sample: np.ndarray, epochs: int = EPOCHS, past: dict[str, np.ndarray] | None = None, batch: int = BATCH) -> Network:
        """Minibatches with a rate for each weight (Adagrad). past is changed as well."""
        past = past if past is not None else self.past()
        batches = [x[self._by_group(x[:, 2])] for x in (sample[k : k + batch] for k in range(0, len(sample), batch))]
        gradients, root = self._zeros(), np.empty(STRIDE, np.float32)
        for _ in range(epochs):
            for x in batches:
                for name, g in self._gradients(x, gradients).items():
                    g, was, weight = g.reshape(-1), past[name].reshape(-1), self.p[name].reshape(-1)
                    for i in range(0, len(g), STRIDE):  # parts that stay in the processor's cache
                        at = slice(i, i + STRIDE)
                        part, squares = g[at], was[at]
                        r = np.multiply(part, part, out=root[: len(part)])
                        squares += r
                        part *= RATE
                        part /= np.sqrt(squares, out=r)
                        weight[at] -= part
        return self


@functools.cache
def _places(classes: int) -> np.ndarray:
    """Where the pairs of numbers of each class stand in its embedding."""
    return np.arange(classes * (HIDDEN // 2)).reshape(classes, -1)


def _with_one(h: np.ndarray) -> np.ndarray:
    """h and a column of ones, whose weights are biases."""
    out = np.empty((len(h), h.shape[1] + 1), np.float32)
    out[:, :-1], out[:, -1] = h, 1
    return out


def _exps(x: np.ndarray) -> np.ndarray:
    """Logits to their exponentials, in place; the sum of each row."""
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], np.float32)


def _lowered(x: np.ndarray) -> np.ndarray:
    """x, with the largest number of each row taken off it if some exponential would be too large or small without that."""
    if not -SAFE < x.min(initial=0) <= x.max(initial=0) < SAFE:
        x -= x.max(1)[:, None]
    return x


def _softmax(x: np.ndarray, part: np.float32) -> np.ndarray:
    """Of each row, times part, in place."""
    s = _exps(_lowered(x))
    x *= np.divide(part, s, out=s)[:, None]
    return x


def _log_at(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The log-probability of number k of each row of logits, which are overwritten."""
    out = _lowered(x)[np.arange(len(k)), k]
    out -= np.log(_exps(x))
    return out


def rounds(units: int) -> list[tuple[int, int, int]]:
    """First unit, unit after the last, and number of tasks of each round of training."""
    out, a = [], 0
    while a < units:
        b = min(units, max(1, 2 * a))
        out.append((a, b, min(WORKERS, b - a)))
        a = b
    return out


def class_rows(docs: DataFrame, words: list[bytes], units: int, layout: Layout) -> DataFrame:
    """unit, key, classes of every row that has tokens, as a table. unit and key hash the row."""
    frequent = pa.array(words, pa.binary())
    key = F.xxhash64(F.lit(5), F.coalesce("text", F.lit("")), F.coalesce("doc_id", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, 1, BLOCK_BYTES):
            found, at, n = _coded(block.column(1))
            classes = _classes(found, frequent, layout).astype("<u2")[at]
            keys = block.column(0).to_numpy()
            unit = (_mix(keys.view(np.uint64)) % np.uint64(units)).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(n * 2)]).astype(np.int32)
            of = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(classes)])
            yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(keys), of], names=["unit", "key", "classes"]).filter(pa.array(n > 0))

    common.short_batches(docs.sparkSession)
    return common.materialize(docs.select(key.alias("key"), "text").mapInArrow(run, "unit int, key long, classes binary"), "lm-classes")


def train_round(rows: DataFrame, net: Network, past: dict[str, np.ndarray], first: int, after: int, tasks: int, epochs: int, batch: int) -> None:
    """Trains net, and past with it, on the units from first to before after: one task for each of `tasks` parts, then the mean of these."""
    names = sorted(net.p)
    sizes = [net.p[k].size for k in names]
    flat = lambda net, past: np.concatenate([x[k].reshape(-1) for x in (net.p, past) for k in names])
    shared = rows.sparkSession.sparkContext.broadcast((net, past))  # as many weights as the layout has

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, net, past, held, n, tokens = None, None, None, [], 0, 0

        def fit() -> None:
            nonlocal held, n, tokens
            x = windows(held)
            net.train(x.take(np.random.default_rng(3).permutation(len(x)), 0), epochs, past, batch)
            held, n, tokens = [], 0, tokens + n

        def give() -> Iterator[pa.RecordBatch]:
            fit()
            x = flat(net, past)
            for k, i in enumerate(range(0, len(x), SLICE)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([tokens], pa.int64()), pa.array([x[i : i + SLICE].tobytes()], pa.binary())], names=["slice", "part", "n", "weights"])

        for rows in batches:
            for p, classes in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if p != part:
                    if part is not None:
                        yield from give()
                    part, tokens, (net, past) = p, 0, shared.value
                    net, past = net.copy(), {k: x.copy() for k, x in past.items()}
                held.append(np.frombuffer(classes, "<u2"))
                n += len(held[-1])
                if n >= UNIT_TOKENS:
                    fit()
        if part is not None:
            yield from give()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for k, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = np.frombuffer(raw, np.float32).astype(np.float64) * n
                sums[k] = [sums[k][0] + x, sums[k][1] + n] if k in sums else [x, n]
        for k, (x, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(x / n).astype(np.float32).tobytes()], pa.binary())], names=["slice", "weights"])

    common.short_batches(rows.sparkSession)
    part = F.floor((F.col("unit") - first) * tasks / F.lit(after - first)).cast("int")
    own = rows.where((F.col("unit") >= first) & (F.col("unit") < after)).select(part.alias("part"), "key", "classes")
    own = own.repartitionById(tasks, "part").sortWithinPartitions("part", "key", "classes").select("part", "classes")
    learnt = own.mapInArrow(learn, "slice int, part int, n long, weights binary")
    # What comes to the driver is one mean of the weights.
    got = learnt.repartition(min(tasks, 8), "slice").sortWithinPartitions("slice", "part").select("slice", "n", "weights").mapInArrow(mean, "slice int, weights binary").collect()
    if got:
        x = np.frombuffer(b"".join(bytes(r[1]) for r in sorted(got)), np.float32)
        cuts = np.cumsum(sizes * 2)[:-1]
        for k, new, kind in zip(names * 2, np.split(x, cuts), [net.p] * len(names) + [past] * len(names)):
            kind[k][...] = new.reshape(kind[k].shape)
    shared.unpersist()


def train_network(docs: DataFrame, net: Network, words: list[bytes], total: int, layout: Layout) -> Network:
    """Trains net on every window of docs, which have total tokens, EPOCHS times each."""
    units = max(1, -(-total // UNIT_TOKENS))
    rows, past = class_rows(docs, words, units, layout), net.past()
    for first, after, tasks in rounds(units):
        train_round(rows, net, past, first, after, tasks, EPOCHS, BATCH if units == 1 else LONG_BATCH)
    common.release(rows)
    return net


#: What a byte changes of a CRC-32.
_CRC = np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], np.uint32)


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the CRC-32 of each word."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data, size = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.diff(ends)
    order = np.argsort(np.minimum(size, WORD_BYTES + 1).astype(np.uint8), kind="stable")[::-1]
    long = int((size > WORD_BYTES).sum())
    start, left = ends[:-1][order], size[order]
    h, crc = np.zeros(len(words), np.uint64), np.full(len(words), 0xFFFFFFFF, np.uint32)
    for k in range(int(left[long:].max(initial=0))):
        to = len(left) - int(np.searchsorted(left[long:][::-1], k, "right"))
        byte = data[start[long:to] + k]
        at = crc[long:to]
        crc[long:to] = _CRC[(at & np.uint32(255)) ^ byte] ^ (at >> np.uint32(8))
        h[long:to] = _mix(h[long:to] * np.uint64(0x9E3779B97F4A7C15) + byte + np.uint64(1))
    crc = ~crc
    for k, i in enumerate(order[:long].tolist()):
        raw = words[i].as_py()
        h[k], crc[k] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little"), zlib.crc32(raw)
    out, crcs = np.empty_like(h), np.empty_like(crc)
    out[order], crcs[order] = h, crc
    return out, crcs


def _classes(words: pa.Array, frequent: pa.Array, layout: Layout, crc: np.ndarray | None = None) -> np.ndarray:
    """The class of each word, as layout.of gives it."""
    known = pc.fill_null(pc.index_in(words, value_set=frequent), -1).to_numpy().astype(np.int64)
    crc = crc if crc is not None else _hashes(words)[1]
    return np.where(known >= 0, known + 1, layout.first + crc % np.uint32(layout.buckets))


def word_ids(words: pa.Array, frequent: pa.Array, layout: Layout) -> np.ndarray:
    """A hash of the word in place of all bits above those of the class."""
    h, crc = _hashes(words)
    return h // np.uint64(layout.classes) * np.uint64(layout.classes) + _classes(words, frequent, layout, crc).astype(np.uint64)


class Shares:
    """The log-probability of words in their class without any context, the token itself left out."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, of_class: np.ndarray):
        """ids, n: of the words whose counts are known; of_class: tokens, types, and those of known words, by class."""
        order = np.argsort(ids)
        self.ids, self.classes = ids[order], np.uint64(of_class.shape[1])
        tokens, types, known, known_types = of_class.astype(np.float64)
        whole = np.maximum(tokens - 1 + ALPHA * types, ALPHA)
        rest = np.maximum(tokens - known - 1, 0) + ALPHA * (types - known_types)
        c = (self.ids % self.classes).astype(np.int64)
        self.logs = np.log((n[order] - 1 + ALPHA) / whole[c]).astype(np.float32)
        self.rest = np.log(np.maximum(rest, ALPHA) / np.maximum(types - known_types, 1) / whole).astype(np.float32)

    def of(self, ids: np.ndarray) -> np.ndarray:
        out = self.rest[(ids % self.classes).astype(np.int64)]
        if len(self.ids):
            order = np.argsort(ids)  # a search for ascending numbers stays in the processor's cache
            at = np.minimum(np.searchsorted(self.ids, ids[order]), len(self.ids) - 1)
            same = self.ids[at] == ids[order]
            out[order[same]] = self.logs[at[same]]
        return out


def shares(counts: DataFrame, words: list[bytes], layout: Layout) -> tuple[Shares, int]:
    """The shares of words in their class, and the number of tokens in buckets."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = F.col("n") >= -(-total // SHARED)
    # The frequent words are a row for each class at most, the buckets have a row each, and SHARED rows at most are known.
    frequent = counts.sparkSession.createDataFrame([(bytearray(w),) for w in words], "word binary")
    rare = common.materialize(counts.join(F.broadcast(frequent), "word", "left_anti"), "lm-rare")
    by = rare.groupBy((F.crc32("word") % layout.buckets).alias("b")).agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(known, F.col("n")).otherwise(0)), F.sum(known.cast("long"))).collect()
    of_class = np.zeros((4, layout.classes), np.int64)
    for b, *x in by:
        of_class[:, layout.first + b] = x
    got = common.map_text(rare.where(known), lambda w, n: {"id": word_ids(pa.array(w, pa.binary()), pa.array(words, pa.binary()), layout).view(np.int64).tolist(), "n": n}, "id long, n long", "word", "n").toArrow()
    return Shares(got.column("id").to_numpy().view(np.uint64), got.column("n").to_numpy(), of_class), int(of_class[0].sum())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def contexts(padded: np.ndarray, at: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the class and the left neighbour, of these and the right one, and of these and the second ones."""
    one = _mix(padded[at - 1] * np.uint64(0x9E3779B97F4A7C15) + padded[at] % np.uint64(classes))
    two = _mix(one + padded[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F))
    return one, two, _mix(two + _mix(padded[at - 2] + np.uint64(1)) + padded[at + 2] * np.uint64(0x165667B19E3779F9))


#: What is dealt of a token: word, contexts, its share in steps, and its document's place in the block.
_DEALT = (("one", "<u4"), ("word", "<u4"), ("two", "<u4"), ("three", "<u2"), ("share", "<u2"), ("doc", "<u2"))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each element's value among equal values from 0 on, and how often each value occurs."""
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    return at.astype(np.uint64), n


def word_logs(m: dict[str, np.ndarray]) -> np.ndarray:
    """The log-probability of each dealt token's word in its class; all tokens of a left neighbour and class are in m."""
    p = np.exp(m["share"] / -float(STEP))
    group, n = _runs(m["one"])
    for deeper in ("two", "three", None):
        seen, k = _runs((group << np.uint64(32)) | m["word"])
        p = (k[seen] - 1 + PRIOR * p) / (n[group] - 1 + PRIOR)
        if deeper:
            group, n = _runs((group << np.uint64(32)) | m[deeper])
    return np.log(p)


def deal(docs: DataFrame, words: list[bytes], net: Network, share: Shares, tasks: int, layout: Layout) -> DataFrame:
    """bucket, block, dealt: for each block of documents the tokens that go to each bucket, and in bucket -1 - block the documents."""
    shared = docs.sparkSession.sparkContext.broadcast((net, share))  # five vectors a class, SHARED numbers at most
    frequent = pa.array(words, pa.binary())
    buckets = np.uint64(tasks * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, share = shared.value

        def give(docs: pa.Array, texts: pa.Array, block: int) -> pa.RecordBatch:
            found, at, n = _coded(texts)
            ids = word_ids(found, frequent, layout)
            logs = share.of(ids)
            doc = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(at)) + 2 + 4 * doc
            padded = np.zeros(len(at) + 4 * len(n), np.uint64)
            padded[pos] = ids[at]
            c = (padded % np.uint64(layout.classes)).astype(np.int64)
            logs_of = np.zeros(len(pos))
            for k in range(0, len(pos), CHUNK):
                p = pos[k : k + CHUNK]
                logs_of[k : k + CHUNK] = net.logs([c[p + d] for d in (-2, -1, 1, 2)], c[p])
            class_logs = np.bincount(doc, logs_of, len(n))
            home = pc.fill_null(docs, -1).to_numpy().astype("<i8").tobytes() + docs.is_null().to_numpy(zero_copy_only=False).astype("<u1").tobytes() + n.astype("<i8").tobytes() + class_logs.astype("<f8").tobytes()
            rare = np.flatnonzero(c[pos] >= layout.first)
            one, two, three = contexts(padded, pos[rare], layout.classes)
            bucket = ((one >> np.uint64(32)) % buckets).astype(np.uint16 if buckets < 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, rare = bucket[order], rare[order]
            cols = {"one": one[order], "word": padded[pos[rare]] // np.uint64(layout.classes), "two": two[order], "three": three[order], "share": np.clip(np.rint(-logs[at[rare]] * STEP), 0, 65535), "doc": doc[rare]}
            cols = {k: (cols[k] & np.uint64((1 << int(t[2]) * 8) - 1) if cols[k].dtype == np.uint64 else cols[k]).astype(t) for k, t in _DEALT}
            there, starts = np.unique(bucket, return_index=True)
            cuts = [*starts.tolist(), len(bucket)]
            blobs = [b"".join(cols[k][i:j].tobytes() for k, _ in _DEALT) for i, j in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array([*there.tolist(), -1 - block], pa.int64()), pa.array([block] * (len(blobs) + 1), pa.int64()), pa.array([*blobs, home], pa.binary())], names=["bucket", "block", "dealt"])

        for k, block in enumerate(common.blocks(batches, 1, BLOCK_BYTES, BLOCK_DOCS)):
            yield give(block.column(0), block.column(1), (TaskContext.get().partitionId() << 32) + k)

    common.short_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "bucket long, block long, dealt binary")


def sums(dealt: DataFrame, tasks: int) -> DataFrame:
    """block, home, dealt: the documents of each block, and sums of word_logs with their places in the block."""
    width = sum(int(t[2]) for _, t in _DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, parts = [], {k: [] for k, _ in _DEALT}
        for batch in batches:
            for bucket, block, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if bucket < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([True]), pa.array([raw], pa.binary())], names=["block", "home", "dealt"])
                    continue
                n, at = len(raw) // width, 0
                blocks.append((block, n))
                for k, t in _DEALT:
                    parts[k].append(np.frombuffer(raw, t, n, at))
                    at += n * int(t[2])
        if not blocks:
            return
        m = {k: np.concatenate(x) for k, x in parts.items()}
        # Buckets that meet in one task share no left neighbour and class but by a collision of 32 bits.
        logs, at = word_logs(m), 0
        for block, n in blocks:
            docs, where = np.unique(m["doc"][at : at + n], return_inverse=True)
            got = docs.astype("<u2").tobytes() + np.bincount(where, logs[at : at + n], len(docs)).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([False]), pa.array([got], pa.binary())], names=["block", "home", "dealt"])
            at += n

    return dealt.repartition(tasks, "bucket").mapInArrow(run, "block long, home boolean, dealt binary")


def collected(summed: DataFrame, tasks: int) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_prob of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes: dict[int, bytes] = {}
        words: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, home, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if home:
                    homes[block] = raw
                    continue
                total, n = words.setdefault(block, np.zeros(BLOCK_DOCS)), len(raw) // 6
                total[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<f4", n, 2 * n)
        for block, raw in homes.items():
            n = len(raw) // 25
            ids, null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u1", n, 8 * n) > 0
            tokens, logs = np.frombuffer(raw, "<i8", n, 9 * n), np.frombuffer(raw, "<f8", n, 17 * n)
            if block in words:
                logs = logs + words[block][:n]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(tokens), pa.array(logs), pa.array(logs / np.maximum(tokens, 1), mask=tokens == 0)], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_prob"])

    return summed.repartition(tasks, "block").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_prob double")


@dataclass
class Model:
    words: list[bytes]
    net: Network
    share: Shares
    rare: int


def train(docs: DataFrame, layout: Layout = LAYOUT) -> Model:
    """What a corpus teaches: the frequent words, the network, and the shares of the others; rare: how many tokens are others."""
    counts = word_counts(docs)
    words = frequent_words(counts, layout.first - 1)
    per_class = class_counts(counts, words, layout)
    share, rare = shares(counts, words, layout)
    net = train_network(docs, Network(layout, per_class), words, int(per_class.sum()), layout)
    return Model(words, net, share, rare)


def pseudo_likelihood(docs: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    model = train(docs, layout)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), model.rare // TASK_TOKENS + 1)
    return collected(sums(deal(docs, model.words, model.net, model.share, tasks, layout), tasks), tasks)
