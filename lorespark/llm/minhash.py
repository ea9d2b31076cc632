r"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on full shingle sets.

HALVES collections of WIDTH minhashes each give a half key; every pair of half keys is a table key. So 60 minhashes
serve 190 tables, where tables of their own would need 1140. Two documents of similarity s meet in a table if two of
their half keys agree: at s = 0.75 they miss with probability 3e-4, at 0.85 with 4e-7, and at 0.3 they meet with 0.1.

Texts with one set of shingles are one class and go on as its smallest doc_id. A half key that no other class has is
dropped before tables are formed. In each table a row links every class to the smallest one under its key, never class
to class, if the share of equal minhashes makes a similarity of PERCENT thinkable; those whose link isn't are linked
among themselves, ROUNDS times, and then without that test. So what chance brings together stays apart, and nothing is
left out. The components of these links bound where true links can be.

Verification has two steps. First each class is compared with the one it is linked to that looks most alike; most of a
group of near copies is joined by these stars. Only components in which parts are still apart go on: classes of different
parts are compared, all of them, in blocks of bounded weight. A part that is a group of any size is never compared
within itself, and blocks whose sizes rule a link out don't meet. The components of all true links are the result.

Words are [^\x20\x09-\x0D]+ after A-Z is lower-cased. A set holds the distinct runs of five words; with fewer, the whole
sequence is the one element. Shingles are held as 64-bit hashes. Null and empty texts and texts without words have an
empty set and are linked with nothing, as is a row without a doc_id, whose component is null and which is kept. Rows of
one doc_id are one document: what is linked to one is linked to all. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm import common
from lorespark.llm.components import components

WORDS, PERCENT = 5, 75
HALVES, WIDTH = 20, 3
#: The share of equal minhashes (of 60, eight bits each) under which a pair isn't linked: 4.5 standard deviations below PERCENT.
THINKABLE, ROUNDS = 0.5, 3
#: Parts into which the rows of a key fall where they are joined with what is known of the key.
SALTS = 16
#: What a block may weigh: a document weighs its shingles and DOC_WEIGHT.
BLOCK_WEIGHT, DOC_WEIGHT = 1_200_000, 2_000
#: Sets in one class of sizes differ by less than this factor.
SIZE_STEP = 1.15
#: A shingle in more documents of a block than this is counted by matrices, others pair by pair.
DENSE_FROM, DENSE_COLUMNS = 16, 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)]
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 1 << 63, HALVES * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _RANDOM.integers(0, 1 << 63, HALVES * WIDTH, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """The distinct hashed shingles of a text, ascending."""
    words = (text or "").encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    size = min(k, n)
    total = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        total = total + w[j : n - size + 1 + j] * np.uint64(_ODD[j])
    return np.unique(_mix(total))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """HALVES * WIDTH minhashes of a set that isn't empty."""
    least = np.full(HALVES * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    step = 1 << 10
    for k in range(0, len(shingles), step):  # pieces bound the memory of a long text
        least = np.minimum(least, (shingles[None, k : k + step] * _FACTORS[:, None] + _ADDED[:, None]).min(1))
    return least


def half_keys(least: np.ndarray) -> np.ndarray:
    """HALVES keys, each of WIDTH minhashes."""
    keys = np.zeros(HALVES, np.uint64)
    for j in range(WIDTH):
        keys = _mix(keys + least[j::WIDTH] * np.uint64(_ODD[j]))
    return keys


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set (s1, s2), half keys, and eight bits of each minhash."""

    def run(ids: list, texts: list) -> dict:
        sets = [shingle_set(x) for x in texts]
        sums = [(_mix(x + np.uint64(_ODD[7])).sum(dtype=np.uint64), _mix(x ^ np.uint64(_ODD[9])).sum(dtype=np.uint64)) for x in sets]
        least = [minhashes(x) if len(x) else None for x in sets]
        halves = [np.zeros(0, np.uint64) if x is None else half_keys(x) for x in least]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in halves])]).astype(np.int32)
        flat = np.concatenate(halves).view(np.int64) if halves else np.zeros(0, np.int64)
        s1, s2 = (np.array([s[k] for s in sums], np.uint64).view(np.int64) for k in (0, 1))
        signs = [b"" if x is None else _mix(x).astype(np.uint8).tobytes() for x in least]
        return {"doc_id": ids, "n_shingles": [len(x) for x in sets], "s1": pa.array(s1), "s2": pa.array(s2), "halves": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "signs": signs}

    return common.map_text(docs, run, "doc_id long, n_shingles long, s1 long, s2 long, halves array<long>, signs binary", "doc_id", "text")


def _with_known(rows: DataFrame, known: DataFrame, key: str, by: str = "node") -> DataFrame:
    """rows joined with a row for each key that is known; a key of many rows is met in SALTS tasks."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS))
    spread = known.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", salt).join(spread, [key, "_salt"]).drop("_salt")


def table_rows(classes: DataFrame) -> DataFrame:
    """key, node of each class in each table in which it may meet another."""
    halves = classes.select("node", F.posexplode("halves").alias("half", "value")).select("node", "half", F.xxhash64("half", "value").alias("key"))
    halves = common.materialize(halves, "minhash-halves")
    shared = halves.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where(F.col("low") < F.col("high")).select("key")
    mine = _with_known(halves, common.materialize(shared, "minhash-shared"), "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("half", "key"))).alias("own")).where(F.size("own") > 1)
    pairs = F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: F.xxhash64(x["key"], y["key"]))))
    return mine.select("node", F.explode(pairs).alias("key"))


def likely(links: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b with the share of minhashes that agree."""
    sign = lambda c: classes.select(F.col("node").alias(c), F.col("signs").alias(f"s{c}"))

    def share(a: list, b: list, x: list, y: list) -> dict:
        n = HALVES * WIDTH
        same = np.frombuffer(b"".join(x), np.uint8).reshape(-1, n) == np.frombuffer(b"".join(y), np.uint8).reshape(-1, n)
        return {"a": a, "b": b, "share": same.mean(1).tolist()}

    return common.map_text(links.join(sign("a"), "a").join(sign("b"), "b"), share, "a long, b long, share double", "a", "b", "sa", "sb")


def candidate_links(classes: DataFrame) -> DataFrame:
    """a, b, share: classes linked with the smallest under a table key that they may resemble, without repeats."""
    rows, found = common.materialize(table_rows(classes), "minhash-tables"), []
    most = rows.count()
    for left in range(ROUNDS, -1, -1):
        tops = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where(F.col("least") < F.col("most")).select("key", "least")
        met = common.materialize(_with_known(rows, tops, "key").where(F.col("least") != F.col("node")), "minhash-met", most)
        most = met.count()
        links = common.materialize(likely(met.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), classes), "minhash-likely", most)
        common.release(rows)
        good = F.col("share") >= (THINKABLE if left else 0.0)  # after the last round everything is linked
        found.append(links.where(good))
        failed = links.where(~good).select(F.col("a").alias("least"), F.col("b").alias("node"))
        if not left or failed.isEmpty():
            break
        rows = common.materialize(met.join(failed, ["least", "node"], "left_semi").select("key", "node"), "minhash-tables", most)
    return common.materialize(reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.max("share").alias("share")), "minhash-links")


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each set of left shares with each of right; left and right number sets, apart or the same."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column)
    out = np.zeros((len(left), len(right)), np.int64)
    at_left, at_right = (np.full(len(sets), -1) for _ in range(2))
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    few = (often[column] > 1) & (often[column] <= DENSE_FROM)
    c, r = column[few], row[few]
    for d in range(1, DENSE_FROM):
        if len(c) <= d:
            break
        same = c[d:] == c[:-d]
        for p, q in ((r[:-d][same], r[d:][same]), (r[d:][same], r[:-d][same])):
            i, j = at_left[p], at_right[q]
            ok = (i >= 0) & (j >= 0)
            if ok.any():
                out += np.bincount(i[ok] * len(right) + j[ok], minlength=out.size).reshape(out.shape)
    many = often[column] > DENSE_FROM
    if many.any():
        dense = np.cumsum(often > DENSE_FROM) - 1
        c, r = dense[column[many]], row[many]
        for start in range(0, int(c[-1]) + 1, DENSE_COLUMNS):
            a, b = np.searchsorted(c, [start, start + DENSE_COLUMNS])
            x = np.zeros((len(sets), DENSE_COLUMNS), np.float32)
            x[r[a:b], c[a:b] - start] = 1
            out += np.rint(x[left] @ x[right].T).astype(np.int64)
    return out


def _forest(nodes: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those pairs that join what earlier ones left apart."""
    up = {int(x): int(x) for x in nodes}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def exact_links(nodes: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], parts: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between nodes of different parts, in two blocks or within one if all are of one."""
    first = np.flatnonzero(blocks == blocks.min())
    second = np.flatnonzero(blocks == blocks.max())
    if len(np.unique(parts)) < 2:
        return []
    shared = _shared(sets, first, second)
    sizes = np.array([len(x) for x in sets])
    union = sizes[first][:, None] + sizes[second][None, :] - shared
    i, j = np.nonzero((100 * shared >= percent * union) & (parts[first][:, None] != parts[second][None, :]))
    return _forest(nodes, list(zip(nodes[first[i]].tolist(), nodes[second[j]].tolist())))


def star_links(pivot: int, nodes: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """The links of a pivot, which is one of the nodes, with the others."""
    at = int(np.flatnonzero(nodes == pivot)[0])
    out = []
    for k, x in enumerate(sets):
        if k != at:
            shared = len(np.intersect1d(sets[at], x, assume_unique=True))
            if 100 * shared >= percent * (len(sets[at]) + len(x) - shared):
                out.append((pivot, int(nodes[k])))
    return out


_TASKS = "tasks array<struct<component:long,block:long,part:long,g1:long,g2:long,g3:long>>"


def _dealt_sets(docs: DataFrame, work: DataFrame, compare) -> DataFrame:
    """a, b that compare gives for the sets of each task. work: node and its tasks, a row each."""
    tasks = common.materialize(work.groupBy("node").agg(F.collect_list(F.struct("component", "block", "part", "g1", "g2", "g3")).alias("tasks")), "minhash-work")
    nodes = common.checked_broadcast(tasks.select(F.col("node").alias("doc_id")), 16)
    texts = docs.select("doc_id", "text").join(nodes, "doc_id", "left_semi")
    joined = tasks.join(texts.withColumnRenamed("doc_id", "node"), "node")

    def to_sets(ids: list, tasks: list, texts: list) -> dict:
        return {"node": ids, "tasks": tasks, "shingles": [shingle_set(x).tobytes() for x in texts]}

    sets = common.map_text(joined, to_sets, f"node long, {_TASKS}, shingles binary", "node", "tasks", "text")
    dealt = sets.where(F.octet_length("shingles") > 0).select("node", "shingles", F.explode("tasks").alias("t")).select("node", "shingles", "t.*")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        common.only(__name__)
        out: list[tuple[int, int]] = []
        for component, own in part.groupby("component", sort=False):
            if len(own) > 1:
                out += compare(int(component), own, [np.frombuffer(x, np.uint64) for x in own["shingles"]])
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return dealt.groupBy("g1", "g2", "g3").applyInPandas(run, "a long, b long")


def _bins(weighed: DataFrame) -> int:
    """How many tasks share what is small: by the weight of all."""
    weight = weighed.agg(F.sum(F.col("n_shingles") + DOC_WEIGHT)).first()[0] or 0
    return max(1, -(-int(weight) // BLOCK_WEIGHT))


def stars(docs: DataFrame, links: DataFrame, sizes: DataFrame) -> DataFrame:
    """a, b: true links of classes with the class they are linked to that looks most alike."""
    best = links.groupBy(F.col("b").alias("node")).agg(F.min_by("a", F.struct(-F.col("share"), "a")).alias("pivot"))
    best = common.materialize(best.join(sizes, "node"), "minhash-stars")
    bins, none = _bins(best), F.lit(-1).cast("long")
    parts = best.groupBy("pivot").agg(F.ceil(F.sum(F.col("n_shingles") + DOC_WEIGHT) / F.lit(BLOCK_WEIGHT)).alias("parts"))
    alone = F.col("parts") == 1
    place = lambda part: (F.col("pivot").alias("component"), part.alias("block"), F.lit(0).cast("long").alias("part"), F.when(alone, F.pmod(F.xxhash64("pivot"), F.lit(bins))).otherwise(F.col("pivot")).alias("g1"), F.when(alone, none).otherwise(part).alias("g2"), none.alias("g3"))
    leaves = best.join(parts, "pivot").withColumn("_part", F.pmod(F.xxhash64("node"), F.col("parts"))).select("node", *place(F.col("_part")))
    heads = parts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(F.col("pivot").alias("node"), *place(F.col("_part")))
    return _dealt_sets(docs, leaves.unionByName(heads), lambda pivot, own, sets: star_links(pivot, own["node"].to_numpy(), sets))


def _work(members: DataFrame) -> DataFrame:
    """node, component, block, part and the tasks it is needed in: g1, g2, g3. members: node, component, part, n_shingles."""
    weight = F.col("n_shingles") + DOC_WEIGHT
    whole = members.groupBy("component").agg((F.sum(weight) <= BLOCK_WEIGHT).alias("small"))
    heavy = members.groupBy("component", "part").agg(F.sum(weight).alias("w")).where(F.col("w") > BLOCK_WEIGHT).select("component", "part", F.col("part").alias("own"))
    sized = members.withColumn("class", F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(SIZE_STEP))).cast("int")).join(heavy, ["component", "part"], "left")
    # A class of sizes, heavy parts apart, is cut by hash into as many blocks as it weighs.
    kind = ["component", "class", "own"]
    cuts = sized.groupBy(*kind).agg(F.ceil(F.sum(weight) / F.lit(BLOCK_WEIGHT)).alias("cuts")).select(*(F.col(c).alias(f"_{c}") for c in kind), "cuts")
    met = sized.join(whole, "component").join(cuts, (F.col("component") == F.col("_component")) & (F.col("class") == F.col("_class")) & F.col("own").eqNullSafe(F.col("_own")))
    number = F.when(F.col("small"), F.lit(0).cast("long")).otherwise(F.xxhash64("class", F.coalesce("own", F.lit(-1)), F.pmod(F.xxhash64("node"), F.col("cuts"))))
    placed = common.materialize(met.select("node", "component", "part", "own", "n_shingles", "small", number.alias("block")), "minhash-blocks")
    bins, none = _bins(placed), F.lit(-1).cast("long")
    blocks = placed.groupBy("component", "block", "own", "small").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    alone = blocks.where("small").select("component", "block", F.pmod(F.xxhash64("component"), F.lit(bins)).alias("g1"), none.alias("g2"), none.alias("g3"))
    more = blocks.where("NOT small")
    x, y = more.alias("x"), more.alias("y")
    apart = F.col("x.own").isNull() | F.col("y.own").isNull() | (F.col("x.own") != F.col("y.own"))
    near = (100 * F.col("x.high") >= PERCENT * F.col("y.low")) & (100 * F.col("y.high") >= PERCENT * F.col("x.low"))
    pairs = x.join(y, (F.col("x.component") == F.col("y.component")) & (F.col("x.block") <= F.col("y.block")) & apart & near)
    both = pairs.select(F.col("x.component").alias("component"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    tasks = both.select("component", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), F.col("component").alias("g1"), F.col("i").alias("g2"), F.col("j").alias("g3"))
    return placed.select("node", "component", "block", "part").join(alone.unionByName(tasks), ["component", "block"])


def verified_links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """a, b: spanning links of similarity PERCENT or more between the parts of each component."""

    def compare(_: int, own: pd.DataFrame, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        blocks, g2, g3 = own["block"].to_numpy(), own["g2"].iloc[0], own["g3"].iloc[0]
        if g2 != g3 and blocks.min() == blocks.max():
            return []
        return exact_links(own["node"].to_numpy(), blocks, sets, own["part"].to_numpy())

    return _dealt_sets(docs, _work(members), compare)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    found = common.materialize(features(docs), "minhash-features")
    same = ["s1", "s2", "n_shingles"]
    classes = found.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy(*same).agg(F.min("doc_id").alias("node"), F.first("halves").alias("halves"), F.first("signs").alias("signs"))
    classes = common.materialize(classes, "minhash-classes")
    # A document with rows in several classes is one node of the graph.
    own = found.where(F.col("doc_id").isNotNull()).join(classes.select(*same, "node"), same)
    repeats = own.where(F.col("doc_id") != F.col("node")).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    several = repeats.join(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct(*same)).alias("x"), F.max(F.struct(*same)).alias("y")).where(F.col("x") != F.col("y")).select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")
    links = candidate_links(classes)
    sizes = classes.select("node", "n_shingles")
    star = common.materialize(stars(docs, links, sizes), "minhash-star-links")
    joined = components(star, "minhash-parts").withColumnRenamed("label", "part")
    loose = components(links.select("a", "b"), "minhash-loose").withColumnRenamed("label", "component")
    members = common.materialize(loose.join(joined, "node", "left").withColumn("part", F.coalesce("part", "node")).join(sizes, "node"), "minhash-members")
    open_ = members.groupBy("component").agg(F.min("part").alias("low"), F.max("part").alias("high")).where(F.col("low") < F.col("high")).select("component")
    rest = verified_links(docs, members.join(open_, "component", "left_semi"))
    labels = components(star.union(rest).union(several), "minhash-true")
    every = found.select("doc_id", *same).join(classes.select(*same, "node"), same, "left")
    start = F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id"))
    named = every.withColumn("node", start).join(labels, "node", "left").withColumn("component_id", F.coalesce("label", "node"))
    return named.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component, with all their columns."""
    kept = near_duplicates(docs).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))
