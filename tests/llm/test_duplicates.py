"""Near duplicates, shared lines, benchmark passages and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lorespark.llm import common
from lorespark.llm import decontamination as dc
from lorespark.llm import line_dedup as ld
from lorespark.llm import minhash as mh
from lorespark.llm import ordered
from lorespark.llm import winnowing as wn
from lorespark.llm.components import components
from lorespark.sources.tables import FILE_ROWS


def lower(x: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def brute_components(rows):
    """rows: (doc_id, text) -> {doc_id: component}."""

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in sets}, [(i, len(s)) for i, s in sets]


def test_near_duplicates_on_edge_rows(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    want, sizes = brute_components(rows)
    got = mh.near_duplicates(edge).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted(sizes)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
    assert mh.near_duplicates(empty).count() == 0
    kept = mh.one_of_each(edge)
    assert kept.columns == edge.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {i for i, c in want.items() if i == c}


def test_chains_and_groups_over_several_blocks(spark, monkeypatch):
    """A chain of near copies whose ends don't resemble each other, cut into many blocks."""
    monkeypatch.setattr(mh, "BLOCK_WEIGHT", 12_000)
    r = random.Random(4)
    words = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(40):
        rows.append((100 + k, " ".join(words)))
        words[r.randrange(80)] = f"n{k}"
    rows += [(300 + k, " ".join(f"z{r.randint(0, 9)}" for _ in range(40))) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute_components(rows)
    assert {r.doc_id: r.component_id for r in mh.near_duplicates(docs).collect()} == want
    assert len(set(want.values())) < 15


def test_pairs_just_over_the_threshold_are_found(spark):
    """300 pairs of similarity 0.75 to 0.8: 100 shingles each, of which the last 11 to 14 differ."""
    r = random.Random(31)
    rows = []
    for k in range(300):
        words = [f"p{k}x{r.randrange(10**6)}" for _ in range(104)]
        cut = 11 + k % 4
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-cut] + [f"q{k}y{j}" for j in range(cut)]))]
    got = {x.doc_id: x.component_id for x in mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = sum(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(300))
    assert found >= 299 and len(set(got.values())) == 600 - found


def test_unlike_documents_of_one_table_are_linked_apart(spark):
    """Documents that share much, but not enough, with the smallest under their keys still meet each other."""
    r = random.Random(17)
    common_part = [f"s{k}" for k in range(60)]
    rows = []
    for k in range(60):
        own = [f"o{k}x{j}" for j in range(40)]
        rows += [(10 * k, " ".join(common_part + own)), (10 * k + 1, " ".join(common_part + own[:-6] + [f"t{r.randrange(10**6)}" for _ in range(6)]))]
    want, _ = brute_components(rows)
    assert len(set(want.values())) == 60
    assert {x.doc_id: x.component_id for x in mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_exact_links_count_what_sets_share():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    every = np.arange(40)
    shared = mh._shared(sets, every, every)
    assert (shared == [[len(np.intersect1d(a, b)) for b in sets] for a in sets])[~np.eye(40, dtype=bool)].all()
    assert (mh._shared(sets, every[:15], every[15:]) == [[len(np.intersect1d(a, b)) for b in sets[15:]] for a in sets[:15]]).all()


def test_components_of_random_graphs(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def brute_lines(rows, min_docs):
    key = lambda line: lower(line.strip(ld.STRIPPED))
    found = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line):
                found[key(line)].add(i)
    gone = {k for k, ids in found.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("min_docs", [2, 5, 10])
def test_line_dedup_on_edge_rows(edge, empty, min_docs):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    got = ld.dedup_lines(edge, min_docs).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got) == brute_lines(rows, min_docs)
    whole = ld.without_shared_lines(edge, min_docs)
    assert whole.columns == edge.columns
    assert all(r.n_chars == len(r.text) and r.rest == "r" for r in whole.collect())
    assert ld.dedup_lines(empty, min_docs).count() == 0


def test_a_hot_line_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(k, f"hot\nline {k}\nhot\npair {k // 9}") for k in range(400)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = ld.dedup_lines(docs, 10).collect()
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got) == brute_lines(rows, 10)
        first = {r.doc_id: r.text for r in ld.dedup_lines(docs, 10, keep_first=True).collect()}
        assert first[0].split("\n")[0] == "hot" and sum(x.split("\n").count("hot") for x in first.values()) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bitmaps():
    lines = [str(k) for k in range(21)]
    assert ld.kept_lines("\n".join(lines), ld.pack([0, 9])) == ("\n".join(x for x in lines if x not in ("0", "9")), 2)


def brute_contamination(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for s in range(max(len(w) - 10, 0) + 1):
                windows[tuple(w[s : s + 10])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    ids |= x
        out.append((str(i), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_contamination_on_edge_rows(spark, edge, empty, benchmark, benchmark_rows):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    want = brute_contamination(rows, benchmark_rows)
    assert sorted((str(r[0]), *r[1:]) for r in dc.summary(dc.contamination(edge, benchmark)).collect()) == want
    clean = dc.clean_documents(edge, benchmark)
    assert clean.columns == edge.columns and clean.count() == sum(not r[-1] for r in want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert sum(r.n_hit for r in dc.contamination(edge, none).collect()) == 0
    assert dc.contamination(empty, benchmark).count() == 0


def brute_fingerprint(text, k=wn.K, window=wn.WINDOW):
    """(hash, position) of each kept minimum, from the definition: one hash after another, one window after another."""
    codes = [xxhash.xxh64_intdigest(c.encode(), seed=42) & (wn.PRIME - 1) for c in text]
    if codes and len(codes) < k:
        codes += [0] * (k - len(codes))
    grams = []
    for i in range(len(codes) - k + 1):
        h = 0
        for c in codes[i : i + k]:
            h = (h * wn.BASE + c) % wn.PRIME
        grams.append((h, i))
    size = min(window, len(grams))
    out = []
    for s in range(len(grams) - size + 1 if grams else 0):
        best = min(grams[s : s + size], key=lambda g: (g[0], -g[1]))
        if best not in out[-1:]:
            out.append(best)
    return out


def unpack(fp):
    return [(x >> 31, (1 << 31) - 1 - (x & ((1 << 31) - 1))) for x in fp]


def brute_likeness(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_winnowing(rows):
    """rows: (doc_id, text) -> sorted doc_id, n_chars, digest of the edited text, both fingerprints, near_edited, near_next."""
    rows = sorted(((i is not None, i or 0, t or "") for i, t in rows), key=lambda x: (x[0], x[1], x[2].encode()))
    out = []
    for k, (known, i, t) in enumerate(rows):
        n, after = len(t) // 4, rows[(k + 1) % len(rows)][2]
        edited = t[: len(t) - n] + after[:n]
        own, new, nxt = (brute_fingerprint(x) for x in (t, edited, after))
        form = lambda f: " ".join(f"{h:x}:{p}" for h, p in f)
        out.append((str(i if known else None), len(t), hashlib.sha256(edited.encode()).hexdigest(), form(own), form(new), round(brute_likeness(own, new), 12), round(brute_likeness(own, nxt), 12)))
    return sorted(out)


def winnowed(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in wn.summary(wn.fingerprints(df)).collect())


def test_winnowing_on_edge_rows(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    got = winnowed(edge)
    assert got == brute_winnowing(rows)
    prints = {r[0]: r[3] for r in got}
    assert prints["5"] == prints["6"] == "" and prints["8"] != prints["9"]
    assert wn.summary(wn.fingerprints(empty)).count() == 0


def test_winnowing_of_edits_around_every_length(spark):
    """Texts from none to a few windows, each before one that is empty, short or long."""
    r = random.Random(8)
    text = lambda n: "".join(r.choice("ab é漢😀") for _ in range(n))
    sizes = [0, 1, 3, 4, 15, 16, 17, 46, 47, 48, 49, 60, 61, 62, 63, 64, 65, 66, 80, 100, 200, 400]
    rows = [(k, text(n if k % 2 else r.choice([0, 2, 30, 300]))) for k, n in enumerate(x for n in sizes for x in (n, n))]
    assert winnowed(spark.createDataFrame(rows, "doc_id long, text string")) == brute_winnowing(rows)


def test_winnowing_guarantee_and_ties(spark):
    r = random.Random(6)
    texts = ["a" * 90, *("".join(r.choice("xyz ") for _ in range(r.randint(1, 160))) for _ in range(40))]
    got = [unpack(x.fp) for x in sorted(wn.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", "fp").collect())]
    assert got == [brute_fingerprint(t) for t in texts]
    # A passage of K + WINDOW - 1 characters at any offset, without a space, shares a fingerprint with any other place of it.
    least = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(wn.K + wn.WINDOW - 1))
    held = ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n)) + least + "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(25 - n)) for n in range(25)]
    prints = [{h for h, _ in unpack(x.fp)} for x in wn.with_fingerprint(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), "text", "fp").collect()]
    assert all(a & b for a in prints for b in prints)


def test_winnowing_of_text_without_spaces(spark):
    r = random.Random(12)
    han = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(2000))
    a, b = (unpack(x.fp) for x in sorted(wn.with_fingerprint(spark.createDataFrame([(0, han), (1, "一" + han)], "doc_id long, text string"), "text", "fp").collect()))
    assert brute_likeness(a, b) > 0.95


def test_buckets_follow_the_order_of_keys(spark):
    from pyspark.sql import functions as F

    keys = [k * k for k in range(500)] + [7] * 50 + [None] * 3
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    cuts = ordered.bounds(df, ordered.order_key(), 20)
    got = df.select(ordered.order_key().alias("k"), ordered.bucket(ordered.order_key(), cuts).alias("b")).collect()
    assert all(r.b == sum(c <= r.k for c in cuts) for r in got)
    assert max(Counter(r.b for r in got).values()) < 120
    assert df.select(F.max(ordered.bucket(ordered.order_key(), []))).first()[0] == 0


def test_a_small_table_is_written_in_few_files(spark):
    rows = spark.range(500).repartition(40)
    shuffled, cores = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        few = common.materialize(rows, "few", 500)
        assert len(few.inputFiles()) <= max(cores, 1) < 40
        assert sorted(r.id for r in few.collect()) == list(range(500))
        assert len(common.materialize(rows, "many", 100 * FILE_ROWS).inputFiles()) == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)


def test_winnowing_copies_each_array_once_a_step(spark):
    """Of the 4 steps of the hash and the 5 of the minima each slices one of its two inputs; two slices cut the ends off."""
    found = wn.with_minima(spark.createDataFrame([(0, "a" * 200)], "doc_id long, text string"), "text", "m")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("slice(") <= 4 + 5 + 2


def test_winnowing_works_out_anew_only_the_seam(spark, monkeypatch):
    """What the edited text takes of the next has minima of its own there, whether it holds a whole window or not."""
    from pyspark.sql import functions as F

    r = random.Random(15)
    text = lambda n: "".join(r.choice("ab é漢😀") for _ in range(n))
    rows = [(2 * k, text(n)) for k, n in enumerate([184, 187, 188, 191, 192, 195, 196, 260, 800, 800, 800, 800, 800, 5000])]
    rows += [(2 * k + 1, text(n)) for k, n in enumerate([46, 47, 48, 300, 300, 300, 300, 0, 45, 46, 47, 48, 49, 4000])]
    asked, whole = [], wn.with_minima
    monkeypatch.setattr(wn, "with_minima", lambda df, text, *more: asked.append((df, text)) or whole(df, text, *more))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert winnowed(docs) == brute_winnowing(rows)
    longest = asked[1][0].agg(F.max(F.length(asked[1][1]))).first()[0]
    assert len(asked) == 2 and longest <= 3 * (wn.K + wn.WINDOW - 1)
