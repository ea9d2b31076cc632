"""Licence scan, language identification, pseudo-likelihood and the pipeline."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lorespark.llm import common
from lorespark.llm import language_id as li
from lorespark.llm import license_scan as ls
from lorespark.llm import pseudo_likelihood as pl
from test_duplicates import brute_components, brute_contamination, brute_lines, lower

NOTICES = tuple(ls.NOTICES)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def brute_labels(words: list[str]) -> set[str]:
    """Labels of notices within their edits of any run of words."""
    out = set()
    for phrase, label, edits in NOTICES:
        for i, j in product(range(len(words)), range(1, 12)):
            run = " ".join(words[i : i + j])
            if i + j <= len(words) and abs(len(run) - len(phrase)) <= edits and distance(run, phrase) <= edits:
                out.add(label)
    return out


def test_fuzzy_search_finds_what_brute_force_finds():
    r = random.Random(3)
    for _ in range(60):
        phrase, label, edits = r.choice(NOTICES)
        text = list(phrase)
        for _ in range(r.randint(0, edits + 1)):
            k = r.randrange(1, len(text) - 1)
            kind = r.random()
            if kind < 0.4:
                text[k] = r.choice("abcxyz ")
            elif kind < 0.7:
                del text[k]
            else:
                text.insert(k, r.choice("abcxyz"))
        words = ("lorem ipsum " + "".join(text) + " dolor sit").split()
        got = set(filter(None, ls.scan_text(" ".join(words), NOTICES)["labels"].split(",")))
        assert got == brute_labels(words), words


def test_pigeonhole_pieces_make_up_the_phrase():
    for phrase, _, edits in NOTICES:
        pieces = ls.pigeonhole(phrase, edits)
        assert "".join(p for _, p in pieces) == phrase and len(pieces) == edits + 1


def test_base_places():
    got = ls.scan_text("MIT License, cc-by cc by; the Apache\nLicense and mit licenses", NOTICES)
    assert (got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (4, 0, 7, "apache,cc-by,mit")
    assert got["score"] == 1.0
    empty = ls.scan_text(None, NOTICES)
    assert (empty["n_words"], empty["first_word"], empty["labels"], empty["score"]) == (0, None, "", 0.0)


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    places = [(i, label) for phrase, label in ls.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_counts_are_what_brute_force_gives(spark, sf, edge, empty):
    extra = spark.createDataFrame([(900, "MIT license cc by cc by\ngnu general public license, apache  LICENSE. mit licence"), (901, "mit license " * 7)], "doc_id long, text string")
    for docs in (edge, common.documents(spark, sf).select("doc_id", "text").union(extra)):
        got = ls.summary(ls.scan(docs)).collect()
        want = Counter((r.doc_id, *brute_base(r.text)) for r in docs.collect())
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert ls.scan(empty).count() == 0


def test_spans_count_words_in_texts_of_many_matches():
    began = time.perf_counter()
    got = ls.scan_text("été mit license foo " * 20_000, NOTICES)
    assert got["n_base"] == 20_000 and (got["first_word"], got["last_word"]) == (1, 79_997)
    assert [(x["first_word"], x["last_word"]) for x in got["spans"][:2]] == [(1, 2), (5, 6)] and time.perf_counter() - began < 60


def test_language_is_learned(spark, sf):
    docs = common.documents(spark, sf)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = li.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and held
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95
    blind = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(docs.withColumn("source", docs.lang)).collect()}
    assert blind == {r.doc_id: (r.lang_pred, r.score) for r in got}


def test_language_of_edge_rows(edge, empty):
    got = li.identify(edge).collect()
    assert len(got) == edge.count()
    by = {r.doc_id: r for r in got}
    assert by[5].lang_pred == by[6].lang_pred == by[7].lang_pred == li.UND and by[5].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    assert li.identify(empty).count() == 0
    assert {r.lang_pred for r in li.identify(edge.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {li.UND}
    kept = li.keep_identified(edge, li.train(edge))
    assert kept.columns == edge.columns and kept.where("text is null").count() == 0


def test_what_is_no_letter_has_no_language(spark, sf):
    model = li.train(common.documents(spark, sf))
    assert [model.predict(x)[0] for x in ("½ ² Ⅷ ① 12", "!!", "", None)] == [li.UND] * 4 and model.predict("x ½")[0] != li.UND


def test_prediction_is_what_the_formula_gives(spark, sf):
    """n-grams, weights and softmax one after another, in plain Python."""
    model = li.train(common.documents(spark, sf))
    for text in ("Ein kurzer Satz", "the end of it", "a", "漢字 é"):
        c = [ord(x) for x in f" {text.lower()} "]
        grams = Counter()
        for n in (1, 2, 3):
            for k in range(len(c) - n + 1):
                total = sum(x * m for x, m in zip(c[k : k + n], li._MULTIPLIERS)) & 0xFFFFFFFF
                grams[((total ^ (total >> 15)) * (0x2C1B3C6D + 2 * (n - 1)) & 0xFFFFFFFF) >> (32 - li.BITS)] += 1
        x = {f: np.log1p(n) * float(model.idf[f]) for f, n in grams.items()}
        size = np.sqrt(sum(v * v for v in x.values()))
        logits = [float(model.bias[k]) + sum(v / size * float(model.weights[f, k]) for f, v in x.items()) for k in range(len(model.langs))]
        p = np.exp(np.array(logits) / model.temperature)
        p /= p.sum()
        lang, score = model.predict(text)
        assert lang == model.langs[int(p.argmax())] and abs(score - p.max()) < 1e-4


def test_rows_that_share_an_id_are_sampled_apart(spark):
    rows = [(1, f"{'der die das ist' if k % 2 else 'the of and is'} w{k}", "de" if k % 2 else "en") for k in range(200)] + [(None, f"le la les est v{k}", "fr") for k in range(100)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(r[0] for r in li.labelled_sample(known, 40))
    assert got == {"de": 40, "en": 40, "fr": 40}


def test_the_floor_rejects_no_calibration_document():
    r = np.random.default_rng(4)
    labels = r.integers(0, 4, 300)
    logits = r.normal(0, 1, (300, 4)) + 3 * np.eye(4)[labels]
    floor = li.score_floor(logits, labels)
    best = np.array([li.softmax(x).max() for x in logits])[logits.argmax(1) == labels]
    assert 0.25 < floor < best.min()


def test_temperature_lowers_the_loss():
    r = np.random.default_rng(0)
    labels = r.integers(0, 3, 300)
    logits = 12 * (r.normal(0, 1, (300, 3)) + np.eye(3)[labels])
    t = li.fit_temperature(logits, labels)
    loss = lambda t: -np.mean([np.log(li.softmax(x / t)[y]) for x, y in zip(logits, labels)])
    assert loss(t) < loss(1.0) and t > 1


def test_pseudo_likelihood_prefers_what_it_saw(spark, edge, empty):
    r = random.Random(1)
    rows = [(k, " ".join("one two three four".split() * 8)) for k in range(60)] + [(99, " ".join(r.choice("one two three four".split()) for _ in range(32))), (100, None), (101, "")]
    got = {x.doc_id: x for x in pl.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].mean_log_prob > got[99].mean_log_prob + 0.5
    assert got[0].n_tokens == 32 and got[100].n_tokens == 0 and got[100].mean_log_prob is None and got[101].log_likelihood == 0
    assert pl.pseudo_likelihood(edge).count() == edge.count()
    assert pl.pseudo_likelihood(empty).count() == 0


SMALL = pl.Layout(group=8, buckets=15)  # 48 frequent words


def naive_class_log(net, window):
    """log p(class) of one window, one number after another."""
    p, g = net.p, net.group
    left2, left, token, right, right2 = window
    h = np.tanh(sum(p["embed"][k][c].astype(float) for k, c in enumerate((left2, left, right, right2))) + p["hidden"])
    x = h @ p["out_group"] + p["bias_group"]
    rows = slice(token // g * g, (token // g + 1) * g)
    y = p["out"][rows] @ h + p["bias"][rows]
    return x[token // g] - np.log(np.exp(x).sum()) + y[token % g] - np.log(np.exp(y).sum())


def test_pseudo_likelihood_is_what_a_computation_by_hand_gives(spark):
    # The reference works on the words themselves: the network's formula, and counts of every context with the token left
    # out, each falling back to a shorter one.
    r = random.Random(5)
    common_words = [f"c{k}" for k in range(48)]
    rare = [f"rare{k}" for k in range(400)]
    texts = [" ".join(common_words) for _ in range(22)] + [" ".join(r.choice(rare if r.random() < 0.5 else common_words) for _ in range(40)) for _ in range(120)]
    texts += [texts[30], None, "", "one"]
    words = [pl.split(x) for x in texts]
    n = Counter(w for x in words for w in x)
    top = sorted(n, key=lambda w: (-n[w], w))[:48]
    number = {w: k + 1 for k, w in enumerate(top)}
    kind = lambda w: number.get(w) or SMALL.first + zlib.crc32(w) % SMALL.buckets
    of_class, types = Counter(), Counter()
    for w, k in n.items():
        of_class[kind(w)] += k
        types[kind(w)] += 1
    levels = lambda x, i: [(x[i - 1],), (x[i - 1], x[i + 1]), (x[i - 2], x[i - 1], x[i + 1], x[i + 2])]
    seen = Counter()
    padded = [[b"", b"", *x, b"", b""] for x in words]
    for x in padded:
        for i in range(2, len(x) - 2):
            for k, c in enumerate(levels(x, i)):
                seen[k, c, kind(x[i])] += 1
                seen[k, c, x[i]] += 1

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = pl.train(docs, SMALL)
    assert model.words == top

    def log(x, i):
        w, c = x[i], kind(x[i])
        at = [kind(x[i + d]) if x[i + d] else pl.BOUNDARY for d in (-2, -1, 0, 1, 2)]
        found = naive_class_log(model.net, at)
        if c < SMALL.first:
            return found
        p = (n[w] - 1 + pl.ALPHA) / (of_class[c] - 1 + pl.ALPHA * types[c])
        for k, context in enumerate(levels(x, i)):
            p = (seen[k, context, w] - 1 + pl.PRIOR * p) / (seen[k, context, c] - 1 + pl.PRIOR)
        return found + np.log(p)

    got = {y.doc_id: y for y in pl.pseudo_likelihood(docs, SMALL).collect()}
    for k, x in enumerate(padded):
        want = sum(log(x, i) for i in range(2, len(x) - 2))
        assert abs(got[k].log_likelihood - want) < 1e-3 * (1 + len(words[k])), k
        assert got[k].n_tokens == len(words[k])
    # A text that stands twice is surer of itself than the others of its kind.
    assert got[30].mean_log_prob > max(got[k].mean_log_prob for k in range(40, 142)) + 0.5


def test_other_rare_words_of_the_same_bucket_score_otherwise(spark):
    # Every neighbour keeps its class; only counts of words can tell the two texts apart.
    by_bucket = {}
    for k in range(3000):
        by_bucket.setdefault(zlib.crc32(b"w%d" % k) % SMALL.buckets, []).append(f"w{k}")
    pairs = [(v[0], v[1]) for v in by_bucket.values()][:20]
    frequent = " ".join(f"c{k}" for k in range(48))
    rows = [(k, frequent) for k in range(9)] + [(20 + k, " ".join(a for a, _ in pairs)) for k in range(4)] + [(30, " ".join(b for _, b in pairs))]
    got = {x.doc_id: x.mean_log_prob for x in pl.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()}
    assert got[20] > got[30] + 0.5


def test_network_gives_probabilities_and_follows_its_gradient():
    r = np.random.default_rng(2)
    net = pl.Network(SMALL, np.arange(64))
    n = SMALL.classes
    around = [np.repeat(r.integers(0, n, 1), n) for _ in range(4)]
    assert abs(np.exp(net.logs(around, np.arange(n))).sum() - 1) < 1e-4
    batch = r.integers(0, n, (50, 5))
    for name, g in net.gradients(batch).items():
        flat, at = net.p[name].reshape(-1), int(np.abs(g).argmax())
        loss = []
        for step in (1e-2, -2e-2):
            flat[at] += step
            loss.append(-net.logs([batch[:, k] for k in (0, 1, 3, 4)], batch[:, 2]).mean(dtype=np.float64))
        flat[at] += 1e-2
        assert abs((loss[0] - loss[1]) / 2e-2 - g.reshape(-1)[at]) < 2e-3, name


def test_network_takes_one_softmax_for_all_groups(monkeypatch):
    # A call for each group's few windows took more time than its numbers.
    r, asked = np.random.default_rng(6), []
    for name in ("_softmax", "_log_at"):
        monkeypatch.setattr(pl, name, lambda *a, of=getattr(pl, name), name=name: (asked.append(name), of(*a))[1])
    net = pl.Network(SMALL, np.arange(64))
    batch = r.integers(0, SMALL.classes, (300, 5))
    net.gradients(batch)
    assert asked == ["_softmax"] * 2
    # Logits whose exponentials are out of range, on either side.
    for shift in (0, 500, -500):
        net.p["bias_group"] += np.float32(shift)
        net.p["bias"] += np.float32(shift)
        logs = net.logs([batch[:, k] for k in (0, 1, 3, 4)], batch[:, 2])
        assert np.abs(logs - [naive_class_log(net, x) for x in batch]).max() < 1e-3
        assert all(np.isfinite(g).all() for g in net.gradients(batch).values())
        for name in ("bias_group", "bias"):
            net.p[name] -= np.float32(shift)
    assert asked.count("_log_at") == 6


def test_columns_of_words_are_what_one_word_after_another_gives():
    r = random.Random(4)
    texts = [None, "", " ", "A\x0bb\x1cC\x85 d\u00a0e\u3000F", "\r\n x  Y\tx ", "İ ÉTÉ été \x00 a\x00b", "z" * 63, "z" * 64, "z" * 65, "Q" * 5000 + " q"]
    texts += ["".join(r.choice("aB é漢\n\t") for _ in range(r.randint(0, 200))) for _ in range(60)]
    want = [pl.split(x) for x in texts]
    column = pa.array(["cut off", *texts], pa.string())[1:]
    found, at, n = pl._coded(column)
    words = found.to_pylist()
    assert [words[k] for k in at] == [w for x in want for w in x] and n.tolist() == [len(x) for x in want]
    assert len(set(words)) == len(words)
    hashes, crc = pl._hashes(found)
    assert crc.tolist() == [zlib.crc32(w) for w in words] and len(set(hashes.tolist())) == len(words)
    # A word's hash depends on nothing but the word.
    assert pl._hashes(pa.array(words[::-1], pa.binary())[1:])[0].tolist() == hashes[::-1][1:].tolist()
    frequent = words[3:40]
    classes = [SMALL.of(w, {w: k + 1 for k, w in enumerate(frequent)}) for w in words]
    assert pl._classes(found, pa.array(frequent, pa.binary()), SMALL).tolist() == classes
    ids = pl.word_ids(found, pa.array(frequent, pa.binary()), SMALL)
    assert (ids % np.uint64(SMALL.classes)).tolist() == classes and len(set(ids.tolist())) == len(words)
    batches = pa.table({"text": column}).to_batches(max_chunksize=7)
    assert [x for b in common.blocks(iter(batches), 0, 500) for x in b.column(0).to_pylist()] == texts
    assert not list(common.blocks(iter([]), 0, 500)) and [len(x) for x in pl._coded(pa.array([None], pa.string()))] == [0, 0, 1]


def test_network_learns_what_both_sides_say():
    sample = np.array([[1, 2, 30, 4, 5], [1, 2, 40, 4, 6], [9, 2, 30, 4, 6], [9, 2, 50, 4, 5]] * 400)
    net = pl.Network(SMALL, np.ones(64)).train(sample, 60)
    logs = net.logs([sample[:4, k] for k in (0, 1, 3, 4)], sample[:4, 2])
    assert np.exp(logs).min() > 0.8


def test_ties_and_samples_depend_on_nothing_but_the_rows(spark):
    rows = [(k, f"b a d c e{k % 7} f") for k in range(40)]
    one, two = (pl.train(spark.createDataFrame(x, "doc_id long, text string").repartition(n), SMALL) for x, n in ((rows, 1), (rows[::-1], 4)))
    assert one.words == two.words and one.words[:5] == [b"a", b"b", b"c", b"d", b"f"]
    assert all((one.net.p[k] == two.net.p[k]).all() for k in one.net.p)


def test_every_window_trains_the_network(spark, monkeypatch):
    # A sample would leave out left neighbours that stand five times in a document.
    r = random.Random(3)
    rows = [(k, " ".join(r.sample([f"w{k}x{j}" for j in range(1000)] * 5, 5000))) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tokens in (1_000_000, 5_000):  # one unit, and four in rounds of 1, 1 and 2
        monkeypatch.setattr(pl, "UNIT_TOKENS", tokens, raising=False)
        model = pl.train(docs)
        start = pl.Network(pl.LAYOUT, np.ones(pl.LAYOUT.classes))
        assert len(model.words) == 4000
        assert (model.net.p["embed"][:, 1:4001] != start.p["embed"][:, 1:4001]).any(2).all()
    other = pl.train(docs.orderBy(docs.doc_id.desc()).repartition(3))
    assert all((model.net.p[k] == other.net.p[k]).all() for k in model.net.p)
    assert pl.rounds(300)[-3:] == [(64, 128, 64), (128, 256, 64), (256, 300, 44)] and pl.rounds(1) == [(0, 1, 1)]


def test_a_long_corpus_has_as_many_passes_as_a_short_one(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"a{k % 7} b c{k % 3} " * 20) for k in range(60)], "doc_id long, text string")
    asked, train_round = [], pl.train_round
    monkeypatch.setattr(pl, "train_round", lambda rows, net, past, first, after, tasks, epochs, batch: (asked.append((first, after, epochs)), train_round(rows, net, past, first, after, tasks, epochs, batch)))
    pl.train(docs, SMALL)
    monkeypatch.setattr(pl, "UNIT_TOKENS", 1_000)
    pl.train(docs, SMALL)
    assert asked == [(0, 1, pl.EPOCHS), (0, 1, pl.EPOCHS), (1, 2, pl.EPOCHS), (2, 4, pl.EPOCHS)] and pl.EPOCHS == 2


def test_pipeline_stages(spark, sf, edge, benchmark, monkeypatch):
    docs, before = common.documents(spark, sf), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = common.materialize(stage(spark, docs, sf), "test")
        assert got.columns == docs.columns and 0 < got.count() <= docs.count(), name
        docs = got
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, last.collect()))


def test_pipeline_is_what_brute_force_gives(spark, sf):
    """Each stage in plain Python over all rows, the language stage with the model that the stage learns."""
    import public_tokenizers

    from lorespark.llm.token_counts import library

    docs = common.documents(spark, sf)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    model = li.train(docs)
    known = [(i, t) for i, t in rows if (p := model.predict(t))[0] != li.UND and p[1] >= model.floor]
    assert 0.9 * len(rows) < len(known)
    lines = [(int(i), text) for i, _, _, text in brute_lines(known, 10)]
    component, _ = brute_components(lines)
    kept = [(i, t) for i, t in lines if component[i] == i]
    items = [(r.item_id, r.text) for r in common.documents(spark, sf, "benchmark").collect()]
    bad = {i for i, *_, hit in brute_contamination(kept, items) if hit}
    clean = [(i, t) for i, t in kept if str(i) not in bad]
    assert len(known) > len(kept) > len(clean) > 0
    tok = library(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in clean:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(want)


@pytest.mark.parametrize("at", range(5))
def test_pipeline_stages_take_edge_rows(spark, sf, edge, empty, at):
    stage = corpus_pipeline.STAGES[at][1]
    assert stage(spark, edge, sf).count() <= edge.count()
    assert stage(spark, empty, sf).count() == 0
