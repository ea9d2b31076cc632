"""Counting, encoding and files against the libraries themselves."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from lorespark.llm import bpe_automaton as ba
from lorespark.llm import common, presplit
from lorespark.llm import token_counts as tc
from lorespark.llm import token_files as tf

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = ["a", "B", "é", " ", "  ", "\n", "'", "s", "'re", "!", "1", "́", "ß", "İ", "Σ", "<|endoftext|>", "<|startoftext|>", "x² ", " ", "漢", "—", "\x1c", "\x85", "\xa0", "_", "ﬁ", "\t", "the", "aaaa", "!!!!"]


def fuzz(n: int, seed: int = 5) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 50))) for _ in range(n)] + ["a" * k for k in range(1, 80)] + ["ha" * k + "!" for k in range(60)]


@pytest.mark.parametrize("name", FILES)
def test_counts_and_chunks_equal_the_library(name):
    path = public_tokenizers.path(name)
    counter, special = tc.PieceCounter(path), list(presplit.layout(path)["special"])
    texts = fuzz(800)
    want = [len(x.ids) for x in counter.tok.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts) == want
    for chunk, overlap in ((20, 4), (7, 2), (64, 1)):
        assert [tc.chunked_count(x, counter.tok, special, chunk, overlap) for x in texts[:300]] == want[:300]


@pytest.mark.parametrize("name", FILES)
def test_stable_cuts_split_the_encoding(name):
    path = public_tokenizers.path(name)
    tok, special = tc.library(path), list(presplit.layout(path)["special"])
    ids = lambda x: tok.encode(x, add_special_tokens=False).ids
    for text in fuzz(250, 8):
        for p in range(1, len(text)):
            if presplit.stable_cut(text, p, special):
                assert ids(text) == ids(text[:p]) + ids(text[p:])


def test_huge_text_is_counted_in_chunks():
    path = public_tokenizers.path("word_bpe_49k.json")
    text = ("the quick brown fox's 12 jumps! " * 9000) + "a" * 70000
    assert len(text) > 4 * tc.CHUNK_CHARS
    assert tc.PieceCounter(path).count([text]) == [len(tc.library(path).encode(text, add_special_tokens=False).ids)]


@pytest.mark.parametrize("name", FILES)
def test_automaton_equals_the_library(name):
    codec = ba.Codec(public_tokenizers.path(name))
    for text in fuzz(1000):
        ids, decoded = codec.encode(text)
        want = codec.tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == codec.tok.decode(want, skip_special_tokens=False)


def test_automaton_on_a_small_merge_list_equals_merging_by_hand():
    vocab = {s: k for k, s in enumerate(["a", "b", "c", "aa", "ab", "aaab", "bc"])}
    merges = [("a", "a"), ("a", "b"), ("b", "c"), ("aa", "ab")]
    machine = ba.Automaton(vocab, merges)
    r = random.Random(2)
    for _ in range(3000):
        word = [r.choice("abc") for _ in range(r.randint(1, 14))]
        parts = list(word)
        for a, b in merges:
            k = 0
            while k < len(parts) - 1:
                if (parts[k], parts[k + 1]) == (a, b):
                    parts[k : k + 2] = [a + b]
                k += 1
        assert [machine.labels[i] for i in machine.encode(word)] == parts


@pytest.mark.parametrize("unk", [None, "!"])
def test_symbols_outside_the_vocabulary_are_left_to_the_library(tmp_path, unk):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    gone = set(ba._BYTES[0xC3]) | {"q"}  # the first byte of Latin letters, and a letter
    held = lambda s: not gone & set(s.removesuffix("</w>"))
    added = {x["content"] for x in spec["added_tokens"]}
    pair = lambda x: x.split(" ") if isinstance(x, str) else x
    spec["model"]["vocab"] = {s: i for s, i in spec["model"]["vocab"].items() if s in added or held(s)}
    spec["model"]["merges"] = [x for x in spec["model"]["merges"] if all(map(held, pair(x)))]
    spec["model"]["unk_token"] = unk
    path = str(tmp_path / "less.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    codec = ba.Codec(path)
    for text in ["quick", "the queen's été", "é", "q", "plain words", "aqua qq 漢 Qß", *(x for x in fuzz(200, 9) if "<" not in x)]:  # the library gives added tokens other ids here
        assert np.frombuffer(codec.encode(text)[0], "<u4").tolist() == codec.tok.encode(text, add_special_tokens=False).ids, text


def test_memories_hold_no_long_pieces(monkeypatch):
    word, byte = (public_tokenizers.path(f) for f in FILES)
    long = ["x" * 5000 + str(k) + " b" for k in range(5)] + ["y" * 300 + "\n" + "z" * 300]
    counter, codec, encoder = tc.PieceCounter(word), ba.Codec(word), tf.UnitEncoder(byte, "<u2")
    assert counter.count(long) == [len(counter.tok.encode(x, add_special_tokens=False).ids) for x in long]
    assert all(codec.encode(x)[0] == np.array(codec.tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in long)
    assert encoder.encode(long) == [np.array(encoder.tok.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in long]
    assert all(len(w) <= tc.PIECE_CHARS for m in (counter.known, codec.known, encoder.known) for w in m)
    assert counter.known and codec.known and encoder.known


def test_units_equal_the_library():
    """Every kind of white space, in texts that are encoded together and apart."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tf.UnitEncoder(path, "<u2")
    parts = [*PARTS, " x", " \n", "\n ", "   ", chr(0x200B), chr(0xFEFF), chr(0x180E), chr(0x3000), "½", "😀", chr(0x120)]
    r = random.Random(4)
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    want = [np.array(x.ids, "<u2").tobytes() for x in encoder.tok.encode_batch(texts, add_special_tokens=False)]
    assert [y for k in range(0, 4000, 500) for y in encoder.encode(texts[k : k + 500])] == want


def test_columns_of_units_and_their_bounded_memory(monkeypatch):
    r = random.Random(9)
    parts = [*PARTS, " x", " \n", "\n ", "   ", " a b", chr(0x3000), chr(0x120), "", " " + "long" * 20]
    texts = ["", " ", "x ", " x", "a  b", "a \n b c", *("".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(400))]
    keys, at, n = tf.units(texts)
    names = keys.to_pylist()
    want = [[" " + x if k == 0 else x[1:] for k, x in enumerate(tf._UNIT.split(text))] for text in texts]
    assert [names[k] for k in at] == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]
    assert len(set(names)) == len(names) and set(at.tolist()) == set(range(len(names)))
    monkeypatch.setattr(tf, "REMEMBERED", 40)
    encoder = tf.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"), "<u2")
    for part in (texts[:20], texts[20:], texts[:20], texts[5:6], []):
        assert encoder.encode(part) == [np.array(encoder.tok.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in part]
        assert 0 < len(encoder.known) <= 40 and all(len(x) <= tf.UNIT_CHARS for x in encoder.known)


def test_automaton_refuses_merges_out_of_order():
    with pytest.raises(ValueError):
        ba.Automaton({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])


def test_operators_on_edge_rows(edge, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tc.library(path)
    rows = edge.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    got = tc.token_counts(edge, path, limit=100).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    coded = ba.digests(ba.encode_decode(edge, path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in coded) == sorted((a, n) for a, _, n in want)
    assert tc.token_counts(empty, path).count() == 0 and ba.encode_decode(empty, path).count() == 0


def test_sentencepiece_counts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["a b c", None, "", "Das ist ein Text."]
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert tc.sentencepiece_counts(texts, path) == [len(sp.encode(x or "")) for x in texts]


def test_perfect_hash_is_minimal_and_tells_foreign_keys():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    mph = tf.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    seg = tf.Segment(tf.pack_segment(keys, np.arange(len(keys)), np.arange(len(keys)) * 3, np.ones(len(keys))))
    there, shard, offset, _ = seg.find(keys)
    assert there.all() and (shard == np.arange(len(keys))).all() and (offset == 3 * np.arange(len(keys))).all()
    other = r.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert seg.find(other)[0].sum() <= 2
    with pytest.raises(ValueError):
        tf.PerfectHash.build(np.array([5, 5], np.uint64))


def test_files_round_trip(spark, edge, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = tc.library(path)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in edge.select("doc_id", "text").collect()), key=lambda x: (x[0], x[1], x[2].encode()))
    at, want = 0, []
    for known, i, text in rows:
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        want.append((i if known else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = tf.round_trip(edge, path, 2).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    uri = common.new_path(spark, "test-files")
    _, segments, dtype = tf.write_files(edge, path, 2, uri)
    assert tf.read_document(uri, 8, segments, dtype).tolist() == tok.encode("Word", add_special_tokens=False).ids + [2]
    assert tf.read_document(uri, 12345, segments, dtype) is None
    assert tf.round_trip(empty, path, 2).count() == 0


def test_a_worker_gives_back_the_memory_of_another_operator(spark, edge):
    ba.encode_decode(edge, public_tokenizers.path("word_bpe_49k.json")).collect()

    def probe(ids):
        return {"held": [len(ba._codecs) for _ in ids]}

    held = [r.held for _ in range(3) for r in common.map_text(edge, probe, "held int", "doc_id").collect()]
    assert held and not any(held)
