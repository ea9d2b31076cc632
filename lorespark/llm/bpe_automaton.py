"""Byte-pair encoding and decoding by an automaton compiled from the merge list.

The automaton reads token labels. It begins as one state with an arc for every base symbol, so that every spelling of a
word is a path. Merge gadgets are applied in order of rank. The gadget of u + v -> w
  1. takes the arc v out of the state that u leads to, since u v may no longer stand side by side;
  2. adds a state for w that is a copy of the state of v as it was just before, since w ends as v does;
  3. adds an arc w wherever there is an arc u by then, since w begins as u does.
After the last gadget the one path that spells a word is its encoding, and every prefix of a word has one path too.
States and arcs are kept as copies-of-copies with the time of each copy, which needs three numbers a merge instead of a
square of the vocabulary; the entries of the transition table are worked out as they are used, and remembered.

Encoding runs over the symbols of a pre-split word once: for each position the table gives the one label that ends a
path there. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm import common, presplit
from lorespark.llm.token_counts import PIECE_CHARS, REMEMBERED, library

#: Entries of the transition table that a worker remembers before it starts anew.
TABLE_ENTRIES = 2_000_000
START = -1
#: Bits of an id in a key of the table.
ID_BITS = 20


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself if printable, else from 0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    kept = set(keep)
    return [chr(b) if b in kept else chr(next(other)) for b in range(256)]


_BYTES = byte_symbols()
_TO_SYMBOL = {b: c for b, c in enumerate(_BYTES)}
_FROM_SYMBOL = {c: b for b, c in enumerate(_BYTES)}


class Automaton:
    """The compiled merges of one vocabulary. suffix: what the last symbol of a word carries."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        if max(vocab.values(), default=0) >= 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        self.suffix, self.labels = suffix, {i: s for s, i in vocab.items()}
        self.blocked: dict[tuple[int, int], int] = {}  # (state, arc) -> when gadget 1 took it out
        self.row_of: dict[int, tuple[int, int]] = {}  # state -> the state it was copied from, and when
        self.arc_of: dict[int, tuple[int, int]] = {}  # arc -> the arc it was added beside, and when
        for time, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if (u, v) in self.blocked or w in self.row_of:
                raise ValueError(f"merge {time} repeats a pair or a product")
            if any(x not in self.row_of and not self._base(s) for x, s in ((u, a), (v, b))):
                raise ValueError(f"merge {time} takes a symbol that is made later")
            self.blocked[u, v] = time
            self.row_of[w], self.arc_of[w] = (v, time), (u, time)
        self.table: dict[int, bool] = {}
        self.trie: dict = {}
        for s, i in vocab.items():
            if i in self.row_of or self._base(s):
                node = self.trie
                for c in self.symbols(s):
                    node = node.setdefault(c, {})
                node[None] = i

    def _base(self, s: str) -> bool:
        return len(s) == 1 or bool(self.suffix) and len(s) == 1 + len(self.suffix) and s.endswith(self.suffix)

    def symbols(self, s: str) -> list[str]:
        if self.suffix and s.endswith(self.suffix) and len(s) > len(self.suffix):
            s = s[: -len(self.suffix)]
            return [*s[:-1], s[-1] + self.suffix]
        return list(s)

    def allows(self, state: int, arc: int) -> bool:
        """Whether the state has the arc once all gadgets are applied: copies are followed back in time."""
        if state == START:
            return True
        key = state << ID_BITS | arc
        found = self.table.get(key)
        if found is None:
            if len(self.table) > TABLE_ENTRIES:
                self.table.clear()
            found = self.table[key] = self._resolve(state, arc)
        return found

    def _resolve(self, state: int, arc: int) -> bool:
        never = len(self.row_of) + 1
        until, same = never, False
        while True:
            taken = self.blocked.get((state, arc))
            # A copied row was taken before gadget 1 of its own merge, a copied arc after it.
            if taken is not None and (taken < until or taken == until and same):
                return False
            row, beside = self.row_of.get(state), self.arc_of.get(arc)
            if row is None and beside is None:
                return True
            if beside is None or row is not None and row[1] > beside[1]:
                (state, until), same = row, False
            else:
                (arc, until), same = beside, True

    def encode(self, word: list[str]) -> list[int]:
        """The labels of the one path that spells the symbols of a word."""
        n, trie, allows = len(word), self.trie, self.allows
        last: list[int | None] = [None] * (n + 1)
        begins = [0] * (n + 1)
        last[0] = START
        for j in range(n):
            state = last[j]
            if state is None:
                continue
            node = trie
            for i in range(j, n):
                node = node.get(word[i])
                if node is None:
                    break
                label = node.get(None)
                if label is not None and last[i + 1] is None and allows(state, label):
                    last[i + 1], begins[i + 1] = label, j
        if n and last[n] is None:
            raise ValueError(f"no path spells {word!r}")
        out = []
        while n:
            out.append(last[n])
            n = begins[n]
        return out[::-1]


class Codec:
    """Texts to ids by pre-splitting as the library does and running the automaton over each new word; ids to text by labels."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.machine = Automaton(model["vocab"], merges, self.suffix)
        self.tok, layout = library(path), presplit.layout(path)
        if layout["family"] is None:
            raise ValueError("the pre-splitting of this file isn't known")
        self.family, self.special, self.splitter = layout["family"], layout["special"], layout["splitter"]
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.labels = self.machine.labels | {i: s for s, i in self.special.items()}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.between = "" if self.byte_decoder else " "

    def _entry(self, ids: list[int]) -> tuple[bytes, str]:
        return array("I", ids).tobytes(), self.between.join(self.labels[i] for i in ids)

    def _word(self, mapped: str) -> tuple[bytes, str]:
        symbols = [*mapped[:-1], mapped[-1] + self.suffix] if self.suffix else list(mapped)
        if not self.machine.trie.keys() >= set(symbols):  # the automaton has no arc for what the vocabulary lacks
            return self._entry([x.id for x in self.tok.model.tokenize(mapped)])
        return self._entry(self.machine.encode(symbols))

    def _segment(self, text: str) -> list[tuple[bytes, str]]:
        words = presplit.pieces(text, self.family)
        known = self.known
        if words is None:  # the library normalises and splits; its pieces are mapped to symbols already
            if self.tok.normalizer is not None:
                text = self.tok.normalizer.normalize_str(text)
            return [self._word(m) for m, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        out = []
        for w in words:
            found = known.get(w)
            if found is None:
                found = self._word(w.encode().decode("latin-1").translate(_TO_SYMBOL))
                if len(w) <= PIECE_CHARS:
                    known[w] = found
            out.append(found)
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        """Little-endian unsigned 32-bit ids, and the decoded text of those ids."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        parts = self.splitter.split(text) if self.splitter is not None and "<" in text else [text]
        found = [x for k, p in enumerate(parts) if p for x in ([self._entry([self.special[p]])] if k % 2 else self._segment(p))]
        if not found:
            return b"", ""
        ids, labels = zip(*found)
        return b"".join(ids), self.text(self.between.join(labels))

    def text(self, labels: str) -> str:
        if not self.byte_decoder:
            return labels
        raw = bytearray()
        for c in labels:  # a special string may hold characters that stand for no byte
            raw += bytes((_FROM_SYMBOL[c],)) if c in _FROM_SYMBOL else c.encode()
        return raw.decode("utf-8", errors="replace")


_codecs: dict[str, Codec] = common.memory(__name__)


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded text of every row.

    Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded each; other columns are
    ignored; an empty table gives an empty table. tokenizer: a tokenizers.json that every executor has.
    """

    def run(doc_ids: list, texts: list) -> dict:
        ids, decoded = zip(*(codec(tokenizer).encode(x or "") for x in texts)) if texts else ((), ())
        return {"doc_id": doc_ids, "n_tokens": [len(x) // 4 for x in ids], "ids": list(ids), "decoded": list(decoded)}

    return common.map_text(docs, run, "doc_id long, n_tokens long, ids binary, decoded string", "doc_id", "text")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
