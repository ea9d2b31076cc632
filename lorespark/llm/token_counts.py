"""Token counts of whole texts, as the tokenizers library gives them.

Huge documents are encoded in overlapping chunks with offsets; neighbours are spliced where both have a token boundary
that is a proven stable cut of the text (presplit.stable_cut), and the overlap widens until there is one, at the worst
to the whole text. Other documents are split into pieces whose counts are remembered; the library counts each new one.
A text that only the library can split is given to it whole.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each. Other columns are ignored. An empty
table gives an empty table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from lorespark.llm import common, presplit

#: Documents over CHUNK_CHARS characters are huge: one in fourteen of the check tables', with two fifths of all characters.
CHUNK_CHARS = 1 << 13
OVERLAP_CHARS = 1 << 8
#: Pieces remembered by a worker, past which the memory starts anew, and the longest one: together they bound its bytes.
REMEMBERED, PIECE_CHARS = 500_000, 64

_counters: dict[str, PieceCounter] = common.memory(__name__)


def library(path: str):
    """The library's tokenizer with truncation and padding off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker for each core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def chunked_count(text: str, tok, special: list[str], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of text, without encoding more than a chunk and its overlap at a time where stable cuts are found."""
    total, start, known = 0, 0, None  # known: the encoding that begins at start
    while True:
        end = min(len(text), start + chunk)
        width = overlap
        while True:
            stop = min(len(text), end + width)
            left = tok.encode(text[start:stop], add_special_tokens=False) if known is None or known[1] != stop else known[0]
            if stop == len(text) and (end == stop or width >= len(text)):
                return total + len(left.ids)
            right = tok.encode(text[end:stop], add_special_tokens=False)  # of the next chunk, what overlaps
            starts = {a + end: k for k, (a, _) in reversed(list(enumerate(right.offsets))) if a + end < stop}
            cut = next(((k, p) for k, (a, _) in enumerate(left.offsets) if (p := a + start) > end and p in starts and presplit.stable_cut(text, p, special) and (k == 0 or left.offsets[k - 1][1] + start <= p)), None)
            if cut is not None:
                total += cut[0]
                start, known = cut[1], None
                break
            if stop == len(text):  # nothing to splice at: the rest is one stretch
                return total + len(left.ids)
            width *= 4


class PieceCounter:
    """Counts tokens by pieces, remembering each piece's count."""

    def __init__(self, path: str):
        self.tok, spec = library(path), presplit.layout(path)
        self.family, self.special, self.splitter = spec["family"], list(spec["special"]), spec["splitter"]
        self.known: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [self._pieces(x or "") for x in texts]
        new, known = list({w for x in split if isinstance(x, list) for w in x if w not in self.known}), self.known
        long: dict[str, int] = {}
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                (known if len(w) <= PIECE_CHARS else long)[w] = len(e.ids)
        count = known.__getitem__ if not long else lambda w: long[w] if w in long else known[w]
        return [sum(map(count, x)) if isinstance(x, list) else x for x in split]

    def _pieces(self, text: str) -> list[str] | int:
        if self.family is None:
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        if len(text) > CHUNK_CHARS:
            return chunked_count(text, self.tok, self.special)
        if self.splitter is not None and self.splitter.search(text):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        found = presplit.pieces(text, self.family)
        return len(self.tok.encode(text, add_special_tokens=False).ids) if found is None else found


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def sentencepiece_counts(texts: list[str | None], path: str) -> list[int]:
    import sentencepiece

    key = f"sp:{path}"
    if key not in _counters:
        _counters[key] = sentencepiece.SentencePieceProcessor(model_file=path)
    return [len(x) for x in _counters[key].encode([t or "" for t in texts], num_threads=1)]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. tokenizer: a .json or .model file that every executor has."""

    def run(ids: list, texts: list) -> dict:
        n = sentencepiece_counts(texts, tokenizer) if tokenizer.endswith(".model") else counter(tokenizer).count(texts)
        return {"doc_id": ids, "n_bytes": [len((x or "").encode()) for x in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return common.map_text(docs, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", "doc_id", "text")
