r"""Licence notices in whole texts: exact base phrases, and a fuzzy search for short notices.

Base places are where the words of a base phrase stand consecutively. The fuzzy search allows each notice a number of
edits. A notice of e edits is cut into e + 1 pieces; by the pigeonhole principle one of them stands unchanged in every
occurrence, so an automaton over all pieces finds where one may lie, and the regex library's bounded-error matching
verifies the place and gives its span and edits. Matches begin and end at words.

Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z is lower-cased. Null and empty texts have no words, no labels and
score 0. Repeated rows are scanned each; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm import common

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices of the fuzzy search: text, label, edits allowed.
NOTICES = [
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("apache license", "apache", 2),
    ("mit license", "mit", 1),
    ("bsd license", "bsd", 1),
    ("isc license", "isc", 1),
    ("mozilla public license", "mpl", 3),
    ("eclipse public license", "epl", 3),
    ("boost software license", "bsl", 3),
    ("creative commons attribution", "cc-by", 3),
    ("permission is hereby granted free of charge", "mit", 5),
    ("redistribution and use in source and binary forms", "bsd", 5),
]


def word_table() -> bytes:
    """For bytes.translate: A-Z to a-z, every byte that is in no word to a space."""
    return bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


_TABLE = word_table()


def pigeonhole(phrase: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces that make up the phrase, with where they begin."""
    bounds = [len(phrase) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(bounds, bounds[1:])]


@lru_cache(maxsize=4)
def _machine(notices: tuple[tuple[str, str, int], ...]):
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    for k, (phrase, _, edits) in enumerate(notices):
        for at, piece in pigeonhole(phrase, edits):
            seeds.setdefault(piece, []).append((k, at))
    found = ahocorasick.Automaton()
    for piece, places in seeds.items():
        found.add_word(piece, (len(piece), places))
    found.make_automaton()
    return found, [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(p, literal_spaces=True)}){{e<={e}}}(?![^ ])") for p, _, e in notices]


def fuzzy_spans(words: str, notices: tuple[tuple[str, str, int], ...]) -> list[tuple[str, int, int, int, float]]:
    """label, first character, end, edits, likeness of each match in words joined by single spaces, with a space at both ends."""
    machine, patterns = _machine(notices)
    tried: set[tuple[int, int, int]] = set()
    spans: dict[tuple[int, int, int], int] = {}
    for end, (size, places) in machine.iter(words):
        for k, at in places:
            phrase, _, edits = notices[k]
            begin = end - size + 1 - at
            low = max(0, words.rfind(" ", 0, max(0, begin - edits) + 1))
            high = words.find(" ", min(len(words) - 1, begin + len(phrase) + edits))
            high = len(words) if high < 0 else high
            if (k, low, high) in tried:
                continue
            tried.add((k, low, high))
            for m in patterns[k].finditer(words, low, high, overlapped=True):
                if m.group().strip():
                    spans[k, m.start(), m.end()] = sum(m.fuzzy_counts)
    return [(notices[k][1], a, b, e, 1 - e / len(notices[k][0])) for (k, a, b), e in sorted(spans.items(), key=lambda x: (x[0][1], x[0][2], x[0][0]))]


def base_places(words: bytes) -> list[tuple[int, str]]:
    """First byte and label of each base place in words joined by single spaces, with a space at both ends."""
    out = []
    for phrase, label in BASE.items():
        needle = b" " + phrase.encode() + b" "
        at = words.find(needle)
        while at >= 0:
            out.append((at, label))
            at = words.find(needle, at + 1)
    return sorted(out)


def scan_text(text: str | None, notices: tuple[tuple[str, str, int], ...]) -> dict:
    found = (text or "").encode().translate(_TABLE).split()
    words = b" " + b" ".join(found) + b" "
    base = base_places(words)
    at = np.searchsorted(np.flatnonzero(np.frombuffer(words, np.uint8) == 32), [p for p, _ in base]).tolist()
    plain = words.decode()
    fuzzy = fuzzy_spans(plain, notices)
    spaces = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le"), "<u4") == 32) if fuzzy else np.zeros(0, np.int64)
    before = lambda p: int(np.searchsorted(spaces, p)) - 1
    return {
        "n_words": len(found),
        "n_base": len(base),
        "first_word": min(at, default=None),
        "last_word": max(at, default=None),
        "base_labels": ",".join(sorted({x for _, x in base})),
        "labels": ",".join(sorted({x for _, x in base} | {x[0] for x in fuzzy})),
        "score": 1.0 if base else max((x[4] for x in fuzzy), default=0.0),
        "spans": [{"label": x, "first_word": before(a), "last_word": before(b), "edits": e} for x, a, b, e, _ in fuzzy],
    }


def scan(docs: DataFrame, notices: list[tuple[str, str, int]] = NOTICES) -> DataFrame:
    """Per row: doc_id, the base counts and labels, all labels, score, and the spans of fuzzy matches in words."""
    fixed = tuple(notices)

    def run(ids: list, texts: list) -> dict:
        rows = [scan_text(x, fixed) for x in texts]
        return {"doc_id": ids} | {k: [r[k] for r in rows] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}

    return common.map_text(docs, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>", "doc_id", "text")


def summary(scanned: DataFrame) -> DataFrame:
    return scanned.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")
