"""Full-text match and rank over lower-cased [a-z0-9]+ without stopwords, as they stand or with English plurals taken back."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark.functions.text import SENTENCE_STOPWORDS


@dataclass(frozen=True)
class Analyzer:
    """How texts and queries become lexemes: a form for each token, as a column expression and as a function of a string."""

    name: str
    column: Callable[[Column], Column]
    plain: Callable[[str], str]


# The endings of plurals, what they become, and after which letters they stay.
PLURALS = [("ies", "y", "ea"), ("es", "e", "aeo"), ("s", "", "us")]


def singular(word: Column) -> Column:
    """English plurals taken back: the first ending that fits decides."""
    out = None
    for ending, instead, but in PLURALS:
        fits, made = word.rlike(f"(^|[^{but}]){ending}$"), F.regexp_replace(word, f"{ending}$", instead)
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out.otherwise(word)


def _singular(word: str) -> str:
    for ending, instead, but in PLURALS:
        if re.search(f"(^|[^{but}]){ending}$", word):
            return word[: -len(ending)] + instead
    return word


PLAIN = Analyzer("plain", lambda w: w, lambda w: w)
ENGLISH = Analyzer("english", singular, _singular)


def query_lexemes(query: str, analyzer: Analyzer = PLAIN) -> list[str]:
    """The distinct lexemes of a query, on the driver: a query is a short string."""
    stop = set(SENTENCE_STOPWORDS)
    return sorted({analyzer.plain(w) for w in re.findall("[a-z0-9]+", query.lower()) if w not in stop})


def lexemes(text: Column, analyzer: Analyzer = PLAIN) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return found if analyzer is PLAIN else F.transform(found, lambda w: analyzer.column(w))


def matches(lex: Column, words: list[str]) -> Column:
    """Whether every lexeme of the query is there; a query without lexemes matches nothing."""
    if not words:
        return F.lit(False)
    out = F.array_contains(lex, words[0])
    for w in words[1:]:
        out = out & F.array_contains(lex, w)
    return out


def rank(lex: Column, words: list[str]) -> Column:
    """Occurrences of the query's lexemes over 1 + ln(lexemes of the text)."""
    hits = F.size(F.filter(lex, lambda w: w.isin(words))) if words else F.lit(0)
    return hits / (1.0 + F.ln(F.greatest(F.size(lex), F.lit(1)).cast("double")))
