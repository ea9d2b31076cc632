"""Decay of confidence, entity kinds, handles and names, embeddings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.text import let, strip

# Half-life in seconds and floor of each tier; age in seconds and cutoff past which a row is stale.
TIERS = {"working": (6 * 3600, 0.10), "episodic": (14 * 86400, 0.30), "semantic": (180 * 86400, 0.60), "procedural": (365 * 86400, 0.70)}
STALE = {"working": (24 * 3600, 0.15), "episodic": (30 * 86400, 0.35)}
#: Authority without any policy, which is also the rank of a source in recall.
FLAT_AUTHORITY = {"human": 3.0, "system": 2.0, "agent": 1.0}
DIMENSION = 256
#: Texts that are embedded at a time, and tokens whose buckets a worker remembers, give or take a batch.
EMBED_ROWS, KNOWN_TOKENS = 256, 100_000


def choose(c: Column, table: dict, otherwise=None) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out if otherwise is None else out.otherwise(F.lit(otherwise))


def age_seconds(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1e6


def effective_confidence(confidence: Column, tier: Column, ts: Column, as_of: Column) -> Column:
    """Confidence halved once each half-life of its tier, never under the floor; a negative age counts as none."""
    half = choose(tier, {k: float(v[0]) for k, v in TIERS.items()})
    floor = choose(tier, {k: v[1] for k, v in TIERS.items()})
    return F.when(half.isNotNull(), F.greatest(floor, confidence.cast("double") * F.pow(F.lit(0.5), F.greatest(age_seconds(ts, as_of), F.lit(0.0)) / half)))


def is_stale(confidence: Column, tier: Column, ts: Column, as_of: Column) -> Column:
    """Older than its tier's limit and decayed under its cutoff; other tiers never are."""
    limit, cutoff = choose(tier, {k: float(v[0]) for k, v in STALE.items()}), choose(tier, {k: v[1] for k, v in STALE.items()})
    return F.coalesce((age_seconds(ts, as_of) > limit) & (effective_confidence(confidence, tier, ts, as_of) < cutoff), F.lit(False))


def entity_kind(key: Column) -> Column:
    """The kind of an entity by the prefix of its key, for topics by what the rest holds."""
    # Prefixes and topic words, in the order in which they are tried.
    k = F.lower(F.coalesce(key, F.lit("")))
    prefix = F.substring_index(k, ":", 1)
    after = F.when(F.instr(k, ":") > 0, F.substring(k, F.instr(k, ":") + 1, F.length(k))).otherwise(F.lit(""))
    topic = lambda *words: (prefix == "topic") & after.rlike("|".join(words))
    return (
        F.when(prefix == "security", "security")
        .when(prefix.isin("engineering", "eng"), "engineering")
        .when(prefix.isin("sales", "account"), "sales")
        .when(prefix == "hr", "hr")
        .when(prefix == "finance", "finance")
        .when(prefix == "person", "people")
        .when(topic("layoff", "hr", "hiring", "firing"), "hr")
        .when(topic("security", "incident", "breach", "vuln"), "security")
        .when(topic("revenue", "pricing", "finance", "budget"), "finance")
        .otherwise("general")
    )


def comparable(c: Column) -> Column:
    """The form in which names and handles are compared: lower-cased, stripped, empty for null."""
    return strip(F.lower(F.coalesce(c, F.lit(""))))


def closeness(x: Column, y: Column) -> Column:
    """1 - edit distance / longer length of two strings in comparable form; 0 if either is empty."""
    return F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def similarity(a: Column, b: Column) -> Column:
    return closeness(comparable(a), comparable(b))


def rounded(x: Column, digits: int) -> Column:
    """F.round of doubles without a decimal for each: only what is near a tie, or very large, is left to it.

    A whole number over a power of ten is the double nearest to that decimal, as F.round gives it. x is spelt out several
    times: let it be a column of its own.
    """
    scaled = x * float(10**digits)
    whole = F.floor(scaled + 0.5)
    return F.when((F.abs(scaled) < 1e12) & (F.abs(scaled - whole) < 0.499), whole / float(10**digits)).otherwise(F.round(x, digits))


def looks_like_email(c: Column) -> Column:
    return (F.instr(c, "@") > 0) & (F.instr(F.substring(c, F.instr(c, "@") + 1, F.length(c)), ".") > 0)


def local_part(c: Column) -> Column:
    return F.lower(F.substring_index(F.regexp_replace(strip(c), "^@+", ""), "@", 1))


def entity_slug(kind: Column, name: Column) -> Column:
    """kind:slug, the slug of letters, digits and hyphens."""
    slug = F.regexp_replace(F.regexp_replace(comparable(name), r"[^\p{L}\p{N}]", "-"), "^-+|-+$", "")
    return F.concat(kind, F.lit(":"), F.when(slug == "", "alias").otherwise(slug))


def embed_md5(text: Column, dim: int = DIMENSION) -> Column:
    """Unit vector of token counts in dim buckets, each token's bucket from its md5; all built-in, zeros without tokens."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    bucket = F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim).cast("int"))
    # Each bucket is added once and all are sorted: a bucket's count is the length of its run, less one. Linear but for the sort.
    ends = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda j: F.coalesce(F.get(s, j - 1) != F.get(s, j), F.lit(True)))
    length = lambda e: F.transform(e, lambda x, i: (x - F.coalesce(F.get(e, i - 1), F.lit(0)) - 1).cast("double"))
    count = lambda bs: let(let(F.sort_array(F.concat(bs, F.sequence(F.lit(0), F.lit(dim - 1)))), ends), length)
    size = lambda xs: F.sqrt(F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x * x))
    unit = lambda xs: let(size(xs), lambda n: F.transform(xs, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))
    return let(bucket, lambda bs: let(count(bs), unit))


def _embed_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, int] = {}

    def one(text: str | None) -> np.ndarray:
        out = np.zeros(DIMENSION)
        for t in re.findall("[a-z0-9]+", (text or "").lower()):
            if t not in known:
                known[t] = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % DIMENSION
            out[known[t]] += 1
        n = np.sqrt(out @ out)
        return (out / n if n else out).astype(np.float32)

    for texts in batches:
        if len(known) > KNOWN_TOKENS:
            known.clear()
        yield texts.map(one)


def embed_local(text: Column) -> Column:
    """Unit vector of token counts in DIMENSION buckets, each token's bucket from its 8-byte blake2b.

    A worker holds a batch of texts at a time and the buckets of so many tokens: see short_batches.
    """
    return F.pandas_udf(_embed_batches, "array<float>")(text)


def short_batches(spark: SparkSession) -> None:
    """Bounds the texts that a Python worker holds at a time; a smaller setting of the caller's stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > EMBED_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(EMBED_ROWS))


@dataclass(frozen=True)
class Provider:
    """What makes embeddings: a name, the dimension, and a column expression from text to array<float>."""

    name: str
    dimension: int
    embed: Callable[[Column], Column]

    @property
    def model_name(self) -> str:
        return f"{self.name}:dim{self.dimension}"


PROVIDERS = {
    "local": Provider("local", DIMENSION, embed_local),
    "md5": Provider("md5", DIMENSION, lambda text: embed_md5(text, DIMENSION).cast("array<float>")),
}


def provider(name: str = "local") -> Provider:
    """A registered provider; remote ones are added to PROVIDERS by who has a client for them."""
    if name not in PROVIDERS:
        raise ValueError(f"no embedding provider {name!r}; known: {sorted(PROVIDERS)}")
    return PROVIDERS[name]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
