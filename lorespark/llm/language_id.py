"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed counts of the 1- to 3-grams of the lower-cased text, as log(1 + count) * idf, scaled to length 1.
Document frequencies cover every labelled document of the training fold. The weights are trained by
follow-the-regularised-leader with L1 and L2 penalties on a bounded sample, SAMPLE_PER_LANG labelled documents of each
language with the smallest hashes of doc_id and text; a fifth of these only set the temperature of the softmax and
the score under which a language counts as unknown. What comes to
the driver is bounded by the hashing dimension and the sample.

Training takes documents with a lang whose crc32(doc_id as text) mod 5 is not 0 (a null doc_id counts as the empty
text); prediction sees the text alone. Null texts and texts without a letter are `und` with score 0, as is every text
where there is nothing to learn from. Repeated rows get equal predictions; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.llm import common

BITS = 14
DIM = 1 << BITS
SAMPLE_PER_LANG = 600
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
UND = "und"
#: Odd multipliers of the n-gram hash, by place.
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def ngram_ids(text: str) -> np.ndarray:
    """The hashed 1-, 2- and 3-grams of the lower-cased text with a space at both ends."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", errors="replace"), "<u4")
    out, total = [], np.zeros(len(c), np.uint32)
    for n, m in enumerate(_MULTIPLIERS):
        if len(c) > n:
            total = total[: len(c) - n] + c[n:] * np.uint32(m)
            mixed = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            out.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate(out)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features that occur, ascending, and how often."""
    n = np.bincount(ngram_ids(text), minlength=DIM)
    at = np.flatnonzero(n)
    return at, n[at]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each feature occurs, and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only(__name__)
        total, n = np.zeros(DIM + 1, np.int64), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total[:DIM][np.unique(ngram_ids(x))] += 1
                n += 1
        total[DIM] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["feature", "n"])

    common.short_batches(texts.sparkSession)
    got = texts.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # DIM + 1 rows at most
    out = np.zeros(DIM + 1, np.int64)
    for f, n in got:
        out[f] = n
    return out[:DIM], int(out[DIM])


def labelled_sample(train: DataFrame, per_lang: int) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """lang, hash, features and counts of the documents of each language with the smallest hashes."""
    hashed = train.select("lang", "text", F.xxhash64(F.coalesce("doc_id", F.lit(0)), "text", F.lit(11)).alias("h"))
    # Hashes are uniform: a share of their range that should hold twice the sample and more of a language leaves few rows
    # to be ranked, and the texts of all others stay where they are.
    sizes = common.materialize(train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-sizes")
    share = F.least(F.lit(1.0), F.lit(2.0 * per_lang + 200) / F.col("n"))
    near = hashed.join(common.checked_broadcast(sizes, 128), "lang").where(F.col("h").cast("double") / F.lit(2.0**64) + 0.5 <= share)
    chosen = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= per_lang)

    def features(langs: list, hashes: list, texts: list) -> dict:
        at, n = zip(*map(counts, texts)) if texts else ((), ())
        return {"lang": langs, "h": hashes, "at": [x.astype("<u2").tobytes() for x in at], "n": [x.astype("<f4").tobytes() for x in n]}

    rows = common.map_text(chosen, features, "lang string, h long, at binary, n binary", "lang", "h", "text").collect()
    return [(r[0], r[1], np.frombuffer(r[2], "<u2").astype(np.int64), np.frombuffer(r[3], "<f4")) for r in sorted(rows, key=lambda r: (r[1], r[0], bytes(r[2])))]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    #: The least score with which keep_identified takes a language for known.
    floor: float = 0.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n) * self.idf[at]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.vector(at, n) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return UND, 0.0
        p = softmax(self.logits(*counts(text)) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_ftrl(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int) -> None:
    """Follow-the-regularised-leader, one document at a time, each coordinate with its own rate."""
    k = len(model.langs)
    z, n = np.zeros((DIM, k)), np.zeros((DIM, k))
    zb, nb = np.zeros(k), np.zeros(k)
    leader = lambda z, n, l1, l2: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))
    for _ in range(epochs):
        for label, at, x in rows:
            w, b = leader(z[at], n[at], L1, L2), leader(zb, nb, 0.0, L2)
            error = softmax(x @ w + b)
            error[label] -= 1
            g = x[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            zb += error - (np.sqrt(nb + error**2) - np.sqrt(nb)) / ALPHA * b
            nb += error**2
    model.weights, model.bias = leader(z, n, L1, L2).astype(np.float32), leader(zb, nb, 0.0, L2).astype(np.float32)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least loss, by golden-section search over its logarithm.

    The true language's target is (n + 1) / (n + k), as if each had been seen once more with each document, so that a
    sample without an error doesn't ask for certainty.
    """
    n, k = logits.shape
    target = np.full((n, k), 1 / (n + k))
    target[np.arange(n), labels] += n / (n + k)

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(1, keepdims=True)
        return float(((np.log(np.exp(x).sum(1, keepdims=True)) - x) * target).sum(1).mean())

    a, b, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def score_floor(logits: np.ndarray, labels: np.ndarray) -> float:
    """Halfway between chance and the lowest winning score of a document that is predicted right, so none of these is rejected."""
    p = np.array([softmax(x) for x in logits])
    right = p.argmax(1) == labels
    return float((1 / p.shape[1] + p.max(1)[right].min()) / 2) if right.any() else 0.0


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, epochs: int = EPOCHS) -> Model:
    known = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = document_frequencies(known)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    sample = labelled_sample(known, per_lang)
    model = Model(sorted({r[0] for r in sample}), idf, np.zeros((DIM, 0), np.float32), np.zeros(0, np.float32), 1.0)
    if not sample:
        return model
    number = {x: k for k, x in enumerate(model.langs)}
    rows = [(number[lang], at, model.vector(at, c)) for lang, _, at, c in sample]
    test = [k for k in range(len(rows)) if k % 5 == 4]
    fit_ftrl(model, [r for k, r in enumerate(rows) if k % 5 != 4], epochs)
    if test and len(model.langs) > 1:
        logits = np.array([rows[k][2] @ model.weights[rows[k][1]] + model.bias for k in test], np.float64)
        labels = np.array([rows[k][0] for k in test])
        model.temperature = fit_temperature(logits, labels)
        model.floor = score_floor(logits / model.temperature, labels)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights for each learned language

    def run(ids: list, held: list, texts: list) -> dict:
        found = [shared.value.predict(x) for x in texts]
        return {"doc_id": ids, "held_out": held, "lang_pred": [x for x, _ in found], "score": [p for _, p in found]}

    return common.map_text(docs.withColumn("_held_out", held_out(F.col("doc_id"))), run, "doc_id long, held_out boolean, lang_pred string, score double", "doc_id", "_held_out", "text")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))


def keep_identified(docs: DataFrame, model: Model, least: float | None = None) -> DataFrame:
    """The rows of docs whose language is known with a score of at least `least` (the model's floor), with all their columns."""
    least = model.floor if least is None else least
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only(__name__)
        for batch in batches:
            found = [shared.value.predict(x) for x in batch.column(text).to_pylist()]
            yield batch.filter(pa.array([x != UND and p >= least for x, p in found], pa.bool_()))

    common.short_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
