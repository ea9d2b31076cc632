import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, version long, kept boolean, node long, label string, n_words long, rest string, bucket int, ord long, _version long, keep_bitmap binary"

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards hex bold pumpkins near quiet misty lakes".split()


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls, empty, blank, one-word and very long texts, ties, repeated rows and near copies."""
    base = sentence(1, 60)
    near = base.replace(base.split()[30], "changed", 1)
    far = " ".join(base.split()[:30] + sentence(2, 30).split())
    long = "\n".join(sentence(k, 40) for k in range(100, 400))
    texts = [
        (1, base), (2, base.upper()), (3, near), (4, far), (5, None), (6, ""), (7, " \t\n "), (8, "Word"), (9, "word"), (10, long), (11, long + " end"),
        (12, "été çà ÉTÉ İstanbul ΣΣ naïve"), (13, "漢字 かな 😀 <|endoftext|> x"), (14, "a\n\nb\n"), (15, "don't 've 12²³ !!\r\n\x1c x"), (None, base), (None, None), (16, sentence(3, 4)), (16, sentence(3, 4)), (16, sentence(4, 9)),
    ]
    texts += [(20 + k, f"unique {sentence(50 + k, 12)}\n  Shared LINE here \nlast {k}") for k in range(11)]
    texts += [(40 + k, "shared twice\nshared twice\n" + sentence(70 + k, 5)) for k in range(5)]
    return texts


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, None if k % 5 == 0 else ("fr" if k % 2 else "en"), None if k % 3 else "src", None, "x", 1, None, 2, None, 3, "r", 4, 5, 6, None) for k, (i, t) in enumerate(edge_rows())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark_rows():
    base = sentence(1, 60).split()
    return [(1, " ".join(base[5:30])), (2, sentence(3, 4)), (3, "Word"), (4, None), (5, ""), (None, base[0]), (10, sentence(999, 30)), (1, " ".join(base[5:30])), (7, " ".join(base[40:52]).upper())]


@pytest.fixture(scope="session")
def benchmark(spark, benchmark_rows):
    return spark.createDataFrame(benchmark_rows, "item_id long, text string").cache()
