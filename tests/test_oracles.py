"""Every registered query against its DuckDB SQL at the smallest scale."""

import datetime
import hashlib
import math
import os
import re
from collections import Counter

import duckdb
import pytest

from lorespark.functions import scrub
from lorespark.plans import registry


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return str(v)[:26] if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[k]) for k in at) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=repr) == want


def test_only_what_sql_cannot_express_has_none(spark, sf, duck):
    """Luhn-checked replacement and blake2b: each against plain Python over the whole table."""
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"local_embed", "scrub_all_pii"}
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    want = {}
    for i, text in texts.items():
        n = Counter(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % 256 for w in re.findall("[a-z0-9]+", text.lower()))
        size = math.sqrt(sum(x * x for x in n.values()))
        want |= {(i, b): x / size for b, x in n.items()}
    got = {(r.seq, r.bucket): r.x for r in registry.QUERIES["local_embed"](spark, sf).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    done = {r.seq: (r.text_sha256, r.n_redactions) for r in registry.QUERIES["scrub_all_pii"](spark, sf).collect()}
    assert done == {i: plain_scrub(t) for i, t in items_with_secrets(texts)}


def items_with_secrets(texts):
    for i, text in texts.items():
        md5 = hashlib.md5(str(i).encode()).hexdigest()
        yield i, text + (f" key AKIA{md5[:16].upper()}" if i % 17 == 0 else "") + (f" token ghp_{md5}abcd" if i % 19 == 0 else "") + (f" id 123-45-{i % 10000:04d}" if i % 23 == 0 else "")


def plain_scrub(text):
    total = 0
    for kind, pattern in scrub.SECRETS:
        text, n = re.subn(pattern, f"[REDACTED:{kind}]", text)
        total += n
    for x in re.findall(scrub.CARD, text):
        digits = [int(c) for c in x if c.isdigit()][::-1]
        if 13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0:
            text, total = text.replace(x, "[REDACTED:credit_card]"), total + 1
    for kind, pattern in (("ssn", scrub.SSN), ("email", scrub.EMAIL)):
        text, n = re.subn(pattern, f"[REDACTED:{kind}]", text)
        total += n
    return hashlib.sha256(text.encode()).hexdigest(), total


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "score", "arms"]
    assert set(e.oracle_sql()) <= set(e.queries())
