"""The corpus queries with their production parameters, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import bpe_automaton as ba
from lorespark.llm import decontamination as dc
from lorespark.llm import language_id as li
from lorespark.llm import license_scan as ls
from lorespark.llm import line_dedup as ld
from lorespark.llm import minhash as mh
from lorespark.llm import pseudo_likelihood as pl
from lorespark.llm import token_counts as tc
from lorespark.llm import token_files as tf
from lorespark.llm import winnowing as wn
from lorespark.llm.common import documents


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mh.near_duplicates(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tc.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.summary(dc.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ba.digests(ba.encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.summary(ls.scan(documents(spark, sf_dir)))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.pseudo_likelihood(documents(spark, sf_dir))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.summary(wn.fingerprints(documents(spark, sf_dir)))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ld.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.identify(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_decontamination": op4_decontamination,
    "op5_bpe_automaton": op5_bpe_automaton,
    "op6_pseudo_likelihood": op6_pseudo_likelihood,
    "op7_winnowing": op7_winnowing,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_token_files": op10_token_files,
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_minhash": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, s FROM (
            SELECT doc_id, unnest([array_to_string(w[k : k + 4], ' ') FOR k IN range(1, greatest(len(w) - 4, 1) + 1)]) AS s
            FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
                   FROM sh x JOIN sh y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
                  WHERE 100 * c >= 75 * (na.n + nb.n - c)),
        near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN near l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""",
    "op4_decontamination": f"""
        WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
        b AS (SELECT cast(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        win AS (SELECT DISTINCT item_id, len(v) AS size, array_to_string(v, ' ') AS win
                FROM (SELECT item_id, unnest([w[s : s + 9] FOR s IN range(1, greatest(len(w) - 9, 1) + 1)]) AS v
                      FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM win),
        runs AS (SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS win
                 FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes)),
        hits AS (SELECT doc_id, r.s, r.size, item_id FROM runs r JOIN win USING (size, win)),
        places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                   FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, pos, line, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
            FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
                  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
        gone AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(g.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
        FROM lines LEFT JOIN gone g USING (key) GROUP BY doc_id""",
}
