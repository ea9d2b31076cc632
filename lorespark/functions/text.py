"""Text primitives as column expressions: normal form, content hash, chunks, sentences, word sets, n-gram concepts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a strip takes off: what Unicode calls so, and the separators 1C-1F.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: A chunk's soft limit in characters: a longer paragraph is not split.
CHUNK_CHARS = 1200

# Words that carry no meaning for sentence overlap.
SENTENCE_STOPWORDS = """
a an the is are was were be been being am i me my we our you your he she it its they them their this that these those
and or but if then else so because as at by for from in into of on off to with without about over under up down out
do does did doing done have has had having will would could should can may might must not no nor than too very just
also only any some all each every more most much many few such own same other another while
""".split()

# Words that no concept begins or ends with.
CONCEPT_STOPWORDS = """
a an and or but if the this that these those is are was were be been being am do does did have has had of in on at to
for with by from as it its he she they them we us you your i my me our their his her not no so than then too very just
also about into over out up down can could should would may might will shall any all some such only own same other
more most much many few each every thing things stuff via per
""".split()


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: a plain expression inside a lambda would be evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def normalize(c: Column) -> Column:
    """Lines with runs of blanks collapsed, stripped, empty ones dropped."""
    collapsed = lambda x: F.when(F.contains(x, F.lit("  ")) | F.contains(x, F.lit("\t")), F.regexp_replace(x, r"[ \t]+", " ")).otherwise(x)
    lines = F.transform(F.split(c, LINE_BREAK), lambda x: strip(collapsed(x)))
    return strip(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def content_hash(c: Column) -> Column:
    """Content address: sha256 of the normal form."""
    return F.sha2(normalize(c), 256)


def sections(c: Column) -> Column:
    """Pieces that begin at a Markdown heading; what stands before the first is one too."""
    return F.filter(F.split(c, r"(?md)(?=^#{1,6}\s)"), lambda x: strip(x) != "")


def chunks(c: Column, max_chars: int = CHUNK_CHARS) -> Column:
    """Paragraphs packed greedily up to max_chars, never across sections; a fold in one expression, without a shuffle."""
    state = "struct<done:array<string>,buf:string>"

    def pack(acc: Column, p: Column) -> Column:
        fits = F.length(acc["buf"]) + F.length(p) + 2 <= max_chars
        return (
            F.when(acc["buf"] == "", F.struct(acc["done"].alias("done"), p.alias("buf")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["buf"], F.lit("\n\n"), p).alias("buf")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["buf"])).alias("done"), p.alias("buf")))
            .cast(state)
        )

    def of_section(s: Column) -> Column:
        paras = F.filter(F.transform(F.split(s, r"\n\s*\n"), strip), lambda p: p != "")
        start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("buf")).cast(state)
        return F.aggregate(paras, start, pack, lambda a: F.when(a["buf"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["buf"]))))

    return F.flatten(F.transform(sections(c), of_section))


def sentences(c: Column) -> Column:
    """Split after . ! or ? before white space; empty ones dropped."""
    return F.filter(F.transform(F.split(strip(c), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def word_set(c: Column) -> Column:
    """Distinct words of two or more characters that carry meaning."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 1)), F.array(*map(F.lit, SENTENCE_STOPWORDS)))


def concepts(c: Column, low: int = 2, high: int = 4) -> Column:
    """n-grams of low to high tokens that neither begin nor end with a stopword, repetitions kept."""
    if low < 1 or high < low:
        raise ValueError("need 1 <= low <= high")

    def of_size(tokens: Column, free: Column, n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
        good = F.filter(starts, lambda i: F.element_at(free, i) & F.element_at(free, i + n - 1))
        return F.transform(good, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))

    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z][a-z0-9]+)"), F.lit(1))
    # Whether a token is a stopword is looked up once, in a hash set.
    free = lambda tokens: F.transform(tokens, lambda t: ~t.isin(CONCEPT_STOPWORDS))
    return let(found, lambda tokens: let(free(tokens), lambda f: F.concat(*(of_size(tokens, f, n) for n in range(low, high + 1)))))
