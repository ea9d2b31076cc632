r"""Document fingerprints by winnowing, in built-in functions only.

The rolling hash of K characters (code points, as they stand) is a polynomial modulo a prime, built by doubling: the hash
of 2n characters is that of n times a power of the base, plus that of the next n. Of every WINDOW neighbouring hashes the
smallest is kept, the rightmost of equal ones, with its position; so two texts that share K + WINDOW - 1 characters in a
row, spaces or none between them, share a fingerprint. A text of fewer characters than K has the one hash of all of them;
fewer hashes than WINDOW make one window.

A window's minimum depends on its K + WINDOW - 1 characters alone. So the edited text keeps the minima of its untouched
head, has those of the next document for what it took of it, moved to their new positions, and only windows that reach
over the seam between the two are worked out anew.

Null counts as empty; an empty text has an empty fingerprint, and two empty ones are alike. Rows that repeat a doc_id are
taken in the order of their texts; a null doc_id comes first. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.llm import ordered

K, WINDOW = 16, 32
PRIME = (1 << 31) - 1
BASE = 1_000_003
_SHIFT = 1 << 31


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def with_minima(df: DataFrame, text: str, name: str, k: int = K, window: int = WINDOW, start: Column | None = None) -> DataFrame:
    """Adds name: array<long>, for each window its least hash * 2^31 + (2^31 - 1 - position). k, window: powers of two.

    start: the position of the first character, where text is the rest of a longer one; past 0, a rest without a whole
    window has none.
    """
    if any(x & x - 1 or x < 1 for x in (k, window)):
        raise ValueError("k and window must be powers of two")
    at, head = start if start is not None else F.lit(0), f"_{name}_"
    none = lambda of: F.expr(f"cast(array() as array<{of}>)")

    def apart(column: str, value: Column, f) -> None:
        """Adds column: f of value. An array made within the projection of a lambda function is interpreted as well; asked for
        twice, it has a projection of its own, which is compiled."""
        nonlocal df
        df = df.withColumn(f"{column}_of", value)
        df = df.withColumn(column, F.when(F.size(f"{column}_of") >= 0, f(F.col(f"{column}_of"))))

    def doubled(now: str, by: str, step: int, f) -> None:
        """f of each element and the one step places on; the last ones have none, and are cut off by first."""
        apart(by, F.slice(F.col(now), F.lit(step + 1), F.size(now)), lambda after: F.zip_with(F.col(now), after, f))

    first = lambda x, less: F.slice(F.col(x), F.lit(1), F.greatest(F.size(x) - F.lit(less), F.lit(0)))

    chars = F.when(F.length(text) > 0, F.split(F.col(text), "")).otherwise(none("string"))
    short = F.when((F.length(text) > 0) & (at == 0), F.greatest(F.lit(k) - F.length(text), F.lit(0))).otherwise(0)
    now, step = f"{head}h1", 1
    codes = F.transform(chars, lambda c: F.xxhash64(c).bitwiseAND(_long(PRIME - 1)))
    df = df.withColumn(now, F.when(short > 0, F.concat(codes, F.array_repeat(_long(0), short))).otherwise(codes))
    while step < k:
        power = _long(pow(BASE, step, PRIME))
        doubled(now, f"{head}h{step * 2}", step, lambda a, b: (a * power + b) % _long(PRIME))
        now, step = f"{head}h{step * 2}", step * 2
    v = f"{head}v"
    top = _long(_SHIFT - 1) - at
    apart(v, first(now, k - 1), lambda h: F.transform(h, lambda x, i: F.shiftleft(x, 31).bitwiseOR(top - i)))
    now, step = v, 1
    while step < window:  # minima of 1, 2, 4, ... neighbours
        doubled(now, f"{head}m{step * 2}", step, lambda a, b: F.when(b < a, b).otherwise(a))
        now, step = f"{head}m{step * 2}", step * 2
    few = F.when((F.size(v) > 0) & (at == 0), F.array(F.array_min(v))).otherwise(none("bigint"))
    df = df.withColumn(name, F.when(F.size(v) >= window, first(now, window - 1)).otherwise(few))
    return df.drop(*(c for c in df.columns if c.startswith(head)))


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds name: the distinct minima of a text, in the order of positions."""
    return with_minima(df, text, f"{name}_all", k, window).withColumn(name, F.array_distinct(f"{name}_all")).drop(f"{name}_all")


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 31)))


def text_form(fingerprint: Column) -> Column:
    """hash:position in hexadecimal and decimal, space-separated."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit(":"), (F.lit(_SHIFT - 1) - F.pmod(x, F.lit(_SHIFT))).cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """The Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    both, shared = F.col(f"_n_{a}") + F.col(f"_n_{b}"), F.size(F.array_intersect(F.col(a), F.col(b)))
    return F.when(both == 0, F.lit(1.0)).otherwise(shared / (both - shared))


def neighbours(docs: DataFrame) -> DataFrame:
    """ord, bucket, text of every row, dealt by buckets of doc_id, with the first row after each bucket as a ghost in it."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), ordered.order_key().alias("ord"))
    cuts = ordered.bounds(docs, ordered.order_key(), buckets)
    placed = rows.withColumn("bucket", ordered.bucket(F.col("ord"), cuts))
    # A row for each bucket, whose number is fixed above, comes to the driver.
    firsts = sorted(placed.groupBy("bucket").agg(F.min("ord").alias("ord")).collect())
    if not firsts:
        return placed.withColumn("ghost", F.lit(False))
    as_sql = lambda x: f"{x}L" if x > ordered.LOWEST else "-9223372036854775807L - 1L"
    after = [(o, firsts[k - 1][0], o) for k, (_, o) in enumerate(firsts) if k] + [(firsts[0][1], firsts[-1][0], ordered.HIGHEST)]
    heads = spark.range(1).select(F.expr("inline(array(" + ",".join(f"named_struct('ord', {as_sql(o)}, 'bucket', {b}, 'place', {as_sql(p)})" for o, b, p in after) + "))"))
    first_text = rows.join(F.broadcast(heads.select("ord").distinct()), "ord", "left_semi").groupBy("ord").agg(F.min("text").alias("text"))
    ghosts = first_text.join(F.broadcast(heads), "ord").select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("place").alias("ord"), "bucket", F.lit(True).alias("ghost"))
    return placed.withColumn("ghost", F.lit(False)).unionByName(ghosts).repartition("bucket")


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_chars, the text's fingerprint and the edited text's, their likeness and that to the next text's.

    The edited text has the last quarter of the code points replaced by the first as many of the next document by
    doc_id; after the last comes the first.
    """
    order = Window.partitionBy("bucket").orderBy("ord", "ghost", "text")
    reach = k + window - 1
    n = F.length("text")
    kept = n - F.floor(n / 4).cast("int")
    # Windows whose characters all lie in the kept part: their minima are the text's own, up to that of the last of them.
    same = F.greatest(kept - F.lit(reach - 1), F.lit(0))
    own = with_minima(neighbours(docs), "text", "all", k, window)
    own = own.withColumns({"fp": F.array_distinct("all"), "last": F.get("all", same - 1)}).drop("all")
    led = own.withColumns({"next_text": F.coalesce(F.lead("text").over(order), F.lit("")), "next_fp": F.lead("fp").over(order)}).where(~F.col("ghost"))
    led = led.withColumns({"kept": kept, "same": same, "taken": F.substring("next_text", F.lit(1), n - kept)})
    m = F.length("taken")
    # The seam, and after it the last whole window of what was taken, which tells how many minima of the next text to take.
    whole = m >= reach
    seam = F.concat(F.substring("text", F.col("same") + 1, F.col("kept") - F.col("same")), F.substring("taken", F.lit(1), F.lit(reach - 1)))
    end = F.when(whole, F.substring("taken", m - F.lit(reach - 1), F.lit(reach))).otherwise(F.lit(""))
    edited = led.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.concat(F.substring("text", F.lit(1), F.col("kept")), "taken"), 256).alias("edited_sha256"), "fp", "next_fp", "last", "kept", "same", m.alias("m"), F.concat(seam, end).alias("seam"))
    both = with_minima(edited, "seam", "seam_all", k, window, F.col("same"))
    over, whole = F.col("kept") - F.col("same"), F.col("m") >= reach
    head = F.when(F.col("same") > 0, F.slice("fp", F.lit(1), F.array_position("fp", F.col("last")).cast("int"))).otherwise(F.array().cast("array<bigint>"))
    anew = F.when(whole, F.slice("seam_all", F.lit(1), over)).otherwise(F.col("seam_all"))
    # The last window begins over + reach - 1 characters after same here, and m - reach characters after the next text's first.
    until = F.get("seam_all", F.size("seam_all") - 1) + (F.col("kept") + F.lit(2 * reach - 1) - F.col("m"))
    taken = F.when(whole, F.slice("next_fp", F.lit(1), F.array_position("next_fp", until).cast("int"))).otherwise(F.array().cast("array<bigint>"))
    both = both.withColumn("efp", F.array_distinct(F.concat(head, anew, F.transform(taken, lambda x: x - F.col("kept")))))
    sets = both.withColumns({"own_set": hashes(F.col("fp")), "edited_set": hashes(F.col("efp")), "next_set": hashes(F.col("next_fp"))})
    sets = sets.withColumns({f"_n_{x}": F.size(x) for x in ("own_set", "edited_set", "next_set")})
    return sets.select("doc_id", "n_chars", "edited_sha256", "fp", "efp", likeness("own_set", "edited_set").alias("near_edited"), likeness("own_set", "next_set").alias("near_next"))


def summary(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_chars", "edited_sha256", text_form(F.col("fp")).alias("fingerprint"), text_form(F.col("efp")).alias("edited_fingerprint"), "near_edited", "near_next")
