"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions alone.

A sketch is the sorted array of the K least distinct hashes of a text's word shingles. Sketches of parts merge into that
of the whole, and estimate resemblance, containment and the number of distinct shingles.

Defined results: words are lower-case runs without white space; fewer words than a shingle make one shingle of the whole
sequence; a null or empty text has an empty sketch; two empty sketches are alike (1), an empty and a full one are not (0);
equal texts have equal sketches; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import common

K, SHINGLE = 64, 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), " ")

    def hashed(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.when(F.size(w) >= n, many).when(w[0] == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(w)))

    return _let(words, hashed)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    return bottom_k(shingle_hashes(text, n), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """The sketch of all rows of each key, as column; no group is gathered in one place before it is cut to k hashes."""
    hashes = df.select(*keys, F.explode(column).alias("__h")).distinct()
    order = Window.partitionBy(*keys).orderBy("__h")
    least = hashes.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of distinct shingles that both have."""
    u = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(u, a), b))
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b has too."""
    common_count = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common_count / distinct_shingles(a, k)))


def as_string(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _ranges(df: DataFrame, key: str, rank: str, n: int) -> Column:
    """The number, in descending order of key, of one of about n ranges with as many rows each; null keys are last.

    A key that is a border several times holds as many ranges; they part its rows by rank, a hash.

    Only the n borders come to the driver; they are held in two levels, so a row looks at about 2 * sqrt(n) of them.
    """
    borders = df.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    borders = sorted(borders or (), reverse=True)
    step = max(1, round(len(borders) ** 0.5))
    groups = [borders[k : k + step] for k in range(0, len(borders), step)]
    if not groups:
        return F.lit(0)
    kind = df.schema[key].dataType
    list_of = lambda xs: F.array(*[F.lit(x).cast(kind) for x in xs])
    coarse = F.size(F.filter(list_of([g[-1] for g in groups]), lambda b: F.col(key) < b))
    fine = F.size(F.filter(F.get(F.array(*[list_of(g) for g in groups]), coarse), lambda b: F.col(key) < b))
    part = F.lit(0)
    for b, times in Counter(borders).items():
        if times > 1:
            part = F.when(F.col(key) == b, F.floor((F.lit(2.0**63) - F.col(rank).cast("double")) / F.lit(2.0**64) * times)).otherwise(part)
    place = coarse * step + F.greatest(fine, F.lit(0)) + F.least(part, F.lit(len(borders)))
    return F.when(F.col(key).isNull(), F.lit((len(groups) + 2) * step)).otherwise(place)


def with_next(df: DataFrame, id_col: str, rank: str, derive: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """derive(df) with `next`, a struct of columns from the row after, by descending id, then rank; after the last comes the first.

    Rows are dealt into ranges of ids, so the order is made in many tasks; the last row of a range meets the first one of the next
    through a table with a row for each range. derive adds what is costly; it is worked out once for each row, and for the first
    ones of the ranges once more. There are four ranges to a partition, so that hashing them out leaves no partition with many.
    """
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("__range", _ranges(df, id_col, rank, n))
    order = [F.desc_nulls_last(id_col), F.desc(rank)]
    within = Window.partitionBy("__range").orderBy(*order)
    derived = derive(placed)
    rows = derived.withColumn("__lead", F.lead(F.struct(*columns)).over(within))
    heads = placed.groupBy("__range").agg(F.max(F.struct(id_col, rank)).alias("__k")).select("__range", F.col("__k")[id_col].alias("__i"), F.col("__k")[rank].alias("__r"))
    ring = Window.orderBy("__range")  # a row for each range
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    last = F.lead("__range").over(ring).isNull()
    heads = heads.select("__range", F.when(last, F.first("__i").over(whole)).otherwise(F.lead("__i").over(ring)).alias("__i"), after("__r").alias("__r"))
    first_rows = df.join(F.broadcast(heads), df[id_col].eqNullSafe(heads["__i"]) & (df[rank] == heads["__r"]))
    first_rows = derive(first_rows).groupBy("__range").agg(F.first(F.struct(*columns)).alias("__first"))
    return rows.join(first_rows, "__range").select(*[c for c in derived.columns if c != "__range"], F.coalesce("__lead", "__first").alias("next"))


def fingerprinted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row the sketch of its text and of its edited text, whose last third gives way to the next row's beginning."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("rank"))
    rows = with_next(rows, "doc_id", "rank", lambda d: d.withColumn("own", sketch(F.col("text"))), ["text", "own"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr(F.col("next.text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", F.col("next.own").alias("after"), edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "after", sketch(F.col("edited")).alias("changed"))
    return rows.select(
        F.col("doc_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"),
        resemblance(F.col("own"), F.col("after")).alias("near_next"),
        distinct_shingles(F.col("own")).alias("shingles"),
        containment(F.col("own"), F.col("changed")).alias("kept_in_edited"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(common.documents(spark, sf_dir))
