"""Narrative clusters of comments: TF-IDF, k-means, and what names a cluster."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from textloom.functions import text as T
from textloom.sources.durable import written

# Sizes of the vocabulary and of what is shown.
FEATURES, MIN_DF, MAX_DF = 8000, 2, 0.85
TERMS, REPRESENTATIVES, PROFILES, SHOWN = 12, 3, 5, 200
SEED, STARTS, ROUNDS = 42, 10, 300
#: Starts that run at once; places to which scores are compared, so that what is equal but for the order of a sum is a tie.
PARALLEL, PLACES = 4, 12
_ACCENTS = ("áàâãäåéèêëíìîïóòôõöúùûüñçý", "aaaaaaeeeeiiiiooooouuuuncy")


def cluster_count(n: int, requested: int | None = None) -> int:
    """The asked number, a fifth of the rows at most; else by the number of rows."""
    if requested and requested > 0:
        return min(requested, max(2, n // 5))
    if n < 30:
        return max(2, min(5, n // 5 or 2))
    return 8 if n < 200 else 12


def cluster_text(df: DataFrame, stopwords: list[str], text_col: str = "comment_text", prepared_col: str = "text_for_cluster", compose: bool = True) -> Column:
    """The stored text for clustering, or else the raw text's tokens."""
    made = F.array_join(T.tokens(F.col(text_col), stopwords, compose), " ")
    return F.coalesce(F.nullif(F.trim(F.col(prepared_col)), F.lit("")), made) if prepared_col in df.columns else made


def terms(text: Column, stopwords: list[str]) -> Column:
    """Words of three characters or more without accents and stopwords, and each two neighbours of them."""
    plain = F.translate(F.lower(text), *_ACCENTS)
    stop = F.array(*map(F.lit, stopwords)).cast("array<string>")
    words = F.filter(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)), lambda w: ~F.array_contains(stop, w))
    return F.transform(F.array(words), lambda w: F.concat(w, F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))))[0]


def vocabulary_of(with_terms: DataFrame, n: int, features: int, min_df: float, max_df: float) -> list[tuple[str, int]]:
    """The most frequent terms of `__terms` with their numbers of rows, `features` at most; of equally frequent ones those that sort first. One pass and one shuffle."""
    each = lambda terms, rows, uses: F.transform(terms, lambda t: F.struct(t.alias("t"), F.lit(rows).alias("d"), F.lit(uses).alias("c")))
    rows = with_terms.select(F.inline(F.concat(each(F.col("__terms"), 0, 1), each(F.array_distinct("__terms"), 1, 0))))
    counts = rows.groupBy("t").agg(F.sum("d").alias("d"), F.sum("c").alias("c")).where((F.col("d") >= min_df) & (F.col("d") <= (max_df * n if max_df < 1 else n)))
    return [(x.t, x.d) for x in counts.orderBy(F.desc("c"), "t").limit(features).collect()]


def _vector(size: int, indices: Column, values: Column) -> Column:
    """A sparse vector of sorted places and their values."""
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), indices.cast("array<int>").alias("indices"), values.cast("array<double>").alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), StructType([StructField("v", VectorUDT())]))["v"]


def tfidf(df: DataFrame, text_col: str, stopwords: list[str], features: int = FEATURES, min_df: float = MIN_DF, max_df: float = MAX_DF) -> tuple[DataFrame, list[str]]:
    """df with `features`, sparse unit vectors of (1 + ln tf) * (ln((n + 1) / (df + 1)) + 1), and the vocabulary, of `features` terms at most.

    max_df below 1 is a share of the rows; from 1 on no term is too frequent. Rows are weighed where they stand, on their own terms alone.
    """
    with_terms = df.withColumn("__terms", terms(F.col(text_col), stopwords))
    n = with_terms.count()
    found = vocabulary_of(with_terms, n, features, min_df, max_df)
    vocabulary = [t for t, _ in found]
    if not found:
        return with_terms.drop("__terms").withColumn("features", _vector(1, F.array(), F.array())), []
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="__terms", outputCol="__tf")
    idf = F.array(*[F.lit(math.log((n + 1) / (d + 1)) + 1) for _, d in found])
    tf = F.unwrap_udt("__tf")
    weight = F.zip_with(tf["indices"], tf["values"], lambda k, c: (1 + F.ln(c)) * F.element_at(idf, k + 1))
    scaled = _let(weight, lambda w: _let(F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x)), lambda size: F.transform(w, lambda x: x / size)))
    return counter.transform(with_terms).withColumn("features", _vector(len(found), tf["indices"], scaled)).drop("__terms", "__tf"), vocabulary


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


@dataclass
class Clustering:
    enriched: DataFrame
    summary: DataFrame
    n_clusters: int


def clustered(df: DataFrame, stopwords: list[str], n_clusters: int | None = None, features: int = FEATURES, starts: int = STARTS, rounds: int = ROUNDS, key: str = "comment_id", text_col: str = "comment_text", compose: bool = True) -> Clustering:
    """Rows with a cluster, and a summary of the clusters. Rows without tokens are left out; ValueError if no row has any."""
    rows = df.withColumn("__text", cluster_text(df, stopwords, text_col, compose=compose)).where(F.trim("__text") != "")
    n = rows.count()
    if not n:
        raise ValueError("no row has words that say something")
    k = cluster_count(n, n_clusters)
    if n < k:
        k = max(2, n // 2 or 1)
    vectors, vocabulary = tfidf(rows, "__text", stopwords, features, min_df=min(MIN_DF, n))
    vectors = written(vectors, "vectors")
    points = vectors.select("features").persist()
    with ThreadPoolExecutor(PARALLEL) as pool:  # a start's rounds leave cores idle that another one can use
        models = list(pool.map(lambda s: KMeans(k=k, seed=SEED + s, maxIter=rounds, tol=1e-4).fit(points), range(starts)))
    best = min(models, key=lambda m: m.summary.trainingCost)
    points.unpersist()
    marked = best.transform(vectors).withColumn("cluster_id", F.col("prediction").cast("string")).drop("prediction", "__text")
    for name, value in (("narrative_label", F.concat(F.lit("narrativa_"), "cluster_id")), *((c, F.lit(v)) for c, v in (("discourse_category_id", ""), ("discourse_category_label", ""), ("discourse_source", "pending")) if c not in df.columns)):
        marked = marked.withColumn(name, value)
    return Clustering(marked.drop("features"), summary(marked, vocabulary, stopwords, key, text_col), k)


def top_terms(marked: DataFrame, vocabulary: list[str], stopwords: list[str], most: int = TERMS) -> DataFrame:
    """cluster_id and its terms of greatest mean weight that say something, joined."""
    from pyspark.ml.stat import Summarizer

    mean = marked.groupBy("cluster_id").agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("m"))
    names = marked.sparkSession.createDataFrame([(k, t) for k, t in enumerate(vocabulary) if len(t) > 2 and not all(w in set(stopwords) for w in t.split())], "k int, term string")
    each = mean.select("cluster_id", F.posexplode("m").alias("k", "w")).where("w > 0").join(F.broadcast(names), "k")
    return top_joined(each, "cluster_id", [F.desc(F.round("w", PLACES)), F.col("term")], "term", most, "top_terms", "; ")


def top_joined(df: DataFrame, key: str, order: list[Column], value: str, most: int, name: str, between: str) -> DataFrame:
    """Of each key the first values, joined in order; Spark cuts each task's rows of a key to `most` before the shuffle."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(value).alias("__v")))), lambda x: x["__v"])
    return ranked.groupBy(key).agg(F.array_join(listed, between, "").alias(name))


def representatives(marked: DataFrame, key: str = "comment_id", text_col: str = "comment_text", most: int = REPRESENTATIVES) -> DataFrame:
    """cluster_id and the texts nearest to its mean, on one line, cut and joined."""
    from pyspark.ml.stat import Summarizer

    mean = marked.groupBy("cluster_id").agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("__m"))
    own = F.unwrap_udt("features")  # sparse: only its own terms are looked up in the mean
    dot = F.aggregate(F.zip_with(own["indices"], own["values"], lambda k, x: x * F.element_at("__m", k + 1)), F.lit(0.0), lambda s, x: s + x)
    each = marked.join(F.broadcast(mean), "cluster_id").select("cluster_id", key, dot.alias("__s"), F.substring(F.replace(text_col, F.lit("\n"), F.lit(" ")), 1, SHOWN).alias("__t"))
    return top_joined(each, "cluster_id", [F.desc(F.round("__s", PLACES)), F.col(key)], "__t", most, "representative_comments", " || ")


def top_profiles(marked: DataFrame, most: int = PROFILES) -> DataFrame:
    """cluster_id and its most frequent profiles, a blank one too, joined."""
    counts = marked.groupBy("cluster_id", "profile_username").agg(F.count("*").alias("n"))
    return top_joined(counts, "cluster_id", [F.desc("n"), F.col("profile_username")], "profile_username", most, "top_profiles", "; ")


def summary(marked: DataFrame, vocabulary: list[str], stopwords: list[str], key: str = "comment_id", text_col: str = "comment_text") -> DataFrame:
    out = marked.groupBy("cluster_id", "narrative_label").agg(F.max("discourse_category_id").alias("discourse_category_id"), F.max("discourse_category_label").alias("discourse_category_label"), F.count("*").alias("n_comments"))
    out = out.join(top_terms(marked, vocabulary, stopwords), "cluster_id", "left").join(representatives(marked, key, text_col), "cluster_id", "left")
    if "profile_username" in marked.columns:
        out = out.join(top_profiles(marked), "cluster_id", "left")
    return out
