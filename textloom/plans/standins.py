"""Posts and comments made of the driver's tables, so that each operator can run on them; and small lexicons of words that occur there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.lexicons import SentimentLexicon, Taxonomy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores, such as one small file, dealt out before costly work on each row; larger ones as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as posts: names and types are hashtags, brands are profiles."""
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("post_id"), F.concat(F.lit("@"), brand).alias("profile_username"),
        F.concat(F.lit("#"), F.replace("p_name", F.lit(" "), F.lit(" #")), F.lit(" by @"), brand, F.lit(" and @"), F.lower("p_type")).alias("caption"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit(";#")), F.lit("; "), F.col("p_type")).alias("hashtags"),
        F.concat(F.lit(" "), F.col("p_type")).alias("source_hashtag"), F.col("p_retailprice").cast("string").alias("like_count"), F.col("p_size").cast("string").alias("comment_count"),
    )


POSTS = """SELECT CAST(p_partkey AS VARCHAR) AS post_id, '@' || lower(replace(p_brand, '#', '')) AS profile_username,
 '#' || replace(p_name, ' ', ' #') || ' by @' || lower(replace(p_brand, '#', '')) || ' and @' || lower(p_type) AS caption,
 replace(p_name, ' ', ';#') || '; ' || p_type AS hashtags, ' ' || p_type AS source_hashtag,
 CAST(p_retailprice AS VARCHAR) AS like_count, CAST(p_size AS VARCHAR) AS comment_count FROM part"""


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as comments of suppliers on parts."""
    flag = F.col("l_returnflag")
    text = F.concat(F.lit("Line #"), flag, F.lit("x #Qty"), F.col("l_linenumber").cast("string"), F.lit(" @User"), (F.col("l_suppkey") % 7).cast("string"), F.lit(" @a"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("comment_id"),
        F.col("l_partkey").cast("string").alias("post_id"), F.concat(F.lit("@User"), F.col("l_suppkey").cast("string")).alias("author_username"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(" ")).otherwise(text).alias("comment_text"),
    )


COMMENTS = """SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS comment_id,
 CAST(l_partkey AS VARCHAR) AS post_id, '@User' || CAST(l_suppkey AS VARCHAR) AS author_username,
 CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE 'Line #' || l_returnflag || 'x #Qty' || CAST(l_linenumber AS VARCHAR) || ' @User' || CAST(l_suppkey % 7 AS VARCHAR) || ' @a' END AS comment_text
 FROM lineitem"""

SENTIMENT = SentimentLexicon(
    positive={"en": ["the", "with", "of the", "thing"], "fr": ["des", "pour", "dans la"], "de": ["der", "von", "auf der"], "es": ["que", "los", "de la"]},
    negative={"en": ["and", "was", "thing", "and the"], "fr": ["les", "est"], "de": ["die", "nicht"], "es": ["del", "por", "para"]},
    negators=["that", "le", "und", "en"],
    intensifiers=["is", "la", "das", "y", "of"],
)
LANGUAGES = ("en", "fr", "de", "es")
TAXONOMY = Taxonomy.parse({"categories": [
    {"id": "feminist", "label": "first stance", "priority": 20, "terms": ["this", "pas", "einer", "con"]},
    {"id": "antifeminist", "label": "second stance", "priority": 21, "terms": ["from", "sur", "mit", "una"]},
    {"id": "rare", "label": "Rare words", "priority": 30, "terms": ["here", "is the", "Aus"]},
    {"id": "early", "label": "Early words", "priority": 10, "terms": ["are the", "qui la"]},
    {"id": "neutral", "priority": 99, "terms": ["the"]},
]})
STOPWORDS = ["and", "are", "dans", "das", "del", "der", "des", "die", "for", "les", "los", "que", "the", "und", "was", "with"]
KEYWORDS = {"en": ["and", "for", "of", "that", "the", "was", "with"], "fr": ["dans", "des", "est", "et", "la", "les", "pour"], "de": ["das", "der", "die", "ist", "nicht", "und", "von"], "es": ["de", "del", "la", "los", "para", "por", "que"]}
SIGNS = {"de": ("[äöüß]", 1.5), "es": ("[ñó]", 2.0)}
