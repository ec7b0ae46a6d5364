"""Scans: posts and comments, raw collector files, tag lists, configuration, graph files."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.values import stripped, with_columns

# The columns of the two stored tables, all text.
POSTS = "platform post_id post_url profile_username caption hashtags mentions media_type published_at like_count comment_count view_count source_mode source_hashtag corpus_id scraped_at".split()
COMMENTS = "platform post_id comment_id parent_comment_id author_username comment_text like_count published_at corpus_id scraped_at".split()
OWNER = "struct<id:string,username:string>"
RAW_POST = f"id string, shortcode string, type string, is_video string, description string, owner {OWNER}, comments long, likes long, views long, taken_at_timestamp string, url string, hashtags array<string>, mentions array<string>, source_search_hashtag string"
RAW_COMMENT = f"id string, text string, created_at string, owner {OWNER}, likes long"


def exists(spark: SparkSession, path: str) -> bool:
    """Through the file system that Spark itself uses."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def empty(spark: SparkSession, columns: list[str]) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Text columns; quotes, commas and line breaks in quotes are kept; a missing value is the empty text."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    return df.na.fill("")


def read_or_empty(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return with_columns(read_csv(spark, path), columns) if exists(spark, path) else empty(spark, columns)


def read_tables(spark: SparkSession, folder: str, need_comments: bool = True) -> tuple[DataFrame, DataFrame]:
    """Posts and comments of a folder. Posts may be missing; FileNotFoundError if comments are and they are needed."""
    path = f"{folder.rstrip('/')}/comments.csv"
    if need_comments and not exists(spark, path):
        raise FileNotFoundError(path)
    return read_or_empty(spark, f"{folder.rstrip('/')}/posts.csv", POSTS), read_or_empty(spark, path, COMMENTS)


def read_raw(spark: SparkSession, path: str, schema: str = RAW_POST) -> DataFrame:
    """Raw items from JSON (a list, an object with `collector`, or one object) or CSV; a missing file gives no rows, and broken files none of theirs.

    CSV columns with dotted names become structs, so both forms read alike.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if path.lower().endswith(".csv"):
        df = read_csv(spark, path)
        if "owner.username" in df.columns:
            own = F.struct((F.col("`owner.id`") if "owner.id" in df.columns else F.lit("")).alias("id"), F.col("`owner.username`").alias("username"))
            df = df.withColumn("owner", own).drop("owner.id", "owner.username")
        return df
    return _raw_json(spark, [path], schema)


def _raw_json(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The items of all files, in one scan, with file, modified and place."""
    both = f"struct<{_struct(schema)},collector:array<struct<{_struct(schema)}>>>"
    whole = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{both}>")).otherwise(F.array(F.from_json("value", both)))
    item = F.col("item")
    rows = whole.select("file", "modified", F.posexplode(listed).alias("place", "item")).where(item.isNotNull() & (F.to_json(item) != "{}"))
    names = [x.split(" ", 1)[0].strip() for x in _fields(schema)]
    flat = rows.where("item.collector is null").select("file", "modified", "place", *[item[n].alias(n) for n in names])
    held = rows.where("item.collector is not null").select("file", "modified", F.posexplode("item.collector").alias("place", "i")).select("file", "modified", "place", *[F.col("i")[n].alias(n) for n in names])
    return flat.unionByName(held)


def _fields(schema: str) -> list[str]:
    return [x.strip() for x in re.split(r",(?![^<]*>)", schema)]


def _struct(schema: str) -> str:
    return ",".join(":".join(x.split(" ", 1)) for x in _fields(schema))


def first_filled(spark: SparkSession, json_path: str | None, csv_path: str | None, schema: str = RAW_POST) -> DataFrame:
    """The JSON file if it has rows, else the CSV file."""
    if json_path:
        df = read_raw(spark, json_path, schema)
        if not df.isEmpty():
            return df
    return read_raw(spark, csv_path, schema) if csv_path else spark.createDataFrame([], schema)


def raw_files(spark: SparkSession, folder: str, pattern: str = "hashtag_*.json") -> DataFrame:
    """tag, path, modified of raw files; the tag is what stands in the name, in lower case."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").alias("modified"))
    tag = F.lower(F.regexp_extract("path", r"hashtag_(.+?)(?:_\d[\d_\-T]*)?\.json$", 1))
    return files.select(tag.alias("tag"), "path", "modified")


def latest_raw_files(files: DataFrame) -> DataFrame:
    """Of each tag the path that was written last; no file is opened for it."""
    return files.groupBy("tag").agg(F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified"))


def import_tags(spark: SparkSession, folder: str, tags: list[str] | None = None, most: int | None = None) -> DataFrame:
    """The items of the latest raw file of each tag, with `tag`; `most` items of a tag at most, in the file's order."""
    latest = latest_raw_files(raw_files(spark, folder))
    if tags is not None:
        latest = latest.where(F.col("tag").isin([t.lower().lstrip("#") for t in tags]))
    paths = dict(latest.select("path", "tag").collect())  # a path for each asked tag
    if not paths:
        return spark.createDataFrame([], f"file string, modified timestamp, place int, {RAW_POST}, tag string")
    items = _raw_json(spark, sorted(paths), RAW_POST)
    items = items.where(F.col("place") < most) if most else items
    names = spark.createDataFrame([(Path(p).name, t) for p, t in paths.items()], "name string, tag string")
    return items.withColumn("name", F.url_decode(F.substring_index("file", "/", -1))).join(F.broadcast(names), "name").drop("name")


def shortcodes(raw: DataFrame) -> DataFrame:
    """id, shortcode of all raw items; the last file and place count."""
    rows = raw.where((stripped(F.col("id")) != "") & (stripped(F.col("shortcode")) != ""))
    return rows.groupBy("id").agg(F.max_by("shortcode", F.struct("file", "place")).alias("shortcode"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Tags, one to a line or in the column hashtag, tag or tags; lines that begin with # are remarks, and of several lines only what stands before a comma counts.
    A file of a single line lists its tags between commas."""
    text = F.regexp_replace("value", "^\ufeff", "")
    rows = spark.read.text(path).select(F.trim(text).alias("v"), F.monotonically_increasing_id().alias("o")).where("v <> '' and not startswith(v, '#')")
    few = [x.v for x in rows.limit(2).collect()]
    if len(few) == 1 and "," in few[0]:
        listed = [t for t in dict.fromkeys(tags_of_line(few[0])) if t.lower() not in ("hashtag", "tag", "tags")]
        return spark.createDataFrame([(t,) for t in listed], "tag string")
    tag = F.trim(F.split("v", ",")[0])
    rows = rows.select(F.regexp_replace(tag, '^"|"$', "").alias("tag"), "o").where("tag <> ''")
    return rows.where(~F.lower("tag").isin("hashtag", "tag", "tags")).groupBy("tag").agg(F.min("o").alias("o")).orderBy("o").select("tag")


def tags_of_line(line: str) -> list[str]:
    """A single line with commas, read as CSV."""
    return [t.strip() for row in csv.reader(io.StringIO(line)) for t in row if t.strip()]


@dataclass
class Corpus:
    id: str
    tags_file: str
    description: str = ""


def read_corpora(path: str) -> list[Corpus]:
    """The corpora of a YAML file; files are found from its folder. ValueError if there is none."""
    import yaml

    here = Path(path)
    listed = (yaml.safe_load(here.read_text(encoding="utf-8")) or {}).get("corpora") or []
    out = []
    for x in listed:
        if not isinstance(x, dict) or not x.get("id") or not x.get("hashtags_file"):
            raise ValueError(f"{path}: each corpus needs an id and a hashtags_file")
        file = Path(x["hashtags_file"])
        out.append(Corpus(str(x["id"]), str(file if file.is_absolute() else here.parent / file), str(x.get("description", ""))))
    if not out:
        raise ValueError(f"{path}: no corpora")
    return out


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a GraphML file, with a map of attributes by key."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    fill = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"])))
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = read("node", f"_id string, {data}").select(F.col("_id").alias("node_id"), fill.alias("attributes"))
    edges = read("edge", f"_source string, _target string, {data}").select(F.col("_source").alias("source"), F.col("_target").alias("target"), fill.alias("attributes"))
    return nodes, edges


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")
