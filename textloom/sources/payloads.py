"""Items out of saved web payloads: feeds of a tag or a profile, and comment pages, in any of the forms that they come in.

Fetching is not part of this library; a collector saves its responses, and these functions start from their text.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions.text import HASHTAG
from textloom.sources.normalize import SITE, embedded_json, longest, merged_feed

# The shapes of the payloads.
_COUNT = "struct<count:bigint>"
_PERSON = "struct<pk:string,id:string,username:string>"
NODE = f"struct<id:string,shortcode:string,__typename:string,is_video:boolean,edge_media_to_caption:struct<edges:array<struct<node:struct<text:string>>>>,owner:{_PERSON},edge_liked_by:{_COUNT},edge_media_preview_like:{_COUNT},edge_media_to_comment:{_COUNT},video_view_count:bigint,play_count:bigint,taken_at_timestamp:string>"
EDGES = f"struct<edges:array<struct<node:{NODE}>>>"
MEDIA = f"struct<pk:string,id:string,code:string,shortcode:string,caption:struct<text:string>,user:{_PERSON},owner:{_PERSON},media_type:string,__typename:string,is_video:boolean,comment_count:bigint,like_count:bigint,play_count:bigint,view_count:bigint,taken_at:string,taken_at_timestamp:string>"
SECTIONS = f"array<struct<layout_content:struct<medias:array<struct<media:{MEDIA}>>>>>"
FEED = f"struct<sections:{SECTIONS}>"
TAG_FEED = f"struct<edge_hashtag_to_media:{EDGES},top:{FEED},recent:{FEED},sections:{SECTIONS},hashtag:struct<edge_hashtag_to_media:{EDGES},top:{FEED},recent:{FEED},sections:{SECTIONS}>>"
PROFILE = f"struct<edge_owner_to_timeline_media:{EDGES},edge_felix_video_timeline:{EDGES},edge_media_collections:{EDGES}>"
COMMENT_PAGE = f"struct<comments:array<struct<pk:string,id:string,text:string,created_at:string,user:{_PERSON},comment_like_count:bigint>>,next_max_id:string>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, payload of each saved response."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))


def _filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns], F.lit(""))


def _item(i: Column, code: Column, kind: Column, video: Column, caption: Column, owner: Column, name: Column, comments: Column, likes: Column, views: Column, time: Column, tag: Column, bare_link: bool) -> Column:
    """An item in the collectors' form."""
    text = F.coalesce(caption, F.lit(""))
    link = F.concat(F.lit(f"{SITE}p/"), code, F.lit("/"))
    return F.struct(
        i.alias("id"), code.alias("shortcode"), kind.alias("type"), F.coalesce(video, F.lit(False)).cast("string").alias("is_video"), text.alias("description"),
        F.struct(owner.alias("id"), F.coalesce(name, F.lit("")).alias("username")).alias("owner"), F.coalesce(comments, F.lit(0)).cast("long").alias("comments"), F.coalesce(likes, F.lit(0)).cast("long").alias("likes"),
        F.coalesce(views, F.lit(0)).cast("long").alias("views"), F.coalesce(time, F.lit("")).alias("taken_at_timestamp"), (link if bare_link else F.when(code == "", "").otherwise(link)).alias("url"),
        F.regexp_extract_all(text, F.lit(HASHTAG), F.lit(0)).alias("hashtags"), F.regexp_extract_all(text, F.lit(r"@[\p{L}\p{N}_]+"), F.lit(0)).alias("mentions"), tag.alias("source_search_hashtag"),
    )


def node_item(n: Column, tag: Column, username: Column | None = None) -> Column:
    """An item from a graph node; a profile's nodes take the profile's name."""
    name = n["owner"]
    caption = F.get(n["edge_media_to_caption"]["edges"], F.lit(0))["node"]["text"]
    likes = F.coalesce(n["edge_liked_by"]["count"], n["edge_media_preview_like"]["count"])
    views = F.coalesce(F.nullif(n["video_view_count"], F.lit(0)), n["play_count"])
    return _item(_filled(n["id"]), _filled(n["shortcode"]), _filled(n["__typename"]), n["is_video"], caption, _filled(name["id"]), username if username is not None else name["username"], n["edge_media_to_comment"]["count"], likes, views, n["taken_at_timestamp"], tag, True)


def media_item(m: Column, tag: Column) -> Column:
    """An item from a medium of the REST form."""
    person = F.coalesce(m["user"], m["owner"])
    video = (m["media_type"] == "2") | F.coalesce(m["is_video"], F.lit(False))
    views = F.coalesce(F.nullif(m["play_count"], F.lit(0)), m["view_count"])
    return _item(_filled(m["pk"], m["id"]), _filled(m["code"], m["shortcode"]), _filled(m["media_type"], m["__typename"]), video, m["caption"]["text"], _filled(person["pk"], person["id"]), person["username"], m["comment_count"], m["like_count"], views, F.coalesce(m["taken_at"], m["taken_at_timestamp"]), tag, False)


def _nodes(edges: Column) -> Column:
    return F.filter(F.transform(F.coalesce(edges, F.array().cast(f"array<struct<node:{NODE}>>")), lambda e: e["node"]), lambda n: n.isNotNull())


def tag_items(payloads: DataFrame, tag: str, payload_col: str = "payload") -> DataFrame:
    """Items of a tag's feeds: those of the graph form first, then of the sections (top, recent, plain) whose id isn't there yet."""
    d, t = F.from_json(payload_col, TAG_FEED), F.lit(tag)
    rows = payloads.select(d.alias("d"))
    pick = lambda name: F.coalesce(F.col(f"d.hashtag.{name}"), F.col(f"d.{name}"))
    none = F.array().cast(SECTIONS)
    sections = F.flatten(F.array(*[F.coalesce(x, none) for x in (pick("top")["sections"], pick("recent")["sections"], pick("sections"))]))
    media = F.flatten(F.transform(sections, lambda s: F.coalesce(s["layout_content"]["medias"], F.array().cast(f"array<struct<media:{MEDIA}>>"))))
    graph = rows.select(F.explode(_nodes(pick("edge_hashtag_to_media")["edges"])).alias("n")).select(node_item(F.col("n"), t).alias("i")).select("i.*")
    rest = rows.select(F.explode(media).alias("m")).where("m.media is not null").select(media_item(F.col("m.media"), t).alias("i")).select("i.*").where("id <> '' or shortcode <> ''")
    return merged_feed(graph, rest)


def profile_items(payloads: DataFrame, username: str, payload_col: str = "payload") -> DataFrame:
    """Items of a profile: the longest of its lists."""
    d = F.from_json(payload_col, PROFILE)
    listed = longest([d[x]["edges"] for x in ("edge_owner_to_timeline_media", "edge_felix_video_timeline", "edge_media_collections")])
    return payloads.select(F.explode(_nodes(listed)).alias("n")).select(node_item(F.col("n"), F.lit(""), F.lit(username)).alias("i")).select("i.*")


def _deep(value, key: str):
    """The first block under key, at any depth, whose edges aren't empty; iterative, so deep pages don't exhaust the stack."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            block = x.get(key)
            if isinstance(block, dict) and block.get("edges"):
                return block
            todo.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            todo.extend(reversed(x))
    return None


@F.pandas_udf(StringType())
def deep_edges(bodies: pd.Series) -> pd.Series:
    """Of each page's JSON bodies the first list of edges, as JSON. A path of unknown depth is what no JSON function reaches."""

    def first(listed) -> str | None:
        for body in listed if listed is not None else ():
            try:
                found = _deep(json.loads(body), "edge_hashtag_to_media")
            except ValueError:
                continue
            if found:
                return json.dumps(found)
        return None

    return bodies.map(first)


def page_items(pages: DataFrame, tag: str, html_col: str = "html") -> DataFrame:
    """Items in the JSON of pages: of each page the first list that isn't empty, however deep it lies. Pages without such a list never reach Python."""
    bodies = pages.where(F.contains(html_col, F.lit('"edge_hashtag_to_media"'))).select(embedded_json(F.col(html_col)).alias("b"))
    found = bodies.select(F.from_json(deep_edges("b"), EDGES).alias("d"))
    return found.select(F.explode(_nodes(F.col("d.edges"))).alias("n")).select(node_item(F.col("n"), F.lit(tag)).alias("i")).select("i.*")


def comment_items(payloads: DataFrame, most: int | None = None, payload_col: str = "payload") -> DataFrame:
    """Comments of saved pages, in the order of the files; `most` at most."""
    page = payloads.select("file", F.posexplode(F.from_json(payload_col, COMMENT_PAGE)["comments"]).alias("place", "c"))
    c = F.col("c")
    out = page.select(_filled(c["pk"], c["id"]).alias("id"), F.coalesce(c["text"], F.lit("")).alias("text"), F.coalesce(c["created_at"], F.lit("")).alias("created_at"), F.struct(_filled(c["user"]["pk"], c["user"]["id"]).alias("id"), F.coalesce(c["user"]["username"], F.lit("")).alias("username")).alias("owner"), F.coalesce(c["comment_like_count"], F.lit(0)).alias("likes"), "file", "place")
    return (out.orderBy("file", "place").limit(most) if most else out).drop("file", "place")
