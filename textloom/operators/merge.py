"""Incremental merges and what is still to do: upserts that keep the last row, status of posts and tags, repair of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.values import stripped, with_columns
from textloom.operators.filters import without_keys_of


def keep_last(df: DataFrame, key: str, order: list[Column] | Column) -> DataFrame:
    """Of each key the row that comes last. It is an aggregate, so a key with many rows is cut to one on each side of the shuffle."""
    by = F.struct(*[(c if isinstance(c, Column) else F.col(c)) for c in (order if isinstance(order, list) else [order])])
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("__r")).select(*[F.col(key) if c == key else F.col(f"__r.`{c}`").alias(c) for c in df.columns])


def keep_first(df: DataFrame, key: str, order: list[Column] | Column) -> DataFrame:
    by = F.struct(*[(c if isinstance(c, Column) else F.col(c)) for c in (order if isinstance(order, list) else [order])])
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), by).alias("__r")).select(*[F.col(key) if c == key else F.col(f"__r.`{c}`").alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str] | None = None, order_col: str | None = None) -> DataFrame:
    """old and new together, one row for each key: a new one before an old one, and within either the one that comes last.

    order_col says what comes last within new and old; without it their physical order does. With columns, the result has exactly these, as text.
    """
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    ordered = [d.withColumns({"__side": F.lit(k), "__o": order}) for k, d in enumerate((old, new))]  # the order may be none of columns
    sides = [with_columns(d, columns, ("__side", "__o")) for d in ordered] if columns else ordered
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    return keep_last(both, key, [F.col("__side"), F.col("__o")]).drop("__side", "__o")


def merge_counts(old: DataFrame, new: DataFrame, merged: DataFrame) -> dict[str, int]:
    """Rows before, offered and after, and how many were added."""
    n = {k: d.count() for k, d in (("old", old), ("new", new), ("merged", merged))}
    return n | {"added": max(n["merged"] - n["old"], 0)}


def replaced(old_comments: DataFrame, new_comments: DataFrame, fetched_posts: DataFrame, order_col: str | None = None) -> DataFrame:
    """Comments after new ones were fetched for some posts: the old ones on these go first."""
    return upsert(without_keys_of(old_comments, fetched_posts, "post_id"), new_comments, "comment_id", order_col=order_col)


def have_text(comments: DataFrame, key: str = "post_id", column: str = "comment_text") -> DataFrame:
    """Each key with whether any of its rows has text, and how many have."""
    full = F.count_if(stripped(F.col(column)) != "")
    return comments.groupBy(key).agg((full > 0).alias("has_text"), full.alias("n_text"))


def pending_posts(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts without a comment that has text."""
    return without_keys_of(posts, have_text(comments).where("has_text"), "post_id")


def tag_status(posts: DataFrame, comments: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Of each searched tag: pending (no posts), needs_comments, or complete (every post has comments with text)."""
    tag = F.lower(stripped(F.col("source_hashtag")))
    done = have_text(comments).where("has_text").select("post_id", F.lit(1).alias("__done"))
    own = posts.select(tag.alias("tag"), "post_id").where("tag <> ''").distinct().join(done, "post_id", "left")
    status = own.groupBy("tag").agg(F.count("*").alias("n_posts"), F.count("__done").alias("n_done"))
    if tags is not None:
        asked = tags.select(F.lower(stripped(F.col("tag"))).alias("tag")).distinct()
        status = asked.join(status, "tag", "left").na.fill(0, ["n_posts", "n_done"])
    return status.withColumn("status", F.when(F.col("n_posts") == 0, "pending").when(F.col("n_done") < F.col("n_posts"), "needs_comments").otherwise("complete"))


def with_profile(comments: DataFrame, posts: DataFrame, order_col: str | None = None) -> DataFrame:
    """Comments with the profile of their post, empty where the post is unknown; of several rows for a post the last counts."""
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    last = posts.select("post_id", "profile_username", order.alias("__o")).groupBy("post_id").agg(F.max_by("profile_username", "__o").alias("profile_username"))
    return comments.drop("profile_username").join(last, "post_id", "left").na.fill("", ["profile_username"])


def repaired_links(posts: DataFrame, shortcodes: DataFrame, site: str = "https://www.instagram.com/") -> DataFrame:
    """Posts whose links are permalinks: as they are but for the query, or made from the code of their id, or of the link itself."""
    url, host = F.coalesce(F.col("post_url"), F.lit("")), site.split("//")[-1].removeprefix("www.").rstrip("/")
    codes = shortcodes.select(F.col("id").cast("string").alias("__id"), "shortcode")
    j = posts.join(codes, posts["post_id"] == codes["__id"], "left")
    plain = F.regexp_replace(F.split(url, r"\?")[0], "/+$", "")
    own = F.regexp_extract(url, host.replace(".", r"\.") + r"/(?:p|reel|tv)/([^/?#]+)", 1)
    link = lambda code: F.concat(F.lit(f"{site}p/"), code, F.lit("/"))
    good = F.contains(url, F.lit("/p/")) | F.contains(url, F.lit("/reel/"))
    new = F.when(good, F.concat(plain, F.lit("/"))).when(F.coalesce("shortcode", F.lit("")) != "", link(F.col("shortcode"))).when(own != "", link(own)).otherwise(url)
    return j.withColumn("post_url", new).select(*posts.columns)


def changed(old: DataFrame, new: DataFrame, key: str, column: str) -> int:
    """How many keys have another value now; one number comes to the driver."""
    a, b = old.select(key, F.col(column).alias("__a")), new.select(key, F.col(column).alias("__b"))
    return a.join(b, key).agg(F.count_if(~F.col("__a").eqNullSafe(F.col("__b")))).first()[0]
