"""Filters on posts and comments: dates, engagement, activity, corpus, labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampNTZType, TimestampType

from textloom.functions.values import count_value, number, published_at, stripped


def date_bound(value: str | None, end: bool = False) -> dt.datetime | None:
    """YYYY-MM-DD as the first or last second of that day; ValueError for any other form."""
    if not value:
        return None
    day = dt.datetime.strptime(value, "%Y-%m-%d")
    return day.replace(hour=23, minute=59, second=59) if end else day


def in_dates(c: Column, date_from: str | None, date_to: str | None) -> Column:
    """Whether a time of publication lies within both days; a blank or unreadable one doesn't."""
    at, low, high = published_at(c), date_bound(date_from), date_bound(date_to, True)
    ok = at.isNotNull()
    if low:
        ok = ok & (at >= F.lit(low).cast("timestamp_ntz"))
    if high:
        ok = ok & (at <= F.lit(high).cast("timestamp_ntz"))
    return ok


def between_days(df: DataFrame, column: str, date_from: str | None, date_to: str | None) -> DataFrame:
    """Rows within both days. A column that is a time already is compared as it is, so the scan can skip by it."""
    if not isinstance(df.schema[column].dataType, (TimestampType, TimestampNTZType)):
        return df.where(in_dates(F.col(column), date_from, date_to))
    kind, out = df.schema[column].dataType, df.where(F.col(column).isNotNull())
    if low := date_bound(date_from):
        out = out.where(F.col(column) >= F.lit(low).cast(kind))
    if high := date_bound(date_to, True):
        out = out.where(F.col(column) <= F.lit(high).cast(kind))
    return out


def metric_value(df: DataFrame, name: str) -> Column:
    """A metric as number: numeric columns as they are (null is 0), text through its checks."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if isinstance(df.schema[name].dataType, NumericType) else number(F.col(name))


def by_dates(posts: DataFrame, comments: DataFrame, date_from: str | None = None, date_to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Posts within the days, and the comments on them; without bounds both stay as they are."""
    if not date_from and not date_to:
        return posts, comments
    kept = between_days(posts, "published_at", date_from, date_to)
    return kept, with_keys_of(comments, kept, "post_id")


def with_keys_of(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_semi")


def without_keys_of(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def at_least(df: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """Rows with at least so much of each metric; a minimum of None or 0 is off."""
    for metric, least in minimums.items():
        if least:
            numeric = isinstance(df.schema[metric].dataType, NumericType)  # then the scan can skip by it
            df = df.where((F.col(metric) if numeric else number(F.col(metric))) >= least)
    return df


#: Metrics whose zeros say nothing and don't count in a mean.
SKIP_ZEROS = ("view_count",)


def _mean(df: DataFrame, metric: str) -> Column:
    v = metric_value(df, metric)
    return F.avg(F.when(v > 0, v)) if metric in SKIP_ZEROS else F.avg(v)


def above_average(df: DataFrame, metrics: list[str], factor: float = 1.0, profile: str = "profile_username") -> DataFrame:
    """Rows over factor times their profile's mean in every metric."""
    ok = F.lit(True)
    for metric in metrics:
        ok = ok & F.coalesce(metric_value(df, metric) > _mean(df, metric).over(Window.partitionBy(profile)) * factor, F.lit(False))
    return df.withColumn("__ok", ok).where("__ok").drop("__ok")


def profile_stats(df: DataFrame, metrics: list[str], factor: float = 1.0, profile: str = "profile_username") -> DataFrame:
    """Of each profile and metric the mean, the threshold and the number of posts; a profile without a mean has 0."""
    wide = df.groupBy(profile).agg(*[F.coalesce(_mean(df, m), F.lit(0.0)).alias(m) for m in metrics], F.count("*").alias("posts_in_profile"))
    long = wide.unpivot([profile, "posts_in_profile"], metrics, "metric", "mean")
    return long.select(profile, "metric", F.round("mean", 2).alias("profile_mean"), F.round(F.col("mean") * factor, 2).alias("threshold"), "posts_in_profile")


def top(df: DataFrame, metric: str, n: int, tie: str = "post_id") -> DataFrame:
    """The n rows with most of a metric; ties go by key."""
    return df.orderBy(F.desc(metric_value(df, metric)), tie).limit(n)


def engaging(posts: DataFrame, minimums: dict[str, float] | None = None, above: list[str] | None = None, factor: float = 1.0, top_by: str | None = None, most: int | None = None) -> DataFrame:
    """Minimums, then the profile's average among what is left, then the order and the cap."""
    out = at_least(posts, minimums or {})
    if above:
        if unknown := set(above) - {"like_count", "comment_count", "view_count"}:
            raise ValueError(f"unknown metrics: {', '.join(sorted(unknown))}")
        out = above_average(out, above, factor)
    if top_by:
        return top(out, top_by, most) if most else out.orderBy(F.desc(metric_value(out, top_by)), "post_id")
    return out.orderBy("post_id").limit(most) if most else out


def with_activity(posts: DataFrame) -> DataFrame:
    """Posts that have comments by their own count; all of them if there is no count."""
    return posts.where(count_value(F.col("comment_count")) > 0) if "comment_count" in posts.columns else posts


def with_text(df: DataFrame, column: str = "comment_text") -> DataFrame:
    return df.where(stripped(F.col(column)) != "")


def look_empty(comments: DataFrame, column: str = "comment_text") -> bool:
    """Whether there are rows, none of which has text; two numbers come to the driver."""
    n, full = comments.agg(F.count("*"), F.count_if(stripped(F.col(column)) != "")).first()
    return n > 0 and full == 0


def of_corpus(df: DataFrame, corpus: str) -> DataFrame:
    return df.where(F.col("corpus_id") == corpus)


def labelled(df: DataFrame, column: str = "discourse_category_id") -> DataFrame:
    return df.where(stripped(F.col(column)) != "")


def narrative_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("edge_type").contains("narrative"))


def cooccurrence_edges(edges: DataFrame) -> DataFrame:
    return edges.where("edge_type = 'hashtag_cooccurrence'")


def described(before: int, after: int, minimums: dict[str, float] | None = None, above: list[str] | None = None, factor: float = 1.0, top_by: str | None = None) -> str:
    """A line for a log about what an engagement filter did."""
    parts = [f"{k} >= {v}" for k, v in (minimums or {}).items() if v]
    if above:
        parts.append(f"> {factor} x profile mean ({'+'.join(above)})")
    if top_by:
        parts.append(f"by {top_by}")
    return f"engagement filter ({', '.join(parts) or 'none'}): {before} -> {after} posts"
