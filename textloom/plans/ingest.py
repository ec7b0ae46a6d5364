"""From saved raw files to the stored tables: import by tag, engagement filter, incremental merge, and what is still to do."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import filters, merge
from textloom.sources import normalize
from textloom.sources.tables import COMMENTS, POSTS, Corpus, import_tags, read_corpora, read_tags
from textloom.streaming.upsert import VersionedTable


@dataclass
class IngestOptions:
    max_posts: int = 40
    minimums: dict[str, float] = field(default_factory=dict)
    above: list[str] | None = None
    factor: float = 1.0
    top_by: str | None = None
    keep: int | None = None


class Store:
    """Posts and comments as versioned tables in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, folder = spark, folder.rstrip("/")
        self.posts_table, self.comments_table = VersionedTable(spark, f"{folder}/posts"), VersionedTable(spark, f"{folder}/comments")

    def _read(self, table: VersionedTable, columns: list[str]) -> DataFrame:
        df = table.read()
        return df if df is not None else self.spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))

    @property
    def posts(self) -> DataFrame:
        return self._read(self.posts_table, POSTS)

    @property
    def comments(self) -> DataFrame:
        return self._read(self.comments_table, COMMENTS)

    def add(self, posts: DataFrame | None = None, comments: DataFrame | None = None, replace_for: DataFrame | None = None) -> dict[str, int]:
        """Merges new rows; with replace_for, old comments on these posts go first. Each table is written once, and then swapped."""
        counts = {}
        if posts is not None:
            old = self.posts
            self.posts_table.replace(merge.upsert(old, posts, "post_id", POSTS))
            counts |= {f"posts_{k}": v for k, v in merge.merge_counts(old, posts, self.posts).items()}
        if comments is not None:
            old = self.comments
            kept = old if replace_for is None else filters.without_keys_of(old, replace_for, "post_id")
            self.comments_table.replace(merge.upsert(kept, comments, "comment_id", COMMENTS))
            counts |= {f"comments_{k}": v for k, v in merge.merge_counts(old, comments, self.comments).items()}
        return counts


def ingest_tags(store: Store, raw_dir: str, tags: list[str], scraped_at: str, corpus: str = "", o: IngestOptions | None = None) -> dict[str, int]:
    """The latest raw file of each tag, in one merge; run again with the same files, it changes nothing."""
    o = o or IngestOptions()
    raw = import_tags(store.spark, raw_dir, tags, o.max_posts)
    posts = normalize.posts(raw, "hashtags", scraped_at, corpus=corpus).withColumn("source_hashtag", F.lower("source_hashtag"))
    if o.minimums or o.above or o.top_by or o.keep:
        posts = filters.engaging(posts, o.minimums, o.above, o.factor, o.top_by, o.keep)
    return store.add(posts)


def ingest_comments(store: Store, raw: DataFrame, scraped_at: str, corpus: str = "") -> dict[str, int]:
    """Raw comments with a post_id column; those stored for the same posts are replaced."""
    new = normalize.comments(raw, scraped_at, corpus=corpus)
    return store.add(comments=new, replace_for=new.select("post_id"))


def to_do(store: Store, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each tag's status, and the posts that still need comments, with the reference to fetch them by."""
    posts = filters.with_activity(store.posts)
    pending = merge.pending_posts(posts, store.comments)
    return merge.tag_status(store.posts, store.comments, tags), pending.select("post_id", normalize.post_ref(pending).alias("ref"))


def ingest_corpora(spark: SparkSession, config: str, raw_dir: str, out_dir: str, scraped_at: str, only: str | None = None, o: IngestOptions | None = None) -> dict[str, dict[str, int]]:
    """Every corpus of a configuration, each in a folder of its own; ValueError if `only` names none."""
    corpora: list[Corpus] = [c for c in read_corpora(config) if only is None or c.id == only]
    if not corpora:
        raise ValueError(f"no corpus {only}")
    out = {}
    for c in corpora:
        tags = [x.tag for x in read_tags(spark, c.tags_file).collect()]  # a list that people write
        out[c.id] = ingest_tags(Store(spark, f"{out_dir.rstrip('/')}/{c.id}"), raw_dir, tags, scraped_at, c.id, o)
    return out
