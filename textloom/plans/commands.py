"""python -m textloom.plans.commands ingest|web|publish ...: stored tables from raw files, and web documents from stored graphs."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.operators import merge
from textloom.plans import ingest, publish
from textloom.sources import sinks
from textloom.sources.tables import exists, import_tags, read_graphml, read_tags, shortcodes

METRICS = {"likes": "like_count", "views": "view_count", "comments": "comment_count"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest", help="raw files of hashtags into posts and comments")
    i.add_argument("--mode", choices=("hashtag", "hashtags", "dual", "multi"), default="hashtags")
    i.add_argument("--query", default="")
    i.add_argument("--hashtag-file", "--file", default="")
    i.add_argument("--raw-dir", default="data/raw")
    i.add_argument("--output-dir", default="data/output")
    i.add_argument("--max-posts", type=int, default=40)
    i.add_argument("--max-posts-per-hashtag", type=int)
    i.add_argument("--min-likes", type=int)
    i.add_argument("--min-views", type=int)
    i.add_argument("--min-comments-count", type=int)
    i.add_argument("--top-by", choices=tuple(METRICS))
    i.add_argument("--keep-top", type=int)
    i.add_argument("--above-profile-avg", default="")
    i.add_argument("--above-profile-avg-factor", type=float, default=1.0)
    i.add_argument("--resume", action="store_true", help="leave out hashtags whose posts all have comments")
    i.add_argument("--repair-posts", action="store_true")
    i.add_argument("--corpus-id", default="")
    i.add_argument("--corpora-config", default="")
    i.add_argument("--only-corpus", default="")
    w = sub.add_parser("web", help="the web document of one GraphML file")
    w.add_argument("--input", required=True)
    w.add_argument("--output", default="")
    w.add_argument("--min-degree", type=int, default=1)
    w.add_argument("--title", default="")
    w.add_argument("--corpus-id", default="")
    b = sub.add_parser("publish", help="web documents of all corpora of a folder, and their manifest")
    b.add_argument("--analysis-dir", default="data/analysis")
    b.add_argument("--output-dir", default="docs")
    return p


def ingest_options(a: argparse.Namespace) -> ingest.IngestOptions:
    minimums = {METRICS[k]: v for k, v in (("likes", a.min_likes), ("views", a.min_views), ("comments", a.min_comments_count)) if v}
    above = [METRICS[x.strip()] for x in a.above_profile_avg.split(",") if x.strip() in METRICS] or None
    return ingest.IngestOptions(a.max_posts_per_hashtag or a.max_posts, minimums, above, a.above_profile_avg_factor, METRICS.get(a.top_by), a.keep_top)


def run_ingest(spark: SparkSession, a: argparse.Namespace) -> dict:
    now, o = datetime.now(UTC).isoformat(timespec="seconds"), ingest_options(a)
    if a.mode in ("dual", "multi"):
        if not a.corpora_config:
            raise ValueError("this mode needs --corpora-config")
        return ingest.ingest_corpora(spark, a.corpora_config, a.raw_dir, a.output_dir, now, a.only_corpus or None, o)
    if a.mode == "hashtag":
        tags = [a.query.strip().lstrip("#")] if a.query.strip() else []
    else:
        tags = [x.tag for x in read_tags(spark, a.hashtag_file).collect()] if a.hashtag_file else []
    if not tags:
        raise ValueError("no hashtag was given")
    store = ingest.Store(spark, a.output_dir)
    if a.resume:
        asked = spark.createDataFrame([(t,) for t in tags], "tag string")
        done = {x.tag for x in merge.tag_status(store.posts, store.comments, asked).where("status = 'complete'").collect()}
        tags = [t for t in tags if t.lower().lstrip("#") not in done]
    counts = ingest.ingest_tags(store, a.raw_dir, tags, now, a.corpus_id, o) if tags else {}
    if a.repair_posts:
        old = store.posts
        new = merge.repaired_links(old, shortcodes(import_tags(spark, a.raw_dir)))
        counts["repaired"] = merge.changed(old, new, "post_id", "post_url")
        store.posts_table.replace(new)
    sinks.save_tables(store.posts, store.comments, a.output_dir)
    return counts


def run_web(spark: SparkSession, a: argparse.Namespace) -> str:
    if not exists(spark, a.input):
        raise FileNotFoundError(a.input)
    stem = Path(a.input).stem
    corpus = a.corpus_id or stem.removeprefix("graph_hashtags_").removeprefix("graph_")
    nodes, edges = read_graphml(spark, a.input)
    nodes = nodes.select("node_id", F.col("attributes.node_type").alias("node_type"), F.col("attributes.label").alias("label"))
    edges = edges.select("source", "target", F.coalesce("attributes.edge_type", F.lit("")).alias("edge_type"), F.coalesce(F.col("attributes.weight").cast("double"), F.lit(1.0)).alias("weight"))
    document = publish.document(nodes, edges, a.title or corpus, corpus, a.min_degree)
    path = a.output or f"docs/graphs/{stem}.json"
    document.select("document").coalesce(1).write.mode("overwrite").text(path)
    return path


def run_publish(spark: SparkSession, a: argparse.Namespace) -> str:
    """Every subfolder with hashtag edges is a corpus of the folder's name."""
    top = Path(a.analysis_dir)
    if not top.exists():
        raise FileNotFoundError(a.analysis_dir)
    found = [sinks.Outputs(spark, str(d), sinks.corpus_of(None, str(d), "")) for d in sorted(top.iterdir()) if d.is_dir()]
    found = [x for x in found if exists(spark, x.readable("edges_hashtag"))]
    manifest = publish.publish(found, a.output_dir)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.output_dir}/manifest.json")
    return manifest


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    try:
        print({"ingest": run_ingest, "web": run_web, "publish": run_publish}[a.command](spark, a))
    except (FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
