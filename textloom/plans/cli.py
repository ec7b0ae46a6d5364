"""python -m textloom.plans.cli --input-dir ... --output-dir ...: the analysis from the command line."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from textloom.functions import defaults
from textloom.functions.lexicons import SentimentLexicon, Taxonomy, load_stopwords
from textloom.operators.filters import by_dates
from textloom.operators.language import MIN_CONFIDENCE, MIN_MARGIN, wanted_languages
from textloom.plans import analysis
from textloom.sources.sinks import Outputs, corpus_of
from textloom.sources.tables import exists, read_tables

STEPS = ("all", "lang", "prep", "cluster", "graph", "discourse-init", "discourse-apply")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--step", choices=STEPS, default="all")
    p.add_argument("--input-dir", default="data/output")
    p.add_argument("--output-dir", default="data/analysis")
    p.add_argument("--corpus-id")
    p.add_argument("--n-clusters", type=int)
    p.add_argument("--min-comment-length", type=int, default=15)
    p.add_argument("--min-co-comments", type=int, default=2)
    p.add_argument("--date-from")
    p.add_argument("--date-to")
    p.add_argument("--export-metrics", action="store_true")
    p.add_argument("--languages", default="es")
    p.add_argument("--min-language-confidence", type=float, default=MIN_CONFIDENCE)
    p.add_argument("--min-language-margin", type=float, default=MIN_MARGIN)
    p.add_argument("--keep-unknown-language", action="store_true")
    p.add_argument("--overwrite-discourse-templates", action="store_true")
    p.add_argument("--sentiment-lexicon")
    p.add_argument("--taxonomy")
    p.add_argument("--stopwords")
    return p


def options(a: argparse.Namespace) -> analysis.Options:
    return analysis.Options(
        date_from=a.date_from, date_to=a.date_to, languages=wanted_languages(a.languages), min_confidence=a.min_language_confidence, min_margin=a.min_language_margin,
        keep_unknown=a.keep_unknown_language, min_length=a.min_comment_length, n_clusters=a.n_clusters, min_common=a.min_co_comments, metrics=a.export_metrics,
        overwrite_templates=a.overwrite_discourse_templates,
        stopwords=load_stopwords(a.stopwords) if a.stopwords else defaults.STOPWORDS, sentiment=SentimentLexicon.load(a.sentiment_lexicon) if a.sentiment_lexicon else defaults.SENTIMENT,
        taxonomy=Taxonomy.load(a.taxonomy) if a.taxonomy and Path(a.taxonomy).exists() else Taxonomy(),
    )


def run_step(spark: SparkSession, step: str, input_dir: str, out: Outputs, o: analysis.Options) -> None:
    """One step on what the steps before it have stored; FileNotFoundError or ValueError if that is not there or holds nothing."""
    if step == "all":
        analysis.run_all(spark, input_dir, out, o)
        return
    if step == "cluster":
        analysis.cluster_step(out.read("comments_enriched"), out, o)
        return
    if step == "discourse-init":
        analysis.discourse_init(out, o)
        return
    posts, comments = read_tables(spark, input_dir)
    posts, comments = by_dates(posts, comments, o.date_from, o.date_to)
    if step == "lang":
        analysis.lang_step(comments, out, o)
    elif step == "prep":
        stored = exists(spark, out.readable("comments_for_analysis"))
        analysis.prep_step(posts, out.read("comments_for_analysis") if stored else comments, out, o)
    elif step == "graph":
        analysis.graphs(posts, comments, out, o)
    else:
        analysis.apply_labels(posts, out, o)
        analysis.graphs(posts, comments, out, o, out.read("comments_discourse"), out.read("clusters_summary_discourse"))


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    out = Outputs(spark, a.output_dir, corpus_of(a.corpus_id, a.output_dir, a.input_dir))
    try:
        run_step(spark, a.step, a.input_dir, out, options(a))
    except (FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
