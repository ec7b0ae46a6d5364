"""The analysis from stored posts and comments to clusters, graphs and summaries, and the labelling workflow."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import defaults
from textloom.functions import text as T
from textloom.functions.lexicons import SentimentLexicon, Taxonomy, stopwords_for
from textloom.operators import clusters, discourse, filters, graph, language, merge, metrics, sentiment
from textloom.sources.durable import written
from textloom.sources.sinks import Outputs, save_taxonomy, save_template
from textloom.sources.tables import read_tables


@dataclass
class Options:
    """What a run can be told; lexicons and word lists are data, those of functions.defaults where none are given."""

    date_from: str | None = None
    date_to: str | None = None
    languages: list[str] | None = None
    min_confidence: float = language.MIN_CONFIDENCE
    min_margin: float = language.MIN_MARGIN
    keep_unknown: bool = False
    min_length: int = 15
    n_clusters: int | None = None
    min_common: int = 2
    starts: int = clusters.STARTS
    rounds: int = clusters.ROUNDS
    metrics: bool = False
    compose: bool = True
    overwrite_templates: bool = False
    model_rows: int = 500_000
    stopwords: dict[str, list[str]] = field(default_factory=lambda: defaults.STOPWORDS)
    sentiment: SentimentLexicon = field(default_factory=lambda: defaults.SENTIMENT)
    taxonomy: Taxonomy = field(default_factory=Taxonomy)
    rules: language.LanguageRules = field(default_factory=lambda: language.DEFAULT_RULES)
    sentences: dict[str, list[str]] = field(default_factory=lambda: defaults.SENTENCES)

    @property
    def every_stopword(self) -> list[str]:
        return stopwords_for(self.stopwords) if self.stopwords else []


def language_model(comments: DataFrame, o: Options) -> DataFrame:
    """Trigrams of the sample sentences and of the comments whose keywords alone name their language; of more than o.model_rows comments about so many are looked
    at, by a hash of the text."""
    n = comments.count()
    if n > o.model_rows:
        comments = comments.where(F.pmod(F.xxhash64("comment_text"), F.lit(1 << 40)) < int((1 << 40) * o.model_rows / n))
    known = language.self_labelled(comments, rules=o.rules, compose=o.compose)
    seeds = language.seed_rows(comments.sparkSession, o.sentences)
    return written(language.trigram_model(seeds.unionByName(known)), "trigrams")


def by_language(comments: DataFrame, o: Options, model: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept comments with language and confidence, and excluded ones with the reason. model: trigrams (lang, gram, logp, none); None: language_model's.

    Each comment is judged once, into a table that both sides read.
    """
    model = language_model(comments, o) if model is None else model
    judged = language.judged(language.with_statistics(comments, model, "comment_text"), "comment_text", F.col("statistical"), o.rules, o.compose)
    judged = written(judged.drop("statistical"), "judged")
    return language.split(judged, comments.columns, o.languages, "comment_text", o.min_confidence, o.min_margin, o.keep_unknown)


def enriched(posts: DataFrame, comments: DataFrame, o: Options, model: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Usable comments in the wanted languages with profile, texts, counts, discourse and sentiment; and the excluded ones."""
    stop = o.every_stopword
    usable = comments.where(T.usable(F.col("comment_text"), stop, o.min_length, o.compose))
    kept, out = by_language(usable, o, model)
    kept = merge.with_profile(kept, posts)
    text = F.col("comment_text")
    prepared = T.tokens(text, stop, o.compose)
    for lang, listed in o.stopwords.items():
        prepared = F.when(F.col("language") == lang, T.tokens(text, listed, o.compose)).otherwise(prepared)
    kept = kept.withColumns({"text_clean": T.normalized(text, o.compose), "text_for_cluster": F.array_join(prepared, " "), "hashtags_in_comment": T.hashtags(text), "mentions_in_comment": T.mentions(text)})
    kept = kept.withColumns({"char_count": F.length("text_clean"), "token_count": F.when(F.col("text_for_cluster") == "", 0).otherwise(F.size(F.split("text_for_cluster", " ")))})
    kept = discourse.with_discourse(kept, o.taxonomy, compose=o.compose)
    return sentiment.with_sentiment(kept, o.sentiment, compose=o.compose), out.withColumn("comment_text", F.substring("comment_text", 1, 300))


def write_sentiment(out: Outputs, rows: DataFrame) -> None:
    """The summaries of all rows and by language, from one pass."""
    both = sentiment.summarized_by(rows, "language")
    keep = [c for c in both.columns if c != "grouping"]
    both = written(both, "sentiment")
    out.write("sentiment_summary", both.where("grouping = 'all'").select(*keep))
    out.write("sentiment_by_language", both.where("grouping = 'language'").select(*keep).orderBy("group"))


def write_languages(out: Outputs, kept: DataFrame, excluded: DataFrame) -> None:
    out.write("language_summary", kept.groupBy("language").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "language"))
    out.write("language_excluded", excluded)
    out.write("exclusion_summary", excluded.groupBy("language", "exclusion_reason").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "language", "exclusion_reason"))


def lang_step(comments: DataFrame, out: Outputs, o: Options) -> DataFrame:
    """Comments with text in the wanted languages, with sentiment, before any other preparation; and what was excluded and why."""
    kept, excluded = by_language(filters.with_text(comments), o)
    kept = written(sentiment.with_sentiment(kept, o.sentiment, compose=o.compose), "for-analysis")
    out.write("comments_for_analysis", kept)
    write_languages(out, kept, written(excluded, "excluded"))
    write_sentiment(out, kept)
    return kept


def prep_step(posts: DataFrame, comments: DataFrame, out: Outputs, o: Options) -> DataFrame:
    rows, excluded = enriched(posts, comments, o)
    rows = written(rows, "enriched")
    out.write("comments_enriched", rows)
    write_languages(out, rows, written(excluded, "excluded"))
    write_sentiment(out, rows)
    out.write("discourse_summary", discourse.counts_by(rows.where(F.col("discourse_stance") != ""), "discourse_stance"))
    return rows


def cluster_step(rows: DataFrame, out: Outputs, o: Options) -> tuple[DataFrame, DataFrame]:
    """Enriched rows with their cluster, and the summary. ValueError if no row has a word that says something."""
    found = clusters.clustered(rows, o.every_stopword, o.n_clusters, starts=o.starts, rounds=o.rounds, compose=o.compose)
    marked = written(found.enriched, "clustered")
    out.write("comments_clustered", marked)
    by_cluster = sentiment.summarized(marked, "cluster_id")
    summary = written(sentiment.with_cluster_sentiment(found.summary, by_cluster), "cluster-summary")
    out.write("clusters_summary", summary)
    out.write("sentiment_by_cluster", by_cluster.orderBy("group"))
    return marked, summary


def discourse_init(out: Outputs, o: Options) -> bool:
    """The table that reviewers fill in, and a taxonomy to start from, beside the clusters; True if the table was written. Templates that are there stay unless
    overwrite_templates."""
    save_taxonomy(out, o.taxonomy, o.overwrite_templates)
    return save_template(out, out.read("clusters_summary"), o.overwrite_templates)


def run_all(spark, input_dir: str, out: Outputs, o: Options) -> dict[str, DataFrame]:
    """Every step. Between steps tables are Parquet in the shared folder; the CSV outputs are written beside them."""
    posts, comments = read_tables(spark, input_dir)
    posts, comments = filters.by_dates(posts, comments, o.date_from, o.date_to)
    rows = prep_step(posts, comments, out, o)
    marked, summary = cluster_step(rows, out, o)
    discourse_init(out, o)
    return graphs(posts, comments, out, o, marked, summary)


def graphs(posts: DataFrame, comments: DataFrame, out: Outputs, o: Options, rows: DataFrame | None = None, summary: DataFrame | None = None) -> dict[str, DataFrame]:
    """Nodes, edges and GraphML of the whole, the hashtags' and the users' graph, and the metrics if asked for; rows and summary as cluster_step gives them, or those stored."""
    rows = out.read("comments_clustered") if rows is None else rows
    summary = out.read("clusters_summary") if summary is None else summary
    parts = {name: written(df, f"graph-{name}") for name, df in graph.full_graph(posts, comments, rows, summary, o.min_common).items()}
    for name, df in parts.items():
        out.write("nodes" if name == "nodes" else f"edges_{name}", df)
    tags, users = graph.tag_nodes(posts), graph.user_nodes(posts, comments, rows)
    for name, nodes, edges in (("graph", parts["nodes"], parts["all"]), ("graph_hashtags", tags, parts["hashtag"].where("edge_type = 'hashtag_cooccurrence'")), ("graph_users", users, parts["user"])):
        out.write_graphml(name, nodes, edges)
    if o.metrics:
        vertices, e = metrics.tag_graph(tags, parts["hashtag"])
        ue, directed = metrics.user_graph(parts["user"])
        both = metrics.graph_metrics(e, "hashtags", vertices=vertices, with_eigenvector=True).unionByName(metrics.graph_metrics(ue, "users", directed))
        out.write("network_metrics", both)
        parts["metrics"] = both
    return parts


def apply_labels(posts: DataFrame, out: Outputs, o: Options) -> dict[str, DataFrame]:
    """The second half of the labelling workflow. ValueError if the taxonomy has categories and no label row names one."""
    labels, rows, summary = out.read("cluster_labels"), out.read("comments_clustered"), out.read("clusters_summary")
    if o.taxonomy.categories and filters.labelled(labels).isEmpty():
        raise ValueError("no cluster has a category yet")
    extra: dict[str, list[str]] = {}
    for x in discourse.extra_terms(labels, summary).collect():  # a few terms for each reviewed cluster
        extra.setdefault(x.category, []).append(x.term)
    lexicon = o.taxonomy.with_terms(extra)
    marked = discourse.relabelled(discourse.from_clusters(rows, labels, o.taxonomy), lexicon, compose=o.compose)
    out.write("comments_discourse", marked)
    written = out.read("comments_discourse")
    result = {"comments": written, "summary": discourse.updated_summary(summary, labels, o.taxonomy), "categories": discourse.counts_by(written, "discourse_category_id", "discourse_category_label"), "posts": discourse.labelled_posts(posts, written, lexicon, o.compose)}
    for stem, name in (("clusters_summary_discourse", "summary"), ("discourse_categories", "categories"), ("posts_discourse", "posts")):
        out.write(stem, result[name])
    return result
