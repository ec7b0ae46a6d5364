"""Discourse labels from a taxonomy: by lexicon, from reviewed clusters, and for posts from their comments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.lexicons import Taxonomy
from textloom.functions.values import stripped, truthy
from textloom.operators import phrases as P

# The two stances that are weighed against each other, and the number of signals shown.
STANCES, SIGNALS = ("feminist", "antifeminist"), 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _tagged(k: int) -> Callable[[Column], Column]:
    return lambda e: e.tag == k


def discourse(text: Column, taxonomy: Taxonomy, compose: bool = True) -> Column:
    """Struct of label, category_label, both stance scores and signals.

    The first category, in order of priority, with a phrase in the text is the label, unless it is a stance; stances count their phrases,
    and the greater count is the label, `mixed` if both have some, `neutral` if none has. Blank text is `unlabeled`.
    """
    used = [c for c in taxonomy.categories if c.id != "neutral"]
    listed = [(k, t) for k, c in enumerate(used) for t in c.terms if t]
    ids = F.array(*[F.lit(c.id) for c in used]).cast("array<string>")
    labels = F.array(*[F.lit(c.label) for c in used]).cast("array<string>")
    stance = {s: next((k for k, c in enumerate(used) if c.id == s), -1) for s in STANCES}

    def judged(hits: Column) -> Column:
        first = F.get(F.filter(hits, lambda e: ~e.tag.isin(*stance.values())), F.lit(0))
        # what comes after the first other category is never looked at
        seen = F.when(first.isNull(), hits).otherwise(F.slice(hits, 1, F.array_position(hits, first).cast("int")))

        def weighed(s: Column) -> Column:
            fem, anti = (F.size(F.filter(s, _tagged(k))).cast("double") for k in stance.values())
            by_stance = F.when((fem > 0) & (anti > 0), "mixed").when(fem > anti, STANCES[0]).when(anti > fem, STANCES[1]).otherwise("neutral")
            signals = F.array_join(F.slice(F.transform(s, lambda e: F.concat(F.lit("+"), F.get(ids, e.tag), F.lit(":"), e.phrase)), 1, SIGNALS), ";")
            return F.struct(F.coalesce(F.get(ids, first.tag), by_stance).alias("label"), F.coalesce(F.get(labels, first.tag), by_stance).alias("category_label"), fem.alias("score_feminist"), anti.alias("score_antifeminist"), signals.alias("signals"))

        return _let(seen, weighed)

    def whole(t: Column) -> Column:
        found = _let(P.matched(t, P.entries(listed), P.words(t), P.single_words(listed)), judged)
        blank = F.struct(F.lit("unlabeled").alias("label"), F.lit("").alias("category_label"), F.lit(0.0).alias("score_feminist"), F.lit(0.0).alias("score_antifeminist"), F.lit("").alias("signals"))
        return F.when(t == "", blank).otherwise(found)

    return _let(T.plain_text(text, compose), whole)


def with_discourse(df: DataFrame, taxonomy: Taxonomy, text_col: str = "comment_text", compose: bool = True) -> DataFrame:
    d = df.select("*", F.explode(F.array(discourse(F.col(text_col), taxonomy, compose))).alias("__d"))
    new = {"discourse_label": "label", "discourse_stance": "label", "discourse_score_feminist": "score_feminist", "discourse_score_antifeminist": "score_antifeminist", "discourse_signals": "signals"}
    return d.select(*[c for c in df.columns if c not in new], *[F.col(f"__d.{v}").alias(k) for k, v in new.items()])


def cluster_categories(labels: DataFrame, taxonomy: Taxonomy, order_col: str | None = None) -> DataFrame:
    """cluster, category and its label from reviewed rows; of several rows for a cluster the last counts, blanks don't."""
    kept = labels.where(truthy(F.col("reviewed")) & (stripped(F.col("cluster_id")) != "") & (stripped(F.col("discourse_category_id")) != ""))
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    last = kept.select(stripped(F.col("cluster_id")).alias("__cluster"), stripped(F.col("discourse_category_id")).alias("__category"), order.alias("__o")).groupBy("__cluster").agg(F.max_by("__category", "__o").alias("__category"))
    names = {c.id: c.label for c in taxonomy.categories}
    label = F.col("__category")
    for i, name in names.items():
        label = F.when(F.col("__category") == i, F.lit(name)).otherwise(label)
    return last.withColumn("__label", label)


def from_clusters(df: DataFrame, labels: DataFrame, taxonomy: Taxonomy, order_col: str | None = None) -> DataFrame:
    """Comments with the category of their cluster, where a reviewer gave one."""
    marks = cluster_categories(labels, taxonomy, order_col)
    j = df.join(marks, stripped(df["cluster_id"]) == marks["__cluster"], "left")
    has = F.col("__category").isNotNull()
    j = j.withColumns({"discourse_category_id": F.coalesce("__category", F.lit("")), "discourse_category_label": F.coalesce("__label", F.lit("")), "discourse_source": F.when(has, "cluster").otherwise("unlabeled")})
    for c in ("discourse_label", "discourse_stance"):
        j = j.withColumn(c, F.when(has, F.col("__category")).otherwise(F.col(c) if c in df.columns else F.lit("")))
    return j.drop("__cluster", "__category", "__label")


def relabelled(df: DataFrame, taxonomy: Taxonomy, text_col: str = "comment_text", only_unlabelled: bool = True, compose: bool = True) -> DataFrame:
    """Rows that no cluster labels get their label from the lexicon, unless it says neutral; the category's label is its id."""
    d = df.select("*", F.explode(F.array(discourse(F.col(text_col), taxonomy, compose))).alias("__d"))
    free = F.lit(True) if not only_unlabelled else F.coalesce(F.col("discourse_source"), F.lit("")) != "cluster"
    hit = free & ~F.col("__d.label").isin("", "neutral", "unlabeled")
    new = {**dict.fromkeys(("discourse_label", "discourse_stance", "discourse_category_id", "discourse_category_label"), F.col("__d.label")), "discourse_score_feminist": F.col("__d.score_feminist"), "discourse_score_antifeminist": F.col("__d.score_antifeminist"), "discourse_signals": F.col("__d.signals"), "discourse_source": F.lit("lexical")}
    return d.withColumns({k: F.when(hit, v).otherwise(F.col(k) if k in df.columns else F.lit(None)) for k, v in new.items()}).drop("__d")


def extra_terms(labels: DataFrame, summary: DataFrame, min_length: int = 3) -> DataFrame:
    """category, term of the reviewed clusters' top terms, to add to the lexicon."""
    kept = labels.where(truthy(F.col("reviewed")) & (stripped(F.col("discourse_category_id")) != ""))
    terms = summary.select(stripped(F.col("cluster_id")).alias("__c"), F.col("top_terms").alias("__t"))
    own = F.col("top_terms") if "top_terms" in labels.columns else F.lit("")
    j = kept.join(terms, stripped(kept["cluster_id"]) == terms["__c"], "left").select(stripped(F.col("discourse_category_id")).alias("category"), F.coalesce(F.nullif("__t", F.lit("")), own, F.lit("")).alias("t"))
    out = j.select("category", F.explode(F.split(F.replace("t", F.lit("|"), F.lit(";")), ";")).alias("term"))
    return out.select("category", stripped(F.col("term")).alias("term")).where(F.length("term") >= min_length)


def updated_summary(summary: DataFrame, labels: DataFrame, taxonomy: Taxonomy, order_col: str | None = None) -> DataFrame:
    """A cluster summary whose reviewed clusters have their category, its label, and the label for their name."""
    marks = cluster_categories(labels, taxonomy, order_col)
    j = summary.join(marks, stripped(summary["cluster_id"]) == marks["__cluster"], "left")
    for c, v in (("discourse_category_id", "__category"), ("discourse_category_label", "__label"), ("narrative_label", "__label")):
        j = j.withColumn(c, F.coalesce(F.col(v), F.col(c) if c in summary.columns else F.lit("")))
    return j.drop("__cluster", "__category", "__label")


def dominant_labels(comments: DataFrame, key: str = "post_id", label: str = "discourse_category_id", name: str | None = "discourse_category_label") -> DataFrame:
    """Of each key the most frequent label that isn't blank, its name, the counts of all labels, and the number of rows; ties go to the label that sorts first."""
    kept = comments.where(stripped(F.col(label)) != "").select(key, F.col(label).alias("l"), (F.col(name) if name else F.lit("")).alias("n"))
    counts = kept.groupBy(key, "l").agg(F.count("*").alias("c"), F.min("n").alias("n"))
    best = Window.partitionBy(key).orderBy(F.desc("c"), "l")
    ranked = counts.withColumn("r", F.row_number().over(best))
    rendered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "l"))), lambda x: F.concat(x.l, F.lit(":"), (-x.c).cast("string"))), ";")
    top = lambda c: F.max(F.when(F.col("r") == 1, F.col(c)))
    return ranked.groupBy(key).agg(top("l").alias("dominant_comment_category_id"), F.coalesce(F.nullif(top("n"), F.lit("")), top("l")).alias("dominant_comment_category_label"), rendered.alias("comment_label_counts"), F.sum("c").alias("n_labeled_comments"))


def labelled_posts(posts: DataFrame, comments: DataFrame, taxonomy: Taxonomy | None = None, compose: bool = True) -> DataFrame:
    """Posts with the label of their caption, and that of most of their comments, which comes first."""
    caption = discourse(F.col("caption"), taxonomy, compose) if taxonomy else F.struct(F.lit("unlabeled").alias("label"), F.lit("").alias("signals"))
    p = posts.select("post_id", "profile_username", "source_hashtag", caption.alias("d"))
    j = p.join(dominant_labels(comments), "post_id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return j.select("post_id", "profile_username", "source_hashtag", F.col("d.label").alias("caption_discourse_label"), F.col("d.signals").alias("caption_discourse_signals"), blank("dominant_comment_category_id").alias("dominant_comment_category_id"), blank("dominant_comment_category_label").alias("dominant_comment_category_label"), blank("comment_label_counts").alias("comment_label_counts"), F.coalesce("n_labeled_comments", F.lit(0)).alias("n_labeled_comments"), F.coalesce("dominant_comment_category_id", F.col("d.label")).alias("post_discourse_label"))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of each combination, most frequent first, then by value."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)
