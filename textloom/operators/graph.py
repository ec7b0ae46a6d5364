"""Edges, nodes and web documents of the social graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.values import split_tags, stripped, user_name
from textloom.sources.durable import parts, written

EDGES = "source string, target string, edge_type string, weight double"


def _edges(df: DataFrame, source: Column, target: Column, kind: Column | str, weight: Column) -> DataFrame:
    return df.select(source.alias("source"), target.alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("edge_type"), weight.cast("double").alias("weight"))


#: Members of a group whose pairs are made within one row; larger groups are dealt into blocks of about so many, and blocks meet in a join.
BLOCK = 2000
#: Rows and pairs that a task is dealt on average, and members whose names are broadcast at most.
ROWS, PAIRS, FEW = 500_000, 2_000_000, 500_000


def pairs(df: DataFrame, group: str, member: str, least: int = 1) -> DataFrame:
    """a < b and weight, the number of groups that hold both, from least on.

    Members are 64-bit hashes within. Each member of a group sends those behind it as one list to the member's own task, where they are counted: what is shuffled is
    a row for each member of a group, not for each pair. Tasks are as many as the pairs ask for. With least over 1, members of fewer groups go before any pair is made.
    """
    spark = df.sparkSession
    rows = df.select(F.col(group).alias("g"), F.col(member).alias("m")).where(F.col("g").isNotNull() & F.col("m").isNotNull()).withColumn("x", F.xxhash64("m"))
    names = written(rows.select("x", "m").distinct(), "members")
    near = F.broadcast if names.count() <= FEW else lambda d: d
    each = written(rows.select("g", "x").repartition(parts(spark, rows.count(), ROWS), "g", "x").distinct(), "groups")
    if least > 1:
        each = each.join(near(each.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("x")), "x", "left_semi")
    sizes = written(each.groupBy("g").agg(F.count("*").alias("c")), "sizes")
    n, made, most = sizes.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.expr("c * (c - 1) div 2")), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    large = sizes.where(F.col("c") > BLOCK).select("g", F.ceil(F.col("c") / BLOCK).cast("int").alias("k"))
    small = each.join(large, "g", "left_anti") if most > BLOCK else each
    one = small.repartition(parts(spark, n, ROWS), "g").groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("xs")).where(F.size("xs") > 1)
    lists = one.select("xs", F.posexplode("xs").alias("i", "a")).select("a", F.slice("xs", F.col("i") + 2, F.size("xs")).alias("bs")).where(F.size("bs") > 0)
    if most > BLOCK:  # blocks in the order of the hashes: what is in a later one is behind
        place = F.least(F.floor((F.col("x") / F.lit(2.0**64) + 0.5) * F.col("k")), F.col("k") - 1).cast("int")
        dealt = each.join(large, "g").withColumn("own", place)
        blocks = dealt.groupBy("g", F.col("own").alias("j")).agg(F.collect_list("x").alias("bs"))
        left = dealt.select("g", F.col("x").alias("a"), "own", F.explode(F.sequence("own", F.col("k") - 1)).alias("j"))
        behind = F.when(F.col("own") == F.col("j"), F.filter("bs", lambda b: b > F.col("a"))).otherwise(F.col("bs"))
        lists = lists.unionByName(left.join(blocks, ["g", "j"]).select("a", behind.alias("bs")).where(F.size("bs") > 0))
    counted = lists.repartition(parts(spark, made, PAIRS), "a").select("a", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("weight"))
    counted = counted.where(F.col("weight") >= least) if least > 1 else counted
    named = counted.join(near(names.select(F.col("x").alias("a"), F.col("m").alias("ma"))), "a").join(near(names.select(F.col("x").alias("b"), F.col("m").alias("mb"))), "b")
    return named.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"), "weight")


def tag_pairs(posts: DataFrame, key: str = "post_id", tags_col: str = "hashtags") -> DataFrame:
    """Edges between hashtags of one post; the weight is the number of posts. A post's tags are few, so its pairs are made within the row."""
    tags = posts.select(split_tags(F.col(tags_col)).alias("t")).where(F.size("t") > 1)
    both = tags.select(F.posexplode("t").alias("i", "a"), "t").select("a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("b"))
    counted = both.groupBy("a", "b").agg(F.count("*").alias("weight"))
    return _edges(counted, F.concat(F.lit("hashtag:"), "a"), F.concat(F.lit("hashtag:"), "b"), "hashtag_cooccurrence", F.col("weight"))


def user_tags(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Edges from profiles and commenters to hashtags: used in a caption, found by a search, used in a comment."""
    p = posts.select(user_name(F.col("profile_username")).alias("u"), split_tags(F.col("hashtags")).alias("t"), F.lower(stripped(F.col("source_hashtag"))).alias("s")).where("u <> ''")
    c = comments.select(user_name(F.col("author_username")).alias("u"), T.all_hashtags(F.col("comment_text")).alias("t")).where("u <> ''")
    lowered = F.array_distinct(F.filter(F.transform("t", lambda x: F.lower(F.regexp_replace(x, "^#+", ""))), lambda x: x != ""))
    rows = p.select("u", F.explode("t").alias("t"), F.lit("profile_uses_hashtag").alias("k"))
    rows = rows.unionByName(p.where("s <> ''").select("u", F.col("s").alias("t"), F.lit("profile_from_hashtag_search").alias("k")))
    rows = rows.unionByName(c.select("u", F.explode(lowered).alias("t"), F.lit("user_uses_hashtag_comment").alias("k")))
    counted = rows.groupBy("u", "t", "k").agg(F.count("*").alias("weight"))
    side = F.when(F.col("k").startswith("profile"), F.lit("profile:")).otherwise(F.lit("user:"))
    return _edges(counted, F.concat(side, "u"), F.concat(F.lit("hashtag:"), "t"), F.col("k"), F.col("weight"))


def co_commenters(comments: DataFrame, least: int = 2) -> DataFrame:
    """Edges between users who comment on the same posts, from `least` common posts on."""
    rows = comments.select("post_id", user_name(F.col("author_username")).alias("u")).where(T.valid_name(F.col("u")) & (stripped(F.col("post_id")) != ""))
    return _edges(pairs(rows, "post_id", "u", least), F.col("a"), F.col("b"), "co_comment", F.col("weight"))


def mention_edges(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Directed edges from authors to whom they mention; each occurrence counts, and so do mentions of oneself."""
    both = posts.select(F.col("profile_username").alias("u"), F.col("caption").alias("x"), F.lit("mention_post").alias("k")).unionByName(comments.select(F.col("author_username").alias("u"), F.col("comment_text").alias("x"), F.lit("mention_comment").alias("k")))
    rows = both.select(user_name(F.col("u")).alias("u"), "k", F.explode(T.valid_mentions(F.col("x"))).alias("m")).where(T.valid_name(F.col("u")))
    counted = rows.groupBy("u", "m", "k").agg(F.count("*").alias("weight"))
    return _edges(counted, F.col("u"), F.col("m"), F.col("k"), F.col("weight"))


def as_users(edges: DataFrame) -> DataFrame:
    return edges.withColumns({c: F.concat(F.lit("user:"), F.col(c)) for c in ("source", "target")})


def term_similarity(summary: DataFrame, key: str = "cluster_id", terms_col: str = "top_terms") -> DataFrame:
    """a, b, weight: Jaccard likeness of the term lists of two clusters that share a term. Pairs meet on a common term, so there is no cross join."""
    sets = summary.select(F.col(key).cast("string").alias("k"), F.array_distinct(F.filter(F.transform(F.split(terms_col, ";"), stripped), lambda t: t != "")).alias("s"))
    each = sets.select("k", F.size("s").alias("n"), F.explode("s").alias("t"))
    a, b = each.select(F.col("k").alias("a"), F.col("n").alias("na"), "t"), each.select(F.col("k").alias("b"), F.col("n").alias("nb"), "t")
    shared = a.join(b, "t").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return shared.select("a", "b", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 4).alias("weight"))


def narrative_edges(enriched: DataFrame, summary: DataFrame, order_col: str | None = None) -> DataFrame:
    """Edges from users and profiles to the narratives of their comments, and between like narratives.

    Where a cluster has several rows in summary its name is that of the first by order_col, by the label without one."""
    order = [F.col(c) for c in ((order_col,) if order_col else ()) + ("discourse_category_label",)]
    named = summary.groupBy(F.col("cluster_id").cast("string").alias("__c")).agg(F.min_by(F.coalesce(F.col("discourse_category_label"), F.lit("")), F.struct(*order)).alias("__n"))
    j = enriched.join(named, enriched["cluster_id"].cast("string") == named["__c"], "left")
    name = F.coalesce(F.nullif(stripped(F.col("__n")), F.lit("")), F.concat(F.lit("narrativa_"), F.col("cluster_id").cast("string")))
    out = []
    for side, column in (("user", "author_username"), ("profile", "profile_username")):
        rows = j.select(F.col(column).alias("u"), F.col("cluster_id").alias("c"), name.alias("n")).where(F.coalesce("u", F.lit("")) != "")
        counted = rows.groupBy("u", "c", "n").agg(F.count("*").alias("weight"))
        out.append(_edges(counted, F.concat(F.lit(f"{side}:"), "u"), F.concat(F.lit("narrative:"), "n"), f"{side}_narrative", F.col("weight")))
    like = term_similarity(summary)
    out.append(_edges(like, F.concat(F.lit("narrative:narrativa_"), "a"), F.concat(F.lit("narrative:narrativa_"), "b"), "narrative_similarity", F.col("weight")))
    return reduce(DataFrame.unionByName, out)


def tag_nodes(posts: DataFrame) -> DataFrame:
    """Hashtags with the number of posts that use them, and that a search for them found."""
    used = posts.select(F.explode(split_tags(F.col("hashtags"))).alias("t"), F.lit(1).alias("u"), F.lit(0).alias("s"))
    found = posts.select(F.lower(stripped(F.col("source_hashtag"))).alias("t"), F.lit(0).alias("u"), F.lit(1).alias("s")).where("t <> ''")
    counted = used.unionByName(found).groupBy("t").agg(F.sum("u").alias("post_count"), F.sum("s").alias("sourced_posts"))
    return counted.select(F.concat(F.lit("hashtag:"), "t").alias("node_id"), F.lit("hashtag").alias("node_type"), F.concat(F.lit("#"), "t").alias("label"), "post_count", "sourced_posts")


def _node(kind: str, label: Column) -> list[Column]:
    low = F.lower(label) if kind == "user" else label
    return [F.concat(F.lit(f"{kind}:"), low).alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label")]


def user_nodes(posts: DataFrame, comments: DataFrame, enriched: DataFrame | None = None) -> DataFrame:
    """Profiles and commenters; with enriched comments also their number of comments and a map of their stances."""
    profile = F.regexp_replace(stripped(F.col("profile_username")), "^@+", "")
    p = posts.select(profile.alias("u")).where("u <> ''").distinct().select(F.concat(F.lit("profile:"), F.lower("u")).alias("node_id"), F.lit("profile").alias("node_type"), F.col("u").alias("label"))
    source = comments if enriched is None else enriched
    author = F.regexp_replace(F.coalesce(F.col("author_username"), F.lit("")), "^@+", "")
    stance = F.col("discourse_stance") if "discourse_stance" in source.columns else F.lit(None).cast("string")
    counted = source.select(author.alias("u"), stance.alias("s")).where("u <> ''").groupBy("u", "s").agg(F.count("*").alias("n"))
    u = counted.groupBy("u").agg(F.sum("n").alias("comment_count"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "n"))))).alias("discourse_stances"))
    return p.unionByName(u.select(*_node("user", F.col("u")), "comment_count", "discourse_stances"), allowMissingColumns=True)


def all_nodes(posts: DataFrame, enriched: DataFrame, summary: DataFrame) -> DataFrame:
    """Profiles of posts and comments (one full outer join), users, narratives and hashtags; of a node that comes twice the later kind stays."""
    profile = F.regexp_replace(F.coalesce(F.col("profile_username"), F.lit("")), "^@+", "")
    a = posts.select(profile.alias("u")).where("u <> ''").distinct()
    b = enriched.select(F.col("profile_username").alias("u")).where("u <> ''").groupBy("u").agg(F.count("*").alias("comment_volume_on_posts"))
    profiles = a.join(b, "u", "full_outer").select(*_node("profile", F.col("u")), "comment_volume_on_posts", F.lit(0).alias("__o"))
    users = enriched.where(F.coalesce("author_username", F.lit("")) != "").groupBy(F.col("author_username").alias("u")).agg(F.count("*").alias("comment_count")).select(*_node("user", F.col("u")), "comment_count", F.lit(1).alias("__o"))
    label = stripped(F.col("discourse_category_label")) if "discourse_category_label" in summary.columns else F.lit("")
    name = F.coalesce(F.nullif(label, F.lit("")), F.concat(F.lit("narrativa_"), F.col("cluster_id").cast("string")))
    narratives = summary.select(*_node("narrative", name), F.col("cluster_id").cast("string").alias("cluster_id"), F.col("n_comments").cast("long").alias("n_comments"), F.substring("top_terms", 1, 500).alias("top_terms"), F.lit(2).alias("__o"))
    tags = tag_nodes(posts).withColumn("__o", F.lit(3))
    whole = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [profiles, users, narratives, tags])
    from textloom.operators.merge import keep_last

    return keep_last(whole, "node_id", [F.col("__o"), F.col("label")]).drop("__o")


def full_graph(posts: DataFrame, comments: DataFrame, enriched: DataFrame, summary: DataFrame, least: int = 2) -> dict[str, DataFrame]:
    """nodes, and the edge tables all, social, hashtag and user; `ord` says which set an edge came from, for collapsing. Each set is made once, into a table that all
    that hold it read."""
    social = written(as_users(mention_edges(posts, comments).unionByName(co_commenters(comments, least))), "social")
    tags = written(tag_pairs(posts).unionByName(user_tags(posts, comments)), "tags")
    narrative = written(narrative_edges(enriched, summary), "narrative")
    order = lambda sets: reduce(DataFrame.unionByName, [s.withColumn("ord", F.lit(k)) for k, s in enumerate(sets)])
    return {"nodes": all_nodes(posts, enriched, summary), "all": order([social, tags, narrative]), "social": order([social]), "hashtag": order([tags]), "user": order([social, narrative])}


def collapsed(edges: DataFrame, order_col: str = "ord") -> DataFrame:
    """One undirected edge for each pair of ends: the last one, with its direction, type and weight. Edges are made once, and dealt to as many tasks as they ask for."""
    edges = written(edges, "edges")
    ends = edges.withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")}).repartition(parts(edges.sparkSession, edges.count(), ROWS), "a", "b")
    last = ends.groupBy("a", "b").agg(F.max_by(F.struct("source", "target", "edge_type", "weight"), F.struct(order_col, "edge_type", "source", "target", "weight")).alias("e"))
    return last.select("e.*")


def subgraph(nodes: DataFrame, edges: DataFrame, min_degree: float, min_weight: float, hidden: list | None = None) -> tuple[DataFrame, DataFrame]:
    """What a viewer shows: nodes by their degree in the full graph, edges by weight with both ends kept, no node without an edge
    (unless one at most is left), then without hidden communities and those that this leaves alone."""
    kept = nodes.where(F.col("degree") >= min_degree)
    e = _between(edges.where(F.col("weight") >= min_weight), kept)
    kept = _connected(kept, e)
    if hidden:
        kept = kept.where(~F.col("community").isin(*hidden))
        e = _between(e, kept)
        kept = _connected(kept, e)
    return kept, e


def _between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("node_id")
    return edges.join(ids, edges["source"] == ids["node_id"], "left_semi").join(ids, edges["target"] == ids["node_id"], "left_semi")


def _connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("node_id")).union(edges.select("target")).distinct()
    few = nodes.limit(2).agg((F.count("*") <= 1).alias("few"))
    alone = nodes.join(F.broadcast(few).where("few"))
    return nodes.join(ends, "node_id", "left_semi").unionByName(alone.join(ends, "node_id", "left_anti").select(*nodes.columns))


# The palette of communities and the bounds of a node's size.
PALETTE_SIZE, SIZE = 20, (8.0, 36.0)


def shown(nodes: DataFrame, degree_col: str = "degree") -> DataFrame:
    """Nodes with size, palette place, and a label where theirs is blank. Narratives have a community of their own; ids that are no numbers are hashed."""
    posts = F.coalesce(F.nanvl(F.col("post_count").cast("double"), F.lit(0.0)), F.lit(0.0)) if "post_count" in nodes.columns else F.lit(0.0)
    size = F.least(F.greatest(6.0 + F.pow(F.greatest(F.col(degree_col).cast("double"), posts, F.lit(1.0)), F.lit(0.45)), F.lit(SIZE[0])), F.lit(SIZE[1]))
    community = F.when(F.col("node_type") == "narrative", "narrative").otherwise(F.col("community").cast("string"))
    number = community.try_cast("long")
    place = F.pmod(F.coalesce(number, F.crc32(F.coalesce(community, F.lit("")).cast("binary"))), F.lit(PALETTE_SIZE))
    label = F.coalesce(F.nullif(stripped(F.col("label")), F.lit("")), F.concat(F.lit("#"), F.regexp_replace("node_id", "^[^:]*:", "")))
    return nodes.withColumns({"community": community, "label": label, "size": size, "palette": place.cast("int")})


def scaled_sizes(df: DataFrame, value: str) -> DataFrame:
    """Values stretched to the bounds of a node's size; 14 if all are alike. One row of bounds is joined on."""
    bounds = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    size = F.when(F.col("__hi") == F.col("__lo"), 14.0).otherwise(SIZE[0] + (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (SIZE[1] - SIZE[0]))
    return df.join(F.broadcast(bounds)).withColumn("size", size).drop("__lo", "__hi")


def legend(nodes: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """Communities with their number of nodes, and of visible ones, most first."""
    rows = nodes.select("node_id", "community", F.lit(0).alias("v"))
    if visible is not None:
        rows = rows.join(visible.select("node_id", F.lit(1).alias("w")), "node_id", "left").select("node_id", "community", F.coalesce("w", F.lit(0)).alias("v"))
    return rows.groupBy("community").agg(F.count("*").alias("node_count"), F.sum("v").alias("visible_count")).orderBy(F.desc("node_count"), "community")


def bounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """max_degree and max_weight, 1 where there is none."""
    a = nodes.agg(F.coalesce(F.max("degree"), F.lit(1)).cast("long").alias("max_degree"))
    b = edges.agg(F.coalesce(F.max(F.col("weight").cast("long")), F.lit(1).cast("long")).alias("max_weight"))
    return a.join(F.broadcast(b))


def first_by_community(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("community").agg(F.count("*").alias("node_count"), F.min("palette").alias("palette")).withColumn("r", F.row_number().over(Window.orderBy(F.desc("node_count"), "community")))
