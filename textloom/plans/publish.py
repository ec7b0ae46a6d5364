"""Web documents of the hashtag graphs of corpora, and their manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import graph, metrics
from textloom.sources import sinks


def document(nodes: DataFrame, edges: DataFrame, title: str, corpus: str, min_degree: int = 1) -> DataFrame:
    """One row with the web document of a graph: nodes (node_id, node_type, label) get their degree and community."""
    degree = metrics.degrees(edges).select(F.col("node").alias("node_id"), "degree")
    community = metrics.communities(edges, vertices=nodes.select(F.col("node_id").alias("node"))).select(F.col("node").alias("node_id"), "community")
    n = nodes.join(degree, "node_id", "left").join(community, "node_id", "left").na.fill(0, ["degree"])
    return sinks.web_graph(n, edges.select("source", "target", "edge_type", "weight"), title, corpus, min_degree=min_degree)


def web_documents(outputs: list[sinks.Outputs], min_degree: dict[str, int] | None = None) -> DataFrame:
    """A row for each corpus with its document; ValueError if there is none. Communities come from the same deterministic kernel each time."""
    found = []
    for out in outputs:
        nodes, edges = out.read("nodes").where("node_type = 'hashtag'"), out.read("edges_hashtag").where("edge_type = 'hashtag_cooccurrence'")
        edges = edges.withColumn("weight", F.col("weight").cast("double"))
        found.append(document(nodes, edges, out.corpus, out.corpus, (min_degree or {}).get(out.corpus, 1)))
    if not found:
        raise ValueError("no corpus to publish")
    return reduce(DataFrame.unionByName, found)


def publish(outputs: list[sinks.Outputs], folder: str, min_degree: dict[str, int] | None = None) -> str:
    """Writes the documents, in place of all older ones, and returns the manifest."""
    docs = web_documents(outputs, min_degree)
    docs.write.mode("overwrite").partitionBy("corpus_id").json(f"{folder.rstrip('/')}/graphs")
    return sinks.manifest(docs.sparkSession.read.json(f"{folder.rstrip('/')}/graphs").withColumn("corpus_id", F.col("corpus_id").cast("string")))


def visible(nodes: DataFrame, edges: DataFrame, min_degree: int, min_weight: int = 1, hidden: list | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a viewer shows of a graph: nodes with sizes, edges, and the legend."""
    n, e = graph.subgraph(nodes, edges, min_degree, min_weight, hidden)
    return graph.scaled_sizes(n, "degree"), e, graph.legend(nodes, n)
