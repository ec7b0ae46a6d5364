"""The corpus pipeline: each stage works on all that the one before it kept, and keeps the columns of documents.

Toxic texts go, then texts without a language, then all but one of each group of near copies, then texts that hold a
benchmark item; what is left is encoded. Models are trained on the stage's own input: toxicity on its labelled rows
(labels that are null or missing teach nothing), language ID on its rows with a language.

Defined results: null and empty texts are not toxic, and go in the language stage, as do texts without a letter; a null id is an id like any
other; rows alike in id and text are copies of each other, of which near_copies keeps the one with the least hash of all its columns,
and of a group's texts the one of the least id, null ids last; where no row has a language, all rows go; without both labels nothing is toxic; further
columns stay as they are, whatever their names, up to the last stage; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, common, decontam, lang_id, toxicity
from textloom.llm import near_copies as near


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are not predicted toxic."""
    model = toxicity.trained(toxicity.sample(docs, common.table(spark, sf_dir, "labels")))
    return toxicity.without_toxic(docs, model)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the languages that the rows name; null and letterless texts go."""
    return lang_id.with_language(docs, lang_id.fitted(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group that five-word shingles link at a similarity of 0.8, that of the least id."""
    return near.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold no benchmark item."""
    return decontam.cleaned(docs, common.table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of ids and decoded text."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("bpe", encode),
]

#: Classifiers, fingerprints and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written in the shared folder and read again, as the next one's input; then the input before goes."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, f"pipeline-{name}")
            if before:
                common.remove(spark, before)
            before = common.last_written()
    return docs
