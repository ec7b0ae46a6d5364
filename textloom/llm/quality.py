"""Text quality by compression with zstandard dictionaries of good and of bad text.

One dictionary is built from good and one from bad labelled texts. A text is compressed in blocks of BLOCK bytes, each on
its own, with either dictionary; the difference of the two compressed sizes over their sum says which it is more like.
A logistic fit over this, the compressed share of the text and their squares makes the score.

Defined results: a null text counts as empty; texts without a byte have the score of the fit's bias; without both labels in the training
rows every score is 1; repeated ids and equal texts give one row each; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common, toxicity

BLOCK, LEVEL, DICTIONARY = 256, 3, 110 << 10
#: Labelled ids of each label, at most, half for the dictionaries and half for the fit; toxicity.sample states the bounds on bytes.
SAMPLE = {0: 2400, 1: 2400}


def blocks(text: bytes) -> list[bytes]:
    return [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    import zstandard

    parts = [b for x in texts for b in blocks(x) if len(b) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, threads=0).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(parts)[-DICTIONARY:] or b" " * 8


class Model:
    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray) -> None:
        self.good, self.bad, self.weights = good, bad, weights
        self.ready: list | None = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "ready": None}

    def sizes(self, text: bytes) -> tuple[int, int, int]:
        """Bytes of the text, and compressed with either dictionary."""
        if self.ready is None:
            import zstandard

            self.ready = []
            for x in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(x)
                d.precompute_compress(level=LEVEL)
                self.ready.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        good, bad = self.ready
        parts = blocks(text)
        return len(text), sum([len(good(b)) for b in parts]), sum([len(bad(b)) for b in parts])

    @staticmethod
    def features(sizes: np.ndarray) -> np.ndarray:
        n, good, bad = sizes.astype(np.float64).T
        both = np.maximum(good + bad, 1)
        d, share = 10 * (good - bad) / both, both / np.maximum(2 * n, 1)
        short = 1 / np.sqrt(n + 16.0)
        return np.stack((d, d * d, share, share * share, d * share, 4 * short), axis=1)

    def probability(self, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(sizes) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def trained(rows: list[tuple[str, int]]) -> Model | None:
    """Every other text goes to the dictionaries, the rest to the fit; None unless both labels are in both."""
    for_dictionary, for_fit = rows[::2], rows[1::2]
    if any(len({y for _, y in x}) < 2 for x in (for_dictionary, for_fit)):
        return None
    pick = lambda label: [t.encode() for t, y in for_dictionary if y == label]
    model = Model(dictionary(pick(1)), dictionary(pick(0)), np.zeros(7))
    sizes = np.array([model.sizes(t.encode()) for t, _ in for_fit])
    model.weights = toxicity.logistic(model.features(sizes), np.array([float(y) for _, y in for_fit]))
    return model


def scored(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, predicted of each row."""
    if model is None:
        return df.select(id_col, F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    shipped = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shipped.value
        for batch in batches:
            for b in common.pieces(batch, text_col):
                sizes = np.array([m.sizes(x) for x in common.raw_texts(b, text_col)]).reshape(-1, 3)
                p = m.probability(sizes)
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return common.by_arrow(df.select(id_col, text_col), run, f"`{id_col}` {kind}, score double, predicted int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = common.id_mod("doc_id", 3) == 1
    model = trained(toxicity.sample(docs, common.table(spark, sf_dir, "labels").where(~held_out), label_col="quality", sizes=SAMPLE))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
