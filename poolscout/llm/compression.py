"""Quality classifier by compression: zstandard dictionaries of good and of bad text; how much better one of them compresses a
text, relative to its size, becomes a calibrated score."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


@dataclass(frozen=True)
class Compression:
    """``sample`` labelled rows of each class at most make a dictionary, and ``calibration`` rows of each class the calibration;
    rows over ``longest`` characters are not used for either. Texts are scored whole, in blocks of ``block`` bytes that are each
    compressed on their own, so that the dictionaries matter in long texts too."""

    sample: int = 2000
    calibration: int = 2000
    longest: int = 20_000
    dictionary: int = 65_536
    block: int = 2048
    level: int = 3


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    # a raw dictionary holds the content alone; a trained one carries its tables too
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(data: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, block: int) -> float:
    """Compressed size by the bad dictionary less that by the good one, over their sum: above 0 for text like the good."""
    a = b = 0
    for at in range(0, len(data), block):
        piece = data[at : at + block]
        a += len(good.compress(piece))
        b += len(bad.compress(piece))
    return (b - a) / (a + b) if a + b else 0.0


def train_dictionary(texts: list[bytes], size: int, block: int) -> bytes:
    """A trained dictionary; of too little text to train on, the text itself is one."""
    blocks = [t[at : at + block] for t in texts for at in range(0, len(t), block)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, blocks)) // 4)), blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:] or b" " * 8


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    options: Compression

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(doc_id, difference, score)`` of every row; the score is the calibrated probability of good text. An empty or null
        text has difference 0. One pass without a shuffle."""
        model = self

        def run(batches):
            good, bad = _compressor(model.good, model.options.level), _compressor(model.bad, model.options.level)
            for batch in batches:
                diffs = np.array([difference(t.as_py() or b"", good, bad, model.options.block) for t in batch.column(1)], dtype=float)
                scores = 1 / (1 + np.exp(-np.clip(model.slope * diffs + model.offset, -700, 700)))
                yield pa.record_batch([batch.column(0), pa.array(diffs), pa.array(scores)], names=["doc_id", "difference", "score"])

        rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
        return rows.mapInArrow(run, "doc_id long, difference double, score double")


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of labels on differences by Newton's method, with a weak pull towards no slope."""
    if len(x) == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return 0.0, math.log(rate / (1 - rate))
    scale = float(np.std(x)) or 1.0
    design = np.column_stack((x / scale, np.ones_like(x)))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + np.array([1e-3, 0]) * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, options: Compression = Compression(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labelled rows outside fold 0: fold 1 calibrates, folds 2 to 4 make the dictionaries.

    The rows are a fixed sample, the least hashes of the id, of bounded size. Null labels and labels other than 0 and 1 are not
    used. Without labelled rows the score is 0.5 for every text.
    """
    spark = docs.sparkSession
    known = labels.select(labels["doc_id"].cast("long").alias("l_id"), labels[label_col].cast("int").alias("label")).where(
        "l_id IS NOT NULL AND label IN (0, 1)"
    )
    known = known.withColumn("fold", fold("l_id")).where("fold <> 0")
    text = docs[text_col].cast("string")
    texts = docs.select(docs[id_col].cast("long").alias("l_id"), text.alias("text")).where(
        F.col("text").isNotNull() & (F.length("text") <= options.longest)
    )
    chosen = None
    for label in (0, 1):
        for calibrating, most in ((True, options.calibration), (False, options.sample)):
            rows = known.where((F.col("label") == label) & ((F.col("fold") == 1) if calibrating else (F.col("fold") > 1)))
            part = rows.orderBy(F.xxhash64("l_id"), "l_id").limit(most).withColumn("calibrating", F.lit(calibrating))
            chosen = part if chosen is None else chosen.union(part)
    # at most 2 * (sample + calibration) rows of two numbers
    sample = texts.join(F.broadcast(chosen), "l_id")

    def train(group: pd.DataFrame) -> pd.DataFrame:
        data = [t.encode() for t in group.sort_values(["l_id", "text"])["text"]]
        return pd.DataFrame({"label": [int(group["label"].iloc[0])], "dictionary": [train_dictionary(data, options.dictionary, options.block)]})

    made = sample.where("NOT calibrating").groupBy("label").applyInPandas(train, "label int, dictionary binary").collect()
    dictionaries = {row["label"]: bytes(row["dictionary"]) for row in made}
    if set(dictionaries) != {0, 1}:
        return Model(b" " * 8, b" " * 8, 0.0, 0.0, options)
    raw = Model(dictionaries[1], dictionaries[0], 0.0, 0.0, options)
    held = sample.where("calibrating").select(F.col("l_id").alias("doc_id"), "text", "label")
    scored = raw.score(held.select((F.col("doc_id") * 2 + F.col("label")).alias("doc_id"), "text")).select("doc_id", "difference").collect()
    y = np.array([r["doc_id"] % 2 for r in scored], dtype=float)
    x = np.array([r["difference"] for r in scored], dtype=float)
    slope, offset = calibrate(x, y)
    return Model(dictionaries[1], dictionaries[0], slope, offset, options)
