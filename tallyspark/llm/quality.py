"""Quality by compression: a text is like the class whose dictionary makes it smaller.

Two Zstandard dictionaries are trained on whole labelled texts, one on good and one on bad texts. A text is cut into
blocks (a dictionary helps at the start of what is compressed, so long texts would else drown it); each block is
compressed with either dictionary. (bad size - good size) / (bad size + good size), summed over all blocks, becomes a
score by a logistic curve fitted on labelled texts that the dictionaries weren't trained on.

The fit reads at most `fit_docs` labelled texts of each class in expectation, drawn by a hash of the identifier, and uses each of them whole:
that is its documented bound. Half of a class trains its dictionary, the other half fits the curve. Scoring reads every whole text.

Cases. Null and empty texts have difference 0 and the score of it. Labels that are null, or other than 0 and 1, aren't learned from;
a document with both labels counts as good. Rows repeated are scored each; of several texts of one identifier the least is learned from. Without labels of both classes every score is 0.5; classes too small
to train a dictionary on give one of their texts side by side. Columns named difference, score or predicted pass by with `_in` after
their names, other columns as they are; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import aside, every, short_batches, small, unit_hash

#: Bytes of a dictionary and of a block, and the length of the segments that training picks.
FIT_DOCS, DICTIONARY, BLOCK, SEGMENT, LEVEL, CUT = 2500, 200_000, 700, 256, 9, 0.7


class CompressionModel:
    """good, bad: the dictionaries' bytes; slope, offset: the curve from difference to score."""

    def __init__(self, good: bytes = b"", bad: bytes = b"", slope: float = 0.0, offset: float = 0.0):
        self.good, self.bad, self.slope, self.offset = good, bad, slope, offset
        self.tools = None

    def __getstate__(self):
        return self.__dict__ | {"tools": None}

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if self.tools is None:
            self.tools = []
            for raw in (self.bad, self.good):
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self.tools

    def difference(self, text: str | None) -> float:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw or not self.good or not self.bad:
            return 0.0
        by_bad, by_good = self._compressors()
        bad = good = 0
        for i in range(0, len(raw), BLOCK):
            part = raw[i : i + BLOCK]
            bad += len(by_bad.compress(part))
            good += len(by_good.compress(part))
        return (bad - good) / (bad + good)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self.difference(text) + self.offset))))

    @classmethod
    def fit(cls, texts: Sequence[str], labels: Sequence[int]) -> CompressionModel:
        """Every other text of each class trains its dictionary, the rest fits the curve."""
        by = {q: [t for t, y in zip(texts, labels) if y == q and t] for q in (0, 1)}
        if not by[0] or not by[1]:
            return cls()
        # dictionaries of one size, as the larger one would shrink any text more
        raw = {q: [t.encode("utf-8", "surrogatepass") for t in ts[::2]] for q, ts in by.items()}
        size = min(DICTIONARY, *(sum(map(len, r)) // 3 for r in raw.values()))
        model = cls(dictionary(raw[1], size), dictionary(raw[0], size))
        rest = [(t, q) for q, ts in by.items() for t in (ts[1::2] or ts)]
        x = np.array([model.difference(t) for t, _ in rest])
        y = np.array([q for _, q in rest], dtype=float)
        weight = np.array([len(by[q]) / sum(k == q for _, k in rest) for q in (0, 1)])[y.astype(int)]
        model.slope, model.offset = _logistic(x, y, weight / weight.sum())
        return model


def dictionary(samples: Sequence[bytes], size: int) -> bytes:
    """A Zstandard dictionary trained on whole texts; where they are too few or too short for that, the texts themselves."""
    try:
        return zstandard.train_dictionary(size, list(samples), level=LEVEL, k=SEGMENT, d=8).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton's method with a slight penalty on the slope, on the standardised difference."""
    scale = max(float(x.std()), 1e-9)
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ w)))
        g = z.T @ (weight * (p - y)) + np.array([1e-3, 0]) * w
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(h, g)
        w -= step / max(1.0, float(np.abs(step).max()))
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS) -> CompressionModel:
    """Fit on a bounded sample of labelled documents. docs, labels: only rows that may be learned from."""
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if set(counts) != {0, 1}:
        return CompressionModel()
    # both classes are drawn at rates of their own; the curve is weighted back to the classes' true shares
    u = unit_hash(F.lit("quality"), F.col("id"))
    rate = F.when(F.col("y") == 1, min(1.0, fit_docs / counts[1])).otherwise(min(1.0, fit_docs / counts[0]))
    chosen = marks.filter(u < rate).withColumn("u", u)
    # an identifier that several rows have gives one text, so what is collected is bounded by the draw
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small(chosen, 40), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("u").alias("u"), F.first("y").alias("y"))
    rows = texts.select("u", "id", "text", "y").collect()
    rows.sort(key=lambda r: (r["u"], str(r["id"]), r["text"] or ""))
    model = CompressionModel.fit([r["text"] for r in rows], [r["y"] for r in rows])
    if model.good:
        seen = {q: max(1, sum(r["y"] == q for r in rows)) for q in (0, 1)}
        model.offset += float(np.log(counts[1] / counts[0]) - np.log(seen[1] / seen[0]))
    return model


def score_quality(docs: DataFrame, model: CompressionModel, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """docs with difference, score and predicted."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("difference double, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            d = np.array([own.difference(t if isinstance(t, str) else None) for t in texts], dtype=float)
            yield pd.DataFrame({"difference": d, "score": 1 / (1 + np.exp(-(own.slope * d + own.offset)))})

    docs, text_col = aside(docs, ["difference", "score", "predicted"], text_col)
    out = docs.select("*", judge(F.col(f"`{text_col}`")).alias("__quality")).select(*every(docs), "__quality.*")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
