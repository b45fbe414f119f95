"""Quality by compression: a text costs fewer bytes against a dictionary of its own kind.

zstandard dictionaries of several sizes are trained on good and on bad labelled texts. A text is compressed with each pair, in
blocks of two lengths so that its own repeats don't hide the dictionaries; the differences of the two sizes over their
sums become a score by a logistic model of them, their squares and products, which is fitted on labelled
texts that the dictionaries haven't seen. Nothing else of a text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestframe.llm.common import draw, fold, read

#: Bounds of what is learned from: labelled rows a class, and characters of a text.
ROWS_A_CLASS, CHARS = 2_000, 20_000
#: Of them the dictionaries get this share, the rest calibrates the score.
DICTIONARY_SHARE = 0.4
#: Bytes of the dictionaries, bytes of the blocks that a text is compressed in, and the compression level.
DICTIONARIES, BLOCKS, LEVEL = (112_640, 16_384, 4_096), (256, 2_048), 3
#: Bytes of the pieces that dictionaries are trained on.
PIECE = 512


@dataclass
class Model:
    """Pairs of dictionaries (good, bad), and the score's scaling and weights. Without texts of both classes every score is ``prior``."""

    pairs: tuple[tuple[bytes, bytes], ...] = ()
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None
    weights: np.ndarray | None = None
    prior: float = 0.5

    def score(self, differences: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(differences), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.terms(differences) @ self.weights, -40, 40)))

    def terms(self, differences: np.ndarray) -> np.ndarray:
        """One, the scaled differences, and their squares and products."""
        d = np.clip((differences - self.mean) / self.deviation, -4, 4)
        i, j = np.triu_indices(d.shape[1])
        return np.column_stack([np.ones(len(d)), d, d[:, i] * d[:, j]])


class Sizer:
    """Normalised differences of a whole text's compressed sizes, by pair of dictionaries and block."""

    def __init__(self, pairs: tuple[tuple[bytes, bytes], ...]) -> None:
        import zstandard

        def compressor(data: bytes):
            trained = zstandard.ZstdCompressionDict(data)
            trained.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.pairs = [(compressor(good), compressor(bad)) for good, bad in pairs]

    def __call__(self, text: str) -> list[float]:
        raw, out = text.encode(), []
        for block in BLOCKS:
            blocks = [raw[i : i + block] for i in range(0, len(raw), block)] or [b""]
            for pair in self.pairs:
                good, bad = (sum([len(c.compress(b)) for b in blocks]) for c in pair)
                out.append((bad - good) / (bad + good))
        return out


def _dictionary(texts: list[str], size: int) -> bytes:
    import zstandard

    raw = [t.encode() for t in texts]
    pieces = [r[i : i + PIECE] for r in raw for i in range(0, len(r), PIECE)]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, pieces)) // 8)), pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: they are the dictionary themselves
        return b"".join(pieces)[:size] or b"\0" * 8


def logistic(terms: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of the weighted logistic fit of y (0 or 1) with a small ridge: its only minimum.

    Newton steps, each halved until the loss falls by its share: whole ones overshoot where the classes are nearly apart, and end anywhere."""

    def loss(w: np.ndarray) -> float:
        z = terms @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge / 2 * (w @ w))

    w = np.zeros(terms.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(terms @ w, -40, 40)))
        hessian = (terms * (weight * p * (1 - p))[:, None]).T @ terms + ridge * np.eye(len(w))
        uphill = ridge * w - terms.T @ (weight * (y - p))
        step = -np.linalg.solve(hessian, uphill)
        fall, share = -float(uphill @ step), 1.0
        if fall <= 1e-9:
            break
        while share > 1e-6 and loss(w + share * step) > now - 1e-4 * share * fall:
            share /= 2
        if share <= 1e-6:  # nothing is left but rounding
            break
        w = w + share * step
        now = loss(w)
    return w


def fit(rows: list, shares: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model of sampled rows (text, quality); ``shares`` are the classes' (0, 1) shares of all labelled rows."""
    of = [[r["text"] for r in rows if r["quality"] == q] for q in (0, 1)]
    model = Model(prior=shares[1] / max(sum(shares), 1e-9) if sum(shares) else 0.5)
    if min(map(len, of)) < 2:
        return model
    cut_at = [max(1, int(len(x) * DICTIONARY_SHARE)) for x in of]
    model.pairs = tuple((_dictionary(of[1][: cut_at[1]], size), _dictionary(of[0][: cut_at[0]], size)) for size in DICTIONARIES)
    size = Sizer(model.pairs)
    left = [x[n:] for x, n in zip(of, cut_at, strict=True)]
    sizes = np.array([size(t) for x in left for t in x])
    y = np.repeat([0.0, 1.0], list(map(len, left)))
    weight = np.repeat([max(s, 1e-9) / len(x) for s, x in zip(shares, left, strict=True)], list(map(len, left)))
    weight *= len(y) / weight.sum()
    model.mean, model.deviation = sizes.mean(0), sizes.std(0) + 1e-6
    terms = model.terms(sizes)
    model.weights = logistic(terms, y, weight)
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS_A_CLASS, chars: int = CHARS) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, quality): classes are counted over all labels, texts are drawn up to the bound.

    Labels are drawn before their texts are looked up, twice as many as are used, as texts may be missing or long."""
    marked = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    counted = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    drawn = [draw(marked.filter(F.col("quality") == q), "quality", "doc_id", 2 * rows, counted.get(q, 0)) for q in (0, 1)]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))  # 4 * rows labels at most
    usable = docs.select("doc_id", "text").filter(F.length("text") <= chars).join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    usable = usable.orderBy(F.xxhash64(F.lit("quality"), "doc_id")).collect()
    few = [[r for r in usable if r["quality"] == q][:rows] for q in (0, 1)]
    return fit(few[0] + few[1], (counted.get(0, 0), counted.get(1, 0)))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted (1 if score >= threshold) of every whole text of docs (doc_id, text).

    Null texts score as empty ones. Rows that repeat are scored each; an empty table gives an empty
    result; other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        size = Sizer(known.pairs) if known.weights is not None else lambda _: [0.0]
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                scores = known.score(np.array([size(t or "") for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs (any columns, text among them) that score ``threshold`` or more, unchanged.

    Null texts score as empty ones; rows that repeat go or stay together; an empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        size = Sizer(known.pairs) if known.weights is not None else lambda _: [0.0]
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                scores = known.score(np.array([size(t or "") for t in part.column("text").to_pylist()]))
                yield part.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Learns from labels of the folds other than 2 of 4."""
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 4) != 2))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
