"""Quality classifier: a byte-level convolutional network in numpy.

Each byte is embedded, learned filters of eight bytes slide over the whole
text, and every chunk of 1,024 bytes (each overlaps the next by half) keeps the
maximum of each filter. The chunks' maxima are combined into the document's
probability: a logistic unit over their mean and their maximum.

Embedding and filters are folded into one table per filter place (256 bytes x
filters), so a convolution is a sum of table rows.

The network is fitted on the driver on a bounded sample: at most SAMPLE
labelled documents of each class and at most SAMPLE_CHUNKS chunks of each,
spread evenly over the text. Scoring covers every byte of every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertspark.llm.common import text_buffers, tidied

BLOCK = 512  # half a chunk
WIDTH, FILTERS, EMBED = 8, 16, 6
SAMPLE, SAMPLE_CHUNKS = 1000, 8
EPOCHS, BATCH, RATE = 14, 16, 0.01
_PIECE = 16 * BLOCK


@dataclass
class Net:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 FILTERS: mean and maximum over the chunks
    out_bias: float

    def __post_init__(self):
        self.fold()

    def fold(self) -> None:
        self.tables = np.einsum("be,kef->kbf", self.embed, self.filters).astype(np.float32)

    def block_maxima(self, data: np.ndarray) -> np.ndarray:
        """Filter maxima of each block of a text; the windows of its last places run into zero bytes."""
        n = len(data)
        out = np.empty((-(-n // BLOCK), FILTERS), np.float32)
        padded = np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)])
        for i in range(0, n, _PIECE):
            m = min(_PIECE, n - i)
            blocks = -(-m // BLOCK)
            y = np.full((blocks * BLOCK, FILTERS), -np.inf, np.float32)
            y[:m] = self.tables[0][padded[i : i + m]]
            for k in range(1, WIDTH):
                y[:m] += self.tables[k][padded[i + k : i + k + m]]
            y.reshape(blocks, BLOCK, FILTERS).max(axis=1, out=out[i // BLOCK : i // BLOCK + blocks])
        return out

    def features(self, data: np.ndarray) -> np.ndarray:
        if not len(data):
            return np.zeros(2 * FILTERS, np.float32)
        b = self.block_maxima(data)
        chunks = np.maximum(np.maximum(b[:-1], b[1:]) if len(b) > 1 else b, -self.bias) + self.bias
        return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])

    def score(self, data: np.ndarray) -> float:
        x = float(self.features(data) @ self.out) + self.out_bias
        return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def _new_net(rng: np.random.Generator) -> Net:
    return Net(rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, 2 * FILTERS), 0.0)


def fit(texts: list[bytes], labels: list[int], odds: float | None = None, seed: int = 5) -> Net:
    """Fit by Adam on class-balanced batches; the odds of label 1 (default: those of ``labels``) are put back into the last bias.

    Without both classes the net only states the share of label 1 (0.5 when there is no label).
    """
    rng = np.random.default_rng(seed)
    net, y = _new_net(rng), np.array(labels, float)
    groups = [np.flatnonzero(y == c) for c in (0, 1)]
    if not len(groups[0]) or not len(groups[1]):
        net.out[:] = 0
        net.out_bias = 3.0 * (y.mean() * 2 - 1) if len(y) else 0.0
        return net
    data = [np.frombuffer(t, np.uint8) for t in texts]
    names = ("embed", "filters", "bias", "out")
    mean = {n: np.zeros_like(getattr(net, n)) for n in names}
    square = {n: np.zeros_like(getattr(net, n)) for n in names}
    step, steps = 0, EPOCHS * max(20, -(-len(data) // BATCH))
    m_b = v_b = 0.0
    while step < steps:
        step += 1
        pick = np.concatenate([rng.choice(g, BATCH // 2) for g in groups])
        grad = {n: np.zeros_like(getattr(net, n)) for n in names}
        grad_b = 0.0
        net.fold()
        for i in pick:
            _accumulate(net, data[i], y[i], grad)
            grad_b += grad.pop("_delta")
        rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for n in names:
            g = grad[n] / BATCH + (1e-3 * getattr(net, n) if n == "out" else 0)
            mean[n] += 0.1 * (g - mean[n])
            square[n] += 0.001 * (g * g - square[n])
            getattr(net, n)[...] -= rate * mean[n] / (np.sqrt(square[n]) + 1e-8)
        m_b += 0.1 * (grad_b / BATCH - m_b)
        v_b += 0.001 * ((grad_b / BATCH) ** 2 - v_b)
        net.out_bias -= rate * m_b / (np.sqrt(v_b) + 1e-8)
    net.fold()
    net.out_bias += float(np.log(len(groups[1]) / len(groups[0]) if odds is None else odds))
    return net


def _accumulate(net: Net, data: np.ndarray, label: float, grad: dict) -> None:
    """Add one text's gradient; only the places of the maxima carry any."""
    grad["_delta"] = 0.0
    n = len(data)
    if not n:
        return
    padded = np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)])
    y = net.tables[0][padded[:n]].copy()
    for k in range(1, WIDTH):
        y += net.tables[k][padded[k : k + n]]
    starts = np.arange(0, max(n - BLOCK, 1), BLOCK)
    at = np.array([s + y[s : s + 2 * BLOCK].argmax(axis=0) for s in starts])  # chunk x filter
    raw = np.take_along_axis(y, at, axis=0) + net.bias
    z = np.maximum(raw, 0)
    top, f = z.argmax(axis=0), np.arange(FILTERS)
    x = np.concatenate([z.mean(axis=0), z[top, f]])
    delta = 1 / (1 + np.exp(-np.clip(x @ net.out + net.out_bias, -60, 60))) - label
    grad["_delta"] = delta
    grad["out"] += delta * x
    dz = np.repeat(delta * net.out[None, :FILTERS] / len(starts), len(starts), axis=0)
    dz[top, f] += delta * net.out[FILTERS:]
    dz *= raw > 0
    grad["bias"] += dz.sum(axis=0)
    for k in range(WIDTH):
        seen = padded[at + k]  # chunk x filter
        grad["filters"][k] += np.einsum("cfe,cf->ef", net.embed[seen], dz)
        np.add.at(grad["embed"], seen.ravel(), (dz[:, :, None] * net.filters[k].T[None]).reshape(-1, EMBED))


def _held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Net:
    """Fit on labelled documents that aren't held out: the SAMPLE of each class with the smallest id hashes.

    An id is one text, however often its row is repeated: the smallest of its
    texts as they are cut.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    known = known.filter(~_held_out("id")).withColumn("h", F.xxhash64("id"))
    some = [known.filter(F.col("label") == c).orderBy("h", "id").limit(SAMPLE) for c in (0, 1)]
    rows = sorted({(r["id"], r["label"]) for s in some for r in s.collect()})
    of_class = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    spark = docs.sparkSession
    if not rows:
        return fit([], [])
    sample = F.broadcast(spark.createDataFrame(rows, T.StructType([T.StructField("id", labels.schema[id_col].dataType), T.StructField("label", T.IntegerType())])))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id").select("id", "label", "text")

    def cut(batches):
        room = SAMPLE_CHUNKS * 2 * BLOCK
        for batch in batches:
            out = []
            for t in batch.column(2):
                raw = (t.as_py() or "").encode()
                if len(raw) > room:
                    starts = np.linspace(0, len(raw) - 2 * BLOCK, SAMPLE_CHUNKS).astype(int)
                    raw = b"".join(raw[s : s + 2 * BLOCK] for s in starts)
                out.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "raw"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("label", T.IntegerType()), T.StructField("raw", T.BinaryType())])
    one = texts.mapInArrow(tidied(cut), schema).groupBy("id", "label").agg(F.min("raw").alias("raw"))
    got = sorted((r[0], r[1], bytes(r[2])) for r in one.collect())
    odds = of_class[1] / of_class[0] if len(of_class) == 2 else None
    return fit([r[2] for r in got], [r[1] for r in got], odds)


def classify(docs: DataFrame, net: Net, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Score every whole text.

    One row per input row: id (or, with ``keep_columns``, all its columns),
    held_out, score, predicted (1 when score >= threshold). A null text scores
    as an empty one, an empty text by the bias alone. Repeated rows give
    repeated results; a null id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = docs if keep_columns else docs.select(id_col, text_col)
    at = kept.columns.index(text_col)
    name = "score" if "score" not in kept.columns else "_score"
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        model = shared.value
        for batch in batches:
            data, off = text_buffers(batch.column(at))
            scores = [model.score(data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    scored = kept.mapInArrow(tidied(run), schema)
    if keep_columns:
        return scored.withColumn("_predicted", (F.col(name) >= threshold).cast("int"))
    return scored.select(id_col, _held_out(id_col).alias("held_out"), name, (F.col(name) >= threshold).cast("int").alias("predicted"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the labels that aren't held out, then ``classify`` every document."""
    return classify(docs, train(docs, labels, id_col, text_col), threshold, id_col, text_col)
