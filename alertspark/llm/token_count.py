"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded on its own; those that come out as
one token (and are one pre-token) form the set of whole tokens. A pre-token in
that set counts as one without any merging; only the others are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from alertspark.llm.bpe_model import BpeModel, Remembered, pre_tokens, stretches
from alertspark.llm.common import text_buffers, tidied


class Counter:
    def __init__(self, model: BpeModel, whole: set[str]):
        self.special, self.whole = model.special, whole
        self.words = Remembered(lambda s: 1 if s in whole else len(model.pre_token(s)))

    def _make(self, stretch: str) -> int:
        if stretch in self.whole or stretch in self.special:
            return 1
        return sum(map(self.words.__getitem__, pre_tokens(stretch)))

    def count_batch(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each whole text."""
        out = np.zeros(len(texts), np.int64)
        for some in stretches(texts, self.special):
            of = np.fromiter(map(self._make, some.texts), np.int64, len(some.texts))
            total = np.concatenate([[0], np.cumsum(of[some.codes])])
            out[some.first : some.first + len(some.at) - 1] = total[some.at[1:]] - total[some.at[:-1]]
        return out

    def count(self, text: str) -> int:
        return int(self.count_batch(pa.array([text]))[0])


def count_tokens(docs: DataFrame, model_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens of each whole text.

    One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit
    (n_tokens > limit). Null and empty texts have 0 of each. Repeated rows give
    repeated results, a null id stays null, other columns are not read. No
    shuffle; model and whole-token set are broadcast (bounded by the vocabulary).
    """
    model = BpeModel(model_path)
    shared = docs.sparkSession.sparkContext.broadcast((model, model.alone()))
    schema = T.StructType(
        [docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )

    def run(batches):
        model, whole = shared.value
        counter = Counter(model, whole)  # with its table of known pre-tokens, until the task ends
        for batch in batches:
            n = counter.count_batch(batch.column(1))
            cols = [batch.column(0), pa.array(np.diff(text_buffers(batch.column(1))[1])), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(tidied(run), schema)
