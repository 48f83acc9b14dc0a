"""BPE encoding and decoding as streaming transducers.

Encoding: a text is cut at special strings and into stretches, those into
pre-tokens; each
pre-token is merged by ``BpeModel``, which emits a token once the merge list's
sufficient lookahead proves it stable. Frequent words are remembered in a table
of bounded size. Decoding: token bytes pass through an incremental
UTF-8 state machine, so the decoder holds at most one unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from alertspark.llm.bpe_model import AT_ONCE, REMEMBERED, BpeModel, Remembered, pre_tokens, stretches
from alertspark.llm.common import slices, tidied



class Ragged:
    """Rows of bytes or numbers of different lengths, end to end; ``take`` lays chosen rows end to end."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    def take(self, rows: np.ndarray) -> np.ndarray:
        n = self.lengths[rows]
        ends = np.cumsum(n)
        shift = self.starts[rows] - (ends - n)
        return self.flat[np.repeat(shift, n) + np.arange(ends[-1] if len(ends) else 0)]


def _ragged_bytes(rows: list[bytes]) -> Ragged:
    return Ragged(np.frombuffer(b"".join(rows), np.uint8), np.array([len(r) for r in rows], np.int64))


class Codec:
    def __init__(self, model: BpeModel, at_once: int = AT_ONCE, remembered: int = REMEMBERED):
        self.model, self.at_once = model, at_once
        self.words = Remembered(lambda s: tuple(model.pre_token(s)), remembered)
        self.bytes_of = _ragged_bytes(model.bytes_of)
        self.decimal = _ragged_bytes([b"%d," % i for i in range(len(model.bytes_of))])

    def _make(self, stretch: str) -> tuple[int, ...]:
        known = self.words.get(stretch)  # mostly a stretch is one pre-token
        if known is not None:
            return known
        if stretch in self.model.special:
            return (self.model.special[stretch],)
        return tuple([i for s in pre_tokens(stretch) for i in self.words[s]])

    def encode_batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each whole text, in order."""
        for some in stretches(texts, self.model.special, self.at_once):
            made = list(map(self._make, some.texts))
            lengths = np.fromiter(map(len, made), np.int64, len(made))
            table = Ragged(np.fromiter(chain.from_iterable(made), np.int32, int(lengths.sum())), lengths)
            for a, b in zip(some.at[:-1], some.at[1:]):
                yield table.take(some.codes[a:b])

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch(pa.array([text]))).tolist()

    def decode_stream(self, ids: np.ndarray, at_once: int = 1 << 18) -> Iterator[str]:
        """The text of the ids, some thousand tokens at a time; holds at most one unfinished character."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in range(0, len(ids), at_once):
            yield machine.decode(self.bytes_of.take(ids[i : i + at_once]).tobytes())
        yield machine.decode(b"", True)

    def decode(self, ids: list[int]) -> str:
        return "".join(self.decode_stream(np.array(ids, np.int64)))

    def digest(self, ids: np.ndarray, at_once: int = 1 << 18) -> tuple[int, str, str]:
        """(tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text)."""
        ids_sha, text_sha = hashlib.sha256(), hashlib.sha256()
        for i in range(0, len(ids), at_once):
            said = self.decimal.take(ids[i : i + at_once])
            ids_sha.update(said if i + at_once < len(ids) else said[:-1])
        for some in self.decode_stream(ids, at_once):
            text_sha.update(some.encode())
        return len(ids), ids_sha.hexdigest(), text_sha.hexdigest()


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (id, text) -> id, ids array<int>: the token ids of each whole text. Null: no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(BpeModel(model_path))
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        codec = Codec(shared.value)  # with its table of known pre-tokens, until the task ends
        for batch in (s for b in batches for s in slices(b, 256)):
            ids = list(codec.encode_batch(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(tidied(run), schema)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids) -> id, text. Null ids: empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(BpeModel(model_path))
    schema = T.StructType([encoded.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches):
        codec = Codec(shared.value)  # with its table of known pre-tokens, until the task ends
        for batch in (s for b in batches for s in slices(b, 256)):
            texts = [codec.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(tidied(run), schema)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", at_once: int = AT_ONCE, remembered: int = REMEMBERED) -> DataFrame:
    """Encode each whole text, decode it again, and return digests of both.

    One row per input row: id, n_tokens, ids_sha256, decoded_sha256. A null or
    empty text has 0 tokens and the digests of the empty string. Repeated rows
    give repeated results, a null id stays null, other columns are not read.
    No shuffle; the model is broadcast (bounded by the vocabulary). A task works
    on about ``at_once`` bytes at a time and remembers twice ``remembered`` strings.
    """
    shared = docs.sparkSession.sparkContext.broadcast(BpeModel(model_path))
    schema = T.StructType(
        [docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def run(batches):
        codec = Codec(shared.value, at_once, remembered)  # with its table of known pre-tokens, until the task ends
        for batch in batches:
            rows = [codec.digest(ids) for ids in codec.encode_batch(batch.column(1))]
            n, ids, text = zip(*rows) if rows else ((), (), ())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(tidied(run), schema)
