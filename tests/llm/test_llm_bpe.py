"""BPE operators against the tokenizers library, and the transducer against plain merging."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from alertspark.llm.bpe_codec import Codec, decode_documents, encode_documents, round_trip
from alertspark.llm.bpe_model import BpeModel
from alertspark.llm.token_count import Counter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string"
ODD = [
    "", " ", "  a", "a  ", "don't we'll ' s", "x<|endoftext|>y", "<|endoftext|>", "a <|endoftext|> b\n\n", "tab\tand nbsp 　wide",
    "café naïve 日本語 \U0001f600 ١٢", "a" * 3000, "-=" * 2000, "q" * 17 + " " * 900 + "x", "ñ" * 2000, "line\r\nline\x85 x",
]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return BpeModel(PATH)


def _random_texts(n):
    rnd = random.Random(7)
    pool = [chr(i) for i in range(0x20, 0x250)] + list("\t\n\r\x0b\x0c\x1c\x1f\x85\xa0     　​") + [chr(rnd.randrange(0x3041, 0x9FFF)) for _ in range(60)]
    words = [" ", "  ", "the", "'s", "'ll", "\n", "<|endoftext|>", "123", "abcabc", " tion"]
    return ["".join(rnd.choice(pool) if rnd.random() < 0.4 else rnd.choice(words) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_codec_equals_library(lib, model):
    texts = ODD + _random_texts(1500)
    codec, counter = Codec(model), Counter(model, model.alone())
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in codec.encode_batch(pa.array(texts))] == want
    assert counter.count_batch(pa.array(texts)).tolist() == [len(w) for w in want]
    assert [codec.decode(w) for w in want] == [lib.decode(w, skip_special_tokens=False) for w in want]


def test_decoding_of_any_ids_equals_library(lib, model):
    rnd, codec = random.Random(3), Codec(model)
    for _ in range(200):
        ids = [rnd.randrange(50257) for _ in range(20)]
        assert codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_transducer_is_stable_for_every_chunking(model):
    rnd = random.Random(5)
    for make in (lambda: "".join(rnd.choice("abcdeinorst") for _ in range(4000)), lambda: "ing" * 900, lambda: "".join(rnd.choice(["tion", "er", "st", "the"]) for _ in range(900))):
        data = make().encode()
        want = model.merge(data)
        for size in (1, 7, 500):
            assert list(model.transduce(data[i : i + size] for i in range(0, len(data), size))) == want


def test_operators_on_edge_rows(spark, lib):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "null id", None), (90, None, None), (3, ODD[3], "again"), (3, ODD[3], "again")]
    docs = spark.createDataFrame(rows, SCHEMA)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, round_trip(docs, PATH).collect()), key=key) == sorted(want, key=key)
    got = sorted(map(tuple, count_tokens(docs, PATH, limit=5).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert got == sorted(((i, len((t or "").encode()), w[1], w[1] > 5) for (i, t, _), w in zip(rows, want)), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    back = decode_documents(encode_documents(docs, PATH), PATH).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t, _ in rows)
    assert round_trip(docs.limit(0), PATH).count() == 0 == count_tokens(docs.limit(0), PATH).count()
