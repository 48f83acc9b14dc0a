"""WARC round trip, record types, and the index merge."""

import base64
import hashlib
import random

import pyarrow.fs as pafs
from pyspark.sql import functions as F

from alertspark.llm import warc
from alertspark.llm.common import Scratch
from alertspark.llm.warc import LoserTree, _order, archive, parse_record, read_members, round_trip, url_key

SCHEMA = "page_id long, url string, html string, first string, d string"


def _pages(spark):
    rows = [(i, f"https://www.b{i % 3}.org/p?b=2&a={i % 5}", f"<p>é {i % 7}</p>", None, None) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "http://x\n.org", "", None, None), (None, "u", "<p>é 3</p>", None, None), (None, "u", "alone", None, None), (102, "u", "z" * 3_000_000, None, None), (4, *rows[4][1:])]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(6)


def test_round_trip_equals_definition(spark):
    rows, df = _pages(spark)
    first = {}
    for i, _, h, *_ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and i != f
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", f if again else None))
    got = round_trip(df, ts=F.timestamp_seconds(F.col("page_id"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert {r["url"] for r in got if r["page_id"] in (100, 1)} == {None, rows[1][1]}


def test_history_is_in_order_and_points_at_its_records(spark):
    rows, df = _pages(spark)
    history, index, folder = archive(df, ts=F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") % 11))
    got = sorted((tuple(r) for r in history.collect()), key=lambda r: r[-2:])
    assert [_order(r) for r in got] == sorted(_order(tuple(r)) for r in index.collect()) and len(got) == len(rows)
    fs, root = pafs.FileSystem.from_uri(folder)
    for r in got[::7]:
        with fs.open_input_file(f"{root}/{r[3]}") as f:
            f.seek(r[4])
            fields, _ = parse_record(next(read_members(f)))
        assert fields["WARC-Type"] == r[6] and fields["WARC-Payload-Digest"] == f"sha1:{r[7]}" and fields.get("X-Source-Id") == (None if r[2] is None else str(r[2]))


def test_archives_are_read_back_by_several_tasks(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, f"http://a.org/{i}", rnd.randbytes(2_000).hex(), None, None) for i in range(200)]
    one_file = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    tasks = []
    keep = Scratch.keep

    def watched(self, df, name):
        if name == "records":
            tasks.append(sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()))
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", watched)
    six = sorted((r["page_id"], r["payload_bytes"]) for r in round_trip(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect())
    monkeypatch.setattr(warc, "READ_BYTES", 50_000, raising=False)
    one = sorted((r["page_id"], r["payload_bytes"]) for r in round_trip(one_file).collect())
    assert six == one == [(i, 4_000) for i in range(200)]
    assert len(tasks[0]) == 6 and len(tasks[1]) > 4 and max(tasks[1]) < 60, tasks


def test_loser_tree():
    rnd = random.Random(9)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rnd.randrange(20), j) for j in range(rnd.randrange(12))) for _ in range(k)]
        assert list(LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert url_key("HTTPS://www.A.org:80/X?b=2&a=1#f") == "org,a)/x?a=1&b=2"
    assert url_key(None) == "" and url_key("a.org") == "org,a)/" and url_key("http://[bad") == "http://[bad"


def test_empty_table(spark):
    _, df = _pages(spark)
    assert round_trip(df.limit(0)).count() == 0
