"""License scans: planted templates, edits, spans, clean texts."""

import random

import numpy as np

from alertspark.llm.license_scan import TEMPLATES, WINDOW, scan_licenses, winnow

SCHEMA = "doc_id long, text string, matches string, coverage string"


def _scan(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    return [r.asDict(recursive=True) for r in scan_licenses(df, **kw).orderBy("doc_id").collect()]


def test_templates_are_found_with_their_spans(spark):
    rnd = random.Random(3)
    filler = lambda n: " ".join(rnd.choice(["ka", "lo", "mi", "é", "tu."]) for _ in range(n))
    names = sorted(TEMPLATES)
    heads = [filler(7) + "\n" for _ in names]
    got = _scan(spark, [f"{h}{TEMPLATES[n]}\n{filler(9)}" for h, n in zip(heads, names)])
    for n, h, r in zip(names, heads, got):
        m = [x for x in r["matches"] if x["template"] == n]
        assert len(m) == 1 and m[0]["coverage"] == 1.0, (n, r)
        t = TEMPLATES[n].rstrip(".")
        assert (m[0]["start"], m[0]["end"]) == (len(h), len(h) + len(t))
        assert n in r["licenses"] and r["coverage"] == 1.0 and r["n_matches"] == len(r["matches"])


def test_edited_copies_repeats_and_clean_texts(spark):
    w = TEMPLATES["MIT"].split()
    edited = " ".join(x for i, x in enumerate(w) if i % 17) + " tail"
    inserted = " ".join(w[:30] + ["new", "words"] + w[30:])
    half = " ".join(w[: len(w) // 2])
    twice = "ALL RIGHTS RESERVED! x y z all rights, reserved"
    got = _scan(spark, [edited, inserted, half, twice, "rights reserved all", None, "", "w " * 100_000 + "All rights reserved."])
    assert got[0]["licenses"] == ["MIT"] and 0.9 < got[0]["coverage"] < 1
    assert got[1]["licenses"] == ["MIT"] and got[1]["coverage"] == 1.0
    assert [r["n_matches"] for r in got[2:]] == [0, 2, 0, 0, 0, 1]
    assert [(m["start"], m["end"]) for m in got[3]["matches"]] == [(0, 19), (27, 46 + 1)]
    assert _scan(spark, []) == []


def test_variants_have_their_own_names_and_whole_texts_are_found(spark):
    notices = {
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0-notice"],
        "This work is licensed under the GNU General Public License, version 7.": [],
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0-notice"],
        "Licensed under CC BY 4.0.": ["CC-BY-4.0-notice"],
        "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0-notice"],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0-notice"],
        "Licensed under CC BY-NC 5.0.": [],
        "Released under the BSD License.": ["BSD-notice"],
        "Released under the Foo License.": [],
        TEMPLATES["BSD-2-Clause"]: ["BSD-2-Clause"],
        TEMPLATES["BSD-3-Clause"]: ["BSD-3-Clause"],
        TEMPLATES["MIT-grant"]: ["MIT-grant"],
        "x " * 50 + TEMPLATES["GPL-2.0-text"] + " y" * 50: ["GPL-2.0-text"],
        " ".join(w for i, w in enumerate(TEMPLATES["MPL-2.0-text"].split()) if i % 300): ["MPL-2.0-text"],
    }
    got = _scan(spark, list(notices))
    assert [r["licenses"] for r in got] == list(notices.values())
    assert TEMPLATES["MIT"].endswith("DEALINGS IN THE SOFTWARE.")


def test_winnowing_keeps_one_of_each_window():
    h = np.random.default_rng(0).integers(0, 1 << 60, 200).astype(np.uint64)
    at = set(winnow(h, WINDOW).tolist())
    assert all(at & set(range(i, i + WINDOW)) for i in range(len(h) - WINDOW + 1)) and len(at) < len(h)


def test_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "All rights reserved."), (1, "All rights reserved."), (1, "All rights reserved.")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_matches"]) for r in scan_licenses(df).collect()) == [(0, 1), (1, 1), (1, 1)]
