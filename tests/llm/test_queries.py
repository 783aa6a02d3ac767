"""Operators on small tables: brute force, or the same in SQL, and odd rows."""

import hashlib
import os
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from claimlens.llm import ann, licenses, media, mixing, packing, queries, site_style, toxicity
from claimlens.llm.queries import tokenizer_path

ROWS = [
    (1, "Some prose here.\nReleased under the MIT License.", "a"),
    (2, "Licensed under CC BY-NC 4.0. More", None),
    (2, "Licensed under CC BY-NC 4.0. More", None),
    (3, "", "b"),
    (None, None, "a"),
    (5, "x " * 3000, "b"),
    (None, "one two three", None),
    (7, "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 9, 0.5) for r in ROWS], "doc_id long, text string, source string, length long, score double")


def same(df, sql, docs):
    documents = docs.toPandas().convert_dtypes()
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(sql)
    names = sorted(df.columns)
    a = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    b = sorted(repr(tuple(r)) for r in want.project(", ".join(names)).fetchall())
    assert a == b


def test_licenses(docs):
    same(licenses.scan(docs), licenses.oracle(), docs)
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()}
    assert got[1] == "MIT" and got[7] == "Apache-2.0" and got[3] == ""
    assert licenses.scan(docs.limit(0)).count() == 0


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
APACHE_HEADER = """Copyright 2020 A. Name

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
LICENSED = [
    (MIT_TEXT, "MIT-text"),
    (MIT_TEXT.replace("\n", "\r\n"), "MIT-text"),
    (APACHE_HEADER, "Apache-2.0-header,Apache-2.0"),
    ("/*\n" + "\n".join(" * " + x for x in APACHE_HEADER.split("\n")) + "\n */\nint x;", "Apache-2.0-header,Apache-2.0"),
    ("\n".join("# " + x for x in GPL_HEADER.split("\n")), "GPL-3.0-header"),
    (BSD_TEXT, "BSD-2-Clause-text"),
    (BSD_TEXT + BSD_THIRD, "BSD-3-Clause-text,BSD-2-Clause-text"),
    ("This work is licensed under a Creative Commons\nAttribution 4.0 International License.", "CC-BY-4.0"),
    ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("# SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"),
    ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"),
    ("<!-- SPDX-License-Identifier: BSD-3-Clause -->", "BSD-3-Clause"),
    ("A line\nReleased under the MIT License\nanother line", "MIT"),
    ("It was not released under the MIT License", ""),
    ("Licensed under the\nMIT. License", ""),
    ("Released under the MIT License of old", ""),
]


def test_licenses_in_wrapped_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LICENSED)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(LICENSED))] == [want for _, want in LICENSED]


def test_each_license_sentence_wrapped(spark):
    known = licenses.forms()
    assert len(known) > 800
    rows = []
    for i, sentence in enumerate(known):
        words = sentence.split(" ")
        rows.append((i, "Before.\n# " + "\n# ".join(" ".join(words[s : s + 5]) for s in range(0, len(words), 5)) + ".\n# After"))
    got = {r["doc_id"]: r["sentence_ids"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [str(k) for k in known.values()]


def test_named_licenses(spark):
    texts = ["This project is licensed under the Mozilla Public License, Version 2.0.\n# SPDX-License-Identifier: MIT", "SPDX-License-Identifier: ISC\nDistributed under the ISC License.\nLicensed under the zlib license; see there"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["licenses"] for r in licenses.scan(df).orderBy("doc_id").collect()] == ["MIT,MPL-2.0", "ISC,Zlib"]


def test_mixing(docs):
    mixed = mixing.mix(docs)
    same(mixed.select("doc_id", "size", "source_size", "target", "taken"), mixing.oracle(), docs)
    for r in mixed.collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert mixing.repeated(docs).columns == docs.columns
    assert mixing.repeated(docs).count() == sum(r["repeats"] for r in mixed.collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_targets_are_the_loop(spark):
    sizes = {"a": 1000, "b": 10, "c": 400, "d": 5, "e": 0, None: 300}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, want = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    assert got == pytest.approx(want)


def test_packing(docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path()).collect()
    pieces, places = {}, {}
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], struct.unpack(f"<{r['length']}I", r["ids"])))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, t, _ in ROWS:
        want = model.encode(t or "", add_special_tokens=False).ids + [1]
        if [r[0] for r in ROWS].count(k) == 1:
            assert [i for _, ids in sorted(pieces[k]) for i in ids] == want
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 2048
    assert sorted(places) == list(range(len(places)))
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_op5_digests_the_packed_ids(docs, spark, tmp_path, monkeypatch):
    """Not digests from before the packing."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    real = packing.pieces
    monkeypatch.setattr(packing, "pieces", lambda *a, **k: real(*a, **k).withColumn("ids_crc32", F.lit(-1).cast("long")))
    got = queries.op5_packing(spark, str(tmp_path))
    want = packing.pack(docs, tokenizer_path()).collect()
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(r["ids_crc32"] for r in got.collect()) == sorted(zlib.crc32(bytes(r["ids"])) for r in want)


def test_media(docs, tmp_path):
    stored = media.store(docs, f"file://{tmp_path}/media")
    got = media.read_back(stored).collect()
    assert len(got) == len(ROWS)
    for r in got:
        texts = [t for k, t, _ in ROWS if k == r["doc_id"]]
        data = [media.payload((t or "").encode()) for t in texts]
        i = next(i for i, d in enumerate(data) if hashlib.sha256(d).hexdigest() == r["payload_sha256"])
        assert r["n_bytes"] == len((texts[i] or "").encode()) and r["payload_bytes"] == len(data[i]) and r["tail_crc32"] == zlib.crc32(data[i][-32:])
    assert {r["width"] for r in media.with_metadata(media.members(stored)).collect()} == {576}
    import tarfile

    for f in (tmp_path / "media").glob("*.tar"):
        with tarfile.open(f) as t:
            assert len(t.getnames()) == len(set(t.getnames())) > 0


def test_neighbours(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(400, 16))
    v[10] = v[11] = v[12]
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (None, [1.0] * 16), (503, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in ann.search(df, df.where("vec_id % 50 = 0 OR vec_id = 10")).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(400), -np.round(s, 12)))[:5]
        hits += len(set(best) & {i for _, i, _ in found})
        assert [x[0] for x in sorted(found)] == list(range(1, len(found) + 1))
        for _, i, score in found:
            assert score == pytest.approx(s[i], abs=1e-12)
    assert len(got) == 9 and hits >= 0.9 * 45
    assert [i for _, i, _ in sorted(got[10])][:2] == [11, 12]
    assert ann.search(df.limit(0), df).count() == 0


def nearest(v, q, k=5):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit @ unit[q]
    s[q] = -9
    return [int(i) for i in np.lexsort((np.arange(len(v)), -np.round(s, 12)))[: min(k, len(v) - 1)]]


def searched(spark, v, where):
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for x in sorted(ann.search(df, df.where(where)).collect(), key=lambda x: x["rank"]):
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    return got


def test_neighbours_beside_many_copies(spark):
    r = np.random.default_rng(8)
    v = r.normal(size=(1500, 16))
    v[500:1000] = v[500]
    v[:20] = v[500] + 0.02 * r.normal(size=(20, 16))
    order = r.permutation(1500)  # so that ids of copies lie among the others
    v = v[order]
    asked = [int(i) for i in np.flatnonzero(order < 20)] + [int(i) for i in np.flatnonzero(order == 700)]
    got = searched(spark, v, f"vec_id IN ({', '.join(map(str, asked))})")
    assert got[asked[-1]] == nearest(v, asked[-1])
    hits = sum(len(set(got[q]) & set(nearest(v, q))) for q in asked)
    assert hits >= 0.9 * 5 * len(asked)


@pytest.mark.parametrize("n", [1, 2, 4, 9, 20])
def test_neighbours_of_few(spark, n):
    v = np.random.default_rng(n).normal(size=(n, 16))
    got = searched(spark, v, "true")
    assert got == {q: nearest(v, q) for q in range(n) if n > 1}


def test_site_style(spark):
    rows = []
    for i in range(12):
        html = f"<body><div class='top-line'><p>Welcome to the site</p></div><div class='text'><h2>Title {i}</h2><p>Body number {i} &amp; more.</p></div><div class='end'>All rights</div></body>"
        rows.append((i, "http://h.example/x", html))
    rows += [(90, None, None), (91, "http://other.example/", "<p>Welcome to the site"), (92, "http://h.example/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_style.extract(df).collect()}
    assert got[3] == "Title 3\nBody number 3 & more."
    assert got[90] == "" and got[91] == "Welcome to the site" and got[92] == ""
    assert site_style.extract(df.limit(0)).count() == 0


def test_site_style_inside_articles(spark):
    page = "<body><article><h1>Title {0}</h1><div class='kicker-line'><p>{1}</p></div><p>Body number {0} of its own.</p></article></body>"
    rows = [(i, "http://h.example/x", page.format(i, "Read on our site" if i else "Words of one page")) for i in range(12)]
    # copies of one article are no boilerplate
    rows += [(100 + i, "http://copies.example/x", page.format(7, "Read on our site")) for i in range(12)]
    rows += [(200 + i, "http://near.example/x", page.format(7, "Read on our site").replace("Title 7", f"Title {i}")) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_style.extract(df).collect()}
    assert got[3] == "Title 3\nBody number 3 of its own."
    assert got[0] == "Title 0\nWords of one page\nBody number 0 of its own."
    assert got[105] == "Title 7\nRead on our site\nBody number 7 of its own."
    assert got[205] == "Title 5\nRead on our site\nBody number 7 of its own."


def test_toxicity_on_tables(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit_on(docs, labels)).collect()
    assert len(scored) == len(ROWS) and all(0 <= r[-1] <= 1 for r in scored)
    assert re.match(r"\d", str(scored[0][-1]))


def test_recall_and_work_of_neighbours(spark):
    """Vectors with structure: few are met, and nearly all nearest found; also along copies of a vector."""
    r = np.random.default_rng(8)
    base = r.normal(size=(40, 32))
    v = base[r.integers(0, 40, 6000)] + 0.05 * r.normal(size=(6000, 32))
    v[:500] = v[0]
    index = ann.calibrated(v, len(v), 5)
    lo, hi = index.around(index.keys(v[::50]))
    at = index.cells(index.keys(v))
    met = ((at[None] >= lo[:, None]) & (at[None] <= hi[:, None])).any(axis=2).mean()
    assert met < 0.5 and len(index.borders[0]) + 1 > ann.FEWEST
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(len(v))], "vec_id long, embedding array<double>")
    got = {}
    for x in ann.search(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = wanted = 0
    for q in range(0, 6000, 50):
        score = np.round(unit @ unit[q], 12)
        score[q] = -2
        best = np.lexsort((np.arange(6000), -score))[:5]
        found += len({i for _, i in got[q]} & set(best.tolist()))
        wanted += 5
        if q < 500:
            assert [i for _, i in sorted(got[q])] == [i for i in range(6) if i != q][:5]
    assert found >= 0.9 * wanted


def test_rows_equal_in_id_and_text_keep_their_own_columns(spark):
    rows = [(1, "a b c", "s1", 0), (1, "a b c", "s2", 1), (1, "a b c", "s2", 2), (None, None, None, 3), (2, "d " * 30, "s1", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repeats int")
    got = mixing.repeated(df)
    times = sorted(r["repeats"] for r in mixing.mix(df).collect())
    by_row = {r["repeats"]: r["count"] for r in got.groupBy("repeats").count().collect()}
    assert got.columns == df.columns and sorted([*by_row.values(), *([0] * (5 - len(by_row)))]) == times
    assert {(r["source"], r["repeats"]) for r in got.collect()} <= {(s, k) for _, _, s, k in rows}


def test_all_queries_on_empty_tables(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, embedding array<float>, label int"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


CLASHES = "n_words n_removed kept n_bytes n_spans n_shingles component_id component score size source_size target taken repeats th did own spans bucket digest place c h label"


def test_all_queries_with_clashing_columns_and_odd_rows(spark, tmp_path):
    """Extra columns of the results' and inner names; null ids, texts and vectors, repeated rows, a long text."""
    extra = CLASHES.split()
    texts = [None, "", " ", "a", "one two three four five six", "x " * 60_000, "The same text. " * 20, "The same text. " * 20]
    docs = [(i if i != 3 else None, t, "en", f"s{i % 2}" if i else None, 1, *(["z"] * len(extra))) for i, t in enumerate(texts)]
    docs.append(docs[-1])
    names = " string, ".join(extra) + " string"
    spark.createDataFrame(docs, f"doc_id long, text string, lang string, source string, n_chars long, {names}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, None, 1), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    vectors = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (None, [1.0, 1.0]), (3, [1.0, None]), (4, [0.0, 2.0])]
    spark.createDataFrame([(*v, *(["z"] * len(extra))) for v in vectors], f"vec_id long, embedding array<float>, {names}").write.parquet(f"{tmp_path}/embeddings.parquet")
    pages = [(1, "http://a/x", "<p>one</p>"), (None, None, None), (2, "", ""), (2, "", ""), (3, "::", "<div>" * 5000 + "deep")]
    spark.createDataFrame([(*p, *(["z"] * len(extra))) for p in pages], f"page_id long, url string, html string, {names}").write.parquet(f"{tmp_path}/pages.parquet")
    rows = {name: query(spark, str(tmp_path)).count() for name, query in queries.queries().items()}
    assert rows["op4_html_extraction"] == len(pages) and rows["op3_nearest_neighbours"] == 4
    assert {rows[n] for n in ("op1_substring_dedup", "op2_toxicity", "op6_suffix_array_dedup", "op7_jaccard_join", "op8_media_columns", "op9_license_scan", "op10_source_mix")} == {len(docs)}


CONTRACT = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op4_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op5_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op6_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op7_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op8_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op10_source_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(21)
    vocab = [f"w{i}" for i in range(300)]
    shared = [" ".join(r.choice(vocab) for _ in range(n)) for n in (55, 80, 130)]
    rows = [(None, None), (0, ""), (1, shared[2]), (2, shared[2]), (3, "few words")]
    for i in range(4, 60):
        own = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 90))) for _ in range(2)]
        rows.append((i, r.choice(["", r.choice(shared) + r.choice([" ", "\n"])]).join(own) + ("" if i % 6 else " moron scum")))
    rows += [(100 + i, rows[i][1] + " more") for i in range(5, 25)]
    spark.createDataFrame([(d, t, "en", f"s{i % 3}", 0) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d % 6 == 0)) for d, _ in rows if d and 3 < d < 60], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = np.random.default_rng(2).normal(size=(120, 8))
    spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(1, "http://a/x", "<article><p>One &amp; two</p></article>")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, rows


def test_queries_keep_their_contracts(spark, folder):
    from tests.llm import test_jaccard, test_repeats

    path, rows = folder
    got = {}
    for name, contract in CONTRACT.items():
        df = queries.queries()[name](spark, path)
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes).startswith(contract), name
        got[name] = df.collect()
    by_id = lambda name: {r["doc_id"]: tuple(r)[1:] for r in got[name]}
    words = by_id("op1_substring_dedup")
    for (d, _), (n, gone, kept) in zip(rows, test_repeats.brute_words(rows, 50), strict=True):
        assert words[d] == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    assert any(gone for _, gone, _ in words.values())
    left = by_id("op6_suffix_array_dedup")
    assert [left[d] for d, _ in rows] == test_repeats.brute_bytes(rows, 100)
    assert sorted((repr(r[0]), r[1], repr(r[2])) for r in got["op7_jaccard_join"]) == test_jaccard.brute(rows)
    for r in got["op2_toxicity"]:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    page = got["op4_html_extraction"][0]
    assert (page["text"], page["n_chars"]) == ("One & two", 9)
    for r in got["op8_media_columns"]:
        text = dict(rows)[r["doc_id"]] or ""
        assert r["payload_sha256"] == hashlib.sha256(media.payload(text.encode())).hexdigest() and r["n_bytes"] == len(text.encode())
        assert r["media_bytes"] == len(media.encode(media.payload(text.encode()))) and r["feature"].startswith(f"{r['width']}x{r['height']}x")
    assert len({r["media_sha256"] for r in got["op8_media_columns"] if r["doc_id"] in (1, 2)}) == 1


def test_equal_payloads_have_one_address(spark, tmp_path):
    df = spark.createDataFrame([(i, "text" if i % 2 else f"text {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    rows = media.store(df, f"file://{tmp_path}/media").collect()
    assert len({(r["shard"], r["offset"], r["length"]) for r in rows if r["doc_id"] % 2}) == 1
    assert len({(r["shard"], r["offset"]) for r in rows}) == 21


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no test tables")
def test_ids_of_whole_texts():
    """The faster encoder, part by part, against the tokenizer on all texts of a table."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    model, ids = Tokenizer.from_file(tokenizer_path()), packing._Ids(tokenizer_path())
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
        raw = np.frombuffer((text or "").encode(), np.uint8)
        if not len(raw):
            continue
        starts = packing._parts(raw, np.array([0, len(raw)]))
        flat, _ = ids.look_up(raw, starts, np.append(starts[1:], len(raw)))
        assert flat.tolist() == model.encode(text, add_special_tokens=False).ids


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/documents.parquet"), reason="no test tables")
def test_held_out_accuracy():
    """Labelled rows of a table: learned from those of four folds, judged on the fifth."""
    import pyarrow.parquet as pq

    read = lambda name, *columns: pq.read_table(f"/root/testdata/sf0.1/{name}.parquet", columns=list(columns)).to_pylist()
    label = {r["doc_id"]: r["toxic"] for r in read("labels", "doc_id", "toxic")}
    rows = [(r["text"] or "", label[r["doc_id"]], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in read("documents", "doc_id", "text") if label.get(r["doc_id"]) in (0, 1)]
    model = toxicity.fit([t for t, _, held in rows if not held], [y for _, y, held in rows if not held])
    scores = []
    for text, y, held in rows:
        if held:
            raw = np.frombuffer(toxicity._whole(text), np.uint8)
            spaced, cuts, _ = toxicity.spaced(raw, np.array([0, len(raw)]))
            scores.append((model.score(model.features(spaced, cuts)), y))
    toxic, other = [s for s, y in scores if y], [s for s, y in scores if not y]
    assert np.mean([s > t for s in toxic for t in other]) + 0.5 * np.mean([s == t for s in toxic for t in other]) > 0.93
    assert sum(s >= 0.5 for s in toxic) > 0.7 * len(toxic) and sum(s >= 0.5 for s in other) < 0.02 * len(other)
