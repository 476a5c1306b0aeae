"""Each operator against a brute-force version, on rows with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexloom.llm import components, decontaminate, exact_dedup, html_text, license_scan, minhash_dedup, mixing, pii, quality, queries, shingles, token_count, warc_zip

SYLLABLES = "an be ti ou re la en st zü é de th".split()


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def corpus(seed=1, n=120):
    """(doc_id, text, lang, source, n_chars), with all kinds of awkward rows."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randint(3, 90))) for _ in range(n)]
    for i in range(0, 40, 2):  # near copies of others
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    base = words(rng, 60)
    for _ in range(30):  # a family around one text
        w = list(base)
        for _ in range(rng.randint(1, 12)):
            w[rng.randrange(60)] = rng.choice(SYLLABLES) + str(rng.randint(0, 99))
        texts.append(" ".join(w))
    texts += [texts[3], texts[3].upper(), texts[4].replace(" ", "\n\t "), "", None, " ", "\n\n", "one", "ONE", "two words", None, "", "x " * 3000, "y" * 50_000, " lead", "lead ", "lead"]
    rows = [(i, t, rng.choice("ab"), rng.choice(["s1", "s2", "s1", "é", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "no id", None, None, None), (None, texts[3], None, None, None)]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    extra = [F.lit(1).alias(c) for c in ("_id", "_n", "_key", "_sha", "score", "spans", "kept", "size", "_x_doc_id", "n_words", "_rep", "taken")]
    return spark.createDataFrame(corpus(), COLUMNS).select("*", *extra).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def scanned(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as rules", "'k' as sentence_ids")
    return [r for r in sorted(license_scan.scan(frame).collect(), key=lambda r: r.doc_id)]


def test_license_sentences(spark, empty):
    text = "Intro line.\nLicensed under the Apache License, Version 2.0.\nPermission is hereby granted!\nALL RIGHTS RESERVED. Released under the MIT License."
    got = scanned(spark, [text, None, "", "mit licensed", "lorem\nreleased under MIT", text, "x" * 10_000 + "\n" + "word " * 200_000 + "\n" + text])
    assert got[0].sentence_ids == got[5].sentence_ids == got[6].sentence_ids == ["apache-2.0-notice", "all-rights", "mit-notice"]
    assert got[0].licenses == ["MIT", "Apache-2.0", "LicenseRef-all-rights-reserved"]
    assert got[1].licenses == got[2].licenses == got[3].licenses == [] and got[4].licenses == ["MIT"]
    assert license_scan.match(["bsd-source", "bsd-redistribute"]) == []
    assert license_scan.match(["bsd-redistribute", "x", "bsd-source", "bsd-endorse"]) == [("bsd-3-text", "BSD-3-Clause")]  # not its BSD-2 part
    assert license_scan.scan(empty).count() == 0


FULL = {
    "MIT": 'Copyright (c) 2020 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0',
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License.",
    "LicenseRef-all-rights-reserved,BSD-3-Clause": 'Copyright (c) 2020, A. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable.\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-only": "SPDX-License-Identifier: GPL-3.0-only",
    "GPL-2.0-or-later": "SPDX-License-Identifier: GPL-2.0+",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
}


def test_whole_and_wrapped_licenses(spark):
    import textwrap

    wrapped = lambda t: "\n".join(textwrap.fill(line, 60) for line in t.split("\n"))
    texts, want = [], []
    for licence, t in FULL.items():
        for fold in (str, wrapped):
            for mark in ("", "# ", " * ", "// ", "dnl ", "; ", "REM "):
                texts.append("\n".join((mark + line).rstrip() for line in fold(t).split("\n")))
                want.append(set(licence.split(",")))
    got = scanned(spark, texts)
    assert [(w, r.licenses, t) for w, r, t in zip(want, got, texts) if set(r.licenses) != w] == []
    assert scanned(spark, ["the mit\n\nlicense. MIT.\nLicense x"])[0].licenses == []


def test_license_sql_agrees(spark, tmp_path):
    """The query and its SQL, which grows runs of pieces recursively, on whole, wrapped, cut and mixed texts."""
    import textwrap

    import duckdb

    from lexloom.llm.oracles import ORACLES

    rng = random.Random(3)
    parts = [p for t in FULL.values() for p in re.split(r"(?<=[.:;]) ", t)] + ["", " * ", "lorem", "MIT License", "License: MIT", "\n", "...", "é"]
    texts = [*FULL.values(), *(textwrap.fill(t, 50) for t in FULL.values()), *(rng.choice([" ", "\n", "\n\n", ".\n# "]).join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(60)), None, ""]
    spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(ORACLES["op1_license_scan"])
    got = queries.op1_license_scan(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(rel.columns)
    assert rows(got.select(*rel.columns)) == sorted(rel.fetchall(), key=repr)


class SlowFtrl:
    """The updates one coordinate at a time, in dictionaries, from the published formulas."""

    def __init__(self, alpha=0.3, beta=1.0, l1=0.02, l2=0.05):
        self.alpha, self.beta, self.l1, self.l2, self.z, self.n = alpha, beta, l1, l2, {}, {}

    def weight(self, i):
        z, n = self.z.get(i, 0.0), self.n.get(i, 0.0)
        if i == "bias":
            return -z / ((self.beta + n**0.5) / self.alpha)
        if abs(z) <= self.l1:
            return 0.0
        return -(z - (self.l1 if z > 0 else -self.l1)) / ((self.beta + n**0.5) / self.alpha + self.l2)

    def vector(self, text):
        grams = quality.features(text).tolist()
        x = {i: quality.SCALE * grams.count(i) / len(grams) for i in set(grams)}
        return {**x, "bias": 1.0}

    def probability(self, text):
        z = sum(v * self.weight(i) for i, v in self.vector(text).items())
        return 1 / (1 + math.exp(-max(-35, min(35, z))))

    def learn(self, text, y):
        x, p = self.vector(text), self.probability(text)
        for i, v in x.items():
            g, w, n = (p - y) * v, self.weight(i), self.n.get(i, 0.0)
            self.z[i] = self.z.get(i, 0.0) + g - ((n + g * g) ** 0.5 - n**0.5) / self.alpha * w
            self.n[i] = n + g * g


def test_quality_against_slow_updates(spark, docs):
    """Training and scores equal the one-coordinate version: nulls, ties, repeated and unlabelled rows, a cut sample."""
    rng = random.Random(6)
    texts = [" ".join(words(rng, rng.randint(0, 30))) for _ in range(60)] + ["AB !!!! " * 40, None, "", "tie", "tie"]
    data = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "another text"), (None, "no id")]
    marks = [(i, i % 2) for i in range(0, 64)] + [(1, 0), (900, 1), (None, 1), (7, None)]
    frame, labels = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    order = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in range(64)], "i long").select("i", F.xxhash64("i")).collect()}
    for sample in (6000, 20):
        model = quality.train(frame.withColumn("_o", F.lit(1)).withColumn("_y", F.lit(0)), labels, sample=sample)
        y = {}
        for i, v in marks:
            if i is not None and v is not None and zlib.crc32(str(i).encode()) % 4 != 2:
                y[i] = min(v, y.get(i, v))
        keys = set(sorted((i for i in y if i in order or i == 900), key=lambda i: (order.get(i, 1 << 70), i))[:sample])
        chosen = sorted((order[i], i, (t or "").encode()) for i, t in data if i in keys and i in order)[:sample]
        slow = SlowFtrl()
        for _ in range(2):
            for _, i, t in chosen:
                slow.learn(t.decode(), y[i])
        got = quality.score(frame, model).collect()
        assert sorted((repr(r.doc_id), round(r.score, 4)) for r in got) == sorted((repr(i), round(slow.probability(t or ""), 4)) for i, t in data)
        assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_quality_features_see_whole_runs():
    assert len(set(quality.features("!?!?!?!?").tolist()) & set(quality.features("!?!").tolist())) == 0
    assert (quality.features("!!!!!") == quality.features("!!!")).all() and not (quality.features("!!") == quality.features("!")).all()


def brute_classes(rows_, n=2, share=80):
    def bag(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])

    bags = [bag(r[1]) for r in rows_]
    at = list(range(len(rows_)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows_)):
        for j in range(i):
            a, b = bags[i], bags[j]
            if a and b and 100 * len(a & b) >= share * len(a | b) or rows_[i][0] is not None and rows_[i][0] == rows_[j][0]:
                at[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows_):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = [(r[0], len(bags[i]), least.get(find(i))) for i, r in enumerate(rows_)]
    return sorted((*r, r[0] == r[2] if r[2] is not None else True) for r in out if r[0] is not None), [r for r in out if r[0] is None]


@pytest.mark.parametrize("n,sizes", [(2, {}), (5, {}), (2, {"block_sets": 4})])
def test_near_duplicates(docs, n, sizes):
    got = minhash_dedup.near_duplicates(docs, words=n, **sizes).collect()
    want, nameless = brute_classes(corpus(), n)
    assert sorted(tuple(r) for r in got if r[0] is not None) == want
    assert sorted(map(repr, (tuple(r)[:3] for r in got if r[0] is None))) == sorted(map(repr, nameless))


def test_exploded_tables_are_not_broadcast(spark, tmp_path):
    """Spark sizes them by their rows before, 32 tokens a row as one value."""
    reps = spark.range(1000).select(F.col("id").alias("_node"), F.lit(9).cast("long").alias("_n"), F.lit(b"x" * 64).alias("_sig"), F.sequence(F.col("id"), F.col("id") + 31).alias("_toks"))
    reps.write.parquet(str(tmp_path / "sets"))
    posts = minhash_dedup.postings(spark.read.parquet(str(tmp_path / "sets")), 6)
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string")
    for df in (posts, exact_dedup.dedup(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert posts.count() > 0


def test_near_duplicates_of_nothing(empty):
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_one_identifier_over_different_texts(spark):
    rng = random.Random(8)
    x, y = words(rng, 60), words(rng, 60)
    rows_ = [(5, " ".join(x)), (5, " ".join(y)), (3, " ".join([*y, "more"])), (4, " ".join([*x, "more"])), (9, " ".join(x[:-1])), (7, "alone"), (7, ""), (8, ""), (5, None), (None, " ".join(y[1:])), (2, "b a"), (6, "b a"), (6, "c d"), (1, "c d")]
    frame = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    got = minhash_dedup.near_duplicates(frame, words=2).collect()
    want, nameless = brute_classes(rows_, 2)
    assert sorted(tuple(r) for r in got if r[0] is not None) == want
    assert {(r.doc_id, r.component_id) for r in got} >= {(3, 3), (4, 3), (5, 3), (9, 3), (8, 8), (6, 1), (2, 1), (None, 3)}
    assert minhash_dedup.near_duplicates(frame.withColumn("_node", F.lit(1)).withColumn("_g", F.lit("k")), words=2).count() == len(rows_)


def test_templates_and_a_large_family(spark):
    """Pages of one template, alike to some 60 to 79 %, stay apart; a family of 400 around one text is one class."""
    rng = random.Random(4)
    core = words(rng, 200)
    template = [" ".join(core + [f"own{i}x{j}" for j in range(rng.randint(30, 90))]) for i in range(350)]
    base = words(rng, 120)
    family = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(120)] = f"new{i}"
        family.append(" ".join(w))
    rows_ = list(enumerate(template + family))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string"), words=2).collect()
    assert sorted(tuple(r) for r in got) == brute_classes(rows_, 2)[0]


def test_long_posting_lists(docs, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "LIST", 3)
    got = minhash_dedup.near_duplicates(docs, words=2, block_sets=5).collect()
    assert sorted(tuple(r) for r in got if r[0] is not None) == brute_classes(corpus(), 2)[0]


def test_unrelated_texts_of_common_words(spark, monkeypatch):
    """Shingles that many unrelated texts have bring no posts, or these grow faster than the table."""
    rng = random.Random(11)
    common = [f"word{i}" for i in range(150)]
    rows_ = [(i, " ".join(rng.choices(common, k=300))) for i in range(300)]
    rows_ += [(300 + i, f"{rows_[i][1]} more{i}") for i in range(0, 300, 60)]
    posts, whole = [], minhash_dedup.candidate_edges
    monkeypatch.setattr(minhash_dedup, "candidate_edges", lambda p, *more: posts.append(p.count()) or whole(p, *more))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string"), words=2).collect()
    assert sorted(tuple(r) for r in got) == brute_classes(rows_, 2)[0]
    assert posts[0] < len(rows_)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(25)] + [(7, 7)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_shingles_are_words_by_contract():
    assert len(shingles.shingle_set(b"a b\x0bA B\x1ca b")) == 4  # \x1c is no white space
    assert len(shingles.shingle_set("É é".encode())) == 1 and len(shingles.shingle_set(b" \n")) == 0
    assert (shingles.shingle_set(b"ONE") == shingles.shingle_set(b"one")).all()


@pytest.mark.parametrize("zip64", [False, True])
def test_warc_round_trip(spark, tmp_path, zip64):
    data = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (5, None, None), (3, "u\r\nX: y", ""), (4, "é", "ünï" * 9000), (None, "n", "<p>x</p>"), (4, "é", "ünï" * 9000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(2)
    manifest = warc_zip.write(pages, f"file://{tmp_path}/w", archive_bytes=300, zip64=zip64)
    assert manifest.count() > 2 and manifest.agg(F.sum("n_records")).first()[0] == len(data)
    got = warc_zip.read(manifest).collect()
    assert len(got) == len(data)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert (by[1][0].record_type, by[1][0].refers_to, bytes(by[1][0].payload)) == ("response", None, b"<p>x</p>")
    assert (by[2][0].record_type, by[2][0].refers_to, by[2][0].payload_bytes, by[2][0].payload) == ("revisit", 1, 8, None)
    assert by[2][0].payload_digest == by[1][0].payload_digest == warc_zip.sha1_base32(b"<p>x</p>")
    assert (by[3][0].record_type, by[3][0].payload_bytes, by[5][0].refers_to) == ("response", 0, 3)
    assert bytes(by[4][0].payload).decode() == "ünï" * 9000 and [r.record_type for r in by[4]] == ["response"] * 2
    assert by[None][0].refers_to == 1
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_zip.read(warc_zip.write(empty, f"file://{tmp_path}/e")).count() == 0


def test_zip_of_the_standard_library(tmp_path):
    import zipfile

    from pyarrow import fs

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("stored", b"abc" * 100)
        z.writestr("packed", b"abc" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5 comment"
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a.zip")) as f:
        r = warc_zip.Reader(f)
        assert set(r.members) == {"stored", "packed"} and r.member("stored") == r.member("packed") == b"abc" * 100
        assert r.range(*r.place("stored")) == b"abc" * 100
        with pytest.raises(ValueError, match="not stored"):
            r.place("packed")


def test_records_name_each_other(spark, tmp_path):
    data = [(3, "http://c.org/x", "same"), (1, "http://www.A.org:80/p q", "same"), (2, "b", "same"), (7, "d", "twice"), (7, "d", "twice"), (8, "e", "twice")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as _k", "'x' as path").repartition(3)
    got = warc_zip.read(warc_zip.write(pages, f"file://{tmp_path}/w")).collect()
    by = {r.page_id: r for r in got}
    assert len({r.record_id for r in got}) == 6  # repeated rows too
    assert by[3].refers_to_record == by[2].refers_to_record == by[1].record_id and by[8].refers_to == 7 and by[8].refers_to_record is None
    assert warc_zip.sort_key("http://www.A.org:80/p q") == "org,a:80)/p%20q" and warc_zip.sort_key("https://b.fr") == "fr,b)/"


def test_attempts_that_lose_count_for_nothing(spark, tmp_path):
    """Files of another attempt in the folder are in no manifest; the reading is spread over tasks."""
    pages = spark.range(200).selectExpr("id page_id", "concat('http://h/', id) url", "repeat(cast(id as string), 50) html")
    manifest = warc_zip.write(pages, f"file://{tmp_path}/w", archive_bytes=500)
    files = [r.path for r in manifest.collect()]
    assert len(set(files)) == len(files) > 8
    for f in files[:3]:
        (tmp_path / "w" / f.rpartition("/")[2].replace("part-", "part-9")).write_bytes(open(f.removeprefix("file://"), "rb").read())
    read = warc_zip.read(manifest)
    assert read.count() == 200 and read.select(F.spark_partition_id()).distinct().count() > 1


def test_archives_of_others(spark, tmp_path):
    import gzip
    import json
    import zipfile

    def rec(kind, body, **more):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in {"WARC_Type": kind, "WARC_Record_ID": f"<{kind}>", **more, "Content_Length": len(body)}.items())
        return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"
    raw = [rec("warcinfo", b"a: b\r\n\r\nc"), rec("response", http, Content_Type="application/http;msgtype=response", WARC_Target_URI="http://o/", WARC_Payload_Digest="sha1:" + warc_zip.sha1_base32(b"hello")), rec("revisit", b"", WARC_Target_URI="http://p/", WARC_Refers_To="<response>", WARC_Payload_Digest="sha1:X")]
    packed = [gzip.compress(r) for r in raw]
    lines = [f"o)/ 2020 {json.dumps({'offset': sum(map(len, packed[:i])), 'length': len(p), 'filename': 'a.warc.gz'})}" for i, p in enumerate(packed)] + [json.dumps({"offset": "0", "length": str(len(raw[0])), "filename": "b.warc"})]
    with zipfile.ZipFile(tmp_path / "o.wacz", "w") as z:
        z.writestr("archive/a.warc.gz", b"".join(packed))
        z.writestr("archive/b.warc", raw[0])
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(lines).encode()), zipfile.ZIP_DEFLATED)
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
    got = sorted(warc_zip.read(spark.createDataFrame([(str(tmp_path / "o.wacz"),)], "path string")).collect(), key=lambda r: r.record_type)
    assert [(r.record_type, r.url, r.payload_bytes, r.page_id) for r in got] == [("response", "http://o/", 5, None), ("revisit", "http://p/", None, None), ("warcinfo", None, 9, None), ("warcinfo", None, 9, None)]
    assert bytes(got[0].payload) == b"hello" and got[1].refers_to_record == "<response>" and bytes(got[2].payload) == b"a: b\r\n\r\nc"


def test_token_counts_equal_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(7)
    odd = [" ", "  ", "\n", "\r\n", "\t", "a", "the", "é", "²", "½", "_", "!", "...", "'s", "'T", "'ll", "　", "\x1c", "\x85", "\xa0", "日本", "😀", "<|endoftext|>", "é", "A", "٣", "ª"]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 40))) for _ in range(1500)] + [t or "" for _, t, *_ in corpus()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_count.count_tokens(frame, path).collect():
        t = texts[r.doc_id]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512), repr(t[:80])
    again = token_count.count_tokens(docs, path).collect()
    assert sorted((repr(r.doc_id), r.n_tokens) for r in again) == sorted((repr(r[0]), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in corpus())
    assert token_count.count_tokens(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError, match="not plain byte-level"):
        token_count.Counter(str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")))


def brute_mix(rows_, fine=1024, golden=mixing.GOLDEN):
    """Slot by slot and token by token: (size, total, target, taken, first slot) of each row."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows_]
    names = sorted({r[3] for r in rows_}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows_) if r[3] == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(size)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= 3 * total[s]
            free.remove(s)
    need = {s: min(int(target[s] + 0.5), 3 * total[s]) for s in names}
    tiers = {}
    for s in names:
        if need[s]:
            tiers.setdefault(len(f"{need[s]:x}"), []).append(s)
    streams = {}
    for s in names:
        own = sorted((hashlib.md5(b"" if r[0] is None else str(r[0]).encode()).hexdigest(), r[0] is not None, r[0] or 0, n, i) for i, (r, n) in enumerate(zip(rows_, size)) if r[3] == s)
        streams[s] = [x[-1] for x in own for _ in range(x[3])]
    taken, first = [0] * len(rows_), [None] * len(rows_)
    for members in tiers.values():
        whole, block = sum(need[s] for s in members), max(1, min(need[s] for s in members) // fine)
        edges, at = [], 0
        for s in members:
            edges.append((int(at / whole * 2.0**32), int((at + need[s]) / whole * 2.0**32), s))
            at += need[s]
        rank = dict.fromkeys(members, 0)
        for slot in range((2 * whole + block) // (2 * block)):
            p = slot * golden % 2**32
            s = next((s for lo, hi, s in edges if lo <= p < hi), ...)
            if s is ...:
                continue
            blocks = -(-total[s] // block)
            if rank[s] < 3 * blocks:
                begin = rank[s] % blocks * block
                for j, i in enumerate(streams[s][begin : begin + block]):
                    if first[i] is None and (j or not begin or streams[s][begin - 1] != i):
                        first[i] = slot
                    taken[i] += 1
            rank[s] += 1
    return size, total, target, taken, first


@pytest.mark.parametrize("fine", [1024, 2])
def test_mixing_token_by_token(docs, empty, fine):
    rows_ = corpus()
    size, total, target, taken, first = brute_mix(rows_, fine)
    want = sorted((repr(r[0]), n, total[r[3]], round(target[r[3]], 6), t, f) for r, n, t, f in zip(rows_, size, taken, first))
    told = lambda df: sorted((repr(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken, r.first_slot) for r in df.collect())
    got = told(mixing.mix(docs, fine=fine))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] is None for g in got] == [g[4] == 0 for g in got] and [g for g in got if g[4]] == [w for w in want if w[4]]
    assert all(t <= 3 * n for n, t in zip(size, taken))
    if fine < 1024:
        return
    for s in total:
        assert abs(sum(t for t, r in zip(taken, rows_) if r[3] == s) - target[s]) <= 0.01 * target[s] + 3
    assert told(mixing.mix(docs.repartition(7), fine=fine)) == got
    assert mixing.mix(empty).count() == 0 and mixing.sequence(empty).count() == 0
    assert told(mixing.mix(docs, carry=("source",))) == got


def test_mixing_depends_on_its_points(docs, monkeypatch):
    taken = lambda: rows(mixing.mix(docs, fine=16).select("doc_id", "taken"))
    good = taken()
    monkeypatch.setattr(mixing, "GOLDEN", 3)  # no low discrepancy: the slots go to few sources
    assert taken() != good


def test_mix_in_order(docs):
    """The sequence reads what ``mix`` counts, and each beginning of it has the sources in proportion."""
    seq = mixing.sequence(docs, fine=64)
    assert rows(seq.groupBy("doc_id").agg(F.sum("words")).where("doc_id <> 5")) == rows(mixing.mix(docs, fine=64).where("taken > 0 and doc_id <> 5").select("doc_id", F.col("taken").cast("long")))
    read = [(r.source, r.words) for r in seq.orderBy("at", "tier", "slot", "first").collect()]
    whole = {s: sum(n for x, n in read if x == s) for s, _ in read}
    for part in (0.1, 0.3, 0.7):
        begun, had = {}, 0
        for s, n in read:
            if had >= part * sum(whole.values()):
                break
            begun[s] = begun.get(s, 0) + n
            had += n
        assert all(abs(begun.get(s, 0) - part * n) <= 0.03 * sum(whole.values()) for s, n in whole.items())


def test_many_sources(spark):
    """Some thousand sources of very different sizes: each comes near its target."""
    docs = spark.range(4000).selectExpr("id doc_id", "repeat('w ', cast(1 + pow(1.003, id) as int) % 5000 + 1) text", "concat('s', id % 1500) source")
    got = mixing.mix(docs).groupBy("source_size", "target", F.col("doc_id") % 1500).agg(F.sum("taken").alias("t")).collect()
    assert len(got) == 1500 and all(abs(r.t - r.target) <= 0.01 * r.target + 3 for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head>
<body><header>Top <a href=/>home</a></header><nav><ul><li><a>One</a></li><li>Two</li></ul></nav><!-- ad --><div class="ad box">Buy</div>
<div id="cookie-notice">We use cookies</div><main><article><h1>Title &amp; more</h1><p><b>Bold start of
the   text.<br>After break<p>Second &eacute;&nbsp;paragraph</p><p>.</p><form><label>Mail</label><input></form>
<aside>See also</aside><figure><figcaption>Caption</figcaption></figure><div class="sharing">Share</div><p>Last <i>words</i></p></article></main>
<section id="comments"><article><p>A very long reader comment that goes on and on and on, longer than all of the article's own text together, in one line without any tags at all, again and again and again.</p></article></section>
<div class="sidebar">Side</div><footer>&copy; foot</footer>"""


def test_html_text(spark):
    assert html_text.extract(PAGE) == "Title & more Bold start of the text. After break Second é paragraph . Caption Last words"
    data = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "no tags, only text"), (5, "x", "<p>" * 3000 + "deep"), (6, "y", "<div><p>short</p><p>" + "long line of content " * 20 + "</p></div><div class=menu>menu</div>")]
    got = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0 and got[4].text == "no tags, only text" and got[5].text == "deep"
    assert got[6].text.startswith("short long line") and "menu" not in got[6].text and got[6].n_chars == len(got[6].text)


@pytest.mark.parametrize("page", [
    '<article class="post has-sidebar">{}<div class="sidebar">Aside</div></article><article class="card"><p>Teaser</p></article>',
    '<article class="comments-open">{}</article><div class="comments"><article class="comment"><p>Reader words</p></article></div>',
    '<div class="content-with-sidebar"><div>{}</div><div class="sidebar"><p>Aside</p></div></div>',
    '<div class="elementor"><div class="elementor-widget a">{0}</div><div class="elementor-widget sidebar">Aside</div></div>',
    '<form action="/"><div class="menu">Menu</div><div>{}</div></form>',
    '<div class="page">{}</div><div class="menu">Menu</div>',
])
def test_html_text_loses_no_article(page):
    parts = ["Heading", "Lead of the text in a few words", *(f"Sentence {i} goes on " * 12 for i in range(4))]
    body = f"<h1>{parts[0]}</h1><p>{parts[1]}</p><div class=body>" + "".join(f"<p>{p}</p>" for p in parts[2:]) + "</div>"
    assert html_text.extract(page.format(body)) == " ".join(" ".join(parts).split())
    if "elementor" in page:
        widgets = "</div><div class='elementor-widget a'>".join(f"<p>{p}</p>" for p in parts)
        assert html_text.extract(page.format(widgets)) == " ".join(" ".join(parts).split())


PROSE = "Sentence of the content that goes on for some length, as running text does. "
STORY = ["Heading", "Short lead", *(f"{PROSE * 3}{i}" for i in range(5))]
CONTENT = f"<div class=x><h1>{STORY[0]}</h1><div class=lead>{STORY[1]}</div><div class=body>" + "".join(f"<p>{p}</p>" for p in STORY[2:]) + "</div></div>"
LINKS = "<div class=tags>" + "".join(f"<span><a href=/{i}><b>Topic number {i}</b></a></span><br>" for i in range(300)) + "</div>"
LEGAL = "<div><div>One single long line of a legal sort far from the content, without any tags, quite long indeed it is</div></div>"


def test_clusters_choose_the_text(monkeypatch):
    """Pages without article or mark: more text in links than in the content; a long line by itself; teasers."""
    want = " ".join(STORY)
    menus = f"<body>{LINKS}{CONTENT}</body>", f"<body>{CONTENT}{LINKS}</body>"
    alone = f"<body>{LINKS}{CONTENT}{LINKS}{LEGAL}{LINKS}</body>"
    teaser = f"<body><article class=card>Teaser one</article>{LINKS}{CONTENT}</body>"
    assert [html_text.extract(p) for p in (*menus, alone, teaser)] == [want] * 4
    assert html_text.extract(f"<body>{LINKS}<article>{CONTENT}{LINKS}</article></body>").startswith(want + " Topic number 0")  # an article is whole
    with monkeypatch.context() as m:
        m.setattr(html_text, "smooth", lambda values, sigma=1.0: values)
        assert html_text.extract(alone) != want
    with monkeypatch.context() as m:
        m.setattr(html_text, "clustered", lambda lines, kept, regions: [float(len(t)) * k for (t, *_), k in zip(lines, kept)])
        assert all(html_text.extract(p) != want for p in (*menus, alone, teaser))


def test_html_table_cases(spark):
    rows_ = [(1, "u", PAGE), (1, "u", PAGE), (None, None, "<p>x</p>")]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string").selectExpr("*", "1 as text", "'k' as n_chars")
    got = html_text.extract_text(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 88), ("1", 88), ("None", 1)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def brute_equal(rows_):
    """(id, owner, rows of the text, SHA-256) of each row."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows_]
    out = []
    for r, t in zip(rows_, norm):
        ids = [x[0] for x, u in zip(rows_, norm) if u == t]
        out.append((r[0], min((i for i in ids if i is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("budget", [exact_dedup.BUDGET, 2000])
def test_exact_dedup(docs, empty, budget):
    got = exact_dedup.dedup(docs, budget=budget, carry=("score", "kept")).collect()
    assert sorted(((r[0], r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute_equal(corpus())
    kept = [(r[0], r.text_sha256) for r in got if r[3]]
    assert len(kept) == len({r.text_sha256 for r in got})  # one row of each text, repeated rows too
    assert sorted(kept, key=repr) == sorted({(w[1], w[3]) for w in brute_equal(corpus())}, key=repr)
    assert exact_dedup.dedup(empty).count() == 0


def test_bytes_decide(spark):
    """In one trie with everything, strings that share length and all but their last byte stay apart."""
    texts = ["same start " * 50 + c for c in "abcabca"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = exact_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {0: (0, 3), 3: (0, 3), 6: (0, 3), 1: (1, 2), 4: (1, 2), 2: (2, 2), 5: (2, 2)}
    trie = exact_dedup.Patricia()
    assert len({id(trie.insert(t.encode(), exact_dedup.owner(0, 0))) for t in texts}) == 3 and trie.held < 2500  # the shared part is held once


@pytest.mark.parametrize("stubs", [True, False])
def test_patricia_trie(stubs):
    rng = random.Random(3)
    trie, want, left = exact_dedup.Patricia(stubs), {}, {}
    for i in range(2500):
        k = bytes(rng.choices(b"abc", k=rng.randint(0, 9)))
        want[k] = want.get(k, 0) + 1
        if trie.insert(k, exact_dedup.owner(i, i)) is None:
            left[k] = left.get(k, 0) + 1
        if trie.held > 60_000:
            for data, t in trie.spill(30_000):
                left[data] = left.get(data, 0) + t.count
    stay = {k: t.count for k, t in trie.terminals()}
    assert left and {k: stay.get(k, 0) + left.get(k, 0) for k in stay.keys() | left} == want
    assert not stubs or not stay.keys() & left  # what has left comes back nowhere
    whole = exact_dedup.Patricia()
    for i, k in enumerate(want):
        whole.insert(k, exact_dedup.owner(None if i % 2 else i, i))
    assert {k: t.least for k, t in whole.terminals()} == {k: exact_dedup.owner(None if i % 2 else i, i) for i, k in enumerate(want)}
    for raw in (b"", b" ", b"\n\t x  y\x0b", b"a\x1cb"):
        assert exact_dedup.normalise(raw).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", raw.decode())


def luhn_brute(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])) % 10 == 0


def brute_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub(r"[^0-9]", "", m.group())) <= 19 and luhn_brute(d)]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def test_pii_against_plain_regexes(spark):
    rng = random.Random(11)
    bits = ["a@b.co", "@", ".", "-", "+", " ", "x", "é", "1", "23", "255", "256", "1.2.3.4", "4539 1488 0343 6467", "378282246310005", "+1 (555) 010-9999", "%", "()", "@x.y-z.w", "００", "\n", "+4", "9" * 20]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(4000)]
    texts += ["a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "@" * 100_000, "a.b@c." * 20_000]
    for t in texts[:4000]:
        assert [s for s in pii.find(t) if s[0] in pii.BASE] == brute_pii(t), repr(t)
    for t in texts[4000:]:
        pii.find(t)
    iban = "pay to IBAN DE89 3704 0044 0532 0130 00 now, not DE88370400440532013000"
    assert [s for s in pii.find(iban) if s[0] == "iban"] == [("iban", 12, 39)]
    got = pii.digest(pii.scan(spark.createDataFrame([(1, iban), (2, None), (3, "me@x.org " + "😀 ip 10.0.0.1")], "doc_id long, text string"))).collect()
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[0].spans == "iban:12:39"
    assert got[2].spans == "email:0:8,ip:14:22" and (got[2].n_email, got[2].n_ip, got[2].n_card, got[2].n_phone) == (1, 1, 0, 0)
    assert pii.score("my card 378282246310005", "card", 8, 23) > pii.score("xx xxxx 378282246310005", "card", 8, 23)


def test_pii_on_the_table(docs, empty):
    got = pii.digest(pii.scan(docs)).collect()
    assert len(got) == len(corpus()) and sorted(r.spans for r in got) == sorted(pii.joined(pii.find(r[1] or "")) for r in corpus())
    assert pii.scan(empty).count() == 0
    iban = "to DE89370400440532013000"
    assert [len(pii.scored(iban, x)) for x in (0.5, 0.95)] == [1, 0] and len(pii.scored("iban account " + iban, 0.95)) == 1  # context decides


def brute_hits(text, items, window=13):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hit, found = set(), set()
    for ident, t in items:
        b = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        n = min(window, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(ident))
    return len(w), hit, found


def bench_rows():
    rng = random.Random(13)
    small = "a b c".split()
    long = [" ".join(rng.choices(small, k=rng.randint(1, 30))) for _ in range(14)]
    return [(i, t) for i, t in enumerate(long)] + [(20, None), (21, ""), (22, "!!"), (23, long[0]), (24, "Solo"), (25, "x-y z")]


@pytest.mark.parametrize("iban", ["QA58DOHB00001234567890ABCDEFG", "XK051212012345678906", "PK36SCBL0000001123456702", "SM86U0322509800000000270100", "LB62 0999 0000 0001 0019 0122 9114", "GI75NWBK000000007099453"])
def test_iban_of_the_whole_registry(iban):
    assert ("iban", 3, 3 + len(iban)) in pii.find(f"to {iban}.")


@pytest.mark.parametrize("limit,memory", [(decontaminate.BLOCK_WORDS, decontaminate.MEMORY), (40, decontaminate.MEMORY), (40, 1)])
@pytest.mark.parametrize("window", [13, 3])
def test_decontaminate(spark, limit, memory, window):
    """One block, many in one pass, many passes."""
    rng = random.Random(17)
    items = bench_rows()
    texts = [" ".join(rng.choices(["a", "b", "c", "B", "d", "x-Y", "z", "solo,"], weights=[6, 6, 6, 1, 1, 1, 1, 0.3], k=rng.randint(0, 70))) for _ in range(150)] + [None, "", "...", "x y z " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert (len(decontaminate.built(bench, window, limit=limit)) > 1) == (limit == 40)
    both = decontaminate.find(docs.selectExpr("*", "1 as _k", "2 as _p", "'k' as items"), bench, window, limit=limit, memory=memory).cache()
    got, spans = {r.doc_id: r for r in decontaminate.digest(both).collect()}, {r.doc_id: r.spans for r in both.collect()}
    left = {r.doc_id: r.text for r in decontaminate.remove(docs, bench, window, limit=limit, memory=memory).collect()}
    whole = {r.doc_id: r.text for r in decontaminate.remove(docs, bench, window).collect()} if memory == 1 else left
    assert left == whole
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, items, window)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (n, len(hit), len(found)), t
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)
        assert {k for s in spans[i] for k in range(s.start, s.end)} == hit
        assert (i in left) == (not r.contaminated)
        if i in left and not hit:
            assert left[i] == t


def test_removed_spans(spark, empty):
    passage = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    rest = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, f"Start, {rest}. {passage}! End {rest}", 9, "k"), (2, passage, 9, "k"), (3, "clean", 5, "k"), (4, None, None, "k")], "doc_id long, text string, n_chars long, spans string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.remove(docs, bench).collect()}
    assert set(got) == {1, 3, 4} and got[1].text == f"Start, {rest}. ! End {rest}" and got[1].n_chars == len(got[1].text)
    assert (got[3].text, got[3].n_chars, got[4].text, got[4].spans) == ("clean", 5, None, "k")
    nameless = spark.createDataFrame([(None, passage), (7, passage)], "item_id long, text string")
    assert [(r.n_hit, r.n_items) for r in decontaminate.digest(decontaminate.find(docs, nameless)).where("doc_id = 2").collect()] == [(14, 1)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(decontaminate.find(docs, none)).where("contaminated or n_hit > 0 or n_items > 0").count() == 0
    assert decontaminate.find(empty, bench).count() == 0


def test_every_query_is_registered_once():
    import __spark_entry__

    names = [q for q in __spark_entry__.queries() if q.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and set(queries.QUERIES) == set(names)
