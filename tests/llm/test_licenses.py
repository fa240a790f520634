"""Licence windows: wrapped, embedded and altered licences, and every licence line of the test tables."""

import textwrap

from cytoplan.llm import licenses

FILLER = "".join(f"value{i} = call{i}(x{i}, y{i})  # note {i} about item{i}\n" for i in range(60))


def found(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in licenses.scan(df, **more).collect():
        out.setdefault(r.doc_id, {})[r.unit] = r.license_id
    return out


def test_wrapped_and_embedded_licences(spark):
    texts, want = [], []
    for name in ("mit", "bsd-2-clause", "bsd-3-clause", "apache-2.0-header", "gpl-3.0-header", "lgpl-2.1-header", "agpl-3.0-header", "mpl-2.0-header", "isc", "zlib", "unlicense", "bsl-1.0"):
        wrapped = "\n".join("# " + line for line in textwrap.wrap(licenses.TEMPLATES[name], 70))
        texts.append("#!/bin/sh\n# Copyright 2020 Somebody\n#\n" + wrapped + "\n\n" + FILLER)
        want.append({4: name})
    texts.append(FILLER + "This file is part of it. Released under the MIT License. Have fun with the code.\n" + FILLER)
    want.append({61: "mit-notice"})
    texts.append("nothing of the kind\n" + FILLER)
    got = found(spark, texts)
    assert [got.get(i, {}) for i in range(len(texts))] == [*want, {}]


def test_altered_long_and_odd_texts(spark):
    mit = licenses.TEMPLATES["mit"].split()
    altered = " ".join(w for i, w in enumerate(mit) if i % 19)
    half = " ".join(mit[: len(mit) // 2])
    long = "lorem ipsum the software of any kind " * 20_000 + "\n" + licenses.TEMPLATES["isc"] + "\n" + "x" * 300_000
    got = found(spark, [None, "", "one", "\n\n", "all rights", "ALL  RIGHTS\nreserved", FILLER + altered + FILLER, FILLER + half, long])
    assert got == {5: {0: "all-rights-reserved", 1: "all-rights-reserved"}, 6: {61: "mit"}, 8: {0: "isc", 2: "isc"}}


def test_ties_go_to_the_more_bigrams_then_the_smaller_name(spark):
    known = {"b": "one two three four", "a": "one two three four", "c": "one two three four five"}
    assert found(spark, ["one two three four", "one two three four five"], templates=known) == {0: {0: "a", 1: "a"}, 1: {0: "c", 1: "c"}}


def test_every_licence_line_of_the_tables_is_found(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = df.selectExpr("doc_id", "inline(transform(split(text, '\n'), (l, i) -> struct(i + 1 AS unit, l AS line)))").where("line rlike '(?i)licensed under|mit license|rights reserved' and length(line) < 200")
    got = {(r.doc_id, r.unit) for r in licenses.scan(df).collect()}
    want = {(r.doc_id, r.unit) for r in lines.collect()}
    assert want and want <= got
