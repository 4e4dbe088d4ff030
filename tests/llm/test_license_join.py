import duckdb
import pytest

from gleanery.llm import license_join

from .fixtures import awkward, documents

LINES = [
    "Released under the MIT License.",
    "Released Under the\tMIT   license, and again: under the mit license",
    "under the mit\nlicense",
    "under the mit license under the mit license",
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under the Apache License, Version 3.0.",
    "text\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0\nmore",
    "the license of the work is a general public license under which this gnu is licensed",
    "license " * 5000 + "cc by nc",
    "Apache-License\nversion 2",
    "this work has been released into the domain of the public",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software",
    "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted\n */",
    "released " + "one two three four " * 30 + "under the mit " + "five six seven " * 30 + "license",
    "word " * 1000 + "\n".join(t for label, t in license_join.TEMPLATES if len(t.split()) > 40) + " word" * 700,
]


def sql_rows(docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    found = con.sql(license_join.oracle())
    return sorted((dict(zip(found.columns, r, strict=True)) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("make", [awkward, lambda s: documents(s, LINES + LINES[:2]), lambda s: documents(s, ["no license here"] * 300 + LINES)])
def test_same_rows_as_comparing_every_block_with_every_template(spark, make):
    docs = make(spark)
    found = sorted((r.asDict() for r in license_join.scan_licenses(docs).collect()), key=repr)
    assert repr(found) == repr([{k: r[k] for k in found[0]} for r in sql_rows(docs)])
    assert len(found) == docs.count()


def test_empty_table(spark):
    assert license_join.scan_licenses(documents(spark, [])).collect() == []


def test_overlapping_places_of_a_phrase_all_count(spark):
    rows = license_join.scan_licenses(documents(spark, ["x a b a b a y a b a"]), phrases={"t": "a b a"}).first()
    assert (rows["n_base"], rows["first_word"], rows["last_word"], rows["base_labels"]) == (3, 1, 7, "t")


def wrapped(text, width):
    words = text.split()
    return "\n# ".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_notices_wrapped_over_lines_are_found_and_scattered_words_are_not(spark):
    texts = [("some prose here\n" * 7 + wrapped(t.upper(), 5) + "\nand more\n" * 9, label) for label, t in license_join.TEMPLATES]
    scattered = " and many other words stand between them so that no block holds it all ".join(license_join.TEMPLATES[-1][1].split())
    rows = license_join.scan_licenses(documents(spark, [t for t, _ in texts] + [scattered])).orderBy("doc_id").collect()
    assert all(label in r["labels"].split(",") and r["score"] == 1.0 for r, (_, label) in zip(rows, texts, strict=False))
    assert rows[-1]["labels"] == "" and rows[-1]["score"] == 0.0
