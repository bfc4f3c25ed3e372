"""The license scan against every rule on every text."""

import random

import pytest

from tablewright.llm import licenses
from tests.llm import brute

PARTS = [
    "Released under the MIT License.", "licensed under the Apache License, Version 2.0", "GNU General Public License v3 or later",
    "GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: GPL-2.0-or-later", "cc by-nc 4.0", "Licensed under CC BY-NC-SA 4.0.",
    "Creative Commons Attribution ShareAlike 3.0 Unported License", "https://creativecommons.org/licenses/by/4.0/", "All rights\nreserved",
    "permission is hereby granted, free of charge, to any person obtaining a copy", "see the LICENSE file for details", "the beer-ware license",
    "3-clause BSD license", "mit\tlicense", "MIT (license)", "apache license mit license", "https://opensource.org/licenses/MIT", "do what the hell you want to public license",
    "distributed under the terms of some other fine license", "submit licenses", "the limit license", "no rights reserved", "Unlicense", "CC0 1.0 universal",
    "you may not use this file except in compliance with the License", "neither the name of the firm nor the names of its contributors",
    "may not be reproduced in any form without the prior written permission", "unauthorized copying of this file is strictly prohibited",
    "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "İMIT LİCENSE", "K MIT License", "é mit license ü",
]
EDGES = [
    (1, None), (2, ""), (3, " \n\t.,"), (4, "mit license"), (5, "MIT LICENSE mit license"), (6, "general public license"), (7, "word " * 70_000 + "mit license"),
    (8, "mit license, " * 400), (8, "mit license, " * 400), (None, "apache license"), (9, "中文 mit license 中文"), (10, "mit\x00license"), (11, "mit license"),
]


def digest(spark, rows, name):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    path = licenses_folder(spark, name)
    df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return [tuple(r) for r in licenses.op11(spark, path).collect()]


def licenses_folder(spark, name):
    from tablewright.session import scratch_path

    return scratch_path(spark, name)


def plain(rows):
    return [(d, *brute.license_scan([(0, t)], licenses.RULES, licenses.BASE)[0]) for d, t in rows]


def ordered(rows):
    return sorted(rows, key=str)


def test_rules_and_gates():
    assert len(licenses.RULES) > 200
    assert [r[2] for r in licenses.RULES] == sorted(r[2] for r in licenses.RULES)


@pytest.mark.parametrize("seed", range(2))
def test_against_every_rule(spark, seed):
    draw = random.Random(seed)
    rows = [(i, p) for i, p in enumerate(PARTS)]
    rows += [(100 + i, " ".join(draw.choice([*PARTS, "filler words here", ";"]) for _ in range(draw.randrange(1, 30)))) for i in range(60)]
    assert ordered(digest(spark, rows, "licenses")) == ordered(plain(rows))


def test_edges(spark):
    assert ordered(digest(spark, EDGES, "edges")) == ordered(plain(EDGES))
    assert digest(spark, [], "none") == []


def test_places_stand_in_long_texts(spark):
    """More places than a run holds, some inside others from an earlier run."""
    text = "licensed under the mit license version 2 0 or later " + "mit license apache license " * 300
    df = spark.createDataFrame([(1, text, "x")], "doc_id bigint, text string, label string")
    row = licenses.scan(df).collect()[0]
    assert row["label"] == "x" and len(row["__base"]) == 601
    assert [p["label"] for p in row["__licenses"]][:3] == ["mit", "mit", "apache"]
    assert len(row["__licenses"]) == 601
    assert (row["__licenses"][0]["start"], row["__licenses"][0]["last"]) == (0, 9)


def test_no_python_in_the_plan(spark):
    plan = licenses.op11(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
