"""Text queries give every line, finding and passage, checked in Python on small tables."""

from __future__ import annotations

import os
import re

import pytest

from loomstead import catalogue
from loomstead.sources.tables import TABLES
from tests.oracle import connect, differs

SF = "/root/testdata/sf0.001"
PASSAGE = "it was a bright cold day in April, and the clocks were striking thirteen all over the wide town"
TEXTS = ["One\n Two  X \nthree\nFOUR   Four\n\nSix", "a\nb %%% c\nd\ne\nf\ng token = \"x\"\nh", f"some way in: {PASSAGE}.", f"{PASSAGE[:60]} and then something else", ""]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("text")
    for t in TABLES:
        if t not in ("documents", "benchmark"):
            os.symlink(f"{SF}/{t}.parquet", d / f"{t}.parquet")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(d / "documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").toPandas().to_parquet(d / "benchmark.parquet")
    return str(d)


def rows(spark, folder, name):
    df = catalogue.queries()[name](spark, folder)
    assert differs(df, connect(folder), catalogue.oracle_sql()[name]) == ""
    return sorted(map(tuple, df.collect()))


LINES = [(i, k + 1, line) for i, t in enumerate(TEXTS) for k, line in enumerate(t.split("\n"))]


def test_every_line_is_canonicalised(spark, folder):
    assert rows(spark, folder, "canonical_text") == sorted((i, k, re.sub(" +", " ", line).strip().lower()) for i, k, line in LINES)


def test_every_finding_is_explained(spark, folder):
    got = rows(spark, folder, "explain_lines")
    hits = [("noise-run", 1, 2), ("literal-token", 1, 6)]
    assert got == sorted((rule, f"s/{i}", at, k, line) for rule, i, at in hits for j, k, line in LINES if j == i and at - 2 <= k <= at + 2)


def test_whole_passages_are_contained(spark, folder):
    assert rows(spark, folder, "interval_contain_join") == [(1, 2, TEXTS[2].index(PASSAGE) + 1)]
