"""Line differences between two versions of many texts."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNKS = "path string, change string, base_from int, base_to int, head_from int, head_to int, removed array<string>, added array<string>"


def changed_lines(base: DataFrame, head: DataFrame) -> DataFrame:
    """Hunks between ``base(path, text)`` and ``head(path, text)``, lines from 1 with exclusive ends.

    Equal texts give none.  A path on one side only is one hunk; null texts count as empty, and an empty
    text has no lines.  Texts are compared where the join puts them, one pair at a time; line ends do not count.
    """
    digest = lambda df, side: df.where("path is not null").select("path", F.coalesce("text", F.lit("")).alias(side))
    pairs = digest(base, "before").join(digest(head, "after"), "path", "full").where("not (before <=> after)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, before, after in zip(b["path"], b["before"], b["after"]):
                a, c = (x.splitlines() if isinstance(x, str) else [] for x in (before, after))
                ops = difflib.SequenceMatcher(None, a, c, autojunk=False).get_opcodes()
                rows = [(path, op, i + 1, j + 1, k + 1, m + 1, a[i:j], c[k:m]) for op, i, j, k, m in ops if op != "equal"]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "change", "base_from", "base_to", "head_from", "head_to", "removed", "added"])

    return pairs.select("path", "before", "after").mapInPandas(run, HUNKS)
