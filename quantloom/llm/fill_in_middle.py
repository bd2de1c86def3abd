"""Operator 12: fill-in-middle transformation over run-length class encodings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import common

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class MiddleSettings:
    """Marks of prefix, suffix and middle; shares in percent; the seed that leads the hashed id."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut_percent: int = 90  # of the documents; the others stay plain
    spm_percent: int = 20  # of those that are cut
    seed: int = 1

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class ClassRuns:
    """A text as maximal runs of ASCII letters and of anything else.

    A run of letters is one unit, of other code points each is one. `units[r]` counts the units before
    run r, which begins at code point `starts[r]`; both end with the totals. A text of n code points
    takes 1 byte (ASCII) or 4 for each while it is encoded, then 16 for each run.
    """

    def __init__(self, text: str):
        points = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), "<u4")
        letter = ((points | 32) - points.dtype.type(97)) < 26  # unsigned: what is below wraps around
        heads = np.concatenate([np.zeros(min(1, len(points)), np.int64), np.flatnonzero(letter[1:] != letter[:-1]) + 1])
        self.starts = np.append(heads, len(points))
        self.units = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(letter[heads], 1, np.diff(self.starts)))])
        self.n = int(self.units[-1])

    def place(self, unit: int) -> int:
        """The code point at which a unit begins, or the text's end: a binary search for its run, then
        arithmetic; only runs of others hold more than one unit."""
        run = int(np.searchsorted(self.units, unit, side="right")) - 1
        return int(self.starts[run] + unit - self.units[run])


def _cut(text: str, h: tuple[int, int, int, int], s: MiddleSettings) -> tuple[int, str, int | None, int | None, str]:
    runs = ClassRuns(text)
    if not text or h[2] % 100 >= s.cut_percent or any(m in text for m in s.marks):
        return runs.n, PLAIN, None, None, text
    first, last = (runs.place(u) for u in sorted((h[0] % (runs.n + 1), h[1] % (runs.n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h[3] % 100 < s.spm_percent:
        return runs.n, SPM, first, last - first, s.suffix + suffix + s.prefix + prefix + s.middle + middle
    return runs.n, PSM, first, last - first, s.prefix + prefix + s.suffix + suffix + s.middle + middle


def fill_in_middle(docs: DataFrame, settings: MiddleSettings = MiddleSettings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row's whole text; no shuffle.

    Both cuts and the form come from the SHA-256 of the seed and the id, so repeated rows give equal
    results and a lost task's second run gives the first one's. A null text counts as empty; empty
    texts and texts that hold a mark stay plain, with null lengths. A null id is hashed as nothing.
    """
    common.small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), common.empty_text(text_column).alias("text"), F.array(*groups).alias("hashes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [_cut(t, tuple(map(int, h)), settings) for t, h in zip(batch["text"], batch["hashes"], strict=True)]
            out = pd.DataFrame(done, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return rows.mapInPandas(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, settings: MiddleSettings = MiddleSettings()) -> Column:
    """The exact text again, from output and form alone; null where either is.

    No part holds a mark, and none can arise where a part meets a mark, since no mark's end is another's
    beginning: the first place of a mark is its own.
    """

    def between(text: Column, left: str, right: str | None) -> Column:
        inner = F.substr(text, F.instr(text, left) + len(left))
        return inner if right is None else F.substring_index(inner, right, 1)

    s = settings
    psm = F.concat(between(output, s.prefix, s.suffix), between(output, s.middle, None), between(output, s.suffix, s.middle))
    spm = F.concat(between(output, s.prefix, s.middle), between(output, s.middle, None), between(output, s.suffix, s.prefix))
    return F.when(form == PSM, psm).when(form == SPM, spm).when(form == PLAIN, output)


def middle_report(docs: DataFrame, settings: MiddleSettings = MiddleSettings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The transformation with digests in place of texts: output_sha256, and restored_sha256 of the text
    that is rebuilt from output and form."""
    out = fill_in_middle(docs, settings, id_column, text_column)
    back = restored(F.col("output"), F.col("form"), settings)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


#: The same for DuckDB, by matching all units.
SQL = """WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
g AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM u),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM g),
p AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
