"""Operator 11, the fill-in-middle transformation, an Arrow-batched pandas UDF.

The ends of a text's units (lines, unless another pattern is given) are gathered in a compact array of offsets. A hash of the seed
and the document's id draws two cuts between units and the order of the parts; two look-ups in the array give the offsets where the
text is sliced. The text is put together again from what was made of it, and digests of both are given.

A row depends on its own id and text alone, so nothing is shuffled and a lost task is done again with the same result. Batches are
worked off in slices of some megabytes, so that few texts are held more than once.

Defined results: a null text is empty, and an empty text is plain; a text that holds a sentinel is plain, whatever was drawn; a null
id draws as the word ``null``; repeated rows, and rows with one id and one text, have the same result; an empty table gives an empty
result; where the pattern leaves characters between units, they go with the unit after them, the last ones with the suffix; further
columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

UNIT = r"[^\n]*\n|[^\n]+"
#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
#: Of a hundred documents so many are transformed, and of those so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 100, 50
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"
#: A slice of a batch ends after so many characters.
SLICE = 4_000_000


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """The offset after each unit, from left to right."""
    return array("Q", (match.end() for match in unit.finditer(text)))


def draws(seed: int, doc_id: str) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that the seed and the id decide."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def restore(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that was transformed, from what became of it and its form alone."""
    before_prefix, before_suffix, before_middle = sentinels
    if form == "plain":
        return output
    head, middle = output.split(before_middle)
    if form == "psm":
        prefix, suffix = head.removeprefix(before_prefix).split(before_suffix)
    else:
        suffix, prefix = head.removeprefix(before_suffix).split(before_prefix)
    return prefix + middle + suffix


def transformed(
    docs: DataFrame, seed: int = SEED, unit: str = UNIT, sentinels: tuple[str, str, str] = SENTINELS, percent: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """(doc_id, text) to doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    A sentinel's first character occurs nowhere else in the sentinels, so that no part of the text can make up one together with them.
    """
    before_prefix, before_suffix, before_middle = sentinels
    if len(set(sentinels)) < 3 or any(not s or any(s[0] in other[1:] for other in sentinels) for s in sentinels):
        raise ValueError(f"these sentinels can be mistaken for one another: {sentinels}")

    def one(doc_id: str, text: str, units: regex.Pattern) -> tuple:
        ends = unit_ends(text, units)
        n = len(ends)
        h1, h2, h3, h4 = draws(seed, doc_id)
        if not text or h3 % 100 >= percent or any(s in text for s in sentinels):
            form, a, b, output = "plain", None, None, text
        else:
            first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = (ends[k - 1] if k else 0 for k in (first, second))
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            if h4 % 100 < suffix_first:
                form, output = "spm", f"{before_suffix}{suffix}{before_prefix}{prefix}{before_middle}{middle}"
            else:
                form, output = "psm", f"{before_prefix}{prefix}{before_suffix}{suffix}{before_middle}{middle}"
        return n, form, a, None if b is None else b - a, output, digest(output), digest(restore(output, form, sentinels))

    def frame(rows: list[tuple]) -> pd.DataFrame:
        n, form, prefix, middle, output, of_output, of_restored = zip(*rows)
        return pd.DataFrame({
            "n": n, "form": form, "prefix_chars": pd.array(prefix, "Int64"), "middle_chars": pd.array(middle, "Int64"),
            "output": output, "output_sha256": of_output, "restored_sha256": of_restored,
        })

    @F.pandas_udf(RESULT)
    def fim(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        units = regex.compile(unit)
        for ids, texts in batches:
            rows, size = [], 0
            for doc_id, text in zip(ids, texts):
                rows.append(one(doc_id, text, units))
                size += len(text)
                if size >= SLICE:
                    yield frame(rows)
                    rows, size = [], 0
            if rows:
                yield frame(rows)

    doc_id = F.col("doc_id").cast("long")
    made = fim(F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("")))
    return docs.select(doc_id.alias("doc_id"), made.alias("made")).select("doc_id", "made.*")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transformed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("output")


#: Lines are counted by their ends; the first k of them are joined again.
ORACLE = {
    "op11_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
u AS (SELECT *, length(t) - length(replace(t, chr(10), '')) + CASE WHEN t = '' OR t[-1] = chr(10) THEN 0 ELSE 1 END AS n, string_split(t, chr(10)) AS parts,
  ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS k1, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS k2,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
e AS (SELECT *, CASE WHEN k1 = 0 THEN '' WHEN k1 = n THEN t ELSE array_to_string(parts[1:k1], chr(10)) || chr(10) END AS upto1,
  CASE WHEN k2 = 0 THEN '' WHEN k2 = n THEN t ELSE array_to_string(parts[1:k2], chr(10)) || chr(10) END AS upto2 FROM c),
p AS (SELECT *, upto1 AS prefix, substr(upto2, length(upto1) + 1) AS middle, substr(t, length(upto2) + 1) AS suffix FROM e)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
}
QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
