"""Where a quote stands in a text (SC27)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"'})


def span_of(text: str | None, quote: str | None, start: int = 0, end: int = 0) -> tuple[int, int] | None:
    """The stated place if the quote is there, else its first one, else one that differs in white space and quotation marks only."""
    text, quote = text or "", quote or ""
    if 0 <= start < end <= len(text) and text[start:end] == quote:
        return start, end
    if quote and (at := text.find(quote)) >= 0:
        return at, at + len(quote)
    words = quote.translate(_PLAIN).split()
    if not words:
        return None
    # One mark becomes one mark, so places in the plain text are places in the text.
    found = re.search(r"\s+".join(map(re.escape, words)), text.translate(_PLAIN))
    return found.span() if found else None


def quote_span(text: Column | str, quote: Column | str) -> Column:
    """SC27: struct<quote_start, quote_end>, nulls where the quote is not in the text."""

    def run(texts: pd.Series, quotes: pd.Series) -> pd.DataFrame:
        found = [span_of(t, q) or (None, None) for t, q in zip(texts, quotes)]
        return pd.DataFrame(found, columns=["quote_start", "quote_end"], dtype="Int32")

    return F.pandas_udf(run, "quote_start int, quote_end int")(text, quote)
