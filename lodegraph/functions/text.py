"""Text functions, as column expressions."""

from __future__ import annotations

import heapq
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords.
STOP_WORDS = """the and for with that this from are was were have has had
into their there which using used paper study results show based
method methods model models approach problem data new present propose""".split()


def clean(s: Column | str) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", " "))


def truncated(s: Column | str, n: int = 260) -> Column:
    s = clean(s)
    return F.when(F.length(s) > n, F.concat(F.rtrim(F.substring(s, 1, n - 3)), F.lit("..."))).otherwise(s)


def keyword_list(s: Column | str, least: int = 4, stop_words: list[str] = STOP_WORDS) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    found = F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(r"[a-z][a-z0-9\-]{2,}"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*stop_words))


def first_sentence(s: Column | str, n: int = 400) -> Column:
    return F.substring(F.element_at(F.split(clean(s), r"(?<=[.!?])\s+"), 1), 1, n)


def parsed_bool(s: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(s) if isinstance(s, str) else s, F.lit("")))).isin("true", "1", "yes")


def edge_key(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def top_keywords(words: Column, k: int = 10) -> Column:
    """The k most frequent of an array of words, ties by word, as 'a, b, c'; words are counted once, however many differ."""

    def told(lists):  # noqa: ANN001, ANN202
        best = lambda w: heapq.nsmallest(k, Counter(w).items(), key=lambda c: (-c[1], c[0]))
        return pd.Series([None if w is None else ", ".join(c[0] for c in best(w)) for w in lists], dtype=object)

    told.__annotations__ = {"lists": pd.Series, "return": pd.Series}
    return F.pandas_udf(told, "string")(words)


def query_text(s: Column | str, mode: str = "original", k: int = 10) -> Column:
    """A query's text: the text, its first sentence, or its keywords."""
    if mode == "original":
        return clean(s)
    if mode == "sentence":
        return first_sentence(s)
    words = top_keywords(keyword_list(clean(s)), k)
    return F.when(words != "", F.concat(F.lit("paper about "), words)).otherwise(truncated(s, 200))
