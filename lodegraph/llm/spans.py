"""Repeated passages by sliding spans of sentences.

A text is cut into sentences; a span is a run of ``LEAST`` consecutive sentences,
from every sentence on, of however few words, or a single sentence of
``MANY_WORDS`` words or more. Spans are hashed (96 bits) in lower case with
single spaces, and joined over all documents. All occurrences of a span but the
first, by ascending id and place, are repeats, and each sentence that a repeat
covers is removed.

A passage may begin and end in mid-sentence, or hold fewer sentences. So windows
of ``MANY_WORDS`` words are hashed as well, cut sentences at their ends included:
one at every sentence start, one every ``STEP`` words back from it, and one up to
every sentence end. Any ``STEP`` neighbouring windows of a passage hold one of
these, so in a repeated passage of over 50 words each whole sentence is covered
that is whole in both places. (A run of over 50 words needs no hash of its own
for that reason.)

Occurrences of a span within a task are settled there, so that a passage in a
third of all rows is dealt as a row of each task. Defined results: a null text
counts as empty; null ids come last; rows that share id and text are one
document and change alike; rows that share an id but not the text are told apart
by the text's checksum. Only the columns asked for are read; an empty table has
no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST, MANY_WORDS = 5, 40
#: A passage of 51 words holds 12 windows of 40.
STEP = 51 - MANY_WORDS + 1
_END = re.compile(r"[.!?]+(?=\s)\s*|\n\s*")
#: Spans that a task holds before it settles them.
_HELD = 1_000_000


def sentences(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end, normal form, words) of each sentence; white space behind one belongs to it."""
    out, at = [], 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if end > at:
            words = text[at:end].lower().split()
            if words or not out:
                out.append((at, end, " ".join(words).encode("utf-8", "surrogatepass"), len(words)))
            else:
                out[-1] = (out[-1][0], end, *out[-1][2:])
            at = end
    return out


def runs(words: list[int], least: int = LEAST, many: int = MANY_WORDS) -> set[tuple[int, int]]:
    """(first, last) sentences of the spans: every run of ``least`` sentences, and every sentence of ``many`` words."""
    return {(i, i + least - 1) for i in range(len(words) - least + 1)} | {(i, i) for i, n in enumerate(words) if n >= many}


def windows(words: list[int], many: int = MANY_WORDS, step: int = STEP) -> list[tuple[int, int, int]]:
    """(first word, first sentence, last sentence) of the windows of ``many`` words that hold a whole sentence, or several."""
    starts = [0, *accumulate(words)]
    total, at = starts[-1], set()
    for i, n in enumerate(words):
        if n < many:
            # Further back, the sentence before has windows of its own.
            at.update(range(starts[i], starts[max(i - 1, 0)], -step), (starts[i], starts[i + 1] - many))
    out = []
    for x in at:
        if 0 <= x <= total - many:
            i, j = bisect_left(starts, x), bisect_right(starts, x + many) - 2
            if i <= j and starts[j + 1] > starts[i]:
                out.append((x, i, j))
    return out


def _occurrences(texts: list[str], least: int = LEAST) -> Iterator[tuple[int, bytes, int, int]]:
    for k, t in enumerate(texts):
        own = sentences(t)
        sizes = [s[3] for s in own]
        for i, j in runs(sizes, least):
            if i < j and sum(sizes[i : j + 1]) > MANY_WORDS + STEP - 2:
                continue  # its sentences have windows or are spans alone
            yield k, xxhash.xxh3_128_digest(b"\0".join([s[2] for s in own[i : j + 1]])), i, j
        if sum(sizes) >= MANY_WORDS:
            line = b" ".join([s[2] for s in own if s[3]])
            at = [0, *(np.flatnonzero(np.frombuffer(line, np.uint8) == 32) + 1).tolist(), len(line) + 1]
            for x, i, j in windows(sizes):
                yield k, xxhash.xxh3_128_digest(line[at[x] : at[x + MANY_WORDS] - 1], 1), i, j


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, text, n_sentences, n_removed): every document without the sentences that repeats cover; ``least``: sentences of a run, 2 to 40."""
    if not 2 <= least <= 40:
        raise ValueError("least must be from 2 to 40")
    names = ["hi", "lo", "id", "u", "place", "repeat"]
    schema = "hi long, lo int, id long, u long, place long, repeat boolean"

    def settle(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Sorted by span and place, each place once; whether each repeats the one before it."""
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        own = np.ones(len(order), bool)
        own[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in (*columns[:4], columns[4] >> 6)])
        columns = [c[own] for c in columns]
        again = np.zeros(len(columns[0]), bool)
        again[1:] = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])
        return columns, again

    def batches_of(columns: list[np.ndarray], again: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(again), 50_000):
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at : at + 50_000]) for c in columns), pa.array(again[at : at + 50_000])], names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids, sums = some.column(0).to_numpy(zero_copy_only=False), some.column(1).to_numpy()
                got = list(_occurrences(some.column(2).to_pylist(), least))
                if got:
                    key = np.frombuffer(b"".join([g[1] for g in got]), np.dtype([("hi", "<i8"), ("lo", "<i4"), ("rest", "<i4")]))
                    k = np.array([g[0] for g in got])
                    # A span has 41 sentences at most.
                    held.append([key["hi"], key["lo"], ids[k], sums[k], np.array([g[2] << 6 | g[3] - g[2] for g in got], np.int64)])
                    size += len(got)
                if size >= _HELD:
                    yield from batches_of(*settle([np.concatenate(c) for c in zip(*held, strict=True)]))
                    held, size = [], 0
        if held:
            yield from batches_of(*settle([np.concatenate(c) for c in zip(*held, strict=True)]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            hi, lo, i_d, u, at_i = (batch.column(n).to_numpy() for n in range(5))
            again = batch.column(5).to_numpy(zero_copy_only=False).copy()
            first = np.flatnonzero(~again)
            if len(first):
                h, x = hi[first], lo[first]
                new = np.r_[last is None or last[:2] != (h[0], x[0]), (h[1:] != h[:-1]) | (x[1:] != x[:-1])]
                at = np.maximum.accumulate(np.where(new, np.arange(len(first)), -1))
                # Rows of one document that are the first place itself, from repeated rows, are no repeats.
                place = [np.where(at < 0, c[first][0] if last is None else last[k], c[first][at]) for k, c in enumerate((i_d, u, at_i >> 6), 2)]
                again[first] = np.logical_or.reduce([p != c[first] for p, c in zip(place, (i_d, u, at_i >> 6), strict=True)])
                last = (h[-1], x[-1], *(p[-1] for p in place))
            if again.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[again]) for c in (i_d, u, at_i)], ["id", "u", "place"])

    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.crc32(F.coalesce(text_col, F.lit("")).cast("binary")).alias("u"), F.coalesce(text_col, F.lit("")).alias("t"))
    spans = d.mapInArrow(find, schema)
    # Firsts meet by span, in order; what is settled already goes along anywhere.
    spans = spans.repartition(F.when(F.col("repeat"), F.xxhash64("id", "u", "place")).otherwise(F.col("hi"))).sortWithinPartitions("repeat", "hi", "lo", "id", "u", "place")
    cover = spans.mapInArrow(join, "id long, u long, place long").groupBy("id", "u").agg(F.collect_list("place").alias("cover"))

    @F.arrow_udf("struct<text string, n_sentences long, n_removed long>")
    def cut(texts: pa.Array, cover: pa.Array) -> pa.Array:
        out = []
        for t, c in zip(texts.to_pylist(), cover.to_pylist(), strict=True):
            own = sentences(t)
            gone = {k for x in c or () for k in range(x >> 6, (x >> 6) + (x & 63) + 1)}
            out.append({"text": "".join(t[s[0] : s[1]] for k, s in enumerate(own) if k not in gone) if gone else t, "n_sentences": len(own), "n_removed": len(gone)})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64())]))

    keyed = docs.select(F.col(id_col).alias("o"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.crc32(F.coalesce(text_col, F.lit("")).cast("binary")).alias("u"), F.coalesce(text_col, F.lit("")).alias("t"))
    got = keyed.join(cover, ["id", "u"], "left").select("o", cut("t", "cover").alias("x"))
    return got.select(F.col("o").alias(id_col), "x.text", "x.n_sentences", "x.n_removed")


def op8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
