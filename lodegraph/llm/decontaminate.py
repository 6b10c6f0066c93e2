"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Items and documents are read as their words (runs of letters, digits and _, in
lower case) with single spaces. The CGK walk reads the characters from a start:
at every step it puts out the character it stands on, and a random bit that
hangs on step and character says whether it goes on; so two strings a few edits
apart soon walk together again, and their edit distance becomes a Hamming
distance of the outputs. A round is a walk with bits of its own and a sample of
its outputs as the key. Windows start at every word of a document and of an
item, so that any stretch of an item may bring the two together. The number of
sampled outputs grows with the logarithm of the number of keys. Rounds are added until ``TARGET``
of the items (a seeded ``TRIAL`` of them) are found when each is edited in as
many characters as may be, at places drawn evenly, ``ROUNDS`` at most. A meeting
places the item-sized window in the document; there the exact edit distance to the best stretch decides: an
item is found if it is at most ``1 - similar`` of the item's length.

Outputs are sampled from the first ``STEPS`` steps only: at one edit in five
characters, walks over the whole of an item are as far apart as those of
unrelated texts. Items under ``SHORT`` characters are looked for in every text
by their edit distance alone.

The benchmark is sent to the tasks in blocks of ``BLOCK`` items, one after the
other: each block's finds are written before the next is read. Defined results:
a null text counts as empty and is clean; items without words match nothing;
items that repeat are all named, and those without an id by null, last; rows
that repeat each keep a row; an empty benchmark finds nothing, and an empty
table has no rows. Columns of the documents other than the new one may have any
name.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

SIMILAR, TARGET, TRIAL = 0.8, 0.95, 200
STEPS, SAMPLED, ROUNDS, SHORT, BLOCK = 22, 14, 16, 24, 5_000
#: Sampled outputs after which a start goes on only if an item's window begins so.
EARLY = 7
_WORD = re.compile(r"\w+")
_SYMBOLS = 1024
_SHIFT, _FACTOR, _MIX = np.uint64(44), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _cell(keys: np.ndarray) -> np.ndarray:
    return ((keys * _MIX) >> _SHIFT).view(np.int64)


def _seen(keys: np.ndarray) -> np.ndarray:
    """Which of 2^20 cells hold a key: what is in no cell is no key."""
    out = np.zeros(1 << 20, bool)
    out[_cell(keys)] = True
    return out


def normal(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def symbols_of(line: str) -> np.ndarray:
    """A number for each character; the space is 0."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    return (((c - np.uint32(32)) * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int64)


def starts_of(symbols: np.ndarray) -> np.ndarray:
    """Where words start."""
    inner = symbols != 0
    inner[1:] &= symbols[:-1] == 0
    return np.flatnonzero(inner)


def edit_distance_within(pattern: str, text: str) -> int:
    """Least edit distance of pattern to any stretch of text (bit-parallel, one long integer a column)."""
    m = len(pattern)
    if not m or pattern in text:
        return 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    place: dict[str, int] = {}
    for k, c in enumerate(pattern):
        place[c] = place.get(c, 0) | (1 << k)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = place.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (~(xh | up) & full)
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a stretch may start anywhere: row 0 is all zero
        mh = (mh << 1) & full
        up = mh | (~(xv | ph) & full)
        down = ph & xv
        if score < best:
            best = score
    return best


def edited(line: str, edits: int, r: np.random.Generator) -> str:
    """The line with so many characters substituted, put in or left out, at places drawn evenly."""
    out = list(line)
    for at in sorted(r.choice(len(out), min(edits, len(out)), replace=False).tolist(), reverse=True):
        other = chr(97 + int(r.integers(26)))
        out[at : at + 1] = ([other], [out[at], other], [])[int(r.integers(3))]
    return "".join(out)


class Index:
    """Keys of the items' windows, in rounds."""

    def __init__(self, items: list[tuple[int | None, str]], similar: float = SIMILAR, target: float = TARGET, rounds: int = ROUNDS, seed: int = 5):
        self.similar = similar
        self.items = [(i, w) for i, t in items if (w := normal(t or ""))]
        self.allowed = [math.floor((1 - similar) * len(w) + 1e-9) for _, w in self.items]
        self.short = [k for k, (_, w) in enumerate(self.items) if len(w) < SHORT]
        self.rounds: list[tuple] = []
        self.proved: dict[tuple[int, str], bool] = {}
        far = [k for k, (_, w) in enumerate(self.items) if len(w) >= SHORT]
        if not far:
            return
        r = np.random.default_rng(seed)
        self.symbol = r.integers(1, 1 << 62, _SYMBOLS, dtype=np.uint64)
        flat, at, item, offset, begin = [], [], [], [], 0
        for k in far:
            own = symbols_of(self.items[k][1])
            first = starts_of(own)
            first = first[first <= len(own) - STEPS]
            flat.append(own)
            at.append(first + begin)
            item.append(np.full(len(first), k))
            offset.append(first)
            begin += len(own)
        place = [np.concatenate(x) for x in (flat, at, item, offset)]
        # A character in common tells about 2.5 bits.
        sampled = min(STEPS, max(SAMPLED, math.ceil(math.log2(max(2, len(place[1]))) / 2.5) + 8))
        trial = [(k, symbols_of(edited(self.items[k][1], self.allowed[k], r))) for k in r.permutation(far)[:TRIAL].tolist()]
        met: set[int] = set()
        for _ in range(rounds):
            bits = r.integers(0, 2, (STEPS, _SYMBOLS))
            for k in range(1, STEPS):  # a walk never stays twice running, else it could rest on one character
                bits[k] |= 1 - bits[k - 1]
            steps = sorted([*r.choice(STEPS - 1, sampled - 1, replace=False).tolist(), STEPS - 1])
            keys, early = self._keys(place[0], place[1], bits, steps)
            order = np.argsort(keys, kind="stable")
            self.rounds.append((bits, steps, keys[order], place[2][order], place[3][order], _seen(early), _seen(keys)))
            for k, line in trial:
                if k not in met:
                    line = np.r_[line, np.zeros(STEPS, np.int64)]
                    got = self._keys(line, starts_of(line), bits, steps)[0]
                    lo, hi = np.searchsorted(keys[order], got, "left"), np.searchsorted(keys[order], got, "right")
                    if any(k in place[2][order][x:y] for x, y in zip(lo[hi > lo], hi[hi > lo], strict=True)):
                        met.add(k)
            if len(met) >= target * len(trial):
                break
        self.recall = len(met) / len(trial)

    def _keys(self, line: np.ndarray, start: np.ndarray, bits: np.ndarray, steps: list[int], seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the walks from each start, and of their first outputs; with ``seen``, starts and keys of those whose first outputs are in it."""
        at, key, early = start.copy(), np.zeros(len(start), np.uint64), start
        told = 0
        for step in range(steps[-1] + 1):
            s = line[at]
            if step == steps[told]:
                key *= _FACTOR
                key += self.symbol[s]
                told += 1
                if told == EARLY:
                    early = key
                    if seen is not None:
                        go = np.flatnonzero(seen[_cell(early)])
                        at, key, start, s = at[go], key[go], start[go], s[go]
                    else:
                        key = key.copy()
            if step < steps[-1]:
                at += bits[step][s]
        return (key, early) if seen is None else (start, key)

    def found(self, texts: list[str]) -> list[list[int | None]]:
        """Ids of the items in each text, ascending, null last."""
        out: list[list[int]] = [[] for _ in texts]
        lines = [normal(t) for t in texts] if self.items else []
        for k in self.short:
            for doc, line in enumerate(lines):
                if line and edit_distance_within(self.items[k][1], line) <= self.allowed[k]:
                    out[doc].append(k)
        if self.rounds and any(lines):
            # The texts one after the other, with room for a walk's end between them.
            size = np.array([len(x) + STEPS for x in lines])
            begins = np.r_[0, np.cumsum(size)]
            flat = np.zeros(int(begins[-1]) + 1, np.int64)
            for x, b in zip(lines, begins, strict=False):
                flat[b : b + len(x)] = symbols_of(x)
            some = starts_of(flat)
            met: list[np.ndarray] = []
            for bits, steps, keys, item, offset, early, seen in self.rounds:
                at, got = self._keys(flat, some, bits, steps, early)
                hit = seen[_cell(got)]
                at, got = at[hit], got[hit]
                lo, hi = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
                n = hi - lo
                which = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                at = np.repeat(at, n)
                doc = np.searchsorted(begins, at, "right") - 1
                met.append(np.stack([doc, item[which], at - begins[doc] - offset[which]]))
            every = np.unique(np.concatenate(met, axis=1), axis=1)
            if every.shape[1]:
                cuts = np.flatnonzero((np.diff(every[:2], axis=1) != 0).any(axis=0)) + 1
                for part in np.split(every, cuts, axis=1):
                    doc, k = int(part[0, 0]), int(part[1, 0])
                    if self._stands(k, lines[doc], part[2].tolist()):
                        out[doc].append(k)
        return [sorted((self.items[k][0] for k in x), key=lambda i: (i is None, i)) for x in out]

    def _stands(self, k: int, line: str, begins: list[int]) -> bool:
        """Whether the item stands in the line at one of the places, by ascending place."""
        n, slack = len(self.items[k][1]), self.allowed[k] + 2
        stretches: list[list[int]] = []
        for b in begins:  # windows that overlap are read as one
            lo, hi = max(0, b - slack), b + n + slack
            if stretches and lo < stretches[-1][1]:
                stretches[-1][1] = hi
            else:
                stretches.append([lo, hi])
        for lo, hi in stretches:
            key = (k, line[lo:hi])
            if key not in self.proved:
                if len(self.proved) >= 5_000:
                    self.proved.clear()
                self.proved[key] = edit_distance_within(self.items[k][1], key[1]) <= self.allowed[k]
            if self.proved[key]:
                return True
        return False


def _finder(sent):  # noqa: ANN001, ANN202
    @F.arrow_udf("array<bigint>")
    def find(texts: pa.Array) -> pa.Array:
        index = sent.value
        out = []
        for part in slices([pa.RecordBatch.from_arrays([texts], ["t"])], 0, 1 << 18):
            out += index.found(part.column(0).to_pylist())
        return pa.array(out, pa.list_(pa.int64()))

    return find


def marked(docs: DataFrame, benchmark: DataFrame, out_col: str = "item_ids", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """The documents with a column of the ids of the benchmark items that stand in each text."""
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(item_text_col, F.lit("")).alias("t"))
    blocks = max(1, math.ceil(rows.count() / block))
    text = F.coalesce(F.col(text_col), F.lit(""))
    if blocks == 1:
        sent = spark.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in rows.collect()], similar))  # a block at most
        return docs.withColumn(out_col, _finder(sent)(text))
    kept = materialize(docs.select(F.struct("*").alias("d"), F.monotonically_increasing_id().alias("row")))
    rows = materialize(rows.withColumn("n", F.pmod(F.xxhash64("i", "t", F.monotonically_increasing_id()), F.lit(blocks))))
    finds = None
    for n in range(blocks):
        sent = spark.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in rows.where(F.col("n") == n).toLocalIterator()], similar))
        own = kept.select("row", _finder(sent)(F.coalesce(F.col("d").getField(text_col), F.lit(""))).alias("ids")).where(F.size("ids") > 0)
        own = materialize(own)
        sent.destroy()
        finds = own if finds is None else finds.unionByName(own)
    told = finds.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    return kept.join(told, "row", "left").select("d.*", F.coalesce("ids", F.array().cast("array<bigint>")).alias(out_col))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = marked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids")
