"""Toxicity by nearest labelled examples.

Terms are words (runs of letters, digits and _) in lower case, all that the
labelled examples hold; a text is the vector of (1 + ln tf) * idf over them, with
document frequencies over all documents. Words that go with the labels should
weigh more than words of the subject, so each coordinate is stretched by the
share of the label's variance that its word explains (squared correlation over
the examples, less what chance may bring, plus ``FLOOR``, so that no word is
without weight). Nearness is the exact cosine
of the stretched TF-IDF vectors.

The examples stand in an inverted index: for each word a list of (example,
weight), and for each block of ``BLOCK`` examples the largest weight of each
common word in it. A query sums the short lists first; the sums of the
``NEAREST`` best so far are a floor, and the block maxima of the common words
bound what any example of a block can still gain, so only examples that can
reach the floor are summed over the long lists: the neighbours are exact.
Votes weigh by distance, a base rate votes from distance 1, and a logistic curve
fitted by leaving each example out makes the vote a probability. The neighbours
are the evidence.

Labels are learned from at most ``SAMPLE`` labelled rows, those of smallest id
hash; the index grows with these rows only. Defined results: a null text counts
as empty; a text without any known word has the base rate's score and no
evidence; without labelled rows, every score is 0.5. Labels that contradict each
other for one id, or for equal texts, count as toxic; null labels and ids are
left out of training. Neighbours of equal cosine go by their place in the index,
which hangs on contents before ids. Equal texts have equal scores; rows that
repeat each keep a row. Only the columns asked for are read; an empty table has no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialize, slices, table

SAMPLE, FLOOR = 4_000, 1e-4
#: The 99 % point of chi-square: so much association is put down to chance.
CHANCE = 6.63
BLOCK, NEAREST = 64, 16
#: A word in over one of so many examples is common.
COMMON = 16
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Terms:
    """The known words by number."""

    def __init__(self, words: list[str]):
        self.place = {w: n for n, w in enumerate(words)}

    def __len__(self) -> int:
        return len(self.place)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(terms ascending, how often each)."""
        found = Counter(words_of(text))
        known = self.place.keys() & found.keys()
        t = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))
        c = np.fromiter(map(found.__getitem__, known), np.int64, len(known))
        order = np.argsort(t)
        return t[order], c[order]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each stretch, one stretch after the other."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))


class Index:
    """Block-max inverted index of the labelled examples, and the calibration."""

    def __init__(self, terms: Terms, idf: np.ndarray, examples: list[tuple]):
        """examples: (id, label, terms, counts)."""
        self.terms, self.n_terms, self.n_examples = terms, len(terms), len(examples)
        n1 = sum(e[1] for e in examples)
        self.base = (n1 + 0.5) / (len(examples) + 1)
        self.stretch = idf * (self.explained(examples) + FLOOR)
        rows = [(y, np.asarray(t, np.int64), np.asarray(c, np.int64), i) for i, y, t, c in examples]
        empty = [y for y, t, _, _ in rows if not len(t)]
        rows = [(y, t, self.weights(t, c), i) for y, t, c, i in rows if len(t)]
        # Like examples side by side give tight blocks; the order is one of contents, with ids last.
        rows.sort(key=lambda r: (int(r[1][np.argmax(r[2])]), r[0], r[1].tobytes(), r[2].tobytes(), r[3]))
        self.labels = np.array([r[0] for r in rows], np.float64)
        self.ids = np.array([r[3] for r in rows], np.int64)
        self.rows = [(r[1], r[2]) for r in rows]
        sizes = np.array([len(t) for t, _ in self.rows], np.int64)
        term = np.concatenate([t for t, _ in self.rows]) if rows else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in self.rows]) if rows else np.zeros(0)
        example = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(term, kind="stable")
        self.example, self.weight = example[order].astype(np.int32), weight[order]
        self.starts = np.searchsorted(term[order], np.arange(self.n_terms + 1))
        # Common words: no more than COMMON times the mean number of an example's words.
        common = np.flatnonzero(np.diff(self.starts) * COMMON > len(rows))
        self.common = np.full(self.n_terms, -1, np.int32)
        self.common[common] = np.arange(len(common))
        blocks = -(-len(rows) // BLOCK)
        self.long = np.zeros((len(common), blocks * BLOCK))
        for k, t in enumerate(common):
            part = slice(self.starts[t], self.starts[t + 1])
            self.long[k, self.example[part]] = self.weight[part]
        self.rough = self.long.astype(np.float32)
        self.most = self.long.reshape(len(common), blocks, BLOCK).max(axis=2) if len(common) else np.zeros((0, blocks))
        self.curve = (0.0, 1.0)
        self.calibrate(empty)

    def explained(self, examples: list[tuple]) -> np.ndarray:
        """Squared correlation of each term's presence and the label, less ``CHANCE``."""
        held = np.zeros((2, self.n_terms))
        sizes = np.zeros(2)
        for _, y, t, _ in examples:
            held[y, np.asarray(t, np.int64)] += 1
            sizes[y] += 1
        n, df = sizes.sum(), held.sum(axis=0)
        apart = held[1] * sizes[0] - held[0] * sizes[1]
        share = apart**2 / np.maximum(df * (n - df) * sizes[0] * sizes[1], 1)
        return np.maximum(share - CHANCE / max(n, 1), 0)

    def weights(self, t: np.ndarray, c: np.ndarray) -> np.ndarray:
        w = (1 + np.log(c)) * self.stretch[t]
        return w / np.sqrt(np.dot(w, w))

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEAREST, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest, by falling cosine and then place."""
        n = len(self.labels)
        if not n or not len(t):
            return np.zeros(0, np.int64), np.zeros(0)
        row = self.common[t]
        rare, shared = row < 0, row >= 0
        starts = self.starts[t[rare]]
        sizes = self.starts[t[rare] + 1] - starts
        place = _spread(starts, sizes)
        sums = np.bincount(self.example[place], self.weight[place] * np.repeat(w[rare], sizes), n).astype(np.float64, copy=False)
        if without >= 0:
            sums[without] = -np.inf
        if shared.any():
            row, v = row[shared], w[shared]
            least = np.partition(sums, n - k)[n - k] if n > k else 0.0
            bound = np.repeat(v @ self.most[row], BLOCK)[:n]
            at = np.flatnonzero(sums + bound >= max(least, 0.0) - 1e-9)
            if len(at) > 8 * k:  # in single precision first, then those that may be among the best
                rough = sums + (v.astype(np.float32) @ self.rough[row])[:n]
                at = np.flatnonzero(rough >= np.partition(rough, n - k)[n - k] - 1e-4)
            best = sums[at] + v @ self.long[np.ix_(row, at)]
        else:
            at, best = np.arange(n), sums
        keep = best > 0
        at, best = at[keep], best[keep]
        if len(best) > k:
            near = best >= np.partition(best, len(best) - k)[len(best) - k] - 1e-9
            at, best = at[near], best[near]
        order = np.lexsort((at, -np.round(best, 12)))[:k]
        return at[order], best[order]

    def vote(self, at: np.ndarray, cosines: np.ndarray) -> float:
        weight = 1 / (1.05 - np.minimum(cosines, 1))
        return (weight @ self.labels[at] + self.base) / (weight.sum() + 1)

    def calibrate(self, empty: list[int]) -> None:
        """Fit the curve on each example's vote without itself; those without terms vote the base rate."""
        x = np.array([self.vote(*self.nearest(t, w, without=k)) for k, (t, w) in enumerate(self.rows)] + [self.base] * (len(empty) + 2))
        y = np.r_[self.labels, np.array(empty, float), 1.0, 0.0]
        weight = np.r_[np.ones(len(x) - 2), 0.5, 0.5]
        z = np.c_[np.ones(len(x)), np.log(x) - np.log1p(-x)]
        a = np.array([0.0, 1.0])
        for _ in range(50):  # Newton's method, with a slight pull to the plain vote
            p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
            gradient = z.T @ (weight * (y - p)) - 0.1 * (a - [0.0, 1.0])
            step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + 0.1 * np.eye(2), gradient)
            a = a + np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-10:
                break
        self.curve = (float(a[0]), max(0.05, float(a[1])))
        del self.rows  # the lists hold all that queries need

    def score(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        """(probability, neighbours, their cosines)."""
        t, c = self.terms.counts(text)
        at, cosines = self.nearest(t, self.weights(t, c)) if len(t) else (np.zeros(0, np.int64), np.zeros(0))
        v = self.vote(at, cosines)
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * np.log(v / (1 - v)), -30, 30)))), at, cosines


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Index:
    """Learn from at most ``sample`` labelled rows of ``labels``; document frequencies are over all of ``docs``.

    What comes to the driver is the examples' words, and a count for each of them.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # Copies of a text count once, as toxic if one of them is.
    some = materialize(d.join(F.broadcast(known), "id").groupBy("text").agg(F.min("id").alias("id"), F.max("y").alias("y")))
    words: dict[str, None] = {}
    for r in some.select("text").toLocalIterator():
        words.update(dict.fromkeys(words_of(r["text"])))
    terms = Terms(sorted(words))
    size = len(terms)
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value.place
        df, n = np.zeros(size, np.int64), 0
        for batch in slices(batches, 0):
            for t in batch.column(0).to_pylist():
                own = place.keys() & set(words_of(t))
                df[np.fromiter(map(place.__getitem__, own), np.int64, len(own))] += 1
                n += 1
        held = np.flatnonzero(df)
        for at in range(0, len(held) + 1, 50_000):
            part = held[at : at + 50_000]
            ids, counts = (np.r_[-1, part], np.r_[n, df[part]]) if not at else (part, df[part])
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(counts)], ["t", "n"])

    df, total = np.zeros(size, np.int64), 0
    if size:
        for r in d.select("text").mapInArrow(frequencies, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow().to_batches():
            t, n = r.column(0).to_numpy(), r.column(1).to_numpy()
            total += int(n[t < 0].sum())
            df[t[t >= 0]] = n[t >= 0]
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = [(r["id"], r["y"], *terms.counts(r["text"])) for r in some.orderBy("id").toLocalIterator()]
    return Index(terms, idf, rows)


def scores(index: Index, spark: SparkSession, text: Column, evidence: bool = False) -> Column:
    """A column of probabilities; with evidence, of (score, evidence: id, label, cosine of each neighbour)."""
    sent = spark.sparkContext.broadcast(index)
    kind = "struct<score double, evidence array<struct<id bigint, label int, cosine double>>>"

    @F.arrow_udf("double")
    def plain(texts: pa.Array) -> pa.Array:
        index = sent.value
        return pa.array([index.score(t)[0] for t in texts.to_pylist()], pa.float64())

    @F.arrow_udf(kind)
    def told(texts: pa.Array) -> pa.Array:
        index = sent.value
        got = [index.score(t) for t in texts.to_pylist()]
        ends = np.cumsum([0, *(len(at) for _, at, _ in got)], dtype=np.int32)
        at = np.concatenate([at for _, at, _ in got]) if got else np.zeros(0, np.int64)
        cosines = np.concatenate([c for _, _, c in got]) if got else np.zeros(0)
        each = pa.StructArray.from_arrays([pa.array(index.ids[at]), pa.array(index.labels[at].astype(np.int32)), pa.array(cosines)], ["id", "label", "cosine"])
        return pa.StructArray.from_arrays([pa.array([s for s, _, _ in got], pa.float64()), pa.ListArray.from_arrays(pa.array(ends), each)], ["score", "evidence"])

    return (told if evidence else plain)(F.coalesce(text, F.lit("")))


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where(crc_mod(id_col, 5) != 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    got = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), scores(index, spark, F.col("text"), True).alias("x"))
    return got.select("doc_id", "held_out", "x.score", (F.col("x.score") >= 0.5).cast("int").alias("predicted"), "x.evidence")
