"""Document fingerprints by winnowing.

Every run of ``K`` code points has a rolling polynomial hash; each window of
``WINDOW`` neighbouring hashes gives its smallest one, the rightmost of equal
ones, and the chosen hashes are kept with their positions. Two texts that share
a passage of at least ``WINDOW + K - 1`` code points share a fingerprint entry.

Defined results: a null text counts as empty; the empty text has an empty
fingerprint; a text shorter than ``K`` is one run, one shorter than a full
window is one window. Equal texts have equal fingerprints. Rows that repeat, or
share an id, each keep a row; null ids come last. Only the columns asked for
are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

K, WINDOW = 16, 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_LOW = np.uint64(0xFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """The hash of every run of k code points, by doubling: a run of 2a is one of a, times base^a, plus the next."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    k = min(k, len(c))
    if not k:
        return c
    done, out, width, part = 0, None, 1, c
    while True:
        if k & width:  # runs of `done` code points so far; put those of `width` behind them
            out = part if out is None else out[: len(c) - done - width + 1] * np.uint64(pow(_BASE, width, _MASK + 1)) + part[done : len(c) - width + 1]
            done += width
        if done == k:
            return _mixed(out)
        part = part[: len(part) - width] * np.uint64(pow(_BASE, width, _MASK + 1)) + part[width:]
        width *= 2


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that the windows choose, by position. Windows compare the hashes' upper 32 bits."""
    h = gram_hashes(text, k)
    n = len(h)
    if not n:
        return h, np.zeros(0, np.uint32)
    w = min(window, n)
    # Upper half: the hash; lower half: falls with the position, so that of equal hashes the rightmost is smallest.
    key = (h & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
    width, least = 1, key
    while width * 2 <= w:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < w:
        least = np.minimum(least[: n - w + 1], least[w - width : w - width + n - w + 1])
    keep = np.ones(len(least), bool)
    keep[1:] = least[1:] != least[:-1]
    at = (_LOW - (least[keep] & _LOW)).astype(np.uint32)
    return h[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two fingerprints' hashes; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(hashes: np.ndarray, at: np.ndarray) -> str:
    """Hex of each entry's upper hash half and position, by position."""
    out = np.empty((len(at), 2), ">u4")
    out[:, 0], out[:, 1] = hashes >> np.uint64(32), at
    return out.tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """The fingerprint of every text: id, ``hashes`` (array<bigint>, as signed) and ``positions`` (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [winnow(t, k, window) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.view(np.int64) for h, _ in got], pa.list_(pa.int64())), pa.array([p.astype(np.int32) for _, p in got], pa.list_(pa.int32()))], ["id", "hashes", "positions"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit(""))).mapInArrow(run, f"id {kind}, hashes array<bigint>, positions array<int>").withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int | None = None) -> DataFrame:
    """Rows (part, id, text, own) so that, in a part, by descending id, each row's next row is its next document.

    Texts are dealt once, by ranges of the id, and those without an id by ranges
    of the text's hash, which orders rows of one id. The first row of each part
    is also given to the part before it (own = false), the first of all to the
    last; there are as many of these as parts (and rows that repeat them).
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("t")  # equal ids stand in the order of their texts' hashes
    d = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))
    at = F.array(*[F.lit(x / parts) for x in range(1, max(parts, 2))])
    ranges, named, total = d.select(F.percentile_approx("i", at, 10000), F.count("i"), F.count(F.lit(1))).first()
    bounds = sorted(set(ranges or []), reverse=True) if parts > 1 else []
    unnamed = max(1, math.ceil(parts * (total - named) / max(1, total)))
    # Part p holds ids in (bounds[p], bounds[p - 1]]; the parts behind them rows without an id.
    part = F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b >= F.col("i"))), F.lit(len(bounds))) if bounds else F.lit(0)
    behind = len(bounds) + 1 + F.floor((F.shiftright(tie, 33) + (1 << 30)) * unnamed / float(1 << 31))
    part = F.when(F.col("i").isNull(), behind).otherwise(part).cast("int")
    keyed = d.withColumn("p", part)
    # The first row of each part that has rows; ids and hashes only, a row for each part.
    place = F.struct(F.col("i").isNotNull().alias("named"), "i", F.bitwise_not(tie).alias("tie"))
    heads = sorted(((r["p"], r["h"]["i"], r["h"]["tie"]) for r in keyed.groupBy("p").agg(F.max(place).alias("h")).collect()), key=lambda r: r[0])
    if not heads:
        return d.select(F.lit(0).alias("p"), "i", tie.alias("tie"), "t", F.lit(True).alias("own"))
    to = spark.createDataFrame([(p, i, ~h, heads[n - 1][0] if n else heads[-1][0]) for n, (p, i, h) in enumerate(heads)], "op int, hi long, ht long, hp int")
    far = keyed.withColumn("tie", tie).join(F.broadcast(to), (F.col("p") == F.col("op")) & F.col("i").eqNullSafe(F.col("hi")) & (F.col("tie") == F.col("ht")), "left")
    both = F.when(F.col("hp").isNotNull(), F.array(F.struct(F.col("p").alias("p"), F.lit(True).alias("own")), F.struct(F.col("hp").alias("p"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col("p").alias("p"), F.lit(True).alias("own"))))
    return far.select("i", "tie", "t", F.explode(both).alias("x")).select("x.p", "i", "tie", "t", "x.own")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """The digest columns of each text, its edited text (its last half replaced by the start of the next document) and the next."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # the last row of each part in this task, not yet told
        rows: list[tuple] = []
        schema = pa.schema([("i", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edited_n_chars", pa.int64()), ("next_id", pa.int64())])

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        def told(row: list, nxt: list) -> None:
            text, half = row[1], len(row[1]) // 2
            edited = (text[: len(text) - half] + nxt[1][:half]) if half else text
            for r in (row, nxt):
                if r[2] is None:
                    r[2] = winnow(r[1], k, window)
            e = row[2] if edited == text else winnow(edited, k, window)
            rows.append((row[0], len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(*row[2]), digest(*e), likeness(row[2][0], e[0]), likeness(row[2][0], nxt[2][0]), len(edited), nxt[0]))

        for batch in batches:
            part, ids, own, texts = (batch.column(n).to_pylist() for n in range(4))
            for p, i, mine, t in zip(part, ids, own, texts, strict=True):
                now = [i, t, None]
                if p in held:
                    told(held.pop(p), now)
                if mine:
                    held[p] = now
                if len(rows) >= 256:
                    yield flush()
        if held:
            raise RuntimeError("a part has no row to follow its last one")
        if rows:
            yield flush()

    dealt = with_next(docs, id_col, text_col, parts).repartitionById(parts, F.col("p"))
    ordered = dealt.sortWithinPartitions("p", F.col("own").desc(), F.col("i").desc_nulls_last(), "tie").select("p", "i", "own", "t")
    out = ordered.mapInArrow(run, "i long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_n_chars long, next_id long")
    return out.withColumnRenamed("i", id_col)


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
