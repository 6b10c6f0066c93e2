"""Work that reads the whole graph for each start, over packed neighbour lists.

The edges are packed as int32 places and dealt once to every group of starts; a
task holds one copy of them and a few starts' rows at a time, and its results
leave it as they are made. So nothing that grows as starts times vertices is
shuffled, sorted or held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written

_CHUNK = "kind int, part int, seq long, ids binary, sizes binary, near binary"
_VERTICES, _NEAR, _STARTS = 0, 1, 2
WIDE = 64  # starts that walk together


def _ids_of(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for seq, batch in enumerate(b for b in batches if b.num_rows):
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        yield _chunk(kind, part, seq, ids.tobytes(), b"", b"")


def _near_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for seq, batch in enumerate(b for b in batches if b.num_rows):
        src, dst = (batch.column(k).to_numpy(zero_copy_only=False).astype("<i4") for k in (0, 1))
        at, sizes = np.unique(src, return_counts=True)
        yield _chunk(_NEAR, part, seq, at.tobytes(), sizes.astype("<i4").tobytes(), dst.tobytes())


def _chunk(kind: int, part: int, seq: int, *columns: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([seq], pa.int64()), *[pa.array([c], pa.binary()) for c in columns]], ["kind", "part", "seq", "ids", "sizes", "near"])


def packed(edges: DataFrame) -> DataFrame:
    """Chunks of the vertices that have edges, by id, and of their neighbours' places among these, both in order."""
    from .match import numbered

    ship(edges.sparkSession)
    ids = written(numbered(edges.select(F.col("src").cast("long").alias("id")).distinct(), ["id"], "n").select("id", (F.col("n") - 1).cast("int").alias("n")))
    e = edges.join(ids.select(F.col("id").alias("src"), F.col("n").alias("a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst")
    near = e.select("a", "b").repartitionByRange("a").sortWithinPartitions("a", "b").mapInArrow(_near_of, _CHUNK)
    names = ids.select("id").repartitionByRange("id").sortWithinPartitions("id").mapInArrow(lambda b: _ids_of(b, _VERTICES), _CHUNK)
    return written(near.unionByName(names))


class _Lists:
    """ids of the vertices, in order; the neighbours of the one at place k are near[at[k]:at[k + 1]]."""

    def __init__(self, rows: list[tuple]) -> None:
        self.ids = np.concatenate([np.frombuffer(r[3], "<i8") for r in rows if r[0] == _VERTICES] or [np.zeros(0, "<i8")])
        sizes = np.zeros(len(self.ids) + 1, np.int64)
        held = [r for r in rows if r[0] == _NEAR]
        self.near = np.empty(sum(len(r[5]) // 4 for r in held), np.int32)
        done = 0
        for r in held:
            own = np.frombuffer(r[5], "<i4")
            self.near[done : done + len(own)] = own
            done += len(own)
            np.add.at(sizes, np.frombuffer(r[3], "<i4") + 1, np.frombuffer(r[4], "<i4"))
        self.at = np.cumsum(sizes)

    def place(self, id_: int) -> int:
        """Its place, or -1 where it has no edges."""
        k = int(np.searchsorted(self.ids, id_))
        return k if k < len(self.ids) and self.ids[k] == id_ else -1


Told = Callable[[_Lists, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def each_start(chunks: DataFrame, starts: DataFrame, told: Told, kind: str, schema: str) -> DataFrame:
    """What ``told`` makes of the lists and some starts (id, distinct): columns start, id and one of the given kind."""
    spark = starts.sparkSession
    ship(spark)
    groups = max(1, spark.sparkContext.defaultParallelism)
    own = starts.select(F.col("id").cast("long").alias("id")).repartition(groups, F.xxhash64("id")).mapInArrow(lambda b: _ids_of(b, _STARTS), _CHUNK)
    own = own.withColumn("g", F.pmod(F.col("part"), F.lit(groups)))
    sent = chunks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).unionByName(own)
    # As many parts as groups, in order: one group in each.
    dealt = sent.repartitionByRange(groups, "g").sortWithinPartitions("g", "kind", "part", "seq")
    value = pa.float64() if kind == "double" else pa.int32()
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, lists = None, [], None
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[6] != group:
                    group, rows, lists = r[6], [], None
                if r[0] != _STARTS:
                    rows.append(r)
                    continue
                if lists is None:
                    lists, rows = _Lists(rows), []
                for a, b, c in told(lists, np.frombuffer(r[3], "<i8")):
                    for k in range(0, len(a), 1 << 16):
                        s = slice(k, k + (1 << 16))
                        yield pa.RecordBatch.from_arrays([pa.array(a[s], pa.int64()), pa.array(b[s], pa.int64()), pa.array(c[s], value)], names)

    return dealt.select("kind", "part", "seq", "ids", "sizes", "near", "g").mapInArrow(run, schema)


def hops(most: int) -> Told:
    """(start, id, dist) of the vertices 1 to ``most`` edges away."""

    def told(lists: _Lists, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        near, at = lists.near, lists.at
        dist = np.full(len(lists.ids), -1, np.int32)
        for s in starts:
            k = lists.place(s)
            if k < 0:
                continue
            dist[:] = -1
            dist[k] = 0
            ring = np.array([k])
            for d in range(1, most + 1):
                seen = np.zeros(len(dist), bool)
                for v in ring:
                    seen[near[at[v] : at[v + 1]]] = True
                ring = np.flatnonzero(seen & (dist < 0))
                dist[ring] = d
            found = np.flatnonzero(dist > 0)
            yield np.full(len(found), s, np.int64), lists.ids[found], dist[found]

    return told


def walks(rounds: int, alpha: float, only: np.ndarray | None = None) -> Told:
    """(start, id, mass) of random walks with restart, scaled to sum 1; only: ids (in order) whose mass is wanted."""

    def told(lists: _Lists, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        near, at, n = lists.near, lists.at, len(lists.ids)
        places = np.array([lists.place(s) for s in starts], np.int64)
        alone = starts[places < 0]  # they keep their own mass, which is scaled to 1
        if only is not None:
            alone = alone[np.isin(alone, only)]
        yield alone.astype(np.int64), alone.astype(np.int64), np.ones(len(alone))
        starts, places = starts[places >= 0], places[places >= 0]
        wanted = np.arange(n) if only is None else np.flatnonzero(np.isin(lists.ids, only))
        share = (alpha / np.maximum(1, np.diff(at)))[:, None]
        most = 4096  # neighbours that are added up at a time
        ones, held = np.ones(most), np.empty((most, WIDE))
        for k in range(0, len(starts), WIDE):
            own, columns = places[k : k + WIDE], np.arange(len(places[k : k + WIDE]))
            now, new = np.zeros((n, len(own))), np.empty((n, len(own)))
            now[own, columns] = 1.0
            part = held.reshape(-1)[: most * len(own)].reshape(most, len(own))
            for _ in range(rounds):
                now *= share
                for v in range(n):
                    lo, hi = at[v], at[v + 1]
                    if hi - lo <= most:
                        np.take(now, near[lo:hi], axis=0, out=part[: hi - lo], mode="clip")
                        np.dot(ones[: hi - lo], part[: hi - lo], out=new[v])
                    else:
                        new[v] = sum(now[near[m : min(m + most, hi)]].sum(axis=0) for m in range(lo, hi, most))
                new[own, columns] += 1.0 - alpha
                now, new = new, now
            now /= now.sum(axis=0)
            for j, s in enumerate(starts[k : k + WIDE]):
                mass = now[wanted, j]
                found = np.flatnonzero(mass > 0)
                yield np.full(len(found), s, np.int64), lists.ids[wanted[found]], mass[found]

    return told
