"""Near-duplicates by SimHash fingerprints and multi-index hashing.

Each fingerprint is cut into two segments of 32 bits. If two fingerprints
differ in 3 bits at most, one segment differs in one bit at most. So a segment
is looked up under itself and under each value that has one of its 0 bits set
(of two segments that differ in one bit, one has the 0 there). What meets in a
table is checked on all 64 bits; a table entry's rows are dealt by the segment,
read as a sorted stream, and told as a tree of links rather than as pairs.
Segment values that over one in ``HOT`` fingerprints share (fewer than 2 ``HOT``
of them), and the values one bit above these, are dealt by each byte of the other
segment as well: of its four bytes, one is equal in any two that are near.
Connected components follow from the links.

Texts that are alike by ``similarity`` (Jaccard, of their sets of shingles) can
differ in more bits than a ball in half of 64 bits can hold. ``similar`` takes
``WORDS`` times 64 bits, cut into segments of 24 bits with balls of one bit; of what
meets there and is near enough by the complete distance, the shingles themselves
decide. Bits of fingerprints follow the similarity only by chance, so this leaves
links out, and an exact search finds the rest: of two sets of n and m shingles that
are alike, the first n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1 in any common order
share one. Texts that links join already are not compared there; others must pass
bounds that no two texts that are alike can fail (sizes, places of what is shared, and
parities: one bit differs at most for each shingle that only one of them has), and
then the shingles themselves decide again. A shared shingle's texts travel as rows,
with their parities, and only pairs that pass all bounds are told. No link rests on
fingerprints alone.

Defined results: a null text counts as empty; a text without words has the
fingerprint zero and is linked like any other; fewer words than a shingle has make one
shingle. Rows that repeat each keep a row. A null id takes part with its text;
the smallest id of a component is that of its non-null ids. Only the columns
asked for are read; an empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table
from .graph import components

SHINGLE, BITS = 3, 3
SEED = 42
_LOW = np.uint64(0xFFFFFFFF)
#: Rows of a table entry that are compared all with all; larger entries are split again by 8 bits of the other segment.
DIRECT = 2048
#: Shares of all fingerprints from which a segment's value is split further, and rows from which that is worth it.
HOT, WORTH = 500, 100_000


#: Fingerprints of texts that are alike: words of 64 bits, and bits of a segment.
WORDS, SEGMENT, SIMILAR_SHINGLE, SIMILAR = 9, 24, 5, 0.8
#: Texts whose shingles are counted to put frequent ones last, counts from which one is frequent, and the most of these; only an order hangs on this, no result.
SAMPLE, FREQUENT, ORDERED = 10_000, 3, 200_000
#: Shingles are matched by so many bits, and then compared whole; up to so many texts to compare are looked up by a broadcast of their hashes.
MATCHED, LOOKUP = (1 << 40) - 1, 1_000_000
#: Rows, or pairs of them, that are compared at once.
STRETCH = 1 << 20


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, "<u8")
    n = max(1, len(words) - shingle + 1)
    joined = [b" ".join(words)] if n == 1 else map(b" ".join, zip(*(words[i : n + i] for i in range(shingle)), strict=True))
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(s, SEED) for s in joined], "<u8", n)


def _majority(h: np.ndarray) -> int:
    n, ones = len(h), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(part, axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return _majority(shingle_hashes(text, shingle))


def wide_fingerprint(text: str, shingle: int = SIMILAR_SHINGLE) -> list[int]:
    """``WORDS`` words over the set of shingles, each by another hash."""
    return _wide(np.unique(shingle_hashes(text, shingle)))


def _wide(h: np.ndarray) -> list[int]:
    out = []
    for k in range(WORDS):
        v = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(v ^ (v >> np.uint64(31))))
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every text, as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit(""))).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def linked(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Positions joined to an earlier one so that what `bits` differing bits link, directly or not, is one tree."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def compare(some: np.ndarray) -> None:
        # Each row is looked at once, against those that no earlier one has reached.
        while len(some) > 1:
            head, reached, some = int(some[0]), [int(some[0])], some[1:]
            while reached and len(some):
                near = np.bitwise_count(fps[some] ^ fps[reached.pop()]) <= bits
                if near.any():
                    got = some[near].tolist()
                    some = some[~near]
                    reached += got
                    for b in got:
                        a, b = find(head), find(b)
                        if a != b:
                            root[max(a, b)] = min(a, b)

    def split(some: np.ndarray, bytes_left: tuple[int, ...]) -> None:
        if len(some) <= DIRECT or len(bytes_left) <= bits:
            return compare(some)
        # Of more than `bits` bytes, one is equal in any two that are near; each byte's value is a smaller entry.
        for k in bytes_left:
            value = (fps[some] >> np.uint64(8 * k)) & np.uint64(255)
            if (value == value[0]).all():
                return split(some, tuple(x for x in bytes_left if x != k))
        for k in bytes_left:
            value = (fps[some] >> np.uint64(8 * k)) & np.uint64(255)
            for v in np.unique(value):
                split(some[value == v], tuple(x for x in bytes_left if x != k))

    split(np.arange(len(fps)), tuple(range(8)))
    return [(i, find(i)) for i in range(len(fps)) if find(i) != i]


def _hot_values(fps: DataFrame) -> list[int]:
    """Segment values (value << 1 | segment) that many of the fingerprints share, and those one bit above them."""
    total = fps.count()
    if total < WORTH:
        return []
    own = F.array(*[F.call_function("shiftleft", F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(1)).bitwiseOR(F.lit(k).cast("long")) for k in range(2)])
    found = fps.select(F.explode(own).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT > total).collect()
    return sorted({r["key"] for r in found} | {r["key"] | 1 << b for r in found for b in range(1, 33)})


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column fp, enough of them to join all that are within `bits` bits.

    ``bits`` may be 3 at most: two segments of which one differs in one bit at most.
    """
    if not 0 <= bits <= 3:
        raise ValueError("bits must be from 0 to 3")

    def probe(segment: int) -> F.Column:
        value = F.shiftrightunsigned("fp", 32 * segment).bitwiseAND(F.lit(0xFFFFFFFF))
        flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.when(F.call_function("getbit", value, b) == 0, F.call_function("shiftleft", F.lit(1).cast("long"), b).bitwiseOR(value))), lambda x: x.isNotNull())
        own = F.array(F.struct(F.lit(True).alias("own"), value.alias("key")))
        return F.transform(F.concat(own, F.transform(flips, lambda x: F.struct(F.lit(False).alias("own"), x.alias("key")))), lambda s: F.struct(s["own"].alias("own"), F.call_function("shiftleft", s["key"], F.lit(1)).bitwiseOR(F.lit(segment).cast("long")).alias("key")))

    entries = fps.select("fp", F.explode(F.concat(probe(0), probe(1))).alias("e")).select("e.key", "fp", "e.own")
    entries = entries.withColumn("key", F.col("key") * 4096)
    if hot := _hot_values(fps):
        known = F.broadcast(fps.sparkSession.createDataFrame([(k * 4096,) for k in hot], "hot long"))  # at most 2 * HOT * 33 rows
        of_other = F.when(F.shiftright("key", 12).bitwiseAND(F.lit(1)) == 1, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32))
        parts = F.array(*[F.shiftright(of_other, 8 * k).bitwiseAND(F.lit(255)) + (1 + 256 * k) for k in range(4)])
        entries = entries.join(known, F.col("key") == F.col("hot"), "left")
        entries = entries.select(F.explode(F.when(F.col("hot").isNull(), F.array(F.lit(0).cast("long"))).otherwise(parts)).alias("part"), "key", "fp", "own").select((F.col("key") + F.col("part")).alias("key"), "fp", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches_and_end(batches):
            if batch is not None and batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)))
                if held[0][0][0] == held[-1][0][-1]:
                    continue  # the same key goes on
            if not held:
                continue
            keys, values, owns = (np.concatenate(c) for c in zip(*held, strict=True))
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            told = len(keys) if batch is None else starts[-1]  # the last key may go on in the next batch
            counts = np.add.reduceat(owns, starts, dtype=np.int64)
            out: list[tuple[int, int]] = []
            for s, e in zip(starts[(ends - starts > 1) & (counts > 0)], ends[(ends - starts > 1) & (counts > 0)], strict=True):
                if e <= told:
                    own = np.unique(values[s:e])
                    out += [(int(own[i]), int(own[j])) for i, j in linked(own, bits)]
            if out:
                got = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])
            held = [(keys[told:], values[told:], owns[told:])] if told < len(keys) else []

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def batches_and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(id, fp, component_id): the smallest id that is reachable over links, for every document."""
    marked = materialize(with_fingerprints(docs, id_col, text_col, shingle))
    own = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("first")))
    part = components(links(own.select("fp"), bits))  # (node, root) of fingerprints that have links
    known = own.join(part, own["fp"] == part["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # Only components of several fingerprints need another look.
    least = known.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id_col, "fp", "component_id")


def _direct(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """(i, j) of positions within ``bits`` bits, enough to join all that such pairs join."""
    out, some = [], np.arange(len(fps))
    while len(some) > 1:
        reached, some = [int(some[0])], some[1:]
        while reached and len(some):
            at = reached.pop()
            near = np.bitwise_count(fps[some] ^ fps[at]) <= bits
            if near.any():
                got = some[near].tolist()
                some = some[~near]
                reached += got
                out += [(at, b) for b in got]
    return out


def similar_pairs(nodes: DataFrame, similarity: float = SIMILAR, held: int = 500_000) -> DataFrame:
    """(a, b): candidates among the first words of wide fingerprints (fp, wide), which meet in a table and are near in that word.

    A table entry is read as a stream in stretches of ``held`` rows; trees of a
    stretch go on in the next one by their first member.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = math.ceil(64 * share + 3 * math.sqrt(64 * share * (1 - share)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                fp = some.column(0).to_numpy()
                wide = np.ascontiguousarray(some.column(1).flatten().to_numpy()).astype("<i8").view(np.uint8).reshape(len(fp), -1, SEGMENT // 8)
                value = (wide.astype(np.int64) << np.array([8 * k for k in range(SEGMENT // 8)])).sum(axis=2)
                value |= np.arange(value.shape[1])[None, :] << SEGMENT
                row = np.broadcast_to(np.arange(len(fp))[:, None], value.shape)
                keys, rows = [value.ravel()], [row.ravel()]
                for b in range(SEGMENT):  # of two segments that differ in one bit, one has the 0 there
                    zero = (value >> b & 1) == 0
                    keys.append(value[zero] | 1 << b)
                    rows.append(row[zero])
                own = np.zeros(sum(map(len, keys)), bool)
                own[: value.size] = True
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)), pa.array(fp[np.concatenate(rows)]), pa.array(own)], ["key", "fp", "own"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, owns = np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, bool)
        for batch in batches_and_end(batches):
            if batch is not None:
                parts = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
                keys, values, owns = (np.concatenate(x) for x in zip((keys, values, owns), parts, strict=True))
                if len(keys) < 100_000:
                    continue
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            told = len(keys) if batch is None else starts[-1]  # the last key may go on in the next batch
            counts = np.add.reduceat(owns, starts, dtype=np.int64)
            whole = (ends - starts > 1) & (counts > 0) & (ends <= told)
            out: list[tuple[int, int]] = []
            for a, b in zip(starts[whole].tolist(), ends[whole].tolist(), strict=True):
                if b - a == 2:
                    if 0 < (int(values[a]) ^ int(values[a + 1])).bit_count() <= bits:
                        out.append((int(values[a]), int(values[a + 1])))
                    continue
                mine = np.unique(values[a:b])
                out += [(int(mine[i]), int(mine[j])) for i, j in _direct(mine, bits)]
            rest = [keys[told:], values[told:], owns[told:]]
            if batch is not None and len(rest[0]) > held:
                mine = np.unique(rest[1])
                tree = _direct(mine, bits)
                out += [(int(mine[i]), int(mine[j])) for i, j in tree]
                heads = np.setdiff1d(np.arange(len(mine)), [j for _, j in tree])
                rest = [np.full(len(heads), rest[0][0]), mine[heads], np.full(len(heads), rest[2].any())]
            if out:
                got = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got.min(axis=1)), pa.array(got.max(axis=1))], ["a", "b"])
            keys, values, owns = rest

    entries = nodes.select("fp", "wide").mapInArrow(probe, "key int, fp long, own boolean")
    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long").distinct()


def _set_id(own: np.ndarray) -> int:
    """A set of shingles, as a signed bigint."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def _prefix(own: np.ndarray, often: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set, rare ones first: two sets that are alike share one of these."""
    n = len(own)
    first = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
    if not n or not len(often):
        return own[:first]
    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
    known = often[at] == own
    rare = own[~known]
    if len(rare) < first:
        rare = np.concatenate((rare, own[known][np.lexsort((own[known], counts[at[known]]))]))
    return rare[:first]


def _parity(own: np.ndarray) -> np.ndarray:
    """Of the shingles whose low bits are i, whether there is an odd number; a power of two of bits, about one for each shingle."""
    bits = 64 << max(0, (len(own) - 1) // 64).bit_length()
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _least_apart(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles that only one of two sets has, at least, by their parities; the longer is folded to the shorter."""
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count((np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).view(np.uint64)).sum())  # of signed ones it counts the magnitude


def _often(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of the texts of column t, sorted, and their counts."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            own = [np.unique(shingle_hashes(t, shingle)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["h"])

    share = math.ceil(1_000_000 * min(1, SAMPLE / max(1, texts.count())))
    some = texts.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < share).distinct()
    found = some.mapInArrow(told, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    found = found.orderBy(F.desc("n"), "h").limit(ORDERED).toArrow()
    often, counts = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(often)
    return often[order], counts[order]


def _sharing(nodes: DataFrame, part: DataFrame, similarity: float) -> DataFrame:
    """(a, b): sets of nodes (id, size, prefix, parity) that share a shingle of their prefixes, are in different components of part (node, root), and may be alike by sizes, places and parities.

    A key goes on with its rows, not with its pairs; pairs are told when their parities are known.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Stretches of the batches that hold all rows of their keys."""
        held, rows, enough = [], 0, STRETCH // 8
        for batch in batches_and_end(batches):
            if batch is not None:
                held.append(batch)
                rows += batch.num_rows
                if rows < enough:
                    continue
            if not rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("key").to_numpy()
            told = rows if batch is None else int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if told:
                yield table.slice(0, told).combine_chunks()
            held, rows = table.slice(told).to_batches(), rows - told
            enough = max(STRETCH // 8, 2 * rows)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows are sorted by key and root.
        for table in whole(batches):
            keys, roots = table.column("key").to_numpy(), table.column("root").to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            yield from table.filter(pa.array(np.repeat(roots[starts] != roots[ends - 1], ends - starts))).to_batches()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            keys, roots, ids, sizes, places = (table.column(c).to_numpy() for c in ("key", "root", "id", "size", "place"))
            lists = table.column("parity").combine_chunks()
            words = lists.value_lengths().to_numpy().astype(np.int64)
            values, first = lists.flatten().to_numpy().view(np.uint64), np.cumsum(words) - words

            def folded(rows: np.ndarray, n: int, words: np.ndarray = words, values: np.ndarray = values, first: np.ndarray = first) -> np.ndarray:
                out = np.zeros((len(rows), n), np.uint64)
                for w in np.unique(words[rows]).tolist():
                    some = words[rows] == w
                    out[some] = np.bitwise_xor.reduce(values[first[rows[some]][:, None] + np.arange(w)].reshape(-1, w // n, n), axis=1)
                return out

            # The others of a row's key and of later roots stand after its run.
            at = np.arange(len(keys))
            new = np.r_[True, keys[1:] != keys[:-1]]
            run = np.r_[new[1:] | (roots[1:] != roots[:-1]), True]
            run_end = np.flatnonzero(run)[np.cumsum(run) - run] + 1
            key_end = np.r_[np.flatnonzero(new)[1:], len(keys)][np.cumsum(new) - 1]
            upto = np.cumsum(key_end - run_end)
            start = 0
            while start < len(at):
                before = upto[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(upto, before + STRETCH, "right")))
                n = (key_end - run_end)[start:stop]
                x = np.repeat(at[start:stop], n)
                y = run_end[x] + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                n, m = sizes[x], sizes[y]
                both = np.minimum(n - places[x], m - places[y])
                may = (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (both * (1 + similarity) >= similarity * (n + m) - 1e-9)
                x, y, most = x[may], y[may], ((1 - similarity) / (1 + similarity) * (n + m) + 1e-9)[may]
                length = np.minimum(words[x], words[y])
                for w in np.unique(length).tolist():
                    of = np.flatnonzero(length == w)
                    for k in range(0, len(of), step := max(1, STRETCH // w)):
                        some = of[k : k + step]
                        some = some[np.bitwise_count(folded(x[some], w) ^ folded(y[some], w)).sum(axis=1) <= most[some]]
                        if len(some):
                            got = np.unique(np.stack((np.minimum(ids[x[some]], ids[y[some]]), np.maximum(ids[x[some]], ids[y[some]])), axis=1), axis=0)
                            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])
                start = stop

    named = nodes.join(part, nodes["id"] == part["node"], "left").select("id", "size", F.coalesce("root", "id").alias("root"), "prefix")
    entries = named.select(F.posexplode("prefix").alias("place", "key"), "root", "id", "size").select("key", "root", "id", "size", "place")
    shared = entries.repartition("key").sortWithinPartitions("key", "root").mapInArrow(several, "key long, root long, id long, size long, place int")
    marked = materialize(shared).join(nodes.select("id", "parity"), "id").select("key", "root", "id", "size", "place", "parity")
    return marked.repartition("key").sortWithinPartitions("key", "root").mapInArrow(near, "a long, b long").distinct()


def _by_distance(pairs: DataFrame, bits: int, similarity: float) -> DataFrame:
    """(a, b) of the pairs (a, b, and of either side w: wide fingerprint, n: size, p: parity) within ``bits`` bits that may be alike by their parities."""

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = (1 - similarity) / (1 + similarity) * n + 1e-9
            sides = zip(batch.column(4), batch.column(5), strict=True)
            near = [_least_apart(x.values.to_numpy(), y.values.to_numpy()) <= m for (x, y), m in zip(sides, most, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    apart = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return pairs.where(apart <= bits).select("a", "b", "na", "nb", "pa", "pb").mapInArrow(may, "a long, b long")


def _alike(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes (id, key) that are alike, by the shingles of rows (key, t)."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            own = [np.unique(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()]
            same = [i == _set_id(x) for i, x in zip(batch.column(0).to_pylist(), own, strict=True)]  # other keys may have the same hash
            sets = pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["id", "own"]).filter(pa.array(same, pa.bool_()))

    pairs = materialize(pairs)
    ends = materialize(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct().join(nodes.select("id", "key"), "id").select("id", F.xxhash64("key").alias("hash")))
    if not (n := ends.count()):
        return pairs
    # Rows that repeat a key hold the same text.
    sets = rows.select(F.xxhash64("key").alias("hash"), "t").join(F.broadcast(ends) if n <= LOOKUP else ends, "hash")
    sets = materialize(sets.select("id", "t").mapInArrow(told, "id long, own array<long>").groupBy("id").agg(F.first("own").alias("own")))
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("own").alias(f"s{side}")), side)
    both = F.size(F.array_intersect("sa", "sb"))
    return materialize(pairs.where(both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both)).select("a", "b"))


def similar(docs: DataFrame, key_col: str, text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILAR) -> DataFrame:
    """(key, n, component): each key, in how many rows it stands, and the least key that links reach; keys of a text must be its own.

    All texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more are linked, and no others.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    maybe = round(64 * WORDS * share + 2 * math.sqrt(64 * WORDS * share * (1 - share)))
    kind = docs.schema[key_col].dataType.simpleString()
    rows = docs.select(F.col(key_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("t"))
    often, counts = _often(rows.select("t"), shingle)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()]
            wide = np.array([_wide(x) for x in sets], np.uint64).view(np.int64)
            prefix = [(_prefix(x, often, counts, similarity) & np.uint64(MATCHED)).view(np.int64) for x in sets]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (list(wide), prefix, [_parity(x) for x in sets])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_set_id(x) for x in sets]), pa.array([len(x) for x in sets]), pa.array(wide[:, 0]), *lists], ["key", "id", "size", "fp", "wide", "prefix", "parity"])

    marked = materialize(rows.mapInArrow(mark, f"key {kind}, id long, size long, fp long, wide array<long>, prefix array<long>, parity array<long>"))
    # All but the key follow from the set of shingles.
    nodes = materialize(marked.groupBy("id").agg(F.min("key").alias("key"), *(F.first(c).alias(c) for c in ("size", "fp", "wide", "prefix", "parity"))))
    heads = materialize(nodes.groupBy("fp").agg(F.min(F.struct("id", "wide", "size", "parity")).alias("m")).select("fp", "m.*"))
    of = lambda side: [F.col("id").alias(side), F.col("wide").alias(f"w{side}"), F.col("size").alias(f"n{side}"), F.col("parity").alias(f"p{side}")]
    meeting = similar_pairs(heads, similarity).toDF("fa", "fb")
    for side in "ab":
        meeting = meeting.join(heads.select(F.col("fp").alias(f"f{side}"), *of(side)), f"f{side}")
    meeting = meeting.drop("fa", "fb")
    equal = nodes.select("fp", *of("b")).join(heads.select("fp", *of("a")), "fp").where("a <> b").drop("fp")
    known = _alike(_by_distance(meeting.unionByName(equal), maybe, similarity), nodes, rows, shingle, similarity)
    rest = _alike(_sharing(nodes, materialize(components(known)), similarity), nodes, rows, shingle, similarity)
    part = components(known.unionAll(rest))
    joined = nodes.join(part, nodes["id"] == part["node"], "left").select("id", "key", F.coalesce("root", "id").alias("root"))
    least = joined.groupBy("root").agg(F.min("key").alias("component"))
    named = joined.join(least, "root").select("id", "component")
    counted = marked.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(named, "id").select("key", "n", "component")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
