"""Language-model scores by prediction by partial matching (PPM).

Texts are put in lower case (A-Z), their words joined by one space, and an end
is added. A trie of byte contexts up to ``ORDER`` bytes, pretrained on the
training documents, predicts each byte: from the longest known context it
escapes to shorter ones (method C: as many escapes as distinct symbols seen),
and symbols that a longer context has seen are excluded from the shorter one's
counts; below order 0 all of 257 symbols that are left are alike. As the trie is
fixed while scoring, escapes and exclusions are summed once for each context.

The trie is whole and never in one place. Documents are read in blocks of
``BLOCK`` symbols; each block gives its distinct codes (a symbol with its
context) with their training counts. Contexts of less than ``BASE`` symbols are
sent to all tasks (at most 257**BASE entries, whatever the corpus); longer ones
are dealt by their newest ``BASE`` symbols, so that a task has all that its
contexts escape to. The probabilities return to the blocks by joins, packed
without loss: up to ``_PACK`` codes of a block, and their probabilities, in a row;
so do the texts, up to ``_TEXTS`` bytes in a row.

Beside it stands a unigram score. Counts of the ``HOT`` most frequent tokens are
sent to the tasks (a bounded table); other tokens are joined to their counts.

Defined results: a null text counts as empty, and has the end only. Without any
training document N and V are 0 and each byte has 1/257. Rows that repeat each
keep a row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialize, slices, table

ORDER, BASE, HOT = 5, 3, 200_000
#: A block ends with the text that brings it to so many symbols, or so many distinct codes.
BLOCK, BLOCK_CODES = 1 << 24, 1_000_000
SYMBOLS, END = 257, 257  # bytes are symbols 1 to 256; 0 fills the context before a text
_BITS = np.uint64(9)
#: Codes of a block that travel in one row, and codes that are put together for that.
_PACK, _PACKED = 512, 1 << 20
#: Bytes of texts that travel in one row, or one text.
_TEXTS = 1 << 14
#: Symbols in one go; rows of the trie in one go; bits of a block's lookup table.
_CHUNK, _ROWS, _SLOTS = 1 << 21, 500_000, 21


def tokens(text: str) -> list[bytes]:
    """Words; the end, which is counted too, is not in the list."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): each byte and end with its context, 9 bits a symbol, the newest lowest; where each text starts."""
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.r_[0, np.cumsum(sizes)]
    padded = np.zeros(int(starts[-1]) + order * len(texts), np.uint64)
    at = np.repeat(np.arange(1, len(texts) + 1) * order, sizes) + np.arange(int(starts[-1]))
    padded[at] = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint64) + np.uint64(1)
    padded[at[starts[1:] - 1]] = END
    code = padded[at].copy()
    for k in range(1, order + 1):
        code |= padded[at - k] << (_BITS * np.uint64(k))
    return code, starts[:-1]


def mask(k: int) -> np.uint64:
    """The newest k symbols of a code."""
    return np.uint64((1 << (9 * k)) - 1)


def shortened(codes: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the codes' newest k symbols."""
    short, back = np.unique(codes & mask(k), return_inverse=True)
    return short, np.bincount(back, n, len(short))


class Trie:
    """Sums for each context; tables are sorted arrays, one set for each order."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each order k from 0, (codes of k + 1 symbols, counts)."""
        self.gram: list[np.ndarray] = []
        self.log: list[np.ndarray] = []
        self.context: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []  # log of the escape from here, nothing excluded
        self.norm: list[np.ndarray] = []
        self.under: list[np.ndarray] = []  # log of the norm of the next shorter context, under exclusion
        self.path: list[np.ndarray] = []  # sum of log escapes from the next shorter context down, under exclusion
        self.below: tuple | None = None
        for codes, n in counts:
            self._add(codes, n)
        self.rest = math.log(max(1, SYMBOLS - len(self.gram[0])))

    def longer(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
        """This trie with further orders; all that they escape to must be known."""
        out = Trie.__new__(Trie)
        out.__dict__ |= {k: list(v) if isinstance(v, list) else v for k, v in self.__dict__.items()}
        for codes, n in counts:
            out._add(codes, n)
        return out

    def _add(self, codes: np.ndarray, n: np.ndarray) -> None:
        k = len(self.gram)
        by = np.argsort(codes, kind="stable")
        codes, n = codes[by], n[by].astype(np.float64)
        context, first = np.unique(codes >> _BITS, return_index=True)
        sums = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        total, distinct = sums(n), sums(np.ones(len(n)))
        self.gram.append(codes)
        self.log.append(np.log(n))
        self.context.append(context)
        self.norm.append(np.log(total + distinct))
        self.escape.append(np.log(distinct) - self.norm[-1])
        if k:
            suffix = np.searchsorted(self.below[0], codes & mask(k))
            up = np.searchsorted(self.context[k - 1], context & mask(k - 1))
            left_n = self.below[2][up] - sums(self.below[1][suffix])
            left_d = self.below[3][up] - distinct
            with np.errstate(divide="ignore"):
                under = np.where(left_d > 0, np.log(left_n + left_d), 0.0)
                own = np.where(left_d > 0, np.log(left_d) - under, 0.0)
            self.under.append(under)
            self.path.append(own + (self.path[k - 1][up] if k > 1 else 0.0))
        else:
            self.under.append(np.zeros(len(context)))
            self.path.append(np.zeros(len(context)))
        self.below = (codes, n, total, distinct)

    @staticmethod
    def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Places, or -1."""
        if not len(table):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return np.where(table[at] == x, at, -1)

    def log_of(self, code: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each newest symbol after its context."""
        longest = np.full(len(code), -1)
        found = np.full(len(code), -1)
        top = np.zeros(len(code))
        out = np.zeros(len(code))
        above = np.zeros(len(code))  # path and norm of the context one longer than the one that is looked at
        over = np.zeros(len(code))
        for k in range(len(self.gram) - 1, -1, -1):
            context = self._find(self.context[k], (code >> _BITS) & mask(k))
            gram = self._find(self.gram[k], code & mask(k + 1))
            new = (context >= 0) & (longest < 0)
            longest[new] = k
            top[new] = self.escape[k][context[new]] + self.path[k][context[new]]
            hit = (gram >= 0) & (found < 0)
            first = hit & (longest == k)
            out[first] = self.log[k][gram[first]] - self.norm[k][context[first]]
            later = hit & (longest > k)
            # The escapes from the longest context down to here, without those from here on.
            out[later] = top[later] - above[later] + self.log[k][gram[later]] - over[later]
            found[hit] = k
            known = context >= 0
            above[known], over[known] = self.path[k][context[known]], self.under[k][context[known]]
        none = found < 0
        out[none] = np.where(longest[none] >= 0, top[none], 0.0) - self.rest
        return out


def chunks(texts: list[bytes]) -> Iterator[slice]:
    at = size = 0
    for n, t in enumerate(texts):
        if size and size + len(t) > _CHUNK:
            yield slice(at, n)
            at, size = n, 0
        size += len(t) + 1
    if at < len(texts):
        yield slice(at, len(texts))


class Lookup:
    """Log probabilities of the codes of a block, by sorted codes with a table of recent places before them."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        self.codes, self.logs = codes, logs
        self.place = np.zeros(1 << _SLOTS, np.int32)
        self.place[self._slots(codes)] = np.arange(len(codes), dtype=np.int32)

    @staticmethod
    def _slots(codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text."""
        code, starts = grams(texts)
        at = self.place[self._slots(code)]
        wrong = np.flatnonzero(self.codes[at] != code)
        if len(wrong):
            at[wrong] = np.minimum(np.searchsorted(self.codes, code[wrong]), len(self.codes) - 1)
            if (self.codes[at[wrong]] != code[wrong]).any():
                raise RuntimeError("a block lacks codes of its own texts")
        return np.add.reduceat(self.logs[at], starts) / math.log(10)


def blocks(docs: DataFrame, id_col: str, text_col: str, train: Column, extra: dict[str, Column]) -> DataFrame:
    """A row for each document (block, i, x..., t: its words in bytes, train), and a row for each distinct code of a block (block, code, n: its count in training documents)."""
    d = docs.select(F.coalesce(text_col, F.lit("")).alias("t"), F.coalesce(train, F.lit(False)).alias("train"), F.col(id_col).alias("i"), *[c.alias(k) for k, c in extra.items()])
    kept = d.schema.names[2:]
    schema = "block long, t binary, train boolean, code long, n long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        apart: list[tuple[np.ndarray, np.ndarray]] = []  # sorted codes and counts, not yet summed
        size, kinds = 0, None
        names = ["block", "t", "train", "code", "n", *kept]

        def merge() -> None:
            nonlocal apart
            codes, ns = (np.concatenate(x) for x in zip(*apart, strict=True))
            codes, back = np.unique(codes, return_inverse=True)
            apart = [(codes, np.bincount(back, ns, len(codes)))]

        def told() -> Iterator[pa.RecordBatch]:
            if not apart:
                return
            merge()
            codes, ns = apart[0]
            for at in range(0, len(codes), 100_000):
                c, n = codes[at : at + 100_000], ns[at : at + 100_000]
                m = len(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.bool_()), pa.array(c.view(np.int64)), pa.array(n.astype(np.int64)), *(pa.nulls(m, k) for k in kinds)], names)

        for batch in slices(batches, 0):
            kinds = [c.type for c in batch.columns[2:]]
            texts = [b" ".join(tokens(t)) for t in batch.column(0).to_pylist()]
            learn = batch.column(1).to_numpy(zero_copy_only=False)
            for part in chunks(texts):
                some, m = texts[part], part.stop - part.start
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(some, pa.binary()), pa.array(learn[part]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *(c.slice(part.start, m) for c in batch.columns[2:])], names)
                new, starts = grams(some)
                size += len(new)
                learned = np.repeat(learn[part], np.diff(np.r_[starts, len(new)]))
                apart += [np.unique(new[learned], return_counts=True), (other := np.unique(new[~learned]), np.zeros(len(other)))]
                if size >= BLOCK or sum(len(c) for c, _ in apart) >= 2 * BLOCK_CODES:
                    merge()
                if size >= BLOCK or len(apart[0][0]) >= BLOCK_CODES:
                    yield from told()
                    block, apart, size = block + 1, [], 0
        yield from told()

    return materialize(d.mapInArrow(run, schema), "zstd")


def probabilities(counts: DataFrame) -> DataFrame:
    """(code, log) of every row of counts (code, n): the natural log of its newest symbol's probability after its context; n counts the training documents."""
    short = counts.where("n > 0").groupBy(F.col("code").bitwiseAND(F.lit(int(mask(BASE)))).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    codes, n = short.column("code").to_numpy().view(np.uint64), short.column("n").to_numpy()
    base = counts.sparkSession.sparkContext.broadcast(Trie([shortened(codes, n, k + 1) for k in range(BASE)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def told(g: np.ndarray, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            known = n > 0
            trie = base.value.longer([shortened(codes[known], n[known], k + 1) for k in range(BASE, ORDER + 1)])
            return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(trie.log_of(codes))], ["code", "log"])

        for batch in batches:
            held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()])
            size += batch.num_rows
            if size >= _ROWS:
                g, codes, n = (np.concatenate(c) for c in zip(*held, strict=True))
                end = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if end:
                    yield told(g[:end], codes[:end], n[:end])
                held, size = [[g[end:], codes[end:], n[end:]]], len(g) - end
        if size:
            yield told(*(np.concatenate(c) for c in zip(*held, strict=True)))

    dealt = counts.select(F.shiftright("code", 9).bitwiseAND(F.lit(int(mask(BASE)))).alias("g"), "code", "n")
    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "code long, log double")


def _packed(values: np.ndarray) -> bytes:
    """Numbers of 8 bytes, first bytes first, compressed without loss."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8")[:, 0]


def packs(told: DataFrame) -> DataFrame:
    """(block, n, codes, logs): the rows (block, code, log), up to ``_PACK`` of a block in a row; codes as differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            block, code, log = (np.concatenate(c) for c in zip(*held, strict=True))
            by = np.lexsort((code, block))
            block, code, log = block[by], code[by], log[by]
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            ends = np.r_[starts[1:], len(block)]
            parts = [(at, min(at + _PACK, e)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) for at in range(s, e, _PACK)]
            columns = [pa.array(block[[a for a, _ in parts]]), pa.array([b - a for a, b in parts], pa.int32())]
            columns.append(pa.array([_packed(np.diff(code[a:b], prepend=np.uint64(0))) for a, b in parts], pa.binary()))
            columns.append(pa.array([_packed(log[a:b]) for a, b in parts], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, ["block", "n", "codes", "logs"])

        for batch in batches:
            held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()])
            size += batch.num_rows
            if size >= _PACKED:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return told.select("block", "code", "log").mapInArrow(run, "block long, n int, codes binary, logs binary")


def text_packs(texts: DataFrame, kept: list[str]) -> DataFrame:
    """(block, t, sizes, kept...): rows (block, t, kept...) of a block put together, up to ``_TEXTS`` bytes, or one text; t is compressed, the others are arrays."""
    d = texts.select("block", "t", *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, own = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            edges, held = [0], 0
            for n, t in enumerate(own):
                if n > edges[-1] and (held + len(t) > _TEXTS or block[n] != block[n - 1]):
                    edges.append(n)
                    held = 0
                held += len(t)
            edges.append(len(own))
            whole = pa.array([pa.compress(b"".join(own[a:b]), codec="zstd", asbytes=True) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
            offsets = pa.array(edges, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, c) for c in (pa.array([len(t) for t in own], pa.int64()), *batch.columns[2:])]
            yield pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]]), whole, *lists], ["block", "t", "sizes", *kept])

    return d.mapInArrow(run, "block long, t binary, sizes array<long>, " + ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in d.schema.fields[2:]))


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c): how often each word, and the end, stands in column t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter[bytes] = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            keys, ns = list(own.keys()), list(own.values())
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000], pa.binary()), pa.array(ns[at : at + 100_000], pa.int64())], ["token", "n"])
            own.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                own.update(t.split())
                own[b""] += 1  # the end
            if len(own) > 400_000:
                yield from told()
        yield from told()

    return materialize(texts.select("t").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c")))


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None, hot: int = HOT) -> DataFrame:
    """(id, extra columns, n_tokens, n_known, train_tokens, base_score, score) of every text, learning from the rows where train holds."""
    spark = docs.sparkSession
    extra = extra or {}
    own_names = {name: f"x{n}" for n, name in enumerate(extra)}
    both = blocks(docs, id_col, text_col, train, {own_names[k]: c for k, c in extra.items()})
    texts = both.where(F.col("t").isNotNull())
    codes = both.where(F.col("code").isNotNull()).select("block", "code", "n")
    words = token_counts(texts.where("train"))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    bottom = math.log10(total + 0.5 * (distinct + 1))
    top = words.orderBy(F.desc("c"), "token").limit(hot).toArrow()
    sent = spark.sparkContext.broadcast(dict(zip(top.column("token").to_pylist(), (np.log10(top.column("c").to_numpy() + 0.5) - bottom).tolist(), strict=True)))
    counts = materialize(codes.groupBy("code").agg(F.sum("n").alias("n")), "zstd")
    told = codes.select("block", "code").join(probabilities(counts), "code")
    kept = ["i", *own_names.values()]
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("n", "int"), ("codes", "binary"), ("logs", "binary"))]
    rows = text_packs(texts, kept).select("block", *nothing, "t", "sizes", *kept).unionByName(packs(told), allowMissingColumns=True)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        get, end = known.get, known.get(b"")
        held: list[list[np.ndarray]] = []
        lookup = None
        for batch in batches:
            is_text = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(is_text[1:] != is_text[:-1]) + 1).tolist(), batch.num_rows]
            for at, to in zip(edges[:-1], edges[1:], strict=True):
                if at == to:
                    continue
                some = batch.slice(at, to - at)
                if not is_text[at]:
                    for m, c, x in zip(*(some.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                        held.append([np.cumsum(_unpacked(c, m), dtype=np.uint64), _unpacked(x, m).view(np.float64)])
                    continue
                if held:  # the first text behind a block's codes
                    c, logs = (np.concatenate(x) for x in zip(*held, strict=True))
                    by = np.argsort(c)
                    lookup, held = Lookup(c[by], logs[by]), []
                for k in range(len(some)):
                    sizes = some.column(5)[k].values.to_numpy()
                    ends = np.cumsum(sizes).tolist()
                    whole = pa.decompress(some.column(4)[k].as_py(), decompressed_size=ends[-1], codec="zstd", asbytes=True) if ends[-1] else b""
                    joined = [whole[e - m : e] for e, m in zip(ends, sizes.tolist(), strict=True)]
                    scores = np.concatenate([lookup.scores(joined[part]) for part in chunks(joined)])
                    base, n_known, n_tokens, rare = [], [], [], []
                    for t in joined:
                        w = t.split()
                        logs = [*map(get, w), end]
                        n_tokens.append(len(logs))
                        left = Counter([t for t, x in zip([*w, b""], logs, strict=True) if x is None]) if None in logs else {}
                        if left:
                            logs = [x for x in logs if x is not None]
                        base.append(float(sum(logs)))
                        n_known.append(len(logs))
                        rare.append([{"token": t, "n": n} for t, n in left.items()])
                    yield pa.RecordBatch.from_arrays([pa.array(n_tokens), pa.array(n_known), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array(rare, pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))), *(c[k].values for c in some.columns[6:])], [*"nkbsr", *kept])

    # A block's codes stand before its texts.
    first = rows.repartition("block").sortWithinPartitions("block", F.col("t").isNotNull()).select("block", "n", "codes", "logs", "t", "sizes", *kept)
    first = first.mapInArrow(run, f"n long, k long, b double, s double, r array<struct<token: binary, n: long>>, {kinds}")
    first = materialize(first.withColumn("row", F.monotonically_increasing_id()))
    rare = first.where(F.size("r") > 0).select("row", F.explode("r").alias("x")).select("row", "x.token", F.col("x.n").alias("m"))
    more = rare.join(words, "token", "left").select("row", F.when(F.col("c") > 0, F.col("m")).otherwise(0).alias("more"), (F.col("m") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - bottom)).alias("y"))
    more = more.groupBy("row").agg(F.sum("more").alias("more"), F.sum("y").alias("y"))
    out = first.drop("r").join(more, "row", "left")
    return out.select(F.col("i").alias(id_col), *[F.col(x).alias(k) for k, x in own_names.items()], F.col("n").alias("n_tokens"), (F.col("k") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("b") + F.coalesce("y", F.lit(0.0))).alias("base_score"), F.col("s").alias("score"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 5) == 1
    return score(table(spark, sf_dir, "documents"), ~held_out, extra={"held_out": held_out})
