"""Secret scan with corpus-wide ownership frequency.

Three kinds of base spans are found by their patterns; a fourth, ``key``, holds
other credential-like values: known prefixes, signed web tokens and mixed runs
of 32 or more characters. Every value is hashed, and hashes are counted over the
whole corpus by distinct repositories and distinct owners. A value that
``COPIED`` owners hold, or ``WIDE`` repositories of whatever owner, is a widely
copied example; one below both looks live. ``key`` spans are reported where they
look live. Base spans always stay, with their verdict beside them.

Counts are summed by (hash, owner, repository) before anything is dealt by hash.
They return by a join in which hashes that hold over ``1 / HOT`` of all spans
(fewer than ``HOT`` of them, whatever the corpus) are salted. Defined results: a
null text counts as empty and has no spans; a null owner or repository counts as
one unnamed; rows that repeat each keep a row, and count once for their
repository; a repository that several owners name counts once. Only the columns
asked for are read, so further columns of any name do no harm; an empty table
has no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

KINDS = ("assign", "access", "hex", "key")
#: Distinct owners from which a value counts as a widely copied example.
COPIED = 2
#: Distinct repositories from which a value of one owner counts so too.
WIDE = 10
SALTS, HOT = 64, 1000
_FLAGS = re.ASCII
_ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", _FLAGS)
_HEX = re.compile(r"[0-9a-f]{24,}", _FLAGS)  # a maximal run either has 24 characters or fails as a whole
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?:sk|pk|rk)[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{16,}|gh[opsur]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|[A-Za-z0-9+/_-]{32,}={0,2})(?![A-Za-z0-9+/_=-])", _FLAGS)
_LONG = re.compile(r"[A-Za-z0-9+/_-]{16}", _FLAGS)
_WORDS = ("passw", "secret", "token", "api")


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the three base kinds, by start and then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS) or not low.isascii():
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _LONG.search(text):
        out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def key_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Other credential-like values that meet no base span."""
    out = []
    for m in _KEY.finditer(text) if _LONG.search(text) else ():
        v = m[0]
        mixed = any(c.isdigit() for c in v) and any(c.isupper() for c in v) and any(c.islower() for c in v)
        if mixed and entropy(v) >= 3.5 and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            out.append((m.start(), 3, m.end(), v))
    return out


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """A row for each document: row, id, owner, repo, and spans (kind, start, end, hash)."""
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            rows = []
            for t in batch.column(4).to_pylist():
                base = base_spans(t)
                rows.append([{"start": s, "kind": k, "end": e, "hash": xxhash.xxh64_intdigest(v.encode(), 0) - (1 << 63)} for s, k, e, v in sorted(base + key_spans(t, base))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rows, pa.list_(span))], ["row", "id", "owner", "repo", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), F.coalesce(text_col, F.lit("")))
    return d.mapInArrow(run, f"row long, id {kind}, owner string, repo string, spans array<struct<start: long, kind: int, end: long, hash: long>>")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repos, n): in how many distinct owners and repositories each value stands, and in how many spans."""
    each = found.select("owner", "repo", F.explode("spans.hash").alias("hash"))
    by_place = each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    return by_place.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"), F.sum("n").alias("n"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", copied: int = COPIED, wide: int = WIDE) -> DataFrame:
    """(id, spans): spans of (kind, start, end, owners, repos, live), by start and then kind; ``key`` spans only where they look live."""
    found = materialize(candidates(docs, id_col, text_col, owner_col, repo_col))
    held = materialize(ownership(found))
    total = held.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(held.where(F.col("n") * HOT > total).select("hash", F.lit(SALTS).alias("salts")))  # fewer than HOT rows
    salted = held.join(hot, "hash", "left").select("hash", "owners", "repos", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    each = found.select("row", F.explode("spans").alias("s")).select("row", "s", F.col("s.hash").alias("hash")).join(hot, "hash", "left")
    each = each.select("row", "s", "hash", F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    live = (F.col("owners") < copied) & (F.col("repos") < wide)
    told = each.join(salted, ["hash", "salt"]).select("row", F.struct("s.start", F.col("s.kind").alias("k"), "s.end", "owners", "repos", live.alias("live")).alias("s"))
    told = told.where((F.col("s.k") < 3) | F.col("s.live")).groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    names = F.array(*[F.lit(k) for k in KINDS])
    shaped = F.transform("spans", lambda s: F.struct(F.element_at(names, s["k"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["owners"].alias("owners"), s["repos"].alias("repos"), s["live"].alias("live")))
    none = found.where(F.size("spans") == 0).select("id", F.lit(None).alias("spans"))
    some = found.where(F.size("spans") > 0).select("row", "id").join(told, "row", "left").select("id", shaped.alias("spans"))
    out = some.unionByName(none.select("id", F.col("spans").cast(some.schema["spans"].dataType)))
    return out.select(F.col("id").alias(id_col), F.coalesce("spans", F.array().cast(some.schema["spans"].dataType)).alias("spans"))


def spans_text(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind"] != "key")
    return got.select("doc_id", *counts, F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"))
