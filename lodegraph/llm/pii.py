"""Personal data by weak supervision, in DataFrame functions only.

Spans of four base kinds and of four further kinds (national phone numbers,
social security numbers, bank account numbers, spelled-out e-mail addresses) are
found by their patterns. Four labelers vote on each: its form, a gazetteer of
its kind, cue words before it, and whether it stands alone. How often each
pattern of votes occurs is counted over all documents; expectation-maximisation
on these counts (a bounded table) estimates how reliable each labeler is for each kind
and how likely each span is true, and a logistic classifier is trained on that.
Base spans always stay; further spans stay if they meet no base span and the
classifier holds them true.

Defined results: a null text counts as empty and has no spans; rows that repeat
each keep a row; an empty table has no rows. Where two spans meet in redaction, the text they cover together
becomes one mark of the first's kind.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

KINDS = ("email", "ip", "card", "phone", "tel", "ssn", "iban", "mail")
BASE = 4
#: Code points before a span in which cue words count.
CONTEXT = 40
# Patterns take the same matches as their plain forms, but never go back over what they took, so that very long runs cost no more than their length.
_PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "tel": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,24}+",
}
#: Cheap tests that a text must pass before its kind's pattern is run.
_GATE = {"email": "@", "phone": "+", "mail": "at"}
_RGATE = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{11}", "tel": r"[0-9]{3}[\x20.-][0-9]{4}", "ssn": r"-[0-9]{2}-", "iban": r"[A-Z]{2}[0-9]{2}"}
_CUE = {
    "email": "mail|contact|write|reach|address",
    "ip": r"\bip\b|host|server|address|from|client",
    "card": "card|visa|master|amex|credit|debit|pay",
    "phone": "phone|call|tel|mobile|fax|contact|reach",
    "tel": "phone|call|tel|mobile|fax|contact|reach",
    "ssn": "ssn|social|security|tax",
    "iban": "iban|account|bank|transfer",
    "mail": "mail|contact|write|reach|address",
}
_GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|it|nl|eu|us|ca|ch|at)$",
    "ip": r"^(?!0\.|127\.|10\.|192\.168\.|169\.254\.|2[2-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "tel": r"^\(?[2-9][0-9]{2}",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "mail": r"(?:com|org|net|edu|gov|io|de|fr|es|uk|it|nl|eu)$",
}
_FORM = {
    "email": r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})[\x20.0-9-]*$",
    "tel": r"^(?:\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4})*(?:\x20[A-Z0-9]{1,3})?$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$",
    "mail": r"^[A-Za-z0-9].*[A-Za-z]$",
}


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.ltrim(p, F.lit("0")).try_cast("int")), F.when(F.ltrim(p, F.lit("0")) == "", 0), F.lit(999)) <= 255)
    if kind == "card":
        n = F.length(digits)
        each = F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d, i: F.when((n - 1 - i) % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
        return F.when(n.between(13, 19), F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _found(kind: str, text: Column) -> Column:
    """Spans of one kind: array of (k, start, end, votes, size); votes: two bits a labeler."""
    pattern = F.lit(_PATTERN[kind])
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, _PATTERN[kind], -1)
    # Between the gaps stand the matches, so the lengths of both give each place.
    pairs = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(F.length(g).alias("g"), v.alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,v:string>>").alias("out"))
    placed = F.aggregate(pairs, start, lambda a, p: F.struct((a["at"] + p["g"] + F.length(p["v"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + p["g"]).alias("start"), (a["at"] + p["g"] + F.length(p["v"])).alias("end"), p["v"].alias("v")))).alias("out")), lambda a: a["out"])
    kept = F.filter(placed, lambda s: _valid(kind, s["v"]))

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, 2).otherwise(0)

    def shaped(s: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(s["start"] + 1 - CONTEXT, F.lit(1)), F.least(s["start"], F.lit(CONTEXT))))
        left = F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise(" ")
        right = F.substring(text, s["end"] + 1, F.lit(1))
        form = s["v"].rlike(_FORM[kind])
        listed = F.regexp_replace(s["v"], "[ -]", "").rlike(_GAZETTEER[kind]) if kind in ("card", "iban") else s["v"].rlike(_GAZETTEER[kind])
        alone = left.rlike(r"[\s(\[<\"':;,=]") & ((right == "") | right.rlike(r"[\s)\]>\"':;,.!?]"))
        votes = vote(form, ~form) + 4 * vote(listed, ~listed) + 16 * vote(before.rlike(_CUE[kind]), F.lit(False)) + 64 * vote(alone, ~alone)
        size = F.when(F.length(s["v"]) < 12, 0).when(F.length(s["v"]) < 17, 1).when(F.length(s["v"]) < 25, 2).otherwise(3)
        return F.struct(F.lit(KINDS.index(kind)).alias("k"), s["start"].alias("start"), s["end"].alias("end"), votes.alias("votes"), size.alias("size"))

    empty = F.array().cast("array<struct<k:int,start:int,end:int,votes:int,size:int>>")
    gate = F.contains(text, F.lit(_GATE[kind])) if kind in _GATE else text.rlike(_RGATE[kind])
    return F.coalesce(F.when(gate, F.transform(kept, shaped)), empty)


def candidates(text: Column) -> Column:
    """All spans by kind and start; further kinds only where they meet no base span."""
    base = F.concat(*[_found(k, text) for k in KINDS[:BASE]])
    more = F.concat(*[_found(k, text) for k in KINDS[BASE:]])
    free = F.filter(more, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return F.concat(base, free)


def features(k: int, votes: int, size: int) -> np.ndarray:
    x = np.zeros(len(KINDS) + 8 + 4)
    x[k] = 1
    for i in range(4):
        v = votes >> 2 * i & 3
        if v:
            x[len(KINDS) + 2 * i + v - 1] = 1
    x[len(KINDS) + 8 + size] = 1
    return x


def estimate(cells: dict[tuple[int, int], float], rounds: int = 100) -> dict[tuple[int, int], float]:
    """Probability that spans of each (kind, votes) are true, by expectation-maximisation with a labeler's rates for each kind.

    Rates start from labelers that are right four times in five, and are drawn to that by two pseudo-counts.
    """
    out: dict[tuple[int, int], float] = {}
    for kind in {k for k, _ in cells}:
        own = {v: n for (k, v), n in cells.items() if k == kind}
        votes = np.array([[v >> 2 * i & 3 for i in range(4)] for v in own])
        n = np.array(list(own.values()), float)
        start = np.array([[0.8, 0.2], [0.2, 0.8]])  # [true or not, yes or no]
        rate = np.repeat(start[:, None, :], 4, axis=1)
        prior = 0.7
        for _ in range(rounds):
            log = np.zeros((2, len(n)))
            for i, v in product(range(4), (1, 2)):
                log[:, votes[:, i] == v] += np.log(rate[:, i, v - 1])[:, None]
            x = math.log(prior) - math.log(1 - prior) + log[0] - log[1]
            p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            for side, weight in enumerate((p, 1 - p)):
                for i in range(4):
                    seen = np.array([(weight * n)[votes[:, i] == v].sum() for v in (1, 2)]) + 2 * start[side]
                    rate[side, i] = seen / seen.sum()
            prior = float(np.clip(((p * n).sum() + 1.4) / (n.sum() + 2), 0.01, 0.99))
        out.update({(kind, v): float(q) for v, q in zip(own, p, strict=True)})
    return out


def train(cells: dict[tuple[int, int, int], int]) -> tuple[np.ndarray, float]:
    """(weights, bias) of the span classifier, fitted to the estimated truth of each (kind, votes, size) and its count."""
    if not cells:
        return np.zeros(len(KINDS) + 12), 0.0
    pooled: dict[tuple[int, int], float] = {}
    for (k, v, _), n in cells.items():
        pooled[k, v] = pooled.get((k, v), 0) + n
    truth = estimate(pooled)
    x = np.array([np.r_[features(*c), 1] for c in cells])
    y = np.array([truth[k, v] for k, v, _ in cells])
    n = np.array(list(cells.values()), float)
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + 0.1 * np.eye(len(w)), x.T @ (n * (y - p)) - 0.1 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def detect(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", keep_text: bool = True) -> DataFrame:
    """The documents with a column of spans (kind, start, end, probability), by kind and start; a column of that name gives way.

    Without ``keep_text``, the texts are neither written nor returned.
    """
    marked = docs.withColumn(spans_col, candidates(F.coalesce(text_col, F.lit(""))))
    marked = materialize(marked if keep_text or spans_col == text_col else marked.drop(text_col))
    rows = marked.select(F.explode(F.col(spans_col)).alias("s")).groupBy("s.k", "s.votes", "s.size").count().collect()  # at most 8 x 81 x 4
    w, bias = train({(r["k"], r["votes"], r["size"]): r["count"] for r in rows})
    at = len(KINDS)
    of_kind = F.array(*[F.lit(float(v)) for v in w[:at]])
    of_size = F.array(*[F.lit(float(v)) for v in w[at + 8 :]])
    of_vote = [F.array(F.lit(0.0), F.lit(float(w[at + 2 * i])), F.lit(float(w[at + 2 * i + 1]))) for i in range(4)]

    def told(s: Column) -> Column:
        x = F.lit(bias) + F.element_at(of_kind, s["k"] + 1) + F.element_at(of_size, s["size"] + 1)
        for i in range(4):
            x = x + F.element_at(of_vote[i], F.shiftright(s["votes"], 2 * i).bitwiseAND(F.lit(3)) + 1)
        return F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"), (1 / (1 + F.exp(-x))).alias("probability"))

    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.array_sort(F.filter(F.transform(spans_col, told), lambda s: (s["k"] < BASE) | (s["probability"] >= 0.5)))
    return marked.withColumn(spans_col, F.transform(kept, lambda s: F.struct(F.element_at(names, s["k"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["probability"].alias("probability"))))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <KIND>."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = F.concat(F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(new)).alias("out")))

    done = F.aggregate(by_place, start, step)
    rest = F.substring(text, done["at"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(done["out"], ""), rest)).otherwise(text)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]]
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))
    return got.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
