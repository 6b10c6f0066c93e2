"""BPE encoding and decoding by tree concatenation.

A text that is too long for one call is cut in halves, and these again, down to
leaves that are encoded in parallel (each leaf is a row of its own). Going up
the tree, two neighbours are joined by encoding a window around the join again.
The window grows on the left until its first piece is the one that the left
side has there, and on the right likewise; then everything outside it stands.
A single word that no pre-tokenizer splits is treated in the same way on the
level of merges: halves are merged apart, and a window of tokens around the
join is merged again until its outer pairs of tokens are pairs that BPE leaves
as they are when it sees the two alone. Such a word may be longer than a leaf:
a side whose last word is still open carries that word's tokens as what is not
the end of a word, and two sides are joined by the same window of tokens, so
what the leaves encoded in parallel is not encoded again. (A long word with
characters that normalization may compose is encoded again as a whole.)

The pieces between white space are encoded by the tokenizer itself and kept in
a bounded memo, as they do not depend on what stands around them (the
vocabulary's pre-tokenizer drops white space and its added tokens hold none).

Defined results: a null text counts as empty; the empty text has no ids and the
empty decoded text. Rows that repeat each keep a row. Strings of special tokens
in a text are encoded as those tokens, as the library does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Texts over this many code points go through leaves in rows of their own.
LONG_TEXT, LEAF = 65_536, 16_384
#: Words over this many code points are merged as a tree.
LONG_WORD, WORD_LEAF = 512, 128
#: Entries of the memo of words; when it is full, others are encoded with each text.
MEMO = 400_000
_SPACE = b"\t\n\x0b\x0c\r "

_loaded: dict[str, Pieces] = {}


class Pieces:
    """Encodes what stands between white space; holds the tokenizer of a path."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        #: The same merges for what is not the end of a word.
        self.inner = BPE(vocab=model["vocab"], merges=merges)
        self.model = self.tokenizer.model
        self.name = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.id_text = {i: f" {i}" for i in self.name}
        self.name_text = {i: f" {t}" for i, t in self.name.items()}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Memo of pre-tokens: ids as text and decoded text, a space before each id and token.
        self.id_memo: dict[str, str] = {}
        self.name_memo: dict[str, str] = {}
        self.bulk = Tokenizer(self.model)
        self.bulk.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = {i for i, t in self.name.items() if self.suffix and t.endswith(self.suffix)}
        # What the pre-tokenizer makes of a text that the normalizer only puts in lower case.
        self.plain = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-zß-öø-ÿ0-9]+")
        self.letter = re.compile(r"[a-zß-öø-ÿ]+")
        self.odd = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")
        spec_ok = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.direct = spec_ok and self.suffix == "</w>" and spec.get("decoder") is None and "[\\p{L}]+|[\\p{N}]|" in json.dumps(spec.get("pre_tokenizer")).replace("\\\\", "\\")
        bs = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in bs]
        self.symbol = {b: chr(b) for b in bs} | {b: chr(256 + n) for n, b in enumerate(rest)}

    def learn(self, words: set[str]) -> tuple[dict[str, str], dict[str, str]]:
        """(ids as text, decoded text) of pre-tokens, by one call for all."""
        ids_of, names_of, short = {}, {}, []
        for w in words:
            symbols = "".join(map(self.symbol.__getitem__, w.encode()))
            if len(symbols) > LONG_WORD:
                ids_of[w], names_of[w], _ = self.told(self.tree(symbols))
            else:
                short.append((w, symbols))
        ids = self.bulk.encode_batch_fast([" ".join([s for _, s in short])], add_special_tokens=False)[0].ids
        start = n = 0
        for at, i in enumerate(ids, 1):
            if i in self.ends:
                own, start = ids[start:at], at
                w = short[n][0]
                ids_of[w], names_of[w] = "".join([self.id_text[x] for x in own]), "".join([self.name_text[x] for x in own])
                n += 1
        return ids_of, names_of

    def told(self, ids: list[int]) -> tuple[str, str, int]:
        return ("".join([self.id_text[i] for i in ids]), "".join([self.name_text[i] for i in ids]), len(ids))

    def part(self, symbols: str, last: bool) -> list[int]:
        return [t.id for t in (self.model if last else self.inner).tokenize(symbols)] if symbols else []

    def fits(self, a: int, b: int, last: bool) -> bool:
        """Whether BPE leaves the two tokens as they are when it sees them alone."""
        x, y = self.name[a], self.name[b]
        return self.part(x + (y.removesuffix(self.suffix) if last else y), last) == [a, b]

    def tree(self, symbols: str, last: bool = True) -> list[int]:
        if len(symbols) <= WORD_LEAF:
            return self.part(symbols, last)
        cut = len(symbols) // 2
        return self.joined(self.tree(symbols[:cut], False), self.tree(symbols[cut:], last), last)

    def joined(self, left: list[int], right: list[int], last: bool) -> list[int]:
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            ends = last and j == len(right)
            window = "".join(self.name[t] for t in left[len(left) - i :]) + "".join(self.name[t] for t in right[:j])
            mid = self.part(window.removesuffix(self.suffix) if ends else window, ends)
            before, after = left[: len(left) - i], right[j:]
            ok_left = not before or self.fits(before[-1], mid[0], ends and len(mid) == 1)
            ok_right = not after or self.fits(mid[-1], after[0], last and len(after) == 1)
            if ok_left and ok_right:
                return before + mid + after
            i, j = i if ok_left else 2 * i, j if ok_right else 2 * j

    def letters(self, word: bytes) -> str | None:
        """The symbols of a word of plain letters, which no pre-tokenizer splits and any letter may follow; else None."""
        if not self.direct:
            return None
        text = word.decode("utf-8", "surrogatepass")
        if self.odd.search(text) or not self.letter.fullmatch(low := text.lower()):
            return None
        return "".join(map(self.symbol.__getitem__, low.encode()))

    def plain_text(self, text: str) -> tuple[str, str, int] | None:
        """(ids as text, decoded text, number of ids), if the normalizer only puts this text in lower case."""
        if not self.direct or self.odd.search(text) or "<|" in text:
            return None
        words = self.plain.findall(text.lower())
        ids_of, names_of = self.id_memo, self.name_memo
        if new := set(words).difference(ids_of):
            own = self.learn(new)
            if len(ids_of) < MEMO:
                ids_of.update(own[0])
                names_of.update(own[1])
            else:
                ids_of, names_of = {w: ids_of.get(w) or own[0][w] for w in set(words)}, {w: names_of.get(w) or own[1][w] for w in set(words)}
        ids = "".join(map(ids_of.__getitem__, words))
        return ids, "".join(map(names_of.__getitem__, words)), ids.count(" ")

    def piece(self, piece: bytes) -> tuple[str, str, int]:
        """The same of what stands between white space."""
        text = piece.decode("utf-8", "surrogatepass")
        return self.plain_text(text) or self.told(self.tokenizer.encode(text, add_special_tokens=False).ids)


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(text: str, p: Pieces) -> tuple[str, str, int]:
    """(ids joined by a space, decoded text, number of ids) of a text that is not too long for one call."""
    got = p.plain_text(text)
    if got is not None:
        return got[0][1:], got[1][1:], got[2]
    got = [p.piece(w) for w in text.encode("utf-8", "surrogatepass").split()]
    return "".join([g[0] for g in got])[1:], "".join([g[1] for g in got])[1:], sum([g[2] for g in got])


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    """Halves of halves, none over a leaf. A cut may be anywhere, within words too."""
    if len(text) <= leaf:
        return [text]
    cut = len(text) // 2
    return leaves(text[:cut], leaf) + leaves(text[cut:], leaf)


class Side:
    """An encoded stretch of text: pieces with their ids, whether white space stands at its ends, and the tokens of a long last word that may go on."""

    def __init__(self, text: str, p: Pieces):
        raw = text.encode("utf-8", "surrogatepass")
        self.words = raw.split()
        self.open = (bool(raw) and raw[0] not in _SPACE, bool(raw) and raw[-1] not in _SPACE)
        self.got = []
        self.going: list[int] | None = None
        for n, w in enumerate(self.words):
            at_end = (n == 0 and self.open[0]) or (n == len(self.words) - 1 and self.open[1])
            symbols = p.letters(w) if at_end and len(w) > WORD_LEAF else None
            if symbols is None:
                self.got.append(p.piece(w))
                continue
            cut = len(symbols) // 2
            left, right = p.tree(symbols[:cut], False), symbols[cut:]
            self.got.append(p.told(p.joined(left, p.tree(right), True)))
            if n == len(self.words) - 1 and self.open[1]:
                self.going = p.joined(left, p.tree(right, False), False)


def _word_goes_on(left: Side, right: Side, p: Pieces) -> Side | None:
    """The two joined by a window of tokens, if one word of letters, long on one side at least, stands across the join."""
    if not (left.words and right.words and left.open[1] and right.open[0]) or max(len(left.words[-1]), len(right.words[0])) <= WORD_LEAF:
        return None
    first = p.letters(right.words[0])
    going = left.going
    if going is None and first is not None and len(left.words[-1]) <= WORD_LEAF and (symbols := p.letters(left.words[-1])) is not None:
        going = p.tree(symbols, False)
    if first is None or going is None:
        return None
    own = [int(i) for i in right.got[0][0].split()]
    whole = p.told(p.joined(going, own, True))
    if len(right.words) == 1:
        right.going = p.joined(going, right.going if right.going is not None else p.tree(first, False), False) if right.open[1] else None
    right.got = [*left.got[:-1], whole, *right.got[1:]]
    right.words = [*left.words[:-1], left.words[-1] + right.words[0], *right.words[1:]]
    right.open = (left.open[0], right.open[1])
    return right


def concatenated(left: Side, right: Side, p: Pieces) -> Side:
    """Join two neighbours; the window holds one piece of each side, or tokens of a long word, and grows until both sides agree."""
    if not left.words and not left.open[1]:
        right.open = (left.open[0], right.open[1]) if left.open != (False, False) else (False, right.open[1])
        return right
    if (done := _word_goes_on(left, right, p)) is not None:
        return done
    n = m = 1
    while True:
        n, m = min(n, len(left.words)), min(m, len(right.words))
        a, b = left.words[len(left.words) - n :], right.words[:m]
        glue = b"" if left.open[1] and right.open[0] else b" "
        window = (b" ".join(a) + glue + b" ".join(b)).split()
        got = [p.piece(w) for w in window]
        before, after = left.words[: len(left.words) - n], right.words[m:]
        # Outside the window all stands once its outer pieces are those that the sides had, or the sides have nothing more.
        ok_left = not before or (n > 1 and got[0] == left.got[len(left.words) - n])
        ok_right = not after or (m > 1 and got[-1] == right.got[m - 1])
        if ok_left and ok_right:
            if len(right.words) <= 1:
                # The last word has become another, or ends before white space.
                symbols = p.letters(window[-1]) if window and right.open[1] and len(window[-1]) > WORD_LEAF else None
                right.going = None if symbols is None else p.tree(symbols, False)
            right.words, right.got = before + window + after, left.got[: len(left.words) - n] + got + right.got[m:]
            right.open = (left.open[0], right.open[1])
            return right
        n, m = n if ok_left else 2 * n, m if ok_right else 2 * m


def tree_encoded(parts: list[str], p: Pieces) -> tuple[str, str, int]:
    """Join the leaves of a text, neighbours first, in as many rounds as the tree has levels."""
    sides = [Side(t, p) for t in parts if t]
    while len(sides) > 1:
        sides = [concatenated(sides[n], sides[n + 1], p) if n + 1 < len(sides) else sides[n] for n in range(0, len(sides), 2)]
    got = sides[0].got if sides else []
    return "".join(g[0] for g in got)[1:], "".join(g[1] for g in got)[1:], sum(g[2] for g in got)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, digests: bool = False) -> DataFrame:
    """Ids and decoded text of every text: id, ``ids`` (array<int>), ``decoded``, ``n_tokens``; with digests, their hashes instead.

    Long texts are cut into leaves, rows of a table dealt evenly over the tasks;
    what returns for a document is as long as its text. The file at ``path``
    must be readable by the executors.
    """
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()
    values = (pa.int64(), pa.string(), pa.string()) if digests else (pa.int64(), pa.list_(pa.int32()), pa.string())
    schema = f"id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    names = ["id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]

    def shaped(got: tuple[str, str, int]) -> tuple:
        return (got[2], _sha(got[0]), _sha(got[1])) if digests else (got[2], np.fromstring(got[0], np.int32, sep=" "), got[1])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in slices(batches, 1):
            rows = [shaped(encoded(t, p)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], values[n]) for n in range(3))], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, i, t in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                parts = leaves(t)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts)), pa.array([i] * len(parts), batch.schema.field(1).type), pa.array(range(len(parts)), pa.int32()), pa.array(parts)], ["row", "id", "n", "text"])

    def warm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encode each leaf; what it holds travels as its pieces' ids."""
        p = pieces(path)
        for batch in slices(batches, 3):
            texts = batch.column(3).to_pylist()
            sides = [Side(t, p) for t in texts]
            coded = ["\n".join(f"{g[0][1:]}\t{g[1][1:]}" for g in s.got) for s in sides]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coded), pa.array([s.going for s in sides], pa.list_(pa.int32()))], ["row", "id", "n", "text", "coded", "going"])

    def joined(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        p = pieces(path)
        rows = rows.sort_by("n")
        sides = []
        for t, coded, going in zip(*(rows.column(c).to_pylist() for c in ("text", "coded", "going")), strict=True):
            if t:
                sides.append(_side(t, coded, going))
        while len(sides) > 1:
            sides = [concatenated(sides[n], sides[n + 1], p) if n + 1 < len(sides) else sides[n] for n in range(0, len(sides), 2)]
        got = sides[0].got if sides else []
        out = shaped(("".join(g[0] for g in got)[1:], "".join(g[1] for g in got)[1:], sum(g[2] for g in got)))
        return pa.Table.from_arrays([rows.column("id")[:1], *(pa.array([out[n]], values[n]) for n in range(3))], names=names)

    d = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    near = d.where(F.length("text") <= LONG_TEXT).mapInArrow(short, schema)
    far = d.where(F.length("text") > LONG_TEXT).select(F.concat_ws(":", F.monotonically_increasing_id(), F.xxhash64("text")).alias("row"), "id", "text")
    far = far.mapInArrow(cut, f"row string, id {kind}, n int, text string").repartition("row", "n").mapInArrow(warm, f"row string, id {kind}, n int, text string, coded string, going array<int>")
    far = far.groupBy("row").applyInArrow(joined, schema)
    return near.unionByName(far).withColumnRenamed("id", id_col)


def _side(text: str, coded: str, going: list[int] | None) -> Side:
    side = Side.__new__(Side)
    side.going = going
    raw = text.encode("utf-8", "surrogatepass")
    side.words = raw.split()
    side.open = (raw[0] not in _SPACE, raw[-1] not in _SPACE)
    side.got = []
    for line in coded.split("\n") if side.words else []:
        ids, _, dec = line.partition("\t")
        side.got.append((f" {ids}" if ids else "", f" {dec}" if dec else "", len(ids.split())))
    return side


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digests=True)
