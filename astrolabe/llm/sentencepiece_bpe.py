"""SentencePiece (merge type) encoding by a prefix table, and decoding.

For every prefix of a text there is exactly one last token of its encoding.  The
table is filled from left to right: an automaton over the vocabulary reports all
pieces that end at a position, and the last token is the one piece that is
compatible with the last token of the prefix before it.  Two adjacent tokens are
compatible if merging their joined text again gives the same two tokens; this
is found by undoing their merges from the latest one back and looking for a
merge across the border that would have come earlier.  The ids are recovered
backwards from the end of the table.

A text is cut where no piece can span (before a space that follows another
character, between letters or digits and others, around line ends and characters
that no piece holds; the vocabulary is checked for it), so equal words are
encoded once per worker and then looked up; the memo is bounded and only saves
work.  Pieces of spaces alone share one score, so their order of merging is by
place, not by rank: their prefix table has a closed form.

Defined results: a null text is an empty one; characters outside the vocabulary
become their UTF-8 byte pieces; the end id closes every row; an empty table
gives an empty result.  Rows are independent, so equal rows and other columns
need no care; identifiers pass through as text and keep their type.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolabe.llm import register
from astrolabe.llm.common import table, text_batches

GAP = "▁"  # the piece character of a space (fixed value)
MEMO_WORDS = 200_000
MEMO_PAIRS = 500_000
MEMO_CHARS = 48


class PrefixTable:
    """Encoder and decoder for one model file (byte fallback, identity normaliser, dummy prefix)."""

    def __init__(self, model_path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        self.eos = sp.eos_id()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bytes_at = {int(self.pieces[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes_at.items()}
        self.hidden = {i for i in range(size) if sp.is_control(i)}
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        # merge order: better score first; single characters come before any merge
        order = sorted((i for i in normal if len(self.pieces[i]) > 1 and set(self.pieces[i]) != {GAP}),
                       key=lambda i: -sp.get_score(i))
        self.rank = {i: k for k, i in enumerate(order, 1)}
        scores = [sp.get_score(i) for i in order]
        if any(a == b for a, b in zip(scores, scores[1:])):
            raise ValueError("two pieces share a score: their merges would go by place, not by rank")
        self.rank.update((i, 0) for i in normal if len(self.pieces[i]) == 1)
        self.runs = {len(self.pieces[i]): i for i in normal if set(self.pieces[i]) == {GAP}}
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for i in self.rank:
            piece = self.pieces[i]
            if len(piece) > 1:
                merged = self._merge(piece)
                if merged is None:
                    continue  # no text ever encodes to this piece
                self.halves[i] = merged
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        if any(len(_CUT.findall(p)) > 1 for p in self.ids):
            raise ValueError("a piece spans a place where texts are cut")
        self.letters = {p for p in self.ids if len(p) == 1}
        self.foreign = re.compile("[^" + re.escape("".join(sorted(self.letters))) + "]").search
        self.length = [len(p) for p in self.pieces]
        self.shown = ["" if i in self.hidden else p.replace(GAP, " ") for i, p in enumerate(self.pieces)]
        self.decimal = [str(i) for i in range(size)]
        self.compatible: dict[int, bool] = {}
        self.memo = Memo(self)

    def _merge(self, piece: str) -> tuple[int, int] | None:
        """The two tokens that the last merge of ``piece`` joins; None if merging stops before."""
        parts = list(piece)
        while len(parts) > 2:
            best = min((self.rank.get(self.ids.get(a + b, -1), 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 30:
                return None
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        left, right = (self.ids.get(p) for p in parts)
        return None if left is None or right is None else (left, right)

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the joined text is again ``left, right``.

        Walks back from the two tokens to their touching ends, latest merge first.
        A merge across the border happens unless both touching parts had been
        merged away before it (``bound``: the rank of the merge just undone; at an
        equal rank the left place wins).
        """
        rank, halves, pieces, ids = self.rank, self.halves, self.pieces, self.ids
        bound = 1 << 30
        while True:
            across = ids.get(pieces[left] + pieces[right])
            if across is not None and rank.get(across, 1 << 30) < bound:
                return False
            # undo the later merge; an equal rank merged on the left first, so the right is undone first
            if rank[left] > rank[right]:
                bound = rank[left]
                left = halves[left][1]
            elif rank[right]:
                bound = rank[right] + 1
                right = halves[right][0]
            else:
                return True

    def _word(self, text: str) -> list[int]:
        """Ids of a text whose characters all have pieces and that holds at most one space, its first."""
        direct = self.ids.get(text)
        if direct is not None and (direct in self.halves or len(text) == 1):
            return [direct]
        last = [0] * len(text)
        compatible, length, size = self.compatible, self.length, len(self.pieces)
        for end, token in self.automaton.iter(text):
            if last[end]:
                continue  # found already: no other piece can be the last token here
            start = end - length[token]  # index of the prefix before the token
            if start < 0:
                last[end] = token
                continue
            pair = last[start] * size + token
            known = compatible.get(pair)
            if known is None:
                known = compatible[pair] = self.fits(last[start], token)
            if known:
                last[end] = token
        out, at = [], len(text) - 1
        while at >= 0:
            token = last[at]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    def _spaces(self, count: int) -> list[int]:
        """Ids of a run of spaces: the leftmost pair whose joined length is a piece merges, again and again."""
        parts: list[int] = []
        for _ in range(count):
            parts.append(1)
            while len(parts) > 1 and parts[-2] + parts[-1] in self.runs:
                last = parts.pop()
                parts[-1] += last
        return [self.runs[n] if n > 1 else self.ids[GAP] for n in parts]

    def _ids(self, word: str) -> list[int]:
        if word[0] != GAP:
            return self._word(word)
        gaps = len(word) - len(word.lstrip(GAP))
        body = self._word(word[gaps - 1:])
        if body[0] == self.ids[GAP]:
            return self._spaces(gaps) + body[1:]
        return self._spaces(gaps - 1) + body

    def encode_word(self, word: str) -> list[int]:
        """Ids of one uncut stretch: spaces in front only, or characters that no piece holds."""
        if not self.foreign(word):
            return self._ids(word)
        out: list[int] = []
        for known, stretch in _runs(word, self.letters):
            out += self._ids(stretch) if known else [self.bytes_at[b] for b in stretch.encode("utf-8")]
        return out

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for word in words(text):
            ids += self.encode_word(word)
        return ids + [self.eos]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: pieces joined, byte pieces read as UTF-8, without the space put in front."""
        text = self._text(ids)
        return text[1:] if text.startswith(" ") else text

    def _text(self, ids: list[int]) -> str:
        byte_of = self.byte_of
        if byte_of.keys().isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        out, raw = [], bytearray()
        for i in ids:
            if i in byte_of:
                raw.append(byte_of[i])
                continue
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
            out.append(self.shown[i])
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def lines(self, text: str) -> tuple[int, str, str]:
        """``(number of ids, ids in decimal, decoded text)`` of one whole text, by the memo."""
        stretches = words(text)
        counts, ids, decoded = zip(*map(self.memo.__getitem__, stretches)) if stretches else ((), (), ())
        self.memo.trim()
        plain = "".join(decoded)
        return sum(counts) + 1, " ".join([*ids, str(self.eos)]), plain[1:] if plain.startswith(" ") else plain

    def digest(self, text: str) -> tuple[int, str, str]:
        """``(number of ids, SHA-256 of the ids, SHA-256 of the decoded text)`` of one whole text."""
        count, line, plain = self.lines(text)
        return count, _sha256(line), _sha256(plain)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


class Memo(dict):
    """Stretch to ``(number of ids, ids in decimal, decoded text)``: two generations of bounded size."""

    def __init__(self, table: PrefixTable) -> None:
        super().__init__()
        self.table, self.old = table, {}

    def __missing__(self, word: str) -> tuple[int, str, str]:
        known = self.old.get(word)
        if known is None:
            ids = self.table.encode_word(word)
            known = (len(ids), " ".join([self.table.decimal[i] for i in ids]), self.table._text(ids))
        if len(word) <= MEMO_CHARS:
            self[word] = known
        return known

    def trim(self) -> None:
        if len(self) >= MEMO_WORDS:
            self.old = dict(self)
            self.clear()
        if len(self.table.compatible) >= MEMO_PAIRS:
            self.table.compatible.clear()


# spaces, then word characters or others; the vocabulary uses _ and ² as others
_CUT = re.compile(rf"{GAP}*[^\W_²]+|{GAP}*(?:[^\w{GAP}\n]|[_²])+|{GAP}+|\n+")


def words(text: str) -> list[str]:
    """Stretches that no piece spans, after the space in front is added; none for an empty text."""
    return _CUT.findall(GAP + text.replace(" ", GAP)) if text else []


def _runs(word: str, letters: set[str]) -> Iterator[tuple[bool, str]]:
    start = 0
    for k in range(1, len(word) + 1):
        if k == len(word) or (word[k] in letters) != (word[start] in letters):
            yield word[start] in letters, word[start:k]
            start = k


_TABLES: dict[str, PrefixTable] = {}


def prefix_table(model_path: str) -> PrefixTable:
    """The worker's table for a model file (built once per Python worker)."""
    if model_path not in _TABLES:
        _TABLES[model_path] = PrefixTable(model_path)
    return _TABLES[model_path]


def default_model() -> str:
    """Path of the public tokenizer's model; every node has the package that names it."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


#: Rows handed back at once, which bounds a worker's memory.
SLICE_ROWS = 256


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
                     model_path: str | None = None) -> DataFrame:
    """``id``, the columns ``carry``, and ``n_tokens, ids, ids_sha256, decoded, decoded_sha256`` per row."""
    def row(table_: PrefixTable, text: str) -> tuple:
        count, line, plain = table_.lines(text)
        return count, np.fromstring(line, dtype=np.int32, sep=" "), _sha256(line), plain, _sha256(plain)

    return _mapped(docs, id_col, text_col, carry, model_path, row, "n_tokens long, ids array<int>, ids_sha256 string, "
                                                                   "decoded string, decoded_sha256 string")


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
                     model_path: str | None = None) -> DataFrame:
    """``id``, the columns ``carry``, and ``n_tokens, ids_sha256, decoded_sha256`` per row, without ids and text."""
    return _mapped(docs, id_col, text_col, carry, model_path, PrefixTable.digest,
                   "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...], model_path: str | None, row,
            columns: str) -> DataFrame:
    """Identifier and carried columns cross to Python as text and get their types back."""
    kept = [f"c{k}" for k in range(len(carry))]
    names = [c.split()[0] for c in columns.split(", ")]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = prefix_table(model_path or default_model())
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                part = batch.iloc[at:at + SLICE_ROWS]
                made = pd.DataFrame([row(table_, t or "") for t in part["text"]], columns=names, index=part.index)
                yield pd.concat([part[["id", *kept]], made], axis=1)

    text_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(f"`{c}`").cast("string").alias(k) for c, k in zip(carry, kept)])
    out = base.mapInPandas(kernel, ", ".join(["id string", *[f"{k} string" for k in kept], columns]))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias("id"),
                      *[F.col(k).cast(docs.schema[c].dataType).alias(c) for c, k in zip(carry, kept)], *names)


@register("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of every document's ids and decoded text."""
    return digest_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
