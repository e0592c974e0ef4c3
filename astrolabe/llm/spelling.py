"""Spelling variant grouping with bidirectional FM-index search schemes.

Words are near if one inserted, deleted or replaced code point turns one into the
other.  Then one half of the longer length is equal in both: the first half as a
beginning, or the second as an end.  So

* a word of length ``c`` is indexed in two places, by the first ``c // 2`` code
  points with its length and by the other half with its length, and asks for near
  words of each length ``c - 1, c, c + 1`` at the places those would be found;
* every group of places is a small vocabulary, written as ``$word$word$`` with its
  suffix ranks in both directions (a bidirectional FM-index: letters as bit rows
  with counts every 64 positions);
* the search scheme matches one half exactly, from its inner end outwards to the
  delimiter, then turns round and extends over the other half with exactly one
  error up to the other delimiter.  The wanted length tells the kind of error, and
  an error in a run of one letter is placed at the run's end, so a word is reached
  once.  For ends, words are read backwards.

All queries of a group move together: a step is a few NumPy operations on arrays
of suffix-rank intervals.  A group returns one row per word with partners - how
many, and the most frequent - so pairs never leave it.  A place that more than
``MOST_WORDS`` words share is cut into parts, and its queries into slices, that
meet part by part.

Forms are followed to the root by doubling: each round joins the table of forms
with itself; counts grow tenfold with each form, so chains are short.

Defined results: a null text has no words; a null identifier is hashed as an empty
one; repeated rows count again; an empty table gives an empty result; other
columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolabe.llm import register
from astrolabe.llm.common import materialise, table, text_of

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form has at least so many times the occurrences of the word.
RATIO = 10
#: One run in so many loses a code point.
NOISE = 31
LETTERS = "a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Indexed words of a group on average, and of one part of a place at most; queries that move together.
GROUP_WORDS = 1 << 13
MOST_WORDS = 1 << 14
QUERY_BATCH, QUERY_CELLS = 1 << 12, 1 << 20

SAME, SHORTER, LONGER = 0, 1, 2    # length of the wanted word against the query's


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """``word, n``: letter runs of all texts (ASCII lower-cased, one in ``noise`` short of a code point) by occurrences."""
    # a run that is too short before the deletion is too short after it
    run = F.regexp_extract_all(F.translate(text_of(F.col(f"`{text_col}`")), UPPER, LOWER),
                               F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(run).alias("run"))
    draw = F.crc32(F.concat_ws(":", "id", "run"))
    at = (F.col("draw") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return (runs.withColumn("draw", draw)
            .select(F.when(F.col("draw") % noise == 0, short).otherwise(F.col("run")).alias("word"))
            .where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


# ---------------------------------------------------------------- index of one group

class _Ranks:
    """Occurrences of each letter before a position of the Burrows-Wheeler text of ``$w0$w1$...$``; code 0 is ``$``."""

    def __init__(self, words: list[str], codes: dict[str, int]):
        words = sorted(words)
        n = len(words)
        text = np.zeros(sum(map(len, words)) + n + 1, dtype=np.int64)
        ends = np.cumsum([0] + [len(w) + 1 for w in words])       # where the delimiters are
        letters = np.ones(len(text), dtype=bool)
        letters[ends] = False
        text[letters] = np.fromiter((codes[c] for w in words for c in w), dtype=np.int64, count=int(letters.sum()))
        last = text[np.roll(np.arange(len(text)), 1)][_suffix_order(text, ends, n)]
        blocks = len(text) // 64 + 1
        self.size, self.letters = len(text), len(codes) + 1
        self.bits = np.zeros((blocks, self.letters), dtype=np.uint64)
        for c in range(self.letters):
            row = np.zeros(blocks * 64, dtype=bool)
            row[:len(last)] = last == c
            self.bits[:, c] = np.packbits(row, bitorder="little").view(np.uint64)
        held = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(held, axis=0) - held
        self.first = np.concatenate([[0], np.cumsum(held.sum(axis=0))[:-1]])

    def count(self, at: np.ndarray) -> np.ndarray:
        """Of every letter, the occurrences before each position."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.bits[block] & mask[:, None])


def _suffix_order(text: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Start of each suffix in order, by doubling.  Delimiters are ordered by the words after them, the last one first."""
    rank = text + n
    rank[ends] = np.r_[np.arange(1, n + 1), 0]
    width = 1
    while True:
        order = np.argsort(rank, kind="stable")
        key = rank[order]
        if len(key) < 2 or (key[1:] != key[:-1]).all():
            return order
        dense = np.empty_like(rank)
        dense[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) + 1
        after = np.zeros_like(rank)
        after[:len(rank) - width] = dense[width:]
        rank = dense * (len(rank) + 2) + after
        width *= 2


class BidirectionalIndex:
    """Distinct words, searched from the middle to both sides."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        self.codes = {c: k + 1 for k, c in enumerate(sorted(set("".join(words))))}
        self.ahead = _Ranks(self.words, self.codes)
        self.back = _Ranks([w[::-1] for w in self.words], self.codes)

    @staticmethod
    def _extend(ranks: _Ranks, low, size, other, letter):
        """Extends matches by a letter: the interval in ``ranks``, its size, and the interval's start in the other direction."""
        start, end = ranks.count(low), ranks.count(low + size)
        held = end - start
        rows = np.arange(len(low))
        below = np.cumsum(held, axis=1) - held
        return ranks.first[letter] + start[rows, letter], held[rows, letter], other + below[rows, letter]

    def _branch(self, low, size, other):
        """The same for every letter at once: rows of matches, columns of letters."""
        start, end = self.back.count(other), self.back.count(other + size)
        held = end - start
        return low[:, None] + np.cumsum(held, axis=1) - held, held, self.back.first + start

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Padded codes with the delimiter after each word; letters that no indexed word has are -1."""
        lens = np.array([len(w) for w in words])
        out = np.zeros((len(words), lens.max() + 1), dtype=np.int64)
        out[np.arange(out.shape[1]) < lens[:, None]] = [self.codes.get(c, -1) for w in words for c in w]
        return out, lens

    def one_error(self, queries: list[str], kinds: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, word)`` numbers: words that begin with the query's first ``exact`` letters and follow the rest
        of it with one error of the query's kind."""
        text, lens = self._encode(queries)
        who = np.arange(len(queries))
        low, size, other = np.zeros_like(who), np.full_like(who, self.ahead.size), np.zeros_like(who)
        # the exact half, from its inner end out to the delimiter
        done = []
        for k in range(int(exact.max()) + 1):
            letter = np.where(k < exact[who], text[who, np.maximum(exact[who] - 1 - k, 0)], 0)
            keep = letter >= 0
            who, low, size, other, letter = who[keep], low[keep], size[keep], other[keep], letter[keep]
            low, size, other = self._extend(self.ahead, low, size, other, letter)
            keep = size > 0
            who, low, size, other = who[keep], low[keep], size[keep], other[keep]
            over = exact[who] == k
            done.append((who[over], low[over], size[over], other[over]))
            who, low, size, other = who[~over], low[~over], size[~over], other[~over]
        who, low, size, other = (np.concatenate(x) for x in zip(*done))
        # the other half: matches without an error go on, and branch into those that have it
        at = exact[who].copy()
        erred = []
        while len(who):
            here, after = text[who, at], text[who, np.minimum(at + 1, lens[who])]
            kind, left = kinds[who], lens[who] - at
            lows, sizes, others = self._branch(low, size, other)
            allowed = (sizes > 0) & ((kind != SHORTER) & ((left > 0) | (kind == LONGER)))[:, None]
            allowed[:, 0] = False
            allowed[np.arange(len(who)), np.maximum(here, 0)] = False
            row, letter = np.nonzero(allowed)
            erred.append((who[row], lows[row, letter], sizes[row, letter], others[row, letter], at[row] + (kind[row] == SAME)))
            skip = (kind == SHORTER) & (left > 0) & (after != here)
            erred.append((who[skip], low[skip], size[skip], other[skip], at[skip] + 1))
            rows = np.arange(len(who))
            goes = (left > 0) & (here >= 0)
            goes[goes] = sizes[rows[goes], here[goes]] > 0
            rows, letter = rows[goes], here[goes]
            who, low, size, other, at = who[rows], lows[rows, letter], sizes[rows, letter], others[rows, letter], at[rows] + 1
        if not erred:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        who, low, size, other, at = (np.concatenate(x) for x in zip(*erred))
        found = []
        while len(who):     # the rest exactly, with the delimiter last
            letter, ends = text[who, at], at == lens[who]
            keep = letter >= 0
            who, low, size, other, at, letter, ends = (x[keep] for x in (who, low, size, other, at, letter, ends))
            other, size, low = self._extend(self.back, other, size, low, letter)
            keep = size > 0
            found.append((who[keep & ends], low[keep & ends]))
            keep &= ~ends
            who, low, size, other, at = who[keep], low[keep], size[keep], other[keep], at[keep] + 1
        who, low = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2
        return who, low - 1      # the first suffix is the last delimiter


def _group_partners(part: pd.DataFrame) -> pd.DataFrame:
    """One group: rows ``side, asks, word, n, wanted`` to ``word, partners, most, best`` of the words that have partners."""
    backward = bool(part["side"].iloc[0])
    indexed, asking = part[~part["asks"]], part[part["asks"]]
    out: dict[str, list] = {"word": [], "partners": [], "most": [], "best": []}
    if len(indexed) and len(asking):
        names, counts = indexed["word"].tolist(), indexed["n"].to_numpy()
        read = [w[::-1] for w in names] if backward else names
        index = BidirectionalIndex(read)
        row_of = np.array(sorted(range(len(read)), key=read.__getitem__))    # of the index's words
        spelled = np.empty(len(names), dtype=np.int64)   # row -> place among the words as they are spelled
        spelled[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        words, wanted = asking["word"].tolist(), asking["wanted"].to_numpy()
        lens = np.array([len(w) for w in words])
        kinds = np.select([wanted == lens, wanted < lens], [SAME, SHORTER], LONGER)
        longer = np.maximum(wanted, lens)
        exact = longer - longer // 2 if backward else longer // 2
        order = np.argsort(lens, kind="stable")          # words of about one length move together
        for pick in _batches(order, lens):
            who, found = index.one_error([words[i][::-1] if backward else words[i] for i in pick], kinds[pick], exact[pick])
            who, found = pick[who], row_of[found]
            if backward:    # what the first half finds too
                new = np.array([kinds[q] == SAME or words[q][:longer[q] // 2] != names[f][:longer[q] // 2]
                                for q, f in zip(who.tolist(), found.tolist())], dtype=bool)
                who, found = who[new], found[new]
            best = np.lexsort((spelled[found], -counts[found], who))
            who, found = who[best], found[best]
            head = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, dtype=np.int64)
            out["word"] += [words[q] for q in who[head]]
            out["partners"] += np.diff(np.r_[head, len(who)]).tolist()
            out["most"] += counts[found[head]].tolist()
            out["best"] += [names[f] for f in found[head]]
    return pd.DataFrame(out)


def _batches(order: np.ndarray, lens: np.ndarray):
    """Runs of ``order`` (ascending lengths) of at most ``QUERY_BATCH`` words and, but for single ones, ``QUERY_CELLS`` padded letters."""
    k = 0
    while k < len(order):
        ahead = lens[order[k:k + QUERY_BATCH]]
        fits = np.arange(1, len(ahead) + 1) * (ahead + 1) <= QUERY_CELLS
        n = max(1, int(np.argmin(fits)) if not fits.all() else len(ahead))
        yield order[k:k + n]
        k += n


# ---------------------------------------------------------------- the Spark job

def _places(words: DataFrame) -> DataFrame:
    """``side, asks, place, word, n, wanted``: where each word is indexed, and where it asks for words of ``wanted`` letters."""
    def halves(length: Column):
        first = F.floor(length / 2).cast("int")
        ends = F.substring("word", F.length("word") - (length - first) + 1, length - first)
        return [(0, F.substring("word", F.lit(1), first)), (1, ends)]

    size = F.length("word")
    rows = []
    for asks, length in ((False, size), (True, size - 1), (True, size), (True, size + 1)):
        for side, half in halves(length):
            rows.append(F.struct(F.lit(side).alias("side"), F.lit(asks).alias("asks"), length.alias("wanted"),
                                 F.xxhash64(F.lit(side), length, half).alias("place")))
    return words.select("word", "n", F.explode(F.array(*rows)).alias("x")).select("word", "n", "x.*")


def partners(words: DataFrame) -> DataFrame:
    """``word, n`` to ``word, partners, most, best`` for words with near words (several rows per word, to be added up)."""
    total = words.count()
    places = _places(words)
    crowded = (places.groupBy("place").agg(F.count_if(~F.col("asks")).alias("held"), F.count_if("asks").alias("asking"))
               .where((F.col("held") > MOST_WORDS) | (F.col("asking") > 8 * MOST_WORDS))
               .select("place", F.ceil(F.col("held") / MOST_WORDS).cast("int").alias("parts"),
                       F.ceil(F.col("asking") / (8 * MOST_WORDS)).cast("int").alias("slices")))
    cut = places.join(crowded, "place", "left")
    draw = lambda n: F.pmod(F.xxhash64(F.lit("part"), "word", "wanted"), F.greatest(n, F.lit(1))).cast("int") + 1
    spread = lambda n: F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    cut = (cut.withColumn("part", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("asks"), spread(F.col("parts")))
                                            .otherwise(F.array(draw(F.col("parts"))))))
           .withColumn("slice", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("asks"), F.array(draw(F.col("slices"))))
                                          .otherwise(spread(F.col("slices"))))))
    groups = max(1, 2 * total // GROUP_WORDS)
    return (cut.withColumn("grp", F.pmod("place", F.lit(groups)))
            .select("side", "grp", "part", "slice", "asks", "word", "n", "wanted")
            .groupBy("side", "grp", "part", "slice")
            .applyInPandas(lambda part: _group_partners(part), "word string, partners long, most long, best string"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, n`` (distinct words) to ``word, form, root, n, n_near, form_n``."""
    words = materialise(words, "spelling-words")
    none = F.lit(None)
    both = words.select("word", "n", F.lit(0).cast("long").alias("partners"), none.cast("long").alias("most"), none.cast("string").alias("best"))
    both = both.unionByName(partners(words).select("word", none.cast("long").alias("n"), "partners", "most", "best"))
    # most frequent first, then smallest in code-point order
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("most")).alias("most"), F.col("best").alias("word"))))
    formed = (both.groupBy("word").agg(F.max("n").alias("n"), F.sum("partners").alias("n_near"), best.alias("near"))
              .withColumn("is_form", F.coalesce(-F.col("near.most") >= ratio * F.col("n"), F.lit(False)))
              .select("word", F.when(F.col("is_form"), F.col("near.word")).alias("form"), "n", "n_near",
                      F.when(F.col("is_form"), -F.col("near.most")).alias("form_n")))
    formed = materialise(formed, "spelling-forms")
    roots = _roots(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """``word, root`` with each root followed to the last one: every round doubles the steps."""
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(ahead, "root", "left")
        links = materialise(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if links.where("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


@register("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its more frequent spelling, and the last one of that chain."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))
