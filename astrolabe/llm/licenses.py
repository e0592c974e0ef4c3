"""License scan by conditional compression.

Candidate blocks are cut out of a text: stretches of words around pairs of
neighbouring words that some template holds, as far as a finding with that pair can
reach.  A block is compressed alone and with each template that has such a pair in it
as a Zstandard raw dictionary; the templates are ranked by how many bytes that saves.
In this order, without a cut, they are held against the block's exact wording, and the
first whose words stand there nearly all in order is the finding, with the exact
differences.  After a finding the rest of the block is searched again, so a block with
several wordings gives them all.

Texts that cannot hold any template are passed over: of a template's rarest words, one
more than may be missing, at least one must be in the text.

Defined results: null, empty and wordless texts have no finding; findings of a
document are numbered by place; a block longer than a window is searched in
overlapping windows, so nothing is cut off; equal rows are separate rows; of
templates that save as much, the closer wording, then the name, wins; templates have
at least two words; an empty table gives an empty result; only identifier and text are
read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolabe.llm import register
from astrolabe.llm.common import table, text_batches

# Public license notices.
TEMPLATES = {
    "MIT/statement": "released under the mit license",
    "MIT/licensed": "licensed under the mit license",
    "MIT/text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                "documentation files the software to deal in the software without restriction including without limitation "
                "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
                "permit persons to whom the software is furnished to do so subject to the following conditions",
    "Apache-2.0/statement": "licensed under the apache license version 2.0",
    "Apache-2.0/header": "licensed under the apache license version 2.0 the license you may not use this file except in "
                         "compliance with the license you may obtain a copy of the license at",
    "GPL-3.0/statement": "licensed under the gnu general public license version 3",
    "GPL/header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                  "public license as published by the free software foundation",
    "BSD/conditions": "redistribution and use in source and binary forms with or without modification are permitted provided "
                      "that the following conditions are met",
    "MPL-2.0/header": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "CC-BY-4.0": "licensed under cc by 4.0",
    "CC-BY-SA-4.0": "licensed under cc by-sa 4.0",
    "CC-BY-NC-4.0": "licensed under cc by-nc 4.0",
    "CC-BY/text": "this work is licensed under a creative commons attribution 4.0 international license",
}
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
#: Least words of a window.
WINDOW_WORDS = 400
#: Least share of a template's words in order.
LEAST_WORDS = 0.85


class Scanner:
    """The templates' words, word pairs and compressors, made once per task."""

    def __init__(self, templates: dict[str, str] = TEMPLATES) -> None:
        self.words = {name: WORD.findall(text.lower()) for name, text in sorted(templates.items())}
        self.cues = sorted({c for w in self.words.values() for c in self._cues(w)})
        common = {"the", "of", "to", "and", "in", "is", "this", "a", "or", "with", "that", "by", "are", "it", "be"}
        self.pairs: dict[tuple[str, str], list[str]] = {}  # the templates that hold a pair
        for name, w in self.words.items():
            own = list(dict.fromkeys(zip(w, w[1:])))
            for p in [p for p in own if not common.issuperset(p)] or own:
                self.pairs.setdefault(p, []).append(name)
        # words that a stretch may have: a fifth more than the template's
        self.spans = {name: len(w) + len(w) // 5 + 1 for name, w in self.words.items()}
        self.reach = max(self.spans.values())
        self.window = max(WINDOW_WORDS, 2 * self.reach)  # so that any stretch lies in one window
        self.counts = {name: Counter(w) for name, w in self.words.items()}
        self.matchers = {name: SequenceMatcher(autojunk=False) for name in self.words}
        for name, matcher in self.matchers.items():
            matcher.set_seq2(self.words[name])
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.packers = {name: zstandard.ZstdCompressor(
            level=3, write_content_size=False, write_checksum=False, write_dict_id=False,
            dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for name, w in self.words.items()}

    @staticmethod
    def _cues(words: list[str]) -> list[str]:
        """The longest distinct words, one more than a finding may lack: every finding has one of them."""
        may_lack = len(words) - math.ceil(LEAST_WORDS * len(words))
        return sorted(set(words), key=lambda w: (-len(w), w))[:may_lack + 1]

    def blocks(self, words: list[str]) -> list[tuple[int, int]]:
        """Half-open word ranges around the pairs that templates hold, in windows that overlap by a half."""
        out: list[list[int]] = []
        for k in (k for k, p in enumerate(zip(words, words[1:])) if p in self.pairs):
            lo, hi = max(0, k + 2 - self.reach), min(len(words), k + self.reach)
            if out and lo <= out[-1][1]:
                out[-1][1] = hi
            else:
                out.append([lo, hi])
        return [(a, min(b, a + self.window)) for lo, b in out
                for a in range(lo, max(lo + 1, b - self.window // 2), self.window // 2)]

    def ranked(self, part: list[str]) -> list[tuple[int, list[str]]]:
        """Templates with a word pair in the block, in groups of equally many bytes saved, most first."""
        data = " ".join(part).encode()
        alone = len(self.plain.compress(data))
        groups: dict[int, list[str]] = {}
        for name in sorted({n for p in zip(part, part[1:]) for n in self.pairs.get(p, ())}):
            groups.setdefault(alone - len(self.packers[name].compress(data)), []).append(name)
        return sorted(groups.items(), reverse=True)

    def share_saved(self, name: str, stretch: str) -> float:
        """The share of the stretch's compressed size that the template saves."""
        data = stretch.encode()
        return 1.0 - len(self.packers[name].compress(data)) / len(self.plain.compress(data))

    def starts(self, name: str, words: list[str]) -> Iterator[tuple[int, int]]:
        """``(first word, most words that can be in order)`` of each stretch that has enough of the template's words at all."""
        count, span = self.counts[name], self.spans[name]
        least, held = LEAST_WORDS * len(self.words[name]), dict.fromkeys(self.counts[name], 0)
        places = [k for k, w in enumerate(words) if w in count]
        ahead = most = 0
        for k in places:
            while ahead < len(places) and places[ahead] < k + span:
                w = words[places[ahead]]
                most += held[w] < count[w]
                held[w] += 1
                ahead += 1
            if most >= least:
                yield k, most
            held[words[k]] -= 1
            most -= held[words[k]] < count[words[k]]

    def compare(self, name: str, words: list[str]) -> tuple[float, int, int, list[str], list[str]] | None:
        """``(share of the template's words in order, first word, end, missing words, added words)`` of the closest stretch."""
        want, matcher, best = self.words[name], self.matchers[name], None
        for k, most in self.starts(name, words):  # a stretch starts with any of the template's words
            if best and most <= best[0] * len(want):
                continue
            part = words[k:k + self.spans[name]]
            matcher.set_seq1(part)
            same = [m for m in matcher.get_matching_blocks() if m.size]
            share = sum(m.size for m in same) / len(want)
            if share < LEAST_WORDS or (best and share <= best[0]):
                continue
            first, end = same[0].a, same[-1].a + same[-1].size
            missing, added = [], []
            for kind, a1, a2, b1, b2 in matcher.get_opcodes():
                if kind != "equal":
                    added += part[max(a1, first):min(a2, end)]
                    missing += want[b1:b2]
            best = (share, k + first, k + end, missing, added)
            if share == 1.0:
                break
        return best

    def scan(self, text: str | None) -> list[tuple[str, int, int, float, float, str, str]]:
        """``(template, first word, end, share saved, share of words, missing, added)`` of each finding, by place."""
        low = (text or "").lower()
        if not any(c in low for c in self.cues):
            return []
        words = WORD.findall(low)
        found: dict[tuple[int, int], tuple] = {}
        todo = self.blocks(words)
        while todo:
            lo, hi = todo.pop()
            part = words[lo:hi]
            best = self.confirmed(part)
            if best is None:
                continue
            name, (share, a, b, missing, added) = best
            saved = self.share_saved(name, " ".join(part[a:b]))
            found[(lo + a, lo + b)] = (name, lo + a, lo + b, saved, share, " ".join(missing), " ".join(added))
            todo += [(lo, lo + a), (lo + b, hi)]
        return _outermost(sorted(found.values(), key=lambda f: (f[1], -f[2])))

    def confirmed(self, part: list[str]) -> tuple[str, tuple] | None:
        """The first template, by bytes saved, whose exact differences leave a finding."""
        for _, names in self.ranked(part):
            held = [(len(self.words[n]) * same[0], same[0], n, same) for n in names if (same := self.compare(n, part))]
            if held:
                return max(held, key=lambda h: h[:2])[2:]    # the first name of equal ones
        return None


def _outermost(found: list[tuple]) -> list[tuple]:
    """Without findings inside others (windows overlap)."""
    out: list[tuple] = []
    for f in found:
        if not out or f[1] >= out[-1][2]:
            out.append(f)
        elif f[2] - f[1] > out[-1][2] - out[-1][1]:
            out[-1] = f
    return out


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   templates: dict[str, str] | None = None) -> DataFrame:
    """One row per finding: ``id, nr, template, first_word, end_word, saved, word_share, missing, added``."""
    columns = ["id", "nr", "template", "first_word", "end_word", "saved", "word_share", "missing", "added"]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates or TEMPLATES)
        for batch in batches:
            rows = [(i, k, *f) for i, t in zip(batch["id"], batch["text"]) for k, f in enumerate(scanner.scan(t))]
            yield pd.DataFrame(rows, columns=columns)

    text_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = base.mapInPandas(kernel, "id string, nr int, template string, first_word int, end_word int, saved double, "
                                   "word_share double, missing string, added string")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


@register("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license wording in the documents, with its place and its differences."""
    return scan_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
