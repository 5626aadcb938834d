"""License scans (operator 7) by conditional compression.

Candidate blocks are the words around those that licences use, read without line breaks and marks, in pieces of PIECE
words that overlap by more than a notice. Every piece is compressed alone and with each template as a raw zstandard
dictionary; a template is looked for only where it saves SAVES hundredths of what it could. There it is aligned with the
words: a notice around common words in a row, a whole licence along the words in a row that stand in it once. Each place
found is compressed again with each template that was found there. Of places that overlap, the one that its template
shrinks by most bytes wins, if its exact wording confirms it: the words of the template that it lacks and the words that
it adds, of which only so many may be. Templates are single notices and whole licences. One pass over the documents, no
shuffle; the work grows with the text, however much of it nearly is a licence.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from difflib import SequenceMatcher
from pathlib import Path

import zstandard
from pyspark.sql import DataFrame

from loomgraph.llm.common import map_columns, with_id

#: Notices as licences word them. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "All-rights-reserved": "All rights reserved.",
}
#: Whole licences, without the line of the copyright holder.
TEMPLATES |= {f"{f.stem}-text": f.read_text("utf-8").strip() for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}

CUE = re.compile(r"licen[cs]|copyright|rights\W+reserved|permission\W+is|redistribution|creative\W+commons|public\W+domain", re.I)

#: Hundredths of a template's words that a block may lack.
MAY_LACK = 10

#: Words in a row that a block has of its template, at least.
GRAM = 3

#: Words of a notice at most; a block may lack no word with a digit of a notice.
NOTICE = 60

#: Words of a piece that is compressed; the next one starts half as far, so that each holds a notice and what it may add.
PIECE = 256

#: Words around a cue that are looked at: a notice, and what it may add.
AROUND = NOTICE * 5 // 4 + 4

#: Hundredths of what a template saves on itself, or of the piece where that is less, that it must save on a piece.
SAVES = 15

#: Level of zstandard: lower ones and the highest save less evenly on pieces of this size.
LEVEL = 6

#: What is put after each piece: letters as English has them. Without letters enough to code, zstandard writes them as
#: they are, and a few more change the size of all others.
FRAME = "".join(random.Random(0).choices("eeeeeeetttttaaaaooooiiiinnnnsssshhhrrrddlluucmwfgypbvk" + " " * 10, k=64)).encode()

_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"\w(?:[\w.+-]*\w)?")
_MARKS = re.compile(r"[^\w\s]*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _bytes(words: list[str]) -> bytes:
    return " ".join(words).encode("utf-8", "replace")


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    given = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    given.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=given)


def _matches(want: list[str], have: list[str], i: int, p: int) -> list[tuple[int, int, int]]:
    """(place in want, place in have, words) of common words in order; places are counted from i and p."""
    if want == have:
        return [(i, p, len(want))] if want else []
    return [(i + x.a, p + x.b, x.size) for x in SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if x.size]


def _between(want: list[str], have: list[str], i: int, p: int, first: bool, last: bool) -> list[tuple[int, int, int]]:
    """_matches of what lies between two places that match, of which the first or last may be missing: what goes on
    from these places belongs to them."""
    n = min(len(want), len(have))
    a = 0 if first else next((x for x in range(n) if want[x] != have[x]), n)
    b = 0 if last else next((x for x in range(n - a) if want[-1 - x] != have[-1 - x]), n - a)
    found = [(i, p, a), *_matches(want[a : len(want) - b], have[a : len(have) - b], i + a, p + a), (i + len(want) - b, p + len(have) - b, b)]
    return [x for x in found if x[2]]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest row of pairs, of those in order of their first, whose second rises."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for x, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [x]
        before.append(ends[at - 1] if at else -1)
    out, x = [], ends[-1]
    while x >= 0:
        out.append(pairs[x])
        x = before[x]
    return out[::-1]


def _runs(pairs: list[tuple[int, int]], slack: int) -> list[list[tuple[int, int]]]:
    """pairs, cut where the text goes on by more than slack words beyond the template."""
    out = [pairs[:1]]
    for x, y in zip(pairs, pairs[1:]):
        if y[0] - x[0] - (y[1] - x[1]) > slack:
            out.append([])
        out[-1].append(y)
    return out


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.words = {k: w for k, t in templates.items() if (w := words_of(t))}
        self.bags = {k: Counter(w) for k, w in self.words.items()}
        self.cued = all(map(CUE.search, templates.values()))
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = {k: _compressor(_bytes(w)) for k, w in self.words.items()}
        self.grams: dict[str, dict[tuple[str, ...], list[int]]] = {}
        for k, w in self.words.items():
            at: dict[tuple[str, ...], list[int]] = {}
            for i in range(max(1, len(w) - GRAM + 1)):
                at.setdefault(tuple(w[i : i + GRAM]), []).append(i)
            self.grams[k] = at if len(w) <= NOTICE else {g: i for g, i in at.items() if len(i) == 1}
        self.most = {k: self.saved(k, w) for k, w in self.words.items()}

    def saved(self, k: str, words: list[str]) -> int:
        """By how many bytes template k makes these words' compressed form smaller."""
        raw = _bytes(words) + FRAME
        return len(self.alone.compress(raw)) - len(self.given[k].compress(raw))

    def _excess(self, k: str, bag: Counter) -> int:
        """By how many words those of bag, in any order, lack more of template k than they may."""
        return (self.bags[k] - bag).total() - MAY_LACK * len(self.words[k]) // 100

    def _trimmed(self, k: str, found: list[tuple[int, int, int]]) -> tuple[int, int, int, int] | None:
        """(first word, word after the last, words lacking, words added) of template k by its matches (place in the
        template, place in the text, words), or None if too many words lack."""
        want = self.words[k]
        spare = MAY_LACK * len(want) // 100 - len(want) + sum(size for _, _, size in found)
        if spare < 0:
            return None
        # words far from the others are lacking rather than wording, as far as words may lack
        while len(found) > 1 and spare >= found[0][2] < found[1][1] - found[0][1] - found[0][2]:
            spare -= found.pop(0)[2]
        while len(found) > 1 and spare >= found[-1][2] < found[-1][1] - found[-2][1] - found[-2][2]:
            spare -= found.pop()[2]
        same = sum(size for _, _, size in found)
        if len(want) <= NOTICE:  # a notice names its version by such words
            there = {i for a, _, size in found for i in range(a, a + size)}
            if any(i not in there and _DIGIT.search(w) for i, w in enumerate(want)):
                return None
        first, last = found[0][1], found[-1][1] + found[-1][2]
        return first, last, len(want) - same, last - first - same

    def _notices(self, k: str, have: list[str], lo: int, hi: int) -> list[tuple[int, int, int, int]]:
        """Places of notice k that have a gram among words lo to hi."""
        want = self.words[k]
        n, size = len(want), min(GRAM, len(want))
        slack = n // 4 + 4

        def around(a: int, b: int) -> tuple[int, int, int, int] | None:
            a = max(0, a)
            return self._trimmed(k, _matches(want, have[a:b], 0, a))

        out, tried = [], -1 - n
        for p in range(lo, hi):
            for i in self.grams[k].get(tuple(have[p : p + size]), ()):
                # neighbouring grams of one place are of one block
                if p - i < tried:
                    continue
                # a place further on by so many words may have as many more of the template
                if (excess := self._excess(k, Counter(have[max(0, p - i - slack) : p - i + n + slack]))) > 0:
                    tried = p - i + excess
                    continue
                found = around(p - i - slack, p - i + n + slack)
                if found:  # the gram may stand at several places of the template: once more around what was found
                    again = around(found[0] - slack, found[0] + n + slack)
                    found = min(filter(None, (found, again)), key=lambda x: 2 * x[2] + x[3])
                    out.append(found)
                tried = found[1] if found else p - i + 1
        return out

    def _whole(self, k: str, have: list[str], lo: int, hi: int) -> list[tuple[int, int, int, int]]:
        """Places of whole licence k among words lo to hi: grams that lie on diagonals next to each other are of one
        copy, and the longest rising row of them is its frame; only what lies between is compared word by word."""
        n = len(self.words[k])
        at = self.grams[k]
        hits = sorted((p - at[g][0], p) for p in range(lo, hi) if (g := tuple(have[p : p + GRAM])) in at)
        out, copy = [], []
        for x in hits:
            if copy and x[0] - copy[-1][0] > n // 8:
                out.append(self._copy(k, have, copy, lo, hi))
                copy = []
            copy.append(x)
        if copy:
            out.append(self._copy(k, have, copy, lo, hi))
        return [x for x in out if x]

    def _copy(self, k: str, have: list[str], hits: list[tuple[int, int]], lo: int, hi: int) -> tuple[int, int, int, int] | None:
        """The place of whole licence k that has these grams (diagonal, word), or None."""
        want = self.words[k]
        n = len(want)
        slack, may_lack = n // 4 + 4, MAY_LACK * n // 100
        frame = max(_runs(_rising(sorted((p, p - d) for d, p in hits)), slack), key=len)
        if len(frame) < (n - (GRAM + 1) * may_lack) // 8:  # each lacking word breaks few grams
            return None
        found: list[tuple[int, int, int]] = []
        lacking, i, p = 0, 0, max(lo, frame[0][0] - frame[0][1] - slack)
        for q, j in [*frame, (min(hi, frame[-1][0] + n - frame[-1][1] + slack), n)]:
            if j > i:  # what is between the last gram and this one
                between = _between(want[i:j], have[p:q], i, p, not i, j == n)
                lacking += j - i - sum(size for _, _, size in between)
                if lacking > may_lack:
                    return None
                found += between
            if j < n:  # of grams that share words, the new ones
                a, b = max(i, j), max(p, q)
                a = b = max(a - j, b - q)
                if a < GRAM:
                    found.append((j + a, q + b, GRAM - a))
                i, p = j + GRAM, q + GRAM
        return self._trimmed(k, found)

    def _blocks(self, text: str, at: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Candidate blocks (first word, word after the last): the words around the cues, put together."""
        if not self.cued:
            return [(0, len(at))] if at else []
        ends = [b for _, b in at]
        out: list[tuple[int, int]] = []
        for m in CUE.finditer(text):
            i = bisect_right(ends, m.start())
            lo, hi = max(0, i - AROUND), min(len(at), i + AROUND)
            if out and lo <= out[-1][1]:
                out[-1] = out[-1][0], hi
            else:
                out.append((lo, hi))
        return out

    def confirmed(self, text: str) -> list[tuple[int, int, str, int, int, int]]:
        """(start, end, template, lacking, added, saved) of each confirmed block, in order; none overlap; saved in
        bytes."""
        at = [m.span() for m in _WORD.finditer(text)]
        have = [text[a:b].lower() for a, b in at]
        whole = Counter(have)
        possible = [k for k in self.words if self._excess(k, whole) <= 0]
        where: dict[str, list[tuple[int, int]]] = {}
        for lo, hi in self._blocks(text, at):
            for a in range(lo, max(lo + 1, hi - PIECE // 2), PIECE // 2):
                b = min(hi, a + PIECE)
                raw = _bytes(have[a:b]) + FRAME
                alone = len(self.alone.compress(raw))
                for k in possible:
                    if 100 * (alone - len(self.given[k].compress(raw))) >= SAVES * min(self.most[k], alone):
                        n = len(self.words[k])
                        more = 0 if n <= NOTICE else n + n // 4 + 4  # words of a whole licence that are far from a cue
                        part = max(0, a - more), min(len(have), b + more)
                        parts = where.setdefault(k, [])
                        if parts and part[0] <= parts[-1][1]:
                            parts[-1] = parts[-1][0], part[1]
                        else:
                            parts.append(part)
        blocks = []
        for k, parts in where.items():
            find = self._notices if len(self.words[k]) <= NOTICE else self._whole
            blocks += [(self.saved(k, have[x[0] : x[1]]), k, *x) for lo, hi in parts for x in find(k, have, lo, hi)]
        # by saved bytes; of equal ones that with the fewest differences of wording
        blocks = sorted((x for x in set(blocks) if x[0] > 0), key=lambda x: (-x[0], 2 * x[4] + x[5], x[1:]))
        kept: list[tuple[int, int]] = []  # apart from each other and in order
        out = []
        for saved, k, first, last, lacking, added in blocks:
            i = bisect_left(kept, (first, last))
            if (i and kept[i - 1][1] > first) or (i < len(kept) and kept[i][0] < last):
                continue
            kept.insert(i, (first, last))
            end = _MARKS.match(text, at[last - 1][1]).end()
            out.append((at[first][0], end, k, lacking, added, saved))
        return sorted(out)

    def scan(self, text: str | None) -> list[tuple[int, int, str, int, int, int] | tuple[int, int, None, int, int, int]]:
        """(start, end, template or None, lacking, added, saved) of a whole text: each confirmed block, and each line
        with a cue that has no part in one."""
        text = text or ""
        if self.cued and not CUE.search(text):
            return []
        kept = self.confirmed(text)
        out, reach, i = list(kept), -1, 0
        for m in CUE.finditer(text):
            if m.start() < reach:
                continue
            start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            reach = end = len(text) if end < 0 else end
            while i < len(kept) and kept[i][1] <= start:
                i += 1
            if i == len(kept) or kept[i][0] >= end:
                out.append((start, end, None, 0, 0, 0))
        return sorted(out, key=lambda x: x[:2])


_LOADED: dict[tuple, Templates] = {}


def license_spans(documents: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_blocks, n_confirmed, n_exact, licenses, spans) for each row of documents.

    n_blocks counts confirmed blocks and the other lines with a cue, n_confirmed the confirmed blocks, n_exact those that are its wording,
    word for word. licenses are the distinct templates in order, spans `template:start:end` in code points, both joined
    by commas. Null and empty texts have none. Repeated rows are reported each, as are rows without an id; other
    columns are ignored; an empty table gives no rows.
    """
    key = tuple(sorted(templates.items()))

    def run(ids: list, texts: list) -> dict:
        if key not in _LOADED:
            _LOADED[key] = Templates(templates)
        found = [_LOADED[key].scan(t) for t in texts]
        sure = [[x for x in f if x[2]] for f in found]
        return {
            "doc_id": ids, "n_blocks": list(map(len, found)), "n_confirmed": list(map(len, sure)), "n_exact": [sum(x[3] == x[4] == 0 for x in f) for f in sure],
            "licenses": [",".join(sorted({x[2] for x in f})) for f in sure], "spans": [",".join(f"{x[2]}:{x[0]}:{x[1]}" for x in f) for f in sure],
        }

    return map_columns(with_id(documents, id_col, text_col), run, "doc_id long, n_blocks long, n_confirmed long, n_exact long, licenses string, spans string")
