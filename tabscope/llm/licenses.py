"""License scans: fuzzy search for short notices.

Texts are reduced to their words (lower-cased A-Z, digits, everything beyond ASCII),
joined by single spaces.  A notice that may hold k edits is split into k + 1 seeds; by
the pigeonhole principle any match holds one of them exactly.  One automaton finds all
seeds; around each the bounded-error matching of the ``regex`` library verifies the
notice and gives its span and edits.  The letters that tell one license from another are
no place for edits: such parts of a notice, written in braces, must be there exactly, and
the longest of them is its only seed.  Where spans of notices overlap, the one that holds
most of its notice's letters wins, then the one that starts first.  Base phrases are
notices without edits, whose one seed is the phrase itself between spaces; all their
places are reported.

Null and empty texts have no words and no spans.  Texts of any length and number of
notices are taken whole, in time that grows with them.  Rows are independent: repeated
rows give repeated results, an empty table an empty one.  Other columns pass through, but
for those that have the name of a result, which it replaces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.shared import prepare, with_results

# The base phrases and their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: Names of licenses as notices give them, with the letters that tell them apart in braces.
NAMES = (
    ("{apache} license version {2 0}", "apache-2.0"),
    ("{apache} license version {1 1}", "apache-1.1"),
    ("{apache} license {2 0}", "apache-2.0"),
    ("{mit} license", "mit"),
    ("{isc} license", "isc"),
    ("{zlib} license", "zlib"),
    ("{bsd} license", "bsd"),
    ("{bsd 2} clause license", "bsd-2-clause"),
    ("{bsd 3} clause license", "bsd-3-clause"),
    ("{2 clause bsd} license", "bsd-2-clause"),
    ("{3 clause bsd} license", "bsd-3-clause"),
    ("gnu {general} public license", "gpl"),
    ("gnu {lesser general} public license", "lgpl"),
    ("gnu {library general} public license", "lgpl"),
    ("gnu {affero general} public license", "agpl"),
    ("gnu {free documentation} license", "gfdl"),
    ("{mozilla} public license", "mpl"),
    ("{mozilla} public license version {1 1}", "mpl-1.1"),
    ("{mozilla} public license version {2 0}", "mpl-2.0"),
    ("{eclipse} public license", "epl"),
    ("{european union} public licence", "eupl"),
    ("common {development and distribution} license", "cddl"),
    ("{common public} license", "cpl"),
    ("{artistic} license", "artistic"),
    ("{boost} software license", "bsl-1.0"),
    ("{academic free} license", "afl"),
    ("{open software} license", "osl"),
    ("{microsoft public} license", "ms-pl"),
    ("{microsoft reciprocal} license", "ms-rl"),
    ("{python software foundation} license", "psf"),
    ("{postgresql} license", "postgresql"),
    ("{php} license", "php"),
    ("{ruby} license", "ruby"),
    ("{openssl} license", "openssl"),
    ("{sil open} font license", "ofl"),
    ("{latex project} public license", "lppl"),
    ("{open database} license", "odbl"),
    ("{open data commons} attribution license", "odc-by"),
    ("{unlicense}", "unlicense"),
    ("{wtfpl}", "wtfpl"),
    *(
        (f"{{{name} {'-'.join(parts).replace('-', ' ')}}}", f"cc-{'-'.join(parts)}")
        for name in ("cc", "creative commons")
        for parts in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd"))
    ),
    ("{cc0}", "cc0"),
    ("creative commons {attribution}", "cc-by"),
    ("creative commons {attribution sharealike}", "cc-by-sa"),
    ("creative commons {attribution share alike}", "cc-by-sa"),
    ("creative commons {attribution noderivatives}", "cc-by-nd"),
    ("creative commons {attribution noncommercial}", "cc-by-nc"),
    ("creative commons {attribution noncommercial sharealike}", "cc-by-nc-sa"),
    ("creative commons {attribution noncommercial noderivatives}", "cc-by-nc-nd"),
)
#: What stands before a name; edits may be in it.
LEADS = ("licensed under the ", "licensed under a ", "licensed under ", "released under the ", "released under ", "distributed under the ",
         "available under the ", "terms of the ", "spdx license identifier ")
#: Notices that are known by their own words.
PHRASES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used", "bsd-3-clause"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("this source code form is subject to the terms of the mozilla public license v {2 0}", "mpl-2.0"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy", "bsl-1.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is dedicated to the public domain", "public-domain"),
    ("everyone is permitted to copy and distribute verbatim copies of this license document", "gpl"),
)
NOTICES = (*((lead + name, label) for lead in LEADS for name, label in NAMES), *PHRASES)
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12

# Bytes that stand in words; the rest of ASCII parts them.
WORD_BYTES = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b in WORD_BYTES else 32 for b in range(256))
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPAN = "struct<label:string,base:boolean,first:long,last:long,start:long,end:long,edits:int,score:double>"


def seeds(words: str, edits: int) -> list[tuple[int, str]]:
    """Offset and text of edits + 1 parts of about equal size."""
    cuts = [round(k * len(words) / (edits + 1)) for k in range(edits + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Notice:
    """A notice's words, how many edits its parts may hold, and the expression that verifies it."""

    def __init__(self, words: str, label: str, chars_per_edit: int):
        self.label = label
        parts = [(p[1:-1], 0) if p[0] == "{" else (p, len(p) // chars_per_edit) for p in regex.findall(r"\{[^}]*\}|[^{]+", words)]
        exact = [p for p, _ in parts if "{" + p + "}" in words]
        self.words = "".join(p for p, _ in parts)
        self.edits = sum(k for _, k in parts)
        body = "".join(f"(?:{regex.escape(p)}){{e<={k}}}" if k else regex.escape(p) for p, k in parts)
        self.pattern = regex.compile(f"(?e)(?<= ){body}(?= )")
        if exact:
            seed = max(exact, key=len)
            self.seeds = [(self.words.index(seed), seed)]
        else:
            self.seeds = seeds(self.words, self.edits)


class Scanner:
    def __init__(self, base=BASE, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        self.base = [(f" {w} ", label) for w, label in base]
        self.notices = [Notice(w, label, chars_per_edit) for w, label in notices]

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        posts: dict[str, list[tuple[int, int]]] = {}
        for n, (words, _) in enumerate(self.base):
            posts.setdefault(words, []).append((~n, len(words) - 1))
        for n, notice in enumerate(self.notices):
            for offset, seed in notice.seeds:
                posts.setdefault(seed, []).append((n, offset + len(seed) - 1))
        found = ahocorasick.Automaton()
        for seed, where in posts.items():
            found.add_word(seed, where)
        found.make_automaton()
        return found

    @cached_property
    def verify(self):
        """Matches of a notice within a stretch of text: start, end, edits."""

        def matches(n: int, stretch: str) -> list[tuple[int, int, int]]:
            return [(m.start(), m.end(), sum(m.fuzzy_counts)) for m in self.notices[n].pattern.finditer(stretch)]

        short = lru_cache(maxsize=4096)(matches)
        return lambda n, stretch: (short if len(stretch) < 400 else matches)(n, stretch)

    def scan(self, text: str | None) -> tuple[int, list[tuple]]:
        """Number of words, and the spans found."""
        words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
        line = f" {b' '.join(words).decode()} "
        windows: dict[int, list[list[int]]] = {}
        base: list[tuple[int, int, int]] = []
        for end, where in self.automaton.iter(line):
            for n, offset in where:
                start = end - offset
                if n < 0:
                    base.append((start + 1, start + len(self.base[~n][0]) - 1, ~n))
                    continue
                notice = self.notices[n]
                a, b = max(0, start - notice.edits - 1), min(len(line), start + len(notice.words) + notice.edits + 1)
                own = windows.setdefault(n, [])
                if own and a <= own[-1][1]:
                    own[-1] = [min(a, own[-1][0]), max(b, own[-1][1])]
                else:
                    own.append([a, b])
        found = [(a + x, a + y, n, e) for n, own in windows.items() for a, b in own for x, y, e in self.verify(n, line[a:b])]
        if not base and not found:
            return len(words), []
        spans = [(a, b, label, True, 0, len(words_of)) for a, b, n in base for words_of, label in [self.base[n]]]
        spans += [(a, b, self.notices[n].label, False, e, len(self.notices[n].words)) for a, b, n, e in best_of(found, self.notices)]
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
        places = [m.span() for m in WORD.finditer(text)]
        out = []
        for a, b, label, is_base, edits, size in sorted(spans):
            a, b = a + (line[a] == " "), b - (line[b - 1] == " ")
            first, last = int(np.searchsorted(blanks, a)) - 1, int(np.searchsorted(blanks, b)) - 1
            out.append((label, is_base, first, last, places[first][0], places[last][1], edits, 1 - edits / size))
        return len(words), out


def best_of(found: list[tuple[int, int, int, int]], notices: list[Notice]) -> list[tuple[int, int, int, int]]:
    """Of (start, end, notice, edits) that overlap, those that hold most letters of their notice."""
    out: list[tuple[int, int, int, int]] = []
    group: list[tuple[int, int, int, int]] = []

    def settle() -> None:
        taken: list[tuple[int, int]] = []
        for a, b, n, e in sorted(group, key=lambda s: (s[3] - len(notices[s[2]].words), s[0], notices[s[2]].label)):
            k = bisect_left(taken, (a, b))
            if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
                insort(taken, (a, b))
                out.append((a, b, n, e))
        group.clear()

    reach = 0
    for span in sorted(found):
        if span[0] >= reach:
            settle()
        group.append(span)
        reach = max(reach, span[1])
    settle()
    return out


def scan(docs: DataFrame, scanner: Scanner | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``spans``.

    A span has its label, whether it is a base phrase, its first and last word (from
    0), its start and end in the text (code points), its edits and a score from 0 to 1.
    """
    prepare(docs.sparkSession)
    scanner = scanner or Scanner()

    @F.pandas_udf(f"n_words long, spans array<{SPAN}>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ("label", "base", "first", "last", "start", "end", "edits", "score")
        for texts in batches:
            found = [scanner.scan(t) for t in texts]
            yield pd.DataFrame(
                {"n_words": [n for n, _ in found], "spans": [[dict(zip(names, s, strict=True)) for s in own] for _, own in found]}
            )

    return with_results(docs, find(F.col(text)), ("n_words", "spans"))
