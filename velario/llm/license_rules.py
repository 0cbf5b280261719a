"""License scans by ordered signature rules.

A text is reduced to its words (ASCII lower case; letters, digits and everything that is
not ASCII), joined by one space. Rules are regular expressions over that line, matched
from word to word, each with a label, a priority, a relevance between 0 and 1, and
keywords that all it can match holds. One Aho-Corasick pass finds the keywords of a line;
only rules whose keywords were all met are run. Overlapping detections are resolved in order of
priority, then length, then place, then rule: one that lies within the words of a
detection already taken is dropped.

Base rules are exact phrases. Every place of theirs is reported, whatever happens to the
detection: they tell what a plain scan finds.

The rules (``RULES``, some hundreds) are written for each license in ``_LICENSES``: its
names and its identifiers, in each of the ``_FORMS`` in which licenses are cited; beside
these are sentences of the license texts themselves (``_NOTICES``).

Cases: a null or empty text has no words and no detection; repeated rows and rows without
``doc_id`` are documents of their own; a text of any length is scanned whole; an empty
table gives no row; other columns are not read.
"""

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from velario.llm.shared import column_bytes, ready, small, texts


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keywords: tuple          # each, or one of the alternatives in it (a|b), stands in every match
    pattern: str             # over words joined by one space
    priority: int
    relevance: float
    base: bool = False


# fixed values: the phrases of a plain scan and their labels
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_V = r"(?: v| version|)"
# label: (keyword, pattern of its names, pattern of its identifiers)
_LICENSES = {
    "gpl-1.0": ("general public", rf"(?:gnu )?general public licen[cs]e{_V} ?1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    "gpl-2.0": ("general public", rf"(?:gnu )?general public licen[cs]e{_V} ?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    "gpl-3.0": ("general public", rf"(?:gnu )?general public licen[cs]e{_V} ?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    "gpl": ("general public", "(?:gnu )?general public licen[cs]e", "gnu gpl(?: v?[123])?"),
    "lgpl-2.0": ("library general", rf"(?:gnu )?library general public licen[cs]e{_V} ?2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    "lgpl-2.1": ("lesser general", rf"(?:gnu )?lesser general public licen[cs]e{_V} ?2 1", "lgpl 2 1(?: only| or later)?"),
    "lgpl-3.0": ("lesser general", rf"(?:gnu )?lesser general public licen[cs]e{_V} ?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    "lgpl": ("lesser general", "(?:gnu )?lesser general public licen[cs]e", "gnu lgpl(?: v?[23])?"),
    "agpl-3.0": ("affero", rf"(?:gnu )?affero general public licen[cs]e(?:{_V} ?3(?: 0)?)?", "agpl 3 0(?: only| or later)?"),
    "gfdl": ("free documentation", rf"(?:gnu )?free documentation licen[cs]e(?:{_V} ?1 [123])?", "gfdl 1 [123](?: only| or later)?"),
    "apache-1.1": ("apache", rf"apache (?:software )?licen[cs]e{_V} ?1 1", "apache 1 1"),
    "apache-2.0": ("apache", rf"apache (?:software )?licen[cs]e{_V} ?2(?: 0)?", "apache 2 0"),
    "apache": ("apache", "apache (?:software )?licen[cs]e", "asl"),
    "mit": ("mit", "mit(?: x11| expat)? licen[cs]e", "mit"),
    "x11": ("x11", "x11 licen[cs]e", "x11"),
    "mit-0": ("mit", "mit no attribution(?: licen[cs]e)?", "mit 0"),
    "isc": ("isc", "isc licen[cs]e", "isc"),
    "bsd-2-clause": ("bsd|freebsd", "(?:simplified bsd|freebsd|2 clause bsd|bsd 2 clause|two clause bsd) licen[cs]e", "bsd 2 clause"),
    "bsd-3-clause": ("bsd", "(?:new bsd|modified bsd|revised bsd|3 clause bsd|bsd 3 clause|three clause bsd) licen[cs]e", "bsd 3 clause"),
    "bsd-4-clause": ("bsd", "(?:original bsd|4 clause bsd|bsd 4 clause|four clause bsd) licen[cs]e", "bsd 4 clause"),
    "0bsd": ("bsd", "(?:zero clause bsd|bsd zero clause) licen[cs]e", "0bsd"),
    "bsd": ("bsd", "bsd(?: style)? licen[cs]e", "bsd"),
    "mpl-1.1": ("mozilla", rf"mozilla public licen[cs]e{_V} ?1 1", "mpl 1 1"),
    "mpl-2.0": ("mozilla", rf"mozilla public licen[cs]e{_V} ?2(?: 0)?", "mpl 2 0"),
    "mpl": ("mozilla", "mozilla public licen[cs]e", "mpl"),
    "epl-1.0": ("eclipse", rf"eclipse public licen[cs]e{_V} ?1(?: 0)?", "epl 1 0"),
    "epl-2.0": ("eclipse", rf"eclipse public licen[cs]e{_V} ?2(?: 0)?", "epl 2 0"),
    "edl-1.0": ("eclipse", "eclipse distribution licen[cs]e", "edl 1 0"),
    "cddl-1.0": ("common development", rf"common development and distribution licen[cs]e(?:{_V} ?1 [01])?", "cddl 1 [01]"),
    "cpl-1.0": ("common public", "common public licen[cs]e", "cpl 1 0"),
    "eupl": ("european union", rf"european union public licen[cs]e(?:{_V} ?1 [012])?", "eupl 1 [012]"),
    "artistic-1.0": ("artistic", rf"artistic licen[cs]e{_V} ?1(?: 0)?", "artistic 1 0"),
    "artistic-2.0": ("artistic", rf"artistic licen[cs]e{_V} ?2(?: 0)?", "artistic 2 0"),
    "artistic": ("artistic", "artistic licen[cs]e", "artistic"),
    "bsl-1.0": ("boost", "boost software licen[cs]e", "bsl 1 0"),
    "busl-1.1": ("business source", "business source licen[cs]e", "busl 1 1"),
    "sspl-1.0": ("server side", "server side public licen[cs]e", "sspl 1 0"),
    "elastic-2.0": ("elastic", "elastic licen[cs]e", "elastic 2 0"),
    "zlib": ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib"),
    "libpng": ("libpng", "libpng licen[cs]e", "libpng(?: 2 0)?"),
    "openssl": ("openssl", "openssl licen[cs]e", "openssl"),
    "python-2.0": ("python", "python (?:software foundation )?licen[cs]e", "(?:psf|python) 2 0"),
    "php-3.01": ("php", "php licen[cs]e", "php 3 01?"),
    "ruby": ("ruby", "ruby licen[cs]e", "ruby"),
    "postgresql": ("postgresql", "postgresql licen[cs]e", "postgresql"),
    "unlicense": ("unlicense", "(?:the )?unlicense", "unlicense"),
    "wtfpl": ("what the", "do what the f[a-z]* you want to public licen[cs]e", "wtfpl"),
    "ofl-1.1": ("open font", "(?:sil )?open font licen[cs]e", "ofl 1 [01]"),
    "ncsa": ("ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa"),
    "afl-3.0": ("academic free", "academic free licen[cs]e", "afl [123] [012]"),
    "osl-3.0": ("open software", "open software licen[cs]e", "osl [123] [01]"),
    "ms-pl": ("microsoft public", "microsoft public licen[cs]e", "ms pl"),
    "ms-rl": ("microsoft reciprocal", "microsoft reciprocal licen[cs]e", "ms rl"),
    "odbl-1.0": ("open database", "open database licen[cs]e", "odbl 1 0"),
    "odc-by-1.0": ("open data", "open data commons attribution licen[cs]e", "odc by 1 0"),
    "pddl-1.0": ("public domain dedication", "open data commons public domain dedication(?: and licen[cs]e)?", "pddl 1 0"),
    "cc0-1.0": ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    "cc-by": ("cc by", r"cc by(?: [1234] [05])?", r"cc by [1234] [05]"),
    "cc-by-sa": ("cc by sa", r"cc by sa(?: [1234] [05])?", r"cc by sa [1234] [05]"),
    "cc-by-nd": ("cc by nd", r"cc by nd(?: [1234] [05])?", r"cc by nd [1234] [05]"),
    "cc-by-nc": ("cc by nc", r"cc by nc(?: [1234] [05])?", r"cc by nc [1234] [05]"),
    "cc-by-nc-sa": ("cc by nc sa", r"cc by nc sa(?: [1234] [05])?", r"cc by nc sa [1234] [05]"),
    "cc-by-nc-nd": ("cc by nc nd", r"cc by nc nd(?: [1234] [05])?", r"cc by nc nd [1234] [05]"),
    "openrail": ("openrail", "(?:bigscience |creativeml )?(?:bloom )?openrail(?: m)?(?: licen[cs]e)?", "openrail"),
    "llama": ("llama", "llama [0-9](?: [0-9])? community licen[cs]e(?: agreement)?", "llama [0-9](?: [0-9])?"),
}

_GIVEN = "licensed|licenced|released|distributed|available|provided|published|redistributed|covered|shared"
_UNDER = (rf"(?:{_GIVEN})(?: to you| for use)? (?:under|by|according to|subject to) (?:the )?"
          r"(?:terms (?:and conditions )?of )?(?:the )?(?:an? )?")
_LATER = r"(?: or(?: at your option)? any later version| or later| only)?"
# form: (pattern around a name or an identifier, what it is put around, its own keyword, priority, relevance)
_FORMS = {
    "grant": (_UNDER + "(?:{}){later}(?: licen[cs]e)?", "name", _GIVEN, 80, 0.95),
    "identified grant": (_UNDER + "(?:{})(?: licen[cs]e)?", "id", _GIVEN, 78, 0.9),
    "tag": ("spdx licen[cs]e identifier (?:{})", "id", "spdx", 90, 1.0),
    "field": ("licen[cs]e (?:{})", "id", "license|licence", 60, 0.8),
    "name": ("(?:the )?(?:{}){later}", "name", None, 50, 0.75),
}
# sentences of license texts and of notices: (label, keyword, pattern, relevance)
_NOTICES = [
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    ("isc", "to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("bsd", "source and binary", "redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission", 0.9),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display", 0.95),
    ("gpl", "free software foundation", "it under the terms of the gnu general public licen[cs]e as published by the free software foundation", 1.0),
    ("lgpl", "free software foundation", "it under the terms of the gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation", 1.0),
    ("agpl-3.0", "free software foundation", "it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation", 1.0),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose", 0.5),
    ("apache-2.0", "in compliance", "you may not use this file except in compliance with the licen[cs]e", 0.95),
    ("apache-2.0", "apache org", "(?:www )?apache org licen[cs]es licen[cs]e 2 0", 1.0),
    ("apache-1.1", "apache org", "(?:www )?apache org licen[cs]es licen[cs]e 1 1", 1.0),
    ("mpl-2.0", "subject to the terms", "this source code form is subject to the terms of the mozilla public licen[cs]e", 1.0),
    ("mpl-2.0", "mozilla org", "mozilla org mpl 2 0", 1.0),
    ("epl-2.0", "eclipse org", "eclipse org legal epl 2 0", 1.0),
    ("epl-1.0", "eclipse org", "eclipse org legal epl v10", 1.0),
    ("bsl-1.0", "boost org", "boost org licen[cs]e 1 0", 1.0),
    ("bsl-1.0", "boost software", "distributed under the boost software licen[cs]e", 0.95),
    ("zlib", "altered source", "altered source versions must be plainly marked as such", 0.9),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
    ("cc0-1.0", "creativecommons org", "creativecommons org publicdomain zero 1 0", 1.0),
    ("cc-by", "creativecommons org", "creativecommons org licen[cs]es by [1234] [05]", 1.0),
    ("cc-by-sa", "creativecommons org", "creativecommons org licen[cs]es by sa [1234] [05]", 1.0),
    ("cc-by-nd", "creativecommons org", "creativecommons org licen[cs]es by nd [1234] [05]", 1.0),
    ("cc-by-nc", "creativecommons org", "creativecommons org licen[cs]es by nc [1234] [05]", 1.0),
    ("cc-by-nc-sa", "creativecommons org", "creativecommons org licen[cs]es by nc sa [1234] [05]", 1.0),
    ("cc-by-nc-nd", "creativecommons org", "creativecommons org licen[cs]es by nc nd [1234] [05]", 1.0),
    ("cc-by", "creative commons", "creative commons attribution(?: licen[cs]e)?(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?", 0.9),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: licen[cs]e)?(?: [1234] [05])?(?: international| unported)?", 0.95),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(?:ative|atives|s)(?: [1234] [05])?", 0.95),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: licen[cs]e)?(?: [1234] [05])?(?: international| unported)?", 0.95),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike(?: [1234] [05])?", 0.97),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)(?: [1234] [05])?", 0.97),
    ("mit", "opensource org", "opensource org licen[cs]es mit(?: licen[cs]e)?(?: php)?", 1.0),
    ("bsd-3-clause", "opensource org", "opensource org licen[cs]es bsd 3 clause", 1.0),
    ("bsd-2-clause", "opensource org", "opensource org licen[cs]es bsd 2 clause", 1.0),
    ("gpl", "gnu org", "gnu org (?:licen[cs]es|copyleft) gpl", 0.95),
    ("lgpl", "gnu org", "gnu org (?:licen[cs]es|copyleft) lesser", 0.95),
    ("agpl-3.0", "gnu org", "gnu org licen[cs]es agpl", 0.95),
    ("ofl-1.1", "reserved font", "with reserved font names?", 0.8),
    ("public-domain", "public domain", "(?:released|dedicated|placed|is) (?:into|to|in) the public domain", 0.8),
    ("proprietary", "all rights", "all rights reserved", 0.4),
    ("proprietary", "proprietary", "(?:proprietary and confidential|confidential and proprietary)", 0.8),
    ("proprietary", "without", "may not be (?:copied|reproduced|distributed)(?: or (?:copied|reproduced|distributed))* without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)", 0.8),
]


def _first_word(ids) -> str:
    """The word, or the alternatives of words, that identifiers begin with."""
    return re.match(r"(?:\(\?:)?([a-z0-9|]+)", ids)[1]


def _written() -> list:
    rules = [Rule(f"base {label}", label, (phrase,), phrase, 40, 0.6, True) for phrase, label in BASE.items()]
    for label, (keyword, names, ids) in _LICENSES.items():
        written = ("license|licence",) * names.endswith("licen[cs]e")
        for name, (around, what, own, priority, relevance) in _FORMS.items():
            inner, gates = (names, (keyword, *written)) if what == "name" else (ids, (_first_word(ids),))
            pattern = around.replace("{later}", _LATER).replace("{}", inner)
            rules.append(Rule(f"{label} {name}", label, gates + (own,) * bool(own), pattern, priority, relevance))
    for i, (label, keyword, pattern, relevance) in enumerate(_NOTICES):
        rules.append(Rule(f"{label} notice {i}", label, (keyword,), pattern, 100, relevance))
    return rules


RULES = _written()

_CLEAN = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
               for b in range(256))


def line_of(text: bytes) -> bytes:
    """The words of a text between single spaces, one before the first and behind the last."""
    words = text.translate(_CLEAN).split()
    return b" " + b" ".join(words) + b" " if words else b" "


class Scanner:
    """Rules made ready: an automaton of their keywords and their patterns."""

    def __init__(self, rules=None):
        import ahocorasick
        self.rules = RULES if rules is None else list(rules)
        self.patterns = [re.compile(f"(?<= )(?:{r.pattern})(?= )".encode()) for r in self.rules]
        self.needed = [[frozenset(k.split("|")) for k in r.keywords] for r in self.rules]
        self.gated, self.automaton = {}, ahocorasick.Automaton()
        for i, needed in enumerate(self.needed):
            for word in needed[0]:
                self.gated.setdefault(word, []).append(i)
        for word in {w for needed in self.needed for some in needed for w in some}:
            self.automaton.add_word(f" {word} ", word)
        self.automaton.make_automaton()

    def open_rules(self, line: bytes) -> list:
        """The rules whose keywords all stand in the line."""
        met = {word for _, word in self.automaton.iter(line.decode("latin-1"))}
        some = {i for word in met for i in self.gated.get(word, ())}
        return sorted(i for i in some if all(met & words for words in self.needed[i]))

    def scan(self, text: bytes):
        """Number of words, all places of base rules and the detections that stay, as
        (first word, behind last word, rule) by place."""
        line = line_of(text)
        n_words = line.count(b" ") - 1
        found, base = [], []
        for i in self.open_rules(line):
            for hit in self.patterns[i].finditer(line):
                found.append((hit.start(), hit.end(), i))
        if not found:
            return max(n_words, 0), base, found
        before = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        ends = np.array([(a, b) for a, b, _ in found])
        first = np.searchsorted(before, ends[:, 0]) - 1
        last = np.searchsorted(before, ends[:, 1])
        spans = [(a, b, i) for a, b, (_, _, i) in zip(first.tolist(), last.tolist(), found)]
        base = [s for s in spans if self.rules[s[2]].base]
        return n_words, sorted(base), self._resolve(spans)

    def _resolve(self, spans) -> list:
        """Detections in order of priority, without those that lie within one taken before."""
        taken, reach = [], _Reach([a for a, _, _ in spans])
        rank = {i: (-self.rules[i].priority, i) for _, _, i in spans}
        for a, b, i in sorted(spans, key=lambda s: (rank[s[2]][0], s[0] - s[1], s[0], rank[s[2]][1])):
            if reach.up_to(a) < b:
                reach.add(a, b)
                taken.append((a, b, i))
        return sorted(taken)


class _Reach:
    """The farthest end of the intervals that start at or before a place (a Fenwick tree of maxima)."""

    def __init__(self, starts):
        self.starts = sorted(set(starts))
        self.far = [0] * (len(self.starts) + 1)

    def add(self, start, end):
        k = bisect_right(self.starts, start)
        while k < len(self.far):
            self.far[k] = max(self.far[k], end)
            k += k & -k

    def up_to(self, start):
        k, far = bisect_right(self.starts, start), 0
        while k:
            far = max(far, self.far[k])
            k -= k & -k
        return far


@lru_cache(maxsize=4)
def scanner(rules=None) -> Scanner:
    return Scanner(rules)


_FOUND = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first_word", pa.int64()),
                             ("last_word", pa.int64()), ("relevance", pa.float64())]))
_FOUND_SQL = "array<struct<label string, rule string, first_word bigint, last_word bigint, relevance double>>"


def scan(docs: DataFrame, rules=None) -> DataFrame:
    """``(doc_id, n_words, base, detections)`` of each row; words count from 0.

    ``base``: every place of a base phrase; ``detections``: what stays after overlaps
    are resolved. Both are structs of label, rule, first and last word, and relevance.
    ``rules``: a tuple of ``Rule``; ``RULES`` without it.
    """
    ready(docs.sparkSession)

    def rows(own, spans):
        return [{"label": own[i].label, "rule": own[i].name, "first_word": a, "last_word": b - 1,
                 "relevance": own[i].relevance} for a, b, i in spans]

    def run(batches):
        tool = scanner(rules)
        for batch in small(batches):
            found = [tool.scan(t) for t in column_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _, _ in found], pa.int64()),
                 pa.array([rows(tool.rules, b) for _, b, _ in found], _FOUND),
                 pa.array([rows(tool.rules, d) for _, _, d in found], _FOUND)],
                names=["doc_id", "n_words", "base", "detections"])

    return texts(docs).mapInArrow(run, f"doc_id bigint, n_words bigint, base {_FOUND_SQL}, detections {_FOUND_SQL}")
