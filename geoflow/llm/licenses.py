"""Licence scans by sentence rules.

1. A text is cut into words (lower case; digits keep their points) and sentence starts: the
   first word, and every word after a line break, a sentence end, or an opening mark.
2. A known licence sentence that begins at a sentence start gives its identifier.
   Sentences may run over line breaks, as licence texts are wrapped.
3. A notice is an opening ("licensed under", "released under the terms of", "free software:
   you can redistribute it ... under", "SPDX-License-Identifier:") and the names of one or
   more licences, so that each licence has one identifier for all openings. It may stand
   anywhere in a sentence and begins with "this <noun> is", if that precedes; a version and
   "or later" are kept if given. A negated opening ("not licensed under") is none.
4. The identifiers of a text are a sequence. Licence rules are ordered lists of identifiers,
   those with most sentences first; a rule matches if its identifiers follow each other with
   no more than ``gap`` words between them. An identifier belongs to one match only.

Null and empty texts have no licence. Equal rows are equal; where two known sentences begin
at one word the longer is taken. A licence named without a version has none in its name.
Very long texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geoflow.llm.common import slices

#: Known sentences of public licences, by identifier. Fixed values.
SENTENCES = (
    ("rights", "all rights reserved"),
    ("apache-not", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("apache-asis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-asis", "the software is provided as is and the author disclaims all warranties"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-names", "neither the name of"),
    ("bsd-asis", "this software is provided by the copyright holders and contributors as is"),
    ("gnu-hope", "this program is distributed in the hope that it will be useful"),
    ("gnu-hope", "this library is distributed in the hope that it will be useful"),
    ("mpl-copy", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-zero-law", "to the extent possible under law"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Names of licences in notices: identifier, pattern, and whether a licence word, a version or a "licensed" must be by it.
#: The first that fits counts. ``~`` stands for what is between words. Fixed values.
NAMES = (
    ("agpl", r"(?:gnu~)?affero~(?:general~public~licen[sc]e|gpl)|(?:gnu~)?agpl", False),
    ("lgpl", r"(?:gnu~)?(?:lesser|library)(?:~or~lesser)?~(?:general~public~licen[sc]e|gpl)|(?:gnu~)?lgpl", False),
    ("gpl", r"(?:gnu~)?general~public~licen[sc]e|(?:gnu~)?gpl", False),
    ("apache", r"apache(?:~software)?(?:~public)?(?:~licen[sc]e)?", True),
    ("mit", r"(?:mit|expat)(?:~(?:x11|expat|open~source|software))?(?:~style)?(?:~licen[sc]e)?", True),
    ("isc", r"isc(?:~licen[sc]e)?", True),
    ("bsd-3", r"(?:(?:3|three)~clause|new|modified|revised)~bsd|bsd~(?:3|three)~clause", False),
    ("bsd-2", r"(?:(?:2|two)~clause|simplified|freebsd)~bsd|bsd~(?:2|two)~clause", False),
    ("bsd", r"bsd", False),
    ("mpl", r"mozilla(?:~public)?~licen[sc]e|mpl", False),
    ("cc-zero", r"cc~?0|(?:creative~commons|cc)~(?:zero|cc0)", False),
    ("cc", r"(?:creative~commons|cc)(?:~(?:attribution|by))?(?:~(?:non~?commercial|nc|no~?deriv(?:s|ative|atives)?(?:~works)?|nd|share~?alike|sa)(?![a-z]))*", False),
    ("epl", r"eclipse~public~licen[sc]e|epl", False),
    ("boost", r"boost~software~licen[sc]e|bsl", False),
    ("unlicense", r"unlicen[sc]e", False),
)

#: What the licences of ``NAMES`` that give one are called; ``#`` takes the version found.
_NAMED = {"agpl": "AGPL-#", "lgpl": "LGPL-#", "gpl": "GPL-#", "apache": "Apache-#", "mit": "MIT", "isc": "ISC", "bsd-3": "BSD-3-Clause",
          "bsd-2": "BSD-2-Clause", "bsd": "BSD", "mpl": "MPL-#", "cc-zero": "CC0-#", "epl": "EPL-#", "boost": "BSL-#", "unlicense": "Unlicense"}
_COMMONS = ("cc", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd")
_GNU = ("gpl", "lgpl", "agpl")

#: Ordered licence rules: name and identifiers. ``#`` in a name takes the version found. Fixed values.
RULES = (
    ("Apache-#", ("apache", "apache-not", "apache-copy", "apache-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("MPL-#", ("mpl", "mpl-copy")),
    *((name, (one, *rest)) for g in _GNU for one, name in ((g + "-later", _NAMED[g] + "-or-later"), (g, _NAMED[g])) for rest in (("gnu-hope",), ())),
    *((name, (one, *rest)) for one, name in ((c, c.upper() + "-#") for c in _COMMONS) for rest in ((one + "-url",), ())),
    *((c.upper() + "-#", (c + "-url",)) for c in _COMMONS),
    ("CC0-#", ("cc-zero-law", "cc-zero-waived", "cc-zero-url")),
    ("CC0-#", ("cc-zero-law", "cc-zero-waived")),
    ("CC0-#", ("cc-zero", "cc-zero-url")),
    ("CC0-#", ("cc-zero-url",)),
    *((name, (one,)) for one, name in _NAMED.items() if one not in _GNU),
    ("All-Rights-Reserved", ("rights",)),
)

_WORD = re.compile(r"[a-z]+[0-9]?|[0-9]+(?:\.[0-9]+)*")
_BREAK = re.compile(r"[\n\r.!?;:*\"'(\[]|//")


def _pattern(words: str) -> re.Pattern:
    return re.compile(words.replace("~", "(?:[^a-z0-9]+)"))


_START = r"(?<![a-z0-9])"
_LATER = r"(?P<{}>\+|~or~(?:at~your~option~)?(?:any~)?(?:later|newer)(?:~versions?)?)?"
#: Words of one sentence between a verb and "under" ("licenses this file to you under").
_FEW = r"(?:[^a-z0-9.!?]+[a-z0-9]+){0,4}?"
_OPENING = _pattern(
    _START + r"(?:free~software~(?:and~)?you~(?:can|may)~(?:re)?distribute~it~and~or~modify~it~under"
    r"|(?P<sure>(?:re)?licen[sc](?:ed|es?))" + _FEW + r"~(?:under|by)"
    r"|(?:released|(?:re)?distributed|available|published|provided|offered|shared|issued|covered|governed|used?|usable|made)" + _FEW + r"~(?:under|by)"
    r"|(?:subject~to|accordance~with|bound~by)(?=~(?:the~)?terms)"
    r"|(?P<label>(?:spdx~)?licen[sc]e(?:~identifier)?[ \t]*[:=]))")
_BEFORE_NAME = _pattern(
    r"~(?:(?:the~)?(?:same~)?(?:terms|conditions)(?:~and~conditions)?~of~)?(?:(?:either~)?(?:the~)?(?:version|ver|v)~?(?P<version>[0-9]+(?:\.[0-9]+)*)"
    + _LATER.format("later") + r"~(?:of~)?)?(?:(?:the|an?|this|either|both|terms|of)~)*")
_AFTER_NAME = _pattern(
    r"(?:[- ]style)?(?:~(?:public~)?licen[sc]e)?(?:~[al]?gpl(?![a-z]))?(?:\s*\([a-z \"]{1,40}\))?(?:~as~published~by~the~free~software~foundation)?"
    r"(?:(?:~(?:either~)?(?:the~)?(?:version|ver|v)~?|[ \t,(/-]*v?|\s+(?=[0-9]\.[0-9]))(?P<version>[0-9]{1,2}(?:\.[0-9]{1,2})*)(?![a-z0-9]|\.[0-9])"
    r"(?:~(?:of~the~(?:gnu~)?(?:gpl|licen[sc]e)))?)?" + _LATER.format("later"))
_NEXT_NAME = _pattern(r"\s*(?:[,/]|(?:[, ]|\s)\s*(?:and/or|and|or)(?=\s))(?:\s*(?:and/or|and|or)(?=\s))?(?:~under)?(?=~)|(?=[ \t]*[/])")
_SUBJECT = re.compile(r"(?<![a-z0-9])(?:this|these|the|all)(?:[^a-z0-9.!?;]+[a-z0-9]+){0,8}?[^a-z0-9.!?;]+(?:is|are)(?:[^a-z0-9.!?;]+[a-z]+)?[^a-z0-9.!?;]+$")
_NOT = re.compile(r"(?:(?<![a-z])(?:not|never|no longer)|n['\u2019]t)(?! only)(?:[^a-z0-9.!?;]+[a-z]+){0,2}[^a-z0-9.!?;]+$")
_NAMES = tuple((name, _pattern(f"(?:{words})(?!(?!v[0-9])[a-z])"), strict) for name, words, strict in NAMES)
_URL = re.compile(r"creativecommons\.org/(?:licenses/(by(?:-nc)?(?:-nd|-sa)?)|publicdomain/(zero))/([0-9]\.[0-9])")
_WAIVED = _pattern(_START + r"waived~all~copyright~and~related~or~neighbou?ring~rights")


def _commons(words: str) -> str:
    """The identifier of a Creative Commons licence by its words."""
    if not re.search(r"(?<![a-z])(?:attribution|by)(?![a-z])", words):
        return "cc"
    return "cc-by" + "-nc" * bool(re.search(r"non|(?<![a-z])nc", words)) + (
        "-nd" if re.search(r"deriv|(?<![a-z])nd", words) else "-sa" if re.search(r"share|(?<![a-z])sa", words) else "")


def notices(low: str) -> list[tuple[str, str, int, int]]:
    """(identifier, version, start, end) of each licence that a notice names, in a text in lower case."""
    found = []
    for opening in _OPENING.finditer(low) if "licen" in low or "under" in low or " by" in low or "terms" in low else ():
        start, at = opening.start(), opening.end()
        before = low[max(0, start - 160):start]
        if _NOT.search(before):
            continue
        subject = _SUBJECT.search(before)
        first = start - len(before) + subject.start() if subject else start
        while prefix := _BEFORE_NAME.match(low, at):
            named = next(((name, m, strict) for name, p, strict in _NAMES if (m := p.match(low, prefix.end()))), None)
            if named is None:
                break
            name, m, strict = named
            after = _AFTER_NAME.match(low, m.end())
            if strict and not (opening["sure"] or opening["label"] or after["version"] or "licen" in m[0] + after[0]):
                break
            if name == "cc":
                name = _commons(m[0])
            version = after["version"] if after["version"] and name not in ("mit", "isc", "bsd", "bsd-2", "bsd-3", "unlicense") else None
            end = after.end() if after["version"] is None or version else m.end()
            if name in _GNU and (after["later"] or prefix["later"]):
                name += "-later"
            version = version or prefix["version"] or ""
            if name.removesuffix("-later") in _GNU:
                version = version.removesuffix(".0")
            elif version.isdigit():
                version += ".0"  # one name for "v2" and "Version 2.0"
            found.append((name, version, first, end))
            following = _NEXT_NAME.match(low, end)
            if not following:
                break
            at = first = following.end()
            first += len(_BEFORE_NAME.match(low, at)[0]) if _BEFORE_NAME.match(low, at) else 0
    for m in _URL.finditer(low) if "creativecommons.org" in low else ():
        found.append(("cc-" + (m[1] or m[2]) + "-url", m[3], m.start(), m.end()))
    found += [("cc-zero-waived", "", m.start(), m.end()) for m in _WAIVED.finditer(low)] if "waived" in low else []
    return found



@dataclass(frozen=True)
class Rules:
    sentences: tuple = SENTENCES
    rules: tuple = RULES
    gap: int = 60


class Recogniser:
    """Known sentences by their first two words, and rules by their first identifier."""

    def __init__(self, given: Rules = Rules()):
        self.gap = given.gap
        self.by_start: dict[tuple[str, str], list] = defaultdict(list)
        for name, sentence in given.sentences:
            words = tuple(sentence.split())
            self.by_start[words[0], words[1]].append((name, words))
        for known in self.by_start.values():
            known.sort(key=lambda x: -len(x[1]))
        self.firsts = {a for a, _ in self.by_start}
        # A text without the rarest-looking word of any known sentence is not cut into words for sentences.
        self.hints = tuple({max(s.split(), key=len) for _, s in given.sentences})
        self.rules: dict[str, list] = defaultdict(list)
        for name, ids in sorted(given.rules, key=lambda x: -len(x[1])):
            self.rules[ids[0]].append((name, ids))

    def sentences(self, text: str) -> list[tuple[str, str, int, int, int, int]]:
        """(identifier, version, start, end, first word, word after) of each known sentence, in order."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)  # places stay those of the text
        named, hinted = notices(low), any(h in low for h in self.hints)
        if not named and not hinted:
            return []
        marks = [(m[0], m.start(), m.end()) for m in _WORD.finditer(low)]
        found, free = [], 0
        for at, (word, start, _) in enumerate(marks[:-1]) if hinted else ():
            if at < free or word not in self.firsts or (word, marks[at + 1][0]) not in self.by_start:
                continue
            if at and not _BREAK.search(low, marks[at - 1][2], start):
                continue
            for name, words in self.by_start[word, marks[at + 1][0]]:
                own = marks[at:at + len(words)]
                if len(own) == len(words) and all(w == m[0] for w, m in zip(words, own)):
                    found.append((name, "", start, own[-1][2], at, at + len(words)))
                    free = at + len(words)
                    break
        starts = [m[1] for m in marks]
        found += [(name, version, a, b, bisect_left(starts, a), bisect_left(starts, b)) for name, version, a, b in named]
        found.sort(key=lambda x: (x[2], -x[3]))
        out, end = [], 0
        for one in found:
            if one[2] >= end:
                out.append(one)
                end = one[3]
        return out

    def licences(self, text: str) -> tuple[int, list[tuple[str, int, int]]]:
        """The number of known sentences, and (licence, start, end) of each match in order."""
        known = self.sentences(text)
        used = [False] * len(known)
        out = []
        for at in range(len(known)):
            if used[at]:
                continue
            for name, ids in self.rules.get(known[at][0], ()):
                chain = [at]
                for wanted in ids[1:]:
                    following = next((k for k in range(chain[-1] + 1, len(known)) if known[k][4] - known[chain[-1]][5] <= self.gap
                                      and known[k][0] == wanted and not used[k]), None)
                    if following is None:
                        break
                    chain.append(following)
                if len(chain) == len(ids):
                    version = next((known[k][1] for k in chain if known[k][1]), "")
                    for k in chain:
                        used[k] = True
                    out.append((name.replace("#", version) if version else name.replace("-#", ""), known[at][2], known[chain[-1]][3]))
                    break
        return len(known), out


FOUND = T.StructType([T.StructField("n_sentences", T.LongType()), T.StructField("n_licenses", T.LongType()),
                      T.StructField("licenses", T.StringType()), T.StructField("spans", T.StringType())])


def scan(text: Column, given: Rules = Rules()) -> Column:
    """A struct column ``FOUND``: distinct licences sorted, and ``licence:start:end`` of each match."""
    schema = pa.struct(list(to_arrow_schema(FOUND)))

    @F.arrow_udf(FOUND)
    def scanned(texts: pa.Array) -> pa.Array:
        recogniser, rows = Recogniser(given), []
        for _, some in slices(texts):
            for one in some:
                n, matches = recogniser.licences(one or "")
                names = sorted({m[0] for m in matches})
                rows.append({"n_sentences": n, "n_licenses": len(names), "licenses": ",".join(names),
                             "spans": ",".join(f"{a}:{b}:{c}" for a, b, c in matches)})
        return pa.array(rows, schema)

    return scanned(text)


def scan_documents(docs: DataFrame, given: Rules = Rules(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id_col`` and the fields of ``FOUND``."""
    return docs.select(F.col(id_col), scan(F.col(text), given).alias("_f")).select(id_col, "_f.*")
