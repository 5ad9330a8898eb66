"""License scan by ordered signature rules.

Texts are folded to lower-case words with one blank between. A keyword has to
be present before a rule's regular expression runs. Detections are taken by
priority, then length, then place; one that lies inside a detection already
taken is suppressed. What is left gives the labels.

The base phrases are counted wherever their words stand in a row, overlapping
ones too, and their labels always stay.

Defined results: a null or wordless text has no words, no places, empty labels
and score 0. Texts are read whole at any length, in time that grows with their
length. Of detections with equal priority the longer, then the earlier one is
taken first, then the one with the smaller label. Repeated rows get equal answers;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import folded_words, table, utf8

BASE = [(b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl")]


@dataclass(frozen=True)
class Rule:
    """priority: greater ones are taken first; confidence in [0, 1] is what the rule adds to the score."""

    label: str
    keyword: bytes
    pattern: bytes
    priority: int
    confidence: float


def _version(v: str) -> str:
    """``3.0`` as it reads after folding: ``3 0``, ``v3 0``, ``version 3`` and so on."""
    head, _, tail = v.partition(".")
    rest = f" {tail}" if tail and tail != "0" else "(?: 0)?"
    return rf"(?:v|version |v )?{head}{rest}"


def signatures() -> list[Rule]:
    """Families, versions and wordings, spelled out into some hundreds of rules."""
    out: list[Rule] = []

    def add(label: str, keyword: str, pattern: str, priority: int, confidence: float) -> None:
        out.append(Rule(label, keyword.encode(), rf"(?<= )(?:{pattern})(?= )".encode(), priority, confidence))

    gnu = [("gpl", "gnu general public license", "1 2 3"), ("lgpl", "gnu (?:lesser|library) general public license", "2 2.1 3"), ("agpl", "gnu affero general public license", "1 3"), ("gfdl", "gnu free documentation license", "1.1 1.2 1.3")]
    for short, name, versions in gnu:
        keyword = "documentation license" if short == "gfdl" else "public license"
        add(short, keyword, name, 40, 0.8)
        add(short, "spdx", rf"spdx license identifier {short}", 45, 0.9)
        for v in versions.split():
            n = _version(v)
            for tail, suffix, p in ((" (?:or (?:at your option )?any later version|or later)", "-or-later", 90), (" only", "-only", 85), ("", "", 80)):
                add(f"{short}-{v}{suffix}", keyword, rf"{name} (?:as published by the free software foundation )?(?:either )?{n}(?: of the license)?{tail}", p, 0.95)
                add(f"{short}-{v}{suffix}", short, rf"{short} ?{n}{tail}", p - 20, 0.85)
            add(f"{short}-{v}", "spdx", rf"spdx license identifier {short} {n}(?: only| or later)?", 95, 1.0)
    for part in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        words = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative|ative work|ative works|atives|s)", "nc": "non ?commercial"}
        name, short = " ".join(words[x] for x in part.split()), part.replace(" ", "-")
        add(f"cc-{short}", "creative commons", rf"creative commons {name}", 50, 0.85)
        for v in "1.0 2.0 2.5 3.0 4.0".split():
            n = _version(v)
            add(f"cc-{short}-{v}", "creative commons", rf"creative commons {name}(?: international| unported| generic)?(?: public)?(?: license)? {n}(?: international| unported| generic)?", 80, 0.95)
            add(f"cc-{short}-{v}", "cc", rf"cc {part} {n}", 75, 0.9)
            add(f"cc-{short}-{v}", "creativecommons", rf"creativecommons org licenses {part} {n}", 85, 1.0)
    for v in "1.0 1.1 2.0".split():
        n = _version(v)
        add(f"apache-{v}", "apache", rf"apache (?:software )?license {n}", 80, 0.95)
        add(f"apache-{v}", "apache", rf"(?:licensed )?under the apache license {n}", 85, 1.0)
        add(f"apache-{v}", "apache", rf"apache (?:license )?{n}", 70, 0.8)
        add(f"apache-{v}", "apache org", rf"apache org licenses license {n}", 85, 1.0)
    for k, word in ((0, "zero"), (1, "one"), (2, "two"), (3, "three"), (4, "four")):
        add(f"bsd-{k}-clause", "bsd", rf"bsd (?:{k}|{word}) clause(?: license)?", 80, 0.95)
        add(f"bsd-{k}-clause", "bsd", rf"(?:{k}|{word}) clause bsd(?: license)?", 80, 0.95)
    for alias, k in (("simplified", 2), ("freebsd", 2), ("new", 3), ("revised", 3), ("modified", 3), ("original", 4), ("old", 4)):
        add(f"bsd-{k}-clause", "bsd", rf"{alias} bsd license", 75, 0.9)
    add("bsd", "bsd", "bsd(?: style)? license", 40, 0.7)
    for label, name, versions in (
        ("mpl", "mozilla public license", "1.0 1.1 2.0"), ("epl", "eclipse public license", "1.0 2.0"), ("cddl", "common development and distribution license", "1.0 1.1"),
        ("eupl", "european union public licen[cs]e", "1.0 1.1 1.2"), ("cpl", "common public license", "1.0"), ("ipl", "ibm public license", "1.0"), ("osl", "open software license", "1.0 2.0 2.1 3.0"),
        ("afl", "academic free license", "1.1 1.2 2.0 2.1 3.0"), ("artistic", "artistic license", "1.0 2.0"), ("zpl", "zope public license", "1.1 2.0 2.1"), ("lppl", "latex project public license", "1.0 1.1 1.2 1.3"),
        ("ofl", "sil open font license", "1.0 1.1"), ("odbl", "open database license", "1.0"), ("odc-by", "open data commons attribution license", "1.0"), ("pddl", "public domain dedication and license", "1.0"),
        ("cecill", "cecill(?: free software)? license", "1.0 1.1 2.0 2.1"), ("ms-pl", "microsoft public license", "1.0"), ("ms-rl", "microsoft reciprocal license", "1.0"), ("psf", "python software foundation license", "2.0"), ("php", "php license", "3.0 3.01"),
        ("qpl", "q public license", "1.0"), ("sspl", "server side public license", "1.0"), ("busl", "business source license", "1.0 1.1"), ("upl", "universal permissive license", "1.0"), ("ncsa", "university of illinois ncsa open source license", "1.0"),
        ("openssl", "openssl license", "1.0"), ("boost", "boost software license", "1.0"), ("wtfpl", "do what the f(?:uck|\\w*) you want to public license", "1.0 2.0"), ("opl", "open publication license", "1.0"), ("rail", "(?:open )?rail(?: m)? license", "1.0"), ("llama", "llama(?: \\d)? community license", "2.0 3.0"),
    ):
        keyword = "licen"
        add(label, keyword, name, 45, 0.85)
        for v in versions.split():
            add(f"{label}-{v}", keyword, rf"{name}(?: agreement)? {_version(v)}", 80, 0.95)
            add(f"{label}-{v}", label.split("-")[0], rf"{label.replace('-', ' ')} ?{_version(v)}", 60, 0.75)
    for label, keyword, pattern, priority, confidence in (
        ("mit", "mit license", "(?:the )?mit license", 40, 0.9), ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 70, 0.95), ("mit", "spdx", "spdx license identifier mit", 90, 1.0),
        ("x11", "x11 license", "x11 license", 50, 0.85), ("isc", "isc license", "(?:the )?isc license", 50, 0.9), ("isc", "permission to use copy", "permission to use copy modify and or distribute this software for any purpose", 60, 0.9),
        ("zlib", "zlib", "zlib(?: libpng)? license", 50, 0.9), ("unlicense", "unlicense", "(?:the )?unlicense", 50, 0.85), ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 80, 1.0),
        ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 70, 0.95), ("cc0-1.0", "publicdomain", "creativecommons org publicdomain zero 1 0", 90, 1.0), ("public-domain", "public domain", "(?:released |placed |dedicated )?(?:in|into|to) the public domain", 35, 0.7),
        ("gpl", "general public license", "general public license", 20, 0.6), ("apache", "apache license", "apache license", 30, 0.8), ("creative-commons", "creative commons", "creative commons(?: license)?", 20, 0.5),
        ("proprietary", "all rights reserved", "all rights reserved", 10, 0.3), ("proprietary", "proprietary", "proprietary and confidential", 30, 0.7), ("beerware", "ware license", "beer ?ware license", 50, 0.8), ("json", "good not evil", "shall be used for good not evil", 60, 0.9),
    ):
        add(label, keyword, pattern, priority, confidence)
    for label, keyword, pattern, priority, confidence in WORDINGS:
        add(label, keyword, pattern, priority, confidence)
    return out


#: Sentences of the licenses' own texts and notices, as they read after folding: label, keyword, pattern, priority, confidence.
WORDINGS = [
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted(?: provided that the following conditions are met)?)?", 55, 0.9),
    ("bsd-3-clause", "endorse or promote", "neither the names? of (?:\\S+ ){1,12}may be used to endorse or promote products derived from this software", 75, 0.95),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 78, 0.95),
    ("bsd-0-clause", "permission to use copy", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)", 62, 0.85),
    ("bsd-source-code", "redistributions of source code", "redistributions of source code must retain the above copyright notice", 45, 0.8),
    ("bsd-2-clause", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice", 45, 0.8),
    ("bsd-3-clause-clear", "patent rights", "no express or implied licenses to any party s patent rights are granted by this license", 76, 0.95),
    ("mit", "the software is provided", "the software is provided as is without warranty of any kind express or implied", 50, 0.85),
    ("mit", "copies or substantial portions", "shall be included in all copies or substantial portions of the software", 60, 0.9),
    ("mit-0", "without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software(?! and to permit persons to whom the software is furnished to do so subject)", 58, 0.7),
    ("x11", "x consortium", "the x consortium", 52, 0.8),
    ("isc", "isc disclaims", "isc disclaims all warranties with regard to this software", 65, 0.9),
    ("isc", "the author disclaims", "the author disclaims all warranties with regard to this software", 58, 0.85),
    ("zlib", "provided as is without any express", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 65, 0.95),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented", 65, 0.95),
    ("boost-1.0", "any person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 75, 0.95),
    ("apache-2.0", "required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 78, 0.95),
    ("apache-2.0", "compliance with the license", "you may not use this file except in compliance with the license", 60, 0.85),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation", 72, 0.9),
    ("gpl", "free software you can", "this program is free software you can redistribute it and or modify it", 30, 0.7),
    ("gpl", "gnu general public", "you should have received a copy of the gnu general public license", 50, 0.85),
    ("lgpl", "gnu lesser general public", "you should have received a copy of the gnu lesser general public license", 52, 0.9),
    ("lgpl", "gnu library general public", "you should have received a copy of the gnu library general public license", 52, 0.9),
    ("agpl", "affero general public", "you should have received a copy of the gnu affero general public license", 52, 0.9),
    ("gpl-classpath-exception", "as a special exception", "as a special exception the copyright holders of this (?:library|program) give you permission to link", 70, 0.9),
    ("gpl", "licenses gpl", "gnu org licenses gpl", 35, 0.7),
    ("lgpl", "licenses lgpl", "gnu org licenses lgpl", 35, 0.75),
    ("agpl", "licenses agpl", "gnu org licenses agpl", 35, 0.75),
    ("gfdl", "modify this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 70, 0.95),
    ("gpl", "copyleft", "gnu copyleft", 25, 0.5),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public license", 78, 0.95),
    ("mpl-1.1", "contents of this file", "the contents of this file are subject to the mozilla public license version 1 1", 82, 0.95),
    ("mpl-2.0", "incompatible with secondary", "incompatible with secondary licenses", 60, 0.8),
    ("mpl", "mozilla org mpl", "mozilla org mpl", 45, 0.8),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license", 60, 0.9),
    ("epl", "eclipse org legal", "eclipse org legal epl", 50, 0.85),
    ("cddl", "common development and distribution", "subject to the terms of the common development and distribution license", 60, 0.9),
    ("eupl", "licensed under the eupl", "licensed under the eupl", 60, 0.9),
    ("unlicense", "unlicense org", "unlicense org", 60, 0.9),
    ("unlicense", "free to copy modify", "anyone is free to copy modify publish use compile sell or distribute this software", 80, 1.0),
    ("cc0-1.0", "waived all copyright", "has waived all copyright and related or neighboring rights", 80, 0.95),
    ("cc0-1.0", "no copyright reserved", "no copyright reserved", 40, 0.6),
    ("public-domain", "disclaims copyright", "the author disclaims copyright to this source code", 60, 0.9),
    ("public-domain", "public domain", "this (?:work|file|code|software|program) is (?:hereby )?(?:in|placed in|dedicated to) the public domain", 50, 0.85),
    ("wtfpl", "you just do what", "you just do what the f(?:uck|\\w*) you want to", 70, 0.95),
    ("beerware", "buy me a beer", "you can buy me a beer in return", 70, 0.95),
    ("artistic", "artistic control", "the copyright holder maintains some semblance of artistic control over the development of the package", 70, 0.95),
    ("artistic-2.0", "artistic license 2 0", "the artistic license 2 0", 75, 0.9),
    ("perl", "same terms as perl", "(?:under|on) the same terms as perl(?: itself)?", 60, 0.9),
    ("ruby", "same terms as ruby", "(?:under|on) the same terms as ruby(?: itself)?", 60, 0.9),
    ("psf", "psf license agreement", "psf license agreement", 55, 0.85),
    ("psf", "python software foundation", "copyright (?:c )?(?:\\d+ )*python software foundation", 50, 0.8),
    ("php", "php net license", "php net license", 55, 0.85),
    ("openssl", "openssl toolkit", "developed by the openssl project for use in the openssl toolkit", 65, 0.95),
    ("ofl", "font software", "the font software is provided as is without warranty of any kind", 60, 0.9),
    ("ofl", "scripts sil org", "scripts sil org ofl", 60, 0.9),
    ("ofl", "reserved font name", "with reserved font names?", 55, 0.85),
    ("bitstream-vera", "bitstream vera", "bitstream vera is a trademark of bitstream", 60, 0.9),
    ("lppl", "latex project", "distributed and or modified under the conditions of the latex project public license", 60, 0.9),
    ("hpnd", "notice appear in supporting", "that both that copyright notice and this permission notice appear in supporting documentation", 60, 0.85),
    ("ntp", "suitability of this software", "makes no representations about the suitability of this software for any purpose", 60, 0.8),
    ("curl", "curl license", "(?:the )?curl license", 50, 0.8),
    ("libpng", "png reference library", "png reference library", 50, 0.8),
    ("ijg", "independent jpeg group", "this software is based in part on the work of the independent jpeg group", 65, 0.9),
    ("tcl", "tcl tk license", "tcl tk license", 50, 0.8),
    ("vim", "vim license", "(?:the )?vim license", 50, 0.8),
    ("w3c", "w3c software", "w3c software(?: and document)?(?: notice and)? license", 60, 0.9),
    ("unicode", "unicode license", "unicode license(?: agreement)?", 50, 0.8),
    ("odbl", "opendatacommons", "opendatacommons org licenses odbl", 65, 0.95),
    ("odc-by", "opendatacommons", "opendatacommons org licenses by", 65, 0.95),
    ("pddl", "opendatacommons", "opendatacommons org licenses pddl", 65, 0.95),
    ("busl", "change date", "on the change date or the fourth anniversary of the first publicly available distribution", 65, 0.9),
    ("sspl", "third parties as a service", "make the functionality of the program or a modified version available to third parties as a service", 65, 0.9),
    ("elastic-2.0", "elastic license", "elastic license 2 0", 65, 0.95),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) license", 60, 0.9),
    ("commons-clause", "commons clause", "commons clause license condition", 60, 0.9),
    ("rail", "use based restrictions", "use based restrictions", 30, 0.5),
    ("cc", "some rights reserved", "some rights reserved", 10, 0.3),
    ("cc-by-nc", "for non commercial", "for non commercial (?:use|purposes) only", 20, 0.4),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction)(?: or distribution)?(?: of this (?:file|document|material))? (?:via any medium )?is (?:strictly )?prohibited", 30, 0.6),
    ("proprietary", "trade secret", "(?:confidential|proprietary) (?:and|or) trade secret", 30, 0.6),
    ("proprietary", "end user license", "end user license agreement", 25, 0.6),
]


class Kept:
    """Intervals that are taken; of these only the outermost matter to what lies inside one."""

    def __init__(self) -> None:
        self.starts: list[int] = []  # both rise from one interval to the next
        self.ends: list[int] = []

    def covers(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start) - 1
        return at >= 0 and self.ends[at] >= end

    def add(self, start: int, end: int) -> None:
        """Takes an interval that none covers; those that lie inside it fall out."""
        at = bisect_left(self.starts, start)
        to = max(at, bisect_right(self.ends, end))
        self.starts[at:to], self.ends[at:to] = [start], [end]


class Scanner:
    """Rules by keyword, in the order of their priorities."""

    def __init__(self, rules: list[Rule]) -> None:
        self.by_keyword: dict[bytes, list[tuple[Rule, re.Pattern]]] = {}
        for r in rules:
            self.by_keyword.setdefault(r.keyword, []).append((r, re.compile(r.pattern)))

    def detections(self, joined: bytes) -> list[tuple[Rule, int, int]]:
        """Rules and intervals that stay, over the words joined and edged by blanks."""
        found = []
        for keyword, rules in self.by_keyword.items():
            if keyword in joined:
                found += [(r, m.start(), m.end()) for r, p in rules for m in p.finditer(joined)]
        found.sort(key=lambda d: (-d[0].priority, d[1] - d[2], d[1], d[0].label))
        kept, outer = [], Kept()
        for d in found:
            if not outer.covers(d[1], d[2]):
                kept.append(d)
                outer.add(d[1], d[2])
        return kept

    def scan(self, text: bytes | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = folded_words(text) if text else []
        joined = b" " + b" ".join(words) + b" "
        places, labels = [], set()
        for phrase, label in BASE:
            at, seen, word = joined.find(b" " + phrase + b" "), 0, 0
            while at >= 0:
                word += joined.count(b" ", seen, at)
                seen = at
                places.append(word)
                labels.add(label)
                at = joined.find(b" " + phrase + b" ", at + 1)
        kept = self.detections(joined)
        own = labels | {r.label for r, _, _ in kept}
        score = max([r.confidence for r, _, _ in kept], default=0.6 if labels else 0.0)
        return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(own)), score)


COLUMNS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def scanned(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., COLUMNS...) of each row."""
    rows = docs.select(*keep, "text")

    def run(batches):
        scanner = Scanner(signatures())
        for batch in batches:
            got = [scanner.scan(t) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate(COLUMNS.values()))], [*keep, *COLUMNS]
            )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in keep)
    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    return rows.mapInArrow(run, fields + ", ".join(f"{c} {kinds[k]}" for c, k in COLUMNS.items()))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))
