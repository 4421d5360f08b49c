"""Operator 5 [native]: license scans by ordered signature rules.

RULES holds hundreds of regexes: signatures of license texts and notices written out one by one, and the forms in which
texts name a license, from a table of their names and versions. A rule is tried only on texts that hold one of its keys (a
word of ASCII letters and digits that stands alone in each of its matches) and its further text, so that nothing is lost;
which keys a text holds is found in one pass over its words. Matches are intervals of the lower-cased text. An interval
that lies within another one of the same or a better priority is suppressed, so that "apache license" says nothing beside
"apache license, version 2.0". Three base phrases are counted word by word besides. Everything runs in DataFrame expressions.

Defined cases: null and empty texts have no words, no labels (empty strings) and score 0. Of equal intervals the one of
better priority, then of the smaller label, is kept. Rows repeat as in the input, and an empty table gives none. Only A-Z
are lower-cased. The input's columns stay, but for those of a result's name, which give way to it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: How sure a detection of each priority is.
SURE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.6}
# Licenses: identifier, name as a regex, keys, versions. A key that ends a name also stands with a version behind it.
_PLAIN = (
    ("mit", r"mit", ("mit",), ()),
    ("isc", r"isc", ("isc",), ()),
    ("zlib", r"zlib", ("zlib",), ()),
    ("unlicense", r"(?:the )?unlicense", ("unlicense",), ()),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)", ("wtfpl", "fuck"), ()),
    ("apache", r"apache(?: software)?", ("apache",), ("1.0", "1.1", "2.0")),
    ("bsd-2-clause", r"(?:bsd[- ]2[- ]clause|simplified bsd|freebsd)", ("bsd", "freebsd"), ()),
    ("bsd-3-clause", r"(?:bsd[- ]3[- ]clause|new bsd|modified bsd|revised bsd)", ("bsd",), ()),
    ("bsd-4-clause", r"(?:bsd[- ]4[- ]clause|original bsd)", ("bsd",), ()),
    ("gpl", r"(?:gnu general public|gnu gpl|gpl)", ("gnu", "gpl"), ("1.0", "2.0", "3.0")),
    ("lgpl", r"(?:gnu (?:lesser|library) general public|gnu lgpl|lgpl)", ("gnu", "lgpl"), ("2.0", "2.1", "3.0")),
    ("agpl", r"(?:gnu affero general public|gnu agpl|agpl)", ("gnu", "agpl"), ("1.0", "3.0")),
    ("gfdl", r"(?:gnu free documentation|gfdl)", ("gnu", "gfdl"), ("1.1", "1.2", "1.3")),
    ("mpl", r"(?:mozilla public|mpl)", ("mozilla", "mpl"), ("1.0", "1.1", "2.0")),
    ("epl", r"(?:eclipse public|epl)", ("eclipse", "epl"), ("1.0", "2.0")),
    ("eupl", r"(?:european union public|eupl)", ("european", "eupl"), ("1.0", "1.1", "1.2")),
    ("cddl", r"(?:common development and distribution|cddl)", ("development", "cddl"), ("1.0", "1.1")),
    ("cpl", r"common public", ("common",), ("1.0",)),
    ("artistic", r"(?:perl )?artistic", ("artistic",), ("1.0", "2.0")),
    ("bsl", r"boost(?: software)?", ("boost",), ("1.0",)),
    ("afl", r"academic free", ("academic",), ("1.1", "2.0", "2.1", "3.0")),
    ("osl", r"open software", ("open",), ("1.0", "2.0", "2.1", "3.0")),
    ("ecl", r"educational community", ("educational",), ("1.0", "2.0")),
    ("ofl", r"(?:sil )?open font", ("font",), ("1.0", "1.1")),
    ("php", r"php", ("php",), ("3.0", "3.01")),
    ("psf", r"(?:python software foundation|psf)", ("python", "psf"), ("2.0",)),
    ("ncsa", r"(?:university of illinois/)?ncsa(?: open source)?", ("ncsa",), ()),
    ("ms-pl", r"microsoft public", ("microsoft",), ()),
    ("ms-rl", r"microsoft reciprocal", ("microsoft",), ()),
    ("qpl", r"q public", ("q",), ("1.0",)),
    ("vim", r"vim", ("vim",), ()),
    ("postgresql", r"postgresql", ("postgresql",), ()),
    ("openssl", r"openssl", ("openssl",), ()),
    ("w3c", r"w3c(?: software)?", ("w3c",), ()),
    ("upl", r"universal permissive", ("universal",), ("1.0",)),
    ("mulan-psl", r"mulan permissive software", ("mulan",), ("1.0", "2.0")),
    ("odbl", r"(?:open data commons open database|open database|odbl)", ("database", "odbl"), ("1.0",)),
    ("odc-by", r"open data commons attribution", ("commons",), ("1.0",)),
    ("cecill", r"cecill", ("cecill",), ("1.0", "1.1", "2.0", "2.1")),
    ("rpl", r"reciprocal public", ("reciprocal",), ("1.1", "1.5")),
    ("sspl", r"server side public", ("server",), ("1.0",)),
    ("busl", r"business source", ("business",), ("1.1",)),
)
# Signatures of license texts and notices: priority, label, key, regex. A space stands for any run of white space.
_WRITTEN = (
    (2, "mit", "hereby", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (2, "mit", "notice", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software"),
    (2, "x11", "advertising", r"shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software"),
    (2, "json", "evil", r"the software shall be used for good, not evil"),
    (2, "isc", "purpose", r"permission to use, copy, modify,? (?:and|and/or|and distribute|or distribute) (?:/or )?(?:distribute )?this software for any purpose with or without fee is hereby granted, provided"),
    (2, "0bsd", "purpose", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\."),
    (2, "hpnd", "documentation", r"permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    (2, "postgresql", "documentation", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    (2, "bsd", "redistribution", r"redistribution and use in source and binary forms,? with or without modification,? (?:are|is) permitted"),
    (2, "bsd", "redistributions", r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer\."),
    (2, "bsd", "reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    (2, "bsd-3-clause", "endorse", r"neither the names? of .{1,120} nor the names of (?:its|his|her|their|the) contributors may be used to endorse or promote products"),
    (2, "bsd-3-clause", "endorse", r"the name of the author may not be used to endorse or promote products derived from this software"),
    (2, "bsd-4-clause", "mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (2, "ncsa", "disclaimers", r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers"),
    (2, "apache-2", "compliance", r"you may not use this file except in compliance with the license"),
    (2, "apache-2", "agreed", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an .as is. basis"),
    (2, "apache-1.1", "foundation", r"this product includes software developed by the apache software foundation"),
    (2, "apache-2", "contributor", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    (2, "gpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu general public license"),
    (1, "gpl-2-or-later", "gnu", r"gnu general public license as published by the free software foundation[,;] either version 2 of the license, or \(at your option\) any later version"),
    (1, "gpl-3-or-later", "gnu", r"gnu general public license as published by the free software foundation[,;] either version 3 of the license, or \(at your option\) any later version"),
    (1, "gpl-2-only", "gnu", r"gnu general public license,? version 2(?: only|,? as published by the free software foundation)"),
    (1, "gpl-3-only", "gnu", r"gnu general public license,? version 3(?: only|,? as published by the free software foundation)"),
    (2, "gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.{1,400}copyleft"),
    (2, "gpl", "receive", r"you must make sure that they, too, receive or can get the source code.{1,400}freedoms"),
    (2, "lgpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license"),
    (1, "lgpl-2-or-later", "gnu", r"gnu library general public license as published by the free software foundation[,;] either version 2 of the license, or \(at your option\) any later version"),
    (1, "lgpl-2.1-or-later", "gnu", r"gnu lesser general public license as published by the free software foundation[,;] either version 2\.1 of the license, or \(at your option\) any later version"),
    (1, "lgpl-3-or-later", "gnu", r"gnu lesser general public license as published by the free software foundation[,;] either version 3 of the license, or \(at your option\) any later version"),
    (2, "agpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu affero general public license"),
    (1, "agpl-3-or-later", "gnu", r"gnu affero general public license as published by the free software foundation[,;] either version 3 of the license, or \(at your option\) any later version"),
    (2, "gfdl", "document", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    (2, "gpl-classpath", "exception", r"classpath exception"),
    (2, "gpl-linking", "exception", r"as a special exception, .{1,200} permission to link"),
    (2, "mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    (2, "mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    (2, "epl-1", "eclipse", r"made available under the terms of the eclipse public license v1\.0"),
    (2, "epl-2", "eclipse", r"made available under the terms of the eclipse public license (?:v\. ?2\.0|2\.0)"),
    (2, "cddl", "development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    (2, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    (2, "unlicense", "dedication", r"we make this dedication for the benefit of the public at large and to the detriment of our heirs.{1,300}interest"),
    (2, "wtfpl", "fuck", r"you just do what the fuck you want to"),
    (2, "zlib", "liable", r"this software is provided 'as-is', without any express or implied warranty\. in no event will the authors? be held liable"),
    (2, "zlib", "altered", r"altered source versions must be plainly marked as such, and must not be misrepresented"),
    (2, "bsl-1", "organization", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    (2, "beerware", "stuff", r"as long as you retain this notice you can do whatever you want with this stuff"),
    (2, "beerware", "beer", r"(?:you can buy me a beer in return|the beer-ware license)"),
    (2, "ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    (2, "openssl", "openssl", r"this product includes software developed by the openssl project"),
    (2, "ssleay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    (2, "psf-2", "licensee", r"psf hereby grants licensee a nonexclusive, royalty-free, world-?wide license"),
    (2, "ofl-1.1", "fonts", r"the fonts and derivatives, however, cannot be released under any other type of license"),
    (2, "ofl", "reserved", r"with reserved font name"),
    (2, "artistic-2", "establishes", r"this license establishes the terms under which a given free software package may be copied, modified, distributed"),
    (2, "artistic-1", "artistic", r"the artistic license preamble the intent of this document"),
    (2, "ms-pl", "accompanying", r"this license governs use of the accompanying software\. if you use the software, you accept this license"),
    (2, "eupl", "eupl", r"licensed under the eupl"),
    (2, "cc0-1.0", "waived", r"has waived all copyright and related or neighboring rights"),
    (2, "cc0-1.0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    (3, "cc", "commons", r"this (?:work|article|book|file|image|dataset) is licensed under (?:a|the) creative commons"),
    (3, "cc", "commons", r"creative commons licen[cs]e"),
    (2, "commons-clause", "clause", r"commons clause"),
    (2, "elastic-2", "elastic", r"elastic license (?:v2|2\.0)"),
    (2, "busl-1.1", "grant", r"additional use grant"),
    (2, "llama", "llama", r"llama [0-9](?:\.[0-9])? community license"),
    (2, "gemma", "gemma", r"gemma terms of use"),
    (2, "openrail", "rail", r"(?:bigscience|creativeml|bigcode) rail"),
    (2, "openrail", "openrail", r"openrail(?:-m|\+\+-m)?"),
    (2, "cdla-permissive", "permissive", r"community data license agreement -? ?permissive"),
    (2, "cdla-sharing", "sharing", r"community data license agreement -? ?sharing"),
    (2, "pddl", "dedication", r"public domain dedication and licen[cs]e"),
    (2, "ogl-uk", "government", r"open government licen[cs]e"),
    (2, "etalab", "licence", r"(?:licence ouverte|open licence) .{0,20}etalab"),
    (2, "ogl-games", "gaming", r"open gaming license"),
    (3, "public-domain", "domain", r"(?:placed|released|dedicated|put|is|are) (?:in|into|to) the public domain"),
    (3, "public-domain", "domain", r"no rights reserved.{0,40}public domain"),
    (3, "all-rights-reserved", "reserved", r"all rights reserved"),
    (3, "proprietary", "prior", r"(?:reproduced|distributed|transmitted|copied|used)[a-z, ]{0,120} without (?:the )?(?:express )?prior (?:written )?(?:permission|consent)"),
    (3, "proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    (3, "proprietary", "prohibited", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)[a-z, ]{0,60} (?:is )?(?:strictly )?prohibited"),
    (3, "non-commercial", "only", r"for (?:personal|educational|academic|research|non-?commercial)(?:,? (?:and |or )?(?:personal|educational|academic|research|non-?commercial))* (?:use|purposes) only"),
    (3, "non-commercial", "commercial", r"(?:not for|no) commercial use"),
    (3, "dual-mit-gpl", "dual", r"dual[- ]licensed under (?:the )?(?:mit|gpl)(?: license)?,? (?:and|or) (?:the )?(?:mit|gpl)"),
    (3, "dual-mit-apache-2", "either", r"licensed under either of (?:the )?(?:apache license|mit license)"),
    (4, "apsl", "apple", r"apple public source license"),
    (4, "ipl", "ibm", r"ibm public license"),
    (4, "spl", "sun", r"sun public license"),
    (4, "npl", "netscape", r"netscape public license"),
    (4, "nokia", "nokia", r"nokia open source license"),
    (4, "lpl", "lucent", r"lucent public license"),
    (4, "rpsl", "realnetworks", r"realnetworks public source license"),
    (4, "watcom", "watcom", r"sybase open watcom public license"),
    (4, "zpl", "zope", r"zope public license"),
    (4, "zimbra", "zimbra", r"zimbra public license"),
    (4, "vovida", "vovida", r"vovida software license"),
    (4, "intel", "intel", r"intel open source license"),
    (4, "motosoto", "motosoto", r"motosoto open source license"),
    (4, "naumen", "naumen", r"naumen public license"),
    (4, "ngpl", "nethack", r"nethack general public license"),
    (4, "oclc", "oclc", r"oclc research public license"),
    (4, "efl", "eiffel", r"eiffel forum license"),
    (4, "entessa", "entessa", r"entessa public license"),
    (4, "fair", "fair", r"fair license"),
    (4, "frameworx", "frameworx", r"frameworx open license"),
    (4, "josl", "jabber", r"jabber open source license"),
    (4, "multics", "multics", r"multics license"),
    (4, "nasa", "nasa", r"nasa open source agreement"),
    (4, "cuaopl", "cua", r"cua office public license"),
    (4, "catosl", "trusted", r"computer associates trusted open source license"),
    (4, "apl", "adaptive", r"adaptive public license"),
    (4, "aal", "assurance", r"attribution assurance license"),
    (4, "cal", "cryptographic", r"cryptographic autonomy license"),
    (4, "liliq", "liberty", r"liberty of quebec license"),
    (4, "oset", "oset", r"oset public license"),
    (4, "ruby", "ruby", r"ruby licen[cs]e"),
    (4, "latex", "latex", r"latex project public license"),
    (4, "sleepycat", "sleepycat", r"sleepycat license"),
    (4, "simple-public", "simple", r"simple public license"),
    (4, "blue-oak", "oak", r"blue oak model license"),
    (4, "parity", "parity", r"parity public license"),
    (4, "polyform", "polyform", r"polyform (?:noncommercial|shield|strict|small business|perimeter) license"),
    (4, "hippocratic", "hippocratic", r"hippocratic license"),
    (4, "anti-996", "996", r"anti[- ]996 license"),
    (4, "confluent", "confluent", r"confluent community license"),
    (4, "timescale", "timescale", r"timescale license"),
    (4, "redis", "redis", r"redis source available license"),
)
_COMMONS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
_COMMONS_NAMES = {"by": "attribution", "sa": "share[- ]?alike", "nd": "no[- ]?deriv(?:ative)?s?(?: works)?", "nc": "non[- ]?commercial"}
_COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _version(v: str) -> str:
    major, _, minor = v.partition(".")
    return major + (r"(?:\.0)?(?!\.?\d)" if minor == "0" else rf"\.{minor}(?!\d)")


def spaced(regex: str) -> str:
    """The regex with each space outside brackets as any run of white space."""
    return re.sub(r"(\[[^\]]*\])| ", lambda m: m[1] or r"\s+", regex)


def rules() -> list[tuple[int, str, tuple[str, ...], str, str]]:
    """(priority, label, keys, further text, regex over lower-cased text), in order. Each match of the regex holds one of the
    keys as a word of its own, and the further text."""
    lead, end = r"(?<![0-9a-z])", r"(?![0-9a-z])"
    out = [(priority, label, (key,), "", rf"{lead}(?:{spaced(regex)}){end}") for priority, label, key, regex in _WRITTEN]
    under = r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?"
    for label, name, keys, versions in _PLAIN:
        out.append((1, label, ("identifier",), label, rf"spdx-license-identifier:\s*{label.replace('.', '[.]')}{end}"))
        out.append((2, label, ("licenses",), label, rf"opensource\.org/licenses/{label}{end}"))
        out.append((3, label, keys, " under ", rf"{under}{name}(?: licen[cs]e)?{end}"))
        out.append((4, label, keys, " licen", rf"{lead}{name} licen[cs]e{end}"))
        for v in versions:
            tail = rf"(?:,? \(?(?:version |v\.? ?)?|-?v?){_version(v)}"
            full = f"{label}-{v.removesuffix('.0')}"
            out.append((1, full, ("identifier",), f"{label}-{v}", rf"spdx-license-identifier:\s*{label}-{v.replace('.', '[.]')}"))
            major = v.partition(".")[0]
            followed = tuple(k + x for k in keys for x in ("", major, f"v{major}"))
            out.append((2, full, followed, v[0], rf"(?:{under}|{lead}){name}(?: licen[cs]e)?{tail}"))
    for kind in _COMMONS:
        name = "[- ]".join(_COMMONS_NAMES[x] for x in kind.split("-"))
        short = kind.replace("-", "[- ]")
        out.append((4, f"cc-{kind}", ("cc",), "", rf"{lead}cc[- ]{short}(?![- ]?(?:nc|sa|nd)){end}"))
        out.append((3, f"cc-{kind}", ("commons",), "", rf"creative commons {name}{end}"))
        out.append((2, f"cc-{kind}", ("licenses",), "", rf"creativecommons\.org/licenses/{kind}/"))
        for v in _COMMONS_VERSIONS:
            out.append((2, f"cc-{kind}-{v}", ("cc",), v, rf"{lead}cc[- ]{short}[- ]{v.replace('.', '[.]')}(?!\d)"))
    out.append((2, "cc0-1.0", ("cc0",), "", rf"{lead}cc0(?:[- ]1\.0)?{end}"))
    return sorted(out, key=lambda r: r[0])


RULES = rules()


def _rule_table() -> Column:
    """RULES as one literal array; its size is that of this module's table."""
    return F.array(*(F.struct(F.lit(priority).alias("priority"), F.lit(label).alias("label"), F.array(*map(F.lit, keys)).alias("keys"), F.lit(further).alias("further"), F.lit(regex).alias("regex")) for priority, label, keys, further, regex in RULES))


def _keys_in(low: Column) -> Column:
    """The keys of rules, and the words of base phrases, that stand in a lower-cased text as words of ASCII letters and digits."""
    every = sorted({k for r in RULES for k in r[2]} | {w for phrase, _ in BASE for w in phrase.split()})
    return F.array_intersect(F.split(low, "[^0-9a-z]+"), F.array(*map(F.lit, every)))


def _matches(low: Column, rule: Column) -> Column:
    """Each match of the rule as (start, minus end, priority, label): what lies between matches gives their places."""
    parts = F.split(low, rule["regex"], -1)
    found = F.regexp_extract_all(low, rule["regex"], F.lit(0))
    pairs = F.arrays_zip(F.transform(parts, F.length).alias("gap"), F.transform(found, F.length).alias("size"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,before:int,priority:int,label:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        hit = F.struct(begin.alias("start"), (-end).alias("before"), rule["priority"].alias("priority"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.when(x["size"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(hit))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _kept(hits: Column) -> Column:
    """Without those that lie within one of the same or a better priority. Sorted by start and falling end, an interval
    lies within an earlier one if that one's end isn't smaller, so the largest end of each priority is enough."""
    zero = F.struct(F.array(*(F.lit(-1) for _ in SURE)).alias("ends"), F.array().cast("array<struct<start:int,before:int,priority:int,label:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        inside = F.array_max(F.slice(acc["ends"], F.lit(1), x["priority"])) >= -x["before"]
        ends = F.transform(acc["ends"], lambda e, i: F.when(i + 1 == x["priority"], F.greatest(e, -x["before"])).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"))

    return F.aggregate(F.array_sort(hits), zero, step, lambda acc: acc["out"])


def detections(low: Column, keys: Column) -> Column:
    """The kept detections of a lower-cased text, by place: array of (start, before (minus end), priority, label)."""
    gated = F.filter(_rule_table(), lambda r: F.arrays_overlap(r["keys"], keys) & F.contains(low, r["further"]))
    found = _kept(F.flatten(F.transform(gated, lambda r: _matches(low, r))))
    return F.when(F.size(keys) > 0, found).otherwise(F.array().cast("array<struct<start:int,before:int,priority:int,label:string>>"))


RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "labels", "score")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns RESULT."""
    x = runtime.text_or_empty(text)
    start = "license_scan"
    while any(c.lower().startswith(start) for c in docs.columns):
        start += "_"
    own = {name: f"{start}_{name}" for name in ("low", "keys", "base", *(label for _, label in BASE))}
    kept = [c for c in docs.columns if c.lower() not in RESULT]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept), F.regexp_count(x, F.lit(WORD)).cast("long").alias("n_words"), runtime.lower_ascii(x).alias(own["low"]))
    low, keys = F.col(own["low"]), F.col(own["keys"])
    docs = docs.withColumn(own["keys"], _keys_in(low))
    counts, firsts, lasts, labels = [], [], [], []
    inside, outside = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]", GAP
    for phrase, label in BASE:
        words = phrase.split()
        regex = f"(?<!{inside}){outside.join(words)}(?!{inside})"
        gate = F.size(F.array_intersect(keys, F.array(*map(F.lit, sorted(set(words)))))) == len(set(words))
        parts = own[label]
        docs = docs.withColumn(parts, F.when(gate, F.split(low, regex, -1)))
        n = F.when(F.col(parts).isNull(), 0).otherwise(F.size(parts) - 1)
        counts.append(n)
        firsts.append(F.when(n > 0, F.regexp_count(F.element_at(parts, 1), F.lit(WORD))))
        lasts.append(F.when(n > 0, F.col("n_words") - F.regexp_count(F.element_at(parts, -1), F.lit(WORD)) - len(words)))
        labels.append(F.when(n > 0, F.lit(label)))
    docs = docs.withColumns(
        {
            "n_base": sum(counts, F.lit(0)).cast("long"),
            "first_word": F.least(*firsts).cast("long"),
            "last_word": F.greatest(*lasts).cast("long"),
            own["base"]: F.array_compact(F.array(*labels)),
            "detections": detections(low, keys),
        }
    )
    named = F.transform("detections", lambda d: d["label"])
    sure = F.create_map(*(F.lit(v) for pair in SURE.items() for v in pair))
    best = F.array_max(F.transform("detections", lambda d: F.element_at(sure, d["priority"])))
    return docs.withColumns(
        {
            "base_labels": F.array_join(F.array_sort(F.array_distinct(own["base"])), ","),
            "labels": F.array_join(F.array_sort(F.array_union(own["base"], named)), ","),
            "score": F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(SURE[3])).otherwise(F.lit(0.0))),
        }
    ).drop(*own.values())


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.documents(spark, sf_dir).select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").cast("long").alias("n_detections"))
