"""License scans by sentence rules: sentences become identifiers, identifier sequences are matched against ordered rules.

A text is cut into parts at line ends and after sentence marks; parts that follow each other without a blank line are joined as
long as they begin a known sentence, so that wrapped lines and comment blocks count as the sentences they hold, and other lines
up to a mark or blank line as one sentence. Sentences are normalised (lower case, runs of other than
letters, digits, dots within numbers and plus signs become one space) and looked up among known licence sentences; a sentence
that does no more than put something under a licence by its name, or under several joined by and or or, is known by these names. So is a
line "License: name", and each identifier of an SPDX tag's expression; identifiers that no table holds stay unclassified. Holders and years of a copyright line
are dropped. The identifiers found, in order, are matched against the rules: a rule fires
where its identifiers follow each other with at most GAP sentences between two; the first rule in the list takes its
sentences, which later rules cannot use. Sentences that no rule takes are reported as `unclassified`.

Defined cases: null and empty texts have no finds; a rule may fire several times in a text; rows with equal doc_id are each
scanned; very long texts are scanned whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

GAP = 3
#: Known sentences in normal form, by identifier.
SENTENCES = {
    "apache2-short": "licensed under the apache license version 2.0",
    "apache2-grant": "licensed under the apache license version 2.0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-title": "apache license version 2.0 january 2004",
    "apache2-url-title": "apache license version 2.0 january 2004 http www apache org licenses",
    "apache2-terms": "terms and conditions for use reproduction and distribution",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib-notice": "this notice may not be removed or altered from any source distribution",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-grant": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "boost-header": "distributed under the boost software license version 1.0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "mpl2-header": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0",
    "mpl2-http-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0",
    "epl2-header": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www eclipse org legal epl 2.0",
    "epl1-header": "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc0-dedication": "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "all-rights": "all rights reserved",
    "copyright": "copyright",
}
#: The general public licences: identifier, name, versions.
GENERAL = (("GPL", "gnu general public license", ("2", "3")), ("LGPL", "gnu lesser general public license", ("2.1", "3")), ("LGPL", "gnu library general public license", ("2",)), ("AGPL", "gnu affero general public license", ("3",)))
#: The titles that stand over their own texts, by licence.
TITLES = {
    "GPL-2.0": "gnu general public license version 2 june 1991",
    "GPL-3.0": "gnu general public license version 3 29 june 2007",
    "LGPL-2.0": "gnu library general public license version 2 june 1991",
    "LGPL-2.1": "gnu lesser general public license version 2.1 february 1999",
    "LGPL-3.0": "gnu lesser general public license version 3 29 june 2007",
    "AGPL-3.0": "gnu affero general public license version 3 19 november 2007",
}
VERBATIM = "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"
FREE = "this {what} is free software you can redistribute it and or modify it under the terms of the {name}"
#: What a licence is called where it is only named, by its identifier.
NAMES = {
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache license version 2", "apache 2.0 license", "apache 2.0", "apache 2 license", "apache software license version 2.0"),
    "MIT": ("mit license", "mit licence", "expat license", "mit"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "three clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "two clause bsd license", "simplified bsd license", "freebsd license", "bsd 2 clause"),
    "BSD": ("bsd license", "bsd style license", "bsd licence", "berkeley software distribution license"),
    "ISC": ("isc license",),
    "0BSD": ("0bsd", "0bsd license", "bsd zero clause license", "zero clause bsd license"),
    "Zlib": ("zlib license", "zlib libpng license"),
    "BSL-1.0": ("boost software license", "boost software license version 1.0", "boost software license 1.0"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license 2.0", "mozilla public license v 2.0", "mpl 2.0", "mpl version 2.0", "mpl v2.0", "mplv2"),
    "MPL-1.1": ("mozilla public license version 1.1", "mozilla public license 1.1", "mpl 1.1"),
    "EPL-2.0": ("eclipse public license 2.0", "eclipse public license version 2.0", "epl 2.0", "eclipse public license v 2.0"),
    "EPL-1.0": ("eclipse public license 1.0", "eclipse public license version 1.0", "epl 1.0", "eclipse public license v1.0"),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0", "cc0 1.0", "cc0 1.0 universal", "creative commons zero", "creative commons cc0 1.0 universal license"),
}
#: Creative Commons: the letters and words of each kind, by version.
COMMONS, COMMONS_VERSIONS = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}, ("2.0", "3.0", "4.0")


def extended():
    """The tables with what follows from rules: the general public licences' sentences and names, Creative Commons' names."""
    sentences, names = dict(SENTENCES), {k: list(v) for k, v in NAMES.items()}
    sentences |= {f"title-{name}": title for name, title in TITLES.items()} | {"gpl-verbatim": VERBATIM}
    for spdx, name, versions in GENERAL:
        short = spdx.lower()
        for v in versions:
            full = v if "." in v else f"{v}.0"
            for what in ("program", "library", "software", "file"):
                free = FREE.format(what=what, name=name)
                sentences[f"{spdx}-{full}-or-later:{what}:{name}"] = f"{free} as published by the free software foundation either version {v} of the license or at your option any later version"
                sentences[f"{spdx}-{full}-only:{what}:{name}"] = f"{free} version {v} as published by the free software foundation"
            sentences[f"{short}-copy-{what}:{name}"] = f"you should have received a copy of the {name} along with this program"
            for n in (name, name.removeprefix("gnu "), short, f"gnu {short}"):
                names.setdefault(f"{spdx}-{full}-only", []).extend(f"{n} {form}" for form in (f"version {v}", f"v{v}", f"v {v}", v, f"version {full}", full, f"v{full}"))
                names.setdefault(f"{spdx}-{full}-or-later", []).extend(f"{n} {form} or {rest}" for form in (f"version {v}", f"v{v}", v, f"version {full}", full) for rest in ("later", "any later version", "at your option any later version"))
            names[f"{spdx}-{full}-only"].append(f"{short}v{v}")
            names[f"{spdx}-{full}-or-later"] += [f"{short}v{v}+", f"{short} {v}+", f"{short} {full}+"]
    for letters, words in COMMONS.items():
        for v in COMMONS_VERSIONS:
            code = letters.lower().replace("-", " ")
            names[f"CC-{letters}-{v}"] = [f"cc {code} {v}", f"creative commons {words} {v}", f"creative commons {words} {v} international", f"creative commons {words} {v} unported", f"creative commons {code} {v}"]
            names[f"CC-{letters}-{v}"] += [f"{n} license" for n in names[f"CC-{letters}-{v}"]]
    return sentences, names


#: Ordered rules: licence and the identifiers that must follow each other; longer texts come before short mentions.
RULES = (
    ("Apache-2.0", ("apache2-grant", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-short", "apache2-comply")),
    ("Apache-2.0", ("apache2-url-title", "apache2-terms")),
    ("Apache-2.0", ("apache2-title", "apache2-terms")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-asis", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "isc-asis", "isc-liability")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-asis", "isc-liability")),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-asis", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-grant", "zlib-origin", "zlib-altered")),
    ("Zlib", ("zlib-grant",)),
    ("Unlicense", ("unlicense-free", "unlicense-grant")),
    ("Unlicense", ("unlicense-free",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-header",)),
    ("MPL-2.0", ("mpl2-header", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-header", "mpl2-http-copy")),
    ("MPL-2.0", ("mpl2-header",)),
    ("EPL-2.0", ("epl2-header",)),
    ("EPL-1.0", ("epl1-header",)),
    ("CC0-1.0", ("cc0-dedication",)),
)
#: The rules that stand behind those of the general public licences and of names.
LAST_RULES = (("Apache-2.0", ("apache2-grant",)), ("Apache-2.0", ("apache2-short",)), ("Apache-2.0", ("apache2-title",)), ("Apache-2.0", ("apache2-url-title",)), ("MIT", ("mit-grant",)), ("Proprietary", ("copyright", "all-rights")))
#: Every known sentence or name holds one of these, so texts without any are passed over.
HINTS = r"licen|copyright|permi|redistribut|free software|warrant|rights reserved|public domain|unencumbered|gpl|bsd|apache|mozilla|\bmpl|\bepl|eclipse|boost|zlib|creative commons|\bcc\b|cc0|\bmit\b"
CUT = re.compile(r"[^\n]+?(?:[.!?;:](?=\s)|(?=\n)|\Z)")
JUNK = re.compile(r"(?<!\d)\.|\.(?!\d)|[^\w.+]+|_+")
YEARS = re.compile(r"^(?:\(c\) |© )?copyright\b.*\b(?:19|20)\d\d\b.*")


COMMENT = re.compile(r"^[\s/*#;%!<>|-]+")


def normal(sentence: str) -> str:
    s = COMMENT.sub("", sentence.strip().lower())
    if YEARS.match(s):
        return "copyright"
    return " ".join(JUNK.sub(" ", s).split())


ALL, CALLED = extended()
RULES += tuple((name, (f"title-{name}", *rest)) for name in TITLES for rest in (("copyright", "gpl-verbatim"), ("gpl-verbatim",), ()))
RULES += tuple((i.split(":")[0], (i, hope)) for i in ALL if ":" in i and "copy" not in i for hope in ("gpl-hope", "lgpl-hope"))
RULES += tuple((i.split(":")[0], (i,)) for i in ALL if ":" in i and "copy" not in i) + LAST_RULES + tuple((name, (f"name:{name}",)) for name in CALLED)
KNOWN = {v: k for k, v in ALL.items()}
NAMED = {n: f"name:{k}" for k, v in CALLED.items() for n in v}
#: A sentence that names a licence and says no more than that something is under it.
MENTION = re.compile(
    r"(?:(?:this|the|all|our|its) (?:[^\W\d_]+ ){0,5}?(?:is|are) )?(?:(?:also |dual |now )*(?P<verb>released|licensed|distributed|available|made available|published|provided|covered|redistributable)(?: under| by| with)? )?(?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?(?P<name>"
    + "|".join(sorted(map(re.escape, NAMED), key=len, reverse=True))
    + r")(?: licen[sc]e)?"
)
#: The same of several licences, each by a name, joined by and or or.
ONE = "(?:the |an? )?(?:" + "|".join(sorted(map(re.escape, NAMED), key=len, reverse=True)) + ")(?: licen[sc]es?)?"
JOINED = re.compile(rf"(?:(?:this|the|all|our|its) (?:[^\W\d_]+ ){{0,5}}?(?:is|are) )?(?:also |dual |now )*(?:released|licensed|distributed|available|made available|published|provided)(?: under| by| with)? (?:either )?(?:the )?(?:terms (?:and conditions )?of )?(?P<names>{ONE}(?: (?:and or|and|or) {ONE})+)")
EACH = re.compile(rf"(?:^| (?:and or|and|or) ){ONE}")
#: A tag and its expression; a line that gives a licence after the word; what an SPDX identifier is called here.
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]*[A-Za-z0-9.+)])", re.IGNORECASE)
LABEL = re.compile(r"(?:^|(?<=\n))[ \t/*#;%!<>|-]*licen[sc]e:[ \t]+([^\n]+)", re.IGNORECASE)
SPDX = {k.lower(): k for k in CALLED}
SPDX |= {f"{spdx}-{v if '.' in v else f'{v}.0'}{old}".lower(): f"{spdx}-{v if '.' in v else f'{v}.0'}-{new}" for spdx, _, vs in GENERAL for v in vs for old, new in (("", "only"), ("+", "or-later"))}
#: What a known sentence may begin with, by words.
BEGINS = {" ".join(v.split()[:n]) for v in KNOWN for n in range(1, len(v.split()) + 1)}


def names_in(words: str) -> list[str]:
    """The names that a normalised list of licences consists of."""
    bare = lambda m: re.sub(r"^ ?(?:and or |and |or )?(?:the |an? )?", "", m)
    found = [bare(m.group()) for m in EACH.finditer(words)]
    return [NAMED.get(n) or NAMED.get(re.sub(r" licen[sc]es?$", "", n)) or NAMED[re.sub(r"s$", "", n)] for n in found]


def declared(text: str) -> list[tuple[list[str], int, int]]:
    """(identifiers, start, end) of SPDX tags and of lines that give a licence after the word."""
    out = []
    for m in TAG.finditer(text):
        words = [w for w in re.split(r"[()\s]+", m[1]) if w]
        words = [w for i, w in enumerate(words) if w.upper() not in ("AND", "OR", "WITH") and (not i or words[i - 1].upper() != "WITH")]
        out.append(([f"name:{SPDX[w.lower()]}" if w.lower() in SPDX else "spdx:other" for w in words], m.start(), m.end()))
    for m in LABEL.finditer(text):
        words = normal(m[1])
        if words.lower() in NAMED or re.fullmatch(f"{ONE}(?: (?:and or|and|or) {ONE})*", words):
            out.append(([NAMED[words]] if words in NAMED else names_in(words), m.start() + len(m.group()) - len(m.group().lstrip(" \t/*#;%!<>|-")), m.end()))
        elif m[1].strip().lower() in SPDX:
            out.append(([f"name:{SPDX[m[1].strip().lower()]}"], m.start() + len(m.group()) - len(m.group().lstrip(" \t/*#;%!<>|-")), m.end()))
    return sorted(out, key=lambda x: x[1:])


def sentences(text: str):
    """(identifier, ordinal of the sentence, start, end) of the known sentences."""
    given = declared(text)
    parts = [(normal(m.group()), m.start(), m.end()) for m in CUT.finditer(text)]

    def parted(i: int) -> bool:
        """Whether a blank line (of a comment, too) stands before or at part i."""
        if not i or i >= len(parts):
            return True
        (_, _, before), (words, start, end) = parts[i - 1], parts[i]
        breaks = text.count("\n", before, start)
        return breaks > 1 or (breaks == 1 and not words and text[end : end + 1] in ("", "\n"))

    def named(i: int):
        """The licence that the sentence beginning at part i names, and its last part."""
        joined, j = "", i
        while j < len(parts) and (j == i or not parted(j)) and len(joined) < 200:
            joined = f"{joined} {parts[j][0]}".strip()
            if text[parts[j][2] - 1] in ".!?;:" or parted(j + 1):
                found = MENTION.fullmatch(joined)
                # a line within a sentence must say so in full, and a word of three letters is no licence by itself
                if found and (found["verb"] or not running and joined != "mit"):
                    return [NAMED[found["name"]]], j
                if several := JOINED.fullmatch(joined):
                    return names_in(several["names"]), j
                if text[parts[j][2] - 1] != ".":
                    return None
            j += 1
        return None

    out, i, n, running = [], 0, 0, False
    while i < len(parts):
        while given and given[0][2] <= parts[i][1]:
            given.pop(0)
        if given and given[0][1] < parts[i][2]:  # a tag or label, whatever parts it is cut into
            names, start, end = given.pop(0)
            n += running
            out += [(name, n, start, end) for name in names]
            n, running = n + 1, False
            while i < len(parts) and parts[i][1] < end:
                i += 1
            continue
        joined, j, found = "", i, None
        while j < len(parts) and (j == i or not parted(j)):
            joined = f"{joined} {parts[j][0]}".strip()
            if joined in KNOWN:
                found = KNOWN[joined], j
            if joined not in BEGINS:
                break
            j += 1
        if found:
            n += running
            out.append((found[0], n, parts[i][1], parts[found[1]][2]))
            i, n, running = found[1] + 1, n + 1, False
            continue
        if (not running or "\n" in text[parts[i - 1][2] : parts[i][1] + 1]) and (end := named(i)):
            n += running
            out += [(name, n, parts[i][1], parts[end[1]][2]) for name in end[0]]
            i, n, running = end[1] + 1, n + 1, False
            continue
        running = True
        if text[parts[i][2] - 1] in ".!?;:" or parted(i + 1):
            n, running = n + 1, False
        i += 1
    return out


def licences(found) -> list[tuple[str, int, int]]:
    """(licence, start, end) of the rules that fire, and of what is left over, by start."""
    free, out = [True] * len(found), []
    for name, wanted in RULES:
        for i in range(len(found)):
            at, last = [], None
            for j in range(i, len(found)):
                if last is not None and found[j][1] - last > GAP + 1:
                    break
                if free[j] and found[j][0] == wanted[len(at)] and (at or j == i):
                    at.append(j)
                    last = found[j][1]
                    if len(at) == len(wanted):
                        break
                elif j == i:
                    break
            if len(at) == len(wanted):
                for j in at:
                    free[j] = False
                out.append((name, found[at[0]][2], found[at[-1]][3], found[at[0]][1], found[at[-1]][1], wanted[0].startswith("name:")))
    hits: list[tuple[str, int, int]] = []
    last = None
    for hit in sorted(out, key=lambda x: (x[1], x[2], x[0])):
        name, start, end, first_at, _, _ = hit
        if last and last[5] and last[0] == name and first_at - last[4] <= GAP + 1:  # a licence's title belongs to its text
            start = hits.pop()[1]
        hits.append((name, start, end))
        last = hit
    return sorted([*hits, *(("unclassified", s, e) for f, (_, _, s, e) in zip(free, found) if f)], key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), identifiers, licences, spans: arrays in the order of the text."""
    out = "doc_id long, n_sentences int, identifiers array<string>, licences array<string>, spans array<struct<start:int,end:int>>"

    def run(batches):
        import pyarrow as pa

        hint = re.compile(HINTS, re.IGNORECASE)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for t in b.column(1).to_pylist():
                found = sentences(t) if t and hint.search(t) else []
                hits = licences(found)
                for c, x in zip(cols, (len(found), [f[0] for f in found], [h[0] for h in hits], [{"start": h[1], "end": h[2]} for h in hits])):
                    c.append(x)
            kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), span)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_sentences", "identifiers", "licences", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, out)


def op5_sentence_rules(spark, sf_dir: str) -> DataFrame:
    """Licences in all documents."""
    df = scan(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_sentences", F.array_join("identifiers", ",").alias("identifiers"), F.array_join("licences", ",").alias("licences"), F.expr("array_join(transform(spans, s -> concat(s.start, ':', s.end)), ',')").alias("spans"))
