import itertools
import random

from scorelake.llm import licenses as x
from pyspark.sql import functions as F

APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at'


def test_known_sentences_are_in_normal_form():
    assert all(x.normal(v) == v for v in x.ALL.values()) and all(x.normal(n) == n for n in x.NAMED)
    assert {i for _, ids in x.RULES for i in ids} <= set(x.ALL) | {f"name:{n}" for n in x.CALLED}
    import re

    alone = ("apache2-terms", "apache2-copy", "zlib-origin", "zlib-altered", "zlib-notice", "mit-liability", "bsd-liability", "isc-liability", "zlib-liability", "unlicense-grant")  # never without another sentence
    assert all(re.search(x.HINTS, v) for k, v in x.ALL.items() if k not in alone) and all(re.search(x.HINTS, n) for n in x.NAMED)


def test_rules_in_order(make_docs):
    rows = [
        (1, "Foo bar. Released under the MIT License. More text."),
        (2, APACHE),
        (3, "Licensed under the Apache License, Version 2.0.\nx"),
        (4, "LICENSED UNDER CC BY-NC 4.0. Licensed under CC BY 4.0."),
        (5, None), (6, ""), (7, "the license of nothing"),
        (8, "Copyright (c) 2020 Someone Ltd.\nAll rights reserved."),
        (9, "All rights reserved.\nA. B. C. D. E.\nCopyright 2020 X."),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (10, "\n".join(x.SENTENCES[i] for i in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"))),
        (11, "word " * 20000 + "\nReleased under the MIT License."),
    ]
    got = sorted((r.doc_id, tuple(r.licences)) for r in x.scan(make_docs(rows, licences=1)).collect())
    assert got == sorted([(1, ("MIT",)), (2, ("Apache-2.0",)), (3, ("Apache-2.0",)), (4, ("CC-BY-NC-4.0", "CC-BY-4.0")), (5, ()), (6, ()), (7, ()), (8, ("Proprietary",)), (9, ("unclassified", "unclassified")), (3, ("GPL-3.0-only",)), (10, ("BSD-3-Clause",)), (11, ("MIT",))])
    (row,) = x.scan(make_docs([(1, rows[0][1])])).collect()
    assert rows[0][1][row.spans[0].start : row.spans[0].end].strip() == "Released under the MIT License."
    assert x.scan(make_docs(rows).where(F.lit(False))).count() == 0


def test_a_sentence_serves_one_rule():
    f = [("mit-grant", 0, 0, 1), ("mit-notice", 1, 2, 3), ("mit-grant", 2, 4, 5)]
    assert x.licences(f) == [("MIT", 0, 3), ("MIT", 4, 5)]
    assert x.licences([("bsd-grant", 0, 0, 1), ("bsd-source", 9, 2, 3)]) == [("unclassified", 0, 1), ("unclassified", 2, 3)]


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


def test_wrapped_texts_and_comment_blocks(make_docs):
    want = {"MIT": MIT, "GPL-3.0-or-later": GPL, "BSD-2-Clause": BSD}
    for name, text in want.items():
        for mark in ("", "# ", " * ", "// "):
            t = "".join(mark + line for line in text.splitlines(True))
            hits = [h for h in x.licences(x.sentences(t)) if h[0] != "unclassified"]
            assert [h[0] for h in hits] == [name], (name, mark)
            assert t[hits[0][2] - 1] == "."
    (row,) = x.scan(make_docs([(1, MIT)])).collect()
    assert "MIT" in row.licences


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
UNLICENSE = "This is free and unencumbered software released into the public domain.\n"


def test_common_licences_wrapped_and_in_comments():
    want = {"ISC": ISC, "Zlib": ZLIB, "LGPL-2.1-or-later": LGPL, "AGPL-3.0-or-later": AGPL, "MPL-2.0": MPL, "Unlicense": UNLICENSE}
    for name, text in want.items():
        for mark in ("", "# ", " * ", "// ", "-- "):
            t = "".join(mark + line for line in text.splitlines(True))
            assert [h[0] for h in x.licences(x.sentences(t))] == [name], (name, mark)


def test_names_and_titles():
    one = lambda t: [h[0] for h in x.licences(x.sentences(t))]
    assert one("This library is licensed under LGPL 2.1.") == ["LGPL-2.1-only"]
    assert one("Our code is released under the\nterms of the BSD license.") == ["BSD"]
    assert one("Mozilla Public License 2.0") == ["MPL-2.0"]
    assert one("Licensed under GPLv2+.") == ["GPL-2.0-or-later"]
    assert one("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.") == ["CC-BY-SA-4.0"]
    assert one("Copyright 2019 A\n\n" + MIT)[1:] == one(MIT) and one(MIT).count("MIT") == 1
    for text in ("He studied at\nMIT. Then he left.", "We compared the GPL with other licenses.", "MIT", "the Boost of power", "a bsd license fee was paid and not refunded"):
        assert one(text) == [], text


def test_very_long_texts(make_docs):
    text = "plain words here. " * 30_000 + "\n\n" + MIT + "\n\n" + "x " * 100_000 + "\n\nReleased under the ISC license."
    (row,) = x.scan(make_docs([(1, text)])).collect()
    assert [n for n in row.licences if n != "unclassified"] == ["MIT", "ISC"] and text[row.spans[-1].start :].strip() == "Released under the ISC license."


def found(text):
    return [(name, text[s:e]) for name, s, e in x.licences(x.sentences(text))]


def test_tags_labels_and_joined_names():
    assert found("// SPDX-License-Identifier: MIT\nint x;") == [("MIT", "SPDX-License-Identifier: MIT")]
    assert [n for n, _ in found("# SPDX-License-Identifier: (GPL-2.0+ OR BSD-3-Clause)\n")] == ["BSD-3-Clause", "GPL-2.0-or-later"]
    assert [n for n, _ in found("/* SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception */")] == ["Apache-2.0"]
    assert [n for n, _ in found("SPDX-License-Identifier: LicenseRef-Ours")] == ["unclassified"]
    assert found("Name: x\nLicense: MIT\nHome: y") == [("MIT", "License: MIT")]
    assert [n for n, _ in found("License: GPL-3.0-only")] == ["GPL-3.0-only"]
    assert [n for n, _ in found("License: MIT or Apache 2.0\n")] == ["Apache-2.0", "MIT"]
    assert [n for n, _ in found("This project is dual licensed under MIT and Apache-2.0.")] == ["Apache-2.0", "MIT"]
    assert [n for n, _ in found("Licensed under either the MIT license or the Apache License 2.0.\n")] == ["Apache-2.0", "MIT"]
    assert [n for n, _ in found("released under the GPL version 2 or later")] == ["GPL-2.0-or-later"]
    for plain in ("License: see below", "The license: a story of mit and men.", "MIT", "we met at mit and left."):
        assert found(plain) == [], plain


def test_general_public_licences_own_texts():
    head = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n"
    body = " Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n"
    assert [n for n, _ in found(head)] == ["GPL-3.0"]
    assert [n for n, _ in found(head + body + "  Preamble\n\n The GNU General Public License is a free one.\n")] == ["GPL-3.0"]
    lesser = "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\n" + body
    assert [n for n, _ in found(lesser)] == ["LGPL-2.1"]


def test_rules_against_all_choices():
    """For every rule in order and every start, the first free sentences in order within the gap, found by trying all."""
    r = random.Random(5)
    ids = sorted({i for _, wanted in x.RULES[:16] for i in wanted})
    for _ in range(150):
        n, rows = 0, []
        for k in range(r.randrange(1, 9)):
            n += r.choice([0, 1, 1, 2, 5])
            rows.append((r.choice(ids), n, 10 * k, 10 * k + 5))
        free, want = set(range(len(rows))), []
        for name, wanted in x.RULES:
            for i in range(len(rows)):
                fits = [c for c in itertools.combinations(range(i, len(rows)), len(wanted)) if c[0] == i and set(c) <= free and all(rows[j][0] == w for j, w in zip(c, wanted)) and all(rows[b][1] - rows[a][1] <= x.GAP + 1 for a, b in zip(c, c[1:]))]
                if fits:
                    free -= set(min(fits))
                    want.append((name, 10 * min(fits)[0], 10 * min(fits)[-1] + 5))
        want += [("unclassified", 10 * i, 10 * i + 5) for i in free]
        assert x.licences(rows) == sorted(want, key=lambda h: (h[1], h[2], h[0]))
