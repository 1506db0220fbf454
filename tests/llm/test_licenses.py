from mnemospark.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""


def _plain(text):
    import re

    known = {s: n for n, s in licenses.SENTENCES}
    parts = re.sub(r"([.!?])[\x20\x09-\x0D]+", "\\1\n", text or "").split("\n")
    ids = [known[licenses.normalise(p)] for p in parts if licenses.normalise(p) in known]
    found, rest = [], "".join(f"<{i}>" for i in ids)
    for licence, seq in licenses.RULES:
        s = "".join(f"<{i}>" for i in seq)
        found += [licence] * rest.count(s)
        rest = rest.replace(s, "|")
    return len(ids), ",".join(found), ",".join(x.strip("<>") for x in rest.replace("|", "").replace("><", ">,<").split(",") if x)


CASES = [
    "Some prose. Licensed under the Apache License, Version 2.0.\nAll rights reserved.",
    MIT,
    MIT + "words between\n" + MIT,
    "Released under the MIT License. released under the MIT licence!",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "this is about permission and copyright in general",
    "LICENSED UNDER CC BY-NC 4.0.\tRest",
    None,
    "",
    "plain text " * 3000,
]


def test_against_plain_rules(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)] + [(0, CASES[0], "x")], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.n_sentences, r.licences, r.loose) for r in licenses.scan(df).collect()]
    want = [(i, *_plain(t)) for i, t in enumerate(CASES)] + [(0, *_plain(CASES[0]))]
    assert sorted(got) == sorted(want)
    assert dict((g[0], g[2]) for g in got)[1] == "MIT" and dict((g[0], g[2]) for g in got)[2] == "MIT,MIT"
    assert licenses.scan(df.limit(0)).count() == 0


def test_every_sentence_finds_itself(spark):
    df = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(licenses.SENTENCES)], "doc_id long, text string")
    assert all(r.n_sentences == 1 for r in licenses.scan(df).collect())


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD = """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_wrapped_and_reflowed_texts(spark):
    import re
    import textwrap

    lines = lambda t, n: "\n\n".join(textwrap.fill(p, n) for p in re.split("\n+", t.strip()))
    flow = lambda t: "\n\n".join(" ".join(p.split()) for p in re.split("\n\n+", t))
    forms = {"Apache-2.0": APACHE, "MIT": lines(MIT, 76) + "\n\n" + AS_IS, "BSD-3-Clause": BSD, "GPL-3.0-or-later": GPL, "ISC": ISC + "\n\n" + AS_IS}
    texts, want = [], []
    for name, t in forms.items():
        for lead in (None, "", " * ", "# ", "// ", ";; ", "dnl ", "REM "):
            texts.append(flow(t) if lead is None else "\n".join(lead + x for x in t.split("\n")))
            want.append((len(texts) - 1, name, ""))
        texts += [t.replace("\n", "\r\n"), t.replace("\n", " \n")]
        want += [(len(texts) - 2, name, ""), (len(texts) - 1, name, "")]
    texts += [" ".join(APACHE.split()), "A title\nReleased under\nthe MIT License\nOther words", "Released under\n\nthe MIT License"]
    want += [(len(texts) - 3, "Apache-2.0", ""), (len(texts) - 2, "MIT", ""), (len(texts) - 1, "", "")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.licences, r.loose) for r in licenses.scan(df).collect()) == want


MIT_FILE = f"""MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

{AS_IS} IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY {who} "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL {who} BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."""
BSD3_FILE = BSD.replace("the copyright holder nor", "Example Widgets, Inc. nor") + "\n\n" + BSD_AS_IS.format(who="THE COPYRIGHT HOLDERS AND CONTRIBUTORS")
BSD2_FILE = BSD.partition("\n\n3. ")[0] + "\n\n" + BSD_AS_IS.format(who="JANE DOE AND FRIENDS")
APACHE_FILE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions."""
GPL3_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed."""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
ZLIB = """Copyright (c) 2020 Jane Doe

This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented."""
ISC_FILE = (
    ISC
    + """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""
)


def test_common_licence_files(spark):
    files = {
        "MIT": MIT_FILE,
        "BSD-3-Clause": BSD3_FILE,
        "BSD-2-Clause": BSD2_FILE,
        "Apache-2.0": APACHE_FILE,
        "GPL-3.0": GPL3_FILE,
        "MPL-2.0": MPL,
        "Zlib": ZLIB,
        "ISC": ISC_FILE,
        "GPL-2.0-or-later": GPL.replace("version 3", "version 2"),
        "LGPL-2.1-or-later": GPL.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"),
        "AGPL-3.0-or-later": GPL.replace("GNU General Public License as", "GNU Affero General Public License as"),
        "0BSD": ISC_FILE.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""),
        "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
        "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)",
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
        "LGPL-3.0-or-later": "// SPDX-License-Identifier: LGPL-3.0-or-later\n\nint main() {}",
    }
    texts, want = [], []
    for name, t in files.items():
        for form in (t, t.replace("\n", "\r\n"), "\n".join("# " + x for x in t.split("\n")), "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */", "\n\n".join(" ".join(p.split()) for p in t.split("\n\n"))):
            texts.append(form)
            want.append((len(texts) - 1, name, ""))
    texts.append(" ".join(MIT_FILE.split()))  # the whole file on one line
    want.append((len(texts) - 1, "MIT", ""))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.licences, r.loose) for r in licenses.scan(df).collect()) == want
