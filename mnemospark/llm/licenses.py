"""Licence scans by sentence rules, with built-in functions only.

A text is cut into pieces, each normalised to lower-case ASCII words: at hard
ends (white space after ``.``, ``!`` or ``?``, and blank lines) and at soft
ones (line ends, ``;`` and ``:`` within a line, web addresses). Consecutive
pieces with only soft ends between them that together spell a known sentence
are a hit, the longest that starts at a place, so wrapped and reflowed texts
are read alike; comment leaders at line starts fall away, and the holder's name
is put aside where a sentence has one. Known sentences map
to identifiers; the text's sequence of identifiers is then matched against
ordered rules: an earlier rule consumes its identifiers before a later one
sees them. What no rule consumes is reported as loose.

The SQL oracle knows line and sentence ends only, and no holders: it agrees where every known
sentence stands on a line, or part of a line cut at a sentence end, of its own.

Only texts that hold one of ``TRIGGERS`` are cut: every known sentence holds
one (checked on import), so no match can be missed.

Defined cases: null or empty text has no licence (empty lists, zero counts);
a sentence said twice counts twice; repeated rows are scanned each; other
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier, normalised sentence.
SENTENCES: list[tuple[str, str]] = [
    ("ApacheRef", "licensed under the apache license version 2 0"),
    ("ApacheRef", "this project is licensed under the apache license version 2 0"),
    ("ApacheHead", "licensed under the apache license version 2 0 the license"),
    ("ApacheComply", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheLimits", "see the license for the specific language governing permissions and limitations under the license"),
    ("MitRef", "released under the mit license"),
    ("MitRef", "licensed under the mit license"),
    ("MitRef", "this project is licensed under the mit license"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MitAsIs", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("BsdGrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BsdNames", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("IscGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("Gpl3Ref", "this work is licensed under the gnu general public license version 3"),
    ("Gpl3Ref", "licensed under the gnu general public license version 3"),
    ("Gpl2Ref", "licensed under the gnu general public license version 2"),
    ("GplFree", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GplHope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("CcByNc", "licensed under cc by nc 4 0"),
    ("CcBy", "licensed under cc by 4 0"),
    ("CcBySa", "licensed under cc by sa 4 0"),
    ("CcZero", "licensed under cc0 1 0"),
    ("MplRef", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("Reserved", "all rights reserved"),
    ("ApacheTitle", "apache license version 2 0 january 2004"),
    ("MitLiable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("BsdAsIs", "this software is provided by HOLDER as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("IscGrant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ZeroGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("IscAsIs", "the software is provided as is and HOLDER disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("ZlibAsIs", "this software is provided as is without any express or implied warranty"),
    ("ZlibGrant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("BoostTitle", "boost software license version 1 0 august 17th 2003"),
    ("BoostRef", "distributed under the boost software license version 1 0"),
    ("BoostGrant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("Gpl3Title", "gnu general public license version 3 29 june 2007"),
    ("Gpl2Title", "gnu general public license version 2 june 1991"),
    ("Lgpl3Title", "gnu lesser general public license version 3 29 june 2007"),
    ("Lgpl21Title", "gnu lesser general public license version 2 1 february 1999"),
    ("Agpl3Title", "gnu affero general public license version 3 19 november 2007"),
    ("Gpl2Free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("Gpl2Only", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("Lgpl21Free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("Lgpl3Free", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("Lgpl3Free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("LgplHope", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("AgplFree", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("MplTitle", "mozilla public license version 2 0"),
    ("Epl2Title", "eclipse public license v 2 0"),
    ("Epl1Title", "eclipse public license v 1 0"),
    ("Epl2Ref", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"),
    ("Epl2Ref", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at"),
    ("Epl1Ref", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at"),
    ("CcBy", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CcBySa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("CcByNc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("OflRef", "this font software is licensed under the sil open font license version 1 1"),
    ("ArtisticTitle", "the artistic license 2 0"),
]
#: Licence, the identifiers that stand for it in this order; tried from the top.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("ApacheHead", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheLimits")),
    ("Apache-2.0", ("ApacheHead", "ApacheComply")),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs", "MitLiable")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("MIT", ("MitRef",)),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames", "BsdAsIs")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("BSD-1-Clause", ("BsdGrant", "BsdSource")),
    ("ISC", ("IscGrant", "IscAsIs")),
    ("ISC", ("IscGrant", "MitAsIs")),
    ("ISC", ("IscGrant",)),
    ("GPL-3.0-or-later", ("GplFree", "GplHope")),
    ("GPL-3.0-or-later", ("GplFree",)),
    ("GPL-3.0", ("Gpl3Ref",)),
    ("GPL-2.0", ("Gpl2Ref",)),
    ("CC-BY-NC-4.0", ("CcByNc",)),
    ("CC-BY-SA-4.0", ("CcBySa",)),
    ("CC-BY-4.0", ("CcBy",)),
    ("CC0-1.0", ("CcZero",)),
    ("MPL-2.0", ("MplRef",)),
    ("Unlicense", ("Unlicense",)),
    ("All-Rights-Reserved", ("Reserved",)),
    ("Apache-2.0", ("ApacheTitle",)),
    ("0BSD", ("ZeroGrant", "IscAsIs")),
    ("0BSD", ("ZeroGrant",)),
    ("Zlib", ("ZlibAsIs", "ZlibGrant")),
    ("Zlib", ("ZlibGrant",)),
    ("BSL-1.0", ("BoostTitle", "BoostGrant")),
    ("BSL-1.0", ("BoostTitle",)),
    ("BSL-1.0", ("BoostGrant",)),
    ("BSL-1.0", ("BoostRef",)),
    ("GPL-3.0", ("Gpl3Title",)),
    ("GPL-2.0", ("Gpl2Title",)),
    ("LGPL-3.0", ("Lgpl3Title",)),
    ("LGPL-2.1", ("Lgpl21Title",)),
    ("AGPL-3.0", ("Agpl3Title",)),
    ("GPL-2.0-or-later", ("Gpl2Free", "GplHope")),
    ("GPL-2.0-or-later", ("Gpl2Free",)),
    ("GPL-2.0-only", ("Gpl2Only", "GplHope")),
    ("GPL-2.0-only", ("Gpl2Only",)),
    ("LGPL-2.1-or-later", ("Lgpl21Free", "LgplHope")),
    ("LGPL-2.1-or-later", ("Lgpl21Free",)),
    ("LGPL-3.0-or-later", ("Lgpl3Free", "GplHope")),
    ("LGPL-3.0-or-later", ("Lgpl3Free", "LgplHope")),
    ("LGPL-3.0-or-later", ("Lgpl3Free",)),
    ("AGPL-3.0-or-later", ("AgplFree", "GplHope")),
    ("AGPL-3.0-or-later", ("AgplFree",)),
    ("MPL-2.0", ("MplTitle",)),
    ("EPL-2.0", ("Epl2Title",)),
    ("EPL-1.0", ("Epl1Title",)),
    ("EPL-2.0", ("Epl2Ref",)),
    ("EPL-1.0", ("Epl1Ref",)),
    ("OFL-1.1", ("OflRef",)),
    ("Artistic-2.0", ("ArtisticTitle",)),
]
def normalise(sentence: str) -> str:
    """The form in which sentences are looked up (for one sentence, in Python)."""
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)).strip(" ")


def _spdx() -> None:
    """A short-form tag for every licence of the rules: its name after the tag is a sentence of its own."""
    for name in dict.fromkeys(licence for licence, _ in RULES if licence != "All-Rights-Reserved"):
        forms = {normalise(name), normalise(name + "-only") if name.startswith(("GPL", "LGPL", "AGPL")) and not name.endswith(("only", "later")) else normalise(name)}
        known = {sentence for _, sentence in SENTENCES}
        SENTENCES.extend((f"Spdx{name}", said) for form in sorted(forms) if (said := f"spdx license identifier {form}") not in known)
        RULES.append((name, (f"Spdx{name}",)))


_spdx()
TRIGGERS = ("licen", "permi", "redistribut", "copyright", "warrant", "public domain", "rights reserved")

if missed := [s for _, s in SENTENCES if not any(t in s for t in TRIGGERS)]:
    raise AssertionError(f"no trigger finds {missed}")
_TRIGGER = "licen|permi|redistribut|copyright|warrant|public[^a-z0-9]+domain|rights[^a-z0-9]+reserved"



#: Where the holder's name stands in a sentence, it is put aside before the look-up.
HOLDERS = (
    ("neither the name of (?:[a-z0-9]+[ \\n]){1,20}?nor the names of", "neither the name of the copyright holder nor the names of"),
    ("this software is provided by (?:[a-z0-9]+[ \\n]){1,20}?as is and any", "this software is provided by HOLDER as is and any"),
    ("provided as is and (?:[a-z0-9]+[ \\n]){1,20}?disclaims all", "provided as is and HOLDER disclaims all"),
)
#: A known sentence over one or more pieces, the longest first.
_KNOWN = "(?m)^(?:" + "|".join(s.replace(" ", "[ \\n]") for _, s in sorted(SENTENCES, key=lambda x: -len(x[1]))) + ")$"


def _sequence(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order: ``<One><Two>``."""
    cut = F.regexp_replace(text, "(?m)^[\\x20\\x09]*@?(?i:dnl|rem)(?=[\\x20\\x09\\r\\n]|$)", "")
    cut = F.regexp_replace(cut, "\\b(?i:(v|inc|ltd|corp|co))[.]\\s+(?=[a-z0-9])", "$1 ")
    cut = F.regexp_replace(cut, "([.!?])[\\x20\\x09-\\x0D]+", "$1\n\n")
    cut = F.regexp_replace(cut, "(?<=\\S)\\x20+(?=(?:Permission is hereby|Permission to use|Permission is granted|Redistribution and use|All rights reserved)\\b)", "\n")
    cut = F.regexp_replace(cut, "(?<=[^\\s;:])[;:](?=[\\x20\\x09]+[^\\s])", "\n")
    cut = F.regexp_replace(cut, "\\s*<?(?i:https?)://[^\\s]+\\s*", "\n\n")
    plain = F.regexp_replace(F.regexp_replace(F.lower(cut), "[^a-z0-9\n]+", " "), " ?\n ?", "\n")
    plain = F.trim(plain)
    for said, kept in HOLDERS:
        plain = F.regexp_replace(plain, said, kept)
    hits = F.regexp_extract_all(plain, F.lit(_KNOWN), F.lit(0))
    names = F.create_map(*[F.lit(x) for name, s in SENTENCES for x in (s, f"<{name}>")])
    return F.concat_ws("", F.transform(hits, lambda s: F.element_at(names, F.translate(s, "\n", " "))))


def _consume(state: Column, rule: Column) -> Column:
    """Takes every occurrence of a rule's sequence out; a bar keeps its neighbours apart."""
    rest, ids = state["rest"], rule["ids"]
    times = ((F.length(rest) - F.length(F.replace(rest, ids, F.lit("")))) / F.length(ids)).cast("int")
    return F.struct(F.replace(rest, ids, F.lit("|")).alias("rest"), F.concat(state["found"], F.repeat(F.concat(rule["licence"], F.lit(",")), times)).alias("found"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), licences (comma-joined, repeats kept, in rule order), loose (comma-joined identifiers that no rule took)."""
    found = docs.select("doc_id", F.when(F.lower("text").rlike(_TRIGGER), _sequence(F.col("text"))).otherwise("").alias("ids"))
    rules = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for licence, ids in RULES])
    state = F.aggregate(rules, F.struct(F.col("ids").alias("rest"), F.lit("").alias("found")), _consume)
    matched = found.select("doc_id", "ids", F.when(F.col("ids") != "", state).alias("s"))
    loose = F.regexp_replace(F.regexp_replace(F.replace(F.col("s.rest"), F.lit("|"), F.lit("")), "><", ","), "[<>]", "")
    return matched.select(
        "doc_id",
        (F.length("ids") - F.length(F.replace(F.col("ids"), F.lit("<"), F.lit("")))).cast("long").alias("n_sentences"),
        F.coalesce(F.regexp_replace("s.found", ",$", ""), F.lit("")).alias("licences"),
        F.coalesce(loose, F.lit("")).alias("loose"),
    )


def oracle() -> str:
    """The same scan as DuckDB SQL over the table ``documents``."""
    known = ", ".join(f"('{s}', '<{name}>')" for name, s in SENTENCES)
    steps, before = [], "ids0"
    for k, (licence, ids) in enumerate(RULES):
        seq = "".join(f"<{i}>" for i in ids)
        times = f"((length(rest) - length(replace(rest, '{seq}', ''))) / {len(seq)})::INT"
        steps.append(f"r{k} AS (SELECT n, doc_id, ids, replace(rest, '{seq}', '|') AS rest, found || repeat('{licence},', {times}) AS found FROM {before})")
        before = f"r{k}"
    return f"""
WITH known(sentence, name) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT n, unnest(string_split(regexp_replace(text, '([.!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10)), 1) AS pos FROM d),
hit AS (SELECT n, string_agg(name, '' ORDER BY pos) AS ids FROM cut JOIN known ON sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) GROUP BY n),
ids0 AS (SELECT d.n, doc_id, coalesce(ids, '') AS ids, coalesce(ids, '') AS rest, '' AS found FROM d LEFT JOIN hit USING (n)),
{", ".join(steps)}
SELECT doc_id, (length(ids) - length(replace(ids, '<', '')))::BIGINT AS n_sentences, regexp_replace(found, ',$', '') AS licences,
       regexp_replace(replace(replace(rest, '|', ''), '><', ','), '[<>]', '', 'g') AS loose
FROM {before}"""
