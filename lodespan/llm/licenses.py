"""License scans by canonical digest: entire texts are normalised, digested and hash-joined to digests of known licences.

Normalising lower-cases A-Z, drops lines that only state a copyright, unifies equivalent spellings, turns everything but
letters and digits into single spaces, and so leaves only the wording. A document matches if its whole wording is a
licence's. License notices, single lines that name a licence, are looked up by the same digests line by line.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespan.session import cut

#: Pairs of spellings that licence matching guidelines treat as equal; the second is used.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("non commercial", "noncommercial"),
    ("sub license", "sublicense"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
)

#: The wording of licences, by SPDX id, without their copyright lines.
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """BSD Zero Clause License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """BSD 2-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """BSD 3-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
}
#: Longer texts lie beside this module, one file for each SPDX id.
TEXTS |= {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

#: Lines at which a text's terms end; what follows tells how to apply them and is often left out, with or without the line.
_ENDS = re.compile("(?m)^ *(END OF TERMS AND CONDITIONS|ADDENDUM: How to use this License for your documents)")


def forms(text: str) -> set[str]:
    """A licence's text as it is met: with and without its title line, and without what follows its terms."""
    title, _, body = text.partition("\n\n")
    ends = [(m.start(), m.end()) for m in _ENDS.finditer(text)][-1:]
    return {text, body if title.endswith("License") else text} | {text[:place] for end in ends for place in end}


#: Lines that put a work under a licence, by SPDX id.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "BSD-3-Clause": ("SPDX-License-Identifier: BSD-3-Clause",),
}
#: Names of licences in a notice, and what stands before them.
NAMES = {
    "MIT": ("MIT License",),
    "ISC": ("ISC License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
}
_BEFORE = ("Licensed under", "Released under", "This work is licensed under", "This project is licensed under", "This software is licensed under")
for _id in sorted(TEXTS.keys() | NAMES.keys() | NOTICES.keys()):
    _named = {f"{before}{the}{name}" for before in _BEFORE for the in (" ", " the ", " a ") for name in NAMES.get(_id, ())}
    if _id.endswith("-only"):
        _later = _id.removesuffix("-only") + "-or-later"
        NOTICES[_later] = (f"SPDX-License-Identifier: {_later}",)
    NOTICES[_id] = tuple(dict.fromkeys([*NOTICES.get(_id, ()), *sorted(_named), f"SPDX-License-Identifier: {_id}"]))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that only states a copyright: the sign or word, then a year or another sign, or "all rights reserved" alone,
#: or the word, a name and years at the line's end.
COPYRIGHT = "(?m)^[ \\t*#/;-]*((copyright|\\(c\\)|©)[ \\t]*(\\(c\\)|©|[0-9]{4}|<year>|\\[year\\]|\\[yyyy\\])[^\\n]*|copyright[ \\t]+[^\\n0-9]{1,80}[ \\t,](19|20)[0-9]{2}([-, \\t]+(19|20)[0-9]{2})*[.,]?([ \\t]*all rights reserved\\.?)?[ \\t\\r]*|all rights reserved\\.?[ \\t\\r]*)$"
#: What is left of a text besides its words: ASCII punctuation and white space, and typographic signs.
PUNCTUATION = "[\\x00-/:-@\\[-`{-\\x7F‘’“”–—…©®™ ]+"


def canonical(text: Column) -> Column:
    """The wording of a text: words in lower case with one space between and around them; null counts as empty."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    bare = F.regexp_replace(lower, COPYRIGHT, " ")
    # Two spaces between words, so that a spelling found takes none from the next word's.
    words = F.concat(F.lit(" "), F.regexp_replace(bare, PUNCTUATION, "  "), F.lit(" "))
    spaced = lambda words: " " + words.replace(" ", "  ") + " "
    spelled = reduce(lambda c, pair: F.replace(c, F.lit(spaced(pair[0])), F.lit(spaced(pair[1]))), SPELLINGS, words)
    return F.regexp_replace(spelled, "  +", " ")


def digest(wording: Column) -> Column:
    return F.sha2(wording.cast("binary"), 256)


def known_texts(spark: SparkSession) -> DataFrame:
    """(digest, license): of every text in TEXTS, in all its forms. A fixed, small table."""
    rows = [(i, t) for i, text in TEXTS.items() for t in forms(text)]
    return spark.createDataFrame(rows, "license string, text string").select(digest(canonical(F.col("text"))).alias("digest"), "license").distinct()


def known_notices(spark: SparkSession) -> DataFrame:
    rows = [(i, line) for i, lines in NOTICES.items() for line in lines]
    return spark.createDataFrame(rows, "license string, text string").select(digest(canonical(F.col("text"))).alias("digest"), "license")


def scan(df: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """All rows and columns of df, with license_digest and license: the id of the licence that a row's whole text is, or null.

    known has digest and license; by default it is the fixed table, small enough to broadcast by its size; a given
    table is joined as the planner sees fit. Null and empty texts have the digest of no words, which no licence has. Ties
    and repeated rows each get their row; a digest known under several ids gets the smallest.
    """
    known = known_texts(df.sparkSession) if known is None else known
    one = known.groupBy("digest").agg(F.min("license").alias("license")).select(F.col("digest").alias("_digest"), F.col("license").alias("_license"))
    rows = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in ("license_digest", "license")), digest(canonical(F.col(text))).alias("license_digest"))
    return rows.join(one, F.col("license_digest") == F.col("_digest"), "left").drop("_digest").withColumnRenamed("_license", "license")


def notices(df: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license, n_lines): for each document the licences that lines of its text state, with their number.

    Only lines that hold a letter of a notice's first words are normalised: those matching "licen" or "released".
    """
    known = known_notices(df.sparkSession) if known is None else known
    one = known.groupBy("digest").agg(F.min("license").alias("license"))
    line = df.select(F.col(key), F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line")).where(F.col("line").rlike("(?i)licen|released"))
    return line.select(key, digest(canonical(F.col("line"))).alias("digest")).join(one, "digest").groupBy(key, "license").agg(F.count(F.lit(1)).alias("n_lines"))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, license_digest, license of each row of documents, and the ids its lines state in order, comma-joined (notices)."""
    stated = notices(df).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    found = scan(df.select("doc_id", "text")).drop("text")
    return found.join(cut(stated, "notices"), "doc_id", "left").select("doc_id", "license_digest", "license", "notices")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    """By words: each spelled by a CASE, pairs of words afterwards, twice, as neighbours share a space."""
    bare = f"regexp_replace(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), {_sql_text(COPYRIGHT)}, ' ', 'g')"
    words = f"string_split(trim(regexp_replace({bare}, {_sql_text(PUNCTUATION)}, ' ', 'g'), ' '), ' ')"
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS if " " not in a)
    joined = f"' ' || array_to_string(list_transform({words}, lambda w: CASE w {cases} ELSE w END), ' ') || ' '"
    pairs = [p for p in SPELLINGS if " " in p[0]]
    return f"regexp_replace({reduce(lambda c, pair: f"replace({c}, ' {pair[0]} ', ' {pair[1]} ')", [*pairs, *pairs], joined)}, '  +', ' ', 'g')"


def sql() -> str:
    """DuckDB SQL of `digests`."""
    texts = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, text in TEXTS.items() for t in {text, text.partition("\n\n")[2] if text.partition("\n\n")[0].endswith("License") else text})
    lines = ", ".join(f"({_sql_text(i)}, {_sql_text(line)})" for i, many in NOTICES.items() for line in many)
    return f"""
WITH known AS (SELECT sha256({_sql_canonical('text')}) AS digest, min(license) AS license FROM (VALUES {texts}) AS t(license, text) GROUP BY 1),
named AS (SELECT sha256({_sql_canonical('text')}) AS digest, min(license) AS license FROM (VALUES {lines}) AS t(license, text) GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
stated AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT doc_id, sha256({_sql_canonical('line')}) AS digest FROM line WHERE regexp_matches(line, '(?i)licen|released')) JOIN named USING (digest) GROUP BY doc_id
), digested AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS license_digest FROM documents)
SELECT d.doc_id, d.license_digest, k.license, s.notices
FROM digested d LEFT JOIN known k ON d.license_digest = k.digest LEFT JOIN stated s ON d.doc_id = s.doc_id
"""
