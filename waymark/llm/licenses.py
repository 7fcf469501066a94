"""License scans by canonical digest lookup.

A text is brought to a canonical form: lower case, without copyright lines (and the holder's line under one that names
nobody) and "all rights reserved", wherever it is wrapped, equivalent spellings made one, everything but letters and
digits a single blank. The MD5 of the whole form, and of the form of
each line, is looked up among the digests of known licence texts and notices by a hash join. SQL functions only.

Known as whole texts: MIT, MIT-0, ISC, 0BSD, BSD-2-Clause, BSD-3-Clause, Zlib and Unlicense, and by digest Apache-2.0, GPL-1.0,
GPL-2.0, GPL-3.0, LGPL-2.0, LGPL-2.1, LGPL-3.0, MPL-1.1, MPL-2.0, GFDL-1.2, GFDL-1.3, CC0-1.0 and Artistic-1.0-Perl.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = [("sub-licens", "sublicens"), ("licence", "license"), ("non-commercial", "noncommercial"), ("http://", "https://"), ("favour", "favor"), ("behaviour", "behavior"), ("organisation", "organization"), ("per cent", "percent"), ("merchantibility", "merchantability"), ("wilful", "willful"), ("&", " and ")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words with which terms go on after "copyright" where they are wrapped before it.
TERMS = "holders?|notices?|and|laws?|disclaimer|owners?|ownership|interests?|on|permission|resulting|licen[sc]es?|treat(?:y|ies)|are|if|is|doctrines|statements?|or|of|in|the[ \t]+(?:software|library|program|works?)"
HELD = r"^([ \t*#/;>-]*)copyright([ \t:]+(?:" + TERMS + r")\b)"
#: A line is a copyright line if it opens with the word and a sign or year, or with the sign alone, or with the word and
#: up to a dozen others that are none of those terms.
COPYRIGHT = r"^[ \t*#/;>-]*(copyright[ \t:]*(\(c\)|©|[0-9]{4}|[<\[])[^\n]*|(\(c\)[ \t]*(copyright|[0-9]{4}|by[ \t])|©)[^\n]*|copyright[ \t:]+([^ \t\n]+[ \t]+){0,11}[^ \t\n]+[ \t]*$)"
#: A copyright line that names nobody, and a line of up to six words.
BARE = r"^[ \t*#/;>-]*((copyright[ \t:]*(\(c\)|©)?)|\(c\)|©)[ \t]*([0-9]{4}[ \t,-]*)*[ \t\r]*$"
BRIEF = r"^[ \t]*([^ \t\r]+[ \t]+){0,5}[^ \t\r]+[ \t\r]*$"
RESERVED = r"all rights reserved[.]?"
#: "All rights reserved" over two lines, which it is brought back to the first of.
WRAPS = [r"(?i)\b(all[ \t]+rights)[ \t\r]*\n[ \t*#/;>-]*(reserved\b)", r"(?i)\b(all)[ \t\r]*\n[ \t*#/;>-]*(rights[ \t]+reserved\b)"]
OTHER = "[^a-z0-9]+"

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Public licence texts by SPDX identifier.
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS,
    "MIT-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n" + _AS_IS,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_AS_IS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_AS_IS,
    "BSD-2-Clause": "\n\n".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_AS_IS)),
    "BSD-3-Clause": "\n\n".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_AS_IS)),
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n" + _AS_IS.split(" IN NO EVENT")[0] + " IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
}
#: Digests of the canonical forms of public licence texts too long to be kept here, by SPDX identifier,
#: each of the whole file and, where the licence has an appendix on how to apply it, of its terms alone.
DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": ["184d4af64a58c708bcf4cb2468396a96", "8d99569c7b33d2f613388e7f7b6676c3", "0a0f73af27c03c9dcd89412f9008b49d"],
    "GPL-1.0": ["738cc3b112640d95d4cd79a58967ecea", "dbf3c47f5a8f127e58d08cabc1ebb916", "21fa8693acc5194a648fe02e11f65a72"],
    "GPL-2.0": ["5e39ace6e62f5a7fe9c17b4da986ad8c", "68380dbeadb093b94ecf563db7312db7", "f2c06efe640b4a281cbe5337cdde80ab"],
    "GPL-3.0": ["5eaa767cc0a56c87c3852144458a3bf1", "444f95dc767ede978b60cfb20fbd0bca", "17e434cc6db7003444b088cb4cc81e91"],
    "LGPL-2.0": ["74cf7fcef3b29a39165a795b2cad3a3a", "c396ba2f94537628797123bc12cd2d6e", "97832943be1e344d51af5aee1b658e4f"],
    "LGPL-2.1": ["f998bc436710cfece156aaa84fd26dd4", "3054b3781b1af43f906dc753acad15ee", "eaf6afb73fc860a002bfbccbe6f07ce7"],
    "LGPL-3.0": ["b31b7335bc37919e8cdd79154e04d88d"],
    "MPL-1.1": ["252dfbcf46f9012c7c356a9252f1c30c"],
    "MPL-2.0": ["db12a21e89062c14ac06f7d6aa8123d5"],
    "GFDL-1.2": ["c969fdb4b731dadf7173c1ffbe49a117"],
    "GFDL-1.3": ["eb6b86c0fad89753a5a36c484fa0ada2"],
    "CC0-1.0": ["93a180096f6cfcf2c0dd24f75c2eec48"],
    "Artistic-1.0-Perl": ["a8b0fb0c6e43a3b36bdc159e59dbfd1e"],
}
#: Titles that the texts go by.
TITLES = {
    "Unlicense": ["The Unlicense", "Unlicense", "The Unlicense (Unlicense)"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)", "ISC"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License", "BSD Zero-Clause License", "BSD Zero Clause License (0BSD)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "The BSD License", "BSD License"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng License"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License", "MIT-0"],
}
#: Names of licences as notices have them. Each goes with each of FORMS.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "ISC": ["ISC License"],
}
FORMS = ("Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This software is licensed under the {}.", "Distributed under the {}.")
CC = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
CC_VERSIONS = ("2.0", "3.0", "4.0")
CC_FORMS = ("Licensed under CC {} {}.", "This work is licensed under CC {} {}.", "Released under CC {} {}.")


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of all that is known: whole texts with and without title, and notices."""
    out = [(k, x) for k, t in TEXTS.items() for x in (t, *(f"{title}\n\n{t}" for title in TITLES[k]))]
    out += [(k, form.format(name)) for k, names in NAMES.items() for name in names for form in FORMS]
    return out + [(f"CC-{kind}-{v}", form.format(kind, v)) for kind in CC for v in CC_VERSIONS for form in CC_FORMS]


def canonical_line(line: str) -> str:
    """The canonical form of a line, in Python; the columns below are the same in SQL."""
    x = re.sub(HELD, r"\1copyterms\2", line.translate(str.maketrans(UPPER, LOWER)))
    x = re.sub(RESERVED, " ", re.sub(COPYRIGHT, " ", x)).replace("copyterms", "copyright")
    for a, b in SPELLINGS:
        x = x.replace(a, b)
    return re.sub(OTHER, " ", x).strip(" ")


def canonical(text: str) -> str:
    """The canonical form of a text: those of its lines, joined by blanks."""
    for wrap in WRAPS:
        text = re.sub(wrap, r"\1 \2\n", text)
    lines = text.split("\n")
    low = [x.translate(str.maketrans(UPPER, LOWER)) for x in lines]
    holder = [k > 0 and bool(re.search(BARE, low[k - 1])) and bool(re.search(BRIEF, x)) for k, x in enumerate(lines)]
    return " ".join(x for x in ("" if h else canonical_line(line) for h, line in zip(holder, lines)) if x)


def known_digests() -> dict[str, str]:
    """Licence by digest; of two licences with one digest, the first in order."""
    out: dict[str, str] = {}
    for name, text in sorted(known_texts()):
        out.setdefault(hashlib.md5(canonical(text).encode()).hexdigest(), name)
    return {**{d: k for k, ds in DIGESTS.items() for d in ds}, **out}


def canonical_column(c):
    x = F.regexp_replace(F.translate(c, UPPER, LOWER), HELD, "$1copyterms$2")
    x = F.replace(F.regexp_replace(F.regexp_replace(x, COPYRIGHT, " "), RESERVED, " "), F.lit("copyterms"), F.lit("copyright"))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, OTHER, " "))


def canonical_lines(raw):
    """The canonical forms of an array of lines; empty for the holder's line under a copyright line that names nobody."""
    holder = lambda x, i: (i > 0) & F.coalesce(F.rlike(F.translate(F.get(raw, i - 1), UPPER, LOWER), F.lit(BARE)), F.lit(False)) & F.rlike(x, F.lit(BRIEF))
    return F.transform(raw, lambda x, i: F.when(holder(x, i), "").otherwise(canonical_column(x)))


def scan(docs: DataFrame, id_col="doc_id", text_col="text", digests: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """One row per find: id, scope ('text' if the whole text is a known one, 'line' for each line that is), line
    (0 for the whole, else from 1), license.

    Null and empty texts, and texts or lines of nothing but copyright lines, are never a find; repeated rows are
    found each; only the two columns are read; an empty table gives an empty result. digests: licence by digest, of
    100 000 at most, which are broadcast, or a table (digest, license) of any size, which is joined. A text is brought
    to its canonical form once, line by line."""
    if isinstance(digests, DataFrame):
        table = digests.select("digest", "license")
    else:
        found = known_digests() if digests is None else digests
        if len(found) > 100_000:
            raise ValueError("too many digests to broadcast: pass them as a table")
        table = F.broadcast(docs.sparkSession.createDataFrame(sorted(found.items()), "digest string, license string"))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    unwrapped = F.col("text")
    for wrap in WRAPS:
        unwrapped = F.regexp_replace(unwrapped, wrap, "$1 $2\n")
    formed = narrow.select("id", F.split(unwrapped, "\n").alias("raw")).select("id", canonical_lines(F.col("raw")).alias("lines"))
    each = F.filter(F.transform("lines", lambda x, i: F.struct(F.lit("line").alias("scope"), (i + 1).alias("line"), x.alias("unit"))), lambda u: u["unit"] != "")
    whole = F.array(F.struct(F.lit("text").alias("scope"), F.lit(0).alias("line"), F.array_join(F.filter("lines", lambda x: x != ""), " ").alias("unit")))
    units = formed.select("id", F.explode(F.concat(whole, each)).alias("u")).select("id", "u.scope", "u.line", F.md5(F.col("u.unit").cast("binary")).alias("digest"))
    return units.join(table, "digest").select(F.col("id").alias(id_col), "scope", F.col("line").cast("int").alias("line"), "license")


def duckdb_sql(table: str = "documents", id_col="doc_id", text_col="text") -> str:
    """The same scan in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    x = f"regexp_replace(translate(part, '{UPPER}', '{LOWER}'), {quote(HELD)}, {quote(chr(92) + '1copyterms' + chr(92) + '2')})"
    x = f"replace(regexp_replace(regexp_replace({x}, {quote(COPYRIGHT)}, ' ', 'g'), {quote(RESERVED)}, ' ', 'g'), 'copyterms', 'copyright')"
    for a, b in SPELLINGS:
        x = f"replace({x}, {quote(a)}, {quote(b)})"
    x = f"trim(regexp_replace({x}, '{OTHER}', ' ', 'g'), ' ')"
    whole = text_col
    for wrap in WRAPS:
        whole = f"regexp_replace({whole}, {quote(wrap)}, {quote(chr(92) + '1 ' + chr(92) + '2')} || chr(10), 'g')"
    rows = ", ".join(f"({quote(d)}, {quote(n)})" for d, n in sorted(known_digests().items()))
    return f"""
WITH known(digest, license) AS (VALUES {rows}),
texts AS (SELECT {id_col}, row_number() OVER () AS rn, string_split({whole}, chr(10)) AS parts FROM {table} WHERE {text_col} IS NOT NULL),
lines AS (SELECT {id_col}, rn, i, CASE WHEN coalesce(regexp_matches(translate(before, '{UPPER}', '{LOWER}'), {quote(BARE)}), false) AND regexp_matches(part, {quote(BRIEF)}) THEN '' ELSE {x} END AS unit
  FROM (SELECT {id_col}, rn, i, parts[i] AS part, CASE WHEN i > 1 THEN parts[i - 1] END AS before FROM (SELECT {id_col}, rn, parts, unnest(range(1, len(parts) + 1)) AS i FROM texts))),
units AS (
  SELECT {id_col}, 'text' AS scope, 0 AS line, string_agg(unit, ' ' ORDER BY i) AS unit FROM lines WHERE unit <> '' GROUP BY {id_col}, rn
  UNION ALL
  SELECT {id_col}, 'line', i, unit FROM lines WHERE unit <> '')
SELECT {id_col}, scope, CAST(line AS INTEGER) AS line, license FROM units JOIN known ON digest = md5(unit)
"""
