"""Licence scan: canonical digests of whole texts and whole lines, hash-joined to the digests of known licence texts.

The canonical form of a text drops copyright lines, lower-cases, turns each run of punctuation, symbols and white space (of any
script) into one space and brings equivalent spellings together. Its sha-256 is looked up among the digests of known texts. A document
is looked up as a whole and line by line, since notices mostly stand in a line of their own. Up to KNOWN_LIMIT known texts
are broadcast, so that nothing is shuffled; more are joined by a shuffle of digests.

Only units whose first word (behind leading copyright lines and punctuation) begins like that of a known text are brought into canonical form: no
other can have a known digest, as no step changes the first letters of a word but for their case.

Nulls, empty texts and texts of punctuation alone have an empty canonical form and match nothing. Very long texts are looked up whole.
Repeated rows give repeated results; extra columns aren't read. A known text given twice under one name counts once, one given under several
names gives a row for each.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm._common import prepare, table

KNOWN_LIMIT = 10_000
#: Letters of the first word by which units are picked; equivalent spellings have at least these in common.
FIRST_LETTERS = 3

# Names of licences with the notices and texts that stand for them.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Released under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
)

# Every lead-in is taken with every licence.
LEADS = ("Licensed under", "This work is licensed under", "Released under")
NAMES = (
    ("Apache-2.0", "the Apache License, Version 2.0."),
    ("MIT", "the MIT License."),
    ("GPL-3.0-only", "the GNU General Public License, version 3."),
    ("GPL-2.0-only", "the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "the BSD 3-Clause License."),
    ("BSD-2-Clause", "the BSD 2-Clause License."),
    ("ISC", "the ISC License."),
    ("Zlib", "the zlib License."),
    ("Unlicense", "the Unlicense."),
    ("MPL-2.0", "the Mozilla Public License, Version 2.0."),
    ("CC0-1.0", "CC0 1.0."),
    ("CC-BY-4.0", "CC BY 4.0."),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0."),
)

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>.
"""

# Whole texts and standard headers, their titles (a text stands with and without one), copyright lines left out.
TEXTS = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", ("BSD 2-Clause License",), _BSD + _BSD_END),
    ("BSD-3-Clause", ("BSD 3-Clause License",), _BSD + _BSD_NAMES + _BSD_END),
    ("ISC", ("ISC License",), """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", ("zlib License",), """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", ("The Unlicense",), """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("Apache-2.0", (), """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-or-later", (), _GNU.format(name="General Public License", n=3)),
    ("GPL-2.0-or-later", (), _GNU.format(name="General Public License", n=2)),
    ("AGPL-3.0-or-later", (), _GNU.format(name="Affero General Public License", n=3)),
    ("LGPL-3.0-or-later", (), _GNU.format(name="Lesser General Public License", n=3)),
    ("MPL-2.0", (), """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
)

ALL_KNOWN = KNOWN + tuple((a, f"{lead} {b}") for a, b in NAMES for lead in LEADS) + tuple((a, f"{title}\n\n{body}") for a, titles, body in TEXTS for title in ("", *titles))

# Spellings taken as the same.
SPELLINGS = (("licenc", "licens"), ("sub licens", "sublicens"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("programme", "program"), ("non commercial", "noncommercial"), ("copy left", "copyleft"))

COPYRIGHT_LINE = r"(?im)^[ \t/*#;-]*(copyright|\(c\)|©)[^\n]*$"
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\p{P}\p{S}\p{Z}]+"
FIRST_WORD = r"(?i)^(?:(?<![^\n])[ \t/*#;-]*(?:copyright|\(c\)|©)[^\n]*|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\p{P}\p{S}\p{Z}])*+([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\p{P}\p{S}\p{Z}]{1,%d})" % FIRST_LETTERS


def canonical(text: Column) -> Column:
    out = F.regexp_replace(text, COPYRIGHT_LINE, "")
    out = F.regexp_replace(F.lower(out), PUNCTUATION, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def scan(docs: DataFrame, known=ALL_KNOWN) -> DataFrame:
    """doc_id, scope (document or line), line_no (from 1; null for a document), license, digest: a row for each hit."""
    spark = prepare(docs.sparkSession)
    listed = F.array(*(F.struct(F.lit(a).alias("license"), F.lit(b).alias("body")) for a, b in known))
    lookup = spark.range(1).select(F.explode(listed).alias("k")).select(F.col("k.license").alias("license"), F.sha2(canonical(F.col("k.body")), 256).alias("digest")).distinct()
    begins = sorted({m.lower() for _, b in known if (m := _first_letters(b))})
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit("line").alias("scope"), (i + 1).cast("long").alias("line_no"), x.alias("body")))
    whole = F.array(F.struct(F.lit("document").alias("scope"), F.lit(None).cast("long").alias("line_no"), F.col("text").alias("body")))
    likely = lambda u: F.lower(F.regexp_extract(u["body"], FIRST_WORD, 1)).isin(begins)
    units = docs.select("doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", F.explode(F.filter(F.concat(whole, lines), likely)).alias("u"))
    units = units.select("doc_id", "u.scope", "u.line_no", canonical(F.col("u.body")).alias("body")).where(F.col("body") != "")
    units = units.select("doc_id", "scope", "line_no", F.sha2("body", 256).alias("digest"))
    if len(known) <= KNOWN_LIMIT:
        lookup = F.broadcast(lookup)
    return units.join(lookup, "digest").select("doc_id", "scope", "line_no", "license", "digest")


def _first_letters(text: str) -> str:
    """What FIRST_WORD finds in a known text (whose copyright lines, if any, are in ASCII)."""
    left = re.sub(COPYRIGHT_LINE, "", text)
    return "".join(c if unicodedata.category(c)[0] not in "PSZC" else " " for c in left).split()[0][:FIRST_LETTERS] if left.strip() else ""


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def form(x: str) -> str:
        out = f"regexp_replace(lower(regexp_replace({x}, '{COPYRIGHT_LINE}', '', 'g')), '{PUNCTUATION}', ' ', 'g')"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return f"trim({out})"

    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in ALL_KNOWN)
    return f"""
WITH k AS (SELECT DISTINCT license, sha256({form('body')}) AS digest FROM (VALUES {values}) v(license, body)),
l AS (SELECT doc_id, string_split(text, chr(10)) AS parts, text FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, 'document' AS scope, CAST(NULL AS BIGINT) AS line_no, text AS body FROM l
      UNION ALL SELECT doc_id, 'line', i, parts[i] FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM l)),
c AS (SELECT doc_id, scope, line_no, {form('body')} AS body FROM u)
SELECT c.doc_id, c.scope, c.line_no, k.license, k.digest FROM c JOIN k ON sha256(c.body) = k.digest WHERE c.body <> ''"""


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLES = {"op7_license_scan": _sql()}
