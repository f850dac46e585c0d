"""License scans by canonical digest lookup, in DataFrame functions only.

A text's canonical form is lower case, without copyright lines, with equivalent spellings
made one, punctuation turned to spaces and white space runs to one space. Two units of every
document are looked up by the SHA-256 of their canonical form: the entire text, and each of
its lines as an entire notice. The known texts are a table (license_id, text); by default one
of this module, a few dozen rows. Its digests are broadcast up to ``BROADCAST_TEXTS`` rows and
joined beyond; no text of a document is ever shuffled.

Edge cases: a null text has a null digest and no license; an empty or blank text has the
digest of the empty form, which is no license; lines that are blank in canonical form are
never looked up. Rows that repeat a doc_id each get a row of their own. Other columns of
``docs`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, as they read without punctuation.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("sublicence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("favour", "favor"),
    ("labour", "labor"),
    ("honour", "honor"),
    ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorised", "authorized"),
    ("initialise", "initialize"),
    ("programme", "program"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("http", "https"),
]

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

# Public license texts and short notices, by SPDX identifier.
KNOWN = [
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("MIT", "The MIT License\n\n" + _MIT_BODY),
    ("MIT", _MIT_BODY),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_TOP + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_TOP + _BSD_END),
    ("BSD-3-Clause", _BSD_TOP + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_TOP + _BSD_THIRD + _BSD_END),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("WTFPL", """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
]

#: Known texts up to which their digests are broadcast; some hundred bytes each.
BROADCAST_TEXTS = 20_000

#: A line that only states who holds the copyright, also behind marks of a comment.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;%!<>\-]*(copyright[ \t]+(\(c\)|©|[0-9]{4})|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E©“”‘’–—…]+"
WHITE = r"[\x20\x09-\x0D]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    # Java's multi-line mode also starts lines at a carriage return; (?d) leaves line feeds alone.
    out = F.regexp_replace(F.lower(text), "(?d)" + COPYRIGHT_LINE, "")
    # Two spaces between words, so that each spelling stands between spaces of its own.
    out = F.concat(F.lit("  "), F.regexp_replace(F.regexp_replace(out, PUNCTUATION, " "), WHITE, "  "), F.lit("  "))
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(f" {spelling} ".replace(" ", "  ")), F.lit(f" {one} ".replace(" ", "  ")))
    return F.trim(F.regexp_replace(out, " +", " "))


def builtin_texts(spark: SparkSession) -> DataFrame:
    """license_id, text: what this module knows."""
    rows = F.array(*[F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in KNOWN])
    return spark.range(1).select(F.inline(rows)).select("license_id", "text")


def known_licenses(texts: DataFrame) -> DataFrame:
    """known_digest, license_id, known_length: one row per distinct canonical text. Null and blank texts are none."""
    forms = texts.select("license_id", canonical(F.col("text")).alias("form")).where(F.length("form") > 0)
    return forms.groupBy(F.sha2("form", 256).alias("known_digest")).agg(F.min("license_id").alias("license_id"), F.min(F.length("form")).alias("known_length"))


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """doc_id, text_digest, license_id, n_notices, notices for every document.

    ``license_id`` names the license the entire text is, null for none. ``notices`` lists the
    licenses of which some line is an entire known notice, in order, between commas;
    ``n_notices`` is their number. ``texts`` (license_id, text) are the known licenses; texts
    of one canonical form count as the least id.
    """
    spark = docs.sparkSession
    known = known_licenses(builtin_texts(spark) if texts is None else texts)
    # One small row per known text; a length is a number, and there are no more of them than texts.
    lengths = sorted({r[0] for r in known.select("known_length").distinct().collect()}) or [0]
    if texts is None or known.count() <= BROADCAST_TEXTS:
        known = F.broadcast(known)
    rows = docs.select("doc_id", F.sha2("text", 256).alias("raw_digest"), "text")
    # Lines as entire units. A form whose length no known text has can't match.
    line = rows.select("doc_id", "raw_digest", F.explode(F.split("text", "\n")).alias("line"))
    near = line.where(F.length("line") * 2 >= min(lengths)).select("doc_id", "raw_digest", canonical(F.col("line")).alias("form"))
    lines = near.where(F.length("form").isin(lengths)).select("doc_id", "raw_digest", F.sha2("form", 256).alias("known_digest"))
    per_license = lines.join(known, "known_digest").select("doc_id", "raw_digest", "license_id").distinct()
    notices = per_license.groupBy(F.col("doc_id").alias("notice_doc"), F.col("raw_digest").alias("notice_raw")).agg(
        F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_list("license_id")), ",").alias("notices")
    )
    whole = rows.select("doc_id", "raw_digest", F.sha2(canonical(F.col("text")), 256).alias("text_digest"))
    entire = whole.join(known, F.col("text_digest") == F.col("known_digest"), "left").select("doc_id", "raw_digest", "text_digest", "license_id")
    return entire.join(notices, F.col("doc_id").eqNullSafe(F.col("notice_doc")) & (F.col("raw_digest") == F.col("notice_raw")), "left").select(
        "doc_id", "text_digest", "license_id", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices")
    )
