"""Licence scan: canonical text, digest, and a hash join with the digests of known licences.

Whole texts are looked up, and so is each line of a text, which finds one-line licence notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import let, store, text_key

# Public licence texts and notices, as published.
_MIT_BODY = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    'publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, '
    'subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or '
    'substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    'BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS '
    'OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING '
    'FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.')
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    'OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY '
    'DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, '
    'ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.')
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must "
    "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment "
    "in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and "
    "must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.")
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n")
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n\n")
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    'LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT '
    'HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT '
    'LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY '
    'THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE '
    'OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.')
KNOWN = (
    ("MIT", _MIT_BODY), ("MIT", "MIT License\n\n" + _MIT_BODY), ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_DISCLAIMER),
    ("BSD-2-Clause", _BSD_TWO + _BSD_DISCLAIMER), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_TWO + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_TWO + _BSD_THIRD + _BSD_DISCLAIMER), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_TWO + _BSD_THIRD + _BSD_DISCLAIMER),
    ("ISC", "SPDX-License-Identifier: ISC"), ("0BSD", "SPDX-License-Identifier: 0BSD"), ("Zlib", _ZLIB), ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("honour", "honor"),
    ("fulfilment", "fulfillment"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("https ", "http "),
)
NO_HOLDERS = (
    "notice notices holder holders owner owners law laws license licenses licence licences and or in on of to is are as for the this that "
    "protection protected interest interests statement statements right rights").split()
"""Words that go on with a sentence after ``copyright``; any other word there is a holder."""


def other_word(words: list[str], start: bool = True) -> str:
    """Pattern of the begin of a word that isn't one of ``words``, without look-ahead, which DuckDB's patterns don't have."""
    heads = sorted({w[0] for w in words if w})
    listed = "".join(heads)
    free = "".join(c for c in "abcdefghijklmnopqrstuvwxyz0123456789" if c not in listed)
    parts = [f"[{free}]" if not start else rf"[{free}<\[{{]|[^\x00-\x7F]"]
    if not start and "" not in words:
        parts.append(r"[^a-z0-9]|$")
    return "(" + "|".join([*parts, *(h + other_word([w[1:] for w in words if w[:1] == h], False) for h in heads)]) + ")"


_YEAR = r"[\s,:<\[{(-]*([0-9]{4}|year|yyyy)"
COPYRIGHT = (
    r"^[^a-z0-9©(]*(©|all rights reserved|[^a-z0-9©]*all rights reserved|\(c\)[\s,:]*copyright\b|\(c\)" + _YEAR
    + r"|\(?copyright[\s,:-]*(\(c\)|©|by\b)|copyright" + _YEAR + r"|copyright:?\s+" + other_word(NO_HOLDERS) + ")")
NO_HOLDER = r"^[^a-z0-9©(]*(copyright|©|\(c\))[\s,:()c©-]*[0-9]{4}[\s,.0-9-]*$"
"""A notice that ends with its years; the holder may stand in the next line."""
HOLDER = r"^[^a-z0-9]*[a-z0-9][^\s]*(\s+[^\s]+){0,7}\s*$"
NOT_HOLDER = r"^[^a-z0-9]*(permission|redistribution|licensed|released|this|the|all|everyone|you|in|for|use|any|no|under|spdx|mit|isc|bsd|zlib)\b"
# Headings that licence texts are published under, in canonical form.
TITLES = (
    "mit license", "the mit license", "mit license mit", "the mit license mit", "isc license", "the isc license", "isc license isc", "the isc license isc",
    "bsd zero clause license", "zero clause bsd", "zero clause bsd license", "bsd 2 clause license", "the bsd 2 clause license", "simplified bsd license",
    "bsd 3 clause license", "the bsd 3 clause license", "new bsd license", "the new bsd license", "modified bsd license", "zlib license", "the zlib license",
)
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F©“”‘’„«»–—…·]+"


def canonical_line(line: Column, before: Column) -> Column:
    """Lower case, one space for punctuation and blanks, equivalent spellings; a copyright line becomes empty, and so does a short line after
    one that names no holder: there it stands."""
    out = F.trim(F.regexp_replace(line, PUNCTUATION, " "))
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(usual))
    holder = before.rlike(NO_HOLDER) & line.rlike(HOLDER) & ~line.rlike(NOT_HOLDER)
    return F.when(line.rlike(COPYRIGHT) | F.coalesce(holder, F.lit(False)), F.lit("")).otherwise(out)


def canonical_lines(text: Column) -> Column:
    return let(F.split(F.lower(text), "\n"), lambda lines: F.filter(
        F.transform(lines, lambda line, i: canonical_line(line, F.get(lines, i - 1))), lambda line: line != ""))


def _digest(lines: Column) -> Column:
    """SHA-256 of the canonical text without a licence's title in its first line."""
    titled = F.get(lines, F.lit(0)).isin(*TITLES)
    return F.sha2(F.array_join(F.when(titled, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines), " "), 256)


def _line_mark(line: Column) -> Column:
    """Two 64-bit hashes of a canonical line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """``digest``, ``license`` and ``mark`` (of the text as a line) of the known texts; one licence a digest, the least name if texts are equal.

    ``known`` is a list of ``(license, text)`` or a table with these columns.
    """
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license string, text string")
    rows = rows.select("license", canonical_lines(F.col("text")).alias("lines")).select(
        "license", _digest(F.col("lines")).alias("digest"), _line_mark(F.array_join("lines", " ")).alias("mark"))
    return rows.groupBy("digest", "mark").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``digest`` of the canonical text, its ``license`` or null, and ``notices``: the licences whose
    whole notice fills a line, sorted and comma-joined, empty if none.

    A null text counts as empty and has the digest of no text, which a title alone has too. Rows equal in id and text give equal results.
    Extra columns aren't looked at, and texts are read whole. ``known`` is
    joined by hash; Spark broadcasts it if it is small.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), text_key(text).alias("key"), let(
        canonical_lines(F.coalesce(F.col(text), F.lit(""))), lambda lines: F.struct(
            _digest(lines).alias("whole"), F.array_distinct(F.transform(lines, _line_mark)).alias("marks"))).alias("d"))
    # stored: texts are put in canonical form once, and what is left of them is read by both joins
    rows = store(rows.select(F.struct("doc_id", "key").alias("row"), F.col("d.whole").alias("digest"), F.col("d.marks").alias("marks")), "license-digests")
    names = known.groupBy("mark").agg(F.min("license").alias("notice"))
    notices = (
        rows.select("row", F.explode("marks").alias("mark")).join(names, "mark")
        .groupBy("row").agg(F.array_sort(F.collect_set("notice")).alias("notices")))
    whole = known.groupBy("digest").agg(F.min("license").alias("license"))
    named = rows.select("row", "digest").join(whole, "digest", "left")
    return named.join(notices, "row", "left").select(
        F.col("row.doc_id").alias("doc_id"), "digest", "license", F.coalesce(F.array_join("notices", ","), F.lit("")).alias("notices"))
