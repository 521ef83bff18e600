"""Licence texts by canonical digest.

A text is made canonical (lower case, copyright lines dropped, equivalent spellings unified, punctuation and
white space reduced to single blanks) and its SHA-256 is looked up among the digests of known licences made
canonical the same way. Only entire texts match. Everything is column expressions; the known digests are a table
of bounded size, checked before it is sent to the executors.

Defined cases: a null text has no digest and no licence; a text that is empty once canonical has a digest and no
licence; of known texts with one digest, the least name is given; repeated rows get equal results; an empty
table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import free_name
from wayfare.session import materialise

#: More known texts than this are joined without a broadcast hint.
SEND = 10_000

# ---- fixed values: spellings taken as equal ---------------------------------------------------------------------
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "sub license": "sublicense",
    "sub licensed": "sublicensed",
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorised": "authorized",
    "copyright owner": "copyright holder",
    "favour": "favor",
    "fulfil": "fulfill",
    "noncommercial": "non commercial",
    "organisation": "organization",
    "per cent": "percent",
    "recognised": "recognized",
    "http": "https",
}

# ---- fixed values: public licence texts and notices -------------------------------------------------------------
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
KNOWN = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
]

#: A line that says whose the rights are: after any comment marks "copyright" with a sign, a year or "by", or the sign
#: with a year. Lines of running text that happen to begin with the word stay.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*(?:copyright[ \t,:]*(?:\(c\)|©|by\b|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    lines = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(lines, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for spelled, same in SPELLINGS.items():
        if spelled != same:
            plain = F.replace(plain, F.lit(f" {spelled} "), F.lit(f" {same} "))
    return F.trim(plain)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, licence) of known texts, one row per digest."""
    return known_of(spark.createDataFrame(texts, "licence string, text string"))


def known_of(texts: DataFrame) -> DataFrame:
    return texts.where(F.length(canonical(F.col("text"))) > 0).groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))


def lookup(texts: DataFrame, known_texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``texts`` with digest and licence (null if unknown); columns of these names are replaced."""
    few = known_texts.limit(SEND + 1).count() <= SEND
    mine = free_name(texts, "_known")
    table = known_texts.select(F.struct(F.col("digest").alias("d"), F.col("licence").alias("l")).alias(mine))
    held = texts.withColumn("digest", digest(F.col(text_col)))
    joined = held.join(F.broadcast(table) if few else table, held["digest"] == F.col(f"{mine}.d"), "left")
    return joined.withColumn("licence", F.col(f"{mine}.l")).drop(mine)


def notices(texts: DataFrame, known_texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``texts`` with ``notices``: for every line that is a known text as a whole, the name of its licence.

    Up to ``SEND`` known texts are a map of digests and lines stay in their row; more of them are joined with the lines.
    """
    listed = known_texts.limit(SEND + 1).collect()
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: F.length(x) > 0)
    none = F.array().cast("array<string>")
    if not listed:
        return texts.withColumn("notices", none)
    if len(listed) > SEND:
        return joined_notices(texts, known_texts, lines)
    table = F.create_map(*[F.lit(x) for r in listed for x in (r["digest"], r["licence"])])
    names = F.filter(F.transform(lines, lambda x: F.try_element_at(table, digest(x))), lambda x: x.isNotNull())
    return texts.withColumn("notices", F.coalesce(names, none))


def joined_notices(texts: DataFrame, known_texts: DataFrame, lines: Column) -> DataFrame:
    """``notices`` for any number of known texts: a hash join of line digests, put together again per row."""
    row = free_name(texts, "_row")
    held = materialise(texts.withColumn(row, F.monotonically_increasing_id()), "licence-rows")  # so that a row keeps its number
    each = held.select(F.col(row).alias("row"), F.posexplode(lines).alias("at", "line")).select("row", "at", digest(F.col("line")).alias("digest"))
    found = each.join(known_texts.select("digest", "licence"), "digest").where(F.col("licence").isNotNull())
    told = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "licence"))).alias("told"))  # at most a text's lines
    mine = free_name(held, "_told")
    told = told.select(F.col("row").alias(row), F.col("told.licence").alias(mine))
    return held.join(told, row, "left").withColumn("notices", F.coalesce(F.col(mine), F.array().cast("array<string>"))).drop(row, mine)
