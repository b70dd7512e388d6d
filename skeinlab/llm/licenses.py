"""Licence scans by canonical digests of entire texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skeinlab.llm.common import BROADCAST_ROWS, bounded_broadcast

# Equivalent spellings (left becomes right), after lower-casing.
SPELLINGS = (
    ("licence", "license"), ("licencing", "licensing"), ("sub-license", "sublicense"), ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("fulfilment", "fulfillment"), ("merchantable", "merchantability"),
    ("favour", "favor"), ("honour", "honor"), ("organisation", "organization"), ("organise", "organize"), ("recognise", "recognize"),
    ("authorise", "authorize"), ("authorisation", "authorization"), ("utilisation", "utilization"), ("initialise", "initialize"),
    ("programme", "program"), ("whilst", "while"), ("https://", "http://"),
)

COPYRIGHT_LINE = r"(?im)^[\x20\t#*/;%!-]*(?:copyright[\x20\t]*(?:\(c\)|©|:|by\b|[0-9])|\(c\)[\x20\t]*[0-9]|©|all rights reserved)[^\n]*$"

_GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Known licence texts and notices, by identifier; several texts may share one.
KNOWN = (
    ("MIT", _GRANT_MIT), ("MIT", "MIT License\n\n" + _GRANT_MIT), ("MIT", "The MIT License (MIT)\n\n" + _GRANT_MIT),
    ("ISC", _GRANT_ISC.format(", provided that the above copyright notice and this permission notice appear in all copies.")),
    ("0BSD", _GRANT_ISC.format(".")),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("MIT", "Released under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


def canonical(text: Column) -> Column:
    """A text in canonical form: copyright lines dropped, lower case, one spelling, words of letters and digits joined by one space."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, COPYRIGHT_LINE, " ")
    t = F.lower(t)
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.btrim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """Reference table (digest, license_id), one row for each digest; ties take the first identifier in order."""
    df = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("text")) for k, t in known])))
    return df.select(digest(F.col("text")).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, digest of the canonical text, license_id (null if not a known text), line_licenses.

    The known digests are hash-joined; they are broadcast when they number at most BROADCAST_ROWS.
    line_licenses lists, comma-joined in order and each once, the licences of which a line of the text is an
    entire known text; lines are looked up in one row that holds all known digests, or, if these number
    more, the distinct lines of each text are joined to them.
    Null and empty texts, and texts that hold nothing but copyright lines, have the digest of the empty text
    and no licence. Repeated rows each get a row; an empty table gives none.
    """
    spark = docs.sparkSession
    known = known_digests(spark) if known is None else known
    n = known.limit(BROADCAST_ROWS + 1).count()
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_t")).withColumn("digest", digest(F.col("_t")))
    few = bounded_broadcast(known.select(F.col("digest").alias("k_digest"), "license_id"), n)
    out = rows.join(few, rows["digest"] == F.col("k_digest"), "left")
    lines = F.transform(F.split(F.coalesce(F.col("_t"), F.lit("")), "\n", -1), digest)
    if n > BROADCAST_ROWS:  # lines of each distinct text go to the known digests
        key = F.sha2(F.coalesce(F.col("_t"), F.lit("")), 256)
        each = rows.select(key.alias("_key"), F.explode(F.array_distinct(lines)).alias("line")).distinct()
        named = each.join(known, each["line"] == known["digest"]).groupBy("_key").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses"))
        return out.withColumn("_key", key).join(named, "_key", "left").select(id_col, rows["digest"], "license_id", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))
    every = known.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license_id"))).alias("_known"))  # one row
    hits = F.array_intersect(lines, F.map_keys("_known"))
    out = out.join(F.broadcast(every)).select("*", hits.alias("_hits"))
    named = F.array_sort(F.array_distinct(F.transform("_hits", lambda d: F.try_element_at(F.col("_known"), d))))
    return out.select(id_col, "digest", "license_id", F.array_join(named, ",").alias("line_licenses"))


def oracle_sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """DuckDB SQL for the scan of `documents`."""

    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canon(x: str) -> str:
        x = f"lower(regexp_replace(coalesce({x}, ''), {q(COPYRIGHT_LINE)}, ' ', 'g'))"
        for old, new in SPELLINGS:
            x = f"replace({x}, {q(old)}, {q(new)})"
        return f"sha256(trim(regexp_replace({x}, {q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')}, ' ', 'g')))"

    rows = ", ".join(f"({q(k)}, {q(t)})" for k, t in known)
    return f"""WITH known AS (SELECT {canon('t')} AS digest, min(k) AS license_id FROM (VALUES {rows}) v(k, t) GROUP BY 1),
m AS (SELECT map_from_entries(list((digest, license_id))) AS mp FROM known),
d AS (SELECT doc_id, {canon('text')} AS digest, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {canon('x')}) AS lines FROM documents)
SELECT d.doc_id, d.digest, known.license_id,
       array_to_string(list_sort(list_distinct(list_transform(list_filter(lines, lambda x: map_contains(mp, x)), lambda x: mp[x]))), ',') AS line_licenses
FROM d LEFT JOIN known USING (digest), m"""
