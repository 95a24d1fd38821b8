"""License scans by canonical digest lookup, with DataFrame functions only.

A text is brought to a canonical form: lower case, copyright lines and punctuation removed, equivalent spellings
unified, white space collapsed. Its digest is looked up in a table of the digests of known licence texts and notices by a hash
join. The table is built from the texts below by the same expressions, so both sides always agree.

Whole texts are looked up first; since licences mostly stand inside longer documents, each line (a notice that stands for itself) and
each paragraph (lines between empty lines) is looked up as an entire text too.

Defined results: a null or empty text has the digest of the empty string and matches nothing; every row gets exactly one result
row, repeated rows included; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.license_texts import known_texts

# Equivalent spellings, after lower-casing and removal of punctuation.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("organisation", "organization"),
    ("merchantable", "merchantability"),
    ("non commercial", "noncommercial"),
    ("sub license", "sublicense"),
    ("per cent", "percent"),
    ("version", "v"),
)

# Public notices and short licence texts, as published.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_REST),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", _ISC_GRANT + ". " + _ISC_REST),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *known_texts(),
)

#: A line that starts as a copyright statement names years and holders; it is no part of a licence's wording.
COPYRIGHT = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
#: Line breaks stay for now; each separator becomes two blanks, so that neighbouring words can both be replaced.
SEPARATORS = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form of a text with its line breaks; null: empty."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    x = F.concat(F.lit(" "), F.replace(F.regexp_replace(x, SEPARATORS, "  "), F.lit("\n"), F.lit("  \n  ")), F.lit(" "))
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new} "))
    return x


def as_one_line(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \n]+", " "))


def known_digests(spark: SparkSession) -> DataFrame:
    """license_digest, license_id, chars: one row per known text, a fixed few hundred."""
    table = spark.createDataFrame(list(KNOWN), "license_id string, text string")
    table = table.withColumn("canonical", as_one_line(canonical_lines(F.col("text"))))
    return table.groupBy(F.sha2(F.col("canonical").cast("binary"), 256).alias("license_digest")).agg(F.min("license_id").alias("license_id"), F.max(F.char_length("canonical")).alias("chars"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, text_digest, whole_license, licenses (distinct, sorted, comma-joined), n_notices.

    known is a table as known_digests() gives it; it is broadcast, so it must be a list of licences, not a corpus. Pieces
    whose canonical length is no known text's cannot match and are not hashed; that loses nothing.
    """
    known = known if known is not None else known_digests(docs.sparkSession)
    lengths = sorted(r["chars"] for r in known.select("chars").distinct().collect())
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), canonical_lines(F.col(f"`{text_col}`")).alias("lines"))
    base = base.withColumn("whole", as_one_line(F.col("lines"))).withColumn("text_digest", F.sha2(F.col("whole").cast("binary"), 256))
    notices = F.transform(F.split(F.regexp_replace("lines", " +", " "), "\n", -1), lambda p: F.trim(p))
    paragraphs = F.transform(F.filter(F.split("lines", r"\n *\n", -1), lambda p: F.contains(F.trim(p), F.lit("\n"))), as_one_line)
    pieces = F.filter(F.concat(notices, paragraphs, F.array("whole")), lambda p: F.char_length(p).isin(lengths))
    hashed = F.transform(pieces, lambda p: F.sha2(p.cast("binary"), 256))
    # The outer form, as a filter on empty lists would compute them twice; the null digest of a text without pieces meets no licence.
    pieces = base.select("doc_id", "text_digest", F.explode_outer(hashed).alias("license_digest"))
    hits = pieces.join(F.broadcast(known.select("license_digest", "license_id")), "license_digest")
    # Repeated rows share both keys and all their pieces, so a piece's count is divided by theirs.
    rows = base.groupBy("doc_id", "text_digest").agg(F.count("*").alias("copies"))
    hits = hits.groupBy("doc_id", "text_digest").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("licenses"), F.count("*").alias("n"))
    found = rows.join(hits, rows["doc_id"].eqNullSafe(hits["doc_id"]) & (rows["text_digest"] == hits["text_digest"]), "left").select(rows["doc_id"], rows["text_digest"], "copies", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n", F.lit(0)).alias("n"))
    out = found.join(F.broadcast(known.select(F.col("license_digest").alias("text_digest"), F.col("license_id").alias("whole_license"))), "text_digest", "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "text_digest", "whole_license", "licenses", F.expr("n div copies").alias("n_notices"))
