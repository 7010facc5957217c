"""Operator 5, licence scans by canonical digests, DataFrame functions only.

A text is brought to a canonical form: lower case, copyright lines gone, equivalent spellings made one, punctuation and white
space reduced to single spaces. The SHA-256 of the whole text's form is joined with the digests of known licences. So are, for
licences and notices within longer documents, the digests of all runs of whole lines whose form is as long as that of a known text,
however the text is wrapped; ends of lines and lengths are sums of one pass, and no word has to occur for a line to be looked at.

Known are the short licences and usual notices given here as texts, and long licences by their digests; ``digests_of_texts`` makes
the same table of a folder of texts.

Defined results: a null or empty text matches nothing; an empty table gives an empty result; repeated rows are scanned each by
itself; where several known texts have one canonical form, the least identifier is given; a text that is a licence as a whole has it
among its notices too; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, materialise, table

#: Lines of a document are added up by so many, then the sums of those.
GROUP = 512

# Equivalent spellings, of which the second stands for both.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("noncommercial", "non-commercial"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("whilst", "while"), ("judgement", "judgment"), ("favour", "favor"), ("https://", "http://"))

# Public licence texts and the usual notices, by SPDX identifier.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("MIT", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)


# Long licences by SPDX identifier, the length and the SHA-256 of the canonical form of the published text.
DIGESTS = (
    ("Apache-2.0", 9921, "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Apache-2.0", 8866, "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Artistic-1.0-Perl", 5833, "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", 19585, "3842a16357f0cdd1e23bb92ec7360a85dcebc4d690aa011625db0b4c951608b1"),
    ("GFDL-1.3-only", 22020, "af67fd0f1a174a4bcb2f40070ab1d7b5e3519fd4e36fa89113923de9a4638f52"),
    ("GPL-1.0-only", 11766, "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-1.0-only", 9416, "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),
    ("GPL-2.0-only", 17118, "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-2.0-only", 14484, "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"),
    ("GPL-3.0-only", 33407, "3c39b58d51baf32b2a21a55c429305f51cfd82e53cad05134293933580b4cd84"),
    ("GPL-3.0-only", 30969, "57f71ba95bda9ddb21fcd4d2b6841fdc3ef7fcebd5c12a2fd2ee5f2027869fc6"),
    ("LGPL-2.0-only", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0-only", 22277, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1-only", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1-only", 23365, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0-only", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22467, "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", 14341, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)


def canonical(text: Column) -> Column:
    """The form in which equal licences are equal; '' for a null text."""
    out = ascii_lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"(?m)^[^a-z0-9\n]*(?:copyright\b|\(c\)|©)[^\n]*(?:\(c\)|©|[12][0-9]{3}|all rights reserved)[^\n]*$", " ")
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def _table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest", "length").agg(F.min("license").alias("license"))


def digests_of_texts(texts: DataFrame) -> DataFrame:
    """(license, text) to the table of known licences: (digest, length, license), one row a canonical form."""
    return _table(texts.select(digest(F.col("text")).alias("digest"), F.char_length(canonical(F.col("text"))).alias("length"), "license"))


def known_digests(spark: SparkSession, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """The table of known licences from (license, text) and (license, length, digest)."""
    texts = spark.createDataFrame([(i, t) for i, t in known], "license string, text string")
    ready = spark.createDataFrame([(d, n, i) for i, n, d in digests], "digest string, length int, license string")
    return _table(digests_of_texts(texts).select("digest", "length", "license").union(ready))


def _running_sums(numbers: Column) -> Column:
    """The sum up to each number of an array; by groups, since an array that grows is copied each time."""
    upto = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x)))
    groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(numbers) / GROUP).cast("int") - 1), lambda g: upto(F.slice(numbers, g * GROUP + 1, F.lit(GROUP))))
    before = lambda sums: F.concat(F.array(F.lit(0)), upto(F.transform(sums, lambda a: F.get(a, F.size(a) - 1))))
    put = lambda sums: F.flatten(F.transform(F.arrays_zip(sums.alias("a"), F.slice(before(sums), F.lit(1), F.size(sums)).alias("b")), lambda g: F.transform(g["a"], lambda x: x + g["b"])))
    return F.when(F.size(numbers) > 0, put(groups)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) to one row per document: doc_id, license (of the whole text), notices (of runs of its lines, sorted), canonical_sha256.

    Digests are hash-joined with the known ones; texts are not shuffled. ``known`` is a table of some thousand rows at most, of
    whose lengths each task has a list.
    """
    known = known if known is not None else known_digests(docs.sparkSession)
    lengths = F.array(*[F.lit(r.length) for r in known.select("length").distinct().orderBy("length").collect()]).cast("array<int>")
    rows = docs.select("doc_id", F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), canonical), lambda x: x != "").alias("_lines"))
    rows = rows.withColumns({"_whole": F.array_join("_lines", " "), "_sizes": F.transform("_lines", lambda x: F.char_length(x))}).drop("_lines")
    # A line and the space after it.
    rows = rows.withColumn("_after", _running_sums(F.transform("_sizes", lambda n: n + 1)))
    rows = rows.withColumns({"_ends": F.transform("_after", lambda x: x - 1), "_starts": F.zip_with("_after", "_sizes", lambda x, n: x - 1 - n)})
    fits = F.filter(lengths, lambda n: n <= F.char_length("_whole"))
    runs = F.flatten(F.transform(fits, lambda n: F.transform(F.array_intersect(F.transform("_starts", lambda x: x + n), F.col("_ends")), lambda e: F.struct((e - n + 1).alias("at"), n.alias("n")))))
    found = F.array_distinct(F.transform(runs, lambda r: F.sha2(F.substring(F.col("_whole"), r["at"], r["n"]).cast("binary"), 256)))
    rows = rows.select("doc_id", F.sha2(F.col("_whole").cast("binary"), 256).alias("digest"), found.alias("_runs"))
    rows = materialise(rows.withColumn("_uid", F.monotonically_increasing_id()), "license-rows")
    named = known.select("digest", "license")
    notices = rows.select("_uid", F.explode("_runs").alias("digest")).join(named, "digest").groupBy("_uid").agg(F.sort_array(F.collect_set("license")).alias("notices"))
    return rows.join(named, "digest", "left").join(notices, "_uid", "left").select(
        "doc_id", "license", F.array_join(F.coalesce("notices", F.array().cast("array<string>")), ",").alias("notices"), F.col("digest").alias("canonical_sha256")
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _canonical_sql(text: str) -> str:
    out = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = rf"regexp_replace({out}, '(?m)^[^a-z0-9\n]*(?:copyright\b|\(c\)|©)[^\n]*(?:\(c\)|©|[12][0-9]{{3}}|all rights reserved)[^\n]*$', ' ', 'g')"
    for one, other in SPELLINGS:
        out = f"replace({out}, '{one}', '{other}')"
    return rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _oracle() -> str:
    known = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    ready = ", ".join(f"('{d}', {n}, '{i}')" for i, n, d in DIGESTS)
    return rf"""
WITH k0(license, t) AS (VALUES {known}),
k1 AS (SELECT sha256({_canonical_sql("t")}) AS digest, length({_canonical_sql("t")}) AS n, license FROM k0 UNION ALL SELECT * FROM (VALUES {ready}) r(digest, n, license)),
k AS (SELECT digest, n, min(license) AS license FROM k1 GROUP BY ALL),
d AS (SELECT row_number() OVER () AS uid, doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_canonical_sql("x")}), lambda x: x <> '') AS lines FROM documents),
w AS (SELECT uid, doc_id, lines, coalesce(array_to_string(lines, ' '), '') AS whole FROM d),
x AS (SELECT uid, generate_subscripts(lines, 1) AS i, length(unnest(lines)) AS n FROM w),
e AS (SELECT uid, n, sum(n + 1) OVER (PARTITION BY uid ORDER BY i) - 1 AS e FROM x),
r AS (SELECT s.uid, s.e - s.n AS at, l.n FROM e s JOIN (SELECT DISTINCT n FROM k) l ON true JOIN e t ON t.uid = s.uid AND t.e = s.e - s.n + l.n),
n AS (SELECT r.uid, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices FROM r JOIN w USING (uid) JOIN k ON k.digest = sha256(substring(w.whole, (r.at + 1)::BIGINT, r.n)) GROUP BY r.uid)
SELECT w.doc_id, k.license, coalesce(n.notices, '') AS notices, sha256(w.whole) AS canonical_sha256 FROM w LEFT JOIN k ON k.digest = sha256(w.whole) LEFT JOIN n ON n.uid = w.uid"""


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE = {"op5_license_scan": _oracle()}
