"""Licence scan by canonical digest lookup, in built-in expressions only.

A text is put into canonical form (lower case; copyright lines dropped;
equivalent spellings unified; punctuation and space collapsed) and its SHA-256
is hash-joined with a table of known digests.  Besides the whole text, each of
its lines is looked up, so a licence statement heading a document is found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>"""
_MIT_ZERO = "\n".join(x.removesuffix(", subject to the following conditions:") + ("." if x.endswith("conditions:") else "") for x in _MIT.split("\n") if not x.startswith("The above"))

#: Licences that a line can state by identifier or by name.
_STATED = (
    ("MIT", "MIT License"), ("ISC", "ISC License"), ("0BSD", "Zero-Clause BSD License"), ("BSD-2-Clause", "2-Clause BSD License"), ("BSD-3-Clause", "3-Clause BSD License"),
    ("Apache-2.0", "Apache License, Version 2.0"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("GPL-2.0-only", "GNU General Public License, version 2"), ("GPL-3.0-only", "GNU General Public License, version 3"),
    ("GPL-2.0-or-later", "GNU General Public License, version 2 or later"), ("GPL-3.0-or-later", "GNU General Public License, version 3 or later"), ("LGPL-2.1-only", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0-only", "GNU Lesser General Public License, version 3"), ("AGPL-3.0-only", "GNU Affero General Public License, version 3"), ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"), ("Zlib", "zlib License"), ("Unlicense", "Unlicense"),
)


def _statements() -> list[tuple[str, str]]:
    """One-line statements of each licence."""
    out = []
    for licence, name in _STATED:
        named = [name, f"the {name}"]
        out += [(licence, f"SPDX-License-Identifier: {licence}")]
        out += [(licence, f"{how} {n}.") for n in named for how in ("Licensed under", "Released under", "This work is licensed under")]
    return out


#: Known texts: (licence, text).  Public licence wordings and one-line statements.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "The MIT License\n" + _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + "\n" + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + "\n" + _BSD_THIRD + "\n" + _BSD_END),
    ("Apache-2.0", _APACHE_HEADER),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("MIT-0", _MIT_ZERO),
    ("MIT-0", "MIT No Attribution\n" + _MIT_ZERO),
    *_statements(),
    ("LicenseRef-reserved", "All rights reserved."),
)

#: Equivalent spellings: (pattern, what it becomes), applied to lower-case text.
EQUIVALENT = (
    (r"licen[cs]e", "license"),
    (r"sub[ -]license", "sublicense"),
    (r"https:", "http:"),
    (r"copyright (owner|proprietor)", "copyright holder"),
    (r"non[ -]?infringement", "noninfringement"),
    (r"favou?r", "favor"),
    (r"&", " and "),
)
_COPYRIGHT = r"(?m)^[^\n\p{L}\p{N}]*(copyright\b[^\n]*(\(c\)|©|\b(19|20)\d\d\b)|\(c\) ?(19|20)\d\d|©|all rights reserved\.?[^\n\p{L}\p{N}]*$)[^\n]*"
#: Digests of the canonical form of whole licence texts as published, with and without the appendix on how
#: to apply them: (licence, SHA-256).
KNOWN_DIGESTS = (
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),
    ("Apache-2.0", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "84f3c9e8cdded0036378e7e6eb92ac6570731434d2fc46027f259264dc16501e"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GFDL-1.3", "ccfa2750c2a3b9dae93f959cfa64078cc3a306c4a4cd4cfaf18365396202da90"),
    ("GPL-1.0", "7843068060f4d9ee30736221ce49abf6cb7dafa9b775fabb47fbf0c21e05b102"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
)


def canonical(text: Column, whole: bool = True) -> Column:
    """The canonical form; with `whole` lines are joined, else line ends stay."""
    t = F.lower(text)
    if whole:
        t = F.regexp_replace(t, _COPYRIGHT, " ")
    for pattern, into in EQUIVALENT:
        t = F.regexp_replace(t, pattern, into)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+" if whole else r"[^\p{L}\p{N}\n]+", " ")
    return F.trim(t)


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, licence) of KNOWN and KNOWN_DIGESTS: as many rows as the table has, whatever the corpus."""
    rows = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(text).alias("known")) for name, text in KNOWN])
    table = spark.range(1).select(F.explode(rows).alias("r")).select("r.licence", "r.known")
    forms = table.select("licence", F.sha2(canonical(F.col("known")), 256).alias("digest")).unionByName(table.select("licence", F.sha2(F.trim(canonical(F.col("known"), False)), 256).alias("digest")))
    whole = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(digest).alias("digest")) for name, digest in KNOWN_DIGESTS])
    forms = forms.unionByName(spark.range(1).select(F.explode(whole).alias("r")).select("r.licence", "r.digest"))
    return forms.where(F.col("digest") != F.sha2(F.lit(""), 256)).groupBy("digest").agg(F.min("licence").alias("licence"))


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_digest, licence, line_licences) of every row.

    `licence` names the licence whose canonical text equals the whole document's,
    else it is null; `line_licences` lists, sorted, those stated by a line of
    their own.  Null, empty and punctuation-only texts have the digest of the
    empty form and no licence.  Repeated rows are looked up one by one.  Known
    forms that coincide go to the first name in order.  Other columns are
    ignored.
    """
    known = known_digests(docs.sparkSession)
    # as many entries as KNOWN has, twice: a constant of this module
    by_digest = F.create_map(*[F.lit(x) for r in known.collect() for x in (r["digest"], r["licence"])])
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = F.filter(F.transform(F.array_distinct(F.split(t, "\n")), lambda x: F.try_element_at(by_digest, F.sha2(canonical(x, False), 256))), lambda x: x.isNotNull())
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(canonical(t), 256).alias("text_digest"), F.array_sort(F.array_distinct(found)).alias("line_licences"))
    whole = F.broadcast(known.withColumnRenamed("digest", "text_digest"))
    return base.join(whole, "text_digest", "left").select("doc_id", "text_digest", "licence", "line_licences")


def op10_licence_scan(spark, sf_dir: str) -> DataFrame:
    """The whole documents table; the list of stated licences as one string."""
    out = licence_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "text_digest", "licence", F.array_join("line_licences", ",").alias("line_licences"))


def _sql_canonical(t: str, whole: bool) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    t = f"lower({t})"
    if whole:
        t = f"regexp_replace({t}, {q(_COPYRIGHT)}, ' ', 'g')"
    for pattern, into in EQUIVALENT:
        t = f"regexp_replace({t}, {q(pattern)}, {q(into)}, 'g')"
    return f"trim(regexp_replace({t}, {q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + ('' if whole else chr(92) + 'n') + ']+')}, ' ', 'g'))"


def _oracle() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({q(n)}, {q(t)})" for n, t in KNOWN)
    digests = ", ".join(f"({q(n)}, {q(d)})" for n, d in KNOWN_DIGESTS)
    return f"""
WITH k(licence, known) AS (VALUES {values}),
f AS (SELECT licence, sha256({_sql_canonical('known', True)}) AS digest FROM k UNION ALL SELECT licence, sha256({_sql_canonical('known', False)}) FROM k UNION ALL SELECT * FROM (VALUES {digests})),
g AS (SELECT digest, min(licence) AS licence FROM f WHERE digest <> sha256('') GROUP BY digest),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
m AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences
      FROM (SELECT doc_id, sha256({_sql_canonical('x', False)}) AS digest FROM l) JOIN g USING (digest) GROUP BY doc_id),
w AS (SELECT doc_id, sha256({_sql_canonical('t', True)}) AS text_digest FROM d)
SELECT w.doc_id, w.text_digest, g.licence, coalesce(m.line_licences, '') AS line_licences
FROM w LEFT JOIN g ON g.digest = w.text_digest LEFT JOIN m ON m.doc_id = w.doc_id
"""


ORACLE_OP10 = _oracle()
