"""License scan by canonical digests.

A text is brought to one form: lower case; spellings that license authors treat as equal; whatever is neither letter nor
digit as one space; copyright lines removed. The SHA-256 of the whole form is joined by hash to the digests of known
license texts. Single lines are looked up the same way among the digests of known one-line notices. Everything is
DataFrame expressions; DuckDB SQL of the same steps is made from the same lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import license_texts

# Spellings that count as equal, in the order in which they are replaced.
SPELLINGS = [
    ("\r\n", "\n"), ("\r", "\n"), ("(c)", " copyright "), ("©", " copyright "), ("&", " and "), ("https:", "http:"), ("licence", "license"),
    ("licencing", "licensing"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"), ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"), ("organisation", "organization"), ("favour", "favor"), ("judgement", "judgment"), ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"), ("wilful", "willful"), ("redistribution's", "redistributions"), ("merchantibility", "merchantability"),
]
APART = r"[^\p{L}\p{N}\n]+"
COPYRIGHT_LINE = r"(?m)^ *(portions )?(copyright )+(.* )?((19|20)[0-9]{2}|year|yyyy)( .*)?$"
RIGHTS_LINE = r"(?m)^ *all rights reserved *$"
#: A catalogue of license texts is broadcast up to this many rows; beyond, the join shuffles.
BROADCAST_LICENSES = 50_000
MOST_NOTICES = 2_000

_AS_IS = """the software is provided "as is", without warranty of any kind, express or implied, including but not limited to
the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or
copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or
otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."""
_BSD_END = """this software is provided by the copyright holders and contributors "as is" and any express or implied warranties,
including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are
disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special,
exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of
use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract,
strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if
advised of the possibility of such damage."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

# License texts by SPDX identifier.
LICENSES = [
    ("MIT", f"""MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_AS_IS}"""),
    ("MIT-0", f"""MIT No Attribution
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so.
{_AS_IS}"""),
    ("ISC", f"""ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
{_ISC_END}"""),
    ("0BSD", f"""Zero-Clause BSD
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
{_ISC_END}"""),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_START}\n{_BSD_END}"),
    ("BSD-3-Clause", f"""BSD 3-Clause License
{_BSD_START}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
{_BSD_END}"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", license_texts.UNLICENSE),
    ("WTFPL", """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004
Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is
allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO."""),
    ("Apache-2.0", license_texts.APACHE_2), ("GPL-2.0", license_texts.GPL_2), ("GPL-3.0", license_texts.GPL_3), ("LGPL-2.1", license_texts.LGPL_2_1),
    ("LGPL-3.0", license_texts.LGPL_3), ("MPL-2.0", license_texts.MPL_2), ("CC0-1.0", license_texts.CC0_1),
]
# Usual headings of a license. The first one heads its text above (none: the text has no heading); each text is known under all of them and bare.
HEADINGS = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "(The MIT License)"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License", "MIT-0", "MIT No Attribution (MIT-0)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"],
    "0BSD": ["Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License", "BSD Zero-Clause License", "BSD Zero Clause License (0BSD)", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "2-Clause BSD License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License', "BSD License", "The BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", "New BSD License", 'BSD 3-Clause "New" or "Revised" License', "BSD License", "The BSD License"],
    "Zlib": ["", "zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "Unlicense": ["", "The Unlicense", "Unlicense", "The Unlicense (Unlicense)"],
}
# Where a license's terms end and its advice on applying it starts; the terms are known with and without it.
TERMS_END = [
    ("Apache-2.0", "END OF TERMS AND CONDITIONS"), ("GPL-2.0", "END OF TERMS AND CONDITIONS"), ("GPL-3.0", "END OF TERMS AND CONDITIONS"), ("LGPL-2.1", "END OF TERMS AND CONDITIONS"),
]


def known_texts() -> list[tuple[str, str]]:
    """LICENSES, under each usual heading and bare, and the terms without advice on applying them."""
    out = list(LICENSES)
    for name, body in LICENSES:
        if name in HEADINGS:
            own, *others = HEADINGS[name]
            bare = body.removeprefix(own).lstrip()
            out += [(name, bare), *((name, f"{h}\n{bare}") for h in others)]
    texts = dict(LICENSES)
    for name, end in TERMS_END:
        terms = texts[name][: texts[name].index(end)]
        out += [(name, terms), (name, terms + end)]
    return out


# One-line notices.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("All-rights-reserved", "All rights reserved."),
]


def canonical_lines(text: Column) -> Column:
    """A text in canonical form, line ends kept."""
    text = F.lower(text)
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, APART, " ")


def digest(form: Column) -> Column:
    """SHA-256 of the canonical form without copyright lines, as hex; null if nothing is left."""
    for line in (COPYRIGHT_LINE, RIGHTS_LINE):
        form = F.regexp_replace(form, line, "")
    form = F.trim(F.regexp_replace(form, r"[ \n]+", " "))
    return F.when(form != "", F.sha2(form, 256))


def catalogue(spark: SparkSession, licenses: list[tuple[str, str]]) -> DataFrame:
    """(license_id, known_digest) of license texts; of equal forms the first identifier counts."""
    known = spark.createDataFrame(licenses, "license_id string, license_text string")
    return known.select("license_id", digest(canonical_lines(F.col("license_text"))).alias("known_digest")).groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, notices: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """Add digest, license_id (of the whole text), notices (identifiers found as lines, sorted, by comma) to docs.

    known has license_id and known_digest. A null text, or one without a letter or digit, has a null digest and no
    license. A text of copyright lines alone has a null digest. Columns of docs with these names are replaced; all rows
    stay as often as they occur.
    """
    if len(notices) > MOST_NOTICES:
        raise ValueError("notices are looked up within a row; put longer lists into the catalogue")
    spark = docs.sparkSession
    line_digest = lambda line: F.sha2(F.trim(line), 256)
    labels = spark.createDataFrame(notices, "id string, line string").select("id", line_digest(canonical_lines(F.col("line"))).alias("d")).distinct().collect()  # MOST_NOTICES rows at most
    of_notice = F.create_map(*(F.lit(x) for r in sorted(labels, key=lambda r: r["d"]) for x in (r["d"], r["id"])))
    digests = F.array(*(F.lit(x) for x in sorted({r["d"] for r in labels})))
    rest = docs.drop("digest", "license_id", "notices")
    formed = rest.withColumn("__form", canonical_lines(F.col(text).cast("string")))
    lines = F.transform(F.split("__form", "\n"), line_digest)
    found = F.array_sort(F.array_distinct(F.transform(F.array_intersect(lines, digests), lambda d: F.element_at(of_notice, d))))
    read = formed.withColumns({"digest": digest(F.col("__form")), "notices": F.coalesce(F.array_join(found, ","), F.lit(""))}).drop("__form")
    if known.count() <= BROADCAST_LICENSES:
        known = F.broadcast(known)
    named = known.select(F.col("known_digest").alias("__known"), F.col("license_id"))
    return read.join(named, read["digest"] == named["__known"], "left").drop("__known").select(*rest.columns, "digest", "license_id", "notices")


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, digest, license_id, notices of every whole text.

    A null text has a null digest, no license and no notices; a null doc_id stays null, repeated rows each have a row,
    extra columns are ignored whatever their names; an empty table gives an empty result.
    """
    return scan(docs.select("doc_id", "text"), catalogue(docs.sparkSession, known_texts()), NOTICES).drop("text")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _form_sql(text: str) -> str:
    out = f"lower({text})"
    for old, new in SPELLINGS:
        old, new = ("chr(13) || chr(10)" if old == "\r\n" else "chr(13)" if old == "\r" else _sql(old)), ("chr(10)" if new == "\n" else _sql(new))
        out = f"replace({out}, {old}, {new})"
    return f"regexp_replace({out}, {_sql(APART)}, ' ', 'g')"


def _digest_sql(form: str) -> str:
    for line in (COPYRIGHT_LINE, RIGHTS_LINE):
        form = f"regexp_replace({form}, {_sql(line)}, '', 'g')"
    return f"nullif(trim(regexp_replace({form}, {_sql('[ ' + chr(92) + 'n]+')}, ' ', 'g')), '')"


def report_sql() -> str:
    """license_report in DuckDB SQL."""
    values = lambda rows: ", ".join(f"({_sql(a)}, {_sql(b)})" for a, b in rows)
    return f"""
WITH formed AS (SELECT row_number() OVER () AS n, doc_id, {_form_sql("text")} AS form FROM documents),
digested AS (SELECT n, doc_id, form, sha256({_digest_sql("form")}) AS digest FROM formed),
known AS (SELECT min(id) AS license_id, sha256({_digest_sql(_form_sql("body"))}) AS d FROM (VALUES {values(known_texts())}) AS v(id, body) GROUP BY 2),
noted AS (SELECT DISTINCT id, sha256(trim({_form_sql("line")})) AS d FROM (VALUES {values(NOTICES)}) AS v(id, line)),
lines AS (SELECT n, sha256(trim(unnest(string_split(form, chr(10))))) AS d FROM formed),
found AS (SELECT n, string_agg(id, ',' ORDER BY id) AS notices FROM (SELECT DISTINCT n, id FROM lines JOIN noted USING (d)) AS x GROUP BY n)
SELECT doc_id, digest, license_id, coalesce(notices, '') AS notices
FROM digested LEFT JOIN known ON digest = known.d LEFT JOIN found USING (n)
"""
