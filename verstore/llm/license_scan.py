"""Operator 5, license scans: canonical digests of entire texts.

A text is put into canonical form, digested with SHA-256 and looked up among
the digests of known license texts by a hash join.  Canonical: lower case
(A-Z), without copyright lines, without the marks and numbers that begin a
list's lines, words separated by one space whatever stood between them
(punctuation of any script, quotes, dashes, bullets, no-break spaces), and of
equivalent spellings one.  DataFrame functions only.

Known are the texts in KNOWN and, by their digests alone, the long ones in
DIGESTS; ``digests_of`` makes such digests of any files.

Defined cases: null texts have the digest of the empty text and no license; a
text of copyright lines alone is empty and has none; a text of any length is
digested whole; null doc_ids, repeated rows and further columns change
nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words and phrases that count as equal, applied in this order.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("artefacts", "artifacts"), ("authorise", "authorize"), ("authorised", "authorized"), ("authorisation", "authorization"),
    ("catalogue", "catalog"), ("centre", "center"), ("colour", "color"), ("favour", "favor"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("honour", "honor"), ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"),
    ("licenced", "licensed"), ("modelled", "modeled"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organisations", "organizations"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("recognised", "recognized"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
    ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("sub license", "sublicense"), ("sub licensed", "sublicensed"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
)
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START = r"(^|\n)[ \t*#/;%!-]*"
#: A line that names a right holder: the word, then a year, a sign or a name; all rights reserved.
COPYRIGHT_LINE = _START + r"((copyright|Copyright|COPYRIGHT)[ \t:]+(\([cC]\)|©|[0-9]|\[|<|\{)|Copyright[ \t]+[A-Z][a-z]|\([cC]\)[ \t]+[0-9]|©|[Aa]ll [Rr]ights [Rr]eserved|ALL RIGHTS RESERVED)[^\n]*"
#: What begins a line of a list.
LIST_MARK = _START + r"(\(?([0-9][0-9]?|[a-z]|[ivx][ivx]+)[.)]|[•▪◦●·])[ \t]+"
#: All but digits and letters (Latin letters without marks, from U+00C0 on those that aren't in blocks of punctuation and symbols).
PUNCTUATION = "[^0-9a-z\u00c0-\u1fff\u2c00-\u2dff\u3040-\ud7ff\uf900-\ufefe\uff10-\U0010ffff]+"

_WARRANTY = 'the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.'
_BSD_END = 'this software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.'
_BSD_START = "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1 = "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_ISC = "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = 'the software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.'
_MIT = 'permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. '

#: Known texts (public license texts, without copyright lines).
KNOWN = {
    "MIT": _MIT + _WARRANTY,
    "MIT (titled)": "mit license\n" + _MIT + _WARRANTY,
    "ISC": _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END,
    "ISC (titled)": "isc license\n" + _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END,
    "0BSD": _ISC + ". " + _ISC_END,
    "BSD-1-Clause": _BSD_START + _BSD_1 + _BSD_END,
    "BSD-2-Clause": _BSD_START + _BSD_1 + _BSD_2 + _BSD_END,
    "BSD-3-Clause": _BSD_START + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_END,
    "Zlib": "this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: the origin of this software must not be misrepresented; you must not claim that you wrote the original software. if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. this notice may not be removed or altered from any source distribution.",
    "MIT-0": _MIT.split(", subject to")[0] + ". " + _WARRANTY,
    "Unlicense": "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY.replace("authors or copyright holders", "authors") + " for more information, please refer to <http://unlicense.org/>",
    "BSL-1.0": 'boost software license - version 1.0 - august 17th, 2003 permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "software") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following: the copyright notices in the software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the software, in whole or in part, and all derivative works of the software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose, title and non-infringement. in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability, whether in contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.',
    "Unlicense (short)": "this is free and unencumbered software released into the public domain.",
    "Apache-2.0 (notice)": 'licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license.',
    "Apache-2.0 (line)": "licensed under the apache license, version 2.0.",
    "GPL-3.0 (line)": "this work is licensed under the gnu general public license, version 3.",
    "MIT (line)": "released under the mit license.",
    "CC-BY-NC-4.0 (line)": "licensed under cc by-nc 4.0.",
}


#: SHA-256 of the canonical form of long public texts, as a common system keeps them.
DIGESTS = {
    "Apache-2.0": "f213b407df637bc294997de205aecfc82e06a5e4ef6d75893ec348ca26dd13c2",
    "Artistic-1.0-Perl": "b1a9ec4dc608aa9f60e07ac63787b043bbaf8d6102bb31211bc28b37db53d680",
    "CC0-1.0": "39d45f9c62b038145006a228a201a41f601ba17dc8b3133443fa291466ba1913",
    "GFDL-1.2": "11b443626816c538e555b7fb60eaba9f2a83a9ecb67ad4a1663e07c118b8e550",
    "GFDL-1.3": "cc84a6c6a2b84e8cde0619ed37d987e1a9b39e53ddcaf34f4735e2138dfe6e4a",
    "GPL-1.0": "ac910954c3184907f3947de0193b0169b8c69656ff2de7f3330438f6ba4fb746",
    "GPL-2.0": "2e8e378a3d24393c0f3fd1439ffbe84e750886c09715e622426a6a0e54fa1bee",
    "GPL-3.0": "3695e90f7fe4b461853cec533de5675ab2b6b1fcafcb504d6c64ded76f675d64",
    "LGPL-2.0": "4a1b1cb15d45262f049457ae26945909d0e5af93e2e3fb5de82c9f72ac6bebe2",
    "LGPL-2.1": "f2755dc4b609b314faab32d30ca6d0466b60adc931cece2ea4f0b61f483bfc98",
    "LGPL-3.0": "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",
    "MPL-1.1": "a1ea0c4b634aa7b4256d56525c941092a1facf7d3e96c4ecb68ba71bc6744f7d",
    "MPL-2.0": "8dce888cb942d93cebeb8e0fea8afac43e084f54254ac4d9b99cfde68a62468b",
}


def canonical(text: Column) -> Column:
    whole = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, "\n"), "\r", "")
    low = F.regexp_replace(F.translate(whole, CAPITALS, SMALL), LIST_MARK, "\n")
    # each word with spaces of its own, so that neighbours are replaced too
    plain = F.concat(F.lit(" "), F.regexp_replace(low, PUNCTUATION, "  "), F.lit(" "))
    for a, b in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {a} ".replace(" ", "  ")[1:-1]), F.lit(f" {b} ".replace(" ", "  ")[1:-1]))
    return F.btrim(F.replace(plain, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def digests_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file and digest of license texts, one a file."""
    files = spark.read.text(paths, wholetext=True)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), digest(F.col("value")).alias("digest"))


def digests(spark: SparkSession, known: dict[str, str] = KNOWN, long: dict[str, str] = DIGESTS) -> DataFrame:
    rows = spark.createDataFrame(sorted(known.items()), "license_id string, known_text string").select("license_id", digest(F.col("known_text")).alias("digest"))
    if long:
        rows = rows.unionAll(spark.createDataFrame(sorted(long.items()), "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: dict[str, str] = KNOWN, long: dict[str, str] = DIGESTS) -> DataFrame:
    """doc_id, digest and license_id (null: none known) of every whole text."""
    own = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    # a broadcast of len(known) + len(long) rows
    return own.join(F.broadcast(digests(docs.sparkSession, known, long)), "digest", "left").select("doc_id", "digest", "license_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def canonical_sql(x: str) -> str:
    x = f"regexp_replace(regexp_replace(coalesce({x}, ''), '{COPYRIGHT_LINE}', chr(10), 'g'), chr(13), '', 'g')"
    x = f"regexp_replace(translate({x}, '{CAPITALS}', '{SMALL}'), '{LIST_MARK}', chr(10), 'g')"
    x = f"' ' || regexp_replace({x}, '{PUNCTUATION}', '  ', 'g') || ' '"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{f' {a} '.replace(' ', '  ')[1:-1]}', '{f' {b} '.replace(' ', '  ')[1:-1]}')"
    return f"trim(replace({x}, '  ', ' '))"


def oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(KNOWN.items()))
    long = ", ".join(f"('{k}', '{v}')" for k, v in sorted(DIGESTS.items()))
    return (
        f"WITH every AS (SELECT license_id, sha256({canonical_sql('known_text')}) AS digest FROM (VALUES {rows}) AS t(license_id, known_text) UNION ALL SELECT * FROM (VALUES {long}) AS l(license_id, digest)), "
        f"known AS (SELECT digest, min(license_id) AS license_id FROM every GROUP BY digest), own AS (SELECT doc_id, sha256({canonical_sql('text')}) AS digest FROM documents) "
        "SELECT doc_id, own.digest AS digest, license_id FROM own LEFT JOIN known ON own.digest = known.digest"
    )
