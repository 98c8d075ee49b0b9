"""Operator 1, license scans: canonical digest lookup of entire texts.

A text is put in canonical form: copyright notices at the start of lines dropped, lower case, every run of other characters than letters and
digits one separator, equivalent spellings replaced by one of them. The SHA-256 digest of the form is looked up by a hash
join among the digests of known licences, a fixed table: short texts as they are, long ones as digests. Only DataFrame functions are used.

A notice is a line that begins with "copyright" and goes on otherwise than a sentence of a licence would, with "(c)" before "copyright" or a
year, with the copyright sign, or with "all rights reserved". It reaches to the end of its line, or to the first words of a known licence in it.

Defined results: a null text has a null digest and no licence; a text without a letter or digit has the digest of the
empty form and no licence; repeated rows give repeated results; an empty table gives none. Of licences with equal
canonical forms the first id in order is given. Further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed

#: After "copyright", these words go on with a sentence of a licence; before other words it is a notice.
IN_SENTENCES = "notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|disclaimers?|infringements?|treat(?:y|ies)|protection|and|or|in|of|on|is|are|to|for"

#: Words that licence matching treats as equal.
WORDS = [
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("analogue", "analog"), ("analyse", "analyze"), ("analysed", "analyzed"), ("artefact", "artifact"), ("artefacts", "artifacts"),
    ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("defence", "defense"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("fulfils", "fulfills"), ("https", "http"), ("judgement", "judgment"),
    ("judgements", "judgments"), ("labelled", "labeled"), ("labelling", "labeling"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("offences", "offenses"), ("practise", "practice"), ("practised", "practiced"),
    ("programme", "program"), ("programmes", "programs"), ("signalling", "signaling"), ("whilst", "while"), ("wilful", "willful"), ("wilfully", "willfully"),
]
#: Stems and the endings that turn both spellings of them into words.
STEMS = [
    (["licenc", "sublicenc", "relicenc", "unlicenc"], "licenc", "licens", ["e", "es", "ed", "ing", "ee", "ees", "er", "ers", "eable", "able"]),
    (["authoris", "capitalis", "categoris", "characteris", "customis", "emphasis", "finalis", "generalis", "initialis", "localis", "maximis", "minimis", "normalis", "optimis", "organis", "realis", "recognis", "specialis", "standardis", "summaris", "synchronis", "utilis"], "is", "iz", ["e", "ed", "er", "ers", "ing", "ation", "ations", "able"]),
    (["behaviour", "colour", "endeavour", "favour", "honour", "labour"], "our", "or", ["", "s", "ed", "ing", "able", "ite", "ites", "al"]),
]


def spellings() -> list[tuple[str, str]]:
    """The words, and those that stems and endings give, each with the spelling it is replaced by."""
    made = [(stem + end, stem[: len(stem) - len(a)] + b + end) for stems, a, b, ends in STEMS for stem in stems for end in ends]
    return WORDS + made


SPELLINGS = spellings()

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_2 = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_2 = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'

_UNLICENSE = 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. ' + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + " For more information, please refer to <http://unlicense.org/>"
_BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'

#: Public licence texts and notices without their copyright lines.
TEXTS = [
    ("MIT", f"MIT License\n\n{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MIT", f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MIT-0", f"{_GRANT}. {_AS_IS}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_2}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_2}"),
    ("BSD-2-Clause", _BSD_1 + _BSD_2),
    ("BSD-3-Clause", f"{_BSD_1}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_2}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
]

#: Titles that may stand above a text.
TITLES = [
    ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"), ("MIT", "MIT License (MIT)"), ("MIT-0", "MIT No Attribution"), ("MIT-0", "MIT No Attribution License"), ("ISC", "ISC License"), ("ISC", "The ISC License"),
    ("0BSD", "BSD Zero Clause License"), ("0BSD", "Zero-Clause BSD"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", "The 2-Clause BSD License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "The 3-Clause BSD License"), ("Zlib", "zlib License"), ("Zlib", "The zlib/libpng License"), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
]

#: Each text with and without its titles. Only texts of more than one sentence have titles.
LICENSES = TEXTS + [(i, f"{title}\n\n{text}") for i, title in TITLES for j, text in TEXTS if i == j and len(text) > 600 and not text.startswith("MIT License")]

#: Fixed values: (licence, its first words, digest of the canonical form of its published text) of texts too long to stand here.
DIGESTS: list[tuple[str, str, str]] = [
    ("Apache-2.0", "Apache License Version", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Artistic-1.0-Perl", "The Artistic License", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "Creative Commons Legal", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "GNU Free Documentation", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "GNU Free Documentation", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "GNU GENERAL PUBLIC", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "GNU GENERAL PUBLIC", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "GNU GENERAL PUBLIC", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "GNU LESSER GENERAL", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "GNU LESSER GENERAL", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "Mozilla Public License", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]


def steps(licenses: list[tuple[str, str]], digests: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """Replacements that drop notices, in the common subset of both engines' expressions: first sentences that begin with "copyright" are told apart."""
    words = [re.findall(r"[^\W_]+", text.strip().split("\n")[0])[:3] for _, text in licenses] + [start.split() for _, start, _ in digests]
    starts = sorted({r"[^\p{L}\p{N}\n]+".join(w) for w in words if w}, key=lambda x: (-len(x), x))
    lead, end = r"^([ \t/#*;-]*)", rf"((?:[^\p{{L}}\p{{N}}\n](?:{'|'.join(starts)})(?:[^\p{{L}}\p{{N}}]|$))|$)"
    sentence = rf"{lead}(copyright[^\p{{L}}\p{{N}}\n]*(?:$|(?:{IN_SENTENCES})(?:[^\p{{L}}\p{{N}}]|$)))"
    notice = rf"{lead}(?:copyright[^\p{{L}}\p{{N}}\n]|\(c\)[^\n]*?(?:copyright|(?:19|20)[0-9][0-9])|©|all rights reserved)[^\n]*?{end}"
    return [(sentence, "\\1\x01\\2"), (notice, "\\1 \\2")]


def canonical(text: Column, licenses: list[tuple[str, str]] = LICENSES, digests: list[tuple[str, str, str]] = DIGESTS) -> Column:
    """The canonical form: the words with single spaces between."""
    for pattern, by in steps(licenses, digests):
        text = F.regexp_replace(text, f"(?imd){pattern}", re.sub(r"\\(\d)", r"$\1", by))
    one = F.create_map(*[F.lit(x) for pair in SPELLINGS for x in pair])
    known = [a for a, _ in SPELLINGS]
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.isin(known), F.element_at(one, w)).otherwise(w)), " ")


def known_digests(spark: SparkSession, licenses: list[tuple[str, str]] = LICENSES, digests: list[tuple[str, str, str]] = DIGESTS) -> DataFrame:
    """(canonical_sha256, license_id), one row a digest."""
    texts = spark.createDataFrame(licenses, "license_id string, text string").select("license_id", canonical(F.col("text"), licenses, digests).alias("form"))
    rows = texts.filter("form <> ''").select("license_id", F.sha2("form", 256).alias("canonical_sha256"))
    if digests:
        rows = rows.union(spark.createDataFrame([(i, d) for i, _, d in digests], "license_id string, canonical_sha256 string"))
    return rows.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, licenses: list[tuple[str, str]] = LICENSES, digests: list[tuple[str, str, str]] = DIGESTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical_sha256 and license_id (null where the entire text is no known licence) of all rows."""
    known = known_digests(docs.sparkSession, licenses, digests)
    forms = keyed(docs, id_col, text_col).select("doc_id", F.sha2(canonical(F.col("text"), licenses, digests), 256).alias("canonical_sha256"))
    return forms.join(F.broadcast(known), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id")  # the table is a fixed parameter


def _sql(text: str) -> str:
    for pattern, by in steps(LICENSES, DIGESTS):
        text = f"regexp_replace({text}, '(?im){pattern}', '{by}', 'g')"
    form = f"' ' || regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
    for a, b in SPELLINGS:
        form = f"replace({form}, ' {a} ', ' {b} ')"
    return f"trim(replace({form}, '  ', ' '), ' ')"


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in LICENSES)
    more = " UNION ALL ".join(f"SELECT '{d}', '{i}'" for i, _, d in DIGESTS)
    return f"""WITH known AS (SELECT d, min(i) AS license_id FROM (SELECT sha256({_sql('t')}) AS d, i FROM (VALUES {values}) v(i, t) WHERE {_sql('t')} <> '' UNION ALL {more}) GROUP BY 1),
forms AS (SELECT doc_id, sha256({_sql('text')}) AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id FROM forms LEFT JOIN known ON d = canonical_sha256"""


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
