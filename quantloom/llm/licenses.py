"""License scans: canonical digests of whole texts, joined to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole

#: Spellings that licences use for the same word; the right one is canonical. Fixed values, from the public SPDX matching guidelines.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

#: Known licences, without their copyright lines. The published texts.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n"
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE."
)
KNOWN: dict[str, str] = {
    "MIT": f"MIT License\n\n{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_DISCLAIMER}",
    "MIT-0": f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_MIT_DISCLAIMER}",
    "ISC": f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_DISCLAIMER}",
    "0BSD": f"Zero-Clause BSD\n\n{_ISC_GRANT}.\n\n{_ISC_DISCLAIMER}",
    "BSD-2-Clause": _BSD_TWO + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD_TWO + _BSD_THIRD + _BSD_DISCLAIMER,
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "MIT-short": "Released under the MIT License.",
}

#: Spellings of more than one word, as they stand once punctuation is gone. Fixed values, from the same guidelines.
PHRASES = {" sub licens": " sublicens", " non commercial": " noncommercial", " per cent ": " percent ", " copyright owner": " copyright holder"}
#: A copyright statement in lower case, past comment signs; of words after "copyright" not holder, owner and notice, which texts speak of.
_STATEMENT = r"(copyright|copyright ([^hno\n]|h[^o\n]|n[^o\n]|o[^w\n])[^\n]*|\(c\) [^\n]*|©[^\n]*|all rights reserved[^\n]*)"
#: Comment signs in front of a line.
_COMMENT = r"(^|\n)[ \t]*(/\*+|\*+/?|//+|#+)[ \t]*"
#: Such a line with a short one that ends its paragraph; and such a line.
_TWO_LINES = r"(^|\n)[^\na-z0-9]*" + _STATEMENT + r"[ \t\r]*\n[^\n]{1,60}\n[ \t\r]*\n"
_COPYRIGHT = r"(^|\n)[^\na-z0-9]*" + _STATEMENT + r"[ \t\r]*(\n|$)"
#: Up to three lines in front that name a licence and end no sentence, before an empty line: a heading.
_HEADING = r"^\s*([^\n]{0,60}(licen[cs]e|no attribution|clause|version [0-9])([^\n]{0,40}[^\n.,:;\s])?[ \t\r]*\n[ \t\r]*){1,3}\n"
#: Characters that are neither letters nor digits part words.
_PUNCTUATION = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The text's words in lower case, one space apart, with canonical spellings, without copyright lines and without a heading."""
    low = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), _COMMENT, "$1"), _TWO_LINES, "$1\n\n"), _COPYRIGHT, "$1\n")
    low = F.regexp_replace(low, _HEADING, "")
    words = F.split(F.trim(F.regexp_replace(low, _PUNCTUATION, " ")), " ")
    same = F.create_map(*(F.lit(x) for pair in EQUIVALENT.items() for x in pair))
    out = F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(same, w), w)), " "), F.lit(" "))
    for a, b in PHRASES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def known_digests(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    """(digest, license_id), one row a digest: of licences with one canonical text, the first by name."""
    df = spark.createDataFrame(list(known.items()), "license_id string, text string")
    return df.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``docs`` with canonical_sha256 and license_id: the known licence that the whole text is, with or without a heading, or null.

    A null or empty text is the empty canonical text, whose digest matches only if ``known`` (digest, license_id) holds it; repeated
    rows get the same answer; nothing is dropped. Clashing columns are replaced. The known table is joined without a hint, so that
    Spark broadcasts it only if its size is under the session's bound.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    df = docs.drop("license_id").withColumn("canonical_sha256", F.sha2(canonical(whole(text)), 256))
    return df.join(known.select(F.col("digest").alias("canonical_sha256"), "license_id"), "canonical_sha256", "left")


def _sql_canonical(text: str) -> str:
    low = rf"regexp_replace(regexp_replace(regexp_replace(lower({text}), '{_COMMENT}', '\1', 'g'), '{_TWO_LINES}', '\1' || chr(10) || chr(10), 'g'), '{_COPYRIGHT}', '\1' || chr(10), 'g')"
    low = f"regexp_replace({low}, '{_HEADING}', '')"
    words = f"string_split(trim(regexp_replace({low}, '{_PUNCTUATION}', ' ', 'g')), ' ')"
    same = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in EQUIVALENT.items()) + "}"
    out = f"' ' || array_to_string(list_transform({words}, lambda w: coalesce({same}[w], w)), ' ') || ' '"
    for a, b in PHRASES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim({out})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = f"""
with known as (select sha256({_sql_canonical('body')}) as digest, min(id) as license_id from (values {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in KNOWN.items())}) as k(id, body) group by 1),
d as (select doc_id, sha256({_sql_canonical("coalesce(text, '')")}) as canonical_sha256 from documents)
select doc_id, canonical_sha256, license_id from d left join known on canonical_sha256 = digest
"""
