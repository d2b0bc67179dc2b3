"""License scans by canonical digest.

A text is brought to a canonical form: A-Z lower-cased, copyright lines
removed, punctuation and white space turned to single spaces, equivalent
spellings made alike. The SHA-256 of the whole canonical text is looked up among
the digests of known licences.

Defined results: null text counts as empty; an empty canonical text matches no
licence; repeated rows are looked up one by one; an empty table gives an empty
result; other columns are ignored. The list of licences is bounded by
MAX_LICENSES, so it is broadcast.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, text_of

MAX_LICENSES = 10_000

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Texts of licences, as published.
LICENSES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
}
#: The same below a usual title.
_TITLES = {
    "0BSD": "BSD Zero Clause License", "ISC": "ISC License", "MIT": "MIT License", "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License",
}
_SHORT = {"ISC": "The ISC License", "MIT": "The MIT License (MIT)", "BSD-2-Clause": "BSD 2-Clause \"Simplified\" License", "BSD-3-Clause": "BSD 3-Clause \"New\" or \"Revised\" License"}
LICENSES |= {f"{k}-titled": f"{t}\n\n{LICENSES[k]}" for k, t in _TITLES.items()} | {f"{k}-titled-2": f"{t}\n\n{LICENSES[k]}" for k, t in _SHORT.items()}
#: Whole texts of the long ones.
LICENSES |= {p.name.removesuffix(".txt"): p.read_text("utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def _other_than(words: list[str]) -> str:
    """A pattern of words other than these, without looking ahead, which DuckDB cannot."""
    heads = sorted({w[0] for w in words if w})
    found = [rf"[^\s,.;:{''.join(heads)}][^\s,.;:]*"] + [h + _other_than([w[1:] for w in words if w[:1] == h]) for h in heads]
    return f"(?:{'|'.join(found)})" + ("" if "" in words else "?")


#: What may follow "copyright" in a licence's own short lines.
_OWN = "notice notices holder holders owner owners law laws license licenses licence licences and or in of to is act statement ownership interest".split()
_NAME = rf"[ \t]+{_other_than(_OWN).removesuffix("?")}(?:[ \t]+[^\s,.;:]+){{0,3}}[ \t\r]*$"
#: Lines that name a holder; a line of the licence itself may begin with "copyright notice", and stays.
_COPYRIGHT = r"(?m)^[^a-z0-9\n(©]*(?:(?:copyright[ \t:,-]*(?:\(c\)|©|[0-9]|by\b|the\b)|\(c\)|©|all rights reserved)[^\n]*$|copyright" + _NAME + ")"
_PUNCT = r"[\x00-\x2f\x3a-\x60\x7b-\x7f «»‐-‟•…]+"
_PUNCT_RE2 = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\x{a0}\x{ab}\x{bb}\x{2010}-\x{201f}\x{2022}\x{2026}]+"
#: Pattern and replacement; groups are kept.
SPELLINGS = [
    (r"\b(licen)c(e|ed|es|ing|ee|or)\b", "12", "s"),
    (r"\b(fav|hon|behavi|lab)our", "1", "or"),
    (r"\b(organ|author|util|initial|recogn|custom)is(e|ed|es|ing|ation|ations)\b", "12", "iz"),
    (r"\b(sub|non) (licen|infring)", "12", ""),
    (r"\b(copyright) owner", "1", " holder"),
    (r"\b(http)s ", "1", " "),
]


def _replacement(groups: str, between: str, mark: str) -> str:
    return f"{mark}1{between}" + (f"{mark}2" if "2" in groups else "")


def canonical(text: Column) -> Column:
    out = F.regexp_replace(lower_ascii(text), _COPYRIGHT, "")
    out = F.regexp_replace(out, _PUNCT, " ")
    for pattern, groups, between in SPELLINGS:
        out = F.regexp_replace(out, pattern, _replacement(groups, between, "$"))
    return F.trim(out)


def scan(docs: DataFrame, licenses: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest, license: license is null where the whole text is none of the known ones."""
    licenses = LICENSES if licenses is None else licenses
    if len(licenses) > MAX_LICENSES:
        raise ValueError(f"more than {MAX_LICENSES} licences: {len(licenses)}")
    known = docs.sparkSession.createDataFrame(list(licenses.items()) or [(None, None)], "license string, text string")
    known = known.select("license", canonical(text_of()).alias("canon")).where("canon <> ''")
    # spellings of one licence under two names: the first by name
    known = known.groupBy(F.sha2(F.col("canon").cast("binary"), 256).alias("_digest")).agg(F.min("license").alias("license"))
    rows = docs.select("doc_id", F.sha2(canonical(text_of()).cast("binary"), 256).alias("digest"))
    return rows.join(F.broadcast(known), F.col("digest") == F.col("_digest"), "left").select("doc_id", "digest", "license")


def oracle(licenses: dict[str, str] | None = None) -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        out = f"regexp_replace(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), {q(_COPYRIGHT)}, '', 'g')"
        out = f"regexp_replace({out}, {q(_PUNCT_RE2)}, ' ', 'g')"
        for pattern, groups, between in SPELLINGS:
            out = f"regexp_replace({out}, {q(pattern)}, {q(_replacement(groups, between, chr(92)))}, 'g')"
        return f"trim({out})"

    known = ", ".join(f"({q(k)}, {q(v)})" for k, v in (LICENSES if licenses is None else licenses).items())
    return f"""WITH known AS (SELECT sha256({canon('text')}) AS k, min(license) AS license FROM (VALUES {known}) AS l(license, text)
WHERE {canon('text')} <> '' GROUP BY 1), d AS (SELECT doc_id, sha256({canon('text')}) AS digest FROM documents)
SELECT d.doc_id, d.digest, known.license FROM d LEFT JOIN known ON d.digest = known.k"""
