"""Licence scans by canonical digest lookup.

A text is put in canonical form: lower case, without copyright lines, equivalent
spellings made one, everything but letters and digits a single space. The digest
of the whole form is looked up among those of known licences by a hash join.

A document may hold a licence among other text. A paragraph is what stands
between lines without letters and digits. Where one is the first of a known
text, the digest of as many paragraphs as that text has is looked up as well.
Lines are looked up as texts of their own, which finds notices in prose.
"""
from __future__ import annotations

import hashlib
from itertools import product

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, whole

#: A line that names who holds the rights, and when (in lower case).
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\s*(?:\(c\)|©|[<\[{])|copyright\b[^\n]*\b(?:19|20)[0-9]{2}\b|(?:\(c\)|©)\s*[0-9]{4}|all rights reserved)[^\n]*$"
OTHER = r"[^\p{L}\p{N}]+"
PARAGRAPH = r"\n[^\p{L}\p{N}\n]*\n"
#: Spellings that count as equal (fixed values), in canonical form.
EQUIVALENT = [
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("authorise", "authorize"), ("favour", "favor"), ("fulfil ", "fulfill "), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labour", "labor"), ("organisation", "organization"), ("per cent", "percent"), ("programme", "program"),
    ("recognise", "recognize"), ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"), ("https", "http"),
]

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]
#: Known whole licences (fixed values).
TEXTS = {
    "MIT": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, '
    "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included "
    'in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
    "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _WARRANTY,
    "0BSD": "BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
    "is hereby granted.\n\n" + _WARRANTY,
    "BSD-2-Clause": "BSD 2-Clause License\n\n" + "\n\n".join(_BSD[:3] + _BSD[4:]),
    "BSD-3-Clause": "BSD 3-Clause License\n\n" + "\n\n".join(_BSD),
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n"
    "0. You just DO WHAT THE FUCK YOU WANT TO.",
}
#: Known licences too long to be here (fixed values): licence, digest, digest of the first paragraph, and number of paragraphs,
#: as entry() makes them of the published texts; also without what follows, or begins with, the line END OF TERMS AND CONDITIONS.
DIGESTS = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b", "8f9a07cfc74f13faacedb4ef5f66671824f4db35b0becf50739f877003b330a7", 32),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe", "8f9a07cfc74f13faacedb4ef5f66671824f4db35b0becf50739f877003b330a7", 27),
    ("Apache-2.0", "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64", "8f9a07cfc74f13faacedb4ef5f66671824f4db35b0becf50739f877003b330a7", 26),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702", "9fed8b0e06b2229a97a10906ed7a4e4608b849d85ed54da1ada55f2d05e8d9db", 29),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "021f3f319970fcf1f6e1d478e5367d797699877f3434ad73ee1ef815fdc7cd63", 13),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b", "8d2eae4d251844e9a73f0504efb40de0122c63022a833e6e0f5caafcd8f04324", 57),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d", "f42b2e6807623175c74cf8ca228746283c01775b536214b79d00df84c9a65ffa", 67),
    ("GPL-1.0", "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6", "82397a16c2231c372bdd0ef728bd88bf794e7b7858a5ee5e95a390556acb8081", 50),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", "82397a16c2231c372bdd0ef728bd88bf794e7b7858a5ee5e95a390556acb8081", 35),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70", "82397a16c2231c372bdd0ef728bd88bf794e7b7858a5ee5e95a390556acb8081", 34),
    ("GPL-2.0", "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1", "800704d54279141c14d2b5236cc50e7ea885fc8220e3bdaa410f2b54971d7522", 59),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", "800704d54279141c14d2b5236cc50e7ea885fc8220e3bdaa410f2b54971d7522", 44),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808", "800704d54279141c14d2b5236cc50e7ea885fc8220e3bdaa410f2b54971d7522", 43),
    ("GPL-3.0", "5e06bcb7b8c914d3ffb433229937b503a624ae6c7bb9ac1cad01e35a324bcb6d", "10c3854c70c10808f2f455ff7ae311088ab9dd94c2c06693fb750f4c9e482943", 122),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", "10c3854c70c10808f2f455ff7ae311088ab9dd94c2c06693fb750f4c9e482943", 109),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191", "10c3854c70c10808f2f455ff7ae311088ab9dd94c2c06693fb750f4c9e482943", 108),
    ("LGPL-2.0", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d", "6ed1731e87010ecac4542e62634534a81feb95b467f42e6140f554e77f81aaf9", 83),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260", "6ed1731e87010ecac4542e62634534a81feb95b467f42e6140f554e77f81aaf9", 71),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2", "6ed1731e87010ecac4542e62634534a81feb95b467f42e6140f554e77f81aaf9", 70),
    ("LGPL-2.1", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f", "4de811fed3402b35cc931316356c984d20ec54d660630f4064c708984b91f51a", 85),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", "4de811fed3402b35cc931316356c984d20ec54d660630f4064c708984b91f51a", 73),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df", "4de811fed3402b35cc931316356c984d20ec54d660630f4064c708984b91f51a", 72),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "b1dddaf7ef2e30067896bb2f11cf3c9defcf11564304f448a9257f49502a9e85", 37),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6", "e8d78c7ef0b7fb5f931ba9501977c8ca266cc1ab4b95b40fea21f3a7867310ca", 73),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d", "58c9a1c62b739e4bead89c80c6af62cd77999c648016e24ba011e53180a5cc15", 83),
]
_FREE = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version.\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.\n\n"
    "You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
)
#: Standard headers of files (fixed values).
HEADERS = {
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
    "a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under "
    'the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
    "governing permissions and limitations under the License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
    f"obtain one at {scheme}://mozilla.org/MPL/2.0/." for scheme in ("http", "https")],
} | {
    key: [_FREE.format(what=what, name=name, version=version) for what in ("program", "library", "file", "software")]
    for key, name, version in (
        ("GPL-2.0", "GNU General Public License", 2), ("GPL-3.0", "GNU General Public License", 3), ("LGPL-3.0", "GNU Lesser General Public License", 3),
        ("AGPL-3.0", "GNU Affero General Public License", 3),
    )
}
#: Names under which notices refer to licences (fixed values).
NAMES = {
    "MIT": ["MIT License", "MIT"], "ISC": ["ISC License"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"], "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"], "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD License"], "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "CC0-1.0": ["CC0 1.0"], "CC-BY-4.0": ["CC BY 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0"], "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
}
_LEADS = ["", "This work is ", "This file is ", "This software is ", "This program is "]
_VERBS = ["Licensed under", "Released under", "Distributed under", "Published under", "Available under"]




def canonical_form(text: str) -> list[str]:
    """The paragraphs of a text in canonical form, those that have any."""
    found = []
    for part in regex.split(PARAGRAPH, text.lower()):
        part = regex.sub(OTHER, " ", regex.sub(COPYRIGHT, " ", part)).strip(" ")
        for a, b in EQUIVALENT:
            part = part.replace(a, b)
        found += [part] if part else []
    return found


def entry(license: str, text: str) -> tuple[str, str, str, int]:
    """The catalogue's entry for a text: licence, digest, digest of its first paragraph, and number of paragraphs (0 for what is looked up by line only)."""
    parts = canonical_form(text)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return license, digest(" ".join(parts)), digest(parts[0] if parts else ""), len(parts)


def catalogue(more: list[tuple[str, str]] = ()) -> list[tuple[str, str, str, int]]:
    """Entries of whole licences, also without their title, of headers, and of notices in all common phrasings; then of more (licence, text)."""
    found = [entry(k, t) for k, text in TEXTS.items() for t in (text, text.partition("\n")[2])] + list(DIGESTS)
    found += [entry(k, form) for k, texts in HEADERS.items() for t in texts for form in (t, t.replace("\n\n", "\n"))]
    for key, names in NAMES.items():
        notices = [f"{lead}{verb} {the}{name}." for lead, verb, the, name in product(_LEADS, _VERBS, ("", "the "), names)]
        found += [(*entry(key, t)[:3], 0) for t in [*notices, f"SPDX-License-Identifier: {key}"]]
    return sorted({e[1:]: e for e in sorted([*found, *(entry(k, t) for k, t in more)], reverse=True)}.values())


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text in canonical form, those that have any."""
    def form(part: Column) -> Column:
        out = F.trim(F.regexp_replace(F.regexp_replace(part, COPYRIGHT, " "), OTHER, " "))
        for a, b in EQUIVALENT:
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    return F.filter(F.transform(F.split(F.lower(text), PARAGRAPH), form), lambda p: p != "")


def canonical(text: Column) -> Column:
    return F.array_join(paragraphs(text), " ")


def known(spark: SparkSession, entries: list[tuple[str, str, str, int]]) -> DataFrame:
    """digest and license of the catalogue."""
    return spark.createDataFrame([(d, k) for d, k in {e[1]: e[0] for e in reversed(entries)}.items()], "digest string, license string")


def blocks(parts: Column, entries: list[tuple[str, str, str, int]]) -> Column:
    """end and digest of each run of paragraphs that begins like an entry and has as many."""
    lengths: dict[str, set[int]] = {}
    for _, _, first, n in entries:
        if n:
            lengths.setdefault(first, set()).add(n)
    table = F.create_map(*[x for k, v in sorted(lengths.items()) for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    run = lambda i, n: F.struct((i + n).alias("end"), F.sha2(F.array_join(F.slice(parts, i + 1, n), " "), 256).alias("digest"))
    found = F.transform(parts, lambda p, i: let(F.coalesce(table[F.sha2(p, 256)], F.array().cast("array<int>")), lambda ns: F.transform(F.filter(ns, lambda n: i + n <= F.size(parts)), lambda n: run(i, n))))
    return F.flatten(found)


#: Only a line with one of these words can be a known notice or text.
LIKELY = "licen|under|permission|software|redistrib|name of|copyright|terms|you just|spdx"


def scan(docs: DataFrame, more: list[tuple[str, str]] = ()) -> DataFrame:
    """doc_id, text_digest, license, n_blocks, blocks, n_notices and notices of every row of docs (doc_id, text).

    text_digest is that of the whole canonical text; license is the known
    licence that has it, or null. n_blocks counts runs of paragraphs that are known
    texts, by their last paragraph and licence, and n_notices lines that are; blocks and notices have their licences, each
    once, sorted and comma-joined (none: empty). A whole licence is a block, too.
    more: further licences and texts for the catalogue, which travels with each task.
    A null text is empty, and an empty canonical text is no licence. Repeated rows
    get equal results: their notices are counted once. Texts are read whole, however long. An empty table gives an empty
    result. Other columns are ignored.
    """
    entries = catalogue(more)
    digests = F.broadcast(known(docs.sparkSession, entries))  # of the catalogue's size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    form = let(paragraphs(F.col("text")), lambda p: F.struct(F.sha2(F.array_join(p, " "), 256).alias("text_digest"), blocks(p, entries).alias("found")))
    texts = rows.select("doc_id", "h", form.alias("form")).select("doc_id", "h", "form.*")
    lines = rows.select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("at", "text")).where(F.lower("text").rlike(LIKELY))
    lines = lines.select("doc_id", "h", F.lit("notice").alias("kind"), "at", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    runs = texts.select("doc_id", "h", F.lit("block").alias("kind"), F.explode("found").alias("x")).select("doc_id", "h", "kind", F.col("x.end").alias("at"), F.col("x.digest").alias("digest"))
    hits = lines.unionByName(runs).join(digests, "digest").select("doc_id", "h", "kind", "at", "license").distinct()
    count = lambda kind: F.count_if(F.col("kind") == kind)
    names = lambda kind: F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("license")))), ",")
    hits = hits.groupBy(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h")).agg(
        count("block").alias("n_blocks"), names("block").alias("blocks"), count("notice").alias("n_notices"), names("notice").alias("notices")
    )
    texts = texts.select("doc_id", "h", "text_digest").join(digests.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    joined = texts.join(hits, texts["doc_id"].eqNullSafe(hits["_doc_id"]) & (texts["h"] == hits["_h"]), "left")
    counts = {f"n_{k}": F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in ("blocks", "notices")}
    return joined.select("doc_id", "text_digest", "license", counts["n_blocks"], F.coalesce("blocks", F.lit("")).alias("blocks"), counts["n_notices"], F.coalesce("notices", F.lit("")).alias("notices"))


def oracle() -> str:
    """SQL for scan(). Of the catalogue it has digests only, which Python made."""
    entries = catalogue()
    values = ", ".join(f"('{k}', '{d}', '{f}', {n})" for k, d, f, n in entries)
    form = f"trim(regexp_replace(regexp_replace(x, '{COPYRIGHT}', ' ', 'g'), '{OTHER}', ' ', 'g'), ' ')"
    for a, b in EQUIVALENT:
        form = f"replace({form}, '{a}', '{b}')"
    parts = lambda text: f"list_filter(list_transform(regexp_split_to_array(lower({text}), '{PARAGRAPH}'), lambda x: {form}), lambda x: x <> '')"
    return f"""
        WITH k AS (SELECT * FROM (VALUES {values}) v(license, digest, first, n)),
        u AS (SELECT digest, min(license) AS license FROM k GROUP BY digest),
        d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
        p AS (SELECT row, doc_id, {parts('text')} AS parts FROM d),
        l AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d WHERE regexp_matches(lower(text), '{LIKELY}')),
        n AS (SELECT row, count(*) AS n_notices, array_to_string(list_sort(list_distinct(list(license))), ',') AS notices
              FROM (SELECT row, sha256(array_to_string({parts('line')}, ' ')) AS digest FROM l) JOIN u USING (digest) GROUP BY row),
        s AS (SELECT row, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, parts FROM p),
        b AS (SELECT DISTINCT s.row, s.i + k.n AS stop, k.license FROM s JOIN k ON k.first = sha256(s.part) AND k.n > 0
              WHERE k.digest = sha256(array_to_string(s.parts[s.i : s.i + k.n - 1], ' '))),
        c AS (SELECT row, count(*) AS n_blocks, array_to_string(list_sort(list_distinct(list(license))), ',') AS blocks FROM b GROUP BY row),
        w AS (SELECT row, doc_id, sha256(array_to_string(parts, ' ')) AS text_digest FROM p)
        SELECT doc_id, text_digest, license, coalesce(n_blocks, 0) AS n_blocks, coalesce(blocks, '') AS blocks, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
        FROM w LEFT JOIN u ON u.digest = text_digest LEFT JOIN n USING (row) LEFT JOIN c USING (row)
    """
