"""Licence scans by canonical digests, in DataFrame functions alone.

A text is made canonical (case, punctuation, white space, equivalent spellings; lines of copyright notices are
left out) and its digest is joined with the digests of known licences, which went through the same expressions.
Entire documents are looked up, and so is each of their lines, since a notice often is one line of a page. A line
can only equal a known text of the same canonical length, so lines of other lengths are not digested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Wordings of licences and of notices that name them, as published.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """BSD 2-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """BSD 3-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("0BSD", """BSD Zero Clause License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
)
# Whole texts are known with and without their first line where that is a title.
KNOWN += tuple((name, text.split("\n\n", 1)[1]) for name, text in KNOWN if "\n\n" in text and len(text.split("\n\n", 1)[0]) < 60)
#: Spellings that count as the same; they apply to canonical text, one after the other.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"), ("organisation", "organization"), ("authorisation", "authorization"), ("favour", "favor"),
    ("behaviour", "behavior"), ("whilst", "while"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("http ", "https "),
    ("version ", "v "), ("v. ", "v "), ("gnu gpl", "gnu general public license"),
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = ".,;:!?\"'`()[]{}<>*_/\\|-–—“”‘’«»#~=+&%$@^"
NOTICE = r"^[^A-Za-z0-9]*(copyright|©|\(c\))([^A-Za-z]|$)"


def canonical(text: Column) -> Column:
    """One line, without case, punctuation, and differences of white space or spelling; '&' stands for 'and'."""
    out = F.translate(F.replace(text, F.lit("&"), F.lit(" and ")), _UPPER + _MARKS, _UPPER.lower() + " " * len(_MARKS))
    return respelled(F.trim(F.regexp_replace(out, r"[ \t\n\x0b\f\r]+", " ")))


def respelled(out: Column) -> Column:
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def body(text: Column) -> Column:
    """The lines of a text that are no copyright notices."""
    return F.filter(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("\n")), "\n", -1), lambda line: ~F.rlike(F.translate(line, _UPPER, _UPPER.lower()), F.lit(NOTICE)))


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(digest, size, license): one row per digest, whose licences are joined by a comma when several share it."""
    table = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in texts])
    rows = spark.range(1).select(F.explode(table).alias("z")).select("z.license", F.transform(body(F.col("z.text")), canonical).alias("l"))
    rows = rows.select("license", respelled(F.trim(F.regexp_replace(F.array_join("l", " "), " +", " "))).alias("c"))
    return rows.groupBy(F.sha2(F.col("c"), 256).alias("digest"), F.length("c").alias("size")).agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("license"))


def scan(df: DataFrame, id: str = "doc_id", text: str = "text", texts: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """One row for each input row: doc_id, text_digest, text_license (the licence that the entire text is, or null),
    line_licenses (sorted, joined by commas, '' without any), n_notices (lines that are a known text).

    Null and empty texts have the digest of the empty text and no licence. Rows repeated under one id each get
    their own. The known texts are a list in the code and bounded by it, so their digests are broadcast.
    """
    names = known(df.sparkSession, texts) if texts else df.sparkSession.sql("select '' as digest, 0 as size, '' as license where false")
    digests = {r.digest: (r.size, r.license) for r in names.collect()}  # as many as known texts
    sizes = sorted({n for n, _ in digests.values()})
    lines = F.transform(body(F.col(text)), canonical)
    rows = df.select(F.col(id).alias("doc_id"), lines.alias("__lines"))
    found = F.array().cast("array<string>")
    if digests:
        lookup = F.create_map(*[F.lit(x) for d, (_, name) in sorted(digests.items()) for x in (d, name)])
        fits = F.filter("__lines", lambda line: F.length(line).isin(sizes))
        found = F.filter(F.transform(fits, lambda line: F.try_element_at(lookup, F.sha2(line, 256))), lambda x: x.isNotNull())
    rows = rows.select("doc_id", F.sha2(respelled(F.trim(F.regexp_replace(F.array_join("__lines", " "), " +", " "))), 256).alias("text_digest"), found.alias("__found"))
    rows = rows.join(F.broadcast(names.select(F.col("digest").alias("text_digest"), F.col("license").alias("text_license"))), "text_digest", "left")
    each = F.array_sort(F.array_distinct(F.split(F.array_join("__found", ","), ",")))
    return rows.select("doc_id", "text_digest", "text_license", F.array_join(each, ",").alias("line_licenses"), F.size("__found").cast("long").alias("n_notices"))


def sql(texts: tuple[tuple[str, str], ...] = KNOWN, table: str = "documents") -> str:
    """scan() over the table, in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def spell(x: str) -> str:
        for a, b in SPELLINGS:
            x = f"replace({x}, {quoted(a)}, {quoted(b)})"
        return x

    def canon(x: str) -> str:
        x = f"translate(replace({x}, '&', ' and '), {quoted(_UPPER + _MARKS)}, {quoted(_UPPER.lower() + ' ' * len(_MARKS))})"
        return spell(f"trim(regexp_replace({x}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))")

    def lines(x: str) -> str:
        low = f"translate(l, '{_UPPER}', '{_UPPER.lower()}')"
        return f"list_transform(list_filter(string_split(replace(coalesce({x}, ''), chr(13), chr(10)), chr(10)), lambda l: not regexp_matches({low}, {quoted(NOTICE)})), lambda l: {canon('l')})"

    joined = spell("trim(regexp_replace(array_to_string(ls, ' '), ' +', ' ', 'g'))")
    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in texts)
    return f"""
with given(license, body) as (values {values}),
wording as (select license, ls, {joined} as c from (select license, {lines('body')} as ls from given)),
names as (select sha256(c) as digest, string_agg(distinct license, ',' order by license) as license from wording group by c),
rows as (select doc_id, ls, sha256({joined}) as text_digest, row_number() over () as r from (select doc_id, {lines('text')} as ls from {table})),
hits as (select r, n.license from (select r, unnest(ls) as l from rows) e join names n on n.digest = sha256(e.l)),
marks as (select r, count(*) as n_notices, string_agg(distinct license, ',' order by license) as line_licenses from hits group by r)
select doc_id, text_digest, n.license as text_license, coalesce(line_licenses, '') as line_licenses, coalesce(n_notices, 0)::bigint as n_notices
from rows left join names n on n.digest = text_digest left join marks using (r)"""
