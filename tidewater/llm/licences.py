"""Licence scans by sentence rules.

Comment marks at the beginning of lines are taken away and a text is cut into sentences; each is normalised (lower case, letters and digits only, single
spaces) and looked up in a table of known licence sentences. What isn't known as a whole is looked
up line by line; known sentences that the cutting breaks are put together again before that. The
identifiers found, in their order, are matched against ordered rules: a rule names a licence by a
run of identifiers, rules of more sentences come before those they contain, and identifiers that a
rule has used are gone. Sentences about licences that nobody knows are kept in the sequence as
unknown, so a rule doesn't reach over them. Everything is worked out inside the row: nothing is
shuffled, and only texts that hold one of the telling stems are cut at all.

Defined cases: null and empty texts have no sentences; null and repeated ids are rows like others; an
empty table gives an empty result; columns besides id and text aren't read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences of licences and of references to them, as published, by identifier.
SENTENCES = {
    "mit-ref": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "Distributed under the MIT License.", "This software is released under the MIT License."],
    "mit-title": ["The MIT License (MIT)", "The MIT License", "MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-name": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-ref": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "apache-ref": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Released under the Apache License, Version 2.0.", "This project is licensed under the Apache License, Version 2.0."],
    "apache-use": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache-url": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-warranty": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl3-ref": ["This work is licensed under the GNU General Public License, version 3.", "This program is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License v3.0."],
    "gpl2-ref": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "gpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "lgpl-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "agpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3-ref": ["Licensed under the GNU Affero General Public License, version 3.", "This program is licensed under the GNU Affero General Public License, version 3."],
    "agpl-see": ["See the GNU Affero General Public License for more details."],
    "epl2-ref": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License 2.0."],
    "bsl-ref": ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License, Version 1.0."],
    "zlib-use": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "wtfpl-ref": ["Licensed under the WTFPL, Version 2.", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-see": ["See the GNU General Public License for more details."],
    "mpl-ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "cc-by-ref": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-ref": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-ref": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd-ref": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc0-ref": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "reserved": ["All rights reserved."],
}
#: Licences by the run of sentence identifiers that tells them, the longer runs first.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD", ["bsd-ref"]),
    ("Apache-2.0", ["apache-ref", "apache-use", "apache-copy", "apache-url", "apache-warranty", "apache-see"]),
    ("Apache-2.0", ["apache-ref", "apache-use", "apache-copy", "apache-warranty", "apache-see"]),
    ("Apache-2.0", ["apache-ref", "apache-use"]),
    ("Apache-2.0", ["apache-ref"]),
    ("AGPL-3.0-or-later", ["agpl3-later", "gpl-warranty", "agpl-see"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("AGPL-3.0-only", ["agpl3-ref"]),
    ("EPL-2.0", ["epl2-ref"]),
    ("BSL-1.0", ["bsl-ref"]),
    ("Zlib", ["zlib-use"]),
    ("WTFPL", ["wtfpl-ref"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-warranty", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-warranty", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("LGPL-2.1-or-later", ["lgpl-later"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("GPL-2.0-only", ["gpl2-ref"]),
    ("MPL-2.0", ["mpl-ref", "mpl-copy"]),
    ("MPL-2.0", ["mpl-ref"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("Unlicense", ["unlicense"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-ref"]),
]
#: Every known sentence holds one of the stems; a sentence with one of the others that isn't known is unknown.
STEMS = "licen[sc]e|permission|redistribut|warrant|liability|copyright|public domain|all rights reserved|neither the name|a copy of the"
#: Comment marks at the beginning of a line, which are taken away.
MARKS = "(?m)^[ \t]*(?:#+|//+|[*]+|;+|--+|%+)[ \t]*"
TELLING = "licen[sc]ed? |licen[sc]e$"


def normal(text: str) -> str:
    """A sentence as it is looked up."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def known() -> dict[str, str]:
    """Identifier of each normalised sentence."""
    made = {}
    for name, texts in SENTENCES.items():
        for t in texts:
            if not re.search(STEMS, normal(t)):
                raise ValueError(f"no stem in {t!r}")
            made[normal(t)] = name
    return made


def _broken() -> list[tuple[str, str]]:
    """(pattern, replacement) of each known sentence that the cutting breaks: it becomes one part of its own.

    Like a sentence that isn't broken, it has to begin and end with a part or a line.
    """
    made = []
    for text in (t for texts in SENTENCES.values() for t in texts):
        parts = [normal(p).split(" ") for p in re.split("(?<=[.!?:;])[ \t\r\n]+", text)]
        if len(parts) > 1:
            inner = "[^A-Za-z0-9]+".join("(" + "[^A-Za-z0-9\u0001]+".join(p) + ")" for p in parts)
            # the end of a part keeps its mark for what follows
            made.append((f"(?i)(?:^|[\u0001\n])[^A-Za-z0-9\u0001\n]*+{inner}[^A-Za-z0-9\u0001\n]*+(?:(?=\u0001)|\n|\\z)", "\u0001" + " ".join(f"${k + 1}" for k in range(len(parts))) + "\u0001"))
    return made


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licences, sentences, n_known, n_unknown) of every row: both lists are joined by commas."""
    table = F.create_map(*(F.lit(x) for pair in sorted(known().items()) for x in pair))

    def look(text: Column) -> Column:
        """The identifier, "unknown" or null."""
        key = _normal(text)
        return F.when(F.rlike(key, F.lit(STEMS)), F.coalesce(F.element_at(table, key), F.when(F.rlike(key, F.lit(TELLING)), "unknown")))

    def each(sentence: Column) -> Column:
        whole = look(sentence)
        lines = F.filter(F.transform(F.split(sentence, "\n"), look), lambda v: v.isNotNull())
        return F.when(~F.rlike(F.lower(sentence), F.lit(STEMS.replace(" ", "[^a-z0-9]+"))), F.array().cast("array<string>")).when(
            whole.isNotNull() & (whole != "unknown"), F.array(whole)).otherwise(lines)

    text = F.col(text_col)
    ends = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, MARKS, ""), "([.!?:;])[ \t\r\n]+", "$1\u0001"), "\n[ \t\r]*\n[ \t\r\n]*", "\u0001")
    for pattern, whole in _broken():
        ends = F.regexp_replace(ends, pattern, whole)
    found = F.flatten(F.transform(F.split(ends, "\u0001"), each))
    found = F.when(F.rlike(F.lower(text), F.lit(STEMS.replace(" ", "[^a-z0-9]+"))), found).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).alias("doc_id"), found.alias("ids"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in run)).alias("run")) for name, run in RULES))
    left = F.concat(F.lit(""), F.array_join(F.transform("ids", lambda v: F.concat(F.lit("<"), v, F.lit(">"))), ""))
    start = F.struct(left.alias("left"), F.array().cast("array<string>").alias("names"))
    matched = F.aggregate(rules, start, lambda a, r: F.when(
        F.contains(a["left"], r["run"]),
        F.struct(F.replace(a["left"], r["run"], F.lit("|")).alias("left"), F.array_union(a["names"], F.array(r["name"])).alias("names"))).otherwise(a))
    names = F.when(F.size("ids") > 0, matched["names"]).otherwise(F.array().cast("array<string>"))
    unknown = F.size(F.filter("ids", lambda v: v == "unknown"))
    return rows.select(
        "doc_id", F.array_join(names, ",").alias("licences"), F.array_join("ids", ",").alias("sentences"),
        (F.size("ids") - unknown).cast("int").alias("n_known"), unknown.cast("int").alias("n_unknown"))
