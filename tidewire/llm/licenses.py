"""License scans by sentence rules, with DataFrame functions only.

Texts are cut into fragments: at line ends and after , ; : softly, at blank lines and after . ! ? hard, but for a single letter with its dot. A known licence
sentence is a run of fragments, of which only the last may end hard, so wrapped lines, comment marks and what follows a
comma do not hide it; at each place the longest counts. The identifiers found, in order, are matched against ordered licence
rules, and a rule uses up what it matches. Everything happens within the row: no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import wrapped

#: Fragments in a run at most: no known sentence has more words.
MOST_FRAGMENTS = 96
#: Known licence sentences by identifier.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-short": "Licensed under the BSD 3-Clause License.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "mpl-grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense-grant": "This is free and unencumbered software released into the public domain.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "This work is dedicated to the public domain under CC0 1.0.",
    "all-rights": "All rights reserved.",
    "apache-header": "Apache License Version 2.0, January 2004",
    "apache-under": "This file is licensed to you under the Apache License, Version 2.0.",
    "mit-title": "The MIT License (MIT)",
    "mit-file": "This project is licensed under the MIT License.",
    "mit-free": "MIT Licensed.",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-names-org": "Neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd2-short": "Licensed under the BSD 2-Clause License.",
    "lgpl21-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl2-short": "This work is licensed under the GNU General Public License, version 2.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "epl2-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "bsl-grant": "Distributed under the Boost Software License, Version 1.0.",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0.",
    "proprietary-confidential": "Proprietary and confidential.",
    "unauthorized-copying": "Unauthorized copying of this file, via any medium is strictly prohibited.",
}
#: Rules in the order in which they are tried; a licence is found where the sentences of one of its rules follow
#: one another, others between them or not. What a rule matches, later rules do not see.
RULES = {
    "Apache-2.0": [["apache-grant", "apache-copy", "apache-warranty"], ["apache-grant", "apache-warranty"], ["apache-grant", "apache-copy"], ["apache-short"], ["apache-under"], ["apache-header"]],
    "MIT": [["mit-grant", "mit-notice", "mit-warranty"], ["mit-grant", "mit-notice"], ["mit-short"], ["mit-licensed"], ["mit-file"], ["mit-free"], ["mit-title"]],
    "BSD-4-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names-org"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names-org"], ["bsd-short"], ["bsd-style"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"], ["bsd2-short"]],
    "AGPL-3.0": [["agpl3-grant"]],
    "LGPL-3.0": [["lgpl3-grant"]],
    "LGPL-2.1": [["lgpl21-grant"]],
    "GPL-3.0": [["gpl-grant", "gpl-hope"], ["gpl-grant"], ["gpl3-short"], ["gpl3-title"]],
    "GPL-2.0": [["gpl2-grant", "gpl-hope"], ["gpl2-grant"], ["gpl2-only"], ["gpl2-short"], ["gpl2-title"]],
    "MPL-2.0": [["mpl-grant", "mpl-copy"], ["mpl-grant"]],
    "EPL-2.0": [["epl2-grant"]],
    "ISC": [["isc-grant"]],
    "Zlib": [["zlib-grant", "zlib-origin"], ["zlib-grant"]],
    "BSL-1.0": [["bsl-grant"]],
    "WTFPL": [["wtfpl-title"]],
    "Unlicense": [["unlicense-grant", "unlicense-anyone"], ["unlicense-grant"]],
    "CC-BY-NC-ND-4.0": [["cc-by-nc-nd"]],
    "CC-BY-NC-SA-4.0": [["cc-by-nc-sa"]],
    "CC-BY-NC-4.0": [["cc-by-nc"], ["cc-by-nc-work"]],
    "CC-BY-SA-4.0": [["cc-by-sa"], ["cc-by-sa-work"]],
    "CC-BY-ND-4.0": [["cc-by-nd"]],
    "CC-BY-4.0": [["cc-by"], ["cc-by-work"]],
    "CC0-1.0": [["cc0"]],
    "Proprietary": [["unauthorized-copying"], ["proprietary-confidential"]],
}
#: A sentence that many licences hold too; alone it reserves all rights.
RESERVED, RESERVED_NAME = "all-rights", "Proprietary"


def normal(sentence: str) -> str:
    """ASCII lower case; each run of other than ASCII letters and digits is one blank."""
    lowered = "".join(c.lower() if c < "\x80" else c for c in sentence)
    return re.sub(r"[^a-z0-9]+", " ", lowered).strip()


KNOWN = {normal(s): i for i, s in SENTENCES.items()}
#: The first two words of each known sentence, and the first, in case a line ends there.
HEADS = sorted({" ".join(n.split(" ")[:k]) for n in KNOWN for k in (1, 2)})
SOFT, HARD = "\x01", "\x02"


def fragments(text: Column) -> Column:
    """Normalised fragments in order; HARD stands behind one that ends hard."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ended = F.regexp_replace(F.regexp_replace(lowered, r"(?:(?<!(?<![a-z0-9])[a-z])\.|[!?])[\"')\]]*(?:[ \t\r]+|(?=\n)|$)|\n[^a-z0-9\n]*(?=\n)", HARD), r"[,;:][\"')]*[ \t]", SOFT)
    plain = F.regexp_replace(F.replace(F.replace(ended, F.lit("\n"), F.lit(SOFT)), F.lit(HARD), F.lit(HARD + SOFT)), rf"[^a-z0-9{SOFT}{HARD}]+", " ")
    return F.filter(F.transform(F.split(plain, SOFT), lambda x: F.trim(x)), lambda x: x != "")


def identifiers() -> Column:
    """The identifiers of the known sentences among ``fragments``, in order: at each fragment the longest known sentence that begins there."""
    ids = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    bare = lambda x: F.rtrim(F.translate(x, HARD, ""))

    def longest(x: Column) -> Column:
        run = F.slice("fragments", x["at"] + 1, F.least(F.size("fragments") - x["at"], F.lit(MOST_FRAGMENTS)))
        start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"), F.lit(None).cast("string").alias("id"))

        def step(done: Column, f: Column) -> Column:
            said = F.when(done["open"], F.ltrim(F.concat_ws(" ", done["text"], F.nullif(bare(f), F.lit(""))))).otherwise(done["text"])
            found = F.when(done["open"], F.try_element_at(ids, said))
            return F.struct(said.alias("text"), (done["open"] & ~f.contains(HARD)).alias("open"), F.coalesce(found, done["id"]).alias("id"))

        return F.aggregate(run, start, step, lambda done: done["id"])

    heads = F.filter(F.transform("fragments", lambda f, i: F.struct(i.alias("at"), bare(f).alias("said"))), lambda x: F.substring_index(x["said"], " ", 2).isin(*HEADS))
    return F.filter(F.transform(heads, longest), lambda x: x.isNotNull())


def pattern(rule: list[str]) -> str:
    """What a rule's identifiers look like among those of a text, each between semicolons; what lies between is caught."""
    return "(.*?)".join(f";{x};" for x in rule)


def between(rule: list[str]) -> str:
    return "".join(f"${k}" for k in range(1, len(rule)))


def named(row: Column) -> Column:
    """The licences of a row of identifiers (each between semicolons), in the order of RULES."""
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(pattern(r)).alias("pattern"), F.lit(between(r)).alias("rest")) for name, rules in RULES.items() for r in rules))
    start = F.struct(row.alias("row"), F.array().cast("array<string>").alias("names"))

    def step(done: Column, rule: Column) -> Column:
        hit = F.regexp_like(done["row"], rule["pattern"])
        names = F.when(hit, F.array_union(done["names"], F.array(rule["name"]))).otherwise(done["names"])
        return F.struct(F.when(hit, F.regexp_replace(done["row"], rule["pattern"], rule["rest"])).otherwise(done["row"]).alias("row"), names.alias("names"))

    alone = lambda done: F.when((F.size(done["names"]) == 0) & done["row"].contains(f";{RESERVED};"), F.array(F.lit(RESERVED_NAME))).otherwise(done["names"])
    return F.aggregate(rules, start, step, alone)


def scanned(documents: DataFrame) -> DataFrame:
    """All rows and columns, and ``found``, a struct of sentence_ids and licenses, arrays of strings; it takes another name where a column has this one.

    Null and empty texts have neither. A licence is named once, in the order of RULES. Repeated rows are scanned each; very
    long texts are scanned whole; an empty table gives no rows.
    """
    name = "found"
    while name in documents.columns:
        name = f"_{name}"
    known = wrapped(documents, "text").withColumn("fragments", fragments(F.col("text"))).withColumn("ids", F.coalesce(identifiers(), F.array().cast("array<string>")))
    row = F.concat(F.lit(";"), F.array_join("ids", ";;"), F.lit(";"))
    licenses = F.when(F.size("ids") > 0, named(row)).otherwise(F.array().cast("array<string>"))
    told = known.withColumn("found", F.struct(F.col("ids").alias("sentence_ids"), licenses.alias("licenses")))
    return told.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in documents.columns), F.col("found").alias(name))


def license_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_known (licence sentences), sentence_ids and licenses (joined by commas) of each document row."""
    found = scanned(documents.select("doc_id", "text"))
    return found.select("doc_id", F.size("found.sentence_ids").cast("long").alias("n_known"), F.array_join("found.sentence_ids", ",").alias("sentence_ids"), F.array_join("found.licenses", ",").alias("licenses"))
