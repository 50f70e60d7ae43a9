"""License scans by sentence rules: known sentences become identifiers, and ordered rules match identifier sequences. DataFrame functions only."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Standard texts and notices of public licences, by rule: (rule, licence, text). Sentences come from them by the
# same cuts that documents get; a rule is the sequence of its text's sentences.
NOTICES = [
    ("mit-text", "MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit-0-text", "MIT-0", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc-text", "ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("isc-text-and", "ISC", """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("0bsd-text", "0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""),
    ("bsd-2-clause", "BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd-3-clause", "BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("bsd-3-clause-university", "BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("bsd-disclaimer", "BSD", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("apache-2.0-notice", "Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("apache-2.0-asf", "Apache-2.0", """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-3.0-notice", "GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("gpl-3.0-only-notice", "GPL-3.0-only", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."""),
    ("gpl-2.0-notice", "GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("gpl-2.0-notice-comma", "GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."""),
    ("gpl-2.0-only-notice", "GPL-2.0-only", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."""),
    ("lgpl-2.1-notice", "LGPL-2.1-or-later", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("lgpl-2.0-notice", "LGPL-2.0-or-later", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("lgpl-3.0-notice", "LGPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("lgpl-3.0-library", "LGPL-3.0-or-later", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("lgpl-3.0-library-2", "LGPL-3.0-or-later", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."""),
    ("agpl-3.0-notice", "AGPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("mpl-2.0-notice", "MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("mpl-2.0-notice-http", "MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("mpl-2.0-subject", "MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."""),
    ("epl-2.0-notice", "EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("unlicense-text", "Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("unlicense-line", "Unlicense", """This is free and unencumbered software released into the public domain."""),
    ("zlib-text", "Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("bsl-1.0-notice", "BSL-1.0", """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"""),
    ("wtfpl-text", "WTFPL", """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."""),
    ("cc0-1.0-notice", "CC0-1.0", """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."""),
    ("postgresql-text", "PostgreSQL", """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."""),
    ("ofl-1.1-notice", "OFL-1.1", """This Font Software is licensed under the SIL Open Font License, Version 1.1."""),
    ("mit-title", "MIT", "The MIT License (MIT)"),
]
# SPDX identifiers with the names that one-sentence statements use.
NAMES = [
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache License v2.0"]),
    ("MIT", ["MIT License", "MIT license terms", "MIT"]),
    ("ISC", ["ISC License", "ISC"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"]),
    ("GPL-2.0-only", ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License v2", "GPLv2", "GNU GPLv2", "GPL-2.0"]),
    ("GPL-3.0-only", ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License v3", "GPLv3", "GNU GPLv3", "GPL-3.0"]),
    ("LGPL-2.1-only", ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL-2.1"]),
    ("LGPL-3.0-only", ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL-3.0"]),
    ("AGPL-3.0-only", ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL-3.0"]),
    ("MPL-2.0", ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"]),
    ("EPL-2.0", ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL 2.0"]),
    ("EUPL-1.2", ["European Union Public Licence, version 1.2", "EUPL v1.2"]),
    ("BSL-1.0", ["Boost Software License, Version 1.0", "Boost Software License 1.0"]),
    ("Artistic-2.0", ["Artistic License 2.0", "Artistic License, version 2.0"]),
    ("OFL-1.1", ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"]),
    ("Unlicense", ["Unlicense"]),
    ("Zlib", ["zlib License", "zlib/libpng License"]),
    ("WTFPL", ["WTFPL", "Do What The F*ck You Want To Public License"]),
    ("PostgreSQL", ["PostgreSQL License"]),
    ("CC0-1.0", ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"]),
]
# Titles of whole licence texts.
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"), ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("Apache-2.0", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"),
    ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
# Terms of the Creative Commons licences, short and in words; versions.
TERMS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Marks of comments at the start of a line, shortened words whose dot ends nothing, a tag whose colon ends nothing, where
# sentences end, what is left of them, how statements begin, and what every text with a known sentence holds. Patterns mean the same to Java, RE2 and Python.
COMMENT = r"(^|\n)[ \t]*(?:/\*+!?|\*+/?|//+!?|#+!?|--+|;+|%+|>+|<!--+|\"\"\"|dnl )"
SHORTENED = r"([ (,])(v|ver|vers|inc|ltd|co|corp|e\.g|i\.e|etc|vs|no|dr|st)\.([ \t\r\n])"
ENDS = r"[.!?;:]+[\"')\]]*[ \t\r\n]+|\n[ \t\r]*\n[ \t\r\n]*|\n[ \t]*(?:\(?[0-9a-z]{1,2}\)|[*+-])[ \t]+"
OTHERS = r"[^a-z0-9.]+"
LOOSE_DOTS = r"\.+( |$)"
STATEMENT = r"^(?:(?:this|the|all) [a-z]+ (?:is|are) )?(?:dual |also |hereby )?(?:licensed|released|distributed|available|made available|provided|published) under (?:the )?(?:terms of )?(?:the )?"
TAG = r"(spdx-license-identifier):[ \t]*"
HINT = r"licen[cs]|permi[st]|redistribut|warrant|unencumbered|misrepresented|software|endorse|copyright|liab|dedicat|procurement|profits|this notice|of the mpl|(?:licensed|released|distributed|available|provided|published)[^a-z0-9.]+under|spdx"


#: Of a normalised sentence: who must not be named in endorsements, where the text is to be found, what may be chosen; and what stands in their place.
GAPS = [
    (r"^neither the names? of .+ nor the names? of ", "neither the name of the copyright holder nor the names of "),
    (r" (?:please )?see (?:the )?(?:accompanying |included |attached )?(?:license|licence|copying)(?:\.[a-z]+)?(?: file)?(?: for .*| in .*)?$", ""),
    (r"^under (?:either|any) (?:one )?of (?:the )?(.*?)(?: at your (?:own )?(?:option|choice))?$", r"choose \1"),
]
#: How sentences that name several licences begin, and what stands between the names.
EITHER, IDENTIFIER, BETWEEN = "choose ", "spdx license identifier ", r" (?:or|and|with) (?:the )?"


def _sentences(text: str) -> list[str]:
    """Normalised sentences of a text, in order: what ``scan`` does with its columns."""
    text = re.sub(TAG, r"\1 ", re.sub(SHORTENED, r"\1\2\3", re.sub(COMMENT, r"\1", text.lower())))
    return [x for s in re.split(ENDS, text) if (x := _normal(s))]


def _normal(sentence: str) -> str:
    x = re.sub(STATEMENT, "under ", re.sub(LOOSE_DOTS, r"\1", re.sub(OTHERS, " ", sentence)).strip(" "))
    for pattern, instead in GAPS:
        x = re.sub(pattern, instead, x)
    return x


def normalise(sentence: Column) -> Column:
    """Of a lower-case sentence: runs of anything but ASCII letters, digits and dots become one blank; dots at a word's end go; statements begin with "under"; see GAPS."""
    x = F.trim(F.regexp_replace(F.regexp_replace(sentence, OTHERS, " "), LOOSE_DOTS, "$1"))
    x = F.regexp_replace(x, STATEMENT, "under ")
    for pattern, instead in GAPS:
        x = F.regexp_replace(x, pattern, instead.replace("\\1", "$1"))
    return x


def named(sentence: Column) -> Column:
    """A sentence that names several licences, of a choice or an SPDX expression, as one for each; others as they are. What stands in an expression behind WITH is no known sentence."""
    later = F.replace(sentence, F.lit(" or later"), F.lit(" or-later"))  # names no other licence
    each = lambda begin, instead: F.transform(F.split(F.substring(later, F.lit(len(begin) + 1), F.length(later)), BETWEEN), lambda x: F.concat(F.lit(instead), F.replace(x, F.lit(" or-later"), F.lit(" or later"))))
    return F.when(F.startswith(sentence, F.lit(EITHER)), each(EITHER, "under ")).when(F.startswith(sentence, F.lit(IDENTIFIER)), each(IDENTIFIER, IDENTIFIER)).otherwise(F.array(sentence))


@lru_cache(maxsize=1)
def standard() -> tuple[dict[str, str], list[tuple[str, str, tuple[str, ...]]]]:
    """Known sentences (normalised, to identifier) and rules (name, licence, identifiers in order), made from the fixed texts and names."""
    known: dict[str, str] = {}
    rules: dict[tuple[str, ...], tuple[str, str]] = {}

    def add(name: str, licence: str | None, text: str) -> None:
        ids = tuple(known.setdefault(s, f"{name}.{k + 1}") for k, s in enumerate(x for x in _sentences(text) if len(x) > 2))
        if licence:
            rules.setdefault(ids, (name, licence))

    for name, licence, text in NOTICES:
        add(name, None if name == "bsd-disclaimer" else licence, text)
    for licence, text in (("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'), *((lic, t) for _, lic, t in NOTICES if lic in ("MIT", "ISC", "0BSD"))):
        # The first sentence alone still names the licence.
        first = re.split(ENDS, text)[0]
        add(f"{licence.lower()}-first", licence, first)
    for k, (licence, title) in enumerate(TITLES):
        add(f"{licence.lower()}-text-{k + 1}", licence, title)
    spdx = [x for x, _ in NAMES] + [f"{x.removesuffix('only')}or-later" for x, _ in NAMES if x.endswith("-only")] + ["0BSD", "MIT-0", "GPL-2.0", "GPL-2.0+", "GPL-3.0", "GPL-3.0+", "LGPL-2.1", "LGPL-2.1+", "LGPL-3.0", "LGPL-3.0+", "AGPL-3.0", "AGPL-3.0+"]
    cc = [(f"CC-{short}-{v}", [f"CC {short} {v}", f"CC {short}", f"Creative Commons {words} {v} International License", f"Creative Commons {words} {v} International", f"Creative Commons {words} {v} License", f"Creative Commons {words} {v}", f"a Creative Commons {words} {v} International License"]) for short, words in TERMS.items() for v in VERSIONS[::-1]]
    for licence, names in [*NAMES, *cc]:
        for k, x in enumerate(names):
            add(f"{licence.lower()}-line" + (f"-{k + 1}" if k else ""), licence, f"Licensed under the {x}")
            if x.endswith("License"):
                add(f"{licence.lower()}-title-{k + 1}", licence, x)
                add(f"{licence.lower()}-the-title-{k + 1}", licence, f"The {x}")
            if licence[-4:] == "only":
                add(f"{licence.lower()[:-4]}or-later-line-{k + 1}", f"{licence[:-4]}or-later", f"Licensed under the {x} or later")
    for x in [*spdx, *(lic for lic, _ in cc)]:
        full = f"{x[:-1]}-or-later" if x.endswith("+") else f"{x}-only" if x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") else x
        add(f"spdx-{x.lower()}", full, f"SPDX-License-Identifier: {x}")
    return known, [(name, licence, ids) for ids, (name, licence) in rules.items()]


def _tables(sentences, rules):
    """Sentences with codes of equal width, rules as runs of codes (longer ones first), their names and licences, and the codes' identifiers."""
    if sentences is None:
        sentences, rules = standard()
    ids = list(dict.fromkeys(sentences.values()))
    code = {x: f"#{k:05d}" for k, x in enumerate(ids)}
    ordered = sorted(rules, key=lambda r: -len(r[2]))  # of equal length, as given
    chosen = {"".join(code[x] for x in own): (name, licence) for name, licence, own in reversed(ordered) if own}
    chosen = dict(reversed(chosen.items()))
    return list(sentences), [code[x] for x in sentences.values()], chosen, code


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """(doc_id, n_sentences, sequence, rules, licenses) for every row of ``docs`` (doc_id, text).

    Marks of comments are left out, a text is cut at ends of sentences, blank lines and list marks (a wrapped line goes on),
    and each sentence is normalised and looked up among the known ones; where it isn't known, each of its lines is. A sentence
    that offers several licences, or an SPDX expression, is looked up by the names in it.
    ``n_sentences`` counts known ones, ``sequence`` holds their identifiers in order, joined by commas. Rules match from left to
    right where their identifiers follow one another in that sequence (unknown sentences between them don't matter), the
    longest rule first; what one has matched is not matched again. ``rules`` and ``licenses`` are the distinct names, sorted,
    joined by commas. Everything happens within a row, so nothing is shuffled. Null and empty texts: 0 and empty strings.
    Repeated rows and null ids stay; other columns are ignored.
    """
    known, codes, chosen, code = _tables(sentences, rules)
    listed = lambda xs: F.array(*map(F.lit, xs))
    number = lambda x: F.array_position(listed(known), x).cast("int")
    numbers = lambda s: F.transform(named(s), number)
    some = lambda ks: F.filter(ks, lambda k: k > 0)
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    cut = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, COMMENT, "$1"), SHORTENED, "$1$2$3"), TAG, "$1 "), ENDS)
    # Each sentence is normalised once, then looked up; only where not all that it names is known are its lines.
    whole = F.transform(cut, lambda s: F.struct(s.alias("raw"), normalise(s).alias("x")))
    looked = F.transform(whole, lambda s: F.struct(s["raw"].alias("raw"), numbers(s["x"]).alias("found")))
    lines = lambda s: F.flatten(F.transform(F.transform(F.split(s, "\n"), normalise), numbers))
    of = lambda s: some(F.when(F.forall(s["found"], lambda k: k > 0) | ~s["raw"].contains("\n"), s["found"]).otherwise(lines(s["raw"])))
    hinted = text.rlike(HINT) if sentences is None else F.lit(True)
    found = F.when(hinted, F.flatten(F.transform(looked, of))).otherwise(F.array().cast("array<int>"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(found, lambda k: F.element_at(listed(codes), k)).alias("codes"))
    names = listed(list(code))
    rows = rows.select("doc_id", F.size("codes").cast("long").alias("n_sentences"), F.array_join(F.transform("codes", lambda c: F.element_at(names, F.substring(c, 2, 5).cast("int") + 1)), ",").alias("sequence"), F.array_join("codes", "").alias("codes"))
    matched = F.regexp_extract_all("codes", F.lit("(" + "|".join(chosen) + ")"), F.lit(1))
    rows = rows.withColumn("at", F.when(F.col("n_sentences") > 0, F.transform(matched, lambda m: F.array_position(listed(list(chosen)), m).cast("int"))).otherwise(F.array().cast("array<int>")))
    pick = lambda k: F.array_join(F.array_sort(F.array_distinct(F.transform("at", lambda i: F.element_at(listed([x[k] for x in chosen.values()]), i)))), ",")
    return rows.select("doc_id", "n_sentences", "sequence", pick(0).alias("rules"), pick(1).alias("licenses"))


def sql(table: str = "documents", sentences: dict[str, str] | None = None, rules: list | None = None) -> str:
    """The same in DuckDB's SQL."""
    known, codes, chosen, code = _tables(sentences, rules)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    array = lambda xs: "[" + ", ".join(map(quoted, xs)) + "]"
    basic = lambda t: f"regexp_replace(trim(regexp_replace(regexp_replace({t}, {quoted(OTHERS)}, ' ', 'g'), {quoted(LOOSE_DOTS)}, '\\1', 'g')), {quoted(STATEMENT)}, 'under ')"

    def clean(t: str) -> str:
        t = basic(t)
        for pattern, instead in GAPS:
            t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(instead)})"
        return t

    part = lambda x, begin, instead: f"list_transform(string_split_regex(substring(replace({x}, ' or later', ' or-later'), {len(begin) + 1}), {quoted(BETWEEN)}), lambda y: concat({quoted(instead)}, replace(y, ' or-later', ' or later')))"
    each = lambda x: f"CASE WHEN starts_with({x}, {quoted(EITHER)}) THEN {part(x, EITHER, 'under ')} WHEN starts_with({x}, {quoted(IDENTIFIER)}) THEN {part(x, IDENTIFIER, IDENTIFIER)} ELSE [{x}] END"
    return f"""
WITH known AS (SELECT unnest({array(known)}) AS sentence, unnest({array(codes)}) AS code),
ids AS (SELECT unnest({array(code.values())}) AS code, unnest({array(code)}) AS id),
rules AS (SELECT unnest({array(chosen)}) AS run, unnest({array([x[0] for x in chosen.values()])}) AS rule, unnest({array([x[1] for x in chosen.values()])}) AS license),
cut AS (SELECT doc_id, row_number() OVER () AS r, string_split_regex(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), {quoted(COMMENT)}, '\\1', 'g'), {quoted(SHORTENED)}, '\\1\\2\\3', 'g'), {quoted(TAG)}, '\\1 ', 'g'), {quoted(ENDS)}) AS ts FROM {table}),
each AS (SELECT r, unnest(ts) AS t, generate_subscripts(ts, 1) AS p FROM cut),
normal AS (SELECT r, p, t, {clean("t")} AS x FROM each),
parts AS (SELECT r, p, unnest({each("x")}) AS x, generate_subscripts({each("x")}, 1) AS q FROM normal),
looked AS (SELECT r, p, q, code, count(*) OVER (PARTITION BY r, p) = count(code) OVER (PARTITION BY r, p) AS every FROM parts LEFT JOIN known ON sentence = x),
whole AS (SELECT r, p, 0 AS l, q, code FROM looked JOIN normal USING (r, p) WHERE code IS NOT NULL AND (every OR NOT contains(t, chr(10)))),
lines AS (SELECT r, p, unnest(string_split(t, chr(10))) AS t, generate_subscripts(string_split(t, chr(10)), 1) AS l FROM normal WHERE contains(t, chr(10)) AND EXISTS (SELECT 1 FROM looked WHERE looked.r = normal.r AND looked.p = normal.p AND NOT every)),
clean AS (SELECT r, p, l, {clean("t")} AS x FROM lines),
items AS (SELECT r, p, l, unnest({each("x")}) AS x, generate_subscripts({each("x")}, 1) AS q FROM clean),
found AS (SELECT * FROM whole UNION ALL SELECT r, p, l, q, code FROM items JOIN known ON sentence = x),
named AS (SELECT r, string_agg(id, ',' ORDER BY p, l, q) AS sequence, string_agg(code, '' ORDER BY p, l, q) AS codes, count(*) AS n FROM found JOIN ids USING (code) GROUP BY r),
matched AS (SELECT r, unnest(regexp_extract_all(codes, {quoted('(' + '|'.join(chosen) + ')')}, 1)) AS run FROM named),
judged AS (SELECT r, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM matched JOIN rules USING (run) GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(sequence, '') AS sequence, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses FROM cut LEFT JOIN named USING (r) LEFT JOIN judged USING (r)
"""
