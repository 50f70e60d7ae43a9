"""Licence statements as people write them, none of which the rules were made from; the same in DuckDB."""

import pandas as pd
from test_llm_operators import docs_of

from folioscope.llm import licenses

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

CASES = [
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
    ("Licensed under the MIT License, please see LICENSE.md for more information.", "MIT"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}", "Apache-2.0,MIT"),
    ("# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", "GPL-2.0-only"),
    ("/* SPDX-License-Identifier: (GPL-2.0-or-later AND BSD-3-Clause) */", "BSD-3-Clause,GPL-2.0-or-later"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0,MIT"),
    (BSD.format("Google Inc."), "BSD-3-Clause"),
    (BSD.format("the University of Nowhere, its departments,"), "BSD-3-Clause"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "Apache-2.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Somebody\n Everyone is permitted to copy", "GPL-3.0-only"),
    ("\t\t  GNU LESSER GENERAL PUBLIC LICENSE\n\t\t       Version 2.1, February 1999\n\n Copyright", "LGPL-2.1-only"),
    ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", "MPL-2.0"),
    ("Either version may be used, or none; the software will choose one of them.", ""),
    ("See the license file for details.", ""),
    ("Neither the name of the town nor the names of its streets are known.", ""),
    ("Licensed under either of two laws or customs.", ""),
]


def test_statements_as_people_write_them(spark, duck):
    docs = docs_of(spark, [t for t, _ in CASES])
    got = licenses.scan(docs).orderBy("doc_id").collect()
    assert [r["licenses"] for r in got] == [x for _, x in CASES]
    duck.register("statements", pd.DataFrame({"doc_id": range(len(CASES)), "text": [t for t, _ in CASES]}))
    said = duck.execute(licenses.sql("statements"))
    names = [x[0] for x in said.description]
    assert sorted(said.fetchall()) == sorted(tuple(r[n] for n in names) for r in got)
