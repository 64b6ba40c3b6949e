from objloom.llm import licenses
from tests.llm.helpers import EDGE_TEXTS, by_id, frame

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""

CASES = [
    ("Some prose. Licensed under CC BY-NC 4.0. More prose", "cc-by-nc-4.0", 1),
    ("Released under the MIT License.\nReleased under the MIT License.", "mit", 2),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0", 1),
    ("x\nLicensed under the Apache License, Version 2.0.\ny", "apache-2.0", 1),
    (APACHE, "apache-2.0", 1),
    (APACHE + "\n\nReleased under the MIT License.", "apache-2.0,mit", 2),
    ("// SPDX-License-Identifier: Apache-2.0\n// SPDX-License-Identifier: MIT\ncode", "apache-2.0,mit", 2),
    ("You may obtain a copy of the License at once", "", 0),
    ("unlicensed under the Apache License, Version 2.0", "", 0),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3.0", 1),
]


def test_rules(spark):
    got = by_id(licenses.recognise(frame(spark, [c[0] for c in CASES]).selectExpr("*", "1 AS licenses", "2 AS Rules")))
    for i, (text, want, n) in enumerate(CASES):
        assert (got[i].licenses, got[i].n_matches) == (want, n), text
    assert got[4].rules == "apache-2.0:1" and got[4].n_known == 5


def test_edges_and_native_plan(spark):
    found = licenses.recognise(frame(spark, [*EDGE_TEXTS, "license " * 30_000]))
    assert all((r.n_known, r.licenses, r.sentence_ids, r.rules) == (0, "", "", "") for r in found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert licenses.recognise(frame(spark, ["a"]).where("false")).count() == 0


def test_every_sentence_is_its_own_normal_form(spark):
    rows = [(i, s) for i, s in enumerate(licenses.SENTENCES)]
    df = spark.createDataFrame([(i, licenses.SENTENCES[k] + "\nlicense") for i, k in rows], "doc_id long, text string")
    got = by_id(licenses.recognise(df))
    assert [got[i].sentence_ids for i, _ in rows] == [k for _, k in rows]


def test_rules_name_known_sentences():
    assert all(k in licenses.SENTENCES for _, seq in licenses.RULES for k in seq)
    sizes = [len(seq) for _, seq in licenses.RULES]
    assert sizes == sorted(sizes, reverse=True)


WRAPPED = [
    ("gpl-3.0", 4, """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""),
    ("gpl-2.0", 2, """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
"""),
    ("bsd-3-clause", 4, """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""),
    ("apache-2.0", 5, """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
// See the License for the specific language governing permissions and
// limitations under the License.
"""),
    ("mpl-2.0", 2, """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""),
    ("", 0, "licensed under the\n\nMIT License of old"),
]


def test_wrapped_notices(spark):
    for end in ("\n", "\r\n"):
        got = by_id(licenses.recognise(frame(spark, [t.replace("\n", end) for _, _, t in WRAPPED])))
        assert [(got[i].licenses, got[i].n_known) for i in range(len(WRAPPED))] == [(k, n) for k, n, _ in WRAPPED]
