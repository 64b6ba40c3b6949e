"""The quick test before sentences are cut is exact, and bare known sentences are found without a neighbour."""

import re

from objloom.llm import licenses
from tests.llm.helpers import by_id, frame

MORE = [
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("bsl-1.0", "// Distributed under the Boost Software License, Version 1.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("epl-2.0", "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/"),
    ("bsd-3-clause", "# SPDX-License-Identifier: BSD-3-Clause"),
    ("agpl-3.0", "/* SPDX-License-Identifier: AGPL-3.0-or-later */"),
]


def test_every_sentence_has_a_hint_word_that_normalising_keeps():
    for s in licenses.SENTENCES.values():
        assert re.search(licenses.HINT, s), s
        found = re.search(licenses.HINT, s)[0]
        assert " " not in found and re.fullmatch("[a-z0-9]+", found), s
        assert re.search(licenses.HINT, s.replace(" ", "  -- ")), s


def test_bare_sentences(spark):
    """Each known sentence alone, as it is and with other characters between its words."""
    keys = list(licenses.SENTENCES)
    texts = [licenses.SENTENCES[k] for k in keys] + [licenses.SENTENCES[k].upper().replace(" ", "  \t") for k in keys]
    got = by_id(licenses.recognise(frame(spark, texts)))
    assert [got[i].sentence_ids for i in range(len(texts))] == keys * 2


def test_more_licences(spark):
    got = by_id(licenses.recognise(frame(spark, [t for _, t in MORE])))
    assert [got[i].licenses for i in range(len(MORE))] == [k for k, _ in MORE]
