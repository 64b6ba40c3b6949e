r"""Operator 10 [native]: licence recognition from sentences.

A text is lower-cased (A-Z), everything but letters, digits, line ends and
``. ! ? ; :`` becomes a space, so comment marks go.  Sentences begin and end at
line ends, at those marks before a space, and before an address.  A known
sentence may be wrapped: it may go on over a line end or a ``;`` or ``:``, but
not over an empty line or a mark that ends sentences.  Known licence sentences
have identifiers; a document becomes the sequence of identifiers of the known
sentences in it, in order.  A line that is a known sentence by
itself is not joined to the next.  *Rules* are ordered sequences of identifiers; they are tried longest
first, and what a rule has matched is not matched again.

All of it is Spark SQL expressions on one row; nothing is shuffled and no
Python runs on executors.  The sentence table is a fixed literal.

Defined results: null is the empty text; documents without a known sentence
have empty strings and zero; repeated rows give repeated rows; extra columns
are kept, those with a name of the results as ``input_<name>``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objloom.llm.common import column, set_aside

# Identifiers of licence sentences, normalised.
SENTENCES = {
    "apache-name": "apache license version 2.0",
    "apache-notice": "licensed under the apache license version 2.0",
    "apache-may-not": "licensed under the apache license version 2.0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "spdx": "spdx license identifier",
    "spdx-apache": "apache 2.0",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-name": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "spdx-mit": "mit",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-notice": "licensed under the bsd license",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "spdx-gpl3": "gpl 3.0 only",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by": "licensed under cc by 4.0",
    "cc-by-sa": "licensed under cc by sa 4.0",
    "cc0": "licensed under cc0 1.0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "rights": "all rights reserved",
    "lgpl-free": "this library is free software",
    "lgpl21-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "lgpl3-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsl-notice": "distributed under the boost software license version 1.0",
    "bsl-name": "boost software license version 1.0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "epl-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-damages": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "spdx-gpl2": "gpl 2.0 only",
    "spdx-gpl2-later": "gpl 2.0 or later",
    "spdx-gpl3-later": "gpl 3.0 or later",
    "spdx-lgpl21": "lgpl 2.1 only",
    "spdx-lgpl21-later": "lgpl 2.1 or later",
    "spdx-lgpl3": "lgpl 3.0 only",
    "spdx-agpl3": "agpl 3.0 only",
    "spdx-agpl3-later": "agpl 3.0 or later",
    "spdx-bsd2": "bsd 2 clause",
    "spdx-bsd3": "bsd 3 clause",
    "spdx-isc": "isc",
    "spdx-bsl": "bsl 1.0",
    "spdx-unlicense": "unlicense",
    "spdx-epl": "epl 2.0",
    "spdx-mpl": "mpl 2.0",
    "spdx-zlib": "zlib",
    "spdx-cc0": "cc0 1.0",
}
# Ordered rules, (licence, identifiers of consecutive known sentences).
RULES = [
    ("apache-2.0", ("apache-may-not", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("apache-2.0", ("apache-notice", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("bsd-3-clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("gpl-3.0", ("gpl-free", "gpl3-terms", "gpl-hope", "gpl-received")),
    ("gpl-2.0", ("gpl-free", "gpl2-terms", "gpl-hope", "gpl-received")),
    ("mit", ("mit-name", "mit-grant", "mit-condition", "mit-as-is")),
    ("bsd-2-clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("mit", ("mit-grant", "mit-condition", "mit-as-is")),
    ("zlib", ("zlib-as-is", "zlib-damages", "zlib-grant")),
    ("gpl-3.0", ("gpl-free", "gpl3-terms")),
    ("gpl-2.0", ("gpl-free", "gpl2-terms")),
    ("mpl-2.0", ("mpl-form", "mpl-copy")),
    ("apache-2.0", ("spdx", "spdx-apache")),
    ("mit", ("spdx", "spdx-mit")),
    ("gpl-3.0", ("spdx", "spdx-gpl3")),
    ("lgpl-2.1", ("lgpl-free", "lgpl21-terms")),
    ("lgpl-3.0", ("lgpl-free", "lgpl3-terms")),
    ("lgpl-3.0", ("gpl-free", "lgpl3-terms")),
    ("agpl-3.0", ("gpl-free", "agpl3-terms")),
    ("isc", ("isc-grant", "isc-as-is")),
    ("gpl-2.0", ("spdx", "spdx-gpl2")),
    ("gpl-2.0", ("spdx", "spdx-gpl2-later")),
    ("gpl-3.0", ("spdx", "spdx-gpl3-later")),
    ("lgpl-2.1", ("spdx", "spdx-lgpl21")),
    ("lgpl-2.1", ("spdx", "spdx-lgpl21-later")),
    ("lgpl-3.0", ("spdx", "spdx-lgpl3")),
    ("agpl-3.0", ("spdx", "spdx-agpl3")),
    ("agpl-3.0", ("spdx", "spdx-agpl3-later")),
    ("bsd-2-clause", ("spdx", "spdx-bsd2")),
    ("bsd-3-clause", ("spdx", "spdx-bsd3")),
    ("isc", ("spdx", "spdx-isc")),
    ("bsl-1.0", ("spdx", "spdx-bsl")),
    ("unlicense", ("spdx", "spdx-unlicense")),
    ("epl-2.0", ("spdx", "spdx-epl")),
    ("mpl-2.0", ("spdx", "spdx-mpl")),
    ("zlib", ("spdx", "spdx-zlib")),
    ("cc0-1.0", ("spdx", "spdx-cc0")),
    ("apache-2.0", ("apache-may-not",)),
    ("apache-2.0", ("apache-notice",)),
    ("apache-2.0", ("apache-name",)),
    ("mit", ("mit-notice",)),
    ("mit", ("mit-licensed",)),
    ("mit", ("mit-grant",)),
    ("mit", ("mit-name",)),
    ("bsd", ("bsd-notice",)),
    ("gpl-3.0", ("gpl3-work",)),
    ("gpl-3.0", ("gpl3-notice",)),
    ("gpl-3.0", ("gpl3-terms",)),
    ("gpl-2.0", ("gpl2-terms",)),
    ("cc-by-nc-4.0", ("cc-by-nc",)),
    ("cc-by-nc-4.0", ("cc-by-nc-work",)),
    ("cc-by-4.0", ("cc-by",)),
    ("cc-by-4.0", ("cc-by-work",)),
    ("cc-by-sa-4.0", ("cc-by-sa",)),
    ("cc0-1.0", ("cc0",)),
    ("mpl-2.0", ("mpl-form",)),
    ("lgpl-2.1", ("lgpl21-terms",)),
    ("lgpl-3.0", ("lgpl3-terms",)),
    ("agpl-3.0", ("agpl3-terms",)),
    ("isc", ("isc-grant",)),
    ("bsl-1.0", ("bsl-notice",)),
    ("bsl-1.0", ("bsl-name",)),
    ("unlicense", ("unlicense-free",)),
    ("epl-2.0", ("epl-terms",)),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = r"[^a-z0-9\n.!?;:]+"
CUT = r" *[.!?;:]* *\n[ \n]*|[.!?;:]+ +"
END = r"^[ .!?;:]+|[ .!?;:]+$"
_WHOLE = r"mit(?=[^a-z0-9\n.!?;:]*(?:$|[\n.!?;:]|https?:))"
#: Every known sentence has one of these words anywhere, or is at the beginning of a sentence one of those that begin with
#: a licence's name (``mit``, which is a word elsewhere, the whole sentence).  Normalising changes none of this, so a text
#: without any has no known sentence and needn't be cut.
HINT = rf"licens|redistribut|copyright|permission|software|rights|warrant|distributed|(?:^|[\n.!?;:])[^a-z0-9]*(?:apache|{_WHOLE}|[la]?gpl|bsd|isc|bsl|epl|mpl|zlib|cc0)(?![a-z0-9])"


_GAP = r"[ \n.!?;:]"
#: A whole gap between words that ends a line or a clause, but neither a sentence nor a paragraph; known sentences may go on behind it.
SOFT = rf"(?<!{_GAP})(?:[ ;:]*+\n[ ;:]*+|[ ;:]*[;:] [ ;:]*+)(?!{_GAP})"
#: Any other gap with a line end, or with a mark before a space.
HARD = rf"(?<!{_GAP}){_GAP}*?(?:\n|[.!?;:] ){_GAP}*+"
EDGE = rf"\A{_GAP}++|(?<!{_GAP}){_GAP}++\z"
_SORTED = [s.replace(".", r"\.") for s in sorted(SENTENCES.values(), key=len, reverse=True)]
_BEHIND = r"(?=[~|]|\z|(?: |~)https?[~|])"
#: A known sentence between gaps, on one line or else wrapped; an address behind it on its line doesn't matter.
KNOWN = rf"(?<![^~|])(?:(?:{'|'.join(_SORTED)}){_BEHIND}|(?:{'|'.join(s.replace(' ', '[ ~]') for s in _SORTED)}){_BEHIND})"


def sentences(text: Column) -> Column:
    """Array of the known sentences of a text, normalised, in order."""
    plain = F.regexp_replace(F.translate(text, UPPER, LOWER), OTHER, " ")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, EDGE, ""), SOFT, "~"), HARD, "|")
    return F.transform(F.regexp_extract_all(marked, F.lit(KNOWN), F.lit(0)), lambda s: F.translate(s, "~", " "))


def recognise(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with n_known (known sentences), sentence_ids, licenses (sorted, comma-joined), n_matches and rules (licence:count in rule order)."""
    made = ("n_known", "sentence_ids", "licenses", "n_matches", "rules")
    docs[f"`{text_col}`"]
    docs, names = set_aside(docs, (*made, "_ids", "_got"))
    text = F.coalesce(column(names[text_col]), F.lit(""))
    known = F.create_map(*[F.lit(x) for k, s in SENTENCES.items() for x in (s, k)])
    ids = F.filter(F.transform(sentences(text), lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    found = docs.withColumn("_ids", F.when(F.regexp_like(F.translate(text, UPPER, LOWER), F.lit(HINT)), ids).otherwise(none))
    # a fold over the rules: what is left of the sequence, and (licence, count) of those that matched
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{k}>" for k in seq)).alias("seq")) for name, seq in RULES])
    sequence = F.concat_ws("", F.transform("_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    empty = F.array().cast("array<struct<name:string,n:bigint>>")
    fold = F.aggregate(
        rules, F.struct(sequence.alias("left"), empty.alias("got")),
        lambda acc, r: F.when(
            F.contains(acc["left"], r["seq"]),
            F.struct(
                F.replace(acc["left"], r["seq"], F.lit("|")).alias("left"),
                F.concat(acc["got"], F.array(F.struct(r["name"].alias("name"), F.floor((F.length(acc["left"]) - F.length(F.replace(acc["left"], r["seq"], F.lit("")))) / F.length(r["seq"])).alias("n")))).alias("got"),
            ),
        ).otherwise(acc),
        lambda acc: acc["got"],
    )
    found = found.withColumn("_got", F.when(F.size("_ids") > 0, fold).otherwise(empty))
    return found.withColumns({
        "n_known": F.size("_ids").cast("long"), "sentence_ids": F.concat_ws(",", "_ids"),
        "licenses": F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("_got", lambda g: g["name"])))),
        "n_matches": F.aggregate("_got", F.lit(0).cast("long"), lambda a, g: a + g["n"]),
        "rules": F.concat_ws(",", F.transform("_got", lambda g: F.concat_ws(":", g["name"], g["n"]))),
    }).drop("_ids", "_got")
