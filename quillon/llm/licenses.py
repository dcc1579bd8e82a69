"""Licences by sentence rules, in DataFrame functions only.

Comment marks at line starts go. A text is then cut into sentences in two readings: by lines (a line goes on in the next only if that begins in lower case or with a bracket)
and by paragraphs (lines go on until an empty one); both also cut after . ! ? ; : before white space or the end.
A sentence is normalised to its ASCII letters and digits, in lower case, with single spaces. Known sentences have identifiers; a licence is found
where a reading's known sentences, in order and without the unknown ones between them, have the licence's identifiers one after another.
The identifiers given are those of the reading with more of them, by lines if both have as many.

Null and empty texts have no sentences. Every row gives one row, repeated rows too, and an empty table none; there is no shuffle. Long texts are read whole, in one task.
The outputs' columns replace the table's own of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

#: Normalised sentences of public licence texts and notices.
SENTENCES = {
    "apache_named": "licensed under the apache license version 2 0",
    "apache_the_license": "licensed under the apache license version 2 0 the license",
    "apache_may_not": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "mit_named": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_title": "the mit license",
    "mit_title_short": "mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl_free": "this program is free software",
    "gpl3_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl_implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "ccbync4_named": "licensed under cc by nc 4 0",
    "ccby4_named": "licensed under cc by 4 0",
    "ccbysa4_named": "licensed under cc by sa 4 0",
    "ccby4_work": "this work is licensed under a creative commons attribution 4 0 international license",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2_subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2_copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "gpl2only_terms": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl_free": "this library is free software",
    "lgpl_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl21_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3_terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "either_2": "either version 2 of the license or at your option any later version",
    "either_21": "either version 2 1 of the license or at your option any later version",
    "either_3": "either version 3 of the license or at your option any later version",
    "bsd_as_is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "cc0_named": "cc0 1 0 universal",
    "cc0_work": "this work is licensed under cc0 1 0 universal",
    "epl2_terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_granted": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost_named": "distributed under the boost software license version 1 0",
    "spdx": "spdx license identifier",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
}
#: Names of licences that a tag can have.
TAGS = "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-or-later LGPL-3.0-or-later AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause ISC MPL-2.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 EPL-2.0 Zlib BSL-1.0".split()
SENTENCES |= {f"tag_{t.lower()}": t.lower().replace("-", " ").replace(".", " ") for t in TAGS}
#: Licence rules: sentence identifiers in order.
RULES = [
    ("Apache-2.0", ["apache_named"]),
    ("Apache-2.0", ["apache_the_license"]),
    ("Apache-2.0", ["apache_may_not", "apache_copy", "apache_unless", "apache_see"]),
    ("MIT", ["mit_named"]),
    ("MIT", ["mit_licensed"]),
    ("MIT", ["mit_title"]),
    ("MIT", ["mit_title_short"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("GPL-3.0-only", ["gpl3_work"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl3_terms"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_terms", "either_3"]),
    ("GPL-3.0-or-later", ["gpl3_terms", "gpl_hope", "gpl_implied"]),
    ("GPL-2.0-or-later", ["gpl_free", "gpl2_terms"]),
    ("GPL-2.0-or-later", ["gpl_free", "gpl_terms", "either_2"]),
    ("GPL-2.0-or-later", ["gpl2_terms", "gpl_hope", "gpl_implied"]),
    ("GPL-2.0-only", ["gpl_free", "gpl2only_terms"]),
    ("LGPL-2.1-or-later", ["lgpl_free", "lgpl21_terms"]),
    ("LGPL-2.1-or-later", ["lgpl_free", "lgpl_terms", "either_21"]),
    ("LGPL-3.0-or-later", ["lgpl3_terms"]),
    ("LGPL-3.0-or-later", ["lgpl_terms", "either_3"]),
    ("AGPL-3.0-or-later", ["agpl3_terms"]),
    ("CC-BY-NC-4.0", ["ccbync4_named"]),
    ("CC-BY-4.0", ["ccby4_named"]),
    ("CC-BY-4.0", ["ccby4_work"]),
    ("CC-BY-SA-4.0", ["ccbysa4_named"]),
    ("CC0-1.0", ["cc0_named"]),
    ("CC0-1.0", ["cc0_work"]),
    ("BSD-2-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_as_is"]),
    ("BSD-3-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("ISC", ["isc_grant"]),
    ("MPL-2.0", ["mpl2_subject", "mpl2_copy"]),
    ("EPL-2.0", ["epl2_terms"]),
    ("Zlib", ["zlib_as_is", "zlib_liable", "zlib_granted"]),
    ("BSL-1.0", ["boost_named"]),
    ("Unlicense", ["unlicense_free"]),
    *[(t, ["spdx", f"tag_{t.lower()}"]) for t in TAGS],
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Comment marks at a line's start; lines that go on; and sentence ends.
MARKS, GOES_ON, ENDS = r"\n[ \t]*(//+|#+|/?\*+/?|--+|;+|%+|<!--)[ \t]*", r"[ \t\r]*\n[ \t]*([a-z(])", r"[.!?;:]+([ \t\r\n]+|$)"
EMPTY_LINES, CUT = r"\n([ \t\r]*\n)+", "\u0001"
_SIZES = range(min(map(len, SENTENCES.values())), max(map(len, SENTENCES.values())) + 1)


def readings(text: Column) -> tuple[Column, Column]:
    """Identifiers of a text's known sentences in order, by lines and by paragraphs."""
    known = F.create_map(*[F.lit(x) for k, s in SENTENCES.items() for x in (s, k)])
    bare = F.regexp_replace(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), MARKS, "\n")
    lines = F.split(F.regexp_replace(F.regexp_replace(bare, GOES_ON, " $1"), ENDS, "\n"), "\n")
    paragraphs = F.split(F.regexp_replace(F.translate(F.regexp_replace(bare, EMPTY_LINES, CUT), "\n", " "), ENDS, CUT), CUT)

    def ids(parts: Column) -> Column:
        long = F.filter(parts, lambda s: F.length(s) >= _SIZES[0])  # normalising only shortens
        plain = F.transform(long, lambda s: F.trim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9]+", " ")))
        some = F.filter(plain, lambda s: F.length(s).between(_SIZES[0], _SIZES[-1]))
        return F.filter(F.transform(some, lambda s: F.element_at(known, s)), lambda x: x.isNotNull())

    return ids(lines), ids(paragraphs)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with ``__sentences`` (identifiers in order) and ``__licences`` (names, sorted)."""
    lines, paragraphs = readings(F.col(text_col).cast("string"))
    (both,) = free(docs, "__readings")
    out = docs.withColumn(both, F.array(lines, paragraphs))
    by_line, by_paragraph = F.get(both, F.lit(0)), F.get(both, F.lit(1))
    line = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    every = F.concat(line(by_line), F.lit("|"), line(by_paragraph))
    found = F.array(*[F.when(F.contains(every, F.lit(f" {' '.join(ids)} ")), F.lit(name)) for name, ids in RULES])
    more = F.when(F.size(by_paragraph) > F.size(by_line), by_paragraph).otherwise(by_line)
    return out.withColumns({"__sentences": more, "__licences": F.array_sort(F.array_distinct(F.array_compact(found)))}).drop(both)


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", F.size("__sentences").cast("long").alias("n_sentences"), F.array_join("__sentences", " ").alias("sentence_ids"), F.array_join("__licences", ",").alias("licences"))


def op3_sql() -> str:
    known = " ".join(f"WHEN '{s}' THEN '{k}'" for k, s in SENTENCES.items())
    rules = ", ".join(f"CASE WHEN contains(line, ' {' '.join(ids)} ') THEN '{name}' END" for name, ids in RULES)
    ids = lambda parts: f"list_filter(list_transform({parts}, lambda s: CASE trim(regexp_replace(translate(s, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')) {known} END), lambda x: x IS NOT NULL)"
    return rf"""
WITH bare AS (
  SELECT doc_id, regexp_replace(chr(10) || coalesce(text, ''), '{MARKS}', chr(10), 'g') AS t FROM documents
), parts AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '{GOES_ON}', ' \1', 'g'), '{ENDS}', chr(10), 'g'), chr(10)) AS p,
    string_split(regexp_replace(translate(regexp_replace(t, '{EMPTY_LINES}', chr(1), 'g'), chr(10), ' '), '{ENDS}', chr(1), 'g'), chr(1)) AS q FROM bare
), ids AS (
  SELECT doc_id, {ids('p')} AS a, {ids('q')} AS b FROM parts
), lines AS (SELECT doc_id, CASE WHEN len(b) > len(a) THEN b ELSE a END AS ids, ' ' || array_to_string(a, ' ') || ' | ' || array_to_string(b, ' ') || ' ' AS line FROM ids)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ' ') AS sentence_ids,
  array_to_string(list_sort(list_distinct(list_filter([{rules}], lambda x: x IS NOT NULL))), ',') AS licences
FROM lines"""
