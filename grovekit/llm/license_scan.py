"""License scans by sentence rules, with DataFrame operations only.

A text is cut into sentences, each sentence is normalised and looked up among
known licence sentences, and the sequence of identifiers is matched against
ordered rules: a rule that matches names its licence and takes its identifiers
out of the sequence, so that general rules see only what special ones left.
Identifiers of other licences between a rule's first and last part stay.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Identifier -> normalised sentence (lower case, letters and digits, single blanks).
SENTENCES = {
    "mit_ref": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "the mit license", "mit license", "distributed under the mit license"),
    "mit_grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit_warranty": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "apache2_ref": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "apache license version 2 0"),
    "apache_compliance": ("you may not use this file except in compliance with the license",),
    "apache_copy": ("you may obtain a copy of the license at",),
    "gpl3_ref": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "gpl2_ref": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    "lgpl3_ref": ("licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    "agpl3_ref": ("licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    "gpl_redistribute": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl_warranty": ("without even the implied warranty of merchantability or fitness for a particular purpose",),
    "bsd_grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd_endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd3_ref": ("licensed under the bsd 3 clause license", "bsd 3 clause license"),
    "bsd2_ref": ("licensed under the bsd 2 clause license", "bsd 2 clause license"),
    "mpl2_ref": ("this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "mozilla public license version 2 0"),
    "cc_by4": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc_by_sa4": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc_by_nc4": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc0": ("this work is dedicated to the public domain under cc0 1 0", "licensed under cc0 1 0"),
    "isc_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "rights_reserved": ("all rights reserved",),
}
# Ordered rules, licence -> pattern over ",id,id,"; other known identifiers may stand between (,\w+)*.
RULES = (
    ("MIT", r",mit_grant(,\w+)*,mit_notice((,\w+)*,mit_warranty)?"),
    ("BSD-3-Clause", r",bsd_grant(,\w+)*,bsd_source(,\w+)*,bsd_binary(,\w+)*,bsd_endorse"),
    ("BSD-2-Clause", r",bsd_grant(,\w+)*,bsd_source(,\w+)*,bsd_binary"),
    ("Apache-2.0", r",apache2_ref(,\w+)*,apache_compliance((,\w+)*,apache_copy)?"),
    ("GPL-3.0-or-later", r",gpl_redistribute((,\w+)*,gpl_warranty)?"),
    ("ISC", r",isc_grant"),
    ("Unlicense", r",unlicense"),
    ("AGPL-3.0", r",agpl3_ref"),
    ("LGPL-3.0", r",lgpl3_ref"),
    ("GPL-3.0", r",gpl3_ref"),
    ("GPL-2.0", r",gpl2_ref"),
    ("MPL-2.0", r",mpl2_ref"),
    ("BSD-3-Clause", r",bsd3_ref"),
    ("BSD-2-Clause", r",bsd2_ref"),
    ("Apache-2.0", r",apache2_ref"),
    ("CC-BY-NC-4.0", r",cc_by_nc4"),
    ("CC-BY-SA-4.0", r",cc_by_sa4"),
    ("CC-BY-4.0", r",cc_by4"),
    ("CC0-1.0", r",cc0"),
    ("MIT", r",mit_ref"),
    ("UNKNOWN-GRANT", r",(mit_grant|bsd_grant|mit_warranty|gpl_warranty)"),
    ("ALL-RIGHTS-RESERVED", r",rights_reserved"),
)
# Every known sentence holds one of these, each within one word, so that no white space or sign of a raw text can break it.
MARKS = ("licen", "permission", "copyright", "warranty", "redistribut", "reserved", "unencumbered", "cc0")

# A BSD-2 text before another BSD text: its identifiers are those of the BSD-3 rule, so it is taken first.
_WITHIN = r"(,(?!bsd_grant,|bsd_endorse,)\w+)*"
_APART = ("BSD-2-Clause", rf",bsd_grant{_WITHIN},bsd_source{_WITHIN},bsd_binary{_WITHIN}(?=,bsd_grant(,\w+)*,bsd_source(,\w+)*,bsd_binary,)")


def _taking() -> list[tuple[str, str, str]]:
    """Name, pattern of a whole sequence in three groups (before, match, behind), and pattern of the rule's own identifiers."""
    out = []
    for name, pattern in [RULES[0], _APART, *RULES[1:]]:
        own = re.findall(r",(\w+)", pattern.split("(?=")[0])
        own = f",({'|'.join(own)})" if own else pattern
        if r"(,\w+)*" not in pattern:
            span = rf"{pattern}((,\w+)*{pattern})?"
        elif name == "GPL-3.0-or-later":
            span = rf",gpl_redistribute((,\w+)*{own})?"
        else:
            span = pattern
        plain = re.sub(r"\((?!\?)", "(?:", span)
        out.append((name, rf"^(.*?)({plain})((?:,\w+)*,)$", own + r"(?=,|$)"))
    return out


_BY_SENTENCE = {s: k for k, own in SENTENCES.items() for s in own}
_LONGEST = max(map(len, _BY_SENTENCE))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licenses, n_licenses`` for every row.

    A sentence ends at one of ``. ! ? : ;`` before white space, or at an empty
    line; each line of a sentence over several lines is looked up as well, before
    the whole. ``n_sentences`` counts known sentences in order of the text, and
    ``licenses`` holds each licence once, sorted. Both lists are comma-joined.
    Null and empty texts have none; repeated rows appear each; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains(F.lower(text), F.lit(m))
    known = F.create_map(*[F.lit(x) for kv in _BY_SENTENCE.items() for x in kv])
    sentences = F.split(text, r"(?<=[.!?:;])\s+|\n\s*\n")
    parts = F.flatten(F.transform(sentences, lambda s: F.when(F.contains(s, F.lit("\n")), F.array_append(F.split(s, r"\n"), s)).otherwise(F.array(s))))
    plain = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", " ")))
    ids = F.filter(F.transform(plain, lambda s: F.when(F.length(s) <= _LONGEST, known[s])), lambda x: x.isNotNull())
    ids = F.when(marked, ids).otherwise(F.array().cast("array<string>"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(whole).alias("whole"), F.lit(own).alias("own")) for name, whole, own in _taking()])
    start = F.struct(F.concat(F.lit(","), F.array_join("ids", ","), F.lit(",")).alias("left"), F.array().cast("array<string>").alias("names"))
    group = lambda c, r, i: F.call_function("regexp_extract", c, r["whole"], i)
    left = lambda c, r: F.concat(group(c, r, F.lit(1)), F.regexp_replace(group(c, r, F.lit(2)), r["own"], F.lit("")), group(c, r, F.lit(3)))
    matched = F.aggregate(
        rules, start,
        lambda acc, r: F.when(F.regexp_like(acc["left"], r["whole"]), F.struct(left(acc["left"], r).alias("left"), F.array_append(acc["names"], r["name"]).alias("names"))).otherwise(acc),
    )
    found = docs.select(F.col(id_col).alias("doc_id"), ids.alias("ids"))
    names = F.when(F.size("ids") > 0, F.array_sort(F.array_distinct(matched["names"]))).otherwise(F.array().cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(names, ",").alias("licenses"), F.size(names).cast("long").alias("n_licenses"))


def _oracle() -> str:
    pairs = ", ".join(f"('{s}', '{k}')" for s, k in _BY_SENTENCE.items())
    steps, last = "", "r0"
    for i, (name, pattern) in enumerate(RULES, 1):
        p = f"{pattern},".replace("'", "''")
        steps += f",\nr{i} AS (SELECT doc_id, ids, CASE WHEN regexp_matches(l, '{p}') THEN list_append(names, '{name}') ELSE names END AS names, regexp_replace(regexp_replace(l, '{p}', ',', 'g'), '{p}', ',', 'g') AS l FROM {last})"
        last = f"r{i}"
    return rf"""
WITH k(s, id) AS (VALUES {pairs}),
a AS (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?:;])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n\s*\n') AS ss FROM documents),
b AS (SELECT doc_id, i, ss[i] AS s FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM a)),
c AS (SELECT doc_id, i, CASE WHEN contains(s, chr(10)) THEN list_append(string_split(s, chr(10)), s) ELSE [s] END AS ps FROM b),
d AS (SELECT doc_id, i, j, trim(regexp_replace(lower(ps[j]), '[^a-z0-9]+', ' ', 'g')) AS s FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS j FROM c)),
e AS (SELECT doc_id, list(id ORDER BY i, j) AS ids FROM d JOIN k USING (s) GROUP BY doc_id),
r0 AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS l, []::VARCHAR[] AS names FROM e){steps}
SELECT doc_id, coalesce(len(ids), 0)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licenses, coalesce(len(list_distinct(names)), 0)::BIGINT AS n_licenses
FROM documents LEFT JOIN {last} USING (doc_id)
"""


ORACLE = _oracle()
