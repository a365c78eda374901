"""License scans by sentence rules.

A text is normalised (lower case, everything but letters and digits is one space) with marks where
a sentence may begin or end: at stops and line ends.  A known licence sentence becomes an identifier
where it lies between two marks; inside it marks don't count, since texts are wrapped and sentences
have colons and semicolons, but no sentence goes past a blank line.  The sequence of identifiers is
then matched against licence rules: ordered sequences of identifiers.  Longer rules come first and
use up the identifiers that they match, so a full grant isn't also reported as its parts.

Sentences and rules are two small fixed tables, inlined in the expression: one pass over the text,
no shuffle, no join, nothing kept between rows.  Each licence of the rules is also known by its tag
line, "SPDX-License-Identifier: name", which is made from the name by the same normalisation.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

# Known licence sentences, normalised, by identifier.
SENTENCES = {
    "mit_release": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache2_licensed": "licensed under the apache license version 2 0",
    "apache2_licensed_the": "licensed under the apache license version 2 0 the license",
    "apache2_compliance": "you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at",
    "apache2_url": "http www apache org licenses license 2 0",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl_free_software": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free_software": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc_by_nc_4": "licensed under cc by nc 4 0",
    "cc_by_4": "licensed under cc by 4 0",
    "cc_by_sa_4": "licensed under cc by sa 4 0",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "reserved": "all rights reserved",
    "mit0_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_grant_and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "mpl2_subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2_copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl2_copy_http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "gpl2_only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "agpl3_free_software": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21_free_software": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_free_software": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl_warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "unlicense_public": "this is free and unencumbered software released into the public domain",
    "unlicense_free": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0_dedicated": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "wtfpl_permitted": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
}

# Licence rules, longest first.
RULES = (
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("Apache-2.0", ("apache2_licensed_the", "apache2_compliance", "apache2_copy", "apache2_url")),
    ("Zlib", ("zlib_as_is", "zlib_liable", "zlib_grant")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("GPL-3.0-or-later", ("gpl_free_software", "gpl_warranty")),
    ("GPL-2.0-or-later", ("gpl2_free_software", "gpl_warranty")),
    ("Apache-2.0", ("apache2_licensed_the", "apache2_compliance")),
    ("MIT-0", ("mit0_grant", "as_is")),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("ISC", ("isc_grant_and", "isc_as_is")),
    ("MPL-2.0", ("mpl2_subject", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_subject", "mpl2_copy_http")),
    ("AGPL-3.0-or-later", ("agpl3_free_software", "gpl_warranty")),
    ("LGPL-2.1-or-later", ("lgpl21_free_software", "lgpl_warranty")),
    ("LGPL-3.0-or-later", ("lgpl3_free_software", "gpl_warranty")),
    ("GPL-2.0-only", ("gpl2_only", "gpl_warranty")),
    ("Unlicense", ("unlicense_public", "unlicense_free")),
    ("MIT", ("mit_release",)),
    ("MIT", ("mit_licensed",)),
    ("Apache-2.0", ("apache2_licensed",)),
    ("Apache-2.0", ("apache2_licensed_the",)),
    ("GPL-3.0-only", ("gpl3_work",)),
    ("GPL-3.0-or-later", ("gpl_free_software",)),
    ("GPL-2.0-or-later", ("gpl2_free_software",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_4",)),
    ("CC-BY-4.0", ("cc_by_4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_4",)),
    ("LicenseRef-Reserved", ("reserved",)),
    ("BSL-1.0", ("bsl_grant",)),
    ("MPL-2.0", ("mpl2_subject",)),
    ("AGPL-3.0-or-later", ("agpl3_free_software",)),
    ("LGPL-2.1-or-later", ("lgpl21_free_software",)),
    ("LGPL-3.0-or-later", ("lgpl3_free_software",)),
    ("GPL-2.0-only", ("gpl2_only",)),
    ("Unlicense", ("unlicense_public",)),
    ("CC0-1.0", ("cc0_dedicated",)),
    ("WTFPL", ("wtfpl_permitted",)),
)

# a tag line for each licence with a public name
for _name in sorted({name for name, _ in RULES if not name.startswith("LicenseRef")}):
    _tag = re.sub("[^a-z0-9]+", " ", _name.lower())
    SENTENCES[f"spdx_{_tag.replace(' ', '_')}"] = f"spdx license identifier {_tag}"
    RULES += ((_name, (f"spdx_{_tag.replace(' ', '_')}",)),)

SENTENCE_END = r"[.!?:;]+(?:[\x20\x09-\x0D]+|\z)|\n+"


#: line ends with nothing but blanks and signs (of a comment, say) in between
BLANK_LINES = r"\n[^a-z0-9]*\n"


def identifiers(text, sentences=None):
    """Array of the identifiers of the known sentences of a text, in order.

    Where several sentences begin at one place the longest counts, and sentences don't overlap.
    """
    known = {v: k for k, v in (sentences or SENTENCES).items()}
    ids = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    # capitals can't be in the text: S may end a sentence, P does
    marked = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BLANK_LINES, " P ")
    marked = F.regexp_replace(F.regexp_replace(marked, SENTENCE_END, " S "), "[^a-z0-9SP]+", " ")
    marked = F.concat(F.lit("S "), F.trim(marked), F.lit(" S"))
    forms = "|".join(v.replace(" ", " (?:S )*+") for v in sorted(known, key=len, reverse=True))
    found = F.regexp_extract_all(marked, F.lit(f"(?<=[SP] )(?:{forms})(?= [SP])"), F.lit(0))
    return F.transform(found, lambda s: F.element_at(ids, F.regexp_replace(s, "(?: S)+ ", " ")))


def licences(ids, rules=RULES):
    """Array of the licences whose rules an identifier array matches, distinct and sorted.

    A rule matches a run of identifiers without gaps among the known sentences; a match is used up.
    """
    # every identifier stands between two spaces of its own, so that matches can't overlap
    line = F.concat(F.lit(" "), F.array_join(F.transform(ids, lambda i: F.concat(i, F.lit(" "))), " "))
    needles = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(sequence) + " ").alias("needle")) for name, sequence in rules])

    def use_up(state, rule):
        found = F.contains(state["line"], rule["needle"])
        hits = F.when(found, F.array_append(state["hits"], rule["name"])).otherwise(state["hits"])
        return F.struct(F.replace(state["line"], rule["needle"], F.lit(" | ")).alias("line"), hits.alias("hits"))

    start = F.struct(line.alias("line"), F.array().cast("array<string>").alias("hits"))
    return F.array_sort(F.array_distinct(F.aggregate(needles, start, use_up, lambda state: state["hits"])))


def scan(docs: DataFrame, text: str = "text", sentences=None, rules=RULES) -> DataFrame:
    """`docs` with licence_sentences and licences (arrays of strings; empty if none is known).

    Null and empty texts have empty arrays.  Texts are scanned whole.  Repeated rows are scanned
    each for itself, an empty table gives an empty result, and other columns pass through; columns
    with the two result names are replaced.
    """
    rest = [c for c in docs.columns if c not in ("licence_sentences", "licences")]
    named = docs.select(*rest, identifiers(docs[text], sentences).alias("licence_sentences"))
    return named.select("*", let(F.col("licence_sentences"), lambda ids: F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(licences(ids, rules))).alias("licences"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with at least one known licence sentence."""
    docs = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text").where(F.size("licence_sentences") > 0)
    return docs.select(
        "doc_id", F.size("licence_sentences").alias("n_sentences"),
        F.array_join("licence_sentences", " ").alias("sentence_ids"), F.array_join("licences", " ").alias("licences"),
    )


def _sql() -> str:
    values = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    steps, hits, line = [], [], "' ' || array_to_string(list_transform(ids, lambda i: i || ' '), ' ')"
    steps.append(f"r0 AS (SELECT doc_id, ids, {line} AS line FROM ids)")
    for k, (name, seq) in enumerate(RULES):
        needle = " " + "  ".join(seq) + " "
        steps.append(f"r{k + 1} AS (SELECT * REPLACE (replace(line, '{needle}', ' | ') AS line), contains(line, '{needle}') AS h{k} FROM r{k})")
        hits.append(f"CASE WHEN h{k} THEN '{name}' END")
    # E and S stand for a mark's two sides, so that neighbours don't share one; P lies between them
    forms = "|".join(v.replace(" ", " (?:E S )*") for v in sorted(SENTENCES.values(), key=len, reverse=True))
    blanks_out = f"regexp_replace(regexp_replace(lower(coalesce(text, '')), '{BLANK_LINES}', ' P ', 'g'), '{SENTENCE_END}', ' S ', 'g')"
    return rf"""
    WITH known(id, sentence) AS (VALUES {values}),
    marked AS (SELECT doc_id, replace(replace('S ' || trim(regexp_replace({blanks_out}, '[^a-z0-9SP]+', ' ', 'g')) || ' S', 'S', 'E S'), 'P', 'E P S') AS m FROM documents),
    pieces AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(m, 'S ({forms}) E', 1) AS p FROM marked)),
    ids AS (
      SELECT doc_id, list(id ORDER BY i) AS ids
      FROM (SELECT doc_id, i, regexp_replace(p, '(?: E S)+ ', ' ', 'g') AS sentence FROM pieces) JOIN known USING (sentence)
      GROUP BY doc_id
    ),
    {", ".join(steps)}
    SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_sentences, array_to_string(ids, ' ') AS sentence_ids,
           array_to_string(list_sort(list_distinct([x for x in [{", ".join(hits)}] if x IS NOT NULL])), ' ') AS licences
    FROM r{len(RULES)}"""


QUERIES = {"op4_licenses": query}
ORACLES = {"op4_licenses": _sql()}
