"""Licence scans by sentence rules, with DataFrame functions alone.

A text becomes one stream of words (a-z, 0-9) with a mark wherever a sentence may begin or end: at line breaks and
behind . ! ? : ; before white space.  A known licence sentence is recognised where it begins at a mark and ends at one; one of
``LONG`` words or more may begin behind any word (a list number, a comment's mark, a copyright notice).  Marks
within it (wrapped lines, a colon) don't matter.  The identifiers found, in the order of the text, are matched
against ordered rules.  All of it happens within a row: nothing is shuffled, and no length of text or sentence is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import ascii_lower

# Licence sentences in normal form (a-z, 0-9 and single blanks) with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-ref",
    "licensed under the apache license version 2 0 the license": "apache-ref",
    "this project is licensed under the apache license version 2 0": "apache-ref",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-header",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 2": "gpl2-ref",
    "this work is licensed under the gnu general public license version 2": "gpl2-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "licensed under cc by nc 4 0": "cc-by-nc-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-ref",
    "licensed under cc by 4 0": "cc-by-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-ref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "zero-bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "licensed under the isc license": "isc-ref",
    "licensed under the bsd 2 clause license": "bsd2-ref",
    "licensed under the bsd 3 clause license": "bsd3-ref",
    "released under the bsd 3 clause license": "bsd3-ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "licensed under the mozilla public license 2 0": "mpl2-ref",
    "licensed under the mozilla public license version 2 0": "mpl2-ref",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "licensed under the gnu lesser general public license version 2 1": "lgpl21-ref",
    "licensed under the gnu lesser general public license version 3": "lgpl3-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation version 3 of the license": "agpl3-grant",
    "licensed under the gnu affero general public license version 3": "agpl3-ref",
    "this is free and unencumbered software released into the public domain": "unlicense-release",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-anyone",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "epl1-terms",
    "licensed under the eclipse public license version 2 0": "epl2-ref",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "distributed under the boost software license version 1 0": "bsl-ref",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "zlib-origin",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "licensed under cc0 1 0": "cc0-ref",
    "licensed under cc by nd 4 0": "cc-by-nd-ref",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-ref",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-ref",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd-ref",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa-ref",
    "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "cc-by-nc-nd-ref",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "this work is dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}

# Names behind "SPDX-License-Identifier:" in normal form, with the identifiers of the tags.
SPDX = {
    "mit": "mit-ref",
    "apache 2 0": "apache-ref",
    "bsd 2 clause": "bsd2-ref",
    "bsd 3 clause": "bsd3-ref",
    "0bsd": "zero-bsd-ref",
    "isc": "isc-ref",
    "zlib": "zlib-ref",
    "unlicense": "unlicense-ref",
    "mpl 2 0": "mpl2-ref",
    "epl 1 0": "epl1-ref",
    "epl 2 0": "epl2-ref",
    "bsl 1 0": "bsl-ref",
    "cc0 1 0": "cc0-ref",
    "gpl 2 0": "gpl2-ref",
    "gpl 2 0 only": "gpl2-ref",
    "gpl 2 0 or later": "gpl2-ref",
    "gpl 3 0": "gpl3-ref",
    "gpl 3 0 only": "gpl3-ref",
    "gpl 3 0 or later": "gpl3-ref",
    "lgpl 2 1": "lgpl21-ref",
    "lgpl 2 1 only": "lgpl21-ref",
    "lgpl 2 1 or later": "lgpl21-ref",
    "lgpl 3 0": "lgpl3-ref",
    "lgpl 3 0 only": "lgpl3-ref",
    "lgpl 3 0 or later": "lgpl3-ref",
    "agpl 3 0": "agpl3-ref",
    "agpl 3 0 only": "agpl3-ref",
    "agpl 3 0 or later": "agpl3-ref",
    "cc by 4 0": "cc-by-ref",
    "cc by sa 4 0": "cc-by-sa-ref",
    "cc by nc 4 0": "cc-by-nc-ref",
}
SENTENCES |= {f"spdx license identifier {name}": identifier for name, identifier in SPDX.items()}
#: Words from which on a sentence is told by itself, wherever it begins.
LONG = 12


@dataclass(frozen=True)
class Rule:
    """``sentences`` must occur in this order; others may stand between them."""

    licence: str
    sentences: tuple[str, ...]

    def fits(self, ids: Column) -> Column:
        """Whether the identifiers hold the rule's in order: one walk that counts how many have been met, so linear in their number."""
        if len(self.sentences) == 1:
            return F.array_contains(ids, self.sentences[0])
        needs = F.array(*map(F.lit, self.sentences), F.lit(""))
        return F.aggregate(ids, F.lit(1), lambda met, x: met + (F.element_at(needs, met) == x).cast("int")) > len(self.sentences)


# The rules in the order in which they are tried; the first one that fits names the document's licence.
RULES = (
    Rule("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    Rule("Apache-2.0", ("apache-header", "apache-see")),
    Rule("Apache-2.0", ("apache-compliance", "apache-basis")),
    Rule("Apache-2.0", ("apache-header",)),
    Rule("ISC", ("isc-grant", "isc-as-is")),
    Rule("0BSD", ("zero-bsd-grant", "isc-as-is")),
    Rule("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    Rule("AGPL-3.0", ("agpl3-grant", "gpl-hope")),
    Rule("LGPL-3.0", ("lgpl3-grant", "gpl-hope")),
    Rule("LGPL-2.1", ("lgpl21-grant", "gpl-hope")),
    Rule("Unlicense", ("unlicense-release", "unlicense-anyone")),
    Rule("BSL-1.0", ("bsl-grant",)),
    Rule("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin")),
    Rule("EPL-2.0", ("epl2-terms",)),
    Rule("EPL-1.0", ("epl1-terms",)),
    Rule("CC0-1.0", ("cc0-waiver",)),
    Rule("GPL-3.0", ("gpl3-grant", "gpl-hope")),
    Rule("GPL-2.0", ("gpl2-grant", "gpl-hope")),
    Rule("AGPL-3.0", ("agpl3-ref",)),
    Rule("LGPL-3.0", ("lgpl3-ref",)),
    Rule("LGPL-2.1", ("lgpl21-ref",)),
    Rule("GPL-3.0", ("gpl3-ref",)),
    Rule("GPL-2.0", ("gpl2-ref",)),
    Rule("MPL-2.0", ("mpl2-ref",)),
    Rule("EPL-2.0", ("epl2-ref",)),
    Rule("ISC", ("isc-ref",)),
    Rule("0BSD", ("zero-bsd-ref",)),
    Rule("Zlib", ("zlib-ref",)),
    Rule("Unlicense", ("unlicense-ref",)),
    Rule("EPL-1.0", ("epl1-ref",)),
    Rule("BSD-3-Clause", ("bsd3-ref",)),
    Rule("BSD-2-Clause", ("bsd2-ref",)),
    Rule("BSL-1.0", ("bsl-ref",)),
    Rule("CC0-1.0", ("cc0-ref",)),
    Rule("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-ref",)),
    Rule("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-ref",)),
    Rule("CC-BY-ND-4.0", ("cc-by-nd-ref",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    Rule("CC-BY-4.0", ("cc-by-ref",)),
    Rule("Apache-2.0", ("apache-ref",)),
    Rule("MIT", ("mit-ref",)),
    Rule("Public-Domain", ("public-domain",)),
    Rule("All-Rights-Reserved", ("reserved",)),
)

#: Where a sentence may end or begin, besides line breaks.
BREAK = r"[.!?:;]+([ \t\r\f\n]|\z)|[\r\n]"


def stream(text: Column) -> Column:
    """The lower-cased text as words and marks, single blanks between them: ``| words of a line | more words |``."""
    marked = F.regexp_replace(F.replace(text, F.lit("|"), F.lit(" ")), BREAK, "|")
    words = F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9|]+", " "), r" ?\|[ |]*", " | ")
    return F.concat(F.lit("| "), F.ltrim(words), F.lit(" |"))


def known_sentences(words: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences in a stream, in order; of several that begin at one mark the longest."""
    longest_first = sorted(sentences, key=lambda s: (-len(s), s))
    any_of = lambda which: "|".join(s.replace(" ", r" (?:\| )?") for s in longest_first if (s.count(" ") + 1 >= LONG) == which) or r"\|{2}"
    pattern = rf"(?<= )(?:{any_of(True)})(?= *\|)|(?<=\| )(?:{any_of(False)})(?= *\|)"
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    return F.transform(F.regexp_extract_all(words, F.lit(pattern), F.lit(0)), lambda s: F.element_at(known, F.replace(s, F.lit("| "), F.lit(""))))


def scan_licences(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, licence, licences, sentence_ids, n_sentences.

    licence: that of the first rule that fits, else null; licences: all that fit, in the rules' order, joined by commas (empty: none); sentence_ids: the
    identifiers of known sentences in the order of the text; n_sentences: their number.  A null text is empty.  Whole texts of
    any length are scanned; repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.  Where
    known sentences begin alike, the longest counts; one within another is not counted apart.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    found = docs.select(F.col(id_col).alias("doc_id"), known_sentences(stream(text), sentences).alias("ids"))
    fits = [F.when(r.fits(F.col("ids")), F.lit(r.licence)) for r in rules]
    none = F.array().cast("array<string>")
    matched = found.withColumn("all", F.when(F.size("ids") > 0, F.array_distinct(F.array_compact(F.array(*fits)))).otherwise(none))
    return matched.select(
        "doc_id", F.when(F.size("all") > 0, F.col("all")[0]).alias("licence"), F.array_join("all", ",").alias("licences"), F.array_join("ids", ",").alias("sentence_ids"), F.size("ids").cast("long").alias("n_sentences")
    )


def oracle_sql(sentences: dict[str, str] = SENTENCES, rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB's SQL, another way: words with places, known sentences joined to the places where one may begin, rules by places."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sentences.items())
    ruled = ", ".join(f"({i}, {quoted(r.licence)}, {list(r.sentences)!r})" for i, r in enumerate(rules))
    return rf"""
        WITH RECURSIVE known AS (SELECT string_split(k, ' ') AS words, k AS sentence, id FROM (VALUES {known}) AS v(k, id)),
        rules AS (SELECT place, licence, needs FROM (VALUES {ruled}) AS v(place, licence, needs)),
        lower AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        pieces AS (
            SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '[.!?:;]+([ \t\r\f\n]|\z)|[\r\n]'), lambda p: regexp_extract_all(p, '[a-z0-9]+')), lambda p: len(p) > 0) AS p FROM lower
        ), shaped AS (
            SELECT doc_id, flatten(p) AS w, list_transform(p, lambda x: len(x)) AS n FROM pieces
        ), bounds AS (
            SELECT doc_id, w, list_transform(range(1, len(n) + 1), lambda i: CAST(list_sum(n[1:i]) AS BIGINT)) AS ends FROM shaped WHERE list_has_any(w, (SELECT list(DISTINCT words[1]) FROM known))
        ), starts AS (
            SELECT doc_id, w, ends, unnest(range(1, len(w) + 1)) AS pos FROM bounds
        ), hits AS (
            SELECT s.doc_id, s.pos, s.pos + len(k.words) - 1 AS until, k.id
            FROM starts AS s JOIN known AS k ON s.w[s.pos] = k.words[1] AND s.w[s.pos:s.pos + len(k.words) - 1] = k.words
            WHERE list_contains(s.ends, s.pos + len(k.words) - 1) AND (s.pos = 1 OR list_contains(s.ends, s.pos - 1) OR len(k.words) >= {LONG})
        ), kept AS (
            SELECT doc_id, pos, id FROM hits AS h
            WHERE NOT EXISTS (SELECT 1 FROM hits AS o WHERE o.doc_id = h.doc_id AND o.pos <= h.pos AND o.until >= h.until AND (o.pos < h.pos OR o.until > h.until))
        ), steps(doc_id, place, licence, needs, k, pos) AS (
            SELECT d.doc_id, place, licence, needs, 0, CAST(0 AS BIGINT) FROM (SELECT DISTINCT doc_id FROM kept) AS d, rules
            UNION ALL
            SELECT s.doc_id, s.place, s.licence, s.needs, s.k + 1, (SELECT min(h.pos) FROM kept AS h WHERE h.doc_id = s.doc_id AND h.id = s.needs[s.k + 1] AND h.pos > s.pos)
            FROM steps AS s WHERE s.k < len(s.needs) AND s.pos IS NOT NULL
        ), fit AS (
            SELECT doc_id, licence, min(place) AS place FROM steps WHERE k = len(needs) AND pos IS NOT NULL GROUP BY doc_id, licence
        ), named AS (
            SELECT doc_id, list(licence ORDER BY place) AS every FROM fit GROUP BY doc_id
        ), told AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM kept GROUP BY doc_id)
        SELECT d.doc_id, n.every[1] AS licence, coalesce(array_to_string(n.every, ','), '') AS licences, coalesce(array_to_string(t.ids, ','), '') AS sentence_ids, CAST(coalesce(len(t.ids), 0) AS BIGINT) AS n_sentences
        FROM documents AS d LEFT JOIN named AS n USING (doc_id) LEFT JOIN told AS t USING (doc_id)
    """
