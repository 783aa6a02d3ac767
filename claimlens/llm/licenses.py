"""License scans by sentence rules.

Sentences of a text are normalised (ASCII lower case, runs of other characters
than letters and digits become one space) and mapped to the ids of known license
sentences; the sequence of a text's ids is then matched against rules, each an
ordered list of ids that the sequence must hold in that order. A known sentence
begins and ends where a line, a clause or a sentence does, and may run over line
breaks (with marks of comments, like "#" or " * ") and clauses in between, but
not over the end of a sentence. Everything is a column expression: no join, no
shuffle, no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licenses and notices, normalised, by id.
SENTENCES: dict[int, str] = {
    1: "released under the mit license",
    2: "licensed under the apache license version 2 0",
    3: "this work is licensed under the gnu general public license version 3",
    4: "licensed under cc by nc 4 0",
    5: "licensed under the mit license",
    6: "licensed under cc by 4 0",
    7: "licensed under cc by sa 4 0",
    8: "this work is licensed under a creative commons attribution 4 0 international license",
    9: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    10: "spdx license identifier mit",
    11: "spdx license identifier apache 2 0",
    12: "spdx license identifier gpl 3 0 only",
    13: "spdx license identifier gpl 3 0 or later",
    14: "spdx license identifier bsd 3 clause",
    20: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    21: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    22: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    30: "you may not use this file except in compliance with the license",
    31: "you may obtain a copy of the license at",
    32: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    33: "see the license for the specific language governing permissions and limitations under the license",
    40: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    41: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    42: "you should have received a copy of the gnu general public license along with this program",
    50: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    51: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    52: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    53: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}
# Names of licenses that the sentences above know too, by the id of one of these.
NAMES: dict[int, tuple[str, ...]] = {
    5: ("mit license", "expat license"),
    2: ("apache license version 2 0", "apache license 2 0", "apache 2 0 license"),
    3: ("gnu general public license version 3", "gnu gpl version 3", "gpl 3 0", "gplv3"),
    4: ("creative commons attribution noncommercial 4 0 international license",),
    6: ("creative commons attribution 4 0 international license", "cc by 4 0 license"),
    7: ("creative commons attribution sharealike 4 0 international license", "cc by sa 4 0 license"),
    14: ("bsd 3 clause license", "new bsd license", "modified bsd license"),
}
# Identifiers and names of further licenses.
MORE: list[tuple[str, tuple[str, ...]]] = [
    ("BSD-2-Clause", ("bsd 2 clause license", "simplified bsd license")),
    ("0BSD", ("bsd zero clause license",)),
    ("ISC", ("isc license",)),
    ("Zlib", ("zlib license",)),
    ("BSL-1.0", ("boost software license version 1 0", "boost software license 1 0")),
    ("MPL-2.0", ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0")),
    ("MPL-1.1", ("mozilla public license version 1 1",)),
    ("GPL-2.0-only", ("gnu general public license version 2", "gplv2")),
    ("GPL-2.0-or-later", ("gnu general public license version 2 or later",)),
    ("LGPL-2.1-only", ("gnu lesser general public license version 2 1",)),
    ("LGPL-2.1-or-later", ("gnu lesser general public license version 2 1 or later",)),
    ("LGPL-3.0-only", ("gnu lesser general public license version 3", "lgplv3")),
    ("LGPL-3.0-or-later", ("gnu lesser general public license version 3 or later",)),
    ("AGPL-3.0-only", ("gnu affero general public license version 3", "agplv3")),
    ("AGPL-3.0-or-later", ("gnu affero general public license version 3 or later",)),
    ("EPL-1.0", ("eclipse public license version 1 0",)),
    ("EPL-2.0", ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v 2 0")),
    ("CDDL-1.0", ("common development and distribution license version 1 0",)),
    ("EUPL-1.2", ("european union public licence version 1 2", "eupl v1 2")),
    ("Artistic-2.0", ("artistic license 2 0",)),
    ("Unlicense", ("unlicense",)),
    ("WTFPL", ("do what the fuck you want to public license",)),
    ("CC0-1.0", ("cc0 1 0 universal public domain dedication", "cc0 1 0 license", "creative commons zero v1 0 universal license")),
    ("CC-BY-3.0", ("creative commons attribution 3 0 unported license", "creative commons attribution 3 0 license")),
    ("CC-BY-SA-3.0", ("creative commons attribution sharealike 3 0 unported license", "creative commons attribution sharealike 3 0 license")),
    ("CC-BY-ND-4.0", ("creative commons attribution noderivatives 4 0 international license",)),
    ("CC-BY-NC-SA-4.0", ("creative commons attribution noncommercial sharealike 4 0 international license",)),
    ("CC-BY-NC-ND-4.0", ("creative commons attribution noncommercial noderivatives 4 0 international license",)),
    ("ODbL-1.0", ("open database license v1 0", "open data commons open database license")),
    ("PDDL-1.0", ("open data commons public domain dedication and license",)),
    ("OFL-1.1", ("sil open font license version 1 1", "sil open font license 1 1")),
    ("Python-2.0", ("python software foundation license version 2",)),
    ("PostgreSQL", ("postgresql license",)),
    ("PHP-3.01", ("php license version 3 01",)),
    ("Ruby", ("ruby license",)),
    ("OpenSSL", ("openssl license",)),
    ("Apache-1.1", ("apache software license version 1 1",)),
    ("MS-PL", ("microsoft public license",)),
]
# Sentences that name a license, {} being its name.
NAMING = (
    "licensed under the {}", "licensed under {}", "released under the {}", "distributed under the {}", "available under the {}", "published under the {}",
    "this work is licensed under the {}", "this work is licensed under a {}", "this file is licensed under the {}", "this project is licensed under the {}",
    "this software is licensed under the {}", "this library is licensed under the {}", "this code is licensed under the {}", "this program is licensed under the {}",
    "this project is licensed under the terms of the {}", "licensed under the terms of the {}", "released under the terms of the {}", "distributed under the terms of the {}",
)
#: Ids of sentences that name the licenses of MORE, in their order, start here.
FIRST = 1000


def forms() -> dict[str, int]:
    """All known sentences, normalised: SENTENCES, and by rule those that name a license."""
    out = {x: i for i, x in SENTENCES.items()} | {"licensed under the apache license version 2 0 the license": 2}
    for i, names in NAMES.items():
        for name in names:
            for naming in NAMING:
                out.setdefault(naming.format(name), i)
    for k, (spdx, names) in enumerate(MORE):
        out.setdefault("spdx license identifier " + "".join(c if c.isalnum() else " " for c in spdx.lower()), FIRST + k)
        for name in names:
            for naming in NAMING:
                out.setdefault(naming.format(name), FIRST + k)
    return out


# Each known sentence holds one of these.
KEYWORDS = ("licens", "permission", "copyright", "warrant", "redistribut", "free software", "gpl", "eupl", "licenc", "cc0")
# Rules in order: license and the ids that must follow one another, gaps allowed.
RULES: list[tuple[str, tuple[int, ...]]] = [
    ("MIT-text", (20, 21, 22)),
    ("Apache-2.0-header", (2, 30, 31, 32, 33)),
    ("GPL-3.0-header", (40, 41, 42)),
    ("BSD-3-Clause-text", (50, 51, 52, 53)),
    ("BSD-2-Clause-text", (50, 51, 52)),
    ("MIT", (1,)),
    ("MIT", (5,)),
    ("MIT", (10,)),
    ("Apache-2.0", (2,)),
    ("Apache-2.0", (11,)),
    ("GPL-3.0", (3,)),
    ("GPL-3.0", (12,)),
    ("GPL-3.0", (13,)),
    ("CC-BY-NC-4.0", (4,)),
    ("CC-BY-NC-4.0", (9,)),
    ("CC-BY-4.0", (6,)),
    ("CC-BY-4.0", (8,)),
    ("CC-BY-SA-4.0", (7,)),
    ("BSD-3-Clause", (14,)),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends of sentences, and of lines and clauses, over which a sentence may go on.
_STOPS, _SOFT = "[.!?]+[ \\t\\r\\n]+", "[:;]+[ \\t]+|[\\r\\n]+"
#: In the oracle, which knows sentences within one line and clause only: all of these.
_ENDS = "[.:;!?]+[ \\t]+|[\\r\\n]+"


def sentence_ids(text: Column) -> Column:
    """Ids of the known sentences of a text, in order; null if it holds no keyword."""
    low = F.translate(text, _UPPER, _LOWER)
    likely = F.lit(False)
    for word in KEYWORDS:
        likely = likely | F.contains(low, F.lit(word))
    known = F.map_from_arrays(F.split(F.lit("|".join(forms())), "[|]"), F.split(F.lit("|".join(map(str, forms().values()))), "[|]").cast("array<int>"))

    def clauses(sentence: Column) -> Column:
        clean = F.transform(F.split(sentence, _SOFT), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
        return F.array_join(F.filter(clean, lambda s: s != ""), " | ")

    # "| clause | clause |. | clause |": a known sentence stands between bars, and may hold some
    marked = F.concat(F.lit("| "), F.array_join(F.transform(F.split(low, _STOPS), clauses), " |. | "), F.lit(" |"))
    # what names a license is one of NAMING with one of the names
    names = [name for _, some in (*NAMES.items(), *MORE) for name in some]
    rest = [x for x in forms() if not any(x == naming.format(name) for naming in NAMING for name in names)]

    def any_of(some: list[str]) -> str:
        return "|".join(sorted(some, key=len, reverse=True))

    any_known = rf"{any_of(rest)}|(?:{any_of([x.removesuffix(' {}') for x in NAMING])}) (?:{any_of(names)})".replace(" ", r"(?: \|)? ")
    found = F.regexp_extract_all(marked, F.lit(rf"(?<=\| )(?:{any_known})(?= \|)"), F.lit(0))
    return F.when(likely, F.transform(found, lambda s: known[F.replace(s, F.lit(" |"), F.lit(""))]))


def _holds(sequence: str, ids: tuple[int, ...]) -> str:
    """SQL, in Spark as in DuckDB: the sequence `,1,,2,` holds the ids in this order."""
    return f"coalesce({sequence}, '') LIKE '%{'%'.join(f',{i},' for i in ids)}%'"


def _matches(sequence: str) -> str:
    """SQL for the licenses whose rules match, by rule order, each once, joined by a comma.
    A license's text or header stands for its name as well."""
    names = list(dict.fromkeys(n for n, _ in RULES))
    parts = [f"CASE WHEN {' OR '.join(_holds(sequence, ids) for n, ids in RULES if n == name)} THEN '{name}' END" for name in names]
    return f"concat_ws(',', {', '.join(parts)}, named)"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_known (license sentences), sentence_ids (joined by a
    comma, in the order of the text) and licenses (joined by a comma, in the order of RULES and
    MORE). Null and empty texts have none: 0 and empty strings. Texts may be of any length; rows
    that repeat are rows of their own; an empty table gives no rows. Other columns are left out."""
    ids = docs.select(F.col(id_col), sentence_ids(F.col(text_col).cast("string")).alias("ids"))
    # further licenses in the order of MORE; null, if there are none
    further = F.array_sort(F.array_distinct(F.transform(F.filter("ids", lambda i: i >= FIRST), lambda i: i - FIRST)))
    names = F.split(F.lit(",".join(n for n, _ in MORE)), ",")
    named = F.when(F.size(further) > 0, F.array_join(F.transform(further, lambda i: F.get(names, i)), ","))
    flat = ids.select(id_col, named.alias("named"), F.coalesce(F.size("ids"), F.lit(0)).alias("n"), F.array_join(F.transform("ids", lambda i: F.concat(F.lit(","), i.cast("string"), F.lit(","))), "").alias("sequence"))
    return flat.select(
        id_col,
        F.greatest(F.col("n"), F.lit(0)).cast("long").alias("n_known"),
        F.trim(F.regexp_replace(F.coalesce("sequence", F.lit("")), ",+", " ")).alias("sentence_ids"),
        F.expr(_matches("sequence")).alias("licenses"),
    ).withColumn("sentence_ids", F.replace("sentence_ids", F.lit(" "), F.lit(",")))


def oracle() -> str:
    """For DuckDB, over documents whose known sentences each stand in one line and clause."""
    keys = " OR ".join(f"contains(low, '{w}')" for w in KEYWORDS)
    known = ", ".join(f"'{s}': {i}" for s, i in forms().items())
    some = ", ".join(f"'{s}'" for s in forms())
    names = ", ".join(f"'{n}'" for n, _ in MORE)
    further = f"list_sort(list_distinct(list_transform(list_filter(ids, lambda i: i >= {FIRST}), lambda i: i - {FIRST})))"
    return f"""
    WITH low AS (SELECT doc_id, translate(text, '{_UPPER}', '{_LOWER}') AS low FROM documents),
    clean AS (SELECT doc_id, CASE WHEN {keys} THEN list_transform(regexp_split_to_array(low, '{_ENDS}'),
        lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))) END AS ss FROM low),
    ids AS (SELECT doc_id, list_transform(list_filter(ss, lambda s: s IN ({some})), lambda s: MAP {{{known}}}[s]) AS ids FROM clean),
    flat AS (SELECT doc_id, coalesce(len(ids), 0) AS n_known, array_to_string(ids, ',') AS joined,
        array_to_string(list_transform(ids, lambda i: ',' || i || ','), '') AS sequence,
        CASE WHEN len({further}) > 0 THEN array_to_string(list_transform({further}, lambda i: ([{names}])[i + 1]), ',') END AS named FROM ids)
    SELECT doc_id, n_known::BIGINT AS n_known, coalesce(joined, '') AS sentence_ids, {_matches('sequence')} AS licenses FROM flat
    """
