"""Licences named in texts, by sentence rules.

A text is cut into sentences, each is put into a normal form, and a known form has an identifier. The identifiers in a
document, in order, are matched against rules: runs of sentences that make up a licence. Longer, more telling runs come
first, and what a rule has matched is taken, so that a general rule does not count the same sentences again.

Everything is a column expression over one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmetrics.functions.once import let

# Sentences of well-known licences and notices in normal form, with their identifiers.
SENTENCES = {
    "released under the mit license": "MitName",
    "licensed under the mit license": "MitName",
    "this project is licensed under the mit license": "MitName",
    "the mit license": "MitTitle",
    "mit license": "MitTitle",
    "spdx license identifier mit": "MitName",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitAsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiable",
    "licensed under the apache license version 2 0": "Apache2Name",
    "licensed under the apache license version 2 0 the license": "Apache2Name",
    "spdx license identifier apache 2 0": "Apache2Name",
    "you may not use this file except in compliance with the license": "Apache2Comply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "Apache2Copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "Apache2AsIs",
    "see the license for the specific language governing permissions and limitations under the license": "Apache2See",
    "this work is licensed under the gnu general public license version 2": "Gpl2Name",
    "this work is licensed under the gnu general public license version 3": "Gpl3Name",
    "this program is licensed under the gnu general public license version 2": "Gpl2Name",
    "this program is licensed under the gnu general public license version 3": "Gpl3Name",
    "spdx license identifier gpl 2 0 only": "Gpl2Name",
    "spdx license identifier gpl 3 0 only": "Gpl3Name",
    "spdx license identifier gpl 2 0 or later": "Gpl2OrLater",
    "spdx license identifier gpl 3 0 or later": "Gpl3OrLater",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2OrLater",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3OrLater",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplNoWarranty",
    "see the gnu general public license for more details": "GplSee",
    "you should have received a copy of the gnu general public license along with this program": "GplCopy",
    "this work is licensed under the gnu lesser general public license version 2 1": "Lgpl21Name",
    "this work is licensed under the gnu lesser general public license version 3": "Lgpl3Name",
    "this work is licensed under the gnu affero general public license version 3": "Agpl3Name",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "licensed under the bsd 2 clause license": "Bsd2Name",
    "licensed under the bsd 3 clause license": "Bsd3Name",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "Mpl2Copy",
    "licensed under cc by 4 0": "CcBy4",
    "licensed under cc by sa 4 0": "CcBySa4",
    "licensed under cc by nc 4 0": "CcByNc4",
    "licensed under cc by nd 4 0": "CcByNd4",
    "licensed under cc by nc sa 4 0": "CcByNcSa4",
    "licensed under cc by nc nd 4 0": "CcByNcNd4",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CcBySa4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CcByNc4",
    "released under cc0 1 0": "Cc0",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "this work is in the public domain": "PublicDomain",
    "all rights reserved": "AllRights",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscAsIs",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "IscLiable",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3OrLater",
    "see the gnu affero general public license for more details": "AgplSee",
    "you should have received a copy of the gnu affero general public license along with this program": "AgplCopy",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "Lgpl21OrLater",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3OrLater",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "LgplNoWarranty",
    "see the gnu lesser general public license for more details": "LgplSee",
    "you should have received a copy of the gnu lesser general public license along with this library": "LgplCopy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "Epl2Terms",
    "spdx license identifier bsd 2 clause": "Bsd2Name",
    "spdx license identifier bsd 3 clause": "Bsd3Name",
    "spdx license identifier isc": "IscName",
    "spdx license identifier mpl 2 0": "Mpl2Name",
    "spdx license identifier epl 2 0": "Epl2Name",
    "spdx license identifier lgpl 2 1 or later": "Lgpl21OrLater",
    "spdx license identifier lgpl 3 0 or later": "Lgpl3OrLater",
    "spdx license identifier agpl 3 0 only": "Agpl3Name",
    "spdx license identifier agpl 3 0 or later": "Agpl3OrLater",
}

# Sentences in which licences leave a place for names, shown by a star, which stands for one to SLOT_WORDS words.
SLOTTED = {
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "neither the name of * nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdAsIs",
    "in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BsdLiable",
    "in no event shall * be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiable",
}
SLOT_WORDS = 12

# Licences and the runs of identifiers that make them up, in the order of trying.
RULES = [
    ("MIT", "MitTitle MitGrant MitNotice MitAsIs MitLiable"),
    ("MIT", "MitGrant MitNotice MitAsIs MitLiable"),
    ("MIT", "MitGrant MitNotice"),
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdEndorse BsdAsIs BsdLiable"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary BsdAsIs BsdLiable"),
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdEndorse"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary"),
    ("Apache-2.0", "Apache2Name Apache2Comply Apache2Copy Apache2AsIs Apache2See"),
    ("GPL-2.0-or-later", "Gpl2OrLater GplNoWarranty GplSee GplCopy"),
    ("GPL-3.0-or-later", "Gpl3OrLater GplNoWarranty GplSee GplCopy"),
    ("GPL-2.0-or-later", "Gpl2OrLater GplNoWarranty GplSee"),
    ("GPL-3.0-or-later", "Gpl3OrLater GplNoWarranty GplSee"),
    ("AGPL-3.0-or-later", "Agpl3OrLater GplNoWarranty AgplSee AgplCopy"),
    ("AGPL-3.0-or-later", "Agpl3OrLater GplNoWarranty AgplSee"),
    ("LGPL-2.1-or-later", "Lgpl21OrLater LgplNoWarranty LgplSee LgplCopy"),
    ("LGPL-3.0-or-later", "Lgpl3OrLater LgplNoWarranty LgplSee LgplCopy"),
    ("LGPL-2.1-or-later", "Lgpl21OrLater LgplNoWarranty LgplSee"),
    ("LGPL-3.0-or-later", "Lgpl3OrLater LgplNoWarranty LgplSee"),
    ("ISC", "IscGrant IscAsIs IscLiable"),
    ("MPL-2.0", "Mpl2Terms Mpl2Copy"),
    ("MIT", "MitTitle MitName"),
    ("MIT", "MitName"),
    ("MIT", "MitTitle"),
    ("Apache-2.0", "Apache2Name"),
    ("GPL-2.0-or-later", "Gpl2OrLater"),
    ("GPL-3.0-or-later", "Gpl3OrLater"),
    ("GPL-2.0-only", "Gpl2Name"),
    ("GPL-3.0-only", "Gpl3Name"),
    ("LGPL-2.1-only", "Lgpl21Name"),
    ("LGPL-3.0-only", "Lgpl3Name"),
    ("AGPL-3.0-only", "Agpl3Name"),
    ("BSD-2-Clause", "Bsd2Name"),
    ("BSD-3-Clause", "Bsd3Name"),
    ("ISC", "IscGrant"),
    ("ISC", "IscName"),
    ("MPL-2.0", "Mpl2Terms"),
    ("MPL-2.0", "Mpl2Name"),
    ("EPL-2.0", "Epl2Terms"),
    ("EPL-2.0", "Epl2Name"),
    ("AGPL-3.0-or-later", "Agpl3OrLater"),
    ("LGPL-2.1-or-later", "Lgpl21OrLater"),
    ("LGPL-3.0-or-later", "Lgpl3OrLater"),
    ("CC-BY-4.0", "CcBy4"),
    ("CC-BY-SA-4.0", "CcBySa4"),
    ("CC-BY-NC-4.0", "CcByNc4"),
    ("CC-BY-ND-4.0", "CcByNd4"),
    ("CC-BY-NC-SA-4.0", "CcByNcSa4"),
    ("CC-BY-NC-ND-4.0", "CcByNcNd4"),
    ("CC0-1.0", "Cc0"),
    ("Unlicense", "Unlicense"),
    ("public-domain", "PublicDomain"),
]

#: In a normal form, what makes a sentence a licence sentence although it is not known.
HINTS = ("licens", "warrant", "redistribut", "copyright notice")
_HINT = "|".join(HINTS)
#: Line ends; a blank after a full stop becomes one.
_ENDS, _CUT = r"([.!?])[ \t\f\r\x0B]+", "\n"
#: What may stand between two words of a wrapped sentence: a single line feed with comment marks about it, but no sentence end.
_BLANKS = r"[^A-Za-z0-9\n.!?]*+(?:[.!?](?![ \t\f\r\x0B\n])[^A-Za-z0-9\n.!?]*+){0,8}+"
_GAP = rf"(?=[^A-Za-z0-9]){_BLANKS}(?:\n{_BLANKS})?+"
#: Gaps that are freer: 'v. 2.0' has no sentence end, and a blank line stands before the address of the Apache licence.
_GAPS = {("v", "2"): r"[^A-Za-z0-9\n]*+\n?+[^A-Za-z0-9\n]*+(?<=[^A-Za-z0-9])", ("at", "http"): r"[^A-Za-z0-9]++"}
#: Where a known sentence may begin, after marks of comments and lists, and what may follow it.
_BEFORE = r"(?:^|(?<=\n)|(?<=[.!?;][ \t\f\r\x0B]))[^A-Za-z0-9\n]*+(?:[A-Za-z0-9]{1,3}\)[ \t]++)?+"
_AFTER = r"(?![A-Za-z0-9])(?=[^A-Za-z0-9\n.!?;]*+(?:\n|\z|;|[.!?]+[^A-Za-z0-9\s]*+(?:\s|\z)))"


#: After a word of a name, which may end in a full stop, as 'Inc.' does.
_NAME_GAP = r"[^A-Za-z0-9\n]*+\n?+[^A-Za-z0-9\n]*+(?<=[^A-Za-z0-9])"


def _wrapped(sentence: str) -> str:
    if "*" in sentence:
        before, after = map(str.strip, sentence.split("*"))
        return f"{_wrapped(before)}{_GAP}(?:[A-Za-z0-9]++{_NAME_GAP}){{1,{SLOT_WORDS}}}?{_wrapped(after)}"
    words = sentence.split()
    return words[0] + "".join(_GAPS.get(pair, _GAP) + pair[1] for pair in zip(words, words[1:], strict=False))


def _slotted(sentence: str) -> str:
    """A pattern for the normal forms of a sentence with a place for names."""
    return f"^{sentence.replace('* ', f'([a-z0-9]+ ){{1,{SLOT_WORDS}}}')}$"


_KNOWN = f"(?i){_BEFORE}({'|'.join(_wrapped(s) for s in sorted([*SENTENCES, *SLOTTED], key=len, reverse=True))}){_AFTER}"


def normal_form(sentence: Column) -> Column:
    """Lower-case ASCII letters and digits, with a blank for each run of anything else; none at either end."""
    return F.trim(F.lower(F.regexp_replace(sentence, "[^A-Za-z0-9]+", " ")))


def _name_of(form: Column) -> Column:
    """The identifier of a sentence in normal form; empty for one that is not known."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    slotted = F.lit("")
    for sentence, name in SLOTTED.items():
        slotted = F.when(form.rlike(_slotted(sentence)), F.lit(name)).otherwise(slotted)
    return F.coalesce(F.element_at(known, form), slotted)


def _parts(text: Column) -> Column:
    """The sentences of a text. A known sentence is one whole, also where it is wrapped or ends at a semicolon; all else is cut at line ends."""
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\x01\x02", "  "), _KNOWN, "\x01\x02$1\x01")
    cut = lambda p: F.when(p.startswith("\x02"), F.array(p)).otherwise(F.split(F.regexp_replace(p, _ENDS, "$1\n"), _CUT))
    return F.flatten(F.transform(F.split(marked, "\x01"), cut))


def license_columns(text: Column) -> Column:
    """A struct for a text: `sentences`, the identifiers of the known sentences in order; `licenses`, the licences in the order of
    the rules, without repeats; `n_matches`, how often rules matched; `n_unmatched`, known sentences that no rule took;
    `n_unknown`, sentences about licensing that are not known. Null and empty texts have empty arrays and zeros.
    """
    forms = F.transform(_parts(text), normal_form)
    # Sentences without a hint need no look-up: but for a few, all known ones have one.
    telling = F.filter(forms, lambda s: s.rlike(_PROBE))
    named = F.transform(telling, lambda s: F.struct(_name_of(s).alias("name"), s.rlike(_HINT).alias("hint")))
    return let(named, _resolve)


def _resolve(found: Column) -> Column:
    sentences = F.filter(F.transform(found, lambda s: s["name"]), lambda n: n != "")
    unknown = F.size(F.filter(found, lambda s: (s["name"] == "") & s["hint"]))
    none = F.struct(F.lit("").alias("rest"), F.array().cast("array<struct<license:string,n:int>>").alias("hits"))
    taken = F.when(F.size(sentences) == 0, none).otherwise(let(sentences, _match))
    return let(
        taken,
        lambda t: F.struct(
            sentences.alias("sentences"),
            F.array_distinct(F.transform(t["hits"], lambda h: h["license"])).alias("licenses"),
            F.aggregate(t["hits"], F.lit(0), lambda n, h: n + h["n"]).alias("n_matches"),
            F.size(F.filter(F.split(t["rest"], " "), lambda n: (n != "") & (n != "*"))).alias("n_unmatched"),
            unknown.alias("n_unknown"),
        ),
    )


def _match(sentences: Column) -> Column:
    """What the rules leave of the sequence, with a star for each match; and each rule's licence with its number of matches."""
    rules = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(f" {run.replace(' ', '  ')} ").alias("run")) for name, run in RULES])
    whole = F.concat(F.lit(" "), F.array_join(sentences, "  "), F.lit(" "))
    start = F.struct(whole.alias("rest"), F.array().cast("array<struct<license:string,n:int>>").alias("hits"))

    def step(state: Column, rule: Column) -> Column:
        left = F.replace(state["rest"], rule["run"], F.lit(" * "))
        n = ((F.length(state["rest"]) - F.length(left)) / (F.length(rule["run"]) - 3)).cast("int")
        hit = F.array(F.struct(rule["license"].alias("license"), n.alias("n")))
        return F.when(F.contains(state["rest"], rule["run"]), F.struct(left.alias("rest"), F.concat(state["hits"], hit).alias("hits"))).otherwise(state)

    return F.aggregate(rules, start, step)


#: Known sentences have a hint or one of these words.
_OTHERS = sorted({next(w for w in s.split() if len(w) > 4) for s in [*SENTENCES, *SLOTTED] if not any(h in s for h in HINTS)})
_PROBE = "|".join([*HINTS, *_OTHERS])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id and what `license_columns` finds in the whole text."""
    return docs.select(F.col(key).alias("doc_id"), license_columns(docs[text]).alias("found")).select("doc_id", "found.*")


def check_sql() -> str:
    """DuckDB SQL for what op4_licenses returns on texts whose known sentences are not wrapped."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    names = ", ".join(f"({quote(s)}, {quote(n)})" for s, n in (SENTENCES | SLOTTED).items())
    slots = " ".join(f"WHEN regexp_matches(form, {quote(_slotted(s))}) THEN {quote(s)}" for s in SLOTTED)
    steps, rest, counts = [], "s0", []
    for i, (_, run) in enumerate(RULES, 1):
        needle = quote(f" {run.replace(' ', '  ')} ")
        steps.append(f"r{i} AS (SELECT *, replace({rest}, {needle}, ' * ') AS s{i}, (length({rest}) - length(replace({rest}, {needle}, ' * '))) // {len(run.replace(' ', '  ')) - 1} AS n{i} FROM r{i - 1})")
        rest = f"s{i}"
        counts.append(f"n{i}")
    hits = ", ".join(f"CASE WHEN n{i} > 0 THEN {quote(name)} END" for i, (name, _) in enumerate(RULES, 1))
    return f"""
WITH known(form, name) AS (VALUES {names}),
cut AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\f\\r\\x0B]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents
),
plain AS (SELECT r, generate_subscripts(parts, 1) AS nth, trim(lower(regexp_replace(unnest(parts), '[^A-Za-z0-9]+', ' ', 'g'))) AS form FROM cut),
forms AS (SELECT r, nth, CASE {slots} ELSE form END AS form FROM plain),
seen AS (
  SELECT r, list(name ORDER BY nth) FILTER (name IS NOT NULL) AS names, count(*) FILTER (name IS NULL AND regexp_matches(form, {quote(_HINT)})) AS n_unknown
  FROM forms LEFT JOIN known USING (form) GROUP BY r
),
r0 AS (SELECT doc_id, coalesce(names, []) AS sentences, n_unknown, CASE WHEN names IS NULL THEN '' ELSE ' ' || array_to_string(names, '  ') || ' ' END AS s0 FROM cut JOIN seen USING (r)),
{", ".join(steps)}
SELECT doc_id, array_to_string(sentences, ' ') AS sentences,
  array_to_string([x FOR x, i IN [{hits}] IF x IS NOT NULL AND list_position([{hits}], x) = i], ' ') AS licenses,
  CAST({" + ".join(counts)} AS INTEGER) AS n_matches,
  CAST(len([x FOR x IN string_split({rest}, ' ') IF x <> '' AND x <> '*']) AS INTEGER) AS n_unmatched,
  CAST(n_unknown AS INTEGER) AS n_unknown
FROM r{len(RULES)}
"""
