"""Licence scans by sentence rules; built-in functions only.

A text is normalised to lower-case words, in which single line ends and comment markers are white
space.  Sentences end at empty lines and after ``.``, ``!`` and ``?`` before white space, but not
after an abbreviation.  Each sentence is mapped to the identifiers of the licence sentences that it
states; names of holders, years and words around them do not matter, and a reference that is denied
("not licensed under ...") states nothing.  The identifiers of a text, in order, make its sequence,
against which each licence's rules, ordered runs of identifiers, are matched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _version(major: int, minor: str = "0", needed: bool = False) -> str:
    return rf"(version |ver |v)?( ?v )?{major}( {minor})" + ("" if needed or minor != "0" else "?")


_PUBLISHED = r"( as published by the free software foundation)?( either)? ?"
_GNU = r"(the )?(gnu )?"
_CC = r"(cc|creative commons)"


def _cc(words: str, letters: str, version: int) -> str:
    return rf"{_CC} ({letters}|{words})( license)?( version)? {version} 0"


#: Names by which references call a licence (a pattern of normalised words), and its
#: own short name in words.
NAMES = {
    "0BSD": (r"(bsd zero clause|zero clause bsd|0bsd) license", "0bsd"),
    "AFL-3.0": (rf"academic free license {_version(3)}", "afl 3 0"),
    "AGPL-3.0": (rf"{_GNU}(affero general public license|agpl) ?{_PUBLISHED}{_version(3)}", "agpl 3 0"),
    "Apache-1.1": (rf"apache( software)? license {_version(1, '1')}", "apache 1 1"),
    "Apache-2.0": (rf"apache( software| public)?( license)? ?{_version(2)}", "apache 2 0"),
    "Artistic-2.0": (rf"artistic license {_version(2)}", "artistic 2 0"),
    "BSD-1-Clause": (r"(bsd (1|one) clause|(1|one) clause bsd)( license)?", "bsd 1 clause"),
    "BSD-2-Clause": (r"((simplified|freebsd) bsd|freebsd|simplified|bsd (2|two) clause|(2|two) clause bsd)( license)?", "bsd 2 clause"),
    "BSD-3-Clause": (r"((new|modified|revised) bsd|bsd (3|three) clause|(3|three) clause bsd)( license)?", "bsd 3 clause"),
    "BSL-1.0": (rf"boost software license ?{_version(1)}", "bsl 1 0"),
    "CC-BY-3.0": (_cc("attribution", "by", 3), "cc by 3 0"),
    "CC-BY-4.0": (rf"({_cc('attribution', 'by', 4)}|{_CC} attribution 4 0 international license)", "cc by 4 0"),
    "CC-BY-NC-4.0": (_cc("attribution non ?commercial", "by nc", 4), "cc by nc 4 0"),
    "CC-BY-NC-ND-4.0": (_cc("attribution non ?commercial no ?deriv(ative)?s", "by nc nd", 4), "cc by nc nd 4 0"),
    "CC-BY-NC-SA-4.0": (_cc("attribution non ?commercial share ?alike", "by nc sa", 4), "cc by nc sa 4 0"),
    "CC-BY-ND-4.0": (_cc("attribution no ?deriv(ative)?s", "by nd", 4), "cc by nd 4 0"),
    "CC-BY-SA-3.0": (_cc("attribution share ?alike", "by sa", 3), "cc by sa 3 0"),
    "CC-BY-SA-4.0": (_cc("attribution share ?alike", "by sa", 4), "cc by sa 4 0"),
    "CC0-1.0": (r"(creative commons )?(cc0|zero)( universal)?( license)? ?(v|version )?1 0", "cc0 1 0"),
    "CDDL-1.0": (rf"(common development and distribution license|cddl)( cddl)? ?{_version(1)}", "cddl 1 0"),
    "EPL-1.0": (rf"(eclipse public license|epl) ?{_version(1)}", "epl 1 0"),
    "EPL-2.0": (rf"(eclipse public license|epl) ?{_version(2)}", "epl 2 0"),
    "EUPL-1.2": (rf"(european union public licen[cs]e|eupl) ?{_version(1, '2')}", "eupl 1 2"),
    "GPL-2.0": (rf"{_GNU}(general public license|gpl) ?{_PUBLISHED}{_version(2)}", "gpl 2 0"),
    "GPL-3.0": (rf"{_GNU}(general public license|gpl) ?{_PUBLISHED}{_version(3)}", "gpl 3 0"),
    "ISC": (r"isc license", "isc"),
    "LGPL-2.1": (rf"{_GNU}(lesser general public license|lgpl) ?{_PUBLISHED}{_version(2, '1')}", "lgpl 2 1"),
    "LGPL-3.0": (rf"{_GNU}(lesser general public license|lgpl) ?{_PUBLISHED}{_version(3)}", "lgpl 3 0"),
    "MIT": (r"(mit|mit x11|expat) license", "mit"),
    "MIT-0": (r"(mit no attribution|mit 0)( license)?", "mit 0"),
    "MPL-1.1": (rf"(mozilla public license|mpl) ?{_version(1, '1')}", "mpl 1 1"),
    "MPL-2.0": (rf"(mozilla public license|mpl) ?{_version(2)}", "mpl 2 0"),
    "MS-PL": (r"(microsoft public license|ms pl)", "ms pl"),
    "NCSA": (r"(university of illinois )?ncsa( open source)? license", "ncsa"),
    "ODbL-1.0": (r"(open (data commons open )?database license|odbl)( odbl)?( v?1 0)?", "odbl 1 0"),
    "OFL-1.1": (rf"(sil )?open font license ?{_version(1, '1')}", "ofl 1 1"),
    "OSL-3.0": (rf"open software license ?{_version(3)}", "osl 3 0"),
    "PostgreSQL": (r"postgresql license", "postgresql"),
    "Python-2.0": (r"(python|psf)( software foundation)? license( version 2)?", "python 2 0"),
    "UPL-1.0": (r"universal permissive license( upl)?( (version |v)?1 0)?", "upl 1 0"),
    "Unlicense": (r"unlicense", "unlicense"),
    "WTFPL": (r"(wtfpl|do what the fuck you want to public license)", "wtfpl"),
    "Zlib": (r"zlib( libpng)? license", "zlib"),
}
#: Identifiers of sentences of licence texts and grants, as patterns of normalised words.
SENTENCES = {
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "apache2-title": "apache license version 2 0 january 2004",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "as-is": "the software is provided as is without warranty of any kind",
    "bsd-redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "names of its contributors may be used to endorse or promote products derived from this software",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "cc0-waiver": "to the extent possible under law the (author|affirmer|person who associated cc0 with this work)s?( has| have)? waived all copyright and related or neighboring rights to this work",
    "epl2-title": "eclipse public license v 2 0",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-free": "under the terms of the gnu general public license as published by the free software foundation (either )?version 2( of the license)?",
    "gpl3-free": "under the terms of the gnu general public license as published by the free software foundation (either )?version 3( of the license)?",
    "isc-grant": "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted $",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so $",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl2-title": "mozilla public license version 2 0 1 definitions",
    "ofl-title": "sil open font license version 1 1 26 february 2007",
    "postgres-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",
    "reserved": "all rights reserved",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "wtfpl-title": "do what the fuck you want to public license( version 2)?",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
}
#: The ordered runs of sentence identifiers that show a licence, beside a reference to it.
TEXTS = {
    "0BSD": [["0bsd-grant"]],
    "AGPL-3.0": [["agpl3-title"]],
    "Apache-2.0": [["apache2-title"], ["apache2-comply", "apache2-copy"]],
    "BSD-1-Clause": [["bsd-redist", "bsd-source"]],
    "BSD-2-Clause": [["bsd-redist", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-redist", "bsd-source", "bsd-binary", "bsd-name"]],
    "BSL-1.0": [["bsl-grant"]],
    "CC0-1.0": [["cc0-waiver"]],
    "EPL-2.0": [["epl2-title"]],
    "GPL-2.0": [["gpl2-title"], ["gpl2-free"]],
    "GPL-3.0": [["gpl3-title"], ["gpl3-free"]],
    "ISC": [["isc-grant"]],
    "LGPL-2.1": [["lgpl21-title"]],
    "LGPL-3.0": [["lgpl3-title"]],
    "MIT": [["mit-grant", "mit-notice"]],
    "MIT-0": [["mit0-grant"]],
    "MPL-2.0": [["mpl2-title"]],
    "OFL-1.1": [["ofl-title"]],
    "PostgreSQL": [["postgres-grant"]],
    "Unlicense": [["unlicense-free"]],
    "WTFPL": [["wtfpl-title"]],
    "Zlib": [["zlib-grant"]],
}
#: Licences whose text is the start of a longer one's.
LONGER = {"BSD-1-Clause": "BSD-2-Clause", "BSD-2-Clause": "BSD-3-Clause"}
#: Shown only if no licence is.
ALONE = "Proprietary"

_VERB = r"(licen[cs]ed|released|distributed|redistributed|published|offered|available|provided|covered|redistribute it and or modify it|governed)"
#: What leads to a name in a reference, and the same denied.
LEAD = rf" ({_VERB}( [a-z0-9]+)?( [a-z0-9]+)?( [a-z0-9]+)?( [a-z0-9]+)? under|(is|are)( under)?|subject to|governed by)( the| a| an)?( (terms|conditions)( and conditions)? of)?( the| a| an)? "
DENIED = rf" (not|never|no longer|isn t|aren t|wasn t|cannot)( [a-z0-9]+)?( [a-z0-9]+)?( [a-z0-9]+)? ?{_VERB} "
#: Every reference has one of the first, every sentence that states something one of the second.
LEADS = r" (under|is|are|subject to|governed by|spdx) "
HINT = r"(?i)licen[cs]e|under|rights|permission|redistribut|copyright|subject to|governed|contributors|warranty|unencumbered"


def _reference(name: str) -> str:
    """The identifier of sentences that refer to a licence: GPL-3.0 is gpl3-ref."""
    return name.lower().removesuffix(".0").replace("-", "") + "-ref"


REFERENCES = {_reference(name): rf"({LEAD}{words} | spdx license identifier ([a-z0-9 ]+ (or|and) )?{short} )" for name, (words, short) in NAMES.items()}
PATTERNS = {name: f" {words} " if not words.endswith("$") else f" {words}" for name, words in SENTENCES.items()}
RULES = {name: [[_reference(name)], *TEXTS.get(name, [])] for name in NAMES}

#: Stands where a sentence ends.
_END = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _END, "abcdefghijklmnopqrstuvwxyz "
#: Comment words at the start of a line, abbreviations, empty lines, ends of sentences.
_COMMENT, _ABBREVIATION = r"(?m)^[\x20\t]*(?:rem|dnl)[\x20\t]+", r"([^a-z0-9](?:v|ver|inc|ltd|co|corp))\.[\x20\x09-\x0D]+"
_BLANK, _STOP = r"\n[^\p{L}\p{N}\n]*\n", r"[.!?][\x20\x09-\x0D]+"


def sentences(text: Column) -> Column:
    """The normalised sentences of a text, each between two spaces."""
    bare = F.regexp_replace(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _COMMENT, ""), _ABBREVIATION, "$1 ")
    ended = F.regexp_replace(F.regexp_replace(bare, _BLANK, _END), _STOP, _END)
    normal = F.regexp_replace(ended, r"[^a-z0-9\x01]+", " ")
    return F.transform(F.split(normal, _END), lambda s: F.concat(F.lit(" "), F.trim(s), F.lit(" ")))


def sentence_ids(text: Column) -> Column:
    """The identifiers that the sentences of a text state, in order; of one sentence, in order of the rules."""

    def stated(s: Column) -> Column:
        refers = s.rlike(LEADS) & ~s.rlike(DENIED)
        references = F.array(*[F.when(s.rlike(p), F.lit(name)) for name, p in REFERENCES.items()])
        texts = F.array(*[F.when(s.rlike(p), F.lit(name)) for name, p in PATTERNS.items()])
        return F.filter(F.concat(F.when(refers, references).otherwise(F.array().cast("array<string>")), texts), lambda i: i.isNotNull())

    hinted = F.filter(sentences(text), lambda s: s.rlike(HINT))
    return F.when(text.rlike(HINT), F.flatten(F.transform(hinted, stated))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentences, licences) for every row of ``docs``.

    ``n_sentences`` counts the licence sentences, ``sentences`` lists their identifiers in order and
    ``licences`` the licences one of whose rules matches, by name; both comma-joined and empty if
    none.  A licence whose text is the start of a longer one that matches is left out for that one;
    reserved rights count only where no licence is found.  Null and empty texts have none; texts of
    any length are scanned whole; repeated rows and null ids give a row each.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), F.array_join(sentence_ids(F.coalesce(F.col(text_col), F.lit(""))), ",").alias("sentences"))
    wrapped = F.concat(F.lit(","), F.col("sentences"), F.lit(","))
    shown = lambda run: F.contains(wrapped, F.lit("," + ",".join(run) + ","))
    has = {name: reduce(Column.__or__, [shown(run) for run in runs]) for name, runs in RULES.items()}
    tests = {name: test & ~has[LONGER[name]] if name in LONGER else test for name, test in has.items()}
    licences = F.concat_ws(",", *[F.when(test, F.lit(name)) for name, test in tests.items()])
    n = F.when(F.col("sentences") == "", F.lit(0)).otherwise(F.size(F.split("sentences", ","))).cast("long")
    found = found.select("doc_id", n.alias("n_sentences"), "sentences", licences.alias("licences"))
    return found.withColumn("licences", F.when((F.col("licences") == "") & shown(["reserved"]), F.lit(ALONE)).otherwise(F.col("licences")))


def _sql() -> str:
    """The same function in DuckDB: sentences, identifiers, rules."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    references = ", ".join(f"case when regexp_matches(x, {quoted(p)}) then '{name}' end" for name, p in REFERENCES.items())
    texts = ", ".join(f"case when regexp_matches(x, {quoted(p)}) then '{name}' end" for name, p in PATTERNS.items())
    has = {name: "(" + " or ".join(f"contains(',' || sentences || ',', ',{','.join(run)},')" for run in runs) + ")" for name, runs in RULES.items()}
    tests = {name: f"{test} and not {has[LONGER[name]]}" if name in LONGER else test for name, test in has.items()}
    licences = ", ".join(f"case when {test} then '{name}' end" for name, test in tests.items())
    end = "chr(1)"
    return rf"""
with b as materialized (select row_number() over () as r, doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), '{_UPPER[:-1]}' || {end}, '{_LOWER}'), '{_COMMENT}', '', 'g'), '{_ABBREVIATION}', '\1 ', 'g') as bare from documents),
s as (select r, list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(bare, '{_BLANK}', {end}, 'g'), '{_STOP}', {end}, 'g'), '[^a-z0-9\x01]+', ' ', 'g'), {end}), lambda x: ' ' || trim(x) || ' ') as cut from b),
u as (select r, pos, x from (select r, unnest(cut) as x, unnest(range(len(cut))) as pos from s) where regexp_matches(x, {quoted(HINT)})),
i as (select r, pos, list_filter(list_concat(case when regexp_matches(x, '{LEADS}') and not regexp_matches(x, {quoted(DENIED)}) then [{references}] else []::varchar[] end, [{texts}]), lambda y: y is not null) as ids from u),
g as (select r, array_to_string(flatten(list(ids order by pos)), ',') as sentences from i where len(ids) > 0 group by r),
d as (select b.doc_id, coalesce(g.sentences, '') as sentences from b left join g on g.r = b.r),
l as (select doc_id, (case when sentences = '' then 0 else len(string_split(sentences, ',')) end)::bigint as n_sentences, sentences, concat_ws(',', {licences}) as licences from d)
select doc_id, n_sentences, sentences, case when licences = '' and contains(',' || sentences || ',', ',reserved,') then '{ALONE}' else licences end as licences from l
"""


SQL = _sql()
