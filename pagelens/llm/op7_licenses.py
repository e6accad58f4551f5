"""License scans by sentence rules.

A text is cut into sentences: after a full stop, exclamation or question mark or semicolon that a blank follows, after a colon
at a line's end, at an empty line, and after a line with an SPDX identifier, which stays whole. Each normalised sentence (lower
case, one space between words) is mapped to all known licence-sentence identifiers that it matches, in the order of their
places, and the sequence of identifiers of a document is matched against ordered licence rules. A general identifier does not
count where a specific one has the same words. A rule consumes what it matches, so a general rule after a specific one sees
only the rest. Everything is one projection of built-in functions: no shuffle, no Python.

Cases: a null or empty text has no sentences and no licence; text of any length is scanned whole; repeated rows repeat their
result; an empty table gives an empty one; other columns are kept, and only the result's own columns (``sentence_ids``,
``licenses``, ``unmatched``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.session import table

#: Every match of ``SENTENCES`` has one of these words, so texts and sentences without them need no closer look.
GUARD = "licen[cs]|copyright|permission|software is provided|redistribution|endorse|cc0|creative commons|public domain|all rights reserved|(released|available|distributed) under|without any warranty|advertising materials|this product includes"

#: Identifiers of the SPDX list that are told apart. A sentence with an SPDX line has these, as ``spdx:`` and the name, and no others; each is a licence by itself.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 "
    "CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 "
    "LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PHP-3.01 PostgreSQL PSF-2.0 Unlicense WTFPL Zlib"
).split()
SPDX_LINE, SPDX_APART = "spdx-license-identifier: ?(.*)", "[ ()/*,;]+"
_UNDER = "(licensed|released|available|distributed) under (the )?(terms of the )?"
_CC = "(licensed|released|available|distributed) under .*cc[ -]"
_NAMED = "creative commons attribution"
#: Sentence identifier, pattern of the normalised sentence; specific ones come before general ones.
SENTENCES = [
    ("apache2Under", "licensed under (the )?apache licen[cs]e,? ?(version|v)?\\.? ?2"),
    ("apache2Copy", "you may obtain a copy of the license at"),
    ("apache2Comply", "you may not use this file except in compliance with the license"),
    ("apache2AsIs", "distributed under the license is distributed on an .?as is.? basis"),
    ("apache11Includes", "this product includes software developed by the apache software foundation"),
    ("gplReceived", "received a copy of the gnu (lesser |library |affero )?general public licen[cs]e"),
    ("gplHope", "distributed in the hope that it will be useful, but without any warranty"),
    ("lgpl", "(gnu )?(lesser|library) general public licen[cs]e"),
    ("agpl", "(gnu )?affero general public licen[cs]e"),
    ("gplOrLater", "general public licen[cs]e.*(or \\(at your option\\) any later version|or later)"),
    ("gpl3", "(gnu )?general public licen[cs]e,? ?(version|v)?\\.? ?3"),
    ("gpl2", "(gnu )?general public licen[cs]e,? ?(version|v)?\\.? ?2"),
    ("gplAny", "(gnu )?general public licen[cs]e"),
    ("mitNamed", _UNDER + "mit licen[cs]e"),
    ("mitGrant", "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mitNotice", "the above copyright notice and this permission notice shall be included"),
    ("mitAsIs", "the software is provided .?as is.?, without warranty"),
    ("bslGrant", "permission is hereby granted, free of charge, to any person or organi[sz]ation obtaining a copy of the software"),
    ("bslNamed", "boost software licen[cs]e"),
    ("iscGrant", "permission to use, copy, modify,? and(/or)? distribute this software for any purpose with or without fee is hereby granted, provided"),
    ("zeroBsdGrant", "permission to use, copy, modify,? and(/or)? distribute this software for any purpose with or without fee is hereby granted([.]|$)"),
    ("iscAsIs", "the software is provided .?as is.? and the author disclaims all warranties"),
    ("iscNamed", _UNDER + "isc licen[cs]e"),
    ("postgresGrant", "permission to use, copy, modify,? and distribute this software and its documentation for any purpose, without fee"),
    ("postgresNamed", "postgresql licen[cs]e"),
    ("zlibAsIs", "this software is provided .?as-is.?, without any express or implied warranty"),
    ("zlibGrant", "permission is granted to anyone to use this software for any purpose, including commercial applications"),
    ("zlibNamed", _UNDER + "zlib(/libpng)? licen[cs]e"),
    ("bsd4Named", _UNDER + "(original |4-clause )bsd"),
    ("bsd4Advertising", "all advertising materials mentioning features or use of this software must display"),
    ("bsdNamed", _UNDER + "(new |modified |simplified |[23]-clause )?bsd"),
    ("bsdGrant", "redistribution and use in source and binary forms"),
    ("bsdSource", "redistributions of source code must retain the above copyright notice"),
    ("bsdBinary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsdEndorse", "neither the name of .* may be used to endorse or promote products"),
    ("bsdAsIs", "this software is provided by the copyright holders and contributors"),
    ("mpl1", "mozilla public licen[cs]e,? ?(version|v)?\\.? ?1"),
    ("mpl2", "mozilla public licen[cs]e,? ?(version|v)?\\.? ?2"),
    ("epl", "eclipse public licen[cs]e"),
    ("cddl", "common development and distribution licen[cs]e"),
    ("artistic", "artistic licen[cs]e"),
    ("eupl", "european union public licen[cs]e"),
    ("msPl", "microsoft public licen[cs]e"),
    ("ncsa", "university of illinois/ncsa open source licen[cs]e"),
    ("psf", "python software foundation licen[cs]e"),
    ("ofl", "sil open font licen[cs]e"),
    ("wtfpl", "do what the fuck you want to public licen[cs]e"),
    ("openssl", "openssl licen[cs]e"),
    ("php", "php licen[cs]e"),
    ("afl", "academic free licen[cs]e"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("ccByNcSa", _CC + "by-nc-sa|" + _NAMED + "-noncommercial-sharealike"),
    ("ccByNcNd", _CC + "by-nc-nd|" + _NAMED + "-noncommercial-noderiv"),
    ("ccByNc", _CC + "by-nc|" + _NAMED + "-noncommercial"),
    ("ccBySa", _CC + "by-sa|" + _NAMED + "-sharealike"),
    ("ccByNd", _CC + "by-nd|" + _NAMED + "-noderiv"),
    ("ccBy", _CC + "by|" + _NAMED),
    ("cc0", "cc0|creative commons zero|dedicated to the public domain|released into the public domain"),
    ("proprietary", "all rights reserved"),
    ("copyright", "copyright (\\(c\\)|©|[0-9]{4})"),
    ("unknownLicence", "(licensed|released) under"),
]

#: General identifiers, narrowed: not the words of a more specific one, and no letters around ``cc0``.
_GPL = "(?<!lesser |library |affero )(?<!received a copy of the gnu )general public licen[cs]e"
NARROWED = {
    "lgpl": "(?<!received a copy of the gnu )(lesser|library) general public licen[cs]e",
    "agpl": "(?<!received a copy of the gnu )affero general public licen[cs]e",
    "gplOrLater": f"{_GPL}((?!general public).)*(or \\(at your option\\) any later version|or later)",
    "gpl3": f"{_GPL},? ?(version|v)?\\.? ?3(?!((?!general public).)*or (later|\\(at your option\\) any later version))",
    "gpl2": f"{_GPL},? ?(version|v)?\\.? ?2(?!((?!general public).)*or (later|\\(at your option\\) any later version))",
    "gplAny": f"{_GPL}(?!,? ?(version|v)?\\.? ?[23])(?!((?!general public).)*or (later|\\(at your option\\) any later version))",
    "ccByNc": f"{_CC}by-nc(?!-sa|-nd)|{_NAMED}-noncommercial(?!-sharealike|-noderiv)",
    "ccBy": f"{_CC}by(?!-nc|-sa|-nd)|{_NAMED}(?!-noncommercial|-sharealike|-noderiv)",
    "cc0": "(?<![a-z0-9])cc0(?![a-z0-9])|creative commons zero|dedicated to the public domain|(?<!unencumbered software )released into the public domain",
}
#: ``unknownLicence`` counts beside these only: any other identifier says what the sentence is licensed under.
NO_LICENCE = ("proprietary", "copyright")

#: Licence, pattern over the identifiers in order (each followed by a space). Rules run from the first to the last.
RULES = [
    ("Apache-2.0", "apache2Under (apache2Comply )?(apache2Copy )?(apache2AsIs )?"),
    ("Apache-1.1", "apache11Includes "),
    ("MIT", "mitGrant (mitNotice )?(mitAsIs )?"),
    ("MIT", "mitNamed (mitGrant )?(mitNotice )?(mitAsIs )?"),
    ("BSL-1.0", "(bslNamed )?bslGrant (mitAsIs )?"),
    ("BSL-1.0", "bslNamed "),
    ("ISC", "(iscNamed )?iscGrant (iscAsIs )?"),
    ("ISC", "iscNamed "),
    ("0BSD", "zeroBsdGrant (iscAsIs )?"),
    ("PostgreSQL", "(postgresNamed )?postgresGrant "),
    ("PostgreSQL", "postgresNamed "),
    ("Zlib", "(zlibNamed )?zlibAsIs (zlibGrant )?"),
    ("Zlib", "zlibNamed "),
    ("BSD-4-Clause", "bsdGrant bsdSource bsdBinary bsd4Advertising (bsdEndorse )?(bsdAsIs )?"),
    ("BSD-3-Clause", "bsdGrant bsdSource bsdBinary bsdEndorse (bsdAsIs )?"),
    ("BSD-2-Clause", "bsdGrant bsdSource bsdBinary (bsdAsIs )?"),
    ("BSD-4-Clause", "bsd4Named "),
    ("BSD", "bsdNamed "),
    ("LGPL", "lgpl (gplHope )?(lgpl )?(gplReceived )?"),
    ("AGPL", "agpl (gplHope )?(agpl )?(gplReceived )?"),
    ("GPL-or-later", "gplOrLater (gplHope )?(gplReceived )?"),
    ("GPL-3.0", "gpl3 (gplHope )?(gplReceived )?"),
    ("GPL-2.0", "gpl2 (gplHope )?(gplReceived )?"),
    ("GPL", "gplAny (gplHope )?(gplReceived )?"),
    ("MPL-1.1", "mpl1 "),
    ("MPL-2.0", "mpl2 "),
    ("EPL", "epl "),
    ("CDDL", "cddl "),
    ("Artistic", "artistic "),
    ("EUPL", "eupl "),
    ("MS-PL", "msPl "),
    ("NCSA", "ncsa "),
    ("PSF", "psf "),
    ("OFL", "ofl "),
    ("WTFPL", "wtfpl "),
    ("OpenSSL", "openssl "),
    ("PHP", "php "),
    ("AFL", "afl "),
    ("Unlicense", "unlicense "),
    ("CC-BY-NC-SA", "ccByNcSa "),
    ("CC-BY-NC-ND", "ccByNcNd "),
    ("CC-BY-NC", "ccByNc "),
    ("CC-BY-SA", "ccBySa "),
    ("CC-BY-ND", "ccByNd "),
    ("CC-BY", "ccBy "),
    ("CC0", "cc0 "),
    ("Proprietary", "(copyright )?proprietary "),
    ("UnknownLicence", "unknownLicence "),
]
_BLANK = "[\\x09-\\x0D\\x20]"
#: Where a text is cut into sentences: pattern, and how many groups of it stay before the cut. One after the other.
#: The first cuts nothing: the stop of a version number ends no sentence.
CUTS = [
    (f"([ ,]v[.]){_BLANK}+([0-9])", 2),
    ("(spdx-license-identifier:[^\n]*)\n", 1),
    (f"([.!?;]){_BLANK}+", 1),
    (f"(:)[\\x09\\x0B-\\x0D\\x20]*\n{_BLANK}*", 1),
    (f"\n{_BLANK}*\n", 0),
]


def sentence_ids(sentence):
    """Identifiers of a normalised sentence in the order of their first places (equal places: of ``SENTENCES``)."""
    named = [(name, NARROWED.get(name, pattern)) for name, pattern in SENTENCES if name != "unknownLicence"]
    found = F.array(*[F.struct(F.regexp_instr(sentence, F.lit(p)).alias("at"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, p) in enumerate(named)])
    found = F.transform(F.array_sort(F.filter(found, lambda x: x["at"] > 0)), lambda x: x["name"])
    unknown = F.when(sentence.rlike(dict(SENTENCES)["unknownLicence"]), F.array(F.lit("unknownLicence"))).otherwise(F.array().cast("array<string>"))
    rest = F.array(*map(F.lit, NO_LICENCE))
    found = F.transform(F.array(found), lambda x: F.when(F.size(F.array_except(x, rest)) == 0, F.concat(x, unknown)).otherwise(x))[0]
    spelt = F.create_map(*[F.lit(x) for name in SPDX for x in (name.lower(), f"spdx:{name}")])
    parts = F.transform(F.split(F.regexp_extract(sentence, SPDX_LINE, 1), SPDX_APART), lambda x: F.rtrim(x, F.lit("+.")))
    listed = F.array_compact(F.transform(parts, lambda x: spelt[x]))
    listed = F.when(F.size(listed) == 0, F.array(F.lit("unknownLicence"))).otherwise(listed)
    return F.when(sentence.contains("spdx-license-identifier:"), listed).otherwise(found)


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` (the identifiers in order, joined by a space), ``licenses`` (sorted, joined by a comma) and ``unmatched`` (identifiers that no rule used)."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    cut = low
    for pattern, kept in CUTS:
        cut = F.regexp_replace(cut, pattern, ["\u0001", "$1\u0001", "$1$2"][kept])
    sentences = F.transform(F.split(cut, "\u0001", -1), lambda s: F.regexp_replace(s, f"{_BLANK}+", " "))
    ids = F.flatten(F.transform(F.filter(sentences, lambda s: s.rlike(GUARD)), sentence_ids))
    ids = F.when(low.rlike(GUARD.replace(" ", f"{_BLANK}+")), F.array_join(ids, " ")).otherwise("")
    out = docs.withColumn("sentence_ids", ids)
    rest = F.array_join(F.filter(F.split("sentence_ids", " "), lambda x: (x != "") & ~x.startswith("spdx:")), " ")
    out = out.withColumn("__licence_0", F.when(rest == "", "").otherwise(F.concat(rest, F.lit(" "))))
    hits = []
    for i, (name, pattern) in enumerate(RULES):
        hits.append(F.when(F.col(f"__licence_{i}").rlike(f"(^| ){pattern}"), F.lit(name)))
        out = out.withColumn(f"__licence_{i + 1}", F.regexp_replace(f"__licence_{i}", f"(^| ){pattern}", "$1"))
    listed = F.transform(F.filter(F.split("sentence_ids", " "), lambda x: x.startswith("spdx:")), lambda x: F.substring_index(x, ":", -1))
    named = F.array_join(F.sort_array(F.array_distinct(F.concat(listed, F.array_compact(F.array(*hits))))), ",")
    out = out.withColumns({"licenses": named, "unmatched": F.rtrim(F.col(f"__licence_{len(RULES)}"))})
    return out.drop(*[f"__licence_{i}" for i in range(len(RULES) + 1)])


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "sentence_ids", "licenses", "unmatched")


def _oracle() -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    case = " ".join(f"WHEN regexp_matches(s, {lit(p)}) THEN {lit(n)}" for n, p in SENTENCES)
    spdx = " ".join(f"WHEN '{name.lower()}' THEN 'spdx:{name}'" for name in SPDX)
    steps, before = [], "ids"
    for i, (name, pattern) in enumerate(RULES):
        p = lit(f"(^| ){pattern}")
        steps.append(f"r{i} AS (SELECT doc_id, sentence_ids, CASE WHEN regexp_matches(rest, {p}) THEN list_append(found, {lit(name)}) ELSE found END AS found, regexp_replace(rest, {p}, '\\1', 'g') AS rest FROM {before})")
        before = f"r{i}"
    cut = "t"
    for pattern, kept in CUTS:
        cut = f"regexp_replace({cut}, {lit(pattern)}, {['chr(1)', lit(chr(92) + '1') + ' || chr(1)', lit(chr(92) + '1' + chr(92) + '2')][kept]}, 'g')"
    return f"""
WITH low AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
cut AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, string_split({cut}, chr(1)) AS parts FROM low)),
named AS (SELECT doc_id, pos, CASE WHEN contains(s, 'spdx-license-identifier:') THEN coalesce(nullif(array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract(s, {lit(SPDX_LINE)}, 1), {lit(SPDX_APART)}), lambda x: CASE rtrim(x, '+.') {spdx} END), lambda x: x IS NOT NULL), ' '), ''), 'unknownLicence') ELSE CASE {case} END END AS id FROM (SELECT doc_id, pos, regexp_replace(raw, '{_BLANK}+', ' ', 'g') AS s FROM cut)),
seq AS (SELECT doc_id, coalesce(string_agg(id, ' ' ORDER BY pos), '') AS sentence_ids FROM named GROUP BY doc_id),
parted AS (SELECT doc_id, sentence_ids, list_filter(string_split(sentence_ids, ' '), lambda x: x <> '' AND NOT starts_with(x, 'spdx:')) AS other, list_transform(list_filter(string_split(sentence_ids, ' '), lambda x: starts_with(x, 'spdx:')), lambda x: split_part(x, ':', 2)) AS found FROM seq),
ids AS (SELECT doc_id, sentence_ids, CASE WHEN len(other) = 0 THEN '' ELSE array_to_string(other, ' ') || ' ' END AS rest, found FROM parted),
{', '.join(steps)}
SELECT doc_id, sentence_ids, array_to_string(list_sort(list_distinct(found)), ',') AS licenses, rtrim(rest) AS unmatched FROM {before}
"""


#: Says the same rules without look-around: of each sentence the first identifier in the order of ``SENTENCES``.
ORACLE = _oracle()
