"""License scan: ordered regular expressions behind a keyword filter; DataFrame functions only."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

#: Words are runs of digits, a-z and characters outside ASCII, once A-Z are lower-cased.
_BREAK = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that always count, and their labels. Fixed values.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label | word of each match | words before "license" | words after it. The more specific stands first.
NAMED = """
apache-1.0 | apache | apache( software)? | ( version)? v?1 0
apache-1.1 | apache | apache( software)? | ( version)? v?1 1
apache-2.0 | apache | apache( software)? | ( version)? v?2( 0)?
apache | apache | apache( software)? |
mit-0 | mit | mit no attribution |
mit-modern | mit | mit( license)? modern variant |
mit-x11 | x11 | (mit )?x11 |
mit | mit | (the )?mit( expat)?( style)? |
mit | expat | expat |
bsd-4-clause | bsd | (original bsd|bsd 4 clause|4 clause bsd|four clause bsd) |
bsd-3-clause | bsd | (new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) |
bsd-2-clause | bsd | (simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) |
bsd-2-patent | bsd | bsd( 2 clause)? plus patent |
0bsd | bsd | (zero clause bsd|bsd zero clause|0bsd) |
bsd | berkeley | berkeley software distribution( style)? |
bsd | bsd | bsd( style)? |
isc | isc | isc( style)? |
mpl-1.0 | mozilla | mozilla public | ( version)? v?1 0
mpl-1.1 | mozilla | mozilla public | ( version)? v?1 1
mpl-2.0 | mozilla | mozilla public | ( version)? v?2( 0)?
mpl | mozilla | mozilla public |
epl-1.0 | eclipse | eclipse public | ( version)? v?1( 0)?
epl-2.0 | eclipse | eclipse public | ( version)? v?2( 0)?
epl | eclipse | eclipse public |
edl-1.0 | eclipse | eclipse distribution | (( version)? v?1 0)?
cpl-1.0 | common | common public | ( version)? v?1 0
cpal-1.0 | common | common public attribution | (( version)? v?1 0)?
cddl-1.1 | common | common development and distribution | ( cddl)?( version)? v?1 1
cddl-1.0 | common | common development and distribution | ( cddl)?(( version)? v?1 0)?
artistic-1.0 | artistic | artistic | ( version)? v?1( 0)?
artistic-2.0 | artistic | artistic | ( version)? v?2( 0)?
artistic | artistic | (perl )?artistic |
clarified-artistic | artistic | clarified artistic |
zlib | zlib | zlib( libpng)? |
libpng | png | (libpng|png reference library) |
boost-1.0 | boost | boost software | (( version)? v?1 0)?
python-2.0 | python | python( software foundation)? | (( version)? v?2( 0)?)?
cnri-python | cnri | cnri( open source)?( python)? |
php-3.0 | php | php | ( version)? v?3 0
php-3.01 | php | php | ( version)? v?3 01
php | php | php |
ruby | ruby | ruby |
openssl | openssl | (dual )?openssl( ssleay)? |
eupl-1.1 | european | european union public | ( version)? v?1 1
eupl-1.2 | european | european union public | ( version)? v?1 2
eupl | european | european union public |
cecill-b | cecill | cecill b |
cecill-c | cecill | cecill c |
cecill-2.1 | cecill | cecill | ( version)? v?2( 1)?
cecill | cecill | cecill( free software)? |
osl-3.0 | open | open software | ( version)? v?3( 0)?
afl-3.0 | academic | academic free | (( version)? v?3( 0)?)?
ecl-2.0 | educational | educational community | (( version)? v?2( 0)?)?
ncsa | ncsa | (university of illinois|uiuc|illinois)?( )?ncsa( open source)? |
postgresql | postgresql | postgresql |
unicode | unicode | unicode( inc)? | ( agreement)?
w3c | w3c | w3c( software( notice)?( and document)?)? |
ofl-1.0 | font | (sil )?open font | ( version)? v?1 0
ofl-1.1 | font | (sil )?open font | (( version)? v?1 1)?
ubuntu-font-1.0 | font | ubuntu font | (( version)? v?1 0)?
odbl-1.0 | database | open( data commons)?( open)? database | ( odbl)?(( version)? v?1 0)?
odc-by-1.0 | attribution | open data commons attribution | (( version)? v?1 0)?
pddl-1.0 | domain | public domain dedication and | ( pddl)?(( version)? v?1 0)?
ogl-uk-3.0 | government | open government | ( version)? v?3( 0)?
ogl-uk | government | open government |
etalab-2.0 | etalab | (etalab )?(open )?etalab | (( version)? v?2( 0)?)?
ms-pl | microsoft | microsoft public | ( ms pl)?
ms-rl | microsoft | microsoft reciprocal | ( ms rl)?
apple-2.0 | apple | apple public source | (( version)? v?2( 0)?)?
ibm-public-1.0 | ibm | ibm public | (( version)? v?1 0)?
intel | intel | intel open source |
qpl-1.0 |  q  | q public | (( version)? v?1 0)?
sleepycat | sleepycat | sleepycat |
vovida-1.0 | vovida | vovida software | (( version)? v?1 0)?
zope-2.1 | zope | zope public | (( version)? v?2 1)?
wtfpl | want | do what the (fuck|f|heck) you want( to)? public |
beerware | beer | beer ?ware |
npl-1.1 | netscape | netscape public | (( version)? v?1 [01])?
sspl-1.0 | server | server side public | (( version)? v?1( 0)?)?
busl-1.1 | business | business source | (( version)? v?1 1)?
elastic-2.0 | elastic | elastic | (( version)? v?2( 0)?)?
commons-clause | clause | commons clause | ( condition)?
polyform-noncommercial-1.0 | polyform | polyform noncommercial | ( 1 0( 0)?)?
polyform-small-business-1.0 | polyform | polyform small business | ( 1 0( 0)?)?
openrail | responsible | (creativeml )?(open )?responsible ai |
llama-2 | llama | llama 2 community |
llama-3 | llama | llama 3( [12])? community |
upl-1.0 | universal | universal permissive | (( version)? v?1( 0)?)?
mulan-psl-2.0 | mulan | mulan permissive software | (( version)? v?2( 0)?)?
blue-oak-1.0 | oak | blue oak model | ( 1 0( 0)?)?
hippocratic | hippocratic | hippocratic |
json | json | json |
fair | fair | fair |
latex-1.3c | latex | latex project public | (( version)? v?1 3c?)?
nasa-1.3 | nasa | nasa open source( agreement)? | (( version)? v?1 3)?
lucent-1.02 | lucent | lucent public | (( version)? v?1 02)?
reciprocal-1.5 | reciprocal | reciprocal public | (( version)? v?1 5)?
proprietary | proprietary | proprietary( software)? | ( agreement)?
end-user | user | end user | ( agreement)?
trial | trial | trial | ( agreement)?
evaluation | evaluation | evaluation | ( agreement)?
royalty-free | royalty | royalty free |
dual | dual | dual |
"""

#: label | word of each match | a sentence of the license's own text.
TEXTS = """
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy
mit-0 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit-notice | permission | the above copyright notice and this permission notice shall be included in all( copies)?
isc | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd | hereby | permission to use copy modify( and)? distribute( and sell)? this software and its documentation for any purpose( and)?( without fee)? is hereby granted
boost-1.0 | hereby | permission is hereby granted free of charge to any person or organization obtaining a copy
ofl-1.1 | hereby | permission is hereby granted free of charge to any person obtaining a copy of the font software
unicode | hereby | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-notice | redistributions | redistributions of source code must retain the above copyright notice
bsd-notice | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse | neither the name of [a-z0-9]+( [a-z0-9]+){0,9} may be used to endorse or promote products
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
disclaimer | warrant | (this software is|the software is) provided( by [a-z0-9]+( [a-z0-9]+){0,6})? as is( and)?( any)?( without warranty of any kind| express or implied warranties)
disclaimer | warrant | without( any)? warrant(y|ies)( of any kind)?( (either )?express(ed)? or implied)?
disclaimer | warrant | implied warrant(y|ies) of merchantability( (and|or) fitness for a particular purpose)?
zlib | freely | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
gpl-or-later | redistribute | you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version [123] of the licen[cs]e or at your option any later version
lgpl-or-later | redistribute | you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public licen[cs]e as published by the free software foundation
agpl-or-later | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation
apache-2.0 | compliance | you may not use this file except in compliance with the licen[cs]e
apache-2.0 | perpetual | perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
unlicense | unencumbered | this is free and unencumbered software released into the public domain
cc0-1.0 | waive | to the extent possible under law( the)?( author| person)?( [a-z0-9]+){0,6} (has|have) waived all copyright
wtfpl | copies | everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document
gnu-text | verbatim | everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document
public-domain | domain | (dedicated|released|placed|released in) (to|into|in) the public domain
public-domain | domain | (this work is|is) in the public domain
all-rights-reserved | reserved | all rights reserved
copyright | copyright | copyright( c)? (19|20)[0-9][0-9]( (19|20)[0-9][0-9])?
no-derivatives | derivative | no derivative works( are)? (allowed|permitted)
noncommercial | commercial | (for )?non ?commercial (use|purposes) only
copyleft | copyleft | (weak |strong )?copyleft
free-documentation | distribute | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
artistic | conditions | the intent of this document is to state the conditions under which a package may be copied
confidential | confidential | (confidential and proprietary|proprietary and confidential)
personal-use | personal | for personal( and)?( non ?commercial)? use only
trade-secret | trade | contains( [a-z0-9]+){0,3} trade secrets
"""

#: Families with versions: label | words of the name before "license" | short name | versions.
GNU = """
agpl | (gnu )?affero general public | agpl | 1.0 3.0
lgpl | (gnu )?(lesser|library) general public | lgpl | 2.0 2.1 3.0
gpl | (gnu )?general public | gpl | 1.0 2.0 3.0
gfdl | (gnu )?free documentation | gfdl | 1.1 1.2 1.3
"""
COMMONS = {
    "by-nc-nd": "attribution non ?commercial no ?deriv(ative)?s?( works)?", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc": "attribution non ?commercial",
    "by-nd": "attribution no ?deriv(ative)?s?( works)?", "by-sa": "attribution share ?alike", "by": "attribution",
}
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0", "")
#: Names that say nothing else: label | word of each match | pattern.
SHORT = """
cc0-1.0 | cc0 | cc0( 1 0)?( universal)?
mpl-2.0 | mpl | mpl( v)? ?2( 0)?
bsd-3-clause | bsd | bsd 3 clause
bsd-2-clause | bsd | bsd 2 clause
bsd-4-clause | bsd | bsd 4 clause
unlicense | unlicense | (the )?unlicense
"""
_LICENSE = " licen[cs]e"
_NOTICE = "(licensed|released|distributed|available|published|provided|redistributed|covered|governed) (under|by|with|according to) (the )?(terms of )?(the )?(a )?"

#: What a raw text must hold for any rule to match it; every rule's matches hold one of these.
GATE = r"(?i)licen[cs]e|spdx|copyright|copyleft|warrant|hereby|redistribut|advertising|endorse|freely|unencumbered|verbatim|derivative|commercial|confidential|may[^0-9a-z]+be[^0-9a-z]+copied|public[^0-9a-z]+domain|rights[^0-9a-z]+reserved|trade[^0-9a-z]+secret|personal[^0-9a-z]|(?<![0-9a-z])(?:[al]?gpl|gfdl|cc0|cc[^0-9a-z]|mpl|bsd|creative[^0-9a-z]+commons)"
_FORMS = {"tag": 1.0, "text": 0.95, "notice": 0.9, "version": 0.8, "name": 0.6, "short": 0.5}


@dataclass(frozen=True)
class Rule:
    label: str
    key: str
    pattern: str
    form: str

    @property
    def spaced(self) -> str:
        """The pattern over text in which each word has a space of its own on either side."""
        return " " + self.pattern.replace(" ?", "( )?").replace(" ", "  ") + " "


def rules() -> list[Rule]:
    """All rules, first the ones that win over others on the same words: tags, texts, notices, names with a version, names, short names."""
    names: list[tuple[str, str, str, bool]] = []
    for line in NAMED.strip().splitlines():
        label, key, before, after = re.split(r" \| ?", line, maxsplit=3)
        names.append((label, key, before + _LICENSE + after, bool(after)))
    short = [(a, b, c.strip()) for a, b, c in (line.split(" | ", 2) for line in SHORT.strip().splitlines())]
    for line in GNU.strip().splitlines():
        label, name, word, versions = line.split(" | ")
        key = "public" if label != "gfdl" else "documentation"
        for v in versions.split():
            number = v.replace(".0", "( 0)?").replace(".", " ")
            later = " or( at your option)?( any)? later( version)?"
            names += [(f"{label}-{v}-or-later", key, f"{name}{_LICENSE}( {word})?( version)? v? ?{number}{later}", True), (f"{label}-{v}", key, f"{name}{_LICENSE}( {word})?( version)? v? ?{number}( only)?", True)]
            short += [(f"{label}-{v}-or-later", word, f"{word} ?v? ?{number}{later}"), (f"{label}-{v}", word, f"{word} ?v? ?{number}( only)?")]
        names.append((label, key, name + _LICENSE, False))
        short.append((label, word, word))
    for kind, words in COMMONS.items():
        for v in COMMONS_VERSIONS:
            label, number = f"cc-{kind}" + (f"-{v}" if v else ""), f" {v}".replace(".", " ").rstrip()
            names.append((label, "commons", f"creative commons {words}{number}( (international|unported|generic))?( public)?{_LICENSE}", bool(v)))
            short += [(label, " cc ", f"cc {kind.replace('-', ' ')}{number}"), (label, "commons", f"creative commons {words}{number}( (international|unported|generic))?")]
    out = [Rule(label, "spdx", f"spdx{_LICENSE} identifier {re.sub('[^a-z0-9]+', ' ', label)}", "tag") for label in sorted({x[0] for x in names + short}, key=lambda x: (-len(x), x))]
    out += [Rule(label, key, pattern.strip(), "text") for label, key, pattern in (line.split(" | ", 2) for line in TEXTS.strip().splitlines())]
    notices = [Rule(label, key, _NOTICE + pattern, "notice") for label, key, pattern, _ in names] + [Rule(label, key, _NOTICE + pattern, "notice") for label, key, pattern in short]
    named = [Rule(label, key, pattern, "version" if v else "name") for label, key, pattern, v in names]
    return out + notices + sorted(named, key=lambda r: r.form == "name") + [Rule(*s, "short") for s in short]


class LicenseScan:
    """Places of licenses in texts.

    A text that the gate passes is turned to its words, each between two spaces; a rule is tried
    where its word is there. Of the matches, one that lies within another goes (within an equal
    one: the later rule's); then, of two neighbours that overlap in part, the later rule's goes.
    Whole texts; null text counts as empty and has no places; repeated rows each get a row; an
    empty table gives no rows; other columns are not read.
    """

    def __init__(self, table: list[Rule] | None = None, base: dict[str, str] | None = None):
        self.rules, self.base = rules() if table is None else table, BASE if base is None else base

    def matches(self, words: Column) -> Column:
        """array<struct<rule,gap,size>> of all rules' matches in `words`, text with a space on both sides of each word.

        gap counts the characters between a match and the one before it of its rule.
        """
        by_key = [{"key": k, "rules": [{"rule": i, "pattern": r.spaced} for i, r in enumerate(self.rules) if r.key == k]} for k in sorted({r.key for r in self.rules})]
        gated = F.filter(_constant(by_key, "array<struct<key:string,rules:array<struct<rule:int,pattern:string>>>>"), lambda k: F.contains(words, k["key"]))
        tried = F.filter(F.flatten(F.transform(gated, lambda k: k["rules"])), lambda r: F.rlike(words, r["pattern"]))

        def places(r: Column) -> Column:
            found = F.regexp_extract_all(words, r["pattern"], F.lit(0))
            gaps = F.slice(F.split(words, r["pattern"], -1), F.lit(1), F.size(found))
            return F.zip_with(gaps, found, lambda g, m: F.struct(r["rule"].alias("rule"), F.char_length(g).alias("gap"), F.char_length(m).alias("size")))

        return F.flatten(F.transform(tried, places))

    def read(self, docs: DataFrame) -> DataFrame:
        """(row, doc_id, n_words, n_base, first_word, last_word, base, found), written once."""
        text = F.coalesce(F.col("text"), F.lit(""))
        plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), f"[{_BREAK}]+", "  ")), F.lit(" "))
        d = docs.select("doc_id", F.regexp_count(text, F.lit(_RAW_WORD)).cast("long").alias("n_words"), F.when(text.rlike(GATE), plain).alias("words"))
        phrases = {p: " " + p.replace(" ", "  ") + " " for p in self.base}
        any_base = F.lit(False)
        for spaced in phrases.values():
            any_base = any_base | F.contains("words", F.lit(spaced))
        d = d.withColumn("list", F.when(any_base, F.split(F.trim("words"), "  ")))
        at = lambda phrase: F.filter(F.sequence(F.lit(0), F.size("list") - len(phrase)), lambda i: _all([F.get("list", i + k) == w for k, w in enumerate(phrase)]))
        # a phrase is looked for only where the text has it, or the list could be shorter than the phrase
        d = d.withColumns({f"_{k}": F.when(F.contains("words", F.lit(phrases[p])), at(p.split())) for k, p in enumerate(self.base)})
        hits = [F.coalesce(F.col(f"_{k}"), F.array().cast("array<int>")) for k in range(len(self.base))]
        labels = F.array(*[F.when(F.size(h) > 0, F.lit(label)) for h, label in zip(hits, self.base.values())])
        return d.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_words",
            sum((F.size(h) for h in hits[1:]), F.size(hits[0])).cast("long").alias("n_base"),
            F.array_min(F.concat(*hits)).cast("long").alias("first_word"), F.array_max(F.concat(*hits)).cast("long").alias("last_word"),
            F.array_distinct(F.array_compact(labels)).alias("base"),
            F.when(F.col("words").isNotNull(), self.matches(F.col("words"))).alias("found"),
        )

    def resolved(self, read: DataFrame) -> DataFrame:
        """(row, rule, start, end) of the matches that stay."""
        doc = W.partitionBy("row").orderBy("start", F.col("end").desc(), "rule")
        d = read.where("size(found) > 0").select("row", F.posexplode("found").alias("place", "m")).select("row", "place", "m.*").repartition("row")
        d = d.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("row", "rule").orderBy("place"))).select("row", "rule", (F.col("end") - F.col("size")).alias("start"), "end")
        d = d.withColumn("reach", F.max("end").over(doc.rowsBetween(W.unboundedPreceding, -1))).where("reach IS NULL OR end > reach")
        d = d.withColumns({"before": F.lag(F.struct("end", "rule")).over(doc), "after": F.lead(F.struct("start", "rule")).over(doc)})
        return d.where("NOT coalesce(before.end > start AND before.rule < rule, false) AND NOT coalesce(after.start < end AND after.rule < rule, false)").select("row", "rule", "start", "end")

    def _of_rule(self, values: list) -> Column:
        return F.get(_constant(values, "array<string>" if isinstance(values[0], str) else "array<double>"), F.col("rule"))

    def detections(self, docs: DataFrame) -> DataFrame:
        """(doc_id, label, form, start, end) of the places that stay; start and end count characters of the spaced words."""
        read = materialize(self.read(docs), "licenses-read")
        d = self.resolved(read).join(read.select("row", "doc_id"), "row")
        return d.select("doc_id", self._of_rule([r.label for r in self.rules]).alias("label"), self._of_rule([r.form for r in self.rules]).alias("form"), "start", "end")

    def scan(self, docs: DataFrame) -> DataFrame:
        """A row a document: its base places, and the labels and score (the surest form's) of all places that stay."""
        read = materialize(self.read(docs), "licenses-read")
        own = self.resolved(read).select("row", self._of_rule([r.label for r in self.rules]).alias("label"), self._of_rule([_FORMS[r.form] for r in self.rules]).alias("sure"))
        own = own.groupBy("row").agg(F.collect_set("label").alias("own"), F.max("sure").alias("sure"))
        none = F.array().cast("array<string>")
        some = read.where("size(found) > 0").drop("found").join(own, "row")
        rest = read.where("NOT coalesce(size(found) > 0, false)").drop("found").withColumns({"own": none, "sure": F.lit(0.0)})
        joined = lambda a: F.array_join(F.array_sort(a), ",")
        return some.unionByName(rest).select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.array_union("base", "own")).alias("labels"), F.col("sure").alias("score"))


def _constant(value: list, kind: str) -> Column:
    """A list as one constant instead of a literal an entry."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def op12_licenses(spark, sf_dir):
    return LicenseScan().scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    return ", ".join(f"({i}, {quoted(r.label)}, {quoted(r.key)}, {quoted(r.spaced)}, {_FORMS[r.form]}::DOUBLE)" for i, r in enumerate(rules()))


_PHRASES = ", ".join(f"({', '.join(repr(x) for x in (p, label))})" for p, label in BASE.items())
OP12_SQL = rf"""
WITH rules(rule, label, key, pattern, sure) AS (VALUES {_values()}),
phrases(phrase, label) AS (VALUES {_PHRASES}),
texts AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
docs AS (SELECT r, doc_id, regexp_extract_all(t, '[^{_BREAK}]+') AS w FROM texts),
spaced AS (SELECT r, ' ' || array_to_string(w, '  ') || ' ' AS s FROM docs),
base_places AS (SELECT r, p.label, unnest(list_filter(range(0, len(w) - len(string_split(phrase, ' ')) + 1), lambda i: w[i + 1 : i + len(string_split(phrase, ' '))] = string_split(phrase, ' '))) AS place
  FROM docs, phrases p WHERE contains(array_to_string(w, ' '), phrase)),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM base_places GROUP BY r),
hits AS (SELECT r, rule, string_split_regex(s, pattern) AS p, regexp_extract_all(s, pattern) AS m FROM spaced JOIN rules ON contains(s, key) WHERE regexp_matches(s, pattern)),
places AS (SELECT r, rule, unnest(range(1, len(m) + 1)) AS k, p, m FROM hits),
found AS (SELECT r, rule, list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start, length(m[k]) AS size FROM places),
reached AS (SELECT r, rule, start, start + size AS stop, max(start + size) OVER (PARTITION BY r ORDER BY start, size DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM found),
outer_ones AS (SELECT r, rule, start, stop, lag(stop) OVER w AS before_stop, lag(rule) OVER w AS before_rule, lead(start) OVER w AS after_start, lead(rule) OVER w AS after_rule
  FROM reached WHERE reach IS NULL OR stop > reach WINDOW w AS (PARTITION BY r ORDER BY start, stop DESC, rule)),
own AS (SELECT r, list(DISTINCT label) AS labels, max(sure) AS sure FROM outer_ones JOIN rules USING (rule)
  WHERE NOT coalesce(before_stop > start AND before_rule < outer_ones.rule, false) AND NOT coalesce(after_start < stop AND after_rule < outer_ones.rule, false) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(o.labels, [])))), ','), '') AS labels, coalesce(sure, 0) AS score
FROM docs d LEFT JOIN base b ON d.r = b.r LEFT JOIN own o ON d.r = o.r
"""
