"""License scans: ordered signature rules over normalised words, as DataFrame expressions only.

Hand-written sentences of licence texts come first, then the forms in which a family is mentioned.

The words of a document are lower-cased and joined.  It takes part only if one of the gate's
patterns occurs there, which the rules give; each rule whose own keyword occurs is matched, and overlapping detections are resolved:
a detection that lies inside one of an earlier rule (or in a longer one of the same rule) falls.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_WORD, UPPER

#: Phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Sentences of licence texts, notices and file headers, in order of priority: label, a literal that every
#: match holds, pattern, how sure a detection is.  One blank stands between words; all is lower case without punctuation.
SIGNATURES = (
    # headers and notices that name a family inside another one's words come first
    ("agpl", "affero general public license", "under the terms of the gnu affero general public license", 1.0),
    ("agpl", "affero general public license", "copy of the gnu affero general public license along with", 1.0),
    ("agpl", "affero general public license", "gnu affero general public license version 3 19 november 2007", 1.0),
    ("agpl", "remote network interaction", "remote network interaction use with the gnu general public license", 0.95),
    ("lgpl", "this library is free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public", 1.0),
    ("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license", 1.0),
    ("lgpl", "library general public license", "under the terms of the gnu library general public license", 1.0),
    ("lgpl", "lesser general public license", "copy of the gnu lesser general public license along with", 1.0),
    ("lgpl", "lesser general public license", "gnu lesser general public license version (?:2 1|3)", 0.95),
    ("lgpl", "a work that uses the library", "a work that uses the library", 0.8),
    ("gpl", "this program is free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("gpl", "gnu general public license", "copy of the gnu general public license along with", 1.0),
    ("gpl", "gnu general public license", "gnu general public license version (?:1 february 1989|2 june 1991|3 29 june 2007)", 1.0),
    ("gpl", "gnu general public license", "under the terms of the gnu general public license", 1.0),
    ("gpl", "free software foundation", "as published by the free software foundation either version (?:1|2|3) of the license", 0.9),
    ("gpl", "free software foundation", "version (?:2|3) (?:only )?as published by the free software foundation", 0.9),
    ("gpl", "this program comes with absolutely no warranty", "this program comes with absolutely no warranty", 0.85),
    ("gpl", "designed to take away your freedom", "the licenses for most software are designed to take away your freedom to share and change it", 1.0),
    ("gpl", "free copyleft license", "is a free copyleft license for software and other kinds of works", 1.0),
    ("gpl", "classpath exception", "classpath exception", 0.85),
    ("gfdl", "gnu free documentation license", "under the terms of the gnu free documentation license", 1.0),
    ("gfdl", "no invariant sections", "with no invariant sections no front cover texts and no back cover texts", 1.0),
    # permissive texts
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", "and this permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "without limitation the rights to use copy", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", 1.0),
    ("mit", "opensource org licenses mit", "opensource org licenses mit", 1.0),
    ("mit", "use of this source code is governed by an mit", "use of this source code is governed by an mit style", 0.95),
    ("json", "shall be used for good not evil", "the software shall be used for good not evil", 1.0),
    ("x11", "except as contained in this notice the name", "except as contained in this notice the name (?:of )?[a-z0-9 ]{1,80} shall not be used in advertising", 0.9),
    ("isc", "distribute this software for any purpose with or without fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("isc", "opensource org licenses isc", "opensource org licenses isc", 1.0),
    ("0bsd", "bsd zero clause", "bsd zero clause license", 1.0),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.95),
    ("bsd", "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd", "may be used to endorse or promote products", "neither the names? of [a-z0-9 ]{1,120} may be used to endorse or promote products derived from this software", 0.95),
    ("bsd", "all advertising materials mentioning features", "all advertising materials mentioning features or use of this software must display the following acknowledgement", 1.0),
    ("bsd", "governed by a bsd style license", "use of this source code is governed by a bsd style license", 1.0),
    ("bsd", "opensource org licenses bsd", "opensource org licenses bsd (?:2|3|license)", 1.0),
    ("apache", "apache license version", "licensed under the apache license version (?:1 1|2 0)", 1.0),
    ("apache", "www apache org licenses", "www apache org licenses license (?:1 0|1 1|2 0)", 1.0),
    ("apache", "apache org licenses", "apache org licenses", 0.9),
    ("apache", "licensed to the apache software foundation", "licensed to the apache software foundation asf under one or more contributor license agreements", 1.0),
    ("apache", "you may not use this file except in compliance", "you may not use this file except in compliance with the license", 0.85),
    ("apache", "grant of patent license", "grant of patent license subject to the terms and conditions of this license each contributor", 0.95),
    ("apache", "software distributed under the license is distributed on an", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.85),
    ("zlib", "this software is provided as is without any express", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.95),
    ("zlib", "must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1.0),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such", 1.0),
    ("libpng", "png reference library", "png reference library license", 1.0),
    ("bsl", "boost software license", "distributed under the boost software license version 1 0", 1.0),
    ("bsl", "www boost org license", "www boost org license 1 0", 1.0),
    ("bsl", "any person or organization obtaining a copy", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 1.0),
    ("ncsa", "university of illinois", "university of illinois (?:ncsa )?open source license", 1.0),
    ("postgresql", "without a written agreement is hereby granted", "for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("w3c", "w3c software", "w3c software (?:notice and license|and document notice and license)", 1.0),
    ("curl", "copyright c 1996", "copyright c 1996 [a-z0-9 ]{1,20}daniel stenberg", 0.9),
    ("openssl", "developed by the openssl project", "this product includes software developed by the openssl project", 1.0),
    ("openssl", "written by eric young", "cryptographic software written by eric young", 0.95),
    ("php", "of the php license", "subject to version 3 (?:0|01) of the php license", 1.0),
    ("php", "products derived from this software may not be called php", "products derived from this software may not be called php", 1.0),
    ("psf", "python software foundation license version", "python software foundation license version 2", 1.0),
    ("psf", "psf is making python available", "psf is making python available to licensee on an as is basis", 1.0),
    ("ruby", "same terms as ruby", "(?:under the )?same terms as ruby", 0.9),
    ("artistic", "the artistic license", "the artistic license 2 0", 1.0),
    ("artistic", "same terms as perl itself", "same terms as perl itself", 0.9),
    ("ofl", "this font software is licensed under the sil", "this font software is licensed under the sil open font license version 1 1", 1.0),
    ("ofl", "scripts sil org ofl", "scripts sil org ofl", 0.95),
    ("beerware", "beer ware license", "the beer ware license", 1.0),
    ("beerware", "buy me a beer in return", "you can buy me a beer in return", 0.95),
    ("wtfpl", "you just do what the fuck you want to", "you just do what the fuck you want to", 1.0),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "unlicense org", "unlicense org", 0.95),
    ("afl", "academic free license", "academic free license version (?:2 0|2 1|3 0)", 1.0),
    ("ecl", "educational community license", "educational community license version (?:1|2) 0", 1.0),
    ("upl", "universal permissive license", "universal permissive license v(?:ersion)? 1 0", 1.0),
    # reciprocal texts of foundations and companies
    ("mpl", "this source code form is subject to the terms", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl", "mozilla public license", "contents of this file are subject to the mozilla public license version (?:1 0|1 1)", 1.0),
    ("mpl", "mozilla org mpl", "mozilla org mpl", 0.95),
    ("mpl", "incompatible with secondary licenses", "this source code form is incompatible with secondary licenses", 0.95),
    ("epl", "eclipse public license", "made available under the terms of the eclipse public license v(?:ersion)? (?:1 0|2 0)", 1.0),
    ("epl", "www eclipse org legal epl", "www eclipse org legal epl", 1.0),
    ("cpl", "common public license", "made available under the terms of the common public license v(?:ersion)? (?:0 5|1 0)", 1.0),
    ("ipl", "ibm public license", "ibm public license version 1 0", 1.0),
    ("cddl", "common development and distribution license", "subject to the terms of the common development and distribution license", 1.0),
    ("cddl", "opensource org licenses cddl", "opensource org licenses cddl", 1.0),
    ("osl", "open software license", "open software license version (?:2 0|2 1|3 0)", 1.0),
    ("eupl", "licensed under the eupl", "licensed under the eupl(?: version)?(?: 1 [012])?", 1.0),
    ("cecill", "cecill", "governed by the cecill (?:b |c )?license", 1.0),
    ("ms-pl", "microsoft public license", "microsoft public license ms pl", 1.0),
    ("ms-rl", "microsoft reciprocal license", "microsoft reciprocal license", 1.0),
    ("sspl", "server side public license", "server side public license(?: version 1)?", 1.0),
    ("sspl", "offering the program as a service", "if you make the functionality of the program [a-z0-9 ]{1,80} offering the program as a service", 0.9),
    ("busl", "business source license", "business source license 1 1", 1.0),
    ("busl", "additional use grant", "additional use grant", 0.85),
    ("elastic", "elastic license", "elastic license (?:2 0|v2)", 1.0),
    ("commons-clause", "commons clause", "commons clause license condition", 1.0),
    # works other than software
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons org licenses by nc(?: (?:sa|nd))?", 1.0),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons org licenses by nd", 1.0),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons org licenses by sa", 1.0),
    ("cc-by", "creativecommons org licenses by", "creativecommons org licenses by [0-9]", 1.0),
    ("cc0", "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0", 1.0),
    ("cc0", "dedicated the work to the public domain", "has dedicated the work to the public domain", 0.95),
    ("cc-by-nc", "attribution noncommercial", "licensed under a creative commons attribution noncommercial", 1.0),
    ("cc-by-sa", "attribution sharealike", "licensed under a creative commons attribution sharealike", 1.0),
    ("odbl", "open database license", "open database license", 1.0),
    ("pddl", "public domain dedication and license", "public domain dedication and license", 1.0),
    ("odc-by", "open data commons attribution license", "open data commons attribution license", 1.0),
    ("ogl", "open government licence", "open government licence", 0.95),
)


#: Label, short names, full names: the families from which the signature rules are built.
FAMILIES = (
    ("agpl", "agpl|agplv3|agpl 3 0", "affero general public license|gnu affero"),
    ("lgpl", "lgpl|lgplv2|lgplv3|lgpl 2 1|lgpl 3 0", "lesser general public license|library general public license|gnu lesser"),
    ("gpl", "gpl|gplv2|gplv3|gpl 2 0|gpl 3 0", "general public license|gnu gpl|gnu public license"),
    ("apache", "apache 2|apache 2 0|apache2|asl 2 0", "apache license|apache software license"),
    ("mit", "mit|expat", "mit license|expat license|x11 license"),
    ("bsd", "bsd|bsd 2 clause|bsd 3 clause|0bsd", "bsd license|new bsd|simplified bsd|berkeley software distribution"),
    ("mpl", "mpl|mpl 1 1|mpl 2 0", "mozilla public license"),
    ("epl", "epl|epl 1 0|epl 2 0", "eclipse public license"),
    ("cddl", "cddl|cddl 1 0|cddl 1 1", "common development and distribution license"),
    ("cpl", "cpl|cpl 1 0", "common public license"),
    ("isc", "isc", "isc license|internet systems consortium license"),
    ("zlib", "zlib", "zlib license|zlib libpng license"),
    ("bsl", "bsl 1 0|boost", "boost software license"),
    ("unlicense", "unlicense", "released into the public domain|the unlicense"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public license"),
    ("artistic", "artistic 1 0|artistic 2 0", "artistic license|perl license"),
    ("ofl", "ofl|ofl 1 1", "open font license|sil open font license"),
    ("cc0", "cc0|cc0 1 0", "creative commons zero|cc0 public domain dedication"),
    ("cc-by-nc", "cc by nc|cc by nc 4 0", "attribution noncommercial|creative commons noncommercial"),
    ("cc-by-nd", "cc by nd|cc by nd 4 0", "attribution noderivatives|creative commons noderivatives"),
    ("cc-by-sa", "cc by sa|cc by sa 3 0|cc by sa 4 0", "attribution sharealike|creative commons sharealike"),
    ("cc-by", "cc by|cc by 3 0|cc by 4 0", "creative commons attribution"),
    ("eupl", "eupl|eupl 1 1|eupl 1 2", "european union public licence|european union public license"),
    ("ms-pl", "ms pl", "microsoft public license"),
    ("psf", "psf|python 2 0", "python software foundation license|psf license"),
    ("ruby", "ruby", "ruby license"),
    ("php", "php 3 01", "php license"),
    ("openssl", "openssl", "openssl license|ssleay license"),
    ("postgresql", "postgresql", "postgresql license|postgresql licence"),
    ("sspl", "sspl|sspl 1 0", "server side public license"),
    ("busl", "busl|busl 1 1", "business source license"),
)

#: Templates of rules in order of priority: kind, pattern, how sure a detection is.
TEMPLATES = (
    ("identifier", "spdx  license  identifier  (?:{short}|{full})(?:  (?:only|or  later))?", 1.0),
    ("grant", "(?:licensed|released|distributed|available|provided|published)  (?:under|in|by)(?:  the)?(?:  terms  of(?:  the)?)?(?:  gnu)?  (?:{short}|{full})", 0.95),
    ("terms", "(?:terms|conditions)  of  the(?:  gnu)?  (?:{full}|(?:{short})  licen[sc]e)", 0.9),
    ("notice", "licen[sc]e  (?:is  |type  )?(?:{short}|{full})", 0.85),
    ("version", "(?:{full})  (?:version|v)  [0-9]+(?:  [0-9]+)?(?:  or(?:  \\(?at  your  option\\)?)?  (?:any  )?later)?", 0.85),
    ("copy", "copy  of  the(?:  gnu)?  (?:{full})", 0.8),
    ("name", "(?:{full})", 0.75),
    ("short", "(?:{short})  licen[sc]ed?", 0.7),
)


def _wide(names: str) -> str:
    """``names`` as they stand in the joined words: each word between two blanks."""
    return names.replace(" ", "  ")


def gate(joined: Column) -> Column:
    """Whether the joined words hold what every match of a rule holds: a test for literals, and the start of a grant.

    A signature holds its keyword.  Of the mentions, all but the grants hold a form of "license", "spdx" or a full
    name; a grant holds its own pattern up to the name, of any family.  Every counted phrase holds "license".
    """
    names = [n for _, _, full in FAMILIES for n in full.split("|")] + [keyword for _, keyword, _, _ in SIGNATURES]
    literals = ["license", "licence", "spdx", *sorted({_wide(n) for n in names if not re.search("licen[sc]e", n)})]
    shorts = "|".join(s + "|" + f for _, s, f in FAMILIES)
    grant = dict((kind, template) for kind, template, _ in TEMPLATES)["grant"].format(short=_wide(shorts), full="-")
    verbs = re.search(r"\(\?:([a-z|]+)\)", grant)[1].split("|")
    holds = lambda words: reduce(or_, [F.contains(joined, F.lit(w)) for w in words])
    return holds(literals) | (holds(verbs) & joined.rlike(" " + grant))


def signature_rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, keyword, pattern, certainty) of every rule: the signatures, then how families are mentioned."""
    rules = [(i, label, _wide(keyword), f" {_wide(pattern)} ", sure) for i, (label, keyword, pattern, sure) in enumerate(SIGNATURES)]
    for kind, template, sure in TEMPLATES:
        for label, short, full in FAMILIES:
            pattern = " " + template.format(short=_wide(short), full=_wide(full)) + " "
            keyword = {"identifier": "spdx", "terms": " of  the", "copy": "copy  of"}.get(kind, "")
            rules.append((len(rules), label, keyword, pattern, sure))
    return rules


def _count(part: Column) -> Column:
    """Words in a part of the joined words, where each stands between two blanks."""
    return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("bigint")


#: Items of a part of a growing list: what is appended to is copied, so lists grow in parts.
_PART = 128


def _nothing(kind: str) -> list[Column]:
    return [F.array().cast(f"array<{kind}>").alias("full"), F.array().cast(kind).alias("part")]


def _pushed(s: Column, item: Column) -> list[Column]:
    """The list of a fold's state with one more item."""
    longer, done = F.array_append(s["part"], item), F.size(s["part"]) >= _PART - 1
    return [
        F.when(done, F.array_append(s["full"], longer)).otherwise(s["full"]).alias("full"),
        F.when(done, F.slice(s["part"], 1, 0)).otherwise(longer).alias("part"),
    ]


def _all_pushed(s: Column) -> Column:
    return F.flatten(F.array_append(s["full"], s["part"]))


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections``.

    One row per input row, repeated rows included; other columns are left out, so clashing names do
    no harm.  Null and empty texts have no words, labels or detections and score 0; texts of any length are
    read whole; an empty table gives no rows.  ``detections``
    are structs of label, start, stop (words, stop exclusive), sure; ``score`` is the certainty of
    the surest one (1 for a counted phrase).
    """
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), NOT_WORD + "+"), "")
    a = docs.select("doc_id", words.alias("words"))
    low = F.translate(F.array_join("words", "  "), UPPER, LOWER)
    a = a.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.concat(F.lit(" "), low, F.lit(" ")).alias("joined"))
    a = a.select("doc_id", "n_words", F.when(gate(F.col("joined")), F.col("joined")).alias("joined"))
    parts = [F.split("joined", f" {p.replace(' ', '  ')} ").alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)]
    rules = F.array(
        *[
            F.struct(
                F.lit(p).alias("rank"), F.lit(l).alias("label"), F.lit(k).alias("keyword"), F.lit(x).alias("pattern"), F.lit(s).alias("sure")
            )
            for p, l, k, x, s in signature_rules()
        ]
    )
    a = a.select("doc_id", "n_words", "joined", *parts, F.when(F.col("joined").isNotNull(), rules).alias("rules"))

    detection = "array<struct<rank: int, label: string, start: bigint, stop: bigint, sure: double>>"

    def found(rule: Column) -> Column:
        """The matches of a rule in one pass: words of the gap before each, then its own."""
        sizes = F.zip_with(F.split("joined", rule["pattern"]), F.regexp_extract_all("joined", rule["pattern"], F.lit(0)), lambda g, h: F.struct(_count(g).alias("gap"), _count(h).alias("own")))

        def step(s: Column, x: Column) -> Column:
            start = s["at"] + x["gap"]
            stop = start + x["own"]
            one = F.struct(rule["rank"].alias("rank"), rule["label"].alias("label"), start.alias("start"), stop.alias("stop"), rule["sure"].alias("sure"))
            return F.when(x["own"].isNull(), s).otherwise(F.struct(stop.alias("at"), *_pushed(s, one)))

        empty = F.struct(F.lit(0).cast("bigint").alias("at"), *_nothing(detection))
        return F.aggregate(sizes, empty, step, _all_pushed)

    hit = F.filter(
        "rules", lambda r: F.contains(F.col("joined"), r["keyword"]) & F.regexp_like(F.col("joined"), r["pattern"])
    )
    a = a.withColumn("hit", hit)
    a = a.withColumn("all", F.flatten(F.transform("hit", found)))
    # a detection inside one of a rule that comes before is dropped: by falling length from each start, with those still open
    order = F.array_sort(F.transform("all", lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("far"), d["rank"].alias("rank"), d.alias("d"))))

    def sweep(s: Column, x: Column) -> Column:
        d = x["d"]
        inside = F.exists(s["open"], lambda e: (e["stop"] >= d["stop"]) & (e["rank"] < d["rank"]))
        still = F.filter(s["open"], lambda e: e["stop"] > d["start"])
        return F.when(inside, s).otherwise(
            F.struct(F.array_append(still, F.struct(d["stop"].alias("stop"), d["rank"].alias("rank"))).alias("open"), *_pushed(s, d))
        )

    none = F.struct(F.array().cast("array<struct<stop: bigint, rank: int>>").alias("open"), *_nothing(detection))
    kept = F.aggregate(order, none, sweep, _all_pushed)
    a = a.withColumn("kept", kept)
    places = [F.coalesce(F.size(f"p{i}") - 1, F.lit(0)).cast("bigint") for i in range(len(PHRASES))]
    places = [F.when(F.col("joined").isNull(), F.lit(0).cast("bigint")).otherwise(n) for n in places]
    first = [F.when(n > 0, _count(F.get(f"p{i}", F.lit(0)))) for i, n in enumerate(places)]
    last = [
        F.when(n > 0, F.col("n_words") - _count(F.element_at(f"p{i}", -1)) - len(PHRASES[i][0].split()))
        for i, n in enumerate(places)
    ]
    base = F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for n, (_, label) in zip(places, PHRASES, strict=True)]))
    kept_labels = F.coalesce(F.transform("kept", lambda d: d["label"]), F.expr("cast(array() as array<string>)"))
    n_base = sum(places[1:], places[0])
    sure = F.coalesce(F.array_max(F.transform("kept", lambda d: d["sure"])), F.lit(0.0))
    return a.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.least(*first).alias("first_word"),
        F.greatest(*last).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, kept_labels))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(sure).cast("double").alias("score"),
        F.transform(F.coalesce("kept", F.expr("filter(all, x -> false)")), lambda d: F.struct(d["label"].alias("label"), d["start"].alias("start"), d["stop"].alias("stop"), d["sure"].alias("sure"))).alias("detections"),
    )
