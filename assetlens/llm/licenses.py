"""Licence scans by ordered signature rules, native DataFrame operations only.

A text is normalised to its lower-cased words joined by single blanks. Rules are regular expressions over that form,
each with a keyword that must occur before the expression is tried, a priority, a label and a confidence. All places of
all rules are detected; a place is suppressed where its interval lies inside the interval of a rule of higher priority
(or of equal priority and greater length). The three base phrases are rules of the highest priority, so they always stay.

Plan: one projection over the scan, without a shuffle. The rule table is a constant of the plan; a text tries only the
rules whose keyword it holds, and a text without any keyword tries none.

Edge cases: null text is empty; empty texts have no words and null first and last places; repeated rows give repeated
rows; ties between equal intervals of equal priority go to the smaller label; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.llm.runtime import id_and_text

#: What stands between words. Letters keep their case: expressions ignore the case of A-Z only, which is what lower-casing A-Z gives.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words too common in licence names to tell one from another.
GENERIC = {"license", "public", "general", "software", "free", "open", "source", "the"}

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, name as words, further expression for the name, version expression or "".
FAMILIES = [
    ("0bsd", "0bsd", "zero clause bsd", ""),
    ("afl-3", "academic free license", "afl", "3(?: 0)?"),
    ("agpl-3", "gnu affero general public license", "agpl|affero gpl|gnu agpl", "3(?: 0)?"),
    ("apache-1", "apache software license", "apache|asl", "1(?: [01])?"),
    ("apache-2", "apache license", "apache|apache software license|asl", "2(?: 0)?"),
    ("artistic-1", "artistic license", "perl artistic", "1(?: 0)?"),
    ("artistic-2", "artistic license", "perl artistic", "2(?: 0)?"),
    ("bsd-2-clause", "bsd 2 clause license", "simplified bsd|freebsd|two clause bsd|bsd 2 clause", ""),
    ("bsd-3-clause", "bsd 3 clause license", "new bsd|modified bsd|revised bsd|three clause bsd|bsd 3 clause", ""),
    ("bsd-4-clause", "bsd 4 clause license", "original bsd|four clause bsd|bsd 4 clause", ""),
    ("bsl-1", "boost software license", "bsl|boost", "1(?: 0)?"),
    ("cc0", "cc0", "cc zero|creative commons zero", "1(?: 0)?"),
    ("cc-by", "creative commons attribution", "cc by", "[1234] [05]"),
    ("cc-by-nc", "creative commons attribution non ?commercial", "cc by nc", "[1234] [05]"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:s|atives)", "cc by nc nd", "[1234] [05]"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike", "cc by nc sa", "[1234] [05]"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:s|atives)", "cc by nd", "[1234] [05]"),
    ("cc-by-sa", "creative commons attribution share ?alike", "cc by sa", "[1234] [05]"),
    ("cddl-1", "common development and distribution license", "cddl", "1(?: [01])?"),
    ("cecill-2", "cecill free software license agreement", "cecill", "2(?: [01])?"),
    ("cpl-1", "common public license", "cpl", "1(?: 0)?"),
    ("ecl-2", "educational community license", "ecl", "2(?: 0)?"),
    ("epl-1", "eclipse public license", "epl", "1(?: 0)?"),
    ("epl-2", "eclipse public license", "epl", "2(?: 0)?"),
    ("eupl-1", "european union public license", "eupl", "1(?: [0-2])?"),
    ("gfdl-1", "gnu free documentation license", "gfdl|gnu fdl", "1(?: [1-3])?"),
    ("gpl-1", "gnu general public license", "gpl|gnu gpl", "1(?: 0)?"),
    ("gpl-2", "gnu general public license", "gpl|gnu gpl", "2(?: 0)?"),
    ("gpl-3", "gnu general public license", "gpl|gnu gpl", "3(?: 0)?"),
    ("isc", "isc license", "isc", ""),
    ("lgpl-2", "gnu (?:lesser|library) general public license", "lgpl|gnu lgpl", "2(?: [01])?"),
    ("lgpl-3", "gnu lesser general public license", "lgpl|gnu lgpl", "3(?: 0)?"),
    ("lppl-1", "latex project public license", "lppl", "1(?: [0-3][abc]?)?"),
    ("mit", "mit license", "mit|expat|mit x11|x11", ""),
    ("mpl-1", "mozilla public license", "mpl", "1(?: [01])?"),
    ("mpl-2", "mozilla public license", "mpl", "2(?: 0)?"),
    ("ms-pl", "microsoft public license", "ms pl", ""),
    ("ms-rl", "microsoft reciprocal license", "ms rl", ""),
    ("ncsa", "university of illinois ncsa open source license", "ncsa", ""),
    ("odbl-1", "open data commons open database license", "odbl", "1(?: 0)?"),
    ("ofl-1", "sil open font license", "ofl", "1(?: [01])?"),
    ("openssl", "openssl license", "openssl ssleay", ""),
    ("osl-3", "open software license", "osl", "3(?: 0)?"),
    ("postgresql", "postgresql license", "postgresql", ""),
    ("psf-2", "python software foundation license", "psf|python", "2(?: 0)?"),
    ("unlicense", "unlicense", "the unlicense", ""),
    ("upl-1", "universal permissive license", "upl", "1(?: 0)?"),
    ("wtfpl", "do what the fuck you want to public license", "wtfpl", ""),
    ("zlib", "zlib license", "zlib|zlib libpng", ""),
]
# Sentences of licence texts and notices that name no licence: label, keyword, expression, priority, confidence.
SENTENCES = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 80, 0.97),
    ("isc", "permission", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee", 80, 0.95),
    ("bsd-3-clause", "redistribution", "redistribution and use in source and binary forms(?: \\S+){1,80}? neither the name", 82, 0.95),
    ("bsd-2-clause", "redistribution", "redistribution and use in source and binary forms", 60, 0.80),
    ("boost", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy", 81, 0.95),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event", 70, 0.85),
    ("public-domain", "domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 65, 0.80),
    ("gpl", "free", "this (?:program|library) is free software you can redistribute it and or modify it under the terms of", 64, 0.85),
    ("all-rights-reserved", "reserved", "all rights reserved", 20, 0.40),
    ("proprietary", "proprietary", "proprietary and confidential", 25, 0.60),
    ("spdx", "spdx", "spdx license identifier \\S+", 30, 0.70),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2})*", 10, 0.30),
]

_GNU = "as published by the free software foundation"
_CC = {"cc-by": "", "cc-by-nc": " noncommercial", "cc-by-nc-nd": " noncommercial no ?deriv(?:s|atives)", "cc-by-nc-sa": " noncommercial share ?alike", "cc-by-nd": " no ?deriv(?:s|atives)", "cc-by-sa": " share ?alike"}
# Written notices, headers and sentences of bodies, each with the label, keyword, priority and confidence.
NOTICES = [
    ("0bsd", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 83, 0.95),
    ("afl-3", "authorship", "this academic free license the license applies to any original work of authorship", 92, 0.97),
    ("agpl-3", "affero", f"gnu affero general public license {_GNU}(?: either)? version 3", 92, 0.98),
    ("agpl-3", "affero", "gnu affero general public license version 3 19 november 2007", 92, 0.99),
    ("apache-1", "apache", "this product includes software developed by the apache (?:software foundation|group)", 82, 0.9),
    ("apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 92, 0.99),
    ("apache-2", "apache", "licensed to the apache software foundation asf under one or more contributor license agreements", 88, 0.95),
    ("apache-2", "apache", "(?:www )?apache org licenses license 2 0", 88, 0.95),
    ("artistic-1", "package", "the intent of this document is to state the conditions under which a package may be copied", 88, 0.95),
    ("artistic-2", "package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 88, 0.97),
    ("bsd-3-clause", "endorse", "neither the name of(?: \\S+){1,20}? nor the names of its contributors may be used to endorse or promote products", 81, 0.9),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 83, 0.95),
    ("bsl-1", "boost", "distributed under the boost software license version 1 0 see accompanying file", 92, 0.98),
    ("cc0", "deed", "the person who associated a work with this deed has dedicated the work to the public domain", 88, 0.97),
    ("cc0", "waived", "to the extent possible under law(?: \\S+){1,20}? waived all copyright and related or neighboring rights", 88, 0.95),
    *[(label, "creative", f"licensed under (?:a|the) creative commons attribution{more} [1234] [05] (?:international|unported|generic|\\S+) licen[sc]e", 92, 0.98) for label, more in _CC.items()],
    *[(label, "creativecommons", f"creativecommons org licenses {label[3:].replace('-', ' ')} [1234] [05]", 88, 0.96) for label in _CC],
    ("cddl-1", "development", "subject to the terms of the common development and distribution license", 88, 0.95),
    ("cecill-2", "cecill", "governed by the cecill license under french law and abiding by the rules of distribution of free software", 88, 0.95),
    ("cpl-1", "accompanying", "the accompanying program is provided under the terms of this common public license", 88, 0.96),
    ("ecl-2", "educational", "licensed under the educational community license version 2 0 the license you may not use this file except in compliance", 92, 0.98),
    ("epl-1", "eclipse", "made available under the terms of the eclipse public license (?:version |v ?)?1 0", 92, 0.98),
    ("epl-2", "eclipse", "made available under the terms of the eclipse public license (?:version |v ?)?2 0", 92, 0.98),
    ("eupl-1", "eupl", "this european union public licence the eupl applies to the work", 88, 0.96),
    ("gfdl-1", "documentation", "copy distribute and or modify this document under the terms of the gnu free documentation license", 88, 0.97),
    ("gpl-1", "gnu", f"gnu general public license {_GNU}(?: either)? version 1", 92, 0.97),
    ("gpl-2", "gnu", f"gnu general public license {_GNU}(?: either)? version 2", 92, 0.98),
    ("gpl-3", "gnu", f"gnu general public license {_GNU}(?: either)? version 3", 92, 0.98),
    ("gpl-1", "gnu", "gnu general public license version 1 february 1989", 92, 0.99),
    ("gpl-2", "gnu", "gnu general public license version 2 june 1991", 92, 0.99),
    ("gpl-3", "gnu", "gnu general public license version 3 29 june 2007", 92, 0.99),
    ("isc", "fee", "with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 81, 0.95),
    ("lgpl-2", "gnu", f"gnu (?:lesser|library) general public license {_GNU}(?: either)? version 2(?: 1)?", 92, 0.98),
    ("lgpl-3", "gnu", f"gnu lesser general public license {_GNU}(?: either)? version 3", 92, 0.98),
    ("lgpl-2", "gnu", "gnu lesser general public license version 2 1 february 1999", 92, 0.99),
    ("lgpl-3", "gnu", "gnu lesser general public license version 3 29 june 2007", 92, 0.99),
    ("lppl-1", "latex", "distributed and or modified under the conditions of the latex project public license", 88, 0.96),
    ("mit", "sublicense", "use copy modify merge publish distribute sublicense and or sell copies of the software", 78, 0.85),
    ("mpl-1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 [01]", 92, 0.98),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 92, 0.99),
    ("ms-pl", "microsoft", "microsoft public license ms pl this license governs use of the accompanying software", 92, 0.98),
    ("ms-rl", "recipients", "for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file", 88, 0.96),
    ("ncsa", "deal", "to deal with the software without restriction including without limitation", 82, 0.93),
    ("odbl-1", "database", "made available under the open database license", 88, 0.95),
    ("ofl-1", "font", "this font software is licensed under the sil open font license version 1 [01]", 92, 0.99),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 88, 0.95),
    ("osl-3", "authorship", "this open software license the license applies to any original work of authorship", 92, 0.97),
    ("postgresql", "fee", "for any purpose without fee and without a written agreement is hereby granted", 83, 0.93),
    ("psf-2", "python", "this license agreement is between the python software foundation psf and the individual or organization licensee", 88, 0.97),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 88, 0.97),
    ("upl-1", "condition", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data", 88, 0.97),
    ("wtfpl", "fuck", "you just do what the fuck you want to", 88, 0.95),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 82, 0.95),
]


def cue(name: str) -> str:
    """The longest plain word of a name that tells it from others; without it the name can't match."""
    words = [w for w in name.split() if w.isalnum()]
    return max([w for w in words if w not in GENERIC] or words, key=len)


def rule_table() -> list[tuple[str, str, list[str], str, int, float]]:
    """(label, keyword, cues, expression, priority, confidence) of every rule: each family in six or seven ways of naming it.

    The keyword and one of the cues must occur before the expression is tried; no cues: the keyword alone is enough.
    """
    rules = [(label, phrase, [], phrase, 100, 1.0) for phrase, label in BASE.items()]
    for label, name, short, version in FAMILIES:
        marked = f"(?: (?:version |v ?|ver )?{version})" if version else ""
        shorts = [cue(x) for x in short.split("|")]
        grants = "(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?"
        spdx = label.replace("-", " ") + ("(?: 0)?" if version else "")
        rules += [
            (label, "under", [cue(name)], f"{grants}{name}{marked}", 90, 0.98),
            (label, "license" if "license" in name.split() else cue(name), [cue(name)], f"{name}{marked}", 70 if version else 60, 0.92 if version else 0.85),
            (label, "under", shorts, f"{grants}(?:{short}){marked}(?: license)?", 75, 0.9),
            (label, "license", shorts, f"(?:{short}){marked} license", 55, 0.8),
            (label, "spdx", [], f"spdx license identifier {spdx}(?: only| or later)?", 95, 0.99),
            (label, "license", shorts, f"license (?:is )?(?:the )?(?:{short}){marked}", 50, 0.75),
        ]
        if label.startswith("cc-"):  # these names stand alone with their version
            rules.append((label, "cc", [], f"{short} {version}", 45, 0.65))
    rules += [(label, word, [], text, priority, confidence) for label, word, text, priority, confidence in SENTENCES + NOTICES]
    return sorted(rules, key=lambda r: (-r[4], r[0], r[3]))


def normalised(text):
    """Words joined by single blanks with one blank on either side; two blanks for a text without words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, SEPARATORS, " ")), F.lit(" "))


#: First word and number of words of every place of rule r. An expression starts with the blank before its first word
#: and leaves the blank after its last, so the blanks before a place count the words before it. The pieces between
#: places come from split and the places from regexp_extract_all.
PLACES = """
  aggregate(
    arrays_zip(split(norm, r.expr), regexp_extract_all(norm, r.expr, 0)),
    named_struct('words', 0L, 'out', cast(array() AS array<struct<start:bigint,words:bigint>>)),
    (s, x) -> named_struct(
      'words', cast(s.words + length(x.`0`) - length(replace(x.`0`, ' ', '')) + coalesce(length(x.`1`) - length(replace(x.`1`, ' ', '')), 0) AS bigint),
      'out', if(x.`1` IS NULL, s.out, array_append(s.out, named_struct(
         'start', cast(s.words + length(x.`0`) - length(replace(x.`0`, ' ', '')) AS bigint),
         'words', cast(length(x.`1`) - length(replace(x.`1`, ' ', '')) AS bigint))))),
    s -> s.out)"""
#: The outer lambda binds the cues once for each text; as a column they would be inlined into the inner lambda.
DETECTED = f"""
  transform(array(cued), cues -> flatten(transform(filter(rules, r -> array_contains(keys, r.keyword) AND (size(r.cues) = 0 OR arrays_overlap(r.cues, cues)) AND regexp_like(norm, r.expr)), r ->
    transform({PLACES}, p -> named_struct('start', p.start, 'words', p.words, 'priority', r.priority, 'label', r.label, 'rule', r.rule, 'confidence', r.confidence)))))[0]"""
KEPT = """
  filter(found, p -> NOT exists(found, q -> q.start <= p.start AND q.start + q.words >= p.start + p.words AND (
    q.priority > p.priority OR (q.priority = p.priority AND (q.words > p.words OR (q.words = p.words AND (
      q.label < p.label OR (q.label = p.label AND q.rule < p.rule))))))))"""


def detect(docs: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """doc_id, n_words, found (all places of all rules) and kept (after suppression), one row for each input row."""
    rules = rule_table() if rules is None else rules
    constant = F.array(*[
        F.struct(
            F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(word).alias("keyword"), F.array(*map(F.lit, cues)).cast("array<string>").alias("cues"),
            F.lit(f"(?i) (?:{text})(?= )").alias("expr"), F.lit(priority).alias("priority"), F.lit(conf).alias("confidence"),
        )
        for i, (label, word, cues, text, priority, conf) in enumerate(rules)
    ])
    held = lambda words: F.array_compact(F.array(*[F.when(F.contains("low", F.lit(f" {w} ")), F.lit(w)) for w in words]))
    some = F.size("keys") > 0
    none = "cast(array() AS array<struct<start:bigint,words:bigint,priority:int,label:string,rule:int,confidence:double>>)"
    body = id_and_text(docs).select("doc_id", normalised(F.col("text")).alias("norm"))
    body = body.withColumn("low", F.lower("norm"))  # only for the cheap gates; it may hold more keywords than count, never fewer
    blanks = (F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit("")))).cast("long")
    body = body.withColumn("n_words", F.when(F.trim("norm") == "", F.lit(0)).otherwise(blanks - 1).cast("long"))
    body = body.withColumn("keys", held(sorted({r[1] for r in rules})))
    body = body.withColumn("cued", F.when(some, held(sorted({c for r in rules for c in r[2]})))).withColumn("rules", F.when(some, constant))
    body = body.withColumn("found", F.when(some, F.expr(DETECTED)).otherwise(F.expr(none)))
    return body.select("doc_id", "n_words", "found", F.expr(KEPT).alias("kept"))


def scan_licenses(docs: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found, n_kept."""
    places = detect(docs, rules).withColumn("base", F.expr("filter(found, p -> p.priority >= 100)"))
    starts = F.expr("transform(base, p -> p.start)")
    named = lambda column: F.array_join(F.array_sort(F.array_distinct(F.expr(f"transform({column}, p -> p.label)"))), ",")
    return places.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named("base").alias("base_labels"), named("kept").alias("labels"),
        F.coalesce(F.array_max(F.expr("transform(kept, p -> p.confidence)")), F.lit(0.0)).alias("score"),
        F.size("found").cast("long").alias("n_found"), F.size("kept").cast("long").alias("n_kept"),
    )
