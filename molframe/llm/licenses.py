"""License scans by ordered signature rules.

A text's words are lower-cased and joined by blanks; rules are regular
expressions over that string. A rule is tried only where the text holds its
keywords, of which each of its matches has one. Detections are sorted
by place; one that lies inside another of the same or a better level is
suppressed; those that overlap in part both stay. Only built-in functions are used and no row is shuffled.

Rows: a null text is empty: no words, no places, score 0, empty labels. Each
input row gives one output row, repeated ids and texts too. An empty table gives
an empty result. A text of any length is scanned whole. Of equal detections the
first rule's counts once. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions.arrays import let
from molframe.llm.registry import ascii_lower, column
from molframe.llm.spans import matches

# Words of lower-cased text, and the base phrases; each phrase has a word that is a rule's keyword.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label, keywords of which one must be among the words, the name as a pattern over words, versions (empty: none).
FAMILIES = (
    ("apache", ("apache",), "apache(?: software)?", ("1 0", "1 1", "2 0")),
    ("mit", ("mit", "expat"), "(?:mit|expat)", ()),
    ("mit-0", ("mit",), "mit (?:0|no attribution)", ()),
    ("bsd-2-clause", ("bsd", "freebsd"), "(?:bsd 2 clause|simplified bsd|freebsd)", ()),
    ("bsd-3-clause", ("bsd",), "(?:bsd 3 clause|new bsd|modified bsd|revised bsd)", ()),
    ("bsd-4-clause", ("bsd",), "(?:bsd 4 clause|original bsd)", ()),
    ("0bsd", ("0bsd", "zero"), "(?:0bsd|zero clause bsd)", ()),
    ("gpl", ("general",), "(?:gnu )?general public", ("1", "2", "2 0", "3", "3 0")),
    ("gpl", ("gpl",), "(?:gnu )?gpl", ("1", "2", "2 0", "3", "3 0")),
    ("lgpl", ("lesser", "library"), "(?:gnu )?(?:lesser|library) general public", ("2", "2 0", "2 1", "3", "3 0")),
    ("lgpl", ("lgpl",), "(?:gnu )?lgpl", ("2", "2 0", "2 1", "3", "3 0")),
    ("agpl", ("affero",), "(?:gnu )?affero general public", ("1", "3", "3 0")),
    ("agpl", ("agpl",), "(?:gnu )?agpl", ("1", "3", "3 0")),
    ("gfdl", ("documentation",), "(?:gnu )?free documentation", ("1 1", "1 2", "1 3")),
    ("mpl", ("mozilla",), "mozilla public", ("1 0", "1 1", "2 0")),
    ("mpl", ("mpl",), "mpl", ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse",), "eclipse public", ("1 0", "2 0")),
    ("edl", ("eclipse",), "eclipse distribution", ("1 0",)),
    ("eupl", ("european",), "european union public", ("1 0", "1 1", "1 2")),
    ("cddl", ("cddl",), "cddl", ("1 0", "1 1")),
    ("cddl", ("distribution",), "common development and distribution", ("1 0", "1 1")),
    ("cpl", ("common",), "common public", ("1 0",)),
    ("ipl", ("ibm",), "ibm public", ("1 0",)),
    ("osl", ("open",), "open software", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", ("academic",), "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", ("artistic",), "artistic", ("1 0", "2 0")),
    ("isc", ("isc",), "isc", ()),
    ("zlib", ("zlib",), "zlib(?: libpng)?", ()),
    ("libpng", ("libpng",), "libpng", ("2 0",)),
    ("boost", ("boost",), "boost software", ("1 0",)),
    ("bsl", ("business",), "business source", ("1 1",)),
    ("unlicense", ("unlicense",), "unlicense", ()),
    ("wtfpl", ("wtfpl",), "wtfpl", ("1", "2")),
    ("python", ("python",), "python software foundation", ("2", "2 0")),
    ("php", ("php",), "php", ("3 0", "3 01")),
    ("ruby", ("ruby",), "ruby", ()),
    ("postgresql", ("postgresql",), "postgresql", ()),
    ("openssl", ("openssl",), "openssl", ()),
    ("ofl", ("font",), "(?:sil )?open font", ("1 0", "1 1")),
    ("ncsa", ("ncsa",), "(?:university of illinois )?ncsa(?: open source)?", ()),
    ("ms-pl", ("microsoft",), "microsoft public", ()),
    ("ms-rl", ("microsoft",), "microsoft reciprocal", ()),
    ("odbl", ("database",), "open (?:data commons )?(?:open )?database", ("1 0",)),
    ("sspl", ("server",), "server side public", ("1",)),
    ("elastic", ("elastic",), "elastic", ("2 0",)),
    ("cecill", ("cecill",), "cecill(?: b| c)?", ("1 0", "2 0", "2 1")),
    ("blueoak", ("oak",), "blue oak model", ("1 0 0",)),
    ("mulan", ("mulan",), "mulan (?:permissive software|psl)", ("1", "2")),
    ("vim", ("vim",), "vim", ()),
    ("x11", ("x11",), "x11", ()),
)

#: Variants of the public copyright licenses whose names are built of parts.
COMMONS = ("", " nc", " nd", " sa", " nc nd", " nc sa")
COMMONS_WORDS = {"nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}

# Passages of license texts that name no license: label, keyword (a word of every match), pattern.
PASSAGES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial", "shall be included in all copies or substantial portions of the software"),
    ("ncsa", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("boost", "hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("ofl", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("isc", "hereby", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "contributors", "nor the names of (?:its|their) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("apache", "compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", "www apache org licenses license 2 0"),
    ("apache-1.1", "apache", "this product includes software developed by the apache (?:software foundation|group)"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "authors", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0", "waived", "has waived all copyright and related or neighbou?ring rights"),
    ("wtfpl", "fuck", "do what the fuck you want to(?: public license)?"),
    ("artistic", "package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)"),
)
#: Versions of the general public licenses as their notices name them.
NOTICES = (("gpl", "", ("1", "2", "3")), ("lgpl", "lesser ", ("2 1", "3")), ("lgpl", "library ", ("2",)), ("agpl", "affero ", ("3",)))
#: Names that are common words: before "license" they are a hint only.
COMMON_WORDS = {"ruby", "elastic", "vim", "php"}

#: Level: 0 a grant or a passage of a license, 1 a name with version or identifier, 2 a name, 3 a hint. Better levels suppress what lies inside.
SCORES = (1.0, 0.9, 0.6, 0.3)


def rules() -> list[dict]:
    """The ordered rules: label, keywords, level and pattern over blank-separated words."""
    grant = r"(?:(?:re)?licen[cs]ed|released|distributed|available|published|provided) (?:to you )?(?:as \w+ )?under (?:the )?(?:terms of (?:the )?)?"
    made = []

    def add(label, keywords, level, pattern):
        made.append({"label": label, "keywords": keywords, "level": level, "pattern": f"(?<= ){pattern}(?= )"})

    for label, keywords, name, versions in FAMILIES:
        named = rf"{name} licen[cs]es?"
        add(label, keywords, 0, rf"{grant}{named}")
        add(label, ("spdx",), 0, rf"spdx license identifier {name}")
        hint = 3 if label in COMMON_WORDS else 2
        add(label, keywords, hint, named)
        add(label, keywords, hint, rf"licen[cs]ed? {name}")
        for version in versions:
            add(f"{label}-{version.replace(' ', '.')}", keywords, 0, rf"{grant}{name}(?: licen[cs]e)?(?: version| v)? v?{version}")
            add(f"{label}-{version.replace(' ', '.')}", keywords, 1, rf"{name}(?: licen[cs]e)?(?: version| v)? v?{version}")
            # The longer identifier suppresses the shorter ones it begins with.
            add(f"{label}-{version.replace(' ', '.')}", ("spdx",), 0, rf"spdx license identifier {name} {version}(?: only)?")
            add(f"{label}-{version.replace(' ', '.')}-or-later", ("spdx",), 0, rf"spdx license identifier {name} {version} or later")
    for label, keyword, passage in PASSAGES:
        add(label, (keyword,), 0, passage)
    for label, kind, versions in NOTICES:
        for version in versions:
            notice = rf"gnu {kind}general public license as published by the free software foundation (?:either )?version {version}"
            add(f"{label}-{version.replace(' ', '.')}", ("foundation",), 0, notice)
            later = rf"{notice} of the license or at your option any later version"
            add(f"{label}-{version.replace(' ', '.')}-or-later", ("foundation",), 0, later)
    add("mit-or-apache-2.0", ("mit", "expat"), 0, "(?:mit|expat) (?:or |and )?apache 2 0")
    add("mit-or-apache-2.0", ("mit", "expat"), 0, "apache 2 0 (?:or |and )?(?:mit|expat)")
    for parts in COMMONS:
        words = "".join(f" {COMMONS_WORDS[p]}" for p in parts.split())
        label = "cc-by" + parts.replace(" ", "-")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            add(f"{label}-{version.replace(' ', '.')}", ("cc",), 1, rf"cc by{parts} {version}")
        add(label, ("cc",), 2, rf"cc by{parts}")
        add(label, ("cc",), 0, rf"{grant}cc by{parts}")
        add(label, ("commons",), 1, rf"(?:creative )?commons attribution{words}")
    add("cc0", ("cc0",), 1, "cc0(?: 1 0)?")
    add("public-domain", ("domain",), 2, "public domain")
    add("copyright", ("copyright",), 3, r"copyright (?:c )?(?:[0-9]{4} )?\w+")
    add("copyleft", ("copyleft",), 3, "copyleft")
    add("reserved", ("reserved",), 2, "(?:all|some) rights reserved")
    add("license-notice", ("license", "licence"), 3, "(?:this|the|see|under) (?:following )?licen[cs]e")
    return made


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _kept(found: Column) -> Column:
    """Detections in order, without those inside one of the same or a better level."""
    levels = range(len(SCORES))
    none = F.struct(
        F.array(*[F.lit(-1).cast("bigint") for _ in levels]).alias("reach"),
        F.array().cast("array<struct<level:int,label:string>>").alias("kept"),
    )

    def step(state, d):
        # Sorted by start: what began before contains d if it reaches as far.
        inside = F.exists(F.slice(state["reach"], F.lit(1), d["level"] + 1), lambda r: r >= d["end"])
        reach = F.transform(
            state["reach"], lambda r, i: F.when(i == d["level"], F.greatest(r, d["end"])).otherwise(r)
        )
        one = F.array(F.struct(d["level"].alias("level"), d["label"].alias("label")))
        return F.when(inside, state).otherwise(
            F.struct(reach.alias("reach"), F.array_distinct(F.concat(state["kept"], one)).alias("kept"))
        )

    return F.aggregate(found, none, step, lambda s: s["kept"])


def _scan(words: Column) -> Column:
    """struct(n_words, base, kept) of one text from its words; the last two are null where no keyword occurs."""
    table = rules()
    kind = "array<struct<label:string,keywords:array<string>,level:int,pattern:string>>"
    listed = F.from_json(F.lit(json.dumps(table)), kind)
    keywords = F.array(*[F.lit(k) for k in sorted({k for r in table for k in r["keywords"]})])

    def scan(ws, present):
        joined = F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))

        def on(text):
            base = [
                F.transform(
                    matches(text, F.lit(f"(?<= ){phrase}(?= )"), 0, _blanks),
                    lambda m: F.struct((m["start"] - 1).alias("start"), F.lit(label).alias("label")),
                )
                for phrase, label in BASE
            ]
            tried = F.filter(listed, lambda r: F.arrays_overlap(present, r["keywords"]))
            found = F.flatten(
                F.transform(
                    tried,
                    lambda r: F.transform(
                        matches(text, r["pattern"], 0, _blanks),
                        # Ordered by start, longest first, best level first.
                        lambda m: F.struct(
                            m["start"].alias("start"),
                            (-m["end"]).alias("longest"),
                            r["level"].alias("level"),
                            r["label"].alias("label"),
                            m["end"].alias("end"),
                        ),
                    ),
                )
            )
            return F.struct(F.concat(*base).alias("base"), _kept(F.sort_array(found)).alias("kept"))

        return let(joined, on)

    def gated(ws):
        found = let(F.array_intersect(ws, keywords), lambda present: F.when(F.size(present) > 0, scan(ws, present)))
        return let(
            found,
            lambda f: F.struct(
                F.size(ws).cast("bigint").alias("n_words"), f["base"].alias("base"), f["kept"].alias("kept")
            ),
        )

    return let(words, gated)


def scan_licenses(df: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(column(text), F.lit(""))), F.lit(WORDS), F.lit(0))
    rows = df.select(column(id).alias("doc_id"), _scan(words).alias("scan"))
    starts = F.transform("scan.base", lambda b: b["start"])
    base_labels = F.transform("scan.base", lambda b: b["label"])
    found_labels = F.transform("scan.kept", lambda k: k["label"])
    best = F.array_min(F.transform("scan.kept", lambda k: k["level"]))
    scores = F.array(*[F.lit(s) for s in SCORES])

    def listed(labels):
        return F.coalesce(F.array_join(F.sort_array(F.array_distinct(labels)), ","), F.lit(""))

    return rows.select(
        "doc_id",
        "scan.n_words",
        F.coalesce(F.greatest(F.size("scan.base"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(base_labels).alias("base_labels"),
        listed(F.concat(base_labels, found_labels)).alias("labels"),
        F.coalesce(F.get(scores, best), F.lit(0.0)).alias("score"),
    )
