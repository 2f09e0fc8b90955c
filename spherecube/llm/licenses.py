"""License scan by ordered signature rules, DataFrame functions only.

A text becomes its words. Words that start a rule (keywords) are the prefilter: a text without one is done. Around every
keyword the rules of that keyword look at the words before and after it; a hit is the interval of words it covers. Rules
are ordered: of hits with the same interval the rule of higher priority (lower number) stays, and a hit inside another
hit's interval is suppressed, so that "apache license version 2 0" is not also "apache license".
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Fixed values of the base scan: what separates words, and its phrases with their labels.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words before and after a keyword that rules may look at.
REACH = 24

#: Names of licenses as they are written in prose: the label and a pattern of normalised words, most specific first.
NAMES = [
    ("apache-2.0", r"apache(?: software)?", r"(?: version| v)? v?2(?: 0)?"),
    ("apache-1.1", r"apache(?: software)?", r"(?: version| v)? v?1 1"),
    ("apache", r"apache(?: software)?", r""),
    ("mit", r"(?:mit|expat|x11)", r""),
    ("mit-0", r"mit no attribution", r""),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", r""),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", r""),
    ("bsd-4-clause", r"(?:bsd 4 clause|original bsd)", r""),
    ("bsd-0-clause", r"(?:bsd zero clause|0bsd|bsd 0 clause)", r""),
    ("bsd", r"bsd(?: style)?", r""),
    ("agpl-3.0", r"(?:gnu )?affero general public", r"(?: version| v)? v?3(?: 0)?"),
    ("agpl", r"(?:gnu )?affero general public", r""),
    ("lgpl-3.0", r"(?:gnu )?lesser general public", r"(?: version| v)? v?3(?: 0)?"),
    ("lgpl-2.1", r"(?:gnu )?lesser general public", r"(?: version| v)? v?2 1"),
    ("lgpl-2.0", r"(?:gnu )?library general public", r"(?: version| v)? v?2(?: 0)?"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public", r""),
    ("gpl-3.0", r"(?:gnu )?general public", r"(?: as published by the free software foundation either)?(?: version| v)? v?3(?: 0)?"),
    ("gpl-2.0", r"(?:gnu )?general public", r"(?: as published by the free software foundation either)?(?: version| v)? v?2(?: 0)?"),
    ("gpl-1.0", r"(?:gnu )?general public", r"(?: as published by the free software foundation either)?(?: version| v)? v?1(?: 0)?"),
    ("gpl", r"(?:gnu )?general public", r""),
    ("gfdl", r"(?:gnu )?free documentation", r""),
    ("mpl-2.0", r"mozilla public", r"(?: version| v)? v?2(?: 0)?"),
    ("mpl-1.1", r"mozilla public", r"(?: version| v)? v?1 1"),
    ("mpl", r"mozilla public", r""),
    ("epl-2.0", r"eclipse public", r"(?: version| v)? v?2(?: 0)?"),
    ("epl-1.0", r"eclipse public", r"(?: version| v)? v?1(?: 0)?"),
    ("epl", r"eclipse public", r""),
    ("eupl", r"european union public", r""),
    ("cddl", r"common development and distribution", r""),
    ("cpl", r"common public", r""),
    ("isc", r"isc", r""),
    ("zlib", r"(?:zlib|zlib libpng)", r""),
    ("libpng", r"libpng", r""),
    ("bsl-1.0", r"boost software", r""),
    ("busl", r"business source", r""),
    ("sspl", r"server side public", r""),
    ("elastic", r"elastic", r""),
    ("artistic", r"(?:perl )?artistic", r""),
    ("python", r"(?:python software foundation|psf)", r""),
    ("php", r"php", r""),
    ("ruby", r"ruby", r""),
    ("openssl", r"openssl", r""),
    ("postgresql", r"postgresql", r""),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r""),
    ("unlicense", r"unlicense", r""),
    ("wtfpl", r"do what the fuck you want to public", r""),
    ("odbl", r"open database", r""),
    ("odc-by", r"open data commons attribution", r""),
    ("ofl", r"(?:sil )?open font", r""),
    ("osl", r"open software", r""),
    ("afl", r"academic free", r""),
    ("mulan", r"mulan permissive software", r""),
    ("ms-pl", r"microsoft public", r""),
    ("ms-rl", r"microsoft reciprocal", r""),
    ("qpl", r"q public", r""),
    ("cc-by", r"creative commons attribution(?: international)?", r""),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: international)?", r""),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: international)?", r""),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: international)?", r""),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s(?: international)?", r""),
    ("proprietary", r"proprietary", r""),
    ("commercial", r"commercial", r""),
]

#: Short identifiers, as they follow "licensed under" or "SPDX-License-Identifier:".
IDENTIFIERS = [
    ("cc-by-nc-sa", r"cc by nc sa"), ("cc-by-nc-nd", r"cc by nc nd"), ("cc-by-nc", r"cc by nc"), ("cc-by-sa", r"cc by sa"),
    ("cc-by-nd", r"cc by nd"), ("cc-by", r"cc by"), ("cc0", r"cc0"), ("mit", r"mit"), ("apache-2.0", r"apache 2(?: 0)?"),
    ("gpl-3.0", r"(?:gnu )?gpl ?v?3?(?<=3)"), ("gpl-2.0", r"(?:gnu )?gpl ?v?2?(?<=2)"), ("gpl", r"(?:gnu )?gpl"),
    ("lgpl-3.0", r"lgpl ?v?3?(?<=3)"), ("lgpl-2.1", r"lgpl ?v?2 1"), ("lgpl", r"lgpl"), ("agpl-3.0", r"agpl ?v?3?(?<=3)"), ("agpl", r"agpl"),
    ("bsd-3-clause", r"bsd 3 clause"), ("bsd-2-clause", r"bsd 2 clause"), ("bsd", r"bsd"), ("mpl-2.0", r"mpl 2 0"), ("mpl", r"mpl"),
    ("epl-2.0", r"epl 2 0"), ("epl", r"epl"), ("isc", r"isc"), ("zlib", r"zlib"), ("bsl-1.0", r"bsl 1 0"), ("unlicense", r"unlicense"),
    ("wtfpl", r"wtfpl"), ("cddl", r"cddl"), ("eupl", r"eupl"), ("ofl", r"ofl 1 1"), ("python", r"psf 2 0"), ("artistic", r"artistic 2 0"),
]

#: Sentences of license texts and notices: label, keyword, what stands before it, what follows.
SENTENCES = [
    ("mit", "permission", r"", r" is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", r"", r" to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"", r" and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither", r"", r" the name of .{0,60}nor the names of its contributors"),
    ("bsd-4-clause", "advertising", r"all ", r" materials mentioning features or use of this software"),
    ("gpl", "redistribute", r"you can ", r" it and or modify it under the terms of the gnu general public"),
    ("lgpl", "redistribute", r"you can ", r" it and or modify it under the terms of the gnu lesser general public"),
    ("agpl", "redistribute", r"you can ", r" it and or modify it under the terms of the gnu affero general public"),
    ("gpl", "warranty", r"without any ", r" without even the implied warranty of merchantability"),
    ("apache-2.0", "compliance", r"you may not use this file except in ", r" with the licen[sc]e"),
    ("mpl-2.0", "source", r"", r" code form is subject to the terms of the mozilla public"),
    ("zlib", "software", r"", r" is provided as is without any express or implied warranty"),
    ("bsl-1.0", "permission", r"", r" is hereby granted free of charge to any person or organization"),
    ("unlicense", "software", r"", r" released into the public domain"),
    ("public-domain", "domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public ", r""),
    ("cc0", "dedication", r"public domain ", r""),
    ("all-rights-reserved", "rights", r"all ", r" reserved"),
    ("cc-by", "attribution", r"creative commons ", r" (?:4|3|2) (?:0|5)"),
]


def signature_rules() -> list[dict]:
    """All rules in order: keyword, pattern of the words before it, of the words after it, label, confidence."""
    rules = []
    add = lambda kw, before, after, label, conf: rules.append(
        {"kw": kw, "before": f"(?:^| ){before}$" if before else "$", "after": f"^{after}(?= |$)" if after else "^", "label": label, "conf": conf}
    )
    for label, keyword, before, after in SENTENCES:
        add(keyword, before, after, label, 0.95)
    for label, name in IDENTIFIERS:
        add("spdx", "", f" licen[sc]e identifier {name}", label, 0.99)
        add("licensed", "", f" under(?: the)?(?: terms of)?(?: the)? {name}(?: licen[sc]e)?", label, 0.9)
        add("license", "", f" {name}", label, 0.6)
    for label, name, version in NAMES:
        for keyword in ("license", "licence"):
            add(keyword, f"{name} ", version, label, 0.85 if version else 0.7)
        add("licensed", "", f" under(?: the)?(?: terms of)?(?: the)? {name}(?: licen[sc]e)?{version}", label, 0.9 if version else 0.8)
        add("licenses", "", f" {name}{version}", label, 0.75)
    return [{**r, "prio": i} for i, r in enumerate(rules)]


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    """Number of words in a string of words with single spaces, with or without spaces around it."""
    trimmed = F.trim(text)
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1)


def normalised(text: Column) -> Column:
    """The words of a text, in lower case, with one space between, before and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), APART, " ")), F.lit(" "))


def detections(words: Column, rules: list[dict]) -> Column:
    """start, end (exclusive), prio, label, conf of every rule's hits in an array of words, containing hits first."""
    by_keyword: dict[str, list[dict]] = {}
    for r in rules:
        by_keyword.setdefault(r["kw"], []).append({k: v for k, v in r.items() if k != "kw"})
    table = F.from_json(F.lit(json.dumps(by_keyword)), "map<string, array<struct<before: string, after: string, label: string, conf: double, prio: int>>>")
    keywords = F.array(*[F.lit(k) for k in sorted(by_keyword)])

    def around(a: Column, all_words: Column) -> Column:
        first = F.greatest(a["i"] - REACH, F.lit(0))
        before = F.array_join(F.slice(all_words, first + 1, a["i"] - first), " ")
        after = F.array_join(F.slice(all_words, a["i"] + 2, F.lit(REACH)), " ")
        return F.struct(
            a["w"].alias("w"), a["i"].alias("i"), F.when(before == "", "").otherwise(F.concat(before, F.lit(" "))).alias("before"),
            F.when(after == "", "").otherwise(F.concat(F.lit(" "), after)).alias("after"),
        )

    def hits(c: Column) -> Column:
        fitting = F.filter(table[c["w"]], lambda r: F.rlike(c["before"], r["before"]) & F.rlike(c["after"], r["after"]))
        return F.transform(fitting, lambda r: F.struct(
            (c["i"] - _words(F.coalesce(F.regexp_substr(c["before"], r["before"]), F.lit("")))).alias("start"),
            (-(c["i"] + 1 + _words(F.coalesce(F.regexp_substr(c["after"], r["after"]), F.lit(""))))).alias("minus_end"),
            r["prio"].alias("prio"), r["label"].alias("label"), r["conf"].alias("conf"),
        ))

    def of(w: Column) -> Column:
        anchors = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda a: F.array_contains(keywords, a["w"]))
        return F.sort_array(F.flatten(F.transform(F.transform(anchors, lambda a: around(a, w)), hits)))

    return _let(words, of)


def surviving(hits: Column) -> Column:
    """labels and the highest confidence of the hits that no earlier or equal interval contains."""
    start = F.struct(F.lit(-1).alias("upto"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("conf"))

    def step(state: Column, h: Column) -> Column:
        inside = -h["minus_end"] <= state["upto"]
        return F.when(inside, state).otherwise(F.struct(
            (-h["minus_end"]).alias("upto"), F.array_union(state["labels"], F.array(h["label"])).alias("labels"),
            F.greatest(state["conf"], h["conf"]).alias("conf"),
        ))

    return F.aggregate(hits, start, step)


def license_scan(docs: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of `docs` (doc_id, text).

    n_base counts the places of the base phrases, first_word and last_word are their smallest and largest start (null
    without one). labels are the base labels and those of the surviving hits, sorted and joined by commas, or empty.
    score is the highest confidence of a surviving hit, 0.5 where only base phrases were found, 0 without a label. A
    null text is an empty one; rows are treated each by itself, whatever their ids; other columns are not looked at.
    """
    rules = signature_rules() if rules is None else rules
    keyword = "|".join(sorted({r["kw"] for r in rules}))
    any_phrase = " (?:" + "|".join(PHRASES) + ")(?= )"
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    has_base = F.contains("norm", F.lit(" license "))
    base = F.when(has_base, F.regexp_extract_all("norm", F.lit(any_phrase), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", "norm", F.transform(base, lambda p: F.trim(p)).alias("base"))
    between = _let(F.split("norm", any_phrase, -1), lambda p: F.struct(p[0].alias("head"), F.element_at(p, -1).alias("tail")))
    gate = F.rlike("norm", F.lit(f" (?:{keyword}) "))
    found = F.when(gate, surviving(detections(F.split(F.trim("norm"), " "), rules)))
    rows = rows.select("doc_id", "norm", "base", F.when(F.size("base") > 0, between).alias("around"), found.alias("found"))
    label = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    n_words = _words(F.col("norm"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda p: label[p])))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce(F.col("found.labels"), F.array().cast("array<string>"))))
    conf = F.coalesce(F.col("found.conf"), F.lit(0.0))
    return rows.select(
        "doc_id", n_words.cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        _words(F.col("around.head")).cast("long").alias("first_word"),
        (n_words - _words(F.col("around.tail")) - _words(F.element_at("base", F.when(F.size("base") > 0, -1).otherwise(F.lit(None).cast("int"))))).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when((F.size("base") > 0), F.greatest(conf, F.lit(0.5))).otherwise(conf).alias("score"),
    )
