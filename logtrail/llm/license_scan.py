"""License scan by ordered signature rules, in DataFrame functions only.

A rule is a regular expression with a keyword that its matches contain, a label, a priority and a
weight. What a rule needs to match (its family's names at the beginning of a word, its sentence, its
marker) is looked for first, all in one expression; only texts that hold any of it are looked at further, and
in them each rule whose need occurs is matched everywhere. No match is lost by that. A detection inside another of higher
priority (or of the same, if longer or from an earlier rule) is suppressed.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier, keyword, names as a regular expression, versions.
FAMILIES = (
    ("apache", "ap", r"apache (?:software )?licen[sc]e|apl|apache", ("1.0", "1.1", "2.0")),
    ("gpl", "g", r"gnu general public licen[sc]e|(?<!lesser )(?<!affero )(?<!library )general public licen[sc]e|gnu gpl|(?<![al])gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", "l", r"(?:gnu )?(?:lesser|library) general public licen[sc]e|gnu lgpl|lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", "a", r"(?:gnu )?affero general public licen[sc]e|gnu agpl|agpl", ("1.0", "3.0")),
    ("gfdl", "f", r"gnu free documentation licen[sc]e|gfdl|gnu fdl", ("1.1", "1.2", "1.3")),
    ("mpl", "m", r"mozilla public licen[sc]e|mpl", ("1.0", "1.1", "2.0")),
    ("epl", "e", r"eclipse public licen[sc]e|epl", ("1.0", "2.0")),
    ("cpl", "c", r"common public licen[sc]e|cpl", ("1.0",)),
    ("cddl", "d", r"common development and distribution licen[sc]e|cddl", ("1.0", "1.1")),
    ("eupl", "e", r"european union public licen[sc]e|eupl", ("1.0", "1.1", "1.2")),
    ("osl", "o", r"open software licen[sc]e|osl", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "a", r"academic free licen[sc]e|afl", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", "artistic", r"artistic licen[sc]e", ("1.0", "2.0")),
    ("lppl", "l", r"latex project public licen[sc]e|lppl", ("1.0", "1.1", "1.2", "1.3")),
    ("apsl", "apple", r"apple public source licen[sc]e", ("1.0", "1.1", "1.2", "2.0")),
    ("zpl", "z", r"zope public licen[sc]e|zpl", ("1.1", "2.0", "2.1")),
    ("cecill", "cecill", r"cecill(?: licen[sc]e)?", ("1.0", "1.1", "2.0", "2.1")),
    ("python", "python", r"python software foundation licen[sc]e|psf licen[sc]e agreement for python|python licen[sc]e", ("2.0",)),
    ("php", "php", r"php licen[sc]e", ("3.0", "3.01")),
    ("boost", "boost", r"boost software licen[sc]e", ("1.0",)),
    ("ofl", "o", r"sil open font licen[sc]e|open font licen[sc]e|ofl", ("1.0", "1.1")),
    ("upl", "u", r"universal permissive licen[sc]e|upl", ("1.0",)),
    ("mulan", "mulan", r"mulan permissive software licen[sc]e|mulan psl", ("1.0", "2.0")),
    ("ms-pl", "p", r"microsoft public licen[sc]e|ms-pl", ()),
    ("ms-rl", "r", r"microsoft reciprocal licen[sc]e|ms-rl", ()),
    ("sspl", "s", r"server side public licen[sc]e|sspl", ("1.0",)),
    ("busl", "business", r"business source licen[sc]e", ("1.0", "1.1")),
    ("elastic", "elastic", r"elastic licen[sc]e", ("1.0", "2.0")),
    ("odbl", "o", r"open database licen[sc]e|odbl", ("1.0",)),
    ("odc-by", "o", r"open data commons attribution licen[sc]e|odc-by", ("1.0",)),
    ("pddl", "p", r"public domain dedication and licen[sc]e|pddl", ("1.0",)),
    ("cc0", "c", r"cc0|creative commons zero", ("1.0",)),
    ("bsd-2-clause", "bsd", r"(?:simplified|2-clause|two-clause|freebsd) bsd(?: licen[sc]e)?|bsd[- ]2[- ]clause(?: licen[sc]e)?", ()),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified|3-clause|three-clause) bsd(?: licen[sc]e)?|bsd[- ]3[- ]clause(?: licen[sc]e)?", ()),
    ("bsd-4-clause", "bsd", r"(?:original|4-clause|four-clause) bsd(?: licen[sc]e)?|bsd[- ]4[- ]clause(?: licen[sc]e)?", ()),
    ("bsd", "bsd", r"bsd(?:-style)? licen[sc]e", ()),
    ("mit", "licen", r"mit licen[sc]e|mit/x11 licen[sc]e|expat licen[sc]e", ()),
    ("x11", "x11", r"x11 licen[sc]e", ()),
    ("isc", "isc", r"isc licen[sc]e", ()),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", ()),
    ("unlicense", "unlicen", r"(?:the )?unlicen[sc]e", ()),
    ("wtfpl", "w", r"wtfpl|do what the fuck you want to public licen[sc]e", ("1.0", "2.0")),
    ("ncsa", "n", r"university of illinois/ncsa open source licen[sc]e|ncsa licen[sc]e", ()),
    ("openssl", "openssl", r"openssl licen[sc]e", ()),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", ()),
    ("ruby", "ruby", r"ruby licen[sc]e", ()),
    ("vim", "vim", r"vim licen[sc]e", ()),
    ("beerware", "beer", r"beer-?ware licen[sc]e|beerware", ()),
    ("public-domain", "public domain", r"(?:released|dedicated|placed|work is) (?:in|in)?to the public domain|in the public domain", ()),
)
_CC_PARTS = {"by": "attribution", "sa": "share[- ]?alike", "nc": "non-?commercial", "nd": "no-?deriv(?:ative)?s?(?: works)?"}
_CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Sentences of the license texts themselves: label, keyword, expression.
SENTENCES = (
    ("mit", "permission", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "permission", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("apache-2.0", "apache.org", r"https?://www\.apache\.org/licenses/license-2\.0"),
    ("gpl", "free software", r"this program is free software[:;,] you can redistribute it and/or modify"),
    ("gpl", "gnu.org", r"https?://www\.gnu\.org/licenses/gpl"),
    ("lgpl", "gnu.org", r"https?://www\.gnu\.org/licenses/lgpl"),
    ("mpl-2.0", "mozilla.org", r"https?://(?:www\.)?mozilla\.org/mpl/2\.0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
)


_OPTIONAL = re.compile(r"\(\?:[^()]*\)\?")


def _families() -> list[tuple[str, str, str, tuple[str, ...]]]:
    """All families, those of Creative Commons included."""
    words = {kind: "[- ]+".join(_CC_PARTS[p] for p in kind.split("-")) for kind in _CC_KINDS}
    return [*FAMILIES, *((f"cc-{kind}", "c", rf"cc[- ]{kind}|creative commons {words[kind]}(?! ?-)", _CC_VERSIONS) for kind in _CC_KINDS)]


def _alternatives(expression: str) -> list[str]:
    """The outermost alternatives of an expression."""
    out, depth = [""], 0
    for ch in expression:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += ch
    return out


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """``id, label, keyword, expression, priority, weight`` in order, built from the families by their forms."""
    return [rule for rule, _ in _with_needs()]


def _with_needs() -> list[tuple[tuple[int, str, str, str, int, float], str]]:
    """The rules with an expression that every text a rule matches also matches."""
    out = []

    def add(label: str, keyword: str, expression: str, priority: int, weight: float, need: str) -> None:
        out.append(((len(out), label, keyword, expression, priority, weight), need))

    def forms(label: str, keyword: str, names: str, versions: tuple[str, ...]) -> None:
        named, marked = rf"\b(?:{names})", "spdx-license-identifier:"
        for version in versions:
            major, minor = version.split(".")
            number = rf"{major}(?:\.{minor})?(?![\d.]*\d)" if minor == "0" else rf"{major}\.{minor}(?!\d)"
            full = rf"(?:{names})(?: licen[sc]e)?[,;]? (?:\(?(?:version|ver\.?|v\.?) ?)?{number}"
            add(f"{label}-{version}", keyword, rf"licen[sc]ed under (?:the )?(?:terms of )?(?:the )?{full}", 50, 1.0, named)
            add(f"{label}-{version}", keyword, rf"\b{full}", 40, 0.95, named)
            add(f"{label}-{version}", "spdx", rf"spdx-license-identifier: ?{label}-{number}(?:-only|-or-later|\+)?", 60, 1.0, marked)
        add(label, keyword, rf"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:{names})\b", 30, 0.9, named)
        add(label, "spdx", rf"spdx-license-identifier: ?{label}\b", 55, 1.0, marked)
        add(label, keyword, rf"\b(?:{names})\b", 10, 0.6, named)

    for family in _families():
        forms(*family)
    for kind, version in product(_CC_KINDS, _CC_VERSIONS):
        add(f"cc-{kind}-{version}", "creativecommons", rf"creativecommons\.org/licenses/{kind}/{version.replace('.', chr(92) + '.')}", 60, 1.0, r"creativecommons\.org/licenses/")
    for label, keyword, expression in SENTENCES:
        add(label, keyword, expression, 20, 0.8, expression)
    return out


def _gate() -> str:
    """One expression, in any case, that every text with a match of a rule or a phrase of the base matches.

    Phrases and most needs hold ``licen``; the rest are the names and sentences that do without it.
    """
    names = [name for _, _, names, _ in _families() for name in _alternatives(names)]
    without = [x for x in dict.fromkeys(names) if "licen" not in _OPTIONAL.sub("", x)]
    sentences = [x for _, _, x in SENTENCES if "licen" not in x]
    return rf"(?i)licen|\b(?:{'|'.join(without)})|{'|'.join(sentences)}"


#: Phrases whose places are counted, with their labels.
PHRASES = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, in any case.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """The words of a text, from what lies between them: extracting every match copies the text for each."""
    return F.array_remove(F.split(text, _GAP, -1), "")


def _places(text: Column, rule: Column) -> Column:
    """All matches of a rule as structs with start and end, from the pieces between them."""
    found = F.regexp_extract_all(text, rule["expression"], F.lit(0))
    between = F.split(text, rule["expression"], -1)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    first = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

    pairs = F.filter(F.arrays_zip(between.alias("gap"), found.alias("hit")), lambda p: p["hit"].isNotNull())
    return F.aggregate(pairs, first, step, lambda state: state["spans"])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row of ``docs``.

    Base: places where a phrase's words stand next to each other; labels: those of the
    base and of the detections that no other suppresses, distinct and sorted; score: the
    highest weight of a detection, 0.5 at least with a phrase, else 0. Null and empty
    texts have no words and no labels; repeated rows are scanned each; an empty table
    gives no rows; other columns are not read.
    """
    needs: dict[str, list[Column]] = {}
    for (i, label, _, e, p, w), need in _with_needs():
        rule = F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(e).alias("expression"), F.lit(p).alias("priority"), F.lit(w).alias("weight"))
        needs.setdefault(need, []).append(rule)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gated = plain.select(
        "doc_id", F.size(_words(F.col("text"))).cast("long").alias("n_words"), F.when(F.col("text").rlike(_gate()), F.translate("text", _UPPER, _LOWER)).alias("text")
    )
    with_words = gated.withColumn("words", F.when(F.contains("text", F.lit("license")), _words(F.col("text"))))

    def begins(word: Column, at: Column) -> Column:
        case = None
        for phrase, label in PHRASES:
            fits = word == phrase[0]
            for k, other in enumerate(phrase[1:], start=1):
                fits = fits & (F.get("words", at + k) == other)
            case = F.when(fits, F.lit(label)) if case is None else case.when(fits, F.lit(label))
        return F.struct(at.alias("at"), case.alias("label"))

    base = F.filter(F.transform("words", begins), lambda p: p["label"].isNotNull())
    no_rules = F.array().cast("array<struct<id:int,label:string,expression:string,priority:int,weight:double>>")
    candidates = F.concat(*[F.when(F.col("text").rlike(need), F.array(*group)).otherwise(no_rules) for need, group in needs.items()])
    detected = F.flatten(
        F.transform(
            candidates,
            lambda r: F.transform(
                _places(F.col("text"), r),
                lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r["priority"].alias("priority"), r["id"].alias("id"), r["label"].alias("label"), r["weight"].alias("weight")),
            ),
        )
    )
    found = with_words.select("doc_id", "n_words", base.alias("base"), F.when(F.col("text").isNotNull(), detected).alias("detected"))

    def suppressed(d: Column) -> Column:
        def beats(e: Column) -> Column:
            longer = (e["end"] - e["start"]) > (d["end"] - d["start"])
            same = (e["end"] - e["start"]) == (d["end"] - d["start"])
            first = longer | (same & (e["id"] < d["id"]))
            return (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & ((e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & first))

        return F.exists("detected", beats)

    kept = found.select("doc_id", "n_words", "base", F.filter("detected", lambda d: ~suppressed(d)).alias("kept"))
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.array_sort(F.array_distinct(F.transform("base", lambda p: p["label"]))), none)
    all_labels = F.array_sort(F.array_union(base_labels, F.coalesce(F.transform("kept", lambda d: d["label"]), none)))
    weight = F.coalesce(F.array_max(F.transform("kept", lambda d: d["weight"])), F.lit(0.0))
    return kept.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["at"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.greatest(weight, F.when(F.size("base") > 0, 0.5).otherwise(0.0)).cast("double").alias("score"),
    )
