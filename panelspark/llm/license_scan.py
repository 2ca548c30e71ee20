"""License scan by ordered signature rules, with DataFrame functions only.

A text is brought to a plain form: words joined by one space, A-Z in lower case. Base phrases are
searched in every text. A cheap gate leaves the texts that hold a word of licensing at all, in any case; of
these, each rule is tried only where its keyword stands. A rule is a regular expression with a label,
a priority and a confidence. Of overlapping detections, one that lies within another of the same
or a higher priority is suppressed (of two equal ones the earlier rule stays).

Everything happens within the row, so no text is moved and a source with a third of all rows is spread as
the input is. The running maximum over a text's detections is linear in their number.

Defined results: a null or empty text has no words, no places and empty labels, score 0; repeated rows
are scanned alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.tasks import column

# Fixed values of the base contract: phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_CONFIDENCE = 0.5


class Rule(NamedTuple):
    """A signature over the plain form of a text, tried where ``keyword`` occurs."""

    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


# Names: label stem, keyword, pattern of the name, known versions (in the plain form "2 0" for 2.0).
_FAMILIES = [
    ("apache", "apache", "apache(?: software)?", ["1 0", "1 1", "2 0"]),
    ("mit", "mit", "(?:mit|expat)", []),
    ("x11", "x11", "(?:mit )?x11", []),
    ("isc", "isc", "isc", []),
    ("zlib", "zlib", "zlib(?: libpng)?", []),
    ("bsl", "boost", "boost software", ["1 0"]),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)", []),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)", []),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)", []),
    ("bsd", "bsd", "bsd(?: style)?", []),
    ("gpl", "general", "gnu general public", ["1", "2", "2 0", "3", "3 0"]),
    ("gpl", "gpl", "(?:gnu )?gpl", ["1", "2", "2 0", "3", "3 0"]),
    ("lgpl", "lesser", "gnu (?:lesser|library) general public", ["2", "2 0", "2 1", "3", "3 0"]),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ["2", "2 0", "2 1", "3", "3 0"]),
    ("agpl", "affero", "(?:gnu )?affero general public", ["1", "3", "3 0"]),
    ("agpl", "agpl", "(?:gnu )?agpl", ["1", "3", "3 0"]),
    ("gfdl", "documentation", "gnu free documentation", ["1 1", "1 2", "1 3"]),
    ("mpl", "mozilla", "mozilla public", ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse", "eclipse public", ["1 0", "2 0"]),
    ("cpl", "common", "common public", ["1 0"]),
    ("cddl", "cddl", "cddl", ["1 0", "1 1"]),
    ("cddl", "distribution", "common development and distribution", ["1 0", "1 1"]),
    ("eupl", "european", "european union public", ["1 0", "1 1", "1 2"]),
    ("artistic", "artistic", "artistic", ["1 0", "2 0"]),
    ("ofl", "font", "(?:sil )?open font", ["1 0", "1 1"]),
    ("odbl", "database", "open database", ["1 0"]),
    ("pddl", "domain", "public domain dedication and", ["1 0"]),
    ("ms-pl", "microsoft", "microsoft public", []),
    ("ms-rl", "microsoft", "microsoft reciprocal", []),
    ("osl", "open", "open software", ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", "academic", "academic free", ["1 2", "2 0", "2 1", "3 0"]),
    ("ncsa", "illinois", "university of illinois(?: ncsa)? open source", []),
    ("postgresql", "postgresql", "postgresql", []),
    ("python", "python", "python software foundation", ["2", "2 0"]),
    ("php", "php", "php", ["3 0", "3 01"]),
    ("ruby", "ruby", "ruby", []),
    ("openssl", "openssl", "openssl", []),
    ("wtfpl", "wtfpl", "wtfpl", ["1", "2"]),
    ("unlicense", "unlicense", "(?:the )?unlicense", []),
    ("vim", "vim", "vim", []),
    ("zpl", "zope", "zope public", ["2 0", "2 1"]),
    ("apsl", "apple", "apple public source", ["1 0", "1 1", "2 0"]),
    ("ipl", "ibm", "ibm public", ["1 0"]),
    ("qpl", "q", "q public", ["1 0"]),
    ("upl", "universal", "universal permissive", ["1 0"]),
]
# Ways to name a licence; %s is the name with its version.
_TEMPLATES = [
    ("license(?:d)? under (?:the )?(?:terms of )?(?:the )?%s(?: licen[cs]e)?", 4, 0.95),
    ("(?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?%s(?: licen[cs]e)?", 4, 0.95),
    ("(?:under|by) (?:the )?terms (?:and conditions )?of (?:the )?%s(?: licen[cs]e)?", 3, 0.9),
    ("(?:the )?%s licen[cs]e", 2, 0.8),
]
_VERSION = "(?: licen[cs]e)?(?: (?:version|v))? v?%s(?: or (?:any )?later(?: version)?)?"

# Names that are written in one word with their version (GPLv2, Apache2): label stem, name, versions.
_GLUED = [
    ("gpl", "gpl", ["1", "2", "2 0", "3", "3 0"]),
    ("lgpl", "lgpl", ["2", "2 0", "2 1", "3", "3 0"]),
    ("agpl", "agpl", ["1", "3", "3 0"]),
    ("apache", "apache", ["1 0", "1 1", "2", "2 0"]),
    ("mpl", "mpl", ["1 0", "1 1", "2", "2 0"]),
    ("epl", "epl", ["1", "1 0", "2", "2 0"]),
    ("eupl", "eupl", ["1 0", "1 1", "1 2"]),
    ("gfdl", "gfdl", ["1 1", "1 2", "1 3"]),
    ("cddl", "cddl", ["1", "1 0", "1 1"]),
]
_GRANT = "(?:licen[cs]ed?|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?"
_GLUED_END = "(?: or (?:any )?later(?: version)?)?(?: licen[cs]e)?"

# SPDX short identifiers, in the plain form, by label.
_SPDX = (
    "apache 1 1,apache 2 0,mit,mit 0,isc,zlib,bsl 1 0,bsd 2 clause,bsd 3 clause,bsd 4 clause,0bsd,gpl 1 0,gpl 2 0,gpl 3 0,"
    "lgpl 2 0,lgpl 2 1,lgpl 3 0,agpl 3 0,gfdl 1 2,gfdl 1 3,mpl 1 1,mpl 2 0,epl 1 0,epl 2 0,cddl 1 0,cddl 1 1,eupl 1 1,eupl 1 2,"
    "artistic 1 0,artistic 2 0,ofl 1 1,odbl 1 0,pddl 1 0,ms pl,ms rl,osl 3 0,afl 3 0,ncsa,postgresql,psf 2 0,php 3 01,ruby,openssl,"
    "wtfpl,unlicense,vim,zpl 2 1,apsl 2 0,ipl 1 0,qpl 1 0,upl 1 0,cc0 1 0"
).split(",")

# Notices that name no licence of the families above: label, keyword, pattern, priority, confidence.
_NOTICES = [
    Rule("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 3, 0.9),
    Rule("cc0", "creative", "creative commons zero", 3, 0.9),
    Rule("public-domain", "public", "(?:released|placed|dedicated) (?:in|into|to) the public domain", 3, 0.9),
    Rule("public-domain", "public", "public domain", 1, 0.6),
    Rule("reserved", "rights", "all rights reserved", 1, 0.5),
    Rule("no-rights-reserved", "rights", "no rights reserved", 1, 0.5),
    Rule("some-rights-reserved", "rights", "some rights reserved", 1, 0.5),
    Rule("proprietary", "proprietary", "proprietary (?:and confidential|licen[cs]e|software)", 3, 0.9),
    Rule("proprietary", "confidential", "confidential and proprietary", 3, 0.9),
    Rule("proprietary", "permission", "without (?:the )?(?:prior )?(?:written|express) permission", 2, 0.7),
    Rule("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 1, 0.4),
    Rule("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 4, 0.95),
    Rule("isc", "permission", "permission to use copy modify and(?: or)? distribute this software for any purpose", 4, 0.95),
    Rule("bsd", "redistribution", "redistribution and use in source and binary forms", 4, 0.9),
    Rule("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 4, 0.95),
    Rule("apache", "except", "you may not use this file except in compliance with the license", 4, 0.9),
]
_CC_PARTS = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]
_CC_NAMES = ["attribution", "attribution sharealike", "attribution noderivatives", "attribution noncommercial",
             "attribution noncommercial sharealike", "attribution noncommercial noderivatives"]
_CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]


def _label(*parts: str) -> str:
    return "-".join(p.replace(" ", ".") for p in parts)


def rules() -> list[Rule]:
    """All rules in order: families by template and version, then identifiers and notices."""
    found = []
    for stem, keyword, name, versions in _FAMILIES:
        for template, priority, confidence in _TEMPLATES:
            for version in versions:
                full = name + _VERSION % version
                found.append(Rule(_label(stem, version), keyword, template % full, priority + 1, confidence))
            found.append(Rule(stem, keyword, template % name, priority, confidence))
    for stem, name, versions in _GLUED:
        for version in versions:
            for glued in (f"{name}v{version}", f"{name}{version}"):
                keyword, full = glued.split()[0], f"(?:gnu )?{glued}{_GLUED_END}"
                found.append(Rule(_label(stem, version), keyword, _GRANT + full, 5, 0.95))
                found.append(Rule(_label(stem, version), keyword, full, 3, 0.8))
    for part, name in zip(_CC_PARTS, _CC_NAMES, strict=True):
        for version in _CC_VERSIONS:
            label = _label("cc-" + part.replace(" ", "-"), version)
            found.append(Rule(label, "cc", f"cc {part} {version}", 4, 0.95))
            found.append(Rule(label, "creative", f"creative commons {name} {version}", 4, 0.95))
        stem = "cc-" + part.replace(" ", "-")
        found.append(Rule(stem, "cc", f"cc {part}", 2, 0.7))
        found.append(Rule(stem, "creative", f"creative commons {name}", 3, 0.85))
    for name in _SPDX:
        found.append(Rule("spdx:" + name.replace(" ", "-"), "spdx", f"spdx license identifier {name}(?: only| or later)?", 6, 1.0))
    return found + _NOTICES


# A text without any of these words cannot match a rule.
_GATE = " (?:licen[cs]e[ds]?|cc|cc0|gnu|creative|copyright|rights|spdx|proprietary|permission|redistribut(?:e|ion)|public|terms|under"
_GATE += "|(?:[al]?gpl|apache|mpl|eu?pl|gfdl|cddl)v?[1-3]) "


def spaced_form(text: Column) -> Column:
    """Words of a text between single spaces, with one before the first and after the last; '' if there are none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    padded = F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))
    return F.when(padded == "  ", "").otherwise(padded)


def _in_lower_case(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(plain: Column, pattern: Column) -> Column:
    """First word of each match, and the word after its last. Matches begin after a space and end before one."""
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    pieces = F.transform(F.split(plain, whole, -1), _spaces)
    inner = F.transform(F.regexp_extract_all(plain, whole, F.lit(0)), _spaces)
    empty = F.array().cast("array<struct<begin:int,end:int>>")

    def add(state: Column, length: Column) -> Column:
        """The k-th match begins behind all pieces and matches before it."""
        k = F.size(state["found"])
        begin = state["spaces"] + F.get(pieces, k)
        end = begin + length
        return F.struct(
            end.alias("spaces"),
            F.concat(state["found"], F.array(F.struct((begin - 1).alias("begin"), end.alias("end")))).alias("found"),
        )

    start = F.struct(F.lit(0).alias("spaces"), empty.alias("found"))
    return F.aggregate(inner, start, add, lambda state: state["found"])


def _constant(value: list, kind: str) -> Column:
    """A list as one literal column."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _detections(plain: Column, table: list[Rule]) -> Column:
    """All matches of rules whose keyword occurs: ``begin, end, priority, rule``, longer ones first at a place."""
    rows = [{"rule": k, "keyword": f" {r.keyword} ", "pattern": r.pattern, "priority": r.priority} for k, r in enumerate(table)]
    every = _constant(rows, "array<struct<rule:int,keyword:string,pattern:string,priority:int>>")
    tried = F.filter(every, lambda r: F.contains(plain, r["keyword"]))
    matched = F.transform(
        tried,
        lambda r: F.transform(
            _places(plain, r["pattern"]),
            lambda m: F.struct(
                m["begin"].alias("begin"), (-m["end"]).alias("minus_end"), (-r["priority"]).alias("minus_priority"), r["rule"].alias("rule")
            ),
        ),
    )
    return F.sort_array(F.flatten(matched))


def _unsuppressed(found: Column, priorities: list[int]) -> Column:
    """Detections that lie in no other one of the same or a higher priority.

    In order of begin, longer ones and higher priorities first, a detection lies in an earlier one if the
    furthest end so far of its priority or a higher one reaches its own end.
    """
    kind = "array<struct<begin:int,minus_end:int,minus_priority:int,rule:int>>"

    def add(state: Column, d: Column) -> Column:
        level = -d["minus_priority"]
        inside = F.lit(False)
        for p in priorities:
            inside = inside | ((level <= p) & (state[f"p{p}"] >= -d["minus_end"]))
        reach = [
            F.when(level == p, F.greatest(state[f"p{p}"], -d["minus_end"])).otherwise(state[f"p{p}"]).alias(f"p{p}") for p in priorities
        ]
        return F.struct(*reach, F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], F.array(d))).alias("kept"))

    start = F.struct(*[F.lit(-1).alias(f"p{p}") for p in priorities], F.array().cast(kind).alias("kept"))
    return F.aggregate(found, start, add, lambda state: state["kept"])


def _base_places(plain: Column, phrase: str, label: str) -> Column:
    places = F.transform(
        _places(plain, F.lit(phrase)), lambda m: F.struct(m["begin"].alias("begin"), m["end"].alias("end"), F.lit(label).alias("label"))
    )
    none = F.array().cast("array<struct<begin:int,end:int,label:string>>")
    return F.when(F.contains(plain, F.lit(f" {phrase} ")), places).otherwise(none)


def scan(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """``doc_id, n_words, base, detections, base_labels, labels, score`` of every row of ``docs``.

    ``base`` and ``detections`` list places by word (end not included) with their label. The score is
    the highest confidence.
    """
    table = rules() if table is None else table
    plain = F.col("plain")
    labels = _constant([r.label for r in table], "array<string>")
    sure = _constant([float(r.confidence) for r in table], "array<double>")
    base_rows = F.flatten(F.array(*[_base_places(plain, phrase, label) for phrase, label in BASE.items()]))
    none = F.array().cast("array<struct<begin:int,minus_end:int,minus_priority:int,rule:int>>")
    found = F.when(F.col("gate"), _detections(plain, table)).otherwise(none)
    # (?i) and the translation both change A-Z only, and most texts need neither.
    stage = docs.select(column(docs, "doc_id").alias("doc_id"), spaced_form(column(docs, "text")).alias("plain"))
    stage = stage.select(
        "doc_id", F.greatest(_spaces(plain) - 1, F.lit(0)).cast("long").alias("n_words"),
        plain.rlike("(?i)" + _GATE).alias("gate"), plain.rlike("(?i) (?:" + "|".join(BASE) + ") ").alias("has_base"), "plain",
    )
    stage = stage.select(
        "doc_id", "n_words", "gate", F.when(F.col("gate") | F.col("has_base"), _in_lower_case(plain)).otherwise("").alias("plain")
    )
    stage = stage.select("doc_id", "n_words", base_rows.alias("base"), found.alias("found"))
    stage = stage.withColumn(
        "found", F.when(F.size("found") > 0, _unsuppressed(F.col("found"), sorted({r.priority for r in table}))).otherwise(F.col("found"))
    )
    detected = F.transform("found", lambda d: F.struct(
        d["begin"].alias("begin"), (-d["minus_end"]).alias("end"), F.get(labels, d["rule"]).alias("label"), F.get(sure, d["rule"]).alias("confidence")
    ))
    stage = stage.select("doc_id", "n_words", "base", detected.alias("detections"))
    joined = lambda array: F.array_join(F.array_sort(F.array_distinct(array)), ",")
    return stage.select(
        "doc_id", "n_words", "base", "detections",
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat(F.col("base.label"), F.col("detections.label"))).alias("labels"),
        F.greatest(
            F.when(F.size("base") > 0, BASE_CONFIDENCE).otherwise(0.0), F.coalesce(F.array_max("detections.confidence"), F.lit(0.0))
        ).alias("score"),
    )
