"""Licence scans: ordered signature rules behind a keyword prefilter, in DataFrame functions only.

A text becomes its words, lower-cased and joined by single spaces, so that line breaks and marks don't
matter. A rule is a regular expression over that string with a label, a priority, a confidence and
keywords, words of which every match has one. Rules run only where the text has one of theirs, which most
texts don't have of any rule. Every match is a detection with an interval; of overlapping ones, those inside
a longer one go, and else those of the lower priority go.

The rules are the hand-written signatures of licence texts and notices (see ``signatures``), and those that
follow from a list of licences and a list of ways to refer to one by name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckhand.llm import common, signatures

#: What stands between words, before lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases whose every place counts, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Licence:
    """label; pattern of its name without the word licence; versions; its identifiers as words; words of which its name has one."""

    label: str
    name: str
    versions: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    words: tuple[str, ...] = ()

    @property
    def keywords(self) -> tuple[str, ...]:
        """The words given, or the first of the name that isn't optional."""
        return self.words or (re.sub(r"\(\?:[^()]*\)\?", "", self.name).split()[0].strip("|"),)


LICENCES = (
    Licence("mit", "mit(?: expat)?|expat", (), ("mit",), ("mit", "expat")),
    Licence("apache", "apache(?: software)?", ("1 0", "1 1", "2 0", "2"), ("apache",)),
    Licence("gpl", "(?:gnu )?general public", ("1", "2", "3", "2 0", "3 0"), ("gpl",)),
    Licence("lgpl", "(?:gnu )?(?:lesser|library) general public", ("2", "2 1", "3", "3 0"), ("lgpl",), ("general",)),
    Licence("agpl", "(?:gnu )?affero general public", ("1", "3", "3 0"), ("agpl",)),
    Licence("gfdl", "(?:gnu )?free documentation", ("1 1", "1 2", "1 3"), ("gfdl",)),
    Licence("bsd", "(?:new |modified |simplified |revised )?(?:bsd|berkeley software distribution)(?: (?:[0234]|two|three|four) clause)?", (), ("bsd",), ("bsd", "berkeley")),
    Licence("bsd-2-clause", "(?:bsd (?:2|two) clause|simplified bsd|freebsd)", (), ("bsd 2 clause",), ("bsd", "freebsd")),
    Licence("bsd-3-clause", "(?:bsd (?:3|three) clause|(?:new|modified|revised) bsd)", (), ("bsd 3 clause",), ("bsd",)),
    Licence("mpl", "mozilla public", ("1 0", "1 1", "2 0"), ("mpl",)),
    Licence("epl", "eclipse public", ("1 0", "2 0"), ("epl",)),
    Licence("edl", "eclipse distribution", ("1 0",), ("edl",)),
    Licence("cddl", "common development and distribution", ("1 0", "1 1"), ("cddl",)),
    Licence("cpl", "common public", ("1 0",), ("cpl",)),
    Licence("eupl", "european union public", ("1 0", "1 1", "1 2"), ("eupl",)),
    Licence("isc", "isc", (), ("isc",)),
    Licence("zlib", "zlib(?: libpng)?", (), ("zlib",)),
    Licence("artistic", "artistic", ("1 0", "2 0"), ("artistic",)),
    Licence("boost", "boost software", ("1 0",), ("bsl",)),
    Licence("ms-pl", "microsoft public", (), ("ms pl",)),
    Licence("ms-rl", "microsoft reciprocal", (), ("ms rl",)),
    Licence("osl", "open software", ("1 0", "2 0", "2 1", "3 0"), ("osl",)),
    Licence("afl", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0"), ("afl",)),
    Licence("ofl", "(?:sil )?open font", ("1 0", "1 1"), ("ofl",)),
    Licence("odbl", "open (?:data commons )?(?:open )?database", ("1 0",), ("odbl",)),
    Licence("python", "python(?: software foundation)?", ("2", "2 0"), ("psf", "python")),
    Licence("php", "php", ("3 0", "3 01"), ("php",)),
    Licence("ruby", "ruby", (), ("ruby",)),
    Licence("perl", "perl", (), ()),
    Licence("openssl", "openssl", (), ("openssl",)),
    Licence("postgresql", "postgresql", (), ("postgresql",)),
    Licence("unicode", "unicode", (), ("unicode dfs 2016",)),
    Licence("w3c", "w3c(?: software)?(?: and document)?", (), ("w3c",)),
    Licence("qpl", "q public", ("1 0",), ("qpl",)),
    Licence("sleepycat", "sleepycat", (), ("sleepycat",)),
    Licence("ibm", "ibm public", ("1 0",), ("ipl",)),
    Licence("intel", "intel open source", (), ("intel",)),
    Licence("nokia", "nokia open source", (), ("nokia",)),
    Licence("sun", "sun public", ("1 0",), ("spl",)),
    Licence("lppl", "latex project public", ("1 0", "1 1", "1 2", "1 3"), ("lppl",)),
    Licence("vim", "vim", (), ("vim",)),
    Licence("x11", "x11", (), ("x11",)),
    Licence("ncsa", "(?:university of illinois )?ncsa(?: open source)?", (), ("ncsa",)),
    Licence("upl", "universal permissive", ("1 0",), ("upl",)),
    Licence("sspl", "server side public", ("1",), ("sspl",)),
    Licence("busl", "business source", ("1 1",), ("busl",)),
    Licence("elastic", "elastic", ("2 0",), ("elastic",)),
    Licence("llama", "llama (?:[234](?: [0-9])? )?community", (), ()),
    Licence("openrail", "(?:bigscience |creativeml )?(?:open )?(?:rail|openrail)(?: m)?", (), ("openrail",), ("rail", "openrail")),
)
#: Ways to refer to a licence by name: pattern around {n}, priority (less is stronger), confidence.
FORMS = (
    ("(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{n}) licen[cs]e", 10, 1.0),
    ("(?:subject to|governed by|covered by|according to) (?:the )?(?:terms of )?(?:the )?(?:{n}) licen[cs]e", 12, 0.95),
    ("(?:copy|terms|text|conditions) of the (?:{n}) licen[cs]e", 14, 0.9),
    ("(?:{n}) licen[cs]e", 30, 0.8),
    ("(?:{n}) licensed", 32, 0.7),
    ("dual licensed under (?:the )?(?:{n})", 20, 0.85),
)
#: The same with a version {v}; these are longer, so that they win over the plain ones.
VERSIONED = (
    ("(?:{n}) licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v )?{v}(?: or (?:any )?later)?", 5, 1.0),
    ("(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{n}) licen[cs]e (?:either )?(?:version |v )?{v}(?: or (?:any )?later)?", 1, 1.0),
)
#: By identifier {i}, as words.
IDENTIFIED = (
    ("spdx licen[cs]e identifier {i}(?: [0-9]+(?: [0-9]+)?)?(?: only| or later)?", 0, 1.0),
    ("(?:opensource org|spdx org) licenses {i}(?: [0-9]+(?: [0-9]+)?)?", 3, 0.95),
    ("licen[cs]e {i}(?: [0-9]+(?: [0-9]+)?)?", 40, 0.5),
)
OTHERS = (
    ("cc-by", "(?:licensed under )?cc by(?: [1-4] [05])?", 26, 0.85, ("cc",)),
    ("cc-by-sa", "(?:licensed under )?cc by sa(?: [1-4] [05])?", 22, 0.9, ("cc",)),
    ("cc-by-nc", "(?:licensed under )?cc by nc(?: [1-4] [05])?", 22, 0.9, ("cc",)),
    ("cc-by-nd", "(?:licensed under )?cc by nd(?: [1-4] [05])?", 22, 0.9, ("cc",)),
    ("cc-by-nc-sa", "(?:licensed under )?cc by nc sa(?: [1-4] [05])?", 18, 0.95, ("cc",)),
    ("cc-by-nc-nd", "(?:licensed under )?cc by nc nd(?: [1-4] [05])?", 18, 0.95, ("cc",)),
    ("cc0", "(?:cc0|cc zero)(?: 1 0)?(?: universal)?", 22, 0.9, ("cc0", "cc")),
    ("cc-by", "creative commons attribution(?: licen[cs]e)?(?: (?:version )?[1-4] [05])?(?: international| unported)?", 26, 0.95, ("commons",)),
    ("cc-by-sa", "creative commons attribution share ?alike(?: licen[cs]e)?(?: (?:version )?[1-4] [05])?(?: international| unported)?", 22, 0.95, ("commons",)),
    ("cc-by-nc", "creative commons attribution non ?commercial(?: licen[cs]e)?(?: (?:version )?[1-4] [05])?(?: international| unported)?", 22, 0.95, ("commons",)),
    ("creative-commons", "creative commons", 60, 0.4, ("commons",)),
    ("public-domain", "(?:dedicated to|released (?:in)?to|placed in|in) the public domain", 25, 0.8, ("domain",)),
    ("unlicense", "(?:the )?unlicense", 25, 0.9, ("unlicense",)),
    ("wtfpl", "wtfpl|do what the fuck you want to public license", 25, 0.9, ("wtfpl", "fuck")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 2, 1.0, ("granted",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 2, 1.0, ("redistribution",)),
    ("proprietary", "all rights reserved", 70, 0.2, ("reserved",)),
    ("proprietary", "(?:confidential and proprietary|proprietary and confidential)", 50, 0.6, ("proprietary",)),
)
DETECTION = "array<struct<at:int,size:int,label:string,priority:int,confidence:double,base:boolean>>"


def rules() -> list[tuple[str, str, int, float, tuple[str, ...], bool]]:
    """label, pattern, priority, confidence, keywords (a match has one), whether it is a base phrase; in order of priority."""
    found = []
    for x in LICENCES:
        own = [(p, rank, c) for p, rank, c in FORMS]
        own += [(p.replace("{v}", f"(?:{v})"), rank, c) for v in sorted(x.versions, key=len, reverse=True) for p, rank, c in VERSIONED]
        found += [(x.label, p.replace("{n}", x.name), rank, c, x.keywords, False) for p, rank, c in own]
        found += [(x.label, p.replace("{i}", i), rank, c, (i.split()[0],), False) for i in x.ids for p, rank, c in IDENTIFIED]
    found += [(label, pattern, rank, c, words, False) for label, pattern, rank, c, words in OTHERS]
    found += [(*x, False) for x in signatures.signatures()]
    found += [(label, phrase, 80, 0.6, (phrase.split()[0],), True) for phrase, label in BASE.items()]
    return sorted(found, key=lambda r: (r[2], r[0], r[1]))


def _literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rule_table() -> Column:
    """Rules by keyword, as a literal map."""
    by: dict[str, list[str]] = {}
    for label, pattern, priority, confidence, words, base in rules():
        whole = f" (?:{pattern})(?= )"
        for keyword in words:
            by.setdefault(keyword, []).append(f"named_struct('label', {_literal(label)}, 'pattern', {_literal(whole)}, 'priority', {priority}, 'confidence', {confidence}D, 'base', {str(base).lower()})")
    return F.expr("map(" + ", ".join(f"{_literal(k)}, array({', '.join(v)})" for k, v in by.items()) + ")")


def keywords() -> list[str]:
    return sorted({k for r in rules() for k in r[4]})


#: A text without any of these words has no match.
HINTS = tuple(keywords())


#: Entries of an array that are worked on together.
BLOCK = 64


def _let(name: str, value: str, body: str) -> str:
    """SQL for a body that uses a value by name, which is worked out once however often the body uses it. The result is copied."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _blocks(array: str, size: int) -> str:
    """SQL for an array that isn't empty, cut into arrays of a size."""
    return f"transform(sequence(0, (size({array}) - 1) DIV {size}), k -> slice({array}, k * {size} + 1, {size}))"


def places() -> str:
    """All matches of every rule in _joined, each after the space before it.

    Pieces between matches give their places by running sums, first of blocks, then within each: an array
    that grows by single entries would be copied with every one.
    """
    total = "aggregate({}, 0, (n, y) -> n + y.skipped + y.size)"
    at = f"starts[b] + {total.format('slice(g, 1, i)')} + x.skipped + 1"
    in_block = f"transform(g, (x, i) -> struct({at} AS at, x.size - 1 AS size, r.label AS label, r.priority AS priority, r.confidence AS confidence, r.base AS base))"
    starts = f"aggregate(transform(blocks, g -> {total.format('g')}), array(0), (a, n) -> concat(a, array(element_at(a, -1) + n)))"
    whole = _let("blocks", _blocks("gaps", BLOCK), _let("starts", starts, f"flatten(transform(blocks, (g, b) -> {in_block}))"))
    gaps = "zip_with(m, slice(split(_joined, r.pattern, -1), 1, size(m)), (x, before) -> struct(length(before) AS skipped, length(x) AS size))"
    return f"flatten(transform(filter(_rules, r -> _joined RLIKE r.pattern), r -> {_let('m', 'regexp_extract_all(_joined, r.pattern, 0)', _let('gaps', gaps, whole))}))"


#: Neighbours on each side that a detection is first held against.
NEIGHBOURS = 8
#: A detection d goes if one, e, that overlaps it is longer and covers it, or has the stronger priority and isn't covered by it.
BEATEN = """e.at < d.at + d.size AND d.at < e.at + e.size AND (
    (e.at <= d.at AND e.at + e.size >= d.at + d.size AND e.size > d.size)
    OR (e.priority < d.priority AND NOT (d.at <= e.at AND d.at + d.size >= e.at + e.size AND d.size > e.size)))"""


def kept() -> str:
    """The detections of _found that none beats, by place.

    Blocks of neighbours are held against those blocks only that reach into them, and each detection against
    its few neighbours there, if the last of them lie beyond its reach and that of the longest detection.
    """
    few = f"slice(near, greatest(p - {NEIGHBOURS}, 0) + 1, {2 * NEIGHBOURS + 1})"
    before = f"(p <= {NEIGHBOURS} OR near[p - {NEIGHBOURS}].at + longest <= d.at)"
    after = f"(p + {NEIGHBOURS} >= size(near) - 1 OR near[p + {NEIGHBOURS}].at >= d.at + d.size)"
    beaten = f"exists(CASE WHEN {before} AND {after} THEN {few} ELSE near END, e -> {BEATEN})"
    each = f"filter(b, (d, q) -> NOT {_let('p', 'q + before', beaten)})"
    reach = "filter(sequence(0, size(blocks) - 1), j -> spans[j].lo < spans[i].hi AND spans[j].hi > spans[i].lo)"
    longest = _let("longest", "array_max(transform(near, x -> x.size))", each)
    near = _let("near", "flatten(transform(js, j -> blocks[j]))", longest)
    of_block = _let("js", reach, _let("before", f"{BLOCK} * (array_position(js, i) - 1)", near))
    spans = "transform(blocks, b -> struct(b[0].at AS lo, array_max(transform(b, x -> x.at + x.size)) AS hi))"
    whole = _let("blocks", _blocks("found", BLOCK), _let("spans", spans, f"flatten(transform(blocks, (b, i) -> {of_block}))"))
    return f"CASE WHEN size(_found) = 0 THEN _found ELSE {_let('found', 'array_sort(_found)', whole)} END"


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds to each row what its text says of licences, and keeps its other columns.

    n_words; n_base, first_word and last_word: places of the base phrases, and the least and greatest
    word at which one starts (null if none); base_labels; labels: of the detections that are left, and
    the base ones; score: the greatest confidence of those, 0 without any; detections, by place. A null
    text is empty: no words, no labels. Rows are worked on one by one, so repeated rows give equal results
    and an empty table stays empty; time grows with the text, also where all of it is licences. Columns of
    df with the names of new ones, in any case of letters, are replaced; all others may have any name.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    own = F.struct(*(F.col(common.quoted(c)) for c in common.others(df, new))).alias("_own")
    blank = F.trim(F.regexp_replace(F.coalesce(F.col(common.quoted(text_col)), F.lit("")), BETWEEN, " "))
    words = df.select(own, F.concat(F.lit(" "), blank, F.lit(" ")).alias("_words"))
    spaces = F.octet_length("_words") - F.octet_length(F.replace("_words", F.lit(" "), F.lit("")))
    wanted = F.expr(f"array({', '.join(map(_literal, keywords()))})")
    # This also lower-cases other letters, of which some become a-z: so a text may be looked at in vain, but none is left out.
    hinted = F.arrays_overlap(F.split(F.lower("_words"), " "), wanted)
    counted = words.select("_own", F.when(F.col("_words") == "  ", 0).otherwise(spaces - 1).cast("long").alias("n_words"), "_words", hinted.alias("_hinted"))
    # Only A-Z are lower-cased for the rules; this takes long, but few texts get so far.
    lower = F.translate("_words", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    joined = counted.select("_own", "n_words", F.when(F.col("_hinted"), lower).alias("_joined"))
    keys = F.array_intersect(F.split("_joined", " "), wanted)
    gated = joined.select("_own", "n_words", "_joined", F.when(F.col("_joined").isNotNull(), keys).alias("_keys"))
    some = F.coalesce(F.size("_keys") > 0, F.lit(False))
    ruled = gated.select(
        "_own", "n_words",
        F.when(some, F.col("_joined")).alias("_joined"),
        F.when(some, F.array_distinct(F.flatten(F.transform("_keys", lambda k: F.element_at(rule_table(), k))))).alias("_rules"),
    )
    found = ruled.select("_own", "n_words", "_joined", F.coalesce(F.expr(places()), F.expr(f"CAST(array() AS {DETECTION})")).alias("_found"))
    left = found.select("_own", "n_words", "_joined", "_found", F.expr(kept()).alias("_kept"))
    base = "filter(_found, d -> d.base)"
    word_at = "CAST(length(left(_joined, {0})) - length(replace(left(_joined, {0}), ' ', '')) - 1 AS LONG)"
    listed = "array_join(array_sort(array_distinct(transform({}, d -> d.label))), ',')"
    return left.select(
        "_own.*", "n_words",
        F.expr(f"CAST(size({base}) AS LONG) AS n_base"),
        F.expr(word_at.format(f"array_min(transform({base}, d -> d.at))") + " AS first_word"),
        F.expr(word_at.format(f"array_max(transform({base}, d -> d.at))") + " AS last_word"),
        F.expr(listed.format(base) + " AS base_labels"),
        F.expr(listed.format(f"concat(_kept, {base})") + " AS labels"),
        F.expr("coalesce(array_max(transform(_kept, d -> d.confidence)), 0D) AS score"),
        F.col("_kept").alias("detections"),
    )


def licence_digest(df: DataFrame) -> DataFrame:
    return scan(df.select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
