"""Corpus operators on inputs of which they once left a part out."""

import re

from deckhand.llm import licences, pii
from deckhand.llm.dom import Page


def ways(pattern):
    """The strings that a rule's pattern matches, with one character for each class."""
    if m := re.search(r"\(\?:([^()]*)\)(\??)", pattern):
        return {w for part in {*m[1].split("|"), *([""] if m[2] else [])} for w in ways(pattern[: m.start()] + part + pattern[m.end() :])}
    return {re.sub(r"\[(.)[^]]*\]\+?", r"\1", w).replace(" ?", " ") for w in pattern.split("|")}


def test_keywords_and_hints_cover_their_rules():
    for _, pattern, _, _, keywords, _ in licences.rules():
        for w in ways(pattern):
            assert re.fullmatch(pattern, w), (pattern, w)
            assert set(keywords) & set(w.split()), (pattern, keywords, w)
            assert any(h in w for h in licences.HINTS), (pattern, w)


def test_licences_named_in_full_words(spark):
    texts = {"CC Zero": "cc0", "Data: CC-Zero 1.0 Universal.": "cc0", "Do What The Fuck You Want To Public License": "wtfpl", "CC0": "cc0", "WTFPL": "wtfpl", "zero cc": ""}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licences.licence_digest(docs).collect()}
    assert got == {k: (label, 0.9 if label else 0.0) for k, label in enumerate(texts.values())}


def test_self_closed_svg_and_math_end_where_they_stand():
    lines = lambda source: (p := Page(source)).lines([True] * len(p.tags))
    assert lines('<p>Hello <svg class="i"/> world</p><p>More</p>') == ["Hello world", "More"]
    assert lines('<p>a <SVG/>b <math x = "1" />c <svg width=9 />d <svg><path d="M0"/>not this</svg>e</p><p>f</p>') == ["a b c d e", "f"]
    assert lines("<p>a<svg href=x/>not this</svg>b<script src='x'/>nor this</script>c</p>") == ["abc"]
    assert Page("<p>a<svg class='i'/>b</p>").tags == ["#", "p", "svg"]


def test_equal_numbers_stay_equal_however_punctuated(spark):
    same = [
        ["(243) 555-5526", "+1 (243) 555-5526", "+1-243-555-5526", "+12435555526", "+1 2435555526"],
        ["+1 143 555 5526", "+11435555526"], ["+7 912 345 67 89", "+79123456789"], ["+44 20 7946 0958", "+442079460958", "+44-(20)-79460958"], ["+353 1 234 5678", "+35312345678"],
    ]
    texts = [t for ways in same for t in ways]
    docs = spark.createDataFrame([(k, f"call {t} now") for k, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(pii.pseudonymize(docs).collect())
    new = iter(r.text.removeprefix("call ").removesuffix(" now") for r in rows)
    for ways in same:
        got = [(t, next(new)) for t in ways]
        assert all(re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b) and a != b for a, b in got)
        assert len({re.sub("[^0-9]", "", b)[-10:] for _, b in got}) == 1, got
    assert all(r.pii_kinds == (["phone"] if r.doc_id < len(same[0]) else ["intl"]) for r in rows)


def test_secrets_without_digits_are_found(spark):
    texts = ["key AKIA" + "QWERTYUIOPASDFGH", "ghp_" + "abcdefghijkl" * 3, "sk-" + "abcdefghijklmnopqrstuvwx", "the task-force"]
    got = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.pii_kinds for r in sorted(got)] == [["secret"], ["secret"], ["secret"], []]
    assert [r.text == t for r, t in zip(sorted(got), texts)] == [False, False, False, True]
