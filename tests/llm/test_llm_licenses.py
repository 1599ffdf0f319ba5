import re

import pytest

from opinion_spark.llm import licenses
from opinion_spark.llm.licenses import TEMPLATES, Template, with_hits

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIT = next(t for t in TEMPLATES if t.label == "mit")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, templates):
    """``(base places, labels, best containment, blocks)``."""
    w = words(text)
    base, labels, best, blocks = [], set(), 0.0, []
    for t in templates:
        if t.base:
            here = [(i, t.label) for i in range(len(w)) if w[i : i + len(t.words)] == t.words]
            base += here
            counts = [len(t.distinct)] * len(here)
        else:
            counts = [len(set(w[i : i + t.span]) & set(t.distinct)) for i in range(len(w))]
            blocks += [(i, t.label, n / len(t.distinct)) for i, n in enumerate(counts) if n >= t.need]
        enough = [n for n in counts if n >= t.need]
        if enough:
            labels.add(t.label)
            best = max(best, max(enough) / len(t.distinct))
    return sorted(base), labels, best, sorted(blocks)


TEXTS = [
    "All rights reserved. CC BY-NC 4.0; cc-by, cc.by\ncc\n\nby",
    "GNU General Public License and the General  Public, License",
    "general public licenses, all rightsreserved, acc by",
    MIT.text.upper(),
    "so " + MIT.text.replace("hereby", "").replace("charge", "cost") + " x",
    " ".join(MIT.words[:12]),
    " ".join(reversed(MIT.words)),
    "Licensed under the Apache License, Version 2.0",
    "apache x x x x x x license version 2 0",
    "cc " * 300 + "by",
    "İcc by ÉCC BY",
    "",
    None,
    "all rights reserved " * 2000,
]


@pytest.mark.parametrize("templates", [TEMPLATES, (Template("pair", "a b a b c"), Template("x", "b a", base=True))])
def test_hits_match_brute_force(table, templates):
    rows = [(i, t) for i, t in enumerate([*TEXTS, "a b a b a c", "b a b a", "c b x a"])]
    found = with_hits(table([(*r, 3) for r in rows], "doc_id long, text string, _hits int"), templates=templates)
    for r in found.select("doc_id", "_words", "_hits").collect():
        base, labels, best, blocks = brute(rows[r.doc_id][1], templates)
        assert sorted((h.start, h.label, h.containment) for h in r._hits if not h.base) == blocks, r.doc_id
        assert sorted((h.start, h.label) for h in r._hits if h.base) == base, r.doc_id
        assert {h.label for h in r._hits} == labels, r.doc_id
        assert max([h.containment for h in r._hits], default=0.0) == pytest.approx(best), r.doc_id


def test_prefix_holds_a_word_of_every_match():
    t = Template("t", "a b c d e f g h i j")
    assert t.need == 9 and t.prefix({"a": 5, "b": 1}) == ["c", "d"]


def test_empty_table(table):
    assert with_hits(table([], "doc_id long, text string")).count() == 0
    assert licenses.word_counts(table([], "doc_id long, text string"), "text", TEMPLATES) == {}


def test_templates_from_a_table(table):
    rows = [("own", "This Text may be copied, by anyone!"), ("own", "this text may be copied by anyone"), (None, "x"), ("e", "..."), ("n", None)]
    found = licenses.templates_of(table(rows, "label string, text string"))
    assert found == (Template("own", "this text may be copied by anyone"),)
    docs = table([(1, "note: this text may be copied by anyone who")], "doc_id long, text string")
    assert {h.label for h in with_hits(docs, templates=found).head()._hits} == {"own"}
    with pytest.raises(ValueError):
        licenses.templates_of(table([(f"l{i}", f"w{i}") for i in range(5)], "label string, text string"), most=4)
