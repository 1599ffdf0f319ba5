"""Character references against the standard library."""

import html
import random
from html.entities import html5

from opinion_spark.functions.entities import unescaped


def decoded(table, texts):
    df = table(list(enumerate(texts)), "id int, text string").repartition(4)
    found = df.select("id", unescaped(df["text"]).alias("text"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    return [r.text for r in sorted(found.collect())]


def check(table, texts):
    want = [None if t is None else html.unescape(t) for t in texts]
    wrong = [(t, g, w) for t, g, w in zip(texts, decoded(table, texts), want) if g != w]
    assert not wrong, wrong[:5]


def test_every_name(table):
    check(table, [f"a &{n} b &{n}x &{n[:-1]}" for n in html5])


def test_numbers(table):
    numbers = [*range(0x180), *range(0xD7F0, 0xE010, 7), 0xD800, 0xDFFF, *range(0xFDC8, 0xFDF8), 0xFFFD, 0xFFFE, 0xFFFF]
    numbers += [0x10000, 0x1FFFE, 0x1F600, 0x10FFFD, 0x10FFFF, 0x110000, 10**8, 10**9, 10**30, 16**8 - 1]
    check(table, [f"x&#{n};y&#{n} &#x{n:x};&#X{n:X}z&#000{n};" for n in numbers])


def test_texts_of_all_kinds(table):
    rng = random.Random(4)
    parts = ["&", "amp", ";", "#", "x41", "lt", "notit;", "&notin;", "é", " ", "<", "&#", "&;", "65", "\n", "q" * 40, "😀", "&AMP"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(1500)]
    check(table, [*texts, None, "", "&", "&&", "no reference", "&amp;lt;", "&" + "z" * 100_000])
