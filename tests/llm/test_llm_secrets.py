import math
import random
import re

from pyspark.sql import functions as F

from opinion_spark.llm.secrets import CLASSES, redacted, with_spans

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)


def entropy(s):
    return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    for k, c in enumerate(CLASSES):
        for m in re.finditer(c.pattern, text):
            # stretches between separators that hold a listed word are cut out of the run
            at, parts = 0, [[0, ""]]
            for stretch in re.split("([/=_-])", m[0]):
                if re.search("example|placeholder|changeme|0123456789|abcdefgh", stretch, re.I):
                    parts.append([at + len(stretch), ""])
                else:
                    parts[-1][1] += stretch
                at += len(stretch)
            for first, s in parts:
                windows = range(len(s) - c.window + 1)
                high = [i for i in windows if entropy(s[i : i + c.window]) >= c.bits - 1e-7]
                if high and not s.isdigit():
                    start = m.start() + first
                    spans.append((start + high[0], 3 + k, start + high[-1] + c.window, c.kind))
    return sorted(spans)


def texts():
    rng = random.Random(8)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    found = [
        "password=abcdefghijkl", "PassWord' :  \"short", "ſecret=aaaaaaaaaaaaaaaa", "token=secret:abcdefghijklm",
        "token=password=abcdefghijkl x", "api_key: 'a.b-c_d/e+f=gh' apikey=abcdefghijklm", "secret==============",
        "AKIA" + "A" * 13, "xAKIA" + "A" * 14, "AKIAAKIA" + "1" * 20 + "z", "é" * 30 + " AKIA" + "Z9" * 8 + "é",
        "0123456789abcdef" * 2, "deadbeefdeadbeef", "a" * 40, "1" * 30, "my-example-key-4f9a8b7c6d5e4f3a2b1c0d9e8f7a6b",
        "𝒳 password = q1w2e3r4t5y6u7", "", None, "word " * 20_000, "a1b2c3d4e5f60718" * 2_000,
        "password=password=password=", "token:" * 50, "http://x/samplez/k=qX7vLm2Rt9Kp4Wz8Yc3Bn6Hs1Jd5Gf0A",
        "http://x/examples/k=qX7vLm2Rt9Kp4Wz8Yc3Bn6Hs1Jd5Gf0A", "example=qX7vLm2Rt9Kp4Wz8Yc3Bn6Hs1/placeholder/Jd5Gf0AqX7vLm2Rt9Kp4Wz8Yc",
        "qX7vLm2Rt9Kp4Wz8Yc3Bn6Hs1exampleJd5Gf0AqX7vLm2Rt9Kp4Wz8Yc",
    ]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            n = rng.randrange(10, 60)
            parts.append("".join(rng.choice(rng.choice([base64, "0123456789abcdef", "abc"])) for _ in range(n)))
        found.append(rng.choice([" ", "\n", "é", "="]).join(parts))
    return found


def test_spans_match_brute_force(table):
    rows = list(enumerate(texts()))
    got = with_spans(table([(*r, 1) for r in rows], "doc_id long, text string, spans int"))
    for r in got.select("doc_id", "spans").collect():
        assert [tuple(s) for s in r.spans] == brute(rows[r.doc_id][1]), rows[r.doc_id]


def test_redaction_covers_every_span(table):
    rows = list(enumerate(texts()))
    got = with_spans(table(rows, "doc_id long, text string")).withColumn("out", redacted(F.col("text"), F.col("spans")))
    for r in got.collect():
        text, out, at = rows[r.doc_id][1], [], 0
        for start, _, end, _ in brute(text):
            if start >= at and (start > at or not out or out[-1] != "[secret]" or start > 0):
                out += [text[at:start], "[secret]"]
            at = max(at, end)
        assert r.out == (text if not out else "".join(out) + text[at:]), rows[r.doc_id]


def test_a_listed_word_beside_a_key_does_not_hide_it(table):
    key = "qX7vLm2Rt9Kp4Wz8Yc3Bn6Hs1Jd5Gf0A"
    rows = [(1, f"http://x/samplez/k={key}"), (2, f"http://x/examples/k={key}"), (3, f"http://x/y={key}/changeme")]
    for r in with_spans(table(rows, "doc_id long, text string")).collect():
        assert any(r.text[s.start : s.end].count(key[2:-2]) for s in r.spans), r


def test_empty_table(table):
    assert with_spans(table([], "doc_id long, text string")).count() == 0


def test_one_text_with_very_many_secrets(table):
    n = 30_000
    rows = [(1, "password=zyxwvutsrqpo\n" * n), (2, "é 0f0f0f0f0f0f0f0f" * 700)]
    got = with_spans(table(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    first = [(s["start"], s["end"]) for s in got[0]["spans"] if s["kind"] == "assign"]
    assert first == [(22 * i, 22 * i + 21) for i in range(n)]
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [(18 * i + 2, 18 * i + 18) for i in range(700)]
