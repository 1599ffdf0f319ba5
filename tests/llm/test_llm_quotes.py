import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opinion_spark.llm.quotes import link_quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def linked(table, rows, schema=SCHEMA):
    columns = ["conv_id", "turn", "own_text", "n_quotes", "max_level", "origin_conv", "origin_turn"]
    columns += ["reply_to", "thread", "depth", "position"]
    return {(r.conv_id, r.turn): tuple(r)[2:] for r in link_quotes(table(rows, schema)).select(*columns).collect()}


def test_levels_links_and_order(table):
    got = linked(
        table,
        [
            (1, 0, "u", "Hello there\nsecond line\n\nnew para here"),
            (1, 1, "a", "Ann wrote:\n> hello   THERE\n> second line\nI agree"),
            (1, 2, "u", ">> Hello there\n> I agree\nnope"),
            (1, 3, "a", "> new para here\nanswer"),
            (1, 4, "u", "unrelated"),
            (1, 5, "u", " > nope\nlast"),
            (2, 0, "u", "> nope\n\ncross"),
            (2, 1, "b", "> unknown thing\n ok"),
        ],
    )
    assert got[1, 0] == ("Hello there\nsecond line\n\nnew para here", 0, 0, None, None, None, 0, 0, 0)
    assert got[1, 1] == ("I agree", 1, 1, 1, 0, 0, 0, 1, 1)
    assert got[1, 2] == ("nope", 2, 2, 1, 1, 1, 0, 2, 2)
    assert got[1, 3] == ("answer", 1, 1, 1, 0, 0, 0, 1, 3)
    assert got[1, 5] == ("last", 1, 1, 1, 2, 2, 0, 3, 4)
    assert got[1, 4] == ("unrelated", 0, 0, None, None, None, 4, 0, 5)
    assert got[2, 0] == ("cross", 1, 1, 1, 2, None, 0, 0, 0)
    assert got[2, 1] == ("ok", 1, 1, None, None, None, 1, 0, 1)


def test_a_long_chain_of_answers(table):
    rows = [(1, 0, "u", "m0")] + [(1, t, "u", f"> m{t - 1}\nm{t}") for t in range(1, 20)]
    got = linked(table, rows)
    assert [got[1, t][6:] for t in range(20)] == [(0, t, t) for t in range(20)]


def test_ties_common_lines_and_the_heaviest_origin(table):
    rows = [(c, 0, "u", "thanks") for c in range(30)] + [(c, 1, "u", "> thanks\nyes") for c in range(30)]
    rows += [(40, 0, "u", "> thanks"), (50, 0, "u", "short one"), (50, 1, "u", "a much longer line of text")]
    rows += [(50, 2, "u", "> short one\n>\n> a much longer line of text\nboth")]
    got = linked(table, rows)
    assert all(got[c, 1][5] == 0 for c in range(30))
    assert got[40, 0][3:6] == (0, 0, None)
    assert got[50, 2][3:6] == (50, 1, 1)


def test_nulls_empties_repeats_long_and_other_columns(table):
    rows = [
        (None, 0, "u", "> nope"), (2, None, "u", "x"), (3, 0, "u", None), (3, 0, "u", None), (3, 1, None, ">"),
        (3, 2, "u", ">>> \n>"), (4, 0, "u", "l\n" * 30_000), (4, 1, "u", "> l\n" * 3_000 + "ok"), (4, 1, "u", "> l"),
    ]
    df = table([(*r, 1, "k") for r in rows], SCHEMA + ", thread int, key string")
    got = link_quotes(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.conv_id, r.turn), []).append(r)
    assert by[None, 0][0].own_text == "> nope" and by[None, 0][0].position is None
    assert sorted(r.position for r in by[3, 0]) == [0, 1] and by[3, 1][0].n_quotes == 0
    assert {r.reply_to for r in by[4, 1]} == {0}
    assert link_quotes(df.where("turn > 99")).count() == 0


def test_every_level_is_linked(table):
    rows = [
        (1, 0, "u", "deepest words"),
        (1, 1, "a", "> deepest words\nmiddle words"),
        (1, 2, "u", ">> deepest words\n> middle words\nlast"),
        (1, 3, "u", ">> deepest words\n> edited middle\nfourth"),
        (1, 4, "u", ">>> deepest words"),
        (2, 0, "u", "none"),
    ]
    by = {(r.conv_id, r.turn): r for r in link_quotes(table(rows, SCHEMA)).collect()}
    quotes = {at: [tuple(q) for q in r.quotes] for at, r in by.items()}
    assert quotes[1, 2] == [(2, 1, 0), (1, 1, 1)] and by[1, 2].reply_to == 1
    assert quotes[1, 3] == [(2, 1, 0), (1, None, None)] and by[1, 3].reply_to == 0
    assert quotes[1, 4] == [(3, 1, 0)] and by[1, 4].reply_to == 0 and by[1, 4].thread == 0
    assert quotes[2, 0] == [] and by[2, 0].reply_to is None


def quoting_replies(messages):
    """``messages`` with a reply at the end of each conversation that quotes its last turn at level 1 and
    its first at level 2, if there are two turns."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns")
    ends = messages.where("trim(text) <> ''").groupBy("conv_id").agg(turns).where(F.size("turns") > 1)
    first, last = (F.col("turns")[0]["text"], F.element_at("turns", -1)["text"])
    quoted = [
        F.regexp_replace(F.concat(F.lit(marks + " "), text), "\n", f"\n{marks} ")
        for marks, text in ((">>", first), (">", last))
    ]
    text = F.concat_ws("\n", *quoted, F.concat(F.lit("I agree, says "), "conv_id"))
    turn = F.element_at("turns", -1)["turn"] + 1
    return messages.unionByName(ends.select("conv_id", turn.alias("turn"), F.lit("user").alias("role"), text.alias("text")))


def test_replies_derived_from_conversations(spark):
    messages = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = [r for r in link_quotes(quoting_replies(messages)).collect() if r.n_quotes]
    assert got
    for r in got:
        assert r.max_level == 2 and r.reply_to is not None and {q.level for q in r.quotes} == {1, 2}
        assert all(q.origin_conv == r.conv_id and q.origin_turn < r.turn for q in r.quotes)


def test_an_origin_elsewhere_does_not_depend_on_the_order_of_ids(table):
    rows = [(2, 0, "u", "X is said"), (1, 0, "u", "> X is said"), (1, 1, "u", "X is said")]
    rows += [(3, 0, "u", "Y is said"), (4, 0, "u", "> Y is said"), (4, 1, "u", "Y is said")]
    rows += [(5, 0, "u", "> Z is said\nZ is said"), (6, 3, "u", "Z is said"), (7, 0, "u", "Z is said")]
    got = linked(table, rows)
    assert got[1, 0][3:6] == (2, 0, None)
    assert got[4, 0][3:6] == (3, 0, None)
    assert got[5, 0][3:6] == (6, 3, None)


def normal(text):
    return re.sub(r"\s+", " ", text).strip(" ").lower()


def passages_of(text):
    """Runs of lines of one depth: [(level, [bodies])]."""
    found, level, open_run = [], None, False
    for line in text.split("\n"):
        marks = re.match(r"(?:[ \t]{0,3}>)*", line).group()
        depth, body = marks.count(">"), line[len(marks) :]
        if depth != level or not body.strip(" "):
            open_run = False
        level = depth
        if body.strip(" "):
            if not open_run:
                found.append((depth, []))
                open_run = True
            found[-1][1].append(body)
    return found


def units_of(bodies):
    return [normal(" ".join(bodies)), *map(normal, bodies)]


def plain_links(rows):
    """``{(conv, turn, text): (quotes, origin, reply_to, depth)}``, one message after the other."""
    messages = {(c, t, x or "") for c, t, _, x in rows}
    said = {}
    for conv, turn, text in messages:
        own = [b for level, b in passages_of(text) if level == 0]
        whole = [normal(" ".join(x for b in own for x in b))]
        for unit in {u for b in own for u in units_of(b)} | set(whole):
            if unit:
                turns = said.setdefault(unit, {})
                turns[conv] = min(turn, turns.get(conv, turn))

    def origin(unit, conv, turn):
        turns = said.get(unit, {})
        if turns.get(conv, turn) < turn:
            return conv, turns[conv]
        others = [(c, t) for c, t in turns.items() if c != conv]
        return min(others) if others else None

    def best(votes, conv):
        order = lambda o: (o[0] == conv, votes[o], o[1], -o[0])
        return max(votes, key=order) if votes else None

    found, parents = {}, {}
    for conv, turn, text in messages:
        quotes, by_level = [], {}
        for level, bodies in passages_of(text):
            if level:
                votes = Counter()
                for unit in units_of(bodies):
                    at = origin(unit, conv, turn) if unit else None
                    if at:
                        votes[at] += len(unit)
                        by_level.setdefault(level, Counter())[at] += len(unit)
                quotes.append((level, *(best(votes, conv) or (None, None))))
        source = best(by_level[min(by_level)], conv) if by_level else None
        reply = source[1] if source and source[0] == conv else None
        found[conv, turn, text] = [quotes, source or (None, None), reply]
        if reply is not None:
            parents[conv, turn] = min(reply, parents.get((conv, turn), reply))
    for (conv, turn, _), values in found.items():
        depth = 0
        while (conv, turn) in parents:
            turn, depth = parents[conv, turn], depth + 1
        values += [turn, depth]
    return found


def random_conversations(seed):
    """Nested quotes of earlier messages, re-wrapped, cut, edited, from other conversations, repeated rows."""
    rng = random.Random(seed)
    words = ["yes", "no", "thanks", "alpha", "beta", "Gamma", "delta", "the", "of"]

    def wrapped(tokens):
        lines, at = [], 0
        while at < len(tokens):
            n = rng.randrange(1, 6)
            lines.append((" " if rng.random() < 0.7 else "  ").join(tokens[at : at + n]))
            at += n
        return lines

    rows = []
    for conv in range(1, 9):
        own = []
        for turn in range(rng.randrange(1, 7)):
            lines = []
            for _ in range(rng.randrange(0, 3)):
                source = rng.choice(rows)[3] if rows and rng.random() < 0.3 else (rng.choice(own) if own else "nobody said")
                body = [x for level, b in passages_of(source) if level == 0 for x in b] or ["empty"]
                tokens = " ".join(body).split()
                if rng.random() < 0.2:
                    tokens[-1] = "edited"
                marks = rng.choice([">", ">", ">>", "> >", ">>>"])
                quoted = wrapped(tokens) if rng.random() < 0.5 else body
                lines += [f"{marks} {x}" for x in quoted] + rng.choice([[], ["> "], [""]])
            lines += wrapped([rng.choice(words) for _ in range(rng.randrange(0, 14))]) + rng.choice([[], ["", "thanks"]])
            own.append("\n".join(lines))
            rows.append((conv, turn, "u", own[-1]))
    return rows + rng.sample(rows, 8)


@pytest.mark.parametrize("seed", range(4))
def test_against_a_plain_version(table, seed):
    rows = random_conversations(seed)
    want = plain_links(rows)
    got = link_quotes(table(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by_key = {(c, t): [v for (c2, t2, _), v in want.items() if (c2, t2) == (c, t)] for c, t, _, _ in rows}
    linked_passages = 0
    for r in got:
        values = [[tuple(q) for q in r.quotes], (r.origin_conv, r.origin_turn), r.reply_to, r.thread, r.depth]
        assert values in by_key[r.conv_id, r.turn], (r, by_key[r.conv_id, r.turn])
        linked_passages += sum(q.origin_conv is not None for q in r.quotes)
    assert linked_passages > 10


def test_a_repeated_original_is_found_once_rewrapped(table):
    original = (1, 0, "u", "one two three\nfour five six\nseven")
    reply = (1, 1, "a", "> one two\n> three four five\n> six seven\nyes")
    for rows in ([original, reply], [original, original, original, reply, reply]):
        found = [r for r in link_quotes(table(rows, SCHEMA)).collect() if r.turn == 1]
        assert [(r.reply_to, r.n_quotes) for r in found] == [(0, 1)] * (len(rows) - rows.count(original))
