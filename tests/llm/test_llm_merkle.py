"""Merkle manifest against a plain version."""

import hashlib
import zlib

import duckdb
import pandas as pd
import pytest

from opinion_spark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g int, member string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(values):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return sha("".join(parts))


def tree(nodes):
    """The root, and for each leaf the (left, right) siblings of every level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            first = i - i % 3
            proofs[leaf].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
            at[leaf] = i // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


def brute(records):
    sources = sorted({r[1] for r in records}, key=lambda s: (s is not None, (s or "").encode()))
    forests = []
    for source in sources:
        rows = [(r, row_digest(r[:5])) for r in records if r[1] == source]
        rows.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        forests.append((rows, *tree([d for _, d in rows])))
    root, upper = tree([f[1] for f in forests])
    out = []
    for (rows, subroot, proofs), rest in zip(forests, upper):
        for (r, digest), proof in zip(rows, proofs):
            start = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                start = row_digest((*r[:4], None if r[4] is None else r[4].replace("\n", "")))
            chain = proof + rest
            node = start
            for left, right in chain:
                node = sha(left + node + right)
            out.append((r[0], digest, subroot, root, sha("".join(a + b for a, b in chain)), node, node == root))
    return sorted(out, key=repr)


def rows():
    found = [(i, f"s{i % 5}", "en", i * 3, f"line\n{i}\r\n", 1, "m") for i in range(60)]
    found += [(1000 + i, "hot", None, None, "é\n" * (i % 3), 2, None) for i in range(800)]
    found += [(5, "s0", "de", 1, "other text under one id", 1, "m"), (7, None, None, None, None, 1, "m")]
    found += [(8, "", "en", 0, "", 1, "m"), (None, "s1", "en", 3, "a\nb", 1, "m"), (9, "zé", "en", 5, "one", 1, "m")]
    found += [(11, "s2", "en", 2, "same\n", 1, "m"), (11, "s2", "en", 2, "same\n", 1, "m"), (12, "s2", "en", 9, "x\n" * 200_000, 1, "m")]
    return found


def result(df):
    return sorted((tuple(r) for r in merkle.tamper_check(df).select(*COLUMNS).collect()), key=repr)


def from_sql(records):
    con = duckdb.connect()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    docs = pd.DataFrame(records, columns=names).astype({"doc_id": "Int64", "n_chars": "Int64"})
    con.register("docs", docs)
    return sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({merkle.merkle_sql('docs', 7)})").fetchall(), key=repr)


def test_matches_plain_version_and_sql(table):
    want = brute(rows())
    assert result(table(rows(), SCHEMA).repartition(7)) == want
    assert from_sql(rows()) == want


@pytest.mark.parametrize("n", [1, 4, 243, 245])
def test_sizes_around_borders(table, n):
    records = [(i, "one", "en", 1, f"t\n{i}", 1, "m") for i in range(n)]
    assert result(table(records, SCHEMA)) == brute(records)


def test_many_sources(table):
    records = [(i, f"s{i}", "en", 1, f"t\n{i}", 1, "m") for i in range(300)]
    assert result(table(records, SCHEMA)) == brute(records)


def test_proofs_lead_to_the_root(table):
    found = merkle.merkle_manifest(table(rows(), SCHEMA))
    assert found.where(merkle.folded(found.leaf, found.proof) != found.root).count() == 0
    assert found.count() == len(rows())


def test_empty_table(table):
    assert merkle.tamper_check(table([], SCHEMA)).count() == 0
