"""Merkle manifest of a dataset: a digest per row, a root per group, a root of all, and proofs.

Nodes of a group are numbered in order and cut into aligned blocks of 3^5. A block keeps each of its
levels as one string, the hexadecimal digests of that level behind each other: a parent is the hash of
a substring of three digests, the siblings of a node are what stands left and right of it in
that substring. The root of a block is a node of the next round, until every group has one; the roots
of the groups are the nodes of one more tree. Proofs are put together downwards, a block at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.llm.mixing import prefix_sums
from opinion_spark.llm.tables import documents
from opinion_spark.staging import stage, staged_lookup

FANOUT = 3
#: Levels of a block, and its nodes.
LEVELS = 5
BLOCK = FANOUT**LEVELS
#: Characters of a digest.
HEX = 64

PROOF = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as it is hashed: its bytes behind their number, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def _cut(level: str, start: Column, nodes: Column) -> Column:
    return F.substring(F.col(level), start * HEX + 1, nodes * HEX)


def _parents(level: str) -> Column:
    """The next level of a level string."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (FANOUT * HEX)).cast("int"))
    hashed = F.transform(runs, lambda i: F.sha2(_cut(level, i * FANOUT, F.lit(FANOUT)), 256))
    return F.array_join(hashed, "")


def _blocks(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(g, block, n, members, l0.., top)`` from ``(g, i, node, member)``: a row per aligned block.

    ``n`` is the number of nodes of the group; a level exists while more than one node is left.
    """
    placed = nodes.groupBy("g", F.floor(F.col("i") / BLOCK).alias("block"))
    listed = placed.agg(F.sort_array(F.collect_list(F.struct("i", "node", "member"))).alias("listed"))
    levels = listed.select(
        "g",
        "block",
        F.transform("listed", lambda x: x["member"]).alias("members"),
        F.array_join(F.transform("listed", lambda x: x["node"]), "").alias("l0"),
    )
    named = sizes.withColumnRenamed("g", "_g")
    levels = levels.join(named, F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
    for j in range(LEVELS):
        levels = levels.withColumn(f"l{j + 1}", F.when(F.col("n") > FANOUT**j, _parents(f"l{j}")))
    top = F.coalesce(*[f"l{j}" for j in range(LEVELS, -1, -1)])
    return stage(levels.withColumn("top", top), "blocks")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of every round, from the leaves ``(g, i, node, member)`` up to one block per group."""
    sizes = staged_lookup(nodes.groupBy("g").agg(F.count("*").alias("n")))
    largest = sizes.agg(F.max("n")).head()[0] or 0
    found = [_blocks(nodes, sizes)]
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        sizes = sizes.withColumn("n", F.ceil(F.col("n") / BLOCK))
        nothing = F.lit(None).cast("int")
        nodes = found[-1].select("g", F.col("block").alias("i"), F.col("top").alias("node"), nothing.alias("member"))
        found.append(_blocks(nodes, sizes))
    return found


def _own(pos: Column) -> Column:
    """The siblings of the node at ``pos`` of a block, up to the block's root."""
    steps = []
    for j in range(LEVELS):
        at = F.floor(pos / FANOUT**j).cast("int")
        inside = F.pmod(at, F.lit(FANOUT))
        left = _cut(f"l{j}", at - inside, inside)
        right = _cut(f"l{j}", at + 1, F.lit(FANOUT - 1) - inside)
        steps.append(F.when(F.col("n") > FANOUT**j, F.struct(left.alias("left"), right.alias("right"))))
    return F.array_compact(F.array(*steps))


def _proofs(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """``(g, i, leaf, member, proof, above)`` of all leaves; ``above`` has ``(g, above)``, the
    ``above.proof`` of each group's root among it."""
    above = above.select(F.col("g").alias("_g"), F.lit(0).cast("bigint").alias("_i"), "above", F.col("above.proof").alias("rest"))
    for blocks in reversed(rounds):
        same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_i"))
        joined = blocks.join(above, same).select("*", F.posexplode("members").alias("pos", "member"))
        nodes = joined.select(
            "g",
            (F.col("block") * BLOCK + F.col("pos")).alias("i"),
            _cut("l0", F.col("pos"), F.lit(1)).alias("leaf"),
            "member",
            F.concat(_own(F.col("pos")), "rest").alias("proof"),
            "above",
        )
        above = nodes.select(F.col("g").alias("_g"), F.col("i").alias("_i"), "above", F.col("proof").alias("rest"))
    return nodes


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, their place in the group from 0, dealt by range."""
    one = rows.withColumn("one", F.lit(1).cast("bigint"))
    return prefix_sums(one, group, order, "one").withColumnRenamed("before", "i").drop("one")


def merkle_manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group: str = "source",
    fields: Sequence[str] = FIELDS,
    carry: Column | None = None,
) -> DataFrame:
    """``(<id_col>, carried, leaf, subroot, root, proof)``, one row per row of ``docs``.

    ``proof`` lists the siblings of each level from the leaf to ``root``, as what stands left and right
    of the path; ``folded(leaf, proof)`` is the root. Leaves of a group are ordered by id, null first,
    repeated ids by leaf; equal rows get the places of each other. Groups are ordered by their bytes, the
    group of null first. ``carry`` is a column computed with the leaf and handed through. Columns that
    are not in ``fields`` are ignored. An empty table gives no rows.
    """
    carry = F.lit(None).cast("string") if carry is None else carry
    leaves = docs.select(
        F.col(group).alias("g"),
        F.col(id_col).alias("id"),
        leaf(*[F.col(c) for c in fields]).alias("node"),
        carry.alias("carried"),
    )
    numbered = _numbered(stage(leaves, "leaves"), "g", ["id", "node"])
    rounds = _rounds(stage(numbered.select("g", "i", "node", F.struct("id", "carried").alias("member")), "numbered"))
    roots = rounds[-1].select(F.lit(0).alias("all"), F.col("g").alias("group"), F.col("top").alias("node"))
    ranked = _numbered(stage(roots, "roots"), "all", ["group"])
    upper = _rounds(stage(ranked.select(F.col("all").alias("g"), "i", "node", F.struct("group").alias("member")), "ranked"))
    nothing = F.array().cast(PROOF).alias("proof")
    start = upper[-1].select("g", F.struct(nothing, F.col("top").alias("root")).alias("above"))
    of_groups = _proofs(upper, start).select(
        F.col("member.group").alias("g"),
        F.struct(F.col("proof"), F.col("leaf").alias("subroot"), F.col("above.root").alias("root")).alias("above"),
    )
    proofs = _proofs(rounds, stage(of_groups, "subroots"))
    return proofs.select(
        F.col("member.id").alias(id_col),
        F.col("member.carried").alias("carried"),
        "leaf",
        F.col("above.subroot").alias("subroot"),
        F.col("above.root").alias("root"),
        "proof",
    )


def _tampered() -> Column:
    """The leaf of a row after its text lost its line ends, for every even checksum of the id."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    return F.when(hit, leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered copies are checked against the manifest; rows without id are not tampered with."""
    return tamper_check(documents(spark, sf_dir))


def tamper_check(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` with the roots that tampered rows lead to."""
    rows = merkle_manifest(docs, carry=_tampered())
    rows = rows.withColumn("folded_root", folded(F.coalesce("carried", "leaf"), F.col("proof")))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def merkle_sql(docs: str, levels: int = 12) -> str:
    """The query over a table with ``FIELDS``, in SQL, for at most ``3 ** levels`` rows and sources."""

    def of(text: str) -> str:
        values = [f"CAST({c} AS VARCHAR)" for c in FIELDS[:-1]] + [text]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    steps, paths = [], []

    def tree(name: str, key: str) -> None:
        """Levels of one forest: ``<name>0`` has (key, i, h, n)."""
        for j in range(levels):
            steps.append(
                f"{name}{j + 1} AS (SELECT {key}, i // 3 AS i, CASE WHEN any_value(n) > 1 THEN "
                f"sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, "
                f"CAST(ceil(any_value(n) / 3) AS BIGINT) AS n FROM {name}{j} GROUP BY {key}, i // 3)"
            )
            steps.append(
                f"{name}p{j} AS (SELECT {key}, i, "
                f"coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, "
                f"coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt, n "
                f"FROM {name}{j} WINDOW w AS (PARTITION BY {key}, i // 3 ORDER BY i))"
            )

    tree("a", "source")
    lower = list(steps)
    steps.clear()
    tree("b", "k")
    upper = list(steps)
    folds, last = [], "leaves"
    for name, at, key in [("a", "i", "l.source IS NOT DISTINCT FROM p.source"), ("b", "s.i", "TRUE")]:
        for j in range(levels):
            paths.append((name, j, key))
    for number, (name, j, key) in enumerate(paths):
        place = "l.i" if name == "a" else "l.r"
        folds.append(
            f"f{number} AS (SELECT l.* REPLACE (l.proof || CASE WHEN p.n > 1 THEN p.lft || p.rgt ELSE '' END AS proof, "
            f"CASE WHEN p.n > 1 THEN sha256(p.lft || l.fold || p.rgt) ELSE l.fold END AS fold) "
            f"FROM {last} l JOIN {name}p{j} p ON {key} AND p.i = {place} // {3**j})"
        )
        last = f"f{number}"
    return f"""
WITH table_of AS (
  SELECT list_transform(range(256), lambda n: list_reduce([CAST(n AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: xor(c >> 1, (c & 1) * 3988292384))) AS t
), hashed AS (
  SELECT doc_id, source, {of("text")} AS leaf, {of("replace(text, chr(10), '')")} AS bad,
    list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])) AS crc
  FROM {docs}, table_of
), a0 AS (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h,
    count(*) OVER (PARTITION BY source) AS n,
    doc_id, CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295) % 2 = 0 THEN bad ELSE leaf END AS start
  FROM hashed
), {", ".join(lower)}, b0 AS (
  SELECT 0 AS k, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, source FROM a{levels}
), {", ".join(upper)}, leaves AS (
  SELECT a0.*, '' AS proof, start AS fold, b0.h AS subroot, b0.i AS r
  FROM a0 JOIN b0 ON a0.source IS NOT DISTINCT FROM b0.source
), {", ".join(folds)}
SELECT doc_id, f.h AS leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
  fold = b.h AS verified
FROM {last} f, b{levels} b"""
