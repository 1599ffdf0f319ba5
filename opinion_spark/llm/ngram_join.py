"""N-gram Jaccard join of whole texts with signature trees.

A document is the set of its word n-grams. All links between sets at or above a percentage are
found exactly; equal sets are one node of the graph, so copies cost nothing.

1. *Routing.* Two sets that reach the percentage differ in at most k members, k bound by their size
   class. The hash space is cut into more than k parts, so one part at least is equal in both. Each
   set gives one signature per part, but for parts of common n-grams alone, as many as can be spared;
   sets that meet in a signature are in one family, and all links are inside families.
2. *Trees.* A family is cut into units of bounded weight, ordered by set size. Each unit becomes a
   signature tree; dual traversal of the tree with itself and with the trees of other units of the
   family prunes node pairs by the largest possible overlap, and the leaf pairs that are left are
   compared member by member.
3. *Components* follow from the links by a distributed algorithm.

``ngram_links`` returns every link between different sets and ``linked_documents`` their number per
document. ``ngram_components`` returns components alone and does not compare sets that hang together
already.

Sets are compared by 64-bit hashes of their members, and told apart by a 64-bit digest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinion_spark.llm import signature_tree
from opinion_spark.llm.components import components
from opinion_spark.llm.mixing import prefix_sums
from opinion_spark.llm.tables import documents
from opinion_spark.llm.words import SPACED, mix, texts, word_hashes
from opinion_spark.staging import drop_staged, stage, staged_lookup

#: One document in so many is looked at for common n-grams; in how many of them one must be; how many.
SAMPLE, COMMON_IN, MOST_COMMON = 16, 3, 200_000
#: Signatures meet in so many passes, each with its share of them on disk.
PASSES = 4
#: Sizes of one class differ by less than this factor.
CLASS_RATIO = 1.45
#: Most members of the sets of one unit, where each set counts this much besides.
UNIT_WEIGHT, SET_WEIGHT = 512_000, 512


NONE = np.zeros(0, np.uint64)


def _odd(n: int) -> np.uint64:
    return np.uint64(pow(0xD6E8FEB86659FD93, n, 1 << 64))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; of all words as one if there are fewer."""
    h = word_hashes(text, SPACED)
    if not len(h):
        return h
    n = min(size, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _odd(k + 1)
    return np.unique(mix(total))


def class_bounds(largest: int) -> np.ndarray:
    """Smallest size of each class, up to one beyond ``largest``."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * CLASS_RATIO)))
    return np.array(bounds, np.int64)


def part_signatures(s: np.ndarray, percent: int, common: np.ndarray = NONE) -> np.ndarray:
    """Signatures such that two sets at or above ``percent`` share one.

    For a pair whose larger set is in a class, the sets differ in at most k members. With
    k + 1 + spare parts, spare + 1 of them are equal. So a set may leave out the parts that have none
    but ``common`` members, or else those without any, as long as there are at most ``spare`` of them:
    whichever of two similar sets leaves out more, an equal part remains in both. Which n-grams are
    common (a sorted array) changes how many sets meet, and never whether similar ones do.
    """
    n = len(s)
    bounds = class_bounds(n * 100 // percent + 1)
    weights = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(s ^ np.uint64(0xA0761D6478BD642F)), out=weights[1:])
    rare = np.zeros(n + 1, np.int64)
    rare[1:] = np.arange(1, n + 1)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        np.cumsum(common[at] != s, out=rare[1:])
    # of parts with m members on average, exp(-m) have none; the smallest sets of a class have least
    least = (100 + percent) / (2 * (100 - percent)) / CLASS_RATIO if percent < 100 else math.inf
    share = 1 / 16 + 3 * math.exp(-least)
    found = []
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    for c in range(own, len(bounds) - 1):
        if bounds[c] * percent > n * 100:
            break
        most = 2 * int(bounds[c + 1] - 1) * (100 - percent) // (100 + percent)
        spare = math.ceil(most * share)
        parts = most + 1 + spare
        edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(s, edges), [n]])
        members, telling = np.diff(at), np.diff(rare[at])
        name = np.arange(parts, dtype=np.uint64) + np.uint64(c << 40)
        signature = mix((weights[at[1:]] - weights[at[:-1]]) ^ mix(name))
        keep = np.ones(parts, bool)
        for counts in (telling, members):
            if (counts == 0).sum() <= spare:
                keep = counts > 0
                break
        found.append(signature[keep])
    return np.concatenate(found)


def _common(docs: DataFrame, id_col: str, text: str, size: int) -> np.ndarray:
    """N-grams that many of the sampled documents have, sorted."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in texts(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(value, size).view(np.int64))], ["g"])

    some = docs.where(F.pmod(F.xxhash64(id_col), F.lit(SAMPLE)) == 0).select(text)
    frequent = some.mapInArrow(cut, "g bigint").groupBy("g").agg(F.count("*").alias("n"))
    found = stage(frequent.where(F.col("n") >= COMMON_IN), "common")
    rows = found.orderBy(F.desc("n"), "g").limit(MOST_COMMON).select("g").collect()
    drop_staged(found)
    return np.sort(np.array([r["g"] for r in rows], np.int64).view(np.uint64))


def _signed(docs: DataFrame, id_col: str, text: str, size: int, percent: int) -> DataFrame:
    """``(id, h, n, dig, sigs)`` per row, ``h`` a hash of the text; rows without id or words have no digest."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, id_col, text, size))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                sizes, digests, signatures = [], [], []
                for has_id, value in zip(
                    part.column(0).is_valid().to_pylist(), texts(part.column(2)), strict=True
                ):
                    s = shingles(value, size)
                    sizes.append(len(s))
                    linked = has_id and len(s) > 0
                    digests.append(_digest(s) if linked else None)
                    signatures.append(
                        part_signatures(s, percent, common).view(np.int64) if linked else None
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.int64()),
                        pa.array(signatures, pa.list_(pa.int64())),
                    ],
                    ["id", "h", "n", "dig", "sigs"],
                )

    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("h", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("dig", T.LongType()),
            T.StructField("sigs", T.ArrayType(T.LongType())),
        ]
    )
    return _rows(docs, id_col, text).mapInArrow(sign, schema)


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, h, text)``: a row is known by its id and the hash of its text."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))


def _digest(s: np.ndarray) -> int:
    total = np.uint64(np.add.reduce(mix(s + np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
    return int(mix(np.array([total + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _meetings(signed: DataFrame) -> DataFrame:
    """``(a, b)``: the first digest of a signature with each other one.

    A shuffle of all signatures is more than twice the texts, so they come in passes by signature; what a pass
    shuffles is deleted before the next.
    """
    rows = signed.where("dig IS NOT NULL").select(F.explode("sigs").alias("sig"), "dig", "id")
    return reduce(
        DataFrame.unionByName, [_met(rows.where(F.pmod("sig", F.lit(PASSES)) == i)) for i in range(PASSES)]
    )


def _met(rows: DataFrame) -> DataFrame:
    """``(a, b)`` of the signatures of one pass.

    Rows are dealt by range of signature, digest and id, so a signature or a group of copies of any
    size is spread; each task reads its rows in order and keeps one. Where a signature goes on in
    the next range, the first digests of both are tied.
    """
    ordered = rows.repartitionByRange("sig", "dig", "id").sortWithinPartitions("sig", "dig")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # first row here; current signature and its first digest
        for batch in batches:
            sig, dig = (np.asarray(c) for c in batch.columns)
            if not len(sig):
                continue
            if last is None:
                first = last = int(sig[0]), int(dig[0])
            sig, dig = np.append(last[0], sig), np.append(last[1], dig)
            lead = np.append(True, sig[1:] != sig[:-1])
            hub = dig[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            last = int(sig[-1]), int(hub[-1])
            meet = hub != dig
            pairs = np.unique(np.stack([hub[meet], dig[meet]], axis=1), axis=0)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none, none], MEETING_NAMES
            )
        if last is not None:
            border = [first[1], last[1], TaskContext.get().partitionId(), first[0], last[0]]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in border], MEETING_NAMES)

    met = stage(ordered.select("sig", "dig").mapInArrow(chain, MEETING), "met")
    order = W.orderBy("part")  # one row per range
    borders = met.where("part IS NOT NULL").select(
        F.lag("b").over(order).alias("a"),
        F.col("a").alias("b"),
        (F.lag("last").over(order) == F.col("first")).alias("same"),
    )
    inside = met.where("part IS NULL").select("a", "b")
    return inside.unionByName(borders.where("same AND a <> b").select("a", "b"))


MEETING_NAMES = ["a", "b", "part", "first", "last"]
MEETING = ", ".join(f"{name} bigint" for name in MEETING_NAMES)


def _sets(linkable: DataFrame) -> DataFrame:
    """``(dig, n, id, h, copies)``: the distinct sets, the first row by id and text that has each, and how
    many ids have it."""
    grouped = linkable.groupBy("dig", "n")
    found = grouped.agg(F.min(F.struct("id", "h")).alias("row"), F.count_distinct("id").alias("copies"))
    return stage(found.select("dig", "n", "row.id", "row.h", "copies"), "sets")


def _placed(sets: DataFrame, families: DataFrame, unit_weight: int) -> DataFrame:
    """``(unit, family, whole, dig, n, id, h, copies)``: one row per distinct set of a family.

    Sets are ordered by family and size and cut into units of equal weight; ``whole`` says that the
    family lies in one unit.
    """
    members = sets.join(families.withColumnsRenamed({"node": "dig", "component": "family"}), "dig")
    weighed = members.withColumn("weight", F.col("n") + SET_WEIGHT).withColumn("all", F.lit(0))
    summed = prefix_sums(weighed, "all", ["family", "n", "dig"], "weight")
    units = stage(
        summed.select(
            F.floor(F.col("before") / unit_weight).alias("unit"), "family", "dig", "n", "id", "h", "copies"
        ),
        "units",
    )
    spread = units.groupBy("family").agg((F.min("unit") == F.max("unit")).alias("whole"))
    return stage(units.join(staged_lookup(spread), "family"), "placed")


#: What is returned of the links: only as many as tie sets together, or besides how many each set has,
#: or all of them.
TIES, COUNTS, PAIRS = "ties", "counts", "pairs"


def _every_link(
    sets_a: list[np.ndarray],
    sets_b: list[np.ndarray] | None,
    percent: int,
    dig: np.ndarray,
    copies: np.ndarray,
    give: str,
) -> list[tuple]:
    """``(a, b, links)`` of all links: the pairs, or ties ``(a, b)`` and documents linked with ``a``."""
    i, j = signature_tree.every_link(sets_a, sets_b, percent)
    if give == PAIRS:
        return [(a, b, None) for a, b in zip(dig[i], dig[j], strict=True)]
    count = np.zeros(len(dig), np.int64)
    np.add.at(count, i, copies[j])
    np.add.at(count, j, copies[i])
    roots = signature_tree.joined(i, j, len(dig))
    ties = [(dig[x], dig[root], None) for x, root in enumerate(roots) if x != root]
    return ties + [(dig[x], None, int(count[x])) for x in np.flatnonzero(count)]


def _placed_texts(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``placed`` with the text of each set, one row per set however often its row is repeated.

    Sorted on both sides at every size: what is looked up grows with the texts. Repeats of a row then
    stand side by side.
    """
    return rows.join(placed.hint("merge"), ["id", "h"]).dropDuplicates(["id", "h"])


def _unit_links(
    docs: DataFrame, placed: DataFrame, id_col: str, text: str, size: int, percent: int, give: str
) -> DataFrame:
    """What links within each unit, and the sets of units whose family is spread over several.

    ``(a, b, links, unit, family, n, copies, members)``: rows with ``unit`` are sets. Of the others, rows
    with ``b`` tie a set to the first one of its group or are a link, rows with ``links`` count.
    """
    def join_unit(batch: pa.Table) -> pa.Table:
        rows = batch.combine_chunks()
        values = rows.column("text").combine_chunks()
        dig = rows.column("dig").to_numpy()
        family = rows.column("family").to_numpy()
        whole = rows.column("whole").to_numpy(zero_copy_only=False)
        copies = rows.column("copies").to_numpy()
        unit = int(rows.column("unit")[0].as_py())
        sets = [shingles(value, size) for value in texts(values)]
        own = sorted(range(len(sets)), key=lambda k: (family[k], len(sets[k]), dig[k]))
        out = []
        for group in _runs(own, family):
            members = [sets[k] for k in group]
            if give == TIES:
                groups = signature_tree.Groups(np.arange(len(group)))
                signature_tree.links(members, None, percent, groups)
                roots = groups.roots().tolist()
                linked = [(dig[group[x]], dig[group[y]], None) for x, y in enumerate(roots) if x != y]
            else:
                linked = _every_link(members, None, percent, dig[group], copies[group], give)
            out += [(*row, None, None, None, None, None) for row in linked]
            if not whole[group[0]]:
                out += [
                    (dig[k], None, None, unit, family[k], len(sets[k]), copies[k], sets[k].tobytes())
                    for k in group
                ]
        return _table(out, UNIT)

    found = _placed_texts(_rows(docs, id_col, text), placed)
    return found.groupBy("unit").applyInArrow(join_unit, UNIT)


LINK = "a bigint, b bigint, links bigint"
UNIT = LINK + ", unit bigint, family bigint, n bigint, copies bigint, members binary"


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    fields = [f.split() for f in ddl.split(", ")]
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table(
        {name: pa.array(list(c), kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)}
    )


def _runs(order: list[int], family: np.ndarray) -> list[list[int]]:
    """Stretches of ``order`` with one family."""
    runs: list[list[int]] = []
    for k in order:
        if runs and family[runs[-1][0]] == family[k]:
            runs[-1].append(k)
        else:
            runs.append([k])
    return runs


def _cross_links(pairs: DataFrame, sets: DataFrame, percent: int, give: str) -> DataFrame:
    """Links between the sets of two units, for ``(family, low, high)`` pairs of units.

    For ties, sets that are in one group ``g`` already are not compared.
    """

    def join_units(batch: pa.Table) -> pa.Table:
        rows = batch.sort_by([("unit", "ascending"), ("n", "ascending"), ("a", "ascending")])
        unit, dig = rows.column("unit").to_numpy(), rows.column("a").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("members").to_pylist()]
        split = int(np.searchsorted(unit, unit[0], side="right"))
        if split == len(sets):
            return _table([], LINK)
        if give != TIES:
            copies = rows.column("copies").to_numpy()
            return _table(_every_link(sets[:split], sets[split:], percent, dig, copies, give), LINK)
        groups = signature_tree.Groups(rows.column("g").to_numpy())
        found = signature_tree.links(sets[:split], sets[split:], percent, groups)
        return _table([(dig[x], dig[y], None) for x, y in found], LINK)

    ends = pairs.select("family", "low", "high", F.explode(F.array("low", "high")).alias("unit"))
    return ends.join(sets, ["family", "unit"]).groupBy("family", "low", "high").applyInArrow(
        join_units, LINK
    )


def _units(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links found within units, and the sets to be compared over units."""
    sets = found.where("unit IS NOT NULL").select("a", "unit", "family", "n", "copies", "members")
    return found.where("unit IS NULL").select("a", "b", "links"), sets


def _whole_links(found: DataFrame, percent: int, give: str) -> DataFrame:
    """``(a, b, links)`` within units and between all units of a family whose sizes are near enough."""
    inside, sets = _units(found)
    if sets.isEmpty():
        return inside
    units = staged_lookup(
        sets.groupBy("family", "unit").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    )
    low = units.select("family", F.col("unit").alias("low"), "most")
    high = units.select("family", F.col("unit").alias("high"), F.col("least").alias("high_least"))
    near = F.col("most") * 100 >= F.col("high_least") * percent
    pairs = low.join(high, "family").where((F.col("high") > F.col("low")) & near)
    return inside.unionByName(_cross_links(pairs, sets, percent, give))


def _spread_links(found: DataFrame, percent: int) -> DataFrame:
    """Ties between units of families that are spread over several units.

    Neighbours in size come first; they tie most copies together. Of the other unit pairs only
    those are left whose sizes are near enough and which are not in one component already.
    """
    inside, sets = _units(found)
    if sets.isEmpty():
        return inside
    units = staged_lookup(
        sets.groupBy("family", "unit").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    )
    other = units.select(
        "family", F.col("unit").alias("high"), F.col("least").alias("high_least")
    )
    near = F.col("most") * 100 >= F.col("high_least") * percent
    low = units.select("family", F.col("unit").alias("low"), "most")
    neighbours = low.join(
        other.withColumn("low", F.col("high") - 1), ["family", "low"]
    ).where(near)
    alone = sets.withColumn("g", F.col("a"))
    chained = stage(_cross_links(neighbours, alone, percent, TIES), "chained")
    known = inside.unionByName(chained)
    groups = stage(components(known), "groups").withColumnRenamed("node", "a")
    grouped = stage(
        sets.join(groups, "a", "left")
        .withColumn("g", F.coalesce("component", "a"))
        .drop("component"),
        "grouped",
    )
    state = staged_lookup(
        grouped.groupBy("family", "unit").agg(
            F.min("n").alias("least"),
            F.max("n").alias("most"),
            F.min("g").alias("first"),
            F.max("g").alias("last"),
        )
    )
    low = state.select("family", F.col("unit").alias("low"), "most", "first", "last")
    high = state.select(
        "family",
        F.col("unit").alias("high"),
        F.col("least").alias("high_least"),
        F.col("first").alias("high_first"),
        F.col("last").alias("high_last"),
    )
    together = (F.least("first", "high_first") == F.greatest("last", "high_last"))
    pairs = low.join(high, "family").where(
        (F.col("high") > F.col("low") + 1) & near & ~together
    )
    return known.unionByName(_cross_links(pairs, grouped, percent, TIES))


def ngram_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    size: int = 3,
    percent: int = 90,
    unit_weight: int = UNIT_WEIGHT,
) -> DataFrame:
    """``(<id_col>, n_shingles, component_id)``, one row per row of ``docs``.

    Two rows link when 100 * intersection >= ``percent`` * union of their n-gram sets; the
    component is named by its smallest id. Words are separated by ASCII white space, A-Z are
    lower-cased; a text of fewer words than ``size`` is one n-gram. Null and empty texts link with
    nothing and are their own component; rows without id take no part and have no component.
    Repeated rows agree; rows that share an id but not the text are different nodes. Other columns
    are ignored.
    """
    base, sets, found = _joined(docs, id_col, text, size, percent, unit_weight, TIES)
    linked = components(_spread_links(found, percent))
    return _named(base, sets, linked, id_col).drop("dig")


def linked_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    size: int = 3,
    percent: int = 90,
    unit_weight: int = UNIT_WEIGHT,
) -> DataFrame:
    """``ngram_components`` with ``n_links``, the number of documents that a row's document links with.

    All links count, those with copies of the text too. A document is an id and a text, so repeated
    rows count once. Rows that link with nothing or take no part have 0.
    """
    base, sets, found = _joined(docs, id_col, text, size, percent, unit_weight, COUNTS)
    links = stage(_whole_links(found, percent, COUNTS), "links")
    linked = components(links.where("b IS NOT NULL").select("a", "b"))
    counted = links.where("b IS NULL").groupBy(F.col("a").alias("dig")).agg(F.sum("links").alias("links"))
    own = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    n_links = staged_lookup(sets.join(counted, "dig", "left").select("dig", own.alias("n_links")))
    return (
        _named(base, sets, linked, id_col)
        .join(n_links, "dig", "left")
        .select(id_col, "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def ngram_links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    size: int = 3,
    percent: int = 90,
    unit_weight: int = UNIT_WEIGHT,
) -> DataFrame:
    """``(a, b, a_set, b_set)``: every link between two different sets, once.

    ``a`` and ``b`` are the smallest ids that have the sets, ``a_set`` and ``b_set`` their digests, which
    tell them apart where texts share an id. Copies of a text are one set.
    """
    _, sets, found = _joined(docs, id_col, text, size, percent, unit_weight, PAIRS)
    links = _whole_links(found, percent, PAIRS).select(F.col("a").alias("a_set"), F.col("b").alias("b_set"))
    ids = staged_lookup(sets.select("dig", "id"))
    for end in "ab":
        links = links.join(ids.select(F.col("dig").alias(f"{end}_set"), F.col("id").alias(end)), f"{end}_set")
    a, b = F.struct("a", "a_set"), F.struct(F.col("b").alias("a"), F.col("b_set").alias("a_set"))
    ends = links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    return ends.selectExpr("low.a AS a", "high.a AS b", "low.a_set AS a_set", "high.a_set AS b_set")


def _joined(
    docs: DataFrame, id_col: str, text: str, size: int, percent: int, unit_weight: int, give: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(id, h, n, dig)`` per row, the distinct sets, and what ``_unit_links`` gives."""
    signed = stage(_signed(docs, id_col, text, size, percent), "signed")
    base = stage(signed.select("id", "h", "n", "dig"), "base")
    families = stage(components(_meetings(signed)), "families")
    drop_staged(signed)
    sets = _sets(base.where("dig IS NOT NULL"))
    placed = _placed(sets, families, unit_weight)
    return base, sets, stage(_unit_links(docs, placed, id_col, text, size, percent, give), "found")


def _named(base: DataFrame, sets: DataFrame, linked: DataFrame, id_col: str) -> DataFrame:
    """``(<id_col>, n_shingles, component_id, dig)`` per row, components named by their smallest id."""
    first = sets.select("dig", F.col("id").alias("first"))
    firsts = first.join(linked.withColumnRenamed("node", "dig"), "dig", "left").withColumn(
        "component", F.coalesce("component", "dig")
    )
    firsts = stage(firsts, "firsts")
    names = firsts.groupBy("component").agg(F.min("first").alias("component_id"))
    named = staged_lookup(
        firsts.join(staged_lookup(names), "component").select("dig", "component_id")
    )
    return base.join(named, "dig", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        "dig",
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(documents(spark, sf_dir))
