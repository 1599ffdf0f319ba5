"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Candidates are long runs of one character class. A window slides over each; the counts of its
characters change by one character in and one out, and with them the sum of ``c * log2(c)``, from
which the Shannon entropy follows. Sums are integers, so nothing drifts over long strings.
Stretches that an allow-list names are suppressed. DataFrame functions only; texts are never
moved, each row is judged where it is read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.llm.tables import documents

KINDS = ("assign", "access", "hex")


def _either(word: str) -> str:
    """ASCII letters of ``word`` in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Shortest value of an assignment.
ASSIGN_VALUE = 12
#: Runs are matched whole, so the shortest length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"


@dataclass(frozen=True)
class CharClass:
    """Runs of ``pattern`` are candidates; ``bits`` is the least entropy of a window."""

    kind: str
    alphabet: str
    bits: float
    window: int = 20

    @property
    def pattern(self) -> str:
        chars = self.alphabet.replace("-", "") + ("-" if "-" in self.alphabet else "")
        return f"[{chars}]{{{self.window},}}"

    @property
    def table(self) -> list[int]:
        """``c * log2(c)`` in millionths for c = 0 .. window."""
        return [0] + [round(c * math.log2(c) * 1e6) for c in range(1, self.window + 1)]

    @property
    def most(self) -> int:
        """Largest sum of a window that has the entropy asked for."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * 1e6)


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = (
    CharClass("entropy_hex", DIGITS + "abcdefABCDEF", 3.0),
    CharClass("entropy_base64", UPPER + LOWER + DIGITS + "+/_=-", 4.0),
)
#: Placeholders and plain counting. The stretch between separators that holds one is no secret; what
#: stands before and behind it is judged on its own.
ALLOWED = (
    _either("example"),
    _either("placeholder"),
    _either("changeme"),
    r"0123456789",
    _either("abcdefgh"),
)
ALLOWED_STRETCH = rf"[^/=_-]*(?:{'|'.join(ALLOWED)})[^/=_-]*"
#: Nor are these.
BARE_NUMBER = r"^[0-9]+$"


#: Starts are gathered in blocks of so many, so that a step copies a block and not all starts so far.
BLOCK = 256


def _starts(text: Column, pattern: str) -> tuple[Column, Column]:
    """All matches of ``pattern`` and the code point at which each starts.

    The pieces between the matches come from the same pattern, so lengths add up to places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    zero = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<int>").alias("block"),
        F.array().cast("array<array<int>>").alias("done"),
    )

    def walk(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        block, done = state["block"], state["done"]
        full = F.size(block) >= BLOCK
        return F.struct(
            (start + F.length(x["match"])).alias("at"),
            F.when(full, F.array(start)).otherwise(F.array_append(block, start)).alias("block"),
            F.when(full, F.array_append(done, block)).otherwise(done).alias("done"),
        )

    walked = F.aggregate(
        F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("match")),
        zero,
        walk,
        lambda state: F.flatten(F.array_append(state["done"], state["block"])),
    )
    return found, walked


SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _span(kind: str, rank: int, start: Column, end: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        F.lit(rank).alias("rank"),
        end.cast("int").alias("end"),
        F.lit(kind).alias("kind"),
    )


def _pattern_spans(text: Column, kind: str, rank: int, pattern: str, present: str) -> Column:
    """Spans of all matches in texts where ``present`` matches, else none."""
    found, starts = _starts(text, pattern)
    zipped = F.arrays_zip(found.alias("match"), starts.alias("start"))
    if kind == "assign":
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        zipped = F.arrays_zip(found.alias("match"), starts.alias("start"), value.alias("value"))
        zipped = F.filter(zipped, lambda x: F.length(x["value"]) >= ASSIGN_VALUE)
    spans = F.transform(
        zipped, lambda x: _span(kind, rank, x["start"], x["start"] + F.length(x["match"]))
    )
    return F.when(text.rlike(present), spans).otherwise(F.array().cast(SPAN))


def _high_window(chars: Column, c: CharClass) -> Column:
    """``(first, last)``: last character of the first and of the last window with high entropy."""
    codes = F.transform(chars, lambda x: F.instr(F.lit(c.alphabet), x) - 1)
    ahead = F.array_repeat(F.lit(-1), c.window)
    table = F.array(*[F.lit(v).cast("bigint") for v in c.table])
    zero = F.struct(
        F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"),
        F.lit(0).cast("bigint").alias("sum"),
        F.lit(0).alias("i"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def at(values: Column, i: Column) -> Column:
        return F.coalesce(F.get(values, i), F.lit(0))

    def slide(state: Column, x: Column) -> Column:
        counts, enters, leaves, i = state["counts"], x["enters"], x["leaves"], state["i"]
        gone = at(counts, leaves)
        there = at(counts, enters) - (leaves == enters).cast("int")
        new = (
            state["sum"] - at(table, gone) + at(table, gone - 1) + at(table, there + 1) - at(table, there)
        )
        high = (i >= c.window - 1) & (new <= c.most)
        return F.struct(
            F.transform(
                counts, lambda n, j: n + (j == enters).cast("int") - (j == leaves).cast("int")
            ).alias("counts"),
            new.alias("sum"),
            (i + 1).alias("i"),
            F.coalesce(state["first"], F.when(high, i)).alias("first"),
            F.when(high, i).otherwise(state["last"]).alias("last"),
        )

    # what enters beside what leaves, so that no step looks back into the string
    leaving = F.concat(ahead, F.slice(codes, 1, F.greatest(F.size(codes) - c.window, F.lit(0))))
    steps = F.zip_with(
        codes, leaving, lambda x, y: F.struct(x.alias("enters"), F.coalesce(y, F.lit(-1)).alias("leaves"))
    )
    return F.aggregate(
        steps, zero, slide, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))
    )


def _unlisted(run: Column, start: Column) -> Column:
    """The parts ``(match, start)`` of a run that the allow-list leaves."""
    listed, at = _starts(run, ALLOWED_STRETCH)
    behind = F.zip_with(at, listed, lambda i, x: i + F.length(x))
    begins = F.concat(F.array(F.lit(0)), behind)
    parts = F.zip_with(
        F.split(run, ALLOWED_STRETCH, -1),
        begins,
        lambda part, i: F.struct(part.alias("match"), (start + i).alias("start")),
    )
    whole = F.array(F.struct(run.alias("match"), start.alias("start")))
    return F.when(run.rlike("|".join(ALLOWED)), parts).otherwise(whole)


def _entropy_spans(text: Column, c: CharClass, rank: int) -> Column:
    """From the first to the last window of high entropy in each candidate, without what the allow-list
    names."""
    found, starts = _starts(text, c.pattern)
    runs = F.arrays_zip(found.alias("match"), starts.alias("start"))
    parts = F.flatten(F.transform(runs, lambda x: _unlisted(x["match"], x["start"])))
    candidates = F.filter(parts, lambda x: (F.length(x["match"]) >= c.window) & ~x["match"].rlike(BARE_NUMBER))
    judged = F.transform(
        candidates,
        lambda x: F.struct(x["start"].alias("start"), _high_window(F.split(x["match"], ""), c).alias("w")),
    )
    spans = F.transform(
        F.filter(judged, lambda x: x["w"]["first"].isNotNull()),
        lambda x: _span(
            c.kind, rank, x["start"] + x["w"]["first"] - c.window + 1, x["start"] + x["w"]["last"] + 1
        ),
    )
    return F.when(text.rlike(c.pattern), spans).otherwise(F.array().cast(SPAN))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: ``(start, rank, end, kind)`` of every secret, by start and kind.

    Places count code points, the end is exclusive. Null and empty texts have none. Rows are
    judged one by one, so repeated rows agree; a column of ``docs`` named ``spans`` is replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    present = ASSIGN.removesuffix("+)") + f"{{{ASSIGN_VALUE}}})"
    patterns = ((ASSIGN, present), (ACCESS, ACCESS), (HEX, HEX))
    spans = [
        _pattern_spans(value, kind, rank, pattern, present)
        for rank, (kind, (pattern, present)) in enumerate(zip(KINDS, patterns, strict=True))
    ]
    spans += [_entropy_spans(value, c, len(KINDS) + i) for i, c in enumerate(CLASSES)]
    return docs.withColumn("spans", F.array_sort(F.concat(*spans)))


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with ``mark`` in place of every stretch that spans cover."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        ahead = F.substring(text, state["at"] + 1, x["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], x["end"]).alias("at"),
            F.when(
                (x["start"] >= state["at"]) & ((x["start"] > 0) | (F.size(state["kept"]) == 0)),
                F.concat(state["kept"], F.array(ahead, F.lit(mark))),
            )
            .otherwise(state["kept"])
            .alias("kept"),
        )

    whole = F.aggregate(
        spans,
        zero,
        step,
        lambda s: F.concat(
            F.array_join(s["kept"], ""), F.substring(text, s["at"] + 1, F.length(text))
        ),
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = with_spans(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["rank"] < len(KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(spans).alias("spans"),
    )


def secrets_sql(docs: str) -> str:
    """The query over a table with ``doc_id`` and ``text``, in SQL; entropy window by window."""

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''").replace('\\"', '"') + "'"

    def found(kind: str, rank: int, pattern: str) -> str:
        keep = f"length(regexp_extract(m.match, {quoted(pattern)}, 2)) >= {ASSIGN_VALUE}"
        return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, m.match AS match, m.start AS start,
    m.start + length(m.match) AS "end"
  FROM (
    SELECT doc_id, unnest(list_transform(matches, lambda x, i: {{'match': x, 'start':
      coalesce(list_sum(list_transform(pieces[1:i], lambda p: length(p))), 0)
      + coalesce(list_sum(list_transform(matches[1:i - 1], lambda p: length(p))), 0)}})) AS m
    FROM (SELECT doc_id, regexp_extract_all(text, {quoted(pattern)}) AS matches,
      string_split_regex(text, {quoted(pattern)}) AS pieces FROM texts)
  ) WHERE {keep if kind == "assign" else "true"}"""

    def entropy(c: CharClass, rank: int) -> str:
        table = "[" + ", ".join(map(str, c.table)) + "]"
        sums = (
            f"list_transform(range(0, length(match) - {c.window - 1}), lambda i: list_sum(list_transform("
            f"list_distinct(string_split(substring(match, CAST(i + 1 AS BIGINT), {c.window}), '')), "
            f"lambda ch: {table}[1 + {c.window} - length(replace(substring(match, "
            f"CAST(i + 1 AS BIGINT), {c.window}), ch, ''))])))"
        )
        listed = quoted(ALLOWED_STRETCH)
        parts = f"""SELECT doc_id, p.match AS match, start + p.ahead AS start FROM (
      SELECT doc_id, start, unnest(list_transform(pieces, lambda x, i: {{'match': x, 'ahead':
        coalesce(list_sum(list_transform(pieces[1:i - 1], lambda p: length(p))), 0)
        + coalesce(list_sum(list_transform(stretches[1:i - 1], lambda p: length(p))), 0)}})) AS p
      FROM (SELECT doc_id, start, string_split_regex(match, {listed}) AS pieces,
        regexp_extract_all(match, {listed}) AS stretches FROM ({found(c.kind, rank, c.pattern)})))
    WHERE length(p.match) >= {c.window} AND NOT regexp_matches(p.match, '{BARE_NUMBER}')"""
        return f"""
  SELECT doc_id, {rank} AS rank, '{c.kind}' AS kind, match, start + high[1] AS start,
    start + high[-1] + {c.window} AS "end"
  FROM (SELECT doc_id, match, start, list_filter(range(0, len(sums)), lambda i: sums[i + 1] <= {c.most})
      AS high
    FROM (SELECT doc_id, match, start, {sums} AS sums FROM ({parts})))
  WHERE len(high) > 0"""

    parts = [found(k, i, p) for i, (k, p) in enumerate(zip(KINDS, (ASSIGN, ACCESS, HEX), strict=True))]
    parts += [entropy(c, len(KINDS) + i) for i, c in enumerate(CLASSES)]
    union = "\n  UNION ALL".join(parts)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS)
    listed = "kind || ':' || start || ':' || \"end\", ',' ORDER BY start, rank"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM {docs}),
spans AS ({union}
), per_doc AS (
  SELECT doc_id, {counts}, string_agg({listed}) FILTER (WHERE rank < {len(KINDS)}) AS base,
    string_agg({listed}) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts d LEFT JOIN per_doc USING (doc_id)"""
