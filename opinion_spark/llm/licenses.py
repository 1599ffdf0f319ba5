"""License scans: an exact set-similarity join of texts with templates.

A block is a stretch of consecutive words a little longer than the template. It matches when it has
enough of the template's distinct words (containment). Words are ordered by how often the corpus has
them: a block that matches must have one of the template's rarest words, as many as may be missing
and one more (prefix filter). Only places of such words are looked at; too few of the template's words
around the place rule it out (length filter), and only stretches over the place are compared, those with an
earlier such word at that word's place (positional filter). Every block that matches is returned once. Base templates are phrases: their rarest word fixes where the phrase would start.

Texts stay where they are read; only counts of template words are gathered. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.llm.tables import documents

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's distinct words that a block must have, in percent.
CONTAINMENT = 85


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def distinct(self) -> list[str]:
        return sorted(set(self.words))

    @property
    def span(self) -> int:
        """Words of a block."""
        n = len(self.words)
        return n if self.base else n + math.ceil(n / 4)

    @property
    def need(self) -> int:
        n = len(self.distinct)
        return n if self.base else -(-n * CONTAINMENT // 100)

    def prefix(self, counts: dict[str, int]) -> list[str]:
        rare_first = sorted(self.distinct, key=lambda w: (counts.get(w, 0), w))
        return rare_first[: len(self.distinct) - self.need + 1]


#: Fixed phrases and labels, then statements that licenses are known by.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("creative-commons", "creative commons attribution"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("agpl", "gnu affero general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl", "mozilla public license"),
    Template("public-domain", "dedicated to the public domain"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
)


#: Templates that may travel with a plan.
MOST_TEMPLATES = 200


def templates_of(table: DataFrame, most: int = MOST_TEMPLATES) -> tuple[Template, ...]:
    """Templates from a table ``(label, text)``, as many as a plan can hold; more are refused.

    Texts are split like documents; rows with a null or without words are left out, equal rows are one.
    """
    split = F.array_join(words(F.col("text")), " ").alias("text")
    rows = table.where("label IS NOT NULL").select("label", split).where("text <> ''").distinct()
    listed = rows.orderBy("label", "text").limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {most} templates")
    return tuple(Template(r["label"], r["text"]) for r in listed)


def words(text: Column) -> Column:
    """Words with letters lower-cased.

    Beyond ASCII ``lower`` changes letters too, but none of them into a word of ASCII letters that
    has no k, so base phrases are found exactly where their ASCII letters stand.
    """
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def word_counts(docs: DataFrame, text: str, templates: tuple[Template, ...]) -> dict[str, int]:
    """How often the corpus has each word of the templates; one row per template word."""
    vocabulary = sorted({w for t in templates for w in t.distinct})
    found = docs.select(
        F.explode(F.filter(words(F.col(text)), lambda w: w.isin(vocabulary))).alias("word")
    )
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


HIT = "array<struct<label:string,base:boolean,start:int,containment:double>>"


def _phrase_hits(ws: Column, at: Column, word: str, t: Template) -> Column:
    """The hit of a phrase whose first ``word`` is at place ``at``."""
    start = at - t.words.index(word)
    same = F.slice(ws, F.greatest(start, F.lit(0)) + 1, len(t.words)) == _texts(t.words)
    return F.when((start >= 0) & same, F.array(_hit(t, start, F.lit(1.0)))).otherwise(F.array().cast(HIT))


def _hit(t: Template, start: Column, containment: Column) -> Column:
    return F.struct(
        F.lit(t.label).alias("label"),
        F.lit(t.base).alias("base"),
        start.cast("int").alias("start"),
        containment.alias("containment"),
    )


def _block_hits(ws: Column, at: Column, t: Template, prefix: list[str]) -> Column:
    """Every block that is good enough and has its first word of the prefix at place ``at``."""
    low = F.greatest(at - t.span + 1, F.lit(0))
    around = F.slice(ws, low + 1, at - low + t.span)
    enough = F.size(F.array_intersect(around, _texts(t.distinct))) >= t.need
    blocks = F.transform(
        F.sequence(low, at),
        lambda s: F.struct(
            s.alias("start"), F.size(F.array_intersect(F.slice(ws, s + 1, t.span), _texts(t.distinct))).alias("n")
        ),
    )
    # a block is found at one place, however many of its words are in the prefix
    good = F.filter(
        blocks,
        lambda x: (x["n"] >= t.need)
        & (F.size(F.array_intersect(F.slice(ws, x["start"] + 1, at - x["start"]), _texts(prefix))) == 0),
    )
    hits = F.transform(good, lambda x: _hit(t, x["start"], x["n"] / F.lit(float(len(t.distinct)))))
    return F.when(enough, hits).otherwise(F.array().cast(HIT))


def with_hits(
    docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """``docs`` with ``_words`` and ``_hits`` ``(label, base, start, containment)``: every place of a phrase
    and every block of a template, each once.

    Null and empty texts have no words and no hits; rows are judged one by one. The templates are a
    list of bounded size that travels with the plan.
    """
    counts = word_counts(docs, text, templates)
    by_word: dict[str, list[Template]] = {}
    prefixes = {t: t.prefix(counts) for t in templates}
    for t in templates:
        for w in prefixes[t]:
            by_word.setdefault(w, []).append(t)
    listed = sorted(by_word)
    read = docs.withColumn("_words", words(F.col(text)))
    ws = F.col("_words")
    places = F.filter(
        F.transform(
            ws,
            lambda w, i: F.when(w.isin(listed), F.struct(i.alias("at"), w.alias("word"))),
        ),
        lambda p: p.isNotNull(),
    )
    read = read.withColumn("_places", places)

    def at_place(p: Column) -> Column:
        hits = F.array().cast(HIT)
        for w in listed:
            here = [
                _phrase_hits(ws, p["at"], w, t) if t.base else _block_hits(ws, p["at"], t, prefixes[t])
                for t in by_word[w]
            ]
            hits = F.when(p["word"] == w, F.flatten(F.array(*here))).otherwise(hits)
        return hits

    found = F.flatten(F.transform(F.col("_places"), at_place))
    return read.withColumn(
        "_hits", F.when(F.size("_places") > 0, found).otherwise(F.array().cast(HIT))
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_hits(documents(spark, sf_dir).select("doc_id", "text"))
    hits = F.col("_hits")
    base = F.filter(hits, lambda h: h["base"])
    starts = F.transform(base, lambda h: h["start"])

    def listed(array: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(array, lambda h: h["label"]))), ",")

    best = F.array_max(F.transform(hits, lambda h: h["containment"]))
    return found.select(
        "doc_id",
        F.size("_words").cast("bigint").alias("n_words"),
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(hits).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )


def licenses_sql(docs: str) -> str:
    """The query in SQL, without filters: every place of a phrase, every block of a template."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def texts(values: list[str]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    def phrase(t: Template) -> str:
        ahead = " AND ".join(
            f"lead(word, {k}) OVER w = '{word}'"
            for k, word in enumerate(t.words)
        )
        return f"""
  SELECT doc_id, '{t.label}' AS label, true AS base, i AS start, 1.0 AS containment
  FROM (SELECT doc_id, i, {ahead} AS here FROM placed
    WHERE doc_id IN (SELECT doc_id FROM words WHERE len(list_intersect(w, {texts(t.distinct)})) >= {t.need})
    WINDOW w AS (PARTITION BY doc_id ORDER BY i))
  WHERE here"""

    def block(t: Template) -> str:
        word = f"CASE WHEN list_contains({texts(t.distinct)}, word) THEN word END"
        return f"""
  SELECT doc_id, '{t.label}' AS label, false AS base, NULL AS start,
    max(n) / CAST({len(t.distinct)} AS DOUBLE) AS containment
  FROM (SELECT doc_id, count(DISTINCT {word}) OVER (PARTITION BY doc_id ORDER BY i
      ROWS BETWEEN CURRENT ROW AND {t.span - 1} FOLLOWING) AS n FROM placed
    WHERE doc_id IN (SELECT doc_id FROM words WHERE len(list_intersect(w, {texts(t.distinct)})) >= {t.need}))
  WHERE n >= {t.need} GROUP BY doc_id"""

    union = "\n  UNION ALL".join(phrase(t) if t.base else block(t) for t in TEMPLATES)
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
    '{WORD}') AS w FROM {docs}
), placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM words
), hits AS ({union}
), per_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) AS first_word,
    max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word,
  last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM words d LEFT JOIN per_doc USING (doc_id)"""
