"""Phrase collocations by marginalising the longest windows.

From every word a window leads over the words behind it in its piece, padded at the end: columns
``w1..w5``. Only these longest windows are counted; a SQL ``ROLLUP`` over the columns then sums them up to the
counts of all shorter phrases, each of which is the prefix of exactly the windows that start with it,
and to the number of words.

A phrase that is frequent has frequent words, pairs and triples alone. One pass counts the hashes of words
and pairs, a second those of triples of frequent pairs; the frequent ones become a bitmap of fixed size,
and a window ends before the first word, pair or triple that is not in it. No occurrence of a frequent phrase is lost by
that, and windows that differ in rare words only are counted together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinion_spark.llm import words as wd
from opinion_spark.llm.tables import documents
from opinion_spark.staging import stage, staged_lookup

#: Words of a piece: all but blanks and tabs; pieces end at these characters.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(b"\x20\x09" + BREAKS)] = False
IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[list(BREAKS)] = True

MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
UNKNOWN = "und"
#: Bits of the bitmap of frequent words and pairs: 8 MB, whatever the size of the input.
BITS = 1 << 26
#: Bits in one row of the bitmap, as ``bitmap_construct_agg`` makes them.
ROW_BITS = 1 << 15
#: Bytes of text that a task works on at a time.
CHUNK = 1 << 20


@dataclass
class Tokens:
    """The words of some text: which document, whether the next word is in the same piece, a hash.

    Windows start at the first ``own`` words; the others only continue them.
    """

    words: pa.Array
    hashes: np.ndarray
    doc: np.ndarray
    joined: np.ndarray
    own: int


def _tokens(data: np.ndarray, own_bytes: int, doc_starts: np.ndarray) -> Tokens:
    starts, ends = wd.spans(data, IS_WORD)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = data[IS_WORD[data]]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    breaks = np.flatnonzero(IS_BREAK[data])
    ahead = np.searchsorted(breaks, starts)
    joined = np.zeros(len(starts), bool)
    joined[:-1] = ahead[1:] == ahead[:-1]
    doc = np.searchsorted(doc_starts, starts, side="right") - 1
    return Tokens(words, wd.hashes(data, starts, ends), doc, joined, int(np.searchsorted(starts, own_bytes)))


def _behind(data: np.ndarray, start: int, words: int) -> int:
    """Where the next ``words`` words behind ``start`` end."""
    look = 256
    while start + look < len(data):
        _, ends = wd.spans(data[start : start + look], IS_WORD)
        ends = ends[ends < look]
        if len(ends) >= words:
            return start + int(ends[words - 1])
        look *= 2
    return len(data)


def _chunks(docs: Iterable[bytes], ahead: int, size: int) -> Iterator[tuple[Tokens, int]]:
    """The words of all documents in chunks, each with the number of its first document."""
    held: list[bytes] = []
    first = 0

    def flush() -> Iterator[tuple[Tokens, int]]:
        # a line end between documents is a break
        data = wd.lower(b"\n".join(held))
        doc_starts = np.cumsum([0] + [len(d) + 1 for d in held[:-1]])
        for a, b in wd.pieces(data, IS_WORD, size):
            c = _behind(data, b, ahead)
            yield _tokens(data[a:c], b - a, doc_starts - a), first

    for number, doc in enumerate(docs):
        held.append(doc)
        if sum(map(len, held)) + len(held) >= size or len(held) >= size >> 8:
            yield from flush()
            held, first = [], number + 1
    if held:
        yield from flush()


def _lang_hashes(langs: list[str]) -> np.ndarray:
    known = {x: int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def _prefixes(tokens: Tokens, langs: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each word the hash of its language and the next 1, 2, .. words, joined or not."""
    key = wd.mix(tokens.hashes ^ langs[tokens.doc])
    yield key
    for j in range(1, words):
        behind = np.zeros_like(tokens.hashes)
        behind[:-j] = tokens.hashes[j:]
        key = wd.mix(key * np.uint64(5) + behind)
        yield key


def _each_chunk(batch: pa.RecordBatch, ahead: int, size: int) -> Iterator[tuple[Tokens, np.ndarray, pa.Array, int]]:
    langs = batch.column("lang")
    numbers = _lang_hashes(langs.to_pylist())
    for tokens, first in _chunks(wd.texts(batch.column("text")), ahead, size):
        if tokens.own:
            yield tokens, numbers[first:], langs, first


def _is_frequent(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(BITS - 1)
    byte = bitmap[(place >> np.uint64(3)).astype(np.int64)]
    return (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _ahead(flags: np.ndarray, by: int) -> np.ndarray:
    """What is ``by`` places further on."""
    moved = np.zeros_like(flags)
    moved[: max(len(flags) - by, 0)] = flags[by:]
    return moved


def _lengths(tokens: Tokens, prefixes: list[np.ndarray], bitmap: np.ndarray, triples: bool) -> np.ndarray:
    """How many words the window of each word has: all of its words, pairs and, if they are known,
    triples are frequent."""
    word = _is_frequent(bitmap, prefixes[0])
    pair = tokens.joined & _is_frequent(bitmap, prefixes[1]) & _ahead(word, 1)
    going, length = word, word.astype(np.int64)
    for j in range(1, len(prefixes)):
        going = going & _ahead(pair, j - 1)
        if triples and j > 1:
            going &= _ahead(_is_frequent(bitmap, prefixes[2]), j - 2)
        length += going
    return length


def _supports(size: int, pairs=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(hash, n)``: how often each word and each pair occurs, by chunk; where the frequent ``pairs`` are
    known, each triple that is made of such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, langs, _, _ in _each_chunk(batch, 1 if pairs is None else 2, size):
                own = slice(0, tokens.own)
                if pairs is None:
                    one, two = _prefixes(tokens, langs, 2)
                    keys = np.concatenate([one[own], two[own][tokens.joined[own]]])
                else:
                    prefixes = list(_prefixes(tokens, langs, 3))
                    keys = prefixes[2][own][_lengths(tokens, prefixes, pairs.value, False)[own] == 3]
                found, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["hash", "n"])

    return run


def _windows(frequent, words: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(lang, w1.., n)``: the longest windows of frequent words, pairs and triples, by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", *columns(words), "n"]
        for batch in batches:
            for tokens, numbers, langs, first in _each_chunk(batch, words - 1, size):
                prefixes = list(_prefixes(tokens, numbers, words))
                length = _lengths(tokens, prefixes, frequent.value, True)[: tokens.own]
                # windows of no frequent word differ by language alone
                keys = numbers[tokens.doc[: tokens.own]].copy()
                for j, prefix in enumerate(prefixes):
                    keys = np.where(length > j, prefix[: tokens.own], keys)
                _, at, n = np.unique(keys, return_index=True, return_counts=True)
                found = [langs.take(pa.array(tokens.doc[at] + first))]
                for j in range(words):
                    short = length[at] <= j
                    found.append(tokens.words.take(pa.array(np.where(short, 0, at + j), mask=short)))
                yield pa.RecordBatch.from_arrays([*found, pa.array(n)], names)

    return run


def columns(words: int) -> list[str]:
    return [f"w{j}" for j in range(1, words + 1)]


def _bitmap(supports: DataFrame, min_count: int) -> np.ndarray:
    """One bit for each hash that is counted ``min_count`` times; others may share it.

    At most ``BITS`` bits reach the driver, as rows of ``ROW_BITS``.
    """
    place = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    rows = (
        supports.groupBy("hash")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= min_count)
        .select(F.floor(place / ROW_BITS).alias("row"), (place % ROW_BITS).alias("bit"))
        .groupBy("row")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    bitmap = np.zeros((BITS // ROW_BITS, ROW_BITS // 8), np.uint8)
    for found in rows.toLocalIterator():
        bitmap[found["row"]] = np.frombuffer(found["bits"], np.uint8)
    return bitmap.reshape(-1)


def frequent_bitmap(texts: DataFrame, min_count: int, size: int = CHUNK) -> np.ndarray:
    """The bits of all frequent words, pairs, and triples of frequent pairs."""
    counts, context = "hash bigint, n bigint", texts.sparkSession.sparkContext
    pairs = _bitmap(texts.mapInArrow(_supports(size), counts), min_count)
    known = context.broadcast(pairs)
    triples = _bitmap(texts.mapInArrow(_supports(size, known), counts), min_count)
    known.unpersist()
    return pairs | triples


def phrase_counts(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    size: int = CHUNK,
) -> DataFrame:
    """``(lang, words, phrase, m, a)`` of all phrases of up to ``max_words`` words that occur at least
    ``min_count`` times, and one row with ``m`` 0 per language, whose ``a`` counts all words."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_bitmap(texts, min_count, size))
    names = columns(max_words)
    schema = "lang string, " + ", ".join(f"{w} string" for w in names) + ", n bigint"
    windows = texts.mapInArrow(_windows(frequent, max_words, size), schema)
    windows = stage(windows.groupBy("lang", *names).agg(F.sum("n").alias("n")), "windows")
    sums = windows.rollup("lang", *names).agg(F.sum("n").alias("a"), F.grouping_id().alias("rolled"))
    # the columns behind the prefix are rolled up, so as many low bits are set
    m = F.lit(max_words) - F.bit_count("rolled")
    prefix = F.slice(F.array(*names), 1, F.greatest("m", F.lit(1)))
    words = F.when(F.col("m") > 0, prefix).otherwise(F.array().cast("array<string>"))
    sums = sums.withColumn("m", m).where("m >= 0").withColumn("words", words)
    # a padded prefix is a shorter phrase, which has its own row
    whole = F.get("words", F.col("m") - 1).isNotNull() & (F.col("a") >= min_count)
    return sums.where((F.col("m") == 0) | whole).select("lang", "words", F.array_join("words", " ").alias("phrase"), "m", "a")


def _exact_floor(x, y):
    """``floor(x / y)`` of decimals without rounding."""
    return ((x - x % y) / y).cast("bigint")


def _scored(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, words, m, a, score, l, r, n)``: every phrase of two words or more at its lowest cut."""
    counts = phrases.where("m > 0").select("lang", "phrase", "a")
    totals = phrases.where("m = 0").select("lang", F.col("a").alias("n"))
    totals = staged_lookup(totals)
    cuts = phrases.where("m > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    left = F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")
    right = F.array_join(F.slice("words", F.col("k") + 1, F.col("m") - F.col("k")), " ")
    cuts = cuts.withColumn("left", left).withColumn("right", right)
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    big = {c: F.col(c).cast("decimal(20,0)") for c in ("a", "n", "l", "r")}
    score = _exact_floor(big["a"] * big["n"] * F.lit(1000).cast("decimal(4,0)"), big["l"] * big["r"])
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    scored = cuts.join(totals, "lang").groupBy("lang", "phrase", "m", "a", "n").agg(best.alias("best"))
    return scored.select("lang", "phrase", "m", "a", "n", "best.score", "best.l", "best.r")


def _covered(phrases: DataFrame, percent: int) -> DataFrame:
    """``(lang, phrase)`` of the phrases that stand in a longer one that is nearly as frequent."""
    starts = F.explode(F.sequence(F.lit(1), F.col("m") - F.col("s") + 1))
    parts = (
        phrases.where("m > 2")
        .withColumn("s", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
        .withColumn("start", starts)
        .select("lang", F.array_join(F.slice("words", F.col("start"), F.col("s")), " ").alias("phrase"), F.col("a").alias("longer"))
    )
    largest = parts.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    met = phrases.join(staged_lookup(largest), ["lang", "phrase"])
    return met.where(F.col("longer") * 100 >= F.col("a") * percent).select("lang", "phrase")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    percent: int = 100,
    size: int = CHUNK,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language.

    A phrase has two words or more, none behind a break. ``score`` is 1000 * a * n / (l * r), rounded
    down, at the cut where that is lowest, the first of them on a tie. Phrases inside a longer one that
    occurs at least ``percent`` % as often are left out. Equal scores go by ``a``, then by the bytes of the
    phrase. Null texts have no words, a null language is ``und``, repeated rows count each time, other
    columns are ignored. An empty table gives no rows.
    """
    phrases = stage(phrase_counts(docs, text, lang, max_words, min_count, size), "phrases")
    scored = _scored(phrases).join(_covered(phrases, percent), ["lang", "phrase"], "left_anti")
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def collocations_sql(docs: str, min_count: int = MIN_COUNT, top: int = TOP) -> str:
    """The query over a table with ``text`` and ``lang``, in SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM {docs} WHERE text IS NOT NULL
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), sized AS (
  SELECT lang, w, unnest(range(1, 6)) AS m FROM listed WHERE len(w) > 0
), started AS (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM sized WHERE len(w) >= m
), counted AS (
  SELECT lang, m, w[s:s + m - 1] AS words, count(*) AS a FROM started GROUP BY lang, m, words
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counted WHERE m = 1 GROUP BY lang
), phrases AS (
  SELECT *, array_to_string(words, ' ') AS phrase FROM counted WHERE a >= {min_count}
), cuts AS (
  SELECT p.*, unnest(range(1, m)) AS k FROM phrases p WHERE m > 1
), scored AS (
  SELECT c.lang, c.phrase, c.m, c.a, c.words, x.a AS l, y.a AS r, t.n, c.k,
    CAST((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts c JOIN totals t USING (lang)
  JOIN phrases x ON x.lang = c.lang AND x.words = c.words[1:c.k]
  JOIN phrases y ON y.lang = c.lang AND y.words = c.words[c.k + 1:]
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
  SELECT lang, a, words, m, unnest(range(2, m)) AS s FROM phrases WHERE m > 2
), part AS (
  SELECT lang, a, words, s, unnest(range(1, m - s + 2)) AS f FROM parts
), covered AS (
  SELECT lang, words[f:f + s - 1] AS words, max(a) AS longer FROM part GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN covered c ON b.lang = c.lang AND b.words = c.words
  WHERE c.longer IS NULL OR 100 * c.longer < 100 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score
FROM kept QUALIFY rank <= {top}"""
