"""What each of five filters costs, for every order of applying them, with its Shapley share.

Every document gets a mask of the filters that it fails; a table of counts by part and mask is all that
the audit needs.  For one part, the number of documents that a set of filters removes is a set function.
Its multilinear extension is the *removal polynomial*: over x in [0, 1]^5 it is the expected number of
removed documents if filter i is applied with chance x_i.  At the corners it gives what is removed by
exactly these filters, from which the survivors of every step of every order follow; the integral of its
partial derivative along the diagonal is a filter's Shapley value, exact in rationals, and times 120 it is
the sum over all orders.

Cases: a null text is an empty text; a null source is the part of the empty string; a null doc_id is
smaller than none and fails no comparison with ids; of rows that repeat a doc_id none is smaller; labels of
an unknown doc_id count for none, a document with several label rows is good or toxic if one of them says
so; no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require_columns, small_batches

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
FULL = 1 << len(FILTERS)
#: Text is looked at in pieces of about so many bytes, cut at white space.
PIECE = 1 << 20
_UPPER = bytes(range(65, 91))
_SPACE = re.compile(rb"[ \t-\r]")
_SYMBOL = re.compile(rb"[#$%&*|]")


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces that cut no word."""
    at = 0
    while len(raw) - at > PIECE:
        cut = _SPACE.search(raw, at + PIECE)
        if cut is None:
            break
        yield raw[at : cut.start()]
        at = cut.start()
    yield raw[at:]


def text_mask(text: str) -> int:
    """Bits 0 to 3: the text fails filter A, B, C, D."""
    raw = text.encode()
    n, distinct = 0, set()
    for piece in _pieces(raw):
        words = piece.split()
        n += len(words)
        distinct.update(words)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (n < 200) | (100 * len(distinct) < 50 * n) << 1 | (100 * upper > 2 * len(text)) << 2 | bool(_SYMBOL.search(raw)) << 3


def _masks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([*b.columns[1:], pa.array([text_mask(t) for t in b.column(0).to_pylist()], pa.int32())], ["doc_id", "part", "digest", "mask"])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask -> n, good, toxic: how many documents fail exactly the filters of the mask."""
    require_columns(docs, ["doc_id", "text", "source"])
    require_columns(labels, ["doc_id", "quality", "toxic"])
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(text.alias("text"), F.col("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    masked = slim.mapInArrow(_masks, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, digest binary, mask int")
    # A text's smallest id, found by partial aggregation; only that row of each text meets it again, so no key of the join is hot.
    first = slim.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = masked.join(first, ["digest", "doc_id"], "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = told.select("doc_id", "part", (F.col("mask") + copy).alias("mask")).join(flags, "doc_id", "left")
    return told.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def removal_polynomial(counts: list[int]) -> list[int]:
    """Coefficients by monomial, a bit mask of its variables, from document counts by failure mask.

    A document with mask m is removed with chance 1 - prod over i in m of (1 - x_i), so the monomial T has
    the coefficient (-1)^(|T| + 1) times the number of documents whose mask holds T.
    """
    over = list(counts)
    for i in range(len(FILTERS)):
        for m in range(FULL):
            if not m >> i & 1:
                over[m] += over[m | 1 << i]
    return [0] + [over[t] if t.bit_count() % 2 else -over[t] for t in range(1, FULL)]


def at_corner(polynomial: list[int], applied: int) -> int:
    """Documents removed by exactly these filters: the polynomial where their variables are 1 and all others 0."""
    return sum(c for t, c in enumerate(polynomial) if t & ~applied == 0)


def shapley(polynomial: list[int], i: int) -> Fraction:
    """The partial derivative by x_i, integrated along the diagonal from 0 to 1."""
    return sum((Fraction(c, t.bit_count()) for t, c in enumerate(polynomial) if t >> i & 1), Fraction(0))


def audit_part(masks: list[dict]) -> list[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley from one part's counts."""
    counts = {k: [0] * FULL for k in ("n", "good", "toxic")}
    for m in masks:
        for k, c in counts.items():
            c[m["mask"]] += m[k]
    total = sum(counts["n"])
    polynomials = {k: removal_polynomial(c) for k, c in counts.items()}
    corner = {k: [at_corner(p, s) for s in range(FULL)] for k, p in polynomials.items()}
    shares = [shapley(polynomials["n"], i) * len(ORDERS) for i in range(len(FILTERS))]
    if any(s.denominator != 1 for s in shares):
        raise ArithmeticError("a sum over all orders is a whole number")
    out = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            i = FILTERS.index(letter)
            after = before | 1 << i
            lost = {k: corner[k][after] - corner[k][before] for k in corner}
            out.append((order, step, total - corner["n"][after], lost["n"], corner["n"][1 << i] - lost["n"], counts["n"][1 << i], lost["good"], lost["toxic"], shares[i].numerator))
            before = after
    return out


_COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _audit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, masks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            columns = list(zip(*audit_part(masks), strict=True))
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(_COLUMNS)]
            yield pa.record_batch([pa.array([part] * len(columns[0]), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["part", "filter_order", "step", *_COLUMNS])


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents, labels -> part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    by_part = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 masks at most
    return by_part.mapInArrow(_audit, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COLUMNS))


#: Filters and orders applied one document and one step at a time.
ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
smallest AS (SELECT text, min(doc_id) AS doc_id FROM texts GROUP BY text),
flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fails AS (
  SELECT t.part, row_number() OVER () AS doc, coalesce(f.good, false) AS good, coalesce(f.toxic, false) AS toxic, [
    len(t.words) < 200,
    100 * len(list_distinct(t.words)) < 50 * len(t.words),
    100 * (length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g'))) > 2 * length(t.text),
    regexp_matches(t.text, '[#$%&*|]'),
    coalesce(t.doc_id > s.doc_id, false)] AS failed
  FROM texts t JOIN smallest s ON s.text = t.text LEFT JOIN flags f ON f.doc_id = t.doc_id),
patterns AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS places FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
runs AS (
  SELECT p.part, p.n, p.good, p.toxic, p.failed, o.places,
    list_position(list_transform(o.places, lambda f: p.failed[f]), true) AS removed_at FROM patterns p CROSS JOIN orders o),
steps AS (
  SELECT part, places, s.f AS step,
    sum(CASE WHEN coalesce(removed_at, 9) > s.f THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN removed_at = s.f THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN failed[places[s.f]] AND removed_at < s.f THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed[places[s.f]] AND len(list_filter(failed, lambda x: x)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN removed_at = s.f THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN removed_at = s.f THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM runs CROSS JOIN letters s GROUP BY ALL)
SELECT part, array_to_string(list_transform(places, lambda f: chr(64 + f)), '') AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, places[step])::BIGINT AS shapley
FROM steps
"""
