"""How far the sources of a language differ in their words, in exact whole numbers.

Terms are maximal runs of ASCII letters and non-ASCII characters, only A-Z lower-cased. A language keeps the
terms that occur in at least `LEAST_DOCS` of its documents. With count the occurrences of a kept term in a
group (or in the language), N their sum over the kept terms and V the number of kept terms, the group's share
is p = 1 + floor(SCALE * (count + 1) / (N + V)), and f(p, q) = floor((p - q)^2 / q).

Counting packs terms by length. Those of up to 8 bytes are one unsigned 64-bit word, those of up to 16 two,
first byte highest and zeros behind; they are radix-sorted 16 bits at a time, last digit first, and runs of
equal words are counted. Longer ones go to buckets of doubling width and are sorted there as byte strings. A
step's counts are then added up by Spark per (lang, source, term).

The sum of f over all kept terms for a pair of sources never lists the terms that neither or only one of them
has: those with an occurrence in g alone depend on g's count only, so the histogram of g's shares stands for
them, and a term that both have takes its two lone shares back. Only terms that two sources share meet.

Cases: null text, lang and source count as ''. A group without kept terms has count 0 for each, and a language
without any gives pair value 0 and no terms. A null or repeated doc_id is of no account: each row is a
document. Ties rank by the UTF-8 bytes of the item. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from octroi.llm.common import LOWER, ranges, release, small_batches, steps, word_spans
from octroi.session import written

LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
STEP = 2 << 20
_TERM = np.zeros(256, bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True


def pack_words(data: np.ndarray, start: np.ndarray, size: np.ndarray, words: int) -> list[np.ndarray]:
    """`words` unsigned 64-bit words of each span, the first byte highest; zeros after the span's end."""
    out = []
    for w in range(words):
        word = np.zeros(len(start), np.uint64)
        for k in range(8 * w, 8 * w + 8):
            byte = data[np.minimum(start + k, len(data) - 1)]
            word = (word << np.uint64(8)) | np.where(k < size, byte, np.uint8(0))
        out.append(word)
    return out


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order by `keys`, the first one counting most, that leaves equals as they were: 16-bit digits, last first."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 64, 16):
            digit = ((key >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def count_terms(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Group, start, end, occurrences and rows of each distinct (group, term); rows are those of `at`, group their group."""
    low = LOWER[data]
    start, end, row = word_spans(_TERM[low], at)
    size = end - start
    of = group[row].astype(np.uint64)
    found: list[tuple[np.ndarray, ...]] = []

    def runs(pick: np.ndarray, order: np.ndarray, new: np.ndarray) -> None:
        """pick: the terms of this bucket; order: sorted, equal terms in order of rows; new: where a run begins."""
        first = np.flatnonzero(new)
        i = pick[order]
        new_row = new.copy()
        new_row[1:] |= row[i[1:]] != row[i[:-1]]
        lead = i[first]
        found.append((group[row[lead]], start[lead], end[lead], np.diff(np.append(first, len(i))), np.add.reduceat(new_row, first, dtype=np.int64)))

    for words, least, most in ((1, 1, 8), (2, 9, 16)):
        pick = np.flatnonzero((size >= least) & (size <= most))
        if len(pick):
            keys = [of[pick], *pack_words(low, start[pick], size[pick], words)]
            order = radix_order(keys)
            new = np.ones(len(pick), bool)
            new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
            runs(pick, order, new)
    width = 32
    left = np.flatnonzero(size > 16)
    while len(left):
        pick, left = left[size[left] <= width], left[size[left] > width]
        if len(pick):
            padded = np.zeros((len(pick), width), np.uint8)
            padded[np.repeat(np.arange(len(pick)), size[pick]), ranges(size[pick])] = low[np.repeat(start[pick], size[pick]) + ranges(size[pick])]
            term = padded.view(f"S{width}").ravel()
            order = np.argsort(term, kind="stable")
            order = order[radix_order([of[pick][order]])]
            new = np.ones(len(pick), bool)
            new[1:] = (term[order][1:] != term[order][:-1]) | (of[pick][order][1:] != of[pick][order][:-1])
            runs(pick, order, new)
        width *= 2
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: occurrences of each term in each group and documents that hold it."""
    small_batches(docs.sparkSession)
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches, size=STEP):
            lang, source = (rows.column(c).dictionary_encode() for c in (0, 1))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            of, start, end, n, held = count_terms(data, at, group)
            size = end - start
            flat = LOWER[data[np.repeat(start, size) + ranges(size)]]
            term = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(flat))
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))), term, pa.array(n), pa.array(held)], names=["lang", "source", "term", "count", "docs"])

    counted = docs.select(words("lang"), words("source"), words("text")).mapInArrow(count, "lang string, source string, term string, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)) in decimals, as the product passes 64 bits in a large corpus."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.when(total + terms > 0, F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), wide(total + terms)))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def pair_values(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item, value for each ordered pair of the sources of a language.

    groups: lang, source, zero (share of a term that the group lacks), terms (kept terms of the language).
    shares: lang, source, term, p of the kept terms that the group has.
    """
    side = lambda df, s: df.select("lang", *(F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "lang"))
    pairs = side(groups.select("lang", "source", "zero", "terms"), "g").join(side(groups.select("lang", "source", "zero"), "h"), "lang").where("source_g <> source_h")
    histogram = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    lone_g = pairs.join(side(histogram, "g"), ["lang", "source_g"]).groupBy("lang", "source_g", "source_h")
    lone_h = pairs.join(side(histogram, "h"), ["lang", "source_h"]).groupBy("lang", "source_g", "source_h")
    only_g = lone_g.agg(F.sum(F.col("n_g") * gap(F.col("p_g"), F.col("zero_h"))).alias("f"), (-F.sum("n_g")).alias("left"))
    only_h = lone_h.agg(F.sum(F.col("n_h") * gap(F.col("zero_g"), F.col("p_h"))).alias("f"), (-F.sum("n_h")).alias("left"))
    held = shares.join(groups.select("lang", "source", "zero"), ["lang", "source"])
    both = side(held, "g").withColumnRenamed("term_g", "term").join(side(held, "h").withColumnRenamed("term_h", "term"), ["lang", "term"]).where("source_g <> source_h")
    taken = gap(F.col("p_g"), F.col("p_h")) - gap(F.col("p_g"), F.col("zero_h")) - gap(F.col("zero_g"), F.col("p_h"))
    shared = both.groupBy("lang", "source_g", "source_h").agg(F.sum(taken).alias("f"), F.count("*").alias("left"))
    parts = only_g.union(only_h).union(shared).groupBy("lang", "source_g", "source_h").agg(F.sum("f").alias("f"), F.sum("left").alias("left"))
    whole = pairs.join(parts, ["lang", "source_g", "source_h"], "left")
    neither = (F.col("terms_g") + F.coalesce("left", F.lit(0))) * gap(F.col("zero_g"), F.col("zero_h"))
    value = F.when(F.col("terms_g") > 0, F.coalesce("f", F.lit(0)) + neither).otherwise(F.lit(0).cast("long"))
    return whole.select("lang", F.col("source_g").alias("source"), F.col("source_h").alias("item"), value.alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources, and each source's `top` terms beyond its language's share."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counts = written(term_counts(docs), "term-counts")
    release(docs.sparkSession)
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all_count")).where(F.col("docs") >= least_docs).drop("docs")
    held = written(counts.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    release(docs.sparkSession)
    # each (lang, term) has one all_count, whichever source is the first to hold it
    of_lang = held.groupBy("lang", "term").agg(F.first("all_count").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("all_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = docs.select(words("lang"), words("source")).distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "all_total")))
    groups = written(groups.withColumn("zero", share(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    rated = held.join(groups.select("lang", "source", "total", "terms", "all_total"), ["lang", "source"])
    rated = rated.select("lang", "source", "term", share(F.col("count"), F.col("total"), F.col("terms")).alias("p"), share(F.col("all_count"), F.col("all_total"), F.col("terms")).alias("q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = rated.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    pairs = pair_values(groups, rated.select("lang", "source", "term", "p")).withColumn("rank", F.row_number().over(best))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").union(columns(terms, "term"))


def checking_sql(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    return f"""
    WITH d AS (
        SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts
        FROM documents
    ),
    o AS MATERIALIZED (SELECT row, lang, source, unnest(ts) AS term FROM d),
    k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= {least_docs}),
    v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
    c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
    g AS MATERIALIZED (
        SELECT s.lang, s.source, coalesce((SELECT sum(c.n) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0) AS n
        FROM (SELECT DISTINCT lang, source FROM d) s
    ),
    -- every group has every kept term of its language
    p AS MATERIALIZED (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
            (1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + v.v)::HUGEINT)::BIGINT AS p,
            (1 + {SCALE}::HUGEINT * (k.n + 1) // (v.n + v.v)::HUGEINT)::BIGINT AS q
        FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ),
    f AS (
        SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
        FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
    ),
    r AS (
        SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value
        FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
        UNION ALL
        SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, value, rank::INTEGER AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
    WHERE part = 'pair' OR rank <= {top}
    """
