"""Spelling variants: words one edit apart, each led to its far more frequent neighbour.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; where the unsigned crc32 of
"<doc_id>:<run>" is divisible by `SPOILT`, the run's code point crc32 % length is taken out first. Of the
results, those of at least `LEAST_LENGTH` code points and `LEAST_COUNT` occurrences are compared.

Two words of which the shorter has l code points are one insertion, deletion or replacement apart exactly if
their common prefix and common suffix together reach the longer one's length less one. An edit at place i
leaves the i code points before it and those after it alone. The places 0 … l are cut into `WINDOWS` windows,
and for each window a word's key is what stands before and after it; so a pair has the key of the window that
holds its edit in common, and is looked at in that window alone (the place is the common prefix's length, which
is one of the possible places). A word has the keys for itself as the shorter word, and as the longer one.

The words of a key are laid out as matrices of code points, from the left and from the right, padded with
zeros, and compared block against block. A key with more than `TILE` words is split into blocks by a hash, and
each pair of blocks is a tile of its own that Spark deals to any task; smaller keys are one tile, of which a
task compares many at once.

Cases: null or empty text has no words. A null doc_id counts as an empty one. Words that equal each other after
a deletion are one word. A word without near words has n_near 0 and is its own root. Chains end, as each step's
n is at least `FACTOR` times the last. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.llm.common import give_back, ranges, release, small_batches
from octroi.session import written

SPOILT, LEAST_LENGTH, LEAST_COUNT, FACTOR = 31, 7, 2, 10
WINDOWS, TILE = 4, 512
#: Pairs that are compared in one step of numpy.
PAIRS = 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "([A-Za-zÀ-ÿ]+)"


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of the words to compare, spoilt as the module says."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(1))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    word = F.when(F.col("h") % SPOILT == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def window_bounds(size):
    """Where the windows over the places 0 … size begin, and the end; size: a Column or an array."""
    if isinstance(size, np.ndarray):
        return [((size + 1) * w + WINDOWS - 1) // WINDOWS for w in range(WINDOWS + 1)]
    return [F.ceil((size + 1) * w / WINDOWS).cast("int") for w in range(WINDOWS + 1)]


def keyed_words(words: DataFrame) -> DataFrame:
    """size, window, key, word: each word under its keys; size is the shorter word's length in that key's pairs."""
    keys = []
    for less in (0, 1):
        size = F.length("word") - less
        bounds = window_bounds(size)
        for w in range(WINDOWS):
            tail = F.greatest(size - bounds[w + 1], F.lit(0))
            before = F.substring("word", F.lit(1), bounds[w])
            after = F.when(tail > 0, F.substring("word", F.length("word") - tail + 1, tail)).otherwise("")
            keys.append(F.struct(size.alias("size"), F.lit(w).alias("window"), F.concat(before, F.lit("*"), after).alias("key")))
    return words.select("word", F.explode(F.array(*keys)).alias("at")).select("at.*", "word")


def tiles(keyed: DataFrame, tile: int = TILE) -> DataFrame:
    """size, window, key, i, j, word, left, right: the words of each tile; left and right say of which of its two blocks.

    Keys of one word are left out: there is nothing to compare it with.
    """
    of = ["size", "window", "key"]
    sizes = keyed.groupBy(*of).agg(F.count("*").alias("held")).where("held > 1").withColumn("blocks", F.ceil(F.col("held") / tile).cast("int"))
    dealt = keyed.join(sizes, of).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = dealt.select(*of, "word", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    return other.select(*of, i.alias("i"), j.alias("j"), "word", (F.col("block") == i).alias("left"), (F.col("block") == j).alias("right"))


def matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, code points from the left and code points from the right, padded with zeros."""
    size = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row, k = np.repeat(np.arange(len(words)), size), ranges(size)
    ahead, behind = np.zeros((len(words), width), np.uint32), np.zeros((len(words), width), np.uint32)
    ahead[row, k] = points
    behind[row, size[row] - 1 - k] = points
    return size, ahead, behind


def common(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many leading columns each pair of rows shares, `most` at most."""
    differ = x != y
    return np.minimum(np.where(differ.any(1), differ.argmax(1), x.shape[1]), most)


def near_in_tiles(size: int, window: np.ndarray, tile: np.ndarray, left: np.ndarray, right: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near words. tile: ascending number of each row's tile; all rows have one `size`."""
    length, ahead, behind = matrices(words, size + 1)
    bounds = np.stack(window_bounds(np.array([size])))[:, 0]
    stop = np.searchsorted(tile, tile, "right")
    begin = np.searchsorted(tile, tile, "left")
    # a row of the left block meets the rows of the right block; within one block the rows after it
    same = left & right
    first, count = np.where(same, np.arange(len(tile)) + 1, begin), np.where(left, stop - np.where(same, np.arange(len(tile)) + 1, begin), 0)
    found = []
    cuts = np.concatenate([[0], np.cumsum(count)])
    a = 0
    while a < len(tile):
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + PAIRS, "right")) - 1)
        n = count[a:b]
        x = np.repeat(np.arange(a, b), n)
        y = np.repeat(first[a:b], n) + ranges(n)
        fit = right[y] & (np.minimum(length[x], length[y]) == size)
        x, y = x[fit], y[fit]
        shorter, longer = np.minimum(length[x], length[y]), np.maximum(length[x], length[y])
        before = common(ahead[x], ahead[y], shorter)
        at_home = (before >= bounds[window[x]]) & (before < bounds[window[x] + 1])
        x, y, before, shorter, longer = (v[at_home] for v in (x, y, before, shorter, longer))
        after = common(behind[x], behind[y], shorter)
        near = before + after >= longer - 1
        found.append((x[near], y[near]))
        a = b
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_pairs(tiled: DataFrame) -> DataFrame:
    """word, other: the near words of each word, both ways; a pair comes from one tile only."""

    def judge(held: pa.Table) -> Iterator[pa.RecordBatch]:
        held = held.combine_chunks()
        size, window, i, j, left, right = (held.column(c).to_numpy() for c in ("size", "window", "i", "j", "left", "right"))
        key = held.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        words = held.column("word")
        new = np.ones(len(size), bool)
        new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in (size, window, key, i, j)])
        tile = np.cumsum(new)
        cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(size)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            x, y = near_in_tiles(int(size[a]), window[a:b], tile[a:b], left[a:b], right[a:b], words.slice(a, b - a).to_pylist())
            p, q = (words.take(pa.array(v + a)).combine_chunks() for v in (x, y))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([p, q]), pa.concat_arrays([q, p])], names=["word", "other"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles are whole in a task, sorted; the last one of a batch may go on in the next."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [batch.column(c) for c in ("size", "window", "i", "j")]
            end = lambda k, batch=batch, parts=parts: (*(p[k].as_py() for p in parts), batch.column("key")[k].as_py())
            if held and end(0) != last:
                yield from judge(pa.Table.from_batches(held))
                held = []
            last = end(batch.num_rows - 1)
            lo, hi = 0, batch.num_rows - 1  # the last tile's first row: rows are sorted, so halve
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if end(mid) == last else (mid + 1, hi)
            if lo:
                yield from judge(pa.Table.from_batches([*held, batch.slice(0, lo)]))
                held = []
            held.append(batch.slice(lo))
            give_back()
        if held:
            yield from judge(pa.Table.from_batches(held))

    small_batches(tiled.sparkSession, 20_000)
    of = ["size", "window", "key", "i", "j"]
    return tiled.select(*of, "left", "right", "word").repartition(*of).sortWithinPartitions(*of).mapInArrow(walk, "word string, other string")


def roots(formed: DataFrame) -> DataFrame:
    """word, root for the words that have a form, by doubling: each round follows twice as many steps."""
    now = written(formed.select("word", F.col("form").alias("to")), "roots")
    while True:
        further = now.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        joined = written(now.join(further, "to", "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "roots")
        now = joined.select("word", "to")
        if joined.where("moved").isEmpty():
            return now.withColumnRenamed("to", "root")


def spelling_variants(docs: DataFrame, factor: int = FACTOR, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of `docs` (doc_id, text)."""
    words = written(word_counts(docs), "words")
    release(docs.sparkSession)
    pairs = near_pairs(tiles(keyed_words(words.select("word")), tile)).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    near = written(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best")).alias("best")), "near-words")
    release(docs.sparkSession)
    flat = near.select("word", F.col("best.other").alias("form"), "n", "n_near", (-F.col("best.less")).alias("form_n"))
    led = roots(flat.where("form is not null"))
    return flat.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def checking_sql(factor: int = FACTOR) -> str:
    """The same rows for DuckDB: crc32 by its table, edits by Levenshtein distance over one byte a letter."""
    accented = "".join(chr(c) for c in range(0xC0, 0x100))
    bytes_ = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).islower() and chr(c) not in "'")[: len(accented)]
    return f"""
    WITH RECURSIVE t0 AS (SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
        UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM t0 WHERE k < 8),
    t AS (SELECT list(c ORDER BY b) AS tab FROM t0 WHERE k = 8),
    o AS (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, count(*) AS n, run
        FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
    ),
    h AS MATERIALIZED (
        SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(doc || ':' || run)), lambda i: ('0x' || substr(hex(encode(doc || ':' || run)), 2 * i + 1, 2))::BIGINT)),
            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
        FROM o, t
    ),
    w AS MATERIALIZED (
        SELECT word, sum(n)::BIGINT AS n, translate(word, '{accented}', '{bytes_}') AS s
        FROM (SELECT n, CASE WHEN h % {SPOILT} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h)
        WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
    ),
    p AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS other_n FROM w a JOIN w b ON abs(strlen(a.s) - strlen(b.s)) <= 1 AND a.word <> b.word AND levenshtein(a.s, b.s) = 1),
    b AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -other_n, o := other)) AS x FROM p GROUP BY word),
    f AS MATERIALIZED (
        SELECT w.word, CASE WHEN -x.m >= {factor} * n THEN x.o END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -x.m >= {factor} * n THEN -x.m END AS form_n
        FROM w LEFT JOIN b ON b.word = w.word
    ),
    r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word) JOIN f e ON e.word = r.at WHERE e.form IS NULL
    """
