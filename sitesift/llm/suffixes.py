"""Repeated passages by sparse suffix arrays.

Texts are sequences of words. Of every ``LEAST - GRAM + 1`` neighbouring word
``GRAM``-grams, the one of smallest hash is kept (a minimiser), so that equal
passages keep equal suffixes, and every passage of ``LEAST`` words keeps at
least one. The suffixes whose gram stands in more than one text are sorted by
gram; each is compared with all others of its gram, and their match is extended
right and left, word by word, up to the words needed to prove ``LEAST``, so no
passage is lost. Overlapping matches join into longer passages.

Output: passages of ``LEAST`` words or more that repeat across documents, as
word offsets; and the part of them that is cut when passages are deduplicated:
a match is cut from the document of larger (doc_id, text hash), so that only
the first occurrence stays.

At scale: equal texts are collapsed first (they repeat as wholes). Only grams
that stand in two texts are followed up; the texts are shuffled once to fetch
the contexts (``LEAST - GRAM`` word hashes on each side). A gram that more than
``CROWDED`` suffixes share is not sorted in one task: its suffixes list all
windows of ``LEAST`` words that hold the gram, and window hashes are aggregated
with map-side combine, which gives the same passages.

Defined cases: null text counts as empty; texts of fewer than ``LEAST`` words
have no passage; repeats within one document only are not reported; rows equal
in doc_id and text are one document (reported once); a null doc_id sorts last;
runs of one repeated word (or a short cycle) keep their first and last suffix
and one per window between; texts of any length are split in chunks; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LEAST = 50
GRAM = 20
WINDOW = LEAST - GRAM + 1            # grams of which one is kept
SIDE = LEAST - GRAM                  # words of context on each side
CROWDED = 32
CHUNK = 1 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: bytes) -> np.ndarray:
    """A 32-bit hash, never 0, of every word."""
    out, at = [], 0
    while at < len(text):
        cut = min(at + CHUNK, len(text))
        while cut < len(text) and text[cut] not in b" \t\n\r\x0b\x0c":
            cut += 1
        out.append(np.array([xxhash.xxh32_intdigest(w) for w in text[at:cut].split()], np.uint32))
        at = cut
    return np.maximum(np.concatenate(out), 1) if out else np.zeros(0, np.uint32)


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, gram hash) of the kept suffixes."""
    n = len(words) - GRAM + 1
    if len(words) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = h * PRIME + words[j:j + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    best, span = np.arange(n), 1                       # leftmost smallest of ``span`` grams
    while span < WINDOW:
        step = min(span, WINDOW - span)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(h[a] <= h[b], a, b)
        span += step
    at = np.unique(best)
    key = h[at]
    begin = np.r_[True, key[1:] != key[:-1]]
    first = at[begin][np.cumsum(begin) - 1]
    place = (at - first) // WINDOW
    keep = begin | np.r_[begin[1:], True] | np.r_[True, place[1:] != place[:-1]]
    return at[keep], key[keep]


def suffixes(docs: DataFrame) -> DataFrame:
    """(key, doc_id, th, pos) of the kept suffixes of (doc_id, th, text as bytes)."""
    def run(batches):
        for batch in batches:
            found = [minimisers(word_hashes(t)) for t in batch.column("text").to_pylist()]
            n = np.array([len(at) for at, _ in found], np.int64)
            row = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([k for _, k in found]).view(np.int64) if len(n) else np.zeros(0, np.int64)),
                batch.column("doc_id").take(row), batch.column("th").take(row),
                pa.array(np.concatenate([a for a, _ in found]).astype(np.int32) if len(n) else np.zeros(0, np.int32))],
                names=["key", "doc_id", "th", "pos"])

    return docs.mapInArrow(run, "key long, doc_id long, th long, pos int")


def contexts(found: DataFrame) -> DataFrame:
    """(key, crowded, doc_id, th, pos, left, right): the words after each suffix's
    gram, and before it in reverse, as little-endian hashes padded with zeros."""
    def run(batches):
        pad = np.zeros(SIDE, np.uint32)
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, th, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text", "at")),
                                         strict=True):
                words = np.concatenate([pad, word_hashes(text), pad])
                for s in at:
                    p = s["pos"] + SIDE
                    for column, value in zip(out, (
                            s["key"], s["crowded"], doc, th, s["pos"], words[p - SIDE:p][::-1].tobytes(),
                            words[p + GRAM:p + LEAST].tobytes()), strict=True):
                        column.append(value)
                    if len(out[0]) == 20_000:
                        yield _batch(out)
                        out = [[] for _ in range(7)]
            yield _batch(out)

    def _batch(out):
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                                          names=["key", "crowded", "doc_id", "th", "pos", "left", "right"])

    return found.mapInArrow(run, "key long, crowded boolean, doc_id long, th long, pos int, left binary, right binary")


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows of two matrices of word hashes."""
    equal = (a == b) & (a != 0)
    return np.where(equal.all(axis=1), equal.shape[1], np.argmin(equal, axis=1))


def compare(key, doc, th, pos, left, right):
    """(row, start, end, kept) of the suffixes of whole grams, sorted by gram, text and
    place, each compared with all others of its gram. Matches of at least ``LEAST`` words
    all hold the gram, so a row has one span over all of them (kept), and one over those
    with smaller documents (not kept)."""
    once = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (th[1:] != th[:-1]) | (pos[1:] != pos[:-1])])
    key, doc, th, pos, left, right = (c[once] for c in (key, doc, th, pos, left, right))
    n = len(key)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((th, doc))] = np.arange(n)
    back, on = np.full((2, n), -1), np.full((2, n), -1)        # of all matches, and with smaller documents
    i, step = np.arange(n - 1), 1
    while len(i := i[i + step < n]) and len(i := i[key[i] == key[i + step]]):
        j = i + step
        b, o = _same(left[i], left[j]), _same(right[i], right[j])
        ok = (b + o >= SIDE) & (th[i] != th[j])
        x, y, b, o = i[ok], j[ok], b[ok], o[ok]
        first = rank[x] < rank[y]
        for of, rows, some in ((0, x, slice(None)), (0, y, slice(None)), (1, x, ~first), (1, y, first)):
            r = rows[some]
            back[of, r], on[of, r] = np.maximum(back[of, r], b[some]), np.maximum(on[of, r], o[some])
        step += 1
    of, row = np.nonzero(on >= 0)
    return once[row], pos[row] - back[of, row], pos[row] + GRAM + on[of, row], of == 0


def matched(found: DataFrame) -> DataFrame:
    """(doc_id, th, start, end, kept) from the contexts of grams that are not crowded."""
    def run(batches):
        held = None

        def result(rows):
            def matrix(name):
                return np.frombuffer(b"".join(rows.column(name).to_pylist()), np.uint32).reshape(-1, SIDE)

            col = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("key", "th", "pos")}
            doc = rows.column("doc_id").fill_null(2 ** 63 - 1).to_numpy(zero_copy_only=False)
            i, start, end, kept = compare(col["key"], doc, col["th"], col["pos"], matrix("left"), matrix("right"))
            at = pa.array(i)
            return pa.RecordBatch.from_arrays([
                rows.column("doc_id").take(at), rows.column("th").take(at), pa.array(start.astype(np.int32)),
                pa.array(end.astype(np.int32)), pa.array(kept)], names=["doc_id", "th", "start", "end", "kept"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = held.column("key").to_numpy()
            cut = int(np.searchsorted(key == key[-1], True))            # the last gram may go on
            if cut:
                yield result(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield result(held)

    dealt = found.repartition(F.col("key")).sortWithinPartitions("key", "th", "pos")
    return dealt.mapInArrow(run, "doc_id long, th long, start int, end int, kept boolean")


def windows(found: DataFrame) -> DataFrame:
    """The same from crowded grams, by the hashes of all windows that hold the gram."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            left = np.frombuffer(b"".join(batch.column("left").to_pylist()), np.uint32).reshape(n, SIDE)
            right = np.frombuffer(b"".join(batch.column("right").to_pylist()), np.uint32).reshape(n, SIDE)
            line = np.concatenate([left[:, ::-1], right], axis=1).astype(np.uint64)
            key = batch.column("key").to_numpy().view(np.uint64)
            row, start, window = [], [], []
            for back in range(WINDOW):
                part = line[:, SIDE - back:2 * SIDE - back]
                h = key + np.uint64(back)
                for j in range(SIDE):
                    h = (h ^ part[:, j]) * PRIME
                    h ^= h >> np.uint64(29)
                whole = np.flatnonzero((part != 0).all(axis=1))
                row.append(whole)
                window.append(h[whole])
                start.append(batch.column("pos").to_numpy()[whole] - back)
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(window).view(np.int64)), batch.column("doc_id").take(at),
                batch.column("th").take(at), pa.array(np.concatenate(start).astype(np.int32))],
                names=["window", "doc_id", "th", "start"])

    every = staged(found.mapInArrow(run, "window long, doc_id long, th long, start int"), "suffix-windows")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th"))
    common = staged(every.groupBy(F.col("window").alias("_w")).agg(F.min("th").alias("_a"), F.max("th").alias("_b"),
                                                                   low.alias("_low")).where("_a <> _b"), "suffix-common")
    kept = F.col("doc_id").eqNullSafe(F.col("_low.doc_id")) & (F.col("th") == F.col("_low.th"))
    return every.join(common, F.col("window") == F.col("_w")).select(
        "doc_id", "th", "start", (F.col("start") + LEAST).alias("end"), kept.alias("kept"))


def merged(found: DataFrame) -> DataFrame:
    """(th, spans, cut) of the passages of every text: overlapping or touching ones joined, all of them and
    those that are not kept. A window over a text's sorted passages finds where a joined one begins."""
    every = (found.select("th", F.lit(0).alias("which"), "start", "end")
             .unionByName(found.where(~F.col("kept")).select("th", F.lit(1).alias("which"), "start", "end")).distinct())
    order = Window.partitionBy("th", "which").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = every.withColumn("_new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    joined = (begins.withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("th", "which", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")))

    def of(which: int) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("which") == which, F.struct("start", "end"))))
    return joined.groupBy("th").agg(of(0).alias("spans"), of(1).alias("cut"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, spans and cut (arrays of word offsets start, end) of every
    document with a passage that repeats in another."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"),
                        text.cast("binary").alias("text"))
    every = staged(suffixes(whole), "suffixes")
    # One row per text and place; copies of a text share their suffixes.
    low = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id")).alias("low")
    once = staged(every.groupBy("key", "th", "pos").agg(low).select("key", "th", "pos", "low.doc_id"), "suffix-texts")
    shared = staged(once.groupBy(F.col("key").alias("_key")).agg(
        F.min("th").alias("_a"), F.max("th").alias("_b"), F.count(F.lit(1)).alias("_n"))
        .where("_a <> _b").select("_key", (F.col("_n") > CROWDED).alias("crowded")), "suffix-shared")
    followed = (once.join(shared, F.col("key") == F.col("_key")).groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
                .agg(F.sort_array(F.collect_list(F.struct("pos", "key", "crowded"))).alias("at")))
    fetched = (whole.join(followed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
               .select("doc_id", "th", "text", "at"))
    around = staged(contexts(fetched), "suffix-contexts")
    found = staged(matched(around.where("not crowded").drop("crowded")).unionByName(
        windows(around.where("crowded"))), "suffix-matches")
    by_text = merged(found)

    # Documents by text: copies repeat as wholes, and all but the first are cut as wholes.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"),
                        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n_words"))
    texts = staged(texts.where(F.col("n_words") >= LEAST).distinct(), "suffix-docs")
    copies = staged(texts.groupBy(F.col("th").alias("_th")).agg(F.count(F.lit(1)).alias("_n"), low).join(
        by_text, F.col("_th") == F.col("th"), "left").where((F.col("_n") > 1) | F.col("spans").isNotNull())
        .select("_th", "_n", F.col("low.doc_id").alias("_first"), "spans", "cut"), "suffix-passages")
    all_words = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return (texts.join(copies, F.col("th") == F.col("_th")).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.when(F.col("_n") > 1, all_words).otherwise(F.col("spans")).alias("spans"),
        F.when(~F.col("doc_id").eqNullSafe(F.col("_first")), all_words)
        .otherwise(F.coalesce(F.col("cut"), none)).alias("cut")))
