"""SimHash near-duplicates by anchor-point covering.

Fingerprints: XXH64 (seed 42) of every word shingle, repeats included; a bit is
1 when it is set in more than half of the hashes. Documents link when their
fingerprints differ in at most ``MAX_BITS`` of 64 bits.

Covering: the 64 bits are cut into three parts of 21, 21 and 22 bits; of two
fingerprints within 4 bits, some part differs in at most one bit. On each part
the anchors are a covering code of radius 1: the perfect Hamming code on 15
bits times all words on the other 6 or 7, 2**17 or 2**18 anchors. Every
fingerprint is replicated to all anchors within covering radius plus threshold
that can be the home of a fingerprint one bit away (15 or so a part), so any
linked pair meets at the home of either. One code over all 64 bits would need
thousands of replicas a fingerprint for the same selectivity; the parts need
about 44, and two random fingerprints meet with odds of 1 in 2,000.

At scale: equal fingerprints are collapsed before anything else, so groups of
copies cost one row. Per anchor, fingerprints are compared with vectorised
XOR and popcount. A crowded anchor is walked breadth-first: a fingerprint that
was reached leaves the list, so dense groups take near-linear time, and each
task sends a spanning forest in place of all pairs. Very crowded anchors are cut
by five further blocks of bits first (two fingerprints within 4 bits agree on one).
Links then go through the star rounds of ``components``.

Defined cases: null text counts as empty; texts without words have fingerprint
zero and link like any other; texts with fewer words than a shingle hash their
whole sequence; texts of any length are hashed in chunks; a null doc_id is the
largest: a group is named by it only if it has no other; rows with equal doc_id
and text are one group; an empty table gives an empty result; other columns
pass through ``with_fingerprint``, but for one named ``fingerprint``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import staged
from .components import components, contract

SEED = 42
SHINGLE = 4
MAX_BITS = 4
CHUNK = 1 << 15            # shingles hashed at once
CROWDED, CROWD_CUT = 64, 4096
PARTS = ((0, 6), (21, 6), (42, 7))    # first bit and number of plain bits; the 15 coded bits follow


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, as an unsigned int."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()     # ASCII case and white space
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    n = max(1, len(words) - shingle + 1)
    last = end[min(shingle, len(words)) - 1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        a, b = start[at:min(at + CHUNK, n)].tolist(), last[at:min(at + CHUNK, n)].tolist()
        h = np.array([digest(line[i:j], SEED) for i, j in zip(a, b, strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, name: str = "fingerprint") -> DataFrame:
    """``docs`` with a long column ``name`` (the 64 bits, signed)."""
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields]).add(name, LongType())
    names = schema.names

    def run(batches):
        for batch in batches:
            made = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(made, np.uint64).view(np.int64))], names)

    return docs.mapInArrow(run, schema)


def _hamming_tables() -> tuple[np.ndarray, np.ndarray]:
    """For 15-bit words: the code word nearest to each, and up to 8 code words
    that are nearest to some word at most one bit away (the first is its own)."""
    words = np.arange(1 << 15)
    syndrome = np.zeros_like(words)
    for j in range(15):
        syndrome ^= np.where(words >> j & 1, j + 1, 0)
    home = np.where(syndrome > 0, words ^ (1 << np.maximum(syndrome - 1, 0)), words)
    around = np.stack([home, *[home[words ^ (1 << j)] for j in range(15)]], axis=1)
    around[:, 1:].sort(axis=1)
    near = [np.unique(row) for row in around]
    out = np.full((len(words), 8), -1)
    for w, row in enumerate(near):
        out[w, :len(row)] = row
    return home, out


def anchors(prints: DataFrame) -> DataFrame:
    """(part, anchor, fp): every fingerprint at the anchors it is replicated to."""
    home, around = _hamming_tables()

    def run(batches):
        for batch in batches:
            fp = np.asarray(batch.column("fp"))
            f = fp.view(np.uint64)
            for part, (bit, plain) in enumerate(PARTS):
                low = (f >> np.uint64(bit)).astype(np.int64) & ((1 << plain) - 1)
                code = (f >> np.uint64(bit + plain)).astype(np.int64) & 0x7FFF
                own, near = home[code], around[code]
                at = [(near << plain) | low[:, None]]
                at += [((own << plain) | (low ^ (1 << j)))[:, None] for j in range(plain)]
                keys = np.concatenate(at, axis=1)
                keep = np.concatenate([near >= 0, np.ones((len(f), plain), bool)], axis=1)
                rows = np.repeat(fp, keep.sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), part, np.int32)), pa.array(keys[keep].astype(np.int32)), pa.array(rows)],
                    names=["part", "anchor", "fp"])

    return prints.mapInArrow(run, "part int, anchor int, fp long")


def _walk(group: np.ndarray, bits: int) -> list:
    """Links of a spanning forest of one group, breadth-first."""
    out, left = [], group
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= bits
            if near.any():
                found, left = left[near], left[~near]
                out.append((np.full(len(found), root), found))
                queue.extend(found)
    return out


def _crowd(group: np.ndarray, bits: int) -> list:
    if len(group) <= CROWD_CUT:
        return _walk(group, bits)
    out, blocks = [], bits + 1
    for b in range(blocks):
        lo, hi = 64 * b // blocks, 64 * (b + 1) // blocks
        block = (group >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        order = np.argsort(block, kind="stable")
        cut = np.flatnonzero(np.diff(block[order])) + 1
        for part in np.split(group[order], cut):
            out += _walk(part, bits)
    return out


def _compare(key: np.ndarray, fp: np.ndarray, bits: int) -> list:
    """Links within runs of equal key."""
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[begin, len(key)])
    out = []
    for at, n in zip(begin[size > CROWDED], size[size > CROWDED], strict=True):
        out += _crowd(fp[at:at + n], bits)
    left = np.repeat(begin + size - 1, size) - np.arange(len(key))     # rows that follow in the run
    left[np.repeat(size > CROWDED, size)] = 0
    rows = np.flatnonzero(left)
    for d in range(1, CROWDED):
        rows = rows[left[rows] >= d]
        if not len(rows):
            break
        hit = rows[np.bitwise_count(fp[rows] ^ fp[rows + d]) <= bits]
        if len(hit):
            out.append((fp[hit], fp[hit + d]))
    return out


def links(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that have the same
    components as all links of at most ``bits`` (at most 4) bits."""
    def run(batches):
        key, fp, found = np.zeros(0, np.int64), np.zeros(0, np.uint64), []

        def flush():
            a, b = contract(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            new = (np.asarray(batch.column("part")).astype(np.int64) << 32) | np.asarray(batch.column("anchor"))
            key = np.concatenate([key, new])
            fp = np.concatenate([fp, np.asarray(batch.column("fp")).view(np.uint64)])
            done = int(np.searchsorted(key == key[-1], True)) if len(key) else 0     # the last run may go on
            if done:
                found += _compare(key[:done], fp[:done], bits)
                key, fp = key[done:], fp[done:]
            if sum(len(x) for x, _ in found) > 200_000:
                yield flush()
        if len(key):
            found += _compare(key, fp, bits)
        if found:
            yield flush()

    at = anchors(prints).repartition(F.col("part"), F.col("anchor")).sortWithinPartitions("part", "anchor", "fp")
    return at.mapInArrow(run, "a long, b long")


def classes(rows: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(fp, _root, component_id) for staged ``rows`` of (doc_id, fingerprint):
    the smallest fingerprint and doc_id of every fingerprint's component."""
    prints = staged(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")), "simhash-prints")
    tree = staged(components(links(prints.select("fp"), bits)), "simhash-tree")
    rooted = prints.join(tree, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("_root"))
    low = staged(rooted.groupBy(F.col("_root").alias("_low")).agg(F.min("first").alias("component_id")), "simhash-low")
    return staged(rooted.join(low, F.col("_root") == F.col("_low")).select("fp", "_root", "component_id"),
                  "simhash-classes")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = staged(with_fingerprint(rows, shingle).select("doc_id", "fingerprint"), "simhash-rows")
    found = rows.join(classes(rows, bits), F.col("fingerprint") == F.col("fp"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: each component keeps the row
    of its smallest doc_id (of several, that with the smallest text hash).
    The texts are written once with their fingerprints and shuffled once."""
    marked = with_fingerprint(docs, shingle, "_simhash")
    marked = staged(marked.withColumn("_texthash", F.xxhash64("text")), "simhash-docs")
    rows = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_simhash").alias("fingerprint"), "_texthash")
    first = (rows.join(classes(rows, bits), F.col("fingerprint") == F.col("fp")).groupBy("_root")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "fingerprint", "_texthash")).alias("_f"))
             .select(F.col("_f.doc_id").alias("_id"), F.col("_f.fingerprint").alias("_fp"),
                     F.col("_f._texthash").alias("_th")))
    first = staged(first, "simhash-first")
    kept = marked.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_simhash") == F.col("_fp"))
                       & (F.col("_texthash") == F.col("_th")))
    one = F.row_number().over(Window.partitionBy("_id", "_fp", "_th").orderBy("_th"))
    return kept.withColumn("_one", one).where("_one = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
