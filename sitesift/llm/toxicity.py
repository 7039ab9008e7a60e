"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: the toxic one holds
the stretches of words that toxic documents have far more often than ordinary
ones; the ordinary one holds words of ordinary text that cover the remaining
pieces of the toxic one, so that what both kinds of text share compresses alike.
Every window of a text is compressed with either dictionary; a window counts
when the toxic dictionary saves at least a threshold of bytes more. The summed
excess per window is compared with a second threshold, and both are calibrated
on the training sample (``SAMPLE`` documents a class, texts of at most
``SAMPLE_BYTES``; parameters).

Windows are up to ``WINDOW`` bytes of lower-cased words (digits and ASCII
punctuation separate words), cut at spaces; a longer word is cut into pieces.
Each begins with a marker that either dictionary holds, so that every window has
a match and a further one costs its true few bytes; windows are too short
for entropy-coded literals, so lengths move only with matches.

At scale: one narrow pass over whole texts in Arrow batches, window by window;
nothing is shuffled, and the dictionaries are a few kilobytes. Training sees
the same number of rows whatever the input.

Defined cases: null text counts as empty; texts without letters score 0; without
labels of both classes, or when no stretch stands out, every score is 0; null
labels and ids are not learned from; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out, learn_rows

SAMPLE, SAMPLE_BYTES = 1000, 100_000
ORDINARY_TIMES = 2                  # ordinary documents in the sample for each toxic one
PIECE = 5                           # bytes of the shortest match
SIZES = (PIECE, 7, 9, None)         # of pieces that may stand out; None: whole words
WINDOW = 40
DICTIONARY_BYTES = 8192
STANDS_OUT, LEAST_SHARE, LEAST = 12.0, 0.01, 6
THRESHOLD = 0.5
APART = b"\n"                        # between stretches; no window holds it
MARK = bytes(range(0x80, 0x90))     # never whole in valid UTF-8
# Lower case; everything in ASCII that is not a letter becomes a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def windows(text: bytes):
    """The windows of a text, each with a space on either side."""
    line = b" " + b" ".join(text.translate(TABLE).split()) + b" "
    at, end = 0, len(line) - 1
    while at < end:
        cut = line.rfind(b" ", at + 1, at + WINDOW + 1)
        if cut < 0:                                        # one long word
            cut = min(at + WINDOW, end)
        yield MARK + (line[at:cut + 1] if line[cut] == 32 else line[at:cut])
        at = cut


def contexts(texts: list[bytes]) -> dict[bytes, int]:
    """Of every word, in how many distinct neighbourhoods it stands (so that copies count once)."""
    seen = defaultdict(set)
    for text in texts:
        words = text.translate(TABLE).split()
        for before, word, after in zip([b"", *words], words, [*words[1:], b""], strict=False):
            seen[word].add(hash((before, after)))
    return {w: len(s) for w, s in seen.items()}


def pieces(words: dict[bytes, int], size: int | None) -> Counter:
    """Neighbourhoods of every piece of ``size`` bytes, of whole words if None."""
    out = Counter()
    for w, n in words.items():
        x = b" " + w + b" "
        for p in {x[i:i + size] for i in range(len(x) - size + 1)} if size else (x,):
            out[p] += n
    return out


def stretches(x: bytes, chosen: set, size: int):
    """Maximal stretches of ``x`` that chosen pieces cover without a gap."""
    i = 0
    while i <= len(x) - size:
        j = i
        while j <= len(x) - size and x[j:j + size] in chosen:
            j += 1
        if j > i:
            yield x[i:j - 1 + size]
        i = j + 1


def toxic_content(words: dict[bytes, int], chosen: dict[int | None, set]) -> bytes:
    """Chosen words, and in other words the stretches of the shortest chosen pieces; the most frequent last."""
    found = Counter()
    for w, n in words.items():
        x = b" " + w + b" "
        if x in chosen[None]:
            found[x] += n
        else:
            some = (set(stretches(x, p, size)) for size, p in chosen.items() if size)
            for stretch in next(filter(None, some), ()):
                found[stretch] += n
    out, body = [], b""
    for stretch, n in sorted(found.items(), key=lambda p: (-p[1], p[0])):
        if n > 1 and stretch not in body and len(body) + len(stretch) <= DICTIONARY_BYTES:
            out.append(stretch)
            body += APART + stretch
    return APART.join(reversed(out))


def covering_content(content: bytes, words: dict[bytes, int], chosen: dict[int | None, set]) -> bytes:
    """For every piece of ``content`` that ordinary text has too, its most frequent ordinary word."""
    out = b""
    for size in (s for s in SIZES[::-1] if s):                 # longer pieces first
        wanted = {content[i:i + size] for i in range(len(content) - size + 1)} - chosen[size]
        best: dict[bytes, tuple] = {}
        for w, n in words.items():
            x = b" " + w + b" "
            for p in {x[i:i + size] for i in range(len(x) - size + 1)} & wanted:
                best[p] = max(best.get(p, (0, b"")), (n, x))
        for p, (_, x) in sorted(best.items(), key=lambda b: (-b[1][0], b)):
            if p not in out and len(out) + len(x) <= DICTIONARY_BYTES:
                out = x + APART + out
    return out


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
        strategy=zstandard.STRATEGY_LAZY, min_match=PIECE, window_log=16, hash_log=13, chain_log=13, search_log=4)
    made = zstandard.ZstdCompressionDict(content + MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=params)


def savings(texts, toxic: bytes, ordinary: bytes):
    """Per text, the bytes by which the toxic dictionary is better on each window."""
    bad, good = compressor(toxic).compress, compressor(ordinary).compress
    for text in texts:
        yield np.fromiter((len(good(w)) - len(bad(w)) for w in windows(text)), np.int32)


def excess(saved: np.ndarray, least: int) -> float:
    over = saved[saved >= least]
    return float((over - (least - 1)).sum()) / len(saved) if len(over) else 0.0


def train(toxic: list[bytes], ordinary: list[bytes]) -> tuple | None:
    """(toxic dictionary, ordinary dictionary, bytes a window must save, excess at
    score 0.5). Two thirds of the sample make the dictionaries, the rest calibrates."""
    if not toxic or not ordinary:
        return None
    learn, rest = slice(0, -(-2 * len(toxic) // 3)), slice(0, -(-2 * len(ordinary) // 3))
    bad_words, good_words = contexts(toxic[learn]), contexts(ordinary[rest])
    bad_all, good_all = sum(bad_words.values()) or 1, sum(good_words.values()) or 1
    least = max(LEAST, LEAST_SHARE * len(toxic[learn]))
    chosen = {}
    for size in SIZES:
        bad, good = pieces(bad_words, size), pieces(good_words, size)
        chosen[size] = {p for p, n in bad.items()
                        if n >= least and (n + .5) / bad_all > STANDS_OUT * (good[p] + .5) / good_all}
    content = toxic_content(bad_words, chosen)
    if not content:
        return None
    cover = covering_content(content, good_words, chosen)
    one = list(savings(toxic[learn.stop:] or toxic, content, cover))
    zero = list(savings(ordinary[rest.stop:] or ordinary, content, cover))
    best = (-1.0, 0.0, 0, 0.0)
    for t in range(2, 9):
        x, y = (np.sort([excess(s, t) for s in group]) for group in (one, zero))
        values = np.unique(np.concatenate([x, y]))
        for low, high in zip(values[:-1], values[1:], strict=True):
            cut = (low + high) / 2
            right = (x >= cut).mean() + ORDINARY_TIMES * (y < cut).mean()
            best = max(best, (round(right, 4), (high - low) / high, t, cut))
    return (content, cover, best[2], float(best[3])) if best[0] > 0 else None


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple | None:
    rows = learn_rows(docs, labels, "toxic", (ORDINARY_TIMES * sample, sample), sample_bytes)
    return train([t for t, y in rows if y], [t for t, y in rows if not y])


def score(docs: DataFrame, model: tuple | None, name: str = "score") -> DataFrame:
    """``docs`` with a double column ``name`` in [0, 1): excess / (excess + calibrated excess)."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    toxic, ordinary, least, half = model

    @F.pandas_udf("double")
    def toxicity(text: pd.Series) -> pd.Series:
        found = [excess(s, least) for s in savings(text, toxic, ordinary)]
        return pd.Series([x / (x + half) for x in found], dtype=float)

    return docs.withColumn(name, toxicity(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
