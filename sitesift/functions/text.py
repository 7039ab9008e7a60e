"""Text Column functions: tokenizer (F2), result extract (G9), highlight.

All are native Spark expressions (regex, higher-order array functions), so
they run inside whole-stage codegen with no Python in the task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# Fixed values of the engine (pinned by us, see SURVEY F2/G9/G10).
# A token is a maximal run of Unicode letters and digits, lower-cased.
TOKEN_PATTERN = r"([\p{L}\p{N}]+)"
# The other analyzers: runs of letters, runs of anything but white space.
ANALYZERS = {"standard": TOKEN_PATTERN, "letter": r"(\p{L}+)", "whitespace": r"([^ \t\n\x0B\f\r]+)"}
# A stock English stop list.
STOP_WORDS_EN = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there "
                      "these they this to was will with".split())
# Word runs and non-word runs, used to cut a fragment into pieces.
RUN_PATTERN = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"
# An extract is the first 201 characters of a text longer than 200.
EXTRACT_THRESHOLD = 200
EXTRACT_LENGTH = 201
# Highlight defaults of the reference's search options.
HIGHLIGHT_DEFAULTS = {
    "pre_tag": "<b>",
    "post_tag": "</b>",
    "ellipsis": "&hellip;",
    "excerpt_length": 50,
    "num_excerpts": 3,
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Analyzer:
    """how text becomes terms. An index keeps its analyzer with its tables, and
    queries against it are analysed by that one.

    ``kind``: standard (letters and digits), letter or whitespace. Stop words are
    no terms and do not count for a field's length, but they keep their place, so
    that a phrase holds across them.
    """
    kind: str = "standard"
    lower: bool = True
    stop_words: tuple[str, ...] = ()

    def __post_init__(self):
        if self.kind not in ANALYZERS:
            raise ValueError(f"unknown analyzer {self.kind!r}: one of {sorted(ANALYZERS)}")
        words = {w.lower() if self.lower else w for w in self.stop_words}
        object.__setattr__(self, "stop_words", tuple(sorted(words)))

    def tokens(self, text) -> Column:
        """All tokens in text order, stop words included."""
        c = _col(text)
        return F.regexp_extract_all(F.lower(c) if self.lower else c, F.lit(ANALYZERS[self.kind]), 1)

    def kept(self, token: Column) -> Column:
        return ~token.isin(*self.stop_words) if self.stop_words else F.lit(True)

    def only_kept(self, tokens: Column) -> Column:
        return F.filter(tokens, self.kept) if self.stop_words else tokens

    def terms(self, text) -> Column:
        """The tokens that are terms, in text order."""
        return self.only_kept(self.tokens(text))

    def placed(self, text) -> Column:
        """(at, term) of every term; ``at`` counts stop words too."""
        placed = F.transform(self.tokens(text), lambda t, i: F.struct(i.alias("at"), t.alias("term")))
        return F.filter(placed, lambda x: self.kept(x["term"])) if self.stop_words else placed


def tokenize(text) -> Column:
    """F2 by the standard analyzer: array of lower-cased letter/digit runs, in text order."""
    return Analyzer().tokens(text)


def build_extract(data) -> Column:
    """Whole text up to 200 characters, else its first 201; NULL stays NULL."""
    d = _col(data)
    return (F.when(F.length(d) > EXTRACT_THRESHOLD, F.substring(d, 1, EXTRACT_LENGTH))
            .otherwise(d))


def _highlight_opts(**kw) -> dict:
    o = dict(HIGHLIGHT_DEFAULTS)
    o.update({k: v for k, v in kw.items() if v is not None})
    return o


def with_highlight(df: DataFrame, data: str, terms: str, out: str, pre_tag: str | None = None,
                   post_tag: str | None = None, ellipsis: str | None = None,
                   excerpt_length: int | None = None, num_excerpts: int | None = None) -> DataFrame:
    """Add column ``out`` with up to ``num_excerpts`` tagged fragments.

    The text is cut into consecutive ``excerpt_length``-character fragments.
    Each fragment is split into word and non-word runs; a word run whose
    lower-case form is one of ``terms`` is a hit and is wrapped in the tags.
    The best fragments by (hits desc, position) are shown in text order,
    joined by the ellipsis. Without any hit the plain extract (G9) is kept.
    Meant for the few rows of a result page, after top-k. Built in three
    projections: every fragment is split and scored once, and only the
    chosen fragments are rendered.
    """
    o = _highlight_opts(pre_tag=pre_tag, post_tag=post_tag, ellipsis=ellipsis,
                        excerpt_length=excerpt_length, num_excerpts=num_excerpts)
    d, t = F.col(data), F.col(terms)
    n = int(o["excerpt_length"])

    def is_hit(r):
        return F.array_contains(t, F.lower(r))

    # 1) one linear regex pass cuts the text into fragments (substring(i*n)
    #    per fragment would rescan the UTF-8 text from its start every time);
    #    each fragment is split into runs once and its hits are counted
    frags = F.transform(
        F.regexp_extract_all(d, F.lit(f"(?s)(.{{1,{n}}})"), 1),
        lambda f, i: let(F.regexp_extract_all(f, F.lit(RUN_PATTERN), 1), lambda runs: F.struct(
            runs.alias("runs"), F.size(F.filter(runs, is_hit)).alias("hits"), i.alias("i"))))
    # 2) the best fragments by (hits desc, position), then in text order
    ranked = F.transform(F.filter(F.col(tmp1 := f"__{out}_frags"), lambda s: s["hits"] > 0),
                         lambda s: F.struct((-s["hits"]).alias("neg_hits"), s["i"].alias("i")))
    chosen = F.array_sort(F.transform(F.slice(F.array_sort(ranked), 1, int(o["num_excerpts"])),
                                      lambda b: b["i"]))
    # 3) only the chosen fragments are rendered with tagged hits
    tmp2 = f"__{out}_chosen"
    rendered = F.array_join(F.transform(F.col(tmp2), lambda i: F.array_join(F.transform(
        F.col(tmp1)[i]["runs"], lambda r: F.when(is_hit(r), F.concat(F.lit(o["pre_tag"]), r, F.lit(o["post_tag"])))
        .otherwise(r)), "")), o["ellipsis"])
    return (df.withColumn(tmp1, frags)
            .withColumn(tmp2, chosen)
            .withColumn(out, F.when(d.isNull(), F.lit(None).cast("string"))
                        .when(F.size(F.col(tmp2)) > 0, rendered).otherwise(build_extract(d)))
            .drop(tmp1, tmp2))
