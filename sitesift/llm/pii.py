"""Personal data by bootstrapped contextual extraction.

Base entities (e-mail, IP address, card and phone number) are found by fixed
patterns and checks, leftmost and non-overlapping per kind. They are the seeds:
the two words before a seed are a lexical pattern, and so is its shape (digits as
0, letters as a), which texts without a cue before their identifiers share. Tokens that hold a digit or
an at-sign, and runs of digit groups written with single spaces, that look like a
kind but fail its base pattern, are the unseen instances. On the graph of patterns and instances, scores go back and forth for
``ROUNDS`` rounds: a pattern's confidence for a kind is the summed score of its
instances over their number (plus ``SMOOTHING``), an unseen instance scores its
best pattern. Patterns of at least ``SUPPORT`` distinct seeds count; instances
that reach ``CONFIDENCE`` are reported wherever they stand. Base spans always stay.

DataFrame functions only. Positions come from two linear passes: all matches,
and the text split at them. The patterns neither backtrack over runs nor
recurse (possessive quantifiers, entry only at the start of a run), so texts of
any length are safe.

At scale: texts are read once and never shuffled; matches go to a narrow staged
table, where window sums over a document's matches give their positions. The graph holds distinct (pattern, kind, instance) edges of supported
patterns only; sums are combined map-side, and joins are between written tables
so that AQE can split a pattern that a third of the edges share.

Defined cases: null text counts as empty; rows keep their own spans whatever
doc_id they have, null or repeated; documents without spans return empty
strings and the digest of an empty one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
# The contract's patterns, made linear: same matches, entered at the start of a run.
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPACE = r"\x20\x09-\x0D"
TOKEN = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
# Groups of digits joined by single spaces, dots, hyphens and brackets.
RUN = rf"(?<![^{SPACE}(\[<\"'])[+(]{{0,2}}+[0-9]++(?![A-Za-z_@])(?:\)?+[\x20.-]?+\(?+[0-9]++(?![A-Za-z_@]))++"
CONTEXT_CHARS = 48
ROUNDS, SUPPORT, SMOOTHING, CONFIDENCE = 3, 3, 1.5, 0.8
FOUND = "array<struct<k:int,i:int,gap:int,n:int,m:string,l:string>>"
TOKENS, RUNS = len(KINDS), len(KINDS) + 1              # in place of a kind


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """The check that a base match must pass."""
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?=[0-9])|$)){4}$")
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


# Cheap tests without which a pattern cannot match.
HINTS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
         "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+"),
         "token": lambda t: t.rlike("[0-9@]"), "run": lambda t: t.rlike(r"[0-9]\)?\x20\(?[0-9]")}


def matches(df: DataFrame, k: int, name: str, pattern: str) -> DataFrame:
    """``df`` with a column ``name``: for every match in ``_text`` its kind, place
    in order, characters since the match before, length, text and left context
    (of the text before, matches and all)."""
    def tail(c: Column) -> Column:
        return F.coalesce(F.substring(c, -CONTEXT_CHARS, CONTEXT_CHARS), F.lit(""))

    text, hint = F.col("_text"), HINTS[name]
    df = df.withColumn("_m", F.when(hint(text), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split(text, pattern, -1)))
    pairs = F.arrays_zip(F.col("_m").alias("m"), F.slice(F.col("_g"), F.lit(1), F.size("_m")).alias("g"))
    found = F.transform(pairs, lambda x, i: F.struct(
        F.lit(k).alias("k"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("n"), x["m"].alias("m"),
        tail(F.concat(*[tail(F.get(F.col(c), i - back)) for back in (2, 1) for c in ("_g", "_m")], tail(x["g"]))).alias("l")))
    return df.withColumn(name, F.when(F.size("_m") > 0, found).otherwise(F.array().cast(FOUND))).drop("_m", "_g")


def pattern_of(left: Column) -> Column:
    """The last two words before a match, lower-cased, digits as 0."""
    words = F.regexp_extract(left, rf"((?:[^{SPACE}]+[{SPACE}]+)?[^{SPACE}]+)[{SPACE}]*$", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(words), rf"[{SPACE}]+", " "), "[0-9]", "0")


def shape_of(m: Column) -> Column:
    """The shape of an instance as a pattern, marked so that no words before one are equal to it."""
    return F.concat(F.lit("\0"), F.regexp_replace(F.regexp_replace(m, "[A-Za-z]+", "a"), "[0-9]", "0"))


def looks_like(kind: str, m: Column) -> Column:
    """Whether an unseen token has the shape of a kind."""
    n = F.length(_digits(m))
    return {"email": m.rlike(r"^[^@]+@[^@]+$"),
            "ip": m.rlike(r"^[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){2,15}$") & (n > 0),
            "card": m.rlike(r"^[0-9\x20-]+$") & n.between(12, 19),
            "phone": m.rlike(r"^[+(]{0,2}[0-9][\x20().0-9-]+$") & n.between(7, 15)}[kind]


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged (documents: _row, doc_id), (base spans: _row, s, k, e, m, p) and
    (unseen tokens and runs clear of base spans: _row, s, e, m, p, ks, run, own), p a pattern, ks the
    kinds it looks like, own unless it begins with a token that looks like a kind by itself."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    for k, (name, pattern) in enumerate([*PATTERNS.items(), ("token", TOKEN), ("run", RUN)]):
        df = matches(df, k, name, pattern)
    rows = staged(df.select(F.monotonically_increasing_id().alias("_row"), "doc_id",
                            F.concat(*PATTERNS, "token", "run").alias("hits")), "pii-rows")
    hits = rows.select("_row", F.inline("hits"))
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("_row", "k").orderBy("i")).cast("int")
    hits = hits.withColumn("e", end).withColumn("s", F.col("e") - F.col("n"))
    ok = F.lit(False)
    for k, kind in enumerate(KINDS):
        ok = ok | ((F.col("k") == k) & valid(kind, F.col("m")))
    token = F.col("k") >= TOKENS
    ahead = F.when(F.col("k") == RUNS, F.regexp_replace("m", r"^\((?=[^)]*$)", "")).otherwise(
        F.regexp_replace("m", "^[(\\[<\"']+", ""))                    # punctuation around a token is not part of it
    core = F.regexp_replace(ahead, "[.,;:!?)\\]>\"']+$", "")
    hits = (hits.where((F.col("k") != RUNS) | F.col("m").contains(" ")).where(token | ok)
            .withColumn("s", F.when(token, F.col("s") + F.col("n") - F.length(ahead)).otherwise(F.col("s")))
            .withColumn("m", F.when(token, core).otherwise(F.col("m"))).withColumn("e", F.col("s") + F.length("m")))
    order = Window.partitionBy("_row").orderBy("s", "k")
    reach = F.max(F.when(~token, F.col("e"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    hits = (hits.withColumn("_reach", reach).withColumn("_base", F.when(~token, F.col("s")))
            .withColumn("_next", F.expr("lead(_base) IGNORE NULLS OVER (PARTITION BY _row ORDER BY s, k)"))
            .withColumn("p", pattern_of(F.col("l"))))
    hits = staged(hits.select("_row", "s", "k", "e", "m", "p", "_reach", "_next"), "pii-hits")
    token = F.col("k") >= TOKENS
    clear = (F.coalesce("_reach", F.lit(0)) <= F.col("s")) & (F.coalesce("_next", F.col("e")) >= F.col("e"))
    shapes = F.array_compact(F.array(*[F.when(looks_like(kind, F.col("m")), F.lit(k)) for k, kind in enumerate(KINDS)]))
    unseen = (hits.where(token & clear & (F.length("m") > 0))
              .select("_row", "s", "e", "m", "p", shapes.alias("ks"), (F.col("k") == RUNS).alias("run")))
    shaped, place = F.size("ks") > 0, Window.partitionBy("_row").orderBy("s")
    begins = F.coalesce(F.max(~F.col("run") & shaped).over(place.rangeBetween(0, 2)), F.lit(False))
    # A run of digit groups stands for those of its tokens that look like no kind.
    unseen = (unseen.withColumn("own", ~F.col("run") | ~begins).withColumn("_in", inside(shaped))
              .where(F.when(F.col("run"), shaped).otherwise(shaped | ~F.col("_in"))).drop("_in"))
    return rows.select("_row", "doc_id"), hits.where(~token).select("_row", "s", "k", "e", "m", "p"), unseen


def inside(counts: Column) -> Column:
    """Whether an unseen instance lies in a run of its row that counts."""
    before = Window.partitionBy("_row").orderBy("s").rangeBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.max(F.when(F.col("run") & counts, F.col("e"))).over(before) >= F.col("e"), F.lit(False))


def discovered(base: DataFrame, unseen: DataFrame) -> DataFrame:
    """(m, k): unseen instances that reach the confidence, each with its best kind."""
    seeds = base.select("p", "k", "m", F.lit(1.0).alias("seed"), F.lit(True).alias("own"))
    other = unseen.select("p", "m", "own", F.explode_outer("ks").alias("k"))
    seen = seeds.unionByName(other.select("p", "k", "m", F.lit(0.0).alias("seed"), "own"))
    patterns = F.array_distinct(F.array("p", shape_of(F.col("m"))))
    seen = seen.select(F.explode(patterns).alias("p"), "k", "m", "seed", "own").where("p <> ''")
    edges = staged(seen.groupBy("p", "k", "m").agg(F.max("seed").alias("seed"), F.max("own").alias("own")), "pii-edges")
    supported = staged(edges.where("seed = 1").groupBy("p", "k").agg(F.count(F.lit(1)).alias("n"))
                       .where(F.col("n") >= SUPPORT).select(F.col("p").alias("_p"), F.col("k").alias("_k")), "pii-support")
    # Instances of a pattern, of whatever kind; only supported patterns can score.
    size = staged(edges.where("own").select("p", "m").distinct().groupBy(F.col("p").alias("_p")).agg(F.count(F.lit(1)).alias("size")),
                  "pii-sizes")
    edges = edges.join(supported, (F.col("p") == F.col("_p")) & (F.col("k") == F.col("_k"))).drop("_p", "_k")
    edges = staged(edges.join(size, F.col("p") == F.col("_p")).drop("_p"), "pii-graph")
    score = None
    for _ in range(ROUNDS):
        scored = edges.withColumn("score", F.col("seed")) if score is None else edges.join(
            score, (F.col("m") == F.col("_m")) & (F.col("k") == F.col("_k")), "left").withColumn(
            "score", F.greatest("seed", F.coalesce("best", F.lit(0.0))))
        trust = staged(scored.groupBy("p", "k").agg((F.sum(F.when(F.col("own"), F.col("score")).otherwise(0.0)) / (F.max("size") + SMOOTHING)).alias("trust"))
                       .select(F.col("p").alias("_p"), F.col("k").alias("_k"), "trust"), "pii-patterns")
        score = staged(edges.where("seed = 0")
                       .join(trust, (F.col("p") == F.col("_p")) & (F.col("k") == F.col("_k")))
                       .groupBy(F.col("m").alias("_m"), F.col("k").alias("_k")).agg(F.max("trust").alias("best")),
                       "pii-instances")
    return (score.where(F.col("best") >= CONFIDENCE).groupBy(F.col("_m").alias("m"))
            .agg(F.min(F.struct(-F.col("best"), "_k")).alias("b")).select("m", F.col("b._k").alias("k")))


def written(found: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans,
    n_discovered of every document."""
    rows, base, unseen = spans(docs)
    new = staged(discovered(base, unseen).select(F.col("m").alias("_m"), F.col("k").alias("k")), "pii-discovered")
    more = unseen.join(new, F.col("m") == F.col("_m")).select("_row", "s", "k", "e", "run")
    more = more.withColumn("_in", inside(F.lit(True)))             # tokens in a reported run are part of it
    more = more.where(F.col("run") | ~F.col("_in")).select("_row", "s", "k", "e", F.lit(True).alias("new"))
    every = base.select("_row", "s", "k", "e", F.lit(False).alias("new")).unionByName(more)
    found = staged(every.groupBy(F.col("_row").alias("_r")).agg(F.sort_array(F.collect_list(
        F.struct("s", "k", "e", "new"))).alias("found")), "pii-found")
    found_or_none = F.coalesce("found", F.array().cast("array<struct<s:int,k:int,e:int,new:boolean>>"))
    whole = rows.join(found, F.col("_row") == F.col("_r"), "left").select("doc_id", found_or_none.alias("found"))
    base_only = F.filter("found", lambda x: ~x["new"])

    def count(k: int) -> Column:
        return F.size(F.filter("found", lambda x: ~x["new"] & (x["k"] == k))).cast("long")

    return whole.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(written(base_only), 256).alias("base_sha256"), written(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: x["new"])).cast("long").alias("n_discovered"))
