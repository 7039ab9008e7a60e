"""E8 in SQL: the first element that a path of steps selects, nesting counted.

The page is cut once at the opening and closing tags that the steps name (comments,
scripts and styles are cut out whole, so no tag is found inside them). One fold over
those tags keeps a counter per step: how deep the page is inside the outermost open
element that matches the steps up to there. Its state is a few integers whatever the
page holds, so the work is linear in the page.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let
from .html import BLOCKS, WS_RUN, _armed, _attribute, _closing, _col, _disarm, _has, _opening, _whole

# (tag, attribute, value, class tokens) of one step.
Step = tuple[str, str | None, str | None, Sequence[str]]


def _matches(opening_tag: Column, step: Step) -> Column:
    _, attr, value, classes = step
    ok = _has(opening_tag, attr, value)
    if classes:
        ok &= let(F.split(_attribute(opening_tag, "class"), WS_RUN), lambda have: F.coalesce(
            functools.reduce(lambda a, b: a & b, [F.array_contains(have, c) for c in classes]), F.lit(False)))
    return ok


def _described(tokens: Column, steps: Sequence[Step]) -> Column:
    """Per tag: its place, name (empty for what is no tag), kind and the steps it matches."""
    def one(t, i):
        name = F.when(_whole(t), F.lower(F.regexp_extract(t, r"^</?([A-Za-z][^ \t\n\f\r/>]*)", 1))).otherwise("")
        opens = ~t.startswith("</")
        return let(name, lambda n: F.struct(
            i.alias("i"), n.alias("name"), opens.alias("opens"), t.endswith("/>").alias("empty"),
            *[F.when(opens & (n == s[0].lower()), _matches(t, s)).otherwise(F.lit(False)).alias(f"m{j}")
              for j, s in enumerate(steps)]))
    return F.transform(tokens, one)


def _fold(described: Column, steps: Sequence[Step]) -> Column:
    """(lo, hi): the tags that open and close the selected element, -1 where there is none."""
    k = len(steps)

    def step(s, t):
        begins = [t[f"m{j}"] & (s[f"c{j}"] == 0) & ((s[f"c{j - 1}"] > 0) if j else F.lit(True)) for j in range(k)]

        def counted(j):
            c = s[f"c{j}"]
            same = (t["name"] == steps[j][0].lower()) & ~t["empty"]
            return (F.when(same & t["opens"], F.when(c > 0, c + 1).when(begins[j], F.lit(1)).otherwise(F.lit(0)))
                    .when(same & ~t["opens"] & (c > 0), c - 1).otherwise(c))

        def settled(r):
            # what lies inside an element ends with it, closed or not
            counts = [r["c0"]]
            for j in range(1, k):
                counts.append(F.when(counts[-1] == 0, F.lit(0)).otherwise(r[f"c{j}"]))
            first = s["lo"] < 0
            lone = first & t["empty"] & begins[-1]
            lo = F.when(first & ((counts[-1] > 0) | lone), t["i"]).otherwise(s["lo"])
            hi = F.when(lone | ((s["lo"] >= 0) & (counts[-1] == 0)), t["i"]).otherwise(F.lit(-1))
            return F.struct(*[c.alias(f"c{j}") for j, c in enumerate(counts)], lo.alias("lo"), hi.alias("hi"))

        moved = let(F.struct(*[counted(j).alias(f"c{j}") for j in range(k)]), settled)
        return F.when(s["hi"] >= 0, s).otherwise(moved)

    zero = F.struct(*[F.lit(0).alias(f"c{j}") for j in range(k)], F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    return F.aggregate(described, zero, step)


def first_inner(html, steps: Sequence[Step]) -> Column:
    """Inner HTML of the first element that matches the last of ``steps`` inside one that
    matches the step before it, and so on; NULL when there is none. An element that is
    not closed runs to the end of the page; ``<div/>`` is an empty element."""
    tags = sorted({s[0].lower() for s in steps})
    blocks = [BLOCKS[b] for b in BLOCKS if b not in tags]
    search = "(?s)" + "|".join([*(f"{o}.*?{c}" for _, o, c in blocks), *map(_opening, tags), *map(_closing, tags)])

    def cut(x):
        parts = F.struct(F.split(x, search, -1).alias("pieces"), F.regexp_extract_all(x, F.lit(search), F.lit(0)).alias("tokens"))
        return let(parts, lambda p: let(_fold(_described(p["tokens"], steps), steps), lambda s: inner(p, s)))

    def inner(p, s):
        last = F.when(s["hi"] < 0, F.size(p["tokens"])).otherwise(s["hi"])
        n = F.greatest(last - s["lo"], F.lit(0))                 # pieces between the two tags
        text = F.slice(p["pieces"], s["lo"] + 2, n)
        between = F.concat(F.array(F.lit("")), F.slice(p["tokens"], s["lo"] + 2, F.greatest(n - 1, F.lit(0))))
        joined = F.array_join(F.zip_with(between, text, lambda a, b: F.concat(F.coalesce(a, F.lit("")), b)), "")
        return F.when(s["lo"] >= 0, F.when(n > 0, joined).otherwise(F.lit("")))

    return _armed(let(_disarm(_col(html), *blocks), cut))
