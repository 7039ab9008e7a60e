import hashlib
import re

from pyspark.sql import functions as F

from sitesift.llm import pii
from tests.conftest import SF01

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else True,
            "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items())
             for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


TRICKY = ["a@b.com_x@y.zz x@y.z..w@q.r @a.b a@b a@b. a@.b é a.b@c-d.e-f.g", "1.2.3.4.5.6.7.8 1.2.3.300 0001.2.3.255 1.2.3",
          "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111 4012888888881881", "+1 (609) 555-4788 ++1+2345678901 +1",
          "😀 x@y.zz 😀 10.0.0.1", None, "", "a@b.c" * 50, "+49 30 1234567 8.8.8.8 4111111111111111 m@n.oo"]


def test_base_spans_equal_plain_regular_expressions(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string").unionByName(
        spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").where("doc_id % 4 = 1")
        .withColumn("doc_id", F.col("doc_id") + 1000)).withColumn("base", F.lit(1)).withColumn("x", F.lit(2))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.personal_data(docs).collect():
        want = base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text[r.doc_id]
        assert r.n_discovered or r.spans == want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k in pii.KINDS]


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"please write to mail: u{i}@ex{i}.org, now") for i in range(9)]
    rows += [(100 + i, f"order number {i * 7} of the day, or user@host{i}") for i in range(9)]
    rows += [(200, "please write to mail: (bob@intranet) soon"), (201, "to mail: nobody"), (202, "elsewhere bob@intranet")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200].spans == "email:23:35" and got[200].n_discovered == 1 and got[200].n_email == 0
    assert got[202].spans == "email:10:22" and got[201].spans == ""
    assert all(got[100 + i].spans == "" for i in range(9)) and got[0].spans == "email:22:32"


def test_identifiers_with_spaces_and_long_ones_are_discovered(spark):
    rows = [(i, f"you may call phone: +1 609 555 47{i:02}, now") for i in range(20)]
    rows += [(100 + i, f"please write to mail: u{i}@ex{i}.org, now") for i in range(20)]
    long = "b" * 70 + "@intranet"
    rows += [(200, "you may call phone: (017) 555-7713 now"), (201, "you may call phone: 0049 30 1234567."),
             (202, f"please write to mail: {long} now"), (203, "elsewhere (017) 555-7713")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in (200, 201, 202, 203)] == ["phone:20:34", "phone:20:35", "email:22:101", "phone:10:24"]
    assert got[0] == "phone:20:35" and got[100] == "email:22:32"


def test_long_texts_neither_recurse_nor_stall(spark):
    texts = ["a" * 300_000, "a." * 150_000 + "@", "x@" + "a." * 100_000 + "b", "1" * 200_000, "1 " * 100_000,
             "1." * 100_000, "+" + "(" * 200_000, "+1" * 100_000, "@" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert rows[2].spans == f"email:0:{2 + 200_001}" and len(rows) == len(texts)


def test_edges(spark, edge_docs, no_docs):
    rows = pii.personal_data(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r.spans == "" for r in rows)
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.personal_data(no_docs).count() == 0


def numbers(n, share, first):
    """Sixteen-digit numbers of which a share pass the checksum."""
    out = []
    for i in range(n):
        body = f"{first + i * 7919:015d}"
        good = next(d for d in "0123456789" if luhn(body + d))
        out.append(body + (good if i % round(1 / share) == 0 else str((int(good) + 1 + i % 9) % 10)))
    return out


def test_a_shape_shared_with_seeds_is_discovered(spark):
    """Identifiers without a cue before them, as in the given texts: recall by shape, none where seeds are chance."""
    planted = numbers(200, 0.5, 400_000_000_000_000)
    rows = [(i, f"w{i % 37}x y{i % 41}z {m} and so on") for i, m in enumerate(planted)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    unseen = [i for i, m in enumerate(planted) if not luhn(m)]
    found = [i for i in unseen if got[i].n_discovered == 1 and got[i].spans.startswith("card:")]
    assert len(unseen) == 100 and len(found) >= 0.9 * len(unseen)
    chance = numbers(200, 0.1, 500_000_000_000_000)
    rows = [(i, f"order w{i % 37}x y{i % 41}z {m} and so on 12345678 of 2024-01-{i % 28 + 1:02}") for i, m in enumerate(chance)]
    assert all(r.n_discovered == 0 for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_the_graph_against_a_plain_one(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    _, base, unseen = pii.spans(docs)
    edges = {}
    for r in base.collect():
        for p in (r.p, shape(r.m)):
            edges[p, r.k, r.m] = (1.0, True)
    for r in unseen.collect():
        for p in (r.p, shape(r.m)):
            for k in r.ks or [None]:
                seed, own = edges.get((p, k, r.m), (0.0, False))
                edges[p, k, r.m] = (seed, own or r.own)
    edges = {e: v for e, v in edges.items() if e[0]}
    support, size, score = {}, {}, {}
    for (p, k, m), (seed, own) in edges.items():
        if seed:
            support.setdefault((p, k), set()).add(m)
        if own:
            size.setdefault(p, set()).add(m)
    graph = {e: v for e, v in edges.items() if len(support.get(e[:2], ())) >= pii.SUPPORT}
    for _ in range(pii.ROUNDS):
        total = {}
        for (p, k, m), (seed, own) in graph.items():
            total[p, k] = total.get((p, k), 0.0) + own * max(seed, score.get((m, k), 0.0))
        trust = {(p, k): v / (len(size[p]) + pii.SMOOTHING) for (p, k), v in total.items()}
        score = {}
        for (p, k, m), (seed, _) in graph.items():
            if not seed:
                score[m, k] = max(score.get((m, k), 0.0), trust[p, k])
    want = {}
    for (m, k), v in score.items():
        if v >= pii.CONFIDENCE:
            want[m] = min(want.get(m, (1, 9)), (-v, k))
    got = {r.m: r.k for r in pii.discovered(base, unseen).collect()}
    assert got == {m: k for m, (_, k) in want.items()} and got


def shape(m):
    return "\0" + re.sub("[0-9]", "0", re.sub("[A-Za-z]+", "a", m))
