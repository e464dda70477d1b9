import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fraudlens.llm import bloom_sketch as B
from tests.llm.util import ODD_TEXTS, docs

PIECE = re.compile(B.PIECE)


def pieces(text):
    out = PIECE.findall(text)
    assert "".join(out) == text
    return set(out)


def like(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """By id: (n_chars, sha of the edited text, near_edited, near_next)."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        k = len(t) // 2
        edited = t[:len(t) - k] + nxt[:k]
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), like(t, edited), like(t, nxt))
    return out


def check(got, rows):
    want = expected(rows)
    assert len(got) == len(rows)
    for r in got:
        n, sha, edited, nxt = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(edited, abs=1e-12) and r.near_next == pytest.approx(nxt, abs=1e-12)


def test_query_equals_brute_force_on_a_whole_table(spark):
    from fraudlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_bloom_sketch"](spark, sf).collect()
    check(got, rows)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)


def test_odd_rows_long_texts_and_many_slices(spark, monkeypatch):
    long = "".join(f"Line number {i} of many.\n" for i in range(9000))
    texts = ODD_TEXTS + [long, long.replace("7", "seven"), long + "more", "no line end " * 3000, "no line end " * 3000]
    df = docs(spark, texts).withColumns({c: F.lit("x") for c in ("a", "e", "row", "found", "_key")})
    rows = list(enumerate(texts))
    check(B.fingerprints_query(df).collect(), rows)
    monkeypatch.setattr(B, "LEAST_ROWS", 2)
    monkeypatch.setattr(B, "SAMPLES", 1)
    assert len(B._bounds(df.select(F.col("doc_id").cast("string").alias("key")), "key")) > 3
    check(B.fingerprints_query(df.repartition(5)).collect(), rows)
    assert B.fingerprints_query(df.limit(0)).count() == 0
    one = B.fingerprints_query(df.where("doc_id = 13")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_repeated_rows_and_ids(spark):
    df = docs(spark, ["same text", "other words"])
    got = B.fingerprints_query(df.unionByName(df)).collect()
    assert sorted((r.doc_id, r.near_next) for r in got) == [(0, 0.0), (0, 1.0), (1, 0.0), (1, 1.0)]
    none = spark.createDataFrame([(None, "x"), (None, None), (5, "y")], "doc_id long, text string")
    assert sorted(B.fingerprints_query(none).collect(), key=str) and B.fingerprints_query(none).count() == 3


def test_next_documents_follow_the_ids_over_slices(spark, monkeypatch):
    monkeypatch.setattr(B, "LEAST_ROWS", 3)
    monkeypatch.setattr(B, "SAMPLES", 1)
    ids = [(i * 7919) % 1009 - 500 for i in range(300)]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, t string").repartition(7)
    got = {r.doc_id: r.follows.t for r in B.with_next(rows, "doc_id", "t", ["t"], "follows").collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(down, down[1:] + down[:1])}


def test_differences_are_recovered_exactly(spark):
    sets = [(0, [], []), (1, [5], []), (2, list(range(40)), list(range(20, 60))), (3, list(range(100)), list(range(1, 101))),
            (4, list(range(3000)), list(range(3000))), (5, list(range(3000)), list(range(5, 3005)))]
    df = spark.createDataFrame(sets, "pair int, a array<long>, b array<long>")
    h = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    df = df.select("pair", h("a").alias("a"), h("b").alias("b")).cache()
    want = {r.pair: (set(r.a) - set(r.b), set(r.b) - set(r.a)) for r in df.collect()}
    got = df.withColumns({"sa": B.sketch(F.col("a")), "sb": B.sketch(F.col("b"))}).withColumn("r", B.difference(*map(F.col, ("a", "b", "sa", "sb")))).collect()
    assert sum(r.r.ok for r in got) >= 5  # the first table is enough for few differences in many digests
    for r in got:
        if r.r.ok:
            assert (set(r.r.a), set(r.r.b)) == want[r.pair] and len(r.r.a) + len(r.r.b) == sum(map(len, want[r.pair]))
    far = spark.createDataFrame([(9, list(range(2000)), list(range(1000, 5000)))], "pair int, a array<long>, b array<long>").select("pair", h("a").alias("a"), h("b").alias("b"))
    one, r = far.first(), B.solve(far).first()
    assert (set(r.a), set(r.b)) == (set(one.a) - set(one.b), set(one.b) - set(one.a)) and len(r.a) == 1000 and len(r.b) == 3000


def test_main_path_is_native(spark):
    plan = B.fingerprints_query(docs(spark, ["a\nb", "c"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
