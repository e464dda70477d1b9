import random

import numpy as np
from pyspark.sql import functions as F

from fraudlens.llm import minhash as M
from tests.llm.util import ODD_TEXTS, SF, docs


def sets_of(t, words=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, percent=85):
    sets = [sets_of(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        seen = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, both in seen.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                parent[b] = a
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: (len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)}


def got(df):
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect() if r.doc_id is not None)
    return out


def family(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_hash_sets_equal_word_sets():
    for t in [*ODD_TEXTS, "A b C d E f", "a b c d e F a b c d e f", "É é x y z"]:
        assert len(M.shingles(t)) == len(sets_of(t))
    assert np.array_equal(M.shingles("A B c d e"), M.shingles("a b\tC d\ne"))
    assert not np.array_equal(M.shingles("a b"), M.shingles("a b c d e")[:1])


def test_odd_rows_and_families_match_brute_force(spark):
    texts = ODD_TEXTS + family(40, 120, 8, 1) + family(3, 30, 1, 2) + ["A  b c d e f g", "a b C d e f g", "one two", "one two", "ONE two"]
    rows = list(enumerate(texts))
    assert got(M.minhash_query(docs(spark, texts))) == brute(rows)


def test_large_groups_in_small_blocks_match_brute_force(spark):
    texts = family(220, 100, 12, 3) + ["the same text in many rows of the table"] * 60 + family(25, 60, 3, 4)
    df = M.near_duplicates(docs(spark, texts), block_docs=32, block_shingles=3000)
    assert got(df) == brute(list(enumerate(texts)))


def test_whole_table_matches_brute_force(spark):
    from fraudlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op4_minhash_near_dedup"](spark, sf)) == brute(rows)


def test_components_on_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 3), (3, 7), (9, 9)]
    c = {r.node: r.comp for r in M.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert c == {**{i: 100 for i in range(100, 141)}, **{500 + i: 500 for i in range(60)}, 3: 3, 7: 3}


def test_null_ids_repeated_rows_clashes_and_empty_table(spark):
    long = "one two three four five six seven"
    rows = [(None, long), (5, long), (5, long), (2, long), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "sig", "node", "th", "comp", "t", "rep")})
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in M.minhash_query(df).collect()), key=str)
    assert out == sorted([(None, None, True), (5, 2, False), (5, 2, False), (2, 2, True), (9, 9, True), (9, 9, True)], key=str)
    assert M.minhash_query(df.limit(0)).count() == 0


def test_repeated_rows_are_one_member(spark):
    one = " ".join(f"w{i}" for i in range(60))
    df = docs(spark, [one, one + " more"])
    many = df.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(200)))).drop("r")
    out = M.minhash_query(many).collect()
    assert len(out) == 400 and {(r.doc_id, r.component_id, r.kept) for r in out} == {(0, 0, True), (1, 0, False)}
