import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fraudlens.llm import periodic_runs as R
from tests.llm.util import ODD_TEXTS, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, power=4):
    """Every maximal stretch of each period, kept if no smaller period fits."""
    n, out = len(words), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, power * q) and not any(words[s:e - d] == words[s + d:e] for d in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *first, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(kept))


def run(word_lists):
    flat = np.array([w for ws in word_lists for w in ws], dtype=np.int64)
    return R.find_runs(flat, np.array([len(ws) for ws in word_lists], dtype=np.int64))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 9)), max_size=6), min_size=1, max_size=4))
def test_equal_to_brute_force(parts):
    lists = [[w for root, k in doc for w in root * k] for doc in parts]
    assert run(lists) == [brute(ws) for ws in lists]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=160))
def test_two_letters(ws):
    assert run([ws]) == [brute(ws)]


def test_runs_with_runs_inside_at_many_scales():
    rng = np.random.default_rng(5)
    for period in (1, 2, 3, 5, 7, 8, 13, 31, 32, 33, 64, 100):
        for inner in (1, 2, 3, 5):
            root = (list(rng.integers(5, 9, size=max(1, period // 3))) + [1, 2, 3, 4, 5][:inner] * period)[:period]
            ws = [50, 51] + root * 4 + root[:int(rng.integers(0, period))] + [52]
            assert run([ws, ws[3:], []]) == [brute(ws), brute(ws[3:]), []]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_brute_force_on_a_whole_table(spark, sf):
    from fraudlens.llm.queries import QUERIES
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_periodic_runs"](spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {tuple(r) for r in got.collect()}
    want = {expected(r.doc_id, r.text) for r in rows}
    assert got == want and any(r[1] for r in got)


def test_odd_rows_ties_and_an_empty_table(spark):
    texts = ODD_TEXTS + ["a b " * 4 + "x " + "c d " * 4, "a " * 6, "a " * 5, ("p q r " * 5).strip() + " p", "z " * 9 + "y " * 9]
    df = docs(spark, texts)
    df = df.unionByName(df)
    got = sorted((tuple(r) for r in R.periodic_query(df).collect()), key=lambda r: r[0])
    want = sorted([expected(i, t) for i, t in enumerate(texts)] * 2, key=lambda r: r[0])
    assert got == want
    out = {r.doc_id: r for r in R.periodic_runs(docs(spark, texts).withColumnRenamed("lang", "runs")).collect()}
    assert out[len(texts) - 1].collapsed == "z y" and out[0].n_words == 0 and out[0].collapsed == ""
    assert R.periodic_query(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "w " * 8)], "doc_id long, text string")
    r = R.periodic_query(none).first()
    assert r.doc_id is None and r.n_runs == 1


def test_small_batches_and_parts_change_nothing(spark, monkeypatch):
    texts = ODD_TEXTS + ["k l m " * 40, "é " * 3000]
    whole = R.periodic_runs(docs(spark, texts)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, R.periodic_runs(docs(spark, texts), batch_words=10).collect()))
    monkeypatch.setattr(R, "SPLIT_CHARS", 7)
    assert [w for part in R.words_of(texts[-1]) for w in part] == ["é"] * 3000
    for t in texts:
        assert [w for part in R.words_of(t) for w in part] == WORD.findall(t or "")
