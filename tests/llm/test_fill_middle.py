import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fraudlens.llm import fill_middle as M
from tests.llm.util import ODD_TEXTS, docs, oracle, same

MARKED = ["a <P> b\nc", "<M>", "x\n<S", "<", "<<P", ">\n<\nP>\n", "é\nüü\n\nñ", "\n", "a\n" * 50, "tail\nno end"]


def numbers(doc_id):
    k = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(k[i:i + 8], 16) for i in range(0, 32, 8)]


def brute(doc_id, text, h=None, fim=100, spm=50):
    """(n, form, prefix chars, middle chars, output) by plain strings."""
    h, text = h or numbers(doc_id), text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def arrays(texts, hs, fim=100, spm=50):
    data, offsets = M.flat(pa.array(texts, pa.string()))
    n, form, c1, c2 = M.cut(data, offsets, np.array(hs, dtype=np.int64).reshape(-1, 4), fim, spm)
    out, ends = M.scatter(data, offsets, form, c1, c2)
    back = M.strings(*M.gather(out, ends, form)).to_pylist()
    return n.tolist(), M.FORMS[form].tolist(), M.strings(out, ends).to_pylist(), back


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a\n<PSM>é\U0001f600", max_size=14), st.tuples(*[st.integers(0, 2**32 - 1)] * 4)), max_size=6),
       st.sampled_from([0, 40, 100]), st.integers(1, 9))
def test_equal_to_plain_strings_and_back(rows, fim, block):
    was, M.BLOCK = M.BLOCK, block
    try:
        n, form, out, back = arrays([t for t, _ in rows], [h for _, h in rows], fim)
    finally:
        M.BLOCK = was
    want = [brute(0, t, list(h), fim) for t, h in rows]
    assert [(a, b, c) for a, b, c in zip(n, form, out)] == [(w[0], w[1], w[4]) for w in want]
    assert back == [t for t, _ in rows]


def test_query_equals_sql_on_a_whole_table(spark):
    from fraudlens.llm.queries import ORACLE, QUERIES
    sf = "/root/testdata/sf0.01"
    same(QUERIES["op12_fill_middle"](spark, sf), oracle(ORACLE["op12_fill_middle"], sf))


@pytest.mark.parametrize("part, block", [(M.PART_BYTES, M.BLOCK), (64, 1000)])
def test_odd_rows_and_an_empty_table(spark, monkeypatch, part, block):
    monkeypatch.setattr(M, "PART_BYTES", part)
    monkeypatch.setattr(M, "BLOCK", block)
    texts = ODD_TEXTS + MARKED + ["line\n" * 40000]
    df = docs(spark, texts).withColumns({c: F.lit("x") for c in ("output", "form", "h0")})
    df = df.unionByName(df)
    got = sorted((tuple(r) for r in M.restore(M.fill_middle(df)).collect()), key=lambda r: r[0])
    assert got == sorted([(i, *brute(i, t), t or "") for i, t in enumerate(texts)] * 2, key=lambda r: r[0])
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert M.fill_middle_query(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "a\nb\nc")], "doc_id long, text string")
    assert tuple(M.restore(M.fill_middle(none)).first()) == (None, *brute(None, "a\nb\nc"), "a\nb\nc")


def test_sliced_arrow_columns():
    c = pa.array(["skip", "a\nb", "", "c"], pa.string()).slice(1)
    assert M.flat(c)[0].tobytes() == b"a\nbc" and M.flat(c)[1].tolist() == [0, 3, 3, 4]
    assert M.flat(c.cast(pa.large_string()))[0].tobytes() == b"a\nbc"
    with pytest.raises(ValueError):
        M.gather(np.frombuffer(b"<P>a<S>b", np.uint8), np.array([0, 8]), np.array([M.PSM]))
