import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fraudlens.llm import token_counts as C
from tests.llm.util import ODD_TEXTS, SF, docs

VOCABULARY = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def counter():
    return C.Counter(VOCABULARY, P.PATTERN)


def spliced(text, edits):
    out, at = [], 0
    for a, r, s in C.normal(edits, len(text)):
        out += [text[at:a], s]
        at = a + r
    return "".join(out) + text[at:]


def check(counter, text, edits):
    tree = C.Tree(*counter.leaves(counter.segments(text)))
    assert tree.total() == len(counter.library.encode_ordinary(text))
    new, spent = C.edit(tree, text, edits, counter)
    assert new == spliced(text, edits)
    assert tree.total() == len(counter.library.encode_ordinary(new)), (text[:80], edits)
    assert tree.chars.sum() == len(new) and tree.total() == tree.tokens.sum()
    assert [list(x) for x in tree.sums] == [list(x) for x in C.sums_over(tree.tokens)]
    assert spent <= len(new)
    return spent


def test_odd_texts(counter):
    for t in ODD_TEXTS:
        t = t or ""
        check(counter, t, [])
        check(counter, t, [(0, 1, "x"), (len(t) // 2, 3, " y z "), (len(t), 0, "'re  \n")])
        check(counter, t, [(None, None, None), (-5, 2, "a"), (10**9, 5, "b"), (0, 10**9, "")])


words = st.sampled_from(["a", "the", " ", "  ", "\n", "it's", "'re", "12", "é", "\t", "word", ".", "Ünï", "-", "日本", " end"])
texts = st.lists(words, max_size=400).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(texts, st.lists(st.tuples(st.integers(0, 1500), st.integers(0, 60), st.lists(words, max_size=6).map("".join)), max_size=6))
def test_any_edits_equal_a_full_count(text, edits):
    check(C.counter_of(VOCABULARY, P.PATTERN), text, edits)


def test_only_a_region_is_encoded_again(counter):
    rng = random.Random(0)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(20000))
    assert check(counter, text, [(60000, 4, "changed"), (200, 0, " new")]) < 3000


def test_query_equals_full_counts(spark, counter):
    from fraudlens.llm.queries import QUERIES
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    edits = {r.doc_id: [tuple(e) for e in r.e] for r in spark.read.parquet(f"{SF}/documents.parquet")
             .select("doc_id", C.sample_edits(F.col("text"), F.col("doc_id")).alias("e")).collect()}
    got = QUERIES["op7_token_counts"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        old, new = rows[r.doc_id], spliced(rows[r.doc_id], edits[r.doc_id])
        assert (r.n_chars, r.edited_n_chars) == (len(old), len(new))
        assert (r.n_tokens, r.edited_n_tokens) == tuple(len(counter.library.encode_ordinary(x)) for x in (old, new))


def test_odd_rows_clashes_gathered_edits_and_empty_table(spark, counter):
    df = docs(spark, ODD_TEXTS).withColumns({c: F.lit("x") for c in ("token_tree", "new_text", "n_tokens", "edits_")})
    edits = spark.createDataFrame([(1, 0, 0, "was empty"), (5, 2, 1, "Z"), (5, 0, 1, "Y"), (0, 3, 3, "was null"), (6, None, None, None)],
                                  "doc_id long, at int, removed int, inserted string")
    rows, tree = C.with_trees(df.join(C.gather_edits(edits), "doc_id", "left"), VOCABULARY, P.PATTERN)
    out, names = C.apply_edits(rows, tree, "edits", VOCABULARY, P.PATTERN)
    by = {e.doc_id: [] for e in edits.collect()}
    for e in edits.collect():
        by[e.doc_id].append((e.at, e.removed, e.inserted))
    for r in out.collect():
        want = spliced(r.text or "", by.get(r.doc_id, []))
        assert r[names[0]] == want and r[names[3]] == len(counter.library.encode_ordinary(want))
    assert C.token_counts_query(df.limit(0), VOCABULARY, P.PATTERN).count() == 0
