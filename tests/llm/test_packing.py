import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fraudlens.llm import packing as K
from tests.llm.util import ODD_TEXTS, SF, docs

PATH = P.path("word_bpe_49k.json")
HARD = ["It's WE'LL don't 'SE", "Σίσυφος ΣΊΣΥΦΟΣ É é", "12 345", "<|endoftext|> x<|startoftext|>", "a\x1cb\x85c d", "\U0001f600" * 9]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library, spark):
    texts = ODD_TEXTS + HARD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t, ids in zip(texts, K.Tokenizer(PATH).encode(texts)):
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids


#: Letters whose lower case or normal form ends in a mark or changes its length, marks, signs, digits.
ODD_LETTERS = "abzİıÉéßẞǅΣσſÅŉkKǺ̧̇'.,!?;:%&#*$|-_<>\" \n\t12²½漢\u0250\u0085\u00a0"
CODE = K.Tokenizer(PATH, 20_000)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(alphabet=ODD_LETTERS, max_size=24), max_size=4))
def test_ids_of_odd_letters_equal_the_library(texts):
    library = K.library(PATH)
    for t, ids in zip(texts, CODE.encode(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_remembered_words_stay_within_their_bound(library):
    code = K.Tokenizer(PATH, 40_000)
    for i in range(60):
        texts = [f"always the same words and w{i}x{j} too." for j in range(20)] + ["İ. xİ! Aİ,"]
        for t, ids in zip(texts, code.encode(texts)):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert code.words.bytes < 20_000 + 40 * 200 and len(code.words.older) < 300 and len(code.ends) < 600


def test_words_of_a_large_vocabulary_are_merged_once(library, monkeypatch):
    code, merged = K.Tokenizer(PATH), []
    merges = code.merges
    code.merges = lambda w: merged.append(w) or merges(w)
    letters = "abcdefghijklmnopqrst"
    words = ["".join(letters[i // 20 ** k % 20] for k in range(5)) for i in range(250_000)]
    for _ in range(2):
        for a in range(0, len(words), 20_000):
            text = " ".join(words[a:a + 20_000])
            ids = code.encode([text])[0]
            assert a or ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(merged) == len(words)


def check(rows, pieces, library, window=4096):
    """An exact round trip; returns the share of padding."""
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for d, ps in by_doc.items():
        copies = len(want[d])  # repeated rows have one id, so their pieces can't be told apart
        assert sum(p.length for p in ps) == sum(map(len, want[d]))
        if copies == 1:
            at = 0
            for p in sorted(ps, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(want[d][0])
                assert p.ids_crc32 == zlib.crc32(want[d][0][at:at + p.length].tobytes())
                at += p.length
    pad = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        total += at
        pad += 0 if at & (at - 1) == 0 else window - at
    return pad / max(1, total)


def test_whole_table_round_trip(spark, library):
    from fraudlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert check(rows, QUERIES["op8_packing"](spark, sf).collect(), library) < 0.01


def test_odd_rows_many_partitions_and_empty_table(spark, library):
    texts = ODD_TEXTS + ["long " * 20000]
    df = docs(spark, texts).unionByName(docs(spark, texts[:4])).repartition(7)
    assert check([(r.doc_id, r.text) for r in df.collect()], K.packing_query(df, PATH).collect(), library) < 0.05
    assert K.packing_query(df.limit(0), PATH).count() == 0
    none = spark.createDataFrame([(None, "no id")], "doc_id long, text string")
    assert [r.doc_id for r in K.packing_query(none, PATH).collect()] and K.packing_query(none, PATH).first().doc_id is None


def test_leftovers_are_merged_in_several_groups(spark, library):
    df = docs(spark, ["some words of a text " * (i % 40 + 1) for i in range(300)]).repartition(8)
    pieces = K.pack(df, PATH, group=3).selectExpr("doc_id", "start", "length", "crc32(ids) ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    assert check([(r.doc_id, r.text) for r in df.collect()], pieces, library) < 0.05
    assert len({p.sequence_id >> 32 for p in pieces if p.sequence_id >= 1 << 62}) > 1


def test_bounded_space_and_best_fit():
    p = K.Packer(0, 100, 2, 16)
    for i, n in enumerate((60, 70, 35, 28)):
        p.add(i, 0, np.zeros(n, dtype="<u4"), n)
        assert len(p.open) <= 2
    assert sorted(w[0] for w in p.open) == [2, 5]  # 28 went to the 30 gap, 35 to the 40 gap
    p.add(9, 0, np.zeros(50, dtype="<u4"), 50)  # none fits: the fullest goes, its gap is too small to cut for
    assert sorted(w[0] for w in p.open) == [5, 50] and len(p.out) == 2
