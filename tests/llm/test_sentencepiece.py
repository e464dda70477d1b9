import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from fraudlens.llm import sentencepiece_codec as S
from tests.llm.util import ODD_TEXTS, SF, docs

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


HARD = ["aaaaaaaaaaaaaaaaaaaaaaa", "ababababab" * 30, "   lead  and   trail   ", "▁ literal ▁▁x", "日本語のテキスト" * 40,
        "xx\nyy\n\n zz", "é" * 200, "_" * 150 + "=" * 333, "https://example.com/a?b=c&d=" + "%20" * 60, "\U0001f600\U0001f601 ok"]


def test_segments_equal_the_library(sp):
    c = S.Codec(MODEL)
    texts = [t for t in ODD_TEXTS + HARD if t is not None]
    for t, ids in zip(texts, c.encode(texts)):
        assert ids.tolist() == sp.encode(t), repr(t)[:80]
        assert c.decode(ids) == sp.decode(ids.tolist())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abet \n.1▁é"), st.characters(exclude_categories=["Cs"])), max_size=120), max_size=5))
def test_any_text_equals_the_library(texts):
    sp, c = sentencepiece.SentencePieceProcessor(model_file=MODEL), S.codec(MODEL)
    for t, ids in zip(texts, c.encode(texts)):
        assert ids.tolist() == sp.encode(t)


def test_decode_of_any_ids(sp):
    c, rng = S.codec(MODEL), np.random.default_rng(0)
    for _ in range(300):
        ids = rng.integers(1, 700, size=rng.integers(0, 30)).tolist()
        assert c.decode(ids) == sp.decode(ids)


def test_query_on_whole_table_and_odd_rows(spark, sp):
    from fraudlens.llm.queries import QUERIES
    own = docs(spark, ODD_TEXTS)
    for df, got in ((spark.read.parquet(f"{SF}/documents.parquet"), QUERIES["op10_sentencepiece"](spark, SF)),
                    (own, S.sentencepiece_query(own, MODEL)), (own.limit(0), S.sentencepiece_query(own.limit(0), MODEL))):
        want = {}
        for r in df.collect():
            ids = sp.encode(r.text or "")
            want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                              hashlib.sha256(sp.decode(ids).encode()).hexdigest())
        assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
