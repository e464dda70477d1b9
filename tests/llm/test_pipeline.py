"""The stages one by one against brute force, and the whole run."""
import re
from collections import defaultdict

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm import test_line_dedup, test_minhash, test_packing, test_quality
from tests.llm.util import ODD_TEXTS, docs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """(input, output) of every stage on the fixture, each written."""
    out, now = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES:
        after = C.write_table(stage(spark, now, SF), name)
        out[name], now = (now, after), after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(steps):
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "secret_scan", "packing"]
    want = steps["quality_rules"][0].dtypes
    assert all(steps[n][1].dtypes == want for n in list(steps)[:-1])


def test_quality_drops_what_fails_and_keeps_clean_documents(steps, spark):
    before, after = map(rows, steps["quality_rules"])
    clean = _clean(spark)
    assert all(after[d] == before[d] for d in after)
    assert all(test_quality.brute(before[d].text)[-1] or not clean.get(d) for d in before.keys() - after.keys())
    assert not any(test_quality.brute(r.text)[-1] for r in after.values())


def _clean(spark):
    return {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_lines_match_brute_force(steps):
    before, after = map(rows, steps["line_dedup"])
    import hashlib
    want = {d: h for d, _, _, h in test_line_dedup.brute([(d, r.text) for d, r in before.items()])}
    assert {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_near_duplicates_match_brute_force(steps):
    before, after = map(rows, steps["near_duplicates"])
    groups = test_minhash.brute([(d, r.text) for d, r in before.items()], percent=80)
    assert set(after) == {d for d, (_, c) in groups.items() if c == d}
    assert all(after[d] == before[d] for d in after)


def test_secrets_are_masked_and_nothing_else(steps):
    before, after = map(rows, steps["secret_scan"])
    assert set(before) == set(after)
    for d, r in before.items():
        assert after[d].text == re.sub(r'(?i)(token = ")[0-9a-f]{40}"', r'\1[SECRET]"', r.text)
        assert after[d].n_chars == len(after[d].text)


def test_packing_round_trip(steps):
    before, after = steps["packing"]
    texts = [(r.doc_id, r.text) for r in before.collect()]
    assert test_packing.check(texts, after.collect(), Tokenizer.from_file(P.path("word_bpe_49k.json"))) < 0.02


def test_an_id_with_two_texts_loses_only_the_copy(spark):
    one, other = (" ".join(f"{w}{i} of" for i in range(60)) for w in ("first", "second"))
    df = docs(spark, [one, "plain", one]).union(docs(spark, ["", "", other]).where("text != ''"))
    df = df.unionByName(df).unionByName(docs(spark, [other]).withColumn("doc_id", F.lit(None).cast("long")))
    got = C.near_duplicates(spark, df, SF)
    want = [(0, one), (1, "plain"), (2, other), (None, other)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str) and got.columns == df.columns


def test_run_on_odd_rows_and_an_empty_table(spark):
    long = " ".join(f"the word{i} of" for i in range(60))
    texts = ODD_TEXTS + [long, long, long + " more", None]
    df = docs(spark, texts).unionByName(docs(spark, [long]).withColumn("doc_id", F.lit(None).cast("long")))
    df = df.unionByName(df).withColumns({c: F.lit("x") for c in ("kept", "th__", "n_words", "value", "comp", "redacted", "kept_text")})
    for now in (df, df.limit(0)):
        empty = now is not df
        for name, stage in C.STAGES:
            now = C.write_table(stage(spark, now, SF), name)
            if name != "packing":
                assert now.columns == df.columns
            if name == "secret_scan":  # the line of all copies stays in the largest id; nothing else of theirs is left
                texts = {(r.doc_id, r.text) for r in now.collect()}
                assert texts == (set() if empty else {(None, ""), (len(ODD_TEXTS), ""), (len(ODD_TEXTS) + 1, long)})
        ids = defaultdict(int)
        for r in now.collect():
            ids[r.doc_id] += 1
        assert set(ids) == (set() if empty else {None, len(ODD_TEXTS), len(ODD_TEXTS) + 1})
