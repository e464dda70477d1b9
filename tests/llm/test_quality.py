import re
from collections import Counter

from pyspark.sql import functions as F

from fraudlens.llm import quality
from tests.llm.util import ODD_TEXTS, SF, docs, oracle, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    cover = {i + j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover),
            len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_counts_match_brute_force_on_odd_texts(spark):
    texts = ODD_TEXTS + ["a b c d " * 20, "x y z\nx y z\nq x y z", "a b a b a b a", "p q\np q\np q"]
    got = {r.doc_id: r for r in quality.quality_query(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr(t)[:60]
        assert not (r.kept and r.base_failed)


def test_whole_table_matches_oracle_and_brute_force(spark):
    from fraudlens.llm.queries import ORACLE, QUERIES
    df = QUERIES["op2_quality_rules"](spark, SF)
    same(df, oracle(ORACLE["op2_quality_rules"]))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in df.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])


def test_verdict_agrees_with_labels(spark):
    """Of labelled documents that pass the base rules, clean ones stay and junk goes."""
    from fraudlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    j = QUERIES["op2_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in j.where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) == 0


def test_clashing_columns_and_empty_table(spark):
    df = docs(spark, ODD_TEXTS).withColumns({c: F.lit("x") for c in ("m__", "quality", "quality_rules", "kept", "w__")})
    out, names = quality.apply_rules(df)
    assert not set(names.values()) & set(df.columns) and set(df.columns) < set(out.columns)
    assert out.where(F.col("kept") != "x").count() == 0 and out.count() == len(ODD_TEXTS)
    assert quality.quality_query(df.limit(0)).count() == 0


def test_plan_is_native_without_shuffle(spark):
    plan = quality.quality_query(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
