"""Small helpers of the corpus operator tests."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"

#: Texts that every text operator must survive: null, empty, blank, one word,
#: ties and repeated rows, control characters, emoji, a very long text.
ODD_TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "one", "a b c a b c a b c", "tab\tnew\nline\r\nend\x0b\x0c",
    "no break   em é \U0001f600 ok", "\n\n\n", "x" * 5000, "word " * 3000,
    "The cat is on the mat and it was fine. " * 4, "<b>&amp; || ## $$</b> !!!", "\u0000nul ﻿bom",
]


def docs(spark, texts, **more):
    """A documents table of ``texts`` with an extra column and doc ids in order."""
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def oracle(sql, sf=SF):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con.execute(sql).df()


def same(spark_df, pandas_df):
    from scripts.oracle_check import frame_hash
    sp = spark_df.toPandas()
    assert sorted(sp.columns) == sorted(pandas_df.columns)
    assert len(sp) == len(pandas_df)
    h1, r1 = frame_hash(sp)
    h2, r2 = frame_hash(pandas_df)
    assert h1 == h2, (sorted(set(r1) - set(r2))[:3], sorted(set(r2) - set(r1))[:3])
