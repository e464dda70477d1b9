import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from fraudlens.llm import line_dedup as L
from tests.llm.util import ODD_TEXTS, SF, docs, oracle, same

A, B = "A line that several documents share.", "Another passage, long enough to count"


def brute(rows, min_chars=20, min_docs=3):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))
    held = defaultdict(set)
    for n, (d, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            held[key(x)].add((d, n))
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        top = lambda x: max((e for e, _ in held[x] if e is not None), default=None)
        gone = [len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and top(key(x)) is not None and (d is None or d < top(key(x))) for x in ls]
        kept = "\n".join(x for x, g in zip(ls, gone) if not g)
        out.append((d, len(ls), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows_match_brute_force(spark):
    texts = ODD_TEXTS + [A, f"x\n{A}", f"  {A.upper()} \ny", f"{A}\n{A}\nz", B, f"{B}\r", f"{B} é", "short\nshort", "short", "short"]
    rows = list(enumerate(texts)) + [(None, A), (None, "null id"), (3, A), (3, A), (99, B), (99, B)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in L.line_dedup_query(df).collect()), key=str) == brute(rows)


def test_whole_table_matches_oracle_and_brute_force(spark):
    from fraudlens.llm.queries import ORACLE, QUERIES
    df = QUERIES["op6_line_dedup"](spark, SF)
    same(df, oracle(ORACLE["op6_line_dedup"]))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(rows)


def test_runs_are_levelled_and_compacted(spark):
    rows = [(i, f"{A}\nonly in document number {i:05d}") for i in range(90)]
    keyed = L.keyed_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 20)
    runs = L.LineRuns(spark, fan_out=3)
    for batch in L.batches_of(keyed, 9):
        runs.add(batch)
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    counts = runs.common().collect()
    assert len(counts) == 1 and counts[0].top == 89
    assert counts[0].n_docs < 90  # batches after the key was settled added nothing
    assert runs._read(runs._paths()).count() == 91


def test_clashing_columns_and_empty_table(spark):
    df = docs(spark, [A] * 4).withColumns({c: F.lit("x") for c in ("d", "th", "k1", "lines", "gone__", "kept_text", "n_lines", "pos", "drop_d")})
    out, kept, n, gone = L.clean(df)
    assert {kept, n, gone}.isdisjoint(df.columns)
    assert sorted((r.doc_id, r[kept]) for r in out.collect()) == [(0, ""), (1, ""), (2, ""), (3, A)]
    assert L.line_dedup_query(df.limit(0)).count() == 0
