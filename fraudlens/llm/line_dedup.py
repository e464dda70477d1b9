"""Operator 6, line deduplication over levelled sorted runs of line hashes.

``LineRuns`` is an index of line keys on shared storage. A run is a parquet
table sorted by key: per key the number of documents that hold it and the
largest document id. A new batch of documents is reduced to such a run
(combined map-side first), merge-anti-joined with the runs already there,
which takes out the keys that they have settled, and added at level 0. When
a level holds ``fan_out`` runs they are merged into one run of the next
level, so a key is rewritten once per level and not once per batch.

The rule: a key of at least ``min_chars`` code points found in at least
``min_docs`` documents stays only in the largest document id that holds it.
A run has settled a key for a batch when it counts ``min_docs`` documents
and knows a document id at least as large as any of the batch; more batches
cannot change what the rule says then. Batches that come in descending order
of document id thus add each common line to the runs once.

``clean`` joins the keyed lines with the merged runs. Only (document,
position) pairs of dropped lines are shuffled back to the texts. The runs
are written tables, so both sides of that join have their own exchange and
Spark can split the partition of a very common line.

A key is the line stripped of ASCII white space with A-Z in lower case,
represented by two 64-bit hashes with different seeds.

Edge cases: a null or empty text is one empty line. Repeated rows count as
one document each, and the rows of the largest document id all keep the
line. A row without document id counts as a document below all others; if no
holder has an id, the line stays everywhere. An empty table gives an empty
result. Columns other than document id and text pass through untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.llm.common import WS, ascii_lower, fresh, write_table
from fraudlens.session import ensure_checkpoint_dir

MIN_CHARS, MIN_DOCS, FAN_OUT, BATCHES = 20, 3, 3, 4
RUN = "k1 bigint, k2 bigint, n_docs bigint, top bigint"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """Per document (id, hash of the text) the positions and key hashes of
    its lines that are long enough."""
    key = lambda x: ascii_lower(F.btrim(x, F.lit(WS)))
    numbered = F.transform(lines_of(F.col(f"`{text}`")), lambda x, i: F.struct(i.alias("pos"), key(x).alias("key")))
    long = F.filter(numbered, lambda x: F.length(x["key"]) >= min_chars)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.transform(
        long, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("k1"),
                                 F.xxhash64(F.lit(7), x["key"]).alias("k2"))).alias("lines"))


class LineRuns:
    """The levelled runs, under one folder of the shared checkpoint space."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fan_out: int = FAN_OUT):
        self.spark, self.min_docs, self.fan_out = spark, min_docs, fan_out
        self.home = f"{ensure_checkpoint_dir(spark).rstrip('/')}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame) -> str:
        path = f"{self.home}/{uuid.uuid4().hex}"
        df.select("k1", "k2", "n_docs", "top").sortWithinPartitions("k1", "k2").write.parquet(path)
        return path

    def _paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths)

    def _merged(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("top").alias("top"))

    def add(self, keyed: DataFrame) -> None:
        """Add the run of a batch of ``keyed_lines``, less what is settled."""
        pairs = F.array_distinct(F.transform("lines", lambda x: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"))))
        run = (keyed.select("d", F.explode(pairs).alias("k")).groupBy("k.k1", "k.k2")
               .agg(F.count(F.lit(1)).alias("n_docs"), F.max("d").alias("top")))
        if self._paths():
            settled = (self._read(self._paths()).where(F.col("n_docs") >= self.min_docs)
                       .select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.col("top").alias("s_top")))
            run = run.hint("merge").join(settled, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))
                                         & (F.col("s_top") >= F.coalesce("top", "s_top")), "left_anti")
        self._push(0, self._write(run))

    def _push(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fan_out:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(self._merged(full)))

    def common(self) -> DataFrame:
        """The keys that ``min_docs`` documents or more hold, written once."""
        paths = self._paths()
        if not paths:
            return self.spark.createDataFrame([], RUN)
        return write_table(self._merged(paths).where((F.col("n_docs") >= self.min_docs) & F.col("top").isNotNull()), "common-lines")


def batches_of(keyed: DataFrame, n: int) -> list[DataFrame]:
    """``n`` batches of about equal row counts, largest document ids first."""
    cuts = keyed.approxQuantile("d", [i / n for i in range(1, n)], 0.01) if n > 1 else []
    cuts = sorted({int(c) for c in cuts}, reverse=True)
    out, above = [], F.lit(True)
    for c in cuts:
        out.append(keyed.where(above & (F.col("d") >= c)))
        above = F.col("d") < c
    return [*out, keyed.where(above | F.col("d").isNull())]


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
          min_docs: int = MIN_DOCS, n_batches: int = BATCHES) -> tuple[DataFrame, str, str, str]:
    """``docs`` with each whole text after line deduplication, its lines
    before it, and how many of them went. Returns the three columns' names."""
    keyed = write_table(keyed_lines(docs, doc_id, text, min_chars), "keyed-lines")
    runs = LineRuns(docs.sparkSession, min_docs)
    for batch in batches_of(keyed, n_batches):
        runs.add(batch)
    common = runs.common()
    each = keyed.select("d", "th", F.inline("lines"))
    dropped = (each.join(common, ["k1", "k2"])
               .where((F.col("top") > F.col("d")) | F.col("d").isNull())
               .groupBy("d", "th").agg(F.collect_set("pos").alias("gone")))
    d, th, gone, lines, drop_d, drop_th = fresh(docs, "d__", "th__", "gone__", "lines__", "drop_d__", "drop_th__")
    out, n_lines, n_dropped = fresh(docs, "kept_text", "n_lines", "n_dropped")
    own = docs.withColumns({d: F.col(f"`{doc_id}`").cast("long"), th: F.xxhash64(F.col(f"`{text}`"))})
    dropped = dropped.select(F.col("d").alias(drop_d), F.col("th").alias(drop_th), F.col("gone").alias(gone))
    joined = own.join(dropped, F.col(d).eqNullSafe(F.col(drop_d)) & (F.col(th) == F.col(drop_th)), "left")
    joined = joined.withColumn(lines, lines_of(F.col(f"`{text}`")))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(gone).isNull(), F.coalesce(F.col(f"`{text}`"), F.lit(""))).otherwise(F.array_join(stay, "\n")).alias(out),
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_dropped),
    ), out, n_lines, n_dropped


def line_dedup_query(docs: DataFrame) -> DataFrame:
    """Contract of ``op6``."""
    out, kept, n_lines, n_dropped = clean(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"),
                      F.sha2(F.col(kept), 256).alias("kept_sha256"))


def oracle_sql(min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> str:
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM t),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT rid) >= {min_docs}),
m AS (SELECT rid, doc_id, pos, line, (c.top IS NOT NULL AND (doc_id IS NULL OR doc_id < c.top)) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
