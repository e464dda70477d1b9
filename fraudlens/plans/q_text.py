"""Registered queries: text (E1-E5) and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlens.operators import text
from fraudlens.plans.registry import query
from fraudlens.sources import adapters


@query("token_ids", f"""
SELECT doc_id, CAST(i AS INTEGER) - 1 AS pos,
       (CAST(('0x' || substring(md5(tok), 1, 8)) AS BIGINT) % {text.DEFAULT_VOCAB}) + 1 AS token_id
FROM (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM (
        SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS toks FROM documents))""")
def token_ids(spark, sf_dir):
    """Hashed token ids of every whole document, long form (doc, pos, id)."""
    d = adapters.load_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(text.token_ids("text")).alias("pos", "token_id"))


@query("embed_semantic")
def embed_semantic(spark, sf_dir):
    """E3 (E2, U2): 64-dim semantic vector of every document (hashed
    TF-IDF, L2, seeded projection)."""
    d = adapters.load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.semantic_embedding(d, "text", dim=64).select("doc_id", "semantic")


@query("embed_learned")
def embed_learned(spark, sf_dir):
    """E3 by learned word vectors (PPMI of co-occurrences, randomised SVD)."""
    d = adapters.load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.learned_embedding(d, "text", dim=64).select("doc_id", "semantic")


@query("cooccurrence", f"""
WITH toks AS (SELECT doc_id, i, (CAST(('0x' || substring(md5(tok), 1, 8)) AS BIGINT) % {text.LEARNED_VOCAB}) + 1 AS id
  FROM (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (
        SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM documents))),
p AS (SELECT a.id AS i, b.id AS j FROM toks a JOIN toks b ON a.doc_id = b.doc_id AND b.i - a.i BETWEEN 1 AND 5)
SELECT i, j, CAST(count(*) AS BIGINT) AS n FROM (SELECT i, j FROM p UNION ALL SELECT j AS i, i AS j FROM p) GROUP BY i, j""")
def cooccurrence(spark, sf_dir):
    """Co-occurrence counts of hashed words within five places, over whole texts."""
    d = text.spread(adapters.load_table(spark, sf_dir, "documents").select("text"), 4096).select(text.token_ids("text", text.LEARNED_VOCAB).alias("ids"))
    return text.cooccurrence(d, "ids")


@query("embed_ngram_cnn")
def embed_ngram_cnn(spark, sf_dir):
    """E4 (U3): 300-dim n-gram CNN vector of every document's whole text."""
    d = adapters.load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.cnn_embedding(d, "text").select("doc_id", "cnn")


@query("projection_2d")
def projection_2d(spark, sf_dir):
    """E5: 2-D principal-component projection of the embeddings with labels."""
    e = adapters.load_table(spark, sf_dir, "embeddings")
    e = e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return text.projection_2d(e, "vec_id", "v", "label")


@query("batch_encode", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS blanks,
       CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS line_ends FROM documents""")
def batch_encode(spark, sf_dir):
    """A plugged-in encoder (three counts as a vector) over
    batches of 500 whole texts."""
    import numpy as np

    def make():
        return lambda texts: np.array([[len(t), t.count(" "), t.count("\n")] for t in texts], dtype=np.float32)

    d = adapters.load_table(spark, sf_dir, "documents").select("doc_id", "text")
    v = text.batch_encode(d, "text", make, 3, batch_size=500, out="v")
    return v.select("doc_id", *[F.col("v")[i].cast("long").alias(c) for i, c in enumerate(("chars", "blanks", "line_ends"))])


def _sink_folder(spark, name: str) -> str:
    import uuid
    from fraudlens.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sinks/{name}-{uuid.uuid4().hex}"


_TOTAL = "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6)"


@query("embedding_sinks", f"""
SELECT 'parquet' AS fmt, vec_id, label, CAST(len(embedding) AS INTEGER) AS width, {_TOTAL} AS total FROM embeddings
UNION ALL SELECT 'csv', vec_id, label, CAST(len(embedding) AS INTEGER), {_TOTAL} FROM embeddings""")
def embedding_sinks(spark, sf_dir):
    """All embeddings written as Parquet and as CSV, and read back."""
    from fraudlens.sources import sinks
    e = adapters.load_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    out = None
    for fmt in ("parquet", "csv"):
        path = _sink_folder(spark, f"embeddings-{fmt}")
        sinks.write_embeddings(e, path, fmt)
        if fmt == "parquet":
            back = spark.read.parquet(path)
        else:
            ddl = ", ".join(f"{c} {'string' if c == 'embedding' else t}" for c, t in e.dtypes)
            back = spark.read.schema(ddl).option("header", "true").option("escape", '"').csv(path)
            back = back.withColumn("embedding", F.from_json("embedding", "array<float>"))
        total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
        back = back.select(F.lit(fmt).alias("fmt"), "vec_id", "label", F.size("embedding").alias("width"), total.alias("total"))
        out = back if out is None else out.unionByName(back)
    return out


@query("feature_matrix_sink", """
SELECT vec_id, label, CAST(i AS INTEGER) - 1 AS slot, round(CAST(v AS DOUBLE), 6) AS value FROM (
  SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)""")
def feature_matrix_sink(spark, sf_dir):
    """A feature matrix written as CSV with a column per slot, and read back."""
    from fraudlens.sources import sinks
    e = adapters.load_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))
    path = _sink_folder(spark, "matrix")
    sinks.write_feature_matrix(e, path, "vec_id", "label", fmt="csv")
    back = spark.read.option("header", "true").csv(path)
    slots = [c for c in back.columns if c.isdigit()]
    label_type = dict(e.dtypes)["label"]
    return back.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast(label_type).alias("label"),
                       F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in slots])).alias("slot", "value"))
