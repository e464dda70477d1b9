"""Operator 5, secret scans: candidates by pattern, false positives removed
by a random forest. Only DataFrame functions and Spark ML are used.

1. ``candidates`` finds words of a whole text that hold a long run of
   key-like characters with a digit or mixed case, or that follow a
   credential word and an assignment. Every match in such a word is a
   candidate: each run (a JWT with its dots is one), each value given behind
   a credential word, and in a word that follows one each value. A name
   before ``=`` or ``:`` does not hide what stands behind it. A candidate
   carries its value, its word's position, what stands before and after it
   in the word and the three words before and two words after (``CONTEXT``
   characters of each, so that a word with many matches stays linear).
2. ``featurize`` measures length, character classes and transitions between
   them, coverage by the corpus dictionary, traces of a path or address, and
   what the neighbouring words say. The dictionary is made of all documents:
   the letter trigrams of words that ``MIN_DOCS`` documents or more hold.
3. ``train`` fits a random forest on labelled findings (``text`` parts and
   ``label``). The query labels by ``labelled_findings``: real candidates
   whose context settles the matter, and variations on them made from hashes
   of the same rows (other key formats and other harmless long words). The
   classes are balanced by a bound of ``TRAIN_ROWS`` rows each, taken in the
   order of a hash; everything else covers all documents.
4. ``scan`` scores every candidate; ``redact`` replaces the secret values
   in the texts, longer ones first, as one may lie in another.

Edge cases: null, empty and blank texts have no candidates. Repeated rows
give repeated findings. A text of any length is read whole. A table without
findings to learn from (or of one class) keeps every candidate that a
credential word names, and an empty table gives an empty result. Extra
columns pass through ``redact`` untouched; internal names are made fresh.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.common import WS, WS_CLASS, fresh, write_table

TRAIN_ROWS, TREES, DEPTH, SEED, MIN_DOCS = 3000, 24, 7, 11, 5
KEYWORD = (r"(?i)(?:^|[^a-z])(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|apikey|access[_-]?key(?:[_-]?id)?|auth(?:orization)?|bearer|"
           r"credentials?|private[_-]?key|client[_-]?secret)[\"']?[^a-z0-9]*$")
NAMED = r"(?i)(?:password|passwd|pwd|passphrase|secret|token|key|auth|bearer|credential)"
RUN = r"[A-Za-z0-9_+/-]{16,}"
VALUE = r"[A-Za-z0-9_+/!@#$%^&*.-]{8,}"
GIVEN = rf"{NAMED}[\"']?[:=][\"']?{VALUE}"
#: ``=`` belongs to a value only if no other value is assigned by it.
PAD = r"(?:={1,2}(?![\"']?[A-Za-z0-9_+/=-]))?"
JWT = r"eyJ[A-Za-z0-9_-]{13,}(?:\.{1,2}[A-Za-z0-9_-]+){1,4}"
#: What each kind of match is; possessive, as Java recurses on other repeated
#: groups. A run ends before a JWT, a given value before ``&name=`` of a URL.
RUNS = rf"{JWT}|(?:[A-Za-df-z0-9_+/-]|e(?!{JWT[1:]})){{16,}}+{PAD}"
GIVENS = (rf"(?<=[:=][\"']?)(?<={NAMED}[\"']?[:=][\"']?)(?:(?:[A-Za-z0-9_+/!@#$%^*.-]|&(?![A-Za-z0-9_.-]+=)){{8,}}+|{VALUE}){PAD}")
VALUES = VALUE + PAD
#: Characters of context on either side; each match but the last of a word
#: has 8 or more, so NEIGHBOURS matches hold them.
CONTEXT, NEIGHBOURS = 256, 32
#: Formats that name themselves.
FORMAT = r"^(?:AKIA|ASIA)[A-Z0-9]{12,}$|^gh[pousr]_[A-Za-z0-9]{20,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk[-_][A-Za-z0-9_-]{16,}$|^eyJ[A-Za-z0-9_-]{13,}(?:\.{1,2}[A-Za-z0-9_-]+){0,4}$"
PARTS = ["value", "inner", "before", "after"]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), pos (word number) and the parts."""
    t = F.col(f"`{text}`")
    some = t.rlike(r"[A-Za-z0-9_+/-]{16,}") | t.rlike(NAMED)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t")).where(some)
    rows = rows.select("doc_id", "th", F.split(F.btrim("t", F.lit(WS)), WS_CLASS + "+").alias("w"))
    near = lambda i: F.array_join(F.array(*[F.coalesce(F.when(i >= k, F.get("w", i - k)), F.lit("")) for k in (3, 2, 1)]), " ")
    long = lambda x: x.rlike(RUN) & (x.rlike("[0-9]") | x.rlike("[a-z][A-Z]"))
    named = lambda x, i: x.rlike(VALUE) & F.concat(near(i), F.lit(" ")).rlike(KEYWORD[:-1] + r"[:=][^a-z0-9]*$")
    found = F.filter(F.transform("w", lambda x, i: F.when(long(x) | x.rlike(GIVEN) | ((F.length(x) >= 8) & named(x, i)), i)), lambda i: i.isNotNull())
    # inline() keeps the search for candidates apart from what is done with them
    rows = rows.withColumn("found", found).select("doc_id", "th", "w", F.inline(F.transform("found", lambda i: F.struct(i.alias("pos")))))
    rows = rows.select("doc_id", "th", "pos", F.get("w", F.col("pos")).alias("word"), named(F.get("w", F.col("pos")), F.col("pos")).alias("named"),
                       F.right(near(F.col("pos")), F.lit(CONTEXT)).alias("before"),
                       F.left(F.concat_ws(" ", F.get("w", F.col("pos") + 1), F.get("w", F.col("pos") + 2)), F.lit(CONTEXT)).alias("behind"))
    # one row for each kind of match: the values, what stands between them, and the values that another kind has
    every = lambda rx: F.regexp_extract_all("word", F.lit(rx), F.lit(0))
    none, bare = F.array().cast("array<string>"), F.transform(every(GIVENS), lambda v: _bare(v, every(RUNS)))
    kind = lambda rx, own: F.struct(every(rx).alias("m"), F.split("word", rx, -1).alias("p"), own.alias("own"))
    kinds = F.array(kind(RUNS, none), kind(GIVENS, every(RUNS)), F.when(F.col("named"), kind(VALUES, F.concat(every(RUNS), bare))))
    rows = rows.select("doc_id", "th", "pos", "before", "behind", F.inline(F.filter(kinds, lambda k: k.isNotNull() & (F.size(k["m"]) > 0))))
    joined = lambda x, y: F.zip_with(x, y, lambda u, v: F.concat(u, v))
    n = F.size("m")
    rows = rows.select("doc_id", "th", "pos", "before", "behind", F.inline(F.array(F.struct(
        "m", "p", "own", joined(F.slice("p", F.lit(1), n), F.col("m")).alias("left"), joined(F.col("m"), F.slice("p", F.lit(2), n)).alias("right")))))

    def match(v: Column, i: Column) -> Column:
        value = _bare(v, F.col("own"))
        left = F.concat(F.array_join(F.slice("left", F.greatest(i - NEIGHBOURS + 1, F.lit(1)), F.least(i, F.lit(NEIGHBOURS))), ""), F.get("p", i))
        right = F.concat(F.substring(v, F.length(value) + 1, F.length(v)), F.get("p", i + 1), F.array_join(F.slice("right", i + 2, F.lit(NEIGHBOURS)), ""))
        return F.when(~F.array_contains("own", value), F.struct(
            value.alias("value"), F.right(left, F.lit(CONTEXT)).alias("inner"), F.left(right, F.lit(CONTEXT)).alias("right")))

    found = F.filter(F.transform("m", match), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "th", "pos", "before", "behind", F.inline(found))
    return rows.select("doc_id", "th", "pos", "value", "inner", "before", F.concat("right", F.lit(" "), "behind").alias("after"))


def _bare(v: Column, own: Column) -> Column:
    """Value ``v`` without the full stops of a sentence if the rest is in ``own``."""
    bare = F.regexp_replace(v, r"\.+$", "")
    return F.when(F.array_contains(own, bare), bare).otherwise(v)


def dictionary(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Letter trigrams of the words that enough documents hold."""
    words = F.array_distinct(F.split(F.lower(F.btrim(F.col(f"`{text}`"), F.lit(WS))), WS_CLASS + "+"))
    common = (docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
              .select(F.regexp_extract("word", r"\p{L}{3,}", 0).alias("word")).where("word != ''"))
    return common.select(F.explode(_trigrams(F.col("word"))).alias("tri")).distinct()


def _trigrams(c: Column) -> Column:
    n = F.length(c)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))).otherwise(
        F.array().cast("array<string>"))


FEATURES = ["length", "digits", "uppers", "lowers", "signs", "distinct", "class_changes", "case_changes", "hex_only", "vowel_changes",
            "covered", "slashes", "dots", "address", "extension", "keyword", "assigned", "quoted", "named_near", "harmless_near", "names", "format"]


def featurize(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` (parts of findings) with a column for each feature."""
    v, before = F.col("value"), F.concat(F.col("before"), F.lit(" "), F.col("inner"))
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    share = lambda rx: F.regexp_count(v, F.lit(rx)) / n
    (row,) = fresh(found, "row")
    # written once: row numbers must be the same in both uses below
    numbered = write_table(found.withColumn(row, F.monotonically_increasing_id()), "findings")
    tri = numbered.select(row, F.explode_outer(_trigrams(F.regexp_replace(F.lower("value"), r"[^\p{L}]+", " "))).alias("tri"))
    tri = tri.join(known.withColumn("known", F.lit(1)), "tri", "left")
    letters = F.col("tri").rlike(r"^\p{L}{3}$")
    cover = tri.groupBy(row).agg((F.sum(F.when(letters, F.coalesce("known", F.lit(0))).otherwise(0)) / F.greatest(F.count("tri"), F.lit(1))).alias("covered"))
    out = numbered.join(cover, row).drop(row)
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return out.withColumns({
        "length": n, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "signs": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "class_changes": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), "case_changes": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "hex_only": flag(v.rlike("^[0-9a-fA-F]+$")), "vowel_changes": share("(?i)[aeiou](?=[bcdfghjklmnpqrstvwxyz])"),
        "slashes": share("/"), "dots": F.regexp_count(F.concat("inner", F.col("value"), F.col("after")), F.lit(r"\.")).cast("double"),
        "address": flag(before.rlike(r"(?i)(?:https?:|www\.|file:|/[a-z]+/)\S*$")), "extension": flag(F.col("after").rlike(r"^\.[a-z]{2,4}\b")),
        "keyword": flag(before.rlike(KEYWORD)), "assigned": flag(before.rlike(r"[:=]\s*[\"']?$")), "quoted": flag(before.rlike("[\"']$")),
        "named_near": flag(before.rlike(NAMED)), "harmless_near": flag(before.rlike(r"(?i)\b(?:commit|sha\d*|md5|checksum|hash|uuid|id|version|revision|order|card|isbn)\W*$")),
        "names": flag(F.col("after").rlike(r"^[\"']?[:=][\"']?[A-Za-z0-9_+/$-]")), "format": flag(v.rlike(FORMAT)),
    })


def labelled_findings(found: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Parts and ``label`` of findings that can be told for certain, and of
    variations made from hashes of the same rows; at most ``rows`` of each
    class and origin, in the order of a hash."""
    h = F.xxhash64("doc_id", "th", "pos", *PARTS)
    base = found.select(*PARTS, h.alias("h"))
    at = F.concat(F.col("before"), F.lit(" "), F.col("inner"))
    random = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (F.regexp_count("value", F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")) >= 3)
    label = F.when((at.rlike(KEYWORD) & random) | F.col("value").rlike(FORMAT), 1).when(~at.rlike(NAMED) & ~random, 0)
    real = base.withColumn("label", label).where("label is not null")
    pick = lambda df: df.orderBy("h").limit(rows).drop("h")
    hexes = F.sha2(F.col("h").cast("string"), 512)
    code = lambda a, n: F.substring(F.translate(F.base64(F.unhex(hexes)), "+/", "Qz"), a, n)
    signed = F.substring(F.base64(F.unhex(hexes)), 5, 40)
    upper = F.upper(F.translate(F.substring(F.base64(F.unhex(hexes)), 5, 16), "+/", "7K"))
    word = F.regexp_extract("before", r"\p{L}{4,}", 0)
    made = [  # (label, before, inner, value, after)
        (1, "token =", '"', F.substring(hexes, 1, 40), '"'), (1, "the password:", "", code(3, 14), ""), (1, "aws access_key_id =", "", F.concat(F.lit("AKIA"), upper), ""),
        (1, "export", "GITHUB_TOKEN=", F.concat(F.lit("ghp_"), code(1, 36)), ""), (1, "Authorization: Bearer", "", F.concat(F.lit("eyJ"), code(1, 44)), ""),
        (1, "const", 'api_key="', F.substring(hexes, 9, 32), '"'), (1, "client", "secret: '", code(7, 40), "'"), (1, "see", "", F.concat(F.lit("ghp_"), code(2, 36)), ""),
        (1, "", "", F.concat(F.lit("gho_"), F.substring(hexes, 3, 36)), ""), (1, "it is", "", F.concat(F.lit("sk-"), code(4, 40)), "."),
        (1, "from", "", F.concat(F.lit("xoxb-"), F.substring(F.regexp_replace(hexes, "[a-f]", ""), 1, 12), F.lit("-"), code(5, 24)), ""),
        (1, "export", "AWS_SECRET_ACCESS_KEY=", signed, ""), (1, "", "AWS_ACCESS_KEY_ID=", F.concat(F.lit("AKIA"), upper), ""),
        (1, "see", "https://api.example.com/v1/resources/list?token=", F.substring(hexes, 5, 32), ""), (1, "", '{"id":1,"secret":"', signed, '","n":2}'),
        (1, "cookie", "", F.concat(F.lit("eyJ"), code(1, 30), F.lit(".eyJ"), code(9, 50), F.lit("."), code(3, 43)), ""),
        (0, "export", "", F.concat(F.upper(word), F.lit("_SECRET_ACCESS_KEY")), F.concat(F.lit("="), signed)),
        (0, "", "", F.concat(F.upper(word), F.lit("_ACCESS_KEY_ID2")), F.concat(F.lit("="), upper)),
        (0, "see", "https://api.example.", F.concat(F.lit("com/v1/"), word, F.lit("/list")), F.concat(F.lit("?token="), F.substring(hexes, 5, 32))),
        (0, "see", "https://api.example.com/v1/resources/list?version=", F.substring(hexes, 5, 32), ""),
        (0, "in commit", "", F.substring(hexes, 1, 40), ""), (0, "from https://cdn.example.com/assets/", "https://cdn.example.com/assets/", F.substring(hexes, 1, 32), ".js"),
        (0, "with", "sha256:", F.substring(hexes, 1, 64), ""), (0, "order number", "", F.substring(F.regexp_replace(hexes, "[a-f]", ""), 1, 16), ""),
        (0, "the uuid", "", F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), ""),
        (0, "open", "", F.concat(F.lit("/usr/share/"), word, F.lit("/lib/"), word, F.lit("-2")), ".so"),
        (0, "token =", '"', F.concat_ws("_", F.lit("your"), word, word, F.lit("here1")), '"'), (0, "call", "", F.concat(word, F.lit("Settings"), F.initcap(word), F.lit("ById2")), "(x)"),
    ]
    options = F.array(*[F.struct(F.lit(y).alias("label"), F.lit(b).alias("before"), F.lit(i).alias("inner"), val.alias("value"), F.lit(a).alias("after"))
                        for y, b, i, val, a in made])
    varied = pick(base).withColumn("h", F.xxhash64(*PARTS)).select("h", F.inline(options)).where(F.length("value") >= 8)
    out = pick(varied.where("label = 1")).unionByName(pick(varied.where("label = 0")))
    return out.unionByName(pick(real.where("label = 1"))).unionByName(pick(real.where("label = 0"))).select(*PARTS, "label")


def train(labelled: DataFrame, known: DataFrame):
    """A random forest over ``FEATURES``; None if there is one class at most."""
    rows = write_table(featurize(labelled, known), "training-rows")
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    forest = RandomForestClassifier(labelCol="label", featuresCol="f", numTrees=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="f").transform(rows))


def score(found: DataFrame, known: DataFrame, model) -> DataFrame:
    """``found`` with ``probability`` and ``is_secret``."""
    rows = featurize(found, known)
    if model is None:
        rows = rows.withColumn("probability", F.col("keyword"))
    else:
        rows = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="f").transform(rows))
        rows = rows.withColumn("probability", F.get(vector_to_array("probability"), 1))
    return rows.select(*found.columns, "probability", (F.col("probability") >= 0.5).alias("is_secret"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """All candidates of ``docs``, scored by a forest trained on ``labelled``
    findings (by default those of the documents themselves)."""
    found = write_table(candidates(docs, doc_id, text), "candidates")
    known = write_table(dictionary(docs, text), "dictionary")
    return score(found, known, train(labelled_findings(found) if labelled is None else labelled, known))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> tuple[DataFrame, str]:
    """``docs`` with each text's secret values replaced by ``mark``; returns
    it and the new column's name. Only texts with a secret are changed."""
    secret = write_table(scan(docs, doc_id, text).where("is_secret").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("value"), lambda a, b: F.length(b) - F.length(a)).alias("values")), "secrets")
    d, th, sd, sth, values = fresh(docs, "d__", "th__", "sd__", "sth__", "values__")
    (out,) = fresh(docs, "redacted")
    own = docs.withColumns({d: F.col(f"`{doc_id}`").cast("long"), th: F.xxhash64(F.col(f"`{text}`"))})
    secret = secret.select(F.col("doc_id").alias(sd), F.col("th").alias(sth), F.col("values").alias(values))
    joined = own.join(secret, F.col(d).eqNullSafe(F.col(sd)) & (F.col(th) == F.col(sth)), "left")
    clean = F.when(F.col(values).isNull(), F.col(f"`{text}`")).otherwise(
        F.aggregate(values, F.col(f"`{text}`"), lambda acc, x: F.replace(acc, x, F.lit(mark))))
    return joined.withColumn(out, clean).drop(d, th, sd, sth, values), out


def secrets_query(docs: DataFrame) -> DataFrame:
    """All findings with the forest's verdict; values only as their hash."""
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", F.col("pos").cast("long").alias("word"), F.length("value").cast("long").alias("value_chars"),
        F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "is_secret")
