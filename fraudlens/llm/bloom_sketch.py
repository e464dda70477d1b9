"""Operator 13, document fingerprints by invertible Bloom lookup sketches.
Only DataFrame functions are used.

1. ``digests`` cuts a whole text into paragraphs and hashes each to 64 bits.
   A paragraph is a line; a longer one than ``PIECE_CHARS`` characters is cut
   behind the last sentence that fits (in a longer sentence: where it is
   full), so a text without line ends has paragraphs too. The pieces are the
   text, end to end. A fingerprint is of the set of different ones.
2. ``sketch`` puts every digest into one cell of each of ``HASHES`` rows, by bits of its own. A cell holds how many digests it has,
   their exclusive or, and that of their check hashes. ``fingerprint`` writes
   the cells as text.
3. ``subtract`` takes one sketch from another cell by cell, and ``peel``
   recovers digests: a cell whose count is 1 or -1 and whose check fits holds
   one digest that only one side has; it is taken out of its other cells,
   until no such cell is left. If all cells are empty then, the differing
   digests of both sides are known.
4. If not, ``larger`` tries again with a table for every ``TABLE_DIGESTS``
   digests, over which the digests are dealt; a table that fails is tried
   with other bits.
5. ``solve`` goes on for the pairs that are still open, those of very long
   texts above all: their digests are dealt by Spark over as many groups as
   they need, and each group is a pair of its own, finer with every round.

Likeness of two fingerprints is the number of common digests by that of all
different ones: with the recovered differences, ``(|A| - a) / (|A| + b)``.

``with_next`` gives each document the one that follows by descending id
(the last one: the first). Rows are dealt over slices of the id order, whose
bounds are ids of a hash sample; the highest row of a slice is also sent to
the slice above it, so one shuffle is enough and no slice grows with the
table. (Bounds on the driver: one key of 33 characters a slice, as in
Spark's own range partitioner.)

Edge cases: a null text is an empty one; it has no paragraphs, and two such
texts have likeness 1. A single document follows itself. Repeated ids are
ordered by a hash of their texts, rows with a null id come last (as the lowest
ids). Texts of any length are read whole. An empty table gives an empty
result. Only the id and the text are read, so other columns and their names
do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.llm.common import write_table

PIECE_CHARS = 160
PIECE = rf"[^\n]{{0,{PIECE_CHARS - 1}}}(?:\n|[.!?](?= ))|[^\n]{{1,{PIECE_CHARS}}}"
#: Rows of cells; a row of the sketch and of a larger try's table has ``2 ** bits`` cells.
HASHES, SKETCH_BITS, TABLE_BITS = 3, 3, 3
ROUNDS = 16
#: First bit of the cells of the sketch, and of each try of a larger table.
SKETCH_BIT, RETRY_BITS = 0, (9, 27, 36)
#: First bit that deals digests over tables, and over the groups of ``solve``.
TABLE_BIT, GROUP_BIT = 21, 45
#: Digests of a table; pairs with more than ``LONG`` go to ``solve`` instead.
TABLE_DIGESTS, LONG = 6, 192
#: Digests of a group in ``solve``, and how much finer the next round's groups are.
GROUP_DIGESTS, FINER_BITS = 16, 3
SLICE_ROWS, LEAST_ROWS, SAMPLES = 100_000, 1_000, 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _bits(k: Column, first: Column) -> Column:
    return F.call_function("shiftright", k, first)


def _check(k: Column) -> Column:
    return F.xxhash64(k, F.lit(0))


def digests(text: Column) -> Column:
    """Digests of the different paragraphs of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))


def _keys(signed: Column, bit: Column, bits: int) -> Column:
    """Signed digests with their checks and their cells as a bit set: one of
    ``2 ** bits`` cells in each row, by bits of the digest from ``bit`` on."""
    one, width = F.lit(1).cast("long"), 1 << bits

    def cells(k: Column) -> Column:
        out = None
        for j in range(HASHES):
            at = _bits(k, bit + bits * j).bitwiseAND(F.lit(width - 1).cast("long")).cast("int") + j * width
            row = F.call_function("shiftleft", one, at)
            out = row if out is None else out.bitwiseOR(row)
        return out

    return F.transform(signed, lambda q: F.struct(q["n"].alias("n"), q["k"].alias("k"), _check(q["k"]).alias("c"), cells(q["k"]).alias("m")))


def _signed(found: Column, sign: int) -> Column:
    return F.transform(found, lambda d: F.struct(F.lit(sign).alias("n"), d.alias("k")))


def _fold(cell: Column, keys: Column, sign: int) -> Column:
    """``cell`` with those of ``keys`` that lie in it put in (sign 1) or taken out (-1)."""
    mine = F.filter(keys, lambda q: q["m"].bitwiseAND(cell["m"]) != 0)
    return F.aggregate(mine, cell, lambda x, q: F.struct(
        x["m"].alias("m"), ((x["n"] + q["n"]) if sign > 0 else (x["n"] - q["n"])).alias("n"),
        x["k"].bitwiseXOR(q["k"]).alias("k"), x["c"].bitwiseXOR(q["c"]).alias("c")))


def _cells(keys: Column, bits: int) -> Column:
    """Cells (bit, count, exclusive or of digests and of checks) of bound
    keys; with signs of both kinds, the difference of two sketches."""
    zero = F.lit(0).cast("long")
    empty = F.array(*[F.struct(F.lit(1 << i).cast("long").alias("m"), F.lit(0).alias("n"), zero.alias("k"), zero.alias("c"))
                      for i in range(HASHES << bits)])
    return F.transform(empty, lambda cell: _fold(cell, keys, 1))


def sketch(found: Column) -> Column:
    """The sketch of an array of digests."""
    return let(_keys(_signed(found, 1), F.lit(SKETCH_BIT), SKETCH_BITS), lambda keys: _cells(keys, SKETCH_BITS))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        x["m"].alias("m"), (x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def _state(go: Column, cells: Column, a: Column, b: Column) -> Column:
    return F.struct(go.alias("go"), cells.alias("cells"), a.alias("a"), b.alias("b"))


def peel(cells: Column, bit: Column, bits: int) -> Column:
    """(ok, a, b): the digests that only the first or only the second sketch
    has; ``ok`` if nothing is left in the cells."""
    def step(s: Column, _: Column) -> Column:
        alone = F.filter(s["cells"], lambda x: (F.abs(x["n"]) == 1) & (_check(x["k"]) == x["c"]))
        alone = _keys(F.array_distinct(F.transform(alone, lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k")))), bit, bits)

        def take(p: Column) -> Column:
            left = F.transform(s["cells"], lambda x: _fold(x, p, -1))
            left = F.filter(left, lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))
            side = lambda n: F.transform(F.filter(p, lambda q: q["n"] == n), lambda q: q["k"])
            return F.when(F.size(p) == 0, _state(F.lit(False), s["cells"], s["a"], s["b"])).otherwise(
                _state(F.lit(True), left, F.concat(s["a"], side(1)), F.concat(s["b"], side(-1))))

        return F.when(s["go"], let(alone, take)).otherwise(s)

    some = F.filter(cells, lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), _state(F.lit(True), some, _none(), _none()), step,
                       lambda s: F.struct((F.size(s["cells"]) == 0).alias("ok"), s["a"].alias("a"), s["b"].alias("b")))


def _open() -> Column:
    return F.struct(F.lit(False).alias("ok"), _none().alias("a"), _none().alias("b"))


def larger(a: Column, b: Column) -> Column:
    """(ok, a, b) of two arrays of digests from a table for every few of them."""
    def each(s: Column) -> Column:
        tables = F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda t: F.filter(
            s["keys"], lambda q: F.pmod(_bits(q["k"], F.lit(TABLE_BIT)), s["n"]) == t))
        tried = F.transform(tables, lambda keys: F.aggregate(
            F.array(*map(F.lit, RETRY_BITS)), _open(), lambda r, bit: F.when(r["ok"], r).otherwise(
                peel(let(_keys(keys, bit, TABLE_BITS), lambda q: _cells(q, TABLE_BITS)), bit, TABLE_BITS))))
        return let(tried, lambda p: F.struct(
            F.forall(p, lambda x: x["ok"]).alias("ok"), F.flatten(F.transform(p, lambda x: x["a"])).alias("a"),
            F.flatten(F.transform(p, lambda x: x["b"])).alias("b")))

    n = F.greatest(F.lit(1).cast("long"), F.ceil((F.size(a) + F.size(b)) / TABLE_DIGESTS))
    return let(F.struct(F.concat(_signed(a, 1), _signed(b, -1)).alias("keys"), n.alias("n")), each)


def difference(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """(ok, a, b) of two arrays of digests: from their sketches, else from larger tables."""
    return let(peel(subtract(sketch_a, sketch_b), F.lit(SKETCH_BIT), SKETCH_BITS), lambda r: F.when(
        r["ok"] | (F.size(a) + F.size(b) > LONG), r).otherwise(larger(a, b)))


def fingerprint(cells: Column) -> Column:
    """The cells of a sketch as base64 of their bytes."""
    cell = lambda x: F.concat(F.lpad(F.hex(x["n"]), 8, "0"), F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["c"]), 16, "0"))
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(cells, cell), ""))), r"\s", "")


def solve(pairs: DataFrame) -> DataFrame:
    """``(pair, a, b)`` of any size: ``(pair, a, b)`` with the digests that
    only one side has (no row for a pair without digests). Digests are dealt
    over groups by bits of their own, so no group grows with a text; open
    groups are dealt again, finer."""
    size = F.size("a") + F.size("b")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(size / F.lit(GROUP_DIGESTS)))).cast("int")
    rows = pairs.where(size > 0).select("pair", bits.alias("bits"), "a", "b")
    done = None
    while True:
        sides = rows.select("pair", "bits", F.explode("a").alias("d"), F.lit(True).alias("first")).unionByName(
            rows.select("pair", "bits", F.explode("b").alias("d"), F.lit(False).alias("first")))
        group = F.expr(f"shiftright(d, {GROUP_BIT}) & (shiftleft(1L, bits) - 1)")
        dealt = sides.groupBy("pair", "bits", group.alias("grp")).agg(
            F.collect_list(F.when(F.col("first"), F.col("d"))).alias("a"), F.collect_list(F.when(~F.col("first"), F.col("d"))).alias("b"))
        tried = write_table(dealt.withColumn("r", larger(F.col("a"), F.col("b"))), "sketch-groups")
        some = tried.where("r.ok").select("pair", F.col("r.a").alias("a"), F.col("r.b").alias("b"))
        done = some if done is None else done.unionByName(some)
        rows = tried.where("not r.ok").select("pair", (F.col("bits") + FINER_BITS).alias("bits"), "a", "b")
        if rows.isEmpty():
            return done.groupBy("pair").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"))


def _bounds(rows: DataFrame, key: str) -> list[str]:
    """Keys that end the slices, ascending, the highest of all last."""
    n = rows.count()
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    slices = max(1, -(-n // SLICE_ROWS), min(wanted, -(-n // LEAST_ROWS)))
    rate = max(1, n // (slices * SAMPLES))
    some = rows.where((F.pmod(F.xxhash64(key), F.lit(rate)) == 0)).select(key).distinct()
    kept = some.agg(F.sort_array(F.collect_list(key)).alias("s")).select(F.filter("s", lambda x, i: i % SAMPLES == SAMPLES - 1).alias("s")).first()["s"]
    top = rows.agg(F.max(key)).first()[0]
    return sorted({*kept, *([] if top is None else [top])})


def with_next(rows: DataFrame, doc_id: str, text: str, carried: list[str], out: str) -> DataFrame:
    """``rows`` with a struct ``out`` of the ``carried`` columns of the next
    row by descending id, the first row's in the last."""
    part = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # noqa: E731  (text order = number order)
    key = F.concat(F.when(F.col(doc_id).isNull(), "0").otherwise("1"), part(F.coalesce(F.col(doc_id), F.lit(0).cast("long"))), part(F.xxhash64(text)))
    bounds = _bounds(rows.select(key.alias("key")), "key")
    n = max(1, len(bounds))
    w = max(1, round(n ** 0.5))  # found in two steps: among the chunks, then in one
    chunks = [bounds[i:i + w] for i in range(0, n, w)]
    ends = F.split(F.lit(",".join(c[-1] for c in chunks if c)), ",")
    inside = F.split(F.get(F.split(F.lit(";".join(",".join(c) for c in chunks)), ";"), F.col("_chunk")), ",")
    below = lambda a: F.size(F.filter(a, lambda x: x < F.col("_key")))
    dealt = rows.withColumn("_key", key).withColumn("_chunk", below(ends)).withColumn("_ends", inside)
    dealt = dealt.withColumn("_slice", F.col("_chunk") * w + below(F.col("_ends")))
    own = F.struct(F.col("_slice").alias("s"), F.lit(False).alias("guard"))
    guard = F.struct(((F.col("_slice") + 1) % n).alias("s"), F.lit(True).alias("guard"))
    dealt = dealt.withColumn("_to", F.explode(F.when(F.array_contains("_ends", F.col("_key")), F.array(own, guard)).otherwise(F.array(own))))
    dealt = dealt.withColumns({"_slice": F.col("_to.s"), "_guard": F.col("_to.guard")}).drop("_chunk", "_ends", "_to")
    order = Window.partitionBy("_slice").orderBy("_guard", F.col("_key").desc())
    return dealt.withColumn(out, F.lead(F.struct(*carried)).over(order)).where(~F.col("_guard")).drop("_slice", "_guard", "_key")


def fingerprints_query(docs: DataFrame) -> DataFrame:
    """Contract of ``op13``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    rows = with_next(rows.withColumn("a", digests(F.col("t"))), "doc_id", "t", ["t", "a"], "follows")
    half = F.floor(F.length("t") / 2).cast("int")
    edited = F.concat(F.col("t").substr(F.lit(1), F.length("t") - half), F.col("follows.t").substr(F.lit(1), half))
    rows = rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), "a", F.col("follows.a").alias("x"), edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha"), "a", digests(F.col("edited")).alias("e"), "x")
    rows = rows.withColumns({f"s{c}": sketch(F.col(c)) for c in "aex"})
    sides = F.array(*[F.struct(F.col(c).alias("d"), F.col(f"s{c}").alias("s")) for c in "ex"])
    found = F.transform(sides, lambda o: let(difference(F.col("a"), o["d"], F.col("sa"), o["s"]), lambda r: F.struct(
        r["ok"].alias("ok"), F.size(o["d"]).alias("n"), F.size(r["a"]).alias("a"), F.size(r["b"]).alias("b"))))
    rows = rows.withColumn("found", found).withColumn("row", F.monotonically_increasing_id())
    # digests are only kept where a pair is still open
    kept = [F.when(F.exists("found", lambda r: ~r["ok"]), F.col(c)).alias(c) for c in "aex"]
    done = write_table(rows.select("row", "doc_id", "n_chars", "sha", F.size("a").alias("n"), *[fingerprint(F.col(f"s{c}")).alias(f"f{c}") for c in "ae"],
                                   *kept, "found"), "fingerprints")
    still = F.exists("found", lambda r: ~r["ok"])
    open_rows = done.where(still)
    if not open_rows.isEmpty():
        pairs = open_rows.select("row", "a", F.posexplode(F.array("e", "x")).alias("side", "b"), "found").where(~F.expr("found[side].ok"))
        found = solve(pairs.select(F.struct("row", "side").alias("pair"), "a", "b"))
        sizes = found.groupBy(F.col("pair.row").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct(
            F.col("pair.side"), F.struct(F.size("a").alias("a"), F.size("b").alias("b"))))).alias("late"))
        late = lambda r, i: F.when(r["ok"], r).otherwise(F.struct(
            F.lit(True).alias("ok"), r["n"].alias("n"), F.col("late")[i]["a"].alias("a"), F.col("late")[i]["b"].alias("b")))
        mended = open_rows.join(sizes, "row").withColumn("found", F.transform("found", late)).drop("late")
        done = done.where(~still).unionByName(mended.select(done.columns))

    def near(i: int) -> Column:
        r, n = F.get("found", F.lit(i)), F.col("n")
        return F.when((n == 0) & (r["n"] == 0), F.lit(1.0)).otherwise((n - r["a"]) / (n + r["b"]))

    return done.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), F.col("fa").alias("fingerprint"),
                       F.col("fe").alias("edited_fingerprint"), near(0).alias("near_edited"), near(1).alias("near_next"))
