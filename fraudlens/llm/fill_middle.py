"""Operator 12, fill-in-the-middle by displacement scatter.

A text is cut at two line ends into prefix, middle and suffix, and written
with a mark before each part, in the order prefix, suffix, middle (``psm``)
or suffix, prefix, middle (``spm``). No text becomes a Python string: a batch
is its Arrow bytes, end to end.

* ``fill_middle`` scans the bytes for line ends and gives every document its
  two cuts. Each part moves by one distance, so a difference array holds a
  step wherever the distance changes; its cumulative sum is the shift of
  every byte, and one scatter writes all outputs. The marks are scattered
  into the gaps.
* ``restore`` finds the marks in the outputs (a text that holds a mark is
  left plain, so a document has each mark once), and the same difference
  arrays over the text's bytes say where each came from: one gather.

``PART_BYTES`` of whole documents are worked on at a time (a longer document
alone), and their shifts in blocks of ``BLOCK`` bytes, so the scratch memory
of a task does not depend on the length of texts.

Cuts, and whether and how a document is cut, come from the SHA-256 of
``<seed>:<doc_id>``; a missing id counts as an empty one.

Edge cases: a null text is an empty one; an empty text is plain, without
lines. A document that is cut before its first or after its last line has
empty parts. Repeated rows are treated alike, one output row each. A text
that holds ``<P>``, ``<S>`` or ``<M>`` stays plain. An empty table gives an
empty result. Only the id and the text are read, so other columns and their
names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
WIDTH = 3
PART_BYTES, BLOCK = 8 << 20, 4 << 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and its row offsets."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def parts_of(column: pa.Array, size: int = 0) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes (``PART_BYTES``), one row at least."""
    _, offsets = flat(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (size or PART_BYTES), side="right")) - 1)
        yield a, b
        a = b


def shifts(breaks: np.ndarray, values: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """For blocks ``a..b`` of ``n`` bytes: each byte's position plus the value
    of the last break at or before it. Breaks ascend; of equal ones the last counts."""
    steps = np.diff(values, prepend=0)
    carry = 0
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        moves = np.zeros(b - a, dtype=np.int64)
        lo, hi = np.searchsorted(breaks, (a, b))
        np.add.at(moves, breaks[lo:hi] - a, steps[lo:hi])
        moves[0] += carry
        np.cumsum(moves, out=moves)
        carry = moves[-1]
        moves += np.arange(a, b)
        yield a, b, moves


def _interleave(*columns: np.ndarray) -> np.ndarray:
    return np.stack(columns, axis=1).ravel()


def chars_before(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Code points before each of ``places`` (ascending)."""
    out, total = np.zeros(len(places), dtype=np.int64), 0
    for a in range(0, len(data), BLOCK):
        counts = np.cumsum((data[a:a + BLOCK] & 0xC0) != 0x80)
        lo, hi = np.searchsorted(places, (a + 1, a + len(counts) + 1))
        out[lo:hi] = total + counts[places[lo:hi] - a - 1]
        total += int(counts[-1])
    return out


def marks_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and letter of every mark that lies within one row."""
    if len(data) < WIDTH:
        return (np.empty(0, np.int64),) * 3
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")))
    at = at[np.isin(data[at + 1], [ord(k) for k in MARKS])]
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + WIDTH <= offsets[row + 1]
    return row[inside], at[inside], data[at[inside] + 1]


def cut(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, fim_percent: int, spm_percent: int):
    """Lines, form and the two cuts (byte places) of each row; ``h`` holds
    four numbers a row."""
    start, end = offsets[:-1], offsets[1:]
    breaks = np.flatnonzero(data == ord("\n"))
    first, last = np.searchsorted(breaks, start), np.searchsorted(breaks, end)
    full = end > start
    open_end = np.zeros(len(start), dtype=bool)
    open_end[full] = data[end[full] - 1] != ord("\n")
    n = last - first + open_end
    form = np.where(h[:, 2] % 100 >= fim_percent, PLAIN, np.where(h[:, 3] % 100 < spm_percent, SPM, PSM))
    form[~full] = PLAIN
    form[marks_in(data, offsets)[0]] = PLAIN

    def place(k):
        """Byte place after ``k`` lines."""
        out = np.where(k == 0, start, end)
        some = (k > 0) & (k <= last - first)
        out[some] = breaks[first[some] + k[some] - 1] + 1
        return out

    x, y = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    return n, form, np.where(form == PLAIN, end, place(np.minimum(x, y))), np.where(form == PLAIN, end, place(np.maximum(x, y)))


def scatter(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, cut1: np.ndarray, cut2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of all rows (bytes and offsets)."""
    start, end = offsets[:-1], offsets[1:]
    whole = np.cumsum(np.r_[0, end - start + np.where(form == PLAIN, 0, 3 * WIDTH)])
    out = np.empty(int(whole[-1]), dtype=np.uint8)
    base, p, s = whole[:-1], cut1 - start, end - cut2
    one = np.where(form == PSM, p, s)  # the part behind the first mark
    to_p = np.where(form == PLAIN, base, base + np.where(form == PSM, WIDTH, 2 * WIDTH + s))
    to_s = base + np.where(form == PSM, 2 * WIDTH + p, WIDTH)
    to_m = base + 3 * WIDTH + p + s
    places, moves = _interleave(start, cut1, cut2), _interleave(to_p - start, to_m - cut1, to_s - cut2)
    for a, b, to in shifts(places, moves, len(data)):
        out[to] = data[a:b]
    for mark, where in (("P", np.where(form == PSM, base, base + WIDTH + one)), ("S", np.where(form == PSM, base + WIDTH + one, base)),
                        ("M", base + 2 * WIDTH + p + s)):
        out[where[form != PLAIN][:, None] + np.arange(WIDTH)] = np.frombuffer(MARKS[mark], dtype=np.uint8)
    return out, whole


def gather(out: np.ndarray, whole: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of all rows (bytes and offsets) from outputs and forms."""
    rows = len(form)
    row, at, letter = marks_in(out, whole)
    cutted = form[row] != PLAIN
    row, at, letter = row[cutted], at[cutted], letter[cutted]
    if not np.array_equal(np.bincount(row, minlength=rows), np.where(form == PLAIN, 0, 3)):
        raise ValueError("an output without its three marks")
    where = {}
    for k in MARKS:
        where[k] = whole[:-1].copy()
        where[k][row[letter == ord(k)]] = at[letter == ord(k)]
    end = whole[1:]
    p = np.where(form == PSM, where["S"], where["M"]) - where["P"] - WIDTH
    m = np.where(form == PLAIN, 0, end - where["M"] - WIDTH)
    p = np.where(form == PLAIN, end - whole[:-1], p)
    offsets = np.cumsum(np.r_[0, end - whole[:-1] - np.where(form == PLAIN, 0, 3 * WIDTH)])
    start = offsets[:-1]
    text = np.empty(int(offsets[-1]), dtype=np.uint8)
    skip = np.where(form == PLAIN, 0, WIDTH)
    places = _interleave(start, start + p, start + p + m)
    moves = _interleave(where["P"] + skip - start, where["M"] + skip - start - p, where["S"] + skip - start - p - m)
    for a, b, source in shifts(places, moves, len(text)):
        text[a:b] = out[source]
    return text, offsets


def fill_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT,
                spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per input row: ``doc_id``, ``n`` (lines), ``form``,
    ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in parts_of(whole.column(1)):
                rows = whole.slice(a, b - a)
                data, offsets = flat(rows.column(1))
                h = np.stack([np.asarray(rows.column(2 + i)) for i in range(4)], axis=1)
                n, form, cut1, cut2 = cut(data, offsets, h, fim_percent, spm_percent)
                out, ends = scatter(data, offsets, form, cut1, cut2)
                chars = chars_before(data, _interleave(offsets[:-1], cut1, cut2)).reshape(-1, 3)
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), pa.array(n.astype(np.int64)), pa.array(FORMS[form], pa.string()),
                    pa.array(chars[:, 1] - chars[:, 0], mask=plain), pa.array(chars[:, 2] - chars[:, 1], mask=plain), strings(out, ends),
                ], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"),
                       *[F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)])
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """``fill_middle``'s rows with the exact text rebuilt from ``output`` and ``form``."""
    names = made.columns
    o, f = names.index("output"), names.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in parts_of(whole.column(o)):
                rows = whole.slice(a, b - a)
                form = np.array([{"plain": PLAIN, "psm": PSM, "spm": SPM}[x] for x in rows.column(f).to_pylist()], dtype=np.int64)
                text = strings(*gather(*flat(rows.column(o)), form))
                yield pa.RecordBatch.from_arrays([*rows.columns, text], names=[*names, "restored"])

    return made.mapInArrow(run, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in made.schema.fields) + ", restored string")


def fill_middle_query(docs: DataFrame) -> DataFrame:
    """Contract of ``op12``."""
    done = restore(fill_middle(docs))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def oracle_sql() -> str:
    """The same result as one DuckDB query."""
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS tx, sha256('{SEED}:' || doc_id) AS k FROM documents),
u AS (SELECT doc_id, tx, regexp_extract_all(tx, '[^\n]*\n|[^\n]+') AS ls,
             [CAST('0x' || k[1:8] AS BIGINT), CAST('0x' || k[9:16] AS BIGINT), CAST('0x' || k[17:24] AS BIGINT), CAST('0x' || k[25:32] AS BIGINT)] AS h FROM t),
c AS (SELECT doc_id, tx, ls, len(ls) AS n, least(h[1] % (len(ls) + 1), h[2] % (len(ls) + 1)) AS lo,
             greatest(h[1] % (len(ls) + 1), h[2] % (len(ls) + 1)) AS hi,
             CASE WHEN tx = '' OR contains(tx, '<P>') OR contains(tx, '<S>') OR contains(tx, '<M>') OR h[3] % 100 >= {FIM_PERCENT} THEN 'plain'
                  WHEN h[4] % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, tx, n, form, array_to_string(ls[1:lo], '') AS pre, array_to_string(ls[lo + 1:hi], '') AS mid,
             array_to_string(ls[hi + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN tx WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(tx) AS restored_sha256
FROM p"""
