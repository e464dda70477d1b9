"""Operator 11, periodic runs: stretches of words that repeat with a period.

A run is a maximal stretch of words with smallest period ``q`` and a length
of at least ``max(min_length, min_power * q)``. They are found by string
synchronising sets at the scales 1, 2, 4, ...:

* every factor of ``2**k`` words has a 64-bit name, mixed from the names of
  its halves (one numpy step a scale, all documents of a batch at once);
* at scale ``t`` a position is synchronising if the least name among the
  ``t``-word factors that start in the ``t + 1`` places from it is the first
  or the last of them, so equal contexts of ``2t`` words select alike;
* factors with a period of ``t / 3`` or less would tie, so they take no part
  in the minimum. They are found beside it: such a factor's first half
  returns at the distance of its period, and nowhere before;
* a synchronising position and the next one with the same context, at a
  distance ``t <= p < 2t``, propose the period ``p``. A run of four periods
  has such a pair: were none of the positions of one period synchronising,
  the whole run would have a period of ``t / 3`` or less, and it is proposed
  at the smaller scale where that period belongs. The distance is the
  stretch's smallest period, since a smaller one would return earlier;
* proposals of one run are merged, confirmed on the words themselves and
  extended to both sides word by word (names only ever propose).

A batch holds about ``BATCH_WORDS`` words of whole documents; a longer
document is a batch of its own. The work at a scale is linear in the words
of the documents that are four times as long, and its arrays are dropped
before the next scale.

Edge cases: a null, empty or blank text has no words and no runs; its
collapsed text is empty. Repeated rows are treated alike, one output row
each; an empty table gives an empty result. Only the id and the text are
read, so other columns and their names do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.common import WORD, fresh

MIN_LENGTH, MIN_POWER = 6, 4
BATCH_WORDS = 400_000
#: Characters of a text that are split into words at a time.
SPLIT_CHARS = 1 << 20

RUNS = "runs array<struct<start:long,length:long,period:long>>"
_WORD, _BLANK = re.compile(WORD), re.compile(r"[\x20\x09-\x0D]")


class _Numbers(dict):
    """Distinct words numbered as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def words_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text, a bounded part of it at a time."""
    at, n = 0, len(text or "")
    while at < n:
        cut = _BLANK.search(text, min(n, at + SPLIT_CHARS))
        end = cut.end() if cut else n
        yield _WORD.findall(text, at, end)
        at = end


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of factors from those of their two parts."""
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + _mix(b + np.uint64(0xD1B54A32D192ED03)))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each position (fewer at the end)."""
    n = len(x)
    pad = np.full(-(-(n + width) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    pad[:n] = x
    blocks = pad.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def _next_equal(at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``at`` (ascending) whose name returns, and the distance."""
    order = np.argsort(names, kind="stable")
    n, a = names[order], at[order]
    same = n[1:] == n[:-1]
    return a[:-1][same], (a[1:] - a[:-1])[same]


def _proposals(names: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(position, period, scale) of every pair of equal contexts. ``names``
    are those of the words, ``room`` the words left in the document from each."""
    size = np.zeros(len(room), dtype=np.int64)  # words of the position's document
    first = np.flatnonzero(np.r_[True, room[1:] >= room[:-1]]) if len(room) else np.empty(0, np.int64)
    size = np.repeat(room[first], np.diff(np.r_[first, len(room)]))
    places = np.arange(len(room))
    half, t = None, 1
    while True:
        keep = size >= MIN_POWER * t  # a period of t or more fits four times
        if not keep.all():
            names, room, size, places = names[keep], room[keep], size[keep], places[keep]
            half = half[keep] if half is not None else None
        n = len(names)
        if not n:
            return
        own = names.copy()
        if half is not None:  # factors of t words with a period of t / 3 or less
            back = np.flatnonzero(room >= t)
            at, d = _next_equal(back, half[back])
            some = d <= t // 3
            at, d = at[some], d[some]
            # the first half returns at d; the second half shifted back by d must too
            at = at[half[at + t // 2 - d] == half[at + t // 2]]
            own[at] = np.iinfo(np.uint64).max
        least = _window_min(own, t + 1)
        i = np.flatnonzero(room >= 2 * t)
        i = i[((least[i] == own[i]) | (least[i] == own[i + t])) & (least[i] != np.iinfo(np.uint64).max)]
        context = _join(names[:n - t], names[t:]) if n > t else names[:0]
        at, p = _next_equal(i, context[i])
        some = (p >= t) & (p < 2 * t)
        yield places[at[some]], p[some], t
        half = names
        names = np.r_[context, np.zeros(n - len(context), dtype=np.uint64)]  # the tail has no room and is never asked
        t *= 2


def find_runs(words: np.ndarray, lengths: np.ndarray, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each document, by start and period.
    ``words`` are the numbered words of all documents end to end."""
    if min_power < MIN_POWER:
        raise ValueError(f"runs of fewer than {MIN_POWER} periods may have no synchronising pair")
    ends = np.cumsum(lengths)
    starts = ends - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    room = np.repeat(ends, lengths) - np.arange(len(words))
    names = _join(_mix(words.astype(np.uint64) + np.uint64(1)), _mix(doc.astype(np.uint64) + np.uint64(1)))
    found: list[set] = [set() for _ in lengths]
    for at, period, t in _proposals(names, room):
        if not len(at):
            continue
        order = np.lexsort((at, period, doc[at]))
        at, period = at[order], period[order]
        # the next proposal shares p words or more with the stretch so far: the same run
        new = np.r_[True, (period[1:] != period[:-1]) | (doc[at[1:]] != doc[at[:-1]]) | (at[1:] > at[:-1] + 2 * t)]
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(at)] - 1
        for s, e, p in zip(at[head].tolist(), (at[tail] + period[tail] + 2 * t).tolist(), period[head].tolist()):
            d = int(doc[s])
            if not np.array_equal(words[s:e - p], words[s + p:e]):
                continue
            s, e = _extend(words, s, e, p, int(starts[d]), int(ends[d]))
            if e - s >= max(min_length, min_power * p):
                found[d].add((s - int(starts[d]), e - s, p))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def _extend(words: np.ndarray, s: int, e: int, p: int, low: int, high: int) -> tuple[int, int]:
    """The stretch grown to both sides as far as the period holds, by doubling strides."""
    step = 16
    while e < high:
        k = min(step, high - e)
        differs = words[e:e + k] != words[e - p:e - p + k]
        if differs.any():
            e += int(differs.argmax())
            break
        e, step = e + k, step * 2
    step = 16
    while s > low:
        k = min(step, s - low)
        differs = (words[s - k:s] != words[s - k + p:s + p])[::-1]
        if differs.any():
            s -= int(differs.argmax())
            break
        s, step = s - k, step * 2
    return s, e


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words outside of runs and the first period of each run; a word
    that any run repeats goes."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, p in runs:
        drop[s + p] += 1
        drop[s + n] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                  min_power: int = MIN_POWER, batch_words: int = BATCH_WORDS) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``runs`` (by start and
    period) and ``collapsed`` (the kept words joined by one space)."""

    def flush(ids: list, texts: list, numbered: list, lengths: list) -> pd.DataFrame:
        runs = find_runs(np.concatenate(numbered) if numbered else np.empty(0, np.int64), np.array(lengths, dtype=np.int64), min_length, min_power)
        kept = [" ".join(collapse([w for part in words_of(t) for w in part], r)) for t, r in zip(texts, runs)]
        return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n_words": lengths,
                             "runs": [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], "collapsed": kept})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            ids, texts, numbered, lengths, total, numbers = [], [], [], [], 0, _Numbers()
            for d, t in zip(whole["d"], whole["t"]):
                parts = [np.fromiter(map(numbers.__getitem__, ws), dtype=np.int64, count=len(ws)) for ws in words_of(t)]
                n = sum(map(len, parts))
                ids.append(None if pd.isna(d) else int(d))
                texts.append(t)
                numbered += parts
                lengths.append(n)
                total += n
                if total >= batch_words:
                    yield flush(ids, texts, numbered, lengths)
                    ids, texts, numbered, lengths, total, numbers = [], [], [], [], 0, _Numbers()
            if ids:
                yield flush(ids, texts, numbered, lengths)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").cast("string").alias("d"), F.col(f"`{text}`").alias("t"))
    return rows.mapInPandas(run, f"doc_id long, n_words long, {RUNS}, collapsed string")


def plant(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with a periodic tail in about every tenth document: with
    ``h = crc32(doc_id)`` and ``g = floor(h / 10)``, where ``h % 10`` is 0,
    every word ``i >= a`` is word ``a + (i - a) % p``; ``a = g % n``,
    ``p = 1 + floor((n - a) / (3 + g % 8))``. Those texts are words joined by one space."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    h, ws, n, a, p = fresh(rows, "h", "ws", "n", "a", "p")
    g = F.floor(F.col(h) / 10)
    rows = rows.withColumn(h, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    rows = rows.withColumn(ws, F.when(F.col(h) % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    rows = rows.withColumn(n, F.size(ws)).withColumn(a, F.when(F.col(n) > 0, F.expr(f"cast(floor({h} / 10) % {n} as int)")))
    rows = rows.withColumn(p, (1 + F.floor((F.col(n) - F.col(a)) / (3 + g % 8))).cast("int"))
    left = F.col(n) - F.col(a)
    tail = F.flatten(F.array_repeat(F.slice(ws, F.col(a) + 1, F.col(p)), F.ceil(left / F.col(p)).cast("int")))
    planted = F.concat_ws(" ", F.concat(F.slice(F.col(ws), F.lit(1), F.col(a)), F.slice(tail, F.lit(1), left)))
    return rows.select("doc_id", F.when(F.col(a).isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def periodic_query(docs: DataFrame) -> DataFrame:
    """Contract of ``op11``: runs of the planted texts, as digests, and the
    run of greatest length / period."""
    found = periodic_runs(plant(docs))
    # greatest exact ratio first: a.length * b.period against b.length * a.period
    better = lambda a, b: F.when(
        b["length"] * a["period"] != a["length"] * b["period"],
        F.signum((b["length"] * a["period"] - a["length"] * b["period"]).cast("double")).cast("int")).when(
        a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(
        F.when(a["period"] < b["period"], -1).otherwise(1))
    best = F.when(F.size("runs") > 0, F.aggregate(F.slice("runs", 2, 1 << 30), F.get("runs", F.lit(0)), lambda a, b: F.when(better(a, b) > 0, b).otherwise(a)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit(""))).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
