"""Operator 7, edit-aware token counts over pre-token segment trees.

A text is cut into segments: runs of pre-tokens that end before a single
blank between two other characters. No token of a byte-level BPE with a
GPT-2-like pattern spans such a place, so counts of segments add up. A
document's tree keeps, for leaves of ``LEAF`` segments, their characters and
tokens, and above them sums over ``FAN_OUT`` nodes up to the root.

An edit (``at``, ``removed``, ``inserted``, in characters of the old text)
touches the leaves it overlaps. Only these are encoded again, with boundary
context: from the last leaf that starts ``CONTEXT`` characters before the
edit, to the first old leaf start behind it that is again a segment start of
the new text, from where on nothing can differ. Then the sums above the
changed leaves are updated. The tree is a column, so it can be stored beside
the document and joined by its id when edits arrive.

Edge cases: a null or empty text is an empty tree with 0 tokens and can be
edited by an insertion. The edits of one batch refer to the same old text;
they are applied in order of position (then of the inserted text) and one
that overlaps an earlier one, or reaches outside the text, is cut back to
what is left. So a document has at most one edit per character and a batch
is bounded by its length. Null parts of an edit count as nothing removed or
inserted. Repeated rows give repeated results, an empty table an empty one;
other columns pass through and new ones get fresh names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.llm.common import fresh

LEAF, FAN_OUT, CONTEXT = 48, 8, 8
KNOWN_SEGMENTS = 500_000
TREE = T.StructType([T.StructField("leaf_chars", T.ArrayType(T.IntegerType())), T.StructField("leaf_tokens", T.ArrayType(T.IntegerType())),
                     T.StructField("sums", T.ArrayType(T.LongType()))])
EDIT = "array<struct<at:int,removed:int,inserted:string>>"


class Counter:
    """Token counts of segments, by the tiktoken library, each once."""

    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def segments(self, text: str) -> list[str]:
        """Cut before every single blank that stands between two other characters."""
        parts = text.split(" ")
        if len(parts) == 1:
            return [text] if text else []
        out, held = [], parts[0]
        for a, b in zip(parts, parts[1:]):
            if a and b and not a[-1].isspace() and not b[0].isspace():
                out.append(held)
                held = " " + b
            else:
                held += " " + b
        out.append(held)
        return out

    def counts(self, segments: list[str]) -> list[int]:
        known = self.known
        if len(known) > KNOWN_SEGMENTS:
            known.clear()
        out = []
        for s in segments:
            n = known.get(s)
            if n is None:
                n = len(self.library.encode_ordinary(s))
                if len(s) <= 64:
                    known[s] = n
            out.append(n)
        return out

    def leaves(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of each leaf."""
        starts = np.arange(0, len(segments), LEAF)
        if not len(starts):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return (np.add.reduceat(np.fromiter(map(len, segments), dtype=np.int64, count=len(segments)), starts),
                np.add.reduceat(np.array(self.counts(segments), dtype=np.int64), starts))


def sums_over(leaf_tokens: np.ndarray) -> list[np.ndarray]:
    """Levels above the leaves, the root last."""
    levels, now = [], np.asarray(leaf_tokens, dtype=np.int64)
    while len(now) > 1:
        now = np.add.reduceat(now, np.arange(0, len(now), FAN_OUT))
        levels.append(now)
    return levels


def _levels(n: int, flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    while n > 1:
        n = -(-n // FAN_OUT)
        out.append(flat[at:at + n])
        at += n
    return out


class Tree:
    """A document's leaves and the sums above them."""

    def __init__(self, leaf_chars, leaf_tokens, sums=None):
        self.chars, self.tokens = np.array(leaf_chars, dtype=np.int64), np.array(leaf_tokens, dtype=np.int64)
        self.sums = sums_over(self.tokens) if sums is None else _levels(len(self.tokens), np.array(sums, dtype=np.int64))

    def total(self) -> int:
        return int(self.sums[-1][0]) if self.sums else int(self.tokens.sum())

    def replace(self, a: int, b: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        """New leaves for those from ``a`` up to ``b``. With as many as before,
        only the sums on the paths from them to the root are added again."""
        same = len(tokens) == b - a
        self.chars = np.concatenate([self.chars[:a], chars, self.chars[b:]])
        self.tokens = np.concatenate([self.tokens[:a], tokens, self.tokens[b:]])
        if not same:  # nodes above and to the right move
            below, old, first, self.sums = self.tokens, self.sums, a, []
            while len(below) > 1:
                first //= FAN_OUT
                tail = np.add.reduceat(below[first * FAN_OUT:], np.arange(0, len(below) - first * FAN_OUT, FAN_OUT)) if first * FAN_OUT < len(below) else below[:0]
                kept = old[len(self.sums)][:first] if len(self.sums) < len(old) else None
                level = np.concatenate([kept, tail]) if kept is not None and len(kept) == first else np.add.reduceat(below, np.arange(0, len(below), FAN_OUT))
                self.sums.append(level)
                below = level
            return
        below = self.tokens
        for level in self.sums:
            a, b = a // FAN_OUT, -(-b // FAN_OUT)
            for i in range(a, b):
                level[i] = below[i * FAN_OUT:(i + 1) * FAN_OUT].sum()
            below = level

    def flat(self) -> list[int]:
        return [int(x) for level in self.sums for x in level]


def normal(edits, length: int) -> list[tuple[int, int, str]]:
    """Edits in order, cut back to the text and to each other."""
    out, free = [], 0
    number = lambda v: 0 if v is None or v != v else max(int(v), 0)  # noqa: E731  (pandas may give NaN for null)
    for at, removed, inserted in sorted((min(number(e[0]), length), number(e[1]), e[2] or "") for e in edits or []):
        end = min(at + removed, length)
        at = max(at, free)
        end = max(end, at)
        out.append((at, end - at, inserted))
        free = end
    return out


def edit(tree: Tree, text: str, edits, counter: Counter) -> tuple[str, int]:
    """Apply a batch to ``text`` and its tree: the new text, and how many of
    its characters were encoded again. Edits whose regions meet share one."""
    batch = normal(edits, len(text))
    if not batch:
        return text, 0
    starts = np.concatenate([[0], np.cumsum(tree.chars)])  # of the old leaves, and the end
    done, pieces, spent, shift, i = 0, [], 0, 0, 0
    while i < len(batch):
        a = max(0, int(np.searchsorted(starts, batch[i][0] - CONTEXT, side="right")) - 1)
        a = min(a, max(0, len(starts) - 2))
        region, at, lead = [], int(starts[a]), int(starts[a])
        pieces.append(text[done:at])
        b = a
        while True:
            # take in the edits up to the next old leaf start that lies behind them
            while i < len(batch) and batch[i][0] <= starts[min(b, len(starts) - 1)] + CONTEXT:
                e = batch[i]
                region += [text[at:e[0]], e[2]]
                at, i = e[0] + e[1], i + 1
            b = max(b + 1, int(np.searchsorted(starts, at)))
            if b >= len(starts) - 1:
                if i < len(batch):
                    b = len(starts) - 1
                    while i < len(batch):
                        e = batch[i]
                        region += [text[at:e[0]], e[2]]
                        at, i = e[0] + e[1], i + 1
                stop, b = len(text), len(starts) - 1
                segments = counter.segments("".join(region) + text[at:stop])
                break
            if i < len(batch) and batch[i][0] <= starts[b] + CONTEXT:
                continue
            # is the old leaf start still a segment start? Look one leaf further.
            stop, look = int(starts[b]), int(starts[b + 1])
            fresh_text = "".join(region) + text[at:stop]
            if fresh_text and _cuts(fresh_text, text[stop:look]):
                segments = counter.segments(fresh_text)
                break
        chars, tokens = counter.leaves(segments)
        tree.replace(a + shift, b + shift, chars, tokens)
        shift += len(chars) - (b - a)
        new = "".join(region) + text[at:stop]
        spent += len(new)
        pieces.append(new)
        done = stop
    pieces.append(text[done:])
    return "".join(pieces), spent


def _cuts(left: str, right: str) -> bool:
    """Whether a segment starts where ``right`` follows ``left``."""
    return len(right) > 1 and right[0] == " " and not right[1].isspace() and not left[-1].isspace()


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counter_of(vocabulary: str, pattern: str) -> Counter:
    if (vocabulary, pattern) not in _COUNTERS:
        _COUNTERS[(vocabulary, pattern)] = Counter(vocabulary, pattern)
    return _COUNTERS[(vocabulary, pattern)]


def with_trees(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", rows: int = 256) -> tuple[DataFrame, str]:
    """``df`` with the tree of each whole text; returns it and the column's name."""
    (name,) = fresh(df, "token_tree")
    schema = T.StructType([*df.schema.fields, T.StructField(name, TREE)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter_of(vocabulary, pattern)
        for whole in batches:
            for a in range(0, len(whole), rows):
                b = whole.iloc[a:a + rows].copy()
                trees = []
                for t in b[text]:
                    t = Tree(*c.leaves(c.segments(t or "")))
                    trees.append({"leaf_chars": t.chars.tolist(), "leaf_tokens": t.tokens.tolist(), "sums": t.flat()})
                b[name] = trees
                yield b

    return df.mapInPandas(run, schema), name


def apply_edits(df: DataFrame, tree: str, edits: str, vocabulary: str, pattern: str, text: str = "text", rows: int = 256) -> tuple[DataFrame, list[str]]:
    """``df`` with the new text, its tree, the token count of the old and the
    new text, and the characters encoded again; returns the five names."""
    names = fresh(df, "new_text", "new_tree", "n_tokens", "new_n_tokens", "encoded_chars")
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], TREE),
                           *[T.StructField(n, T.LongType()) for n in names[2:]]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter_of(vocabulary, pattern)
        for whole in batches:
            for a in range(0, len(whole), rows):
                b = whole.iloc[a:a + rows].copy()
                cols: list[list] = [[], [], [], [], []]
                for t, had, es in zip(b[text], b[tree], b[edits]):
                    now = Tree(had["leaf_chars"], had["leaf_tokens"], had["sums"])
                    before = now.total()
                    new, spent = edit(now, t or "", [] if es is None else [(e["at"], e["removed"], e["inserted"]) for e in es], c)
                    for col, v in zip(cols, (new, {"leaf_chars": now.chars.tolist(), "leaf_tokens": now.tokens.tolist(), "sums": now.flat()},
                                             before, now.total(), spent)):
                        col.append(v)
                for n, col in zip(names, cols):
                    b[n] = col
                yield b

    return df.mapInPandas(run, schema), names


def gather_edits(edits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Edit rows (id, at, removed, inserted) as one array per document."""
    return edits.groupBy(doc_id).agg(F.collect_list(F.struct("at", "removed", "inserted")).cast(EDIT).alias("edits"))


def sample_edits(text: Column, doc_id: Column) -> Column:
    """Three edits for a document, made from its own text: some characters
    replaced in the first third, a word put in later, its start repeated at the end."""
    n = F.length(F.coalesce(text, F.lit("")))
    third = F.greatest(F.floor(n / 3), F.lit(1)).cast("int")
    spot = lambda k: F.pmod(F.xxhash64(doc_id, F.lit(k)), third.cast("long")).cast("int")
    start = F.substring(F.coalesce(text, F.lit("")), 1, 12)
    return F.array(F.struct(spot(1).alias("at"), F.lit(5).alias("removed"), start.alias("inserted")),
                   F.struct((third + spot(2)).alias("at"), F.lit(0).alias("removed"), F.lit(" edited ").alias("inserted")),
                   F.struct(n.alias("at"), F.lit(0).alias("removed"), start.alias("inserted"))).cast(EDIT)


def token_counts_query(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Token counts of all documents before and after a batch of edits."""
    rows = docs.select("doc_id", "text").withColumn("edits", sample_edits(F.col("text"), F.col("doc_id")))
    rows, tree = with_trees(rows, vocabulary, pattern)
    rows, names = apply_edits(rows, tree, "edits", vocabulary, pattern)
    return rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.col(names[2]).alias("n_tokens"),
                       F.length(names[0]).cast("long").alias("edited_n_chars"), F.col(names[3]).alias("edited_n_tokens"),
                       F.col(names[4]).alias("encoded_chars"))
