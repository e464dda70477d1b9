"""Operator 8, bounded-space online packing of tokenised documents.

Each input partition is one stream. A task tokenises its documents, cuts
full windows off long ones, and places what is left best-fit in one of
``n_open`` open windows. When none fits, the fullest window is topped up
with a cut of the document if its gap is worth one, and emitted. What is
still open at the end of a partition is a leftover; leftovers are merged in
a second, much smaller step, in groups of ``GROUP`` windows, so that no task
or driver ever holds them all. Only the last window of such a group can stay
unfilled; it is cut into sequences whose lengths are powers of two, which
need no padding.

Pieces (with their ids as little-endian unsigned 32-bit integers) are
written once to the shared checkpoint folder: finished pieces and leftovers
come from the same run of the tasks, so a lost executor cannot make the two
disagree.

Tokenising: white space is dropped by this tokenizer and no token spans it,
so a text is cut at blanks and newlines and each distinct word is encoded
once; a task remembers words of at most ``CACHE_BYTES`` (in two generations,
so that those in use stay) and forgets them when it ends.

Edge cases: a null or empty text is the end-of-text id alone. Repeated rows
are packed as often as they occur. A document of any length is cut over as
many sequences as it needs. An empty table gives no pieces. Columns other
than document id and text are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.common import write_table

WINDOW, N_OPEN, MIN_CUT, END_ID = 4096, 32, 16, 2
#: Leftover windows that one task merges.
GROUP = 256
#: Memory of the remembered words of a task, and what one takes beside its letters.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 190
#: Signs that may follow a run of letters and are tokens of their own.
SIGNS = ".,!?;:%&#*$|"
#: Letters below this one are in normal form, and Python lower-cases them as the library does.
PLAIN_LETTERS = "\u0250"
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

_LIBRARIES: dict = {}


def library(path: str):
    """The worker's tokenizer of a file."""
    if path not in _LIBRARIES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        _LIBRARIES[path] = Library.from_file(path)
    return _LIBRARIES[path]


class Words(dict):
    """Rows of the words met; a new one is noted and gets the next row."""

    def __init__(self, older: dict[str, int], rows: int):
        self.older, self.rows, self.new, self.bytes = older, rows, [], 0

    def __missing__(self, word: str) -> int:
        row = self.older.get(word)
        if row is None:
            row = self.rows + len(self.new)
            self.new.append(word)
        self[word] = row
        self.bytes += len(word) + ENTRY_BYTES
        return row


class Tokenizer:
    """Whole-text ids of the tokenizers library, from its ids of single words.

    The library makes letters and the signs after them separate tokens and
    drops letter case, so a run of plain letters goes to its merges alone.
    All other words are encoded by the library whole."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers.pre_tokenizers import ByteLevel

        self.library, self.bound = library(path), cache_bytes // 2
        self.merges, self.tails = self.library.model.tokenize, {}
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_form = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, ord(PLAIN_LETTERS)) if chr(c).isalpha()}
        self.words = Words({}, 0)
        self.flat, self.ends = np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64)  # ids of all rows, end to end

    def _whole(self, word: str) -> list[int]:
        return self.library.encode(word, add_special_tokens=False).ids

    def _tail(self, signs: str) -> list[int]:
        """Ids of the signs behind a run of letters."""
        ids = self.tails.get(signs)
        if ids is None:
            ids = self._whole(signs)
            if len(signs) < 4:  # so many, and no more, are possible
                self.tails[signs] = ids
        return ids

    def _learn(self) -> None:
        """Ids of the new words, as rows after the known ones. Letters with
        other signs or in other case than before are not merged again."""
        words, get, older, merges = self.words, self.words.get, self.words.older, self.merges
        if not words.new:
            return
        found, cores, known, flat, ends = [], {}, words.rows, self.flat, self.ends
        for word, low in zip(words.new, "\n".join(words.new).lower().split("\n")):
            core = low.rstrip(SIGNS)
            ids = cores.get(core)
            if ids is None:
                plain = core.isascii()
                if not core.isalpha() or not plain and max(core) >= PLAIN_LETTERS:
                    found.append(self._whole(word) if word else [])
                    continue
                row = known
                if core != word:  # the word itself is new
                    row = get(core, known)
                    if row >= known:
                        row = older.get(core, known)
                if row < known:
                    ids = flat[ends[row]:ends[row + 1]].tolist()
                else:
                    ids = [t.id for t in merges(core if plain else core.translate(self.byte_form))]
                cores[core] = ids
            found.append(ids + self._tail(low[len(core):]) if len(core) < len(low) else ids)
        own = np.cumsum([len(x) for x in found]) + ends[-1]
        self.flat = np.concatenate([flat, np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(own[-1] - ends[-1]))])
        self.ends = np.concatenate([ends, own])
        words.rows, words.new = known + len(words.new), []

    def _rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows end to end, and where each row ends."""
        start = self.ends[rows]
        size = self.ends[rows + 1] - start
        ends = np.cumsum(size)
        return self.flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _forget(self) -> None:
        """Keep the words met since the last time, as the older generation."""
        kept = self.words
        self.flat, ends = self._rows(np.fromiter(kept.values(), dtype=np.int64, count=len(kept)))
        self.ends = np.r_[0, ends]
        self.words = Words(dict(zip(kept, range(len(kept)))), len(kept))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.words.bytes > self.bound:
            self._forget()
        row = self.words.__getitem__
        rows = [np.fromiter(map(row, ws), dtype=np.int64, count=len(ws))
                for ws in (t.replace("\n", " ").split(" ") if t else [] for t in texts)]
        self._learn()
        ids, ends = self._rows(np.concatenate(rows) if rows else np.empty(0, np.int64))
        cuts = np.r_[0, ends][np.cumsum([0, *map(len, rows)])]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class Packer:
    """Open windows of one stream. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, window: int, n_open: int, min_cut: int):
        self.window, self.n_open, self.min_cut = window, n_open, min_cut
        self.next_id, self.open, self.out = first_id, [], []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def add(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self.emit([(doc_id, start, ids[:self.window], total)])
            start, ids = start + self.window, ids[self.window:]
        while len(ids):
            fits = [w for w in self.open if w[0] >= len(ids)]
            if fits:
                best = min(fits, key=lambda w: w[0])
            elif len(self.open) < self.n_open:
                self.open.append(best := [self.window, []])
            else:
                best = min(self.open, key=lambda w: w[0])
                cut = best[0] if best[0] >= self.min_cut else 0
                if cut:
                    best[1].append((doc_id, start, ids[:cut], total))
                    start, ids = start + cut, ids[cut:]
                self.emit(best[1])
                self.open.remove(best)
                continue
            best[1].append((doc_id, start, ids, total))
            best[0] -= len(ids)
            if not best[0]:
                self.emit(best[1])
                self.open.remove(best)
            return

    def close(self) -> None:
        """Emit all: the open windows' pieces end to end, the rest at powers of two."""
        pieces = [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]
        left, self.open = sum(len(p[2]) for p in pieces), []
        sizes = [self.window] * (left // self.window)
        sizes += [1 << b for b in reversed(range(left.bit_length())) if (left % self.window) >> b & 1]
        pieces.reverse()
        for size in sizes:
            row = []
            while size:
                doc_id, start, ids, total = pieces.pop()
                row.append((doc_id, start, ids[:size], total))
                if len(ids) > size:
                    pieces.append((doc_id, start + size, ids[size:], total))
                size -= len(row[-1][2])
            self.emit(row)


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
         n_open: int = N_OPEN, min_cut: int = MIN_CUT, end_id: int = END_ID, group: int = GROUP, rows: int = 256) -> DataFrame:
    """The pieces of all sequences, with their ids."""

    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, code, end = TaskContext.get().partitionId(), Tokenizer(tokenizer_path), np.array([end_id], dtype="<u4")
        packer = Packer(part << 32, window, n_open, min_cut)
        for whole in batches:
            for a in range(0, len(whole), rows):
                ids = whole["d"].iloc[a:a + rows].tolist()
                for d, toks in zip(ids, code.encode(whole["t"].iloc[a:a + rows].tolist())):
                    toks = np.concatenate([toks, end])
                    packer.add(None if pd.isna(d) else int(d), 0, toks, len(toks))
                if packer.out:
                    yield pd.DataFrame(packer.out, columns=columns).assign(part=part, left=False)
                    packer.out = []
        for _, pieces in packer.open:
            packer.emit(pieces)
        if packer.out:
            yield pd.DataFrame(packer.out, columns=columns).assign(part=part, left=True)

    def merge(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:  # of the windows of a group
        packer = Packer((1 << 62) + (int(key[0]) << 32), window, n_open, min_cut)
        pieces = pieces.sort_values(["sequence_id", "offset"], kind="stable")
        for p in pieces.itertuples():
            packer.add(None if pd.isna(p.doc_id) else int(p.doc_id), p.start, np.frombuffer(p.ids, dtype="<u4"), p.doc_tokens)
        packer.close()
        return pd.DataFrame(packer.out, columns=columns)

    streamed = docs.select(F.col(f"`{doc_id}`").cast("long").cast("string").alias("d"), F.col(f"`{text}`").alias("t"))
    done = write_table(streamed.mapInPandas(stream, f"{PIECE}, part int, left boolean"), "packed")
    left = done.where("left").drop("left", "part")
    groups = max(1, -(-left.where(F.col("offset") == 0).count() // group))  # a window has one piece at 0
    merged = (left.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("grp", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
              .groupBy("grp").applyInPandas(merge, PIECE))
    return done.where(~F.col("left")).drop("part", "left").unionByName(merged)


def packing_query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Contract of ``op8``: one row per piece, its ids as a checksum."""
    return pack(docs, tokenizer_path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                                             "doc_tokens", "sequence_id", "offset")
