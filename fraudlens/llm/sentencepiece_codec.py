"""Operator 10, SentencePiece (BPE with byte fallback) by vectorised merges.

A batch of texts is cut into segments that no vocabulary piece can span. The
distinct segments not yet known to the worker become one flat numpy array of
symbols. Each round looks up the rank of every adjacent pair, takes the
minimum rank per segment (``minimum.reduceat``), merges its leftmost
occurrences in all segments at once, and compacts the arrays; segments
without a pair left are taken out, until none remains.

All occurrences of the minimum pair are merged in one round only where that
cannot differ from merging them one by one: no pair that holds the merged
piece may rank before it, and no other piece may share its score. Otherwise
only the leftmost occurrence is merged in that round.

Edge cases: a null or empty text has no ids and decodes to the empty string.
Characters outside the vocabulary become byte pieces. Texts of any length
are encoded whole: every segment is further cut where no piece holds its two
neighbouring characters. Repeated rows give repeated results, an empty table
an empty one; other columns pass through and the new ones get fresh names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.llm.common import fresh

SPACE = "▁"
NONE = np.iinfo(np.int64).max
#: Segments remembered by one worker, and the longest one that it remembers.
CACHE_SEGMENTS, CACHE_CHARS = 400_000, 64


class Codec:
    """The pair table of one model file, and its encoder and decoder."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.byte_id = np.zeros(256, dtype=np.int32)
        self.raw: list[bytes] = []  # what an id decodes to
        self.is_byte = np.zeros(n, dtype=bool)
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.byte_id[b], self.is_byte[i] = i, True
                self.raw.append(bytes([b]))
            elif sp.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.raw.append(b"" if sp.is_control(i) else p.replace(SPACE, " ").encode())
        self.starts_with_space = [p.startswith(SPACE) for p in pieces]

        own = {p: i for i, p in enumerate(pieces) if not special[i]}
        scores = np.array([sp.get_score(i) for i in range(n)])
        _, rank = np.unique(-scores, return_inverse=True)  # equal scores share a rank
        self.char_id = np.full(0x110000, -1, dtype=np.int64)
        pairs, self.joined = {}, set()
        for p, i in own.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
            self.joined.update(zip(p, p[1:]))
            for k in range(1, len(p)):
                a, b = own.get(p[:k]), own.get(p[k:])
                if a is not None and b is not None:
                    pairs[(a, b)] = i
        self.n = n
        keys = np.array([a * n + b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        made = np.array(list(pairs.values()), dtype=np.int64)[order]
        self.keys, self.made, self.rank = keys[order], made, rank[made].astype(np.int64)
        # an id is safe to merge everywhere at once (see the module's text)
        self.safe = np.bincount(rank[list(own.values())], minlength=rank.max() + 1)[rank] == 1
        for side in (self.keys // n, self.keys % n):
            self.safe[side[self.rank <= rank[side]]] = False
        if any(b == SPACE and a != SPACE for a, b in self.joined):
            raise ValueError("a piece spans two words; this model needs another way to cut segments")
        cut = "" if any("\n" in x for x in self.joined) else "\n"
        self.segments = re.compile(f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" + ("|\n" if cut else "")).findall
        self.known: dict[str, bytes] = {}

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each segment, by rounds of merges."""
        if not segments:
            return []
        code = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        seg = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        sym = self.char_id[code]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            rank = np.full(len(sym), NONE, dtype=np.int64)
            made = np.zeros(len(sym), dtype=np.int64)
            near = np.flatnonzero((seg[:-1] == seg[1:]) & (sym[:-1] >= 0) & (sym[1:] >= 0))
            key = sym[near] * self.n + sym[near + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            rank[near[hit]], made[near[hit]] = self.rank[at[hit]], self.made[at[hit]]
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(seg)]))
            over = least == NONE
            if over.any():  # compaction: segments without a pair leave
                done.append((seg[over], sym[over], code[over]))
                rest = ~over
                seg, sym, code, rank, made, least = (x[rest] for x in (seg, sym, code, rank, made, least))
                if not len(sym):
                    break
            left = np.flatnonzero(rank == least)
            first = np.r_[True, seg[left[1:]] != seg[left[:-1]]]
            run = np.r_[True, np.diff(left) != 1]
            place = np.arange(len(left))
            even = (place - place[run][np.cumsum(run) - 1]) % 2 == 0  # of overlapping ones the leftmost
            left = left[np.where(self.safe[made[left]], even, first)]
            sym[left] = made[left]
            keep = np.ones(len(sym), dtype=bool)
            keep[left + 1] = False
            seg, sym, code = seg[keep], sym[keep], code[keep]
        seg, sym, code = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(seg, kind="stable")
        seg, sym, code = seg[order], sym[order], code[order]
        if (sym < 0).any():  # byte fallback
            tails = [self.byte_id[list(chr(c).encode("utf-8", "surrogatepass"))] if s < 0 else (s,)
                     for s, c in zip(sym.tolist(), code.tolist())]
            seg = np.repeat(seg, [len(x) for x in tails])
            sym = np.concatenate([np.asarray(x) for x in tails])
        ends = np.searchsorted(seg, np.arange(len(segments) + 1))
        flat = sym.astype("<i4").tobytes()
        return [flat[4 * a:4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _pieces_of(self, segment: str) -> list[str]:
        """A long segment cut where no piece holds the two characters."""
        if len(segment) <= CACHE_CHARS:
            return [segment]
        cuts = [0, *(i + 1 for i, p in enumerate(zip(segment, segment[1:])) if p not in self.joined), len(segment)]
        return [segment[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.segments(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        cut = [[y for x in s for y in self._pieces_of(x)] if any(len(x) > CACHE_CHARS for x in s) else s for s in cut]
        if len(self.known) > CACHE_SEGMENTS:
            self.known.clear()
        known = self.known
        new = list({x for s in cut for x in s if x not in known})
        found = dict(zip(new, self.encode_segments(new)))
        known.update(found)
        out = [np.frombuffer(b"".join([known[x] for x in s]), dtype="<i4") for s in cut]
        for x in found:
            if len(x) > CACHE_CHARS:
                del known[x]
        return out

    def decode(self, ids) -> str:
        """The text of one list of ids."""
        ids = np.asarray(ids)
        if not len(ids):
            return ""
        raw = self.raw
        data = b"".join([raw[i] for i in ids.tolist()])
        head = next((i for i in ids.tolist() if raw[i]), ids[0])  # control pieces have no text
        skip = 1 if self.starts_with_space[head] else 0  # the space put before the text
        try:
            return data.decode()[skip:]
        except UnicodeDecodeError:  # byte pieces that form no character: one mark for each byte
            out, held = [], b""
            for i in [*ids.tolist(), -1]:
                if i >= 0 and self.is_byte[i]:
                    held += raw[i]
                    continue
                while held:
                    k = next((k for k in (1, 2, 3, 4) if _is_char(held[:k])), 0)
                    out.append(held[:k].decode() if k else "�")
                    held = held[k or 1:]
                if i >= 0:
                    out.append(raw[i].decode())
            return "".join(out)[skip:]


def _is_char(b: bytes) -> bool:
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


_CODECS: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """The worker's codec of a model file."""
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def encode_decode(df: DataFrame, model_file: str, text: str = "text", rows: int = 256) -> tuple[DataFrame, str, str]:
    """``df`` with the ids of each whole text and the text decoded from them.

    Returns it and the names of the two new columns. ``rows`` texts are
    encoded at a time, which bounds what a task holds."""
    ids_name, decoded_name = fresh(df, "ids", "decoded")
    schema = T.StructType([*df.schema.fields, T.StructField(ids_name, T.ArrayType(T.IntegerType(), False)),
                           T.StructField(decoded_name, T.StringType())])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                b = whole.slice(a, rows)
                ids = c.encode(b.column(place).to_pylist())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
                texts = pa.array([c.decode(x) for x in ids], type=pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, lists, texts], names=[*b.schema.names, ids_name, decoded_name])

    return df.mapInArrow(run, schema), ids_name, decoded_name


def sentencepiece_query(docs: DataFrame, model_file: str) -> DataFrame:
    """Contract of ``op10``: counts and digests of the ids and decoded text."""
    out, ids, decoded = encode_decode(docs.select("doc_id", "text"), model_file)
    return out.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
