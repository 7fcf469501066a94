"""Token counts of byte-level BPE by rank-synchronous array merging.

A text is split at special strings and then into pre-tokens. Pre-tokens not met before by this task are gathered, and
a whole batch of them is held as one ragged array of symbol ids. Each round finds every sequence's lowest-ranked
adjacent pair, merges all its occurrences in all sequences at once, and looks up only the pairs that changed; a
sequence with no pair left is done, and its surviving symbols are its tokens. Counts are kept by pre-token in a
cache of bounded size.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches, utf8

#: Fixed value: the public pattern that splits text before the merges of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int64(1 << 40)
CACHE = 1 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """A byte-level BPE vocabulary as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.start = np.array([vocab[c] for c in byte_letters()], np.int64)
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 20 | right
        by = np.argsort(key)
        self.keys, self.rank, self.made = key[by], by.astype(np.int64), made[by]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank << 20 | position in the table of each pair; NONE if it doesn't merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at] << 20 | at, NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece."""
        size = np.array([len(p) for p in pieces], np.int64)
        out = size.copy()
        ids = self.start[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), size)
        last = np.ones(len(ids), bool)
        last[:-1] = owner[1:] != owner[:-1]
        pair = np.full(len(ids), NONE)
        inner = np.flatnonzero(~last)
        pair[inner] = self.look_up(ids[inner], ids[inner + 1])
        while len(ids):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            length = np.diff(np.append(begin, len(ids)))
            low = np.minimum.reduceat(pair, begin)
            live = low < NONE
            out[owner[begin[~live]]] = length[~live]
            keep = np.repeat(live, length)
            ids, owner, last, pair = ids[keep], owner[keep], last[keep], pair[keep]
            if not len(ids):
                break
            hit = pair == np.repeat(low[live], length[live])
            # Of touching occurrences (aaa: a a) every second is merged, from the left.
            at = np.flatnonzero(hit)
            run = np.concatenate([[True], np.diff(at) > 1])
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            ids[at] = self.made[pair[at] & 0xFFFFF]
            last[at] = last[at + 1]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            touched = np.zeros(len(ids), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            before = at[at > 1] - 2  # the symbol before may have been merged away, then the one before it is the neighbour
            touched[before] |= ~stay[before + 1]
            ids, owner, last, pair, touched = ids[stay], owner[stay], last[stay], pair[stay], touched[stay]
            again = np.flatnonzero(touched & ~last)
            pair[touched] = NONE
            pair[again] = self.look_up(ids[again], ids[again + 1])
        return out


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point: 0 other, 1 letter, 2 number, 3 white space, as PATTERN has them."""
    out = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, points):
            a, z = ord(points[m.start()]), ord(points[m.end() - 1])
            out[a : z + 1] = kind
    return out


def token_starts(points: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where PATTERN's matches start in texts laid end to end, of which non-empty ones start at begin.

    A run of one class is a match; a single blank before it belongs to it; white space before something gives up its
    last character; an apostrophe at a match's start takes its contraction with it."""
    kind = classes()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[begin] = True
    first[n] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    solid = np.flatnonzero(run & (kind != 3) & ~first[:n])
    after_space = solid[kind[solid - 1] == 3]
    start[after_space - 1] = True
    start[after_space[points[after_space - 1] == 32]] = False
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[(quote + 1 < n)]
    quote = quote[~first[quote + 1]]
    at = lambda i, ok: np.where(ok, points[np.minimum(i, n - 1)], 0)
    one = points[quote + 1]
    two = at(quote + 2, (quote + 2 < n) & ~first[np.minimum(quote + 2, n)])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for hit, size in ((quote[short], 2), (quote[long & ~short], 3)):
        start[hit + 1] = False
        if size == 3:
            start[hit + 2] = False
        ends = hit + size
        start[ends[ends < n]] = True
        # What follows the contraction starts a match of its own; a blank before a solid run is settled above.
    return np.flatnonzero(start)


class Counter:
    """Counts the tokens of texts, remembering pre-tokens."""

    def __init__(self, table: Merges):
        self.table, self.known = table, {}
        self.split = regex.compile("|".join(map(regex.escape, table.specials))) if table.specials else None

    def count(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        parts = [[t or ""] if self.split is None or not t else self.split.split(t) for t in texts]
        flat = [p for ps in parts for p in ps]
        owner = np.repeat(np.arange(len(texts)), [len(ps) for ps in parts])
        out = np.array([len(ps) - 1 for ps in parts], np.int64)
        joined = "".join(flat)
        if not joined:
            return out
        size = np.array([len(p) for p in flat], np.int64)
        begin = np.cumsum(size) - size
        starts = token_starts(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), begin[size > 0])
        cuts = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(cuts, [*cuts[1:], len(joined)])]
        fresh = [p for p in set(pieces) if p not in self.known]
        if fresh:
            self.known.update(zip(fresh, self.table.count([p.encode("utf-8", "surrogatepass") for p in fresh]).tolist()))
        tokens = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        part = np.searchsorted(begin[size > 0], starts, "right") - 1
        np.add.at(out, owner[size > 0], np.bincount(part, tokens, int((size > 0).sum())).astype(np.int64))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One in each Python worker."""
    return Counter(Merges(path))


def count_tokens(docs: DataFrame, vocabulary: str, id_col="doc_id", text_col="text", limit: int = 1024) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    vocabulary is the path of a byte-level BPE .json, the same on every machine. Null and empty texts have 0 bytes
    and 0 tokens; a special token's string inside a text is that one token. Only the two columns are read; repeated
    rows are counted each; an empty table gives an empty result."""
    text_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        counts = counter(vocabulary).count
        for b in batches:
            size = np.diff(utf8(b.column(1))[1])
            texts, found, part, held = b.column(1).to_pylist(), [], [], 0
            for t in texts:  # a few million characters at a time
                part.append(t)
                held += len(t or "")
                if held > 1 << 21:
                    found += counts(part).tolist()
                    part, held = [], 0
            found += counts(part).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(found, pa.int64()), pa.array([n > limit for n in found], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([narrow.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
