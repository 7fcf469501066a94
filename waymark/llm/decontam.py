"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are reduced to lower-case letters and digits with single blanks. Every q-gram of a text is
looked up among those of the items; a shared one lies on a diagonal (text position less item position), and hits are
counted in bands of diagonals, each overlapping its neighbours by half. Two strings of length m within k edits share
at least m + 1 - q - k * q q-grams in a band as wide as k. An item's q is as long as makes this positive for every part
that counts (at least cover of the item, and at least `q` characters, with the edit budget of that part), up to `q`
itself; bands that reach the least of these bounds are retained, so no match is lost. What is retained is verified by
banded alignment: at least cover of the item, at most budget edits a character. Hits that are no match as a whole, such
as a passage with a phrase replaced, are searched for parts that are. Items of fewer than `q` characters, which any text
may hold by chance, are compared with whole texts.

The index holds one slice of the benchmark, about slice_chars characters of distinct texts; a larger benchmark takes
several passes, one slice in memory at a time. Long texts are searched in segments that overlap by more than a match can
be long, and hits are worked off for some pairs of segment and item at a time, HITS of them or those of one pair, so
that memory grows neither with the number of items nor with how often they share a q-gram.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpointed, text_batches

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CELLS = 22  # bits of the first filter's table
PIECE = 1 << 21  # characters worked off at a time; a longer text is one piece of its own
HITS = 1 << 21  # shared q-grams held at a time
SEGMENT = 1 << 13  # characters of a text searched together, at least


@lru_cache(maxsize=1)
def kept_points() -> np.ndarray:
    """Which code points are letters, marks or digits."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def reduced(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the reduced text, and the place of each in the lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = kept_points()[points]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    at = np.flatnonzero(keep)
    return np.where(solid[at], points[at], 32).astype(np.uint32), at


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all q-grams, by doubling."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    power, width, h = MULTIPLIER, 1, points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    out, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if q & width:
                if out is None:
                    out, done = h, width
                else:
                    shift = np.uint64(pow(int(MULTIPLIER), width, 1 << 64))
                    n = len(points) - done - width + 1
                    out, done = out[:n] * shift + h[done : done + n], done + width
            if done == q:
                return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h[:-width] * power + h[width:]
            power, width = power * power, 2 * width


def parts_of(length: int, least: int, cover: float, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """The lengths that a match of an item may have, and the edits that each may have."""
    m = np.arange(max(int(np.ceil(cover * length)), min(length, least)), length + 1)
    return m, np.floor(budget * m).astype(np.int64)


def gram_length(length: int, most: int, cover: float, budget: float) -> int:
    """The longest q up to most for which the lemma's bound is positive for every match of an item of that length."""
    m, k = parts_of(length, most, cover, budget)
    return max(1, min(most, int((m // (k + 1)).min(initial=most))))


class Slice:
    """One slice of the benchmark: an index for each q that its items take, and the items too short for any."""

    def __init__(self, ids: list, items: list[np.ndarray], q: int, cover: float, budget: float):
        self.ids = ids
        self.short: dict[bytes, list[int]] = {}
        by_q: dict[int, list[int]] = {}
        for i, x in enumerate(items):
            if len(x) >= q:
                by_q.setdefault(gram_length(len(x), q, cover, budget), []).append(i)
            elif len(x):
                self.short.setdefault(x.tobytes(), []).append(i)
        self.parts = [(own, Index([ids[i] for i in own], [items[i] for i in own], g, cover, budget, q)) for g, own in sorted(by_q.items())]
        self.longest = max(map(len, self.short), default=0)

    def search(self, texts: list[str]) -> list[tuple]:
        """As Index.search, over all items."""
        forms = [reduced(t) for t in texts]
        out = []
        for own, index in self.parts:
            out += [(m[0], own[m[1]], *m[2:]) for m in index.search(texts, forms)]
        for t, (points, at) in enumerate(forms if self.short else []):
            solid = np.flatnonzero(points != 32) if points.nbytes <= self.longest + 8 else []
            if len(solid):
                first, last = solid[0], solid[-1]
                out += [(t, i, int(at[first]), int(at[last]) + 1, 0, int(last - first) + 1, 0, 0) for i in self.short.get(points[first : last + 1].tobytes(), [])]
        return sorted(out)


@dataclass
class Index:
    """The q-grams of items."""

    ids: list
    items: list[np.ndarray]
    q: int
    cover: float
    budget: float
    least_chars: int | None = None

    def __post_init__(self):
        grams = [gram_hashes(x, self.q) for x in self.items]
        length = np.array([len(x) for x in self.items], np.int64)
        parts = [parts_of(len(x), self.least_chars or self.q, self.cover, self.budget) for x in self.items]
        self.least = np.array([m[0] for m, _ in parts], np.int64)
        self.need = np.array([max(1, int((m + 1 - self.q - k * self.q).min())) for m, k in parts], np.int64)
        self.band = int(max([8, *np.floor(self.budget * length)]))
        h = np.concatenate([np.zeros(0, np.uint64), *grams])
        by = np.argsort(h, kind="stable")
        self.item = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])[by]
        self.place = np.concatenate([np.zeros(0, np.int32), *[np.arange(len(g), dtype=np.int32) for g in grams]])[by]
        self.keys, self.first, self.times = np.unique(h[by], return_index=True, return_counts=True)
        self.cells = np.zeros(1 << CELLS, bool)
        self.cells[(self.keys >> np.uint64(64 - CELLS)).astype(np.int64)] = True
        self.reach = 2 * int(max([0, *length])) + self.q  # more than a match and what may prolong it
        self.stride = max(SEGMENT, 4 * self.reach)

    def search(self, texts: list[str], forms: list | None = None) -> list[tuple]:
        """(text number, item number, start, end, item start, item end, shared q-grams, edits) of verified matches;
        start and end are character offsets in the lower-cased text. A match within another of its item is left out."""
        forms = forms or [reduced(t) for t in texts]
        if not self.items or not forms:
            return []
        points = np.concatenate([p for p, _ in forms])
        size = np.array([len(p) for p, _ in forms], np.int64)
        begin = np.cumsum(size) - size
        h = gram_hashes(points, self.q)
        maybe = np.flatnonzero(self.cells[(h >> np.uint64(64 - CELLS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), max(0, len(self.keys) - 1))
        ok = self.keys[at] == h[maybe] if len(self.keys) else np.zeros(0, bool)
        pos, at = maybe[ok], at[ok]
        owner = np.searchsorted(begin, pos, "right") - 1
        within = pos + self.q <= begin[owner] + size[owner]
        pos, at, owner = pos[within], at[within], owner[within]
        # Segments: each begins a stride after the one before and holds what a match that begins in the stride can reach.
        first = (pos - begin[owner]) // self.stride
        again = np.flatnonzero((first > 0) & ((pos - begin[owner]) % self.stride < self.reach))
        pos, at, owner = (np.concatenate([x, x[again]]) for x in (pos, at, owner))
        segment = np.concatenate([first, first[again] - 1])
        found: dict[tuple, list] = {}
        order = np.lexsort((pos, segment, owner))
        pos, at, owner, segment = (x[order] for x in (pos, at, owner, segment))
        new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(segment) != 0), [True]]) if len(pos) else np.zeros(1, bool)
        edges, total = np.flatnonzero(new), np.concatenate([[0], np.cumsum(self.times[at], dtype=np.int64)])
        k = 0
        while k + 1 < len(edges):  # as many whole segments as have HITS shared q-grams, each worked off once
            to = max(k + 1, int(np.searchsorted(total[edges], total[edges[k]] + HITS, "right")) - 1)
            own = slice(edges[k], edges[to])
            parts = max(1, -(-int(total[edges[to]] - total[edges[k]]) // HITS))
            for part in range(parts):  # more than one if a single segment has more
                self._matches(pos[own], at[own], owner[own], segment[own], part, parts, points, begin, size, found)
            k = to
        out = []
        for (t, i), rows in found.items():
            last = -1
            for m in sorted(set(rows), key=lambda m: (m[0], -m[1], -m[4], m[5])):
                if m[1] > last:
                    where, last = forms[t][1], m[1]
                    out.append((t, i, int(where[m[0]]), int(where[m[1] - 1]) + 1, *m[2:]))
        return sorted(out)

    def _matches(self, pos, at, owner, segment, part, parts, points, begin, size, found) -> None:
        """Adds the matches of those pairs of segment and item that fall to part of parts."""
        new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(segment) != 0)]) if len(pos) else np.zeros(0, bool)
        room = np.cumsum(new) - 1  # number of the segment
        total = np.cumsum(self.times[at])
        held: list[list[np.ndarray]] = [[], [], [], []]
        cuts = np.searchsorted(total, np.arange(HITS, (int(total[-1]) if len(total) else 0) + HITS, HITS), "right") if len(total) else np.zeros(0, np.int64)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pos)]):
            times = self.times[at[a:b]]
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            posting = np.repeat(self.first[at[a:b]], times) + step
            row = np.repeat(np.arange(a, b), times)
            mine = (room[row] * 1_000_003 + self.item[posting]) % parts == part if parts > 1 else slice(None)
            row, posting = row[mine], posting[mine]
            for x, y in zip(held, (row, self.item[posting], self.place[posting], room[row] * len(self.items) + self.item[posting]), strict=True):
                x.append(y)
        row, item, place, pair = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in held)
        # Counting pairs first: most have too few hits for any band.
        by = np.argsort(pair, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(pair[by]) != 0, [True]])) if len(by) else np.zeros(1, np.int64)
        enough = np.diff(edge) >= self.need[item[by[edge[:-1]]]]
        live = by[np.repeat(enough, np.diff(edge))]
        row, item, place, pair = (x[live] for x in (row, item, place, pair))
        hit = pos[row]
        diagonal = hit - begin[owner[row]] - place + (1 << 40)
        for shift in (0, self.band):
            band = (diagonal + shift) // (2 * self.band)
            by = np.lexsort((hit, band, pair))
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(pair[by]) != 0) | (np.diff(band[by]) != 0), [True]])) if len(by) else np.zeros(1, np.int64)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                rows = by[a:b]
                i, t, k = int(item[rows[0]]), int(owner[row[rows[0]]]), int(segment[row[rows[0]]])
                if b - a >= self.need[i]:
                    start = int(begin[t]) + k * self.stride
                    text = points[start : min(int(begin[t] + size[t]), start + self.stride + self.reach)]
                    for m in self.verify(place[rows], hit[rows] - start, i, text):
                        found.setdefault((t, i), []).append((m[0] + k * self.stride, m[1] + k * self.stride, *m[2:]))

    def verify(self, p: np.ndarray, x: np.ndarray, i: int, text: np.ndarray):
        """(start, end, item start, item end, shared q-grams, edits) of clusters of a band's hits, at places p of the
        item and x of the text, that the alignment confirms; a gap that no budget bridges parts clusters."""
        q, item = self.q, self.items[i]
        order = np.lexsort((x, p))
        p, x = p[order], x[order]
        gap = 2 * q + int(self.budget * len(item)) * q
        parts = np.split(np.arange(len(p)), np.flatnonzero((np.diff(p) > gap) | (np.diff(x) < -2 * self.band) | (np.diff(x) > gap + 2 * self.band)) + 1)
        for c in parts:
            if len(np.unique(p[c])) < self.need[i]:
                continue
            ia, ib, a, b = int(p[c[0]]), int(p[c[-1]]) + q, int(x[c[0]]), int(x[c[-1]]) + q
            if ib - ia >= self.least[i] and b > a:
                limit = int(self.budget * (ib - ia))
                edits = banded_distance(item[ia:ib], text[a:b], limit)
                if edits <= limit:
                    yield a, b, ia, ib, len(c), edits
                    continue
            for ia, ib, a, b, edits in self.regions(p[c], x[c], item, text, int(self.least[i])):
                yield a, b, ia, ib, int(np.sum((p[c] >= ia) & (p[c] <= ib - q) & (x[c] >= a) & (x[c] <= b - q))), edits

    def regions(self, p, x, item, text, least):
        """Matches within a cluster that isn't one as a whole. A match has an unedited q-gram, so each run of hits along
        a diagonal is prolonged to both sides by banded alignment, as far as the budget of the whole item can reach."""
        q, most = self.q, int(self.budget * len(item))
        by = np.lexsort((p, x - p))
        p, x = p[by], x[by]
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(x - p) != 0) | (np.diff(p) != 1), [True]]))
        found: list[tuple] = []
        for n, k in sorted(zip(np.diff(cuts).tolist(), cuts[:-1].tolist(), strict=True), key=lambda r: (-r[0], r[1])):
            ia, ib, a, b = int(p[k]), int(p[k]) + n - 1 + q, int(x[k]), int(x[k]) + n - 1 + q
            if any(ia < f[1] and f[0] < ib and a < f[3] and f[2] < b for f in found):
                continue  # what it would be prolonged to overlaps that match too
            if n - 1 + q == len(item):
                found.append((ia, ib, a, b, 0))
                continue
            on = reaches(item[ib:], text[b : b + len(item) - ib + most], most)
            back = reaches(item[:ia][::-1], text[max(0, a - ia - most) : a][::-1], most)
            best = None
            for e, (i, j) in enumerate(back):
                for f, (k_, m) in enumerate(on):
                    long = ib - ia + i + k_
                    if long >= least and e + f <= int(self.budget * long) and (best is None or (long - q * (e + f), -e - f) > best[0]):
                        best = (long - q * (e + f), -e - f), (ia - i, ib + k_, a - j, b + m, e + f)
            if best and not any(best[1][0] < f[1] and f[0] < best[1][1] and best[1][2] < f[3] and f[2] < best[1][3] for f in found):
                found.append(best[1])
        return found


def reaches(a: np.ndarray, b: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """For each number of edits up to limit, the longest start of a that is a start of b with so many, and that of b."""
    w, far = 2 * limit + 1, 1 << 30
    shift, step = np.arange(w) - limit, np.arange(w)
    row = np.where((shift >= 0) & (shift <= len(b)), shift, far).astype(np.int64)
    out = [(0, 0)] * (limit + 1)
    for i in range(1, len(a) + 1):
        j = i + shift
        inside = (j >= 1) & (j <= len(b))
        same = np.zeros(w, bool)
        same[inside] = b[j[inside] - 1] == a[i - 1]
        new = np.where(inside, row + ~same, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[j == 0] = i
        outside = (j < 0) | (j > len(b))
        new[outside] = far
        new = np.minimum.accumulate(new - step) + step  # insertions along the row
        new[outside] = far
        row, k = new, int(new.argmin())
        if row[k] > limit:
            break
        for e in range(int(row[k]), limit + 1):
            out[e] = (i, i + int(shift[k]))
    return out


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance if it is at most limit, else limit + 1; only the band of limit diagonals either way is computed."""
    if len(a) == len(b) and (a == b).all():
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    w, far = 2 * limit + 1, 1 << 30
    shift = np.arange(w) - limit  # column k of row i is b position i + shift[k]
    row = np.where(shift >= 0, shift, far).astype(np.int64)
    step = np.arange(w)
    for i in range(1, len(a) + 1):
        j = i + shift
        inside = (j >= 1) & (j <= len(b))
        same = np.zeros(w, bool)
        same[inside] = b[j[inside] - 1] == a[i - 1]
        new = np.where(inside, row + ~same, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[j == 0] = i
        new[(j < 0) | (j > len(b))] = far
        new = np.minimum.accumulate(new - step) + step  # insertions along the row
        new[(j < 0) | (j > len(b))] = far
        row = new
        if row.min() > limit:
            return limit + 1
    return int(min(row[len(b) - len(a) + limit], limit + 1))


def _slices(benchmark: DataFrame, item_col, text_col, q, cover, budget, slice_chars):
    """(number of slices, whether texts are repeated, one index at a time of about slice_chars characters).

    Texts are indexed once each, under the id of their item, or if several items share a text, under its digest."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
    once = items.groupBy("t").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n"))
    chars, most = once.agg(F.sum(F.length("t")), F.max("n")).first()
    n, repeated = max(1, -(-(chars or 0) // slice_chars)), (most or 0) > 1

    def indexes():
        for k in range(n):
            rows = once.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k).select(F.md5("t") if repeated else "i", "t").collect()
            rows = sorted(((r[0], reduced(r[1])[0]) for r in rows), key=lambda r: (r[0] is None, r[0], len(r[1])))
            yield Slice([i for i, _ in rows], [p for _, p in rows], q, cover, budget)

    return n, repeated, indexes()


def _pieces(texts: list[str | None]):
    """Lists of text numbers, a few million characters each."""
    part, held = [], 0
    for n, t in enumerate(texts):
        if t:
            part.append(n)
            held += len(t)
            if held > PIECE:
                yield part
                part, held = [], 0
    if part:
        yield part


MATCH = "item_start int, item_end int, shared_qgrams int, edits int"


def matches(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", q: int = 10, cover: float = 0.5, budget: float = 0.07, slice_chars: int = 4_000_000) -> DataFrame:
    """One row per verified match: id, item id, start and end (characters of the lower-cased text), item_start and
    item_end (of the reduced item), shared_qgrams, edits.

    Null and empty texts on either side match nothing; items of fewer than q characters once reduced match texts that
    are the item and nothing else, with no q-gram shared; items
    that occur several times in a text, or twice in the benchmark, match each time. Only the named columns are read;
    an empty table gives an empty result."""
    spark = docs.sparkSession
    text_batches(spark)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n, repeated, indexes = _slices(benchmark, item_col, item_text_col, q, cover, budget, slice_chars)
    item = T.StructField("item", T.StringType() if repeated else benchmark.schema[item_col].dataType)
    schema = T.StructType([T.StructField("id", narrow.schema["id"].dataType), item, T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), *T._parse_datatype_string(MATCH).fields])
    item_type = to_arrow_type(item.dataType)
    out = None
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for b in batches:
                texts, found = b.column(1).to_pylist(), []
                for part in _pieces(texts):
                    found += [(part[m[0]], *m[1:]) for m in index.search([texts[n] for n in part])]
                col = list(zip(*found, strict=True)) if found else [[]] * 8
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(col[0], pa.int64())), pa.array([index.ids[i] for i in col[1]], item_type), pa.array(col[2], pa.int64()), pa.array(col[3], pa.int64()), *[pa.array(c, pa.int32()) for c in col[4:]]], names=["id", "item", "start", "end", "item_start", "item_end", "shared_qgrams", "edits"])

        one = narrow.mapInArrow(run, schema)
        if n > 1:  # a slice is searched for and let go before the next is built
            one = checkpointed(one)
            shared.destroy()
        out = one if out is None else out.unionByName(one)
    if repeated:
        known = benchmark.filter(F.col(item_text_col).isNotNull()).select(F.md5(item_text_col).alias("item"), F.col(item_col).alias("__item"))
        out = out.join(known, "item").select("id", F.col("__item").alias("item"), *out.columns[2:])
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col if item_col != id_col else f"benchmark_{item_col}")


def clean(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text", q: int = 10, cover: float = 0.5, budget: float = 0.07, slice_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs, as they are, whose text has no match. With a benchmark of one slice there is no exchange, each
    row is judged where it is read; else the digests of the texts that match are joined."""
    spark = docs.sparkSession
    text_batches(spark)
    n, _, indexes = _slices(benchmark, item_col, item_text_col, q, cover, budget, slice_chars)
    at = docs.columns.index(text_col)
    bad_texts = lambda index, texts: {part[m[0]] for part in _pieces(texts) for m in index.search([texts[n] for n in part])}
    found = None
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)

        def keep(batches, shared=shared):
            for b in batches:
                texts = b.column(at).to_pylist()
                bad = bad_texts(shared.value, texts)
                yield b.filter(pa.array([n not in bad for n in range(len(texts))], pa.bool_()))

        def flag(batches, shared=shared):
            for b in batches:
                texts = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(sorted(bad_texts(shared.value, texts)), pa.int64()))], names=["digest"])

        if n == 1:
            return docs.mapInArrow(keep, docs.schema)
        one = checkpointed(docs.select(F.col(text_col).alias("text"), F.md5(text_col).alias("digest")).mapInArrow(flag, "digest string").distinct())
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    digest = F.md5(docs[text_col])
    return docs.join(found, digest == found["digest"], "left_anti")
