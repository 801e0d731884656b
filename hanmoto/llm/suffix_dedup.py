"""Removal of byte strings that documents with smaller ids already have, by hash-compared suffix sort.

Documents are written as blocks. In each window of LENGTH bytes the GRAM-byte span with the smallest prefix hash is the window's
anchor; windows in a row with the same anchor make a segment. Equal windows have equal anchors at equal places, so it is enough to
compare segments with equal anchors. This happens in three rounds over the blocks, with packed values in between:

1. Segments' hashes go to their anchor's part, where it is decided which segments must meet as text: equal hashes, and different segments
   that may share a window. Each carries short hashes of the SIDE bytes left and right of its anchor: a window has so many on one side
   at least, so different segments with neither in common have no window in common.
2. These meet in parts, an anchor in one. Equal texts are verified byte by byte and from then on are one. Of different ones the windows
   with the same place of the anchor are sorted as suffixes: a mergesort whose comparisons find the longest common extension by binary
   search on prefix hashes. Neighbours with a common extension of a whole window are verified byte by byte too, and each class of
   windows gets its smallest document. (Unequal segments whose anchors and 48-bit hashes collide stay, and aren't sorted again.)
3. Blocks mark the windows found in smaller documents and cut their bytes out. No byte goes unless it was compared with its equal.

An anchor with more than HOT segments isn't one group: its equal segments are verified in groups of CROWD against a witness that goes to
each, and its different ones are sent window by window to groups of windows with one hash. A block sends a string once, however often it
holds it, so what a hot passage sends grows with blocks and not with rows. The first round holds 26 bytes for each segment of an
anchor that differs between or within blocks.

Defined results: a null text is empty; a null id counts as larger than any other; equal ids (repeated rows) aren't smaller
than each other and so remove nothing of each other; texts shorter than a window keep everything; a text longer than a block is a block
of its own and is hashed in pieces; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, tasks
from .prefix_hash import PRIME, PrefixHash, WrapHash, mix, powers, reduce, wrap_hash

#: Bytes of a window and of an anchor; grams in a window.
LENGTH, GRAM = 50, 20
GRAMS = LENGTH - GRAM + 1
SIDE = (LENGTH - GRAM) // 2
#: Bytes of a block, windows hashed at once, bytes of a part, bytes that a packed segment takes about.
BLOCK, CHUNK, PART, PACKED = 4 << 20, 1 << 16, 12 << 20, 18
#: Segments of an anchor that are compared as one group, equal segments that are verified against one copy of their witness.
HOT, CROWD = 4096, 2048
LAST = np.int64((1 << 63) - 1)


# Blocks


def _blocks(most: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        squeeze = zstandard.ZstdCompressor(level=3)

        def close() -> pa.RecordBatch:
            data = squeeze.compress(b"".join(texts))
            lengths = np.array([len(t) for t in texts], np.int64)
            return pa.record_batch([pa.array([(part << 32) + n]), pa.array([size]), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([lengths.tobytes()]), pa.array([data], pa.binary())], ["block", "n_bytes", "ids", "lengths", "data"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = (t or "").encode("utf-8", "surrogatepass")
                if texts and size + len(t) > most:
                    yield close()
                    n, ids, texts, size = n + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield close()

    return f


def write_blocks(docs: DataFrame, most: int = BLOCK) -> DataFrame:
    """``block, n_bytes, ids, lengths, data``, bucketed by block so that the rounds join to it without moving texts."""
    spark = docs.sparkSession
    name = f"hanmoto_blocks_{uuid.uuid4().hex}"
    table = docs.mapInArrow(_blocks(most), "block long, n_bytes long, ids binary, lengths binary, data binary")
    table.write.bucketBy(tasks(spark), "block").sortBy("block").option("path", f"{shared_dir(spark)}/{name}").option("compression", "none").saveAsTable(name)
    return spark.table(name)


# Segments


def spans_of(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of spans, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def same_bytes(data: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether the spans of two lists have equal bytes, pair by pair."""
    out = a_size == b_size
    for at in range(0, len(a), 20_000):
        i = at + np.flatnonzero(out[at : at + 20_000])
        if len(i):
            n = a_size[i]
            differ = data[spans_of(a[i], n)] != data[spans_of(b[i], n)]
            out[i] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return out


class Segments:
    """A block's segments in order: ``start``, ``count`` of windows, ``anchor`` (hash), ``place`` (of the anchor from the start), ``hash``, ``doc``,
    ``left`` and ``right``: hashes of the bytes beside the anchor, 0 where the segment holds too few."""

    def __init__(self, ids: bytes, lengths: bytes, data: bytes):
        self.ids, length = np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        self.ends = np.cumsum(length)
        self.begins = self.ends - length
        found = [self._chunk(at) for at in range(0, len(self.data) - LENGTH + 1, CHUNK)]
        self.start, self.count, self.place = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))
        self.anchor, self.hash, self.left, self.right = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.uint64) for i in (3, 4, 5, 6))
        self.doc = self.ids[np.searchsorted(self.ends, self.start, "right")] if found else np.empty(0, np.int64)

    def equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether segments x and y have the same bytes, pair by pair."""
        return same_bytes(self.data, self.start[x], self.count[x] + LENGTH - 1, self.start[y], self.count[y] + LENGTH - 1)

    def _chunk(self, at: int) -> tuple[np.ndarray, ...]:
        data = self.data[at : at + CHUNK + LENGTH - 1]
        n = len(data) - LENGTH + 1
        p = PrefixHash(data)
        m = n + GRAMS - 1
        order = reduce((p.sums[0][GRAM:][:m] + np.uint64(PRIME) - p.sums[0][:m]) * powers(0, m, True))
        low = mix(order) & np.uint64(~0xFFFFF & (1 << 64) - 1) | np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= GRAMS:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[GRAMS - width :][:n])
        where = (low & np.uint64(0xFFFFF)).astype(np.int64)
        # windows that reach over a document's end are nobody's
        valid = np.ones(n + 1, bool)
        valid[n] = False
        first, last = np.searchsorted(self.ends, [at, at + n + LENGTH])
        for e in self.ends[first : last + 1] - at:
            valid[max(0, e - LENGTH + 1) : max(0, min(e, n))] = False
        new = np.empty(n, bool)
        new[0], new[1:] = True, where[1:] != where[:-1]
        new[1:] |= ~valid[:-2]
        start = np.flatnonzero(new & valid[:n])
        stop = np.flatnonzero(np.r_[(new | ~valid[:n])[1:], True] & valid[:n]) + 1
        anchor = where[start]
        hashed = mix(p.span(anchor, np.full(len(anchor), GRAM)))
        size, side = stop - start + LENGTH - 1, np.full(len(anchor), SIDE)
        sides = []
        for ok, begin in ((anchor - start >= SIDE, anchor - SIDE), (start + size - anchor - GRAM >= SIDE, anchor + GRAM)):
            sides.append(np.where(ok, mix(p.span(np.where(ok, begin, 0), np.where(ok, side, 0))) >> np.uint64(48) | np.uint64(1), np.uint64(0)))
        return start + at, stop - start, anchor - start, hashed, mix(p.span(start, size)), *sides


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers, none of them -1, begin and end."""
    first = np.flatnonzero(np.diff(x, prepend=-1))
    return first, np.r_[first[1:], len(x)][: len(first)]


class Records:
    """A block's distinct segments, sorted by part, anchor and hash; ``of`` gives each segment's record."""

    def __init__(self, s: Segments, parts: int):
        self.segments = s
        part = (s.anchor % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((s.doc, s.hash, s.anchor, part))
        a, h = s.anchor[order], s.hash[order]
        new = np.ones(len(a), bool)
        again = np.flatnonzero((a[1:] == a[:-1]) & (h[1:] == h[:-1])) + 1
        new[again] = ~s.equal(order[again], order[again - 1])
        self.first = order[new]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.anchor, self.hash, self.doc, self.part = s.anchor[self.first], s.hash[self.first], s.doc[self.first], part[self.first]
        self.edges, self.stops = _runs(self.part)

    def parts(self) -> Iterator[tuple[int, int, int]]:
        yield from zip(self.part[self.edges].tolist(), self.edges.tolist(), self.stops.tolist(), strict=True)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The numbers' low bytes, one plane a byte, which packs better."""
    return x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(raw: np.ndarray, width: int) -> np.ndarray:
    n = len(raw) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for b in it:
        for i in range(b.num_rows):
            yield [c[i].as_py() for c in b.columns]


# Round 1: which segments meet


def _send_segments(parts: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for block, ids, lengths, data in _rows(batches):
            s = Segments(ids, lengths, data)
            r = Records(s, parts)
            out = [(p, squeeze.compress(_planes(r.anchor[i:j], 8) + _planes(r.hash[i:j], 6) + _planes(r.doc[i:j].view(np.uint64), 8) + _planes(s.left[r.first[i:j]], 2) + _planes(s.right[r.first[i:j]], 2))) for p, i, j in r.parts()]
            yield pa.record_batch([pa.array([p for p, _ in out], pa.int64()), pa.array([block] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], ["part", "block", "rows"])

    return f


def _settle_segments(most: int, crowded: int):
    def f(group: pa.Table) -> pa.Table:
        """For each block the records that must be compared as text: with their anchor's group, with a group of a given name, or window by window."""
        blocks = group.column("block").to_pylist()
        unpack = zstandard.ZstdDecompressor()
        widths, counts = (8, 6, 8, 2, 2), []
        columns: list[list[np.ndarray]] = [[] for _ in widths]
        for x in group.column("rows").to_pylist():
            raw = np.frombuffer(unpack.decompress(x), np.uint8)
            n, at = len(raw) // sum(widths), 0
            for c, w in zip(columns, widths, strict=True):
                c.append(_numbers(raw[at : at + w * n], w))
                at += w * n
            counts.append(n)
        anchor, h, doc, left, right = (np.concatenate(c) for c in columns)
        doc = doc.view(np.int64)
        order = np.lexsort((doc, h, anchor))
        a, h, d = anchor[order], h[order], doc[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (h[1:] != h[:-1])]
        first, number = np.flatnonzero(new), np.cumsum(new) - 1
        last = np.r_[first[1:], len(a)] - 1
        different = np.zeros(len(first), bool)  # distinct segments that share an anchor and a side with another
        for side in (left[order][first], right[order][first]):
            there = np.flatnonzero(side)
            by_side = there[np.lexsort((side[there], a[first][there]))]
            x, y = a[first][by_side], side[by_side]
            twin = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
            different[by_side[1:][twin]] = True
            different[by_side[:-1][twin]] = True
        least = d[first][number]
        copied = d[last] > d[first]  # classes that larger documents have too
        to_verify = d > least
        witness = np.zeros(len(d), bool)
        witness[first] = copied
        to_sort = different[number] & ~to_verify
        go = to_verify | to_sort | witness
        edges, stops = _runs(np.cumsum(np.r_[False, a[1:] != a[:-1]]))
        hot = np.repeat(np.add.reduceat(go.astype(np.int64), edges) > most, stops - edges)
        # of a hot anchor's class the members but the first documents', in crowds; the witness goes to each group
        rank = np.cumsum(to_verify) - 1
        rank -= rank[first][number] + (~to_verify[first][number]).astype(np.int64)
        crowd = np.maximum(rank, 0) // crowded
        name = mix(mix(a + h * np.uint64(0x9E3779B97F4A7C15)) + crowd.astype(np.uint64))
        named = np.flatnonzero(to_verify & hot)
        begins = named[rank[named] % crowded == 0]
        pairs = [(order[named], name[named]), (order[first[number[begins]]], name[begins])]
        picked = [(order[go & ~hot & ~to_sort], None), (order[to_sort & ~hot], None), tuple(np.concatenate(x) for x in zip(*pairs, strict=True)), (order[to_sort & hot], None)]
        ends = np.cumsum(counts)
        out = []
        cut = []
        for rows, names in picked:
            by = np.argsort(rows, kind="stable")
            cut.append((rows[by], None if names is None else names[by], np.searchsorted(rows[by], np.r_[0, ends])))
        for k, block in enumerate(blocks):
            at = ends[k] - counts[k]
            lists = [rows[e[k] : e[k + 1]] - at for rows, _, e in cut]
            if sizes := sum(len(x) * n for x, n in zip(lists, (LENGTH + GRAMS,) * 3 + (GRAMS * LENGTH // 2,), strict=True)):
                names, e = cut[2][1:]
                out.append((block, *(x.astype("<u4").tobytes() for x in lists), names[e[k] : e[k + 1]].tobytes(), sizes))
        part = group.column("part")[0].as_py()
        kinds = (*((k, pa.binary()) for k in (*LISTS, "names")), ("n", pa.int64()))
        return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "part": pa.array([part] * len(out), pa.int64()), **{k: pa.array([o[i + 1] for o in out], t) for i, (k, t) in enumerate(kinds)}})

    return f


#: Records that only meet their equals, that are sorted too, that meet in groups of a given name, that are sent window by window.
LISTS = ("plain", "sorted", "named", "split")
SETTLED = f"block long, part long, {', '.join(f'{k} binary' for k in LISTS)}, names binary, n long"
#: Added to the place of an item that is sorted.
SORTED = 128


# Round 2: suffix sort


def _send_texts(parts: int, text_parts: int):
    """A value: number of items; names of groups, documents, counts of windows, anchors' places; texts. An item is a segment or a single window."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for block, ids, lengths, data, answers in _rows(batches):
            s = Segments(ids, lengths, data)
            r = Records(s, parts)
            edge = {p: i for p, i, _ in r.parts()}
            which: dict[str, np.ndarray] = {k: np.concatenate([np.frombuffer(a[k], "<u4").astype(np.int64) + edge[a["part"]] for a in answers]) for k in LISTS}
            windows = s.count[r.first[which["split"]]]
            own = np.concatenate([*(which[k] for k in LISTS[:3]), np.repeat(which["split"], windows)])
            whole, lone = len(own) - int(windows.sum()), len(which["plain"])
            nth = np.concatenate([np.zeros(whole, np.int64), np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)])
            seg = r.first[own]
            start, count, place = s.start[seg] + nth, s.count[seg], s.place[seg]
            count[whole:], place[whole:] = 1, 0
            place[lone : lone + len(which["sorted"])] += SORTED
            names = [np.frombuffer(a["names"], "<u8") for a in answers]
            singles = [window_hashes(s.data, start[i : i + 50_000]) for i in range(whole, len(start), 50_000)]
            name = np.concatenate([r.anchor[which["plain"]], r.anchor[which["sorted"]], *names, *singles])
            part = (mix(name + np.uint64(text_parts)) % np.uint64(text_parts)).astype(np.int64)
            order = np.lexsort((name, part))
            out = []
            for i, j in zip(*_runs(part[order]), strict=True):
                at = order[i:j]
                text = s.data[spans_of(start[at], count[at] + LENGTH - 1)]
                raw = struct.pack("<I", len(at)) + name[at].tobytes() + r.doc[own[at]].tobytes() + count[at].astype(np.uint8).tobytes() + place[at].astype(np.uint8).tobytes() + text.tobytes()
                out.append((int(part[at[0]]), squeeze.compress(raw), own[at].astype("<u4").tobytes(), nth[at].astype(np.uint8).tobytes()))
            kinds = (("part", pa.int64()), ("rows", pa.binary()), ("which", pa.binary()), ("nth", pa.binary()))
            yield pa.record_batch({"block": pa.array([block] * len(out), pa.int64()), **{k: pa.array([o[i] for o in out], t) for i, (k, t) in enumerate(kinds)}})

    return f


SENT = "block long, part long, rows binary, which binary, nth binary"


def window_hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(wrap_hash(data[start[:, None] + np.arange(LENGTH)]))


class SuffixSort:
    """Sorts positions of a text by the LENGTH bytes from there, within groups."""

    def __init__(self, text: np.ndarray):
        self.text, self.hashes = text, WrapHash(text)

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether a's window comes before b's (or equals it, where that is asked)."""
        out = or_equal.copy()
        differ = np.flatnonzero(self.hashes.span(a, LENGTH) != self.hashes.span(b, LENGTH))
        x, y = a[differ], b[differ]
        common = self.hashes.common(x, y, LENGTH - 1)
        out[differ] = self.text[x + common] < self.text[y + common]
        return out

    def sort(self, pos: np.ndarray, group: np.ndarray) -> np.ndarray:
        """``pos`` with its groups side by side; gives the order that sorts each group. Runs double until they fill the largest group."""
        n = len(pos)
        first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
        size = np.diff(np.r_[first, n])
        base, length = np.repeat(first, size), np.repeat(size, size)
        order, width = np.arange(n), 1
        while width < size.max(initial=1):
            at = np.flatnonzero(length > width)  # whole groups
            i = at - base[at]
            run = i // width
            lo = np.minimum((run ^ 1) * width, length[at])
            hi = np.minimum(lo + width, length[at])
            right = run % 2 == 1
            own = pos[order[at]]
            low, high = lo.copy(), hi.copy()
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) >> 1
                other = pos[order[base[at[open_]] + mid]]
                before = self.less(other, own[open_], right[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            target = base[at] + (run & ~1) * width + (i - run * width) + (low - lo)
            moved = order.copy()
            moved[target] = order[at]
            order, width = moved, 2 * width
        return order

    def same_as_before(self, pos: np.ndarray, group: np.ndarray) -> np.ndarray:
        """For sorted positions: whether the window equals the one before; equal hashes are verified byte by byte."""
        out = np.zeros(len(pos), bool)
        if len(pos) > 1:
            h = self.hashes.span(pos, LENGTH)
            for part in np.array_split(np.flatnonzero((h[1:] == h[:-1]) & (group[1:] == group[:-1])) + 1, 1 + len(pos) // 100_000):
                span = np.arange(LENGTH)
                out[part] = (self.text[pos[part][:, None] + span] == self.text[pos[part - 1][:, None] + span]).all(1)
        return out


def _compare_texts(group: pa.Table) -> pa.Table:
    """For each record that came, the windows (a bit each) that a smaller document has too."""
    unpack = zstandard.ZstdDecompressor()
    columns, counts = [[] for _ in range(5)], []
    for x in group.column("rows").to_pylist():
        raw = unpack.decompress(x)
        n = struct.unpack_from("<I", raw)[0]
        at = 4
        for c, (kind, width) in zip(columns, (("<u8", 8), ("<i8", 8), ("u1", 1), ("u1", 1)), strict=False):
            c.append(np.frombuffer(raw, kind, n, at))
            at += width * n
        columns[4].append(np.frombuffer(raw, np.uint8, -1, at))
        counts.append(n)
    name, doc, count, place, text = (np.concatenate(c) for c in columns)
    count, place = count.astype(np.int64), place.astype(np.int64)
    size = count + LENGTH - 1
    begin = np.cumsum(size) - size
    # distinct names' numbers make the group keys small
    number = np.unique(name, return_inverse=True)[1]
    masks = np.zeros(len(name), np.uint32)
    by_name = np.argsort(number, kind="stable")
    edges = np.flatnonzero(np.diff(number[by_name], prepend=-1))
    # as many whole groups at once as keep the arrays small
    windows = np.cumsum(count[by_name])
    cut = [0, *(edges[1:][np.flatnonzero(np.diff(windows[edges[1:] - 1] // 400_000) > 0) + 1].tolist() if len(edges) > 1 else []), len(by_name)]
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        rec = by_name[i:j]
        masks[rec] = _compare(number[rec], doc[rec], count[rec], place[rec], text[spans_of(begin[rec], size[rec])])
    out, at = [], 0
    for block, which, nth, n in zip(*(group.column(c).to_pylist() for c in ("block", "which", "nth")), counts, strict=True):
        own = masks[at : at + n] << np.frombuffer(nth, np.uint8).astype(np.uint32)
        some = np.flatnonzero(own)
        if len(some):
            out.append((block, np.frombuffer(which, "<u4")[some].tobytes(), own[some].tobytes()))
        at += n
    return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "which": pa.array([o[1] for o in out], pa.binary()), "masks": pa.array([o[2] for o in out], pa.binary())})


def _compare(group: np.ndarray, doc: np.ndarray, count: np.ndarray, place: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The windows (a bit each) of each item that a smaller document of its group has too; texts follow one another."""
    size = count + LENGTH - 1
    begin = np.cumsum(size) - size
    to_sort, place = place >= SORTED, place % SORTED
    sorter = SuffixSort(text)
    # equal texts are one from here on
    h = sorter.hashes.span(begin, size)
    order = np.lexsort((~to_sort, doc, h, size, place, group))
    x, y = order[1:], order[:-1]
    again = (group[x] == group[y]) & (place[x] == place[y]) & (h[x] == h[y])
    at = np.flatnonzero(again)
    again[at] = same_bytes(text, begin[x[at]], size[x[at]], begin[y[at]], size[y[at]])
    first = np.flatnonzero(np.r_[True, ~again])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(np.r_[True, ~again]) - 1
    item = order[first]  # of each class one of its smallest document's
    least = doc[item]
    masks = np.zeros(len(item), np.uint32)
    # classes that aren't alone in their group
    rest = np.flatnonzero(to_sort[item])
    own = group[item]
    edge = np.flatnonzero(np.diff(own[rest], prepend=-1))
    rest = rest[np.repeat(np.diff(np.r_[edge, len(rest)]) > 1, np.diff(np.r_[edge, len(rest)]))]
    if len(rest):
        n = count[item[rest]]
        k = np.repeat(rest, n)
        r = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        key = own[k] * GRAMS + place[item[k]] - r
        by_key = np.argsort(key, kind="stable")
        k, r, key = k[by_key], r[by_key], key[by_key]
        by = sorter.sort(begin[item[k]] + r, key)
        k, r, key = k[by], r[by], key[by]
        new = ~sorter.same_as_before(begin[item[k]] + r, key)
        d = least[k]
        hit = np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1] < d
        np.bitwise_or.at(masks, k[hit], np.uint32(1) << r[hit].astype(np.uint32))
    every = ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    return np.where(doc > least[of], every, masks[of])


# Round 3: cutting


def removed(s: Segments, r: Records, masks: np.ndarray) -> np.ndarray:
    """Which bytes of the block go."""
    hit = np.zeros(len(s.data) + 1, np.int32)
    k = np.repeat(np.arange(len(s.start)), s.count)
    j = np.arange(len(k)) - np.repeat(np.cumsum(s.count) - s.count, s.count)
    bad = (r.doc[r.of] < s.doc)[k] | (masks[r.of][k] >> j.astype(np.uint32) & np.uint32(1)).astype(bool)
    hit[(s.start[k] + j)[bad] + 1] = 1
    total = np.cumsum(hit)
    before = np.concatenate([np.zeros(LENGTH - 1, np.int32), total])[: len(s.data)]
    return total[1:] > before


SPANS = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(parts: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, lengths, data, found in _rows(batches):
            s = Segments(ids, lengths, data)
            r = Records(s, parts)
            masks = np.zeros(len(r.first), np.uint32)
            for x in found or ():
                np.bitwise_or.at(masks, np.frombuffer(x["which"], "<u4"), np.frombuffer(x["masks"], np.uint32))
            gone = removed(s, r, masks)
            out = []
            for i, b, e in zip(s.ids.tolist(), s.begins.tolist(), s.ends.tolist(), strict=True):
                g = gone[b:e]
                if not g.any():
                    out.append((i, e - b, [], s.data[b:e].tobytes()))
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                out.append((i, e - b, [{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()], s.data[b:e][~g].tobytes()))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([o[3] for o in out], pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return f


def coded_ids(docs: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """``docs`` with LAST for null ids, which is then larger than any other, and the expression that gives ``doc_id`` back.

    Only where LAST is an id too, beside null, ids above the first free number move down by one.
    """
    found = docs.agg(F.max(F.col(key).isNull()).alias("none"), F.max(key).alias("most"), F.min(key).alias("least")).first()
    id_, last = F.col("doc_id"), F.lit(int(LAST))
    if not found["none"]:
        return docs, id_
    back = F.when(id_ == last, None).otherwise(id_)
    if found["most"] == LAST:
        free = found["least"] - 1
        if free < -(1 << 63):
            ids, at, step, free = docs.select(F.col(key).alias("id")).distinct(), found["least"], 1 << 20, None
            while free is None:
                free, at = docs.sparkSession.range(at, at + step).join(ids, "id", "left_anti").agg(F.min("id")).first()[0], at + step
        docs = docs.withColumn(key, F.when(F.col(key) > free, F.col(key) - 1).otherwise(F.col(key)))
        back = F.when(id_ == last, None).when(id_ >= free, id_ + 1).otherwise(id_)
    return docs.withColumn(key, F.coalesce(F.col(key), last)), back


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK, hot: int = HOT, crowd: int = CROWD) -> DataFrame:
    """Per document: ``doc_id, n_bytes, spans`` (removed runs) and ``kept`` (the remaining bytes)."""
    spark = docs.sparkSession
    coded, doc_id = coded_ids(docs.select(F.col(key).cast("long").alias(key), text), key)
    blocks = write_blocks(coded, block)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(tasks(spark), -(-total * PACKED * 2 // (GRAMS + 1) // PART))
    content = ["block", "ids", "lengths", "data"]
    sent = blocks.select(*content).mapInArrow(_send_segments(parts), "part long, block long, rows binary")
    settled = materialize(sent.groupBy("part").applyInArrow(_settle_segments(hot, crowd), SETTLED), "segments")
    todo = settled.agg(F.sum("n")).first()[0] or 0
    answers = settled.groupBy("block").agg(F.collect_list(F.struct("part", *LISTS, "names")).alias("answers"))
    texts = blocks.join(answers, "block").select(*content, "answers").mapInArrow(_send_texts(parts, max(tasks(spark), -(-todo // PART))), SENT)
    compared = materialize(texts.groupBy("part").applyInArrow(_compare_texts, "block long, which binary, masks binary"), "windows")
    found = compared.groupBy("block").agg(F.collect_list(F.struct("which", "masks")).alias("found"))
    return blocks.join(found, "block", "left").select(*content, "found").mapInArrow(_cut(parts), SPANS).withColumn("doc_id", doc_id)


def digest(cut: DataFrame) -> DataFrame:
    runs = F.transform("spans", lambda x: x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
