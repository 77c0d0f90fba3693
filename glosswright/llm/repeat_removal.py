"""Removal of long repeated byte strings between documents, by run-length indexes over ranges of minimisers.

Every window of `length` bytes has a minimiser: of its K-byte strings the one with the smallest hash.  Equal
windows have equal minimisers, so windows meet where their minimisers do:

1. tasks post the minimisers of their documents, as sorted, delta-coded runs over ranges of hashes; what
   two documents post sets a bit in a filter of fixed size, and what about HOT segments have one in another;
2. around minimisers whose first bit is set, each document cuts segments - the runs of windows with one
   minimiser - and sends them to the minimiser's range.  Segments of a hot minimiser are cut into single
   windows, each of which goes to the range of its own hash, so that no minimiser fills a task.  Equal segments
   of a task go once, for the smallest document; the others are known to be repeats.  Full filters let more
   segments pass, or cut more of them, and change no result;
3. a range drops equal segments once more, builds a run-length index (run_index.py) over the different ones of
   its minimisers, some at a time and in ascending order of documents, and streams their matching statistics.  A
   window whose match of `length` bytes is witnessed in a smaller document is marked;
4. marks meet their texts again, and the bytes that they cover go.

Segments count as equal only after a comparison of their bytes; hashes decide where they meet, no more.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, partitions, small_batches, text_bytes, trim, written
from .run_index import RunIndex
from .shingles import BASE, INVERSE, VALUES, blocks, mix, powers

K = 24
FILTER_BITS, HOT_BITS = 29, 24
#: Segments from which a minimiser is hot, about a CHUNK of bytes: cut into windows, they have some ten times as many.
#: A flush tells how many it has from HEAVY on, otherwise it counts as one.
HOT, HEAVY = 16_384, 8
#: Bytes of segments that a task holds before it sends them, gathers at a time, and that a range indexes at a time.
HELD, GATHER, CHUNK = 12 << 20, 1 << 19, 1 << 20
#: Ranges that a task of the second shuffle solves, one after the other.  A flush makes a blob for each range.
SPLIT = 4
_U = np.uint64


class Windows:
    """The segments of a block of texts: runs of windows with one minimiser."""

    def __init__(self, texts: list[bytes], length: int):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(lengths)
        self.begin = self.end - lengths
        n, w = len(self.data), length - K + 1
        if n < length:
            self.start = self.stop = self.doc = np.zeros(0, np.int64)
            self.minimiser = np.zeros(0, np.uint64)
            return
        with np.errstate(over="ignore"):
            self.sums = running_hash(self.data)
            grams = mix((self.sums[K:] - self.sums[:-K]) * powers(INVERSE, n)[: n - K + 1])
        low = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equals
        span = 1
        while span * 2 <= w:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
        at = (low & _U(0xFFFFFFFF)).astype(np.int64)
        usable = np.zeros(len(at) + 1, np.int8)
        long_enough = lengths >= length
        np.add.at(usable, self.begin[long_enough], 1)
        np.add.at(usable, self.end[long_enough] - length + 1, -1)
        usable = np.cumsum(usable[:-1]) > 0
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (usable[1:] != usable[:-1])]))
        doc = np.searchsorted(self.end, cut, side="right")
        after = np.append(cut[1:], len(at))
        ok = usable[cut]
        # two documents whose windows touch cannot share a run: windows that cross the border are unusable
        self.start, self.stop, self.doc = cut[ok], after[ok] + length - 1, doc[ok]
        self.minimiser = mix(grams[at[cut[ok]]])  # the smallest of many hashes is small: spread it again


def running_hash(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[data] * powers(BASE, len(data)), dtype=np.uint64)])


def range_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of data[start:stop] from the running hash of data."""
    with np.errstate(over="ignore"):
        return mix((sums[stop] - sums[start]) * powers(INVERSE, len(sums))[start] + (stop - start).astype(np.uint64))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of the ranges [start, start + size), one after the other."""
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - size), size)


def slices(size: np.ndarray, most: int):
    """(lo, hi) of consecutive items of about `most` in all."""
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def segment_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of segments that lie one after the other."""
    out = [np.zeros(0, np.uint64)]
    for lo, hi in slices(size, 1 << 19):
        first, last = begin[lo], begin[hi - 1] + size[hi - 1]
        sums = running_hash(data[first:last])
        out.append(range_hash(sums, begin[lo:hi] - first, begin[lo:hi] + size[lo:hi] - first))
    return np.concatenate(out)


def equal_segments(data, begin, size, key, doc, place) -> tuple[np.ndarray, np.ndarray]:
    """(order, owner): equal segments side by side, and the first of each one's group, which has the smallest
    document.  Segments of one hash are compared byte by byte with their neighbours."""
    order = np.lexsort((place, doc, key))
    if not len(order):
        return order, order
    like = (key[order[1:]] == key[order[:-1]]) & (size[order[1:]] == size[order[:-1]])
    at = np.flatnonzero(like)
    for lo, hi in slices(size[order[at]], 1 << 19):
        a, b = order[at[lo:hi]], order[at[lo:hi] + 1]
        same = data[spread(begin[a], size[a])] == data[spread(begin[b], size[b])]
        like[at[lo:hi]] = np.logical_and.reduceat(same, np.cumsum(size[a]) - size[a])
    head = np.append(True, ~like)
    return order, order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]


def stretches(doc, th, start, stop):
    """Marks of one text that touch or overlap become one."""
    order = np.lexsort((start, th, doc))
    doc, th, start, stop = doc[order], th[order], start[order], stop[order]
    if len(doc):
        text = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])))
        far = int(stop.max()) + 1
        reach = np.maximum.accumulate(stop + text * far)
        new = np.append(True, (start + text * far)[1:] > reach[:-1])
        last = np.append(np.flatnonzero(new)[1:] - 1, len(new) - 1)
        doc, th, start, stop = doc[new], th[new], start[new], (reach - text * far)[last]
    return doc, th, start, stop


def _pack(sorted_values: np.ndarray) -> bytes:
    """Ascending distinct integers as 3-byte steps; 0xFFFFFF goes on without a value."""
    step = np.diff(sorted_values, prepend=np.int64(0))
    skip = step // 0xFFFFFF
    out = np.full(len(step) + int(skip.sum()), 0xFFFFFF, "<u4")
    out[np.arange(len(step)) + np.cumsum(skip)] = step % 0xFFFFFF
    return out.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    three = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
    step = three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16
    return np.cumsum(step)[step != 0xFFFFFF]


def _set_bits(n: int, bits: np.ndarray) -> np.ndarray:
    out = np.zeros(n >> 3, np.uint8)
    np.bitwise_or.at(out, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
    return out


def _has_bit(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def shared_filters(rows: DataFrame, length: int) -> list[tuple[int, bytes, bytes]]:
    """Parts of two bitmaps over the leading bits of minimisers, those of two documents or more and the hot ones:
    (first byte, compressed bytes of the first, bits of the second).  The driver only passes them on."""
    ranges = partitions(rows.sparkSession)

    def post(batches):
        lean()
        def flush(grams, docs):
            gram, doc = np.concatenate(grams) >> _U(24), np.concatenate(docs)
            order = np.argsort(gram)
            gram, doc = gram[order].astype(np.int64), doc[order]
            at = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            values, n = gram[at], np.diff(np.append(at, len(gram)))
            many = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
            heavy = n >= HEAVY
            bounds = np.searchsorted(values, -(-(np.arange(ranges + 1, dtype=np.int64) << 40) // ranges))
            rows = []
            for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if b > a:
                    v, h = values[a:b], heavy[a:b]
                    rows.append((r, _pack(v), _pack(v[many[a:b]]), _pack(v[h]), n[a:b][h].astype("<u4").tobytes()))
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], ["r", "one", "many", "heavy", "counts"])

        grams, docs, held = [], [], 0
        for batch in batches:
            names = batch.column("doc_id").to_numpy()
            i = 0
            for block in blocks(batch.column("text").to_pylist(), 1 << 20):
                w = Windows(block, length)
                grams.append(w.minimiser)
                docs.append(names[i + w.doc])
                i += len(block)
                held += len(w.minimiser)
                if held > 1_000_000:
                    yield flush(grams, docs)
                    grams, docs, held = [], [], 0
        if held:
            yield flush(grams, docs)
        trim()

    posted = rows.mapInArrow(post, "r int, one binary, many binary, heavy binary, counts binary").repartition(ranges, "r").sortWithinPartitions("r")

    def meet(batches):
        lean()
        now, once, heavy, counts = None, [], [], []

        def flush():
            values, n = np.unique(np.concatenate(once), return_counts=True)
            bits = np.unique(values[n > 1] >> (40 - FILTER_BITS))
            low = int(bits[0]) // 8 if len(bits) else 0
            part = _set_bits((int(bits[-1]) // 8 - low + 1) * 8, bits - 8 * low) if len(bits) else np.zeros(0, np.uint8)
            # a minimiser's segments, at least: those of heavy posts and one for each post (many posts count twice)
            v, w = np.concatenate([values, *heavy]), np.concatenate([n, *counts])
            order = np.argsort(v, kind="stable")
            v, w = v[order], w[order]
            at = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            hot = np.unique(v[at][np.add.reduceat(w, at) >= HOT] >> (40 - HOT_BITS))
            return pa.record_batch([pa.array([low], pa.int64()), pa.array([zlib.compress(part, 1)], pa.binary()), pa.array([hot.astype("<i4").tobytes()], pa.binary())], ["low", "bits", "hot"])

        for batch in batches:
            for r, one, many, some, n in zip(*(batch.column(c).to_pylist() for c in ("r", "one", "many", "heavy", "counts")), strict=True):
                if r != now:
                    if once:
                        yield flush()
                    now, once, heavy, counts = r, [], [], []
                once += [_unpack(one), _unpack(many)]
                heavy.append(_unpack(some))
                counts.append(np.frombuffer(n, "<u4").astype(np.int64))
        if once:
            yield flush()
        trim()

    found = posted.mapInArrow(meet, "low long, bits binary, hot binary").collect()  # 68 MB in all, whatever the input
    return [(r["low"], bytes(r["bits"]), bytes(r["hot"])) for r in found]


def bitmaps(parts: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    shared, hot = np.zeros(1 << FILTER_BITS - 3, np.uint8), np.zeros(1 << HOT_BITS - 3, np.uint8)
    for low, bits, some in parts:
        part = np.frombuffer(zlib.decompress(bits), np.uint8)
        shared[low : low + len(part)] |= part
        at = np.frombuffer(some, "<i4")
        np.bitwise_or.at(hot, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return shared, hot


MARKS = ["doc_id", "th", "start", "stop"]
#: What a blob holds of each segment, before the bytes: document (as steps), hash of its text, place, size, group.
PLANES = ["<i8", "<i8", "<i4", "<u4", "<u4"]


def packed(doc, th, place, size, group, data, begin, first):
    """The blobs of segments whose runs begin at `first`, not yet compressed.

    There are as many as flushes times ranges, which grows faster than the text: all but the joining is done for
    all of them at once.
    """
    step = np.diff(doc, prepend=np.int64(0))
    step[first] = doc[first]
    planes = [x.astype(t).tobytes() for x, t in zip((step, th, place, size, group), PLANES, strict=True)]
    planes.append(b"".join(data[spread(begin[lo:hi], size[lo:hi])].tobytes() for lo, hi in slices(size, GATHER)))
    cuts = np.append(first, len(doc))
    cuts = [(cuts * np.dtype(t).itemsize).tolist() for t in PLANES] + [np.append(0, np.cumsum(size))[cuts].tolist()]
    for k in range(len(first)):
        yield b"".join([p[c[k] : c[k + 1]] for p, c in zip(planes, cuts, strict=True)])


def unpacked(raw: bytes, n: int) -> tuple[np.ndarray, ...]:
    """Document, hash of its text, place, size and group of the n segments of a blob, and their bytes."""
    planes, at = [], 0
    for t in PLANES:
        planes.append(np.frombuffer(raw, t, n, at))
        at += n * planes[-1].itemsize
    return np.cumsum(planes[0]), *planes[1:], np.frombuffer(raw, np.uint8, offset=at)


def _mark_batch(r, marks, names):
    blobs = [pa.nulls(len(marks[0]), t) for t in (pa.int32(), pa.binary())]
    return pa.record_batch([pa.array(r, pa.int32()), *blobs, *(pa.array(x, pa.int64()) for x in marks)], names)


def segments(rows: DataFrame, length: int, filters) -> DataFrame:
    """Rows (r, n, blob) of segments for the ranges, and rows (r, marks) of what is known at once.

    filters: a broadcast of shared_filters(), at most 68 MB whatever the input.
    """
    ranges = SPLIT * partitions(rows.sparkSession)
    names = ["r", "n", "blob", *MARKS]

    def run(batches):
        lean()
        held: list[tuple] = []
        size, pack = 0, zstandard.ZstdCompressor(level=1)
        shared, hot = bitmaps(filters.value)

        def flush():
            doc, th, place, n, route, key, content = (np.concatenate([h[k] for h in held]) for k in range(7))
            held.clear()
            begin = np.cumsum(n) - n
            order, owner = equal_segments(content, begin, n, key, doc, place)
            known = order[doc[order] != doc[owner]]
            send = np.sort(order[doc[order] == doc[owner]])
            if len(known):  # neighbouring segments overlap: whole stretches become one mark
                marks = stretches(doc[known], th[known], place[known], place[known] + n[known])
                yield _mark_batch((marks[0] % ranges).astype(np.int32), marks, names)
            if len(send):
                r = ((route[send] >> _U(24)).astype(np.int64) * ranges) >> 40
                by = np.argsort(r, kind="stable")
                r, send = r[by], send[by]
                first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                many = np.diff(np.append(first, len(send)))
                raw = packed(doc[send], th[send], place[send], n[send], route[send] >> _U(32), content, begin[send], first)
                blobs = pa.array(map(pack.compress, raw), pa.binary())
                yield pa.record_batch([pa.array(r[first], pa.int32()), pa.array(many, pa.int32()), blobs, *(pa.nulls(len(first), pa.int64()) for _ in MARKS)], names)

        for batch in batches:
            ids, hashes = batch.column("doc_id").to_numpy(), batch.column("th").to_numpy()
            i = 0
            for block in blocks(batch.column("text").to_pylist(), 1 << 20):
                w = Windows(block, length)
                pick = np.flatnonzero(_has_bit(shared, (w.minimiser >> _U(64 - FILTER_BITS)).astype(np.int64)))
                is_hot = _has_bit(hot, (w.minimiser[pick] >> _U(64 - HOT_BITS)).astype(np.int64))
                for s, single in ((pick[~is_hot], False), (pick[is_hot], True)):
                    if not len(s):
                        continue
                    start, stop, doc = w.start[s], w.stop[s], w.doc[s]
                    if single:
                        n = stop - start - length + 1
                        start, doc = spread(start, n), np.repeat(doc, n)
                        stop = start + length
                    key = range_hash(w.sums, start, stop)
                    for lo, hi in slices(stop - start, 8 * GATHER):
                        a, b, d = start[lo:hi], stop[lo:hi], doc[lo:hi]
                        route = key[lo:hi] if single else w.minimiser[s[lo:hi]]
                        held.append((ids[i + d], hashes[i + d], a - w.begin[d], b - a, route, key[lo:hi], w.data[spread(a, b - a)]))
                        size += int((b - a).sum())
                        if size > HELD:
                            yield from flush()
                            size = 0
                i += len(block)
        if held:
            yield from flush()
        trim()

    return rows.mapInArrow(run, "r int, n int, blob binary, doc_id long, th long, start long, stop long")


def repeated_windows(data: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int):
    """(segment, first byte, end) of the stretches of windows that a segment of a smaller document has as well."""
    by = np.argsort(doc, kind="stable")
    size, doc = size[by], doc[by]
    index = RunIndex(data[spread(begin[by], size)], size, length - 1)
    piece = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(index.n)
    hit = (doc[piece[index.witnesses()]] < doc[piece]) & (place + length <= index.end[piece])
    on = np.flatnonzero(hit)
    if not len(on):
        return on, on, on
    new = np.append(True, on[1:] != on[:-1] + 1)
    first = on[new]
    last = on[np.append(np.flatnonzero(new)[1:] - 1, len(on) - 1)]
    p = piece[first]
    zero = index.end[p] - size[p]
    return by[p], first - zero, last - zero + length


def solve(parts: list[tuple], length: int) -> list[np.ndarray]:
    """The marks (document, hash of its text, first byte, end) of the segments of a range."""
    *planes, data = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    doc, th, place, size, group = (x.astype(np.int64) for x in planes)
    begin = np.cumsum(size) - size
    order, owner = equal_segments(data, begin, size, segment_hashes(data, begin, size), doc, place)
    later = doc[order] != doc[owner]
    known = order[later]
    out = [(doc[known], th[known], place[known], place[known] + size[known])]
    twin, of = order[~later & (order != owner)], owner[~later & (order != owner)]
    heads = np.sort(order[order == owner])
    heads = heads[np.argsort(group[heads], kind="stable")]
    new = np.append(True, group[heads[1:]] != group[heads[:-1]])
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(heads)))
    heads = heads[np.repeat(n > 1, n)]  # a segment that is alone with its minimiser repeats nothing
    weight = np.add.reduceat(size[heads], np.cumsum(n[n > 1]) - n[n > 1]) if len(heads) else np.zeros(0, np.int64)
    bounds = np.append(0, np.cumsum(n[n > 1]))
    for lo, hi in slices(weight, CHUNK):  # whole minimisers at a time
        s = heads[bounds[lo] : bounds[hi]]
        at, a, b = repeated_windows(data, begin[s], size[s], doc[s], length)
        h = s[at]
        out.append((doc[h], th[h], place[h] + a, place[h] + b))
        by = np.argsort(h, kind="stable")  # and the same for equal segments of the same document
        x, y = np.searchsorted(h[by], of), np.searchsorted(h[by], of, side="right")
        t, like = np.repeat(twin, y - x), by[spread(x, y - x)]
        out.append((doc[t], th[t], place[t] + a[like], place[t] + b[like]))
    return stretches(*(np.concatenate(x) for x in zip(*out, strict=True)))


def marks(blobs: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, start, stop): the bytes of windows that a smaller document of the range has as well, and
    the marks that came along."""

    def run(batches):
        lean()
        now, parts, unpack = None, [], zstandard.ZstdDecompressor()
        for batch in batches:
            done = batch.filter(pc.is_valid(batch.column("start")))
            if len(done):
                yield done.select(MARKS)
            rest = batch.filter(pc.is_null(batch.column("start")))
            for r, n, blob in zip(*(rest.column(c).to_pylist() for c in ("r", "n", "blob")), strict=True):
                if r != now:
                    if parts:
                        yield pa.record_batch([pa.array(x, pa.int64()) for x in solve(parts, length)], MARKS)
                    now = r
                parts.append(unpacked(unpack.decompress(blob), n))
        if parts:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in solve(parts, length)], MARKS)
        trim()

    return blobs.repartition(partitions(blobs.sparkSession), "r").sortWithinPartitions("r").mapInArrow(run, "doc_id long, th long, start long, stop long")


def spans_of(marked) -> list[tuple[int, int]]:
    """Maximal runs of the union of intervals (start, stop); null: none."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((m["start"], m["stop"]) for m in (() if marked is None else marked)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def marked_documents(docs: DataFrame, length: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, utf8, marked): each row of docs as a struct, its text's bytes, and the intervals to remove (null: none).

    A byte goes when a string of `length` bytes that covers it also begins in a document with a smaller
    identifier; strings are those of the input, overlaps count, matches never cross documents.  Null texts
    are empty.  Rows with a null identifier neither lose bytes nor make others lose any; rows with equal
    identifiers are not smaller than each other.  Columns of docs may have any names.
    """
    if length < K + 1 or length > 60_000:
        raise ValueError("length must be in 25..60000")
    small_batches(docs.sparkSession)
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("utf8")).withColumn("th", F.xxhash64("utf8"))
    rows = keyed.where("doc_id is not null").select("doc_id", "th", F.col("utf8").alias("text")).where(F.length("text") >= length)
    # written before the texts are shuffled: the segments' shuffle files can go first
    filters = docs.sparkSession.sparkContext.broadcast(shared_filters(rows, length))
    found = written(marks(segments(rows, length, filters), length), "marks")
    filters.destroy()
    every = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("marked"))  # a document's own
    return keyed.join(every, ["doc_id", "th"], "left").select("row", "utf8", "marked")


def removal_digests(docs: DataFrame, length: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def run(batches):
        lean()
        for batch in batches:
            out = []
            for text, marked in zip(*(batch.column(c).to_pylist() for c in ("utf8", "marked")), strict=True):
                spans = spans_of(marked)
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked = marked_documents(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), length)
    return marked.select("row.doc_id", "utf8", "marked").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs with the repeated bytes cut out of their texts; characters cut in two go as well."""

    @F.pandas_udf("string")
    def cut(text, marked):
        out = text.copy()
        for i, (t, m) in enumerate(zip(text, marked, strict=True)):
            at, kept = 0, []
            for x, y in spans_of(m):
                kept.append(t[at:x])
                at = y
            out.iloc[i] = b"".join([*kept, t[at:]]).decode("utf-8", "ignore")
        return out

    def column(name: str) -> Column:
        own = F.col("row")[name]
        return (F.when(F.col("marked").isNull(), own).otherwise(cut("utf8", "marked")) if name == text_column else own).alias(name)

    return marked_documents(docs, length, id_column, text_column).select(*map(column, docs.columns))
