"""Operator 4: removal of repeated passages by a sparse, hash-compared suffix sort."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import bit_filter, bounded_batches, load, materialize, tidied, unique_ids, with_membership

LENGTH = 100  # bytes of a passage
GRAM = 32  # bytes of an anchor
REACH = LENGTH - GRAM  # an anchor lies at most so far behind a passage's start
RUN = 1 << 18  # bytes hashed at once
OVERLAP = 4 * LENGTH
HOT = 20_000  # contexts of one gram that a task sorts; beyond, its passages are spread over tasks: the same result, by bytes either way
BUCKET_BYTES = 16 << 20  # text that one bucket of anchors stands for
_RNG = np.random.default_rng(4)
_LETTER = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) for _ in range(2)]
_BASE = [(int(_RNG.integers(1, 2**62)) * 4 + 1) % 2**64 for _ in range(2)]
_POWERS: dict = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        out = []
        for base in (_BASE[which], pow(_BASE[which], -1, 2**64)):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = _POWERS[which] = tuple(out)
    return have


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def _prefix(data: np.ndarray, which: int) -> np.ndarray:
    """Prefix polynomial hashes: entry i covers the first i bytes."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[which][data] * _powers(which, len(data))[0][: len(data)], out=p[1:])
    return p


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of `width` entries, by doubling."""
    have = 1
    while 2 * have <= width:
        x = op(x[: len(x) - have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have:]) if width > have else x


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs_lo: np.ndarray, docs_hi: np.ndarray):
    """(position, segment, gram hash, left, right, context hash) of a run's anchors.

    data: a run of bytes; starts/ends: its segments; docs_lo/docs_hi: where each segment's document begins and ends (may
    lie outside the run). An anchor is the gram of least hash of some passage. Its context is what passages about it
    can cover: 68 bytes before and 100 from it, within the document.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.view(np.uint64), none, none, none.view(np.uint64)
    p0, inv0 = _prefix(data, 0), _powers(0, n)[1]
    h = _mix((p0[GRAM:] - p0[: n - GRAM + 1]) * inv0[: n - GRAM + 1])
    seg = np.repeat(np.arange(len(starts), dtype=np.int32), ends - starts)
    least = _slide(h, REACH + 1, np.minimum)  # per passage start
    at = np.arange(len(least), dtype=np.int64)
    least = np.where(at + LENGTH <= ends[seg[: len(least)]], least, np.uint64(0))
    pad = np.zeros(REACH, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)  # over the passages that a gram lies in
    a = np.flatnonzero(most == h)
    s = seg[a]
    left, right = np.minimum(a - docs_lo[s], REACH), np.minimum(docs_hi[s] - a, LENGTH)
    ok = (a - left >= starts[s]) & (a + right <= ends[s])
    a, s, left, right = a[ok], s[ok], left[ok], right[ok]
    p1, inv1 = _prefix(data, 1), _powers(1, n)[1]
    ctx = _mix((p1[a + right] - p1[a - left]) * inv1[a - left]) + (left * 128 + right).astype(np.uint64)
    return a, s, h[a], left, right, ctx


def _shares(which: np.ndarray):
    """(bucket, places) of each bucket that occurs; which: bucket numbers, the order within a bucket is kept."""
    order = np.argsort(which, kind="stable")
    w = which[order]
    starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
    for a, b in zip(starts, np.r_[starts[1:], len(w)]):
        yield int(w[a]), order[a:b]


def _equal(data: np.ndarray, p: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from p equal those from q, for every entry; n is at most _WIDE, and data reaches so far beyond."""
    out = np.empty(len(p), bool)
    at = np.arange(_WIDE)
    for s in range(0, len(p), 20_000):
        e = slice(s, s + 20_000)
        out[e] = ((data[p[e, None] + at] == data[q[e, None] + at]) | (at >= n[e, None])).all(1)
    return out


def _text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.large_string())
    buffers = col.buffers()
    offs = np.frombuffer(buffers[1], np.int64)[col.offset: col.offset + len(col) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offs


def _runs(offs: np.ndarray):
    """Runs of at most about RUN bytes as lists of segments (document, start, end); a longer document is cut, with overlaps."""
    run, size = [], 0
    for d in range(len(offs) - 1):
        lo, hi = int(offs[d]), int(offs[d + 1])
        if hi - lo < LENGTH:
            continue
        if hi - lo > 2 * RUN:
            for s in range(lo, hi, RUN):
                yield [(d, max(lo, s - OVERLAP), min(hi, s + RUN + OVERLAP))]
            continue
        if run and (size + hi - lo > RUN or run[-1][2] != lo):
            yield run
            run, size = [], 0
        run.append((d, lo, hi))
        size += hi - lo
    if run:
        yield run


def _pack(*arrays) -> bytes:
    return b"".join(x for a in arrays for x in (len(a).to_bytes(4, "little"), np.ascontiguousarray(a).tobytes()))


def _unpack(blob: bytes, kinds):
    at, out = 0, []
    for k in kinds:
        k = np.dtype(k)
        n = int.from_bytes(blob[at: at + 4], "little")
        out.append(np.frombuffer(blob, k, n, at + 4))
        at += 4 + n * k.itemsize
    return out


_ANCHOR = ("<i8", "<u4", "<u4", "<u8", "<u4", "<u4", "<u4")


def _anchors(buckets: int):
    """Batches of (id, text) -> (bucket, blob). Of anchors with the same bytes about them in a batch only the first is sent; the
    rest are covered whole, and travel as spans."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            data, offs = _text_bytes(b.column(1))
            parts = [[] for _ in range(6)]
            for segs in _runs(offs):
                base, end = segs[0][1], segs[-1][2]
                d = np.array([x[0] for x in segs])
                lo, hi = np.array([x[1] for x in segs]) - base, np.array([x[2] for x in segs]) - base
                a, s, h, left, right, ctx = anchors(data[base: end], lo, hi, offs[d] - base, offs[d + 1] - base)
                for k, v in zip(range(6), (d[s], a + base - offs[d[s]], left, right, h, ctx)):
                    parts[k].append(v)
            if not parts[0]:
                continue
            doc, pos, left, right, h, ctx = (np.concatenate(p) for p in parts)
            order = np.lexsort((pos, ids[doc], ctx, h))
            doc, pos, left, right, h, ctx = (x[order] for x in (doc, pos, left, right, h, ctx))
            again = np.r_[False, (h[1:] == h[:-1]) & (ctx[1:] == ctx[:-1]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1])]
            k = np.flatnonzero(again)
            padded = np.concatenate([data, np.zeros(_WIDE, np.uint8)])
            begin = offs[doc] + pos - left
            again[k] = _equal(padded, begin[k], begin[k - 1], (left + right)[k])  # hashes propose, bytes decide
            twice = again & np.r_[False, (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])]  # found in two segments
            full = again & ~twice & (left + right >= LENGTH)
            which = (h % np.uint64(buckets)).astype(np.int64)
            use = np.flatnonzero(~again | full)
            use = use[np.lexsort((pos[use], doc[use]))]
            rows, blobs = [], []
            for k, at in _shares(which[use]):
                mine = use[at]
                one, cov = mine[~again[mine]], mine[again[mine]]
                here, back = np.unique(doc[mine], return_inverse=True)
                rows.append(k)
                new = ~again[mine]
                blobs.append(_pack(ids[here].astype("<i8"), back[new].astype("<u4"), pos[one].astype("<u4"), h[one].astype("<u8"), back[~new].astype("<u4"),
                                   (pos[cov] - left[cov]).astype("<u4"), (pos[cov] + right[cov]).astype("<u4")))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


_OUT = "id long, kind int, blob binary"
_SPAN = np.dtype([("lo", "<u4"), ("hi", "<u4")])
_REQUEST = np.dtype([("pos", "<u4"), ("gram", "<u8")])


def _by_document(ids: np.ndarray, kind: int, of: np.dtype, *columns) -> pa.Table:
    """Rows (id, kind, blob) with each document's records together. With many buckets nearly every record is a row of its own, so
    nothing is done row by row."""
    order = np.argsort(ids, kind="stable")
    ids, records = ids[order], np.empty(len(ids), of)
    for name, c in zip(of.names, columns):
        records[name] = c[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
    offsets = (np.r_[starts, len(ids)] * of.itemsize).astype(np.int64)
    blobs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(records.view(np.uint8))])
    return pa.table([pa.array(ids[starts].astype(np.int64)), pa.array(np.full(len(starts), kind, np.int32)), blobs.cast(pa.binary())], names=["id", "kind", "blob"])


def _records(blobs: pa.Array, of: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of blobs made by _by_document, and how many each blob has."""
    blobs = blobs.cast(pa.large_binary())
    offs = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset: blobs.offset + len(blobs) + 1]
    return np.frombuffer(blobs.buffers()[2], of, (offs[-1] - offs[0]) // of.itemsize, offs[0]), np.diff(offs) // of.itemsize


def _group(t: pa.Table, hot: int = HOT) -> pa.Table:
    """A bucket: spans found covered (kind 0) and, of grams that occur again, the anchors whose bytes are wanted (kind 1; kind 2
    where the gram has more than `hot` of them)."""
    ids, pos, h, cid, clo, chi = ([] for _ in range(6))
    for blob in t["blob"].to_pylist():
        d, i, p, g, ci, lo, hi = _unpack(blob, _ANCHOR)
        for into, v in zip((ids, pos, h, cid, clo, chi), (d[i], p, g, d[ci], lo, hi)):
            into.append(v)
    ids, pos, h, cid, clo, chi = (np.concatenate(x) for x in (ids, pos, h, cid, clo, chi))
    order = np.lexsort((pos, ids, h))
    ids, pos, h = ids[order], pos[order], h[order]
    twice = np.r_[False, (h[1:] == h[:-1]) & (ids[1:] == ids[:-1]) & (pos[1:] == pos[:-1])] if len(h) else np.zeros(0, bool)
    ids, pos, h = ids[~twice], pos[~twice], h[~twice]  # found in two segments
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    size = np.repeat(np.diff(np.r_[start, len(h)]), np.diff(np.r_[start, len(h)]))
    wanted = [(1, (size > 1) & (size <= hot)), (2, size > max(hot, 1))]
    return pa.concat_tables([_by_document(cid, 0, _SPAN, clo, chi), *[_by_document(ids[x], kind, _REQUEST, pos[x], h[x]) for kind, x in wanted]])


_CONTEXT = ("<i8", "<u4", "<u1", "<u1", "<u8", "<u1")
_WIDE = REACH + LENGTH


def _contexts(buckets: int):
    """(id, text, requests) -> (bucket, hot, blob): the bytes about the anchors asked for; of anchors of hot grams, their passages."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            data, offs = _text_bytes(b.column(1))
            data = np.concatenate([np.zeros(_WIDE, np.uint8), data, np.zeros(_WIDE, np.uint8)])
            owner = pc.list_parent_indices(b.column(2)).to_numpy()
            kinds, requests = pc.list_flatten(b.column(2)).flatten()
            kinds = kinds.to_numpy()
            rows, blobs = [], []
            for kind in (1, 2):
                mine = np.flatnonzero(kinds == kind)
                if not len(mine):
                    continue
                found, n = _records(requests.take(pa.array(mine)), _REQUEST)
                doc, pos, gram = np.repeat(owner[mine], n), found["pos"].astype(np.int64), found["gram"].astype(np.uint64)
                left, right = np.minimum(pos, REACH), np.minimum(offs[doc + 1] - offs[doc] - pos, LENGTH)

                def bytes_about(s, doc=doc, pos=pos, left=left, right=right):
                    ctx = data[(offs[doc[s]] + pos[s] + _WIDE - REACH)[:, None] + np.arange(_WIDE)]
                    ctx[np.arange(_WIDE) < (REACH - left[s])[:, None]] = 0
                    ctx[np.arange(_WIDE) >= (REACH + right[s])[:, None]] = 0
                    return ctx

                if kind == 2:
                    for at in range(0, len(doc), 2000):
                        s = slice(at, at + 2000)
                        made = _passages(ids, doc[s], pos[s], left[s], right[s], bytes_about(np.arange(at, min(at + 2000, len(doc)))), buckets)
                        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), pa.array([True] * len(made)), pa.array([x for _, x in made], pa.binary())], ["bucket", "hot", "blob"])
                    continue
                which = (gram % np.uint64(buckets)).astype(np.int64)
                for k, s in _shares(which):
                    rows.append((k, False))
                    blobs.append(_pack(ids[doc[s]].astype("<i8"), pos[s].astype("<u4"), left[s].astype("<u1"), right[s].astype("<u1"), gram[s], bytes_about(s).reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([h for _, h in rows], pa.bool_()), pa.array(blobs, pa.binary())], ["bucket", "hot", "blob"])

    return run


_PASSAGE = ("<i8", "<u4", "<u4", "<u8", "<u1", "<u4", "<u4", "<u4")


def _firsts(ids, start, h, text) -> np.ndarray:
    """Order passages by bytes, id and start; returns (order, again): whether an entry has the bytes of the one before it.
    They are sorted by hash; where unequal bytes meet under one hash, by the bytes."""
    order = np.lexsort((start, ids, h))
    same = h[order][1:] == h[order][:-1]
    equal = (text[order][1:] == text[order][:-1]).all(1)
    if (same & ~equal).any():
        words = np.zeros((len(text), 8 * -(-LENGTH // 8)), np.uint8)
        words[:, :LENGTH] = text
        order = np.lexsort((start, ids, *words.view(np.uint64).T))
        equal = (text[order][1:] == text[order][:-1]).all(1)
        same = equal
    return order, np.r_[False, same & equal] if len(order) else np.zeros(0, bool)


def _passages(ids, doc, pos, left, right, ctx, buckets: int) -> list[tuple[int, bytes]]:
    """All passages about the anchors of hot grams: the first of equals here goes to a bucket by its hash, with its bytes; the others
    are covered. So a passage that very many documents share sends one entry at a time, and no task sees them all."""
    prefix = np.zeros((len(doc), _WIDE + 1), np.uint64)
    np.cumsum(_LETTER[0][ctx] * _powers(0, _WIDE)[0][:_WIDE], axis=1, out=prefix[:, 1:])
    hashes = _mix((prefix[:, LENGTH:] - prefix[:, : _WIDE - LENGTH + 1]) * _powers(0, _WIDE)[1][: _WIDE - LENGTH + 1])
    back = REACH - np.arange(REACH + 1)  # column c starts `back` bytes before the anchor
    anchor, c = np.nonzero((left[:, None] >= back) & (right[:, None] >= LENGTH - back))
    start, h, text = pos[anchor] - back[c], hashes[anchor, c], ctx[anchor[:, None], c[:, None] + np.arange(LENGTH)]
    order, again = _firsts(ids[doc[anchor]], start, h, text)
    anchor, start, h, text = anchor[order], start[order], h[order], text[order]
    d = doc[anchor]
    twice = again & np.r_[False, (d[1:] == d[:-1]) & (start[1:] == start[:-1])] if len(h) else again
    cov = again & ~twice
    # the covered passages of an anchor overlap, so they are one span
    low, high = np.full(len(doc), 2**62), np.full(len(doc), -1)
    np.minimum.at(low, anchor[cov], start[cov])
    np.maximum.at(high, anchor[cov], start[cov] + LENGTH)
    hit = np.flatnonzero(high >= 0)
    firsts = np.flatnonzero(~again)
    out = []
    for n, (k, at) in enumerate(_shares((h[firsts] % np.uint64(buckets)).astype(np.int64))):
        new, c = firsts[at], hit if n == 0 else hit[:0]  # the spans travel with the first
        here, back = np.unique(np.concatenate([d[new], doc[c]]), return_inverse=True)
        out.append((k, _pack(ids[here].astype("<i8"), back[: len(new)].astype("<u4"), start[new].astype("<u4"), h[new], text[new].reshape(-1),
                             back[len(new):].astype("<u4"), low[c].astype("<u4"), high[c].astype("<u4"))))
    return out


def _first_passages(t: pa.Table) -> pa.Table:
    parts = [[] for _ in range(7)]
    for blob in t["blob"].to_pylist():
        d, i, s, h, text, ci, lo, hi = _unpack(blob, _PASSAGE)
        for into, v in zip(parts, (d[i], s, h, text, d[ci], lo, hi)):
            into.append(v)
    ids, start, h, text, cid, lo, hi = (np.concatenate(p) for p in parts)
    order, again = _firsts(ids, start, h, text.reshape(-1, LENGTH))
    ids, start = ids[order], start[order]
    if len(h):
        again &= ~np.r_[False, (ids[1:] == ids[:-1]) & (start[1:] == start[:-1])]
    ids, start = ids[again], start[again]
    return _by_document(np.concatenate([cid, ids]), 0, _SPAN, np.concatenate([lo, start]), np.concatenate([hi, start.astype(np.int64) + LENGTH]))


def suffix_sort(group: np.ndarray, rows: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows sorted within their groups, and what each has in common with the one before it (-1: a new group).

    rows: bytes by which to sort, of which `valid` count; groups are contiguous and ascending. Merge sort, all groups and
    merges of a level at once; a comparison finds the common extension by binary search over prefix polynomial
    hashes, so it takes a logarithm of the length. At the end the bytes of all neighbours are compared: where a hash
    collision has misled, the rows are sorted by their bytes.
    """
    n, width = rows.shape
    prefix = np.zeros((n, width + 1), np.uint64)
    np.cumsum(_LETTER[0][rows] * _powers(0, width)[0][:width], axis=1, out=prefix[:, 1:])

    def common(i, j):
        lo, hi = np.zeros(len(i), np.int64), np.minimum(valid[i], valid[j]).astype(np.int64)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) // 2
            same = prefix[i, mid] == prefix[j, mid]
            lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)

    def less(i, j):
        c = common(i, j)
        end_i, end_j = c >= valid[i], c >= valid[j]
        x, y = rows[i, np.minimum(c, width - 1)], rows[j, np.minimum(c, width - 1)]
        return np.where(end_i | end_j, end_i & ~end_j, x < y)

    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    start = np.repeat(starts, np.diff(np.r_[starts, n]))
    end = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    order, at, step = np.arange(n), np.arange(n), 1
    longest = int((end - start).max(initial=0))
    while step < longest:
        local = at - start
        first = start + local // (2 * step) * (2 * step)
        mid, last = np.minimum(first + step, end), np.minimum(first + 2 * step, end)
        in_first = at < mid
        busy = mid < last
        lo, hi = np.where(in_first, mid, first), np.where(in_first, last, mid)
        lo, hi = np.where(busy, lo, 0), np.where(busy, hi, 0)
        base = lo.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            m = (lo[open_] + hi[open_]) // 2
            me, other = order[open_], order[m]
            # equal rows keep their order: one of the second half goes after equals of the first
            before = np.where(in_first[open_], less(other, me), ~less(me, other))
            lo[open_] = np.where(before, m + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], m)
        target = np.where(busy, first + (at - np.where(in_first, first, mid)) + (lo - base), at)
        new = np.empty(n, np.int64)
        new[target] = order
        order, step = new, 2 * step
    prev = np.r_[0, order[:-1]] if n else order
    got = common(order, prev)
    sure = np.arange(width) >= got[:, None]
    wrong = ~(sure | (rows[order] == rows[prev])).all(1)
    if n and wrong[1:].any():  # a collision: sort by the bytes themselves
        keys = [np.where(np.arange(width)[c] < valid, rows[:, c].astype(np.int16) + 1, 0) for c in range(width - 1, -1, -1)]
        order = np.lexsort([*keys, group])
        prev = np.r_[0, order[:-1]]
        equal = (rows[order] == rows[prev]) & (np.arange(width) < np.minimum(valid[order], valid[prev])[:, None])
        got = np.where(equal.all(1), width, equal.argmin(1))
    if n:
        got[np.r_[True, group[order][1:] != group[order][:-1]]] = -1
    return order, got


def _repeats(group, ctx, left, right) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) per row: the least and greatest i such that the passage from i bytes before the anchor also starts in an
    earlier row of its group; low > high: none. Rows are in document order within their groups."""
    n = len(group)
    after, r_common = suffix_sort(group, ctx[:, REACH + GRAM:], np.maximum(right.astype(np.int64) - GRAM, 0))
    before, l_common = suffix_sort(group, np.ascontiguousarray(ctx[:, REACH - 1:: -1][:, :REACH]), left.astype(np.int64))
    low, high = np.full(n, LENGTH), np.full(n, -1)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(REACH + 1):
        fits = np.flatnonzero((left >= i) & (right >= LENGTH - i))
        if len(fits) < 2:
            continue
        r_class[after] = np.cumsum(r_common < REACH - i)
        l_class[before] = np.cumsum(l_common < i)
        key = r_class[fits] * (n + 1) + l_class[fits]
        order = np.argsort(key, kind="stable")
        k = key[order]
        dup = fits[order[1:][k[1:] == k[:-1]]]
        low[dup] = np.minimum(low[dup], i)
        high[dup] = i
    return low, high


def _compare(t: pa.Table) -> pa.Table:
    """A bucket of contexts -> spans (kind 0). Equal grams are told by their bytes. Buckets of hot grams hold passages."""
    if t["hot"][0].as_py():
        return _first_passages(t)
    parts = [[] for _ in range(6)]
    for blob in t["blob"].to_pylist():
        for into, v in zip(parts, _unpack(blob, _CONTEXT)):
            into.append(v)
    ids, pos, left, right, gram, ctx = (np.concatenate(p) for p in parts)
    ctx = ctx.reshape(-1, _WIDE)
    order = np.lexsort((pos, ids, gram))
    ids, pos, left, right, gram, ctx = (x[order] for x in (ids, pos, left, right, gram, ctx))
    spans = []
    starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    ends = np.r_[starts[1:], len(gram)]
    s = 0
    while s < len(starts):
        e = s + int(np.searchsorted(ends[s:], starts[s] + 30_000, side="right"))
        e = max(e, s + 1)
        at = slice(starts[s], ends[e - 1])
        g, c = gram[at], ctx[at]
        middle = np.ascontiguousarray(c[:, REACH: REACH + GRAM]).view(f"V{GRAM}").reshape(-1)
        same = np.r_[True, (g[1:] == g[:-1])]
        if not (middle[1:] == middle[:-1])[same[1:]].all():  # different grams of equal hash
            _, g = np.unique(middle, return_inverse=True)
            g = g.reshape(-1)
            o = np.argsort(g, kind="stable")
        else:
            o = np.arange(len(g))
        low, high = _repeats(g[o], c[o], left[at][o], right[at][o])
        hit = np.flatnonzero(high >= low)
        p = pos[at][o][hit].astype(np.int64)
        spans.append((ids[at][o][hit], p - high[hit], p - low[hit] + LENGTH))
        s = e
    i, lo, hi = (np.concatenate([x[k] for x in spans]) for k in range(3))
    return _by_document(i, 0, _SPAN, lo, hi)


def _cut(with_text: bool):
    """(id, text, blobs of spans) -> what is left of a document."""
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_bytes"] * with_text

    def run(batches):
        for b in batches:
            out = [[] for _ in names]
            data, offs = _text_bytes(b.column(1))
            for k, (i, blobs) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                raw = data[offs[k]: offs[k + 1]].tobytes()
                at, left, removed, spans = 0, [], 0, 0
                if blobs:
                    found = np.frombuffer(b"".join(blobs), _SPAN)
                    lo, hi = found["lo"].astype(np.int64), found["hi"].astype(np.int64)
                    o = np.argsort(lo, kind="stable")
                    lo, top = lo[o], np.maximum.accumulate(hi[o])
                    new = np.flatnonzero(np.r_[True, lo[1:] > top[:-1]])
                    for s, e in zip(lo[new].tolist(), top[np.r_[new[1:] - 1, len(top) - 1]].tolist()):
                        left.append(raw[at:s])
                        at, removed, spans = e, removed + e - s, spans + 1
                left.append(raw[at:])
                kept = b"".join(left)
                for col, v in zip(out, (i, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
                 bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes): the text without every byte that a
    100-byte string covers which also starts earlier (smaller id, or same document and earlier start).

    Sorting all suffixes of a corpus is out of the question, and needless: any repeated 100-byte string holds the same
    anchor, the 32-byte gram of least hash in it. Anchors (one in about 35 bytes) are grouped by their hash. Where the whole
    bytes about an anchor (68 before, 100 from it) repeat within a batch, everything in them does, and only the first is sent.
    The bytes about anchors of grams that occur again are sorted forwards and backwards from the anchor by a merge sort whose
    comparisons find the common extension by binary search over prefix polynomial hashes; runs of sufficient common
    extension on both sides tell which passages have occurred before. Hashes only propose: bytes are compared before
    anything is called equal, and where unequal bytes meet under one hash, the bytes are sorted.

    Null text is empty. Rows that repeat an id, and null ids, are ordered by id (null first), then text hash; rows equal in
    both are ordered arbitrarily, but each is a document. Extra columns are ignored; an empty table gives an empty result.
    Very long texts are hashed piece by piece, with overlaps. A hot passage sends one anchor a batch. A gram with more than
    `hot` anchors left (the edges of a passage in very many documents) is not sorted in one task: its passages are grouped
    by their bytes, first in each batch, then over tasks; the result is the same for any `hot`. The id must be an integer or a
    string of one.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total, count = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("docs")).first()
    buckets = max(8, -(-total // bucket_bytes))
    base, back = unique_ids(base)
    base = base.select(F.col("id").cast("long").alias("id"), "text")
    grouped = (base.mapInArrow(tidied(_anchors(buckets)), "bucket int, blob binary").groupBy("bucket").applyInArrow(lambda t: _group(t, hot), _OUT))
    grouped = materialize(grouped)
    asked = grouped.where("kind > 0").groupBy("id").agg(F.collect_list(F.struct("kind", "blob")).alias("blobs"))
    texts = with_membership(base, bit_filter(asked, F.col("id"), min(count, grouped.where("kind > 0").count())), F.col("id"), "maybe").where("maybe").drop("maybe")
    compared = (texts.join(asked, "id").select("id", "text", "blobs").mapInArrow(tidied(_contexts(buckets)), "bucket int, hot boolean, blob binary")
                .groupBy("bucket", "hot").applyInArrow(_compare, _OUT))
    spans = materialize(grouped.where("kind = 0").union(compared))
    per_doc = spans.groupBy("id").agg(F.collect_list("blob").alias("blobs"))
    flagged = with_membership(base, bit_filter(spans, F.col("id"), min(count, spans.count())), F.col("id"), "maybe")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    cut = (flagged.where("maybe").drop("maybe").join(per_doc, "id", "left").select("id", "text", "blobs").mapInArrow(tidied(_cut(with_text)), schema))
    zero = F.lit(0).cast("long")
    whole = flagged.where("not maybe").select("id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
                                              F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), *([F.col("text").cast("binary").alias("kept_bytes")] * with_text))
    out = cut.unionByName(whole)
    if back is not None:
        out = out.join(back, "id").drop("id").withColumnRenamed("own", "id")
    return out.select(F.col("id").alias(id_col), *[c for c in out.columns if c != "id"])


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup(load(spark, sf_dir, "documents"))


SQL = None  # tested against brute force
