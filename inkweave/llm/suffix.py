"""Repeated byte windows by a depth-limited most-significant-digit sort of suffixes.

Every suffix of ``depth`` bytes or more is ordered through its first ``depth`` bytes only; a group of equal prefixes that
starts in several documents is a repeated window.  Moving every suffix would move many times the input, so a first pass
over sparse suffixes decides which windows move:

1. Of the stretches of ``digit`` bytes inside a window the one with the least hash is its sparse suffix (the leftmost of
   equals).  It depends on the window's bytes alone, so equal windows have the same one at the same offset, and one
   stands for a run of neighbouring windows: about one position in sixteen is dealt out by the hash of those bytes.
   Where only one document has them, that suffix ends there, with all of its windows.
2. The windows of the others are dealt out by it with the bytes of their run.  Each bucket orders them by digits of eight
   bytes, the most significant first: a pass splits every open group by the next digit; groups of one document are
   done, and so are groups whose windows agree through ``depth``; the rest goes on.  The groups that are left at depth
   ``depth`` hold equal bytes.  The least doc_id of a group keeps its window, the others lose the bytes it covers.

Hashes only route and propose; what is removed has been compared byte by byte.

Sparse suffixes and runs travel packed, one row for each batch and bucket; the number of buckets follows the bytes of the
input.  A suffix that many documents of one batch share is hot: the batch sends it once and its places pass through
evenly; one that many documents of the whole input share is found hot in its bucket.  In the second pass the windows
of hot ones are dealt out one by one by their own bytes.  Equal runs that meet in one bucket of documents are sent once.

Texts are dealt out twice by row key, in buckets of about ``BUCKET_BYTES``, to meet what was found about them.

Defined results: matches never cross rows; null and empty texts and texts shorter than ``depth`` lose nothing; a null
doc_id comes last; rows that repeat a doc_id, or have none, do not count against each other.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import NO_ID, keyed, mix, octets, pieces, release

DEPTH, DIGIT = 50, 20
#: Bytes of text for each bucket.
BUCKET_BYTES = 4 << 20
#: Documents of one batch that make a digit hot.
HOT = 32
#: Documents of the whole input that make one hot.
HOT_ALL = 1024
#: Bytes of text for which digits are packed together.
TOGETHER = 32 << 20
_BASE = 0xD6E8FEB86659FD93
_MANY = np.uint64(2**64 - 1)


def pack(*arrays: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))  # noqa: S301  only what pack made


def rolling(raw: np.ndarray, k: int, bits: int = 64) -> np.ndarray:
    """A hash of the k bytes from each position on (of fewer near the end), by doubling."""
    n = len(raw)
    block, size, out, have = raw.astype(np.uint64) + np.uint64(1), 1, None, 0
    while k:
        if k & 1:
            if out is None:
                out, have = block.copy(), size
            else:
                out *= np.uint64(pow(_BASE, size, 1 << 64))
                out[: max(0, n - have)] += block[have:]
                have += size
        k >>= 1
        if k:
            longer = block * np.uint64(pow(_BASE, size, 1 << 64))
            longer[: max(0, n - size)] += block[size:]
            block, size = longer, size * 2
    return mix(out) & np.uint64(2**bits - 1)


def sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """choose over values[i : i + width] at each i."""
    out, size = values, 1
    while size < width:
        step = min(size, width - size)
        longer = out.copy()
        longer[:-step] = choose(out[:-step], out[step:])
        out, size = longer, size + step
    return out


def left_bytes(at: np.ndarray) -> np.ndarray:
    """Bytes from each position to the end of its row."""
    return np.repeat(at[1:], np.diff(at)) - np.arange(at[-1])


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number, without copying them; behind the end stand zeros."""
    b = np.concatenate([raw, np.zeros(7, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(b, 8).view(">u8")[:, 0] if len(raw) else np.zeros(0, ">u8")


def string_hashes(eight: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int = 64) -> np.ndarray:
    """A hash of all bytes of each stretch of eight bytes or more."""
    h, live, k = mix(size.astype(np.uint64)), np.arange(len(start)), 0
    while len(live):
        e = eight[start[live] + np.minimum(k, size[live] - 8)].astype(np.uint64)
        h[live] = mix(h[live] * np.uint64(_BASE) + e)
        k += 8
        live = live[size[live] > k]
    return h & np.uint64(2**bits - 1)


def same_runs(proposed: np.ndarray, start: np.ndarray, size: np.ndarray, eight: np.ndarray) -> np.ndarray:
    """A group number for each stretch: equal only for equal bytes.  proposed: hashes; stretches with other hashes are not compared."""
    order = np.argsort(proposed, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = proposed[order][1:] != proposed[order][:-1]
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    own = np.arange(len(order))
    left = np.flatnonzero((first != own) & (size == size[first]))
    differ = (first != own) & (size != size[first])
    k = 0
    while len(left):
        at = np.minimum(k, size[left] - 8)
        bad = eight[start[left] + at] != eight[start[first[left]] + at]
        differ[left[bad]] = True
        k += 8
        left = left[~bad & (size[left] > k)]
    return np.where(differ, own, first)


def least_of_equals(start: np.ndarray, least: np.ndarray, eight: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each window the smallest ``least`` among the windows that begin with the same ``depth`` bytes."""
    out = least.copy()
    active, group, at = np.arange(len(start)), np.zeros(len(start), np.int64), 0
    last = np.uint64(64 - 8 * (depth % 8)) if depth % 8 else np.uint64(0)

    def digit(which: np.ndarray, k: int) -> np.ndarray:
        d = eight[start[which] + k].astype(np.uint64)
        return d >> last if k + 8 > depth else d

    while len(active):
        d = digit(active, at)
        order = np.lexsort((d, group)) if at else np.argsort(d)
        active, group, d = active[order], group[order], d[order]
        new = np.ones(len(active), bool)
        new[1:] = (group[1:] != group[:-1]) | (d[1:] != d[:-1])
        begin = np.flatnonzero(new)
        own = least[active]
        low = np.minimum.reduceat(own, begin)
        open_groups = low != np.maximum.reduceat(own, begin)
        group = np.cumsum(new) - 1
        keep = open_groups[group]
        active, group, at = active[keep], group[keep], at + 8
        if not len(active):
            break
        new = np.ones(len(active), bool)
        new[1:] = group[1:] != group[:-1]
        begin = np.flatnonzero(new)
        first = active[begin][np.cumsum(new) - 1]
        equal = np.ones(len(active), bool)
        for k in range(at, depth, 8):
            equal &= digit(active, k) == digit(first, k)
        done = np.logical_and.reduceat(equal, begin)[np.cumsum(new) - 1]
        out[active[done]] = low[group[done]]
        active, group = active[~done], group[~done]
    return out


def digit_hashes(raw: np.ndarray, left: np.ndarray, bits: int = 64) -> np.ndarray:
    h = rolling(raw, DIGIT, bits)
    h[left < DIGIT] = _MANY
    return h


def digits(raw: np.ndarray, at: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Positions that are least in some window, and their hashes; of equal hashes all."""
    if len(raw) < DEPTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = left_bytes(at)
    h = digit_hashes(raw, left, bits)
    width = DEPTH - DIGIT + 1
    least = sliding(h, width, np.minimum)
    least[left < DEPTH] = 0
    most = sliding(least[::-1].copy(), width, np.maximum)[::-1]
    places = np.flatnonzero((most == h) & (left >= DIGIT))
    return places, h[places]


def runs(raw: np.ndarray, at: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the digit, its hash, first window, last window) for each run of windows with one digit."""
    none = np.zeros(0, np.int64)
    if len(raw) < DEPTH:
        return none, np.zeros(0, np.uint64), none, none
    left = left_bytes(at)
    h = digit_hashes(raw, left, bits)
    best, size, width = np.arange(len(raw)), 1, DEPTH - DIGIT + 1
    while size < width:
        step = min(size, width - size)
        longer = best.copy()
        a, b = best[:-step], best[step:]
        longer[:-step] = np.where((h[b] < h[a]) | ((h[b] == h[a]) & (b < a)), b, a)
        best, size = longer, size + step
    windows = np.flatnonzero(left >= DEPTH)
    if not len(windows):
        return none, np.zeros(0, np.uint64), none, none
    chosen = best[windows]
    new = np.ones(len(windows), bool)
    new[1:] = chosen[1:] != chosen[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(windows)]]) - 1
    return chosen[first], h[chosen[first]], windows[first], windows[last]


def _rows(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_PACKED = "bucket int, kind int, blob binary"


def _packed(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return _rows({"bucket": pa.array([o[0] for o in out], pa.int32()), "kind": pa.array([o[1] for o in out], pa.int32()), "blob": pa.array([o[2] for o in out], pa.binary())})


def _split(bucket: np.ndarray, kind: int, *arrays: np.ndarray):
    """(bucket, kind, blob) for each bucket; the order inside a bucket stays."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    for b, part in zip(found, np.split(order, first[1:]), strict=True) if len(found) else ():
        yield int(b), kind, pack(*(a[part] for a in arrays))


def row_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) + np.uint64(7)) % np.uint64(n)).astype(np.int64)


def _first_digits(n: int, hot: int, bits: int):
    def run(batches):
        for b in batches:
            raw, at = octets(b.column("text"))
            ids, keys = (b.column(c).to_numpy() for c in ("_id", "_row"))
            for x, y in pieces(at, TOGETHER):
                found = []
                for i, j in pieces(at[x : y + 1]):
                    i, j = i + x, j + x
                    places, h = digits(raw[at[i] : at[j]], at[i : j + 1] - at[i], bits)
                    row = np.searchsorted(at[i : j + 1] - at[i], places, side="right") - 1
                    found.append((row + i, places + at[i] - at[row + i], h))
                row, place, h = (np.concatenate(c) for c in zip(*found, strict=True))
                if not len(h):
                    continue
                order = np.lexsort((ids[row], h))
                rows = row[order]
                new = np.ones(len(h), bool)
                new[1:] = h[order][1:] != h[order][:-1]
                group = np.cumsum(new) - 1
                other = np.ones(len(h), bool)
                other[1:] = new[1:] | (ids[rows][1:] != ids[rows][:-1])
                heat = np.bincount(group, other) >= hot
                hot_at = np.zeros(len(h), bool)
                hot_at[order] = heat[group]
                bucket = ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
                low = h.astype(np.uint32)
                cold = np.flatnonzero(~hot_at)
                out = list(_split(bucket[cold], 0, low[cold], ids[row[cold]], keys[row[cold]], place[cold].astype(np.uint32)))
                warm = np.flatnonzero(hot_at)
                if len(warm):
                    one = order[new][heat]
                    out += _split(bucket[one], 2, low[one])
                    out += _split(row_bucket(keys[row[warm]], n), 1, keys[row[warm]], place[warm].astype(np.uint32))
                yield _packed(out)
                del out, found, row, place, h, order, rows, group
                release()

    return run


def _columns(blobs: list[bytes], n: int) -> list[np.ndarray]:
    parts = [unpack(b) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) for k in range(n)] if parts else []


def _shared(n: int, hot_all: int):
    """Of each bucket of digits, the places whose digit several documents have, by bucket of rows; hot ones marked."""

    def run(group: pa.Table) -> pa.Table:
        release()  # what the bucket before this one left
        blobs: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
        for k, b in zip(group.column("kind").to_pylist(), group.column("blob").to_pylist(), strict=True):
            blobs[k].append(b)
        found = []
        if blobs[0]:
            h, ids, keys, place = _columns(blobs[0], 4)
            hot = np.unique(_columns(blobs[2], 1)[0]) if blobs[2] else np.zeros(0, np.uint32)
            order = np.argsort(h, kind="stable")
            new = np.ones(len(h), bool)
            new[1:] = h[order][1:] != h[order][:-1]
            starts = np.flatnonzero(new)
            group_of = np.cumsum(new) - 1
            many = np.minimum.reduceat(ids[order], starts) != np.maximum.reduceat(ids[order], starts)
            warm = np.isin(h[order][starts], hot) | (np.diff(np.append(starts, len(h))) >= hot_all)
            keep = (many | warm)[group_of]
            chosen = order[keep]
            found.append((keys[chosen], place[chosen], warm[group_of][keep]))
        if blobs[1]:
            keys, place = _columns(blobs[1], 2)
            found.append((keys, place, np.ones(len(keys), bool)))
        if not found:
            return pa.Table.from_batches([_packed([])])
        keys, place, warm = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((place, keys))
        keys, place, warm = keys[order], place[order], warm[order]
        return pa.Table.from_batches([_packed(list(_split(row_bucket(keys, n), 0, keys, place, warm)))])

    return run


def _texts(n: int):
    """Texts packed by bucket of rows: kind 9, (id, row key, lengths, bytes)."""

    def run(batches):
        for b in batches:
            raw, at = octets(b.column("text"))
            ids, keys = (b.column(c).to_numpy() for c in ("_id", "_row"))
            bucket = row_bucket(keys, n)
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            out = []
            for k, part in zip(found, np.split(order, first[1:]), strict=True) if len(found) else ():
                out.append((int(k), 9, pack(ids[part], keys[part], np.diff(at)[part], b"".join(raw[at[i] : at[i + 1]].tobytes() for i in part))))
            yield _packed(out)

    return run


def _open(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, row keys, offsets and bytes of the texts of one bucket."""
    parts = [unpack(b) for b in group.column("blob").to_pylist()]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint8)
    ids, keys, size = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return ids, keys, np.concatenate([[0], np.cumsum(size)]), np.frombuffer(b"".join(p[3] for p in parts), np.uint8)


def _locate(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The row of the bucket with each wanted key."""
    order = np.argsort(keys)
    return order[np.searchsorted(keys[order], want)]


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of raw one after the other."""
    end = np.cumsum(size)
    return raw[np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


def _second_digits(n: int, bits: int):
    """Runs of windows whose digit is shared, packed by the digit's bucket; those of hot digits window by window."""

    def run(key, texts: pa.Table, marks: pa.Table) -> pa.Table:
        release()  # what the bucket before this one left
        ids, keys, at, raw = _open(texts)
        blobs = marks.column("blob").to_pylist()
        if not len(ids) or not blobs:
            return pa.Table.from_batches([_packed([])])
        m_keys, m_place, m_warm = _columns(blobs, 3)
        row = _locate(keys, m_keys)
        spot = at[row] + m_place
        mark = np.zeros(len(raw) + 1, np.uint8)
        mark[spot] = 1 + m_warm.astype(np.uint8)
        touched = np.zeros(len(ids), bool)
        touched[row] = True
        got = []
        for i, j in pieces(at):
            if not touched[i:j].any():
                continue
            place, h, first, last = runs(raw[at[i] : at[j]], at[i : j + 1] - at[i], bits)
            good = mark[place + at[i]] > 0
            got.append((place[good] + at[i], h[good], first[good] + at[i], last[good] + at[i]))
        if not got:
            return pa.Table.from_batches([_packed([])])
        place, h, first, last = (np.concatenate(c) for c in zip(*got, strict=True))
        warm = mark[place] == 2
        n_windows = last - first + 1
        each = np.where(warm, n_windows, 1)
        source = np.repeat(np.arange(len(place)), each)
        step = np.arange(len(source)) - np.repeat(np.cumsum(each) - each, each)
        start = first[source] + np.where(warm[source], step, 0)
        size = np.where(warm[source], DEPTH, n_windows[source] - 1 + DEPTH)
        eight = eights(raw)
        whole = string_hashes(eight, start, size, bits)
        dealt = np.where(warm[source], whole, h[source])
        of = np.searchsorted(at, start, side="right") - 1
        group = same_runs(whole, start, size, eight)
        least = np.full(len(group), NO_ID, np.int64)
        np.minimum.at(least, group, ids[of])
        known = ids[of] > least[group]
        offset = (start - at[of]).astype(np.uint32)
        out = []
        if known.any():
            own = int(key[0].as_py())
            out.append((own, 1, pack(keys[of][known], offset[known], size[known].astype(np.uint32))))
        ask = np.flatnonzero(~known)
        bucket = ((dealt[ask] >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
        deal = np.argsort(bucket, kind="stable")
        found, cuts = np.unique(bucket[deal], return_index=True)
        for b, part in zip(found, np.split(ask[deal], cuts[1:]), strict=True) if len(found) else ():
            out.append((int(b), 0, pack(ids[of][part], keys[of][part], offset[part], size[part].astype(np.uint8), _gather(raw, start[part], size[part]))))
        return pa.Table.from_batches([_packed(out)])

    return run


def _covered(n: int, bits: int):
    """Of each bucket of runs, the stretches of bytes whose windows start in a document with a smaller id, by bucket of rows."""

    def run(group: pa.Table) -> pa.Table:
        release()  # what the bucket before this one left
        kinds, blobs = group.column("kind").to_pylist(), group.column("blob").to_pylist()
        out = [part for k, b in zip(kinds, blobs, strict=True) if k == 1 for part in _by_row(*unpack(b))]
        asked = [b for k, b in zip(kinds, blobs, strict=True) if k == 0]
        if asked:
            ids, keys, offset, size, raw = _columns(asked, 5)
            size = size.astype(np.int64)
            start = np.cumsum(size) - size
            eight = eights(raw)
            same = same_runs(string_hashes(eight, start, size, bits), start, size, eight)
            of_run = np.full(len(ids), NO_ID, np.int64)
            np.minimum.at(of_run, same, ids)
            later = ids > of_run[same]
            one = np.flatnonzero(same == np.arange(len(same)))
            windows = size[one] - DEPTH + 1
            end = np.cumsum(windows)
            base = np.repeat(start[one] - (end - windows), windows) + np.arange(end[-1])
            owner = np.repeat(one, windows)
            lost = least_of_equals(base, of_run[owner], eight) < of_run[owner]
            del base, eight
            found = [(keys[later], offset[later], size[later].astype(np.uint32))]
            # Stretches of lost windows in the first holders of a run.
            edge = np.flatnonzero(lost & np.concatenate([[True], ~lost[:-1] | (owner[1:] != owner[:-1])]))
            stop = np.flatnonzero(lost & np.concatenate([~lost[1:] | (owner[1:] != owner[:-1]), [True]]))
            if len(edge):
                begin = np.arange(len(lost)) - np.repeat(end - windows, windows)
                by = owner[edge]
                holders = np.flatnonzero(~later)
                holders = holders[np.argsort(same[holders], kind="stable")]
                low, high = np.searchsorted(same[holders], by, side="left"), np.searchsorted(same[holders], by, side="right")
                k = high - low
                pick = holders[np.repeat(low - (np.cumsum(k) - k), k) + np.arange(k.sum())]
                span = np.repeat(np.arange(len(edge)), k)
                found.append((keys[pick], (offset[pick] + begin[edge][span]).astype(np.uint32), (begin[stop][span] - begin[edge][span] + DEPTH).astype(np.uint32)))
            out += _by_row(*(np.concatenate(c) for c in zip(*found, strict=True)))
        return pa.Table.from_batches([_packed(out)])

    def _by_row(keys, offset, size):
        order = np.lexsort((offset, keys))
        keys, offset, size = keys[order], offset[order], size[order]
        return list(_split(row_bucket(keys, n), 0, keys, offset, size))

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _finish(with_bytes: bool):
    def run(key, texts: pa.Table, gone: pa.Table) -> pa.Table:
        release()  # what the bucket before this one left
        ids, keys, at, raw = _open(texts)
        lose = np.zeros(len(raw) + 1, np.int32)
        blobs = gone.column("blob").to_pylist()
        if blobs and len(ids):
            g_keys, offset, size = _columns(blobs, 3)
            begin = at[_locate(keys, g_keys)] + offset
            np.add.at(lose, begin, 1)
            np.add.at(lose, begin + size, -1)
        lost = np.cumsum(lose[:-1]) > 0
        n_lost = np.concatenate([[0], np.cumsum(lost)])
        start = lost.copy()
        start[1:] &= ~lost[:-1]
        inner = at[:-1][at[:-1] < len(raw)]
        start[inner] = lost[inner]
        n_start = np.concatenate([[0], np.cumsum(start)])
        kept = [raw[at[i] : at[i + 1]][~lost[at[i] : at[i + 1]]].tobytes() for i in range(len(ids))]
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "n_bytes": pa.array(np.diff(at), pa.int64()), "n_removed": pa.array(n_lost[at[1:]] - n_lost[at[:-1]], pa.int64()), "n_spans": pa.array(n_start[at[1:]] - n_start[at[:-1]], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "kept": pa.array(kept if with_bytes else [None] * len(kept), pa.binary())})

    return run


def remove_repeats(docs: DataFrame, hot: int = HOT, hot_all: int = HOT_ALL, bucket_bytes: int = BUCKET_BYTES, bits: int = 64, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of each row of docs.

    bits: of the hashes that route; fewer force collisions, which change no result.
    """
    d = keyed(docs).select("_id", "_row", "text")
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(64, -(-total // bucket_bytes))
    first = d.mapInArrow(_first_digits(n, hot, bits), _PACKED)
    marks = first.groupBy("bucket").applyInArrow(_shared(n, hot_all), _PACKED)
    asked = d.mapInArrow(_texts(n), _PACKED).groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(_second_digits(n, bits), _PACKED)
    gone = asked.groupBy("bucket").applyInArrow(_covered(n, bits), _PACKED)
    out = d.mapInArrow(_texts(n), _PACKED).groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(_finish(with_bytes), _RESULT)
    return out if with_bytes else out.drop("kept")


#: The same rows by DuckDB: bytes as pairs of hexadecimal digits, cut into overlapping stretches before windows are taken of them.
ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS i, hex(encode(coalesce(text, ''))) AS h FROM documents),
cut AS (SELECT r, i, b, substr(h, 2 * b + 1, 2 * (512 + 49)) AS s FROM (SELECT r, i, h, unnest(range(0, greatest(length(h) // 2 - 49, 0), 512)) AS b FROM d)),
g AS (SELECT r, i, b + p AS p, substr(s, 2 * p + 1, 100) AS s FROM (SELECT r, i, b, s, unnest(range(0, length(s) // 2 - 49)) AS p FROM cut)),
f AS (SELECT s, min(i) AS first FROM g GROUP BY s HAVING min(i) < max(i)),
c AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM g JOIN f USING (s) WHERE i > first),
n AS (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS run FROM c),
x AS (SELECT r, run, min(p) AS a, max(p) + 50 AS z FROM n GROUP BY r, run),
k AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS b FROM x),
t AS (SELECT d.r, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS before, max(z) AS last, sum(z - a) AS removed, count(*) AS spans FROM k JOIN d ON d.r = k.r GROUP BY d.r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(before, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""
