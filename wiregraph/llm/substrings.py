"""Removal of repeated 50-byte strings, found in suffix arrays built by linear grouping.

Baier, "Linear-time Suffix Sorting" (2016): suffixes are grouped by their Lyndon prefix, groups being processed in
descending order with pointers to the previous smaller suffix; a second pass then emits the order within each group,
with no recursion and no renaming.

Every 50-byte window has an anchor: the least hash (by 48 bits) of its 24-byte strings, which depends on the window's
bytes alone, so equal windows have equal anchors. Windows that share an anchor lie in one piece of text, and pieces meet by the
anchor's hash: arrays over the pieces of a share of the hashes decide all their windows. Only anchors that two documents
have are followed. Documents are packed into blocks, and each block sends a piece once however often it has it.

An anchor with many different pieces (a common phrase with different text around it) would bring all of them into one
share. Its windows are sent one by one instead, each to the share of its own 50 bytes, so equal windows still meet and
no share grows with the anchor.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import bucketed
from .common import batch_bytes, durable
from .ngram_join import _powers

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
BAND = SPAN // 3
PIECE = LENGTH + SPAN - 1  # bytes of the longest piece
BLOCK_BYTES, SLICE_BYTES, SHARD_BYTES, ARRAY_BYTES = 4_000_000, 64_000, 2_000_000, 16_000
PART_BYTES = 250_000  # of pieces hashed at once: tables of eight bytes each, kept by the worker
#: The bits of a place in a slice; hashes are compared by the other 48.
PLACE = np.int64(0xFFFF)
#: Different pieces of an anchor, summed over blocks, from which on its windows go one by one.
HOT = 20_000
LAST = np.iinfo(np.int64).max


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a list of numbers whose last is smaller than all others."""
    n, by_value = len(text), defaultdict(list)
    for i, c in enumerate(text):
        by_value[c].append(i)
    members = [by_value[c] for c in sorted(by_value)]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    smaller, done, final = [-1] * n, bytearray(n), []
    g = len(members) - 1
    above[g] = -1
    while g >= 0:
        own = members[g]
        if len(own) == 1:  # most groups: nothing to sort or count
            i = own[0]
            if group[i] == g:
                p = i - 1
                while p >= 0 and done[p]:
                    p = smaller[p]
                smaller[i] = p
                done[i] = 1
                final.append(own)
                if p >= 0:
                    low, new = group[p], len(members)
                    high = above[low]
                    members.append([p])
                    below.append(low)
                    above.append(high)
                    above[low] = below[high] = group[p] = new
            g = below[g]
            continue
        own = sorted([i for i in own if group[i] == g])
        counts: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = smaller[p]
            smaller[i] = p
            done[i] = 1
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        final.append(own)
        # a suffix that stands before v suffixes of this group rises above its old group, the higher the larger v
        moved: dict[int, dict[int, list[int]]] = {}
        for p, v in counts.items():
            moved.setdefault(group[p], {}).setdefault(v, []).append(p)
        for low, by_count in moved.items():
            for v in sorted(by_count):
                new, high = len(members), above[low]
                members.append(by_count[v])
                below.append(low)
                above.append(high)
                above[low] = new
                below[high] = new  # there is one: the group in hand is higher
                for p in by_count[v]:
                    group[p] = new
                low = new
        g = below[g]
    # the second pass: each suffix, in order, places those before it that wait for it alone
    head, at = [0] * len(members), 0
    for own in reversed(final):
        if own:
            head[group[own[0]]] = at
            at += len(own)
    order, placed = [-1] * n, bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            order[head[group[j]]] = j
            head[group[j]] += 1
            placed[j] = 1
            j = smaller[j]
    return order


def _rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, inverse): (total[b] - total[a]) * inverse[a] is the hash of the bytes a..b, wherever they stand."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return total, inverse


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, `size` numbers."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first of each kind, the kind of every piece): pieces of one kind have the same key and bytes.

    Pieces are matched by the hash of their bytes, `value`, and then compared byte for byte; those whose hash alone agrees are kinds of their own,
    which later comparisons of all bytes put right.
    """
    order = np.argsort(key ^ (value * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
    same = np.all([x[order][1:] == x[order][:-1] for x in (key, value, size)], axis=0)
    rank = np.arange(len(order))
    rank[1:][same] = 0
    leader = np.empty_like(order)
    leader[order] = order[np.maximum.accumulate(rank)]
    view, columns = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(PIECE, np.uint8)), PIECE), np.arange(PIECE)
    follows = np.flatnonzero(leader != np.arange(len(leader)))
    for part in np.array_split(follows, len(follows) // 50_000 + 1):
        odd = ((view[start[part]] != view[start[leader[part]]]) & (columns < size[part, None])).any(1)
        leader[part[odd]] = part[odd]
    return np.unique(leader, return_inverse=True)


def window_owners(data: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each window of each piece in turn, the least owner of a piece that holds the same 50 bytes, by one suffix array over all pieces."""
    begin = np.cumsum(size + 1) - size - 1
    raw = np.full(int(size.sum()) + len(size), -1, np.int16)  # -1 ends a piece; below every byte
    raw[_spread(begin, size)] = data[_spread(start, size)]
    order = np.array(suffix_array([*raw.tolist(), -2]), np.int64)
    piece = np.repeat(np.arange(len(size)), size + 1)
    offset = np.arange(len(piece)) - begin[piece]
    order = order[order < len(piece)]
    order = order[offset[order] + LENGTH <= size[piece[order]]]
    columns = np.arange(LENGTH)
    new = np.ones(len(order), bool)
    for lo in range(1, len(order), 200_000):  # neighbours in the array with the same 50 bytes
        rows = raw[order[lo - 1 : lo + 200_000, None] + columns]
        new[lo : lo + 200_000] = (rows[1:] != rows[:-1]).any(1)
    first = np.flatnonzero(new)
    out = np.empty(len(piece), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(owner[piece[order]], first), np.diff(np.append(first, len(order))))
    return out[_spread(begin, size - LENGTH + 1)]


def anchors(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, place, document, first, last, hash of the piece) of each anchor of a block: the windows first..last have the gram there as their least."""
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 6
    ends = np.cumsum(lengths)
    step, long = np.zeros(len(data), np.int8), lengths >= LENGTH
    step[(ends - lengths)[long]] = 1
    step[ends[long] - LENGTH + 1] = -1
    valid = np.cumsum(step, dtype=np.int8).view(bool)
    parts = [_slice_anchors(data[lo : lo + SLICE_BYTES + LENGTH - 1], valid[lo : lo + SLICE_BYTES], lo) for lo in range(0, len(data) - LENGTH + 1, SLICE_BYTES)]
    h, at, first, last, value = (np.concatenate(x) for x in zip(*parts))
    return h, at, np.searchsorted(ends, first, side="right"), first, last, value


def _slice_anchors(data: np.ndarray, valid: np.ndarray, lo: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first, last, hash of the piece) for the windows that begin in a slice of a block; stretches end with the slice."""
    total, inverse = _rolling(data)
    h = _mixed((total[GRAM:] - total[:-GRAM]) * inverse[: len(data) - GRAM + 1])
    # the place in the low bits, which keeps the first of equal ones: the least of ever wider spans
    least, width = (h & ~PLACE) | np.arange(len(h)), 1
    while width < SPAN:
        k = min(width, SPAN - width)
        least, width = np.minimum(least[k:], least[:-k]), width + k
    at, valid = least & PLACE, valid[: len(least)]
    cut = np.append(np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])])), len(at))
    first, last = cut[:-1], cut[1:] - 1
    first, last = first[valid[first]], last[valid[first]]
    return h[at[first]], at[first] + lo, first + lo, last + lo, (total[last + LENGTH] - total[first]) * inverse[first]


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    """The share of hashes, by leading bits of a product: anchors are minima, so their own leading bits are uneven."""
    return ((h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def blocks(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, none, lengths, data): whole texts of some megabytes each; a null id is LAST, and `none` says so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, ids, none, data, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        row = lambda: pd.DataFrame({"block": [f"{part}-{k}"], "ids": [ids], "none": [none], "lengths": [[len(d) for d in data]], "data": [b"".join(data)]})
        for batch in batches:
            for i, no, t in zip(batch["k"].tolist(), batch["none"].tolist(), batch["t"]):
                ids.append(i)
                none.append(no)
                data.append((t or "").encode())
                size += len(data[-1])
                if size >= BLOCK_BYTES:
                    yield row()
                    k, ids, none, data, size = k + 1, [], [], [], 0
        if ids:
            yield row()

    known = F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST)))  # pandas would round ids beside a null one
    return documents.select(known.alias("k"), F.col(id_col).isNull().alias("none"), F.col(text_col).alias("t")).mapInPandas(run, "block string, ids array<long>, none array<boolean>, lengths array<int>, data binary")


def _anchors_of(row):
    data, lengths = np.frombuffer(row.data, np.uint8), np.asarray(row.lengths, np.int64)
    return data, lengths, np.asarray(row.ids, np.int64), anchors(data, lengths)


def _own_hashes(h: np.ndarray, document: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes in order, which of them several documents of the block have, and how many different pieces."""
    if not len(h):
        return h, np.zeros(0, bool), np.zeros(0, np.int32)
    order = np.argsort(h)
    h, document, value = h[order], document[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    n = np.diff(np.append(first, len(h)))
    kinds = np.ones(len(first), np.int32)
    again = np.flatnonzero(n > 1)
    if len(again):  # hashes that occur once have one piece
        at, of = _spread(first[again], n[again]), np.repeat(again, n[again])
        order = np.lexsort((value[at], of))
        v, of = value[at][order], of[order]
        kinds[again] = np.add.reduceat(np.concatenate([[True], (of[1:] != of[:-1]) | (v[1:] != v[:-1])]), np.cumsum(n[again]) - n[again], dtype=np.int32)
    return h[first], np.maximum.reduceat(document, first) > np.minimum.reduceat(document, first), kinds


def _ranges(h: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of hashes, by shard, in the order they have."""
    s = _shard(h, bits)
    order = np.argsort(s, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], s[order][1:] != s[order][:-1], [True]])) if len(h) else [0]
    for a, b in zip(at, at[1:]):
        yield int(s[order[a]]), order[a:b]


def _window_hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The hash of the 50 bytes from each place on, as `_rolling` gives it."""
    view, power = np.lib.stride_tricks.sliding_window_view(data, LENGTH), _powers(LENGTH)[0][:LENGTH]
    parts = np.array_split(start, len(start) // 10_000 + 1)
    return np.concatenate([((view[p].astype(np.uint64) + np.uint64(1)) * power).sum(1, dtype=np.uint64) for p in parts])


def _pieces(row, bits: int):
    """(data, lengths, ids, pieces, found, runs) of a block.

    pieces: shard, place of the anchor, least id, start and size, in order of the shards; found: the piece of each
    stretch of windows (a single window each for hot anchors); runs: its first window and its document.
    """
    data, lengths, ids, (h, at, document, first, last, value) = _anchors_of(row)
    order = np.argsort(h)
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])[: len(h)]
    own, of = h[order][new], np.empty_like(order)
    of[order] = np.cumsum(new) - 1
    shared, hot = np.zeros(len(own), bool), np.zeros(len(own), bool)
    marks = {m["shard"]: m for m in row.marks} if row.marks is not None else {}
    for s, places in _ranges(own, bits):
        if s in marks:
            for found, name in ((shared, "bits"), (hot, "hot")):
                found[places] = np.unpackbits(np.frombuffer(zlib.decompress(marks[s][name]), np.uint8), count=len(places)).astype(bool)
    keep = np.flatnonzero(shared[of])
    if not len(keep):
        return data, lengths, ids, (h[:0],) * 5, h[:0], (first[:0], document[:0])
    hot = hot[of[keep]]
    h, at, document, first, last, value = (x[keep] for x in (h, at, document, first, last, value))
    if hot.any():
        n = np.where(hot, last - first + 1, 1)
        single = np.repeat(hot, n)
        at, document, start, h, value, last = (np.repeat(x, n) for x in (at, document, first, h, value, last))
        first = np.where(single, _spread(first, n), start)
        last = np.where(single, first, last)
        value[single] = _window_hashes(data, first[single])
        h[single] = _mixed(value[single])
    at, size = at - first, last - first + LENGTH
    kinds, found = distinct(data, first, size, h, value)
    owner = np.full(len(kinds), LAST)
    np.minimum.at(owner, found, ids[document])
    order = np.argsort(_shard(h[kinds], bits), kind="stable")
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    kinds = kinds[order]
    return data, lengths, ids, (_shard(h[kinds], bits), at[kinds], owner[order], first[kinds], size[kinds]), number[found], (first, document)


def _cuts(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each stretch of equal values begins and ends."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])).tolist() if len(x) else [0]
    yield from zip(at, at[1:])


def _share(key: tuple, group: pd.DataFrame, most: int) -> pd.DataFrame:
    """For each block, which of its hashes of a share another document has too, and which are hot."""
    hashes = [np.frombuffer(b, np.int64) for b in group["hashes"]]  # too random to compress
    value, of, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    hot = np.bincount(of, np.concatenate([_unpack(b, np.int32) for b in group["kinds"]]), len(value)) > most
    bits, marks = [], []
    for x, m, at in zip(hashes, group["multi"], np.split(of, np.cumsum([len(x) for x in hashes])[:-1])):
        bits.append(zlib.compress(np.packbits(np.unpackbits(np.frombuffer(m, np.uint8), count=len(x)).astype(bool) | (n > 1)[at]).tobytes(), 1))
        marks.append(zlib.compress(np.packbits(hot[at]).tobytes(), 1))
    return pd.DataFrame({"block": group["block"].to_numpy(), "shard": key[0], "bits": bits, "hot": marks})


def _bands(at: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bytes before the anchor, which pieces have the 42 bytes from there on).

    A window has its anchor and 26 bytes more, so many before it and the rest after it; windows with 0 to 8, 9 to 17 or
    18 to 26 before it agree at least on 18 bytes around the anchor.
    """
    for before in range(0, SPAN, BAND):
        yield before, np.flatnonzero((at >= before) & (at - before + GRAM + SPAN - BAND <= size))


def _piece_hashes(data: np.ndarray, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The hashes of each piece's anchor, of the piece, and of the bands around the anchor that `_bands` says it has."""
    h, value, *around = np.zeros((2 + len(range(0, SPAN, BAND)), len(start)), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(data), PART_BYTES)), len(start)))
    for p, q in zip(cuts, cuts[1:]):
        total, inverse = _rolling(data[start[p] : start[q - 1] + size[q - 1]])
        a, n, place = start[p:q] - start[p], size[p:q], at[p:q]
        anchor = a + place
        h[p:q] = (total[anchor + GRAM] - total[anchor]) * inverse[anchor]
        value[p:q] = (total[a + n] - total[a]) * inverse[a]
        for (before, own), found in zip(_bands(place, n), around):
            left = anchor[own] - before
            found[p + own] = (total[left + GRAM + SPAN - BAND] - total[left]) * inverse[left]
    return _mixed(h), value, around


def _meeting(h: np.ndarray, at: np.ndarray, size: np.ndarray, around: list[np.ndarray]) -> np.ndarray:
    """Which pieces can share a window with another: those that have a band in common."""
    found = np.zeros(len(h), bool)
    for (_, own), value in zip(_bands(at, size), around):
        _, kind, n = np.unique(value[own] ^ h[own].view(np.uint64), return_inverse=True, return_counts=True)
        found[own[n[kind] > 1]] = True
    return found


def _resolve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """For each block's pieces of a share, the least document that has each of their windows."""
    ids = np.concatenate([_unpack(x, np.int64) for x in group["ids"]])
    at, size = (np.concatenate([_unpack(x, np.uint8) for x in group[c]]).astype(np.int64) for c in ("places", "lengths"))
    data = np.frombuffer(b"".join(zlib.decompress(x) for x in group["data"]), np.uint8)
    counts = [len(_unpack(x, np.uint8)) for x in group["lengths"]]
    start = np.cumsum(size) - size
    h, value, around = _piece_hashes(data, at, start, size)
    kinds, found = distinct(data, start, size, h, value)
    owner = np.full(len(kinds), LAST)
    np.minimum.at(owner, found, ids)
    h, at, start, size, around = h[kinds], at[kinds], start[kinds], size[kinds], [x[kinds] for x in around]
    windows = size - LENGTH + 1
    begin = np.cumsum(windows) - windows
    least = np.repeat(owner, windows)  # so it is where a piece meets no other
    meeting = np.flatnonzero(_meeting(h, at, size, around))
    meeting = meeting[np.argsort(h[meeting], kind="stable")]
    batch, bytes_ = [], 0
    stretches = list(_cuts(h[meeting]))
    for n, (a, b) in enumerate(stretches):
        batch.append(meeting[a:b])
        bytes_ += int(size[batch[-1]].sum())
        if bytes_ > ARRAY_BYTES or n == len(stretches) - 1:
            own = np.concatenate(batch)
            least[_spread(begin[own], windows[own])] = window_owners(data, start[own], size[own], owner[own])
            batch, bytes_ = [], 0
    parts = np.split(found, np.cumsum(counts)[:-1])
    return pd.DataFrame({"block": group["block"].to_numpy(), "shard": key[0], "least": [_pack(least[_spread(begin[x], windows[x])]) for x in parts]})


def remove_repeats(documents: DataFrame, *, id_col="doc_id", text_col="text", keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row; ids are whole numbers.

    A byte goes if a 50-byte string over it also starts in a document with a smaller id; strings are judged on the
    input. A null text is empty; a null id counts as the largest; rows of the same id do not affect one another; texts
    under 50 bytes stay whole, very long ones are cut into slices but judged whole. An empty table gives no rows; no other
    column is read.
    """
    with batch_bytes(documents.sparkSession, "4m"):
        return _remove_repeats(documents, id_col, text_col, keep_text, hot)


def _remove_repeats(documents: DataFrame, id_col: str, text_col: str, keep_text: bool, hot: int) -> DataFrame:
    cut = bucketed(blocks(documents, id_col, text_col), "block", deal=False)  # joined twice; the texts never pass a shuffle
    size = cut.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    bits = max(1, (size // SHARD_BYTES).bit_length())  # as many shares as the input has parts of that size

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                found = _anchors_of(row)[3]
                h, multi, kinds = _own_hashes(found[0], found[2], found[5])
                rows = [(s, row.block, h[at].tobytes(), np.packbits(multi[at]).tobytes(), _pack(kinds[at])) for s, at in _ranges(h, bits)]
                yield pd.DataFrame(rows, columns=["shard", "block", "hashes", "multi", "kinds"])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                data, _, _, (shard, at, owner, start, size), _, _ = _pieces(row, bits)
                rows = [(int(shard[a]), row.block, *(_pack(x[a:b]) for x in (owner, at.astype(np.uint8), size.astype(np.uint8))), _pack(data[_spread(start[a:b], size[a:b])])) for a, b in _cuts(shard)]
                yield pd.DataFrame(rows, columns=["shard", "block", "ids", "places", "lengths", "data"])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                data, lengths, ids, (*_, size), found, (first, document) = _pieces(row, bits)
                step = np.zeros(len(data) + 1, np.int8)
                windows = size - LENGTH + 1
                begin = np.cumsum(windows) - windows
                least, done = np.empty(windows.sum(), np.int64), 0
                for x in sorted(row.owners, key=lambda x: x["shard"]) if len(found) else ():
                    own = _unpack(x["least"], np.int64)
                    least[done : done + len(own)] = own
                    done += len(own)
                for part in np.array_split(np.arange(len(found)), len(found) // 20_000 + 1):
                    n = windows[found[part]]
                    earlier = least[_spread(begin[found[part]], n)] < np.repeat(ids[document[part]], n)
                    at = _spread(first[part], n)[earlier]  # each window is in one stretch
                    step[at] += 1
                    step[at + LENGTH] -= 1
                gone = np.cumsum(step[:-1], dtype=np.int8) > 0  # 50 at most
                rows, at = [], 0
                for i, no, n in zip(ids.tolist(), row.none, lengths.tolist()):
                    g, text = gone[at : at + n], data[at : at + n]
                    kept = text[~g].tobytes()
                    spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                    rows.append((i, bool(no), n, int(g.sum()), spans, hashlib.sha256(kept).hexdigest()) + ((kept,) if keep_text else ()))
                    at += n
                yield pd.DataFrame(rows, columns=["k", "none", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    shared = cut.mapInPandas(hashes, "shard int, block string, hashes binary, multi binary, kinds binary").groupBy("shard").applyInPandas(lambda key, group: _share(key, group, hot), "block string, shard int, bits binary, hot binary")
    marks = durable(shared.groupBy("block").agg(F.collect_list(F.struct("shard", "bits", "hot")).alias("marks")))
    marked = cut.join(marks, "block", "left")  # made again for the last pass rather than written: it holds all texts
    resolved = marked.mapInPandas(pieces, "shard int, block string, ids binary, places binary, lengths binary, data binary").groupBy("shard").applyInPandas(_resolve, "block string, shard int, least binary")
    owners = durable(resolved.groupBy("block").agg(F.collect_list(F.struct("shard", "least")).alias("owners")))
    out = marked.join(owners, "block", "left").mapInPandas(apply, "k long, none boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
    return durable(out.select(F.when(~F.col("none"), F.col("k")).alias(id_col), *out.columns[2:]))
