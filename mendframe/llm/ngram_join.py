"""Joining documents whose word shingle sets have a Jaccard similarity of 0.8 or more, size-aware.

Sets are small or large, with the boundary chosen by cost. Two sets of sizes m <= n link exactly if they share
c(m, n) = ceil(0.8 (m + n) / 1.8) shingles. Small sets enumerate their subsets of that size for each partner size, so
that an equal subset is a link without a further test. Large sets, and those small ones whose partners can be large,
stand in inverted lists of the rarest shingles that a partner cannot avoid (n - ceil(0.8 n) + 1 of them); scanning a
list gives candidates, and candidates are tested on whole sets.

Texts are read once. A chunk of documents sends each of its shingles to one of many buckets, packed; a bucket tells each
chunk which of its shingles other chunks have as well, and in how many sets. What only one set has can't be in an
intersection, so all later steps work on the rest, and most sets drop out: those with more shingles of their own than a
link allows. The rest is in the exact order of rarity. Equal sets are collapsed. Two members of a list are a candidate
only if their sizes and the shingle's positions in them allow a link (`may_link`), which few unrelated ones pass.

A list isn't joined with itself. Its smallest member is the hub that the others are tested against; lists whose shingle
is frequent are cut into parts with a hub each, and the hubs meet in a second list. Members are also tested against a few
neighbours in a random order of each list. What the links leave in several components is compared at last: every member
outside a list's largest component with all members of other components, in blocks, but for pairs that sketches of the
sets rule out. Candidates are tested on whole sets, those of one hub in parts. Components follow from links in rounds
of grouped minima. No list, hub or component has to fit a task. Sets over LARGEST_SMALL are never enumerated: their
subsets outnumber any list's cost.

Defined cases: null texts and texts without words have the empty set and link with nothing; fewer than five words give
one shingle, the whole sequence; repeated rows and equal sets share a component; rows without doc_id link like others,
and a component of only such rows has a null component_id; an empty table gives an empty result; extra columns stay out
of the way. Shingles are told apart by 48 bits of a hash, sets by 64.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.components import components
from mendframe.llm.shared import estimated_bytes, materialise, own_name, slices, small_batches, tidied

WORDS = 5
PERCENT = 80
KEY_BYTES = 6
CHUNK_SHINGLES = 1_000_000
CHUNK_ROWS = 60_000
RECURS = 65_535
LEAST_BUCKETS = 128
BUCKET_BYTES = 4 << 20
LARGEST_SMALL = 12
SCAN_COST = 0.25
PART_ROWS = 400
MARK_BITS = 26
HUB_ROWS = 1000
NEIGHBOURS = 4
SKETCH_BITS = 1024
BLOCK_ROWS = 4096
PAIRS_AT_ONCE = 1 << 16
PAIRS_HELD = 1 << 20
POSTING = "token long, part int, size int, id long, position int"
LISTED = ["token", "part", "size", "id", "position", "hub", "hub_size", "hub_position"]
PAIR = "x long, x_size int, y long, y_size int"
MIX = np.uint64(0x9E3779B97F4A7C15)


def finished(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in one array, sorted within each text, and where each text begins."""
    if texts.offset:  # pyarrow 23 lowers a cast slice wrongly
        texts = texts.take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    coded = pc.dictionary_encode(lists.flatten())
    named = coded.dictionary.to_pylist()
    hashes = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in named), np.uint64) if named else np.empty(0, np.uint64)
    codes = np.asarray(coded.indices).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets).astype(np.int64)))
    real = np.array([w != "" for w in named], bool)[codes] if named else np.empty(0, bool)
    h, owner = hashes[codes][real], owner[real]
    count = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(count) - count
    left = (begin + count)[owner] - np.arange(len(h))  # words from here to the text's end
    starts = (left >= words) | (np.arange(len(h)) == begin[owner])
    at = np.flatnonzero(starts)
    mixed = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            there = left[at] > k
            nth = np.where(there, h[np.minimum(at + k, len(h) - 1)], np.uint64(k)) if len(h) else mixed
            mixed = finished(mixed * MIX + nth + np.uint64(k + 1))
    doc = owner[at]
    order = np.lexsort((mixed, doc))
    mixed, doc = mixed[order], doc[order]
    fresh = np.ones(len(mixed), bool)
    fresh[1:] = (mixed[1:] != mixed[:-1]) | (doc[1:] != doc[:-1])
    mixed, doc = mixed[fresh], doc[fresh]
    return mixed, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int64)


def set_keys(shingles: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, 0 for empty ones."""
    with np.errstate(over="ignore"):
        zero = np.zeros(1, np.uint64)
        one, two = (np.concatenate([zero, np.cumsum(finished(shingles ^ salt), dtype=np.uint64)]) for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)))
        sizes = np.diff(starts).astype(np.uint64)
        keys = [finished((x[starts[1:]] - x[starts[:-1]]) * MIX + sizes) for x in (one, two)]
    return tuple(np.where(sizes == 0, np.uint64(0), k).view(np.int64) for k in keys)


def overlap(m: int, n: int, percent: int = PERCENT) -> int:
    """The least intersection with which sets of sizes m and n link."""
    return -(-percent * (m + n) // (100 + percent))


def partner_sizes(n: int, percent: int = PERCENT) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix_length(n, percent: int = PERCENT):
    return n + (-percent * n // 100) + 1  # n - ceil(percent n / 100) + 1


def subset_keys(n: int, percent: int = PERCENT) -> int:
    """How many subsets a set of n shingles enumerates as a small one."""
    return sum(comb(n, overlap(n, m, percent)) for m in partner_sizes(n, percent))


def boundary(sizes: dict[int, int], lists: float, percent: int = PERCENT) -> int:
    """The largest size that is enumerated: the cut with the least total cost over the sets there are.

    sizes: number of sets by size, up to LARGEST_SMALL; lists: the mean length of an inverted list.
    """
    best, least, small = 0, 0.0, 0.0
    for n in range(1, LARGEST_SMALL + 1):
        have = sizes.get(n, 0)
        small += have * (subset_keys(n, percent) - prefix_length(n, percent) * (1 + SCAN_COST * lists))
        if small <= least:
            best, least = n, small
    return best


def planes(keys: np.ndarray) -> bytes:
    """KEY_BYTES bytes of each key, most significant ones of all keys first: sorted keys compress that way."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BYTES :].T).tobytes()


def keys_of(data: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, 8 - KEY_BYTES :] = data[: n * KEY_BYTES].reshape(KEY_BYTES, n).T
    return out.view(">u8").ravel().astype(np.int64)


def raw(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8)


ROWS = "bucket int, kind int, chunk long, n int, payload binary"
MEMBERS, RECURRING, ENTRIES, ANSWERS = range(4)


def chunk_rows(chunk: int, buckets: int, ids: np.ndarray, named: np.ndarray, shingles: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """What a chunk of documents tells: its members, the shingles that recur in it, and by bucket each shingle once."""
    one, two = set_keys(shingles, starts)
    sizes = np.diff(starts)
    order = np.lexsort((np.where(named, ids, np.iinfo(np.int64).max), one))
    new = np.ones(len(order), bool)
    new[1:] = one[order][1:] != one[order][:-1]
    owners = np.sort(order[new & (sizes[order] > 0)])  # equal sets speak once, by the smallest doc_id
    own = np.repeat(owners, sizes[owners])
    at = np.arange(len(own)) - np.repeat(np.cumsum(sizes[owners]) - sizes[owners], sizes[owners]) + np.repeat(starts[owners], sizes[owners])
    key = (shingles[at] >> np.uint64(64 - 8 * KEY_BYTES)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, own = key[order], own[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    run = np.diff(np.append(first, len(key)))
    again = np.repeat(run > 1, run)
    members = np.concatenate([x.astype(np.int64) for x in (ids, named, sizes, one, two)]).tobytes()
    recurring = np.concatenate([key[first][run > 1], run[run > 1], own[again]]).astype(np.int64).tobytes()
    token, owner = key[first], np.where(run > 1, RECURS, own[first]).astype(np.uint16)
    bucket = (token >> (8 * KEY_BYTES - 32)) * buckets >> 32
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    numbers, counts, payloads = [], [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        numbers.append(int(bucket[a]))
        counts.append(b - a)
        payloads.append(planes(token[a:b]) + owner[a:b].tobytes() + run[a:b][run[a:b] > 1].astype(np.uint32).tobytes())
    home = chunk * 2654435761 % buckets
    kinds = [MEMBERS, RECURRING, *[ENTRIES] * len(counts)]
    return pa.RecordBatch.from_arrays(
        [pa.array([home, home, *numbers], pa.int32()), pa.array(kinds, pa.int32()), pa.array([chunk] * len(kinds), pa.int64()), pa.array([len(ids), int((run > 1).sum()), *counts], pa.int32()), pa.array([members, recurring, *payloads], pa.binary())],
        names=["bucket", "kind", "chunk", "n", "payload"],
    )


def chunked(rows: DataFrame, words: int, buckets: int) -> DataFrame:
    """chunk_rows() of rows (doc_id, text), some CHUNK_SHINGLES at a time; the only pass over texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        task, nth = TaskContext.get().partitionId() << 32, 0

        def closed() -> pa.RecordBatch:
            ids, named, shingles, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return chunk_rows(task + nth, buckets, ids, named, shingles, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))

        for batch in batches:
            for part in slices(batch, 1, CHUNK_ROWS):
                if held and sum(len(h[0]) for h in held) + part.num_rows > CHUNK_ROWS:
                    yield closed()
                    nth += 1
                shingles, starts = shingle_sets(part.column(1), words)
                held.append((np.asarray(pc.fill_null(part.column(0), 0)), np.asarray(part.column(0).is_valid()), shingles, np.diff(starts)))
                if sum(len(h[2]) for h in held) > CHUNK_SHINGLES:
                    yield closed()
                    nth += 1
        if held:
            yield closed()

    return rows.mapInArrow(tidied(run), ROWS)


def answered(told: DataFrame) -> DataFrame:
    """For each chunk the shingles that other chunks have too, with their numbers of sets; members and recurring ones pass through.

    A bucket's entries are those of one range of shingles; buckets stream by, one at a time is held.
    """

    def answers(entries: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        keys, owners, counts = [], [], []
        for _, n, data in entries:
            keys.append(keys_of(data, n))
            owner = data[n * KEY_BYTES : n * (KEY_BYTES + 2)].view(np.uint16)
            count = np.ones(n, np.int64)
            count[owner == RECURS] = data[n * (KEY_BYTES + 2) :].copy().view(np.uint32)
            owners.append(owner)
            counts.append(count)
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        run = np.diff(np.append(first, len(key)))
        sets, shared = np.empty(len(key), np.int64), np.empty(len(key), bool)
        sets[order] = np.repeat(np.add.reduceat(count[order], first), run)
        shared[order] = np.repeat(run > 1, run)
        chunks, numbers, payloads, at = [], [], [], 0
        for (chunk, n, _), k, o in zip(entries, keys, owners, strict=True):
            here, in_sets = shared[at : at + n], sets[at : at + n]
            at += n
            if here.any():
                chunks.append(chunk)
                numbers.append(int(here.sum()))
                payloads.append(planes(k[here]) + o[here].tobytes() + np.minimum(in_sets[here], 0xFFFFFFFF).astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(chunks, pa.int64()), pa.array([ANSWERS] * len(chunks), pa.int32()), pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())], names=["chunk", "kind", "n", "payload"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, entries = None, []
        for batch in batches:
            numbers, kinds = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            yield batch.select(["chunk", "kind", "n", "payload"]).filter(pa.array(kinds != ENTRIES))
            chunks, counts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i in np.flatnonzero(kinds == ENTRIES).tolist():
                if numbers[i] != bucket and entries:
                    yield answers(entries)
                    entries = []
                bucket = numbers[i]
                entries.append((chunks[i], counts[i], raw(batch.column(4)[i]).copy()))
        if entries:
            yield answers(entries)

    return told.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(run), "chunk long, kind int, n int, payload binary")


def members_of(told: DataFrame) -> DataFrame:
    """doc_id, n, id and other (two digests of the set) of all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                ids, named, n, one, two = raw(value).view(np.int64).reshape(5, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=named == 0), pa.array(n), pa.array(one), pa.array(two)], names=["doc_id", "n", "id", "other"])

    return told.where(F.col("kind") == MEMBERS).select("payload").mapInArrow(run, "doc_id long, n long, id long, other long")


def shared_sets(told: DataFrame, percent: int, twins: list[int]) -> DataFrame:
    """Sets that can link with another one, by what they share with any other set.

    A row has the set's size, how many of its shingles no other set has, the others sorted (items), those of them that
    belong to its prefix, rarest first, and in how many sets those are. Sets whose prefix is all their own are left out.
    A sketch has a bit for each of SKETCH_BITS groups of shingles: whether the set holds an odd number of its items.
    """

    def assemble(parts: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        by_kind = {kind: [(n, data) for k, n, data in parts if k == kind] for kind in (MEMBERS, RECURRING, ANSWERS)}
        ids, named, sizes, one, two = by_kind[MEMBERS][0][1].view(np.int64).reshape(5, -1)
        many, flat = by_kind[RECURRING][0]
        flat = flat.view(np.int64)
        repeated, times, owners = flat[:many], flat[many : 2 * many].copy(), flat[2 * many :]
        runs = times.copy()
        keys, own, sets = [], [], []
        for n, data in by_kind[ANSWERS]:
            keys.append(keys_of(data, n))
            own.append(data[n * KEY_BYTES : n * (KEY_BYTES + 2)].view(np.uint16).astype(np.int64))
            sets.append(data[n * (KEY_BYTES + 2) :].copy().view(np.uint32).astype(np.int64))
        key, owner, count = (np.concatenate([np.empty(0, np.int64), *x]) for x in (keys, own, sets))
        recurs = owner == RECURS
        times[np.searchsorted(repeated, key[recurs])] = count[recurs]
        key = np.concatenate([key[~recurs], np.repeat(repeated, runs)])
        owner = np.concatenate([owner[~recurs], owners])
        count = np.concatenate([count[~recurs], np.repeat(times, runs)])
        held = np.bincount(owner, minlength=len(sizes))
        unique = sizes - held
        room = prefix_length(sizes, percent) - unique  # places of the prefix that shared shingles take
        able = np.flatnonzero((held > 0) & (room > 0))
        fine = (room > 0)[owner]
        key, owner, count = key[fine], owner[fine], count[fine]
        order = np.lexsort((key, owner))
        items, ends = key[order], np.cumsum(held[able])
        order = np.lexsort((key, count, owner))
        nth = np.arange(len(order)) - np.repeat(ends - held[able], held[able])
        order = order[nth < room[owner[order]]]
        prefix, count = key[order], count[order]
        cuts = np.cumsum(np.minimum(held, room)[able])

        def blobs(values: np.ndarray, upto: np.ndarray) -> pa.Array:
            places = pa.py_buffer((np.concatenate([[0], upto]) * 8).astype(np.int32))
            return pa.Array.from_buffers(pa.binary(), len(upto), [None, places, pa.py_buffer(np.ascontiguousarray(values.astype(np.int64)))])

        place = np.repeat(np.arange(len(able)), held[able]) * SKETCH_BITS + (finished(items.view(np.uint64)) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
        sketches = np.packbits((np.bincount(place, minlength=len(able) * SKETCH_BITS) & 1).astype(np.uint8))
        digest = np.where(np.isin(one, np.array(twins, np.int64)), two, one)[able]
        columns = [pa.array(ids[able], mask=named[able] == 0), pa.array(digest), pa.array(sizes[able].astype(np.int32)), pa.array(unique[able].astype(np.int32))]
        return pa.RecordBatch.from_arrays([*columns, blobs(items, ends), blobs(prefix, cuts), blobs(count, cuts), blobs(sketches.view(np.int64), np.arange(1, len(able) + 1) * (SKETCH_BITS // 64))], names=["doc_id", "id", "size", "unique", "items", "prefix", "sets", "sketch"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts = None, []
        for batch in batches:
            chunks, kinds, counts = (batch.column(i).to_pylist() for i in range(3))
            for i, c in enumerate(chunks):
                if c != chunk and parts:
                    yield assemble(parts)
                    parts = []
                chunk = c
                parts.append((kinds[i], counts[i], raw(batch.column(3)[i]).copy()))
        if parts:
            yield assemble(parts)

    placed = told.repartition("chunk").sortWithinPartitions("chunk")
    return placed.mapInArrow(tidied(run), "doc_id long, id long, size int, unique int, items binary, prefix binary, sets binary, sketch binary")


def subset_postings(items: np.ndarray, n: int, percent: int) -> Iterator[tuple[np.ndarray, int]]:
    """(tokens, need) for each size of a partner of a small set: its subsets of the size of their least intersection.

    n is the set's size, items what it shares with any other set: no other shingle can be in an intersection. need is
    the smaller size of the two.
    """
    with np.errstate(over="ignore"):
        for m in partner_sizes(n, percent):
            c = overlap(n, m, percent)
            parts = np.array(list(combinations(range(len(items)), c)), np.int64).reshape(-1, c)
            tag = np.uint64((min(m, n) << 20) + max(m, n))
            yield finished(finished(items.view(np.uint64)[parts]).sum(axis=1, dtype=np.uint64) * MIX + tag).view(np.int64), min(m, n)


def candidate_lists(sets: DataFrame, most_small: int, percent: int) -> DataFrame:
    """Postings (token, part, size, id, position): part is -need for subsets, 0 for a whole list, 1, 2... for parts of one."""

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]

            def add(token, part, size, ident, position) -> None:
                ones = np.ones(len(token), np.int64)
                for held, x in zip(out, (token, part * ones, size * ones, ident * ones, position * ones), strict=True):
                    held.append(x)

            numbers = zip(*(batch.column(i).to_pylist() for i in range(3)), *(batch.column(i) for i in range(3, 6)), strict=True)
            for ident, size, unique, items, prefix, counts in numbers:
                if size <= most_small:
                    for token, need in subset_postings(np.frombuffer(items.as_buffer(), np.int64), size, percent):
                        add(token, -need, size, ident, 0)
                # sets that no larger partner can reach need no list; a partner of size n + 1 or more needs n >= percent of it
                if 100 * size >= percent * (most_small + 1):
                    token = np.frombuffer(prefix.as_buffer(), np.int64)
                    # frequent shingles: as many parts as it takes for a part to stay near PART_ROWS
                    split = np.frombuffer(counts.as_buffer(), np.int64) // PART_ROWS
                    add(token, np.where(split > 1, 1 + (ident & (1 << 60) - 1) % np.maximum(split, 1), 0), size, ident, unique + np.arange(len(token)))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x]), t) for x, t in zip(out, kinds, strict=True)], names=["token", "part", "size", "id", "position"])

    return sets.select("id", "size", "unique", "items", "prefix", "sets").mapInArrow(post, POSTING)


def scan_lists(postings: DataFrame) -> DataFrame:
    """The distinct members of each list of two or more, each with the list's hub: its first by size and id.

    Rows stream in order of lists; only the hub and one row are held. The hub of a part is given even where it is alone.
    """
    placed = postings.repartition("token", "part").sortWithinPartitions("token", "part", "size", "id")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hub = None, None  # the last row, and the hub of its list, not given while it may be alone
        for batch in batches:
            rows = [np.asarray(batch.column(i)) for i in range(5)]
            if held is not None:
                rows = [np.concatenate([[h], x]).astype(x.dtype) for h, x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            token, part, size, ident, position = rows
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
            again = np.zeros(len(token), bool)
            again[1:] = ~new[1:] & (ident[1:] == ident[:-1])
            rows = [x[~again] for x in rows]
            token, part, size, ident, position = rows
            new = new[~again]
            going = held is not None and hub is not None
            first = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            heads = [x[first] for x in (ident, size, position)]
            if going:
                for x, h in zip(heads, hub, strict=True):
                    x[first == 0] = h
            last = np.append(new[1:], False)  # ends its list, as far as this batch shows
            alone = new & last & (part <= 0)
            if going:
                alone[0] = False
            given = ~alone
            given[-1] = False  # the last row waits for the next batch
            yield pa.RecordBatch.from_arrays([pa.array(x[given]) for x in (*rows, *heads)], names=LISTED)
            held, hub = [x[-1] for x in rows], None if new[-1] and not (going and len(token) == 1) else [x[-1] for x in heads]
        if held is not None and (hub is not None or held[1] > 0):
            hub = hub or [held[3], held[2], held[4]]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([x])) for x in (*held, *hub)], names=LISTED)

    return placed.mapInArrow(scan, POSTING + ", hub long, hub_size int, hub_position int")


def may_link(size_a, place_a, size_b, place_b, percent: int):
    """Whether sets of these sizes whose first common shingle is at these positions can link; works on numbers and columns.

    What comes before the first common shingle in either is not common, so min(size - position) bounds the intersection.
    """
    least = percent * (size_a + size_b)
    return ((100 + percent) * (size_a - place_a) >= least) & ((100 + percent) * (size_b - place_b) >= least) & (100 * size_a >= percent * size_b) & (100 * size_b >= percent * size_a)


def ordered_pairs(rows: DataFrame, left: tuple[str, str], right: tuple[str, str]) -> DataFrame:
    """Distinct pairs (a, b): a the set that is smaller by size and id; left and right name id and size columns."""
    x, y = F.struct(F.col(left[1]).alias("s"), F.col(left[0]).alias("i")), F.struct(F.col(right[1]).alias("s"), F.col(right[0]).alias("i"))
    return rows.select(F.least(x, y)["i"].alias("a"), F.greatest(x, y)["i"].alias("b")).where("a <> b").distinct()


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, tested on sets (id, size, items). The b sides come to the set of a, in parts where a has many."""
    parts = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {HUB_ROWS}) as int)").alias("parts"))
    own = sets.select("id", "size", "items")
    sides = pairs.join(parts, "a").join(own.withColumnRenamed("id", "b"), "b").select("a", F.expr("cast(pmod(xxhash64(b), parts) as int)").alias("part"), "b", "size", "items")
    heads = parts.join(own.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "size", "items")
    placed = heads.unionByName(sides).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, most = np.empty(0, np.int64), 0
        for batch in batches:
            heads, sizes, kept = batch.column(2).is_null().to_pylist(), batch.column(3).to_pylist(), []
            for i, items in enumerate(batch.column(4)):
                mine = np.frombuffer(items.as_buffer(), np.int64)
                if heads[i]:
                    head, most = mine.copy(), sizes[i]
                    continue
                both = np.concatenate([head, mine])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (most + sizes[i] - common):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return placed.mapInArrow(test, "a long, b long")


def marked(rows: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """rows with a flag that is true for every doc_id in ids and, by chance, for some others.

    The flags lie in a bitmap of 2^MARK_BITS bits, broadcast as rows of 64: 2^(MARK_BITS - 6) rows at most.
    """
    spot, word, bits = (own_name(rows, n) for n in ("mark_place", "mark_word", "mark_bits"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - MARK_BITS)
    bit = F.expr(f"shiftleft(cast(1 as bigint), cast({spot} & 63 as int))")
    marks = ids.select(place.alias(spot)).select(F.shiftright(spot, 6).alias(word), bit.alias("bit")).groupBy(word).agg(F.bit_or("bit").alias(bits))
    placed = rows.withColumn(spot, place).withColumn(word, F.shiftright(spot, 6)).join(F.broadcast(marks), word, "left")
    return placed.withColumn(flag, F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))).select(*rows.columns, flag)


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (id, component) after links (a, b) of ids, through the components of links between components."""
    left, right = (parts.select(F.col("id").alias(s), F.col("component").alias(f"{s}_part")) for s in ("a", "b"))
    between = links.join(left, "a").join(right, "b").where("a_part <> b_part").select(F.col("a_part").alias("a"), F.col("b_part").alias("b"))
    roots = components(between).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return materialise(parts.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "parts")


def sketches_allow(size_a, held_a, sketch_a, size_b, held_b, sketch_b, percent: int) -> np.ndarray:
    """Whether pairs of sets (size, number of items, sketch) can link: each bit that differs is an item of only one."""
    apart = np.bitwise_count(sketch_a ^ sketch_b).sum(axis=1, dtype=np.int64)
    return (100 + percent) * (held_a + held_b - apart) >= 2 * percent * (size_a + size_b)


def open_lists(listed: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of the lists whose members are in several components; main tells the members of the list's largest one."""
    rows = listed.join(parts, "id")
    shares = rows.groupBy("token", "component").agg(F.count("*").alias("n"))
    chief = shares.groupBy("token").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("rows")).where("top.n < rows")
    joined = rows.join(chief.select("token", F.col("top.component").alias("chief"), "rows"), "token")
    return joined.select("token", "id", "size", "position", "component", (F.col("component") == F.col("chief")).alias("main"), "rows")


def chained(listed: DataFrame, percent: int) -> DataFrame:
    """Pairs of near neighbours, the members of each list in a random order of its own."""
    placed = listed.select("token", "id", "size", "position").withColumn("turn", F.xxhash64("token", "id")).repartition("token").sortWithinPartitions("token", "turn")

    def neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [np.asarray(batch.column(n)) for n in ("token", "id", "size", "position")]
            if held is not None:
                rows = [np.concatenate([h, x]) for h, x in zip(held, rows, strict=True)]
            token, ident, size, position = rows
            found = []
            for step in range(1, NEIGHBOURS + 1):
                x, y = slice(None, -step), slice(step, None)
                fine = (token[x] == token[y]) & may_link(size[x].astype(np.int64), position[x], size[y].astype(np.int64), position[y], percent)
                found.append([z[s][fine] for s in (x, y) for z in (ident, size)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["x", "x_size", "y", "y_size"])
            held = [z[-NEIGHBOURS:] for z in rows]

    return ordered_pairs(placed.mapInArrow(neighbours, PAIR), ("x", "x_size"), ("y", "y_size"))


def crossed(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that a list's sizes, positions and sketches allow.

    Long lists go in parts: a member of the largest component in one, any other in all, and it meets the members at home there.
    """
    parts = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    home = F.expr(f"cast(pmod(xxhash64(id), cast(ceil(rows / {BLOCK_ROWS}) as int)) as int)")
    opened = opened.join(sets.select("id", (F.col("size") - F.col("unique")).alias("held"), "sketch"), "id")
    dealt = opened.withColumn("home", home).withColumn("part", F.explode(F.when(F.col("main"), F.array("home")).otherwise(F.sequence(F.lit(0), parts - 1))))
    placed = dealt.select("token", "part", "id", "size", "position", "component", "main", (F.col("home") == F.col("part")).alias("home"), "held", "sketch").repartition("token", "part").sortWithinPartitions("token", "part")

    def cross(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = None, ["token", "part", "id", "size", "position", "component", "main", "home", "held"]
        found: list[np.ndarray] = []

        def pairs(rows) -> None:
            _, _, ident, size, position, component, main, home, held, sketch = rows
            size, held = size.astype(np.int64), held.astype(np.int64)
            others, own = np.flatnonzero(~main), np.flatnonzero(home)
            for at in range(0, len(others), step := max(1, PAIRS_AT_ONCE // max(1, len(own)))):
                x, y = others[at : at + step, None], own[None, :]
                fine = (component[x] != component[y]) & may_link(size[x], position[x], size[y], position[y], percent)
                i, j = np.nonzero(fine)
                i, j = others[at + i], own[j]
                fine = sketches_allow(size[i], held[i], sketch[i], size[j], held[j], sketch[j], percent)
                i, j = i[fine], j[fine]
                swap = (size[i] > size[j]) | ((size[i] == size[j]) & (ident[i] > ident[j]))
                found.append(np.stack([ident[np.where(swap, j, i)], ident[np.where(swap, i, j)]], axis=1))

        def given() -> pa.RecordBatch:
            both = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = [np.asarray(batch.column(n).to_numpy(zero_copy_only=False)) for n in names]
            rows.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64))
            if held is not None:
                rows = [np.concatenate([h, x]) for h, x in zip(held, rows, strict=True)]
            cuts = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            bounds = [0, *cuts.tolist()]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                pairs([x[a:b] for x in rows])
            held = [x[bounds[-1] :] for x in rows]
            if sum(map(len, found)) > PAIRS_HELD:
                yield given()
        if held is not None:
            pairs(held)
        yield given()

    return placed.mapInArrow(cross, "a long, b long").distinct()


def ngram_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of documents."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    buckets = max(LEAST_BUCKETS, estimated_bytes(rows) // BUCKET_BYTES)
    told = materialise(answered(chunked(rows, words, buckets)), "shingles")

    members = materialise(members_of(told), "members")
    # different sets of one first digest go by their second one; among 1e10 sets some three pairs are expected
    twins = [r["id"] for r in members.where("n > 0").groupBy("id").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").select("id").toLocalIterator()]
    members = members.select("doc_id", "n", F.when(F.col("id").isin(twins), F.col("other")).otherwise(F.col("id")).alias("id"))
    groups = materialise(members.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("rep")), "groups")
    found = shared_sets(told, percent, twins).join(groups.withColumnRenamed("id", "same"), F.col("id") == F.col("same"))
    sets = materialise(found.where(F.col("doc_id").eqNullSafe(F.col("rep"))).drop("doc_id", "same", "rep").dropDuplicates(["id"]), "sets")
    small = {r["size"]: r["n"] for r in sets.where(F.col("size") <= LARGEST_SMALL).groupBy("size").agg(F.count("*").alias("n")).collect()}
    shares = sets.agg(F.sum(F.octet_length("prefix") / 8).alias("rows"), F.count("*").alias("sets")).first()
    most_small = boundary(small, float(shares["rows"] or 0) / max(1, shares["sets"]), percent)

    listed = materialise(scan_lists(candidate_lists(sets, most_small, percent)), "lists")
    sure = listed.where("part < 0 and hub_size = -part").select(F.col("hub").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    # the hubs of a shingle's parts meet in a list of their own
    hubs = listed.where("part > 0 and id = hub").select("token", F.lit(0).alias("part"), "size", "id", "position")
    near = may_link(*(F.col(c).cast("long") for c in ("hub_size", "hub_position", "size", "position")), percent)
    full = listed.where("part >= 0")
    tried = ordered_pairs(full.unionByName(scan_lists(hubs)).where("id <> hub").where(near), ("hub", "hub_size"), ("id", "size"))
    tried = materialise(tried.unionByName(chained(full, percent)).distinct(), "candidates")
    parts = listed.select("id").distinct().select("id", F.col("id").alias("component"))
    parts = merged(parts, sure.unionByName(linked(tried, sets, percent)))

    # members that their hub and their neighbours leave in other components meet all others that sketches allow
    opened = open_lists(full.select("token", "id", "size", "position"), parts)
    rest = materialise(crossed(opened, sets, percent).join(tried, ["a", "b"], "left_anti"), "candidates")
    parts = merged(parts, linked(rest, sets, percent))

    by_set = groups.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = by_set.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = by_set.join(smallest, "component").select("id", "component_id")
    out = members.join(named, "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Documents without those that link to one of smaller doc_id, directly or over others.

    Equal rows become one; rows without doc_id can't be told apart by it and stay.
    """
    named = docs.where("doc_id is not null")
    found = materialise(ngram_components(named, percent, words).select("doc_id", "component_id"), "components")
    gone = found.groupBy("doc_id").agg(F.max("component_id").alias("c")).where("c <> doc_id").select("doc_id")
    flag = own_name(docs, "doubtful")
    told = marked(named, gone, flag)
    # rows outside the bitmap stay without an exchange of texts; the others are looked up
    kept = told.where(~F.col(flag)).unionByName(told.where(flag).join(gone, "doc_id", "left_anti")).select(*docs.columns)
    if found.groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))
