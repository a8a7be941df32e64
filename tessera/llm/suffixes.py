"""Repeated-string removal with suffix arrays.

Texts are UTF-8 bytes. A byte is removed if a string of ``WINDOW`` = 400 bytes covers it
that also starts anywhere else, in this document or another; strings are judged on the
input. Bytes that a repeated string of ``SHORT`` = 300 bytes covers are counted besides
(``n_shared``), so passages too short to be removed show.

1. *Pieces.* The anchor of a 300-byte window is its smallest hashed ``GRAM``-byte string
   (leftmost of equals), a function of the window's content alone; a piece is a run of
   consecutive windows with one anchor occurrence, and its bytes go on to 400 from the last
   window's start, if the document does. Equal strings of 300 bytes, so those of 400 too, have
   equal anchors, so only pieces with equal anchors need be compared.
2. *Which pieces.* Each chunk sends one entry for each distinct piece (a 128-bit cryptographic
   digest of its bytes) and one for what is around its anchor in each of four alignments of
   233 bytes; pieces with a common window agree in one. Entries meet by hash, so neither
   equal pieces nor different ones around a frequent line gather in one place. A digest that
   occurs twice settles all windows of its pieces; of each set of equal pieces one goes on,
   and only if a different piece agrees with it in an alignment. So copies of a document,
   however many, cost one list entry for each chunk.
3. *Suffix arrays.* Pieces are dealt to shards by anchor. Each shard builds the suffix
   array of its windows by Larsson-Sadakane refinement in numpy: ranks by the first 8
   bytes, then doubling, sorting again only what is still tied and still asked for. Kasai's
   recurrence, run over all pieces side by side, gives the common prefixes of neighbours
   that have equal ranks by 256 bytes; those with 400 or more in common repeat as a whole.
4. *Merging shards.* An anchor's pieces are dealt over as many shards as hold ``hot`` of them
   each. Of an anchor in several, each shard sends the sorted hashes of its distinct windows
   to a merge dealt by hash, and each list is looked up in the sorted union of all by binary
   search.

A document is read in blocks of 1 MB that overlap by a window; a task holds the texts of one
chunk (and of one document longer than that), and about 20 bytes for each of their bytes.

Defined results: null and empty texts have no bytes; documents shorter than 400 bytes
stay whole; rows that repeat are occurrences of their own, so their long texts go;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import chunks, frames
from tessera.llm import textbatch as tb

WINDOW, SHORT, GRAM = 400, 300, 32
_SPAN = SHORT - GRAM + 1  # gram positions in a short window
#: A repeated short window reaches over its anchor by L bytes to the left and R to the right
#: with L + R = 268; so for one of these it covers all of (left, right) around the anchor.
_REACH = [(0, 201), (67, 134), (134, 67), (201, 0)]
_PLACE_BITS = 24  # of a key: gram position; the others: its hash
_BLOCK = 1 << 20  # bytes of one document handled at once
SHARD_BYTES = 1 << 20
HOT = 512
MOST_PARTITIONS = 1 << 15


def _least(key: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive keys, by block-wise prefix and suffix minima."""
    size = len(key) - n + 1
    rows = -(-len(key) // n)
    padded = np.full(rows * n, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    square = padded.reshape(rows, n)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:size], ahead[n - 1 : n - 1 + size])


@dataclass
class _Pieces:
    """Pieces of a part of a chunk, by column."""

    row: np.ndarray
    start: np.ndarray  # of the first window, in the document
    windows: np.ndarray  # short ones
    whole: np.ndarray  # those of 400 bytes
    begin: np.ndarray  # the bytes, in ``raw``
    end: np.ndarray
    anchor: np.ndarray
    digest: np.ndarray  # two words each
    around: np.ndarray  # a hash for each alignment (zero: it reaches past the document)
    raw: bytes

    def data(self, k: int) -> bytes:
        return self.raw[self.begin[k] : self.end[k]]


def _pieces(buf: np.ndarray, off: np.ndarray, row: int, base: int, starts: int) -> _Pieces | None:
    """The pieces of whole documents or of a block of one, which begins at ``base`` there and
    whose windows start before ``starts``."""
    if len(buf) < SHORT:
        return None
    sums = tb.Sums(buf)
    grams = np.arange(len(buf) - GRAM + 1)
    h = sums.hashes(grams, grams + GRAM)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    anchor = (_least((h & ~low) | grams.astype(np.uint64), _SPAN) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(anchor)]
    fits = np.flatnonzero(np.arange(len(anchor)) + SHORT <= off[doc + 1])
    fits = fits[: np.searchsorted(fits, starts)]
    if not len(fits):
        return None
    new = np.ones(len(fits), bool)
    new[1:] = (anchor[fits[1:]] != anchor[fits[:-1]]) | (fits[1:] != fits[:-1] + 1)
    first = fits[new]
    last = fits[np.append(np.flatnonzero(new)[1:], len(fits)) - 1]
    at, own = anchor[first], doc[first]
    end = np.minimum(last + WINDOW, off[own + 1])
    around = np.zeros((len(first), len(_REACH)), np.uint64)
    for k, (left, right) in enumerate(_REACH):
        inside = np.flatnonzero((at - left >= off[own]) & (at + GRAM + right <= off[own + 1]))
        here = sums.hashes(at[inside] - left, at[inside] + GRAM + right)
        around[inside, k] = tb.mix(here + h[at[inside]] * np.uint64(2 * k + 1)) | np.uint64(1)
    raw = buf.tobytes()
    digests = b"".join(hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(first.tolist(), end.tolist()))
    return _Pieces(row + own, first - off[own] + base, last - first + 1, np.maximum(end - first - WINDOW + 1, 0), first, end, h[at], np.frombuffer(digests, np.uint64).reshape(-1, 2), around, raw)


class _Chunk:
    """The documents of a chunk in a fixed order, and their pieces."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()

    def pieces(self):
        row = 0
        for batch in self.table.to_batches():
            for part in tb.slices(batch, most=min(tb.SLICE_BYTES, _BLOCK)):
                buf, off = tb.flat(part.column("text"))
                if len(buf) <= _BLOCK:
                    blocks = [(buf, off, 0)]
                else:  # one long document; blocks share the windows' overlap
                    cut = (buf[at : at + _BLOCK + WINDOW - 1] for at in range(0, len(buf), _BLOCK))
                    blocks = ((x, np.array([0, len(x)]), k * _BLOCK) for k, x in enumerate(cut))
                for block, own, base in blocks:
                    if (got := _pieces(block, own, row, base, _BLOCK if len(buf) > _BLOCK else len(buf))) is not None:
                        yield got
                row += part.num_rows


_LOWEST = np.uint64(1)  # bit


def _entries(pieces: list[_Pieces]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values that a chunk sends, sorted by key. An even key is half of a digest
    with the other half as value, whose lowest bit says that the chunk has it twice; an odd
    key is what is around an anchor, with pieces it is around, two of them at most."""
    digest = np.concatenate([x.digest for x in pieces])
    around = np.concatenate([x.around for x in pieces])
    order = np.lexsort(digest.T)
    digest, around = digest[order], around[order]
    first = np.flatnonzero(np.append(True, (digest[1:] != digest[:-1]).any(axis=1)))
    many = np.diff(np.append(first, len(digest))) > 1
    digest, around = digest[first], around[first]
    key, of = around.reshape(-1), np.repeat(digest[:, 0], around.shape[1])
    some = np.flatnonzero(key)
    some = some[np.lexsort((of[some], key[some]))]
    key, of = key[some], of[some]
    place = np.arange(len(key))
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    few = place - place[new][np.cumsum(new) - 1] < 2
    keys = np.concatenate([digest[:, 0] & ~_LOWEST, key[few]])
    values = np.concatenate([digest[:, 1] & ~_LOWEST | many, of[few]])
    order = np.lexsort((values, keys))
    return keys[order], values[order]


def _answered(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the entries of all chunks are digests that occur twice, or surroundings of
    different pieces; and which are digests that an entry before them has."""
    order = np.lexsort((value, key))
    k, v = key[order], value[order]
    same_key = k[1:] == k[:-1]
    digest = k & _LOWEST == 0
    twice = digest & (v & _LOWEST > 0)
    met = same_key & np.where(digest[1:], v[1:] >> _LOWEST == v[:-1] >> _LOWEST, v[1:] != v[:-1])
    twice[1:] |= met
    twice[:-1] |= met
    # What holds for one entry of a key holds for all: of a digest those with its other half.
    first = np.append(True, ~same_key | digest[1:] & (v[1:] >> _LOWEST != v[:-1] >> _LOWEST))[: len(k)]
    group = np.cumsum(first) - 1
    told, follows = np.zeros(len(key), bool), np.zeros(len(key), bool)
    told[order] = (np.bincount(group, weights=twice) > 0)[group] if len(k) else twice
    follows[order] = digest & ~first
    return told, follows


def _verdicts(docs: DataFrame, n: int) -> DataFrame:
    """(chunk, bucket, a, b): in packed lists the chunk's keys that are told of, and those of
    digests that another chunk's piece stands for."""

    def send(table: pa.Table) -> pa.Table:
        pieces = list(_Chunk(table).pieces())
        key, value = _entries(pieces) if pieces else (np.zeros(0, np.uint64),) * 2
        bucket = (key >> _LOWEST) % np.uint64(n)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(n + 1))
        own = np.flatnonzero(np.diff(edge))
        cut = [pa.array([chunks.pack(x[order[edge[b] : edge[b + 1]]]) for b in own], pa.binary()) for x in (key, value)]
        return pa.Table.from_arrays([pa.array(np.full(len(own), table.column("chunk")[0].as_py()), pa.int32()), pa.array(own, pa.int32()), *cut], names=["chunk", "bucket", "a", "b"])

    def answer(table: pa.Table) -> pa.Table:
        keys, values = ([chunks.unpack(x) for x in table.column(c).to_pylist()] for c in "ab")
        ends = np.cumsum([len(k) for k in keys])
        cut = [pa.array([chunks.pack(np.unique(k[x[e - len(k) : e]])) for k, e in zip(keys, ends)], pa.binary()) for x in _answered(np.concatenate(keys), np.concatenate(values))]
        return pa.Table.from_arrays([table.column("chunk"), table.column("bucket"), *cut], names=["chunk", "bucket", "a", "b"])

    sent = docs.groupBy("chunk").applyInArrow(send, "chunk int, bucket int, a binary, b binary")
    return sent.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, a binary, b binary")


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_SENT = "chunk int, row int, size int, start long, windows int, anchor long, part long, settled boolean, data binary"


def _joined(x: _Pieces, at: np.ndarray, size: int) -> pa.Table:
    """Runs of repeated strings of a size, of pieces that all repeat; those that adjoin as one."""
    count = x.windows if size == SHORT else x.whole
    at = at[count[at] > 0]
    end = x.start + count
    new = np.ones(len(at), bool)
    new[1:] = (x.row[at[1:]] != x.row[at[:-1]]) | (x.start[at[1:]] != end[at[:-1]])
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else at
    return pa.table({"row": pa.array(x.row[first], pa.int32()), "size": pa.array(np.full(len(first), size), pa.int32()), "start": pa.array(x.start[first], pa.int64()), "windows": pa.array(end[last] - x.start[first], pa.int32())})


def _sent(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Runs of windows known to repeat (data null), and pieces to compare."""

    def send(key, own: pa.Table, answers: pa.Table) -> pa.Table:
        told, others = (np.sort(np.concatenate([np.zeros(0, np.uint64), *(chunks.unpack(x) for x in answers.column(c).to_pylist())])) for c in "ab")
        known: list[pa.Table] = []
        work: list[tuple] = []
        gone: set[bytes] = set()
        for x in _Chunk(own).pieces():
            twice = chunks.among(told, x.digest[:, 0] & ~_LOWEST)
            compared = chunks.among(told, x.around.reshape(-1)).reshape(x.around.shape).any(axis=1)
            compared &= ~chunks.among(others, x.digest[:, 0] & ~_LOWEST)
            at = np.flatnonzero(twice)
            known += [_joined(x, at, size) for size in (SHORT, WINDOW)]
            for k in np.flatnonzero(compared).tolist():
                digest = x.digest[k].tobytes()
                if digest not in gone:  # one of equal pieces goes
                    gone.add(digest)
                    work.append((x.row[k], x.start[k], x.windows[k], x.anchor[k].view(np.int64), x.digest[k, 1].view(np.int64), twice[k], x.data(k)))
        kinds = {"row": pa.int32(), "start": pa.int64(), "windows": pa.int32(), "anchor": pa.int64(), "part": pa.int64(), "settled": pa.bool_(), "data": pa.binary()}
        sent = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*work)) or [[]] * 7, kinds.values())], names=list(kinds))
        out = pa.concat_tables([sent, *known], promote_options="default")
        if "size" not in out.column_names:
            out = out.append_column("size", pa.nulls(out.num_rows, pa.int32()))
        return out.append_column("chunk", pa.array([key[0].as_py()] * out.num_rows, pa.int32())).select(_names(_SENT))

    return docs.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(send, _SENT)


def _eights(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number in their order; zeros past the end."""
    n = len(text)
    held = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.lib.stride_tricks.sliding_window_view(held, 8)[:n].copy().view(">u8").reshape(-1).astype(np.uint64)
    room = ends - np.arange(n)
    late = np.flatnonzero(room < 8)
    key[late] &= np.uint64(2**64 - 1) << (np.uint64(64) - np.uint64(8) * room[late].astype(np.uint64))
    return key


def suffix_ranks(text: np.ndarray, ends: np.ndarray, depth: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rank of every suffix (that is ``asked`` for) among all, by its first ``depth``
    bytes at least, and its rank by half as many; a suffix ends where its piece does. Equal
    ranks: equal as far as that."""
    n = len(text)
    key = _eights(text, ends)
    order = np.argsort(key).astype(np.int32)
    sorted_key = key[order]
    new = np.append(True, sorted_key[1:] != sorted_key[:-1])
    at = np.flatnonzero(new).astype(np.int32)
    size = np.diff(np.append(at, n))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(at, size)
    half = rank
    tied = order[np.repeat(size > 1, size)]
    steps = [8 << k for k in range(max(0, (depth - 1) // 8).bit_length())]
    # The last step needs the ranks of what is asked for and of what is so much further on, and so on.
    needed = [np.ones(n, bool) if asked is None else asked]
    for h in reversed(steps):
        more = needed[-1].copy()
        more[h:] |= needed[-1][:-h] if h < n else False
        needed.append(more)
    for h, wanted in zip(steps, needed[-2::-1]):
        if h == steps[-1]:
            half = rank.copy()
        tied = tied[wanted[tied]]
        if not len(tied):
            continue
        further = tied + np.int32(h)
        after = np.where(further < ends[tied], rank[np.minimum(further, n - 1)], -1) + 1
        old = rank[tied]
        pair = (old.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        order = np.argsort(pair, kind="stable")  # by old ranks in order already
        tied, pair = tied[order], pair[order]
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        group = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        size = np.diff(np.append(new, len(tied)))
        # In a group of equal old ranks, how many come before.
        rank[tied] = old + np.repeat(new, size) - np.repeat(group, np.diff(np.append(group, len(tied))))
        tied = tied[np.repeat(size > 1, size)]
    return rank, half


def _leading_equal(differ: np.ndarray) -> np.ndarray:
    """How many of the 8 leading bytes are zero."""
    # Without neighbouring ones a number isn't rounded up to the next power of two.
    bits = np.frexp((differ & ~(differ >> np.uint64(1))).astype(np.float64))[1]
    return (64 - bits) >> 3


def common_prefixes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, place: np.ndarray, most: int, steps: np.ndarray | None = None, known: np.ndarray | None = None) -> np.ndarray:
    """Kasai's recurrence over all pieces side by side: for each suffix, what it has
    in common (at most ``most``) with the suffix before it in ``order``. ``steps``: how
    many suffixes of each piece, from its start, are in the order; ``known``: what each is
    known to have in common at least, and none are looked at where that is nothing."""
    every = ends - starts
    steps = every if steps is None else steps
    stop = np.repeat(ends, every)
    key = _eights(text, stop)
    common = np.zeros(len(text), np.int64)
    within = np.repeat(starts + steps, every)  # the suffixes in the order end here
    by_length = np.argsort(-steps, kind="stable")
    lanes = np.searchsorted(-steps[by_length], -np.arange(int(steps.max(initial=0))), "left")
    k = np.zeros(len(starts), np.int64)
    for step, n in enumerate(lanes.tolist()):
        lane = by_length[:n]
        p = starts[lane] + step
        r = place[p]
        q = order[np.maximum(r - 1, 0)]
        limit = np.where(r > 0, np.minimum(np.minimum(stop[p] - p, stop[q] - q), most), 0)
        have = np.maximum(k[:n] - 1, 0)
        if known is not None:
            limit = np.where(known[p] > 0, limit, 0)
            have = np.maximum(have, known[p])
        have = np.minimum(have, limit)
        live = np.flatnonzero(have < limit)
        while len(live):
            h = have[live]
            equal = _leading_equal(key[p[live] + h] ^ key[q[live] + h])
            have[live] = h = np.minimum(h + equal, limit[live])
            live = live[(equal == 8) & (h < limit[live])]
        common[p] = have
        # The next suffix has as much in common but one, if what follows q is in the order too and
        # still before it, which ranks by a bounded depth don't imply.
        after = np.minimum(q + 1, len(text) - 1)
        k[:n] = np.where((q + 1 < within[q]) & (place[after] < place[np.minimum(p + 1, len(text) - 1)]), have, 0)
    return common


def _repeats(pieces: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Window starts of all pieces (as offsets into their concatenation), by size whether the
    string that starts there does so twice among them, and the concatenated bytes."""
    size = np.array([len(p) for p in pieces])
    ends = np.cumsum(size)
    starts = ends - size
    text = np.frombuffer(b"".join(pieces), np.uint8)
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    asked = np.zeros(len(text), bool)
    asked[at] = True
    rank, half = suffix_ranks(text, np.repeat(ends, size), WINDOW, asked)
    order = at[np.argsort(rank[at])]
    place = np.zeros(len(text), np.int64)
    place[order] = np.arange(len(order))
    known = np.zeros(len(text), np.int64)
    known[order[1:]] = np.where(half[order[1:]] == half[order[:-1]], 256, 0)
    common = common_prefixes(text, starts, ends, order, place, WINDOW, windows, known)
    r = place[at]
    twice = {}
    for size in (SHORT, WINDOW):
        joint = np.zeros(len(order) + 1, bool)  # of each place in the order: is its string that of the place before
        joint[1:-1] = common[order[1:]] >= size
        twice[size] = joint[r] | joint[r + 1]
    return at, twice, text


_RUNS = "chunk int, row int, size int, start long, windows int"


def _as_runs(chunk: np.ndarray, row: np.ndarray, start: np.ndarray, size: int) -> pa.Table:
    """Windows as runs of consecutive starts."""
    order = np.lexsort((start, row, chunk))
    chunk, row, start = chunk[order], row[order], start[order]
    new = np.ones(len(start), bool)
    new[1:] = (chunk[1:] != chunk[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    return pa.Table.from_arrays([pa.array(chunk[first], pa.int32()), pa.array(row[first], pa.int32()), pa.array(np.full(len(first), size), pa.int32()), pa.array(start[first], pa.int64()), pa.array(count, pa.int32())], names=["chunk", "row", "size", "start", "windows"])


_FOUND = f"{_RUNS}, range int, a binary, b binary, c binary, d binary, e binary, f binary"


def _in_shard(table: pa.Table, ranges: int) -> pa.Table:
    """The runs that repeat in the shard, and for anchors in several one list for each size and
    range of hashes: the sorted hashes of distinct windows (a, b), whether they are in doubt
    (c) and where they are (d, e, f)."""
    pieces = table.column("data").to_pylist()
    windows = table.column("windows").to_numpy().astype(np.int64)
    at, twice, text = _repeats(pieces, windows)
    piece = np.repeat(np.arange(len(pieces)), windows)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(windows) - windows, windows)
    room = np.array([len(p) for p in pieces])[piece] - inner
    chunk, row = table.column("chunk").to_numpy()[piece], table.column("row").to_numpy()[piece]
    start = table.column("start").to_numpy()[piece] + inner
    settled = table.column("settled").to_numpy(zero_copy_only=False)[piece]
    spread = (table.column("shards").to_numpy() > 1)[piece]
    out = []
    for size, both in twice.items():
        told = np.flatnonzero(both & ~settled)
        out.append(_as_runs(chunk[told], row[told], start[told], size))
        # What is in doubt is decided by the merge; a window that repeats here is there as a witness.
        hot = np.flatnonzero(spread & (room >= size))
        if not len(hot):
            continue
        h = tb.span_hashes(text, at[hot], at[hot] + size)
        g = tb.span_hashes(text[::-1], len(text) - at[hot] - size, len(text) - at[hot])
        order = np.lexsort((g, h))
        keep = np.ones(len(order), bool)
        keep[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        order = order[keep]
        order = order[np.argsort((g[order] % np.uint64(ranges)).astype(np.int64), kind="stable")]
        hot, h, g = hot[order], h[order], g[order]
        range_ = (g % np.uint64(ranges)).astype(np.int64)
        edge = np.searchsorted(range_, np.arange(ranges + 1))
        own = np.flatnonzero(np.diff(edge))
        doubt = ~(both | settled)[hot]
        columns = [h, g, doubt.astype(np.uint64), *((x[hot] * doubt).astype(np.uint64) for x in (chunk, row, start))]
        lists = [pa.array([chunks.pack(np.ascontiguousarray(c[edge[r] : edge[r + 1]])) for r in own], pa.binary()) for c in columns]
        out.append(pa.Table.from_arrays([pa.array(own, pa.int32()), pa.array(np.full(len(own), size), pa.int32()), *lists], names=["range", "size", *"abcdef"]))
    return pa.concat_tables([_EMPTY_FOUND, *out], promote_options="default").select(_names(_FOUND))


_EMPTY_FOUND = pa.table({n: pa.array([], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _FOUND.split(", "))})


def _merged(table: pa.Table) -> pa.Table:
    """Windows of anchors in several shards that are in several of their lists: every hash is
    looked up in the sorted union of the lists by binary search."""
    h, g, doubt, chunk, row, start = (np.concatenate([chunks.unpack(x) for x in table.column(c).to_pylist()]) for c in "abcdef")
    union = np.sort(h)
    some = np.flatnonzero(np.searchsorted(union, h, "right") - np.searchsorted(union, h, "left") > 1)
    some = some[np.lexsort((g[some], h[some]))]
    new = np.ones(len(some), bool)
    new[1:] = (h[some][1:] != h[some][:-1]) | (g[some][1:] != g[some][:-1])
    several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1 if len(some) else new
    told = some[several & (doubt[some] > 0)]
    return _as_runs(*(x[told].astype(np.int64) for x in (chunk, row, start)), table.column("size")[0].as_py())


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int | None = None, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    n_shared and kept (binary: the bytes that stay)."""
    total, _ = chunks.sized(docs, text)
    own = chunks.dealt(docs, total, doc_id, text, chunk_bytes)
    sent = frames.stored(_sent(own, _verdicts(own, chunks.buckets(total / 27))))
    known = sent.filter("data is null").select("chunk", "row", "size", "start", "windows")
    work = sent.filter("data is not null").drop("size")
    facts = work.agg(F.sum(F.length("data")).alias("b")).first()
    n = max(1, -(-(facts["b"] or 0) // shard_bytes))
    # Counted before the shuffle; stored, so that the join can split a frequent anchor.
    held = frames.stored(work.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > hot))
    several = not held.isEmpty()
    if several:
        work = work.join(held, "anchor", "left").withColumn("shards", F.coalesce(F.ceil(F.col("n") / hot), F.lit(1)).cast("int")).drop("n")
    else:
        work = work.withColumn("shards", F.lit(1))
    work = work.withColumn("home", F.pmod(F.xxhash64("anchor", F.pmod("part", "shards")), F.lit(n)))
    # Sorting suffixes takes seconds for a megabyte, so shards aren't put together by their size.
    work = work.repartition(min(n, MOST_PARTITIONS), "home")
    ranges = max(8, n // 4)
    found = frames.stored(work.groupBy("home").applyInArrow(lambda t: _in_shard(t, ranges), _FOUND))
    runs = known.unionByName(found.filter("range is null").select(*known.columns))
    if several:
        runs = runs.unionByName(found.filter("range is not null").groupBy("range", "size").applyInArrow(_merged, _RUNS))

    def finish(key, table: pa.Table, found: pa.Table) -> pa.Table:
        data = _Chunk(table).table
        ids = data.column("doc_id")
        buf, off = tb.flat(data.column("text"))
        row, at, start, windows = (found.column(c).to_numpy().astype(np.int64) for c in ("row", "size", "start", "windows"))
        covered = {}
        for of in (SHORT, WINDOW):
            mark = np.zeros(len(buf) + 1, np.int32)
            mine = at == of
            np.add.at(mark, off[row[mine]] + start[mine], 1)
            np.add.at(mark, off[row[mine]] + start[mine] + windows[mine] + of - 1, -1)
            covered[of] = np.cumsum(mark[:-1], dtype=np.int32) > 0
        size = np.diff(off)
        kept, removed, spans, shared = [], [], [], []
        for s, e in zip(off, off[1:]):
            k = ~covered[WINDOW][s:e]
            kept.append(buf[s:e][k].tobytes())
            removed.append(int(e - s) - len(kept[-1]))
            spans.append(int(np.count_nonzero(~k & np.append(True, k[:-1]))) if removed[-1] else 0)
            shared.append(int(np.count_nonzero(covered[SHORT][s:e])))
        return pa.Table.from_arrays([ids, pa.array(size), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(shared, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "kept"])

    return own.groupBy("chunk").cogroup(runs.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, kept binary")
