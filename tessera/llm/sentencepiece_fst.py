"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file and composed with each input:

* the *normaliser* reads characters and writes the symbols that pieces are made of: the
  longest match among the model's rules (its compiled character map) or the character itself,
  a leading space before a text, one space for a run of them, if the model says so;
* the *piece machine* reads symbols along a trie of the pieces; at the end of a piece it
  writes the id, weighs it, and goes on in the state that the piece leads to;
* the *byte machine* reads a symbol that is no piece and writes the ids of its UTF-8 bytes.

Weights are real numbers of the tropical semiring, added along a path, and the path of least
weight is the encoding. In a unigram model a piece weighs minus its log probability, a
character as bytes 10 more than the least likely piece, and there is one state. In a
byte-pair model the order of merges decides, which no sum of piece weights gives: there the
state is the last piece, pieces weigh nothing, and the arc from piece ``s`` to piece ``t``
weighs nothing if merging the text of ``s`` followed by ``t`` (best score first, then
leftmost) ends in just these two pieces, else infinity; so the path of finite weight is the
model's own segmentation. Both are relaxed by the same code: composed states are (position,
state), made as they are reached, and arcs of infinite weight are left out.

Between two characters that stand side by side in no piece every path has a border, so a
text is cut there (before spaces, beside punctuation) into chunks which are composed
one by one; each worker keeps the paths of chunks seen, in a table of bounded size. Of a long
text a task holds about 40 bytes for each byte.

Defined results: null and empty texts have no ids; repeated rows get equal results;
decoding gives the normalised text back (with the identity: the text, except that U+2581
becomes a space); byte ids that are not
valid UTF-8 decode to U+FFFD each; unknown and control ids decode to nothing; columns
named like the outputs are replaced. Models without byte fallback, with pieces defined by
users, or whose pieces are whole words or characters raise ValueError.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import frames
from tessera.llm import textbatch as tb

SPACE = "▁"
#: Chunks, and piece pairs, of a generation that a worker remembers.
REMEMBER = 100_000

#: Characters from which on a chunk's positions are kept in arrays of numbers.
LONG_CHUNK = 1 << 16
_NORMAL, _USER, _BYTE = 1, 4, 6
_UNIGRAM, _MERGES = 1, 2
#: Fixed value: what a character outside the vocabulary weighs more than the worst piece.
_UNKNOWN = 10.0


def _wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol-buffers message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class Vocabulary:
    """What a model file holds; its size is that of the file."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model: int  # what the pieces are
    rules: bytes  # the normaliser's compiled character map
    lead: bool  # whether a space is put before a text
    squeeze: bool  # whether runs of spaces become one, and those at the ends none

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        pieces, scores, kinds, model, rules, lead, squeeze = [], [], [], _UNIGRAM, b"", True, True
        for field, value in _wire(data):
            if field == 1:
                own = dict(_wire(value))
                pieces.append(own[1].decode())
                scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(own.get(3, _NORMAL))
            elif field == 2:
                model = dict(_wire(value)).get(3, _UNIGRAM)
            elif field == 3:
                own = dict(_wire(value))
                rules, lead, squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
                if not own.get(5, 1):
                    raise ValueError("the model doesn't write spaces as U+2581")
        if model not in (_UNIGRAM, _MERGES) or _USER in kinds:
            raise ValueError("only unigram and byte-pair models without pieces defined by users are compiled")
        return cls(pieces, scores, kinds, model, rules, lead, squeeze)


class Normaliser:
    """The first machine. Its rules are a double array (a trie of UTF-8 prefixes in one table of
    numbers) and a pool of what they write; arcs are looked up as characters ask for them."""

    def __init__(self, v: Vocabulary):
        self.lead, self.squeeze = v.lead, v.squeeze
        size = int(np.frombuffer(v.rules[:4], "<u4")[0]) if v.rules else 0
        self.units = np.frombuffer(v.rules[4 : 4 + size], "<u4").tolist()
        self.pool = v.rules[4 + size :]
        #: Whether a text is its own output but for the leading space.
        self.plain = not self.units and not self.squeeze

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _rule(self, data: memoryview, at: int) -> tuple[int, bytes] | None:
        """Length and output of the longest rule that matches there. A view's rest isn't copied."""
        found = None
        node = self._jump(self.units[0])
        for n, c in enumerate(data[at:], 1):
            node ^= c
            if node >= len(self.units) or self.units[node] & (1 << 31 | 255) != c:
                break
            unit = self.units[node]
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                start = self.units[node] & ((1 << 31) - 1)
                found = n, self.pool[start : self.pool.index(b"\0", start)]
        return found

    def apply(self, text: str) -> str:
        if self.units:
            data, out, at = memoryview(text.encode()), [], 0
            while at < len(data):
                if (got := self._rule(data, at)) is not None:
                    n, written = got
                else:
                    n = 1
                    while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                        n += 1
                    written = data[at : at + n]
                out.append(written)
                at += n
            text = b"".join(out).decode()
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return " " + text if self.lead and text else text


class Recent:
    """A table of bounded size: what was asked for in this generation or the last."""

    def __init__(self, most: int = REMEMBER):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        got = self.new.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Transducer:
    """The piece and byte machines, composed with a chunk of the normaliser's output."""

    def __init__(self, v: Vocabulary):
        self.ids = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == _NORMAL}
        self.scores = v.scores
        self.pieces = v.pieces
        self.merges = v.model == _MERGES
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == _BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        self.byte_weight = 0.0 if self.merges else _UNKNOWN - min(self.scores[i] for i in self.ids.values())
        self.trie: dict = {}  # arcs by symbol; under None the arc that ends a piece: id and weight
        for p, i in self.ids.items():
            if not self.merges or self._merged(p) == [p]:
                node = self.trie
                for c in p:
                    node = node.setdefault(c, {})
                node[None] = i, 0.0 if self.merges else -self.scores[i]
        self.longest = max(map(len, self.ids))
        self.links: dict[int, dict[int, float]] = {}
        self.n_links = 0
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: Whether two bytes stand side by side in a piece, in either spelling of the space.
        self.inner = np.zeros((256, 256), bool)
        for p in self.ids:
            for x, y in zip(p, p[1:]):
                for a in {x.encode(), x.replace(SPACE, " ").encode()}:
                    for b in {y.encode(), y.replace(SPACE, " ").encode()}:
                        self.inner[a[-1], b[0]] = True
        self.inner[:, 0x80:0xC0] = True  # within a character

    def _merged(self, text: str, until: int = 1) -> list[str]:
        """The pieces of a short text in the model's merge order; ``until`` stops at so
        many."""
        parts = list(text)
        while len(parts) > until:
            found = [(self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            k = -max(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge gives this one; null for a single character."""
        got = self.halves.get(piece, ())
        if got == ():
            text = self.pieces[piece]
            got = None if len(text) == 1 else tuple(self.ids.get(p, -1) for p in self._merged(text, 2))
            self.halves[piece] = got
        return got

    def link(self, s: int, t: int) -> float:
        """The weight of the arc from state s (the last piece; below 0: none) to piece t.

        Merges are undone at the boundary, latest first, while none could have been made
        across it before them.  ``best``: the score from which on a merge across the
        boundary comes too late; at a tie the one further left is made."""
        row = self._links_of(s)
        got = row.get(t)
        if got is None:
            got = row[t] = 0.0 if s < 0 or not self.merges or self._apart(s, t) else math.inf
            self.n_links += 1
        return got

    def _links_of(self, s: int) -> dict[int, float]:
        """The weights known from state s; all are forgotten when there are too many."""
        if self.n_links >= 4 * REMEMBER:
            self.links.clear()
            self.n_links = 0
        row = self.links.get(s)
        if row is None:
            row = self.links[s] = {}
        return row

    def _apart(self, s: int, t: int) -> bool:
        scores, best, tie = self.scores, -math.inf, True
        left, right = self._halves(s), self._halves(t)
        while True:
            across = self.ids.get(self.pieces[s] + self.pieces[t])
            if across is not None and (scores[across] > best or tie and scores[across] == best):
                return False
            if left is None and right is None:
                return True
            # The later of the two merges that end at the boundary is undone; of equal ones the right.
            if right is None or left is not None and scores[s] < scores[t]:
                best, tie = scores[s], False
                s = left[1]
                left = self._halves(s)
            else:
                best, tie = scores[t], True
                t = right[0]
                right = self._halves(t)

    def arcs(self, text: str, at: int) -> list[tuple[int, int, float]]:
        """(piece, where it ends, weight) for each arc of the piece machine from a position,
        or that of the byte machine (piece -1) if the symbol is no piece by itself."""
        out = []
        node = self.trie
        for end in range(at, min(len(text), at + self.longest)):
            node = node.get(text[end])
            if node is None:
                break
            if None in node:
                piece, weight = node[None]
                out.append((piece, end + 1, weight))
        if not out or out[0][1] > at + 1:
            out.append((-1, at + 1, self.byte_weight))
        return out

    def path(self, chunk: str) -> list[int]:
        """Ids on the path of least weight through the composition with ``chunk``; of equal
        ones that whose last piece begins first. In both kinds of model one state of a position
        has a finite distance at most, so a position stands for its state."""
        text = chunk.replace(" ", SPACE)
        n = len(text)
        if n < LONG_CHUNK:
            distance, written, begin = [math.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        else:
            distance, written, begin = array("d", [math.inf]) * (n + 1), array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1)
        distance[0] = 0.0
        trie, merges = self.trie, self.merges
        for at in range(n):
            here, s = distance[at], written[at] if merges else -1
            if here == math.inf:
                continue  # no arc leads here
            known = self._links_of(s)
            node, alone = trie, False
            end = at
            for symbol in text[at : at + self.longest]:
                node = node.get(symbol)
                if node is None:
                    break
                end += 1
                arc = node.get(None)
                if arc is not None:
                    piece, weight = arc
                    alone = alone or end == at + 1
                    link = known.get(piece)
                    if link is None:
                        link = self.link(s, piece)
                    total = here + weight + link
                    if total < distance[end]:
                        distance[end], written[end], begin[end] = total, piece, at
            if not alone and here + self.byte_weight < distance[at + 1]:
                distance[at + 1], written[at + 1], begin[at + 1] = here + self.byte_weight, -1, at
        if distance[n] == math.inf:
            raise AssertionError(f"no path through {chunk!r}")
        out: list[int] = []
        at = n
        while at:
            piece, start = written[at], begin[at]
            if piece < 0:
                out.extend(self.bytes[b] for b in reversed(text[start].encode()))
            else:
                out.append(piece)
            at = start
        return out[::-1]


class Encoder:
    """A transducer with a table of known chunks. The driver compiles it once; each worker gets a copy that goes
    on by itself."""

    def __init__(self, v: Vocabulary):
        self.fst = Transducer(v)
        self.normaliser = Normaliser(v)
        self.known = Recent()  # ids as bytes

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document's begin (plus the end)."""
        normaliser = self.normaliser
        if not normaliser.plain:
            column = pa.array([normaliser.apply(t or "") for t in column.to_pylist()], pa.string())
        buf, off = tb.flat(column)
        size = np.diff(off)
        # The normaliser's leading space, where there is a text and it isn't there yet.
        lead = (size > 0).astype(np.int64) * (normaliser.plain and normaliser.lead)
        to = np.concatenate([[0], np.cumsum(size + lead)])
        out = np.full(to[-1], 0x20, np.uint8)
        keep = np.ones(len(out), bool)
        keep[to[:-1][lead > 0]] = False
        out[keep] = buf
        if not len(out):
            return np.zeros(0, np.int32), np.zeros(len(size) + 1, np.int64)
        start = np.ones(len(out), bool)
        start[1:] = ~self.fst.inner[out[:-1], out[1:]]
        start[to[:-1][size > 0]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(out))
        _, first, inverse = np.unique(tb.span_hashes(out, starts, ends), return_index=True, return_inverse=True)
        raw = out.tobytes()
        paths = []
        for s, e in zip(starts[first].tolist(), ends[first].tolist()):
            chunk = raw[s:e]
            got = self.known.get(chunk)
            if got is None:
                got = array("i", self.fst.path(chunk.decode())).tobytes()
                self.known.put(chunk, got)
            paths.append(got)
        n = np.array([len(p) for p in paths]) // 4
        pool = np.frombuffer(b"".join(paths), np.int32)
        ids, ends_of = _gather(pool, np.concatenate([[0], np.cumsum(n)])[:-1][inverse], n[inverse])
        chunk_ends = np.concatenate([[0], ends_of])
        return ids, chunk_ends[np.searchsorted(starts, to)]


class Decoder:
    """The inverse: each id's text from a pool."""

    def __init__(self, v: Vocabulary):
        texts = [bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(SPACE, " ").encode() if k == _NORMAL else b"" for p, k in zip(v.pieces, v.kinds)]
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.text_size = np.array([len(t) for t in texts])
        self.text_at = np.concatenate([[0], np.cumsum(self.text_size)])
        self.lead = v.lead

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        data, ends = _gather(self.text_bytes, self.text_at[ids], self.text_size[ids])
        ends = np.concatenate([[0], ends])
        raw = data.tobytes()
        out = []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            text = raw[ends[s] : ends[e]].decode(errors="replace")
            out.append(text[1:] if self.lead and text.startswith(" ") else text)
        return out


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool's runs [start, start + size) after each other, and where each ends."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(start - (ends - size), size) + np.arange(total)], ends


_IDS = T.ArrayType(T.IntegerType(), containsNull=False)


def _once(kind, sent, cache: dict):
    if not cache:
        cache["coder"] = kind(sent.value)
    return cache["coder"]


def encode(docs: DataFrame, model_path: str, text: str = "text", check: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``n_tokens`` (long). The driver reads and compiles the
    model, which is broadcast. ``check``: the ids are decoded at once, and
    ``round_trip`` says whether that gives the text back (not the normalised one)."""
    vocabulary, texts = Vocabulary.load(model_path), {}
    send = docs.sparkSession.sparkContext.broadcast
    sent, coder = send(vocabulary), send(Encoder(vocabulary))

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        ids, at = coder.value.encode(part.column(text))
        out = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), pa.array(np.diff(at))]
        if check:
            back = _once(Decoder, sent, texts).decode(ids, at)
            out.append(pa.array([(t or "") == b for t, b in zip(part.column(text).to_pylist(), back)], pa.bool_()))
        return out

    fields = [T.StructField("ids", _IDS), T.StructField("n_tokens", T.LongType())]
    return frames.append(docs, fields + [T.StructField("round_trip", T.BooleanType())] * check, compute, text)


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids decode to an empty text."""
    sent, cache = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path)), {}
    kept = [c for c in encoded.columns if c.lower() != name.lower()]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField(name, T.StringType())])
    encoded = encoded.select(*[encoded[f"`{c}`"] for c in kept])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                column = part.column(ids)
                size = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = _once(Decoder, sent, cache).decode(flat, np.concatenate([[0], np.cumsum(size)]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)
