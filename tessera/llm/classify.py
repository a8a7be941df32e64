"""Document classifiers: FTRL logistic regression over hashed n-grams.

Two feature sets share one learner:

* ``toxicity``: n-grams of lower-cased alphanumeric words (1, 2 words), skip-grams
  (a word and the one after next) and 1-grams of word stems (leading 3 to 6
  bytes, so an inflected insult counts with its base form);
* ``quality``: n-grams of the words as they stand (1, 2 words) and of their shapes
  (1 to 3 words). A shape is the word's run-collapsed sequence of character
  classes, e.g. ``Xx.`` or ``x%``; a word that repeats the word before it has a
  shape of its own.

The learner is fitted on a sample of at most about ``max_train_rows`` labelled
documents, chosen by a hash of the document id; scoring covers every whole text. A long text
is read in blocks of 1 MB that overlap by a feature's words, so a task holds the text and a
block's features only (about 100 MB), however long it is.

Defined results: a null or empty text has no features, so its score is the
logistic of the bias; repeated rows get equal scores; labels given twice for one
id count once, with the larger label; null labels are ignored; with no labelled
row every score is 0.5; columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import frames, ftrl
from tessera.llm import textbatch as tb

_SHAPES = np.arange(256, dtype=np.uint8)
_SHAPES[97:123] = 1
_SHAPES[128:] = 1
_SHAPES[65:91] = 2
_SHAPES[48:58] = 3
_REPEATED = np.uint64(0x5EED)

#: Of a column of texts, the first of its words whose grams count; gives hashes and documents.
Features = Callable[[pa.Array, int], tuple[np.ndarray, np.ndarray]]
#: How many words a feature spans at most.
SPAN = 3


def toxicity_features(column, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    w = tb.words(column, tb.ALNUM, lower=True)
    h = w.hashes()
    parts = [tb.grams(w, h, (0,), 1, skip), tb.grams(w, h, (0, 1), 2, skip), tb.grams(w, h, (0, 2), 3, skip)]
    for k in (3, 4, 5, 6):
        parts.append(tb.grams(w, tb.span_hashes(w.buf, w.starts, np.minimum(w.ends, w.starts + k)), (0,), 10 + k, skip))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _shape_hashes(w: tb.Words) -> np.ndarray:
    classes = _SHAPES[w.buf]
    change = np.ones(len(classes), bool)
    change[1:] = classes[1:] != classes[:-1]
    change[w.starts] = True
    change &= tb.SPACED[w.buf]
    at = np.flatnonzero(change)
    return tb.span_hashes(classes[at], np.searchsorted(at, w.starts), np.searchsorted(at, w.ends))


def quality_features(column, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    w = tb.words(column)
    h = w.hashes()
    shape = _shape_hashes(w)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    shape[same] = _REPEATED
    parts = [tb.grams(w, h, (0,), 1, skip), tb.grams(w, h, (0, 1), 2, skip)]
    parts += [tb.grams(w, shape, o, s, skip) for o, s in (((0,), 4), ((0, 1), 5), ((0, 1, 2), 6))]
    return tuple(np.concatenate(x) for x in zip(*parts))


@dataclass(frozen=True)
class Task:
    features: Features
    table: np.ndarray  # which bytes are words'
    learner: ftrl.Ftrl
    max_train_rows: int = 14_000
    threshold: float = 0.7

    def distinct(self, column, wanted: np.ndarray | None = None) -> np.ndarray:
        """Sorted keys of the distinct features of each text: its row above ``bits``, the
        feature below. A long text is read in blocks. ``wanted``: which features count."""
        bits = np.uint64(self.learner.bits)
        mask = np.uint64((1 << self.learner.bits) - 1)
        keys = np.zeros(0, np.uint64)
        for block, skip in tb.blocks(column, self.table, SPAN):
            f, d = self.features(block, skip)
            f = f & mask
            if wanted is not None:
                some = np.flatnonzero(wanted[f.view(np.int64)])
                f, d = f[some], d[some]
            own = np.unique((d.astype(np.uint64) << bits) | f)
            keys = np.union1d(keys, own) if len(keys) else own
        return keys


TOXICITY = Task(toxicity_features, tb.ALNUM, ftrl.Ftrl(alpha=0.5, l1=3.0, positive_weight=3.0, epochs=4))
QUALITY = Task(quality_features, tb.SPACED, ftrl.Ftrl(alpha=0.3, l1=1.0, epochs=3))


@dataclass(frozen=True)
class Model:
    task: Task
    index: np.ndarray = field(repr=False)
    weight: np.ndarray = field(repr=False)
    bias: float = 0.0

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.task.learner.bits)
        out[self.index] = self.weight
        return out


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str, task: Task, keep=None, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits ``task`` on labelled documents; ``keep`` selects the labels to learn from."""
    own = labels.filter(keep) if keep is not None else labels
    own = own.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("double").alias("_y"))
    own = own.withColumn("_order", F.xxhash64(F.lit("fold"), F.col("_id")))
    total = own.count()
    if total > task.max_train_rows:
        share = int(task.max_train_rows / total * (1 << 32))
        own = own.filter(F.shiftrightunsigned("_order", 32) < share)
    # The sample has about max_train_rows ids whatever the size of the table.
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(own), "_id")
    bits = task.learner.bits
    mask = np.uint64((1 << bits) - 1)

    def encode(batches):
        for batch in batches:
            for part in tb.slices(batch):
                key = task.distinct(part.column("text"))
                f = (key & mask).astype(np.uint32)
                at = np.searchsorted(key >> np.uint64(bits), np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("_order"), part.column("_id"), part.column("_y"), pa.array([f[at[i] : at[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary())], names=["o", "id", "y", "f"])

    learner = task.learner

    def learn(frames_):
        seen, ys = [], []
        for pdf in frames_:
            seen += [np.frombuffer(x, np.uint32) for x in pdf.f]
            ys += list(pdf.y)
        w, bias = ftrl.fit(seen, np.array(ys), learner)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"i": np.append(at, -1), "w": np.append(w[at], bias)})

    id_type = docs.schema[doc_id].dataType.simpleString()
    samples = rows.select("_order", "_id", "_y", "text").mapInArrow(encode, f"o long, id {id_type}, y double, f binary")
    got = samples.repartition(1).sortWithinPartitions("o", "id", "f").mapInPandas(learn, "i long, w double").toPandas()
    mine = got.i >= 0
    bias = got.w[~mine]
    return Model(task, got.i[mine].to_numpy(), got.w[mine].to_numpy(), float(bias.iloc[0]) if len(bias) else 0.0)


def score(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``score`` (double) and ``predicted`` (int), or by other names."""
    sent = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias))
    task, cache = model.task, {}
    mask = np.uint64((1 << task.learner.bits) - 1)

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        if not cache:
            i, w, b = sent.value
            dense = np.zeros(int(mask) + 1)
            dense[i] = w
            cache["w"], cache["b"], cache["some"] = dense, b, dense != 0
        keys = task.distinct(part.column(text), cache["some"])
        s = ftrl.scores(cache["w"], cache["b"], (keys & mask).astype(np.int64), (keys >> np.uint64(task.learner.bits)).astype(np.int64), part.num_rows)
        return [pa.array(s), pa.array((s >= task.threshold).astype(np.int32))]

    return frames.append(docs, [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())], compute, text)
