"""8. Quality classifier: attention-based multiple-instance learning over a document's passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of a passage.
PASSAGE = 48
#: Hash buckets of words and of word shapes, and the widths of their learned vectors.
WORDS, SHAPES = 1 << 15, 1 << 11
WORD_DIM, SHAPE_DIM, EXTRA = 16, 8, 3
HIDDEN, GATE = 24, 12
#: Labelled documents that the model is fitted on at most, the first by a hash of the id. A bound on fitting alone.
MAX_TRAIN = 4000
EPOCHS = 8
BATCH = 24
SEED = 7
#: Heads: quality (the higher the better) and toxic.
HEADS = ("quality", "toxic")
CUT = 0.5
_MARKS = regex.compile(r"[^\p{L}\p{N}]")
_RUNS = regex.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Upper-case letters as A, other letters as a, digits as 9, marks as they are; runs cut to one."""
    word = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1", word)


class Passages:
    """A batch of texts as passages: word codes into small tables of buckets, passage bounds, passages of each text."""

    def __init__(self, text: pa.Array, size: int = PASSAGE) -> None:
        w = common.Words(text, lower=False)
        vocab = w.vocab
        self.word = np.fromiter((xxhash.xxh3_64_intdigest(_MARKS.sub("", v.lower()) or v) % WORDS for v in vocab), np.int64, len(vocab))
        self.shape = np.fromiter((xxhash.xxh3_64_intdigest(shape(v)) % SHAPES for v in vocab), np.int64, len(vocab))
        self.codes = w.codes
        counts = -(-w.lens // size)
        self.docs = np.concatenate([[0], np.cumsum(counts)])
        starts = np.repeat(w.starts, counts) + common.ragged(np.zeros(len(counts), np.int64), counts) * size
        self.starts = starts
        self.lens = np.minimum(starts + size, np.repeat(w.bounds[1:], counts)) - starts
        self.extra = self._extra(vocab)

    def _extra(self, vocab: list[str]) -> np.ndarray:
        """Share of distinct words, of repeats of the word before, and mean word length of each passage."""
        n = len(self.starts)
        out = np.zeros((n, EXTRA), np.float32)
        if n:
            owner = np.repeat(np.arange(n), self.lens)
            key = np.sort(owner << 32 | self.codes)
            new = np.r_[True, key[1:] != key[:-1]]
            out[:, 0] = np.bincount(key[new] >> 32, minlength=n) / self.lens
            same = np.r_[False, (self.codes[1:] == self.codes[:-1]) & (owner[1:] == owner[:-1])]
            out[:, 1] = np.bincount(owner, weights=same, minlength=n) / self.lens
            length = np.fromiter(map(len, vocab), np.float64, len(vocab))
            out[:, 2] = np.bincount(owner, weights=length[self.codes], minlength=n) / self.lens / 10
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Encoder, gated attention and one output for each head; ``trained`` is False without labels."""

    p: dict[str, np.ndarray]
    trained: bool = True

    @staticmethod
    def new(seed: int = SEED) -> Model:
        rng = np.random.default_rng(seed)
        wide = WORD_DIM + SHAPE_DIM + EXTRA

        def g(*s: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)

        return Model(
            {
                "word": rng.normal(0, 0.1, (WORDS, WORD_DIM)).astype(np.float32),
                "shape": rng.normal(0, 0.1, (SHAPES, SHAPE_DIM)).astype(np.float32),
                "W": g(wide, HIDDEN),
                "b": np.zeros(HIDDEN, np.float32),
                "V": g(HIDDEN, GATE),
                "U": g(HIDDEN, GATE),
                "w": g(GATE, len(HEADS)),
                "C": g(HIDDEN, len(HEADS)),
                "c": np.zeros(len(HEADS), np.float32),
            }
        )

    def encode(self, x: Passages) -> np.ndarray:
        """Word and shape vectors of each passage, summed over the root of its length, and its extra numbers."""
        table = np.concatenate([self.p["word"][x.word], self.p["shape"][x.shape]], axis=1)
        total = np.add.reduceat(table[x.codes], x.starts, axis=0) if len(x.starts) else np.zeros((0, table.shape[1]), np.float32)
        return np.concatenate([total / np.sqrt(x.lens)[:, None].astype(np.float32), x.extra], axis=1)

    def forward(self, h0: np.ndarray, docs: np.ndarray) -> tuple:
        """(hidden, gates, attention by head, document vectors by head, logits); no document without passages."""
        p = self.p
        h = np.tanh(h0 @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        score = (t * s) @ p["w"]
        starts, counts = docs[:-1], np.diff(docs)
        top = np.maximum.reduceat(score, starts, axis=0)
        e = np.exp(score - np.repeat(top, counts, axis=0))
        a = e / np.repeat(np.add.reduceat(e, starts, axis=0), counts, axis=0)
        z = np.stack([np.add.reduceat(a[:, [k]] * h, starts, axis=0) for k in range(len(HEADS))], axis=1)
        return h, t, s, a, z, np.einsum("dkh,hk->dk", z, p["C"]) + p["c"]

    def predict(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities by head, and which texts have words."""
        x = Passages(text)
        real = np.flatnonzero(np.diff(x.docs))
        out = np.zeros((len(text), len(HEADS)))
        if len(real):
            docs = np.concatenate([x.docs[real], x.docs[-1:]])
            out[real] = _sigmoid(self.forward(self.encode(x), docs)[-1])
        return out, np.diff(x.docs) > 0


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.08) -> Model:
    """Fit by stochastic gradients (Adagrad); ``labels`` has a column for each head, NaN where it is unknown."""
    model, rng = Model.new(seed), np.random.default_rng(seed)
    p = model.p
    grown = {k: np.full_like(v, 1e-3) for k, v in p.items()}
    bags = [Passages(pa.array(texts[i : i + 1], pa.string())) for i in range(len(texts))]
    usable = [i for i, x in enumerate(bags) if len(x.starts)]

    def update(name: str, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        if rows is None:
            grown[name] += g * g
            p[name] -= rate * g / np.sqrt(grown[name])
        else:
            at, inverse = np.unique(rows, return_inverse=True)
            total = np.zeros((len(at), g.shape[1]), np.float32)
            np.add.at(total, inverse, g)
            grown[name][at] += total * total
            p[name][at] -= rate * total / np.sqrt(grown[name][at])

    for _ in range(epochs):
        order = rng.permutation(usable)
        for k in range(0, len(order), BATCH):
            mine = [bags[i] for i in order[k : k + BATCH]]
            y = labels[order[k : k + BATCH]]
            word = np.concatenate([x.word[x.codes] for x in mine])
            form = np.concatenate([x.shape[x.codes] for x in mine])
            lens = np.concatenate([x.lens for x in mine])
            docs = np.concatenate([[0], np.cumsum([len(x.starts) for x in mine])])
            starts = np.cumsum(lens) - lens
            vectors = np.concatenate([p["word"][word], p["shape"][form]], axis=1)
            h0 = np.concatenate([np.add.reduceat(vectors, starts, axis=0) / np.sqrt(lens)[:, None], np.concatenate([x.extra for x in mine])], axis=1).astype(np.float32)
            h, t, s, a, z, logit = model.forward(h0, docs)
            known = ~np.isnan(y)
            d = np.where(known, _sigmoid(logit) - np.where(known, y, 0), 0).astype(np.float32) / len(mine)
            counts = np.diff(docs)
            gC = np.einsum("dkh,dk->hk", z, d)
            dz = d[:, :, None] * p["C"].T[None]  # document, head, hidden
            dzp = np.repeat(dz, counts, axis=0)
            dh = np.einsum("pk,pkh->ph", a, dzp)
            da = np.einsum("ph,pkh->pk", h, dzp)
            mean = np.repeat(np.add.reduceat(a * da, docs[:-1], axis=0), counts, axis=0)
            ds = a * (da - mean)
            gw = (t * s).T @ ds
            dg = ds @ p["w"].T
            dt, dsg = dg * s * (1 - t * t), dg * t * s * (1 - s)
            gV, gU = h.T @ dt, h.T @ dsg
            dh += dt @ p["V"].T + dsg @ p["U"].T
            dpre = dh * (1 - h * h)
            gW, gb = h0.T @ dpre, dpre.sum(axis=0)
            dh0 = dpre @ p["W"].T
            each = np.repeat(dh0[:, : WORD_DIM + SHAPE_DIM] / np.sqrt(lens)[:, None], lens, axis=0).astype(np.float32)
            for name, g in (("C", gC), ("c", d.sum(axis=0)), ("w", gw), ("V", gV), ("U", gU), ("W", gW), ("b", gb)):
                update(name, g.astype(np.float32))
            update("word", each[:, :WORD_DIM], word)
            update("shape", each[:, WORD_DIM:], form)
    return model


def label_rows(labels: DataFrame) -> DataFrame:
    """``doc_id, quality, toxic`` once for each id; where rows of an id disagree the larger value holds."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").cast("double").alias("quality"), F.max("toxic").cast("double").alias("toxic")).where("quality IS NOT NULL OR toxic IS NOT NULL")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, epochs: int = EPOCHS) -> Model:
    """A model fitted on at most ``max_train`` labelled documents, the first by the MD5 of their id."""
    chosen = label_rows(labels).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_train)
    rows = common.project(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"]).toArrow()
    key = [xxhash.xxh3_64_intdigest(f"{d} {t}") for d, t in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist())]
    order = np.argsort(np.asarray(key, np.uint64), kind="stable")
    texts = [rows.column("text")[int(i)].as_py() for i in order]
    y = np.stack([np.asarray(rows.column(h).to_pylist(), np.float64)[order] for h in HEADS], axis=1) if texts else np.zeros((0, 2))
    if not any(t.strip() for t in texts):
        return Model(Model.new().p, trained=False)
    return train(texts, y, epochs)


def classify(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """``doc_id, quality, toxic, keep`` for every document by a fitted model.

    Every passage of every text is encoded and weighted; ``keep`` is quality >= cut and toxic < cut.
    A null, empty or blank text has null scores and is not kept. A model without training labels gives null
    scores and keeps every text with words. A null doc_id is kept; repeated rows are scored alike. An empty table gives
    no rows. Every passage of a very long text counts; it costs its own size in memory. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches):
            prob, real = shared.value.predict(part.column("text"))
            known = real & shared.value.trained
            keep = np.where(known, (prob[:, 0] >= cut) & (prob[:, 1] < cut), real & ~np.bool_(shared.value.trained))
            yield pa.record_batch([part.column("doc_id"), *(pa.array(np.round(prob[:, k], 6), pa.float64(), mask=~known) for k in range(2)), pa.array(keep.astype(bool))], names=["doc_id", "quality", "toxic", "keep"])

    return common.mapped(common.project(docs), run, "doc_id bigint, quality double, toxic double, keep boolean")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, common.table(spark, sf_dir, "labels")))
