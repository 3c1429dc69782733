"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks at both ends) and of itself, hashed to
BUCKETS rows of an embedding table; a text is the mean of its words and of PRIOR blank ones, so that
one word of a very short text doesn't decide alone. Embeddings and softmax
weights are trained together on labelled rows, at most `sample` of them, half of each label as far
as there are so many, taken by hash of their id; each row weighs as many labelled rows as it stands
for, so the share of toxic texts is that of all labels. Misspelt words share most of their n-grams with the words that were seen. Because all
is linear, scoring needs one number per n-gram: the trained model is a vector of BUCKETS floats.

Cases: null, empty and blank texts get the score of the intercept alone; without labelled rows, or
with one class only, every row gets the share of toxic rows (0 without any); repeated rows are
scored alike; of several texts with one labelled id the one whose words sort first is fitted; rows without an id are
scored, not held out and not fitted; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import column, ragged, slices

BUCKETS, DIMS, SCALE, PRIOR = 1 << 20, 2, 30.0, 8
#: At most so many labelled rows are fitted.
SAMPLE = 5000
GRAMS = range(3, 7)
CACHE = 300_000
#: Longer words (bytes) aren't remembered; in scripts without blanks a whole text is one word.
LONG = 256
#: ASCII letters in lower case, digits as they are, other ASCII as blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def grams(word: bytes) -> list[int]:
    w = "<" + word.decode("utf-8", "ignore") + ">"
    out = [zlib.crc32(w.encode()) % BUCKETS]
    for n in GRAMS:
        out += [zlib.crc32(w[i : i + n].encode()) % BUCKETS for i in range(len(w) - n + 1) if n < len(w)]
    return out


def bag(text: str | None) -> tuple[bytes, np.ndarray]:
    """A text's distinct words, joined by blanks, and the share of each among them and the blank ones."""
    own = words(text)
    counts: dict[bytes, int] = {}
    for w in own:
        counts[w] = counts.get(w, 0) + 1
    return b" ".join(counts), np.fromiter(counts.values(), np.float32, len(counts)) / np.float32(len(own) + PRIOR)


class _Sums:
    """Weighted sums of table rows: out[r] = sum of weight * table[col] over the cells of r; and the transpose."""

    def __init__(self, cols: np.ndarray, lens: np.ndarray, weights: np.ndarray, width: int):
        self.n, self.width, self.cols, self.weights = len(lens), width, cols, weights[:, None]
        self.full = np.flatnonzero(lens)
        self.starts = (np.cumsum(lens) - lens)[self.full]
        order = np.argsort(cols, kind="stable").astype(np.int32)
        self.rows, self.back = np.repeat(np.arange(len(lens), dtype=np.int32), lens)[order], weights[order][:, None]
        own = cols[order]
        self.firsts = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
        self.seen = own[self.firsts]

    def __call__(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, table.shape[1]), np.float32)
        if len(self.full):
            cells = table[self.cols]
            cells *= self.weights
            out[self.full] = np.add.reduceat(cells, self.starts)
        return out

    def transposed(self, grad: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, grad.shape[1]), np.float32)
        if len(self.seen):
            cells = grad[self.rows]
            cells *= self.back
            out[self.seen] = np.add.reduceat(cells, self.firsts)
        return out


class _Scores(dict):
    """What each word adds, on average over its n-grams."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        s = float(self.weights[grams(word)].mean())
        if len(word) <= LONG:
            self[word] = s
        return s


class ToxicityModel:
    """weights: what each n-gram adds to the difference of the two logits; bias: theirs without words."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, _Scores(weights)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        out = np.full(len(texts), self.bias)
        for i, t in enumerate(texts):
            own = words(t)
            if own:
                out[i] += np.fromiter(map(self.known.__getitem__, own), np.float64, len(own)).sum() / (len(own) + PRIOR)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))

    @classmethod
    def fit(cls, bags: list[tuple[bytes, np.ndarray]], labels: np.ndarray, weights: np.ndarray | None = None, rounds: int = 150, rate: float = 0.5, common: float = 0.005, seed: int = 7) -> ToxicityModel:
        """Embeddings and softmax weights by gradient descent with momentum on all rows at once.

        An n-gram's step is scaled by its share of the text, and n-grams in fewer than
        `common` of the rows stay zero: the rest can't be learnt by heart. weights: how much each row counts.
        """
        weights = np.ones(len(bags)) if weights is None else weights
        weights = (weights / max(weights.sum(), 1e-9)).astype(np.float32)
        share = float(labels.mean()) if len(bags) else 0.0
        if share in (0.0, 1.0):
            return cls(np.zeros(BUCKETS, np.float32), 50.0 if share else -50.0)
        share = float(weights @ labels)
        number: dict[bytes, int] = {}
        rows = [np.array([number.setdefault(w, len(number)) for w in joined.split()], np.int32) for joined, _ in bags]
        lens, flat = np.zeros(len(number), np.int32), array("i")
        for i, w in enumerate(number):
            own = grams(w)
            lens[i] = len(own)
            flat.extend(own)
        flat, ends = np.frombuffer(flat, np.int32), np.cumsum(lens, dtype=np.int64)
        number.clear()
        seen = np.zeros(BUCKETS, np.int32)
        for row in rows:
            if len(row):
                seen[np.unique(flat[ragged(ends[row] - lens[row], lens[row])])] += 1
        used = np.flatnonzero(seen >= max(2, common * len(rows)))
        if not len(used):
            return cls(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
        place = np.full(BUCKETS, -1, np.int32)
        place[used] = np.arange(len(used))
        flat = place[flat]
        owner = np.repeat(np.arange(len(lens), dtype=np.int32), lens)[flat >= 0]
        to_word = _Sums(flat[flat >= 0], np.bincount(owner, minlength=len(lens)), (1 / lens).astype(np.float32)[owner], len(used))
        del flat, owner, place, seen
        to_text = _Sums(np.concatenate(rows), np.array([len(r) for r in rows]), np.concatenate([v for _, v in bags]), len(lens))
        mass = to_word.transposed(to_text.transposed(weights[:, None]))
        step = 1 / (mass * SCALE**2 + 1e-6)
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.05, (len(used), DIMS)).astype(np.float32)
        soft = rng.normal(0, 1, (DIMS, 2)).astype(np.float32)
        bias = np.log(np.array([1 - share, share], np.float32))
        moves = [np.zeros_like(table), np.zeros_like(soft), np.zeros_like(bias)]
        for _ in range(rounds):
            mean = to_text(to_word(table)) * SCALE
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels] -= 1
            p *= weights[:, None]
            grads = [to_word.transposed(to_text.transposed((p @ soft.T * SCALE).astype(np.float32))) * step, mean.T @ p, p.sum(0)]
            for value, move, grad, speed in zip((table, soft, bias), moves, grads, (rate, 0.05, 0.05)):
                move *= 0.9
                move += grad
                value -= speed * move
        learnt = np.zeros(BUCKETS, np.float32)
        learnt[used] = table @ (soft[:, 1] - soft[:, 0]) * SCALE
        return cls(learnt, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """A model from at most `sample` labelled rows that aren't held out, half of each label if there are enough.

    docs: id, text. labels: doc_id, toxic. Only the sample's distinct words go to the driver.
    """
    picked = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    picked = picked.select(F.col("doc_id").cast("bigint").alias("id"), (F.col("toxic") > 0).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    shares = {1: min(toxic, max(sample // 2, sample - clean))}
    shares[0] = min(clean, sample - shares[1])
    halves = [picked.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in shares.items()]
    picked = halves[0].union(halves[1])
    rows = docs.join(F.broadcast(picked), "id")

    def run(batches):
        for batch in slices(batches, "text"):
            got = [bag(t) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "label"), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())], ["id", "label", "words", "shares"])

    # one row for each label, however often an id repeats; in one order, whatever the partitions were
    bags = rows.select("id", "label", "text").mapInArrow(run, "id bigint, label int, words binary, shares binary").groupBy("id", "label").agg(F.min(F.struct("words", "shares")).alias("bag")).select("id", "label", "bag.*")
    got = sorted(((r["id"], r["label"], bytes(r["words"]), np.frombuffer(r["shares"], np.float32)) for r in bags.toLocalIterator()), key=lambda r: r[:2])
    labels = np.array([r[1] for r in got], np.int64)
    got = [r[2:] for r in got]
    return ToxicityModel.fit(got, labels, np.array([sizes[k] / shares[k] for k in labels.tolist()]))


def scored(docs: DataFrame, model: ToxicityModel, columns: list[str], name: str = "score") -> DataFrame:
    """The columns of docs (among them text) with the score as a column of that name; one of docs that has it already is replaced."""
    weights, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias  # of fixed size
    keep = [c for c in columns if c != name]

    def run(batches):
        use = ToxicityModel(weights.value, bias)
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(use.score(column(batch, "text").to_pylist()), pa.float64())], [*keep, name])

    frame = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = frame.select(*keep).schema.add(name, "double")
    return frame.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    model = train(own, labels, sample)
    out = scored(own, model, ["id"])
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
