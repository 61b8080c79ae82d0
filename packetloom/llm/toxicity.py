"""Toxicity: a convolutional text classifier over hashed word embeddings."""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import stored
from packetloom.llm.decontam import words_of

BUCKETS, DIM, FILTERS, WIDTHS, PADS = 1 << 20, 16, 16, (1, 2, 3), 3
LEAST_TEXTS = 3  # a hashed row is learnt if so many of the texts learnt from hold it, and zero otherwise
GROUP_WORDS = 60_000
SHARD_ROWS = 16_000  # rows that one task learns from, about
BLOCK_ROWS, BLOCK_BYTES = 2000, 8 << 20  # of the texts that a task holds at a time
STEPS = 24_000  # rows that the first shard is to be taken through, repeats included
FIXED = 1 << 24  # moves of parameters are summed as whole numbers, so the order of tasks does not matter
BINS = 256  # of a unit of the logits that calibrate


class WordTable:
    """Numbers of words, and for each number a row that ``made`` gives for the word's hashes.

    A word is hashed as a whole and by its first three and four bytes.  Number 0 is the
    padding between texts.  The table is emptied at ``most`` words, so that a worker's
    memory does not grow with the corpus.
    """

    def __init__(self, made, most: int = 200_000):
        self.made, self.most = made, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.rows = self.made(np.full((1, 3), -1))

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all texts, each followed by the padding; where each text begins)."""
        if len(self.number) > self.most:
            self.clear()
        new = sorted(set().union(*texts) - self.number.keys())
        if new:
            hashes = np.array([[crc32(w), crc32(b"3" + w[:3]), crc32(b"4" + w[:4])] for w in new]) % BUCKETS
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, self.made(hashes)])
        sizes = np.array([len(t) + PADS for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        numbers = np.zeros(int(sizes.sum()), np.int32)
        for t, s in zip(texts, starts, strict=True):
            numbers[s:s + len(t)] = np.fromiter(map(self.number.__getitem__, t), np.int32, len(t))
        return numbers, starts


class ToxicityCnn:
    """Filters of several widths over word embeddings, the best place of each in the text, and a logistic output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.seed = seed
        self.place = np.zeros(BUCKETS, np.int32)  # row of ``embed`` of each hash; row 0 is zero, for padding and what was not learnt
        self.embed = np.zeros((1, DIM), np.float32)
        self.filters = [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(0)
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str, float] = {}

    def _responses(self, vectors: np.ndarray, k: int) -> np.ndarray:
        """Response of the filters of one width at every row."""
        w, n = WIDTHS[k], len(vectors)
        total = vectors @ self.filters[k][:DIM]
        for j in range(1, w):
            total[:n - j] += vectors[j:] @ self.filters[k][j * DIM:(j + 1) * DIM]
        return total

    def _pooled(self, vectors: np.ndarray, starts: np.ndarray) -> np.ndarray:
        ends = np.append(starts[1:], len(vectors))
        cut = np.concatenate([ends - 1, ends - 2])  # windows from here reach into the next text
        out = []
        for k in range(len(WIDTHS)):
            r = self._responses(vectors, k)
            r[cut] = -np.inf
            out.append(np.maximum.reduceat(r, starts))
        return np.concatenate(out, axis=1)

    def table(self) -> WordTable:
        return WordTable(lambda hashes: self.embed[np.where(hashes < 0, 0, self.place[hashes])].sum(axis=1))

    def logits(self, texts: list[list[bytes]], table: WordTable) -> np.ndarray:
        if not texts:
            return np.zeros(0, np.float32)
        numbers, starts = table.of(texts)
        pooled = self._pooled(table.rows[numbers], starts)
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias

    def score(self, texts: list[list[bytes]], table: WordTable) -> np.ndarray:
        z = np.clip(self.scale * self.logits(texts, table) + self.shift, -30, 30)
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def learn(self, buckets: np.ndarray) -> None:
        """Small random rows for these hashes; all others are zero."""
        self.place[buckets] = np.arange(1, len(buckets) + 1)
        self.embed = np.random.default_rng(self.seed).normal(0, 0.01, (len(buckets) + 1, DIM)).astype(np.float32)
        self.embed[0] = 0

    def dense(self) -> np.ndarray:
        """All parameters but ``embed``, as rows of ``DIM``."""
        flat = np.concatenate([*[f.ravel() for f in self.filters], self.bias, self.out, [self.out_bias]])
        return np.concatenate([flat, np.zeros(-len(flat) % DIM)]).astype(np.float32).reshape(-1, DIM)

    def set_dense(self, rows: np.ndarray) -> None:
        flat, at = rows.ravel(), 0
        for k, f in enumerate(self.filters):
            self.filters[k] = flat[at:at + f.size].reshape(f.shape)
            at += f.size
        n = len(self.bias)
        self.bias, self.out, self.out_bias = flat[at:at + n], flat[at + n:at + 2 * n], np.float32(flat[at + 2 * n])

    def _best(self, vectors: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each text, and its row."""
        pooled, places = [], []
        ends = np.append(starts[1:], len(vectors))
        responses = np.concatenate([self._responses(vectors, k) for k in range(len(WIDTHS))], axis=1)
        for s, e in zip(starts, ends, strict=True):
            part = responses[s:e - 2]
            best = part.argmax(axis=0)
            pooled.append(part[best, np.arange(part.shape[1])])
            places.append(best + s)
        return np.array(pooled), np.array(places)

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, n: np.ndarray, prior: float, languages: list[str | None]) -> None:
        """Logistic scaling on rows not trained on, moved to the share ``prior`` of toxic rows, and a threshold a language.

        Each logit stands for ``n`` rows.  A language's threshold is the score that parts its
        calibration rows best; languages with fewer than ten toxic rows take 0.7.  The score
        itself never sees the language.
        """
        part = n / n.sum()
        share = min(max(float(part @ labels), 1e-3), 1 - 1e-3)
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        a, b = 1.0, 0.0
        for _ in range(2000):
            p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
            a -= 0.2 * float(part @ ((p - labels) * logits) + 0.01 * (a - 1))
            b -= 0.2 * float(part @ (p - labels))
        self.scale, self.shift = max(a, 0.1), b + float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
        scores = 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))
        for name in sorted({x for x in languages if x}):
            own = np.array([x == name for x in languages])
            s, y = scores[own], labels[own]
            if n[own] @ y < 10:
                continue
            weight = n[own] * np.where(y == 1, prior / share, (1 - prior) / (1 - share))
            cuts = np.linspace(0.3, 0.9, 25)
            cost = [float((weight * ((s >= c) != (y == 1))).sum()) for c in cuts]
            good = [c for c, x in zip(cuts, cost, strict=True) if x <= min(cost) + 1e-9]
            self.thresholds[name] = float(min(good, key=lambda c: abs(c - 0.7)))


class Learner:
    """Adagrad on the logistic loss, from a model on; gradients reach the best place of each filter only."""

    def __init__(self, model: ToxicityCnn, weights: tuple[float, float], first: float, batch: int = 32, rate: float = 0.05):
        self.start, self.model = model, copy.copy(model)
        self.model.embed, self.model.filters = model.embed.copy(), [f.copy() for f in model.filters]
        self.model.bias, self.model.out = model.bias.copy(), model.out.copy()
        self.weights, self.batch, self.rate = weights, batch, rate
        self.rng = np.random.default_rng(model.seed)
        m = self.model
        self.g_embed, self.g_filters = np.full_like(m.embed, first), [np.full_like(f, first) for f in m.filters]
        self.g_bias, self.g_out, self.g_ob = np.full_like(m.bias, first), np.full_like(m.out, first), first
        self.moved, self.steps = np.zeros(len(m.embed), np.int64), 0
        self.table = WordTable(lambda hashes: np.where(hashes < 0, 0, m.place[hashes]))

    def block(self, texts: list[list[bytes]], labels: np.ndarray, epochs: int) -> None:
        numbers, starts = self.table.of(texts)
        ids, ends = self.table.rows[numbers], np.append(starts[1:], len(numbers))
        for _ in range(epochs):
            order = self.rng.permutation(len(texts))
            for at in range(0, len(order), self.batch):
                some = order[at:at + self.batch]
                sizes = ends[some] - starts[some]
                self._step(np.concatenate([ids[starts[i]:ends[i]] for i in some]), np.cumsum(sizes) - sizes, labels[some])

    def _step(self, ids: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> None:
        m, rate = self.model, self.rate
        vectors = m.embed[ids].sum(axis=1)
        pooled, places = m._best(vectors, starts)
        hidden = np.maximum(pooled + m.bias, 0)
        z = hidden @ m.out + m.out_bias
        err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * np.where(labels == 1, self.weights[1], self.weights[0]) / len(labels)).astype(np.float32)
        d_hidden = err[:, None] * m.out * (hidden > 0)
        grads, touched, deltas = [], [], []
        for k, w in enumerate(WIDTHS):
            d = d_hidden[:, k * FILTERS:(k + 1) * FILTERS]
            where = places[:, k * FILTERS:(k + 1) * FILTERS]
            grad = np.zeros_like(m.filters[k])
            for j in range(w):
                part = slice(j * DIM, (j + 1) * DIM)
                spot = where + j
                grad[part] = np.einsum("bf,bfd->df", d, vectors[spot])
                touched.append(ids[spot].reshape(-1, 3))
                deltas.append((d[:, :, None] * m.filters[k][part].T[None]).reshape(-1, DIM))
            grads.append(grad)
        spots, flow = np.concatenate(touched), np.concatenate(deltas)
        used, at = np.unique(spots, return_inverse=True)
        d_embed = np.zeros((len(used), DIM), np.float32)
        for c in range(3):
            np.add.at(d_embed, at.reshape(spots.shape)[:, c], flow)
        if used[0] == 0:
            d_embed[0] = 0
        self.g_embed[used] += d_embed ** 2
        m.embed[used] -= rate * d_embed / np.sqrt(self.g_embed[used])
        self.moved[used] += 1
        self.steps += 1
        for k in range(len(WIDTHS)):
            self.g_filters[k] += grads[k] ** 2
            m.filters[k] -= rate * grads[k] / np.sqrt(self.g_filters[k])
        d_bias = d_hidden.sum(0)
        self.g_bias += d_bias ** 2
        m.bias -= rate * d_bias / np.sqrt(self.g_bias)
        d_out = err @ hidden
        self.g_out += d_out ** 2
        m.out -= rate * d_out / np.sqrt(self.g_out)
        d_ob = float(err.sum())
        self.g_ob += d_ob ** 2
        m.out_bias -= np.float32(rate * d_ob / np.sqrt(self.g_ob))

    def moves(self, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        """(at, n, v0 ...): how far each row of parameters moved, times the steps ``n`` that moved it; negative places are ``dense``."""
        used = np.flatnonzero(self.moved)
        used = used[used > 0]
        dense = self.model.dense() - self.start.dense()
        for i in range(0, len(used), rows):
            at = used[i:i + rows]
            yield self._moved(at, self.moved[at], self.model.embed[at] - self.start.embed[at])
        if self.steps:
            yield self._moved(-1 - np.arange(len(dense)), np.full(len(dense), self.steps), dense)

    @staticmethod
    def _moved(at: np.ndarray, n: np.ndarray, by: np.ndarray) -> pa.RecordBatch:
        whole = np.rint(by.astype(np.float64) * FIXED).astype(np.int64) * n[:, None]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in whole.T]], schema=MOVES)


MOVES = pa.schema([("at", pa.int64()), ("n", pa.int64()), *[(f"v{i}", pa.int64()) for i in range(DIM)]])
MOVES_DDL = ", ".join(f"{name} long" for name in MOVES.names)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list[bytes]], np.ndarray]]:
    """(words of texts, labels) of a bounded number of rows of (t, label, ...) at a time."""
    texts, labels, held = [], [], 0
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            text = text.as_py()
            texts.append(words_of(text))
            labels.append(label)
            held += len(text or b"")
            if len(texts) >= BLOCK_ROWS or held >= BLOCK_BYTES:
                yield texts, np.array(labels, np.float32)
                texts, labels, held = [], [], 0
    if texts:
        yield texts, np.array(labels, np.float32)


def _learnt(rows: DataFrame) -> np.ndarray:
    """The hashes that ``LEAST_TEXTS`` of the texts hold; counted a block first, at most one row a hash comes back."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table = np.zeros(BUCKETS, np.int64), WordTable(lambda hashes: hashes)
        for texts, _ in _blocks(batches):
            numbers, starts = table.of(texts)
            for own in np.split(numbers, starts[1:]):
                found = np.unique(table.rows[np.unique(own)])
                held[found[found >= 0]] += 1
        at = np.flatnonzero(held)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 100_000]), pa.array(held[at[i:i + 100_000]])], schema=schema)

    found = rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS).select("bucket").toArrow()
    return np.sort(found.column("bucket").to_numpy())


def _move(model: ToxicityCnn, rows: DataFrame, weights: tuple[float, float], epochs: int, first: float) -> None:
    """Moves ``model`` by what the tasks of ``rows`` learn from it on: the mean of their moves, by the steps that made them.

    What comes back is one row a row of parameters, summed before, however many tasks there are.
    """
    holder = rows.sparkSession.sparkContext.broadcast(model)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(holder.value, weights, first)
        for texts, labels in _blocks(batches):
            learner.block(texts, labels, epochs)
        yield from learner.moves()

    means = [(F.sum(f"v{i}") / F.sum("n") / FIXED).cast("float").alias(f"v{i}") for i in range(DIM)]
    found = rows.mapInArrow(fit, MOVES_DDL).groupBy("at").agg(*means).toArrow()
    at = found.column("at").to_numpy()
    by = np.stack([found.column(f"v{i}").to_numpy() for i in range(DIM)], axis=1) if len(at) else np.zeros((0, DIM), np.float32)
    dense = model.dense()
    dense[-1 - at[at < 0]] += by[at < 0]
    model.set_dense(dense)
    model.embed[at[at > 0]] += by[at > 0]
    holder.unpersist()


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", label: str = "toxic",
          shard_rows: int = SHARD_ROWS, seed: int = 7) -> ToxicityCnn:
    """A classifier fitted on the whole texts of all labelled rows.

    Held-out rows, null keys and null labels are left out, a key with several labels takes
    the largest.  A fifth of the rows, by a hash of the key, calibrates the scores and
    thresholds and is not learnt from.  Without labelled rows of both kinds the classifier
    gives the share of toxic ones, or 0 without any rows.

    1. Hashed words and word beginnings are counted over all texts learnt from.
    2. The rows are dealt to shards of about ``shard_rows`` by a hash.  One shard is taken
       through several times by one task.  From the model found, all other shards go on in
       parallel, and the model moves by the mean of their moves.  A task holds a block of
       texts at a time; the driver gets parameters, no texts.  Up to ``shard_rows`` rows
       are one shard.
    3. The logits of all calibration rows are counted in narrow bins, by label and language.

    Rows of the two kinds weigh the same in all (a row no more than ten times its own).
    """
    usable = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).where(F.col("_key").isNotNull() & F.col("_label").isNotNull() & ~held_out(F.col("_key")))
    usable = usable.groupBy("_key").agg((F.max("_label") == 1).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    model = ToxicityCnn(seed)
    texts = docs.where(F.col(key).isNotNull() & ~held_out(F.col(key))).select(
        F.col(text).cast("binary").alias("t"), (F.col(language) if language in docs.columns else F.lit(None)).cast("string").alias("lang"), F.col(key).alias("_doc"))
    # a broadcast would grow with the labels
    named = texts.join(usable.hint("merge"), F.col("_doc") == F.col("_key")).select(
        "t", "label", "lang", F.xxhash64("_key", "t").alias("order"), (F.crc32(F.concat(F.lit("c"), F.col("_key").cast("string")).cast("binary")) % 5 == 0).alias("apart"))
    rows = stored(named, "labelled-texts")
    sizes = {(r["label"], r["apart"]): r["n"] for r in rows.groupBy("label", "apart").agg(F.count("*").alias("n")).collect()}
    n = [sizes.get((y, False), 0) + sizes.get((y, True), 0) for y in (0, 1)]
    if not all(n):
        model.out[:] = 0
        model.shift = float(np.log(max(prior, 1e-12) / max(1 - prior, 1e-12)))
        return model
    parted = len(sizes) == 4
    if parted:
        n = [sizes[y, False] for y in (0, 1)]
    learnt, tuned = (rows.where("NOT apart"), rows.where("apart")) if parted else (rows, rows)
    weights = tuple(min(10.0, sum(n) / (2 * x)) for x in n)
    model.learn(_learnt(learnt))
    shards = max(1, round(sum(n) / shard_rows))
    of_first = F.pmod("order", F.lit(shards)) == 0

    def dealt(part: DataFrame, tasks: int) -> DataFrame:
        return part.repartition(tasks, "order").sortWithinPartitions("order", "label", "t").select("t", "label")

    _move(model, dealt(learnt.where(of_first), 1), weights, max(2, min(6, STEPS * shards // sum(n))), 1e-3)
    if shards > 1:
        _move(model, dealt(learnt.where(~of_first), shards - 1), weights, 1, 0.05)
    holder = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("lang", pa.string()), ("label", pa.int32()), ("bin", pa.int64())])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = holder.value.table()
        for batch in batches:
            logits = [holder.value.logits(group, words) for group in _groups(batch.column(0))]
            bins = np.rint(np.clip(np.concatenate(logits), -100, 100).astype(np.float64) * BINS) if logits else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(bins.astype(np.int64))], schema=schema)

    found = tuned.select("t", "label", "lang").mapInArrow(binned, "lang string, label int, bin long").groupBy("lang", "label", "bin").agg(F.count("*").alias("n")).collect()
    found = sorted(found, key=lambda r: (r["lang"] or "", r["label"], r["bin"]))
    model.calibrate(np.array([r["bin"] / BINS for r in found]), np.array([float(r["label"]) for r in found]), np.array([float(r["n"]) for r in found]), prior, [r["lang"] for r in found])
    return model


def _groups(texts: Iterable) -> Iterator[list[list[bytes]]]:
    """Words of some texts at a time."""
    group, held = [], 0
    for value in texts:
        group.append(words_of(value.as_py()))
        held += len(group[-1]) + PADS
        if held > GROUP_WORDS:
            yield group
            group, held = [], 0
    if group:
        yield group


def scored(docs: DataFrame, model: ToxicityCnn, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the toxicity score of every whole text; a null text counts as empty.  No shuffle."""
    shaped = docs.withColumn(out, F.lit(None).cast("double"))
    at, out_at = shaped.columns.index(text), shaped.columns.index(out)
    holder = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = holder.value.table()
        for batch in batches:
            found = [holder.value.score(group, words) for group in _groups(batch.column(at).cast(pa.large_binary()))]
            arrays = list(batch.columns)
            arrays[out_at] = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return shaped.mapInArrow(apply, shaped.schema)


def is_toxic(model: ToxicityCnn, score: Column, language: Column, otherwise: float = 0.7) -> Column:
    """Whether a score reaches the threshold of the text's language."""
    cut = F.lit(otherwise)
    for name, value in sorted(model.thresholds.items()):
        cut = F.when(language == name, F.lit(value)).otherwise(cut)
    return score >= cut


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", language: str = "lang", **options) -> DataFrame:
    """``docs`` without those that a classifier fitted on ``labels`` finds toxic; all columns as before."""
    model = train(docs, labels, text=text, language=language, **options)
    return scored(docs, model, text, "_toxicity").where(~F.coalesce(is_toxic(model, F.col("_toxicity"), F.col(language)), F.lit(False))).select(*docs.columns)
