"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A text is lower-cased and cut into words; a word enters the network as the
embedding of the word itself next to the pooled embeddings of its character
n-grams. Two gated recurrent layers read each window forwards and backwards,
attention pools their states, and the window's logit is linear in the pool. A
document scores as its highest window; windows overlap and cover all words.

Training is by numpy on the driver, on a bounded sample of labelled documents:
a document's label is taken to be that of its highest window, which is the one
that gradients flow through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgraph.llm.text import TEXTS_TOGETHER

WINDOW, STRIDE = 48, 32
UNITS = 8  # of each direction, and of each embedding
GRAMS = (3, 5)
#: Bounds of the training sample and of what is learned from it.
POSITIVES, NEGATIVES, SAMPLE_WORDS = 800, 1_600, 2_000
WORDS, GRAM_COUNT = 30_000, 60_000
STEPS, EPOCHS, BATCH = 400, 30, 64
#: Steps between two looks at all words for picking windows.
REFRESH = 20
SEED = 7
#: Words a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 60_000
_GROUP = 2_048  # windows scored together

_PUNCTUATION = bytes(range(1, 48)) + b":;<=>?@[\\]^_`{|}~"
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_PAD = 0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode(errors="replace").translate(_TO_SPACE).split()


def character_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of the marked words, and the word each belongs to."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))
    codes, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        code = np.full(len(at), n << 48, np.uint64)
        for k in range(n):
            code |= data[at + k] << np.uint64(8 * k)
        codes.append(code)
        owners.append(owner[at])
    return np.concatenate(codes), np.concatenate(owners)


@dataclass
class Model:
    """Weights. ``words`` has a row for unknown words first; ``gram_codes`` is
    sorted and matches the rows of ``grams``. Matrices have the direction first."""

    vocabulary: dict[bytes, int]
    gram_codes: np.ndarray
    words: np.ndarray
    grams: np.ndarray
    inputs: np.ndarray  # (2, 2 UNITS, 3 UNITS)
    bias: np.ndarray  # (2, 3 UNITS)
    states: np.ndarray  # (2, UNITS, 3 UNITS)
    attention: np.ndarray  # (2 UNITS,)
    output: np.ndarray  # (2 UNITS,)
    offset: np.ndarray  # (1,)

    def grams_of(self, words: list[bytes]):
        """Rows of the known n-grams of each word, the owners, and the weights."""
        codes, owners = character_grams(words)
        if not len(self.gram_codes):
            codes = codes[:0]
            owners = owners[:0]
        rows = np.minimum(np.searchsorted(self.gram_codes, codes), max(len(self.gram_codes) - 1, 0))
        known = self.gram_codes[rows] == codes if len(codes) else np.zeros(0, bool)
        rows, owners = rows[known], owners[known]
        hits = np.bincount(owners, minlength=len(words))
        return rows, owners, (1 / np.sqrt(hits + 1)).astype(np.float32)

    def embed(self, word_rows: np.ndarray, gram_rows, owners, scale) -> np.ndarray:
        pooled = np.zeros((len(word_rows), UNITS), np.float32)
        if len(owners):
            starts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
            pooled[owners[starts]] = np.add.reduceat(self.grams[gram_rows], starts)
        return np.concatenate([self.words[word_rows], pooled * scale[:, None]], axis=1)

    def gates(self, embedded: np.ndarray) -> np.ndarray:
        """What each word adds to the gates: (words, 2, 3 UNITS)."""
        return np.stack([embedded @ self.inputs[d] + self.bias[d] for d in range(2)], axis=1)


def _pad_gates() -> np.ndarray:
    """Padding holds the state: the update gate is open whatever the state is."""
    row = np.zeros((1, 2, 3 * UNITS), np.float32)
    row[:, :, :UNITS] = 60.0
    return row


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def forward(model: Model, gates: np.ndarray, windows: np.ndarray, keep: bool = False):
    """Logits of ``windows`` (rows of ``gates``, row 0 being padding)."""
    n, length = windows.shape
    h = np.zeros((2, n, UNITS), np.float32)
    states = np.empty((length, n, 2 * UNITS), np.float32)
    trail = []
    for t in range(length):
        x = np.stack([gates[windows[:, t], 0], gates[windows[:, length - 1 - t], 1]])
        s = h @ model.states
        zr = _sigmoid(x[:, :, : 2 * UNITS] + s[:, :, : 2 * UNITS])
        z, r = zr[:, :, :UNITS], zr[:, :, UNITS:]
        new = np.tanh(x[:, :, 2 * UNITS :] + r * s[:, :, 2 * UNITS :])
        if keep:
            trail.append((h, z, r, new, s[:, :, 2 * UNITS :]))
        h = new + z * (h - new)
        states[t, :, :UNITS] = h[0]
        states[length - 1 - t, :, UNITS:] = h[1]
    e = states @ model.attention
    e[windows.T == _PAD] = -1e9
    e = np.exp(e - e.max(axis=0))
    weights = e / e.sum(axis=0)
    pooled = np.einsum("tn,tnk->nk", weights, states)
    logits = pooled @ model.output + model.offset[0]
    return (logits, states, weights, pooled, trail) if keep else logits


def backward(model: Model, windows: np.ndarray, kept, slope: np.ndarray):
    """Gradients of the sum of ``slope * logit``: of the weights, and of the
    gates at every position, as (n, length, 2, 3 UNITS)."""
    _, states, weights, pooled, trail = kept
    n, length = windows.shape
    grads = {"output": pooled.T @ slope, "offset": np.array([slope.sum()])}
    d_pooled = slope[:, None] * model.output
    inner = np.einsum("tnk,nk->tn", states, d_pooled)
    d_e = weights * (inner - (weights * inner).sum(axis=0))
    grads["attention"] = np.einsum("tn,tnk->k", d_e, states)
    d_states = weights[:, :, None] * d_pooled + d_e[:, :, None] * model.attention

    d_gates = np.zeros((n, length, 2, 3 * UNITS), np.float32)
    grads["states"] = np.zeros_like(model.states)
    dh = np.zeros((2, n, UNITS), np.float32)
    for t in reversed(range(length)):
        dh = dh + np.stack([d_states[t, :, :UNITS], d_states[length - 1 - t, :, UNITS:]])
        h, z, r, new, s = trail[t]
        d_new = dh * (1 - z) * (1 - new * new)
        d_z = dh * (h - new) * z * (1 - z)
        d_r = d_new * s * r * (1 - r)
        d_x = np.concatenate([d_z, d_r, d_new], axis=2)
        d_s = np.concatenate([d_z, d_r, d_new * r], axis=2)
        grads["states"] += np.swapaxes(h, 1, 2) @ d_s
        dh = dh * z + d_s @ np.swapaxes(model.states, 1, 2)
        d_gates[:, t, 0] = d_x[0]
        d_gates[:, length - 1 - t, 1] = d_x[1]
    return grads, d_gates


def windows_of(rows: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Overlapping windows over a document's rows; the last ends with the text,
    and a text shorter than a window is padded."""
    if len(rows) < window:
        return np.append(rows, np.full(window - len(rows), _PAD, rows.dtype))[None, :]
    starts = np.append(np.arange(0, len(rows) - window, stride), len(rows) - window)
    return rows[starts[:, None] + np.arange(window)]


class _Adam:
    """Adam steps; of an embedding only the touched rows move."""

    def __init__(self, rate: float):
        self.rate, self.moments, self.steps = rate, {}, 0

    def step(self, name: str, array: np.ndarray, grad: np.ndarray, rows=None):
        if name not in self.moments:
            self.moments[name] = (np.zeros_like(array), np.zeros_like(array))
        first, second = self.moments[name]
        at = slice(None) if rows is None else rows
        first[at] = 0.9 * first[at] + 0.1 * grad
        second[at] = 0.99 * second[at] + 0.01 * grad * grad
        up = first[at] / (1 - 0.9**self.steps)
        array[at] -= self.rate * up / (np.sqrt(second[at] / (1 - 0.99**self.steps)) + 1e-7)


def _log_odds(having: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Smoothed log-odds of the label given a feature, less those of the prior."""
    rate = (positive + 4 * prior) / (having + 4)
    return np.log(rate / (1 - rate)) - np.log(prior / (1 - prior))


def _initial(documents: list[list[bytes]], labels: np.ndarray, rng) -> Model:
    """Embeddings of what several documents have; their first unit starts as
    smoothed log-odds, all else at random."""
    prior = float(np.clip(labels.mean() if len(labels) else 0.0, 0.01, 0.99))
    having, positive = Counter(), Counter()
    for words, label in zip(documents, labels):
        distinct = set(words)
        having.update(distinct)
        if label:
            positive.update(distinct)
    types = list(having)
    chosen = sorted((w for w in types if having[w] >= 2), key=lambda w: (-having[w], w))[:WORDS]

    number = {w: i for i, w in enumerate(types)}
    codes, owners = character_grams(types) if types else (np.zeros(0, np.uint64), np.zeros(0, int))
    distinct, rows = np.unique(codes, return_inverse=True)
    order = np.argsort(owners, kind="stable")
    rows, cuts = rows[order], np.searchsorted(owners[order], np.arange(len(types) + 1))
    gram_having, gram_positive = np.zeros(len(distinct)), np.zeros(len(distinct))
    for words, label in zip(documents, labels):
        parts = [rows[cuts[i] : cuts[i + 1]] for i in {number[w] for w in words}]
        own = np.unique(np.concatenate(parts)) if parts else np.zeros(0, int)
        gram_having[own] += 1
        gram_positive[own] += label
    usable = np.flatnonzero(gram_having >= 3)
    usable = np.sort(usable[np.argsort(-gram_having[usable], kind="stable")[:GRAM_COUNT]])

    def near_zero(*shape, size=0.1):
        return (rng.standard_normal(shape) * size).astype(np.float32)

    words = near_zero(len(chosen) + 1, UNITS)
    words[0] = 0
    words[1:, 0] = 0.2 * _log_odds(
        np.array([having[w] for w in chosen], float), np.array([positive[w] for w in chosen], float), prior
    )
    grams = near_zero(len(usable), UNITS)
    grams[:, 0] = 0.2 * _log_odds(gram_having[usable], gram_positive[usable], prior)
    return Model(
        {w: i + 1 for i, w in enumerate(chosen)},
        distinct[usable],
        words,
        grams,
        near_zero(2, 2 * UNITS, 3 * UNITS, size=0.3),
        np.zeros((2, 3 * UNITS), np.float32),
        near_zero(2, UNITS, 3 * UNITS, size=0.2),
        near_zero(2 * UNITS, size=0.3),
        near_zero(2 * UNITS, size=0.3),
        np.zeros(1, np.float32),
    )


def train(texts: list[str | None], labels: list[int], prior: float, steps: int = STEPS) -> Model:
    """Fit to labelled texts; ``prior`` is the share of positives to expect in
    use. Without both labels present, the scores are the prior."""
    rng = np.random.default_rng(SEED)
    documents = [words_of(t) for t in texts]
    y = np.array(labels, np.float32)
    model = _initial(documents, y, rng)
    # the empty text is a negative of every batch
    documents.append([])
    y = np.append(y, np.float32(0))
    prior = float(np.clip(prior, 0.01, 0.99))
    sides = [np.flatnonzero(y == 1), np.flatnonzero(y[:-1] == 0)]
    if min(map(len, sides)) == 0:
        model.output[:] = 0
        model.offset[:] = np.log(prior / (1 - prior))
        return model

    types = sorted(set().union(*documents))
    number = {w: i + 1 for i, w in enumerate(types)}
    word_rows = np.array([model.vocabulary.get(w, 0) for w in types], np.int64)
    gram_rows, owners, scale = model.grams_of(types)
    order = np.argsort(owners, kind="stable")
    gram_rows, owners = gram_rows[order], owners[order]
    cuts = np.searchsorted(owners, np.arange(len(types) + 1))
    windows = [windows_of(np.array([number[w] for w in d], np.int64)) for d in documents]

    adam = _Adam(0.01)
    share = 0.25
    model.offset[:] = np.log(share / (1 - share))
    steps = min(steps, max(1, EPOCHS * len(documents) // BATCH))
    for step in range(steps):
        adam.steps += 1
        adam.rate = 0.01 * (1 - step / steps) + 0.0005
        picked = np.concatenate(
            [
                rng.choice(sides[0], int(BATCH * share)),
                rng.choice(sides[1], BATCH - int(BATCH * share)),
                [len(documents) - 1] * 4,
            ]
        )
        if step % REFRESH == 0:
            all_gates = np.concatenate([_pad_gates(), model.gates(model.embed(word_rows, gram_rows, owners, scale))])
        counts = np.array([len(windows[i]) for i in picked])
        firsts = np.cumsum(counts) - counts
        stacked = np.concatenate([windows[i] for i in picked])
        logits = forward(model, all_gates, stacked)
        best = [f + int(np.argmax(logits[f : f + c])) for f, c in zip(firsts, counts)]

        used, top = np.unique(stacked[best], return_inverse=True)
        padded = int(used[0] == _PAD)
        top = top.reshape(len(best), -1) + (1 - padded)
        kinds = used[padded:] - 1
        counts = cuts[kinds + 1] - cuts[kinds]
        own = np.repeat(np.arange(len(kinds)), counts)
        flat = np.arange(counts.sum()) + np.repeat(cuts[kinds] - (np.cumsum(counts) - counts), counts)
        grams = gram_rows[flat]
        # known words are hidden at times, so that their characters must serve alone
        hidden = rng.random(len(kinds)) < 0.3
        rows = np.where(hidden, 0, word_rows[kinds])
        embedded = model.embed(rows, grams, own, scale[kinds])
        gates = np.concatenate([_pad_gates(), model.gates(embedded)])
        kept = forward(model, gates, top, keep=True)
        slope = ((_sigmoid(kept[0]) - y[picked]) / len(picked)).astype(np.float32)
        grads, d_gates = backward(model, top, kept, slope)

        per_word = np.zeros((len(gates), 2, 3 * UNITS), np.float32)
        np.add.at(per_word, top.ravel(), d_gates.reshape(-1, 2, 3 * UNITS))
        per_word = per_word[1:]
        d_embedded = sum(per_word[:, d] @ model.inputs[d].T for d in range(2))
        grads["inputs"] = np.stack([embedded.T @ per_word[:, d] for d in range(2)])
        grads["bias"] = per_word.sum(axis=0)
        for name, grad in grads.items():
            adam.step(name, getattr(model, name), grad)
        touched, inverse = np.unique(rows, return_inverse=True)
        grad = np.zeros((len(touched), UNITS), np.float32)
        np.add.at(grad, inverse, d_embedded[:, :UNITS])
        known = touched > 0
        adam.step("words", model.words, grad[known], touched[known])
        if len(grams):
            touched, inverse = np.unique(grams, return_inverse=True)
            grad = np.zeros((len(touched), UNITS), np.float32)
            np.add.at(grad, inverse, (d_embedded[:, UNITS:] * scale[kinds][:, None])[own])
            adam.step("grams", model.grams, grad, touched)

    model.offset += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return model


class Scorer:
    """A model with the gates of the words met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows, self.gates = _Numbers(), np.zeros((4_096, 2, 3 * UNITS), np.float32)
        self.gates[:1] = _pad_gates()

    def _learn(self) -> None:
        words, self.rows.new = self.rows.new, []
        if not words:
            return
        first = len(self.rows) + 1 - len(words)
        while first + len(words) > len(self.gates):
            self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
        known = np.array([self.model.vocabulary.get(w, 0) for w in words], np.int64)
        rows, owners, scale = self.model.grams_of(words)
        order = np.argsort(owners, kind="stable")
        embedded = self.model.embed(known, rows[order], owners[order], scale)
        self.gates[first : first + len(words)] = self.model.gates(embedded)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """One score per text, from 0 to 1."""
        out, group, counts = [], [], []
        for text in texts:
            words = words_of(text)
            rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            windows = windows_of(rows)
            group.append(windows)
            counts.append(len(windows))
            if sum(counts) >= _GROUP:
                out.append(self._highest(group, counts))
                group, counts = [], []
        if group:
            out.append(self._highest(group, counts))
        return _sigmoid(np.concatenate(out).astype(np.float64)) if out else np.zeros(0)

    def _highest(self, group, counts) -> np.ndarray:
        self._learn()
        windows = np.concatenate(group)
        logits = np.concatenate(
            [forward(self.model, self.gates, windows[i : i + _GROUP]) for i in range(0, len(windows), _GROUP)]
        )
        if len(self.rows) > REMEMBERED:
            self.forget()
        return np.maximum.reduceat(logits, np.cumsum(counts) - counts)


class _Numbers(dict):
    """Row numbers of words from 1 on, handed out at first sight."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self) + 1
        self.new.append(word)
        return found


def held_out(id_col: str = "doc_id", modulus: int = 4, remainder: int = 2):
    """Whether a row's label is kept from training; a null id is not held out."""
    code = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(F.pmod(code, F.lit(modulus)) == remainder, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    sample_words: int = SAMPLE_WORDS,
    steps: int = STEPS,
) -> Model:
    """Train on a sample of the labelled documents that are not held out.

    ``labels`` has ``doc_id`` and the label; rows without both count for
    nothing. Of each label at most ``positives`` and ``negatives`` ids, the
    first in hash order, are taken; their texts reach the driver unless they
    have more than ``sample_words`` words.
    """
    usable = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).alias("y"))
    )
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(sum(counts.values()), 1)
    by_hash = [F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id")]
    sample = None
    for y, most in ((1, positives), (0, negatives)):
        part = usable.filter(F.col("y") == y).orderBy(*by_hash).limit(most)
        sample = part if sample is None else sample.union(part)
    # bounded by positives + negatives rows
    taken = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .filter(F.size(F.split("text", r"\s+", sample_words + 1)) <= sample_words)
        # an id that many rows share has one text in the sample, and the bound holds
        .groupBy("doc_id")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
        # equal texts are one, under the least id, so that reruns train alike
        .groupBy("text", "y")
        .agg(F.min("doc_id").alias("doc_id"))
        .orderBy(*by_hash, "text")
        .select("text", "y")
        .collect()
    )
    return train([r["text"] for r in taken], [r["y"] for r in taken], prior, steps)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but a clashing one, and ``score``: the toxicity of
    each whole text, from 0 to 1.

    Null texts count as empty; a text without words scores as the network's
    offset, which is trained on the empty text as a negative. Repeated
    rows come back as often as they came. Nothing is shuffled; the model, of
    bounded size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # what a task has remembered goes with it: later stages need the memory
        scorer = Scorer(shared.value)
        for texts in batches:
            parts = [texts.slice(k, TEXTS_TOGETHER) for k in range(0, len(texts), TEXTS_TOGETHER)]
            found = [scorer.scores(part.to_pylist()) for part in parts]
            yield pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())
            del texts, parts
            pa.default_memory_pool().release_unused()

    others = [c for c in docs.columns if c != "score"]
    return docs.select(*others, toxicity(text_col).alias("score"))
