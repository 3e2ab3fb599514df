"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling.

A word goes in as two vectors: its own, if it is in the vocabulary, and the mean of its hashed character trigrams'. Two
recurrent layers read a window of words from either end, attention weighs their states, and a logistic unit judges the
weighted mean. Every text is cut into overlapping windows that cover it whole; its score follows its worst window.

Labels say which texts are toxic, not where. So training alternates: it fits the network to one window per text, then
takes the window that the network now finds worst in each text. The first choice is by word frequencies.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Words of a window, and how far on the next one starts: every passage of up to WINDOW - STRIDE + 1 words lies whole in one.
WINDOW, STRIDE = 24, 4
#: Width of the word and character inputs, of each direction's state, and number of character buckets.
WORD_DIM, CHAR_DIM, STATE, BUCKETS = 8, 8, 8, 1024
#: The fit takes at most this many labelled texts of each class, none longer than TRAIN_CHARS code points.
TRAIN_TEXTS = 1500
TRAIN_CHARS = 6_000
#: A word has a vector of its own if it occurs in this many different texts of the sample; at most VOCABULARY words do.
LEAST_TEXTS = 8
VOCABULARY = 20_000
#: Passes over the windows after each choice of windows; on small samples as many as give LEAST_STEPS.
ROUNDS = (5, 3, 3)
LEAST_STEPS = 100
#: One text in this many trains no weights; on these the scores are calibrated.
CALIBRATION = 5
#: Some labels are wrong. What a network can learn by heart is held small: a word's frequencies count as much as if so
#: many texts of each label more had been seen, its own vector is left out this often, and vectors decay at each step.
PSEUDO_TEXTS = 20
LEFT_OUT = 0.2
DECAY = 0.5
BATCH = 128
#: Distinct words whose inputs a worker remembers at most; words that are scored at a time.
REMEMBERED = 200_000
SEGMENT = 60_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of all words in order, and their number for each word.

    Words are marked at both ends.
    """
    line = "".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(line, "<u4").astype(np.uint64)
    mixed = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xD1B54A32D192ED03) + c[2:] * np.uint64(0x2545F4914F6CDD1D)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    inside = (c[:-2] != ord(">")) & (c[1:-1] != ord(">"))
    return (mixed[inside] % np.uint64(BUCKETS)).astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


@dataclass
class Model:
    """A fitted network. ``vocabulary`` numbers words from 1; row 0 of ``words`` serves all others."""

    vocabulary: dict[str, int]
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0

    def inputs(self, words: list[str]) -> np.ndarray:
        """Rows of both input vectors, one for each word."""
        own = self.p["words"][[self.vocabulary.get(w, 0) for w in words]]
        flat, counts = trigrams(words)
        owners = np.repeat(np.arange(len(words)), counts)
        chars = np.stack([np.bincount(owners, self.p["chars"][:, k][flat], len(words)) for k in range(CHAR_DIM)], axis=1)
        return np.concatenate([own, chars / counts[:, None]], axis=1)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and first word of every window of texts with these numbers of words; the last one ends with the text."""
    counts = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, np.minimum(place * STRIDE, np.maximum(0, lengths[owner] - WINDOW))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


# --- network ------------------------------------------------------------------------------------------------------


def _direction(gates: np.ndarray, mask: np.ndarray, rec: np.ndarray, order, keep: list | None = None) -> np.ndarray:
    """States (place, window, unit) of one direction; ``gates`` (place, window, 3 units) hold the inputs' share.

    Where ``mask`` is 0, beyond the end of a text, the state stays.
    """
    n, h = gates.shape[1], rec.shape[0]
    state, states = np.zeros((n, h), gates.dtype), np.empty((gates.shape[0], n, h), gates.dtype)
    for t in order:
        both = _sigmoid(gates[t, :, : 2 * h] + state @ rec[:, : 2 * h])
        z, r = both[:, :h], both[:, h:]
        c = np.tanh(gates[t, :, 2 * h :] + (r * state) @ rec[:, 2 * h :])
        new = state + mask[t] * z * (c - state)
        if keep is not None:
            keep.append((t, state, z, r, c))
        state = states[t] = new
    return states


def _pooled(states: np.ndarray, mask: np.ndarray, p: dict) -> tuple[np.ndarray, tuple]:
    looked = np.tanh(states @ p["attend"])
    weight = np.exp(looked @ p["look"]) * mask[..., 0]
    weight = weight / weight.sum(axis=0)
    mean = np.einsum("tn,tnh->nh", weight, states)
    return mean @ p["out"] + p["out_bias"], (looked, weight, mean)


def _gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradients of the mean logistic loss by the parameters and by the inputs ``x`` (place, window, input)."""
    places, n, _ = x.shape
    h = STATE
    kept: dict[str, list] = {"f": [], "b": []}
    ahead = _direction(x @ p["in_f"] + p["bias_f"], mask, p["rec_f"], range(places), kept["f"])
    back = _direction(x @ p["in_b"] + p["bias_b"], mask, p["rec_b"], reversed(range(places)), kept["b"])
    states = np.concatenate([ahead, back], axis=2)
    logit, (looked, weight, mean) = _pooled(states, mask, p)
    prob = _sigmoid(logit)
    g: dict[str, np.ndarray] = {}
    d = (prob - y) / n
    g["out"], g["out_bias"] = mean.T @ d, d.sum(keepdims=True)
    d_mean = d[:, None] * p["out"]
    d_states = weight[..., None] * d_mean
    d_weight = np.einsum("nh,tnh->tn", d_mean, states)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["look"] = np.einsum("tn,tnh->h", d_score, looked)
    d_look = d_score[..., None] * p["look"] * (1 - looked**2)
    g["attend"] = states.reshape(-1, 2 * h).T @ d_look.reshape(-1, 2 * h)
    d_states = d_states + d_look @ p["attend"].T
    d_x = np.zeros_like(x)
    for name, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
        rec, d_gates, later = p[f"rec_{name}"], np.empty((places, n, 3 * h)), np.zeros((n, h))
        g[f"rec_{name}"] = np.zeros_like(rec)
        for t, state, z, r, c in reversed(kept[name]):
            later = later + d_states[t, :, part]
            m = mask[t] * later
            d_c = m * z * (1 - c**2)
            d_reset = d_c @ rec[:, 2 * h :].T
            d_z, d_r = m * (c - state) * z * (1 - z), d_reset * state * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_c], axis=1)
            g[f"rec_{name}"][:, : 2 * h] += state.T @ d_gates[t, :, : 2 * h]
            g[f"rec_{name}"][:, 2 * h :] += (r * state).T @ d_c
            later = later - m * z + d_reset * r + d_gates[t, :, : 2 * h] @ rec[:, : 2 * h].T
        flat = d_gates.reshape(-1, 3 * h)
        g[f"in_{name}"], g[f"bias_{name}"] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(axis=0)
        d_x += d_gates @ p[f"in_{name}"].T
    loss = -np.log(np.where(y > 0, prob, 1 - prob) + 1e-12).mean()
    return g, d_x, float(loss)


# --- fitting ------------------------------------------------------------------------------------------------------


def fit(samples: list[tuple[list[str], int]], rounds: tuple[int, ...] = ROUNDS, seed: int = 11) -> Model | None:
    """A network fitted to ``(words, label)`` samples; None unless both labels occur in texts with words."""
    samples = [(w, y) for w, y in samples if w]
    labels = np.array([y for _, y in samples], float)
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    # Every so many texts of either label; tiny samples calibrate on all.
    rank = np.where(labels > 0, np.cumsum(labels), np.cumsum(1 - labels))
    aside = (rank % CALIBRATION == 0) & (min(labels.sum(), len(labels) - labels.sum()) >= 4 * CALIBRATION)
    seen = (Counter(), Counter())
    for (w, y), out in zip(samples, aside, strict=True):
        if not out:
            seen[y].update(set(w))
    totals = ((1 - labels[~aside]).sum(), labels[~aside].sum())
    common = sorted(((n, w) for w in seen[0] | seen[1] if (n := seen[0][w] + seen[1][w]) >= LEAST_TEXTS), key=lambda x: (-x[0], x[1]))
    vocabulary = {w: i for i, (_, w) in enumerate(common[:VOCABULARY], 1)}
    odds = np.zeros(len(vocabulary) + 1)
    for w, i in vocabulary.items():
        base = PSEUDO_TEXTS * (seen[0][w] + seen[1][w]) / len(labels)
        odds[i] = np.log((seen[1][w] + base + 1) / (totals[1] + PSEUDO_TEXTS)) - np.log((seen[0][w] + base + 1) / (totals[0] + PSEUDO_TEXTS))

    def normal(*shape, by=0.3):
        return rng.normal(0, by, shape)

    width = WORD_DIM + CHAR_DIM
    p = {
        "words": normal(len(vocabulary) + 1, WORD_DIM, by=0.1), "chars": normal(BUCKETS, CHAR_DIM, by=0.1),
        "in_f": normal(width, 3 * STATE), "rec_f": normal(STATE, 3 * STATE), "bias_f": np.zeros(3 * STATE),
        "in_b": normal(width, 3 * STATE), "rec_b": normal(STATE, 3 * STATE), "bias_b": np.zeros(3 * STATE),
        "attend": normal(2 * STATE, 2 * STATE), "look": normal(2 * STATE), "out": normal(2 * STATE), "out_bias": np.zeros(1),
    }
    p["words"][:, 0] = odds / 2
    origin = np.zeros_like(p["words"])
    origin[:, 0] = odds / 2
    model = Model(vocabulary, p)
    lengths = np.array([len(w) for w, _ in samples])
    distinct = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in samples for w in words))}
    ids = np.fromiter((distinct[w] for words, _ in samples for w in words), np.int64)
    own = np.array([vocabulary.get(w, 0) for w in distinct])
    grams, n_grams = trigrams(list(distinct))
    grams_at = np.cumsum(n_grams) - n_grams
    begins = np.cumsum(lengths) - lengths
    owner, at = windows(lengths)
    first = begins[owner] + at
    size = np.minimum(WINDOW, lengths[owner])
    value = np.concatenate([[0.0], np.cumsum(odds[own[ids]])])
    suspicion = value[first + size] - value[first]
    sums = [(np.zeros_like(v), np.zeros_like(v)) for v in p.values()]
    step = 0
    for epochs in rounds:
        # The worst window of every text, and another one of every text that isn't toxic.
        order = np.lexsort((suspicion, owner))
        worst = order[np.concatenate([np.flatnonzero(np.diff(owner[order])), [len(order) - 1]])]
        worst = worst[~aside[owner[worst]]]
        other = rng.permutation(np.flatnonzero((labels[owner] == 0) & ~aside[owner]))[: len(worst)]
        chosen = np.unique(np.concatenate([worst, other]))
        for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // len(chosen)))):
            for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // BATCH)):
                step += 1
                spots = first[part] + np.minimum(np.arange(WINDOW)[:, None], size[part] - 1)
                mask = (np.arange(WINDOW)[:, None] < size[part])[..., None].astype(float)
                found, inverse = np.unique(ids[spots], return_inverse=True)
                counts = n_grams[found]
                owners = np.repeat(np.arange(len(found)), counts)
                flat = grams[np.arange(len(owners)) + (grams_at[found] - np.cumsum(counts) + counts)[owners]]
                chars = np.stack([np.bincount(owners, p["chars"][:, k][flat], len(found)) for k in range(CHAR_DIM)], axis=1)
                table = np.concatenate([p["words"][own[found]], chars / counts[:, None]], axis=1)
                # Now and then the word's own vector is left out, so that characters are learned for unknown words.
                table[rng.random(len(found)) < LEFT_OUT, :WORD_DIM] = p["words"][0]
                x = table[inverse.reshape(spots.shape)]
                g, d_x, _ = _gradients(p, x, mask, labels[owner[part]])
                by_word = np.stack([np.bincount(inverse.ravel(), d_x[..., k].ravel(), len(found)) for k in range(width)], axis=1)
                g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
                np.add.at(g["words"], own[found], by_word[:, :WORD_DIM])
                np.add.at(g["chars"], flat, (by_word[:, WORD_DIM:] / counts[:, None])[owners])
                for (name, v), (m, s) in zip(p.items(), sums, strict=True):
                    m += 0.1 * (g[name] - m)
                    s += 0.01 * (g[name] ** 2 - s)
                    if name in ("words", "chars"):
                        v -= 0.01 * DECAY * (v - origin if name == "words" else v)
                    v -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        suspicion = Scorer(model).window_logits(ids, list(distinct), first, size)
    best = np.full(len(lengths), -np.inf)
    np.maximum.at(best, owner, suspicion)
    judged = aside if aside.any() else np.ones(len(labels), bool)
    model.scale, model.shift = _calibrate(best[judged], labels[judged])
    return model


def _calibrate(best: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the texts' worst windows."""
    a, b = 1.0, 0.0
    for _ in range(2000):
        d = (_sigmoid(a * best + b) - labels) / len(labels)
        a, b = max(0.05, a - 0.2 * ((d * best).sum() + 0.001 * (a - 1))), b - 0.2 * d.sum()
    return a, b


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """A network fitted to a bounded sample of the labelled rows; None unless it holds both labels.

    The sample has at most TRAIN_TEXTS texts of each label, evenly by a hash of the id, none longer than TRAIN_CHARS code
    points. Where an id has several labels, the greatest counts. Rows without text, id or label aren't learned from.
    """
    marked = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(F.col(label).cast("int")).alias("y"))
    rows = docs.where(F.length(text) <= TRAIN_CHARS).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    samples = []
    for y, n in sorted(counts.items()):
        share = min(1.0, 3 * TRAIN_TEXTS / n)
        picked = marked.where(F.col("y") == y).where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < share * (1 << 20))
        picked = picked.orderBy(F.xxhash64(F.lit(1), F.col("_id"))).limit(6 * TRAIN_TEXTS)
        taken = rows.join(F.broadcast(picked), "_id").groupBy(F.xxhash64("_text").alias("h")).agg(F.any_value("_text").alias("t"))
        taken = taken.orderBy(F.xxhash64(F.lit(2), F.col("h"))).limit(TRAIN_TEXTS).collect()
        samples += [(words_of(r["t"]), int(y)) for r in taken]
    return fit(samples)


# --- scoring ------------------------------------------------------------------------------------------------------


class Scorer:
    """Scores texts; remembers the inputs of frequent words, as each direction's share of the gates."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        p = {k: v.astype(np.float32) for k, v in model.p.items() if k not in ("words", "chars")}
        self.p = p
        self.table = np.empty((0, 2, 3 * STATE), np.float32)

    def _gates(self, words: list[str]) -> np.ndarray:
        x, p = self.model.inputs(words), self.model.p
        return np.stack([x @ p["in_f"] + p["bias_f"], x @ p["in_b"] + p["bias_b"]], axis=1).astype(np.float32)

    def window_logits(self, ids: np.ndarray, words: list[str] | None, first: np.ndarray, size: np.ndarray, step: int = 2048) -> np.ndarray:
        """Logit of each window of ``size`` words from ``first`` on; ``ids`` number ``words``, or else the known ones."""
        table = self.table if words is None else self._gates(words)
        found = np.empty(len(first), np.float32)
        places = np.arange(WINDOW)[:, None]
        for a in range(0, len(first), step):
            own = size[a : a + step]
            spots = ids[first[a : a + step] + np.minimum(places, own - 1)]
            mask = (places < own)[..., None].astype(np.float32)
            gates = table[spots]
            ahead = _direction(gates[:, :, 0], mask, self.p["rec_f"], range(WINDOW))
            back = _direction(gates[:, :, 1], mask, self.p["rec_b"], reversed(range(WINDOW)))
            found[a : a + step] = _pooled(np.concatenate([ahead, back], axis=2), mask, self.p)[0]
        return found

    def _ids(self, tokens: list[str]) -> np.ndarray:
        distinct = dict.fromkeys(tokens)
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            self.table, new = self.table[:0], list(distinct)
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self._gates(new)])
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))

    def _worst(self, tokens: list[str], lengths: np.ndarray) -> np.ndarray:
        owner, at = windows(lengths)
        best = np.full(len(lengths), -np.inf)
        if len(owner):
            begins = np.cumsum(lengths) - lengths
            logits = self.window_logits(self._ids(tokens), None, begins[owner] + at, np.minimum(WINDOW, lengths[owner]))
            np.maximum.at(best, owner, logits)
        return best

    def score(self, texts: list[str | None]) -> list[float]:
        """Score of each text by its worst window; 0 without words."""
        worst: list[float] = []
        held: list[str] = []
        lengths: list[int] = []
        for text in [*texts, None]:
            own = words_of(text)
            held.extend(own)
            lengths.append(len(own))
            if len(held) >= SEGMENT or len(lengths) + len(worst) > len(texts):
                worst += self._worst(held, np.array(lengths)).tolist()
                held, lengths = [], []
        logits = self.model.scale * np.array(worst[: len(texts)]) + self.model.shift
        return _sigmoid(np.maximum(logits, -60.0)).tolist() if len(texts) else []


_latest: list[Scorer] = []


def _scorer(model: Model) -> Scorer:
    """The worker's scorer, which later tasks of the same job take over with the words it knows."""
    if not _latest or _latest[0].model is not model:
        _latest[:] = [Scorer(model)]
    return _latest[0]


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = scorer.score(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(found, pa.float64())], [*part.schema.names[1:], "toxicity"])

    return run


def score_texts(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with ``toxicity`` from 0 to 1, in place of a column of that name.

    All words of a text are scored. Texts without a word (NULL, empty, no letter) score 0, as do all texts where no
    model could be fitted. Equal texts score alike; repeated rows stay. Rows stay where they are; only the model is sent
    to the tasks, and VOCABULARY bounds its size.
    """
    keep = [k for k in keep if k != "toxicity"]
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("toxicity"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text).alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_scores(shared), f"{schema + ', ' if schema else ''}toxicity double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that the fit never sees."""
    return remainder(F.col(doc_id), 5) == 0
