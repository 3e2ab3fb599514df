"""Languages of texts by a linear-chain conditional random field over their words.

Each word has features: the character n-grams inside it, its affixes, and itself where it is in the lexicon. Their
weights give a score per language, a learned matrix scores the transition from one word's language to the next's, and
forward-backward turns both into the probability of each language at each word, so a text may switch language anywhere.
A document's language is the one with the greatest mean probability over all its words.

A worker reads the words of a batch as one chain in which a document's first word forgets what came before. The chain
is cut into blocks; a first pass multiplies each block into one small matrix, these are scanned in order, and a second
pass starts every block from its exact messages. Neither memory nor exactness depends on a text's length.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import held, remainder, small, text_key, text_slices

UNKNOWN = "und"
#: A word is a run of letters with their marks; digits, signs and spaces are none.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The fit takes at most this many different texts of a language, and this many languages (the most frequent).
TRAIN_TEXTS = 500
TRAIN_LANGUAGES = 100
#: Of each text that the fit takes, this many words at most, from a place that the text's hash gives.
TRAIN_WORDS = 64
STEPS = 40
#: A lexicon word occurs in at least this many texts of the sample.
LEXICON_TEXTS = 3
#: Words whose scores a worker remembers at most.
REMEMBERED = 200_000
#: Words times languages that are worked on at a time, and words of a block.
SEGMENT, BLOCK = 1 << 19, 128
#: A document whose declared language differs from the one found with at least this mean probability is rejected.
CONTRADICTED = 0.9


def segment(languages: int) -> int:
    """Words that are worked on at a time: fewer with many languages, so that memory stays bounded."""
    return max(BLOCK, SEGMENT // max(4, languages) // BLOCK * BLOCK)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_features(word: str) -> list[str]:
    """Affixes of up to three characters, all n-grams of three, and the word for the lexicon."""
    found = [word[i : i + 3] for i in range(len(word) - 2)]
    found += ("=" + word, "<" + word[:1], "<" + word[:2], "<" + word[:3], word[-1:] + ">", word[-2:] + ">", word[-3:] + ">")
    return found


@dataclass
class Model:
    """Weights of a fitted field. ``index`` numbers the features; all are bounded by the fit's sample."""

    languages: list[str]
    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of language scores for each word."""
        ids, counts = _feature_ids(words, self.index)
        return _sum_rows(self.weights, ids, np.repeat(np.arange(len(words)), counts), len(words))


def _feature_ids(words: list[str], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weights for all features of all words, and how many each word has. Row 0 is for the unknown ones."""
    get, ids, counts = index.get, [], []
    for word in words:
        own = word_features(word)
        ids.extend(map(get, own, repeat(0)))
        counts.append(len(own))
    return np.array(ids, np.int64), np.array(counts, np.int64)


def _sum_rows(weights: np.ndarray, ids: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owners, weights[:, k][ids], n) for k in range(weights.shape[1])], axis=1)


# --- forward-backward over one long chain -------------------------------------------------------------------------


def _blocks(ids: np.ndarray, first: np.ndarray, potentials: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Potentials (place in block, block, language), and for each place the blocks in which a document starts there.

    The last block of a chain is filled up with places that count as documents of their own; nothing follows them.
    """
    n = -(-len(ids) // BLOCK) * BLOCK
    p = np.ones((n, potentials.shape[1]))
    p[: len(ids)] = potentials[ids]
    starts = np.ones(n, bool)
    starts[: len(ids)] = first
    return (
        np.ascontiguousarray(p.reshape(-1, BLOCK, p.shape[1]).transpose(1, 0, 2)),
        [np.flatnonzero(x) for x in starts.reshape(-1, BLOCK).T],
    )


def _norm(x: np.ndarray, axes) -> np.ndarray:
    return x / x.max(axis=axes, keepdims=True)


def _products(p: np.ndarray, starts: list[np.ndarray], step: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Each block as one matrix from the message before it to the message after it."""
    size = p.shape[2]
    m = np.broadcast_to(np.eye(size), (p.shape[1], size, size))
    for k in range(BLOCK):
        on = (m.reshape(-1, size) @ step).reshape(m.shape)
        if len(at := starts[k]):
            on[at] = m[at].sum(axis=2, keepdims=True) * begin
        on *= p[k][:, None, :]
        m = _norm(on, (1, 2)) if k % 8 == 7 else on
    return m


def _posteriors(p, starts, step, begin, entry, leave) -> np.ndarray:
    """Probabilities (place, block, language), given each block's forward message before and backward message after it."""
    ahead = np.empty_like(p)
    message = entry
    for k in range(BLOCK):
        on = message @ step
        if len(at := starts[k]):
            on[at] = message[at].sum(axis=1, keepdims=True) * begin
        on *= p[k]
        message = ahead[k] = _norm(on, 1) if k % 8 == 7 else on
    message = leave
    for k in reversed(range(BLOCK)):
        ahead[k] *= message
        seen = p[k] * message
        on = seen @ step.T
        if len(at := starts[k]):
            on[at] = (seen[at] @ begin)[:, None]
        message = _norm(on, 1) if k % 8 == 0 else on
    ahead /= ahead.sum(axis=2, keepdims=True)
    return ahead


def language_sums(ids: np.ndarray, lengths: np.ndarray, scores: np.ndarray, model: Model) -> np.ndarray:
    """Per document the sum over its words of each language's probability. ``ids`` number rows of ``scores``."""
    size = len(model.languages)
    sums = np.zeros((len(lengths), size))
    if not len(ids):
        return sums
    potentials = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(model.transitions - model.transitions.max())
    begin = np.exp(model.start - model.start.max())
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.zeros(len(ids), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    long = segment(size)
    cuts = range(0, len(ids), long)
    matrices = np.concatenate([
        _products(*_blocks(ids[a : a + long], first[a : a + long], potentials), step, begin) for a in cuts])
    entry, leave = np.ones((len(matrices), size)), np.ones((len(matrices), size))
    for b in range(1, len(matrices)):
        entry[b] = (x := entry[b - 1] @ matrices[b - 1]) / x.max()
    for b in reversed(range(len(matrices) - 1)):
        leave[b] = (x := matrices[b + 1] @ leave[b + 1]) / x.max()
    for a in cuts:
        part = slice(a, min(a + long, len(ids)))
        at = slice(a // BLOCK, a // BLOCK + -(-(part.stop - a) // BLOCK))
        found = _posteriors(*_blocks(ids[part], first[part], potentials), step, begin, entry[at], leave[at])
        found = found.transpose(1, 0, 2).reshape(-1, size)[: part.stop - a]
        for k in range(size):
            sums[:, k] += np.bincount(owner[part], found[:, k], len(lengths))
    return sums


# --- fitting ------------------------------------------------------------------------------------------------------


def fit(samples: list[tuple[str, list[str]]], steps: int = STEPS, seed: int = 7) -> Model | None:
    """A field fitted to ``(language, words)`` samples; None without any words.

    Besides the samples themselves it learns from spliced ones that switch between languages, so the transitions know
    of switches. Full gradients of the penalised likelihood by forward-backward, steps by Adam.
    """
    samples = [(lang, w) for lang, w in samples if w]
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return None
    code, rng = {lang: k for k, lang in enumerate(languages)}, np.random.default_rng(seed)
    chains = [(w, [code[lang]] * len(w)) for lang, w in samples]
    for i in range(len(samples) // 2 if len(languages) > 1 else 0):
        parts = [chains[i], chains[rng.integers(len(samples))], chains[rng.integers(len(samples))]]
        spliced, labels = [], []
        for w, y in parts:
            n = int(rng.integers(1, max(2, TRAIN_WORDS // 3)))
            at = int(rng.integers(0, max(1, len(w) - n)))
            spliced, labels = spliced + w[at : at + n], labels + y[at : at + n]
        chains.append((spliced[:TRAIN_WORDS], labels[:TRAIN_WORDS]))

    distinct: dict[str, int] = {}
    seen_in: dict[str, int] = {}
    for _, w in samples:
        for word in set(w):
            seen_in[word] = seen_in.get(word, 0) + 1
    for w, _ in chains:
        for word in w:
            distinct.setdefault(word, len(distinct))
    vocabulary = list(distinct)
    counts: dict[str, int] = {}
    for word in vocabulary:
        for f in word_features(word):
            counts[f] = counts.get(f, 0) + 1
    index = {"": 0}
    for f, n in counts.items():
        if n >= 2 if f[0] != "=" else seen_in.get(f[1:], 0) >= LEXICON_TEXTS:
            index[f] = len(index)
    ids, sizes = _feature_ids(vocabulary, index)
    owners = np.repeat(np.arange(len(vocabulary)), sizes)

    width, size = max(len(w) for w, _ in chains), len(languages)
    at, gold = np.zeros((len(chains), width), np.int64), np.zeros((len(chains), width), np.int64)
    mask = np.zeros((len(chains), width), bool)
    for i, (w, y) in enumerate(chains):
        at[i, : len(w)], gold[i, : len(w)], mask[i, : len(w)] = [distinct[x] for x in w], y, True
    model = Model(languages, index, np.zeros((len(index), size)), np.zeros((size, size)), np.zeros(size))
    truth = np.eye(size)[gold] * mask[..., None]
    both = mask[:, 1:]
    pairs = np.zeros((size, size))
    np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
    firsts = np.bincount(gold[:, 0], minlength=size).astype(float)
    total = mask.sum()
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (model.weights, model.transitions, model.start)]
    for t in range(1, steps + 1):
        emission = _sum_rows(model.weights, ids, owners, len(vocabulary))
        node, edge = _expectations(emission[at], mask, model)
        slope = (node - truth) * mask[..., None]
        by_word = np.stack([np.bincount(at.ravel(), slope[..., k].ravel(), len(vocabulary)) for k in range(size)], axis=1)
        grads = (
            np.stack([np.bincount(ids, by_word[owners, k], len(model.weights)) for k in range(size)], axis=1) + 0.5 * model.weights,
            edge - pairs + 0.5 * model.transitions,
            node[:, 0].sum(axis=0) - firsts + 0.5 * model.start,
        )
        for x, g, (m, v) in zip((model.weights, model.transitions, model.start), grads, state, strict=True):
            g = g / total
            if x is model.weights:
                g[0] = 0.0
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return model


def _expectations(scores: np.ndarray, mask: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels (chain, place, language) and expected transitions of padded chains."""
    p = np.where(mask[..., None], np.exp(scores - scores.max(axis=2, keepdims=True)), 1.0)
    step = np.exp(model.transitions - model.transitions.max())
    ahead = np.empty_like(p)
    ahead[:, 0] = _norm(np.exp(model.start - model.start.max()) * p[:, 0], 1)
    for k in range(1, p.shape[1]):
        ahead[:, k] = _norm(np.where(mask[:, k, None], (ahead[:, k - 1] @ step) * p[:, k], ahead[:, k - 1]), 1)
    back = np.ones_like(p)
    edge = np.zeros_like(step)
    for k in reversed(range(p.shape[1] - 1)):
        seen = p[:, k + 1] * back[:, k + 1]
        on = mask[:, k + 1]
        weight = np.where(on, 1 / np.maximum(np.einsum("ni,ij,nj->n", ahead[:, k], step, seen), 1e-300), 0.0)
        edge += step * ((ahead[:, k] * weight[:, None]).T @ seen)
        back[:, k] = _norm(np.where(on[:, None], seen @ step.T, back[:, k + 1]), 1)
    node = ahead * back
    return node / node.sum(axis=2, keepdims=True), edge


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """A field fitted to a bounded sample of the labelled rows of ``docs``; None where there are none.

    The sample has at most TRAIN_TEXTS different texts of each of at most TRAIN_LANGUAGES languages, evenly by text
    hash, and at most TRAIN_WORDS words of each. A warning says where there are more languages.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(TRAIN_LANGUAGES + 1).collect()
    if not counts:
        return None
    if len(counts) > TRAIN_LANGUAGES:
        warnings.warn(f"more than {TRAIN_LANGUAGES} labelled languages: the rarer ones are never predicted", stacklevel=2)
        counts = counts[:TRAIN_LANGUAGES]
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.5 * TRAIN_TEXTS / r["n"]))])
    picked = F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < share[F.col("lang")] * float(1 << 20)
    terms = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))
    sample = (
        rows.where(picked).select("lang", "h", terms.alias("w")).where(F.size("w") > 0)
        .withColumn("at", (F.pmod(F.col("h"), F.greatest(F.lit(1), F.size("w") - TRAIN_WORDS + 1)) + 1).cast("int"))
        .select("lang", "h", F.slice("w", F.col("at"), F.lit(TRAIN_WORDS)).alias("w"))
        .groupBy("lang", "h").agg(F.any_value("w").alias("w"))
        .orderBy(F.xxhash64("h"), "lang").limit(2 * TRAIN_TEXTS * len(counts)).collect()
    )
    taken: dict[str, int] = {}
    samples = []
    for r in sample:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= TRAIN_TEXTS:
            samples.append((r["lang"], list(r["w"])))
    return fit(samples)


# --- prediction ---------------------------------------------------------------------------------------------------


class Reader:
    """Predicts languages of texts; remembers the scores of frequent words."""

    def __init__(self, model: Model):
        self.model, self.known, self.table = model, {}, np.empty((0, len(model.languages)))

    def _ids(self, tokens: list[str]) -> np.ndarray:
        """Rows of ``table`` for all tokens; new words are scored together."""
        known = self.known
        distinct = dict.fromkeys(tokens)
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            self.table, new = self.table[:0], list(distinct)
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.scores(new)])
        return np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and mean probability of each text; ``und`` and 0 for texts without a letter."""
        langs, scores = [], []
        held: list[str] = []
        lengths: list[int] = []

        def flush():
            counts = np.array(lengths, np.int64)
            sums = language_sums(self._ids(held), counts, self.table, self.model)
            for n, row in zip(lengths, sums, strict=True):
                best = int(row.argmax())
                langs.append(self.model.languages[best] if n else UNKNOWN)
                scores.append(min(1.0, float(row[best]) / n) if n else 0.0)
            held.clear()
            lengths.clear()

        for text in texts:
            own = words_of(text)
            held.extend(own)
            lengths.append(len(own))
            if len(held) >= segment(len(self.model.languages)):
                flush()
        if lengths:
            flush()
        return langs, scores


def _predict(shared, at: int, stays: bool):
    """For mapInArrow: languages of the texts in column ``at``, which is handed on or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Later tasks take it over with the words it knows.
        reader = held(shared.value, lambda: Reader(shared.value))
        for batch in batches:
            for start, n in text_slices(batch.column(at)):
                part = batch.slice(start, n)
                langs, scores = reader.predict(part.column(at).to_pylist())
                kept = part if stays else part.select([i for i in range(part.num_columns) if i != at])
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    [*kept.schema.names, "lang_pred", "lang_score"])

    return run


def identify(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with ``lang_pred`` and ``lang_score``, in place of columns of those names.

    The score is the language's mean probability over all words. NULL, empty and other texts without a letter, and all
    texts where no model could be fitted, are ``und`` with score 0. Equal texts get equal answers; repeated rows stay.
    Rows stay where they are; only the model is sent to the tasks, and its size is bounded by the fit's sample.
    """
    keep = [k for k in keep if k not in ("lang_pred", "lang_score")]
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("lang_score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    stays = text in keep
    rows = docs.select(*keep) if stays else docs.select(*keep, F.col(text).alias("_text"))
    fields = rows.schema.fields if stays else rows.schema.fields[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    predict = _predict(shared, keep.index(text) if stays else len(keep), stays)
    return rows.mapInArrow(predict, f"{schema + ', ' if schema else ''}lang_pred string, lang_score double")


def held_out(doc_id: str = "doc_id"):
    """Rows that the fit never sees."""
    return remainder(F.col(doc_id), 4) == 2


def rejected(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             contradicted: float = CONTRADICTED, languages: list[str] | None = None) -> DataFrame:
    """``_id, _t``: id and text key of the rows that ``keep_known`` drops. Only ids and texts go through the field."""
    narrow = docs.select(F.col(doc_id).alias("_id"), text_key(F.col(text)).alias("_t"), F.col(lang).cast("string").alias("_lang"), F.col(text).alias("text"))
    found = identify(narrow, model, ["_id", "_t", "_lang"])
    unwanted = F.col("lang_pred") == UNKNOWN
    if model is not None:
        unwanted |= F.col("_lang").isNotNull() & (F.col("_lang") != F.col("lang_pred")) & (F.col("lang_score") >= contradicted)
    if languages is not None:
        unwanted |= ~F.col("lang_pred").isin(languages)
    return found.where(unwanted).select("_id", "_t", "_lang").distinct()


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", contradicted: float = CONTRADICTED,
               languages: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` in a recognised language, with their columns.

    Rejected are texts without a letter, and rows whose declared language is another than the one that the field finds with a
    mean probability of ``contradicted`` or more: a text that mixes languages evenly, or an uncertain one, stays. With
    ``languages`` texts found to be in any other language go, too. Rows with a NULL id or label are judged like others; repeated
    rows share their answer. Where ``docs`` has no labelled row nothing can be recognised and all rows with a letter stay.
    """
    model = train(docs.where(~held_out(doc_id)), text, lang)
    if model is None:
        return docs.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    gone = small(materialise(rejected(docs, model, doc_id, text, lang, contradicted, languages), "rejected"))
    rows = docs.select(
        F.struct("*").alias("_row"), F.col(doc_id).alias("_own_id"), text_key(F.col(text)).alias("_own_t"), F.col(lang).cast("string").alias("_own_lang"))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_t") == F.col("_t")) & F.col("_own_lang").eqNullSafe(F.col("_lang"))
    return rows.join(gone, same, "left_anti").select("_row.*")
