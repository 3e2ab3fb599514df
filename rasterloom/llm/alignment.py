"""Alignment of two tokenizers over a corpus.

The byte offsets at which tokens of both tokenizers end cut a text into groups. Most groups are one token of each side with
the same bytes. For these an array made beforehand gives the B id of each A id, so they are told by one look-up and their
documents are counted in a vector as long as the vocabulary. Only links of other groups are exploded, shuffled and
counted by pair.

Both tokenizers break a text before a space that follows a character other than white space, so a text is aligned chunk by chunk, and a
worker remembers what it knows of chunks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import held, small

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Chunks that a worker remembers at most, checked before each document; longer ones aren't remembered.
REMEMBERED = 300_000
REMEMBERED_CHARS = 48
#: Characters of longer chunks at which their results are dropped.
LONG_CHARS = 4 << 20
#: Group texts are handed on in batches of about this many characters.
BATCH_CHARS = 8 << 20
#: Splits a text before a space that follows another character than white space.
CUT = re.compile(r"(?<=\S)(?= )")
#: Fixed value: how the byte-level vocabulary splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for the bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Models:
    """What workers need of both tokenizers: A's tokens as bytes by id, B's model file. Small: goes to every task."""

    ranks: dict[bytes, int]
    model_b: bytes
    size: int


def read_models(model_a: str = MODEL_A, model_b: str = MODEL_B) -> Models:
    """Reads both files on the driver. A's merges must have rising ids, as its search takes the lowest id first."""
    with open(model_a, encoding="utf-8") as file:
        whole = json.load(file)
    if whole["model"]["type"] != "BPE" or whole["pre_tokenizer"]["type"] != "ByteLevel" or whole.get("normalizer"):
        raise ValueError(f"{model_a}: not a byte-level merge vocabulary")
    vocabulary, letters = whole["model"]["vocab"], byte_letters()
    merges = [m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"]]
    rising = [vocabulary[a + b] for a, b in merges]
    if rising != sorted(rising):
        raise ValueError(f"{model_a}: ids don't rise with the merges")
    special = {t["content"] for t in whole.get("added_tokens", ())}
    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    with open(model_b, "rb") as file:
        return Models(ranks, file.read(), max(vocabulary.values()) + 1)


def _segments(pool: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parts of ``pool`` that begin at ``first``, one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Pool:
    """Arrays of different lengths, one after the other in one growing array."""

    def __init__(self, kind: type):
        self.values, self.first, self.sizes, self.n, self.used = np.empty(4096, kind), np.empty(1024, np.int64), np.empty(1024, np.int64), 0, 0

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        def room(old: np.ndarray, n: int) -> np.ndarray:
            return old if n <= len(old) else np.concatenate((old, np.empty(max(n - len(old), len(old)), old.dtype)))

        n, used = self.n + len(sizes), self.used + len(values)
        self.values, self.first, self.sizes = room(self.values, used), room(self.first, n), room(self.sizes, n)
        self.values[self.used : used] = values
        self.sizes[self.n : n] = sizes
        self.first[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = n, used

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of these arrays one after the other, and their sizes."""
        sizes = self.sizes[rows]
        return _segments(self.values, self.first[rows], sizes), sizes

    def keep(self, rows: np.ndarray) -> None:
        values, sizes = self.of(rows)
        self.__init__(self.values.dtype.type)
        self.append(values, sizes)


class Aligner:
    """Aligns texts; remembers chunks.

    The chunks of a text that aren't known yet are put together and aligned as one text, as both tokenizers break
    between chunks anyway.
    """

    def __init__(self, models: Models):
        import sentencepiece
        import tiktoken

        self.models = models
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=models.ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=models.model_b)
        ids = range(self.b.get_piece_size())
        pieces = [self.b.id_to_piece(i) for i in ids]
        self.bytes_a = {i: t for t, i in models.ranks.items()}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(models.size)])
        self.sizes_b = np.array([len(x) for x in self.bytes_b])
        # Of several B ids with the same bytes the ordinary piece counts, not the byte.
        plain = {self.bytes_b[i]: i for i in ids if self.b.is_byte(i)}
        plain |= {self.bytes_b[i]: i for i in ids if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))}
        #: The identity map: for each A id the B id of the same bytes, or -1.
        self.same = np.full(models.size, -1)
        for token, i in models.ranks.items():
            self.same[i] = plain.get(token, -1)
        self.printed = [f"{i}|{b}" for i, b in enumerate(self.same.tolist())]
        self.first_b = self.b.piece_to_id(SPACE)
        # No piece of B goes on from another character to a space.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.texts: list[str] = []
        #: Per chunk: ``n_a, n_b, n_groups, n_links``, whether it has no tokens, and how often it was asked for.
        self.stats, self.seen = np.zeros((1024, 5), np.int64), np.zeros(1024, np.int64)
        self.same_ids, self.pairs, self.long = Pool(np.int32), Pool(np.int64), 0

    def _thin(self) -> None:
        """Keeps the half of the remembered chunks that was asked for most."""
        chunks, at = list(self.places), np.fromiter(self.places.values(), np.int64, len(self.places))
        order = np.argsort(-self.seen[at], kind="stable")[: REMEMBERED // 2]
        rows = at[order]
        self.places = {chunks[k]: i for i, k in enumerate(order.tolist())}
        self.texts = [self.texts[i] for i in rows.tolist()]
        self.stats, self.seen = self.stats[rows], self.seen[rows] // 2
        self.same_ids.keep(rows)
        self.pairs.keep(rows)
        self.long = 0

    def _learn(self, chunks: list[str]) -> None:
        """Aligns new chunks, each of which begins with a space, and appends what it finds to the lists."""
        line = "".join(chunks)
        raw = line.encode()
        a, b = self.a.encode_ordinary(line), self.b.encode(line[1:]) if len(line) > 1 else [self.first_b]
        sound = b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
        if sound:
            ids_a, ids_b = np.array(a), np.array(b)
            ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
            ends = np.cumsum([len(c) for c in chunks] if len(raw) == len(line) else [len(c.encode()) for c in chunks])
            last_a, last_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
            if (ends_a[last_a] != ends).any() or (ends_b[last_b] != ends).any():
                raise ValueError("a token reaches over the end of a chunk")
        elif len(chunks) > 1:
            for chunk in chunks:
                self._learn([chunk])
            return
        else:
            self._append(chunks, [""], np.array([[0, 0, 0, 0, 1]]), (np.empty(0, np.int32), [0]), (np.empty(0, np.int64), [0]))
            return
        # Between two neighbouring ends of any side lies one link; a group ends where both sides do.
        cuts = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        link_a, link_b = ids_a[at_a], ids_b[at_b]
        same = self.same[link_a] == link_b
        group = np.flatnonzero((ends_a[at_a] == cuts) & (ends_b[at_b] == cuts))
        alone = np.diff(group, prepend=-1) == 1
        regular = alone & same[group]
        texts = [*map(self.printed.__getitem__, link_a[group].tolist())]
        begin_a, begin_b = np.concatenate(([0], at_a[group][:-1] + 1)), np.concatenate(([0], at_b[group][:-1] + 1))
        rest = np.flatnonzero(~regular)
        for g, i, j, k, m in zip(*(x[rest].tolist() for x in (np.arange(len(group)), begin_a, at_a[group] + 1, begin_b, at_b[group] + 1)), strict=True):
            texts[g] = f"{str(a[i:j])[1:-1]}|{str(b[k:m])[1:-1]}".replace(" ", "") if j - i > 1 or m - k > 1 else f"{a[i]}|{b[k]}"
        last_link, last_group = np.searchsorted(cuts, ends) + 1, np.searchsorted(cuts[group], ends) + 1
        since = lambda last: np.diff(last, prepend=0)
        upto = np.concatenate(([0], np.cumsum(same)))[last_link]
        stats = np.stack((since(last_a + 1), since(last_b + 1), since(last_group), since(last_link), np.zeros(len(chunks), np.int64)), axis=1)
        joined, begin = [], 0
        for end in last_group.tolist():
            joined.append(";".join(texts[begin:end]) if end - begin > 1 else texts[begin])
            begin = end
        pairs = link_a[~same].astype(np.int64) << 32 | link_b[~same]
        self._append(chunks, joined, stats, (link_a[same].astype(np.int32), since(upto)), (pairs, since(last_link - upto)))

    def _append(self, chunks: list[str], texts: list[str], stats: np.ndarray, same: tuple, pairs: tuple) -> None:
        at, n = len(self.texts), len(self.texts) + len(chunks)
        if n > len(self.stats):
            more = max(n - len(self.stats), len(self.stats))
            self.stats, self.seen = np.concatenate((self.stats, np.zeros((more, 5), np.int64))), np.concatenate((self.seen, np.zeros(more, np.int64)))
        self.stats[at:n] = stats
        self.texts += texts
        self.same_ids.append(same[0], np.asarray(same[1]))
        self.pairs.append(pairs[0], np.asarray(pairs[1]))
        self.places |= zip(chunks, range(at, n), strict=True)

    def align(self, text: str):
        """``(n_a, n_b, n_groups, n_links), groups, same, same_n, pairs, pair_n`` of a text; None if it has no tokens."""
        if not text:
            return None
        if len(self.texts) >= REMEMBERED or self.long >= LONG_CHARS:
            self._thin()
        chunks = CUT.split(" " + text) if self.cuts else [" " + text]
        # The last chunk alone can end with white space, so it stays last. Each unknown chunk is learnt once.
        if new := [c for c in dict.fromkeys(chunks) if c not in self.places]:
            if new[-1] != chunks[-1] and chunks[-1] in new:
                new.remove(chunks[-1])
                new.append(chunks[-1])
            self._learn(new)
        places = [*map(self.places.__getitem__, chunks)]
        once, n = np.unique(np.array(places), return_counts=True)
        self.seen[once] += n
        totals = n @ self.stats[once]
        for chunk in new:
            if len(chunk) > REMEMBERED_CHARS:
                del self.places[chunk]
                self.long += len(chunk)
        if totals[4]:
            return None
        same, pairs = (_summed(values, np.repeat(n, sizes)) for values, sizes in (self.same_ids.of(once), self.pairs.of(once)))
        return totals[:4], ";".join(map(self.texts.__getitem__, places)), *same, *pairs


def _summed(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids with the sum of their ``n``."""
    once, at = np.unique(ids, return_inverse=True)
    return once, np.bincount(at, n, len(once)).astype(np.int32)


NOTHING = (np.zeros(4, np.int64), "", *[np.empty(0, t) for t in (np.int32, np.int32, np.int64, np.int32)])


def _align(models):
    """For mapInArrow over (text, …): the other columns and what ``Aligner.align`` finds."""

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Later tasks take it over with the chunks it knows.
        aligner = held(models.value, lambda: Aligner(models.value))
        for batch in batches:
            first, found, chars = 0, [], 0
            for row, text in enumerate(batch.column(0)):
                found.append(aligner.align(text.as_py() or "") or NOTHING)
                chars += len(found[-1][1])
                if chars < BATCH_CHARS and row + 1 < batch.num_rows:
                    continue
                totals, groups, *rest = zip(*found, strict=True)
                numbers = [pa.array(np.array([t[k] for t in totals])) for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, len(found)) for c in batch.columns[1:]), *numbers, pa.array(groups, pa.string()), *map(lists, rest)],
                    [*batch.schema.names[1:], "n_a", "n_b", "n_groups", "n_links", "groups", "same", "same_n", "pairs", "pair_n"])
                first, found, chars = row + 1, [], 0

    return run


def _vector(size: int):
    """For mapInArrow over (same): how many documents of the task hold each A id linked to the B id of the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["a_id", "documents"])

    return run


def _weighed(vectors):
    """For mapInArrow over (key, same, same_n): ``key, count_sum, n_best`` of the links between tokens of the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = vectors.value
        for batch in batches:
            column = batch.column(1)
            ids, n = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums[0], rows, n * counts[ids])
            np.add.at(sums[1], rows, n * (counts[ids] == best[ids]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], ["key", "count_sum", "n_best"])

    return run


@dataclass
class Alignment:
    """``rows``: per document its id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups``. ``pairs``: the irregular
    links of the corpus, ``pair`` (``a << 32 | b``), ``documents``, ``best``. ``same``: the same of links between tokens of
    equal bytes, as two vectors by A id: documents, and the greatest number among all links of the A id."""

    rows: DataFrame
    pairs: DataFrame
    same: tuple[np.ndarray, np.ndarray]


def align(
    docs: DataFrame, models: Models | None = None, doc_id: str = "doc_id", text: str = "text",
    groups: Callable[[Column], Column] = lambda g: g,
) -> Alignment:
    """Aligns every row's whole text; all rows are answered.

    A encodes a space and the text, B the text, to which it adds the space; names of special tokens in a text are plain text. Texts that
    are NULL or empty, or whose tokens don't give back the text's bytes, have no tokens: zeros and empty ``groups``.
    Otherwise ``groups`` is that function of ``a1,a2|b1;a3|b2``. A link is an A and a B token that overlap; its count is the
    number of rows that hold such a pair, each row being a document, whatever its id. ``n_best`` are the links whose count is
    the greatest of their A id. Columns besides id and text don't matter.
    """
    spark = docs.sparkSession
    models = models or read_models()
    shared = spark.sparkContext.broadcast(models)
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    aligned = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id")).mapInArrow(_align(shared), (
        f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, same array<int>, same_n array<int>, "
        "pairs array<bigint>, pair_n array<int>"))
    # Every row is written under a key of its own, as ids may repeat.
    aligned = materialise(aligned.withColumn("groups", groups(F.col("groups"))).withColumn("key", F.monotonically_increasing_id()), "aligned")
    a_id = F.shiftright("pair", 32).cast("int").alias("a_id")
    counted = materialise(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents")), "pairs")
    # Both vectors are as long as A's vocabulary.
    counts, best = np.zeros(models.size, np.int64), np.zeros(models.size, np.int64)
    for r in aligned.select("same").mapInArrow(_vector(models.size), "a_id int, documents bigint").groupBy("a_id").agg(F.sum("documents").alias("n")).collect():
        counts[r["a_id"]] = best[r["a_id"]] = r["n"]
    greatest = counted.groupBy(a_id).agg(F.max("documents").alias("n")).collect()
    for r in greatest:
        best[r["a_id"]] = max(best[r["a_id"]], r["n"])
    tops = spark.createDataFrame([(r["a_id"], int(best[r["a_id"]])) for r in greatest], "a_id int, top bigint")
    pairs = counted.withColumn("a_id", a_id).join(F.broadcast(tops), "a_id").select("pair", "documents", (F.col("documents") == F.col("top")).cast("int").alias("best"))
    links = aligned.select("key", F.inline(F.arrays_zip("pairs", "pair_n"))).withColumnRenamed("pairs", "pair")
    irregular = links.join(small(pairs), "pair").groupBy("key").agg(
        F.sum(F.col("pair_n") * F.col("documents")).alias("_sum"), F.sum(F.col("pair_n") * F.col("best")).alias("_best"))
    vectors = spark.sparkContext.broadcast((counts, best))
    regular = aligned.select("key", "same", "same_n").mapInArrow(_weighed(vectors), "key bigint, count_sum bigint, n_best bigint")
    rows = aligned.drop("same", "same_n", "pairs", "pair_n").join(regular, "key").join(irregular, "key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups")
    return Alignment(rows, pairs, (counts, best))
