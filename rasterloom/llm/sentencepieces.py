"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The search reads a text character by character. Every position keeps the piece that ends its best path, so paths are
chains of back pointers; only positions less than the longest piece away can still be extended. When the chains of all
these have one boundary in common, everything before it is decided: its ids are committed and its characters forgotten.

For a merge vocabulary (``rule="merges"``) the best path is the one that merging yields: a sequence of pieces is the
result of merging exactly if each two neighbours, merged on their own, come out as the same two pieces. So a piece may
follow the piece that ends the path before it only if the pair is stable, and one path per position remains. For a
vocabulary with piece probabilities (``rule="scores"``) the path of the greatest sum of scores is the best.

Texts are cut where no piece goes on, and of a batch each short chunk that isn't known yet is searched once: the same
search, position by position, over the chunks of a whole block (``_Block``). Longer chunks are streamed.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Chunks, and pairs of pieces, that a worker remembers at most; longer chunks aren't remembered.
REMEMBERED = 300_000
REMEMBERED_CHARS = 48
#: Beginnings that a worker remembers at most; each holds lists.
REMEMBERED_PREFIXES = 40_000
#: Beginnings of so many characters whose search is remembered: paths up to there depend on nothing that follows.
PREFIXES = (7, 5)
#: Characters that are searched together, and the binary logarithm of the pairs of pieces held in an array.
BLOCK_CHARS = 1 << 18
PAIR_BITS = 20


@dataclass
class Vocabulary:
    """Pieces with id and score, the ids of the 256 bytes, and how paths are chosen. Small: it goes to every task."""

    pieces: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    rule: str = "merges"
    unknown_score: float = -1e4
    longest: int = field(init=False)

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)


def read_vocabulary(model: str = MODEL, rule: str = "merges") -> Vocabulary:
    """The ordinary pieces and byte pieces of a model file, read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(sp.get_piece_size())
    byte_ids = [i for i in ids if sp.is_byte(i)]
    plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return Vocabulary({sp.id_to_piece(i): i for i in plain}, {sp.id_to_piece(i): sp.get_score(i) for i in plain}, byte_ids, rule)


class Encoder:
    """Encodes and decodes texts; remembers frequent chunks."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.stable: dict[str | None, dict[str, bool]] = {}
        self.n_stable = 0
        self.prefixes: dict[str, tuple[list, list]] = {}
        ends: dict[str, set[int]] = {}
        for p in vocabulary.pieces:
            if len(p) > 2:
                ends.setdefault(p[-3:], set()).add(len(p))
        #: Lengths of the pieces with these last three characters, longest first.
        self.sizes = {e: (*sorted(n, reverse=True), 2, 1) for e, n in ends.items()}
        inside = any(SPACE in p.lstrip(SPACE) for p in vocabulary.pieces)
        #: No piece goes on from another character to a space, so every path has a boundary there.
        self.cut = None if inside else re.compile(" *[^ ]+| +")
        if self.cut and (marks := _apart(vocabulary.pieces)):
            marks = "".join(f"\\{c}" for c in marks)
            self.cut = re.compile(f" *(?:[^ {marks}]+|[{marks}]+)| +")
        self.block = _Block(self) if vocabulary.rule == "merges" else None
        self.texts = dict.fromkeys(vocabulary.byte_ids, b"") | {i: p.replace(SPACE, " ").encode() for p, i in vocabulary.pieces.items()}
        self.texts |= {i: bytes([n]) for n, i in enumerate(vocabulary.byte_ids)}

    def merged(self, text: str) -> list[str]:
        """A short text's pieces by merging: always the pair of greatest score, the leftmost of equals."""
        parts, scores = list(text), self.v.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, a: str | None, b: str) -> bool:
        """Whether ``a`` and ``b`` stay two pieces when merged on their own; without ``a``, whether ``b`` comes out whole."""
        if self.n_stable >= REMEMBERED:
            self.stable, self.n_stable = {}, 0
        self.n_stable += 1
        found = self.merged(b) == [b] if a is None else self.merged(a + b) == [a, b]
        self.stable.setdefault(a, {})[b] = found
        return found

    def _advance(self, held: str, back: list[str | None], sums: list[float]) -> None:
        """Adds the best path's last piece (and its sum) for each further position of ``held``."""
        pieces, scores, sizes, none = self.v.pieces, self.v.scores, self.sizes, {}
        merges, unknown = self.v.rule == "merges", self.v.unknown_score
        begins = len(back) == 1 and back[0] is None
        if begins:
            for size in PREFIXES:
                if len(held) >= size and (state := self.prefixes.get(held[:size])):
                    back[:], sums[:] = state
                    break
        from_here = len(back)
        for end in range(len(back), len(held) + 1):
            best, total = None, None
            for size in sizes.get(held[end - 3 : end] if end >= 3 else "", (2, 1)):
                start = end - size
                if start < 0:
                    continue
                piece = held[start:end]
                if size > 1 and piece not in pieces:
                    continue
                if merges:
                    before = back[start]
                    stays = self.stable.get(before, none).get(piece)
                    if stays or stays is None and self._follows(before, piece):
                        best = piece
                        break
                    continue
                value = sums[start] + scores.get(piece, unknown)
                if total is None or value >= total:
                    best, total = piece, value
            back.append(best)
            sums.append(total or 0.0)
        if begins:
            for size in PREFIXES:
                if from_here <= size <= len(held):
                    if len(self.prefixes) >= REMEMBERED_PREFIXES:
                        self.prefixes.clear()
                    self.prefixes[held[:size]] = (back[: size + 1], sums[: size + 1])

    def search(self, characters: Iterable[str]) -> Iterator[str]:
        """Pieces of a stream of characters, given out as soon as a window's length shows that they are decided."""
        stream, longest = iter(characters), self.v.longest
        held, back, sums = "", [None], [0.0]  # back[j]: the piece that ends the best path to j, or the piece before held
        while block := "".join(islice(stream, 3 * longest)):
            held += block
            self._advance(held, back, sums)
            if len(held) >= 4 * longest and (decided := self._common(back, len(held))):
                yield from self._path(back, decided)
                held, back, sums = held[decided:], back[decided:], sums[decided:]
        yield from self._path(back, len(held))

    def _common(self, back: list[str | None], end: int) -> int:
        """The last boundary that the paths to all extendable positions share."""
        shared = None
        for live in range(end - self.v.longest + 1, end + 1):
            if back[live] is None:
                continue
            at, own = live, {live}
            while at:
                at -= len(back[at])
                own.add(at)
            shared = own if shared is None else shared & own
        return max(shared or {0})

    @staticmethod
    def _path(back: list[str | None], end: int) -> list[str]:
        found = []
        while end:
            found.append(back[end])
            end -= len(back[end])
        return found[::-1]

    def ids(self, characters: Iterable[str]) -> Iterator[int]:
        for piece in self.search(characters):
            known = self.v.pieces.get(piece)
            if known is not None:
                yield known
            else:
                yield from (self.v.byte_ids[b] for b in piece.encode())

    def _one(self, chunk: str) -> bytes:
        chunk = chunk.replace(" ", SPACE)
        if not len(chunk) <= REMEMBERED_CHARS < 4 * self.v.longest:
            return array("i", self.ids(chunk)).tobytes()
        # Shorter than the window of the search: one step of it, without the stream around.
        back: list[str | None] = [None]
        self._advance(chunk, back, [0.0])
        known, ids = self.v.pieces, []
        for piece in self._path(back, len(chunk)):
            if (i := known.get(piece)) is not None:
                ids.append(i)
            else:
                ids += (self.v.byte_ids[b] for b in piece.encode())
        return array("i", ids).tobytes()

    def _search_all(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks, short ones searched together."""
        found, block, size = {}, [], 0
        for chunk in chunks:
            if self.block is None or len(chunk) > REMEMBERED_CHARS:
                found[chunk] = self._one(chunk)
                continue
            block.append(chunk)
            size += len(chunk)
            if size >= BLOCK_CHARS:
                found.update(self.block.search(block))
                block, size = [], 0
        if block:
            found.update(self.block.search(block))
        return found

    def _remember(self, chunk: str, ids: bytes) -> None:
        """Keeps a chunk; those not asked for since the last time the memory was half full are forgotten."""
        if len(self.chunks) >= REMEMBERED // 2:
            self.chunks, self.older = {}, self.chunks
        self.chunks[chunk] = ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. A space is put in front, and spaces are the character U+2581, as the model has it."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; chunks that several texts hold are looked up or searched once."""
        # Chunks have plain spaces, which keep most strings at a byte a character; U+2581 comes in when they are searched.
        lines = [" " + t.replace(SPACE, " ") if t else "" for t in texts]
        if self.cut is None:
            return [np.fromiter(self.ids(line.replace(" ", SPACE)), np.int32) for line in lines]
        cut = [self.cut.findall(line) for line in lines]
        fresh, new = {}, []
        for chunk in set().union(*cut).difference(self.chunks):
            if (ids := self.older.get(chunk)) is None:
                new.append(chunk)
            else:
                fresh[chunk] = ids
        fresh.update(self._search_all(new))
        known = self.chunks
        known.update(fresh)
        found = [np.frombuffer(b"".join(map(known.__getitem__, line)), np.int32) for line in cut]
        for chunk in fresh:
            del known[chunk]
        for chunk, ids in fresh.items():
            if len(chunk) <= REMEMBERED_CHARS:
                self._remember(chunk, ids)
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space put in front."""
        line = b"".join(map(self.texts.__getitem__, ids.tolist())).decode(errors="replace")
        return line[1:] if line.startswith(" ") else line


def _apart(pieces: Iterable[str]) -> list[str]:
    """Marks (ASCII, neither letters nor digits) that no piece joins to a character other than such marks, or a space before them."""
    pairs = {xy for p in pieces for xy in zip(p, p[1:]) if SPACE not in xy}
    marks = {chr(i) for i in range(128) if not chr(i).isalnum() and chr(i) != " "}
    while joined := {c for x, y in pairs if (x in marks) != (y in marks) for c in (x, y)} & marks:
        marks -= joined
    return sorted(marks)


class _Block:
    """The search for a vocabulary of merges over many short chunks at a time, as arrays.

    Pieces are numbers; ``none`` stands for the beginning, and for a character without a piece, as nothing merges with either.
    Steps go through the pieces' beginnings, which are numbers too: ``keys`` has those of (beginning, character).
    """

    def __init__(self, encoder: Encoder):
        self.encoder, self.names = encoder, list(encoder.v.pieces)
        self.none = len(self.names)
        self.ids = np.array([*encoder.v.pieces.values(), -1], np.int32)
        self.letters = np.array(sorted({ord(c) for p in self.names for c in p}), np.uint32)
        code = {chr(c): i for i, c in enumerate(self.letters.tolist())}
        self.width = len(code) + 1  # the last code is for characters of no piece
        steps, ends = {}, {}
        for n, piece in enumerate(self.names):
            at = 0
            for c in piece:
                at = steps.setdefault(at * self.width + code[c], len(steps) + 1)
            ends[at] = n
        self.keys, order = np.unique(np.fromiter(steps, np.int64, len(steps)), return_index=True)
        self.after = np.fromiter(steps.values(), np.int64, len(steps))[order]
        self.ends = np.full(len(steps) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        self.pairs, self.stays = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def _stable(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether pieces may follow those before them; pairs that aren't in the array are asked for once each."""
        keys = before * (self.none + 1) + piece
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        stays = self.stays[slots]
        missing = np.flatnonzero(self.pairs[slots] != keys)
        if missing.size:
            asked, first, place = np.unique(keys[missing], return_index=True, return_inverse=True)
            told = np.array([self._asked(*divmod(k, self.none + 1)) for k in asked.tolist()], bool)
            stays[missing] = told[place]
            self.pairs[slots[missing[first]]], self.stays[slots[missing[first]]] = asked, told
        return stays

    def _asked(self, before: int, piece: int) -> bool:
        if piece == self.none:
            return True
        a, b = None if before == self.none else self.names[before], self.names[piece]
        known = self.encoder.stable.get(a, {}).get(b)
        return self.encoder._follows(a, b) if known is None else known

    def _candidates(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a piece may end, its size and number, in order of end and from long to short; ``left`` has the characters up to a chunk's end."""
        at, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found = []
        for size in range(1, self.encoder.v.longest + 1):
            keys = state * self.width + codes[at + size - 1]
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[place] == keys
            piece = np.where(hit, self.ends[self.after[place]], -1)
            if size == 1:
                piece[piece < 0] = self.none
            whole = piece >= 0
            found.append((at[whole] + size, np.full(np.count_nonzero(whole), size), piece[whole]))
            hit &= left[at] > size
            at, state = at[hit], self.after[place[hit]]
            if not at.size:
                break
        end, size, piece = (np.concatenate(x) for x in zip(*reversed(found)))
        order = np.argsort(end, kind="stable")
        return end[order], size[order], piece[order]

    def search(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """Chunks with their ids."""
        chunks = sorted(chunks, key=len, reverse=True)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(sizes) - sizes
        letters = np.frombuffer("".join(chunks).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.minimum(np.searchsorted(self.letters, letters), len(self.letters) - 1)
        codes = np.where(self.letters[codes] == letters, codes, self.width - 1)
        end, size, piece = self._candidates(codes, np.repeat(starts + sizes, sizes) - np.arange(len(codes)))
        first = np.searchsorted(end, np.arange(len(codes) + 1))  # the longest candidate that ends at a position
        # The candidate chosen for the position before each character's end; positions count from 1 in a chunk.
        chosen = np.zeros(len(codes) + 1, np.int64)
        for j in range(1, len(chunks[0]) + 1):
            active = starts[: np.searchsorted(-sizes, -j, side="right")]
            open_, now = active + j, first[active + j]
            while open_.size:
                before = open_ - size[now]
                previous = np.where(before == open_ - j, self.none, piece[chosen[before]])
                stays = self._stable(previous, piece[now])
                chosen[open_[stays]] = now[stays]
                open_, now = open_[~stays], now[~stays] + 1
        used = np.zeros(len(codes) + 1, bool)
        at, begin = starts + sizes, starts
        while at.size:
            used[at] = True
            at = at - size[chosen[at]]
            more = at > begin
            at, begin = at[more], begin[more]
        path = piece[chosen[np.flatnonzero(used)]]
        bounds = np.cumsum(used)[starts + sizes].tolist()
        ids, odd = self.ids[path].tobytes(), set((np.searchsorted(bounds, np.flatnonzero(path == self.none), side="right")).tolist())
        last = 0
        for n, (chunk, bound) in enumerate(zip(chunks, bounds)):
            yield chunk, self.encoder._one(chunk) if n in odd else ids[4 * last : 4 * bound]
            last = bound


def _encode(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Later tasks take it over with the chunks it knows.
        encoder = held(vocabulary.value, lambda: Encoder(vocabulary.value))
        for whole in batches:
            for start, n in text_slices(whole.column(0)):
                batch = whole.slice(start, n)
                found = encoder.encode_all([t or "" for t in batch.column(0).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64))).astype(np.int32)
                decoded = [encoder.decode(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found))), pa.array(decoded, pa.string())],
                    [*batch.schema.names[1:], "ids", "decoded"])

    return run


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with ``ids`` (array) and ``decoded``, the text that the ids give back.

    NULL and empty texts have no ids and decode to the empty text. The character U+2581 in a text is taken for a space.
    Characters without a piece are encoded as the bytes of UTF-8. Rows stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(text).alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_encode(shared), f"{schema + ', ' if schema else ''}ids array<int>, decoded string")
