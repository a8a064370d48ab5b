"""Byte-pair encoding and decoding with a given vocabulary.

A text is encoded piece by piece. Special tokens are cut out first, then the text is normalised
and split into words as the vocabulary file says. Within a word, two neighbouring bytes that
stand side by side in no vocabulary token can never be merged, nor can anything across them: there
the word is cut for certain. The fragments between these cuts are encoded on their own, by lowest
merge rank and leftmost first, and their ids are joined. Texts are handled many at a time: they are cut into words as one array of
characters, each different word is encoded once, and its ids are copied to all its places.

A vocabulary is a file of bounded size (``MAX_VOCABULARY_BYTES``), read on the driver and broadcast.

Defined results: null and empty texts have no ids and decode to the empty text; ids outside the
vocabulary are skipped when decoding. Rows are handled one by one, so repeated rows, ties and other
columns don't matter. A column that has the name of an output is replaced.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rateweave.llm.common import with_python_columns

MAX_VOCABULARY_BYTES = 64 << 20
#: Characters that are encoded together, and bytes of rows that a task takes at a time for it. They bound memory only.
RUN_CHARACTERS = 1 << 22
RUN_BYTES = 4 << 20
#: Words and pieces between blanks of texts with unusual characters whose ids a task remembers. The memory is bounded; what is forgotten is encoded again.
REMEMBERED_WORDS = 1 << 19
REMEMBERED_PIECES = 1 << 18
#: Below this code point, NFC leaves every character alone, and lower case is the same everywhere.
PLAIN_BELOW = 0x180
#: Fragments of this many symbols are merged one by one with a heap, shorter ones side by side. Both merge alike.
HEAP_FROM = 64
NO_MERGE = 1 << 62
#: Characters that need the tokenizers library's own tables, and those that mark the ends of texts, which must not be in one.
UNUSUAL = f"[\x1c-\x1f\u0130{chr(PLAIN_BELOW)}-\U0010ffff]"
END = "\x1c"
BLANK, LETTER, NUMBER, OTHER = range(4)
#: Normal forms and lower case never reach across these.
BLANKS = re.compile("[\t-\r ]+")
SPACES = "\t\n\x0b\x0c\r \x85\xa0"
SUFFIX = "</w>"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def kinds() -> np.ndarray:
    """The kind of each character below ``PLAIN_BELOW`` in the file's word pattern."""
    kind = {"L": LETTER, "N": NUMBER}
    return np.array([BLANK if c in SPACES + END else kind.get(unicodedata.category(c)[0], OTHER) for c in map(chr, range(PLAIN_BELOW))], np.uint8)


def word_starts(text: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the words of lower-case characters begin, by the file's word pattern; two blanks must stand at the end.

    A word is a run of letters, one number or a run of other characters; an apostrophe on its own takes some letters after it along.
    """
    first = (np.diff(kind, prepend=BLANK) != 0) | (kind == NUMBER)
    at = np.flatnonzero(first & (text == ord("'")))
    after, second = text[at + 1], text[np.minimum(at + 2, len(text) - 1)]
    one = np.isin(after, [*map(ord, "stmd")])
    two = (np.isin(after, [*map(ord, "rv")]) & (second == ord("e"))) | ((after == ord("l")) & (second == ord("l")))
    first[at[one | two] + 1] = False
    for short, length in ((one, 2), (two, 3)):
        end = at[short] + length
        first[end] |= kind[end] == LETTER
    return np.flatnonzero(first & (kind != BLANK))


class PairTable:
    """Merge ranks by pair of ids, looked up for whole arrays.

    Pairs are kept in a table by hash; the few whose place is taken go to a second table under a hash without clashes.
    """

    def __init__(self, ranks: dict[tuple[int, int], int]):
        pairs = np.array(list(ranks), np.uint64).reshape(-1, 2)
        keys, values = self.key(pairs[:, 0], pairs[:, 1]), np.fromiter(ranks.values(), np.int64)
        self.tables = []
        factor = 0x9E3779B97F4A7C15
        while len(keys):
            shift = np.uint64(64 - max(10, int(len(keys)).bit_length() + 4))
            places = (keys * np.uint64(factor)) >> shift
            _, first = np.unique(places, return_index=True)
            size = 1 << (64 - int(shift))
            held, found = np.zeros(size, np.uint64), np.full(size, NO_MERGE, np.int64)
            held[places[first]], found[places[first]] = keys[first], values[first]
            self.tables.append((np.uint64(factor), shift, held, found))
            keys, values = np.delete(keys, first), np.delete(values, first)
            factor = (factor * 0xD1342543DE82EF95 + 1) % (1 << 64) | 1

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) + np.uint64(1))

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, out = self.key(left, right), np.full(len(left), NO_MERGE, np.int64)
        for factor, shift, held, found in self.tables:
            places = (keys * factor) >> shift
            hit = held[places] == keys
            out[hit] = found[places[hit]]
        return out


class Bpe:
    """Encoder and decoder for one vocabulary file (JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != SUFFIX or spec["decoder"] is not None:
            raise ValueError("only byte-level BPE vocabularies with word ends and without a decoder are supported")
        self.text = text
        vocabulary = model["vocab"]
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[a], vocabulary[b]] = rank << 32 | vocabulary[a + b]
        characters = byte_characters()
        self.of_byte = np.array([vocabulary[c] for c in characters])
        self.of_last = np.array([vocabulary[c + SUFFIX] for c in characters])
        self.characters = {c: b for b, c in enumerate(characters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.pairs = PairTable(self.ranks)
        self.joined = self.neighbours(vocabulary)
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.kinds = kinds()
        self.library = None
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def neighbours(self, vocabulary: dict[str, int]) -> np.ndarray:
        """For two bytes, the second not the last or the last of its word: whether they stand side by side in some token."""
        joined = np.zeros((256, 512), bool)
        for token in vocabulary:
            end = token.endswith(SUFFIX)
            units = [self.characters[c] for c in (token[: -len(SUFFIX)] if end else token)]
            if end and units:
                units[-1] += 256
            for a, b in zip(units, units[1:]):
                joined[a, b] = True
        return joined

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each of many words."""
        if not words:
            return []
        ids, counts = self.encode_bytes(np.frombuffer(b"".join(words), np.uint8), np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))
        packed, stops = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
        return [packed[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist())]

    def encode_bytes(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that stand one after another, none of them empty, and how many each word has."""
        last = np.zeros(len(text), bool)
        last[ends - 1] = True
        ids = np.where(last, self.of_last[text], self.of_byte[text])
        cut = last.copy()
        cut[:-1] |= ~self.joined[text[:-1], text[1:] + 256 * last[1:]]
        fragment = np.cumsum(cut) - cut
        ids, places = self.merge(ids, fragment)
        word = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[places]
        return ids, np.bincount(word, minlength=len(ends))

    def beside(self, ids: np.ndarray, fragment: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The merge rank of each of these symbols with the next one of its fragment."""
        found = np.full(len(places), NO_MERGE, np.int64)
        inner = np.flatnonzero(fragment[places] == fragment[np.minimum(places + 1, len(ids) - 1)])
        inner = inner[places[inner] + 1 < len(ids)]
        at = places[inner]
        found[inner] = self.pairs(ids[at], ids[at + 1])
        return found

    def merge(self, ids: np.ndarray, fragment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all fragments at once, one merge in each per step: lowest rank first, leftmost among equals.

        Long fragments are merged one by one. Returns ids and, in ascending order, a place among the given ones for each, in the same fragment.
        """
        order = np.arange(len(ids))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = np.bincount(fragment)
        ends = np.cumsum(sizes)  # fragments stand one after another
        for f in np.flatnonzero(sizes >= HEAP_FROM):
            start = ends[f] - sizes[f]
            merged = np.array(self.merge_long(ids[start : ends[f]].tolist()))
            done.append((merged, order[start : start + len(merged)]))
        rest = sizes[fragment] < HEAP_FROM
        ids, fragment, order = ids[rest], fragment[rest], order[rest]
        found = self.beside(ids, fragment, np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.diff(fragment, prepend=-1))
            best = np.repeat(np.minimum.reduceat(found, starts), np.diff(starts, append=len(ids)))
            going = best != NO_MERGE
            done.append((ids[~going], order[~going]))
            ids, fragment, order, found, best = (x[going] for x in (ids, fragment, order, found, best))
            at = np.flatnonzero(found == best)
            at = at[np.diff(fragment[at], prepend=-1) != 0]
            ids[at] = best[at] & 0xFFFFFFFF
            left = np.ones(len(ids), bool)
            left[at + 1] = False
            ids, fragment, order, found = (x[left] for x in (ids, fragment, order, found))
            # Only the merged symbols and those before them have another neighbour now.
            at -= np.arange(len(at))
            changed = np.concatenate([at, at[at > 0] - 1])
            found[changed] = self.beside(ids, fragment, changed)
        ids, order = (np.concatenate(x) for x in zip(*done)) if done else (ids, order)
        sort = np.argsort(order)
        return ids[sort], order[sort]

    def merge_long(self, ids: list[int]) -> list[int]:
        ranks, n = self.ranks, len(ids)
        heap = [(found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            found, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = found & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get((ids[i], ids[k])):
                    heapq.heappush(heap, (found, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (found := ranks.get((ids[h], ids[i]))):
                heapq.heappush(heap, (found, h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text.

        None of the many short-lived lists is in a cycle, so the collector of cycles rests meanwhile.
        """
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode_all(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_all(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.parts(text) for text in texts]
        encoded = self.encode_parts([part for own in cut for part in own[::2]])
        return [
            b"".join(struct.pack("<I", self.special[part]) if k % 2 else next(encoded) for k, part in enumerate(own)) for own in cut
        ]

    def parts(self, text: str | None) -> list[str]:
        """A text cut at special tokens, which stand at odd places."""
        return self.find_special.split(text) if text and self.special else [text or ""]

    def encode_parts(self, parts: list[str]) -> Iterator[bytes]:
        """The packed ids of texts without special tokens."""
        run, held = [], 0
        for part in parts:
            run.append(part)
            held += len(part)
            if held >= RUN_CHARACTERS:
                yield from self.encode_run(run)
                run, held = [], 0
        yield from self.encode_run(run)

    def encode_run(self, parts: list[str]) -> list[bytes]:
        unusual = pc.match_substring_regex(pa.array(parts, pa.large_string()), UNUSUAL).to_pylist()
        usual = iter(self.encode_usual([part for part, odd in zip(parts, unusual) if not odd]))
        self.learn({piece for part, odd in zip(parts, unusual) if odd for piece in BLANKS.split(part)})
        return [b"".join(map(self.pieces.__getitem__, BLANKS.split(part))) if odd else next(usual) for part, odd in zip(parts, unusual)]

    def encode_usual(self, texts: list[str]) -> list[bytes]:
        """The packed ids of texts without unusual characters: those of each different word, copied to all its places."""
        text = np.frombuffer((END.join(texts) + 2 * END).lower().encode("utf-16-le"), "<u2")
        kind = self.kinds[text]
        starts = word_starts(text, kind)
        written = kind != BLANK
        if not len(starts):
            return [b""] * len(texts)
        size = np.where(text < 0x80, 1, 2) * written  # in UTF-8
        offsets = np.concatenate([(np.cumsum(size) - size)[starts], [size.sum()]])
        together = text[written].tobytes().decode("utf-16-le").encode("utf-8")
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(together)]).dictionary_encode()
        _, bounds, letters = words.dictionary.buffers()
        known = np.frombuffer(bounds, np.int64, len(words.dictionary) + 1)
        ids, counts = self.encode_bytes(np.frombuffer(letters, np.uint8, known[-1]), known[1:])
        code = words.indices.to_numpy()
        repeated = counts[code]
        ends = np.cumsum(repeated)
        packed = ids.astype("<u4")[np.repeat((np.cumsum(counts) - counts)[code] - (ends - repeated), repeated) + np.arange(ends[-1])].tobytes()
        before = np.searchsorted(starts, np.flatnonzero(text == ord(END))[: len(texts)])
        stops = (4 * np.concatenate([[0], ends])[before]).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops)]

    def learn(self, needed: set[str]) -> None:
        """Make sure that all these pieces of texts with unusual characters are remembered."""
        if len(self.pieces) > REMEMBERED_PIECES:
            self.pieces.clear()
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        new = [(piece, self.unusual_words(piece)) for piece in needed if piece not in self.pieces]
        words = list({w for _, found in new for w in found if w not in self.words})
        self.words.update(zip(words, self.encode_words(words)))
        for piece, found in new:
            self.pieces[piece] = b"".join(map(self.words.__getitem__, found))

    def unusual_words(self, text: str) -> list[bytes]:
        """Words by the tokenizers library's own Unicode tables."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.text)
        text = self.library.normalizer.normalize_str(text)
        words = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(map(self.characters.__getitem__, word)) for word, _ in words]

    def decode(self, ids: bytes | None) -> str:
        """The tokens of packed ids with a blank between them, special tokens included."""
        if not ids:
            return ""
        numbers = struct.unpack(f"<{len(ids) // 4}I", ids)
        try:
            return " ".join(map(self.tokens.__getitem__, numbers))
        except KeyError:
            return " ".join(t for i in numbers if (t := self.tokens.get(i)) is not None)


class Shared:
    """A vocabulary that tasks build once per worker from broadcast text."""

    built: dict[int, Bpe] = {}

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            text = file.read(MAX_VOCABULARY_BYTES + 1)
        if len(text) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
        self.size = 1 + max(json.loads(text)["model"]["vocab"].values())
        self.sent = spark.sparkContext.broadcast(text)
        self.key = hash(text)

    def __call__(self) -> Bpe:
        if self.key not in Shared.built:
            Shared.built[self.key] = Bpe(self.sent.value)
        return Shared.built[self.key]


def vocabulary(spark: SparkSession, path: str) -> Shared:
    """Read a vocabulary file on the driver and make it known to all executors."""
    return Shared(spark, path)


def encode(docs: DataFrame, bpe: Shared, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the packed ids (binary, little-endian unsigned 32-bit) of the whole text."""

    def make(part: pa.RecordBatch) -> list[list]:
        return [bpe().encode_all(part.column(text).to_pylist())]

    return with_python_columns(docs, [(ids, T.BinaryType(), pa.binary())], make, RUN_BYTES)


def decode(docs: DataFrame, bpe: Shared, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of packed ids."""

    def make(part: pa.RecordBatch) -> list[list]:
        return [[*map(bpe().decode, part.column(ids).to_pylist())]]

    return with_python_columns(docs, [(text, T.StringType(), pa.string())], make)
