"""Byte-level BPE by forced-boundary splitting.

Two neighbouring bytes that stand together inside no token of the vocabulary are
never merged: between them the text can be cut, and what lies between two cuts is
encoded alone. Such fragments are short and repeat, so each is encoded once per
worker and looked up afterwards. The ids of a text are those of its fragments in
order.

A cut must not change how the tokenizer's own splitting rule reads the rest
either. The rule looks ahead only at the end of white space and for the
contractions after an apostrophe, so no cut is made after white space and next to
an apostrophe, and none inside a character.

Null texts count as empty and have no ids. A row is handled alone, so ties,
repeated rows, null ids and empty tables need no rule; other columns are neither
read nor changed. Long texts are cut a window at a time.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from traceaudit.llm.shingles import pieces

# Bytes of text that are cut at a time.
WINDOW = 1 << 20
# Fragments a worker remembers, and the longest that it remembers; others are encoded again, with the same ids.
REMEMBERED, LONGEST_REMEMBERED = 1_000_000, 64
# Pieces of fewer bytes are merged by looking at all pairs again, longer ones through a heap.
SHORT = 24
DECODE_IDS = 1 << 18

APOSTROPHE = 0x27
# Letters before this character are the same in every version of Unicode.
LATIN_END = "\u0250"
# The contractions of the byte-level splitting rule.
CONTRACTIONS = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")
# White space of Unicode beyond ASCII, as UTF-8.
WIDE_SPACES = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def byte_alphabet() -> dict[str, int]:
    """The characters in which byte-level vocabularies are written: printable bytes as themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _ascii_space() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
    return table


class ByteBpe:
    """A byte-level BPE vocabulary: where texts may be cut, the ids of a fragment, the bytes of ids."""

    def __init__(self, definition: str):
        made = json.loads(definition)
        model, split = made["model"], made["pre_tokenizer"] or {}
        plain = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
                     or model.get("ignore_merges") or made["normalizer"])
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or not plain:
            raise ValueError("only plain byte-level BPE without a normalizer or a prefix space is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in made["added_tokens"]):
            raise ValueError("added tokens must stand for their exact text")
        alphabet, vocabulary = byte_alphabet(), model["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in made["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, number in vocabulary.items():
            self.bytes_of[number] = bytes(alphabet[c] for c in token)
        inside = np.zeros((256, 256), dtype=bool)
        for token in self.bytes_of:
            inside[list(token[:-1]), list(token[1:])] = True
        for token, number in self.special.items():
            self.bytes_of[number] = token
        self.letter = {c: vocabulary[c] for c in alphabet}
        self.number = [number for _, number in sorted((alphabet[c], number) for c, number in self.letter.items())]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        self.may_cut = self._cuttable(inside).ravel()
        self.split = Tokenizer.from_str(definition).pre_tokenizer.pre_tokenize_str
        self.known = _Known(self)

    @staticmethod
    def _cuttable(inside: np.ndarray) -> np.ndarray:
        """Pairs of bytes between which a cut changes neither merges nor the splitting rule, wide white space aside."""
        may = ~inside
        may[_ascii_space(), :] = False                     # white space keeps what follows it
        may[APOSTROPHE, :] = may[:, APOSTROPHE] = False
        may[:, 0x80:0xC0] = False                          # inside a character
        for word in CONTRACTIONS:
            for left, right in zip(word[:-1], word[1:], strict=True):
                may[left, right] = False
        return may

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places in ``data`` where a new fragment begins."""
        at = np.flatnonzero(self.may_cut[(data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]]) + 1
        wide = np.zeros(len(at), dtype=bool)
        high = np.flatnonzero(data[at - 1] >= 0x80)
        for space in WIDE_SPACES:
            spot = at[high]
            same = spot >= len(space)
            for back, byte in enumerate(reversed(space), 1):
                same &= data[np.maximum(spot - back, 0)] == byte
            wide[high[same]] = True
        return at[~wide]

    def merge(self, ids: list[int]) -> list[int]:
        """Merge neighbours, lowest rank first and from the left, until no pair has a rank."""
        if len(ids) >= SHORT:
            return self._merge_long(ids)
        rank_of, none = self.merges.get, (1 << 60, 0)
        while len(ids) > 1:
            found = [rank_of(pair, none) for pair in zip(ids, ids[1:])]  # noqa: B905
            best = min(found)
            if best is none:
                break
            at = found.index(best)                         # the leftmost pair of this rank
            ids[at:at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same through a heap of pairs: n log n steps."""
        merges, total = self.merges, len(ids)
        after, before = list(range(1, total + 1)), list(range(-1, total - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < total and (found := merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(total - 1):
            offer(i)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= total or ids[j] != right:
                continue                                   # one of the two has been merged since
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[j] < total:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [i for i in ids if i >= 0]

    def encode_fragment(self, fragment: bytes) -> bytes:
        """Ids of one fragment, four little-endian bytes each."""
        if fragment in self.special:
            return self.special[fragment].to_bytes(4, "little")
        text, number = fragment.decode(), self.number
        word = text.removeprefix(" ")
        if word.isalpha() and max(word) < LATIN_END:       # most fragments: one word, one piece of the splitting rule
            ids = self.merge([number[b] for b in fragment])
            return pack(f"<{len(ids)}I", *ids)
        ids = []
        for piece, _ in self.split(text):
            ids += self.merge([self.letter[c] for c in piece])
        return pack(f"<{len(ids)}I", *ids)

    def _special_places(self, blob: bytes, ends: np.ndarray) -> list[tuple[int, int]]:
        """Begin and end of each special token that lies within one text, leftmost first."""
        found, at = [], 0
        while hits := [(p, -len(token)) for token in self.special if (p := blob.find(token, at)) >= 0]:
            begin, length = min(hits)
            stop = begin - length
            crossed = np.searchsorted(ends, begin, "right") != np.searchsorted(ends, stop, "left")
            at = begin + 1 if crossed else stop
            if not crossed:
                found.append((begin, stop))
        return found

    def encode_bytes(self, data: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of the texts that end at ``ends``, all in ``data``."""
        blob = data.tobytes()
        forced = set(ends.tolist())
        special = self._special_places(blob, ends)
        for begin, stop in special:
            forced |= {begin, stop}
        fixed = np.array(sorted(forced | {0}), dtype=np.int64)
        hidden = [(begin + 1, stop) for begin, stop in special]
        done: list[bytes] = []
        counts = np.zeros(len(ends), dtype=np.int64)
        at = 0
        while at < len(data):
            window = WINDOW
            while True:                                    # up to the last cut of a window; a window without any grows
                stop = min(len(data), at + window)
                places = self.cuts(data[max(0, at - 3):stop]) + max(0, at - 3)
                for begin, last in hidden:
                    places = places[(places < begin) | (places >= last)]
                own = fixed[np.searchsorted(fixed, at, "right"):np.searchsorted(fixed, stop, "right")]
                places = np.sort(np.concatenate((places[places > at], own)))
                places = places[np.append(True, places[1:] > places[:-1])[:len(places)]]
                if stop == len(data) or len(places):
                    break
                window *= 2
            if stop == len(data) and (not len(places) or places[-1] < stop):
                places = np.append(places, stop)
            begins = np.concatenate(([at], places[:-1]))
            done.extend(map(self.known.__getitem__, [blob[a:b] for a, b in zip(begins.tolist(), places.tolist(), strict=True)]))
            counts += np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(ends))[:len(ends)]
            at = int(places[-1])
        upto = np.concatenate(([0], np.cumsum(counts)))
        return [b"".join(done[a:b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text."""
        for _, _, data, ends in pieces(texts):
            yield from self.encode_bytes(data, np.asarray(ends, dtype=np.int64))

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        numbers, table = np.frombuffer(ids, dtype="<u4"), self.bytes_of
        parts = (b"".join(map(table.__getitem__, numbers[a:a + DECODE_IDS].tolist())) for a in range(0, len(numbers), DECODE_IDS))
        return b"".join(parts).decode("utf-8", "replace")


class _Known(dict):
    """Fragments encoded so far; it starts anew when it is full."""

    def __init__(self, owner: ByteBpe):
        super().__init__()
        self.owner = owner

    def __missing__(self, fragment: bytes) -> bytes:
        ids = self.owner.encode_fragment(fragment)
        if len(fragment) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[fragment] = ids
        return ids


_LOADED: dict[int, ByteBpe] = {}


def _loaded(definition: Broadcast) -> ByteBpe:
    key = hash(definition.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(definition.value)
    return _LOADED[key]


class Codec:
    """Encoding and decoding under one vocabulary file; its text, a few MB at most, is broadcast to the workers."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            self.definition = spark.sparkContext.broadcast(file.read())

    def encode(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(id, ids): the ids of each text as packed bytes, four little-endian bytes an id, as training shards hold them."""
        definition = self.definition
        narrow = docs.select(docs[doc_id].alias("id"), docs[text].alias("body"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = pa.array(list(_loaded(definition).encode(batch.column(1))), type=pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

        schema = T.StructType([T.StructField("id", narrow.schema["id"].dataType), T.StructField("ids", T.BinaryType())])
        return narrow.mapInArrow(run, schema).withColumnRenamed("id", doc_id)

    def decode(self, ids: Column) -> Column:
        """Text of each row's packed ids; null counts as no ids."""
        definition = self.definition

        @F.arrow_udf("string")
        def run(packed: pa.Array) -> pa.Array:
            table = _loaded(definition)
            return pa.array([table.decode(row.as_py() or b"") for row in packed], type=pa.string())

        return run(ids)


def n_ids(ids: Column) -> Column:
    """How many ids a packed column holds."""
    return (F.length(ids) / 4).cast("long")
