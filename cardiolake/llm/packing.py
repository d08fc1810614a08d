"""Operator 9 - packing by minimum bin slack.

Every document becomes the ids of a word-level BPE tokenizer plus an end id;
different words of a batch are looked up once and new ones tokenized.
Documents longer than a window give whole windows; what remains of each is a
*remainder*.  Windows are then filled one after the other: a bitset subset-sum
dynamic programme over the multiset of remaining lengths (a Python integer is
the bitset) finds the multiset whose sum comes closest to the capacity, and the
counts are backtracked from the stored bitsets.  A slack above ``max_slack`` is
closed by cutting one remainder.  What is left at the end of a task, less than
one window, is cut at powers of two, which need no padding.

Scale: no shuffle.  Each scan task packs its own rows; sequence ids start at
``task << 32``.  A task holds at most ``buffer_tokens`` ids plus one document,
then packs all but the last windows' worth of them.  A retried task reads the
same split in the same order and returns the same rows.

Defined results: null and empty texts are a document of the end id alone;
repeated rows and repeated or null ids are packed as they come; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Texts without a match are lower-cased and cut into words by Arrow, with a cache; those
#: with other characters, or with what may be a special token, go whole to the tokenizer.
_UNUSUAL = r"[^\t\n\r\x20-\x7e\x{c0}-\x{12f}\x{131}-\x{24f}]|<\|"
#: The tokenizer's own word split, for lower-case text.
_SPLIT = r"('s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+)"
#: Most chunks are letters and then symbols, which trimming cuts sooner than the split.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
_SYMBOLS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _take(ids: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of ``ids``, run i from bounds[i] to bounds[i + 1], in a row; and their bounds there."""
    starts, out = bounds[at], np.zeros(len(at) + 1, np.int64)
    lengths = bounds[at + 1] - starts
    np.cumsum(lengths, out=out[1:])
    places = np.repeat(starts - out[:-1], lengths)
    places += np.arange(len(places))
    return ids[places], out


class Known:
    """Strings met so far and their ids, as columns; ``learn`` gives ids and bounds of new ones.

    With more than ``limit`` strings the half of ``limit`` that was met most often stays.
    """

    def __init__(self, learn, limit: int):
        self.learn, self.limit = learn, limit
        self.keys = pa.array([""], pa.large_string())
        self.ids, self.bounds, self.met = np.empty(0, "<u4"), np.zeros(2, np.int64), np.zeros(1, np.int64)

    def find(self, values: pa.Array) -> np.ndarray:
        """The number of each value, for ``take``; good until the next call."""
        if len(self.keys) > self.limit:
            self._forget()
        coded = values.dictionary_encode()
        own, codes = coded.dictionary, coded.indices.to_numpy()
        found = pc.index_in(own, value_set=self.keys)
        new = own.filter(found.is_null())
        numbers = found.fill_null(-1).to_numpy().copy()
        if len(new):
            numbers[numbers < 0] = np.arange(len(self.keys), len(self.keys) + len(new))
            ids, bounds = self.learn(new)
            self.keys = pa.concat_arrays([self.keys, new])
            self.bounds = np.concatenate([self.bounds, bounds[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.met[numbers] += np.bincount(codes, minlength=len(own))
        return numbers[codes]

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _take(self.ids, self.bounds, numbers)

    def _forget(self) -> None:
        often = np.argsort(-self.met[1:], kind="stable")[: self.limit // 2] + 1
        stay = np.concatenate(([0], np.sort(often)))  # the empty string is always known
        self.keys, self.met = self.keys.take(pa.array(stay)), self.met[stay] // 2
        self.ids, self.bounds = self.take(stay)


class Tokens:
    """uint32 ids of texts; equal to the tokenizer's own on whole texts.

    ``chunks`` keeps what stands between spaces in lower case, ``words`` its parts.
    """

    def __init__(self, path: str, limit: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder, self.chunks, self.words = Tokenizer.from_file(path), Known(self._cut, limit), Known(self._encode, limit)
        self.plain = Tokenizer.from_file(path)  # for words already split and in lower case
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.encoder.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def __call__(self, text: str | None) -> bytes:
        return self.many(pa.array([text], pa.large_string()))[0]

    def many(self, texts: pa.Array, several: int = 100) -> list[bytes]:
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(texts, _UNUSUAL)
        spaced = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(whole, "", texts)))
        numbers, out = self.chunks.find(spaced.flatten()), []
        stops = spaced.offsets.to_numpy() - spaced.offsets[0].as_py()
        for i in range(0, len(texts), several):
            of = stops[i : i + several + 1]
            ids, bounds = self.chunks.take(numbers[of[0] : of[-1]])
            at = bounds[of - of[0]].tolist()
            out += [ids[a:b].tobytes() for a, b in zip(at, at[1:])]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._ids(self.encoder, texts[i].as_py()).tobytes()
        return out

    @staticmethod
    def _ids(encoder, text: str) -> np.ndarray:
        return np.asarray(encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _cut(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks by way of their words."""
        head, tail = pc.ascii_rtrim(chunks, _SYMBOLS), pc.utf8_ltrim(chunks, _LETTERS)
        covered = pc.equal(pc.add(pc.binary_length(head), pc.binary_length(tail)), pc.binary_length(chunks))
        easy = pc.and_(pc.utf8_is_alpha(head), covered)
        split = pc.replace_substring_regex(pc.if_else(easy, "", chunks), _SPLIT, r"\1 ")
        parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.if_else(easy, pc.binary_join_element_wise(head, tail, pa.scalar(" ", pa.large_string())), split)))
        ids, bounds = self.words.take(self.words.find(parts.flatten()))
        return ids, bounds[parts.offsets.to_numpy()]

    def _encode(self, words: pa.Array, several: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by the tokenizer; a word ends with an id that closes it."""
        runs = [words.slice(i, several).to_numpy(zero_copy_only=False) for i in range(0, len(words), several)]
        ids = np.concatenate([self._ids(self.plain, " ".join(run)) for run in runs])
        return ids, np.flatnonzero(np.concatenate(([True], self.closes[ids])))


@functools.lru_cache(maxsize=2)
def _tokens(path: str, limit: int) -> Tokens:
    """One per Python worker, so that its cache serves all of the worker's tasks."""
    return Tokens(path, limit)


def _encoded(tokens: Tokens, texts: pa.Array, size: int = 16 << 20) -> Iterator[bytes]:
    """The ids of each text, from as many texts at a time as make up ``size`` bytes."""
    nth = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(nth)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield from tokens.many(texts.slice(a, b - a))


def closest_fill(offered: Iterable[tuple[int, int]], capacity: int) -> dict[int, int]:
    """Counts per length whose sum is the largest not above ``capacity``.

    ``offered``: (length, count) in falling order of length.  Counts are split
    into powers of two.  ``reach`` has bit s set when sum s can be made.  The
    programme stops as soon as the capacity itself is reachable.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length, count in offered:
        left, part = min(count, capacity // length), 1
        while left and not reach >> capacity & 1:
            part = min(part, left)
            grown = (reach | reach << part * length) & mask
            if grown != reach:
                steps.append((length, part, reach))
                reach = grown
            left -= part
            part *= 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            used[length] += part
            total -= part * length
    return dict(used)


class Packer:
    """Packs pieces (document number, start, length) into sequences."""

    def __init__(self, window: int, max_slack: int):
        self.window, self.max_slack = window, max_slack
        self.left: dict[int, list[tuple[int, int]]] = {}  # length -> [(document, start)]
        self.lengths: list[int] = []  # its keys, rising
        self.held = 0

    def add(self, doc: int, n: int) -> Iterator[list[tuple[int, int, int]]]:
        whole = n - n % self.window
        for start in range(0, whole, self.window):
            yield [(doc, start, self.window)]
        if n > whole:
            self._put(doc, whole, n - whole)

    def _put(self, doc: int, start: int, n: int) -> None:
        if n not in self.left:
            self.left[n] = []
            insort(self.lengths, n)
        self.left[n].append((doc, start))
        self.held += n

    def _take(self, n: int) -> tuple[int, int, int]:
        doc, start = self.left[n].pop()
        if not self.left[n]:
            del self.left[n], self.lengths[bisect_left(self.lengths, n)]
        self.held -= n
        return doc, start, n

    def _cut(self, n: int) -> tuple[int, int, int]:
        """A piece of exactly ``n`` tokens from the longest remainder."""
        doc, start, have = self._take(self.lengths[-1])
        if have > n:
            self._put(doc, start + n, have - n)
        return doc, start, min(n, have)

    def fill(self, down_to: int) -> Iterator[list[tuple[int, int, int]]]:
        while self.held >= max(self.window, down_to):
            chosen = closest_fill(((n, len(self.left[n])) for n in reversed(self.lengths)), self.window)
            pieces = [self._take(n) for n, k in chosen.items() for _ in range(k)]
            slack = self.window - sum(p[2] for p in pieces)
            if slack > self.max_slack:
                while slack:
                    pieces.append(self._cut(slack))
                    slack -= pieces[-1][2]
            yield pieces

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """The last tokens, as sequences of falling powers of two."""
        yield from self.fill(0)
        while self.held:
            room, pieces = 1 << (self.held.bit_length() - 1), []
            while room:
                pieces.append(self._cut(room))
                room -= pieces[-1][2]
            yield pieces


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, window: int = 4096, end_id: int = 2, max_slack: int = 8, buffer_tokens: int = 4_000_000, cache_words: int = 800_000
) -> DataFrame:
    """One row per piece; see ``SCHEMA``.  ``tokenizer`` is a path on every executor.

    ``cache_words`` bounds each of the two word caches a Python worker keeps.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        tokens, packer, ids, doc_ids, out, made = _tokens(path, cache_words), Packer(window, max_slack), {}, {}, [], 0
        end = np.asarray([end_id], dtype="<u4").tobytes()
        open_tokens: dict[int, int] = {}  # tokens of a document not yet placed

        def emit(sequences):
            nonlocal made
            for pieces in sequences:
                at = 0
                for doc, start, n in pieces:
                    raw = ids[doc]
                    out.append((doc_ids[doc], start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), len(raw) // 4, base + made, at))
                    at += n
                    open_tokens[doc] -= n
                    if not open_tokens[doc]:
                        del open_tokens[doc], ids[doc], doc_ids[doc]
                made += 1

        def flush():
            columns = list(zip(*out)) if out else [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

        number = 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), _encoded(tokens, batch.column(1))):
                raw += end
                ids[number], doc_ids[number], open_tokens[number] = raw, doc_id, len(raw) // 4
                emit(packer.add(number, len(raw) // 4))
                number += 1
                if packer.held > buffer_tokens:
                    emit(packer.fill(buffer_tokens // 2))
                if len(out) >= 20_000:
                    yield flush()
        emit(packer.rest())
        yield flush()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents into sequences of at most 4096 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
