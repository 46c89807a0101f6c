"""BPE encoding and decoding through a minimal acyclic transducer.

The most frequent words of the corpus (pieces of the vocabulary's splitting
pattern) are compiled with their ids into an automaton that shares prefixes and
suffixes. Each transition carries the number of words that sort before those
behind it; their sum along a path is the word's number, and that number's slot
in a table holds the ids. The automaton is one flat file, which executors get
from Spark and map into memory. Words it lacks are merged exactly by rank.
"""
from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import heapq
import json
import mmap
import os
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, long_rows, shared_dir

#: The splitting pattern of byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of the lexicon.
LEXICON_WORDS = 1 << 17
#: Code points of a text that are split at once.
PIECE = 1 << 20
#: Code points of texts that are encoded together.
TOGETHER = 1 << 22
#: Bytes of a word that is merged in the table's way; longer ones use a heap.
SHORT = 64
_HASH_BITS = 20
_BLANKS = frozenset(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
#: A chunk that is empty, or whose body begins or ends with white space.
_OPEN = r"^\n?$|^\n[{0}]|^[{1}]|[{0}]$".format("".join(sorted(_BLANKS)), "".join(sorted(_BLANKS - {"\n"})))
_RARE = regex.compile(r"[^\x00-՗]")
_SPLIT = regex.compile(PATTERN)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _hash(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        pairs = [(p.split(" ") if isinstance(p, str) else p) for p in spec["model"]["merges"]]
        left, right, new = (np.fromiter((vocab[f(p)] for p in pairs), np.int64, len(pairs)) for f in (lambda p: p[0], lambda p: p[1], lambda p: p[0] + p[1]))
        keys = left << 32 | right
        order = np.argsort(keys)
        self._keys, self._ranks, self._new = keys[order], order, new[order]
        # A table of the keys by hash, in which a key lies at its place or soon after.
        self._slots = np.full((1 << _HASH_BITS) + 64, -1, np.int64)
        for i, h in enumerate(_hash(self._keys).tolist()):
            while self._slots[h] >= 0:
                h += 1
            self._slots[h] = i
        self._byte_ids = np.asarray(self.byte_ids, np.int64)

    @functools.cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rank and new id by pair, for words that are merged alone."""
        return {(k >> 32, k & (1 << 32) - 1): (r, n) for k, r, n in zip(self._keys.tolist(), self._ranks.tolist(), self._new.tolist())}

    def _pairs(self, keys: np.ndarray) -> np.ndarray:
        """The merge of each pair, -1 for none."""
        found = np.full(len(keys), -1, np.int64)
        at, rest = _hash(keys), np.arange(len(keys))
        while len(rest):
            slot = self._slots[at]
            hit = (slot >= 0) & (self._keys[slot] == keys[rest])
            found[rest[hit]] = slot[hit]
            more = (slot >= 0) & ~hit
            rest, at = rest[more], at[more] + 1
        return found

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """merge() of many short words at once, as little-endian 32-bit integers: each round
        merges the best pair of every word that still has one."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self._byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_owner = [], []
        while len(ids):
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            pair = self._pairs(ids[inside] << 32 | ids[inside + 1])
            can = pair >= 0
            place, pair = inside[can], pair[can]
            if not len(place):
                break
            who = owner[place]
            heads = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            best = np.minimum.reduceat(self._ranks[pair] * len(ids) + place, heads) % len(ids)
            ids[best] = self._new[pair[np.searchsorted(place, best)]]
            keep = np.ones(len(ids), bool)
            keep[best + 1] = False
            active = np.zeros(len(words), bool)
            active[who[heads]] = True
            active = active[owner]
            done_ids.append(ids[~active])
            done_owner.append(owner[~active])
            keep &= active
            ids, owner = ids[keep], owner[keep]
        ids, owner = np.concatenate([*done_ids, ids]), np.concatenate([*done_owner, owner])
        order = np.argsort(owner, kind="stable")
        raw = ids[order].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of lowest rank, leftmost first, merges until none is left."""
        ids = [self.byte_ids[b] for b in word]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        while len(ids) > 1:
            best = min((m for pair in zip(ids, ids[1:]) if (m := self.merges.get(pair))), default=None)
            if best is None:
                break
            i = next(i for i in range(len(ids) - 1) if self.merges.get((ids[i], ids[i + 1])) == best)
            ids[i : i + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, in n log n."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (m := self.merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (m[0], a, m[1], ids[a], ids[b]))
        return [x for x in ids if x >= 0]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal automaton of entries as a flat file.

    Words are added in order; what can no longer change behind the last common
    prefix is replaced by an equal state, if there is one.
    """
    states: list[list] = [[False, {}]]  # final, transitions; equal states are one
    register: dict[tuple, int] = {}

    def settle(path: list[tuple[int, int]], keep: int) -> None:
        while len(path) > keep:
            parent, byte = path.pop()
            child = states[parent][1][byte]
            key = (states[child][0], tuple(states[child][1].items()))
            states[parent][1][byte] = register.setdefault(key, child)

    path: list[tuple[int, int]] = []
    last = b""
    words = sorted(entries)
    for word in words:
        keep = len(os.path.commonprefix((last, word)))
        settle(path, keep)
        at = states[path[-1][0]][1][path[-1][1]] if path else 0
        for b in word[keep:]:
            states.append([False, {}])
            states[at][1][b] = len(states) - 1
            path.append((at, b))
            at = len(states) - 1
        states[at][0] = True
        last = word
    settle(path, 0)

    count: dict[int, int] = {}
    order: list[int] = []
    stack = [(0, False)]
    while stack:
        s, done = stack.pop()
        if done:
            count[s] = states[s][0] + sum(count[t] for t in states[s][1].values())
            order.append(s)
        elif s not in count:
            count[s] = -1
            stack.append((s, True))
            stack += [(t, False) for t in states[s][1].values() if t not in count]
    order.reverse()
    number = {s: i for i, s in enumerate(order)}
    first, labels, target, weight, final = [0], bytearray(), [], [], bytearray()
    for s in order:
        skipped = int(states[s][0])
        for b, t in sorted(states[s][1].items()):
            labels.append(b)
            target.append(number[t])
            weight.append(skipped)
            skipped += count[t]
        first.append(len(labels))
        final.append(states[s][0])
    starts = np.cumsum([0] + [len(entries[w]) for w in words])
    ids = [i for w in words for i in entries[w]]
    parts = [np.asarray(x, "<u4").tobytes() for x in (first, target, weight, starts, ids)] + [bytes(final), bytes(labels)]
    return np.asarray([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        lengths = np.frombuffer(self.map, "<u4", 7)
        at, views = 28, []
        for n in lengths.tolist():
            views.append(memoryview(self.map)[at : at + n])
            at += n
        self.first, self.target, self.weight, self.starts = (v.cast("I") for v in views[:4])
        self.ids, self.final, self.label_at = views[4], views[5], at - len(views[6])

        labels = np.frombuffer(self.map, np.uint8, len(views[6]), self.label_at)
        first = np.asarray(self.first)
        self._edges = np.repeat(np.arange(len(first) - 1), np.diff(first)) << 8 | labels
        self._target, self._weight = np.asarray(self.target), np.asarray(self.weight)
        self._final = np.frombuffer(self.final, np.uint8)

    def get_all(self, words: list[bytes]) -> list[bytes | None]:
        """get() of many words: all walk the automaton together, a byte a step."""
        if not len(self._edges):
            return [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(lengths > 0)
        step = 0
        while len(live):
            key = state[live] << 8 | raw[begin[live] + step]
            edge = np.minimum(np.searchsorted(self._edges, key), len(self._edges) - 1)
            known = self._edges[edge] == key
            state[live[~known]] = -1
            live, edge = live[known], edge[known]
            number[live] += self._weight[edge]
            state[live] = self._target[edge]
            step += 1
            live = live[lengths[live] > step]
        hit = (state >= 0) & (self._final[state] == 1)
        starts, ids = self.starts, self.ids
        return [bytes(ids[4 * starts[n] : 4 * starts[n + 1]]) if h else None for h, n in zip(hit.tolist(), number.tolist())]

    def get(self, word: bytes) -> bytes | None:
        """The ids of a word as little-endian 32-bit integers, or None."""
        s = n = 0
        find, base = self.map.find, self.label_at
        for i in range(len(word)):
            e = find(word[i : i + 1], base + self.first[s], base + self.first[s + 1])
            if e < 0:
                return None
            n += self.weight[e - base]
            s = self.target[e - base]
        if not self.final[s]:
            return None
        return bytes(self.ids[4 * self.starts[n] : 4 * self.starts[n + 1]])


def unusual(text: str) -> bool:
    """Whether a text has characters that Python's tables, and so perhaps the tokenizer library's, don't know."""
    return bool(_RARE.search(text)) and any(unicodedata.category(c) == "Cn" for c in set(text))


class Splitter:
    """The words of texts that hold no special token.

    Letters and digits newer than the tokenizer library's tables are left to that library.
    """

    def __init__(self, tokenizer_path: str):
        self.path, self.library = tokenizer_path, None

    def pieces(self, text: str) -> Iterator[list[str]]:
        if unusual(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path).pre_tokenizer
            yield [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        elif len(text) <= PIECE:
            yield _SPLIT.findall(text)
        else:
            found = (m.group() for m in _SPLIT.finditer(text))
            while some := list(islice(found, PIECE // 4)):
                yield some


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of values that begin at starts, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + lengths).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return values[at]


def _lengths(items) -> np.ndarray:
    return np.fromiter(map(len, items), np.int64, len(items))


def cut_up(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Cut texts where words always end: before a line feed or a single space between other characters.

    Returns the different chunks, the number of each chunk in turn, and how many
    each text has. A chunk that begins with a line feed is itself, any other is
    preceded by a space in the text; texts get a line feed in front.
    """
    marked = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
    lists = pc.split_pattern(marked, " ")
    coded = pc.list_flatten(lists).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


class Words:
    """The words of different chunks: words, which of them come in turn, and how many each chunk has.

    open marks chunks that touch further white space, so that their words depend
    on their neighbours; they have none here.
    """

    def __init__(self, chunks: pa.Array, splitter: Splitter):
        self.open = pc.match_substring_regex(chunks, _OPEN).to_numpy(zero_copy_only=False)
        closed = chunks.filter(pa.array(~self.open))
        spelled = pc.if_else(pc.starts_with(closed, "\n"), closed, pc.binary_join_element_wise(" ", closed, ""))
        found = [w for some in splitter.pieces("".join(spelled.to_pylist())) for w in some]
        coded = pa.array(found, pa.string()).dictionary_encode()
        self.words, self.order = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        ends = np.searchsorted(np.cumsum(_lengths(found)), np.cumsum(pc.utf8_length(spelled).to_numpy(zero_copy_only=False))) + 1
        self.count = np.zeros(len(chunks), np.int64)
        self.count[~self.open] = np.diff(np.r_[0, ends])


class Encoder:
    """Encodes and decodes whole texts.

    Some texts at a time are cut in chunks, and each different chunk in words;
    each different word is looked up in the lexicon, and merged if it isn't there.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.splitter = Splitter(vocabulary.path)
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None

    def _resolve(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        raw = [w.encode() for w in words]
        found = self.lexicon.get_all(raw) if self.lexicon else [None] * len(raw)
        short = [i for i, x in enumerate(found) if x is None and len(raw[i]) <= SHORT]
        for i, x in zip(short, self.vocabulary.merge_all([raw[i] for i in short]) if short else ()):
            found[i] = x
        return [np.asarray(self.vocabulary.merge(r), "<u4").tobytes() if x is None else x for r, x in zip(raw, found)]

    def _uncut(self, texts: list[str]) -> list[bytes]:
        """ids of texts by their words as a whole, special tokens included."""
        parts = [self.special.split(t) if self.special else [t] for t in texts]
        words = [[[w for some in self.splitter.pieces(p) for w in some] if i % 2 == 0 else p for i, p in enumerate(x)] for x in parts]
        every = list({w for x in words for p in x[::2] for w in p})
        ids = dict(zip(every, self._resolve(every)))
        special = {k: v.to_bytes(4, "little") for k, v in self.vocabulary.special.items()}
        return [b"".join([b"".join([ids[w] for w in p]) if i % 2 == 0 else special[p] for i, p in enumerate(x)]) for x in words]

    def _cut(self, texts: list[str]) -> list[bytes | None]:
        """ids of texts by chunks; None for texts with an open one."""
        chunks, order, count = cut_up(pa.array(texts, pa.string()))
        words = Words(chunks, self.splitter)
        ids = self._resolve(words.words)
        size = _lengths(ids) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        flat = _gather(flat, (np.cumsum(size) - size)[words.order], size[words.order])
        # Ids of each different chunk, then of each in turn, then of each text.
        ends = np.r_[0, np.cumsum(size[words.order])][np.cumsum(words.count)]
        size = np.diff(np.r_[0, ends])
        flat = _gather(flat, (ends - size)[order], size[order])
        bounds = np.r_[0, np.cumsum(count)]
        is_open = np.r_[0, np.cumsum(words.open[order])][bounds]
        ends = np.r_[0, np.cumsum(size[order])][bounds].tolist()
        raw = flat.tobytes()
        # The line feed in front of a text isn't part of it.
        return [None if o else raw[4 * a + 4 : 4 * b] for o, a, b in zip(np.diff(is_open).tolist(), ends, ends[1:])]

    def encode_all(self, texts: Iterator[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers, in order."""
        waiting: list[str] = []
        size = 0
        for text in texts:
            if len(text) > TOGETHER:
                yield from self._flush(waiting)
                waiting, size = [], 0
                if any(x in text for x in self.vocabulary.special):
                    yield self._uncut([text])[0]
                else:
                    yield b"".join(self._flush([part])[0] for part in parts_of(text))
                continue
            waiting.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._flush(waiting)
                waiting, size = [], 0
        yield from self._flush(waiting)

    def _flush(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        special = [any(x in t for x in self.vocabulary.special) for t in texts]
        found = self._cut(["" if s else t for s, t in zip(special, texts)])
        rest = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(rest, self._uncut([texts[i] for i in rest])):
            found[i] = x
        return found

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(iter([text])))

    def decode(self, ids: bytes) -> str:
        get = self.vocabulary.bytes_of.__getitem__
        words = np.frombuffer(ids, "<u4")
        return b"".join(b"".join(map(get, words[i : i + PIECE].tolist())) for i in range(0, len(words), PIECE)).decode("utf-8", "replace")


def parts_of(text: str) -> Iterator[str]:
    """A long text cut at single spaces, about PIECE apart; each part but the first begins with one."""
    at = 0
    while True:
        end = text.find(" ", at + PIECE)
        while 0 < end < len(text) - 1 and (text[end - 1] in _BLANKS or text[end + 1] in _BLANKS):
            end = text.find(" ", end + 1)
        if end < 0 or end >= len(text) - 1:
            yield text[at:]
            return
        yield text[at:end]
        at = end


def trim() -> None:
    """Give memory that is free back to the system: worker processes outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


@functools.lru_cache(4)
def encoder(model: str, lexicon: str) -> Encoder:
    """The encoder of a worker process for files that were shipped; it lasts over tasks."""
    return Encoder(Vocabulary(SparkFiles.get(model)), Lexicon(SparkFiles.get(lexicon)))


def ship(spark: SparkSession, path: str) -> str:
    """Give a file to all executors; returns the name to open it by."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def publish(spark: SparkSession, content: bytes, label: str) -> str:
    """Write content to the shared folder, named by its digest, and ship it."""
    name = f"{label}-{hashlib.sha256(content).hexdigest()[:24]}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(content))
    out.close()
    return ship(spark, path.toString())


def word_counts(docs: DataFrame, model: str) -> DataFrame:
    """word, n of all words in all whole texts; counted in each task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(SparkFiles.get(model))

        def counted(texts: list[str]) -> pa.RecordBatch:
            chunks, order, count = cut_up(pa.array(texts, pa.string()))
            words = Words(chunks, splitter)
            bounds = np.r_[0, np.cumsum(count)]
            is_open = np.diff(np.r_[0, np.cumsum(words.open[order])][bounds]) > 0
            times = np.bincount(order[np.repeat(~is_open, count)], minlength=len(chunks))
            n = np.bincount(words.order, np.repeat(times, words.count), len(words.words)).astype(np.int64)
            rest = Counter(w for t, o in zip(texts, is_open.tolist()) if o for some in splitter.pieces(t) for w in some)
            # A line feed in front of each text isn't part of it.
            rest["\n"] -= int((~is_open).sum())
            return pa.RecordBatch.from_arrays([pa.array(words.words + list(rest), pa.string()), pa.array(n.tolist() + list(rest.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            waiting: list[str] = []
            size = 0
            for text in batch.column(0):
                for part in parts_of(text.as_py() or ""):
                    waiting.append(part)
                    size += len(part)
                    if size >= TOGETHER:
                        yield counted(waiting)
                        waiting, size = [], 0
            if waiting:
                yield counted(waiting)
            trim()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer_path: str, words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of docs, at most so many, and ship them; returns the file's name."""
    spark = long_rows(docs.sparkSession)
    model = ship(spark, tokenizer_path)
    # A word that occurs once gains nothing. The table of counts stays distributed; a histogram
    # over steps of an eighth of a power of two tells which counts make up the words wanted.
    counts = cut(word_counts(docs, model).where((F.col("n") > 1) & (F.length("word") <= SHORT)))
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    floor, found = 0, 0
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        found += r["count"]
        floor = r["step"]
        if found > words:
            floor += 1
            break
    top = counts.where(step >= floor).collect()
    raw = [r["word"].encode() for r in top]
    entries = {w: np.frombuffer(x, "<u4").tolist() for w, x in zip(raw, Vocabulary(tokenizer_path).merge_all(raw) if raw else [])}
    return publish(spark, compile_lexicon(entries), "lexicon")


def tokenizer(path: str | None = None) -> str:
    """The path of the vocabulary file, by default that of the installed public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def encode(docs: DataFrame, tokenizer_path: str | None = None, lexicon_words: int = LEXICON_WORDS, ids: bool = False) -> DataFrame:
    """Encode every whole text of docs (doc_id, text) and decode it again.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit
    integers) and decoded_sha256 (of the decoded text in UTF-8); with ids=True
    also ids (binary) and decoded. Special tokens in a text become their ids. A
    null or empty text has no ids. Rows are independent, so repeated rows get
    equal results, and an empty table gives an empty one. Very long texts are
    split in pieces and very long words merged with a heap. Other columns are ignored.
    """
    spark = long_rows(docs.sparkSession)
    tokenizer_path = tokenizer(tokenizer_path)
    lexicon = build_lexicon(docs, tokenizer_path, lexicon_words)
    model = ship(spark, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model, lexicon)
        for batch in batches:
            n, hashes, texts, kept, back = [], [], [], [], []
            for found in coder.encode_all(text.as_py() or "" for text in batch.column(1)):
                decoded = coder.decode(found)
                n.append(len(found) // 4)
                hashes.append(hashlib.sha256(found).hexdigest())
                texts.append(hashlib.sha256(decoded.encode()).hexdigest())
                if ids:
                    kept.append(found)
                    back.append(decoded)
            trim()
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(
                columns + ([pa.array(kept, pa.binary()), pa.array(back, pa.string())] if ids else []),
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if ids else 4],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
