"""Phrase collocations: frequent phrases counted by broadcast double-array tries.

Phrases are first counted into hashed buckets, those of three words and more only where their pairs lie in full
buckets; a bucket's sum is never below the count of a phrase in it, so no frequent phrase is lost. The phrases of full
buckets, whose parts are in full buckets too, are the candidates. They go into double-array tries of a bounded number
of phrases, several of which are broadcast at once. Tasks then advance the trie states of all text positions at once,
word by word, and count the accepting states met; the sums over all tasks are the exact counts.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm.url_templates import LOWER, UPPER
from stockloom.plans.topk import top_k
from stockloom.session import scratch_dir, written

# Fixed by the contract: what ends a piece of text, and what ends a word in it.
PIECE_ENDS, WORD_ENDS = ".,;:!?\n\x0b\x0c\r", " \t"
UNKNOWN = "und"
MOST_WORDS, LEAST, TOP = 5, 100, 2_000
BLOCK = 2_097_152  # bytes of text held as words at once in a task
TEXTS = 512  # texts put in lower case at once
SHARD, TRIES = 250_000, 8  # phrases of one trie, tries broadcast at once: what a task holds does not grow with the corpus
LEAST_BITS, MOST_BITS = 16, 30  # of the number of buckets of pairs; 2**30 buckets are 128 MB of bits
FEWER_BITS = 3  # by which other lengths have fewer: there are less different words, and less phrases whose pairs are frequent
LONG_WORD = 128  # bytes; words beyond it are hashed one by one
PAGE_BITS, LEAST_PAGES = 20, 6  # of the buckets summed by one group, at most; of the groups, at least
COUNT_BITS = 32 - PAGE_BITS  # a bucket's place in its page and a part of its count are one number
HELD = 4_194_304  # positions of a task whose buckets are counted at once
SEEN = 2_000_000  # phrases a task remembers to have reported
REPORTED = 100_000  # phrases a task holds until it hands them on
SUMS = 2_048  # phrases whose counts are summed over all tasks in one group
SHARE = 6  # of so many occurrences one reports its phrase, at first: of phrases found 100 times one of 80 million reports nothing
WINDOW, CODES = 256, 16  # places of a trie and children of a node that are tried at once


@dataclass
class Block:
    """The words of a block of texts."""

    ids: np.ndarray  # of each word, into ``words``
    words: pa.Array
    piece: np.ndarray  # equal for words of one piece
    lang: np.ndarray  # of each word, into the languages of the batch

    def keys(self) -> np.ndarray:
        """64-bit key of each word, taken from its bytes, eight at a time."""
        bounds = np.frombuffer(self.words.buffers()[1], np.int64)[: len(self.words) + 1]
        data = np.r_[np.frombuffer(self.words.buffers()[2], np.uint8)[: bounds[-1]], np.zeros(8, np.uint8)]
        size = np.diff(bounds)
        own, rest = _mix(size.astype(np.uint64) + np.uint64(1)), np.flatnonzero(size <= LONG_WORD)
        for done in range(0, int(size[rest].max(initial=0)), 8):
            rest = rest[size[rest] > done]
            part = np.zeros(len(rest), np.uint64)
            for i in range(8):
                byte = np.where(size[rest] > done + i, data[bounds[rest] + done + i], 0)
                part |= byte.astype(np.uint64) << np.uint64(8 * i)
            own[rest] = _mix((own[rest] ^ part) * np.uint64(0x9FB21C651E98DF25))
        for i in np.flatnonzero(size > LONG_WORD):
            own[i] = xxhash.xxh64_intdigest(data[bounds[i] : bounds[i + 1]].tobytes())
        return own[self.ids]


_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in WORD_ENDS]] = 1
_CLASS[[ord(c) for c in PIECE_ENDS]] = 2
_CLASSES = _CLASS.tobytes()
_LOWER = bytes(i + 32 if 65 <= i < 91 else i for i in range(256))


def _cut(data: np.ndarray, starts: np.ndarray, at: int, size: int) -> int:
    """End of a block from ``at``: a text's or piece's end, at most ``size`` further where there is one."""
    while True:
        end = min(at + size, len(data))
        if end == len(data):
            return end
        text = int(starts[np.searchsorted(starts, end, "right") - 1])
        ends = np.flatnonzero(_CLASS[data[at:end]] == 2)
        cut = max(text, at + int(ends[-1]) + 1 if len(ends) else 0)
        if cut > at:
            return cut
        size *= 2


def blocks(texts: pa.Array, langs: np.ndarray, size: int = BLOCK) -> Iterator[Block]:
    """The words of texts, in lower case of A-Z, with the language of each text."""
    if texts.null_count:
        texts = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if bounds[0] == bounds[-1]:
        return
    data = np.frombuffer(texts.buffers()[2].slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes().translate(_LOWER), np.uint8)
    starts = bounds[:-1] - bounds[0]
    at = 0
    while at < len(data):
        end = _cut(data, starts, at, size)
        kind = np.frombuffer(data[at:end].tobytes().translate(_CLASSES), np.uint8)
        inside = kind == 0
        here = starts[(starts >= at) & (starts < end)] - at
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        first[here] = inside[here]
        last[:-1] &= ~inside[1:]
        last[here[here > 0] - 1] = inside[here[here > 0] - 1]
        place = np.flatnonzero(first)
        if len(place):
            offsets = np.r_[0, np.cumsum(np.flatnonzero(last) + 1 - place)].astype(np.int64)
            own = pa.Array.from_buffers(
                pa.large_string(), len(place), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at:end][inside].tobytes())]
            ).dictionary_encode()
            text = np.diff(np.searchsorted(place + at, starts), prepend=0, append=len(place))  # words before the first text, then of each
            ends = kind == 2
            ends[here] = True
            yield Block(own.indices.to_numpy(), own.dictionary, np.cumsum(ends, dtype=np.int32)[place], np.repeat(langs, text[1:]))
        at = end


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit keys."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STEP = 0x9E3779B97F4A7C15  # between a phrase's key and that with one more word


def _bits(k: int, bits: int) -> int:
    """Bits of the number of buckets of phrases of ``k`` words, where pairs have ``bits``."""
    return bits if k == 2 else max(bits - FEWER_BITS, LEAST_BITS)


def _page_bits(k: int, bits: int) -> int:
    """Bits of the number of their buckets that one group sums up."""
    return min(PAGE_BITS, _bits(k, bits) - LEAST_PAGES)


def _full(sieve: np.ndarray, key: np.ndarray) -> np.ndarray:
    bucket = key >> np.uint64(65 - (8 * len(sieve)).bit_length())
    return (sieve[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8)) & 1 == 1


def grams(block: Block, seeds: np.ndarray, sieves: list[np.ndarray], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, positions and keys of the phrases of up to ``most`` words whose parts lie in full buckets, where there is a sieve."""
    word = block.keys()
    key, alive = _mix(word ^ seeds[block.lang]), np.ones(len(word), bool)
    at = np.arange(len(word))
    for k in range(1, most + 1):
        if k > 1:
            both = np.zeros(len(word), bool)
            n = len(word) - k + 1
            if n > 0:
                both[:n] = alive[:n] & alive[1 : n + 1] & (block.piece[:n] == block.piece[k - 1 :])
            at = np.flatnonzero(both)
            key[at] = _mix(key[at] * np.uint64(STEP) + word[at + k - 1])
        yield k, at, key[at]
        alive = np.zeros(len(word), bool)
        alive[at] = _full(sieves[k - 1], key[at]) if k <= len(sieves) else True


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], np.ndarray]]:
    """Texts, languages, and the language of each text."""
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS):
            part = batch.slice(start, TEXTS)
            langs = part.column("lang").dictionary_encode()
            yield part.column("text"), langs.dictionary.to_pylist(), langs.indices.to_numpy()


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Hands texts to Python ``TEXTS`` at a time: else each task holds a batch of thousands of whole texts on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), TEXTS) if int(before) > 0 else TEXTS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _seeds(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(n, seed=1) for n in names], np.uint64)


def _split(phrases: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different words of phrases; for all phrases one after the other their words; where those of each start, and how many it has."""
    own = pc.split_pattern(pa.array(phrases, pa.large_string()), " ")
    words, size = own.flatten().dictionary_encode(), pc.list_value_length(own).to_numpy().astype(np.int64)
    return words.dictionary, words.indices.to_numpy().astype(np.int64), np.cumsum(size) - size, size


def _room(taken: np.ndarray, codes: np.ndarray, at: int) -> tuple[np.ndarray, int]:
    """The first place from ``at`` from which a node's children fall on places not taken; makes more places at the end."""
    while True:
        if at + WINDOW + codes[-1] >= len(taken):
            taken = np.r_[taken, np.zeros(len(taken) + WINDOW + codes[-1], bool)]
        tries = np.arange(at, at + WINDOW)
        for i in range(0, len(codes), CODES):
            tries = tries[~taken[tries[:, None] + codes[i : i + CODES]].any(1)]
            if not len(tries):
                break
        else:
            return taken, int(tries[0])
        at += WINDOW


def build_trie(langs: list[str], phrases: list[str]) -> dict:
    """A double-array trie of phrases per language, by words.

    The child of ``node`` by a word's ``code`` is ``child[base[node] + code]`` if ``owner[base[node] + code] ==
    node``. ``accept`` has the index of the phrase that ends in a node, else -1.

    Frequent words have low codes, so wide nodes are dense where they start. Nodes with more children go first; the search for
    room starts anew only where their number halves, so the places are gone through a few times, not once per node.
    """
    words, code, start, size = _split(phrases)
    by_use = np.argsort(-np.bincount(code, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[by_use] = np.arange(1, len(words) + 1)
    code, width = rank[code], len(words) + 1
    root = pa.array(langs, pa.string()).dictionary_encode()
    state, nodes, edges = root.indices.to_numpy().astype(np.int64), len(root.dictionary), []
    for level in range(int(size.max(initial=0))):
        use = np.flatnonzero(size > level)
        own, place = np.unique(state[use] * width + code[start[use] + level], return_inverse=True)
        edges.append(own)
        state[use] = nodes + place
        nodes += len(own)
    accept = np.full(nodes, -1, np.int64)
    accept[state] = np.arange(len(phrases))
    parent, by = np.divmod(np.concatenate(edges), width)  # by parent, then code; the first node that is no root is the first one's child
    above, first, many = np.unique(parent, return_index=True, return_counts=True)
    base, taken = np.zeros(nodes, np.int64), np.zeros(4 * width, bool)
    at = halved = top = 0
    for i in np.lexsort((above, -many))[: int((many > 1).sum())].tolist():
        codes = by[first[i] : first[i] + many[i]]
        if int(many[i]).bit_length() != halved:
            at, halved = 0, int(many[i]).bit_length()
        taken, at = _room(taken, codes, at)
        taken[at + codes] = True
        base[above[i]], top = at, max(top, at + int(codes[-1]) + 1)
    top, single = max(top, width), np.flatnonzero(many == 1)
    base[above[single]] = top + np.arange(len(single)) - by[first[single]]
    owner, child = (np.full(top + len(single) + width, x, np.int32) for x in (-1, 0))
    owner[base[parent] + by], child[base[parent] + by] = parent, len(root.dictionary) + np.arange(len(parent))
    return {"words": words.take(pa.array(by_use)).to_pylist(), "langs": root.dictionary.to_pylist(), "roots": list(range(len(root.dictionary))),
            "base": base.astype(np.int32), "owner": owner, "child": child, "accept": accept}


def _phrase_keys(langs: list[str], phrases: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of the first ``most`` words of each phrase, as in ``grams``, and how many words it has."""
    words, code, start, size = _split(phrases)
    word = Block(code, words, None, None).keys()
    own = pa.array(langs, pa.string()).dictionary_encode()
    key = _mix(word[start] ^ _seeds(own.dictionary.to_pylist())[own.indices.to_numpy()])
    for k in range(1, min(int(size.max(initial=0)), most)):
        use = size > k
        key[use] = _mix(key[use] * np.uint64(STEP) + word[start[use] + k])
    return key, size


def buckets_of(langs: list[str], phrases: list[str], bits: int) -> list[int]:
    """The bucket of each phrase, among those of its length."""
    key, size = _phrase_keys(langs, phrases, MOST_WORDS)
    shift = np.array([64 - _bits(k, bits) for k in range(int(size.max(initial=0)) + 1)], np.uint64)
    return (key >> shift[size]).astype(np.int64).tolist()


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def count_trie(block: Block, names: list[str], trie: dict, words: pa.Array, counts: np.ndarray, most: int = MOST_WORDS) -> None:
    """Adds the phrases of a block to the counts of their accepting nodes: all positions advance together."""
    found = pc.fill_null(pc.index_in(block.words, value_set=words), -1).to_numpy(zero_copy_only=False)
    _advance(block, names, trie, found.astype(np.int64) + 1, counts, np.arange(len(block.ids)), 1, most)


def _advance(block: Block, names: list[str], trie: dict, code: np.ndarray, counts: np.ndarray, at: np.ndarray, fewest: int, most: int) -> None:
    """Adds phrases of ``fewest`` to ``most`` words from given positions; ``code`` is that of each different word of the block."""
    root = np.array([dict(zip(trie["langs"], trie["roots"])).get(n, -1) for n in names], np.int64)
    at = at[(code[block.ids[at]] > 0) & (root[block.lang[at]] >= 0)]
    state = root[block.lang[at]]
    for k in range(1, most + 1):
        place = trie["base"][state] + code[block.ids[at + k - 1]]
        hit = trie["owner"][place] == state
        at, state = at[hit], trie["child"][place[hit]].astype(np.int64)
        if k >= fewest:
            np.add.at(counts, state, 1)
        stay = at + k < len(block.ids)
        at, state = at[stay], state[stay]
        stay = block.piece[at + k] == block.piece[at]
        at, state = at[stay], state[stay]


class _Counter:
    """Counts by several tries: a position meets the trie of its word, and follows only that of its first two words."""

    def __init__(self, rows: list[dict], shards: int, most: int):
        self.tries, self.shards, self.most = [], shards, most
        own = [pc.split_pattern(pa.array([r["words"].decode()], pa.large_string()), "\n").flatten() for r in rows]
        self.words = pc.unique(pa.concat_arrays(own))
        self.keys = np.append(Block(np.arange(len(self.words)), self.words, None, None).keys(), np.uint64(0))
        self.slot = np.full(shards, -1, np.int8)
        for i, (r, words) in enumerate(zip(rows, own)):
            trie = r | {c: np.frombuffer(r[c], np.int32) for c in ("base", "owner", "child", "accept")}
            code = pc.fill_null(pc.index_in(self.words, value_set=words), -1).to_numpy(zero_copy_only=False)
            self.slot[r["shard"]] = i
            self.tries.append((trie, np.append(code + 1, 0).astype(np.int64), np.zeros(len(trie["accept"]), np.int64)))

    def add(self, block: Block, names: list[str]) -> None:
        none = len(self.words)
        found = pc.fill_null(pc.index_in(block.words, value_set=self.words), none).to_numpy(zero_copy_only=False)
        known, word = (found < none)[block.ids], self.keys[found][block.ids]
        key = _mix(word ^ _seeds(names)[block.lang])
        one = np.where(known, self.slot[_shard(key, self.shards)], -1)
        pair = self.slot[_shard(_mix(key[:-1] * np.uint64(STEP) + word[1:]), self.shards)]
        two = np.where(known[:-1] & known[1:] & (block.piece[:-1] == block.piece[1:]), pair, -1)
        for i, (trie, code, sums) in enumerate(self.tries):
            own = code[found]
            _advance(block, names, trie, own, sums, np.flatnonzero(one == i), 1, 1)
            _advance(block, names, trie, own, sums, np.flatnonzero(two == i), 2, self.most)

    def pages(self) -> Iterator[pa.RecordBatch]:
        """``shard, page, at, counts``: of ``SUMS`` phrases those met, and how often."""
        for trie, _, sums in self.tries:
            met = trie["accept"] >= 0
            vector = np.zeros(int(met.sum()), np.int64)
            vector[trie["accept"][met]] = sums[met]
            own = [(j, x, np.flatnonzero(x)) for j, x in ((j, vector[j : j + SUMS]) for j in range(0, len(vector), SUMS)) if x.any()]
            columns = [
                pa.array([trie["shard"]] * len(own), pa.int32()), pa.array([j // SUMS for j, _, _ in own], pa.int32()),
                pa.array([at.astype(np.uint16).tobytes() for _, _, at in own], pa.binary()),
                pa.array([x[at].astype(np.min_scalar_type(x.max())).tobytes() for _, x, at in own], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "page", "at", "counts"])


def _sieves(buckets: DataFrame, lengths: list[int], bits: int) -> list[np.ndarray]:
    """For each length one bit per bucket, set for those given; packed in tasks, 2**bits / 8 bytes in all."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["k"].iloc[0])
        size = 1 << _page_bits(k, bits)
        page = np.zeros(size, np.uint8)
        page[group["bucket"].to_numpy() % size] = 1
        own = zlib.compress(np.packbits(page, bitorder="little").tobytes(), 1)
        return pd.DataFrame({"k": [k], "page": [int(group["bucket"].iloc[0]) // size], "bits": [own]})

    size = F.element_at(F.array(*[F.lit(1 << _page_bits(k, bits)) for k in range(1, max(lengths, default=1) + 1)]), F.col("k"))
    full = buckets.where(F.col("k").isin(lengths)).withColumn("page", F.call_function("div", F.col("bucket"), size))
    out = {k: np.zeros((1 << _bits(k, bits)) // 8, np.uint8) for k in lengths}
    for r in full.groupBy("k", "page").applyInPandas(pack, "k int, page bigint, bits binary").collect():
        own = np.frombuffer(zlib.decompress(r.bits), np.uint8)
        out[r.k][r.page * len(own) : (r.page + 1) * len(own)] = own
    return [out[k] for k in lengths]


PAGES = "lang string, k int, page bigint, n bigint, own binary"  # counts of buckets, those of one page in one row


def _rows(langs: pa.Array, k: int, page: np.ndarray, n: pa.Array, own: pa.Array) -> pa.RecordBatch:
    columns = [langs, pa.array(np.full(len(langs), k, np.int32)), pa.array(page.astype(np.int64)), n, own]
    return pa.RecordBatch.from_arrays(columns, ["lang", "k", "page", "n", "own"])


def _pages(held: dict[int, list[np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of the buckets held for each length, which are let go."""
    most = (1 << COUNT_BITS) - 1
    for k, some in held.items():
        if not some:
            continue
        bucket, n = np.unique(np.concatenate(some), return_counts=True)
        some.clear()
        times = (n - 1) // most + 1  # counts that take more than one number
        bucket, part, size = np.repeat(bucket, times), np.full(int(times.sum()), most, np.uint32), _page_bits(k, bits)
        part[np.cumsum(times) - 1] = n - (times - 1) * most
        own = (bucket & np.uint32((1 << size) - 1)) << np.uint32(COUNT_BITS) | part
        page, first = np.unique(bucket >> np.uint32(size), return_index=True)
        offsets = (np.r_[first, len(own)] * 4).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(page), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(own.tobytes())])
        yield _rows(pa.nulls(len(page), pa.string()), k, page, pa.nulls(len(page), pa.int64()), data)


def _total(group: pd.DataFrame, bits: int, least: int) -> pd.DataFrame:
    """``k, bucket, n`` of the buckets of a page whose counts come to ``least``."""
    k, pages = int(group["k"].iloc[0]), group["own"].tolist()
    size = _page_bits(k, bits)
    sums = np.zeros(1 << size, np.int64)
    for i in range(0, len(pages), 256):
        own = np.frombuffer(b"".join(pages[i : i + 256]), np.uint32)
        sums += np.bincount(own >> np.uint32(COUNT_BITS), own & np.uint32((1 << COUNT_BITS) - 1), 1 << size).astype(np.int64)
    full = np.flatnonzero(sums >= least)
    return pd.DataFrame({"k": k, "bucket": full + (int(group["page"].iloc[0]) << size), "n": sums[full]})


def _buckets(docs: DataFrame, lengths: list[int], sieves: list[np.ndarray], bits: int, least: int) -> DataFrame:
    """``lang, k, bucket, n``: full buckets of phrases of the given lengths; words of each language with ``k`` 0.

    A task counts the buckets of ``HELD`` positions at once and hands them on a page a row; a group sums one page.
    """
    known = docs.sparkSession.sparkContext.broadcast(list(sieves))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, many = defaultdict(int), {k: [] for k in lengths}, 0
        for texts, names, langs in _batches(batches):
            seeds = _seeds(names)
            for block in blocks(texts, langs):
                for name, n in zip(names, np.bincount(block.lang, minlength=len(names)).tolist()):
                    words[name] += n
                for k, _, key in grams(block, seeds, known.value, lengths[-1]):
                    if k in held and len(key):
                        held[k].append((key >> np.uint64(64 - _bits(k, bits))).astype(np.uint32))
                        many += len(key)
                if many >= HELD:
                    yield from _pages(held, bits)
                    many = 0
        yield from _pages(held, bits)
        n = pa.array(list(words.values()), pa.int64())
        yield _rows(pa.array(list(words), pa.string()), 0, np.zeros(len(n)), n, pa.nulls(len(n), pa.binary()))

    def total(group: pd.DataFrame) -> pd.DataFrame:
        lang = group["lang"].iloc[0]
        own = _total(group, bits, least) if pd.isna(lang) else pd.DataFrame({"k": [0], "bucket": 0, "n": group["n"].sum()})
        return own.assign(lang=lang)[["lang", "k", "bucket", "n"]]

    found = docs.mapInArrow(fill, PAGES).groupBy("lang", "k", "page").applyInPandas(total, "lang string, k int, bucket bigint, n bigint")
    return written(found, scratch_dir(docs.sparkSession, "buckets"))


def _reported(docs: DataFrame, sieves: list[np.ndarray], wanted: list[np.ndarray], bits: int, share: int, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase`` of phrases in wanted buckets: of those found ``f`` times, all but ``(1 - 1 / share) ** f``.

    And ``k, bucket, n``: the buckets that are still full when only phrases count whose parts are all in full buckets.
    A task hands on many phrases in one row, apart by line breaks, which no word has.
    """
    spark, pages = docs.sparkSession, 1 << max(bits - PAGE_BITS, 0)
    known = spark.sparkContext.broadcast((sieves, wanted))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, asked = known.value
        seen, place, held, many = np.zeros(0, np.uint64), {}, [], 0
        done = TaskContext.get().partitionId() << 40  # else copies of a file report the same occurrences
        sums, counted = {k: [] for k in range(2, len(asked) + 1)}, 0

        def rows() -> pa.RecordBatch:
            group = np.concatenate([x for x, _ in held])
            order = np.argsort(group, kind="stable")
            own, first = np.unique(group[order], return_index=True)
            phrases = pa.concat_arrays([x for _, x in held]).take(pa.array(order))
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.r_[first, len(order)], pa.int64()), phrases), pa.scalar("\n", pa.large_string()))
            langs = pa.array(list(place), pa.string()).take(pa.array(own // pages))
            return _rows(langs, 0, own % pages, pa.nulls(len(own), pa.int64()), joined.cast(pa.binary()))

        for texts, names, langs in _batches(batches):
            seeds, lang = _seeds(names), np.array([place.setdefault(n, len(place)) for n in names], np.int64)
            for block in blocks(texts, langs):
                new = []
                for k, at, key in grams(block, seeds, full, len(asked)):
                    if k > 1:
                        use = np.flatnonzero(_full(asked[k - 1], key))
                        if len(use):
                            sums[k].append((key[use] >> np.uint64(64 - _bits(k, bits))).astype(np.uint32))
                            counted += len(use)
                        use = use[_mix(key[use] + (at[use] + done).astype(np.uint64)) <= np.uint64((2**64 - 1) // share)]
                        own, first = np.unique(key[use], return_index=True)
                        fresh = np.searchsorted(seen, own, "right") == np.searchsorted(seen, own)
                        own, at = own[fresh], at[use][first][fresh]
                        if len(own):
                            new.append(own)
                            words = [block.words.take(pa.array(block.ids[at + i])) for i in range(k)]
                            held.append((lang[block.lang[at]] * pages + (own % np.uint64(pages)).astype(np.int64), pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))))
                            many += len(own)
                seen, done = np.sort(np.concatenate([seen, *new]), kind="stable"), done + len(block.ids)
                if many >= REPORTED:
                    yield rows()
                    held, many = [], 0
                if counted >= HELD:
                    yield from _pages(sums, bits)
                    counted = 0
                if len(seen) > SEEN:
                    seen = seen[:0]
        if many:
            yield rows()
        yield from _pages(sums, bits)

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        lang = group["lang"].iloc[0]
        if pd.isna(lang):
            own = _total(group, bits, least).assign(phrase=None)
        else:
            own = pd.DataFrame({"k": 0, "bucket": 0, "n": 0, "phrase": sorted({p for x in group["own"] for p in bytes(x).decode().split("\n")})})
        return own.assign(lang=lang)[["lang", "k", "bucket", "n", "phrase"]]

    schema = "lang string, k int, bucket bigint, n bigint, phrase string"
    found = docs.mapInArrow(report, PAGES).groupBy("lang", "k", "page").applyInPandas(gather, schema)
    found = written(found, scratch_dir(spark, "reported"))
    return found.where("k = 0").select("lang", "phrase"), found.where("k > 0").select("k", "bucket", "n")


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """The counts of a page of phrases over all tasks."""
    total = np.zeros(SUMS, np.int64)
    for at, own in zip(group["at"], group["counts"]):
        at = np.frombuffer(at, np.uint16)
        total[at] += np.frombuffer(own, f"u{len(own) // len(at)}").astype(np.int64)
    at = np.flatnonzero(total)
    return pd.DataFrame({"shard": int(group["shard"].iloc[0]), "at": at + int(group["page"].iloc[0]) * SUMS, "f": total[at]})


def _counted(docs: DataFrame, phrases: DataFrame, bits: int, most: int, shard: int) -> DataFrame:
    """``lang, phrase, k, bucket, f``: exact counts of given phrases, by ``TRIES`` tries in each pass over the texts.

    Phrases that begin with the same two words share a trie, so a position is followed in one trie only, however many there are.
    """
    spark = docs.sparkSession
    given = written(phrases, scratch_dir(spark, "phrases"))
    shards = max(1, -(-given.count() // shard))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                key, _ = _phrase_keys(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), 2)
                yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("phrase"), pa.array(_shard(key, shards), pa.int32())], ["lang", "phrase", "shard"])

    dealt = given.select("lang", "phrase").mapInArrow(deal, "lang string, phrase string, shard int")

    def trie_of(group: pd.DataFrame) -> pd.DataFrame:
        langs, own = group["lang"].tolist(), group["phrase"].tolist()
        trie = build_trie(langs, own)
        raw = {c: [trie[c].astype(np.int32).tobytes()] for c in ("base", "owner", "child", "accept")} | {"words": ["\n".join(trie["words"]).encode()]}
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "langs": [trie["langs"]], "roots": [trie["roots"]], **raw,
                             "rows_lang": [langs], "rows_phrase": [own], "rows_bucket": [buckets_of(langs, own, bits)]})

    schema = (
        "shard int, langs array<string>, roots array<int>, base binary, owner binary, child binary, accept binary, words binary, "
        "rows_lang array<string>, rows_phrase array<string>, rows_bucket array<bigint>"
    )
    tries = written(dealt.groupBy("shard").applyInPandas(trie_of, schema), scratch_dir(spark, "tries"))
    rows = F.posexplode(F.arrays_zip("rows_lang", "rows_phrase", "rows_bucket")).alias("at", "row")
    named = tries.select("shard", rows).select(
        "shard", "at", F.col("row.rows_lang").alias("lang"), F.col("row.rows_phrase").alias("phrase"), F.col("row.rows_bucket").alias("bucket")
    )
    counts = None
    for i in range(0, shards, TRIES):
        found = tries.where(F.col("shard").between(i, i + TRIES - 1)).drop("rows_lang", "rows_phrase", "rows_bucket")
        shared = spark.sparkContext.broadcast([r.asDict() for r in found.toLocalIterator()])
        if not shared.value:
            continue

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counter = _Counter(shared.value, shards, most)
            for texts, names, langs in _batches(batches):
                for block in blocks(texts, langs):
                    counter.add(block, names)
            yield from counter.pages()

        vectors = docs.mapInArrow(count, "shard int, page int, at binary, counts binary")
        part = vectors.groupBy("shard", "page").applyInPandas(_summed, "shard int, at int, f bigint")
        part = written(part, scratch_dir(spark, "counts"))
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        return spark.createDataFrame([], "lang string, phrase string, k int, bucket bigint, f bigint")
    length = F.size(F.split("phrase", " "))
    return written(named.join(counts, ["shard", "at"]).select("lang", "phrase", length.alias("k"), "bucket", "f"), scratch_dir(spark, "counted"))


def phrase_counts(
    docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, shard: int = SHARD, share: int = SHARE
) -> tuple[DataFrame, DataFrame]:
    """Exact counts of phrases, and the number of all words of each language.

    ``lang, phrase, k, f`` holds every phrase of 2 to ``most`` words that occurs ``least`` times and every word in one
    of them. ``docs`` has ``text, lang``, neither null.

    Only about one of ``share`` occurrences reports its phrase. The counts of what was reported are then held against the sums
    of the buckets: where the rest of a bucket could hide a frequent phrase, all its phrases are reported and counted.
    """
    spark = docs.sparkSession
    volume = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(max(math.ceil(math.log2(max(volume, 1) / 24 + 1)), LEAST_BITS), MOST_BITS)
    short = _buckets(docs, [k for k in (1, 2) if k <= most], [], bits, least)
    sieves = _sieves(short, [1, 2], bits)
    totals = short.where("k = 0").select("lang", "n")
    if most > 2:
        long = _buckets(docs, list(range(3, most + 1)), sieves, bits, least)
        sieves += _sieves(long, list(range(3, most + 1)), bits)

    def with_words(phrases: DataFrame) -> DataFrame:
        words = phrases.where(F.size(F.split("phrase", " ")) == 2).select("lang", F.explode(F.split("phrase", " ")).alias("phrase"))
        return phrases.unionByName(words.distinct())

    found, full = _reported(docs, sieves, sieves, bits, share, least)
    known = _counted(docs, with_words(found), bits, most, shard)
    sums = known.groupBy("k", "bucket").agg(F.sum("f").alias("f"))
    rest = full.join(sums, ["k", "bucket"], "left").where(F.col("n") - F.coalesce("f", F.lit(0)) >= least).select("k", "bucket")
    rest = written(rest, scratch_dir(spark, "rest"))
    if not rest.isEmpty():
        wanted = [sieves[0][:0], *_sieves(rest, list(range(2, most + 1)), bits)]
        more = with_words(_reported(docs, sieves, wanted, bits, 1, least)[0]).join(known, ["lang", "phrase"], "left_anti")
        known = known.unionByName(_counted(docs, more, bits, most, shard))
    return known.where((F.col("k") == 1) | (F.col("f") >= least)).select("lang", "phrase", "k", "f"), totals


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def score() -> Column:
    """``floor(1000 * a * n / (l * r))``, exact while the products have no more than 38 digits."""
    a, n, l, r = (F.col(c).cast("decimal(18, 0)") for c in ("a", "n", "l", "r"))
    return F.call_function("div", F.lit(1000).cast("decimal(4, 0)") * a * n, l * r)


def mine(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, top: int = TOP, percent: int = 100, shard: int = SHARD) -> DataFrame:
    """The best collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Takes ``text, lang``; a null text is empty, a null language ``und``; other columns are not read. Texts are
    lower-cased in A-Z and cut into pieces and words; a phrase is 2 to ``most`` words of one piece and counts with all
    its occurrences. Candidates occur ``least`` times. A cut after the first ``k`` words scores ``floor(1000 * a * n / (l * r))``
    with the counts of the phrase, of all words and of both parts; the lowest cut counts, ties to the smallest ``k``. Phrases
    inside a longer candidate with at least ``percent`` percent of their count are dropped. Ranks go by score and count,
    descending, then phrase; each language has its first ``top``.

    Repeated rows count as often as they appear. An empty table and one without frequent phrases give no rows. Texts of any
    length are read whole, in blocks that end with a piece: only a single piece must fit a task's memory.
    """
    narrow = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    with _short_batches(docs.sparkSession):
        counted, totals = phrase_counts(narrow, least, most, shard)
    frequent = counted.where("k > 1").withColumn("words", F.split("phrase", " "))
    cuts = frequent.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "k", F.col("f").alias("a"), "cut", _part(F.lit(1), F.col("cut")).alias("left"),
        _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"),
    )
    parts = counted.select("lang", F.col("phrase").alias("part"), "f")
    with_left = cuts.join(parts.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"])
    with_both = with_left.join(parts.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"]).join(totals, "lang")
    best = with_both.withColumn("score", score()).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best")
    )
    spans = [(i, k) for k in range(2, most) for i in range(1, most - k + 2)]
    inner = F.explode(F.array_distinct(F.array_compact(F.array(*[
        F.when((F.col("k") > k) & (F.col("k") >= i + k - 1), _part(F.lit(i), F.lit(k))) for i, k in spans
    ])))) if spans else None
    if inner is not None:
        covered = frequent.where("k > 2").select("lang", "f", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
        best = best.join(covered, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
    flat = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    ranked = top_k(flat, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = f"""
    WITH pieces AS (
      SELECT coalesce(lang, '{UNKNOWN}') AS lang,
             regexp_extract_all(unnest(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
      FROM documents WHERE text IS NOT NULL),
    grams AS (
      SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM pieces, (SELECT unnest(range(1, {MOST_WORDS + 1})) AS k) WHERE len(w) >= k),
    counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
    frequent AS (SELECT * FROM counts WHERE k > 1 AND f >= {LEAST}),
    totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
    cuts AS (
      SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM frequent),
    scored AS (
      SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, t.n, c.cut, (1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f) AS score
      FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
      JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ') JOIN totals t ON t.lang = c.lang),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    inside AS (
      SELECT lang, f, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase
      FROM frequent, (SELECT unnest(range(2, {MOST_WORDS})) AS m), (SELECT unnest(range(1, {MOST_WORDS})) AS i)
      WHERE m < k AND i + m - 1 <= k),
    covered AS (SELECT lang, phrase, max(f) AS most FROM inside GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
           r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM lowest LEFT JOIN covered USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a
    QUALIFY rank <= {TOP}"""
