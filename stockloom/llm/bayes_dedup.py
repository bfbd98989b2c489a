"""Near-duplicates by MinHash with sequential Bayesian verification.

Documents with equal shingle sets form one class. Classes that share a band of their signatures
are candidates. Their signatures are compared batch by batch, and a candidate is dropped as
soon as the posterior probability of a similarity at the threshold falls below a chosen miss
probability; the survivors are compared on their full sets.

Inside a bucket classes are first compared with one hub, then with another, which costs as
many pairs as the bucket has members. What these links join needs no comparison any more; only
classes outside the main component of their bucket are compared with all the others, in
blocks of bounded size. No pair that shares a band and may join two components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.components import components
from stockloom.session import scratch_dir, written

# 28 bands of 4 hashes miss a pair of similarity 0.8 with probability 4e-7.
BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
BATCH = 16  # hashes compared before each look at the posterior
MISS = 1e-6  # a candidate is dropped when its similarity reaches the threshold with less than this probability
CHUNK = 512  # classes on either side of a block
WORDS_KNOWN = 500_000  # word hashes a worker remembers

_ONE = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(1)
def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_229)
    return (
        draw.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
        draw.integers(0, 2**63, HASHES, dtype=np.uint64),
    )


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * _TWO
    return values ^ (values >> np.uint64(32))


_words: dict[bytes, int] = {}


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text, A-Z lower-cased.

    Fewer words than a shingle has count as one shingle, no words as none.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = []
    for part in parts:
        known = _words.get(part)
        if known is None:
            if len(_words) >= WORDS_KNOWN:
                _words.clear()
            known = _words[part] = xxhash.xxh64_intdigest(part)
        hashes.append(known)
    own = np.array(hashes, np.uint64)
    span = min(words, len(own))
    total = np.full(len(own) - span + 1, span, np.uint64)
    for i in range(span):
        total = _mixed(total * _ONE + own[i : len(own) - span + 1 + i])
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    scale, shift = _hash_family()
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[start : start + 1024, None] * scale + shift).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and signature; the band's number is part of the key."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = _mixed(key * _ONE + parts[:, :, i])
    return key.view(np.int64)


@lru_cache(64)
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """For each batch, the fewest matching hashes with which a candidate stays.

    With a uniform prior the posterior of the similarity after m of n matches is a beta
    distribution, whose upper tail is a binomial lower tail.
    """
    limits, t = [], percent / 100
    for n in range(BATCH, HASHES + 1, BATCH):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
        limits.append(m)
    return tuple(limits)


def may_be_similar(one: np.ndarray, many: np.ndarray, percent: int, miss: float) -> np.ndarray:
    """Rows of ``many`` that survive the sequential comparison with ``one`` (row by row if it has as many rows)."""
    left = np.arange(len(many))
    matches = np.zeros(len(many), np.int64)
    for i, limit in enumerate(least_matches(percent, miss)):
        if not len(left):
            break
        part = slice(i * BATCH, (i + 1) * BATCH)
        own = one[left, part] if one.ndim == 2 else one[part]
        matches[left] += (many[left, part] == own).sum(axis=1)
        left = left[matches[left] >= limit]
    return left


def is_similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``percent`` hundredths."""
    shared = len(one) + len(two) - len(np.union1d(one, two))
    return 100 * shared >= percent * (len(one) + len(two) - shared)


def _features(text: Column, words: int, full: bool) -> Column:
    """Struct of the set's size and digest and its signature; with the set itself and its bands if ``full``."""

    def build(texts: pa.Array) -> pa.Array:
        sizes, keys, signatures, bands, sets = [], [], [], [], []
        for t in texts:
            own = shingle_set(t.as_py(), words)
            sizes.append(len(own))
            keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            sig = signature(own) if len(own) else None
            signatures.append(None if sig is None else sig.tobytes())
            if full:
                sets.append(own.tobytes())
                bands.append(None if sig is None else band_keys(sig[None])[0].tobytes())
        columns = {"n": pa.array(sizes, pa.int64()), "key": pa.array(keys, pa.binary()), "sig": pa.array(signatures, pa.binary())}
        if full:
            columns |= {"bands": pa.array(bands, pa.binary()), "shingles": pa.array(sets, pa.binary())}
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    build.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    more = ", bands: binary, shingles: binary" if full else ""
    return F.arrow_udf(build, f"struct<n: bigint, key: binary, sig: binary{more}>").asNondeterministic()(text)


def _bands(sig: Column) -> Column:
    def split(signatures: pa.Array) -> pa.Array:
        rows = np.frombuffer(b"".join(s.as_py() for s in signatures), np.uint32).reshape(-1, HASHES)
        keys = pa.array(band_keys(rows).ravel(), pa.int64())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), keys)

    split.__annotations__ = {"signatures": pa.Array, "return": pa.Array}
    return F.arrow_udf(split, "array<bigint>")(sig)


def _linked(percent: int, miss: float, *columns: Column) -> Column:
    """Whether two classes are linked: signatures batch by batch, then the full sets of survivors."""

    def verify(sig_a: pa.Array, sig_b: pa.Array, set_a: pa.Array, set_b: pa.Array) -> pa.Array:
        one, two = (np.frombuffer(b"".join(s.as_py() for s in x), np.uint32).reshape(-1, HASHES) for x in (sig_a, sig_b))
        found = np.zeros(len(one), bool)
        for i in may_be_similar(one, two, percent, miss):
            a, b = (np.frombuffer(x[int(i)].as_py(), np.uint64) for x in (set_a, set_b))
            found[i] = is_similar(a, b, percent)
        return pa.array(found)

    verify.__annotations__ = dict.fromkeys(("sig_a", "sig_b", "set_a", "set_b", "return"), pa.Array)
    return F.arrow_udf(verify, "boolean").asNondeterministic()(*columns)


def block_links(block: pd.DataFrame, percent: int, miss: float) -> list[tuple[bytes, bytes]]:
    """Links between the left and the right classes of one block of a bucket that join components.

    A pair that shares an earlier band is left to that band's bucket; of two classes that are
    both on the left, the pair is taken once. Components that a link joins are one from then on.
    """
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    right = block[block["right"]].reset_index(drop=True)
    left = block[~block["right"]]
    if not len(left) or not len(right):
        return []
    keys, comps = right["key"].tolist(), right["comp"].tolist()
    stays = right["stray"].to_numpy()
    signatures = np.frombuffer(b"".join(right["sig"]), np.uint32).reshape(-1, HASHES)
    bands = np.frombuffer(b"".join(right["bands"]), np.int64).reshape(-1, BANDS)
    own_band = int(block["band"].iloc[0])
    sets = [np.frombuffer(s, np.uint64) for s in right["shingles"]]
    sizes = np.array([len(s) for s in sets])
    links = []
    for key, comp, sig, band, shingles in left[["key", "comp", "sig", "bands", "shingles"]].itertuples(index=False):
        mine = np.frombuffer(shingles, np.uint64)
        n = len(mine)
        fits = (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
        first = np.argmax(bands == np.frombuffer(band, np.int64), axis=1)
        fits &= bands[np.arange(len(bands)), first] == own_band
        near = np.flatnonzero(fits)
        near = near[may_be_similar(np.frombuffer(sig, np.uint32), signatures[near], percent, miss)]
        for j in near:
            if stays[j] and keys[j] <= key:
                continue
            a, b = find(comp), find(comps[j])
            if a != b and is_similar(mine, sets[j], percent):
                links.append((key, keys[j]))
                root[a] = b
    return links


def link_classes(members: DataFrame, buckets: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links ``a, b`` that give the same components as all links between classes that share a band.

    ``members`` has one row per class that shares a band (``key, n, sig, bands, shingles``), ``buckets`` the rows
    ``band, key`` of bands with two classes or more.
    """
    spark = members.sparkSession
    ends = {s: members.select(F.col("key").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("shingles").alias(f"set_{s}")) for s in "ab"}

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(ends["a"], "a").join(ends["b"], "b")
        return both.where(_linked(percent, miss, *[F.col(c) for c in ("sig_a", "sig_b", "set_a", "set_b")])).select("a", "b")

    def labelled(links: DataFrame) -> DataFrame:
        roots = components(links)
        own = buckets.join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
        return own.select("band", "key", F.coalesce("root", "key").alias("comp"))

    hubs = buckets.groupBy("band").agg(F.min("key").alias("a"))
    pairs = buckets.join(hubs, "band").where("key <> a").select("a", F.col("key").alias("b")).distinct()
    first = written(verified(pairs), scratch_dir(spark, "links"))

    state = written(labelled(first), scratch_dir(spark, "state"))
    hubs = state.groupBy("band").agg(F.max(F.struct("key", "comp")).alias("hub"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    pairs = (
        state.join(hubs, "band").where("comp <> hub.comp").select(F.col("hub.key").alias("b"), F.col("key").alias("a")).distinct()
    )
    links = written(first.unionByName(verified(pairs)), scratch_dir(spark, "links"))

    state = written(labelled(links), scratch_dir(spark, "state"))
    sizes = state.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("of"))
    mixed = (
        sizes.groupBy("band").agg(F.sum("of").alias("n"), F.max(F.struct("of", "comp")).alias("main"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1 AND n > 2")  # with two members the hub has seen both
        .select("band", "n", F.col("main.comp").alias("main"), (F.col("n") - F.col("main.of")).alias("strays"))
    )
    chunks = lambda n: F.call_function("div", n - 1, F.lit(CHUNK)) + 1
    rows = state.join(mixed, "band").select(
        "band", "key", "comp", (F.col("comp") != F.col("main")).alias("stray"),
        chunks(F.col("strays")).alias("lefts"), chunks(F.col("n")).alias("rights"),
    )
    place = lambda n: F.pmod(F.xxhash64("key"), n)
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    right = rows.select("*", F.lit(True).alias("right"), spread(F.col("lefts")).alias("i"), place(F.col("rights")).alias("j"))
    left = rows.where("stray").select("*", F.lit(False).alias("right"), place(F.col("lefts")).alias("i"), spread(F.col("rights")).alias("j"))
    kept = ["band", "i", "j", "right", "stray", "key", "comp"]
    blocks = right.select(*kept).unionByName(left.select(*kept)).join(members.select("key", "sig", "bands", "shingles"), "key")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(block, percent, miss), columns=["a", "b"])

    rest = blocks.groupBy("band", "i", "j").applyInPandas(compare, "a binary, b binary")
    return written(links.unionByName(rest), scratch_dir(spark, "links"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """The near-duplicate component of every row: ``doc_id, n_shingles, component_id, kept``.

    A document's set is its distinct shingles of ``words`` words; documents are linked if the Jaccard
    similarity of their sets is ``percent`` hundredths or more. ``component_id`` is the smallest ``doc_id`` reachable
    over links, ``kept`` marks the document that has it. Null texts and texts without words have an
    empty set and stand alone. Repeated rows are copies of one another (all with the smallest id
    are kept), rows with a null id get the component of their set, an empty table gives no rows.
    """
    spark = docs.sparkSession
    features = written(
        docs.select("doc_id", _features(F.col("text"), words, False).alias("f")).select("doc_id", "f.*"),
        scratch_dir(spark, "features"),
    )
    classes = written(
        features.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")),
        scratch_dir(spark, "classes"),
    )
    banded = classes.select("key", F.explode(_bands(F.col("sig"))).alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    buckets = written(banded.join(shared, "band").select("band", "key"), scratch_dir(spark, "buckets"))
    wanted = buckets.select("key").distinct().join(classes.select("key", "id"), "key").select(
        F.col("key").alias("wanted"), F.col("id").alias("wanted_id")
    )
    # The full sets are built anew for the classes that need them: cheaper than storing all.
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    members = written(
        texts.select("wanted", _features(F.col("text"), words, True).alias("f"))
        .where("f.key = wanted").select("f.*").dropDuplicates(["key"]),
        scratch_dir(spark, "members"),
    )
    roots = components(link_classes(members, buckets, percent, miss))
    joined = classes.select("key", "id").join(roots, F.col("key") == F.col("node"), "left").select(
        "key", "id", F.coalesce("root", "key").alias("root")
    )
    ids = joined.groupBy("root").agg(F.min("id").alias("component"))
    of_class = joined.join(ids, "root").select("key", "component")
    return features.select("doc_id", "n", "key").join(of_class, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
