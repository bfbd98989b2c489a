"""Exact token counts at every prefix of a text, by dynamic programming.

Byte-pair encodings have the property that a sequence of tokens is the encoding of its bytes
exactly if every two neighbours are the encoding of theirs. So the last token of the encoding
of a prefix is the one token that ends there and fits the last token of the prefix before it,
and one pass over a pre-token gives the count of each of its prefixes. Counts are kept as one
signed step per code point, so truncation and budget questions are running sums.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
CACHE_ENTRIES = 400_000  # distinct pre-tokens and token pairs a worker remembers; a full cache starts anew

# Fixed by the vocabulary's byte-level pre-tokeniser.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATE_CONTRACTIONS = ("'re", "'ve", "'ll")  # their two-character prefix is two pre-tokens


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Remembered(dict):
    """Values of a function by argument; a full table starts anew and long arguments are not kept."""

    def __init__(self, made: Callable[[str], bytes]) -> None:
        super().__init__()
        self.made = made

    def __missing__(self, piece: str) -> bytes:
        value = self.made(piece)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = value
        return value


class PrefixCounter:
    """Prefix counts under a byte-level BPE vocabulary file; one per Python worker."""

    def __init__(self, path: str | None = None) -> None:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        special = [t["content"] for t in described["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.names = [b"", *(raw(t) for t in described["model"]["vocab"] if t not in special)]
        self.ending = ahocorasick.Automaton()  # finds the tokens that end at each byte, the longest first
        for number, token in enumerate(self.names[1:], 1):
            self.ending.add_word(token.decode("latin-1"), (number, len(token)))
        self.ending.make_automaton()
        self.ranks = {}
        for rank, merge in enumerate(described["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[raw(left), raw(right)] = rank
        self.made = {left + right: ((left, right), rank) for (left, right), rank in self.ranks.items()}
        self.left: dict = {}
        self.right: dict = {}
        self.find = regex.compile(PRETOKENS).findall
        self.spaces = regex.compile(r"(?<!\s)\s\s++(?=\S)").finditer  # one try for a run
        self.fits: dict[int, bool] = {}
        self.steps = _Remembered(self._count)

    def _encode(self, raw: bytes) -> list[bytes]:
        """Plain byte-pair merging, for the bytes of one or two tokens."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            pairs = [self.ranks.get(p, len(self.ranks)) for p in zip(parts, parts[1:])]
            best = min(pairs)
            if best == len(self.ranks):
                break
            left, right = next(p for p, r in zip(zip(parts, parts[1:]), pairs) if r == best)
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == left and parts[i + 1] == right:
                    merged.append(left + right)
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return parts

    def _edge(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """Parts of a token that stood at its right or left end while it was merged, and the rank that ended each."""
        spine, end = [(token, len(self.ranks))], self.made.get(token)
        while end is not None:
            pair, rank = end
            spine.append((pair[right], rank))
            end = self.made.get(pair[right])
        return spine

    def _fit(self, before_number: int, number: int) -> bool:
        """Whether the two tokens are the encoding of their bytes: no merge crosses the border between them.

        A pair of parts at the border merges if its rank comes before the merges that end
        either part; of equal ranks the one further left is merged first.
        """
        if len(self.fits) >= CACHE_ENTRIES:
            self.fits.clear()
        before, token = self.names[before_number], self.names[number]
        if not before:
            fit = self._encode(token) == [token]
        else:
            if before not in self.right:
                self.right[before] = self._edge(before, True)
            if token not in self.left:
                self.left[token] = self._edge(token, False)
            rank, fit = self.ranks.get, True
            for a, a_ends in self.right[before]:
                for b, b_ends in self.left[token]:
                    crossing = rank((a, b))
                    if crossing is not None and crossing < a_ends and crossing <= b_ends:
                        fit = False
        self.fits[before_number * len(self.names) + number] = fit
        return fit

    def byte_prefixes(self, raw: bytes) -> list[int]:
        """Token counts of ``raw[:1], raw[:2], ...``, taken as one pre-token each."""
        last, counts = [0] * (len(raw) + 1), [0] * (len(raw) + 1)
        known, size, decided = self.fits.get, len(self.names), -1
        for end, (number, length) in self.ending.iter(raw.decode("latin-1")):
            if end == decided:
                continue
            start = end + 1 - length
            before = last[start]
            fit = known(before * size + number)
            if fit or fit is None and self._fit(before, number):
                last[end + 1], counts[end + 1], decided = number, counts[start] + 1, end
        if 0 in last[1:]:
            raise ValueError(f"no encoding of {raw!r}")
        return counts[1:]

    def _count(self, piece: str) -> bytes:
        """Steps of a pre-token: the change of the count with each code point, as signed bytes."""
        raw = piece.encode("utf-8")
        counts = self.byte_prefixes(raw)
        if len(raw) != len(piece):
            ends, at = [], -1
            for c in piece:
                at += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
                ends.append(at)
            counts = [counts[e] for e in ends]
        if piece in _LATE_CONTRACTIONS:
            counts[1] = 2
        return bytes([(b - a) % 256 for a, b in zip([0, *counts], counts)])

    def _segment(self, text: str) -> tuple[list[str], bytearray]:
        """Pre-tokens and steps of a text without special tokens."""
        pieces = self.find(text)
        steps = bytearray(b"".join(map(self.steps.__getitem__, pieces)))
        for run in self.spaces(text):
            # All but the last character is one pre-token; cut after the last, the whole run is.
            at = run.end() - 1
            change = self._sum(run[0]) - self._sum(run[0][:-1]) - self._sum(run[0][-1])
            if change:
                steps[at] = (_signed(steps[at]) + change) % 256
                steps[at + 1] = (_signed(steps[at + 1]) - change) % 256
        return pieces, steps

    def _sum(self, piece: str) -> int:
        return int(np.frombuffer(self.steps[piece], np.int8).sum())

    def steps_of(self, text: str) -> bytes:
        """One signed byte per code point; their running sum is the token count of each prefix."""
        whole, at = bytearray(), 0
        for match in self.special.finditer(text) if self.special else ():
            pieces, steps = self._segment(text[at : match.start()])
            whole += steps
            # Inside its string a special token is ordinary text that may merge with what stands before.
            tail = "".join(pieces[-2:])
            before = now = sum(map(self._sum, pieces[-2:]))
            for cut in range(1, len(match[0])):
                count = sum(map(self._sum, self.find(tail + match[0][:cut])))
                whole.append((count - now) % 256)
                now = count
            whole.append((before + 1 - now) % 256)
            at = match.end()
        return bytes(whole + self._segment(text[at:])[1])


def _signed(byte: int) -> int:
    return byte - 256 if byte > 127 else byte


def index(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id") -> DataFrame:
    """The stored prefix counts of every whole text: ``key, n_bytes, steps``.

    ``steps`` has one signed byte per code point. ``vocabulary`` is the file's path on the executors. A null
    text counts as empty and has no steps; every row is kept, repeated rows too; other columns
    are left out.
    """
    counters: list[PrefixCounter] = []

    def count(texts: pa.Array) -> pa.Array:
        if not counters:
            counters.append(PrefixCounter(vocabulary))
        return pa.array([counters[0].steps_of(t.as_py() or "") for t in texts], pa.binary())

    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    steps: Column = F.arrow_udf(count, "binary")("text")
    return docs.select(
        key, F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), steps.alias("steps")
    )


def answer(indexed: DataFrame, budget: int | None = None, chars: int | None = None, key: str = "doc_id") -> DataFrame:
    """Answers from stored steps, without a tokeniser: ``key, n_bytes, n_tokens, budget_chars, prefix_tokens``.

    ``budget_chars`` is the length of the longest prefix of at most ``budget`` tokens, ``prefix_tokens`` the count of
    the first ``chars`` code points (of all, if there are fewer); null where the question is not asked.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw in batch["steps"]:
                counts = np.cumsum(np.frombuffer(raw, np.int8), dtype=np.int64)
                total = int(counts[-1]) if len(counts) else 0
                within = prefix = None
                if budget is not None:
                    fitting = np.flatnonzero(counts <= budget)
                    within = int(fitting[-1]) + 1 if len(fitting) else 0
                if chars is not None:
                    prefix = int(counts[min(chars, len(counts)) - 1]) if chars and len(counts) else 0
                rows.append((total, within, prefix))
            found = pd.DataFrame(rows, columns=["n_tokens", "budget_chars", "prefix_tokens"]).astype("Int64")
            yield pd.concat([batch[[key, "n_bytes"]].reset_index(drop=True), found], axis=1)

    kind = dict(indexed.dtypes)[key]
    return indexed.select(key, "n_bytes", "steps").mapInPandas(
        ask, f"{key} {kind}, n_bytes bigint, n_tokens bigint, budget_chars bigint, prefix_tokens bigint"
    )
