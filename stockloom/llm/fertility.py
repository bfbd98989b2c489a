"""Quality rule on tokeniser fertility.

Two public vocabularies, one with byte fallback and one byte-level, measure characters per
token, the share of byte-fallback tokens and the entropy of the tokens of a text. Each script
has its own band; a text outside the band of its main script is rejected, as is one that
fails the base rules on words and repetition.
"""

from __future__ import annotations

import base64
import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """What a script's texts may measure; few tokens widen the lower bounds by ``slack / sqrt(tokens)``.

    ``entropy`` gives bits of token entropy at least, by log2 of the number of tokens, linear in
    between; below its first point nothing is asked.
    """

    piece_chars: tuple[float, float] = (1.6, 9.0)
    byte_chars: tuple[float, float] = (2.2, 9.0)
    fallback: float = 0.12
    entropy: tuple[tuple[float, float], ...] = ((6, 4.6), (7, 5.3), (8, 5.75), (9, 6.05), (10, 6.25), (11, 6.35), (12, 6.4))
    slack: float = 2.0


# Vocabularies know Latin script best; others need more tokens and more fallback.
_FLAT = ((6, 3.5), (9, 4.5))
BANDS = {
    "latin": Band(),
    "greek": Band((0.6, 6.0), (0.6, 6.0), 0.3, _FLAT),
    "cyrillic": Band((0.8, 7.0), (0.8, 7.0), 0.3, _FLAT),
    "han": Band((0.3, 3.0), (0.3, 3.0), 0.9, _FLAT),
    "kana": Band((0.3, 3.0), (0.3, 3.0), 0.9, _FLAT),
    "hangul": Band((0.3, 3.0), (0.3, 3.0), 0.95, _FLAT),
    "other": Band((0.25, 9.0), (0.25, 9.0), 1.0, _FLAT),
}
# First and last code points of scripts; fixed values of the Unicode standard.
SCRIPTS = (
    (0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC0, 0x24F, "latin"), (0x370, 0x3FF, "greek"), (0x400, 0x52F, "cyrillic"),
    (0x590, 0x10FF, "other"), (0x1100, 0x11FF, "hangul"), (0x1E00, 0x1EFF, "latin"), (0x3040, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
)
_FIELDS = (
    ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"),
    ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"), ("script", "string"),
    ("piece_chars_per_token", "double"), ("byte_chars_per_token", "double"), ("fallback_share", "double"),
    ("token_entropy", "double"), ("outside", "string"),
)


_NAMES = tuple(dict.fromkeys(name for _, _, name in SCRIPTS))  # the first of equals wins
_ASCII_LETTER = re.compile("[A-Za-z]")


@lru_cache(1)
def _script_table() -> np.ndarray:
    """The number of the script of every code point in ``_NAMES``, their count where it has none."""
    table = np.full(0x110000, len(_NAMES), np.uint8)
    for low, high, name in SCRIPTS:
        table[low:high + 1] = _NAMES.index(name)
    return table


def script_of(text: str) -> str:
    """The script of most letters; ``other`` where there are none."""
    if text.isascii():
        return "latin" if _ASCII_LETTER.search(text) else "other"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    counts = np.bincount(_script_table()[points], minlength=len(_NAMES) + 1)[: len(_NAMES)]
    best = int(counts.argmax())
    return _NAMES[best] if counts[best] else "other"


_MIX = np.int64(0x1E3779B97F4A7C15)


def repeated_words(words: list[bytes], span: int = 5) -> int:
    """Words that lie in a window of ``span`` words found twice or more, the first one included."""
    if len(words) <= span:
        return 0
    # A window whose hash no other has is alone; only where hashes agree are the words compared.
    hashes, n = np.fromiter(map(hash, words), np.int64, len(words)), len(words) - span + 1
    mixed = np.zeros(n, np.int64)
    for i in range(span):
        mixed = mixed * _MIX + hashes[i:i + n]
    order = np.argsort(mixed)
    same = np.diff(mixed[order]) == 0
    if not same.any():
        return 0
    alike = np.sort(order[np.r_[same, False] | np.r_[False, same]])
    first: dict = {}
    inside = np.zeros(len(words) + 1, np.int64)
    for i in alike.tolist():
        j = first.setdefault(tuple(words[i:i + span]), i)
        if j != i:
            for at in (i, j):
                inside[at] += 1
                inside[min(at + span, len(words))] -= 1
    return int((np.cumsum(inside)[: len(words)] > 0).sum())


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbol characters, repeated lines and repeated words of a text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return (
        len(words), len(text) - sum(raw.count(b) for b in b" \t\n\r\x0b\x0c"), sum(raw.count(b) for b in SYMBOLS),
        len(lines) - len(set(lines)), repeated_words(words),
    )


def entropy_bits(counts: np.ndarray) -> float:
    """Entropy of tokens by their counts, in bits."""
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def outside_band(band: Band, n: int, piece: float, byte: float, fallback: float, entropy: float) -> list[str]:
    """Names of the measures outside the band of a text of ``n`` tokens."""
    slack = band.slack / math.sqrt(n)
    floor = np.interp(math.log2(n), *zip(*band.entropy)) if math.log2(n) >= band.entropy[0][0] else 0.0
    found = {
        "piece_chars": not band.piece_chars[0] - slack <= piece <= band.piece_chars[1],
        "byte_chars": not band.byte_chars[0] - slack <= byte <= band.byte_chars[1],
        "fallback": fallback > band.fallback + slack / 2,
        "entropy": entropy < floor,
    }
    return [k for k, bad in found.items() if bad]


class _Meter:
    """Both vocabularies, loaded once per Python worker."""

    def __init__(self, pieces: str | None, ranks: str | None) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces or public_tokenizers.path(PIECES))
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})

    def measure(self, text: str | None, bands: dict[str, Band]) -> tuple:
        text = text or ""
        words, chars, symbols, lines, repeats = base_measures(text)
        failed = words < 10 or 100 * repeats > 20 * words
        base = (words, chars, symbols, lines, repeats, failed)
        ids = self.pieces.encode(text, num_threads=1) if words else []
        if not ids:
            return (*base, False, None, None, None, None, None, None)
        coarse = self.ranks.encode_ordinary(text)
        script = script_of(text)
        kinds, counts = np.unique(np.array(ids, np.int32), return_counts=True)
        fallback = float(counts[self.is_byte[kinds]].sum() / len(ids))
        piece, byte, bits = len(text) / len(ids), len(text) / len(coarse), entropy_bits(counts)
        outside = outside_band(bands.get(script, bands["other"]), len(ids), piece, byte, fallback, bits)
        return (*base, not failed and not outside, script, piece, byte, fallback, bits, ",".join(outside))


def assess(text: Column, bands: dict[str, Band] | None = None, pieces: str | None = None, ranks: str | None = None) -> Column:
    """A struct of the base measures, the fertility measures and the verdict ``kept`` for a whole text.

    ``pieces`` and ``ranks`` are paths of the vocabulary files on the executors. Null and empty texts and
    texts of white space have zero words, fail the base rules and carry null fertility measures.
    Each row is judged alone: repeated rows get equal structs, an empty table none, and the
    other columns of the table play no part.
    """
    own = bands or BANDS
    meters: list[_Meter] = []
    types = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}

    def judge(texts: pa.Array) -> pa.Array:
        if not meters:
            meters.append(_Meter(pieces, ranks))
        rows = [meters[0].measure(t.as_py(), own) for t in texts]
        columns = list(zip(*rows)) or [()] * len(_FIELDS)
        return pa.StructArray.from_arrays(
            [pa.array(c, types[kind]) for c, (_, kind) in zip(columns, _FIELDS)], [name for name, _ in _FIELDS]
        )

    judge.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    schema = ", ".join(f"{name}: {kind}" for name, kind in _FIELDS)
    # Marked so that Catalyst evaluates it once when a filter and a projection both use it.
    return F.arrow_udf(judge, f"struct<{schema}>").asNondeterministic()(text)
