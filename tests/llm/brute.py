"""Plain Python versions of what the operators compute, taken from their contracts."""

from __future__ import annotations

import hashlib
import itertools
import re

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    found = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(BASE[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def span_digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_quality(text: str | None) -> tuple[int, int, int, int, int]:
    own = words(text)
    windows: dict = {}
    for i in range(len(own) - 4):
        windows.setdefault(tuple(own[i : i + 5]), []).append(i)
    repeated = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            copies += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), copies, len(repeated)


def shingles(text: str | None, span: int) -> frozenset:
    own = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return frozenset()
    if len(own) < span:
        return frozenset([tuple(own)])
    return frozenset(tuple(own[i : i + span]) for i in range(len(own) - span + 1))


def near_components(rows: list[tuple], span: int, percent: int) -> dict:
    """Smallest id reachable over links, by comparing all pairs."""
    sets = {i: shingles(t, span) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        one, two = sets[a], sets[b]
        if one and two and 100 * len(one & two) >= percent * len(one | two):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}
