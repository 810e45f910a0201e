"""Plain versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring(rows: list[tuple[int, str | None]], length: int = 13) -> dict:
    first: dict = {}
    words = {d: WORD.findall(t or "") for d, t in rows}
    for d, w in words.items():
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def components(nodes: list, links: list[tuple]) -> dict:
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def sections(text: str, spans: list[tuple[int, int]], tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(characters, tokens, crossing tokens) of each section, token by token."""
    out = [[e - s, 0, 0] for s, e in spans]
    for a, b in tokens:
        b = max(b, a + 1)
        held = [max(0, min(b, e) - max(a, s)) for s, e in spans]
        best = held.index(max(held))
        out[best][1] += 1
        out[best][2] += sum(h > 0 for h in held) > 1
    return [tuple(x) for x in out]


def subsequence_value(text: str, weight, decay: float, reach: int, classes) -> list[float]:
    """The weighted sum over all ordered triples of each span, divided by the span's own weight, triple by triple."""
    signs = [(int(classes[ord(c)]) if ord(c) < 65536 else 27 + ord(c) % 36) for c in f"  {text}  "]
    blank = [c == 63 for c in signs]
    alone = [0 < i < len(signs) - 1 and not blank[i] and blank[i - 1] and blank[i + 1] and signs[i] > 0 for i in range(len(signs))]
    left = [c for i, c in enumerate(signs) if c > 0 and not (blank[i] and 0 < i < len(signs) - 1 and alone[i - 1] and alone[i + 1])]
    opens = [i for i, c in enumerate(left) if c == 63]
    out = []
    for s, e in zip(opens, [*opens[1:], len(left) - 1], strict=True):
        span, total, own = left[s : e + 1], 0.0, 0.0
        for i in range(len(span) - 1):
            for j in range(i + 1, min(i + reach, len(span) - 1) + 1):
                for k in range(j + 1, min(j + reach, len(span) - 1) + 1):
                    if span[j] != 63:
                        w = decay ** (k - i)
                        total, own = total + w * weight(span[i], span[j], span[k]), own + w * w
        if own:
            out.append(total / own**0.5)
    return out
