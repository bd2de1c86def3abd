"""Plain versions of the operators, for small tables: no hashing, filters or caches."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None, lower: bool = False) -> list[str]:
    found = WORD.findall(text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in found] if lower else found


def components(ids: list, links: list[tuple]) -> dict:
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text: str | None, n: int) -> frozenset:
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard_components(texts: dict[int, str | None], n: int, percent: int) -> dict[int, int]:
    sets, holders = {i: shingles(t, n) for i, t in texts.items()}, defaultdict(list)
    shared: Counter = Counter()
    for i in sorted(sets):
        for x in sets[i]:
            shared.update((j, i) for j in holders[x])
            holders[x].append(i)
    links = [(a, b) for (a, b), k in shared.items() if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k)]
    return components(list(texts), links)


def removed_runs(texts: list[str | None], length: int = 400) -> list[list[tuple[int, int]]]:
    data, times = [(t or "").encode() for t in texts], Counter()
    for d in data:
        times.update(d[i : i + length] for i in range(len(d) - length + 1))
    out = []
    for d in data:
        runs: list[list[int]] = []
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        out.append([tuple(r) for r in runs])
    return out


def kept_bytes(text: str | None, runs: list[tuple[int, int]]) -> bytes:
    data = (text or "").encode()
    gone = {i for a, b in runs for i in range(a, b)}
    return bytes(x for i, x in enumerate(data) if i not in gone)


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text: str | None) -> list[tuple[int, str, int]]:
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def entropy_spans(text: str | None, base: list, limits, allowed: tuple) -> list[tuple[int, int, int]]:
    out = []
    for m in re.finditer(rf"[A-Za-z0-9+/_.=-]{{{limits.window},}}", text or ""):
        if any(re.search(p, m[0]) for p in allowed) or any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        bits = limits.hex_bits if re.fullmatch("[0-9a-fA-F]+", m[0]) else limits.alnum_bits if re.fullmatch("[A-Za-z0-9]+", m[0]) else limits.any_bits
        best = max(-sum(n / limits.window * math.log2(n / limits.window) for n in Counter(m[0][i : i + limits.window]).values()) for i in range(len(m[0]) - limits.window + 1))
        if best >= bits - 1e-12:
            out.append((m.start(), 3, m.end()))
    return out


def joined(spans: list[tuple[int, int, int]], kinds: tuple) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    if not spans:
        return text
    merged: list[list[int]] = []
    for a, _, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def rule_row(text: str | None) -> dict:
    t, w = text or "", words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    row = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": dup, "n_repeat_words": len(inside)}
    return row | {"base_failed": len(w) < 10 or 100 * len(inside) > 20 * len(w)}


def quality_kept(texts: list[str | None], hosts: list) -> list[bool]:
    rows = [rule_row(t) for t in texts]
    failed = [r["base_failed"] or 100 * r["n_dup_lines"] > 50 * r["n_words"] or 100 * r["n_symbols"] > 50 * r["n_words"] for r in rows]
    by = defaultdict(list)
    for h, f in zip(hosts, failed, strict=True):
        if h is not None:
            by[h].append(f)
    rates = [sum(x) / len(x) for x in by.values()]
    mean = sum(rates) / len(rates) if rates else 0.0
    spread = sum((r - mean) ** 2 for r in rates) / len(rates) if rates else 0.0
    weight = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1000.0
    bad = {h for h, x in by.items() if (sum(x) + mean * weight) / (len(x) + weight) > 0.5}
    return [not r["base_failed"] and h not in bad for r, h in zip(rows, hosts, strict=True)]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
