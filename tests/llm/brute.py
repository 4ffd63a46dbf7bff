"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter

import xxhash

WS = re.compile(r"[^\x20\x09-\x0D]+")


def ws(text):
    return WS.findall(text or "")


def edited(rows):
    """rows: (doc_id, text) in ascending doc_id -> the edited texts."""
    out = {}
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out[key] = text[: len(text) - half] + after[:half]
    return out


def quality(text):
    text = text or ""
    words = ws(text)
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if wins[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WS.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def licences(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def shingles(text, k=5):
    words = ws("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def components(ids, linked):
    """ids and pairs -> id -> smallest id that it reaches."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard_components(rows):
    sets = {k: shingles(t) for k, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {k: (len(sets[k]), c) for k, c in components(ids, linked).items()}


def repeats(rows, length=200):
    """(doc_id, text) -> doc_id: (n_bytes, n_removed, n_spans, sha of the rest)."""
    data = {k: (t or "").encode() for k, t in rows}
    seen = Counter(d[i : i + length] for d in data.values() for i in range(len(d) - length + 1))
    out = {}
    for k, d in data.items():
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        rest = bytes(b for b, g in zip(d, gone) if not g)
        out[k] = (len(d), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _mixed(seed, *values):
    """The 64-bit hash of a row of strings (UTF-8) and longs (eight bytes), chained from one value to the next."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (2**64 - 1)).to_bytes(8, "little"), seed)
    return seed


def order_minhash(text, k=5, parts=64, keep=2):
    """part -> eight hexadecimal digits: the part's smallest occurrence-numbered k-mers, in text order, hashed."""
    words = [_mixed(42, w) for w in ws(text)]
    if not words:
        return {}
    high, seen, numbered = lambda x: x >> 26, Counter(), []
    for i in range(max(1, len(words) - k + 1)):
        h = high(_mixed(42, *words[i : i + k]))
        occurrence = seen[h].to_bytes(4, "little")  # a 32-bit number is hashed as four bytes
        seen[h] += 1
        numbered.append((high(xxhash.xxh64_intdigest(occurrence, _mixed(42, h))), i))
    out = {}
    for part in [*range(parts // 2, parts), *range(parts // 2)]:  # hashes are signed: the upper half comes first
        mine = sorted(x for x in numbered if x[0] >> 32 == part)[:keep]
        if mine:
            in_order = [h for h, _ in sorted(mine, key=lambda x: (x[1], x[0]))]
            out[part] = f"{part << 26 | _mixed(42, *in_order) >> 38:08X}"
    return out


def agreement(a, b):
    either = a.keys() | b.keys()
    return sum(a.get(p) == b.get(p) for p in either) / len(either) if either else 1.0


def secrets(text):
    """(kind, start, end) of the three base patterns, by plain scanning."""
    found = []
    values = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    at = 0
    while at < len(text):
        end = next((at + len(w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if lower.startswith(w, at)), None)
        if end is None:
            at += 1
            continue
        if text[end : end + 1] in ('"', "'"):
            end += 1
        while text[end : end + 1] == " ":
            end += 1
        if text[end : end + 1] not in (":", "="):
            at += 1
            continue
        end += 1
        while text[end : end + 1] == " ":
            end += 1
        if text[end : end + 1] in ('"', "'"):
            end += 1
        stop = end
        while stop < len(text) and text[stop] in values:
            stop += 1
        if stop == end:
            at += 1
            continue
        if stop - end >= 12:
            found.append(("assign", at, stop))
        at = stop
    at = 0
    while at < len(text):
        stop = at + 4
        while text.startswith("AKIA", at) and stop < len(text) and text[stop] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
            stop += 1
        if not text.startswith("AKIA", at) or stop == at + 4:
            at += 1
            continue
        if stop - at >= 18:
            found.append(("access", at, stop))
        at = stop
    at = 0
    while at < len(text):
        stop = at
        while stop < len(text) and text[stop] in "0123456789abcdef":
            stop += 1
        if stop - at >= 16:
            found.append(("hex", at, stop))
        at = stop + 1
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
