"""The text operators in plain Python, for small tables: rows are (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

NOT_SPACE, ALNUM = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def one_edit(a: str, b: str) -> bool:
    """Equal, or one character inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def kept_lines(rows: list[tuple]) -> dict:
    """doc_id: text that is left, of rows with ids that differ."""
    lines = [(d, i, line) for d, t in sorted(rows) for i, line in enumerate((t or "").split("\n"))]
    first: dict[str, int] = {}
    for n, (_, _, line) in enumerate(lines):
        first.setdefault(line, n)
    kinds = sorted((x for x in first if x), key=first.get)
    by_length = defaultdict(list)
    near = set()
    for line in kinds:
        if any(one_edit(line, x) for k in (-1, 0, 1) for x in by_length[len(line) + k]):
            near.add(line)
        by_length[len(line)].append(line)
    out = defaultdict(list)
    for n, (d, _, line) in enumerate(lines):
        if not line or (first[line] == n and line not in near):
            out[d].append(line)
    return {d: None if t is None else "\n".join(out[d]) for d, t in rows}


def components(rows: list[tuple], k: int = 5) -> dict:
    """doc_id: the smallest id that links of Jaccard similarity 0.75 reach."""
    sets = {}
    for d, t in rows:
        w = NOT_SPACE.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    part = {d: d for d in sets}

    def root(d):
        while part[d] != d:
            d = part[d]
        return d

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    x, y = sorted((root(a), root(b)))
                    part[y] = x
    return {d: root(d) for d in ids}


def contaminated(rows: list[tuple], items: list[tuple], width: int = 13) -> dict:
    """doc_id: (words, hit words, contaminated)."""
    windows = set()
    for _, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        windows |= {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit = {j for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        out[d] = (len(w), len(hit), 0 < len(hit) and 20 * len(hit) >= len(w))
    return out


def removed_bytes(texts: list[str], n: int = 200) -> list[bytes]:
    """What is left of each text once strings of n bytes that start anywhere else too are gone."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[s : s + n] for t in raw for s in range(len(t) - n + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for s in range(len(t) - n + 1):
            if seen[t[s : s + n]] > 1:
                gone[s : s + n] = b"\1" * n
        out.append(bytes(x for x, g in zip(t, gone, strict=True) if not g))
    return out


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()
