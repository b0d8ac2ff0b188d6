"""Plain versions of the operators, to hold the distributed ones against."""

import hashlib
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def covered(sequences, width):
    """Which positions of each sequence lie in a window that begins earlier; sequences in order."""
    seen, out = set(), []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            key = tuple(s[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        out.append(gone)
    return out


def repeated_words(rows, width):
    rows = sorted(rows)
    words = [SPACE_WORD.findall(t or "") for _, t in rows]
    out = {}
    for (doc_id, _), w, gone in zip(rows, words, covered(words, width), strict=True):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[doc_id] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def repeated_bytes(rows, width):
    rows = sorted(rows)
    raw = [(t or "").encode() for _, t in rows]
    out = {}
    for (doc_id, _), b, gone in zip(rows, raw, covered(raw, width), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def components(prints, distance, linked=lambda i, j: False):
    """Smallest id reachable, of {id: fingerprint}; ``linked`` says which ids are linked besides."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= distance or linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def hits(docs, items, width):
    """{doc_id: (words, hit words, items)}."""
    windows = []
    for item, text in items:
        w = PLAIN_WORD.findall(lower(text))
        if w:
            windows += [(str(item), w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    out = {}
    for doc_id, text in docs:
        w = PLAIN_WORD.findall(lower(text))
        hit, found = set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    found.add(item)
        out[doc_id] = (len(w), len(hit), sorted(found))
    return out
