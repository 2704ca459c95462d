"""Plain Python forms of the corpus operators, straight from their definitions."""

import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(docs, size=20):
    """docs: list of (doc_id, text) -> {doc_id: (n_words, n_removed, kept_sha256)}"""
    words = {d: SPACED.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for k in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][k : k + size]), (d, k))
    out = {}
    for d, own in words.items():
        gone = [False] * len(own)
        for k in range(len(own) - size + 1):
            if first[tuple(own[k : k + size])] != (d, k):
                gone[k : k + size] = [True] * size
        out[d] = (len(own), sum(gone), sha(" ".join(w for w, g in zip(own, gone) if not g)))
    return out


def shingles(text, size):
    own = SPACED.findall(fold(text))
    return {tuple(own)} if 0 < len(own) < size else {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}


def near_duplicates(docs, size=4, percent=80):
    """-> {doc_id: (n_shingles, component_id)}, every pair that shares a shingle compared"""
    sets = {d: shingles(t, size) for d, t in docs}
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = {(a, b) for own in by.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def contamination(docs, items, size=10):
    """-> {doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    windows = {}
    for i, text in items:
        own = ALNUM.findall(fold(text))
        n = min(size, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[k : k + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        own = ALNUM.findall(fold(text))
        hit, found = [False] * len(own), set()
        for n in sizes:
            for k in range(len(own) - n + 1):
                if w := windows.get(tuple(own[k : k + n])):
                    hit[k : k + n] = [True] * n
                    found |= w
        out[d] = (len(own), sum(hit), len(found), sha(",".join(sorted(found))), any(hit))
    return out


def luhn(digits):
    total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def personal(text):
    """Base spans (start, kind order, kind, end)"""
    text = text or ""
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip('0')) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)
