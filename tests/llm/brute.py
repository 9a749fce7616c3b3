"""Plain restatements of what the operators must return, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def classes(nodes, links):
    """Least member of the connected component of every node."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(rows, threshold=0.8, size=5):
    """Class ids of (doc_id, text) rows by exact Jaccard similarity of all pairs."""
    sets, holders = {}, defaultdict(list)
    links = []
    whole = {}
    for doc, text in rows:
        if doc is None or text is None:
            continue
        if text in whole:
            links.append((whole[text], doc))
            continue
        whole[text] = doc
        w = words(text)
        own = {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        sets[doc] = sets.get(doc, set()) | own if doc in sets else own
        for s in own:
            holders[s].append(doc)
    shared = defaultdict(int)
    for docs in holders.values():
        for i, a in enumerate(docs):
            for b in docs[i + 1:]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if a != b and n / (len(sets[a]) + len(sets[b]) - n) >= threshold:
            links.append((a, b))
    return classes({d for d, _ in rows if d is not None}, links)


def repeated_bytes(rows, width=100):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256) by a table of all strings."""
    seen, out = set(), {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - width + 1):
            name = data[i:i + width]
            if name in seen:
                gone[i:i + width] = True
            seen.add(name)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[doc] = (len(data), int(gone.sum()), spans, digest(kept))
    return out


def contamination(rows, items, window=10):
    """doc_id -> (n_words, n_hit, item ids) by a table of all windows."""
    names = defaultdict(set)
    for item, text in items:
        w = words(text)
        if item is not None:
            for i in range(max(1, len(w) - window + 1) if w else 0):
                names[tuple(w[i:i + window])].add(item)
    sizes = {len(n) for n in names}
    out = {}
    for doc, text in rows:
        w = words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                owners = names.get(tuple(w[i:i + size]))
                if owners:
                    found |= owners
                    hit.update(range(i, i + size))
        out[doc] = (len(w), len(hit), found)
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(digits):
    doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10))
               for k, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def personal(text):
    """Base spans (kind, start, end) straight from the patterns."""
    text = text or ""
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text)
              if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and checksum(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text)
              if 10 <= len(re.findall("[0-9]", m.group())) <= 15]
    rank = ("email", "ip", "card", "phone")
    return sorted(found, key=lambda s: (s[1], rank.index(s[0])))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return lower(host), re.match(r"[^?#]*", rest[len(host):]).group()


def url_rule(url, rules=RULES):
    host, path = url_parts(url)
    fits = [(len(h + p), v == "allow", h + p, v) for v, h, p in rules
            if path.startswith(p) and (host == h or host.endswith("." + h))]
    return max(fits)[2:] if fits else (None, None)


def nearest(rows, k=5, every=50):
    """query -> [(vec_id, score)] by cosine with every other vector."""
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[i] = np.array(v, float)
    out = {}
    for q, a in sound.items():
        if q % every == 0:
            found = [(-float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), i)
                     for i, b in sound.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def crc(text):
    return zlib.crc32((text or "").encode())
