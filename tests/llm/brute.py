"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: (doc_id, text): nulls, empty and odd texts, ties, repeated rows, hot copies, a long text.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (3, "The  quick\tbrown fox jumps over the lazy dog near the river\nbank today."),
    (4, None),
    (5, ""),
    (6, " \n"),
    (7, "one"),
    (8, "two words"),
    (8, "two words"),
    (9, "Étude 漢字 \x00 ퟿ ¤ ★ a¤b <|endoftext|> '’s it's"),
    (10, "word " * 6000 + "end"),
    *((20 + k, "Copy of a hot text that many rows share, word for word.") for k in range(40)),
    *((100 + k, f"Filler number {k} has its own words w{k} x{k * 7} y{k * 13} and z{k * k}.") for k in range(30)),
]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    least, size = {}, Counter(t for _, t in norm)
    for i, t in norm:
        least[t] = min(least.get(t, i), i)
    return sorted((i, least[t], size[t], sha(t)) for i, t in norm)


def simhash(text, k):
    import xxhash

    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, k):
    f = [simhash(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (f[a] ^ f[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = defaultdict(lambda: 2**63)
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least[find(a)], i)
    return sorted((i, format(f[a], "016x"), least[find(a)]) for a, (i, _) in enumerate(rows))


def warc(rows):
    best = {}
    for i, h in rows:
        best[h or ""] = max(best.get(h or "", i), i)
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    out = []
    for i, h in rows:
        h = h or ""
        last = best[h] == i
        out.append((i, len(h.encode()), digest(h), "response" if last else "revisit", None if last else best[h]))
    return sorted(out, key=repr)


def katz(rows, k=5):
    tokens = [(i, (t or "").encode().translate(LOWER).split() + [b" "]) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    one, two = Counter(), defaultdict(Counter)
    for i, ws in tokens:
        if not held(i):
            for a, b in zip([None, *ws], ws):
                one[b] += 1
                two[a][b] += 1
    n, v = sum(one.values()), len(one)

    def discounts(counts):
        c, out = Counter(counts), {}
        for r in range(1, k + 1):
            d = -1
            if c[1] and c[r] and (cut := (k + 1) * c[k + 1] / c[1]) < 1:
                d = ((r + 1) * c[r + 1] / c[r] / r - cut) / (1 - cut)
            out[r] = d if 0 < d < 1 else 1 - 0.5 / r
        return out

    d1, d2 = discounts(one.values()), discounts(x for c in two.values() for x in c.values())
    lost = sum(c * (1 - d1[c]) for c in one.values() if c <= k)
    scale, unknown = (n, lost / n) if lost else (n + 1, 1 / (n + 1))
    word = lambda w: d1.get(one[w], 1) * one[w] / scale if w in one else unknown
    back = {}
    for h, c in two.items():
        total, low = sum(c.values()), [r for r in c.values() if r <= k]
        left = sum(r * (1 - d2[r]) for r in low) / total if low else 1 / (total + 1)
        back[h] = (left / (1 - sum(map(word, c))), total + (not low))

    def pair(h, w):
        if w in two.get(h, ()):
            return d2.get(two[h][w], 1) * two[h][w] / back[h][1]
        return back.get(h, (1,))[0] * word(w)

    for h in [None, *(w for w, _ in one.most_common(3) if w != b" ")]:
        assert math.isclose(sum(pair(h, w) for w in one) + pair(h, b"no such"), 1)
    out = []
    for i, ws in tokens:
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws)
        out.append((i, held(i), len(ws), sum(w in one for w in ws), n, base, sum(math.log10(pair(a, b)) for a, b in zip([None, *ws], ws))))
    return sorted(out)


def token_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array([*x.ids, 2], "<u4") for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
