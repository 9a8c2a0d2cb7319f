"""Plain versions of the operators' contracts, for small inputs only."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def suffix_dedup(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, sha(bytes(b for b, g in zip(d, gone) if not g))))
    return out


def words13(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def decontamination(texts, items, window=13):
    wins = defaultdict(set)
    for item, text in items:
        w = words13(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[i : i + window])].add(str(item))
    lengths = {len(k) for k in wins}
    out = []
    for t in texts:
        w, hit, own = words13(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    own |= wins[k]
        out.append((len(w), len(hit), len(own), sha(",".join(sorted(own)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, fps, k=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= k:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [least[find(i)] for i in range(len(ids))]


def secrets(text):
    text, out = text or "", []
    kinds = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    for k, (name, rx, group, least) in enumerate(kinds):
        out += [(m.start(), k, name, m.end()) for m in rx.finditer(text) if len(m[group]) >= least]
    out.sort()
    return Counter(x[2] for x in out), ",".join(f"{n}:{s}:{e}" for s, _, n, e in out)


def secret_spans(texts, owners, repos, max_owners, max_repos):
    """Base and live spans of each text; a value is live by distinct owners, distinct repositories and looks."""
    kinds = ((re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24))
    names = ("assign", "access", "hex", "live")
    found = [[(m.start(), k, m.end(), m[g]) for k, (rx, g, least) in enumerate(kinds) for m in rx.finditer(t or "") if len(m[g]) >= least] for t in texts]
    owned, stored = defaultdict(set), defaultdict(set)
    for f, o, r in zip(found, owners, repos):
        for *_, value in f:
            owned[value].add(o)
            stored[value].add(r)
    live = lambda v: len(owned[v]) <= max_owners and len(stored[v]) <= max_repos and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= 8
    out = []
    for f in found:
        spans = f + sorted({(e - len(v), 3, e, v) for _, _, e, v in f if live(v)})
        out.append(",".join(f"{names[k]}:{s}:{e}" for s, k, e, _ in sorted(spans)))
    return out


def exact(ids, texts):
    groups = defaultdict(list)
    for d, t in zip(ids, texts):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d))
    keep = {n: (min(g)[1], len(g)) for n, g in groups.items()}
    out = []
    for d, t in zip(ids, texts):
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        out.append((keep[n][0], keep[n][1], d == keep[n][0], sha(n.encode())))
    return out


def lm_base(ids, texts):
    toks = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""] for t in texts]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d in ids]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for t, h in zip(toks, held)]


def bpe(texts):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for t in texts:
        ids = enc.encode_ordinary(t or "")
        out.append((len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode())))
    return out
