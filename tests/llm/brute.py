"""Plain versions of the operators, straight from their definitions, for small inputs."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def simhash(text, size=4):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, bits=4):
    prints = [(i, simhash(t)) for i, t in rows]
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= bits:
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, f"{fp:016x}", least.get(root(k))) for k, (i, fp) in enumerate(prints)]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 18:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 2, m.end()))
    return sorted(out)


def listed(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def without_repeats(rows, size=20):
    """rows of (id, text) to (id, n_words, n_removed, kept)."""
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, words in sorted(texts, key=lambda r: r[0]):
        for s in range(len(words) - size + 1):
            first.setdefault(tuple(words[s : s + size]), (i, s))
    out = []
    for i, words in texts:
        gone = set()
        for s in range(len(words) - size + 1):
            if first[tuple(words[s : s + size])] != (i, s):
                gone.update(range(s, s + size))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), sha(" ".join(kept))))
    return out


def contamination(rows, items, size=10):
    windows = {}
    for i, t in items:
        words = ITEM_WORD.findall(lower(t))
        for s in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[s : s + size]), set()).add(str(i))
    out = []
    for i, t in rows:
        words, hit, found = ITEM_WORD.findall(lower(t)), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(words) - n + 1):
                w = tuple(words[s : s + n])
                if w in windows:
                    hit.update(range(s, s + n))
                    found |= windows[w]
        out.append((i, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out
