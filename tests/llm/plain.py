"""Plain Python versions of the operators' results, for comparison."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def personal(text):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def secrets(text):
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def copies(docs):
    """[(key, set size, smallest key reachable)] over all pairs that share a shingle."""
    sets, parent, index = [shingles(t) for _, t in docs], list(range(len(docs))), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for j in index.get(g, ()):
                common[j] = common.get(j, 0) + 1
            index.setdefault(g, []).append(i)
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def leak_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def leaks(docs, items):
    """[(key, words, hit words, items, digest of the items)]"""
    windows = {}
    for item, text in items:
        words = leak_words(text)
        n = min(len(words), 10)
        for j in range(len(words) - n + 1 if n else 0):
            windows.setdefault(n, {}).setdefault(tuple(words[j : j + n]), set()).add(item)
    out = []
    for key, text in docs:
        words, hit, found = leak_words(text), set(), set()
        for n, known in windows.items():
            for j in range(len(words) - n + 1):
                if tuple(words[j : j + n]) in known:
                    hit.update(range(j, j + n))
                    found |= known[tuple(words[j : j + n])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((key, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()))
    return out


def fewest(items, capacity):
    """The least number of bins, by trying."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + items[i] <= capacity:
                bins[j] += items[i]
                go(i + 1, bins)
                bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def segmentations(word, scores):
    """Probability of a word as the sum over all its cuts into pieces."""
    total = [1.0] + [0.0] * len(word)
    for high in range(1, len(word) + 1):
        total[high] = sum(total[low] * scores.get(word[low:high], 0.0) for low in range(high))
    return total[-1]


def spelled(docs):
    """[(word, n, n_near, form, form_n, root)] over all words and their spellings without one letter."""
    seen = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 7 and c >= 2}
    near, holes = {w: set() for w in n}, {}
    for w in n:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            holes.setdefault((i, short), []).append(w)
            if short in n:
                near[w].add(short), near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: b if b and n[b] >= 10 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n]


def filtered(docs, labels):
    """[(part, order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)], document by document."""
    good, toxic = ({k for k, *marks in labels if k is not None and marks[i] == 1} for i in (0, 1))
    rows = []
    for key, source, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)}
        failed |= {"D": bool(re.search("[#$%&*|]", text)), "E": key is not None and any(k is not None and k < key and (t or "") == text for k, _, t in docs)}
        rows.append((source or "", failed, key in good, key in toxic))
    out = []
    for part in {r[0] for r in rows}:
        steps, credit = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                lost, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                credit[f] += len(lost)
                failing = [r for r in rows if r[0] == part and r[1][f]]
                alone = sum(sum(r[1].values()) == 1 for r in failing)
                steps.append((f, "".join(order), step, len(left), len(lost), len(failing) - len(lost), alone, sum(r[2] for r in lost), sum(r[3] for r in lost)))
        out += [(part, *s[1:], credit[s[0]]) for s in steps]
    return out
