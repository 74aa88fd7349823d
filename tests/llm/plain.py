"""The operators' results in plain Python, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def components(rows, n=5, percent=80):
    """rows: (id, text) -> [(set size, least id reached)] in the order of rows."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None and (least[root(k)] is None or i < least[root(k)]):
            least[root(k)] = i
    return [(len(sets[k]), least[root(k)]) for k in range(len(rows))]


def line_key(line):
    key = line.strip(" \t\n\v\f\r").translate(LOWER)
    return key if len(key) >= 20 else None


def drop_lines(rows, least=3):
    """rows: (id, text), ids not null -> {id: (lines, dropped, kept text)}"""
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if line_key(line):
                holders[line_key(line)].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (line_key(x) and len(holders[line_key(x)]) >= least and max(holders[line_key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def drop_windows(rows, k=50):
    first, words = {}, [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            first[g] = min(first.get(g, i), i)
    out = {}
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def quality(text):
    w = WORD.findall(text or "")
    times = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if times[g] > 1 for j in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(again)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secret_spans(text):
    text = text or ""
    hits = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    hits += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    hits += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(hits))


def licence_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    at = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p]
    return len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def normal(text):
    return re.sub(r"[ \t\n\v\f\r]+", " ", (text or "").translate(LOWER)).strip(" ").encode()


def least_edits(pattern, text):
    """Edits of the pattern's best place in the text."""
    row = [0] * (len(text) + 1)
    for j, c in enumerate(pattern, 1):
        new = [j]
        for i, d in enumerate(text):
            new.append(min(row[i] + (c != d), row[i + 1] + 1, new[i] + 1))
        row = new
    return min(row)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
