"""Plain Python twins of the operators, over small lists of rows."""

import re
from collections import Counter, defaultdict
from itertools import combinations

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def lowered(text):
    return (text or "").translate(UPPER)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def shingles(text):
    w = spaced(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_documents(docs):
    """{id: (n_shingles, component)} of {id: text}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(sets, links)
    return {i: (len(sets[i]), root[i]) for i in docs}


WIDE = "[฀-࿿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]"


def units(words):
    return [u for w in words for u in re.findall(f"{WIDE}|(?:(?!{WIDE}).)+", w, re.S)]


def edit_one(a, b):
    """Unit edit distance of at most one, by trying all edits."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) == len(short) + 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def kept_lines(docs):
    """{id: text} cut to the lines that stay; ids in order."""
    first = {}
    for i in sorted(docs):
        for k, line in enumerate((docs[i] or "").split("\n")):
            if w := tuple(spaced(line)):
                first.setdefault(w, (i, k))
    cut = {w: units(w) for w in first}
    long_ = [w for w in first if sum(1 if re.fullmatch(WIDE, u) else 2 for u in cut[w]) >= 8]
    meet = defaultdict(list)  # lines one edit apart share a half, counted from either end
    for w in long_:
        n = len(cut[w])
        for half in {("first", *cut[w][: n // 2]), ("first", *cut[w][: (n - 1) // 2]), ("last", *cut[w][n - n // 2 :]), ("last", *cut[w][n - (n - 1) // 2 :])}:
            meet[half].append(w)
    near = {w for group in meet.values() for w in group for v in group
            if first[v] < first[w] and abs(len(cut[v]) - len(cut[w])) < 2 and edit_one(cut[v], cut[w])}
    stays = lambda i, k, w: not w or (first[w] == (i, k) and w not in near)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if stays(i, k, tuple(spaced(x)))) for i, t in docs.items()}


def contaminated(docs, items):
    """{id: (n_words, hit word numbers, item names)}."""
    windows = defaultdict(set)
    for name, text in items:
        w = plain_words(text)
        for i in range(len(w) - min(10, len(w)) + 1):
            if w:
                windows[tuple(w[i : i + min(10, len(w))])].add(name)
    sizes = {len(k) for k in windows}
    out = {}
    for i, text in docs.items():
        w, hit, names = plain_words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    names |= found
        out[i] = (len(w), hit, names)
    return out


def cut_words(text, hit):
    """`text` without its hit stretches, from the first byte of a stretch to the end of its last word."""
    spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))]
    out, at = [], 0
    for k, (start, end) in enumerate(spans):
        if k in hit:
            if k - 1 not in hit:
                out.append(text[at:start])
            at = end
    return "".join(out) + text[at:]


def profile(grams, top=300):
    return [g for g, _ in sorted(Counter(grams).items(), key=lambda x: (-x[1], x[0]))[:top]]
