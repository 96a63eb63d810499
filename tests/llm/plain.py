"""Plain versions of the operators, from their definitions."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_failed(text):
    w = words(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    spots = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w) < 50 or 100 * len(spots) > 50 * len(w)


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", line.lower())).strip(" ")


def loose(line):
    w = line.split(" ")
    q = (len(w) + 1) // 4
    return {(k, *w[: q * k], *w[len(w) - q * (3 - k) :]) for k in range(4)} if len(w) >= 12 else set()


def frequent_lines(items, max_docs, min_distinct):
    """{host: lines to remove} for (host, text) items."""
    per = [(h, {x for x in map(normal, (t or "").split("\n")) if x}) for h, t in items]
    out = {}
    for host in {h for h, _ in per}:
        count = Counter(x for h, s in per if h == host for x in s)
        texts = {frozenset(s) for h, s in per if h == host and s}
        often = {x for x, n in count.items() if n > max_docs and sum(x in s for s in texts) > min_distinct}
        texts = [s for s in texts if s & often]
        varied = Counter(y for s in texts for y in set().union(*map(loose, s - often)))
        varied = {y for y, n in varied.items() if n > min_distinct} | set().union(*map(loose, often))
        rest = {s: frozenset(x for x in s if not loose(x) or (x not in often and not loose(x) & varied)) for s in texts}
        out[host] = {x for x in often if len({rest[s] for s in texts if x in s}) > min_distinct}
    return out


def quality_rules(items, max_docs=20, min_distinct=10, max_lost=0.7):
    """(kept flags, texts without frequent lines) for (key, host, text) items; rows of one key are judged together."""
    frequent = frequent_lines([(h, t) for _, h, t in items], max_docs, min_distinct)
    lost, total = Counter(), Counter()
    for key, host, text in items:
        lines = {x for x in map(normal, (text or "").split("\n")) if x}
        lost[key] += sum(x.count(" ") + 1 for x in lines & frequent[host])
        if lines & frequent[host]:
            total[key] = max(total[key], sum(x.count(" ") + 1 for x in lines))
    kept = [not base_failed(t) and not (lost[k] > 0 and lost[k] > max_lost * total[k]) for k, _, t in items]
    texts = ["\n".join(x for x in t.split("\n") if normal(x) not in frequent[h]) if t is not None else None for _, h, t in items]
    return kept, texts


def shingle_sets(texts, width):
    out = []
    for t in texts:
        w = words(lower(t))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def components(texts, width, percent):
    """A component number for each text."""
    sets, parent = shingle_sets(texts, width), list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    return [find(a) for a in range(len(sets))]


def tiling(doc, item, m):
    """Greedy string tiling: tokens of the item under tiles."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    m = min(m, len(item))
    while m:
        best, found = m, []
        for p in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while p + n < len(item) and d + n < len(doc) and doc[d + n] == item[p + n] and free_d[d + n] and free_i[p + n]:
                    n += 1
                if n > best:
                    best, found = n, [(p, d)]
                elif n == best:
                    found.append((p, d))
        if not found:
            return covered
        for p, d in found:
            if all(free_d[d : d + best]) and all(free_i[p : p + best]):
                free_d[d : d + best], free_i[p : p + best] = [False] * best, [False] * best
                covered += best
    return 0


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+", (text or "").lower())


def contaminated(text, items, m=5, threshold=0.5):
    doc = tokens(text)
    for item in map(tokens, items):
        w = min(m, len(item))
        if not w:
            continue
        seeds = {tuple(item[i : i + w]) for i in range(len(item) - w + 1)}
        if any(tuple(doc[i : i + w]) in seeds for i in range(len(doc) - w + 1)) and tiling(doc, item, m) >= threshold * len(item):
            return True
    return False
