"""Plain Python versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = words(lower(text))
    if 0 < len(w) < k:
        return {tuple(w)}
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(docs, k, num, den):
    """id -> (set size, least id reachable), over all pairs."""
    sets = {i: shingles(t, k) for i, t in docs}
    links = defaultdict(set)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    links[a].add(b)
                    links[b].add(a)
    out = {}
    for a in ids:
        seen, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[a] = (len(sets[a]), min(seen))
    return out


def repeat_words(text, size=5):
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - size + 1):
        at[tuple(w[i : i + size])].append(i)
    return len({i + j for p in at.values() if len(p) > 1 for i in p for j in range(size)})


def edit_one(a, b):
    """True if two word lists are one replaced, added or missing word apart, or equal."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def kneser_ney_ratios(corpus, toxic, ordinary, said, order=6, own=2.0, shared=0.75):
    """word -> log P(toxic) - log P(ordinary), by the definition, over plain dicts.

    ``corpus``, ``toxic`` and ``ordinary`` map words to counts.  Each letter of a word
    and its end mark is predicted from up to ``order`` - 1 letters before it.
    """
    from math import log

    def grams(word):
        marked = "\x01" + word + "\x02"
        return [(marked[max(0, i - order + 1) : i], marked[i]) for i in range(1, len(marked))]

    longest = defaultdict(int)
    for word, n in corpus.items():
        for c, x in grams(word):
            longest[c, x] += n
    # Below the longest context a gram counts the letters that come before it somewhere.
    every = {(c[k:], x) for c, x in longest for k in range(len(c) + 1)}
    before = defaultdict(int)
    for c, x in every:
        if c:
            before[c[1:], x] += 1

    def backoff(context, x, lengths=(None, 3, 1, 0)):
        lengths = [n for n in lengths if n is None or n < len(context)]
        if not lengths:
            return 1 / 256
        c = context if lengths[0] is None else context[len(context) - lengths[0] :]
        table = longest if lengths[0] is None else before
        total = sum(n for (k, _), n in table.items() if k == c)
        kinds = sum(1 for k, _ in table if k == c)
        return (max(table.get((c, x), 0) - shared, 0) + shared * kinds * backoff(context, x, lengths[1:])) / total

    def prob(counts, context, x):
        mine = defaultdict(int)
        for word, n in counts.items():
            for c, y in grams(word):
                if c == context:
                    mine[y] += n
        total = sum(mine.values())
        if not total:
            return backoff(context, x)
        freed = sum(min(n, own) for n in mine.values())
        return max(mine[x] - own, 0) / total + freed / total * backoff(context, x)

    out = {}
    for word in said:
        out[word] = 0.0
        for c, x in grams(word):
            seen = any(c == k for w in (*toxic, *ordinary) for k, _ in grams(w))
            known = any((c, x) == g for w in (*toxic, *ordinary) for g in grams(w))
            if known:
                out[word] += log(prob(toxic, c, x) / prob(ordinary, c, x))
            elif seen:  # only the freed masses differ
                a, b = (sum(n for w, n in k.items() for g in grams(w) if g[0] == c) for k in (toxic, ordinary))
                gaps = []
                for k, t in ((toxic, a), (ordinary, b)):
                    mine = defaultdict(int)
                    for w, n in k.items():
                        for g in grams(w):
                            if g[0] == c:
                                mine[g[1]] += n
                    gaps.append(sum(min(n, own) for n in mine.values()) / t if t else 1.0)
                out[word] += log(gaps[0] / gaps[1])
    return out
