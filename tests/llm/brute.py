"""Plain versions of the operators, one text at a time, to compare with."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality(text, boilerplate):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bad_lines, n_lost_words)"""
    text = text or ""
    words = WORD.findall(text)
    seen, dup, lost, bad, full = set(), 0, 0, 0, 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        n = len(own)
        if not n:
            continue
        full += 1
        dup += line in seen
        seen.add(line)
        again = sum(a == b for a, b in zip(own, own[1:]))
        phrases = len(re.findall("|".join(boilerplate), line, re.IGNORECASE | re.ASCII)) or -1
        bars, shouts = line.count("|"), line.count("!") + line.count("?")
        fails = (
            (bars >= 2 and 5 * bars >= n)
            or (n >= 10 and not re.search("[.!?;:。．｡！？；：…।؟؛۔።։]", line))
            or (shouts >= 4 and 2 * shouts > n)
            or 2 * len(re.findall(r"[#*$%&|<>]", line)) > n
            or (n >= 10 and 2 * again > n)
            or 20 * phrases >= n
        )
        bad += fails
        lost += n * fails
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, dup, len(covered), full, bad, lost


def shingles(text):
    words = WORD.findall((text or "").translate(SMALL))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(rows):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) rows with distinct ids."""
    rows = list(rows)
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows)}


def links(rows):
    """{doc_id: number of other rows at a similarity of 0.8 or more} of (doc_id, text) rows with distinct ids."""
    sets = {doc_id: shingles(text) for doc_id, text in rows}
    close = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    return {i: sum(bool(close(a, b)) for j, b in sets.items() if i != j) for i, a in sets.items()}


def top_k(rows, k):
    """[(query_id, rank, vec_id, score)] of (vec_id, whole numbers) rows."""
    out = []
    for query_id, q in rows:
        if query_id % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != query_id and len(v) == len(q)]
        out += [(query_id, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def rows_linked(rows):
    """[(doc_id, n_shingles, component_id, n_links)] of (doc_id, text) rows; ids may repeat or be null."""
    sets = [shingles(text) for _, text in rows]
    able = [bool(s) and i is not None for s, (i, _) in zip(sets, rows)]
    close = [
        [b for b in range(len(rows)) if b != a and able[a] and able[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        for a in range(len(rows))
    ]
    group = [None] * len(rows)
    for start in range(len(rows)):
        reach = [start] if group[start] is None else []
        while reach:
            here = reach.pop()
            group[here] = start
            reach += [x for x in close[here] if group[x] is None]
    least = {}
    for g, able_here, (i, _) in zip(group, able, rows):
        if able_here:
            least[g] = min(least.get(g, i), i)
    return [(i, len(s), least[g] if a else i, len(c)) for (i, _), s, g, a, c in zip(rows, sets, group, able, close)]
