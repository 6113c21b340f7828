"""Plain versions of what the operators compute, and tables that hold every odd case."""

import re
from collections import Counter

SPACE = r"[^\x20\x09-\x0D]+"

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, __rule_x int, component_id string"


def odd_documents(spark, more=()):
    """Nulls in each column, empty, blank and very long texts, repeated rows, and columns whose names operators use."""
    base = "Some words that stand here for a text of a document number one with a tail " * 5
    texts = [(1, base), (2, base), (2, base), (3, ""), (4, None), (5, " \n\t "), (6, LONG), (7, LONG + " end"), (8, "one two"), (9, "ONE two"), (10, "x" * 5000), (None, base), (None, None), *more]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else "s", None, 0.0, "z", 1, "c") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def empty(frame):
    return frame.where("1 = 0")


def words(text):
    return re.findall(SPACE, text or "")


def shingles(text, size):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def groups(sets, percent):
    """Smallest reachable key of each by exact comparison of all pairs."""
    keys = sorted(sets)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}


def rule_counts(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = [False] * len(w)
    for k in range(len(w) - 2):
        if grams[tuple(w[k : k + 3])] > 1:
            marked[k : k + 3] = [True] * 3
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, sum(marked)
