"""Plain Python versions of operators, over lists of (doc_id, text)."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def best_of_equal(docs):
    """doc_ids that exact deduplication keeps."""
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {min(members)[1] for members in groups.values()}


def components(docs):
    """(number of shingles, smallest doc_id of the component) by doc_id."""
    sets = {}
    for i, t in docs:
        w = lowered_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def spoken(text):
    return WORD.findall(re.sub(r"[!-/:-@\[-`{-~]", "", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def overlap(text, item):
    """Whether some stretch of 16 words of the item (or all of it) has 80 % of its words at one place of the text."""
    size = min(16, len(item))
    for start in range(-len(item), len(text)):
        same = [0 <= start + k < len(text) and text[start + k] == w for k, w in enumerate(item)]
        if any(5 * sum(same[k : k + size]) >= 4 * size for k in range(len(item) - size + 1)):
            return True
    return False
