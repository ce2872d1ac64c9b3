"""Small document tables with odd rows, and plain counterparts of the operators."""

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, extra string, n_removed string, kept string"


def docs(spark, texts, lang="en", source="s"):
    """texts: a list, or a dict by doc_id; with columns that clash with results."""
    items = texts.items() if isinstance(texts, dict) else enumerate(texts)
    return spark.createDataFrame([(i, t, lang, source, "x", "y", "z") for i, t in items], SCHEMA)


def tokens(text):
    return re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bag(words, width=5):
    return [tuple(words[k : k + width]) for k in range(len(words) - width + 1)] if len(words) >= width else [tuple(words)] if words else []


def prose(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(2 + i % 5)) for i in (r.randrange(vocabulary) for _ in range(n)))


def edited(text, every, seed=0):
    """The text with one word in `every` replaced."""
    r = random.Random(seed)
    w = text.split(" ")
    for i in range(r.randrange(every), len(w), every):
        w[i] = f"q{r.randrange(10**6)}"
    return " ".join(w)


def components(sets):
    """Smallest reachable id by id, over links of Jaccard 0.75 or more."""
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def similarity(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()), sum((a | b).values())
