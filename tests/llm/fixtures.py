"""Small tables with every odd case, and plain versions of tokens and components."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves: they must not clash.
EXTRA = {"component_id": 1, "size": 2, "hashes": 3, "fp1": 4, "digest": 5, "key": 6, "label_": 7, "n_tokens": 8, "bucket": 9, "shard": 10, "text_digest": 11, "held_out": 12, "host": 13, "id": 14, "copies": 15, "tokens": 16, "place": 17}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def join(edges, ids):
    """Smallest id of each node's component."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}x{rng.randrange(9)}" for _ in range(n))


def documents(seed=0, n=60):
    """Rows of documents: distinct ones, exact and near copies, and odd cases."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(20, 160)) for _ in range(n)]
    for i in range(0, n, 6):
        texts.append(texts[i])
    for i in range(0, n, 4):
        for _ in range(rng.randrange(1, 4)):
            w = texts[i].split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += ["", None, "   \t\n ", "one", "One", "two words", "a b c", "a b c d", "a b c d", "\x0bA\x0cb  c\nd", "é É É é à"]
    rows = [(i, t, ("en", "fr", None)[i % 3], f"src{0 if i % 3 else i % 20}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows, schema=DOCS, extra=False, parts=3):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema).repartition(parts)
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items() if k not in df.columns}) if extra else df
