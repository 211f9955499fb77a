"""Small documents with everything that may go wrong, shared by the tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, batch int, label string, size string, component_id string"


def rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "épée", "zeta", "eta", "THETA", "io", "kappa", "x1", "ß"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(30, 90))) for _ in range(8)]
    texts = []
    for text in base:
        texts.append(text)
        parts = text.split()
        for _ in range(3):
            copy = parts[:]
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        texts.append(text)
    texts += [None, "", " \n\t", "one", "one two", "one two", base[0] + "\n" + base[1], base[2][:70], "a" * 300, "a" * 120, "ab" * 90, "…" * 60]
    texts.append(" ".join(rng.choice(words) for _ in range(4000)))
    texts.append(texts[-1])
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    out = [(i, t) for i, t in zip(ids, texts, strict=True)]
    out += [out[3], out[3], (None, base[0]), (None, base[0]), (None, None)]
    sources = ["a", "b", None, "ü", "c"]
    langs = ["en", "de", None]
    return [(i, t, langs[k % 3], sources[k % 5], None if t is None else len(t), "r", k, None, "s", "c") for k, (i, t) in enumerate(out)]


def frame(spark, given=None):
    return spark.createDataFrame(rows() if given is None else given, SCHEMA).repartition(3)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
