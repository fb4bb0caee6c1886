"""The pipeline's near-duplicate stage against brute force at its own values: 5 words, 0.8."""

import corpus_pipeline

from .conftest import DOCS, prose


def shingles(text: str, width: int) -> frozenset:
    words = text.lower().split()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def kept(texts: list[str], num: int, width: int) -> list[int]:
    """The smallest of each component of texts whose similarity is num / 100 or more."""
    sets, name = [shingles(t, width) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = [new if x == old else x for x in name]
    return [k for k in range(len(texts)) if name[k] == k]


def test_near_duplicate_stage(spark):
    texts = []
    for g in range(8):
        base = prose(700 + g, 150 + 20 * g).split()
        texts.append(" ".join(base))
        # 5 to 30% of new text at the end
        texts += [" ".join(base + prose(900 + 10 * g + k, len(base) * share // 100).split()) for k, share in enumerate((5, 12, 20, 24, 30))]
        for edits in (1, 3, 6):
            words = list(base)
            for e in range(edits):
                words[(e + 1) * len(words) // (edits + 1)] = f"x{g}{edits}{e}"
            texts.append(" ".join(words))
    texts += ["one two", "one two", "one two three four", "", "   "]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], DOCS)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == kept(texts, 80, 5)
    assert got != kept(texts, 90, 3)
