import random

import pytest

from sensorlake.llm.decontaminate import leaks, shingles, without_leaks


def brute(docs, items):
    out = set()
    for d, text in docs:
        for i, passage in items:
            k = min(5, len((passage or "").split()))
            if k and text:
                q = shingles(passage, k)
                c = len(q & shingles(text, k))
                if 100 * c >= 80 * len(q):
                    out.add((d, i, len(q), c))
    return out


@pytest.mark.parametrize("max_sketch", [1_000_000, 0])
def test_against_brute_force(spark, documents, max_sketch):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(200)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(rng.choice([2, 5, 12, 40])))) for i in range(12)] + [(20, ""), (21, None), (22, "solo")]
    docs = []
    for d in range(50):
        body = words(rng.choice([10, 100, 3000]))
        if d % 3 == 0:
            leak = rng.choice(items[:12])[1].upper().split()
            if d % 2 and len(leak) > 10:
                leak[rng.randrange(len(leak))] = "other"
            at = rng.randrange(len(body))
            body[at:at] = leak
        docs.append((d, " ".join(body)))
    docs += [(60, None), (61, ""), (62, "Solo"), (63, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in leaks(documents(docs), bench, max_sketch=max_sketch).collect()}
    assert got == brute(docs, items)
    clean = {r.doc_id for r in without_leaks(documents(docs), bench).collect()}
    assert clean == {d for d, _ in docs} - {g[0] for g in got}


def test_empty(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(documents([(1, "a b")]), none).count() == 0
    assert leaks(documents([]), none).count() == 0
