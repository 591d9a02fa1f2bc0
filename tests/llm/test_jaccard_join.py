import random

from sensorlake.llm.jaccard_join import near_duplicate_components, one_of_each


def sets(text, k=5):
    import re
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    s = {i: sets(t) for i, t in rows}
    comp = {i: i for i in s}
    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    return {i: (len(s[i]), comp[i]) for i in s}


def edited(words, n, rng, vocab):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(vocab)
    return out


def test_against_brute_force(spark, documents):
    rng = random.Random(5)
    vocab = [f"W{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 30, 90, 150]))]
        rows += [(len(rows) + j, " ".join(edited(base, j % 5, rng, vocab))) for j in range(25)]
    shared = [rng.choice(vocab) for _ in range(40)]
    rows += [(1000 + j, " ".join(shared + [rng.choice(vocab) for _ in range(j)])) for j in range(0, 60, 3)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one two"), (2004, "ONE two"), (2005, "one"), (2006, "w1 " * 3000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_components(documents(rows)).collect()}
    assert got == brute(rows)


def test_empty_and_extra_columns(spark, documents):
    assert near_duplicate_components(documents([])).count() == 0
    df = documents([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "q", "z")], ", component_id string")
    assert sorted((r.doc_id or 0, r.component_id) for r in one_of_each(df).collect()) == [(0, "z"), (1, "x")]


def test_words_of_equal_polynomial_hash(spark, documents):
    from test_substring_dedup import thue_morse

    x, y = thue_morse(1024)
    tail = " ".join(f"w{i}" for i in range(60))
    rows = [(1, x), (2, y), (3, x.upper()), (4, f"{x} {tail}"), (5, f"{y} {tail}"), (6, f"{x} b"), (7, f"{y} b")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_components(documents(rows)).collect()}
    assert got == brute(rows) and got[2][1] == 2 and got[3][1] == 1 and got[7][1] == 7


def test_strangers_in_a_large_group(spark, documents):
    rng = random.Random(8)
    vocab = [f"W{i}" for i in range(900)]
    base, other = ([rng.choice(vocab) for _ in range(80)] for _ in range(2))
    mixed = base[:50] + other[50:]
    rows = [(len(range(i)), " ".join(edited(w, rng.randrange(3), rng, vocab))) for i, w in enumerate([base] * 60 + [mixed] * 40 + [other] * 30)]
    rows += [(500 + i, rows[i][1]) for i in range(20)] + [(500, rows[0][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_components(documents(rows)).collect()}
    assert got == brute(rows)
