import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sensorlake.llm import spelling


def edits_to_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def brute(rows, min_chars=7, min_count=2, ratio=10, typo=31):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if typo and h % typo == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    near = {w: [v for v in n if edits_to_one(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: v if v is not None and n[v] >= ratio * n[w] else None for w, v in form.items()}

    def root(w):
        return root(form[w]) if form[w] is not None else w

    return sorted((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n)


def grouped(documents, rows, more="", **options):
    return sorted(tuple(r) for r in spelling.group_variants(documents(rows, more), **options).collect())


@pytest.mark.parametrize("symbols", [1, 4, 8])
def test_equals_brute_force(documents, symbols):
    rng = random.Random(symbols)
    words = ["".join(rng.choice("abÀé") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    for _ in range(120):
        w = rng.choice(words)
        i = rng.randrange(len(w))
        words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcé÷") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1:]]))
    rows = [(d, " ".join(rng.choices(words, [3 ** (i % 7) for i in range(len(words))], k=80)).replace("a", rng.choice("aA"))) for d in range(60)]
    want = brute(rows)
    assert len(want) > 60 and sum(r[3] is not None for r in want) > 5
    assert grouped(documents, rows, typo=31, symbols=symbols) == want
    assert grouped(documents, rows, symbols=symbols) == brute(rows, typo=0)


def test_forms_are_followed_to_the_last_and_ties_take_the_smallest(documents):
    rows = [(1, "abcdefgh " * 2 + "abcdefghi " * 20 + "abcdefghij " * 200), (2, "qqqqqqqq " * 2 + "qqqqqqqqa " * 20 + "qqqqqqqqb " * 20)]
    got = {r[0]: r for r in grouped(documents, rows)}
    assert got["abcdefgh"][3:] == ("abcdefghi", 20, "abcdefghij") and got["qqqqqqqq"][2:] == (2, "qqqqqqqqa", 20, "qqqqqqqqa")
    assert grouped(documents, rows) == brute(rows, typo=0)


def test_nulls_empty_repeated_rows_and_clashing_columns(documents):
    rows = [(1, None), (2, ""), (3, "1 2 3 ,;"), (None, "Wörterbuch wörterbuch wörterbuchs WÖRTERBUCH"), (None, "wörterbuchs"), (4, "Einmalig"), (5, "zweimalig"), (5, "zweimalig")]
    assert grouped(documents, rows, typo=31) == brute(rows) != []
    clash = [(*r, 1, "x", "y") for r in rows]
    assert grouped(documents, clash, ", n long, word string, root string", typo=31) == brute(rows)
    assert grouped(documents, [], typo=31) == grouped(documents, [(1, None)], typo=31) == []


def test_very_long_words_in_linear_memory(documents):
    long = "".join(random.Random(1).choices("abcdefgh", k=300_000))
    rows = [(1, f"{long} {long}"), (2, " ".join([long[:1000] + "x" + long[1000:]] * 25)), (3, "short words only")]
    got = {len(r[0]): r for r in grouped(documents, rows)}
    assert got[300_000][2:5] == (1, long[:1000] + "x" + long[1000:], 25) and got[300_001][2:4] == (1, None)


def test_hashes_of_variants_are_those_of_the_varied_words():
    codes = np.array([[0, 0, 2, 1], [3, 1, 1, 1]])
    made = {(int(r), int(h)) for rows, hs in spelling.neighbourhood(codes, 4) for r, h in zip(rows, hs)}
    want = set()
    for r, word in enumerate(codes.tolist()):
        for i in range(4):
            want.add((r, int(spelling.hashes(np.array([word[:i] + word[i + 1:]]))[0])))
            want |= {(r, int(spelling.hashes(np.array([word[:i] + [c] + word[i + 1:]]))[0])) for c in range(word[i] + 1, 4)}
    assert made == want
