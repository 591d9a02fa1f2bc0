import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sensorlake.llm import packing
from sensorlake.llm.packing import best_fit, pack, plan, reduce_by_dominance

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pack_round_trip(spark, documents):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "béta", "Γ", "δelta", "\n", "x1"]) for _ in range(rng.choice([0, 3, 80, 900]))) for _ in range(60)]
    rows = list(enumerate(texts + [None, "", "stop <|endoftext|> here", texts[5]]))
    got = [r.asDict() for r in pack(documents(rows), PATH).collect()]
    tok = Tokenizer.from_file(PATH)
    by_doc = {}
    for g in got:
        by_doc.setdefault(g["doc_id"], []).append(g)
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        pieces = sorted(by_doc[i], key=lambda g: g["piece"])
        assert sum(p["length"] for p in pieces) == len(ids) and [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert all(p["length"] == 1024 for p in pieces[1:]) and len(pieces) == -(-len(ids) // 1024)
        for p in pieces:
            assert zlib.crc32(ids[p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
    by_seq = {}
    for g in got:
        by_seq.setdefault(g["sequence_id"], []).append(g)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert pack(documents([]), PATH).count() == 0


def optimum(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                go(i + 1, bins[:j] + [bins[j] + items[i]] + bins[j + 1:])
        go(i + 1, bins + [items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum_and_all_items():
    rng = random.Random(9)
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        counts = dict(Counter(items))
        fixed, left = reduce_by_dominance(counts, 20)
        rest = sorted(Counter(left).elements(), reverse=True)
        assert sum(t for _, t in fixed) + optimum(rest, 20) == optimum(items, 20)
        used = Counter()
        for lengths, times in plan(counts, 20):
            assert sum(lengths) <= 20
            for v in lengths:
                used[v] += times
        assert used == Counter(items)
    assert sum(t for _, t in best_fit({6: 5}, 20)) == 2


def test_texts_of_any_length_and_clashing_columns(documents):
    texts = [" " * 1_500_000, "\n" * 1_500_000, "a" * 1_500_000, "x" + " \t" * 600_000 + "y", None, ""]
    rows = [(i, t, 1, "p", 2) for i, t in enumerate(texts)]
    slow = Tokenizer.from_file(PATH)
    lengths = {i: len(slow.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    encode = packing.tokenizer(PATH)
    assert list(encode(texts[3])) == slow.encode(texts[3], add_special_tokens=False).ids
    got = {}
    for r in pack(documents(rows, ", piece int, start string, length long"), PATH).select("doc_id", "length").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == lengths
