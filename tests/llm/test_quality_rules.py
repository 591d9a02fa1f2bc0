import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from sensorlake.llm.kernels import chunks
from sensorlake.llm.quality_rules import COUNTS, N_SHAPE, ChainField, Lines, fit_field, judge, judge_texts, keep_quality


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    g = Counter(zip(w, w[1:], w[2:]))
    inside = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if g[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_base_counts():
    rng = random.Random(1)
    texts = ["", " \n ", None, "a b", "a b c a b c", "x\nx\ny\nx", "é|é #\n\x0b<z>"]
    texts += [" ".join(rng.choice("abcd") + rng.choice(["", "\n"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["x y z " * 30_000 + "\n" + "é" * 70_000]
    found = [tuple(r[c] for c in COUNTS) for part in judge_texts(pa.array(texts), ChainField.neutral()) for r in part.to_pylist()]
    assert found == [base(t) for t in texts]


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(4)
    field = ChainField.neutral()
    field.move = rng.normal(size=(2, 2))
    scores = rng.normal(size=(8, 2))
    score = lambda y: sum(scores[t, k] for t, k in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))
    assert tuple(field.viterbi(scores)) == max(itertools.product((0, 1), repeat=8), key=score)


def test_fit_separates(spark, documents):
    rng = random.Random(7)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "of", "river", "mountain", "is", "walking"]) + f"{'' if rng.random() < .5 else 'er'}" for _ in range(30)) for _ in range(4))
    bad = lambda: "\n".join(" ".join(w.upper() + "!!" for w in good().split()[:30]) for _ in range(4))
    rows = [(i, good() if i % 2 else bad()) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = documents(rows + [(200, None), (201, "")])
    field = fit_field(docs, labels)
    got = {r.doc_id: r.kept for r in judge(docs, field).collect()}
    assert all(got[i] == bool(i % 2) for i in range(40, 80)) and not got[200] and not got[201]
    assert {r.doc_id for r in keep_quality(docs, field).collect()} == {i for i, k in got.items() if k}
    assert judge(documents([]), fit_field(documents([]), labels)).count() == 0


def test_lines_of_one_document_get_different_labels(spark, documents):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randrange(9, 30))).capitalize() + "."
    boxes = [f"Subscribe to the {word()} newsletter and share this {word()} page" for _ in range(12)]
    junk = lambda: " | ".join(word() for _ in range(25))

    def good():
        lines = [prose() for _ in range(6)]
        lines.insert(rng.randrange(7), rng.choice(boxes))
        return "\n".join(lines)

    rows = [(i, good() if i % 3 else "\n".join([rng.choice(boxes), junk(), junk(), rng.choice(boxes), prose()])) for i in range(240)]
    rows += [(1000 + i, rows[1][1]) for i in range(15)]  # copies repeat their lines between the same neighbours
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)] + [(1000 + i, 1, 0) for i in range(15)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    got = {r.doc_id: r for r in judge(docs, fit_field(docs, labels)).collect()}
    right = total = 0
    for i, text in rows[150:240]:
        assert got[i].kept == bool(i % 3)
        if i % 3:
            want = [int(line not in boxes) for line in text.split("\n")]
            assert len(want) == len(got[i].labels) and 0.5 <= got[i].content_share < 1
            right, total = right + sum(map(int.__eq__, want, got[i].labels)), total + len(want)
    assert right >= 0.97 * total


def test_repeated_rows_null_ids_and_clashing_columns(spark, documents):
    text = " ".join(f"word{i}" for i in range(60))
    df = documents([(1, text, "a", True), (1, text, "b", False), (None, text, "c", True), (2, None, "d", True)], ", labels string, kept boolean")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    field = fit_field(df, labels)
    assert [(r.doc_id, r.n_words, r.kept) for r in judge(df, field).orderBy("doc_id").collect()] == [(None, 60, True), (1, 60, True), (1, 60, True), (2, 0, False)]
    assert sorted((r.labels, r.kept) for r in keep_quality(df, field).collect()) == [("a", True), ("b", False), ("c", True)]


def test_features_in_range():
    lines = Lines.of(next(chunks(pa.array(["a " * 1000 + "\n!\n!", "", "É x"]))))
    assert lines.shape.max() < N_SHAPE and lines.n.tolist() == [1000, 1, 1, 2] and lines.doc.tolist() == [0, 0, 0, 2]
