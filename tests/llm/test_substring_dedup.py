import hashlib
import random
import re

from sensorlake.llm.substring_dedup import FingerprintIndex, deduplicate


def brute(rows, n=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for s in range(len(w) - n + 1):
            key = tuple(w[s:s + n])
            if key in seen:
                gone |= set(range(s, s + n))
            seen.add(key)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def texts(rng):
    vocab = [f"é{i}" for i in range(300)]
    fresh = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, rows = fresh(55), []
    for i in range(40):
        body = fresh(rng.randrange(0, 120))
        if i % 3 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage[rng.randrange(0, 20):rng.randrange(30, 55)]
        rows.append((i, " ".join(body)))
    rows += [(50, rows[7][1]), (51, rows[7][1]), (52, "x " * 70), (53, "y y z " * 40), (54, None), (55, ""), (56, " ".join(fresh(19))), (57, "\t".join(fresh(20)))]
    return rows


def test_against_brute_force(spark, documents):
    rows = texts(random.Random(2))
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in deduplicate(documents(rows)).collect()}
    assert got == brute(rows)


def test_batches_compaction_and_spans(spark, documents):
    rows = texts(random.Random(4))
    index = FingerprintIndex(spark, buckets=4)
    got = {}
    for part in (rows[:15], rows[15:30], [], rows[30:]):
        for r in index.ingest(documents(part)).collect():
            got[r.doc_id] = (r.n_removed, sum(s.stop - s.start for s in r.removed))
    assert {k: v[0] for k, v in got.items()} == {k: v[1] for k, v in brute(rows).items()}
    assert all(a == b for a, b in got.values())
    assert len(index.runs) < 4
    index.close()


def thue_morse(n):
    """Two words of n characters that agree in every polynomial hash modulo 2**64, for n of 1024 and more."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_equal_polynomial_hash(spark, documents):
    x, y = thue_morse(2048)
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{x} {tail}")]
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in deduplicate(documents(rows)).collect()}
    assert got == brute(rows) and got[2][1] == 0 and got[3][1] == 20


def test_index_goes_on_in_another_session(spark, documents, tmp_path):
    rows = texts(random.Random(9))
    got = {}
    for n, part in enumerate((rows[:20], rows[20:35], rows[35:])):
        index = FingerprintIndex(spark, buckets=3, at=str(tmp_path)) if n == 0 else FingerprintIndex.reopen(spark, str(tmp_path))
        got |= {r.doc_id: r.n_removed for r in index.ingest(documents(part)).collect()}
        index.close()
    assert got == {k: v[1] for k, v in brute(rows).items()}


def test_repeated_rows_null_ids_and_other_columns(spark, documents):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, 5), (1, text, 6), (2, "new " + text, 7), (None, text, 8)]
    got = sorted((r.doc_id, r.n_removed) for r in deduplicate(documents(rows, ", n_removed int")).collect())
    assert got == [(1, 0), (1, 0), (2, 30)]


def test_empty_table(spark, documents):
    assert deduplicate(documents([])).count() == 0


def test_ids_with_several_rows_and_copies(spark, documents):
    rng = random.Random(11)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(2))
    shared = " ".join(b.split()[5:30])
    for rows in ([(1, a), (2, a), (2, b)], [(1, a), (1, a), (2, a)], [(1, a), (1, a), (2, a), (2, a)], [(1, "x y"), (1, "x y"), (2, "x y")],
                 [(1, a), (1, b), (2, a), (3, shared + " new end"), (3, None), (4, a)]):
        got = sorted((r.doc_id, r.n_words, r.n_removed) for r in deduplicate(documents(rows)).collect())
        want, first = [], {}
        for doc, text in rows:  # a window is repeated if a smaller id has it
            words = (text or "").split()
            windows = [tuple(words[i:i + 20]) for i in range(len(words) - 19)]
            gone = {i + k for i, w in enumerate(windows) for k in range(20) if first.get(w, doc) < doc}
            for w in windows:
                first.setdefault(w, doc)
            want.append((doc, len(words), len(gone)))
        assert got == sorted(want), rows
