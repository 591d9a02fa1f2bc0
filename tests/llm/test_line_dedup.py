import random

from sensorlake.llm.line_dedup import clean_lines, dedup_lines


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def brute(rows, least=20):
    earlier, out = [], {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[i] = None
            continue
        kept = []
        for line in text.split("\n"):
            if len(line) >= least and any(one_edit(line, e) for e in earlier):
                pass
            else:
                kept.append(line)
            if len(line) >= least:
                earlier.append(line)
        out[i] = "\n".join(kept)
    return out


def test_against_brute_force(spark, documents):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([18, 19, 20, 21, 40, 90]))) for _ in range(25)]

    def changed(s):
        p = rng.randrange(len(s))
        return rng.choice([s, s[:p] + s[p + 1:], s[:p] + "Z" + s[p:], s[:p] + "Q" + s[p + 1:], s[:p] + "Q" + s[p + 2:]])

    rows = [(i, "\n".join(changed(rng.choice(base)) for _ in range(rng.randrange(0, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "item number 000000000001\nitem number 000000000002\nitem number 000000000012")]
    got = {r.doc_id: r.text for r in dedup_lines(documents(rows)).collect()}
    assert got == brute(rows)


def test_empty_null_id_and_extra_columns(spark, documents):
    assert dedup_lines(documents([])).count() == 0
    line = "the same long line of text"
    df = documents([(1, line, "a"), (2, f"{line}\nshort", "b"), (None, line, "c")], ", place string")
    got = sorted((r.doc_id or 0, r.text, r.place, r.n_removed) for r in dedup_lines(df).collect())
    assert got == [(0, line, "c", 0), (1, line, "a", 0), (2, "short", "b", 1)]


def test_short_repeats_in_query_and_pipeline(spark, documents, tmp_path):
    from corpus_pipeline import lines
    from sensorlake.llm.queries import QUERIES

    rows = [(1, "Home\nShare this\n---\n\nné"), (2, "Share this\nShare thin\n---\n\nHome\nHome"), (3, "7\nné\n7\nhome")]
    docs = documents(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: rows[0][1], 2: "Share thin\n---\n", 3: "7\nhome"}
    got = QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == want and {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 3, 3: 2}
    staged = lines(spark, docs.selectExpr("*", "cast(char_length(text) as long) AS n_chars"), str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in staged} == want and all(r.n_chars == len(r.text) for r in staged)


def test_lines_of_many_code_points(spark, documents):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdé ") for _ in range(120_000))
    rows = [(1, base), (2, base[:70_001] + "Z" + base[70_002:]), (3, base[:9] + base[10:]), (4, base + "Q"), (5, base[:5] + "Z" + base[5:90_000] + base[90_001:])]
    got = {r.doc_id: r.n_removed for r in dedup_lines(documents(rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0}


def test_columns_named_like_the_results(spark, documents):
    line = "the same long line of text"
    df = documents([(1, line, 7, 8, 9), (2, f"{line}\nshort", 7, 8, 9), (2, f"{line}\nshort", 7, 8, 9)], ", n_lines int, n_removed int, __gone int")
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r["__gone"]) for r in dedup_lines(df).collect()) == [(1, 1, 0, 9), (2, 2, 1, 9), (2, 2, 1, 9)]
    assert sorted(tuple(r) for r in clean_lines(df).collect()) == [(1, line, 7, 8, 9), (2, "short", 7, 8, 9), (2, "short", 7, 8, 9)]
