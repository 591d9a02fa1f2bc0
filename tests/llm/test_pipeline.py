import random

import corpus_pipeline


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(8)
    vocab = [f"{a}{b}" for a in ("ri", "mo", "ta", "lu", "se") for b in ("ver", "un", "ble", "the", "of", "ing", "an")]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    good = lambda: "\n".join(line(25) for _ in range(5))
    bad = lambda: "\n".join(" ".join(w.upper() + "!!" for w in line(25).split()) for _ in range(5))
    passage = line(40)
    texts = {i: good() for i in range(60)} | {i: bad() for i in range(60, 90)}
    texts[100] = texts[3]  # an exact copy
    texts[101] = texts[4].replace("\n", " ").replace("ver", "ver", 1) + " More."  # a near copy, on one line
    texts[102] = good() + "\n" + passage  # a leak
    texts[103] = texts[5].split("\n")[2] + "\n" + good()  # a repeated line
    texts |= {104: None, 105: "", 106: "short text"}
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == schema.replace("long", "").replace("string", "").replace(" ", "").split(","), name
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept.append({r.doc_id: r.text for r in docs.collect()})
    quality, lines, near, clean = kept
    assert set(quality) == set(range(60)) | {100, 101, 102, 103}
    assert set(lines) == set(quality) and lines[100] == "" and lines[103] == "\n".join(texts[103].split("\n")[1:]) and lines[0] == texts[0]
    assert set(near) == set(lines) - {101} and set(clean) == set(near) - {102}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(clean)
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_stages_on_empty_repeated_and_extra_columns(spark, tmp_path):
    from test_jaccard_join import brute

    rng = random.Random(5)
    vocab = [f"{a}{b}{c}" for a in ("ri", "mo", "ta", "lu") for b in ("ver", "un", "the", "of", "ing") for c in range(90)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    base = [[line(30) for _ in range(4)] for _ in range(6)]
    texts = {i: "\n".join(x if rng.random() < 0.9 else line(30) for x in base[i % 6]) for i in range(30)}
    texts |= {50: "\n".join(base[0]).replace("\n", " "), 51: " ".join(base[0])[:-4], 52: None, 53: ""}
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_removed string, component_id int, labels boolean, item_id int, kept int, sequence_id int"
    rows = [(i, t, "en", "s", len(t or ""), "own", 1, True, 2, 3, 4) for i, t in texts.items()]
    docs = spark.createDataFrame(rows + rows[:3] + [(None, line(80), "en", "s", 1, "own", 1, True, 2, 3, 4)], schema)
    sf = str(tmp_path)
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for start in (docs, docs.where("false")):
        at, found = start, []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, sf)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
            path = f"{sf}/{name}-{start is docs}"
            out.write.parquet(path)
            at = spark.read.parquet(path)
            assert at.select(*[f"`{c}`" for c in rest]).distinct().count() == (start is docs)
            found.append(sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in at.collect()))
        packed = corpus_pipeline.STAGES[-1][1](spark, at, sf)
        assert (packed.count() > 0) == (start is docs)
        if start is docs:
            quality, lines, near, clean = found
            assert len(lines) == len(quality) and len([1 for i, _ in quality if i in (0, 1, 2)]) == 6  # repeated rows are judged alike
            want = brute([(i, t) for i, t in dict(lines).items() if i >= 0])
            assert {i for i, _ in near} == {i for i, (_, c) in want.items() if i == c} | {-1} and clean == near
        else:
            assert found == [[], [], [], []]
