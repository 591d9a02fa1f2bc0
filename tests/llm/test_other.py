import fnmatch
import hashlib
import json
import random

import pytest

from sensorlake.llm import chat_format, html_extract, language_id, url_filter
from sensorlake.llm.samples import bounded_sample


def test_automaton_against_fnmatch():
    import pyarrow as pa

    rng = random.Random(1)
    globs = ["".join(rng.choice(["a", "b", "/", "**", "?"]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 12))) for _ in range(80)] + [""]
    auto = url_filter.Automaton.compile([(i, url_filter.parse_glob(g)) for i, g in enumerate(globs)])
    assert auto.n_words > 1
    states = auto.run(pa.array(texts))
    for word, bit, rule in auto.finals:
        want = [fnmatch.fnmatchcase(t, globs[rule].replace("**", "*")) for t in texts]
        assert [bool(int(s[word]) >> bit & 1) for s in states] == want
    one = url_filter.Automaton.compile([(0, url_filter.parse_glob("a*b"))])
    assert [bool(s[0] >> 3 & 0 or int(s[0]) >> one.finals[0][1] & 1) for s in one.run(pa.array(["ab", "axb", "a/b", None]))] == [True, True, False, False]


def test_url_rules(spark):
    rules = [url_filter.UrlRule("block", "example.com", "/en/"), url_filter.UrlRule("allow", "com")]
    rows = [(1, "http://EXAMPLE.com/en/x?q"), (2, "http://notexample.com/en/"), (3, None), (4, "nothing"), (5, "http://a.example.com/en/#f"), (6, "x://org/"), (6, "x://org/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'z' AS host")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules, default="keep").collect()}
    assert got == {1: ("example.com", "/en/x", "example.com/en/", "block"), 2: ("notexample.com", "/en/", "com/", "allow"), 3: ("", "", None, "keep"),
                   4: ("", "", None, "keep"), 5: ("a.example.com", "/en/", "example.com/en/", "block"), 6: ("org", "/", None, "keep")}


@pytest.mark.parametrize("record, turns", [
    ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"conversations": [{"from": "human", "value": "p"}, {"from": "gpt", "value": "r"}]}, [("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"messages": [{"role": "system", "content": "<|im_end|>\\n\\\n"}, {"role": "a\nb\\n", "content": None}]}, [("system", "<|im_end|>\\n\\\n"), ("a\nb\\n", "")]),
    ({"messages": []}, []), ({"odd": 1}, []),
    ({"prompt": 5, "response": True}, [("user", "5"), ("assistant", "true")]),
    ({"id": 7, "meta": {"lang": ["en"]}, "prompt": "p", "response": "r", "score": None}, [("user", "p"), ("assistant", "r")]),
    ({"system": None, "prompt": {"a": ["é"]}, "completion": "c", "response": "r"}, []),
    ({"system": "s", "prompt": "p", "response": "r", "input": "i"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"messages": [{"role": "user", "content": "\ud800x\ud83d\ude00", "name": "n"}, "bare", {"role": "assistant"}]},
     [("user", "\ufffdx\U0001f600"), ("", "bare"), ("assistant", "")]),
    ({"question": "q" * 300_000, "answer": ""}, [("user", "q" * 300_000), ("assistant", "")]),
    ({"prompt": "p", "response": "r", "deep": json.loads("[" * 500 + "]" * 500)}, [("user", "p"), ("assistant", "r")]),
])
def test_formats_round_trip(spark, record, turns):
    more = [(2, None), (3, "[broken"), (4, '{"prompt":' + "[" * 200_000 + "]" * 200_000 + ',"response":"r"}'), (5, "7")]
    df = spark.createDataFrame([(1, json.dumps(record)), *more], "conv_id long, record string").selectExpr("*", "1 AS mapping")
    rows = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    r = rows[1]
    assert chat_format.parse(r.formatted) == turns and all(rows[i].formatted == "" and rows[i].mapping is None for i in (2, 3, 4, 5))
    loss = "".join(chat_format.unescape(r.formatted[s.start:s.stop]) for s in r.loss_spans)
    assert loss == "".join(t for role, t in turns if role == "assistant")


def test_conversation_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(chat_format.conversation_records(df))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest() and got[2].n_turns == 2
    assert chat_format.read_back(chat_format.format_chats(chat_format.conversation_records(df.where("false")))).count() == 0


def test_conversations_meet_every_layout(spark):
    shapes = [("user", "assistant"), ("system", "user", "assistant"), ("user", "assistant", "user"), ("odd",)]
    rows = [(i, t, role, f"a{i}\n\nb\n\nc" if i % 3 else "x") for i in range(200) for t, role in enumerate(shapes[i % 4])]
    records = chat_format.conversation_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r.conv_id: r for r in chat_format.format_chats(records).collect()}
    assert {r.mapping for r in found.values()} == {x.name for x in chat_format.LAYOUTS} - {"messages_empty"}
    for i, r in found.items():
        assert chat_format.parse(r.formatted) == [(role, f"a{i}\n\nb\n\nc" if i % 3 else "x") for role in shapes[i % 4]]


PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><div class="side sidebar">s</div><nav><li>m</nav>
<main><h1>T &amp; &eacute;</h1><p>a<br>b  <b>c</b><p>d &lt;x&gt;<ul><li>one<li>two</ul><form>f</form><div id="comments"><p>c</div><script>"</p>"</script>
<!-- no --><table><tr><td>1<td>2</table>tail</main><footer>f</footer>"""


def test_main_text():
    assert html_extract.main_text(PAGE, frozenset()).split("\n\n") == ["T & é", "a b c", "d <x>", "one", "two", "1", "2", "tail"]
    assert html_extract.main_text("<p>x</p><p hidden>y</p><a", frozenset()) == "x"
    assert html_extract.main_text("", frozenset()) == ""


def test_style_tree_removes_what_a_site_repeats(spark):
    page = lambda i: f"<body><div class=box><p>Same words on all</p></div><div class=text><p>Own words {i} of page</p></div>"
    rows = [(i, "http://h.org/a", page(i)) for i in range(8)] + [(20, None, None), (21, "http://one.org/", page(1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[3] == "Own words 3 of page" and got[20] == "" and got[21].startswith("Same words")


def test_names_do_not_remove_layout_wrappers():
    text = lambda page: html_extract.main_text(page, frozenset())
    side = "<div class=sidebar><p>side</p></div>"
    for wrapper in ("<div class='content has-sidebar'>", "<div id='page-with-navigation'>", "<div class='search-layout'>", "<div class=widget-page><section class=share-on>"):
        assert text(f"<body>{wrapper}<article><p>own text</p></article>{side}</div></body>") == "own text"
        assert text(f"<body>{wrapper}<main><p>own text</p></main>{side}</div><article>x</article></body>").startswith("own text")
        assert text(f"<body><p>top</p>{wrapper}<p>own text without an article</p>{side}</div></body>") == "top\n\nown text without an article"
    assert text("<div class=related-layout><main>own text</main></div>") == "own text"
    # What the names are for still goes, articles or not.
    comments = "<div class=comments><article><p>much longer than the text itself</p></article></div>"
    assert text(f"<body><p>own text</p>{side}{comments}</body>") == "own text"
    assert text(f"<body><article>own text</article>{side}{comments}<div class=sidebar><article>tease</article></div></body>") == "own text"
    assert text("<div class=sidebar hidden><main>x</main></div><p>own</p>") == "own"


def test_style_tree_inside_articles_and_on_small_hosts(spark):
    box = "<div class=callout><p>Join our circle of readers</p></div>"
    page = lambda i: f"<body><article><h1>Title {i}</h1><p>Own words {i}</p>{box}<p>More of {i}</p></article></body>"
    copy = lambda i: f"<body><div class=top>Page {i}</div><article><p>One article at many addresses</p></article></body>"
    rows = [(i, "http://large.org/a", page(i)) for i in range(8)] + [(i, "http://small.org/a", page(i)) for i in range(10, 13)]
    rows += [(i, "http://two.org/a", page(i)) for i in (20, 21)] + [(i, "http://copies.org/a", copy(i)) for i in range(30, 36)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\n\nOwn words {i}\n\nMore of {i}" for i in [*range(8), 10, 11, 12])
    assert all("Join our circle" in got[i] for i in (20, 21))
    assert all(got[i] == "One article at many addresses" for i in range(30, 36))


def test_importance_against_brute_force(spark):
    import math
    from collections import Counter

    rng = random.Random(4)
    boxes = ["Read our rules", "Ask us", "Call us now"]
    page = lambda i: (f"<body><div class=top>{rng.choice(boxes)}</div><article><h1>T{i % 7}</h1><p>Own words {i}</p><div class=box>{rng.choice(boxes[:2])}</div>"  # noqa: E731
                      f"<p>More {i}</p><ul><li>{i % 3}</li></ul></article></body>")
    pages = [("a.org" if i % 4 else "b.org", page(i)) for i in range(40)] + [("a.org", page(1))] * 2
    df = spark.createDataFrame([(i, h, p) for i, (h, p) in enumerate(pages)], "id long, host string, html string")
    got = {(r.host, r.path): (r.pages, r.importance) for r in html_extract.style_tree(html_extract.nodes(df)).collect()}
    values = {}
    for host, html in set(pages):
        for text, node, children in html_extract.blocks(html):
            values.setdefault((host, node.key, 0), set()).add((html, " ".join(children)))
            values.setdefault((host, node.key, 1), set()).add((html, text))
    want = {}
    for (host, path, kind), seen in values.items():
        counts = Counter(v for _, v in seen)
        m = sum(counts.values())
        entropy = -sum(c / m * math.log(c / m) for c in counts.values()) / math.log(m) if m > 1 else 1.0
        pages_, importance = want.get((host, path), (0, 0.0))
        want[host, path] = max(pages_, m), importance + (0.1, 0.9)[kind] * entropy
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert any(v[1] < html_extract.MIN_IMPORTANCE for v in got.values()) and any(v[1] > 0.85 for v in got.values())


def test_tree_overrules_names_inside_articles(spark):
    page = lambda i: (f"<body><article><p>Own words {i}</p><div class=promo-story><p>A story of its own, {i}</p></div><div class=share><p>Share this</p></div>"  # noqa: E731
                      f"<div class=comments><p>Reader {i} says</p></div></article></body>")
    rows = [(i, "http://h.org/a", page(i)) for i in range(9)] + [(20, "http://one.org/", page(20)), (None, "http://one.org/", page(21)), (20, "http://one.org/", page(20))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS low", "1 AS host", "2 AS n_chars")
    got = html_extract.extract(df).collect()
    texts = {r.page_id: r.text for r in got}
    assert all(texts[i] == f"Own words {i}\n\nA story of its own, {i}" for i in range(9))
    assert texts[20] == "Own words 20" and texts[None] == "Own words 21" and len(got) == len(rows)
    long = html_extract.extract(spark.createDataFrame([(1, "http://a.org", "<p>" + "word " * 400_000 + "</p>" + "<div>" * 3000 + "end")], df.schema[:3])).first()
    assert long.n_chars == 2_000_000 - 1 + 2 + 3 and html_extract.extract(df.where("false")).count() == 0


def test_languages(spark, documents):
    rng = random.Random(3)
    vocab = {"en": "the of and that with river water house".split(), "de": "der und die nicht mit fluss wasser haus".split(),
             "fr": "le et la que avec rivière eau maison".split(), "es": "el y la que con río agua casa".split()}
    rows = [(i, " ".join(rng.choice(vocab[v]) for _ in range(30)), v) for i, v in enumerate(list(vocab) * 40)]
    docs = documents(rows + [(900, None, "en"), (901, "12 — 34 ² ½ Ⅷ ①", "de"), (902, "", None)], ", lang string")
    model = language_id.fit_languages(docs.where("doc_id % 5 <> 2 OR doc_id >= 900"))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i].lang_pred == v for i, _, v in rows) and all(0 <= g.score <= 1 for g in got.values())
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    empty = language_id.fit_languages(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_bounded_sample(spark):
    df = spark.range(20_000).selectExpr("id AS k", "CASE WHEN id % 1000 = 0 THEN 'rare' ELSE 'common' END AS v")
    got = {r.v: r["count"] for r in bounded_sample(df, "v", "k", 100, 5).groupBy("v").count().collect()}
    assert got == {"rare": 20, "common": 100}
