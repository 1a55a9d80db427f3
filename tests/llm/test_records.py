import hashlib
import io
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harborline.llm import chat, html_extract, warc

from .helpers import WORD, brute_components, brute_substrings, corpus, frame, prose, save, sha

HEAD = '<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>'
DATE = "2024-05-01T00:00:00Z"
ARTICLE = "<article><header><h1>Head &amp; more</h1></header><p>One <b>bold</b>&nbsp; text<br>next<p>Two &lt;x&gt; &#233;<ul><li>a<li>b</ul><aside>side</aside><div class='share'>share me</div><blockquote>Quote</blockquote></article>"
WANT = ["Head & more", "One bold text next", "Two <x> é", "a", "b", "Quote"]


def test_extraction_of_one_page():
    rest = "<footer>foot</footer><div id=comments><p>I say</p></div>"
    page = f"{HEAD}<nav><a href=x>menu</a></nav><div class='ad'>buy</div><div class='cookie-notice'>cookies</div><form>f<input></form>{ARTICLE}{rest}</body></html>"
    assert html_extract.extract(page, None).split("\n\n") == WANT
    assert html_extract.extract(page, {"region": "#>html>nowhere", "template": []}).split("\n\n") == WANT
    for odd in (None, "", "plain text", "<p>", "<", "<a href='x", "<!-- c", "</p></div>", "<script>x", "&amp;&bogus; &#0;"):
        assert isinstance(html_extract.extract(odd, None), str)
    assert html_extract.extract("plain &lt; text", None) == "plain < text"


def test_tree_matching():
    a, b = (html_extract.Slot(html_extract.parse(s), 0, [99]) for s in ("<div><p>x</p><ul><li>1</ul></div>", "<div><h1>t</h1><p>y</p><ul><li>2<li>3</ul></div>"))
    assert html_extract.match(a, b, {}) == 5  # root, div, p, ul and the folded li
    html_extract.align(a, b, {})
    assert [k.label for k in a.kids[0].kids] == ["h1", "p", "ul"] and a.kids[0].kids[1].texts == ["x", "y"]


def test_wrapper_of_a_host_without_articles():
    rng = random.Random(1)
    texts = [[prose(rng, 30) for _ in range(3)] for _ in range(5)]
    page = lambda t: f"{HEAD}<div class=top><span>Site name and slogan of this host</span></div><div class=x1><div class=promo2>Same box on every page of the host</div>{''.join(f'<p>{p}</p>' for p in t)}</div><div class=z>Imprint and so on, at the end</div></body>"
    w = html_extract.induce([page(t) for t in texts])
    assert w["region"].endswith("div.1.x:") and len(w["template"]) == 1
    assert html_extract.extract(page(texts[0]), w) == "\n\n".join(texts[0])


@pytest.mark.parametrize("seed", range(6))
def test_region_of_hosts_without_telling_names(spark, seed):
    """No article, main, nav or footer, and classes that say nothing: only the wrapper can tell. Simple tree matching is
    compared with brute force, and the query counts the pages whose region is that of the wrapper."""
    rng = random.Random(seed)
    names = rng.sample([f"q{i}" for i in range(50)], 4)

    def page():
        body = [prose(rng, rng.randint(25, 60)) for _ in range(rng.randint(2, 5))]
        links = "".join(f"<li><a href=/{i}>{prose(rng, 2)}</a></li>" for i in range(rng.randint(2, 6)))
        parts = [f"<div class={names[0]}><ul>{links}</ul></div>", f"<div class={names[1]}>{prose(rng, 3)}</div>"]
        parts.append(f"<div class={names[2]}><span>{'<h2>' + body[0] + '</h2>'}</span>{''.join(f'<p>{b}</p>' for b in body[1:])}</div>")
        parts.append(f"<div class={names[3]}>Imprint, the same everywhere. {prose(rng, 4)}</div>")
        return body, f"{HEAD}{''.join(parts)}</body>"

    made = [page() for _ in range(9)]
    rows = [(i, f"https://h.example/{i}", html) for i, (_, html) in enumerate(made)]
    got = {r["page_id"]: r for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i]["by_wrapper"] and got[i]["text"].split("\n\n") == body for i, (body, _) in enumerate(made))


def _largest(a, b):
    """Brute force: the best way to choose children of a and b in the same order."""
    if a.label != b.label:
        return 0
    best = 0
    for k in range(min(len(a.kids), len(b.kids)) + 1):
        for x in itertools.combinations(a.kids, k):
            for y in itertools.combinations(b.kids, k):
                best = max(best, sum(_largest(p, q) for p, q in zip(x, y)))
    return 1 + best


def test_tree_matching_against_brute_force():
    rng = random.Random(1)

    def tree(depth):
        kids = "".join(tree(depth - 1) for _ in range(rng.randint(0, 4))) if depth else "t"
        tag = rng.choice(["div", "ul", "section"])
        return f"<{tag}>{kids}</{tag}>"

    for _ in range(40):
        a, b = (html_extract.Slot(html_extract.parse(tree(3)), 0, [999]) for _ in range(2))
        assert html_extract.match(a, b, {}) == _largest(a, b)


def test_template_is_told_from_varying_nodes_of_its_path():
    rng = random.Random(2)
    texts = [(prose(rng, 4), prose(rng, 40), prose(rng, 30)) for _ in range(4)]
    pages = [f"{HEAD}<div class=content><p>By our staff</p><h2>{a}</h2><p>{b}</p><p>{c}</p></div></body>" for a, b, c in texts]
    w = html_extract.induce(pages)
    for page, want in zip(pages, texts):
        assert html_extract.extract(page, w).split("\n\n") == list(want)


def test_template_is_checked_on_all_pages_of_a_host(spark):
    rng = random.Random(3)
    lines = lambda i: (prose(rng, 40), "Standing text of one section" if i < 6 else prose(rng, 12))
    texts = [lines(i) for i in range(12)]
    pages = [f"{HEAD}<div class=x1><p class=a>{a}</p><p class=b>{b}</p><p class=c>Same everywhere</p></div></body>" for a, b in texts]
    rows = [(i, f"https://h.example/{i}", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("h.example", json.dumps(html_extract.induce(pages[:6])))], "host string, wrapper string")
    assert len(json.loads(rules.first()["wrapper"])["template"]) == 2
    w = json.loads(html_extract.verified(df, rules).first()["wrapper"])
    for page, want in zip(pages, texts):
        assert html_extract.extract(page, w).split("\n\n") == list(want)


def test_second_layout_of_a_host():
    rng = random.Random(4)
    box = "<div class=x1><p>{}</p></div>"
    w = html_extract.induce([f"{HEAD}{box.format(prose(rng, 60))}</body>" for _ in range(6)])
    assert w["region"].endswith("div.1.x:")
    other = [prose(rng, 50) for _ in range(3)]
    page = f"{HEAD}{box.format('A few words')}<div class=y>{''.join(f'<p>{p}</p>' for p in other)}</div></body>"
    assert all(p in html_extract.extract(page, w).split("\n\n") for p in other)


def test_long_outlines():
    rng = random.Random(5)
    pages = []
    for _ in range(4):
        many = "".join(f"<h2>{prose(rng, 2)}</h2><p class=k>{prose(rng, 8)}</p>" for _ in range(1000))
        pages.append(f"{HEAD}<div class=x1><p class=k>Same</p>{many}</div><div class=y>{prose(rng, 20)}</div></body>")
    w = html_extract.induce(pages)
    assert w["region"] == "" and [len(html_extract.extract(p, w).split("\n\n")) >= 2000 for p in pages] == [True] * 4


def test_class_words_of_containers():
    page = "<html><body class='single has-sidebar'><div class='content with-sidebar'><article class='post related'><h1>T</h1><p>text</p><div class=comments><article class='comment'>I say</article></div></article></div><div class=sidebar>side</div></body></html>"
    assert html_extract.extract(page, None) == html_extract.extract(page, html_extract.induce([page.replace("text", x) for x in "abc"])) == "T\n\ntext"
    assert html_extract.extract("<body id=banner><div class='page-header'><h1 class=banner>T</h1></div><p>text</p><div class=share>s</div></body>", None) == "T\n\ntext"
    assert html_extract.extract("<div class='widget'><main class=social><p>text</p></main></div><p>rest</p>", None) == "text"


def test_equal_articles_of_a_host_are_kept():
    page = f"{HEAD}<nav>n</nav>{ARTICLE}</body>"
    assert html_extract.extract(page, html_extract.induce([page] * 4)).split("\n\n") == WANT


def test_extraction_query(spark, tmp_path):
    rows = [(i, f"https://h{i % 3}.example/{i}", f"{HEAD}<nav>menu {i}</nav><article><h1>T{i}</h1><p>p{i}</p></article><footer>f{i}</footer>") for i in range(12)]
    rows += [(50, None, None), (51, "no url", ""), (52, "https://lone.example/x", HEAD + ARTICLE), (0, "https://h0.example/0", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit(2))
    save(df, tmp_path, "pages")
    got = html_extract.query(spark, str(tmp_path)).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 16 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(texts[i] == f"T{i}\n\np{i}" for i in range(12)) and texts[50] == texts[51] == "" and texts[52].split("\n\n") == WANT
    save(df.limit(0), tmp_path, "pages")
    assert html_extract.query(spark, str(tmp_path)).collect() == []


def test_warc_round_trip():
    data = warc.member(warc.record(3, "http://x/\r\ny", b"\xc3\xa9" * 100000, "response", None, DATE)) + warc.member(warc.record(1, None, b"abc", "revisit", 3, DATE)) + warc.member(warc.record(None, "u", b"", "response", None, DATE))
    a, b, c = warc.read_records(io.BytesIO(data))
    assert a["payload"] == b"\xc3\xa9" * 100000 and a["url"] == "http://x/%0D%0Ay" and a["payload_digest"] == hashlib.sha1(a["payload"]).hexdigest()
    assert (b["record_type"], b["refers_to"], b["payload"], b["payload_bytes"], b["url"]) == ("revisit", 3, b"", 3, None)
    assert c["page_id"] is None and c["payload_bytes"] == 0
    for broken in (data[:-9], warc.member(warc.record(3, "u", b"abc", "response", None, DATE).replace(b"abc", b"abd")), warc.member(warc.record(3, "u", b"abc", "response", None, DATE).replace(b"Content-Length: 7", b"Content-Length: 6")), b"no gzip"):
        with pytest.raises(Exception):
            n = list(warc.read_records(io.BytesIO(broken)))
            assert len(n) == 3 and not broken.startswith(b"\x1f")


def test_warc_query(spark, tmp_path):
    big, rows = "é" * 600, []
    for i in range(30):
        rows.append((i, f"http://h/{i}", big if i % 3 == 0 else "small" if i % 3 == 1 else big + str(i)))
    rows += [(27, "http://h/27", big), (None, "http://h/n", big), (100, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("size", F.lit(1))
    save(df.repartition(3), tmp_path, "pages")
    got = sorted((tuple(r) for r in warc.query(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, _, html in rows:
        p = (html or "").encode()
        top = max((j for j, _, h in rows if h == html and j is not None), default=None)
        old = len(p) >= 1000 and (i is None or i < top)
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if old else "response", top if old else None))
    assert got == sorted(want, key=str)
    save(df.limit(0), tmp_path, "pages")
    assert warc.query(spark, str(tmp_path)).collect() == []


def test_chat_query(spark, tmp_path):
    odd = ["a\\", "<|im_start|>", "\\<|", "x\n<|im_end|>\ny", None, "", "\\|", "<\\|im_end|>"]
    rows = [(c, t, ["user", "assistant", "sys\ntem\\-", None][(c + t) % 4], odd[(c * 3 + t) % len(odd)]) for c in range(9) for t in range(c)] + [(8, 0, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("s"))
    save(df, tmp_path, "conversations")
    got = {r["conv_id"]: r for r in chat.query(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", chat.EXTRA), (-1, 1, "assistant", chat.EXTRA)]
    for c in {r[0] for r in rows}:
        turns = sorted((t, role or "", text or "") for k, t, role, text in rows if k == c)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(learned) and got[c]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert len(got) == len({r[0] for r in rows})
    save(df.limit(0), tmp_path, "conversations")
    assert [r["conv_id"] for r in chat.query(spark, str(tmp_path)).collect()] == [-1]


def test_chat_with_null_ids(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "user", "c"), (3, 0, "assistant", "d")]
    save(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tmp_path, "conversations")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = chat.query(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(chat.SQL).fetchall(), key=str) and len(got) == 3
    nodes = [(None, None, None, "user", "x", 0.0), (None, 1, None, "user", "y", 0.0), (None, 2, 1, "user", "z", 0.0), (5, None, 1, "user", "v", 0.0), (5, 1, None, "user", "w", 0.0)]
    df = spark.createDataFrame(nodes, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    made = {(r["tree_id"], r["root_id"], r["leaf_id"]): [t.split("\n")[1] for t in r["formatted"].split("<|im_end|>\n")[:-1]] for r in chat.format_branches(df).collect()}
    assert made == {(None, None, None): ["x"], (None, 1, 2): ["y", "z"], (5, 1, None): ["w", "v"]}


def test_reply_trees(spark):
    # 1 - 2 - 4, 1 - 3 - 5, 3 - 6; 7 alone; 8 and 9 point at each other; 10 has a parent that is not there; 2 stands twice
    rows = [(1, None, 0.0), (2, 1, 5.0), (2, 1, 5.0), (3, 1, 1.0), (4, 2, 1.0), (5, 3, 9.0), (6, 3, None), (7, None, 0.0), (8, 9, 0.0), (9, 8, 0.0), (10, 99, 1.0)]
    df = spark.createDataFrame([(0, n, p, "user", f"m{n}", s) for n, p, s in rows], "tree_id long, node_id long, parent_id long, role string, text string, score double")
    got = {}
    for r in chat.branches(df.dropDuplicates(["node_id"]), None).collect():
        got.setdefault((r["root_id"], r["leaf_id"], r["rank"]), []).append((r["depth"], r["node_id"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {(1, 5, 1): [1, 3, 5], (1, 4, 2): [1, 2, 4], (1, 6, 3): [1, 3, 6], (7, 7, 1): [7], (10, 10, 1): [10]}
    best = {r["root_id"]: r["formatted"] for r in chat.format_branches(df).collect()}
    assert best[1] == "".join(f"<|im_start|>user\nm{n}<|im_end|>\n" for n in (1, 3, 5)) and set(best) == {1, 7, 10}


def test_long_chain(spark):
    n = 200
    df = spark.createDataFrame([(0, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(n)], "tree_id long, node_id long, parent_id long, role string, text string, score double")
    r = chat.format_branches(df).collect()
    assert len(r) == 1 and [t.split("\n")[1] for t in r[0]["formatted"].split("<|im_end|>\n")[:-1]] == [str(i) for i in range(n)]


@pytest.fixture
def documents(spark, tmp_path):
    rng = random.Random(2)
    rows = corpus(11)
    leak = prose(rng, 25)
    for i in range(60):
        w = prose(rng, 60).split()
        if i % 3 == 0:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["moronic", "scumbag"])
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, prose(rng, 30) + " " + leak + " " + prose(rng, 30)), (None, "no id " + prose(rng, 10))]
    df = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    save(df, tmp_path, "documents")
    save(spark.createDataFrame([(1000 + i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int"), tmp_path, "labels")
    save(spark.createDataFrame([(1, leak)], "item_id long, text string"), tmp_path, "benchmark")
    return str(tmp_path), rows, leak


def test_stages(spark, documents):
    folder, rows, leak = documents
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in ("near_duplicates", "repeated_passages", "benchmark_leaks"):
        got = stages[name](spark, docs, folder)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        kept[name] = got.collect()
    want = brute_components([(d, t) for d, t in rows if d is not None])
    assert {r["doc_id"] for r in kept["near_duplicates"]} == {d for d, (_, c) in want.items() if d == c} | {None}
    leaked = {r["doc_id"]: r for r in kept["benchmark_leaks"]}
    assert leak not in leaked[2000]["text"] and leaked[2000]["n_chars"] == len(leaked[2000]["text"]) and len(leaked) == len(rows)
    assert all(leaked[d]["text"] == t for d, t in rows if d != 2000)
    assert len(kept["repeated_passages"]) < len(rows)
    toxic = {r["doc_id"] for r in stages["toxicity"](spark, docs, folder).collect()}
    assert not toxic & {1000 + i for i in range(0, 60, 3)} or len(toxic & {1000 + i for i in range(0, 60, 3)}) < 6
    assert None in toxic


def test_repeated_passages_against_brute_force(spark, documents):
    folder, rows, _ = documents
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null")
    got = {r["doc_id"]: r for r in corpus_pipeline.cut_repeated_passages(spark, docs, folder).collect()}
    own = [(d, t) for d, t in rows if d is not None]
    want = brute_substrings(own)
    assert set(got) == {d for d, (n, gone, _) in want.items() if not gone or gone < n}
    for d, t in own:
        if d in got:
            n, gone, digest = want[d]
            assert got[d]["text"] == t if not gone else sha(" ".join(WORD.findall(got[d]["text"]))) == digest
            assert got[d]["n_chars"] == (None if t is None else len(got[d]["text"]))


def test_stages_with_empty_tables_and_other_columns(spark, tmp_path):
    """Columns named as those that operators add; null and repeated ids; tables without rows."""
    extra = ["n_words", "n_removed", "kept_text", "kept_sha256", "n_hit", "items", "spans", "clean_text", "score", "predicted", "component_id", "doc", "u", "host"]
    rng = random.Random(5)
    long, other = prose(rng, 60), prose(rng, 60)
    rows = [(1, long), (5, long), (5, other), (None, long), (None, None), (7, ""), (8, prose(rng, 4000))]
    docs = spark.createDataFrame([(*r, *(f"{c}{i}" for c in extra)) for i, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    save(spark.createDataFrame([], "doc_id long, toxic int"), tmp_path, "labels")
    save(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    kept = {}
    for name, work in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = work(spark, df, str(tmp_path))
            got = out.collect()
            assert name == "packing" or out.dtypes == df.dtypes
            kept.setdefault(name, got)
        assert got == []
    number = lambda name: sorted(int(r["score"][5:]) for r in kept[name])
    assert number("toxicity") == number("benchmark_leaks") == list(range(7))
    assert number("near_duplicates") == [0, 3, 4, 5, 6]  # 5 goes with all its rows; no id is no duplicate
    cut = {int(r["score"][5:]): r["text"] for r in kept["repeated_passages"]}
    assert cut[2] == other and cut[3] == long and cut[4] is None and not {0, 1} & set(cut)
    assert {r["doc_id"] for r in kept["packing"]} == {1, 5, 7, 8, None}
    save(docs.limit(0), tmp_path, "documents")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_runs_whole(spark, documents):
    folder, rows, _ = documents
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and {r["doc_id"] for r in got} <= {d for d, _ in rows} and sum(r["length"] for r in got) > 1000
    assert len(corpus_pipeline.STAGES) == 5
