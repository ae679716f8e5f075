"""Token files, byte-level BPE, main text, quality and toxicity."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
import tiktoken
from tokenizers import Tokenizer

from tillmark.llm import binary, bpe, pages, quality, toxicity
from tillmark.sources.shared import new_folder

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "  a", "a ", "it's  don't \n\n x", "<|endoftext|>", "x" * 5000, " " * 300, "\n" * 40, "é é́\x1c😀​ΣΑΣ 漢字\t١٢½", "Á b"]


def odd_texts(n):
    rng, letters = random.Random(2), " \n\t\x1c\x85  \r'abst é́ßΣςÇ漢😀​1２½!?-_…"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_byte_bpe_as_the_rank_library(documents):
    texts = odd_texts(400)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = set()
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    docs = documents(list(enumerate(texts))).repartition(3)
    assert {tuple(r) for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()} == want
    for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN, offsets=True).collect():
        text, spelled = texts[r["doc_id"]] or "", bpe._spelling(RANKS)
        at = 0
        for i, start in zip(r["ids"], r["starts"], strict=True):
            assert start == len(text.encode()[:at].decode(errors="ignore"))
            at += len(spelled[i])
    assert bpe.round_trip(documents([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark, documents):
    texts = odd_texts(300)
    library = Tokenizer.from_file(WORD_FILE)
    folder = new_folder(spark, "ids")
    docs = documents([*((3 * i, t) for i, t in enumerate(texts)), (None, "first"), (6, "again")])
    binary.write_ids(docs.repartition(4), folder, WORD_FILE)
    rows = sorted([(-1, "first"), (6, "again"), *((3 * i, t or "") for i, t in enumerate(texts))], key=lambda r: r[0])
    start, want = 0, set()
    for doc, t in rows:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        if doc != 6:  # of two rows with one id either may come first
            want.add((doc if doc >= 0 else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = {tuple(r) for r in binary.digests(spark, folder).collect()}
    assert want <= got and len(got) == len(rows)
    one = binary.read_ids(spark, folder, doc_id=33).collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in one] == [[*library.encode(texts[11], add_special_tokens=False).ids, 1]]
    other = new_folder(spark, "ids")
    binary.write_ids(documents([]), other, WORD_FILE)
    assert binary.digests(spark, other).count() == 0
    blob = spark.read.parquet(f"{folder}/shards").head()["blob"]
    with pytest.raises(ValueError, match="another dictionary"):
        binary._unpack(bytes(blob), b"x")


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav class=menu><ul><li><a href="/a">Menu %d</a></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy %d now</div><article class="post"><header><h1>Title&nbsp;%d &amp; more</h1></header><p>First <b>part %d</b>a,
next<br>line<p>Second &lt;part&gt; %d<ul><li>one<li>two</ul><aside>no</aside><section id="comments"><p>no</p></section></article>
<form><p>no</p></form><footer>&copy; %d</footer></body></html>"""
TEXT = "Title %d & more First part %da, next line Second <part> %d one two"


def page_rows(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_main_text_of_articles(spark):
    rows = [(i, f"http://a.example/{i}", PAGE % ((i,) * 6)) for i in range(12)]
    rows += [(20, "http://a.example/20", PAGE % ((3,) * 6)), (21, None, PAGE % ((21,) * 6)), (22, "no url at all", PAGE % ((22,) * 6))]
    got = {r["page_id"]: r for r in pages.extract(page_rows(spark, rows)).collect()}
    for i, _, _ in rows:
        assert got[i]["text"] == TEXT % ((3 if i == 20 else i,) * 3)
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_template_is_induced_without_any_article(spark):
    body = "<html><body><div><span>Welcome to the site</span></div><div><h2>Title {0}</h2><p>Text {0}.</p><p>Read on</p></div><div>All rights</div></body></html>"
    rows = [(i, f"http://b.example/{i}", body.format(i)) for i in range(5)] + [(9, "http://alone.example/", body.format(9))]
    got = {r["page_id"]: r["text"] for r in pages.extract(page_rows(spark, rows)).collect()}
    assert [got[i] for i in range(5)] == [f"Title {i} Text {i}." for i in range(5)]
    assert got[9] == "Welcome to the site Title 9 Text 9. Read on All rights"  # nothing to compare with


def test_copies_of_an_article_do_not_become_template(spark):
    rows = [(i, f"http://c.example/{i}", PAGE % (i, i, 7, 7, 7, i)) for i in range(6)]
    assert {r["text"] for r in pages.extract(page_rows(spark, rows)).collect()} == {TEXT % (7, 7, 7)}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><p>open <b>ended", "open ended"),
        ("<article><p>cut off</p><p cla", "cut off"),
        ("<p>a</p></div></p><p>b <!-- never closed", "a b"),
        ("<article><p title='a>b'>x</p><p title=\"open>y</p></article>", "x y"),
        ("<main><p>1</p><script>if (a<b) {}</script><p>2&#8364;</p></main><p>3", "1 2€"),
        ("<script>only", ""),
        ("<article></article><p>text</p>", "text"),
    ],
)
def test_broken_pages(html, text):
    assert pages.content(pages.parse(html or ""), frozenset()) == text


def test_simple_tree_matching():
    a, b = pages.parse("<div><p>a</p><ul><li>1</ul></div><div>x</div>"), pages.parse("<div><h1>t</h1><p>b</p></div><div>x</div>")
    pairs = []
    assert pages.align(a, b, pairs) == 4
    assert sorted(x.tag for x, _ in pairs) == ["#", "div", "div", "p"]


def plain_alignment(a, b):
    """Simple tree matching as published, one pair of children at a time."""
    xs, ys = a.elements(), b.elements()
    best = [[(0, [])] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], key=lambda e: e[0])
            if x.tag == y.tag:
                size, own = plain_alignment(x, y)
                if best[i][j][0] + size > best[i + 1][j + 1][0]:
                    best[i + 1][j + 1] = best[i][j][0] + size, [*best[i][j][1], *own]
    return 1 + best[-1][-1][0], [(a, b), *best[-1][-1][1]]


def test_tree_matching_as_published():
    rng = random.Random(8)

    def tree(depth):
        tag = rng.choice("abi")
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 4) if depth else 0)) + f"</{tag}>"

    for _ in range(60):
        a, b = (pages.parse("".join(tree(3) for _ in range(3))) for _ in range(2))
        pairs = []
        assert pages.align(a, b, pairs) == plain_alignment(a, b)[0] == len(pairs)
        assert all(x.tag == y.tag for x, y in pairs)


def test_what_two_pages_share_is_not_matched_again(monkeypatch):
    """Equal trees, and the equal children that two levels begin with, are paired off without comparing all with all."""
    calls, matched = [], pages._matching
    monkeypatch.setattr(pages, "_matching", lambda xs, ys, sizes: calls.append((xs, ys)) or matched(xs, ys, sizes))
    item = "<ul><li><a>x</a></li><li><b>y</b></li></ul>"
    one, other = pages.parse(f"<div>{item * 30}</div>"), pages.parse(f"<div>{item * 30}<h1>z</h1></div>")
    pairs = []
    assert pages.align(one, one, pairs) == len(pairs) == 2 + 30 * 5 and all(a is b for a, b in pairs) and not calls
    pairs.clear()
    assert pages.align(one, other, pairs) == len(pairs) == 2 + 30 * 5 and all(len(xs) * len(ys) <= 1 for xs, ys in calls)


@pytest.mark.parametrize("narrow", [0, 600])
def test_levels_are_matched_alike_with_and_without_arrays(monkeypatch, narrow):
    monkeypatch.setattr(pages, "NARROW", narrow)
    rng = random.Random(3)
    for _ in range(200):
        sizes = {(x, y): rng.randint(1, 4) for x in range(4) for y in range(4) if rng.random() < 0.7}
        xs, ys = (tuple(rng.choices(range(4), k=rng.randint(0, 7))) for _ in range(2))
        size, places = pages._matching(xs, ys, sizes)
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + sizes.get((x, y), 0))
        assert size == best[-1][-1] == sum(sizes[xs[i], ys[j]] for i, j in places)
        assert all(a > c and b > d for (a, b), (c, d) in zip(places, places[1:], strict=False))


def test_wide_levels_are_aligned_whole():
    """700 children, one more in front and a constant node in the middle."""
    page = lambda n, front: front + "".join("<h5>house rules</h5>" if i == 350 else f"<div>{n} {i}</div>" for i in range(700))
    a, b = pages.parse(page(1, "")), pages.parse(page(2, "<ul><li>new</ul>"))
    pairs = []
    assert pages.align(a, b, pairs) == 701
    assert ("house rules", "house rules") in {(x.own(), y.own()) for x, y in pairs}
    reference, seen = pages.Reference(0, pages.outline_of(a)), {}
    for i in range(5):
        tree = pages.parse(page(i, "<ul><li>new</ul>" if i % 2 else ""))
        for number, m, size, more in pages.observed(tree, reference.places(tree)[1]):
            n, least, greatest, *rest = seen.get(number, (0, m, m, 0, 0))
            seen[number] = (n + 1, min(least, m), max(greatest, m), rest[0] + size, rest[1] + more)
    article, template = pages.induce(reference, seen)
    assert template == [pages.mark("/h5", "house rules")] and article == 0


def renamed(html, names=("article", "main")):
    """The page with neutral names for some elements."""
    return re.sub(rf"<(/?)(?:{'|'.join(names)})(?=[\s>/])", r"<\1div", html)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_article_is_found_without_its_tag_in_the_given_pages(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "url", "html")
    plain = {r["page_id"]: r["text"] for r in pages.extract(rows).collect()}
    by_tag = {r["page_id"]: pages.content(pages.parse(r["html"]), frozenset()) for r in rows.collect()}
    assert plain == by_tag  # what the tags alone say where they are kept
    without = spark.createDataFrame([(r["page_id"], r["url"], renamed(r["html"])) for r in rows.collect()], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in pages.extract(without).collect()}
    assert sum(found[i] == plain[i] for i in plain) >= 0.95 * len(plain)


def test_the_article_is_found_by_alignment_alone(spark):
    """No name of an element or class says anything: menus, adverts, article and footer are all div."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    neutral = lambda h: renamed(re.sub(r' class="[^"]*"', "", h), ("article", "main", "nav", "footer"))
    without = spark.createDataFrame([(r["page_id"], r["url"], neutral(r["html"])) for r in rows.collect()], "page_id long, url string, html string")
    plain = {r["page_id"]: r["text"] for r in pages.extract(rows).collect()}
    found = {r["page_id"]: r["text"] for r in pages.extract(without).collect()}
    assert sum(found[i] == plain[i] for i in plain) >= 0.95 * len(plain)


def test_a_host_with_two_layouts(spark):
    one = "<body><div>Menu {1} home</div><div><h2>Head {0}</h2><p>The first layout has a text of several words {0}.</p></div><div>Copyright {1}</div></body>"
    two = "<body><table><tr><td>Side {1}</td><td><section><h2>Head {0}</h2><p>The second one stands in a table and says {0}.</p><p>More {0} of it, longer than the side.</p></section></td></tr></table></body>"
    odd = "<body><ul><li>{0}</ul><div>Menu</div><div><h2>Head {0}</h2><p>Another page with its own list in front {0}.</p></div><div>Copyright</div></body>"
    rows = [(i, f"http://d.example/{i}", (one if i % 2 else two).format(i, i % 3)) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in pages.extract(page_rows(spark, [*rows, (77, "http://d.example/77", odd.format(77))])).collect()}
    for i in range(20):
        assert got[i] == (f"Head {i} The first layout has a text of several words {i}." if i % 2 else f"Head {i} The second one stands in a table and says {i}. More {i} of it, longer than the side.")
    assert "Another page with its own list in front 77." in got[77]


def test_a_host_of_copies_keeps_its_text(spark):
    body = "<body><div>Menu</div><div><h2>Head</h2><p>One text that all the pages of the host have in common.</p></div><div>Imprint</div></body>"
    rows = [(i, f"http://e.example/{i}", body) for i in range(12)]
    assert {r["text"] for r in pages.extract(page_rows(spark, rows)).collect()} == {"Head One text that all the pages of the host have in common."}


def test_a_very_long_page_and_clashing_columns(spark):
    long = "<html><body><nav><a>x</a></nav><article>" + "".join(f"<p>word {i}</p>" for i in range(30_000)) + "</article></body></html>"
    rows = [(1, "http://f.example/1", long), (2, "http://f.example/2", "<html><body><nav>y</nav><article><p>short</p></article></body></html>"), (3, "http://f.example/3", "<p" * 20_000)]
    table = page_rows(spark, rows).withColumns({c: F.lit("clash") for c in ("host", "text", "layout", "references", "wrappers", "seen", "number")})
    got = {r["page_id"]: r["text"] for r in pages.extract(table).collect()}
    assert got[1] == " ".join(f"word {i}" for i in range(30_000)) and got[2] == "short"
    assert pages.extract(table).columns == ["page_id", "url", "text", "n_chars"]


def test_outlines_come_back_as_the_same_tree():
    html = "<html><body><nav><ul><li>a<li>b</ul></nav><div class=ad>x</div><article><h1>t</h1><p>u<b>v</b></article></body></html>"
    flat = lambda node: [(c.tag, c.away, c.inside, flat(c)) for c in node.elements()]
    root = pages.parse(html)
    reference = pages.Reference(0, pages.outline_of(root))
    assert flat(reference.root) == flat(root) and reference.places(root)[0] == len(reference.nodes) == 12
    odd = pages.parse("<div><x(y!)z+>w</x(y!)z+><p>v</div>")
    assert len(pages.Reference(0, pages.outline_of(odd)).nodes) == 4


def test_pages_empty(spark):
    assert pages.extract(page_rows(spark, [])).count() == 0


def labelled(prose, n):
    rows, labels = [], []
    for i in range(n):
        words = prose(60, i).split()
        kind = i % 5
        text = " ".join(words).capitalize() + "." if kind else " ".join(w.upper() + "!!" for w in words[:8] * 6)
        toxic = kind == 2
        if toxic:
            words[7:7] = ["grumf" + "abcde"[i % 3]]
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(bool(kind)), int(toxic)))
    return rows, labels


def test_quality(spark, documents, prose):
    rows, labels = labelled(prose, 400)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents([*rows, (1000, None), (1001, ""), (None, "x y z"), (5, rows[5][1])])
    got = quality.classify(docs, table).collect()
    assert len(got) == 404
    truth = {i: q for i, q, _ in labels}
    known = [r for r in got if r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in known)
    held = [r for r in known if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    kept = quality.keep_good(docs, table)
    assert kept.columns == docs.columns and {0 < truth.get(r["doc_id"], 1) for r in kept.collect()} == {True}


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(i, 1, 0) for i in range(40)], 1.0), ([(i, 0, 0) for i in range(40)], 0.0), ([(1, None, None)], 0.5)])
def test_quality_of_one_class(spark, documents, prose, labels, score):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents([(i, prose(20, i)) for i in range(40)])
    assert {r["score"] for r in quality.classify(docs, table).collect()} == {score}
    assert quality.classify(documents([]), table).count() == 0


def test_toxicity(spark, documents, prose):
    rows, labels = labelled(prose, 600)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents([*rows, (1000, None), (1001, ""), (None, "you idiot"), (1002, "what a fine day"), (1003, f"{prose(300, 5)} you 1d10t, m0r0n {prose(300, 6)}")])
    got = toxicity.classify(docs, table).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert (by[1000], by[1001], by[1002]) == (0, 0, 0)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in toxicity.classify(docs, empty).collect()} == set(by)
    assert toxicity.classify(documents([]), table).count() == 0


def test_label_model_finds_accuracies_and_clusters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    good = lambda hit, false: np.where(y, rng.random(4000) < hit, rng.random(4000) < false)
    first = good(0.8, 0.02)
    fires = np.stack([first, first, first, good(0.6, 0.05), good(0.7, 0.1)], 1).astype(float)
    q, theta, weight = toxicity.label_model(fires, np.where(rng.random(4000) < 0.1, y, -1), 0.2)
    assert np.mean((q > 0.5) == y) > 0.93
    assert theta[1, 3] > 0.4 > theta[0, 3]
    assert weight[:3].max() < 0.5 < weight[3:].min()


def test_label_model_counts_every_document():
    """Rows with a number give what as many rows give, however large the number of the clean row without a hit."""
    rng = np.random.default_rng(3)
    fires = (rng.random((300, 6)) < 0.3).astype(float)
    fires[0] = 0
    labels, number = rng.integers(-1, 2, 300), rng.integers(1, 4, 300)
    labels[0], number[0] = 0, 20_000
    q, theta, weight = toxicity.label_model(fires, labels, 0.05, number=number.astype(float))
    each = toxicity.label_model(np.repeat(fires, number, 0), np.repeat(labels, number), 0.05)
    assert np.allclose(q, each[0][np.cumsum(number) - number]) and np.allclose(theta, each[1]) and np.allclose(weight, each[2])
    assert theta[0].max() < 0.02


def test_fit_weighs_every_document(spark, documents, monkeypatch):
    """9,900 equal clean documents and 120 others of as many kinds: the label model gets all of them."""
    seen = []
    model = toxicity.label_model

    def spied(fires, labels, prior, **more):
        number = more.get("number")
        seen.append(len(labels) if number is None else number.sum())
        return model(fires, labels, prior, **more)

    monkeypatch.setattr(toxicity, "label_model", spied)
    words = sorted(toxicity.INSULTS)
    rows = [(i, "a fine day") for i in range(9900)] + [(20_000 + i, " ".join(words[: 1 + i % 40])) for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i >= 20_000)) for i, _ in rows], "doc_id long, quality int, toxic int")
    toxicity.fit(documents(rows), labels)
    learnt = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in rows)
    assert seen == [pytest.approx(learnt)]


def test_held_out_matches_sql(spark):
    ids = [0, 5, 17, 12345678901]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", quality.held_out(quality.F.col("doc_id"))).collect()
    assert [r[1] for r in rows] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]
    assert duckdb.sql("select 1").fetchall() == [(1,)]
