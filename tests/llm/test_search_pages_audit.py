"""Reversed lexical search, main text of pages, and the audit of interacting filters."""

import html
import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfline.llm import lexical
from shelfline.llm.filter_audit import audit_documents, lattice_edges
from shelfline.llm.html_text import extract_pages, main_text
from shelfline.llm.lexical import rank_documents, term_lists
from tests.llm.helpers import PROSE, no_documents, odd_documents, sample
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long, score long"


@pytest.mark.parametrize("name", ["op11_reversed_search", "op13_filter_paths"])
def test_sql_twins(spark, name):
    assert compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF) == []


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    """Brute force: every item against every document."""
    docs = [(i, terms(t)) for i, t in docs]
    n, length = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = Counter(t for _, own in docs for t in set(own))
    found = Counter()
    for item, text in {(i, t) for i, t in items}:
        scores = []
        for doc, own in docs:
            tf = Counter(own)
            score = 0
            for t in terms(text):
                if t in tf:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * (75 + 25 * len(own) * n // length)))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        found.update((item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1))
    return found


def odd_items(spark):
    rows = [(1, "The quick brown FOX fox"), (1, "The quick brown FOX fox"), (1, "dog"), (2, None), (3, ""), (4, " .,; "), (5, "ä日本語 rain"), (None, "fox one two"),
            (6, "unheard-of"), (7, PROSE * 3), (8, "w1 w2 W3 no id")]
    return spark.createDataFrame([(*r, 9, 9) for r in rows], ITEMS)


def search_rows(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_search_equals_brute_force(spark):
    for docs in (odd_documents(spark), sample(spark, 60)):
        items = odd_items(spark)
        want = ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 4)
        assert search_rows(rank_documents(docs, items, 4)) == want and want


def test_search_over_several_index_blocks_and_pieces(spark, monkeypatch):
    docs, items = odd_documents(spark), odd_items(spark)
    want = search_rows(rank_documents(docs, items, 4))
    monkeypatch.setattr(lexical, "POSTINGS", 12)
    assert search_rows(rank_documents(docs, items, 4)) == want
    monkeypatch.setattr(lexical, "PIECE", 7)
    text = "Ab-cd ä日本語 x" * 50
    assert [t.decode() for part in term_lists(text.encode()) for t in part] == terms(text)
    monkeypatch.setattr(lexical, "CELLS", 50)
    index = lexical.Index(lexical.postings_of(items).toArrow())
    index.weigh(3, 30, {t: 1 for t in range(len(index.terms))})
    import numpy as np

    hits = [(d, t, 1 + d) for d in range(3) for t in range(len(index.terms))]
    got = index.scores(*np.array(hits, np.int64).T, np.array([5, 10, 15], np.int64))
    want = np.zeros_like(got)
    for d, t, tf in hits:
        for p in range(index.start[t], index.start[t + 1]):
            want[d, index.item[p]] += index.repeats[p] * index.weight[t] * (10**9 * tf // (1000 * tf + 12 * (75 + 25 * 5 * (d + 1) * 3 // 30)))
    assert (got == want).all()


def test_search_keeps_the_smallest_ids_among_many_ties(spark):
    docs = spark.range(5000).select((5000 - F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "same words here").otherwise("other text").alias("text"))
    got = rank_documents(docs.repartition(5), spark.createDataFrame([(1, "same")], "item_id long, text string"), 20).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2 * i + 2 for i in range(20)] and len({r.score for r in got}) == 1


def test_search_without_documents_or_items(spark):
    assert rank_documents(no_documents(spark), odd_items(spark)).count() == 0
    assert rank_documents(odd_documents(spark), odd_items(spark).limit(0)).count() == 0


def article_text(page):
    """Brute force for the given pages, whose article is marked and flat."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", part.replace("<br>", " "))).split()) for part in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in entry.queries()["op12_composite_density"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == pages.count()
    for page in pages.collect():
        row = got[page.page_id]
        assert (row.url, row.text, row.n_chars) == (page.url, article_text(page.html), len(article_text(page.html)))


BODY = ("<p>The first paragraph has a good many words, so that it is dense, with a <a href=x>link</a> in it.</p>"
        "<p>Second &amp; last&nbsp;one\n goes  on here for a while.</p><p>Short.</p>")
TEXT = "The first paragraph has a good many words, so that it is dense, with a link in it.\nSecond & last one goes on here for a while.\nShort."
REMARKS = "<p>I think this is a very long comment by a reader who has lots of spare time to write here about it all.</p>" * 3
MENU = "<ul class='menu'><li><a href=a>One</a><li><a href=b>Two</a></ul>"


@pytest.mark.parametrize("page, want", [
    (f"<body><div id='header'><h1>Site</h1></div>{MENU}<div class='page has-sidebar'><div id=content><h2>Title</h2>{BODY}</div><div id='sidebar'><p>About us</p></div>"
     f"</div><div id='comments'>{REMARKS}</div><div class=cookie-consent>We use cookies</div><div id=footer>me</div></body>", "Title\n" + TEXT),
    (f"<main><article class='post'><header class='entry-header'><h1>Title</h1><span>By me</span></header>{BODY}<form><p>Sign up</p></form><aside>Buy</aside></article>"
     f"<div id=comments><article class=comment>{REMARKS}</article></div></main>", "Title\n" + TEXT),
    (f"<nav><a>x</a></nav><div><section><h2>A</h2>{BODY}</section><section><h2>B</h2>{BODY}</section><section><h2>C</h2><p>few words</p></section></div>"
     "<div><a href=a>more links</a><a href=b>other links</a></div>", f"A\n{TEXT}\nB\n{TEXT}\nC\nfew words"),
    ("<article><table><tr><td>a<td>b</tr><tr><td>c</td><td>d</td></tr></table><ul><li>x<li>y</ul><pre>a\n  b</pre>line<br>two</article>", "a b\nc d\nx\ny\na b\nline two"),
    ("<script>if (a<b) '</p>'</script><p>hello</p><script>unclosed <p>x", "hello"),
    ("<p>a</p><p hidden>b</p><div style='display: none'>c</div><span class='ad'>buy</span><p>d <span aria-hidden=true>e</span>f</p>", "a\nd f"),
    ("<form id=all action=x><div><p>Some long article text in a form that wraps all of the page.</p><p>More of it.</p></div><input></form>",
     "Some long article text in a form that wraps all of the page.\nMore of it."),
    (f"<div><!-- <p>no</p> --><a title='a > b' href=\"x\">go</a></div><ARTICLE>{BODY}</ARTICLE>", TEXT),
    (None, ""), ("", ""), (" \n ", ""), ("just &lt;text&gt; &#8364; &am", "just <text> € &am"), ("<nav>only a menu</nav>", ""),
    ("<div>" * 30000 + "x" + "</div>" * 30000, "x"), ("<p>" + "<b>" * 30000 + "x" + "</i>" * 30000 + "<i>" * 9999 + "</b>" * 9999, "x"),
    ('<a href="x>' * 30000, ""), ("<!-- " * 30000 + "x", ""), ("<article>" * 9999 + "x", "x"), ("<p>" + "word " * 1000000, ("word " * 1000000).strip()),
])
def test_main_text(page, want):
    assert main_text(page) == want


def test_pages_odd_rows(spark):
    rows = [(1, "u", "<p>one", "t", 1), (1, "u", "<p>one", "t", 1), (None, None, None, None, None), (2, None, "", "t", 2)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long"))
    assert Counter(tuple(r) for r in got.collect()) == Counter([(1, "u", "one", 3), (1, "u", "one", 3), (None, None, "", 0), (2, None, "", 0)])
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def audited(docs, labels):
    """Brute force: every order applied to every document."""
    flags = defaultdict(lambda: [0, 0])
    for doc, quality, toxic in labels:
        flags[doc][0] |= quality == 1
        flags[doc][1] |= toxic == 1
    texts = defaultdict(list)
    for doc, text, _ in docs:
        texts[text or ""].append(doc)
    fails, parts = [], defaultdict(list)
    for at, (doc, text, source) in enumerate(docs):
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
        fails.append({f for f, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)),
                                       ("D", bool(re.search(r"[#$%&*|]", text))), ("E", doc is not None and any(d is not None and d < doc for d in texts[text]))) if bad})
        parts[source or ""].append(at)
    found = {}
    for part, rows in parts.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = set(rows)
            for step, f in enumerate(order, 1):
                out = {r for r in alive if f in fails[r]}
                alive -= out
                total[f] += len(out)
                mark = [flags[docs[r][0]] if docs[r][0] is not None else [0, 0] for r in out]
                found[part, order, step] = [len(alive), len(out), sum(f in fails[r] for r in rows) - len(out), sum(fails[r] == {f} for r in rows),
                                            sum(m[0] for m in mark), sum(m[1] for m in mark), f]
        for key in found:
            if key[0] == part:
                found[key][6] = total[found[key][6]]
    return {k: tuple(v) for k, v in found.items()}


def test_audit_equals_brute_force(spark):
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 0, 0), (None, 1, 1), (5, 1, None), (99, 1, 1), (0, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = [(20 + i, PROSE.replace("fox", f"f{i % 3}").upper() + " # " * (i % 2) + " ".join(f"w{j}" for j in range(250 * (i % 3))), "s1", i) for i in range(12)]
    docs = odd_documents(spark).select("doc_id", "text", "source", F.lit(1).alias("part")).unionByName(
        spark.createDataFrame(more, "doc_id long, text string, source string, part int"))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit_documents(docs, table).collect()}
    assert got == audited([(r.doc_id, r.text, r.source) for r in docs.collect()], labels)
    assert audit_documents(no_documents(spark), table).count() == 0
    assert audit_documents(docs, table.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def test_path_counts():
    for n in range(1, 7):
        edges = lattice_edges(n)
        assert len(edges) == n * 2 ** (n - 1)
        through = Counter((sum(1 << f for f in order[:i]), f) for order in permutations(range(n)) for i, f in enumerate(order))
        assert {(s, f): w for s, f, w in edges} == through
