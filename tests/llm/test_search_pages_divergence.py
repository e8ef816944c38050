"""Ranked search, main text of pages and the divergence audit against plain versions."""

import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest

from chronopanel.llm import divergence, html_regions, lexical
from chronopanel.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_ranking(docs, items, k=50):
    """(item, rank, doc, score) by scoring every document."""
    bags = [(i, Counter(tokens(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total, df = len(bags), sum(b[2] for b in bags), Counter(t for _, b, _ in bags for t in b)
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        asked = {t for i, text in items if i == item for t in tokens(text)}
        scored = []
        for doc, bag, size in bags:
            m = 100 - 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in asked if t in bag)
            if score > 0:
                scored.append((-score, doc is not None, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_search_equals_scoring_every_document(spark, small_docs, sf_dir, edge_docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    odd = [(1, None), (2, ""), (3, "one two THREE zzz"), (3, "word1"), (None, "six x5"), (4, "... !"), (5, "one one one")]
    for docs, asked in ((small_docs, items), (edge_docs, odd)):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        for chars in (1 << 20, 200):                          # one slice of queries, many slices
            got = lexical.search(docs, spark.createDataFrame(asked, "item_id long, text string"), slice_chars=chars)
            assert found(got) == plain_ranking(rows, asked)


def test_search_without_rows(spark, no_docs, edge_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    asked = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lexical.search(edge_docs, none).count() == 0 and lexical.search(no_docs, asked).count() == 0 and lexical.search(no_docs, none).count() == 0


def shard_of(docs, vocabulary):
    builder = lexical.ShardBuilder(vocabulary)
    for i, t in docs:
        builder.add(i, t.encode())
    return builder.rows(7).to_pylist()


def test_blocks_are_rejected_before_they_are_unpacked(monkeypatch):
    rng = random.Random(3)
    docs = [(i, " ".join(["common"] * rng.randint(1, 3) + ["filler"] * rng.randint(5, 60) + (["rare"] * 3 if i % 211 == 0 else []))) for i in range(20_000)]
    rows = shard_of(docs, ["common", "rare"])
    n, total = len(docs), sum(len(t.split()) for _, t in docs)
    df = {r["term"]: r["df"] for r in rows if r["term"]}
    weights = {t: lexical.weight(n, d) for t, d in df.items()}
    read = []
    unpack = lexical.unpack
    monkeypatch.setattr(lexical, "unpack", lambda b: read.append(1) or unpack(b))
    ids, scores = lexical.Shard(rows, n, total).search(weights)
    want = plain_ranking(docs, [(1, "common rare")])
    assert sorted(((1, r + 1, int(i), int(s)) for r, (i, s) in enumerate(zip(ids, scores))), key=str) == want
    assert len(read) < sum(len(r["last"]) for r in rows if r["term"]) / 2


def test_shards_of_any_size_agree(spark, small_docs, sf_dir, monkeypatch):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").limit(5).collect()]
    docs = [tuple(r) for r in small_docs.collect()]
    words = sorted({t for _, x in items for t in tokens(x)})
    want = plain_ranking(docs, items)
    bags = [b for b in (tokens(t) for _, t in docs) if b]
    n, total, df = len(bags), sum(map(len, bags)), Counter(t for b in bags for t in set(b))
    for size, window in ((1000, 4096), (40, 16)):
        monkeypatch.setattr(lexical, "WINDOW", window)
        got = []
        for item in dict.fromkeys(i for i, _ in items):
            weights = {t: lexical.weight(n, df[t]) for i, x in items if i == item for t in tokens(x) if df[t]}
            heap = []
            for at in range(0, len(docs), size):
                heap += [(-int(s), int(i)) for i, s in zip(*lexical.Shard(shard_of([(i, t or "") for i, t in docs[at:at + size]], words), n, total).search(weights))]
            got += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(heap)[:50])]
        assert sorted(got, key=str) == want


def test_blocks_round_trip():
    rng = np.random.default_rng(5)
    for high in (200, 60_000, 1 << 30):
        docs = np.unique(rng.integers(0, high, 128))
        tf = rng.integers(1, high, len(docs))
        a, b = lexical.unpack(lexical.pack(docs, tf))
        assert (a == docs).all() and (b == tf).all()


def test_block_bounds_are_the_highest_scores(monkeypatch):
    rng = random.Random(9)
    docs = [(i, " ".join(["t"] * rng.randint(1, 30) + ["f"] * rng.randint(0, 400))) for i in range(1_000)]
    shard = lexical.Shard(shard_of(docs, ["t"]), 1_000, sum(len(t.split()) for _, t in docs))
    postings = shard.lists["t"]
    assert [int(b) for b in postings.bounds] == [int(postings.block(k, shard.lengths)[1].max()) for k in range(len(postings.bounds))]


class Article(HTMLParser):
    """Plain version: text inside ``article``, blocks joined by a space."""

    def __init__(self):
        super().__init__()
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.out += [" "] if tag not in ("b", "i", "a") else []

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.out += [" "] if tag not in ("b", "i", "a") else []

    def handle_data(self, data):
        self.out += [data] if self.depth else []


def test_pages_equal_the_marked_article(spark, sf_dir):
    rows = {r.page_id: r for r in QUERIES["op12_html_main_text"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for page in pages:
        plain = Article()
        plain.feed(page.html)
        plain.close()
        want = " ".join("".join(plain.out).split())
        assert (rows[page.page_id].text, rows[page.page_id].n_chars, rows[page.page_id].url) == (want, len(want), page.url)


PARTS = {
    "menu": "<nav><ul><li><a href='/'>Home</a><li><a>About</a></ul></nav>", "notice": "<div class='cookie-notice'><p>We use cookies to serve you better in every way.</p></div>",
    "header": "<header class=top><h1>The Daily Site</h1></header>", "advert": "<div class=\"ad\">Buy one, get one free, today only.</div>", "style": "<style>p > a {x:y}</style>",
    "script": "<script>if (a < b) document.write('</p>');</script>", "form": "<form action=x><label>Mail</label><input name=m><button>Send</button></form>",
    "side": "<aside><p>Most read: ten stories of the week and more.</p></aside>", "footer": "<footer>&copy; all rights reserved</footer>",
    "comments": "<section id=\"comments\"><h3>2 comments</h3><article class=\"comment\"><p>I could not agree more with all of what was written here.</p></article></section>"}
BODY = ("<h1>A title</h1><p>First <b>bold</b>ly put paragraph of the text,<br>with a line break &amp; an <a href=\"a>b\">odd link</a>.</p>{0}<ul><li>one item<li>two</ul>"
        "<p>Last paragraph\n of   it&nbsp;all &lt;here&gt;.")
TEXT = "A title First boldly put paragraph of the text, with a line break & an odd link. one item two Last paragraph of it all <here>."


@pytest.mark.parametrize("frame", ["<article>{0}</article>", "<main>{0}</main>", "<div class='post-content'>{0}</div>", "<div>{0}</div>", "<div id=wrap><div class='entry'>{0}</div></div>"])
def test_what_is_no_article_goes(frame):
    weights = html_regions.Weights()
    for inner in ["", *(PARTS[p] for p in ("advert", "notice", "script", "form", "side"))]:
        page = "<html><head><title>A title</title></head><body>" + PARTS["menu"] + PARTS["header"] + PARTS["notice"] + frame.format(BODY.format(inner)) + "".join(
            PARTS[p] for p in ("comments", "advert", "script", "style", "form", "side", "footer"))
        assert html_regions.extract(page, weights) == TEXT


def test_comments_longer_than_the_article_go():
    page = f"<main><article>{BODY.format('')}</article>" + PARTS["comments"].replace("<p>", "<p>" + "a reader writes and writes " * 100) + "</main>"
    assert html_regions.extract(page, html_regions.Weights()) == TEXT


def test_forms_around_a_page_and_odd_pages():
    weights = html_regions.Weights()
    assert html_regions.extract(f"<form id=all><main>{BODY.format('')}</main></form>", weights) == TEXT
    assert html_regions.extract(f"<form id=all><div>{BODY.format('')}</div></form>", weights) == TEXT
    for page in ("", "   ", "<p>" * 50, "<nav>only a menu</nav>", "<!-- " * 10, "<script>never closed"):
        assert html_regions.extract(page, weights) == ""
    assert html_regions.extract("a < b and 3 > 2", weights) == "a < b and 3 > 2"
    assert html_regions.extract("plain\ttext", weights) == "plain text"


def test_long_pages_take_time_in_proportion():
    import time
    weights = html_regions.Weights()
    for piece in ("<div><b>x", "<p><b>x</i>", "<a ", "<li><td>x", '<a "', "<!-- x"):
        took = []
        for n in (10_000, 80_000):
            start = time.process_time()
            html_regions.extract(piece * n, weights)
            took.append(time.process_time() - start)
        assert took[1] < 32 * took[0] + 0.5


def test_stretch_equals_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, 0, 1, 2]) for _ in range(rng.randint(0, 14))]
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        start, end = html_regions.best_stretch([float(s) for s in scores])
        assert sum(scores[start:end]) == max([0, *sums.values()])


def test_weights_come_from_labelled_pages(spark, sf_dir):
    weights = html_regions.fit(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert weights.word > 0 > weights.tags["article"] and weights.tags["p"] > weights.tags["body"] and "ad" in weights.names
    odd = spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert html_regions.fit(odd) == html_regions.Weights() == html_regions.fit(odd.limit(0))


def test_page_rows_stay(spark):
    rows = [(1, "u", "<p>some text</p>", 5), (1, "u", "<p>some text</p>", 5), (None, None, None, None), (2, "v", "", 1)]
    got = html_regions.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=str) == sorted([(1, "u", "some text", 9)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)


def plain_audit(rows):
    """(lang, source, part, item, value, rank) over dense tables."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, w in own for t in set(w))
        kept = [t for t, n in df.items() if n >= 3]
        v, counts = len(kept), {s: Counter(t for _, x, w in own if x == s for t in w) for s in {d[1] for d in own}}
        share = lambda c, n: 1 + 1_000_000_000 * (c + 1) // (n + v)
        of = lambda c: {t: share(c[t], sum(c[u] for u in kept)) for t in kept}
        p, q = {s: of(c) for s, c in counts.items()}, of(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, i, n, r + 1) for r, (i, n) in enumerate(ranked)]
    return sorted(out)


def audited(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_audit_equals_dense_tables(spark, sf_dir, edge_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text")
    odd = [("en", "a", "x y z x"), ("en", "a", "x y z"), ("en", "b", "X, y1z. q"), ("en", "c", None), ("en", None, "x é Éa"), (None, None, "x x"), (None, "a", ""), ("de", "a", "solo"),
           ("fr", "a", "1 2 3"), ("fr", "b", ""), ("en", "a", "x y z x"), ("en", "é", "é " * 3000 + "w" * 90 + " " + "w" * 91), ("en", "d", "w" * 90 + " " + "w" * 91), ("en", "d", "w" * 91)]
    for rows in ([tuple(r) for r in docs.collect()], odd):
        assert audited(divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"))) == plain_audit(rows)
    assert audited(divergence.audit(edge_docs)) == plain_audit([(r.lang, r.source, r.text) for r in edge_docs.collect()])
    assert divergence.audit(no_docs).count() == 0


def test_audit_over_many_sources_and_tiles(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("en", f"s{rng.randint(0, 30)}", " ".join(rng.choice("abcdefghij") * rng.randint(1, 12) for _ in range(20))) for _ in range(150)]
    monkeypatch.setattr(divergence, "TILE", 4)
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 500)
    lists = []
    for _ in range(40):
        sids = sorted(rng.sample(range(30), rng.randint(1, 12)))
        lists.append(("en", [(s, rng.randint(50, 900), 10 + s) for s in sids]))
    f = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for _, held in lists:
        for a, p, p0 in held:
            for b, q, q0 in held:
                want[a, b] += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    table = spark.createDataFrame(lists, "lang string, held array<struct<sid: long, p: long, p0: long>>").repartition(2)
    got = {(r.a, r.b): r.part for r in divergence.shared_gaps(table).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert audited(divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"))) == plain_audit(rows)


def test_pointer_sort_equals_a_plain_sort():
    rng = random.Random(2)
    for deep in (8, 16, 64):
        texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.choice((1, 2, 7, 8, 9, 16, 17, 40)))) for _ in range(rng.randint(0, 60))) for _ in range(20)] + ["", "aab", "aab" * 40]
        folded, starts, lengths, doc = divergence.pointers(pa.array(["drop me", *texts]).slice(1))
        words = [bytes(folded[s:s + n]) for s, n in zip(starts, lengths)]
        assert words == [w.encode() for t in texts for w in t.split()] and doc.tolist() == [k for k, t in enumerate(texts) for _ in t.split()]
        order, new = divergence.sort_words(folded, starts, lengths, deep)
        want = sorted(range(len(words)), key=lambda k: words[k])          # stable as well
        assert order.tolist() == want
        assert new.tolist() == [k == 0 or words[want[k]] != words[want[k - 1]] for k in range(len(want))]
