import random
from html.parser import HTMLParser

import numpy as np
import odd
import pyarrow as pa
import pytest

from textlode.llm import ann
from textlode.llm import html_text as ht

VECTORS = "vec_id long, embedding array<float>, label int, id long, vec string"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 7, "x") for i, v in zip(ids or range(len(vectors)), vectors)], VECTORS)


def brute(vectors, ids, queries, best):
    out = {}
    for q in queries:
        scores = sorted((-float(np.dot(vectors[ids.index(q)].astype(float), v.astype(float))), i) for i, v in zip(ids, vectors) if i != q)
        out[q] = scores[:best]
    return out


def test_rotation_keeps_lengths_and_angles():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 50))
    y = ann.rotate(x, ann.rotations(50, 1, 1, 3)[0, 0])
    assert y.shape == (5, 64) and np.allclose(y @ y.T, x @ x.T)


@pytest.mark.parametrize("joint", [1, 2, 3])
def test_probes_are_the_buckets_of_least_loss(joint):
    rng = np.random.default_rng(2)
    x, signs = ann.unit(rng.normal(size=(20, 8))), ann.rotations(8, 2, joint, 5)
    got = ann.probes(x, signs, 10).reshape(20, 2, 10)
    for t, table_signs in enumerate(signs):
        assert all(k in row for k, row in zip(ann.joint_keys(x, signs)[:, t], got[:, t]))
        sides = [np.stack([y, -y], 2).reshape(20, -1) for y in (ann.rotate(x, s) for s in table_signs)]
        for q in range(20):
            loss = {}
            for at in np.ndindex(*[16] * joint):
                loss[int(np.ravel_multi_index(at, [16] * joint)) + t * 16**joint] = sum((s[q].max() - s[q][a]) ** 2 for s, a in zip(sides, at))
            assert sorted(loss[k] for k in got[q, t]) == pytest.approx(sorted(loss.values())[:10])


def test_scored_share_falls_as_the_table_grows(spark):
    """Recall stays at 0.9 or more, vectors are scored once for a query, and five times the vectors are a smaller share of them."""
    rng, shares = np.random.default_rng(8), []
    for n in (2000, 10_000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = table(spark, x.astype(np.float32)).where("vec_id is not null")
        rows = ann.nearest(df, df.where("vec_id % 100 = 0")).collect()
        scores = (x[::100].astype(np.float32).astype(float)) @ x.astype(np.float32).astype(float).T
        scores[np.arange(n // 100), np.arange(0, n, 100)] = -9
        true = {100 * i: set(np.argsort(-s)[:20].tolist()) for i, s in enumerate(scores)}
        assert sum(r.vec_id in true[r.query_id] for r in rows) >= 0.9 * 20 * len(true)
        shares.append(np.mean([r.n_candidates for r in rows]) / n)
    assert shares[1] < 0.9 * shares[0] and shares[0] < 0.3


def test_small_tables_give_all_they_have(spark):
    rng = np.random.default_rng(9)
    for n in (2, 12, 21):
        x = rng.normal(size=(n, 64)).astype(np.float32)
        df = table(spark, x)
        got = {}
        for r in ann.nearest(df, df).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == {q: [i for _, i in e] for q, e in brute(x, list(range(n)), range(n), 20).items()}


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, df = list(range(1500)), table(spark, x)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    expected = brute(x, ids, [i for i in ids if i % 20 == 0], 20)
    hits = sum(len({v for _, v, _ in got[q]} & {i for _, i in e}) for q, e in expected.items())
    assert hits >= 0.9 * 20 * len(expected)
    for q, rows in got.items():
        assert [k for k, _, _ in rows] == list(range(1, 21)) and q not in [v for _, v, _ in rows]
        for _, v, score in rows:
            assert score == pytest.approx(float(np.dot(x[q].astype(float), x[v].astype(float))), abs=1e-12)


def test_many_equal_vectors_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "CHUNK", 3)
    rng = np.random.default_rng(4)
    x = np.vstack([np.tile(rng.normal(size=16), (100, 1)), rng.normal(size=(60, 16))]).astype(np.float32)
    df = table(spark, x)
    found = ann.nearest(df, df.where("vec_id % 20 = 0")).where("query_id = 0").orderBy("rank").collect()
    top = [i for _, i in brute(x, list(range(160)), [0], 20)[0]]
    assert [r.vec_id for r in found] == top


def test_a_block_takes_the_hashes_it_is_given(monkeypatch):
    """Vectors are hashed once, not in each of the chunks of queries that their block meets; a rotation is the same by transforms and as one product."""
    rng = np.random.default_rng(6)
    x = ann.unit(rng.normal(size=(300, 12)))
    signs = ann.rotations(12, 16, 2, 5)
    keys = ann.joint_keys(x, signs)
    assert np.allclose(ann.rotate(x, signs[0, 0]), ann.transformed(x, signs[0, 0]))
    monkeypatch.setattr(ann, "joint_keys", lambda *_: pytest.fail("hashed again"))
    points = pa.table({"id": pa.array(range(300)), "vec": pa.array(list(x)), "keys": pa.array(list(keys))})
    found = ann.search_block(points, points.slice(0, 5), signs, 40, 3).to_pylist()
    met = {q: (np.isin(keys, ann.probes(x[q : q + 1], signs, 40)[0]).any(1) & (np.arange(300) != q)) for q in range(5)}
    for q in range(5):
        best = sorted((-float(x[i] @ x[q]), i) for i in np.flatnonzero(met[q]))[:3]
        assert [r["vec_id"] for r in found if r["query_id"] == q and r["vec_id"] is not None] == [i for _, i in best]
    assert ann.grid(600_000, 30_000, 12) == (19, 4) and ann.grid(10_256, 513, 12) == (1, 3)


def test_odd_vectors(spark):
    rows = [[1, 0], [0, 0], None, [float("nan"), 1], [float("inf"), 1], [None, 1], [], [0.5, 0.5], [1, 2, 3], [3, 4]]
    df = table(spark, rows)
    df = df.unionByName(table(spark, [[1, 0], [2, 2]], [0, None]))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 9, 3.0), (0, 2, 7, 0.5), (7, 1, 9, 3.5), (7, 2, 0, 0.5), (9, 1, 7, 3.5), (9, 2, 0, 3.0)]
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def test_query_recall(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows]), [r.vec_id for r in rows]
    expected = brute(x, ids, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in ann.op1_cross_polytope(spark, sf_dir).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == expected.keys() and sum(len(got[q] & {i for _, i in e}) for q, e in expected.items()) >= 0.9 * 20 * len(expected)


# pages


class Plain(HTMLParser):
    """An extraction of its own: the text of article elements without furniture, block by block."""

    SKIP = {"script", "style", "noscript", "template", "title", "nav", "footer", "aside", "form", "button", "select", "textarea", "iframe"}
    VOID = {"br", "hr", "img", "input", "link", "meta", "wbr"}
    FLOW = {"a", "b", "i", "em", "strong", "span", "u", "code", "small", "sub", "sup", "time", "mark"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skipped, self.inside, self.out, self.now = [], 0, [], ""

    def flush(self):
        if text := " ".join(self.now.split()):
            self.out.append(text)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now += " "
        elif tag not in self.FLOW:
            self.flush()
        if self.skipped or tag in self.SKIP:
            if tag not in self.VOID:
                self.skipped.append(tag)
        elif tag == "article":
            self.inside += 1

    def handle_endtag(self, tag):
        if tag not in self.FLOW:
            self.flush()
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
        elif tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.now += data


def plain_text(page):
    parser = Plain()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return " ".join(parser.out)


def text_of(page):
    return ht.extracted(["h"], [ht.blocks(page)], {})[0][0]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<nav>menu</nav><article><h1>T</h1><p>a <b>b</b>c<p>d<br>e</article><footer>f</footer>", "T a bc d e"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut off <a hre", "cut off"),
        ("<article>x &lt;b&gt; &amp;amp; &#233;&nbsp;&eacute;\n\t y</article>", "x <b> &amp; é é y"),
        ("<article>f<i>o</i>o<span> bar</span></article>", "foo bar"),
        ("<main>m<aside>s</aside><form>q<input></form><div class='share-buttons'>x</div>n</main>", "m x n"),
        ("<article>a<section id=comments><p>c</p></section><div class='comment-list'>d</div></article>", "a"),
        ("<article><p class='share-price'>Shares fell.</p><div class='search-results'>Found.</div><p class=alert>Tornado alert body.</p></article>", "Shares fell. Found. Tornado alert body."),
        ("<div class='content-wrapper'><div>Cookie stuff</div><article>a</article></div>", "a"),
        ("<article>a<!--> b<!---> c<!-- d > --> e</article>", "a b c e"),
        ("<article><header><h1>T</h1></header>a<footer>by</footer></article>", "T a"),
        ("<header>site</header><div class=sidebar>s</div><div class='cookie notice'>c</div><div class=content>a</div>", "a"),
        ("<body class='has-sidebar'><div role=main>a</div><div>b</div></body>", "a"),
        ("<article>a<script>if (1<2) '</p>'</script><style>p{}</style><!-- x <p> -->b<noscript>n</noscript></article>", "a b"),
        ("<article>a<p hidden>h</p><p style='display: none'>i</p><p aria-hidden=true>j</p>b</article>", "a b"),
        ("<title>t</title><article>a</div></p></b>b</article>", "a b"),
        ("<article><p><b>a<br><p>b</p></article><div class=ad>x</div>", "a b"),
        ("<article><a title='x > y'>l</a> <img alt='>'> z</article>", "l z"),
        ("<article><ul><li>one<li>two</ul></article>", "one two"),
        ("<div class='main-header'>h</div><div id='post-12'><h1>T</h1>a</div><div>x</div>", "T a"),
    ],
)
def test_blocks(page, text):
    assert text_of(page) == text


def brute_cover(streams, run):
    seen = {}
    for p, words in enumerate(streams):
        for i in range(len(words) - run + 1):
            seen.setdefault(tuple(words[i : i + run]), set()).add(p)
    out = []
    for words in streams:
        marks = [False] * len(words)
        for i in range(len(words) - run + 1):
            if len(seen[tuple(words[i : i + run])]) > 1:
                marks[i : i + run] = [True] * run
        out.append(marks)
    return out


@pytest.mark.parametrize("run", [1, 3, 8, 11])
def test_suffix_array_covers_what_repeats(run):
    rng = random.Random(run)
    streams = [[rng.randrange(4) for _ in range(rng.randrange(0, 60))] for _ in range(12)]
    tokens, pages = [], []
    for p, s in enumerate(streams):
        tokens += [*s, -p - 1]
        pages += [p] * (len(s) + 1)
    hits, at = ht.repeated(np.array(tokens), np.array(pages), run=run), 0
    for s, marks in zip(streams, brute_cover(streams, run)):
        assert ht.covered(hits[at : at + len(s)], run).tolist() == marks
        at += len(s) + 1


def test_stream_of_blocks():
    found = [(ht.ARTICLE, "one two"), (ht.OPEN, "three"), (ht.MARKED, "four\u2009five six")]
    words, roles = ht.stream(found)
    assert words == [w for _, x in found for w in x.split(" ")]
    assert roles.tolist() == [r for r, x in found for _ in x.split(" ")]
    words, roles = ht.stream([])
    assert words == [] and len(roles) == 0


def test_array_decides_on_nominated_blocks(spark, monkeypatch):
    """Nominated blocks of an article go where they repeat outside articles; an article's own text stays, repeated or not."""
    passage = " ".join(f"shared{i}" for i in range(40))
    legal = " ".join(f"legal{i}" for i in range(12))
    promo = " ".join(f"promo{i}" for i in range(9))
    rows = [(i, "http://h/", f"<article>own{i} text{i} {passage}<div class=ad>{promo}</div></article><footer>{legal}</footer>") for i in range(6)]
    rows += [(6, "http://h/", f"<article>own6 {legal} tail6<div class=ad>one of its kind</div></article>"), (7, "http://g/", f"<article>{legal} {promo}</article>")]
    expected = {i: f"own{i} text{i} {passage}" for i in range(6)} | {6: f"own6 {legal} tail6 one of its kind", 7: f"{legal} {promo}"}
    for part in (1024, 1, 2):
        monkeypatch.setattr(ht, "PART_PAGES", part)
        got = ht.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id", "url"]).collect()
        assert {r.page_id: r.text for r in got} == expected
        assert {r.page_id: r.n_removed for r in got} == {i: 9 for i in range(6)} | {6: 0, 7: 0}


def open_pages(n=30, seed=5):
    rng = random.Random(seed)
    menu = " ".join(f"menu{i}" for i in range(12))
    legal = " ".join(f"legal{i}" for i in range(15))
    rows = []
    for i in range(n):
        own = " ".join(f"u{rng.randrange(10**6)}" for _ in range(25))
        rows.append((i, f"http://h{i % 2}.org/{i}", f"<div>{menu}</div><div>{own}</div><div>start here {legal} end{i} of{i} it{i}</div>", f"{own} end{i} of{i} it{i}"))
    return rows


@pytest.mark.parametrize("part", [256, 4])
def test_open_text_without_boilerplate(spark, monkeypatch, part):
    monkeypatch.setattr(ht, "PART_PAGES", part)
    rows = open_pages()
    rows += [(100, "http://h0.org/100", rows[0][2], rows[0][3])]  # a copy does not erase its page
    df = spark.createDataFrame([(*r[:3], 1, "x") for r in rows], "page_id long, url string, html string, row long, host string")
    got = {r.page_id: r.text for r in ht.main_text(df, ["page_id", "url"]).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_runs_that_repeat_only_across_parts(spark, monkeypatch):
    monkeypatch.setattr(ht, "PART_PAGES", 1)
    rows = [(i, "http://h.org/", f"<div>{' '.join(f'b{k}' for k in range(10))}</div><div>own{i} text{i} of{i}</div>") for i in range(6)]
    got = {r.page_id: r.text for r in ht.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id", "url"]).collect()}
    assert got == {i: f"own{i} text{i} of{i}" for i in range(6)}


@pytest.mark.parametrize("part", [256, 4, 1])
def test_runs_across_blocks_in_any_parts(spark, monkeypatch, part):
    """Short list items, runs over a block's border and runs from a menu into open text go, whatever the parts."""
    monkeypatch.setattr(ht, "PART_PAGES", part)
    items = "".join(f"<li>link{i} to{i}</li>" for i in range(6))
    rows = []
    for i in range(6):
        own = " ".join(f"own{i}x{k}" for k in range(9))
        rows.append((i, "http://h.org/", f"<ul>{items}</ul><p>{own}</p><p>a b c d e</p><p>f g h {own} y</p><nav>m n o p q r s</nav><p>t {own} z</p>", f"{own} {own} {own} z"))
    rows += [(9, "http://h.org/", f"<article>main</article><ul>{items}</ul>", "main")]
    got = {r.page_id: r.text for r in ht.main_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string"), ["page_id", "url"]).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_short_unique_runs_stay():
    sentence = "we are very glad to greet our guest {} who came from far away to see us all"
    names = ("Ann", "Bob Lee", "Eve")
    assert [t for t, _ in ht.extracted(["h"] * 3, [[(ht.OPEN, sentence.format(name))] for name in names], {})] == list(names)


def test_odd_pages(spark):
    rows = [(None, None, None), (1, "nonsense", ""), (1, "nonsense", ""), (2, None, "<p>" + odd.LONG), (3, "http://x/", "<article>\u0000 z</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = ht.main_text(df, ["page_id", "url"]).collect()
    assert len(got) == 5 and {r.n_chars for r in got if r.page_id == 2} == {len(odd.LONG)}
    assert ht.main_text(df.limit(0), ["page_id", "url"]).count() == 0


def test_page_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in ht.op4_html_extraction(spark, sf_dir).collect()}
    assert got.keys() == {p.page_id for p in pages}
    for p in pages:
        assert got[p.page_id].text == plain_text(p.html) and got[p.page_id].n_chars == len(got[p.page_id].text)
