"""The language model, the classifier, page extraction, the pipeline, and the registered queries."""

import math
import os
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

DATA = Path(os.environ.get("TESTDATA", "/root/testdata")) / "sf0.001"
need_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def test_hidden_markov_by_definition():
    from nervemap.llm.hmm import Counts, HiddenMarkov

    draw = np.random.default_rng(1)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = HiddenMarkov(norm(draw.random(3)), norm(draw.random((3, 3))), norm(draw.random((3, 7))))
    sizes = np.array([1, 5, 64, 65, 200, 1, 130])
    symbols = draw.integers(0, 7, sizes.sum())
    total, likelihoods = Counts.zeros(3, 7), []
    for lo, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
        s = symbols[lo : lo + n]
        ahead = [m.start * m.emit[:, s[0]]]
        for x in s[1:]:
            ahead.append((ahead[-1] @ m.move) * m.emit[:, x])
        behind = [np.ones(3)]
        for x in s[:0:-1]:
            behind.append(m.move @ (m.emit[:, x] * behind[-1]))
        behind = behind[::-1]
        mass = ahead[-1].sum()
        likelihoods.append(math.log(mass))
        for t, x in enumerate(s):
            g = ahead[t] * behind[t] / mass
            total.emit[:, x] += g
            if t:
                total.move += np.outer(ahead[t - 1], m.emit[:, x] * behind[t]) * m.move / mass
            else:
                total.start += g
    got = Counts.zeros(3, 7)
    m.expect(symbols, sizes, got)
    assert np.allclose(m.log_likelihood(symbols, sizes), likelihoods) and np.isclose(got.log_likelihood, sum(likelihoods))
    for part in ("start", "move", "emit"):
        assert np.allclose(getattr(got, part), getattr(total, part))


def _texts():
    draw = np.random.default_rng(3)
    a, b = ["der", "die", "das", "und", "haus"], ["the", "and", "house", "of", "is"]
    rows = [(i, " ".join(draw.choice(a if i % 2 else b, 30))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, "  \n"), (None, "The THE die"), (3, rows[3][1]), (63, " ".join(["word"] * 3000)), (64, "unseen " * 3)]


def _fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def _plain_scores(rows, states=4, rounds=3, seed=0):
    """The model by definition: classes of words, Baum-Welch a text at a time, the unscaled forward recursion in logarithms."""
    from nervemap.llm import language_model as L
    from nervemap.llm.hmm import Counts, HiddenMarkov

    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").lower().encode())
    train = [split(t) for i, t in rows if _fold(i, 7) != 2]
    count = Counter(w for t in train for w in t)
    n, v = np.zeros(L.CLASSES + 1), np.zeros(L.CLASSES + 1)
    for w, k in count.items():
        n[L.word_class(w)] += k
        v[L.word_class(w)] += 1
    n[-1] = len(train)
    model = HiddenMarkov.initial(states, n / n.sum(), seed)
    of = lambda t: [*map(L.word_class, split(t)), L.CLASSES]

    def forward(s):
        ahead, logs = [model.start * model.emit[:, s[0]]], 0.0
        for x in s[1:]:
            logs += math.log(ahead[-1].sum())
            ahead[-1] = ahead[-1] / ahead[-1].sum()
            ahead.append((ahead[-1] @ model.move) * model.emit[:, x])
        logs += math.log(ahead[-1].sum())
        return [a / a.sum() for a in ahead], logs

    for _ in range(rounds):
        sums = Counts.zeros(states, L.CLASSES + 1)
        for s in ([*map(L.word_class, t), L.CLASSES] for t in train):
            ahead, _ = forward(s)
            behind = np.ones(states)
            for t in range(len(s) - 1, -1, -1):
                g = ahead[t] * behind
                sums.emit[:, s[t]] += g / g.sum()
                if t:
                    pair = np.outer(ahead[t - 1], model.emit[:, s[t]] * behind) * model.move
                    sums.move += pair / pair.sum()
                    behind = model.move @ (model.emit[:, s[t]] * behind)
                    behind /= behind.sum()
                else:
                    sums.start += g / g.sum()
        model = HiddenMarkov.fitted(sums)
    inside = lambda w: math.log10((count[w] + 1) / (n[L.word_class(w)] + v[L.word_class(w)] + 1))
    return {(i, t): forward(of(t))[1] / math.log(10) + sum(map(inside, split(t))) for i, t in rows}


def test_language_model(spark, monkeypatch):
    import nervemap.llm.language_model as L

    rows = _texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("held", F.lit(1)).withColumn("tokens", F.lit(1))
    for small in (False, True):
        if small:
            monkeypatch.setattr(L, "BLOCK", 500)
            monkeypatch.setattr(L, "BUNDLE", 900)
        got = L.score_texts(df, rounds=3).collect()
        split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").lower().encode())
        train = [split(t) for i, t in rows if _fold(i, 7) != 2]
        c = Counter(w for t in train for w in t)
        c["end"] = len(train)
        n, v = sum(c.values()), len(c)
        want = {}
        for i, t in rows:
            own = [*split(t), "end"]
            base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)
            want[i, len(own)] = (_fold(i, 7) == 2, sum(c[w] > 0 for w in own), base)
        assert len(got) == len(rows)
        plain = sorted(((i is not None, i or 0, x) for (i, _), x in _plain_scores(rows).items()))
        made = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["score"]) for r in got})
        assert [x[:2] for x in made] == [x[:2] for x in plain] and np.allclose([x[2] for x in made], [x[2] for x in plain], rtol=1e-9)
        for r in got:
            held, known, base = want[r["doc_id"], r["n_tokens"]]
            assert (r["held_out"], r["n_known"], r["train_tokens"]) == (held, known, n)
            assert r["base_score"] == pytest.approx(base) and r["score"] < 0
        held = [r for r in got if r["held_out"] and r["n_tokens"] > 5]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert L.score_texts(df.where("false")).count() == 0


def test_language_model_probabilities_add_up(spark):
    """Over all words and the end, the chance of what comes next is one."""
    from nervemap.llm.hmm import HiddenMarkov

    m = HiddenMarkov.initial(3, np.array([0.5, 0.3, 0.2]), 1)
    one = [m.log_likelihood(np.array([0, 1, s]), np.array([3]))[0] for s in range(3)]
    assert np.exp(one).sum() == pytest.approx(math.exp(m.log_likelihood(np.array([0, 1]), np.array([2]))[0]))


def test_classifier(spark):
    from nervemap.llm.quality import fit, held_out, with_score

    draw = np.random.default_rng(5)
    good, bad = ["plain", "words", "here", "flow", "on."], ["BUY!!", "$$$", "win###", "now%%%"]
    rows = [(i, " ".join(draw.choice(good if i % 3 else bad, 25)), int(i % 3 > 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "plain words"), (7, rows[7][1]), (902, "plain " * 300_000)], "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(7, 1), (None, 0), (5000, 1), (900, None)], "doc_id long, quality int")
    model = fit(docs, labels)
    got = with_score(docs, model).select("*", held_out("doc_id").alias("h")).collect()
    assert len(got) == 245 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["h"] == (_fold(i, 5) == 0) for i, _, _ in rows)
    held = [(by_id[i]["predicted"], q) for i, _, q in rows if _fold(i, 5) == 0]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    none = fit(docs.where("false"), labels.where("false"))
    assert {r["predicted"] for r in with_score(docs.limit(3), none).collect()} == {1}
    assert with_score(docs.where("false"), model).count() == 0
    # the same words score the same whatever stands beside them
    twice = with_score(docs.withColumn("lang", F.lit("zz")), model).where("doc_id = 7").select("score").distinct().count()
    assert twice == 1


def test_word_vectors_and_pooling_by_definition(spark, monkeypatch):
    from nervemap.llm import quality as Q

    monkeypatch.setattr(Q, "STEP", 40)  # long texts in pieces
    draw = np.random.default_rng(7)
    words = ["Plain", "plain,", "words", "HERE!", "x9", "été", "42", "a-b", "..."]
    texts = [" ".join(draw.choice(words, n)) for n in (1, 2, 5, 17, 30, 33)] + [None, "", " \n"]
    index = Q.index_vectors(3)
    near = {}
    for t in texts:
        own = [Q._buckets(w) for w in (t or "").encode().split()]
        for i, (b, _) in enumerate(own):
            for j in range(max(0, i - Q.WINDOW), min(len(own), i + Q.WINDOW + 1)):
                if j != i:
                    near[b] = near.get(b, np.zeros(Q.SIZE)) + index[own[j][0]] + index[own[j][1]]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    made = Q.word_vectors(df, seed=3)
    for b in range(Q.WORDS):
        want = near.get(b, np.zeros(Q.SIZE))
        assert np.allclose(made[b], want / max(1.0, np.linalg.norm(want)), atol=1e-6)
    got = Q.features(texts, made, index)
    for t, row in zip(texts, got, strict=True):
        own = [Q._buckets(w) for w in (t or "").encode().split()]
        n = max(1, len(own))
        pooled = sum((made[b] for b, _ in own), np.zeros(Q.SIZE)) / n
        shapes = sum((index[s] for _, s in own), np.zeros(Q.SIZE)) / n
        assert np.allclose(row[:-2], np.concatenate([pooled, shapes]), atol=1e-5) and row[-2] == pytest.approx(math.log1p(len(own)))
        if len(own) < 40:  # repeats are told within a piece
            assert row[-1] == pytest.approx(len({b for b, _ in own}) / n)


def test_temperature_is_the_best_of_those_tried():
    from nervemap.llm.quality import Network

    draw = np.random.default_rng(2)
    x = draw.normal(0, 1, (400, 5))
    y = (x[:, 0] + draw.normal(0, 1.5, 400) > 0).astype(float)
    net = Network.fit(x, y, seed=1)
    kept = np.random.default_rng(1).permutation(400)[300:]
    z = net.logit(x[kept])
    loss = lambda t: -np.mean(y[kept] * np.log(1 / (1 + np.exp(-z / t))) + (1 - y[kept]) * np.log(1 / (1 + np.exp(z / t))))
    assert loss(net.temperature) == pytest.approx(min(map(loss, np.geomspace(0.25, 8, 60))))
    assert net.temperature > 1  # it was too sure of noisy labels


def test_pages(spark):
    from nervemap.llm.html_extraction import extract_articles

    body = lambda x: f"<html><head><title>no</title></head><body><nav>menu</nav><div class='ad-box'>buy</div><div class='post-12'>{x}</div><aside>no</aside><footer>no</footer></body></html>"
    long = "<p>One &amp; two&nbsp;three <b>bo</b>ld.<p>Next\n  line<br>goes <a href=x>on</a>" + "<p>more words of the text here</p>" * 3
    rows = [
        (1, "https://a.example/x", body(long)),
        (2, "https://a.example/y", body(long)),
        (3, "https://a.example/z", body("<p>short, but " + "long enough " * 20) + "<div class='other'>" + "<p>a reader's remark in another place</p>" * 6 + "</div>"),
        (10, "https://a.example/w", body("<p>a lead") + "<div class='other'>" + "<p>and six paragraphs of the article</p>" * 6 + "</div>"),
        (4, None, None),
        (5, "https://b.example", ""),
        (6, "https://b.example", "<p>tail < x <!-- <p>no --><script>if (a<b) '</p>'</script><style>p{}</style><form><p>no</form>"),
        (7, "https://c.example", "<article><h1>A</h1><ul><li>i<li>j</ul><table><tr><td>c<td>d</table></article>"),
        (8, "https://d.example", "<main>" + "<p>x</p>" * 20_000 + "</main>"),
        (1, "https://a.example/x", body(long)),
        (9, "https://e.example", "&lt;b&gt; plain &#65;&#x42; &unknown; <div"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("path", F.lit(1)).withColumn("text", F.lit("x"))
    got = {r["page_id"]: r for r in extract_articles(df).collect()}
    more = "\n\n".join(["more words of the text here"] * 3)
    assert got[1]["text"] == got[2]["text"] == f"One & two three bold.\n\nNext line goes on\n\n{more}"
    assert got[3]["text"] == ("short, but " + "long enough " * 20).strip()  # the host's path wins
    assert got[10]["text"] == "\n\n".join(["a lead", *["and six paragraphs of the article"] * 6])  # where it loses text it doesn't
    assert got[4]["text"] == got[5]["text"] == "" and got[4]["n_chars"] == 0
    assert got[6]["text"] == "tail < x" and got[7]["text"] == "A\n\ni\n\nj\n\nc\n\nd"
    assert got[8]["n_chars"] == 20_000 + 2 * 19_999 and got[9]["text"].startswith("<b> plain AB &unknown;")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extract_articles(df).count() == len(rows) and extract_articles(df.where("false")).count() == 0


def test_layout_names_and_parts_beside_the_body():
    from nervemap.llm.html_extraction import article, parse

    one = lambda x: article(parse(x), None)
    long = "<p>" + "words of the text " * 30 + "</p>"
    want = " ".join(("words of the text " * 30).split())
    for name in ("content no-sidebar", "post comments-open", "with-ads", "page has-menu"):
        assert one(f"<body><nav>n</nav><div class='{name}'>{long}</div></body>") == want
    assert one(f"<body><div class='post category-social'>{long}</div><div class='comments'>{long}</div></body>") == want  # no other text is left
    assert one(f"<body><div class=sidebar>{long}</div><article>{long}</article></body>") == want
    assert one(f"<body><div class=post><h1>Head</h1><p>intro to it</p><div class=body>{long}{long}</div><p>the end</p></div><div>x</div></body>") == f"Head\n\nintro to it\n\n{want}\n\n{want}\n\nthe end"
    assert one("<article><p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>") == "a x=2"


def test_names_take_no_article_text_out():
    from nervemap.llm.html_extraction import article, parse

    one = lambda x, path=None: article(parse(x), path)
    para = "<p>" + "words of the text " * 6 + "</p>"
    text = ("words of the text " * 6).strip()
    wrapped = f"<h1>T</h1>{para * 3}"
    want = "\n\n".join(["T", text, text, text])
    assert one(f"<body><form id=f><div class=page>{wrapped}<select><option>a</select><input></div></form></body>") == want
    assert one(f"<body><div>a line outside</div><form action=x><article>{wrapped}</article><button>Go</button></form></body>") == want
    assert one(f"<body><form><p>a line of a form<label>Name</label></form><article>{wrapped}<form><p>Write to us<input></form></article></body>") == want
    for odd in ("<h2 id='related-work'>H</h2>", "<h2 id='the-menu'>H</h2>", "<h3 class='widget-title'>H</h3>", "<p id='comment-on-method'>H</p>", "<p id='ad'>H</p>", "<section class='social-history'><h2>H</h2></section>", "<div id='share-of-votes'><p>H</p></div>", "<ul id='menu-of-the-day'><li><p>H</ul>"):
        assert one(f"<article>{para}{odd}{para}</article>") == f"{text}\n\nH\n\n{text}"
    for noise in (
        "<div class='ad'>H</div>", "<div class='ad-box'><p>H</p></div>", "<div class='related-posts'><p>H</p></div>", "<div id='comments'><p>H</p></div>", "<p class='advert'>H</p>", "<section class='comment-list'><h2>H</h2><p>H</p></section>",
        "<div class='social-history'><a href=x>H</a> | <a href=y>H</a></div>", "<ul class='share-this'><li><a href=x>H</a></ul>", "<div role='navigation'><p>H</p></div>", "<div hidden><p>H</p></div>",
    ):
        assert one(f"<article>{para}{noise}{para}</article>") == f"{text}\n\n{text}", noise
    lead = f"<body><main><div class=post><p>lead</p></div>{para * 6}</main><div class=x>{para}</div></body>"
    assert one(lead, "/body/main/div.post") == "\n\n".join(["lead", *[text] * 6])
    assert one(lead, "/body/nowhere") == one(lead)


_HARD = {
    "names": lambda n: "<div class=social-history>" * n + "x" * 500,
    "forms": lambda n: "<form><label>a" * n + "<p>x",
    "path": lambda n: "<div class=a>" * n + "<p>x</p>" + "<div>" * n + "y" * 300,
    "unclosed": lambda n: "<a " * n,
    "nested": lambda n: '<div class="a">' * n + "x" * 500,
    "inline": lambda n: "<b>" * n + "<hr>" * n + "t",
    "ends": lambda n: "<i>" * n + "</u>" * n,
    "items": lambda n: "<ul>" * n + "<li>x" * n,
    "quotes": lambda n: '<a "' * n + ">",
    "two quotes": lambda n: "<a b='" * n + '<a c="' * n + ">",
    "values": lambda n: "<a " + "''" * n + ">t",
    "signs": lambda n: "<" * n,
    "comments": lambda n: "<!--" * n,
    "rows": lambda n: "<table><tr><td>" * n + "x",
    "holders": lambda n: "<b>" * n + "<div>" * n + "text " * 20,
    "scripts": lambda n: "<script>" * n,
}


@pytest.mark.parametrize("name", list(_HARD))
def test_pages_take_time_as_they_are_long(name):
    import time

    from nervemap.llm.html_extraction import article, best_container, parse

    def seconds(n):
        html, began = _HARD[name](n), time.thread_time()
        page = parse(html)
        article(page, page.path_text(best_container(page)))
        return time.thread_time() - began

    seconds(1000)
    assert seconds(200_000) < 14 * max(0.15, seconds(25_000))  # eight times the length; its square would be 64 times


def _plain_articles(rows):
    """Another reading of well-formed pages: a tree by the standard library's parser, its best container, votes counted per host."""
    from html.parser import HTMLParser
    from urllib.parse import urlsplit

    void, raw = {"meta", "br", "hr", "img", "input", "link"}, {"script", "style", "title"}
    never = {"head", "nav", "footer", "aside", "form", *raw}
    holders = {"html", "body", "article", "main", "div"}
    shown = {"html", "head", "body", "article", "main", "div", "nav", "ul", "li", "p", "h1", "footer", "aside"}

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.root = self.at = {"tag": "", "label": "", "up": None, "inside": []}

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.at["inside"].append(" ")
            if tag in void:
                return
            attrs = {k: v or "" for k, v in attrs}
            classes = sorted({re.sub(r"\d+", "#", c) for c in attrs.get("class", "").lower().split()})
            new = {"tag": tag, "label": ".".join([tag, *classes]), "up": self.at, "inside": [], "attrs": attrs}
            self.at["inside"].append(new)
            self.at = new

        def handle_endtag(self, tag):
            at = self.at
            while at["up"] is not None and at["tag"] != tag:
                at = at["up"]
            if at["up"] is not None:
                self.at = at["up"]

        def handle_data(self, data):
            self.at["inside"].append(data)

    def noise(x):
        return x["tag"] in never or x["attrs"].get("class") == "ad"

    def ups(x):
        while (x := x["up"]) is not None:
            yield x

    def blocks(x, out, link=False):
        for y in x["inside"]:
            if isinstance(y, str):
                out[-1][0].append(y)
                out[-1][1] += len(y) * link
            elif not noise(y):
                if y["tag"] in shown:
                    out.append([[], 0])
                blocks(y, out, link or y["tag"] == "a")
                if y["tag"] in shown:
                    out.append([[], 0])
        return out

    def texts(x):
        made = [(" ".join("".join(t).split()), n) for t, n in blocks(x, [[[], 0]])]
        return [(t, n) for t, n in made if t]

    def walk(x):
        yield x
        for y in x["inside"]:
            if not isinstance(y, str) and not noise(y):
                yield from walk(y)

    def path(x):
        return "/".join(u["label"] for u in [*reversed(list(ups(x))), x] if u["tag"] in holders)

    def best(root):
        value = lambda x: sum(max(0, len(t) - 1.5 * n) for t, n in texts(x))
        for x in walk(root):
            if x["tag"] in ("article", "main") and value(x) >= 0.7 * value(root) > 0:
                return x
        return next(x for x in walk(root) if x["tag"] in ("body", ""))

    trees, votes = [], {}
    for r in rows:
        tree = Tree()
        tree.feed(r["html"] or "")
        tree.close()
        trees.append(tree.root)
        host = (urlsplit(r["url"] or "").hostname or "")
        if texts(tree.root):
            votes.setdefault(host, Counter())[path(best(tree.root))] += 1
    out = []
    for r, root in zip(rows, trees, strict=True):
        host = (urlsplit(r["url"] or "").hostname or "")
        won = max(votes.get(host, {"": 0}).items(), key=lambda v: (v[1], len(v[0])))[0]
        at = [x for x in walk(root) if path(x) == won and x["tag"] in holders] or [best(root)]
        out.append("\n\n".join(t for x in at for t, _ in texts(x)))
    return out


@need_data
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_against_another_reading(spark, sf):
    from nervemap.llm.html_extraction import extract_articles

    df = spark.read.parquet(str(DATA.parent / sf / "pages.parquet"))
    rows = [r.asDict() for r in df.collect()]
    got = Counter((r["page_id"], r["url"], r["text"]) for r in extract_articles(df).collect())
    assert got == Counter((r["page_id"], r["url"], t) for r, t in zip(rows, _plain_articles(rows), strict=True))


@need_data
def test_registered_queries(spark):
    """Those that SQL can express, against it; the others are held against plain versions above."""
    import duckdb

    from nervemap.llm.queries import oracle_sql, queries

    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 14)}
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    for name, sql in oracle_sql().items():
        cur = con.execute(sql)
        cols = [d[0] for d in cur.description]
        df = queries()[name](spark, str(DATA))
        assert sorted(df.columns) == sorted(cols)
        assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(map(tuple, cur.fetchall())), name


_MINE = ("_k1", "_k2", "_k3", "_id", "_score", "_good", "score", "predicted", "kept", "id", "group", "block", "n_bytes", "x", "item", "v", "label")


def _similar_groups(rows):
    """Smallest doc_id of each group of texts whose sets of five words have a similarity of 0.8 or more, by all pairs; rows without one come last."""
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (i, _), n in zip(rows, label, strict=True):
        least[n] = min(least.get(n, (True, 0)), (i is None, i or 0))
    return Counter(None if none else i for none, i in least.values())


@need_data
def test_pipeline(spark):
    import corpus_pipeline as P
    from nervemap.runtime import materialize

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id = 1")).unionByName(spark.createDataFrame([(None, None, None, None, None), (10_000, "", "en", "s", 0)], docs.schema))
    docs = docs.withColumns({c: F.lit("mine") for c in _MINE})
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        out = materialize(stage(spark, docs, str(DATA)), name)
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == columns
            assert out.where(" OR ".join(f"`{c}` <> 'mine' OR `{c}` IS NULL" for c in _MINE)).count() == 0
        docs = out
    before, after = seen["near_dedup"]
    assert Counter(r["doc_id"] for r in after.collect()) == _similar_groups([(r["doc_id"], r["text"]) for r in before.collect()])
    before, after = seen["passages"]
    assert before.count() == after.count() and after.where("n_chars <> length(text)").count() == 0
    assert all(r["long"] for r in before.join(after.select("doc_id", F.col("text").alias("now")), "doc_id").select((F.length("now") <= F.length("text")).alias("long")).collect())
    before, after = seen["benchmark"]
    assert 0 < after.count() < before.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in seen["quality"][1].select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) / len(good) > 0.97
    assert seen["packing"][1].where("piece = 0").count() == seen["benchmark"][1].count()
    for name, stage in P.STAGES:
        assert stage(spark, seen["quality"][0].where("false"), str(DATA)).count() == 0, name
