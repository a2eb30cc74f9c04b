"""HTML blocks, the network's gradients, and extraction from unseen page forms."""

import numpy as np
import pytest

from millrace.llm import extraction as X
from millrace.llm.htmlblocks import blocks_of

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"
STORY = ["The first paragraph of the story is long enough to be read as text.", "A second paragraph follows, with more words than a menu has.", "The last one ends the article and says good bye to its readers."]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF_DIR}/pages.parquet")


@pytest.fixture(scope="module")
def labeller(pages):
    return X.fit(pages)


def texts(page):
    return [b.text for b in blocks_of(page)]


@pytest.mark.parametrize(
    "page, expected",
    [
        ("", []),
        ("plain &amp; simple\n\t text", ["plain & simple text"]),
        ("<p>a<b>b</b>c<p>d<br>e</p>f", ["abc", "d", "e", "f"]),
        ("<ul><li>one<li>two <i>x</i></ul>tail", ["one", "two x", "tail"]),
        ("<script>if (a<b) '</p>'</script>x<style>p{}</style><!-- <p>no</p> -->y", ["x", "y"]),
        ("<SCRIPT>never closed", []),
        ("a < b and c > d &lt;p&gt; &#228;&nbsp;z", ["a < b and c > d <p> ä z"]),
        ("<table><tr><td>1<td>2<tr><td><table><tr><td>in</table>3</table>", ["1", "2", "in", "3"]),
        ("<p title='a>b' class=x>q</p></div></p>r", ["q", "r"]),
        ("<title>T</title><textarea>t</textarea><h1>H</h1><![CDATA[c < d]]>", ["H", "c < d"]),
        ("x<!-- open", ["x"]),
        ("<object data=x><p>a</p><svg><p>b</p>", ["a", "b"]),
        ("<object><p>a</p><object>inner</object><p>b", ["a", "b"]),
        ("<svg><text>q</text><svg>r</svg>s</svg>x<!-- </svg> --><video>y</video>", ["x"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds", ["so x=2 holds"]),
    ],
)
def test_blocks(page, expected):
    assert texts(page) == expected


def test_paths_names_and_links():
    (b, c) = blocks_of('<div class="Main ad-box" id=top><p><a href=x>all link</a></div><p hidden>h')
    assert b.path == [("div", ("main", "ad", "box", "top")), ("p", ())] and b.link_share == 1.0
    assert c.path == [("p", ("hidden",))]


def test_all_names_of_an_element_count():
    (post, side, gone) = blocks_of("<main><p id='post-123' class='post-123 post type-post status-publish format-standard hentry'>a</p><div class='flex mt grid px py gap text-sm font-bold rounded sidebar'>b</div><p class='a b c d e f g h i' style='display:none'>c</main>")
    assert post.path[-1][1] == ("post", "type", "status", "publish", "format", "standard", "hentry")
    assert X.marked(post) and not X.marked(side) and "sidebar" in side.path[-1][1] and gone.path[-1][1][-1] == "hidden"


def test_gradients_are_right():
    model, vectors = X.BlockLabeller(seed=3), X.Vectors()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    shown = [blocks_of("<nav><a>x</a></nav><article><p>one two<p>three</article>"), blocks_of("<div>solo</div>")]
    data, labels = [vectors.page(b) for b in shown], [np.array([0, 1, 1.0]), np.array([1.0])]
    _, g = model.gradients(data, labels)
    rng = np.random.default_rng(0)
    for key, grad in g.items():
        spots = np.argwhere(np.abs(grad) > 1e-5)
        for spot in spots[rng.permutation(len(spots))[:4]]:
            at, old = tuple(spot), model.p[key][tuple(spot)]
            model.p[key][at] = old + 1e-2
            up = model.gradients(data, labels)[0]
            model.p[key][at] = old - 1e-2
            down = model.gradients(data, labels)[0]
            model.p[key][at] = old
            assert abs((up - down) / 2e-2 - grad[at]) < 0.02 * abs(grad[at]) + 1e-4, key


def test_given_pages(pages, labeller):
    rows = X.extract(pages, labeller).collect()
    expected = {r.page_id: " ".join(b.text for b in blocks_of(r.html) if X.marked(b)) for r in pages.collect()}
    assert len(rows) == len(expected) and np.mean([r.text == expected[r.page_id] for r in rows]) > 0.98


def test_sample_holds_marked_pages_only(spark):
    rows = [(i, "u", f"<p>bare {i}</p><!-- <article> -->") for i in range(200)]
    rows += [(1000 + i, "u", f"<nav>menu</nav><article><p>{STORY[i]} {i}</article>") for i in range(3)]
    assert X.fit(spark.createDataFrame(rows, SCHEMA), sample_pages=3) is not None


FORMS = {
    "plain div": "<body><div id=header><a href=/>Home</a></div><div class=menu><ul><li><a href=a>News</a><li><a href=b>Sport</a></ul></div><div class=content>{}</div><div class=footer>Imprint and contact</div></body>",
    "main": "<body><header>Site</header><nav><a href=x>Start</a></nav><main>{}</main><aside><a href=q>Other story</a></aside><footer>&copy; 2020</footer></body>",
    "comments": "<body><article>{}</article><section class=comments><p>I do not agree with this.<p>Nice story, thank you.</section><footer>Contact</footer></body>",
    "notice and form": "<body><div class='cookie notice'>We use cookies on this site, please accept them.</div><div class='entry content'>{}</div><form class=subscribe><div>Enter your mail</div></form></body>",
}


@pytest.mark.parametrize("form", FORMS)
def test_other_page_forms(labeller, form):
    page = FORMS[form].format("".join(f"<p>{t}</p>" for t in STORY))
    got = X.main_texts([page], labeller, X.Vectors())[0]
    assert got == " ".join(STORY)


def test_edge_cases(spark, labeller):
    long = "<article>" + "".join(f"<p>word{i} of a long page.</p>" for i in range(5000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<article><p>Some text here.</p></article>"), (4, "u", long), (4, "u", long)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS text", "'y' AS path")
    got = X.extract(df, labeller).collect()
    assert len(got) == 5 and {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert sum(r.text.count("word") for r in got if r.page_id == 4) > 9900
    assert X.extract(df.limit(0), labeller).count() == 0
    bare = spark.createDataFrame([(1, "u", "<nav>menu</nav><p>text</p>")], SCHEMA)
    assert X.fit(bare) is None and X.extract(bare, None).first().text == "text"


@pytest.mark.parametrize("unit", ["x <y ", "<y \"a ", "</script ", "<a ' \" > ", "<!x ", "<object \"", "text </b> <i"])
def test_tags_that_never_end_take_linear_time(unit):
    import time

    page = "<article><p>start</p>" + unit * (5_000_000 // len(unit))
    started = time.perf_counter()
    blocks = blocks_of(page)
    assert time.perf_counter() - started < 20 and blocks[0].text == "start"


def test_tags_end_outside_of_quotes():
    page = """<p title="a > b">one</p><p data-x='"'>two</p> 1 < 2 <3 <b class="c">bold</b> <i "never <u>"""
    assert [b.text for b in blocks_of(page)] == ["one", "two", '1 < 2 <3 bold <i "never']
    assert [b.text for b in blocks_of("a <y b")] == ["a <y b"]
