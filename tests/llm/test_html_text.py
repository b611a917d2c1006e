import time

import pytest

from vspark.llm import html_text as H

ARTICLE = "<h1>Title here</h1><p>One two&nbsp;&amp; three.<p>Four <b>five</b> six.<ul><li>seven eight</li></ul>"
TEXT = "Title here\nOne two & three.\nFour five six.\nseven eight"


@pytest.mark.parametrize("around", H.BOILERPLATE)
def test_boilerplate_is_left_out(around):
    noise = around.replace("b", "zz")
    for page in (f"<body>{around}<article>{ARTICLE}</article>{around}</body>", f"<div id='content'>{ARTICLE}{around}<p>Nine ten eleven twelve.</p></div>"):
        text = H.main_text(page)
        assert text == TEXT + ("\nNine ten eleven twelve." if "Nine" in page else "")
    assert noise


def test_markup_scripts_and_references():
    page = "<html><head><title>no</title><style>p{}</style><script>if(a<b){'</p>'}</script></head><body><!-- no <p>x --><article><p title='a>b'>A &lt;b&gt;\n\t c<br>d &#233; &copy</p><script>x</script><p hidden>no</p></article></body>"
    assert H.main_text(page) == "A <b> c d é ©"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("   ", ""), ("just text of a page that has no markup at all", "just text of a page that has no markup at all"), ("<p>open", "open"), ("<script>var x", ""), ("<!-- open", ""), ("<nav><a>b</a></nav>", "")])
def test_odd_pages(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("attributes", ["class='overflow-hidden'", 'aria-hidden="false"', "title='the hidden valley'", "data-x=hidden", "style='--display:none'", "style='display:none;display:block'", "data-hidden", "title='display:none'"])
def test_words_that_hide_nothing(attributes):
    assert H.main_text(f"<body {attributes}><article>{ARTICLE}</article></body>") == TEXT
    assert H.main_text(f"<article><p>One two <a href='/hidden-gems' {attributes}>three</a> four.</p></article>") == "One two three four."


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN", "hidden=''", "class=x hidden", "aria-hidden=true", "aria-hidden = 'True'", "style='color:red; Display : none'", 'style="display:none!important;display:block"', "class='a'hidden"])
def test_hidden_elements(attributes):
    assert H.main_text(f"<article>{ARTICLE}<p {attributes}>not to be seen</p></article>") == TEXT


@pytest.mark.parametrize(
    ("within", "text"),
    [("<svg class=icon />", ""), ("<svg><path d='M0'/><title>no</title><text>no</text></svg>", ""), ("<svg><title/><path></svg>", ""), ("<svg><foreignObject><p>no</p></foreignObject></svg>", ""), ("<svg><path d='M0'>", ""), ("<svg><style>no", ""), ("<svg><svg><path/></svg>no</svg>", ""),
     ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold", "Let x=2 hold\n"), ("<math/>", ""), ("<math><mi>x</mi>", "x\n"), ("<math><semantics><mi>x</mi><annotation>no</annotation></semantics></math>", "x\n"), ("<xmp>if a <b> &amp; c</xmp>", "if a <b> &amp; c\n"), ("<xmp hidden>no</xmp>", ""), ("<video src=x/>", ""), ("<object>", "")],
)
def test_drawings_formulas_and_raw_text(within, text):
    page = f"<article><p>First words here.</p>{within}<p>Last words here.</p></article>"
    assert H.main_text(page) == f"First words here.\n{text}Last words here."
    assert H.main_text(page + "<svg><path/></svg>") == H.main_text(page)


def test_xmp_left_open():
    assert H.main_text("<article><p>First words here.</p><xmp>a <b> c") == "First words here.\na <b> c"


@pytest.mark.parametrize("depth", [1, 200])
def test_marks_count_at_any_depth(depth):
    around = "".join(f"<div class='u{chr(97 + k % 26)}{chr(97 + k // 26)}x qz{chr(97 + k // 26)}{chr(97 + k % 26)}'>" for k in range(depth))
    noise = "<nav><a>b b</a></nav><aside><p>b b b b b b</p></aside><form><label>b b b</label></form><ul class='comment-list'><li>b b b b b b b</li></ul>"
    assert H.main_text(f"<body>{around}{noise}<article>{ARTICLE}</article>{noise}") == TEXT
    assert H.main_text(f"<body>{around}<article>{ARTICLE}{noise}<p>Nine ten eleven twelve.</p></article>") == TEXT + "\nNine ten eleven twelve."


def test_time_is_linear_in_marks():
    page = "".join(f"<div class='m{k:x}'>x" for k in range(20_000))
    began = time.time()
    H.main_text(page)
    assert time.time() - began < 20


def test_best_region_against_all_stretches():
    import random

    rng = random.Random(0)
    for _ in range(300):
        s = [rng.choice([-2.0, -0.5, 0.0, 1.0, 3.0]) for _ in range(rng.randint(0, 12))]
        a, b = H.region(s)
        best = max([sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)], default=0.0)
        assert sum(s[a:b]) == best


def test_time_is_linear():
    for page in ("<div>" * 100_000 + "x", "<b>" * 50_000 + "x" + "</i>" * 50_000, "<p>word " * 50_000, "<a href='" + "x" * 300_000, "<" * 200_000, "&" * 200_000):
        began = time.time()
        H.main_text(page)
        assert time.time() - began < 20


def test_time_is_linear_in_drawings():
    for page in ("<video>" * 100_000, "<svg>" * 100_000 + "<p>x", "<svg><foreignObject>" + "<div>" * 100_000, "<svg><title>" * 50_000, "<svg><p>" * 50_000):
        began = time.time()
        H.main_text(page)
        assert time.time() - began < 20


def test_table(spark):
    df = spark.createDataFrame([(1, "u", f"<article>{ARTICLE}</article>", "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in H.extract_text(df).collect()) == [(1, TEXT, len(TEXT)), (2, "", 0), (2, "", 0)]
    assert H.extract_text(df.filter("false")).collect() == []


def all_stretches(scores):
    """region() by trying every stretch whose beginnings all gain: the largest sum, then the first start, then the longest."""
    gains = lambda i, j: all(sum(scores[i:k]) > 0 for k in range(i + 1, j))
    sums = [(sum(scores[i:j]), -i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1) if gains(i, j)]
    best = max([s for s in sums if s[0] > 0], default=None)
    return (-best[1], best[2]) if best else (0, 0)


def test_pages_against_all_stretches():
    import random

    rng = random.Random(3)
    pieces = ["<p>one two three four", "<a>x</a>", "<div class=q1>", "</div>", "<ul><li><a>y z</a></ul>", "<article>", "</article>", "<span>s</span>", "<h1>title</h1>", "<nav>n n</nav>", "<div class='ad'>b b</div>", "text alone ", "<table><tr><td>cell<td>cell</table>", "<br>"]
    texts = set()
    for _ in range(400):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        # Sums of scores that are multiples of 1/64 are exact in any order.
        exact = lambda scores: [round(s * 64) / 64 for s in scores]
        got = H.main_text(page, find=lambda s: H.region(exact(s)))
        slow = H.main_text(page, find=lambda s: all_stretches(exact(s)))
        assert got == slow, page
        texts.add(got)
    assert len(texts) > 50


LINKS = "<div class='q1'><a>zz</a><a>zz yy</a><span>zz</span><a>zz</a></div>"
LIST = "<ul class='q4'><li><a>zz yy</a></li><li><a>zz</a></li><li><a>zz</a></li></ul>"


@pytest.mark.parametrize("around", [LINKS, LIST, LINKS + LIST, "<div><span>zz</span><label>zz</label></div>", "<table><tr><td><a>zz</a><td><a>zz</a></table>" + LINKS])
@pytest.mark.parametrize("body", ["<div class='q2'><p>One two three four five six.<p>Seven eight nine ten.</div>", "<p>One two three four five six.</p><p>Seven eight nine ten.</p>", "<article><p>One two three four five six.<p>Seven eight nine ten.</article>"])
def test_the_scan_decides_where_no_mark_does(around, body):
    page = f"<body class='has-sidebar'>{around}{body}{around}</body>"
    assert H.main_text(page) == "One two three four five six.\nSeven eight nine ten."
    assert "zz" in H.main_text(page, find=lambda scores: (0, len(scores)))


@pytest.mark.parametrize("wrapper", ["<div class='legal-article'>{}</div>", "<div class='page-top'><div class='legal-article'>{}</div></div>", "<div class='no-sidebar menu-closed'>{}</div>", "<form id='aspnet'>{}</form>", "<div id='banner-page'><article>{}</article></div>"])
def test_wrappers_are_no_boilerplate(wrapper):
    noise = "<nav><a>b b</a></nav><div class='comments'><p>b b b b</p></div>"
    assert H.main_text(f"<body>{wrapper.format(noise + ARTICLE + noise)}<footer>b b</footer>") == TEXT


def test_short_ends_of_an_article_stay():
    end = "<table><tr><td>a<td>b<tr><td>c<td>d</table><ul><li><a>e</a><li><a>f</a></ul>"
    assert H.main_text(f"<article>{ARTICLE}<div class='ad'>b b b b b</div>{end}</article>{LINKS}") == TEXT + "\na\nb\nc\nd\ne\nf"
    assert H.main_text(f"<p>One two three four five.</p><div class='ad'>{'b ' * 60}</div><p>Six seven eight nine ten eleven.</p>") == "One two three four five.\nSix seven eight nine ten eleven."


@pytest.mark.parametrize(("page", "text"), [("<p>a < b and c <d is text</p>", "a < b and c <d is text"), ("<p>if x <y then", "if x <y then"), ("<p>a <b and more</p><p>end of it", "a <b and more\nend of it"), ("<p class='x' <b>one two three</p>", "one two three"), ("<p title=it's>Don't stop here</p>", "Don't stop here"), ("<foo>one two</foo> three", "one two three"), ("<p>one two<!-- no > no", "one two"), ("<p>one two</p ><!-- no", "one two")])
def test_signs_that_are_no_tags(page, text):
    assert H.main_text(page).split("\n") == text.split("\n") or H.main_text(page).replace("\n", " ") == text


def test_time_is_linear_in_broken_tags():
    for page in ("<d " * 100_000, "<d " * 100_000 + ">", "</ " * 100_000, "<! " * 100_000, "<a x='" * 100_000 + ">", "<d ='\"" * 50_000 + ">", "<!-- " * 100_000):
        began = time.time()
        H.main_text(page)
        assert time.time() - began < 20
