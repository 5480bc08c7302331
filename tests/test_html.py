from pyspark.sql import functions as F

from playbill.functions import html

BASE = "https://ex.com/dir/page?z=1#t"
# Link, and the absolute address a browser makes of it (None: not a web address).
RESOLVED = [
    ("/a", "https://ex.com/a"), ("b?x", "https://ex.com/dir/b?x"), ("?q=1", "https://ex.com/dir/page?q=1"),
    ("#f", "https://ex.com/dir/page?z=1#f"), ("//H.com/z", "https://h.com/z"), ("../c", "https://ex.com/c"),
    ("mailto:a@b", None), ("javascript:x", None), ("tel:1", None), ("HTTP://EX.com:80/p", "http://ex.com/p"),
    ("a b", "https://ex.com/dir/a%20b"), ("./x", "https://ex.com/dir/x"), ("/a/../b/./c", "https://ex.com/b/c"),
    ("..", "https://ex.com/"), ("/a/..", "https://ex.com/"), ("/a/.", "https://ex.com/a/"), ("../../../q", "https://ex.com/q"),
    ("/für,", "https://ex.com/f%C3%BCr,"), ("/x?q=é&a='b", "https://ex.com/x?q=%C3%A9&a=%27b"),
    ("https://ex.com", "https://ex.com/"), ("https://ex.com?x", "https://ex.com/?x"),
    ("https://user:p@ex.com:443/z", "https://user:p@ex.com/z"), ("  /sp  ", "https://ex.com/sp"),
    ("/a\nb", "https://ex.com/ab"), ("/a|b", "https://ex.com/a|b"), ("/a[1]", "https://ex.com/a[1]"),
    ('/"q"', "https://ex.com/%22q%22"), ("/a\\b", "https://ex.com/a/b"), ("/a//b/../c", "https://ex.com/a//c"),
    ("https://ex.com:8080/p", "https://ex.com:8080/p"), ("/x#é `", "https://ex.com/x#%C3%A9%20%60"),
]


def test_resolve(apply):
    got = apply(lambda c: html.resolve_url(c, F.lit(BASE)), [h for h, _ in RESOLVED])
    assert got == [want for _, want in RESOLVED]


def test_links(apply):
    page = """<a href="/a">1</a><A class='x' HREF='/b'>2</A><a data-href="/no" href=/c>3</a><a href="/a">again</a>
      <!-- <a href="/comment">x</a> --><script>"<a href='/script'>"</script><style><a href="/style"></style>
      <a href="">empty</a><a name="x">none</a><a href="https://EX.com/d?x=1&amp;y=2">4</a><a href="https://www.ex.com/e">other</a>
      <a href="mailto:a@ex.com">m</a><area href="/area"><a title="a>b" href="/f">5</a><a
      href = "/g#top">6</a>"""
    got = apply(lambda c: html.page_links(c, F.lit("https://ex.com/x")), [page, "<p>none</p>"])
    assert got == [[f"https://ex.com{p}" for p in ("/a", "/b", "/c", "/d?x=1&y=2", "/f", "/g#top")], []]


def test_link_host_ignores_port_and_scheme(apply):
    got = apply(lambda c: html.page_links(c, F.lit("http://Ex.com:81/x")), ['<a href="https://ex.com/s">s</a><a href="/r">r</a>'])
    assert got == [["https://ex.com/s", "http://ex.com:81/r"]]


def test_many_attributes_and_long_pages(apply):
    wide = "<a " + " ".join(f'd{i}="{i}"' for i in range(150)) + ' href="/w">x</a>'
    deep = "<div>" * 50_000 + '<a href="/' + "s/" * 5000 + '">x</a>' + " " * 100_000
    got = apply(lambda c: html.page_links(c, F.lit("https://e.gr/")), [wide, deep])
    assert got == [["https://e.gr/w"], ["https://e.gr/" + "s/" * 5000]]
    assert apply(html.strip_html, [deep]) == ["x"]


def test_links_cost_the_length_of_the_page(apply):
    """Any number of attributes, and tags that never close: each character is read once or twice."""
    wide = "<a " + " ".join(f'd{i}="{i}"' for i in range(20_000)) + ' href="/w">x</a>'
    open_tags = '<a b="1" c ' * 40_000 + '<p><a href="/late">'
    nested = '<a x <a href="/b">1</a><a href=>2</a><a hrefs="/no" data-href=/no>3</a><a/href="/c">4</a><a x=y/href=/no>5</a><a\thref=\'/d\'>'
    got = apply(lambda c: html.page_links(c, F.lit("https://e.gr/")), [wide, open_tags, nested])
    assert got == [["https://e.gr/w"], ["https://e.gr/late"], ["https://e.gr/b", "https://e.gr/c", "https://e.gr/d"]]


def test_text(apply):
    page = "<p>One <a class='c' href='u'><b>two</b></a></p>\n<script>var t=\"</p>\";</script><style>p{}</style> three &middot;"
    assert apply(html.text_with_links, [page]) == ["One two (u) three &middot;"]
    assert apply(html.strip_html, [page]) == ["One two three &middot;"]


def test_main_content(apply):
    pages = ["<body><nav>n</nav><article><p>a</p></article><footer>f</footer></body>",
             "<body><nav>n</nav><main id=m>b</main></body>",
             "<body><header>h</header><nav class=x>n</nav><p>c</p><aside>s</aside><footer>f</footer></body>",
             "<body><nav>n</nav></body>", "", "<article>one</article><nav>n</nav><article class=x>two</article> <article> </article>",
             "<main>m1</main><p>between</p><main>m2</main>"]
    assert apply(html.page_text, pages) == ["a", "b", "c", None, None, "one two", "m1 m2"]


def test_nested_main_parts(apply):
    late = "C | 2026-03-04 " + "c" * 1200
    pages = [f"<nav>n</nav><article>A<article class=card>B</article>{late}</article><footer>f</footer>",
             "<main>A<main>B</main>C</main><p>out</p>",
             "<article>1<article>2<ARTICLE>3</ARTICLE >4</article>5<article>6</article>7</article>x<article>8</article>y",
             "<!-- <article> -->x<article>A</article>y", "<article-list><article>A</article>x</article-list>y",
             "</article>x<article>A</article>y", "<article>A</article>x<article>B", "<body><nav>n</nav><article>A</body>",
             "<article>" + "<article>a</article>b" * 2000 + "</article>c"]
    assert apply(html.page_text, pages) == [
        f"A B {late}", "A B C", "1 2 3 4 5 6 7 8", "A", "A", "A", "A B", "A", "a b" + " a b" * 1999]
    assert apply(html.main_content, pages[1:3]) == [
        "A<main>B</main>C", "1<article>2<ARTICLE>3</ARTICLE >4</article>5<article>6</article>7 8"]
    code = "A<!-- </article> -->B<script>'</article>'</script><style></article></style>C"
    assert apply(html.main_content, [f"<article>{code}</article>D"]) == [code]


def test_choose_content(spark):
    long, raw = "x" * 1000, "<p>raw</p>"
    rows = [("short", raw), ("short", None), ("short", ""), (long, raw), (None, raw), ("😀" * 500, raw)]
    frame = spark.createDataFrame(rows, "text string, raw string")
    got = [r.c for r in frame.select(html.choose_content(F.col("text"), F.col("raw")).alias("c")).collect()]
    assert got == ["raw", "short", "short", long, "raw", "😀" * 500]
    assert [len(r.c) for r in frame.select(html.prompt_content(F.col("text"), F.col("raw"), 900).alias("c")).collect()] == [
        3, 5, 5, 900, 3, 450]


def test_hostname(apply):
    assert apply(html.hostname, ["https://U:p@EX.com:81/x", "mailto:a@b", "http://a.b", "x"]) == ["ex.com", "", "a.b", ""]


def test_plain_paths_resolve_like_all_others(spark):
    """A path without dots takes a shorter way; with a base that is not in its plain form it does not."""
    paths = ["/", "/a", "/a/b%20c", "/a[1]|x", "/a~b!$&'()*+,;=:@"]
    for base, origin in (("https://ex.com/d?x", "https://ex.com"), ("https://EX.com:443/d", "https://ex.com"),
                         ("http://u:p@ex.com/d", "http://u:p@ex.com"), ("http://ex.com:8080/d", "http://ex.com:8080")):
        frame = spark.createDataFrame([(p,) for p in paths], "v string")
        got = [r.o for r in frame.select(html.resolve_url(F.col("v"), F.lit(base)).alias("o")).collect()]
        assert got == [origin + p for p in paths]
