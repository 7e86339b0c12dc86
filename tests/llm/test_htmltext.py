from __future__ import annotations

import re
from itertools import combinations

from tokenloom.llm.htmltext import FURNITURE, PLAIN, SUSPECT, TEXT, Votes, common_lines, extract_text, page_lines, path_distance
from tokenloom.llm.q_htmltext import op7_htmltext


def test_longest_common_subsequence():
    def longest(a, b):
        for n in range(len(a), -1, -1):
            for s in combinations(a, n):
                it = iter(b)
                if all(x in it for x in s):
                    return n

    for a, b in (("abcbdab", "bdcaba"), ("", "a"), ("aaa", "aa"), ("abc", "xyz"), ("xaybz", "aqbxz"), ("abcabba", "cbabac")):
        got = common_lines(list(a), list(b))
        assert got == sorted(set(got)) and len(got) == longest(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)


def kept(html):
    return [x for m, x in page_lines(html) if m != FURNITURE]


def test_markup():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>A<li>B</ul></nav>
    <!-- <p>no</p> --><div class="ad">Buy</div><div id='cookie-notice'>We use</div><main><h1>Head&amp;line</h1><p>One&nbsp; <b>two</b><br>three<p>a &lt; b &#233;
    <script>if (a < b) "</p>";</script><form><input>Name</form><aside>Related</aside><div class="comments"><p>Nice!</div><p>last</main><footer>&copy;</footer></body>"""
    assert kept(page) == ["Head&line", "One two three", "a < b é", "last"]
    assert [x for m, x in page_lines(page) if m == FURNITURE] == ["Site", "A", "B", "Buy", "We use", "Name", "Related", "Nice!", "©"]
    assert page_lines("") == []
    assert page_lines("plain & text") == [(PLAIN, "plain & text")]
    assert kept("<p title='a>b'>x</p><p hidden>y</p><p style='display: none'>z</p><p title=\"unclosed>w")[0] == "x"
    assert kept("<div class='heading'>kept</div><div class=load>kept too</div>") == ["kept", "kept too"]
    assert page_lines("<div class='content-sidebar-wrap'><p>text</p></div>") == [(SUSPECT, "text")]
    assert kept("<form><nav>a</nav><main><p>the page is one form</main></form>") == ["the page is one form"]
    assert kept("<p>one <span hidden>no</span>line <a class=share>Share</a>of it</p>") == ["one line of it"]


def test_words_in_classes_do_not_decide_inside_an_article():
    page = """<article><p>first</p><div class="related-work"><p>Related work</p></div><section id="search"><p>On search</p></section><p class="md:flex hidden lg:block">shown</p>
    <p>sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math></p><object><p>fallback</p></object><video>no player</video></article>"""
    assert kept(page) == ["first", "Related work", "On search", "shown", "sum x+y", "fallback"]


def test_differencing_deletes_what_neighbours_share(spark):
    frame = "<div>Top menu</div><div>Home</div>{}<div>Contact us</div>"
    body = lambda i: "".join(f"<p>Paragraph {i} {j} of its own text</p>" for j in range(3))
    rows = [(i, f"http://h.org/news/{i}?q=1", frame.format(body(i))) for i in range(4)]
    rows += [(10, "http://h.org/news/1", frame.format(body(1)))]  # a copy of page 1 is no neighbour to learn from
    rows += [(11, "http://alone.org/", frame.format(body(11))), (12, None, "<p>a</p>"), (13, "http://h.org/x", None), (None, "not a url", "<article>x<p>y</article>z"), (14, "http://h.org/empty", "")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    own = lambda i: "\n\n".join(f"Paragraph {i} {j} of its own text" for j in range(3))
    for i in (0, 2, 3):
        assert got[i] == own(i)
    assert own(1) in got[1] and own(1) in got[10]
    assert got[11].startswith("Top menu") and got[12] == "a" and got[13] == got[14] == "" and got[None] == "x\n\ny"
    assert extract_text(pages.where("false")).count() == 0


def test_hot_host_is_split(spark):
    rows = [(i, f"http://h.org/p/{i:04d}", f"<div>Menu</div><p>text number {i} with words</p>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(pages, block=7).collect()}
    assert all(got[i] == f"text number {i} with words" for i in range(60))


def test_neighbours_do_not_depend_on_the_size_of_the_host(spark):
    """Directories with menus of their own, in any number of blocks; also a run of copies that is longer than a block."""
    page = lambda d, i: f"<div>Menu of {d}</div><p>text number {d * 100 + i} with words</p>"
    rows = [(d * 100 + i, f"http://h.org/d{d:02d}/{i:02d}", page(d, i)) for d in range(20) for i in range(3)]
    long = "<div>Top menu of it</div><p>" + "one and the same long article " * 9 + "</p>"
    rows += [(5000 + i, f"http://h.org/x/{i:03d}", long) for i in range(60)] + [(6000, "http://h.org/x/999", "<div>Top menu of it</div><p>quite another short text here</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    small, whole = ({r.page_id: r.text for r in extract_text(pages, block=b).collect()} for b in (7, 2000))
    assert small == whole and len(small) == len(rows)
    assert all(small[d * 100 + i] == f"text number {d * 100 + i} with words" for d in range(20) for i in range(3))


def text_of(lines, neighbours, mark=PLAIN):
    votes = Votes([(mark, x) for x in lines])
    for n in neighbours:
        if votes.neighbours < 8:
            votes.add([(mark, x) for x in n])
    return votes.result()[0].split("\n\n")


def test_copies_do_not_blank_each_other():
    assert text_of(["a" * 50, "b"], [["a" * 50, "c"], ["b", "x"]]) == ["a" * 50]


def test_rotating_menus_take_two_further_neighbours():
    page, other = ["menu one", "text of this page"], [["menu two", "text of another"], ["menu one", "text of a third page"], ["menu two", "yet more text"], ["menu one", "the fifth text"]]
    assert text_of(page, other) == ["text of this page"]
    assert text_of(page, other[:2]) == page
    assert text_of(page, other[:2], SUSPECT) == ["text of this page"]


def test_lines_of_articles_go_only_if_all_neighbours_share_them():
    page = ["subscribe to our letter now", "a passage that two share", "own text of this article, long enough that a shared passage is less than half of it"]
    others = [["subscribe to our letter now", f"article number {i} is about other things"] for i in range(4)]
    others[2].insert(1, "a passage that two share")
    assert text_of(page, others, TEXT) == page[1:]
    assert text_of(page, others[:3], TEXT) == page
    assert text_of(page, [*others[:3], ["a passage that two share", "else, quite else, and longer too"]], TEXT) == page


def brute(pages, neighbours=8):
    """Text of every page, each compared with all pages of its host in the order of distance."""
    out = []
    keyed = []
    for i, url, html in pages:
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)", url or "")
        keyed.append((m and m[1].lower(), m and m[2], url, i, page_lines(html or "")))
    keyed.sort(key=lambda r: (r[0] is None, *(r[:4] if r[0] is not None else ())))
    for at, (host, path, url, i, lines) in enumerate(keyed):
        votes, n = Votes(lines), len(keyed)
        alike = lambda j: 0 <= j < n and keyed[j][0] == host and keyed[j][4] == lines
        low, high = at, at
        while alike(low - 1):
            low -= 1
        while alike(high + 1):
            high += 1
        if host is not None and votes.size:
            left = [j for j in range(low - 1, -1, -1) if keyed[j][0] == host]
            right = [j for j in range(high + 1, n) if keyed[j][0] == host]
            while (left or right) and votes.neighbours < neighbours:
                side = min((x for x in (left, right) if x), key=lambda x: path_distance(keyed[low if x is left else high][1], keyed[x[0]][1]))
                votes.add(keyed[side.pop(0)][4])
        out.append((i, url, votes.result()[0]))
    return sorted(out, key=repr)


def test_query_against_brute_force(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = op7_htmltext(spark, sf_dir).collect()
    assert sorted(((r.page_id, r.url, r.text) for r in got), key=repr) == brute(pages)
    assert all(r.n_chars == len(r.text) for r in got) and sum(r.n_shared > 0 for r in got) > 0


def test_blocks_do_not_matter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    whole, small = (sorted(map(tuple, extract_text(pages, block=b).collect()), key=repr) for b in (2000, 9))
    assert whole == small


def test_short_articles_among_much_furniture(spark):
    menu = [f"An entry number {i} of the long menu of the site" for i in range(12)]
    texts = ["rain is due on the coast tonight", "seven goals fell in one match", "prices of bread rose again slightly"]
    assert text_of([*menu, texts[0]], [[*menu, texts[1]]]) == [texts[0]]
    article = "the council met on monday to talk about the new bridge over the river and its cost"
    assert text_of([*menu, article], [[*menu, article.replace("monday", "tuesday")], menu]) == [*menu, article]  # an edit, and a trace
    rows = [(i, f"http://h.org/{i}", "".join(f"<div>{x}</div>" for x in [*menu, t])) for i, t in enumerate(texts)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == texts


def test_equal_pages_have_equal_texts(spark):
    """Three copies and a repeated row between pages that share different lines with them."""
    text = "one and the same long article that stands on several pages of this host"
    copy = f"<div>Left menu</div><p>{text}</p><div>Right menu</div>"
    rows = [(0, "http://h.org/a/0", "<div>Left menu</div><p>some other text on the left</p>"), (9, "http://h.org/a/9", "<p>some other text on the right</p><div>Right menu</div>")]
    rows += [(i, f"http://h.org/a/{i}", copy) for i in (3, 4, 4, 5)]
    got = [r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect() if r.page_id in (3, 4, 5)]
    assert len(got) == 4 and set(got) == {f"{text}\n\nRight menu"}
