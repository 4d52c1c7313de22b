from quartzite.llm.html_text import blocks, chosen, extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="has-sidebar"><header><a href="/">Home</a> Site name.</header><nav><ul><li>Menu, one.<li>Menu two</ul></nav>
<div class="cookie-notice">We use cookies, a lot of them. Really, we do, you know.</div><aside>Side, long and with. Punctuation, many, commas.</aside>
<main><article><h1>Title &lt;here&gt;</h1><p>First   paragraph, with <b>bold</b>&nbsp;text.<br>And more. <p>Second &eacute;, unclosed.
<div class="ad-banner"><p>Buy, buy, buy! Now, today.</p></div><ul><li>Item one<li>Item two, longer.</ul><form><p>Your name, please.</p></form></article>
<section id="comments"><p>Reader: nice, very nice article. I liked it, a lot, truly.</p></section></main><footer>&copy; 2024, all rights.</footer></body></html>"""


def test_article_only_and_whole():
    assert main_text(PAGE) == "Title <here>\nFirst paragraph, with bold text. And more.\nSecond é, unclosed.\nItem one\nItem two, longer."


def test_pages_without_article_element():
    page = "<body><div id=menu><a>One</a><a>Two</a></div><div id=content><h2>Head</h2>" + "".join(f"<p>Sentence {k}, with commas, and a stop. Another one here.</p>" for k in range(8)) + "</div><div class='footer'>Imprint, terms.</div></body>"
    assert main_text(page).split("\n")[0] == "Head" and main_text(page).count("Sentence") == 8 and "Imprint" not in main_text(page)


def test_broken_and_empty_pages():
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<!-- only") == ""
    assert main_text("just text & more") == "just text & more"
    assert main_text("<p>a < b and \"c' <i>d</i") .startswith("a < b")
    assert main_text("<article><p>x" + " y" * 200_000).count("y") == 200_000
    assert main_text('<article><p title="a>b">ok</p></article>') == "ok"
    assert chosen([], [-1]) == []


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (2, None, "", 5)], "page_id long, url string, html string, n_chars int")
    rows = sorted(extract(df).collect(), key=lambda r: (r.page_id, r.text))
    assert [(r.page_id, r.n_chars) for r in rows] == [(1, len(main_text(PAGE))), (2, 0), (2, 0)]
    assert extract(df.limit(0)).count() == 0


def test_no_content_is_lost_beside_a_large_block():
    long = "Long text, with commas, and stops. " * 60
    assert main_text(f"<body><h1>T</h1><div>{long}</div><p>second, short</p></body>").split("\n") == ["T", long.strip(), "second, short"]
    paragraphs = "".join(f"<p>Sentence {k}, with commas, and a stop. Another one here.</p>" for k in range(40))
    small = "<article><h2>Small</h2><p>A sentence, with commas, and a stop. One more here.</p></article>"
    text = main_text(f"<body><article><h2>Large</h2>{paragraphs}</article>{small}<div class=ad>Buy, now.</div></body>")
    assert text.count("Sentence") == 40 and "Small\nA sentence" in text and "Buy" not in text
    outside = "".join(f"<p>Outside {k}, with commas, and a stop. Another one here.</p>" for k in range(40))
    text = main_text(f"<body><article>{paragraphs}</article><div id=more><h3>More</h3>{outside}</div><ul><li>x</ul></body>")
    assert text.count("Sentence") == 40 and text.count("Outside") == 40 and "More" in text


def plain_article(tree):
    """The method in plain loops over a tree of (name, class, factor, [children or texts]); texts are (letters, links)."""
    found = []

    def walk(node, line, factor):
        name, cls, own, children = node
        line, factor = [*line, (name, cls, min(factor, own))], min(factor, own)
        for c in children:
            if isinstance(c, str):
                found.append((tuple(line), id(node), node, c, factor))
            else:
                walk(c, line, factor)
                above[id(c)] = id(node)

    above = {}
    walk(tree, [], 1.0)
    if not found:
        return []
    ratios = []
    for _, _, _, text, _ in found:
        marks = sum(text.count(c) for c in ".,;")
        ratios.append((len(text) / (len(text) + 60), marks / (marks + 1)))
    smooth = []
    for k, (_, me, *_) in enumerate(found):
        parent = above.get(me)
        sides = [ratios[j] if 0 <= j < len(found) and above.get(found[j][1]) == parent else ratios[k] for j in (k - 1, k + 1)]
        smooth.append([0.25 * sides[0][r] + 0.5 * ratios[k][r] + 0.25 * sides[1][r] for r in range(2)])
    paths = {f[0] for f in found}
    average = lambda xs: sum(xs) / len(xs)
    own, factor = {}, {}
    for p in paths:
        mine = [k for k, f in enumerate(found) if f[0] == p]
        factor[p] = found[mine[0]][4]
        own[p] = average([smooth[k][0] for k in mine]) * (0.5 + 0.5 * average([smooth[k][1] for k in mine])) * factor[p]

    def around(p):
        if not p:
            return 0
        direct = [own[f[0]] for f in found if f[0] == p or f[0][:-1] == p]
        return max(average(direct) if direct else 0, 0.6 * around(p[:-1]))

    weight = {p: own[p] + 0.6 * around(p[:-1]) * factor[p] for p in paths}
    total = sum(weight[f[0]] * len(f[3]) for f in found)
    least = 0.25 * sum(weight[f[0]] ** 2 * len(f[3]) for f in found) / max(total, 1e-12)
    return [f[3] for f in found if weight[f[0]] > 1e-9 and weight[f[0]] >= least]


def test_against_the_method_in_plain_loops():
    import random

    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice(["ab", "cde", "fghi", "j.", "kl,"]) for _ in range(n))
    classes = [("", 1.0), ("text", 1.0), ("ad", 0.02), ("share-price", 0.5), ("x", 1.0), ("comment list", 0.02)]

    def made(depth):
        name, (cls, factor) = rng.choice(["div", "section", "div", "blockquote"]), rng.choice(classes)
        children = []
        for _ in range(rng.randint(1, 5)):
            children.append(made(depth - 1) if depth and rng.random() < 0.5 else ("p", "", 1.0, [words(rng.choice([1, 3, 10, 60]))]))
        return name, cls, factor, children

    def shown(node):
        name, cls, _, children = node
        return f"<{name}" + f' class="{cls}"' * bool(cls) + ">" + "".join(c if isinstance(c, str) else shown(c) for c in children) + f"</{name}>"

    sizes = set()
    for _ in range(300):
        tree = ("body", "", 1.0, [made(3) for _ in range(rng.randint(1, 4))])
        page = shown(tree)
        expected = plain_article(tree)
        assert main_text(page) == "\n".join(expected), page
        sizes.add(len(expected) * 10 // len(blocks(page)[0]))
    assert len(sizes) > 5  # all, few and many blocks were chosen


def test_marks_are_one_feature_and_links_another():
    page = '<article><h1>T</h1><p class="share-price">The share price rose, again, by three. It fell later.</p><p id="alert-level">The alert level is high, now. So it was, then.</p><div class="related-work"><p>Related work, by others, is this. And that.</p></div><div class="ad"><p>Buy, buy. Now, and here.</p></div><p>Plain, as ever. It goes on, and on.</p></article>'
    assert [x.split()[0] for x in main_text(page).split("\n")] == ["T", "The", "The", "Related", "Plain,"]
    page = "<main><h1>T</h1><p>A sentence, with marks. And one more of them, here.</p><h3>Top stories</h3><ul><li><a href=x>One</a></li><li><a>Two words</a></li></ul><h3>Weather</h3><ul><li><a>Sun</a></ul></main>"
    assert main_text(page) == "T\nA sentence, with marks. And one more of them, here."
    assert main_text('<body><div class="entry form"><h1>T</h1><p>Sentence, a. Sentence, b, and more of it.</p></div></body>').startswith("T\nSentence")


def test_deep_nesting_takes_time_in_proportion():
    import time

    for page in ("<div>" * 50_000 + "x" + "</p>" * 50_000, "<article>" + "<div>text, here." * 50_000, "<ul><li>" * 25_000):
        began = time.time()
        main_text(page)
        assert time.time() - began < 20


def article(inside):
    long = "".join(f"<p>Sentence {k}, with commas, and a stop. Another one follows here, and it is long enough to count.</p>" for k in range(6))
    text = main_text(f"<body><nav><a href=x>Menu</a></nav><article>{long}{inside}</article><div class=ad>Buy, now.</div></body>").split("\n")
    assert all(t.startswith("Sentence") for t in text[:6]) and "Buy, now." not in text
    return text[6:]


def test_everything_of_an_article_is_kept():
    assert article("<table><tr><td>Year</td><td>12</td></tr></table>") == ["Year", "12"]
    assert article("<dl><dt>Term</dt><dd>Def</dd></dl>") == ["Term", "Def"]
    assert article("<figure><img src=x><figcaption>A caption</figcaption></figure>") == ["A caption"]
    assert article("<header><h1>HEADLINE</h1><time>May 2</time></header><p>End.</p>") == ["HEADLINE", "May 2", "End."]
    assert article("".join(f'<div class="q"><p>Q{k}?</p></div>' for k in range(5))) == [f"Q{k}?" for k in range(5)]
    assert article("<h2>Poem</h2>" + "".join(f'<p class="l{k}">line {k}' for k in range(8)) + "<p>" + "A note, long and with commas. " * 20)[:9] == ["Poem", *(f"line {k}" for k in range(8))]
    assert article('<p class="share">The share of the vote, as counted, was a third. It had been less.</p>') == ["The share of the vote, as counted, was a third. It had been less."]
    assert article("<h2>Sources</h2><ul><li><a href=a>One</a><li><a href=b>Two</a></ul>") == ["Sources", "One", "Two"]


def test_what_is_not_the_articles_goes_from_within_it():
    for inside in ('<div class="ad"><p>Buy, buy. Now, and here.</p></div>', "<form><p>Your name, please.</p></form>", "<nav><ul><li><a>x</a></ul></nav>", "<aside>Side, long and with. Punctuation, many, commas.</aside>", "<footer>Imprint.</footer>", '<section id="comments"><h3>Comments</h3><p>Reader: nice, very nice. I liked it, a lot.</p></section>', '<div class="share"><p>Tell friends, now.</p></div>', "<script>x</script><style>y</style><!-- z -->"):
        assert article(inside) == [], inside


def test_quotes_that_never_close_take_time_in_proportion():
    import time

    for page in ('<a "' * 80_000, '<a "' * 80_000 + ">", "<a '\"" * 80_000 + "x", "<p>a" + "<" * 300_000, "<script " * 50_000):
        began = time.time()
        main_text(page)
        assert time.time() - began < 1
    assert main_text("<p>text<script>if (a > b) x") == "text" and main_text("<p>text <!-- a > b") == "text" and main_text("<p>a<!-- b -->c <!-- d") == "ac"
