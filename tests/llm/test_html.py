from shelfspark.llm import html


def text(page):
    p = html.Page(page)
    return p.text({p.pick()})


def test_blocks_and_markup():
    assert text("<html><body><nav>menu</nav><article><h1>T &amp; U</h1><p>a <b>b</b>\n c<br>d<p>e<ul><li>f<li>g</ul></article>"
                "<footer>x</footer></body></html>") == "T & U\n\na b c d\n\ne\n\nf\n\ng"
    assert text("plain text") == "plain text" and text("") == "" and text("<!-- open <p>a") == "" and text("<script>x") == ""
    assert text("<p>1 < 2 &lt;b&gt; &#233;&nbsp;z</p>") == "1 < 2 <b> é z"


def test_no_content_is_left_out():
    page = ("<body><header>h</header><div class='ad-box'>ad</div><div id='cookie-notice'>c</div><main><article><p>long text of it</p>"
            "<aside>s</aside><form>f</form><div class='share'>sh</div><style>p{}</style><p>more text of it</p>"
            "<section class='comments'><p>nice one</p></section></article></main><div class='sidebar'>sb</div></body>")
    assert text(page) == "long text of it\n\nmore text of it"
    assert text("<body class='has-sidebar'><div class='post'><p>kept text</p></div></body>") == "kept text"


def test_hosts_agree_on_a_path(spark, empty):
    def page(k, body):
        return (k, f"https://A.example.com:80/{k}", f"<body><div class='x{k}'>teaser {k} " + "t" * (400 if k == 3 else 5)
                + f"</div><div class='text c{k}'><p>{body}</p></div></body>")

    rows = [page(k, f"main text number {k}") if k == 3 else page(k, f"main text number {k} " + "w" * 300) for k in range(10)]
    rows += [(90, None, "<p>alone</p>"), (91, "http://b.example.com/", None), (92, "http://b.example.com/", "")]
    out = {r.page_id: r for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3].text == "main text number 3"  # its own pick would be the teaser
    assert out[5].text.startswith("main text number 5") and "teaser" not in out[5].text
    assert out[90].text == "alone" and out[91].text == out[92].text == "" and out[91].n_chars == 0
    assert all(r.n_chars == len(r.text) for r in out.values())
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract_pages(none).count() == 0


def test_title_and_lead_beside_a_nested_body_stay(spark):
    def article(k):
        return f"<article><h1>Title {k}</h1><p>lead {k}</p><div class='body'><p>{'w' * 300}</p></div></article>"

    whole = "lead\n\n" + "w" * 300
    assert text(article(1)) == "Title 1\n\nlead 1\n\n" + "w" * 300
    assert text(f"<body><div id=p><div class=post><p>lead</p><div class=in><p>{'w' * 300}</p></div></div></div></body>") == whole
    mixed = [f"<body><p>{k}</p>{article(k)}</body>" if k == 4 else f"<body><div class=top>t</div>{article(k)}</body>" for k in range(5)]
    rows = [(k, "http://c.example.com/", h) for k, h in enumerate(mixed)]
    out = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[k] == f"Title {k}\n\nlead {k}\n\n" + "w" * 300 for k in range(4))
    # Both a container and one inside it win; nothing of the outer one is lost, whatever the page's own pick.
    page = html.Page(f"<body><main><p>lead</p><section><p>{'w' * 300}</p></section></main></body>")
    assert page.extract(["/body/main", "/body/main/section"]) == whole
    page = html.Page(f"<body><p>beside</p><article><p>lead</p><section><p>{'w' * 300}</p></section></article></body>")
    assert page.extract(["/body/article/section"]) == whole


def test_class_words_of_a_wrapper_dont_drop_the_article():
    long = "w" * 300
    for wrapper in ("class='content right-sidebar'", "id='page' class='menu-open'", "class='social-article'", "class='widget' role='form'"):
        for inner in (f"<article><p>{long}</p></article>", f"<main><p>{long}</p></main>", f"<h1>h</h1><p>{long}</p>", f"<p>{long}</p>"):
            page = f"<body><div class='ad'>ad</div><div {wrapper}>{inner}<div class='share'>sh</div></div><div class='sidebar'>sb</div></body>"
            assert text(page).endswith(long) and "sb" not in text(page) and "sh" not in text(page) and "ad" not in text(page)
    assert text(f"<body><h1>T</h1><div class='social-box'><div class='widget'><article>{long}</article></div></div></body>").endswith(long)
    # Teasers, reader comments and the site's heading stay out.
    page = (f"<body><div class='masthead'><h1>Site</h1></div><article><p>{long}</p></article><div class='related'><article>teaser</article></div>"
            f"<div class='comments'><article class='comment'><p>{long * 3}</p></article></div></body>")
    assert text(page) == long
    assert text(f"<body><div class='ad'>{long}</div><article><p>short</p></article></body>") == "short"
