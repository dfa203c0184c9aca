"""Pages keep their article, whatever names are around it and whatever its language."""

from strideway.llm.html_extract import extract_pages, main_text


def test_names_with_other_parts_drop_nothing():
    body = "It was the best of times and it was the worst of times, and all of it was in the book that he had."
    for name in ("layout has-sidebar", "no-sidebar", "post no-comments", "market-share"):
        assert main_text(f'<body><div class="{name}"><article><p>{body}</p></article></div></body>') == body
        assert main_text(f'<body><div class="{name}"><p>{body}</p></div></body>') == body
    assert main_text(f'<body><div class="sidebar"><main><p>{body}</p></main></div></body>') == body
    assert main_text(f'<body><article><p>{body}</p><div class="comments"><article><p>{body} No.</p></article></div></article></body>') == body
    assert main_text(f'<body><div hidden class="sidebar"><article><p>{body}</p></article></div><p>{body} Yes.</p></body>') == body + " Yes."
    for name in ("sidebar", "nav-menu", "social_share", "ad"):
        assert main_text(f'<body><p>{body}</p><div class="{name}"><p>{body} No.</p></div></body>') == body


def test_pages_in_languages_without_a_list_keep_their_text():
    body = " ".join(["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw."] * 4)
    assert main_text(f"<body><nav><a href=1>Start</a></nav><div><p>{body}</p></div><footer>Kontakt</footer></body>") == body


BODY = "It was the best of times and it was the worst of times, and all of it was in the book that he had."


def test_the_word_hidden_hides_only_as_an_attribute():
    page = "<body><div {}><article><p>{}</p></article></div></body>"
    for mark in ('class="overflow-hidden"', 'class="flex lg:hidden"', 'title="hidden gems of the city"', "data-hidden='hidden'", 'hidden="until-found"', 'style="overflow: hidden"'):
        assert main_text(page.format(mark, BODY)) == BODY, mark
    for mark in ("hidden", 'class="x" hidden=""', 'style="display : none"', "aria-hidden=true"):
        assert main_text(page.format(mark, BODY)) == "", mark


def test_svg_without_a_body_takes_nothing_with_it():
    assert main_text(f'<article><p>{BODY}</p><svg class="icon" /><p>{BODY} Two.</p><svg><text>no</text></svg><p>{BODY} Three.</p></article>') == f"{BODY}\n{BODY} Two.\n{BODY} Three."
    assert main_text(f"<article><p>{BODY} <svg viewBox='0 0 1 1'/> More of it.</p></article>").replace("\n", " ") == f"{BODY} More of it."


def test_teasers_in_articles_are_not_the_text():
    rest = f"<div><p>{BODY}</p><p>{BODY} Two.</p><p>{BODY} Three.</p></div>"
    for teaser in ("<article><h3>Read on</h3><p>A short teaser.</p></article>", f"<article><p>{BODY} Teaser.</p></article>"):
        for page in (rest + teaser, teaser + rest):
            assert main_text(f"<body>{page}</body>") == f"{BODY}\n{BODY} Two.\n{BODY} Three."


def test_comments_go_by_the_first_part_of_their_name():
    for name in ('id="comments-list"', 'id="comments" class="comments-area"', 'class="comment even"', 'class="comment-body-7"', 'id="disqus_thread"'):
        for inner in (f"<p>{BODY} No.</p>", f'<article class="comment-body"><p>{BODY} No.</p></article>'):
            assert main_text(f"<body><article><p>{BODY}</p><div {name}>{inner}</div></article></body>") == BODY, name
            assert main_text(f"<body><article><p>{BODY}</p></article><ol {name}><li>{inner}</li></ol></body>") == BODY, name
    for name in ("comments-open", "comments-closed", "no-comments", "commentary"):
        assert main_text(f'<body><div class="{name}"><article class="{name}"><p>{BODY}</p></article></div></body>') == BODY, name


def test_long_repeated_and_no_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    long = "<article>" + "".join(f"<div><p>{BODY} {i}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "a", f"<p>{BODY}</p>", "clash", 1), (1, "a", f"<p>{BODY}</p>", "clash", 1), (2, None, None, None, None), (None, "b", "", "", 0), (3, "c", long, "", 0)]
    found = sorted(map(tuple, extract_pages(spark.createDataFrame(rows, schema)).collect()), key=str)
    expected = "\n".join(f"{BODY} {i}" for i in range(20_000))
    assert found == sorted([(1, "a", BODY, len(BODY))] * 2 + [(2, None, "", 0), (None, "b", "", 0), (3, "c", expected, len(expected))], key=str)
    assert extract_pages(spark.createDataFrame([], schema)).count() == 0
