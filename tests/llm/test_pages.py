"""Ordinary pages that the tables do not have: no footer, short last paragraphs, blog class names, paragraphs of links."""

import pytest

from tracelake.llm import extract


def words(n: int, name: str = "w") -> str:
    return " ".join(f"{name}{k}" for k in range(n))


A, B, C = words(60, "a"), words(60, "b"), words(21, "c")
LINK, HEAD = f'<a href="/l">{words(20, "l")}</a>', f'<p><a href="/x">{words(9, "z")}</a></p><p><a href="/y">{words(12, "y")}</a></p>'
PAGES = {
    "no_footer_short_last_paragraph": (f"<article><p>{A}</p><p>{B}</p><p>{C}</p></article>", [A, B, C]),
    "one_short_paragraph": (f"<article><p>{words(25)}</p></article>", [words(25)]),
    "title_and_one_line": (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{words(5)}</p></article>", ["Title", words(5)]),
    "article_class_names": (f'<article class="post tags-news comment-open"><p>{A}</p><p>{C}</p></article><div class="sidebar"><p>{B}</p></div>', [A, C]),
    "link_heavy_paragraph": (f"<article><p>{A}</p><p>{LINK} end of it</p><p>{B}</p></article><footer>c {words(8)}</footer>", [A, words(20, "l") + " end of it", B]),
    "has_sidebar_wrapper": (f'<div class="wrap has-sidebar"><div class="content"><p>{A}</p><p>{C}</p></div><div class="sidebar">{words(30)}</div></div>', [A, C]),
    "main_in_sidebar_layout": (f'<div class="layout sidebar"><main><p>{A}</p><p>{C}</p></main><div class="sidebar">{words(30)}</div></div>', [A, C]),
    "divisions_only": (f'<div class="menu"><a href=1>A</a> <a href=2>B</a></div><div class="content"><h2>Head</h2><p>{A}</p><p>short one.</p></div><div class="footer">foot</div>', ["Head", A, "short one."]),
    "nothing_but_paragraphs": (f"<p>{A}</p><p>{B}</p>", [A, B]),
    "notice_inside_the_article": (f'<article><p>{A}</p><div class="cookie-notice">{words(32)}</div><p>{C}</p></article>', [A, C]),
    "related_headlines": (f'<article><p>{A}</p><p>{B}</p></article><div class="related">{HEAD}</div>', [A, B]),
    "comments_with_content_names": (f'<article class="post"><p>{A}</p><p>{C}</p></article><div id="comments"><div class="comment"><div class="comment-content"><p>{B}</p></div></div></div>', [A, C]),
    "blog": (
        f'<header class="site-header"><a href=/>Site</a></header><div id="page"><div class="content-area"><main id="main"><article id="post-5" class="post-5 post category-news tag-ads"><header class="entry-header"><h1 class="entry-title">T one</h1></header>'
        f'<div class="entry-content"><p>{A}</p><ul><li>x</li><li>{words(4)}</li></ul><p>{C}</p></div><footer class="entry-footer">Posted in <a href=n>News</a></footer></article><div id="comments"><p>{B}</p></div></main></div><aside class="widget-area"><p>{C}</p></aside></div><footer>c 2020</footer>',
        ["T one", A, "x", words(4), C],
    ),
}


@pytest.fixture(scope="module")
def tree():
    return extract.grow(*extract.labelled_table())


@pytest.mark.parametrize("body", ["<body>", '<body class="post-1 single has-sidebar comments-open">', '<html class="no-js ad-free"><body id="blog">'])
@pytest.mark.parametrize("name", PAGES)
def test_page(tree, name, body):
    page, want = PAGES[name]
    assert extract.main_text(f"{body}{page}</body>", tree).split("\n") == want


def test_a_page_over_one_chunk(spark, tree):
    page = "<article>" + f"<p>{A}</p>" * 12_000 + "</article>"
    row = extract.extract_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert row["text"] == "\n".join([A] * 12_000) and row["n_chars"] == len(row["text"])
