import pytest
from memlake.llm import site_tree


@pytest.mark.parametrize("html, text", [
    ('<article><h1>T</h1><div class="article-body ad-free"><p>Paragraph.</p></div></article>', "T\nParagraph."),
    ('<div class="wrapper has-sidebar menu-open"><article><p>Text</p></article></div>', "Text"),
    ('<body class="comments-open"><main><p>M</p></main><div class="site-footer">f</div></body>', "M"),
    ('<div class="menu"><article><p>Only</p><div class="comments"><p>no</p></div></article></div>', "Only"),
    ('<div class="social"><div role="main"><p>Only</p></div><p>like us</p></div>', "Only"),
    ('<article><p>A</p></article><div id="comments"><article class="comment-body"><p>c</p></article></div>', "A"),
    ('<div id="comments"><article><p>c</p></article></div><article><p>A</p></article>', "A"),
    ('<nav><article><p>no</p></article></nav><p>yes</p>', "yes"),
    ('<div class="ad">x</div><div class="ad-slot-2">y</div><div class="page_share">z</div><p>yes</p>', "yes"),
    ('<div class="leadership-menu-board"><p>kept</p></div>', "kept"),
])
def test_names(html, text):
    assert site_tree.main_text(html) == text


def test_name_parts():
    assert site_tree.noise_name("post comments") and site_tree.noise_name("site-footer") and site_tree.noise_name("cookie_banner")
    assert not site_tree.noise_name("no-comments") and not site_tree.noise_name("adapter") and not site_tree.noise_name("")
