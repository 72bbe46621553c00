"""Elements without text for readers take only their own text away."""

import pytest

from catalens.llm import html

TREE = html.train_tree(*html.labelled_blocks())
LONG = "which runs on for a good number of words, as the sentences of an article do, and has few links or none at all"
STORY = f"<article><p>Story {LONG}</p><p>Ending {LONG}</p></article>"


def texts(page):
    return [b[0] for b in html.blocks(page)]


WANT = texts(STORY)


@pytest.mark.parametrize(
    "before",
    [
        "<html><head><title>T</title><meta charset=utf-8><body>",
        "<html><head><title>T</title><script>var a = '<p>no</p>'</script>",
        "<svg width='1' height='1'/>",
        "<object data='x' />",
        "<iframe src='x'/>",
        "<div><button>Menu</div>",
        "<button>Menu",
        "<select><option>A<option>B",
        "<svg-icon name=a></svg-icon>",
        "<button-group></button-group>",
        "<p><svg><path d='x'/></p>",
        "<button>One<button>Two</button>",
        "<svg><svg><text>no</text></svg><text>no</text></svg>",
        "<button><div>no</div></button>",
        "<script>no</script >",
    ],
)
def test_text_after_a_skipped_element_stays(before):
    assert texts(before + STORY) == WANT
    assert html.main_text(before + STORY, TREE) == " ".join(WANT)


def test_text_beside_an_unclosed_element_in_an_inline_parent_stays():
    assert texts("<p>One <span><svg><path d='x'></path></span> two</p>") == ["One two"]


def test_text_in_custom_elements_stays():
    assert texts("<svg-icon>Word</svg-icon> and <button-group>more</button-group>") == ["Word and more"]


def test_raw_text_is_swallowed():
    assert texts("a <script>if (a < b) '<p>'</script> b <style>p > q {}</style> c <textarea><p>x</p></textarea> d") == ["a b c d"]
