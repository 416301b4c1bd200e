"""Blocks of pages with embedded elements: closed, self-closed, unclosed, and custom ones."""

import pytest

from quarryloom.llm import html_text as H


@pytest.mark.parametrize("page, texts", [
    ('<p>A <svg width="1"/> b.</p><p>c</p>', ["A b.", "c"]),
    ('<p>A <svg title="x>y"><text>no</text></svg> b.</p><p>c</p>', ["A b.", "c"]),
    ("<p>a</p><svg><p>b</p><svg><text>no</text></svg><p>c</p>", ["a", "b", "c"]),
    ("<p>a</p><video src=x><p>b</p><p>c</p>", ["a", "b", "c"]),
    ("<p>a</p><video>Get a player</video><p>b</p>", ["a", "Get a player", "b"]),
    ("<object-view><p>a</p></object-view><svg-icon></svg-icon><video-js>b</video-js><p>c</p>", ["a", "b", "c"]),
    ("<p>Let <math><mi>x</mi></math> be <i>y</i>.</p>", ["Let x be y."]),
    ("<noscript><p>a</p></noscript><iframe>b</iframe><p>c</p>", ["a", "b", "c"]),
    ("<template><p>no</p></template><p>a</p><template><p>b</p>", ["a", "b"]),
    ('<script src="x"/>no</script foo><p>a</p><style>no', ["a"]),
])
def test_only_scripts_styles_and_graphics_are_dropped(page, texts):
    assert [b.text for b in H.blocks(page)] == texts
