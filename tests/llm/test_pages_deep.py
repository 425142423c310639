"""Pages whose markup is unusual: deep nesting, references that tags cut, attributes of any value."""

import time

import numpy as np

from matchweave.llm import html_extract


def test_references_are_decoded_within_one_stretch_of_text():
    for source, want in (("a&<b>amp;</b>b", "a&amp;b"), ("<p>a&amp;b &lt;c&gt;</p>", "a&b <c>"), ("<p>x&am<!-- c -->p;y", "x&amp;y"), ("<p>caf&eacute;<i>&#33;</i>", "café!")):
        assert [t for _, t in html_extract.parse(source).blocks] == [want]


def test_deep_nesting_takes_time_in_proportion():
    width = html_extract._features([html_extract.parse("<p>x")])[0].shape[1]
    model = html_extract.Model(np.zeros(width), np.zeros((3, 2, 2)))
    begun = time.process_time()
    html_extract.texts_of(["<div>" * 50_000 + "x" + "</p></b></li>" * 50_000], model)
    assert time.process_time() - begun < 20  # 2 s on an idle machine; minutes when it grows with the square


def test_any_value_of_any_attribute():
    page = "<article data-label><p data-label='Price' matchweave-label='x' class='' id style>Text of the page, long enough.</p></article>"
    assert [t for _, t in html_extract.parse(page, labelled=False).blocks] == ["Text of the page, long enough."]
