"""The stemmer on the published algorithm's own examples."""

from __future__ import annotations

import pytest

from weftline.functions.stems import holds_phrase, stem

EXAMPLES = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll"}


@pytest.mark.parametrize("word", sorted(EXAMPLES))
def test_stem(word):
    assert stem(word) == EXAMPLES[word]


def test_phrase():
    assert holds_phrase("They were adopting relational models", "adopted relation model")
    assert not holds_phrase("models adopted", "adopted model") and not holds_phrase("x", "")
