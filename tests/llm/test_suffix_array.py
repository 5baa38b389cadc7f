import os

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from webloom.llm.suffix_array import common_prefixes, suffix_array


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(97 + x % 3 for x in b)), st.integers(1, 3))
def test_order_and_prefixes(text, times):
    text *= times
    places, words = suffix_array(np.frombuffer(text, np.uint8), 256)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert places.tolist() == want
    shared = [len(os.path.commonprefix([text[a:], text[b:]])) for a, b in zip(want, want[1:], strict=False)]
    assert common_prefixes(places, words, 256).tolist() == ([0, *shared] if want else [])
