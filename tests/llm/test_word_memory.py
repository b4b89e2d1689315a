"""The words that the packing remembers cost a batch nothing."""

import time

import public_tokenizers

from wardspan.llm import mixture_packing as M


def test_batches_do_not_go_through_all_remembered_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    M._encoder.cache_clear()
    first = M.encode(["one two, ł", ""], path)
    known = M._encoder(path)[2]
    known.update((f"#{i}", b"") for i in range(600_000))
    start = time.process_time()
    again = [M.encode(["one two, ł", ""], path) for _ in range(60)]
    took = time.process_time() - start
    M._encoder.cache_clear()
    assert all(x == first for x in again)
    assert took < 0.5
