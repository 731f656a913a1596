"""What a worker holds at once."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import public_tokenizers

from lodewatch.llm import piece_sampling
from lodewatch.llm.pieces import piece_model

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_new_runs_of_a_chunk_are_summed_in_parts_of_bounded_memory():
    r = random.Random(3)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(3, 12))) for _ in range(60_000)]
    texts = [" ".join(words[i : i + 600]) for i in range(0, len(words), 600)]
    s = piece_sampling.Sampler(piece_model(MODEL), 0.3)
    tracemalloc.start()
    ids, ends = s.sample(texts, np.arange(len(texts), dtype=np.uint64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Tables of 1.1 million edges take 17 MB; with the arrays they are made from, 39 MB here, and 114 MB when all runs were summed at once.
    assert peak < 70 << 20
    alone = piece_sampling.Sampler(piece_model(MODEL), 0.3)
    for i in (0, 57, 99):
        one, _ = alone.sample(texts[i : i + 1], np.array([i], np.uint64))
        assert (one == ids[ends[i] : ends[i + 1]]).all()
