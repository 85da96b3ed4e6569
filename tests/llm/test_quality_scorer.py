from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from loomline.llm import quality


def test_scores_are_those_of_the_features_and_known_grams_are_not_hashed_again(monkeypatch):
    values = np.random.default_rng(3).normal(size=quality.BUCKETS).astype(np.float32)
    texts = ["", " \n", "a", "Ünï 12 İß \U0001f600 ab c", "AB-12 ab ab ab x", "x1y2 " * 40 + "ZZ"]
    score = quality.Model(values, 0.1).scorer()
    for text in texts:
        words = Counter(text.split())
        own = [(b, k) for w, k in words.items() for b in quality.features(w)] + quality.document_features(words)
        z = sum(k * float(values[b]) for b, k in own) / sum(k for _, k in own) + 0.1
        assert score(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    calls, plain = [], quality.xxhash.xxh32_intdigest
    monkeypatch.setattr(quality, "xxhash", SimpleNamespace(xxh32_intdigest=lambda *a, **k: calls.append(a) or plain(*a, **k)))
    fresh = ["".join("ab"[n >> k & 1] for k in range(12)) for n in range(1 << 12)]
    score(" ".join(fresh))
    assert len(calls) < 1.1 * len(fresh)
