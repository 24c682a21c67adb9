"""Candidates of any length, and span weights that do not depend on the size of the table."""

import time

import numpy as np
import pytest

from linewave.llm import pii


@pytest.mark.parametrize("n", [20, 128, 129, 400, 100_000])
def test_secrets_of_any_length_are_proposed(n):
    key = ("aB3dE5gH7jK9" * n)[:n]
    assert pii.proposals(f"token = '{key}'", []) == [("secret", 9, 9 + n)]
    assert pii.votes(f"token = '{key}'", "secret", 9, 9 + n, False)[-1] == str(min(9, n.bit_length()))
    assert pii.proposals(f"token = '{key[:19]}'", []) == []


def test_long_runs_without_a_digit_are_looked_at_once():
    began = time.perf_counter()
    assert not [s for s in pii.proposals("abcdefghij" * 50_000 + " " + "A" * 500_000, []) if s[0] == "secret"]
    assert time.perf_counter() - began < 10


def test_the_span_classifier_is_free_of_scale():
    patterns = [("secret", "-1-1--5"), ("secret", "-1-0--5"), ("secret", "-0-0--6"), ("email", "1-11--5"), ("email", "-0-00-5")]
    counts, post = np.asarray([900.0, 80, 20, 30, 2]), np.asarray([0.9, 0.4, 0.1, 0.99, 0.2])
    small, large = (pii.span_classifier(patterns, n * counts, post) for n in (1, 1000))
    assert np.allclose(small, large)
