"""Precision and recall of the spans that weak supervision adds, on planted ones."""

import random

import numpy as np
import pytest

from linewave.llm import pii
from tests.llm.fixtures import frame, prose

rng = random.Random(11)
_pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
DIGITS, ALNUM = "0123456789", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"


def _iban():
    number = _pick(DIGITS, 18)
    text = f"DE{98 - int(number + '131400') % 97:02d}{number}"
    return " ".join(text[i : i + 4] for i in range(0, len(text), 4))


def planted():
    """(text, {kind: wanted (start, end)}) cases: personal data in use, and what only looks like it."""
    good = {
        "secret": lambda: ("token = '", _pick(ALNUM, 28) + "7aQ", "' for the job"),
        "phone": lambda: (rng.choice(["call me at ", "phone: ", "tel. "]), f"({rng.randint(201, 989)}) {rng.randint(201, 989)}-{rng.randint(1000, 9999)}", " today"),
        "social": lambda: ("her ssn is ", f"{rng.randint(101, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", " as filed"),
        "email": lambda: ("write to ", f"{_pick('abcdefgh', 6)} [at] {_pick('klmnop', 5)} [dot] com", " soon"),
        "iban": lambda: ("to my account, iban ", _iban(), " please"),
        "person": lambda: ("signed by ", f"Dr. {rng.choice(['Anna', 'Peter', 'Maria'])} {_pick('abcdefgh', 6).title()}", " in town"),
    }
    bad = {
        "secret": lambda: ("commit ", _pick("0123456789abcdef", 40), " of the build"),
        "phone": lambda: ("invoice ", f"{rng.randint(10, 99)}-{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}", " is paid"),
        "social": lambda: ("section ", f"000-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", " of the order"),
        "email": lambda: ("see figure ", f"{_pick('abcdefgh', 4)} (at) {_pick('klmnop', 5)} (dot) {_pick('qxz', 5)}", " below"),
        "iban": lambda: ("order ", f"XK{_pick(DIGITS, 2)} {_pick(DIGITS, 4)} {_pick(DIGITS, 4)}", " was sent"),
        "person": lambda: ("the ", f"{_pick('ijklmn', 5).title()} {_pick('opqrst', 6).title()}", " was there"),
    }
    rows, truth, n = [], {}, 0
    for kind in good:
        for make, real in [(good[kind], True)] * 60 + [(bad[kind], False)] * 60:
            head, span, tail = make()
            before = prose(n, 20) + " " + head
            rows.append((n, before + span + tail + " " + prose(n + 5000, 20), "en", "s"))
            truth[n] = (kind, len(before), len(before) + len(span), real)
            n += 1
    return rows, truth


@pytest.fixture(scope="module")
def found(spark):
    rows, truth = planted()
    got = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in pii.find_personal_data(frame(spark, rows)).collect()}
    return got, truth


@pytest.mark.parametrize("kind", ["secret", "phone", "social", "email", "iban", "person"])
def test_added_spans_of_each_kind(found, kind):
    got, truth = found
    right = sum([kind, str(a), str(b)] in got[n] for n, (k, a, b, real) in truth.items() if k == kind and real)
    added = sum(s[0] == kind for n in truth for s in got[n])
    assert right >= 0.9 * 60 and right >= 0.9 * added, (right, added)


def test_features_by_hand():
    text = 'key: "ab12CD", (555) x\n0a1b'
    assert pii.features(text, 6, 12) == "qqm9"
    assert pii.features('a,' + text[15:20] + ';', 2, 7) == "ppy6" and pii.features(text, 15, 20) == "ssy6" and text[15:20] == "(555)"
    assert pii.features("0a1b", 0, 4) == "nnh9" and pii.features("12", 0, 2) == "nnd9" and pii.features("aaaaaaaaab", 0, 10) == "nnl2"
    assert pii.features("id: 99 x", 4, 6)[0] == "c" and pii.features("é99x", 1, 3)[:2] == "ww"


def test_features_can_turn_the_votes_down():
    """Two patterns with the same votes part where their features tell them apart."""
    sure, votes = "1-11--5", "-1-1--5"
    patterns = [("secret", sure + "qqm7"), ("secret", "-0-00-5" + "ssh4"), ("secret", votes + "qqm7"), ("secret", votes + "ssh4")]
    weights = pii.fit_spans(patterns, np.array([400.0, 400, 60, 60]))
    a, b = pii.span_scores(patterns[2:], weights)
    assert a > b + 0.02


def test_phones_keep_their_country():
    text = "+1 (826) 555-4081 10.0.0.1 0 999999"
    assert ("phone", 0, 17) in pii.proposals(text, pii.base_spans(text))


def test_names_are_a_parameter(spark):
    assert pii.votes("dear Zork Blim", "person", 5, 14, False)[2] == "0"
    assert pii.votes("dear Zork Blim", "person", 5, 14, False, frozenset(["Zork"]))[2] == "1"
    assert pii.find_personal_data(frame(spark, []), names=["Zork"]).count() == 0


def test_of_overlapping_proposals_the_longer_stays():
    text = "iban DE44 1234 5678 9012 3456 78 and 212-555-1234"
    assert pii.proposals(text, []) == [("phone", 37, 49), ("iban", 5, 32)]
