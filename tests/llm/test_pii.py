import re

from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.llm.pii import KINDS, base_spans, candidates, examples, find, fit, luhn


def plain(text):
    """The base patterns as they are written down."""
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for kind, p, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ):
        out += [(kind, *m.span()) for m in re.finditer(p, text) if ok(m[0])]
    return out


PARTS = ["a", "b.c", "@", "@@", ".", "..", "-", " ", "+", "1", "255", "256", "0001", "4", "4111111111111111", "4111-1111 1111-1111", "(", ")", "é", "x@y.zz", "1.2.3.4", "+1 (555) 010-9999", "\n"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans_as_written(text):
    assert base_spans(text) == plain(text)


def test_base_spans_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "a.b-" * 90_000 + "@", "(" * 300_000):
        base_spans(text)
        candidates(text)


def test_model_on_held_out_examples():
    model, limits = fit()
    test = examples(1500, seed=99)
    found = find([t.encode() for t, _, _ in test], model, limits)
    hit = wrong = total = clean = 0
    for (text, place, kind), spans in zip(test, found):
        if kind:
            total += 1
            hit += any(s[1] < place[1] and s[2] > place[0] for s in spans)
        else:
            clean += 1
            wrong += any(not s[3] for s in spans)
    assert hit / total > 0.9 and wrong / clean < 0.03, (hit / total, wrong / clean)


def test_edges_and_additions():
    model, limits = fit()
    two = "4111111111111111 4012888888881881"  # one run of 32 digits: the base pattern drops it
    texts = [None, b"", b"plain words only", f"pay with {two} now".encode(), b'token = "1eb9c654e721b4f81208a1eb9c654e721b4f8120"', b"order 9807915762804490 shipped"]
    found = find(texts, model, limits)
    assert found[:3] == [[], [], []] and found[5] == []
    assert [(s[0], s[1], s[2]) for s in found[3]] == [("card", 9, 25), ("card", 26, 42)]
    assert [s[0] for s in found[4]] == ["secret"]
    assert set(KINDS) >= {s[0] for f in found for s in f}


def test_numbers_in_long_runs(monkeypatch):
    """Every group of a run of any length is proposed, and so found whole."""
    model, limits = fit()
    cards = ["4111111111111111", "4012888888881881", "5555555555554444"]
    phones = [f"555-123-45{k}" for k in range(67, 87)]
    for sep in (" ", "/", ". "):
        text = "cards " + sep.join(cards * 30)
        places = [("card", m.start(), m.end()) for m in re.finditer("[0-9]{16}", text)]
        assert len(places) == 90 and set(places) <= set(candidates(text))
    text = "call " + " ".join(phones)
    places = [("phone", m.start(), m.end()) for m in re.finditer("555-123-45[0-9]{2}", text)]
    assert len(places) == 20 and set(places) <= set(candidates(text))
    texts = [("pay with " + " ".join(cards) + " now").encode(), text.encode(), b"1 " * 200]
    found = find(texts, model, limits)
    assert [s[:3] for s in found[0]] == [("card", 9, 25), ("card", 26, 42), ("card", 43, 59)]
    assert all(_covered(s, found[1]) for s in places)
    monkeypatch.setattr("vecloom.llm.pii.JUDGED", 7)
    assert find(texts, model, limits) == found


def test_long_secrets():
    """Keys are found from end to end, however long; so are signed web tokens, parts and all."""
    import random

    rng = random.Random(3)
    of = lambda k: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=k))
    model, limits = fit()
    for key in (of(300), of(600), of(2000), of(6000), "eyJ" + of(33) + ".eyJ" + of(700) + "." + of(342), "x" * 100 + of(500)):
        for before in ("token=", "see ", 'secret = "'):
            text, at = f"{before}{key} end", (len(before), len(before) + len(key))
            assert ("secret", *at) in candidates(text), (before, len(key))
            if not key.startswith("x"):
                assert [s[:3] for s in find([text.encode()], model, limits)[0]] == [("secret", *at)], (before, len(key))
    for text in ("a" * 300_000, "eyJ" * 100_000, "eyJ." * 80_000, "token=" * 50_000, "key:" + "a1/" * 100_000):
        candidates(text)


def _covered(place, spans):
    """No digit of the place is outside the spans."""
    return all(any(a <= x < b for _, a, b, *_ in spans) for x in range(place[1], place[2]))
