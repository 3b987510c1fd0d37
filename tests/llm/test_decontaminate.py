import random
import tracemalloc

import pytest

from vecloom.llm.decontaminate import Index, find, keep_clean, with_hits

PASSAGE = "A passage of the benchmark, long enough that no document has it by chance."


def brute(item: str, text: str) -> int:
    """Least edits that turn item into a part of text."""
    item, text = item.lower(), text.lower()
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text: str, n: int) -> str:
    for _ in range(n):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "x", text[i] + "y"]) + text[i + 1 :]
    return text


def test_same_as_brute_force():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices(["th", "er", "on", "an", "re"], k=rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(rng.randint(8, 40))) for k in range(12)]
    index = Index(items)
    texts = [None, "", " "]
    for _ in range(60):
        k, passage = rng.choice(items)
        n = rng.choice([0, 0, 1, 2, index.edits[k], index.edits[k] + 1, index.edits[k] + 6])
        texts.append(rng.choice(["", prose(30)]) + " " + edited(rng, passage, n).upper() + rng.choice(["", " " + prose(30)]))
    got = find(index, texts)
    n = 0
    for t, hits in zip(texts, got):
        for k, (ident, _) in enumerate(items):
            least = brute(items[k][1], t or "")
            mine = [h for h in hits if h[0] == ident]
            assert bool(mine) == (least <= index.edits[k]), (ident, least, mine)
            if mine:
                n += 1
                assert min(h[3] for h in mine) == least
                _, s, e, cost = min(mine, key=lambda h: h[3])
                assert brute(items[k][1], t[s:e]) == cost
    assert n > 20


def test_edges():
    index = Index([(1, ""), (2, None), (3, " \n"), (4, "Tiny"), (5, "A passage of some more words than the others")])
    assert find(index, [None, "", "so tiny", "nothing"]) == [[]] * 4
    twice = "a passage of some more words than\nthe others. " * 2
    assert [h[:2] for h in find(index, [twice])[0]] == [(5, 0), (5, 46)]
    assert find(Index([]), ["x"]) == [[]]


def test_long_text_in_parts(monkeypatch):
    import vecloom.llm.decontaminate as d

    monkeypatch.setattr(d, "PART", 100)
    passage = "the quick brown fox jumps over the lazy dog again and again"
    text = "lorem ipsum dolor " * 20 + passage + " sit amet" * 30
    assert [h[3] for h in find(Index([(9, passage)]), [text])[0]] == [0]


def test_short_passages_are_whole_words_and_answers_are_none():
    index = Index([(1, "yes"), (2, "the capital of"), (3, "(c) 12,345 items sold"), (4, "42")])
    assert len(index.items) == 2
    assert find(index, ["yesterday yes 42", "The capital of France", "the capital offence", "x(C) 12,345 items sold.", "(c) 12,345 items soldiers"]) == [[], [(2, 0, 14, 0)], [], [(3, 1, 22, 0)], []]
    with pytest.raises(ValueError):
        Index([], least=3)


def test_short_answers_keep_documents(spark):
    docs = spark.createDataFrame([(1, "yes, that is so, said the old man by the sea"), (2, PASSAGE + " and more")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "yes"), (2, "said the old man"), (3, PASSAGE)], "item_id bigint, text string")
    assert [r["doc_id"] for r in keep_clean(docs, bench).collect()] == [1]
    assert {(r["doc_id"], h["item_id"]) for r in with_hits(docs, bench).collect() for h in r["hits"]} == {(1, 2), (2, 3)}


def test_many_short_passages_in_bounded_memory():
    """30,000 passages of some 35 characters with many common words, and a text of one part and more: under 500 MB."""
    rng = random.Random(4)
    words = ["of the", "in the", "and", "that", "which", *("".join(rng.choices("abcdefgh", k=5)) for _ in range(400))]
    items = [(k, " ".join(rng.choice(words) for _ in range(7))[:36]) for k in range(30_000)]
    text = " ".join(rng.choice(words) for _ in range(60_000)) + " " + items[77][1] + " end"
    index = Index(items)
    tracemalloc.start()
    hits = find(index, [text])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert any(h[0] == 77 and h[3] == 0 for h in hits) and most < 500e6, most


def test_halved_parts_find_the_same(monkeypatch):
    import vecloom.llm.decontaminate as d

    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choices(["th", "er", "on"], k=rng.randint(1, 3))) for _ in range(n))
    items = [(k, prose(rng.randint(6, 30))) for k in range(40)]
    texts = [prose(200) + edited(rng, rng.choice(items)[1], rng.choice([0, 1, 2])) + prose(300) for _ in range(12)]
    index = Index(items)
    want = find(index, texts)
    monkeypatch.setattr(d, "MOST_HITS", 500)
    assert find(index, texts) == want and sum(map(len, want)) > 8


def test_places_do_not_depend_on_rows_aligned_at_once(monkeypatch):
    """A long passage many times: aligned a few places at a time."""
    from vecloom.llm import decontaminate

    item = "".join(random.Random(4).choices("abcdefgh ", k=3000))
    texts = [f"{i} lorem {item[:1500]}{'x' * (i % 3)}{item[1500:]} ipsum" for i in range(12)]
    index = decontaminate.Index([(5, item)])
    want = decontaminate.find(index, texts)
    assert [len(w) for w in want] == [1] * 12 and [w[0][3] for w in want] == [i % 3 for i in range(12)]
    monkeypatch.setattr(decontaminate, "ALIGNED", 5000)
    assert decontaminate.find(index, texts) == want
