import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselade.llm import overlap as O
from tesselade.llm.overlap import cut, image_key, overlap_pairs, overlaps
from tesselade.llm.overlap_text import chunks, differing, edits, sentences, views, word_counts

WORDS = [f"w{i}" for i in range(400)]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=30))
@settings(max_examples=200, deadline=None)
def test_edits(a, b):
    assert edits(a, b) == plain_edits(a, b)


@given(st.lists(st.sampled_from(WORDS[:30]), min_size=1, max_size=60), st.data())
@settings(max_examples=300, deadline=None)
def test_an_edit_destroys_two_chunks_at_most(said, data):
    at = data.draw(st.integers(0, len(said) - 1))
    kind = data.draw(st.sampled_from(["change", "drop", "add"]))
    other = said[:at] + {"change": ["zz"], "drop": [], "add": ["zz", said[at]]}[kind] + said[at + 1 :]
    mine, theirs = Counter(d for d, _, _ in chunks(said)), Counter(d for d, _, _ in chunks(other))
    assert sum((mine - theirs).values()) <= 2


@given(st.lists(st.lists(st.sampled_from(WORDS[:30]), min_size=1, max_size=9), min_size=1, max_size=9))
@settings(max_examples=300, deadline=None)
def test_views(said):
    within, whole = views(said)
    assert Counter(within) == Counter(d for s in said for d, _, _ in chunks(s))
    assert Counter(whole) == Counter(d for d, _, _ in chunks([w for s in said for w in s]))


def test_word_counts_bound():
    rng = random.Random(2)
    for _ in range(50):
        a = [rng.choice(WORDS) for _ in range(80)]
        b = list(a)
        for i in rng.sample(range(80), 8):
            b[i] = rng.choice(WORDS)
        del b[3]
        assert sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(word_counts(a, 2), word_counts(b, 2))) <= 2 * 8 + 1


def test_order_numbers_and_marks_do_not_count():
    a = "1. **Light**: One two three four.\n2. **Edge**: Five six seven eight."
    b = "1) EDGE: five six, seven eight.\n2) light — one two three four!"
    assert differing(sentences(a), sentences(b), 1) == 0


def text(rng, n=80):
    return " ".join(rng.choice(WORDS) + ("." if i % 10 == 9 else "") for i in range(n))


def near(rng, base, n):
    said = base.split()
    for i in rng.sample(range(len(said)), n):
        said[i] = "z" + said[i]
    return " ".join(said)


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = {}
    for i in range(60):
        texts[i] = text(rng)
        texts[100 + i] = near(rng, texts[i], rng.choice([0, 2, 5, 8, 14, 20]))
        parts = texts[i].rstrip(".").split(". ")
        texts[200 + i] = ". ".join(rng.sample(parts, len(parts))) + "."
    rows = [(k, f"./dataset/{k}.png", t, "clash") for k, t in texts.items()] + [(5, "./dataset/5.png", texts[5], "again")]
    rows += [(300, "images/a.png", None, ""), (301, ".\\images\\a.png", "short", ""), (302, None, "", ""), (303, None, None, ""), (None, "images/a.png", texts[0], "")]
    split = {k: "train" if rng.random() < 0.6 else "eval" for k in texts} | {300: "train", 301: "holdout", 302: "train", 303: "eval"}
    lines = [*split.items(), (7, "train"), (7, "eval"), (7, "eval"), (999, "eval")]
    role = {}
    for k, s in lines:
        role.setdefault(k, set()).add(s)
    known = spark.createDataFrame(rows, "row_id bigint, image string, body string, class string")
    splits = spark.createDataFrame(lines, "row_id bigint, split string")
    found = {(r.train_row, r.eval_row) for r in overlaps(known, splits, "row_id", "image", "body").collect()}
    said = {k: sentences(t) for k, t in texts.items()}
    want = {(7, 7), (300, 301)}
    for a in texts:
        for b in texts:
            limit = int(0.1 * max(sum(map(len, said[a])), sum(map(len, said[b]))))
            if "train" in role[a] and role[b] & {"eval", "holdout"} and differing(said[a], said[b], limit) <= limit:
                want.add((a, b))
    assert found == want and len(want) > 30


def test_copies_and_empty(spark):
    same = text(random.Random(4))
    rows = spark.createDataFrame([(i, None, same) for i in range(30)], "row_id bigint, image string, body string")
    splits = spark.createDataFrame([(i, "train" if i < 20 else "eval") for i in range(30)], "row_id bigint, split string")
    assert overlaps(rows, splits, "row_id", "image", "body").count() == 200
    assert overlaps(rows.limit(0), splits, "row_id", "image", "body").count() == 0
    assert overlaps(rows, splits.limit(0), "row_id", "image", "body").count() == 0


def test_image_key(spark):
    df = spark.createDataFrame([("./dataset/a\\b.png",), ("images/a/b.png",), ("dataset/images/c",), ("./x",), (None,)], "p string")
    assert [r[0] for r in df.select(image_key(df.p)).collect()] == ["a/b.png", "a/b.png", "images/c", "x", None]


def edited(rng, said, places, kinds):
    """``said`` with the words at ``places`` (counted through) changed, dropped or preceded by another."""
    out, at = [], 0
    for s in said:
        new = []
        for w in s:
            kind = rng.choice(kinds) if at in places else "keep"
            new += {"keep": [w], "change": [f"z{rng.getrandbits(40)}"], "drop": [], "add": [f"z{rng.getrandbits(40)}", w]}[kind]
            at += 1
        if new:
            out.append(new)
    return out


def test_no_placing_of_edits_and_no_order_loses_a_candidate():
    rng = random.Random(5)
    for words in (60, 90, 180, 300, 600, 1200, 2000):
        for trial in range(8):
            longest = (1, 8, 20, 40)[trial % 4]
            said, left = [], words
            while left:
                n = min(left, rng.randint((longest + 1) // 2, longest))
                said.append([rng.choice(WORDS) for _ in range(n)])
                left -= n
            most = words // 10
            start = rng.randrange(10)
            places = [rng.sample(range(words), most), range(start, words, 10), range(start, start + most), [i + d for i in range(1, words - 19, 20) for d in (0, 3)]]
            for place in places:
                for kinds in (["change"], ["drop"], ["add"], ["change", "drop", "add"]):
                    other = edited(rng, said, set(place[:most]), kinds)
                    for order in (other, rng.sample(other, len(other)), [[w for s in other for w in s]]):
                        (mine, wanted), (theirs, other_wanted) = cut(said), cut(order)
                        shared = [sum(min(n[v], theirs[d][v]) for d, n in mine.items() if d in theirs) for v in range(3)]
                        used = [v for v in range(3) if wanted[v] and other_wanted[v]]
                        assert any(shared[v] >= max(wanted[v], other_wanted[v]) for v in used)


def test_few_chunks_fall_back_on_words():
    said = [["a"] * 30 + ["b"] * 40]
    found, wanted = cut(said)
    assert wanted == [1, 1, 70 - 7] and sum(n[2] for n in found.values()) == 70


@pytest.mark.parametrize("words", [60, 200, 600, 1200, 4000])
def test_edits_inside_the_longest_chunks(spark, words):
    """A tenth of the words replaced where the cuts lie farthest apart."""
    rng = random.Random(words)
    rows = []
    for i in range(10):
        said = [rng.choice(WORDS) for _ in range(words)]
        starts = sorted((start for _, start, _ in chunks(said)))
        gaps = sorted(zip(starts, [*starts[1:], words]), key=lambda g: g[0] - g[1])
        places = {at for start, end in gaps for at in range(start + 1, end)}
        other = list(said)
        for at in [p for start, end in gaps for p in range(start + 1, end) if p in places][: words // 10]:
            other[at] = f"z{rng.getrandbits(40)}"
        rows += [(i, None, " ".join(said)), (100 + i, None, " ".join(other))]
    known = spark.createDataFrame(rows, "row_id bigint, image string, body string")
    splits = spark.createDataFrame([(k, "train" if k < 100 else "eval") for k, _, _ in rows], "row_id bigint, split string")
    found = overlap_pairs(known, splits, "row_id", "image", "body").collect()
    assert {(r.train_row, r.eval_row) for r in found} == {(i, 100 + i) for i in range(10)}
    assert all(0 < r.train_overlap < 1 and 0 < r.eval_overlap < 1 for r in found)


def test_popular_copies(spark, monkeypatch):
    monkeypatch.setattr(O, "COPIES", 3)
    monkeypatch.setattr(O, "HOT_CLASSES", 2)
    rng = random.Random(8)
    base = text(rng, 100)
    rows = [(i, None, base) for i in range(12)] + [(100 + i, None, near(rng, base, 4)) for i in range(6)]
    known = spark.createDataFrame(rows, "row_id bigint, image string, body string")
    splits = spark.createDataFrame([(k, "train" if k < 8 or k > 102 else "eval") for k, _, _ in rows], "row_id bigint, split string")
    found = {(r.train_row, r.eval_row) for r in overlaps(known, splits, "row_id", "image", "body").collect()}
    train, test = [k for k, _, _ in rows if k < 8 or k > 102], [k for k, _, _ in rows if 8 <= k <= 102]
    assert found == {(a, b) for a in train for b in test}


def test_evenly_spread_edits_in_shuffled_sentences(spark):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        said = [[rng.choice(WORDS) for _ in range(20)] for _ in range((6, 12, 30, 100)[i % 4])]
        other = edited(rng, said, set(range(rng.randrange(10), 20 * len(said), 10)), ["change"])
        rng.shuffle(other)
        rows += [(i, None, ". ".join(map(" ".join, said)) + "."), (100 + i, None, ". ".join(map(" ".join, other)) + ".")]
    known = spark.createDataFrame(rows, "row_id bigint, image string, body string")
    splits = spark.createDataFrame([(k, "train" if k < 100 else "eval") for k, _, _ in rows], "row_id bigint, split string")
    found = {(r.train_row, r.eval_row) for r in overlaps(known, splits, "row_id", "image", "body").collect()}
    assert found == {(i, 100 + i) for i in range(40)}
