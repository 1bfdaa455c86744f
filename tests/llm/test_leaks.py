import random

from tesselade.llm import leaks as L
from tesselade.llm.leak_text import holds, words

WORDS = [f"w{i}" for i in range(300)]


def plain_holds(same, least=20, share=10):
    best = 0
    for a in range(len(same)):
        for b in range(a + least, len(same) + 1):
            if sum(not x for x in same[a:b]) * share <= b - a:
                best = max(best, b - a)
    return best


def test_holds():
    rng = random.Random(1)
    for _ in range(300):
        same = [rng.random() < 0.87 for _ in range(rng.randint(0, 60))]
        run = holds(same, 20)
        assert (run[1] - run[0] if run else 0) == plain_holds(same)


def test_layout_does_not_count():
    plain = words("the half-open lamp, by the water; it says so")
    assert words("> The **half**-open\n> lamp by​ the wa­ter &mdash; it <b>says</b> so") == plain
    assert words('{"a": "the half-open lamp,\\n by the water; it\\tsays so"}')[1:] == plain
    assert words("| the | half-open | [lamp](http://x.y/z) |\r\n by the w`ater`; it says so") == plain


def brute(items, text):
    said, found = words(text), set()
    for key, item in items:
        it = words(item)
        for shift in range(-len(it), len(said)):
            a, b = max(0, -shift), min(len(it), len(said) - shift)
            if b - a >= 20 and plain_holds([it[k] == said[k + shift] for k in range(a, b)]):
                found.add(key)
                break
    return found


def test_against_brute_force():
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(WORDS[:60]) for _ in range(rng.randint(15, 70)))) for i in range(12)]
    texts = []
    for _ in range(60):
        _, item = rng.choice(items)
        part = item.split()[rng.randint(0, 10) :][: rng.randint(14, 60)]
        rate = rng.choice([0, 0.05, 0.1, 0.15])
        part = ["other" if rng.random() < rate else w for w in part]
        texts.append(" ".join([rng.choice(WORDS) for _ in range(rng.randint(0, 30))] + part + [rng.choice(WORDS) for _ in range(rng.randint(0, 30))]))
    texts += [None, "", "short", "w1 " * 300, " ".join(x for _, x in items)]
    known = L._Items(items)
    found = {}
    for t, i, *_ in L.passages(known, texts):
        found.setdefault(t, set()).add(known.keys[i])
    want = {n: f for n, t in enumerate(texts) if (f := brute(items, t or ""))}
    assert found == want and len(want) > 20


def test_leaks(spark, monkeypatch):
    rng = random.Random(3)
    passage = [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(6)]
    items = spark.createDataFrame([(i, t, "x") for i, t in enumerate(passage)] + [(98, None, "x"), (99, "", "x"), (5, passage[5], "again")], "item_id bigint, text string, words string")
    rows = [(i, "Before. " + p + " after", 1) for i, p in enumerate(passage)] + [(50, " ".join(passage[0].split()[:19]), 1), (51, None, 1), (52, "", 1), (0, passage[0], 1), (53, "long " * 200_000 + passage[1], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item int")
    found = L.leaks(docs, "doc_id", "text", items, "item_id", "text")
    pairs = {(r.doc_id, r.item) for r in found.collect()}
    assert pairs == {(i, i) for i in range(6)} | {(53, 1)}
    assert {r.doc_id for r in L.without_leaks(docs, "doc_id", found).collect()} == {50, 51, 52}
    monkeypatch.setattr(L, "BLOCK_BYTES", 500)  # in blocks
    assert {(r.doc_id, r.item) for r in L.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()} == pairs
    assert L.leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert L.leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_long_mark_up_and_compatible_letters():
    link = "x" * 500
    assert words(f'the <a href="{link} {link}">lamp</a> by [the water](http://{link}) <!-- {link} {link} -->') == ["the", "lamp", "by", "the", "water"]
    assert words("für ﬁne ＷＯＲＤ") == words("für fine word")


def test_passage_inside_mark_up():
    item = " ".join(WORDS[:30])
    for text in (f"Before <!-- {item} --> after.", f'<img alt="{item}"> after', f"<p>{item}</p>"):
        assert {i for _, i, *_ in L.passages(L._Items([(7, item)]), [text])} == {0}


def test_two_passages_of_one_alignment():
    item = WORDS[:80]
    text = item[:25] + ["other"] * 20 + item[45:]
    assert [(a, n) for _, _, a, _, n in L.passages(L._Items([(7, " ".join(item))]), [" ".join(text)])] == [(0, 27), (42, 38)]


def test_trimmed(spark):
    item = " ".join(WORDS[:30])
    texts = {1: f"Kept line.\n{item}\nKept too.", 2: "Nothing here.", 3: None, 4: f"<b\n title='x'>{item}</b>", 5: f"{' '.join(WORDS[:10])}\n{' '.join(WORDS[10:30])} tail\nend"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    left = dict(L.without_spans(docs, "doc_id", "text", L.leaks(docs, "doc_id", "text", items, "item_id", "text")).collect())
    assert left == {1: "Kept line.\nKept too.", 2: "Nothing here.", 3: None, 5: "end"}
