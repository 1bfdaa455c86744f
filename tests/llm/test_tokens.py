import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesselade.llm.bpe import ByteBPE, encoder
from tesselade.llm.encode import PATTERN, encode
from tesselade.llm.split_text import LEVELS, boundaries, fences, pack
from tesselade.llm.splitting import pieces

PATH = "/opt/tokenizers/byte_bpe_50k.json"
REFERENCE = Tokenizer.from_file(PATH)
REFERENCE.encode_special_tokens = True


def own():
    with open(PATH, "rb") as f:
        return encoder(f.read(), PATTERN)


def reference(text):
    return REFERENCE.encode(text, add_special_tokens=False).ids


@given(st.text(max_size=200) | st.text(alphabet="ab \n'", max_size=200) | st.text(alphabet="漢字カナー한글é🙂‍", max_size=100))
@settings(max_examples=300, deadline=None)
def test_same_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    assert own().encode(text) == reference(text)


def test_long_pretokens():
    for text in ("a" * 20_000, "ab" * 10_000, " " * 20_000, "漢" * 9_000, "<|endoftext|>" * 50, "0123456789" * 2_000):
        assert own().encode(text) == reference(text)


def test_cache_may_be_cleared(model):
    small, text = ByteBPE(model, PATTERN, cache=3), "one two three four five one two xyzzy plugh 漢字仮名交じり文の長い並び"
    assert small.encode(text) == reference(text)


def test_encode(spark):
    rows = [(1, "Hello world", "clash"), (2, "", "x"), (3, None, "x"), (3, None, "x"), (None, "  ", "x"), (4, "<|endoftext|>", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    found = sorted(((r.doc_id, r.ids) for r in encode(df, "doc_id", "text").collect()), key=str)
    assert found == sorted([(k, reference(t) if t else []) for k, t, _ in rows], key=str)
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def check(text, limit=1000, overlap=100):
    bpe = own()
    ids = bpe.encode(text)
    lengths = np.array([len(bpe.bytes_of[i]) for i in ids])
    found = pack(text.encode(), lengths, limit, overlap)
    if len(ids) <= limit:
        assert len(found) == bool(ids)
        return found
    assert found[0][0] == 0 and found[-1][1] == len(ids)
    assert all(b - a <= limit for a, b, _ in found)
    assert all(nxt[0] == cur[1] - overlap and nxt[1] > cur[1] and nxt[0] >= cur[0] for cur, nxt in zip(found, found[1:]))
    return found


def test_pack():
    sections = "\n\n".join(f"## Part {i}\n\n" + "One plain sentence follows the other here. " * 40 for i in range(9))
    assert {b for _, _, b in check(sections)[:-1]} == {"heading 2"}
    assert {b for _, _, b in check("A sentence of some words ends here. " * 900)[:-1]} == {"sentence"}
    assert {b for _, _, b in check("- item of a list\n" * 900)[:-1]} == {"item"}
    assert {b for _, _, b in check("word " * 3000)[:-1]} == {"word"}
    for text in ("x" * 50_000, "漢字" * 4_000, "\n" * 9_000, '{"a": [1, 2, {"b": "c"}]},\n' * 500, "", "short", "héllo wörld " * 5_000):
        check(text)
        check(text, limit=64, overlap=20)


@given(st.text(alphabet="ab.#- \n漢", min_size=100, max_size=600))
@settings(max_examples=60, deadline=None)
def test_pack_any(text):
    check(text, limit=30, overlap=7)


def test_pieces(spark):
    bpe = own()
    long = "Ünïcode words and 漢字 go on. " * 400
    rows = [(1, long, 1), (2, "short", 2), (3, None, 3), (4, "", 4), (5, "a " * 1000, 5), (6, "a" + " a" * 999, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece int")
    found = pieces(df, "doc_id", "text").collect()
    assert {r.doc_id for r in found} == {k for k, t, _ in rows if t and len(bpe.encode(t)) > 1000}
    mine = sorted((r for r in found if r.doc_id == 1), key=lambda r: r.piece)
    assert [r.piece for r in mine] == list(range(len(mine)))
    assert all(len(bpe.encode(r.text)) <= 1000 for r in found) and mine[0].text == long[: len(mine[0].text)]
    assert pieces(df, "doc_id", "text", content=False).columns == ["doc_id", "piece", "start_token", "end_token", "boundary"]
    assert pieces(df.limit(0), "doc_id", "text").count() == 0


def test_code_blocks_are_nodes():
    code = "```python\n# no heading\nx = 1\n\n## none\ny = 2\n```\n"
    raw = f"# One\ntext\n\n{code}# Two\ntail\n".encode()
    assert [raw[a:b] for a, b in fences(raw)] == [code.encode()]
    marks = boundaries(raw, np.arange(len(raw)))
    named = {raw[i:].split(b"\n")[0]: LEVELS[level] for i, level in marks.items() if raw[i - 1 : i] == b"\n"}
    assert named[b"# Two"] == "heading 1" and named[b"# no heading"] == "line" and named[b"## none"] == "item" and named[b"```python"] == "paragraph"


def test_json_members_by_depth():
    raw = b'{"a": {"b": 1, "c": [1, 2]}, "d": "x, y"}'
    marks = {raw[i:][:4]: LEVELS[level] for i, level in boundaries(raw, np.arange(len(raw))).items()}
    assert marks[b' "d"'] == "paragraph" and marks[b' "c"'] == "item" and b" y\"}" not in marks


def test_no_cut_at_a_weaker_boundary_than_there_is():
    """A unit of its own size holds no boundary stronger than the one that it ends at."""
    rng = np.random.default_rng(4)
    kinds = ["# H{}\n", "## H{}\n", "\nPara {} goes on. It ends here.\n\n", "- item {}\n- other\n", "| a | {} |\n| b | c |\n", "```\n# code {}\n\nx\n```\n", "A line {} without an end\n"]
    cuts = weaker = 0
    for _ in range(60):
        raw = "".join(kinds[k].format(i) for i, k in enumerate(rng.integers(0, len(kinds), 120))).encode()
        limit, overlap = 220, 20
        marks = boundaries(raw, np.arange(len(raw)))
        found = pack(raw, np.ones(len(raw), np.int64), limit, overlap)
        begin = 0
        for _, end, name in found[:-1]:
            stronger = [p for p, level in marks.items() if begin < p < end and level < LEVELS.index(name)]
            # only a unit with less of its own than is shared may hold one
            weaker += any(p - begin >= overlap and end - p >= overlap for p in stronger)
            cuts += 1
            begin = end
    # a small unit whose neighbour over the weaker boundary has no room joins the other one
    assert cuts > 500 and weaker <= cuts // 200
