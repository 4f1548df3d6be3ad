"""Chat formatting against plain versions: trees, escaping, masks, read back."""

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandlake.llm import chats

MESSAGES = "node long, parent long, role string, text string, score double, place int, root string, up long"
CONVERSATIONS = "conv_id long, turn long, role string, text string, node string, root int, range int, piece string, mask int"


def trees_by_hand(rows, keep):
    """{(root, leaf): [(role, text)]} of messages, the best `keep` branches of each root."""
    node = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "", r[4] is not None, r[4] or 0)):
        if r[0] is not None:
            node.setdefault(r[0], r)
    parents = {r[1] for r in node.values()}
    found = {}
    for n in node:
        if n in parents:
            continue
        path, at = [], n
        while at in node and len(path) <= len(node):
            path.append(at)
            at = node[at][1]
        if len(path) <= len(node):
            found[path[-1], n] = (sum(node[x][4] or 0 for x in path), [(node[x][2], node[x][3]) for x in reversed(path)])
    if keep is not None:
        by_root = {}
        for (root, leaf), (score, _) in found.items():
            by_root.setdefault(root, []).append((-score, leaf))
        kept = {(root, leaf) for root, leaves in by_root.items() for _, leaf in sorted(leaves)[:keep]}
        found = {k: v for k, v in found.items() if k in kept}
    return {k: v[1] for k, v in found.items()}


def forest():
    rng = random.Random(5)
    rows = [(i, None if i % 25 == 0 else rng.randrange(i - i % 25, i), rng.choice(["user", "assistant", None]), rng.choice(["a", "", None, "</s>x"]), rng.choice([0.0, 1.0, 2.5, None])) for i in range(100)]
    rows += [(200 + i, 199 + i if i else None, "user", f"t{i}", 1.0) for i in range(40)]  # a chain
    rows += [(300, None, "user", "star", 0.0)] + [(301 + i, 300, "assistant", f"s{i}", float(i % 7)) for i in range(60)]
    rows += [(400, 401, "user", "cycle", 1.0), (401, 400, "user", "cycle", 1.0), (402, 401, "user", "below", 1.0), (403, 403, "user", "own", 1.0)]
    rows += [(500, 999, "user", "no parent", 1.0), (None, 500, "user", "no id", 1.0), rows[7], (7, None, None, None, None), (8, 0, "user", "again", 9.0)]
    return rows


@pytest.mark.parametrize("keep", [1, 3, None])
def test_paths(spark, keep):
    rows = forest()
    df = spark.createDataFrame([(*r, 1, "x", 3) for r in rows], MESSAGES).repartition(3)
    found = {}
    for r in sorted(chats.paths(df, keep).collect(), key=lambda r: r["place"]):
        path = found.setdefault((r["root"], r["leaf"]), [])
        assert r["place"] == len(path)
        path.append((r["role"], r["text"]))
    assert found == trees_by_hand(rows, keep)


def test_no_messages(spark):
    assert chats.paths(spark.createDataFrame([], MESSAGES)).count() == 0
    assert chats.chats(spark.createDataFrame([], CONVERSATIONS)).count() == 0


PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<<SYS>>", "<", "\\", "|", "s>", "/s>", "[", "INST]", "x", "é", "\n", "\U0001f600", "<\\/s>", "$1"]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escaping(text):
    t = chats.Template()
    escaped = t.escape(text)
    assert t.unescape(escaped) == text
    assert not any(m in escaped for m in t.marks)
    assert not any(m in f"{t.text}{escaped}{t.end}"[1:-1].replace(t.text[1:], "", 1) for m in t.marks)


def test_escaping_in_columns(spark):
    t, rng = chats.Template(), random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(t.escaped(df.x)).collect()] == [t.escape(x) for x in texts]


def test_conversations(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["system", "user", "assistant", None, "to</s>ol"]), rng.choice(["".join(rng.choices(PIECES, k=6)), None, "", "plain text"])) for c in range(12) for t in range(rng.randrange(1, 9))]
    rows += [(50, t, ("user", "assistant")[t % 2], f"turn {t} </s>") for t in range(300)]  # longer than a piece
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (60, 1, "assistant", "tie"), (60, 1, "assistant", "tie"), (60, 1, "user", "tie"), (61, 0, None, None)]
    rows += [(70, 0, "assistant", "<|text|>" + "long </s> " * 60_000)]
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], CONVERSATIONS).repartition(5)
    t = chats.Template()
    whole = chats.chats(chats.with_planted(df)).collect()
    expected = {}
    for c, turn, role, text in sorted(rows + chats.PLANTED, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: chats.read_back(r["formatted"], t) for r in whole} == expected and len(whole) == len(expected)
    for r in whole:
        assert r["formatted"].count(t.end) == len(expected[r["conv_id"]]) and not any(m in r["formatted"] for m in t.others)
    rows = {r["conv_id"]: tuple(r)[1:] for r in chats.digests(chats.chats(chats.with_planted(df)), "conv_id").collect()}
    for c, turns in expected.items():
        trained = "".join(x for role, x in turns if role == "assistant")
        sha = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        chars = len(t.opening) + sum(len(t.turn + t.escape(a) + t.text + t.escape(b) + t.end) for a, b in turns)
        assert rows[c] == (len(turns), sha, len(trained), hashlib.sha256(trained.encode()).hexdigest(), chars)


def test_another_template(spark):
    t = chats.Template(opening="", turn="<|im_start|>", text="<|sep|>", end="<|im_end|>", trained=("user",))
    df = spark.createDataFrame([(1, 0, "user", "<|sep|><|im_end|>"), (1, 1, "assistant", "</s>")], "conv_id long, turn long, role string, text string")
    assert chats.read_back(chats.chats(df, t).first()["formatted"], t) == [("user", "<|sep|><|im_end|>"), ("assistant", "</s>")]
    assert chats.digests(chats.chats(df, t), "conv_id", t).first()["loss_chars"] == len("<|sep|><|im_end|>")
