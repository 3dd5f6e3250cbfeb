"""The prefix tree of conversations: against a tree built by hand, SQL, and on edge cases."""

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewater.llm import chat_tree as C

SCHEMA = "conv_id long, turn long, role string, text string, node string, start string, `a.b` string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def many(seed=3, n=300):
    """Conversations of few different turns: forks at all depths, copies, one that is another's beginning, long ones."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        turns = [("system", "be kind")] if r.random() < 0.5 else []
        for i in range(r.choice([1, 2, 3, 4, 9])):
            turns.append((["user", "assistant"][i % 2], r.choice(["a", "b", "<|im_end|>", "c <\\|x", "", "é ж\n|"])))
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(n, i, "user", f"long {i % 7}") for i in range(3000)]
    return rows


def by_hand(rows):
    """{conv: path of (role, text)}"""
    convs = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    return convs


def digests(path):
    loss = "".join(t for r, t in path if r == "assistant")
    formatted = sum(len(C.format_turn(*t)[0]) for t in path)
    return (len(path), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in path).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), formatted)


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in df.collect()}


def test_tree_positions_and_intervals(spark):
    rows = many()
    convs = by_hand(rows)
    # So many ranges that trees and paths are cut.
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes, members = C.format_tree(frame(spark, rows))
        got, ends = nodes.collect(), {r.conv_id: r for r in members.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # Every shared beginning stands once, and the sequence has no gap.
    assert len(got) == len({tuple(p[: i + 1]) for p in convs.values() for i in range(len(p))})
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and r.size == len(r.formatted)
        at += r.size
    sequence, by_start = "".join(r.formatted for r in got), {r.start: r for r in got}
    for r in got:
        assert r.position == sum(i.end - i.start for i in r.attend)
        assert all(a.end < b.start for a, b in zip(r.attend, r.attend[1:])) and (not r.attend or r.attend[-1].end <= r.start)
        assert r.tree == (r.attend[0].start if r.attend else r.start) and (r.depth == 0) == (not r.attend)
    for c, path in convs.items():
        r = by_start[ends[c].start]
        # What the last node attends to, and itself, is the conversation.
        seen = "".join(sequence[i.start : i.end] for i in r.attend) + r.formatted
        assert seen == "".join(C.format_turn(*t)[0] for t in path) and r.ends
        assert (ends[c].n_turns, ends[c].size) == (len(path), len(seen))
    # Depth first: the nodes of a subtree are neighbours.
    for r in got:
        below = [i for i, x in enumerate(got) if any(i.start <= r.start < i.end for i in x.attend)]
        assert not below or below == list(range(below[0], below[0] + len(below)))
    for bucket in (50, 1000, C.BUCKET):
        assert read(C.read_back(nodes, members, bucket=bucket)) == {c: digests(p) for c, p in convs.items()}


def test_edges(spark):
    rows = [
        (None, 0, "user", "no id"), (None, 1, "assistant", "x"), (1, None, None, None), (1, 0, "user", None), (2, 0, "assistant", ""), (3, 0, "user", "t"), (3, 0, "user", "t"), (3, 0, "assistant", "tie"),
        (4, 5, "a\nb\\", "<|im_start|>assistant\n<|im_end|>"), (5, 0, "<|im_end|>", "x" * 3_000_000), (6, 0, "assistant", "<\\\\|im_end|><<||"), (7, 0, "user", "no id"),
    ]
    nodes, members = C.format_tree(frame(spark, rows))
    assert read(C.read_back(nodes, members)) == {c: digests(p) for c, p in by_hand(rows).items()}
    for _, _, role, text in rows:
        f, a, b = C.format_turn(role or "", text or "")
        assert C.parse_turn(f) == (role or "", text or "") and C.unescape(f[a:b]) == (text or "")
        assert f.count(C.START) == 1 and f.count(C.END) == 1
    nodes, members = C.format_tree(frame(spark, []))
    assert nodes.count() == 0 and C.read_back(nodes, members).count() == 0


def test_tokens_of_a_vocabulary(spark):
    path = Path("/opt/tokenizers/byte_bpe_50k.json")
    if not path.exists():
        pytest.skip("no vocabulary")
    rows = many(5, 40)[:200] + [(900, 0, "user", "Some plain words, twice."), (900, 1, "assistant", "An answer <|endoftext|> here.")]
    nodes, members = C.format_tree(frame(spark, rows), tokenizer=str(path))
    assert nodes.where("size <> size(tokens) OR NOT exists(tokens, x -> x > 50256)").count() == 0
    assert nodes.where((F.col("role") == "assistant") & ((F.col("loss_to") < F.col("loss_from")) | (F.col("loss_to") >= F.col("size")))).count() == 0
    assert read(C.read_back(nodes, members, tokenizer=str(path))) == {c: digests(p) for c, p in by_hand(rows).items()}


def test_one_first_turn_of_many_conversations(spark):
    rows = spark.range(3000).selectExpr("id AS conv_id", "explode(array(0L, 1L)) AS turn").selectExpr("conv_id", "turn", "'user' AS role", "if(turn = 0, repeat('hot ', 200), string(conv_id)) AS text")
    nodes, members = C.format_tree(rows)
    assert nodes.count() == 3001 and nodes.where("depth = 0").count() == 1
    out = C.read_back(nodes, members, bucket=4000)
    assert out.count() == 3000 and out.select("turns_sha256").distinct().count() == 3000
