import hashlib
from collections import defaultdict

import pytest

from conftest_llm import SMALL, same_as_sql
from rowsmith.llm.reply_trees import END, SAYS, TURN, chosen_paths, format_paths, op6_reply_trees, read_back

COLS = "conv long, id long, parent long, role string, text string, score double"


def messages(spark, rows):
    return spark.createDataFrame(rows, COLS)


def formatted(df, n_paths=1):
    return format_paths(df, "conv", "id", "parent", "role", "text", "score", n_paths)


def test_query_matches_sql(spark):
    assert same_as_sql(spark, "op6_reply_trees") == 21


def test_query_matches_brute_force(spark):
    rows = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{SMALL}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        rows[r.conv_id].append((r.role, r.text or ""))
    rows[-7] = [(role, r"\### Assistant: </turn> ok") for role in ("user", "assistant")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in op6_reply_trees(spark, SMALL).collect():
        turns = rows.pop(r.conv_id)
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
    assert not rows


def test_best_branch_and_all_branches(spark):
    tree = messages(spark, [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0),
                            (1, 4, 2, "user", "more", 0.5), (1, 5, 3, "user", "thanks", 0.0), (1, 6, 99, "user", "orphan", 0.1)])
    best = formatted(tree).collect()
    assert [r.formatted for r in best] == ["".join(f"{TURN}{a}{SAYS}{b}{END}" for a, b in
                                                  (("user", "q"), ("assistant", "good"), ("user", "thanks")))]
    span = best[0].loss[0]
    assert best[0].formatted[span.start:span.start + span.length] == "good"
    assert {r.leaf for r in formatted(tree, None).collect()} == {4, 5, 6}
    paths = defaultdict(list)
    for r in chosen_paths(tree.select("conv", "id", "parent", "score"), None).collect():
        paths[r.leaf].append((r.pos, r.id))
    assert {k: sorted(v) for k, v in paths.items()} == {4: [(1, 1), (2, 2), (3, 4)], 5: [(1, 1), (2, 3), (3, 5)], 6: [(1, 6)]}


def test_random_trees_match_a_walk(spark, rng):
    rows, parent = [], {}
    for conv in range(5):
        for i in range(60):
            parent[conv, i] = rng.randrange(i) if i and rng.random() < 0.95 else None
            rows.append((conv, i, parent[conv, i], "user", str(i), float(rng.randrange(4))))
    score = {(r[0], r[1]): r[5] for r in rows}

    def walk(c, i):
        return [] if i is None else walk(c, parent[c, i]) + [i]
    inner = {(c, p) for (c, _), p in parent.items() if p is not None}
    for r in formatted(messages(spark, rows)).collect():
        ends = [walk(r.conv, i) for c, i in parent if c == r.conv and (c, i) not in inner]
        want = min(ends, key=lambda p: (-sum(score[r.conv, i] for i in p), -len(p), p[-1]))
        assert r.formatted == "".join(f"{TURN}user{SAYS}{i}{END}" for i in want)


def test_escapes_and_edges(spark):
    texts = [None, "", "\\", "<|", "<\\|", "\\<|end|>\n<|turn|>", "a\\\\<|<|", "ü<|says|>\U0001f600", "x" * 200_000, "<", "|>"]
    rows = [(1, i, i - 1 if i else None, "assistant", t, None) for i, t in enumerate(texts)]
    rows += [(None, 1, None, None, "null conv", None), (2, 1, None, "user", None, 0.0)]
    out = {r.conv: r for r in read_back(formatted(messages(spark, rows))).collect()}
    assert len(out) == 3 and out[1].n_turns == len(texts) and out[1].loss_text == "".join(t or "" for t in texts)
    want = "".join(f"assistant\n{t or ''}\n" for t in texts)
    assert out[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert out[None].turns_sha256 == hashlib.sha256(b"\nnull conv\n").hexdigest() and out[None].loss_text == ""
    assert formatted(messages(spark, rows).limit(0)).count() == 0


def test_long_chain_takes_few_rounds(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(700)]
    out = read_back(formatted(messages(spark, rows))).first()
    assert out.n_turns == 700
    assert out.turns_sha256 == hashlib.sha256("".join(f"user\n{i}\n" for i in range(700)).encode()).hexdigest()


def test_circles_and_repeated_ids_raise(spark):
    with pytest.raises(ValueError):
        formatted(messages(spark, [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)]))
    with pytest.raises(ValueError):
        formatted(messages(spark, [(1, 1, None, "user", "a", 0.0), (1, 1, None, "user", "b", 0.0)]))
