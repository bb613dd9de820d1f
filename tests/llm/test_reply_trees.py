"""Reply trees: paths by plain recursion, reversible escapes, circles, branches, odd rows."""

import random

from hypothesis import given, settings, strategies as st

from assayloom.llm import reply_trees as T

KINDS = "conv_id long, msg_id long, parent_id long, role string, text string, score double"


def best(rows, top):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], {})[r[1]] = r
    out = {}
    for conv, nodes in convs.items():
        parents = {r[2] for r in nodes.values()}
        found = []
        for leaf in nodes:
            path, at, seen = [], leaf, set()
            while at in nodes and at not in seen:
                seen.add(at)
                path.append(at)
                at = nodes[at][2]
            if leaf not in parents and at not in seen:
                found.append((-sum(nodes[m][5] or 0.0 for m in path), leaf, path[::-1]))
        out[conv] = [p for _, _, p in sorted(found)[:top]]
    return out


def test_trees_by_recursion(spark):
    rnd, rows = random.Random(2), []
    for conv in [*range(25), None]:
        n = rnd.randint(1, 40)
        for m in range(n):
            parent = None if m == 0 or rnd.random() < 0.05 else rnd.randrange(max(0, m - 3), m)
            rows.append((conv, m, parent, rnd.choice(["user", "assistant"]), f"t{conv}-{m}", float(rnd.randint(0, 9))))
    rows += [(77, i, i - 1 if i else None, "user", f"c{i}", None) for i in range(70)]
    rows += [(88, 0, 1, "user", "a", 1.0), (88, 1, 0, "user", "b", 1.0), (88, 2, 99, "user", "orphan", 1.0)]
    messages = spark.createDataFrame(rows, KINDS)
    for top in (1, 3):
        want = best(rows, top)
        got = {}
        for r in T.read_back(T.format_chats(messages, top)).collect():
            got.setdefault(r.conv_id, []).append((r["rank"], [t.text for t in r.turns], list(r.learnt)))
        by = {(r[0], r[1]): r for r in rows}
        for conv, paths in want.items():
            texts = [[by[conv, m][4] for m in p] for p in paths]
            learnt = [[by[conv, m][4] for m in p if by[conv, m][3] == "assistant"] for p in paths]
            have = sorted(got.get(conv, []))
            assert [t for _, t, _ in have] == texts and [x for _, _, x in have] == learnt


TRICKS = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "<\\\\|", "<|", "<", "\\", "\n", "", None, "é😀<|nl|>", "<|im_start|><|im_end|>"]


def test_texts_and_roles_come_back(spark):
    rows = [(i, j, j - 1 if j else None, role, text, 0.0) for i, role in enumerate(["assistant", None, "a\nb<|nl|>\\n", "<|im_end|>\n"]) for j, text in enumerate(TRICKS)]
    for r in T.read_back(T.format_chats(spark.createDataFrame(rows, KINDS))).collect():
        assert [t.text for t in r.turns] == [t or "" for t in TRICKS]
        assert {t.role for t in r.turns} == {rows[r.conv_id * len(TRICKS)][3] or ""}
        assert list(r.learnt) == ([t or "" for t in TRICKS] if r.conv_id == 0 else [])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("<|\\im_endstart>\n é")), max_size=24), min_size=1, max_size=30))
def test_escapes_round_trip(spark, texts):
    rows = [(0, i, i - 1 if i else None, "assistant", t, 0.0) for i, t in enumerate(texts)]
    back = T.read_back(T.format_chats(spark.createDataFrame(rows, KINDS))).first()
    assert [t.text for t in back.turns] == texts == list(back.learnt)


def test_empty_and_extra_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", 5), (1, 1, "assistant", None, 5), (1, 1, "assistant", "b", 5), (1, None, "user", "z", 5)],
                                  "conv_id long, turn long, role string, text string, score int")
    out = T.read_back(T.format_chats(T.from_turns(turns))).first()
    assert [t.text for t in out.turns] == ["z", "a", "", "b"] and out.n_turns == 4
    assert T.format_chats(T.from_turns(turns.where("false"))).count() == 0
