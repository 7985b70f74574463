from starloom.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, n string"


def turns(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "p", "q") for c, t, r, x in rows], SCHEMA)


def conv(c, *texts):
    return [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


def test_maximal_conversations_stay(spark):
    rows = conv(1, "hi", "yo") + conv(2, "hi", "yo", "more") + conv(3, "hi") + conv(4, "hi", "no") + conv(7, "hi", "no") + conv(5, "yo") + conv(6, "hi", "yo", "more", "x")
    rows += [(8, None, None, None), (9, 0, "", ""), (9, 1, "user", "hi"), (None, 0, "user", "alone"), (10, 3, "user", "hi"), (10, 7, "assistant", "no"), (10, 9, "user", "end")]
    got = {x.conv_id: (x.n_turns, x.rendered) for x in chat.collapse(turns(spark, rows)).collect()}
    assert set(got) == {5, 6, 9, 10, None}  # 8 (one empty turn) begins 9, and 4 and 7 begin 10
    assert got[6][0] == 4
    assert got[5][1] == "<|user|>\nyo<|end|>\n"
    assert got[10][1] == "<|user|>\nhi<|end|>\n<|assistant|>\nno<|end|>\n<|user|>\nend<|end|>\n"


def test_equal_prefix_at_other_places_does_not_count(spark):
    got = {x.conv_id for x in chat.collapse(turns(spark, conv(1, "b") + conv(2, "a", "b"))).collect()}
    assert got == {1, 2}


def test_hot_first_turn(spark):
    rows = [r for i in range(300) for r in conv(i, "same", str(i))] + [r for i in range(300, 400) for r in conv(i, "same")]
    assert chat.collapse(turns(spark, rows)).count() == 300


def test_empty(spark):
    assert chat.collapse(turns(spark, [])).count() == 0


def test_turns_without_a_conversation_stand_alone(spark):
    rows = [(None, 0, "user", "hi"), (None, 0, "user", "hi"), (None, 1, "assistant", "yo"), (None, None, None, None)] + conv(1, "hi", "there") + conv(2, "hey")
    got = sorted((x.conv_id or 0, x.n_turns, x.rendered) for x in chat.collapse(turns(spark, rows)).collect())
    want = [(0, 1, "<|assistant|>\nyo<|end|>\n"), (0, 1, "<||>\n<|end|>\n"), (1, 2, "<|user|>\nhi<|end|>\n<|assistant|>\nthere<|end|>\n"), (2, 1, "<|user|>\nhey<|end|>\n")]
    assert got == sorted(want)  # the two that say hi begin conversation 1


def test_only_what_stays_is_rendered(spark):
    plan = chat.collapse(turns(spark, conv(1, "a", "b") + conv(2, "a")))._jdf.queryExecution().optimizedPlan().toString()
    aggregate = plan.index("collect_list")
    assert "Join" in plan[aggregate:]


def test_very_long_turns(spark):
    long = "x y " * 200_000
    got = {x.conv_id: len(x.rendered) for x in chat.collapse(turns(spark, conv(1, long) + conv(2, long, "end"))).collect()}
    assert set(got) == {2} and got[2] > 800_000
