"""Whole views of long dialogues, and marks in texts."""

from cytoplan.llm import chat


def test_whole_views_join_the_chunks(spark):
    turns = [(1, i, ("a", "b", "system")[i % 3], f"turn {i} <|end|> é") for i in range(2500)] + [(2, 0, "a", "hi"), (None, 0, "a", "x"), (None, 1, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    views = chat.perspectives(df, chunk=100)
    got = {(r.conv_id, r.speaker): r for r in chat.whole_views(views).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "unknown")}
    whole = got[1, "a"]
    assert whole.n_turns == 2500 and whole.text.count("<|end|>") == 2500 and whole.text.count("<\\|end|>") == 2500
    spans = [tuple(map(int, s.split(":"))) for s in whole.mask.split(",")]
    own = [i for i in range(2500) if i % 3 == 0]
    assert [whole.text[a:b] for a, b in spans] == [f"turn {i} <\\|end|> é<|end|>\n" for i in own]
    parts = sorted((r.chunk, r.start, r.text) for r in views.where("conv_id = 1 and speaker = 'a'").collect())
    assert len(parts) == 25 and all(whole.text[start : start + len(text)] == text for _, start, text in parts)
