from vspark.llm import chat


def test_prefix_masks_and_missing_sides(spark):
    turns = [
        (0, True, 10, 0, "user", "hi"), (0, True, 10, 1, "assistant", "yes"), (0, True, 10, 2, "user", "é?"), (0, False, 11, 0, "user", "hi"), (0, False, 11, 1, "assistant", "no"),
        (1, True, 12, 0, "user", "same"), (1, False, 13, 5, "user", "same"),
        (2, True, 14, 0, None, None), (2, True, 14, 0, "assistant", "b"),
        (None, True, 15, 0, "user", "x"),
    ]
    df = spark.createDataFrame(turns, "pair_id long, chosen boolean, conv_id long, turn int, role string, text string").selectExpr("*", "1 AS prompt", "2 AS c", "3 AS n_prefix")
    got = {r.pair_id: r for r in chat.format_preferences(df).collect()}
    assert sorted(got) == [0, 1, 2]
    a = got[0]
    assert (a.chosen_id, a.rejected_id, a.n_prefix, a.prompt) == (10, 11, 1, "<|user|>\nhi<|end|>\n")
    assert a.chosen == "<|assistant|>\nyes<|end|>\n<|user|>\né?<|end|>\n" and a.rejected == "<|assistant|>\nno<|end|>\n"
    spans = lambda text, mask: [text[slice(*map(int, s.split(":")))] for s in mask.split(",") if s]
    assert spans(a.chosen, a.chosen_mask) == ["yes<|end|>\n"] and spans(a.rejected, a.rejected_mask) == ["no<|end|>\n"] and a.complete
    assert (got[1].n_prefix, got[1].chosen, got[1].rejected, got[1].chosen_mask) == (1, "", "", "")
    assert (got[2].n_prefix, got[2].prompt, got[2].rejected, got[2].rejected_mask, got[2].complete) == (0, "", None, None, False)
    assert got[2].chosen == "<||>\n<|end|>\n<|assistant|>\nb<|end|>\n"
    assert chat.format_preferences(df.filter("false")).collect() == []
