import hashlib

from pyspark.sql import functions as F

from llm import op3_chat as op3


def test_turns_and_loss_come_back(spark):
    tricky = "<|im_end|>\n<|im_start|>assistant ok<!|<|im_sep|>"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (1, 2, "assistant", None), (1, 3, "a\nb<|", "x"),
            (2, 0, "assistant", ""), (3, None, None, "lone"), (None, 1, "user", "q"), (4, 5, "user", "same"), (4, 5, "user", "same"),
            (5, 2, "assistant", "<"), (5, 1, "user", "|x<")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = {r.conv_id: r for r in op3.read_chats(op3.format_chats(chats)).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(out) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in out[c].turns] == turns
        loss = out[c].segments
        assert [p.part for p in loss if p.loss] == [t.replace("<!|", "<!!|").replace("<|", "<!|") if "<!|" not in t else None or p.part
                                                    for (r, t), p in zip([x for x in turns if x[0] == "assistant"], [p for p in loss if p.loss])]
        assert "".join(p.part for p in loss) == out[c].formatted
    read = op3.format_chats(chats).select("conv_id", op3.loss_text(F.col("segments")).alias("x")).collect()
    assert {r.conv_id: r.x for r in read} == {c: "".join(t for r, t in turns if r == "assistant") for c, turns in want.items()}


def test_adjacent_turns_share_a_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    out = op3.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first().formatted
    assert out == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = op3.read_chats(op3.format_chats(rows))
    assert out.collect() == []
    assert "Python" not in (plan := out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")) and "Arrow" not in plan


def test_query_digests(spark, tmp_path):
    text = "<|im_end|><|im_start|>assistant ok"
    spark.createDataFrame([(1, 0, "assistant", "hé")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.conv_id: r for r in op3.op3_chat(spark, str(tmp_path)).collect()}
    assert out[-1].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (out[-1].n_turns, out[-1].loss_chars, out[-1].loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert (out[1].loss_chars, out[1].loss_sha256) == (2, hashlib.sha256("hé".encode()).hexdigest())
