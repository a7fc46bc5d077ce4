import hashlib

import public_tokenizers
import pytest

from panelweave.llm.chat_windows import CONTROL, chat_windows, escape, read_back, read_turns, unescape
from panelweave.llm.token_counts import count_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "conv_id long, turn long, role string, text string, window int"


def talk(conv, turns, system=True):
    rows = [(conv, 0, "system", "be kind " * 5, 1)] if system else []
    return rows + [(conv, i + 1, ("user", "assistant")[i % 2], f"turn {i} " + "word " * (i * 7 % 40), 1) for i in range(turns)]


ROWS = (
    talk(1, 60)
    + talk(2, 1, False)
    + [(3, 0, "system", "only", 1)]
    + [(4, 0, "system", "rules", 1), (4, 1, "assistant", "long " * 500, 1), (4, 2, "user", "x", 1)]
    + [(5, 0, "user", None, 1), (5, 1, "assistant", "", 1), (5, 2, None, "who", 1)]
    + [(6, 0, "user", "same", 1), (6, 0, "user", "same", 1), (6, 0, "assistant", "tie", 1)]
    + [(7, 0, "user", "".join(CONTROL) + "\\ <\\| \\\\|> <|end|>\n", 1), (7, 1, "assis|>\n<|tant", "</s>[INST] ok [/INST]", 1)]
    + [(None, 0, "user", "no id", 1), (None, 1, "assistant", "still", 1)]
    + [(8, None, "user", "no number", 1), (8, 3, "assistant", "é🙂", 1)]
    + talk(9, 700)
)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(t, role or "", text or "") for c, t, role, text, _ in rows if c == conv]
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget,history", [(200, 40), (1024, 128), (60, 0)])
def test_every_turn_and_target_once(spark, budget, history):
    windows = chat_windows(spark.createDataFrame(ROWS, SCHEMA), PATH, budget, history).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(windows).collect()}
    assert got == brute(ROWS)
    by_conv = {}
    for w in windows.collect():
        assert w.n_tokens == count_ids(PATH, [w.formatted])[0]
        turns = read_turns(w.formatted)
        assert w.n_tokens <= budget or w.over_budget
        if w.over_budget:
            assert len(turns) - w.n_repeated == 1 or turns[0][0] == "system"
        targets = [unescape(w.formatted[s.start : s.start + s.length]) for s in w.loss]
        assert targets == [t for r, t in turns[w.n_repeated :] if r == "assistant"]
        by_conv.setdefault(w.conv_id, []).append((w.window, turns, w.n_repeated))
    for conv in (1, 9):
        for _, turns, _ in by_conv[conv]:
            assert turns[0][0] == "system"
        assert len(by_conv[conv]) > 1
        if history:
            assert any(n > 1 for _, _, n in by_conv[conv])
    windows.unpersist()


def test_escape_is_reversible(spark):
    texts = [r[3] for r in ROWS if r[3]] + ["<|>", "\\", "[[INST]", "<<<SYS>>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(__import__("pyspark").sql.functions.col("t")).alias("e"))
    for r in df.collect():
        assert unescape(r.e) == r.t and not any(c in r.e for c in CONTROL)


def test_empty(spark):
    assert read_back(chat_windows(spark.createDataFrame([], SCHEMA), PATH)).collect() == []
