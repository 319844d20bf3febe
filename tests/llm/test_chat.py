import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from roomgraph.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, seq long, state string"


def test_digests_from_output(spark):
    nasty = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "s"), (1, 1, "user", nasty), (1, 2, "assistant", nasty + "\\"), (1, 3, "user", None),
            (2, 0, "assistant", "####"), (2, 0, "assistant", "<</turn>"), (2, None, "tool)###\\", "t"), (3, 5, None, "x" * 300000),
            (None, 1, "user", "n"), (None, 2, "assistant", ""), (4, 1, "user", "q"), (4, 1, "user", "q")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].valid and got[None].valid and not got[2].valid and not got[4].valid
    assert got[4].error == "'user' after asked"


def test_empty_table(spark):
    assert chat.read_back(chat.format_chat(spark.createDataFrame([], SCHEMA))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\#</turn> ASsit:)(é\n", max_size=60))
def test_hidden_text_has_no_marks_and_comes_back(text):
    t = chat.ChatTemplate()
    found = list(t.reader().finditer(t.hide(text)))
    assert {m.lastgroup for m in found} <= {"plain", "text"}
    assert "".join(m[m.lastgroup] for m in found) == text
