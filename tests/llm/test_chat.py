import hashlib
import os
import tempfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkseek.llm import chat as C

pieces = st.lists(st.sampled_from([*C.CONTROL, "\\", "#", "###", "\n", "</", "turn>", "é", "日本", " ", "a", "\r\n", "Assistant:"]), max_size=12).map("".join)


@given(pieces)
@settings(max_examples=300, deadline=None)
def test_escape(s):
    e = C.escape(s)
    assert C.unescape(e) == s
    rest = C._UNESCAPE.sub("", e)
    assert not any(x in rest for x in ()) and "\\" not in rest


@given(st.sampled_from(["user", "assistant", "system", "", "tool", "</role>", "### User:"]), pieces)
@settings(max_examples=200, deadline=None)
def test_turn(role, text):
    c = C.codec(C.TOKENIZERS, C.VOCABULARY)
    ids, mask, segments = c.assemble(role, text)
    got = C.read_turn(c, ids, mask)
    assert got[:3] == (role, text, text if role == "assistant" else "")
    assert got[3] == len(c.decode(ids)) and len(mask) == len(ids) == segments[-1][2]
    assert sum(i >= c.first for i in ids.tolist()) == (2 if role in C.HEADS else 3)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).hexdigest()[:16]))]
        loss = "".join(t for r, t in own if r == "assistant")
        form = "".join((C.HEADS.get(r) or f"{C.OTHER_HEAD}{C.escape(r)}{C.ROLE_END}") + C.escape(t) + C.TURN_END for r, t in own)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss), len(form))
    return out


@pytest.mark.parametrize("rows", [
    [],
    [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, None, None, "\\"), (None, 0, "tool", "###"), (3, 5, "system", ""), (4, 0, "assistant", "long é " * 9000)],
])
def test_query(spark, rows):
    d = tempfile.mkdtemp()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(os.path.join(d, "conversations.parquet"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in C.op2_chat(spark, d).collect()}
    assert got == brute([*rows, (-7, 0, "user", C.TRICKY), (-7, 1, "assistant", C.TRICKY)])


def test_offsets_and_many_turns(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(3000)]
    f = C.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = C.with_offsets(f).orderBy("turn").select("token_start", "char_start", "n_tokens", "formatted_chars").collect()
    t = c = 0
    for r in got:
        assert (r.token_start, r.char_start) == (t, c)
        t, c = t + r.n_tokens, c + r.formatted_chars
    assert C.read_back(f).collect()[0].n_turns == 3000
