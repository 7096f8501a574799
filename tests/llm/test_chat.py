import hashlib

import odd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siteframe.llm import chat

ODD_TEXTS = ["", "<|", "<\\|", "<\\\\|end|>", "<|end|>\n<|turn|>user<|text|>", "<<|", "<", "|", "\\", "<|loss|>x<|/loss|>", "<|image:0|>", "a<b|c", "<\\<|\\|"]


@given(st.text(alphabet="<|\\/xend:0 ", max_size=30))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


@given(st.lists(st.one_of(
    st.text(alphabet="<|\\ab", max_size=8).map(lambda t: {"type": "text", "text": t}),
    st.sampled_from(["image", "audio", "document"]).map(lambda k: {"type": k, "ref": f"s3/{k}", "units": 3})), max_size=8))
def test_parts_read_back(parts):
    formatted, attachments = chat.format_turn("assistant", parts)
    body = formatted.partition(chat.TEXT_BEGIN)[2].removeprefix(chat.LOSS_BEGIN).removesuffix(chat.TURN_END + "\n").removesuffix(chat.LOSS_END)
    want = []
    for p in parts:
        if p["type"] != "text":
            want.append(p)
        elif p["text"] and want and want[-1]["type"] == "text":
            want[-1] = {"type": "text", "text": want[-1]["text"] + p["text"]}
        elif p["text"]:
            want.append(p)
    assert chat.read_parts(body, attachments) == want
    assert [n for _, _, n in attachments] == [3 * chat.TOKENS[p["type"]] for p in parts if p["type"] != "text"]


def digests(turns):
    turns = [(r or "", t or "") for r, t in turns]
    learnt = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learnt),
            hashlib.sha256(learnt.encode()).hexdigest())


def test_read_back(spark):
    rows = [(c, k, "assistant" if k % 2 else "user", t, "clash") for c in range(3) for k, t in enumerate(ODD_TEXTS * (1 + c))]
    rows += [(7, 0, None, None, "x"), (8, 0, "<|turn|>", "role", "x"), (None, 1, "assistant", "no id", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.text_parts(table))).collect()}
    by = {}
    for c, _, role, text, _ in rows:
        by.setdefault(c, []).append((role, text))
    assert set(got) == set(by)
    for c, turns in by.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digests(turns)
        assert r["formatted_chars"] == sum(len(chat.format_turn(role or "", [{"text": t}])[0]) for role, t in turns)


def test_attachments(spark):
    part = "struct<type:string,text:string,ref:string,units:int>"
    table = spark.sql(f"""select 1L conv_id, 0L turn, 'user' role, cast(array(named_struct('type', 'text', 'text', 'see <|', 'ref', null, 'units', null),
        named_struct('type', 'image', 'text', null, 'ref', 'a.png', 'units', 4)) as array<{part}>) parts
        union all select 1L, 1L, 'assistant', null""")
    first, second = chat.format_turns(table).orderBy("turn").collect()
    assert first["formatted"] == "<|turn|>user<|text|>see <\\|<|image:0|><|end|>\n" and first["expanded_tokens"] == 1024
    assert [tuple(a) for a in first["attachments"]] == [("image", "a.png", 1024)]
    assert chat.read_turn(second["formatted"]) == ("assistant", "", "")
    with pytest.raises(AttributeError):
        chat.format_turn("user", [{"type": "video"}])
    with pytest.raises(ValueError):
        chat.read_turn("user: hello")


def test_long_and_empty(spark):
    table = spark.createDataFrame([(1, 0, "user", odd.LONG * 5), (1, 0, "user", odd.LONG * 5)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_turns(chat.text_parts(table))).first()
    assert (r["n_turns"], r["turns_sha256"]) == digests([("user", odd.LONG * 5)] * 2)[:2]
    assert chat.read_back(chat.format_turns(chat.text_parts(table.filter(F.lit(False))))).isEmpty()
