import hashlib
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quantloom.llm import chat, queries

RECORDS = [
    ({"role": "user", "text": "hi"}, "turn", [("user", "hi")]),
    ({"role": "tool", "content": None, "id": 7}, "message", [("tool", "")]),
    ({"from": "gpt", "value": 3.5}, "speech", [("assistant", "3.5")]),
    ({"message": {"author": {"role": "user"}, "content": {"parts": ["a", "", "b"]}}}, "export", [("user", "a\n\nb")]),
    ({"assistant": "x"}, "speakers", [("assistant", "x")]),
    ({"user": "q", "system": "s", "meta": {"k": [1]}}, "speakers", [("system", "s"), ("user", "q")]),
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "text", "text": "r"}]}]}, "message_parts", [("user", "q\n\nr")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a", "weight": 0}]}, "conversations", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "completion": "a"}, "prompt_completion", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": "a", "system": "s"}, "prompt_response", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"question": "q", "answer": "a", "score": 1}, "question_answer", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "q", "input": "about", "output": "a"}, "instruction", [("user", "q\n\nabout"), ("assistant", "a")]),
    ({"instruction": "q", "input": "", "output": ""}, "instruction", [("user", "q"), ("assistant", "")]),
    ({"instruction": "q", "output": "a"}, "instruction", [("user", "q"), ("assistant", "a")]),
    # none of the layouts
    ({"messages": []}, None, []),
    ({"a.b": 1, "messages[]": {"role": 1}}, None, []),
    ({"prompt": "q"}, None, []),
    ([1, 2], None, []),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(100, None), (101, "{broken"), (102, '{"role": "user", "text": "\\ud800x"}'), (0, json.dumps(RECORDS[0][0]))]
    df = spark.createDataFrame(rows, "id long, record string").withColumns({"text": F.lit("old"), "a b": F.col("id")})
    out = chat.canonical(df).orderBy("id", "place").collect()
    got = defaultdict(list)
    for r in out:
        assert r["a b"] == r.id
        got[r.id].append(r)
    for i, (_, layout, turns) in enumerate(RECORDS):
        mine = got[i]
        assert {r.layout for r in mine} == {layout}
        if i == 0:  # is there twice
            assert len(mine) == 2 and {(r.role, r.text) for r in mine} == {("user", "hi")}
        elif turns:
            assert [(r.place, r.role, r.text) for r in mine] == [(k, *t) for k, t in enumerate(turns)]
        else:
            assert [(r.place, r.role, r.text) for r in mine] == [(None, None, None)]
    assert [(r.fingerprint, r.layout) for r in got[100] + got[101]] == [(None, None)] * 2
    assert got[102][0].text == "�x"
    assert got[6][0].fingerprint != got[8][0].fingerprint and len(got[6][0].fingerprint) == 16


def test_layouts_must_differ():
    with pytest.raises(ValueError, match="told apart"):
        chat.Mappings((*chat.LAYOUTS, chat.Layout("other", ("text", "role"), (chat.Turn(("text",), "role"),))))


def test_overlapping_controls_are_refused():
    for bad in (("<<a>", "<a>"), ("<a<", "<b>"), ("<a\\>",), ("<",)):
        with pytest.raises(ValueError):
            chat.Template(controls=bad)


def noise(rng):
    parts = [*chat.Template().controls, "<", "[", "\\", "\\\\", "s>", "INST]", "\n", "\\n", "ü", "😀", "a", " ", "|im_end|>", "/s>", "<\\s>", "\x00", " "]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))


def test_every_text_comes_back(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(["user", "assistant", None, noise(rng)]), rng.choice([None, "", noise(rng), noise(rng)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, role string, text string").withColumns({"mask_start": F.lit("x"), "formatted": F.lit("y")})
    t = chat.Template()
    made = chat.formatted(df, t).select("id", "formatted", "mask_start", "mask_end")
    out = made.withColumns({"r": chat.role_of(t), "t": chat.text_of(t), "l": chat.learned(t)}).collect()
    assert len(out) == len(rows)
    for x in out:
        _, role, text = rows[x.id]
        assert (x.r, x.t) == (role or "", text or "")
        assert x.l == (text or "" if role == "assistant" else None)
        inner = x.formatted.removeprefix(t.begin).removesuffix(t.end)
        assert inner != x.formatted and not any(c in inner for c in t.controls)
        if role == "assistant":
            assert x.formatted[: x.mask_start] == t.begin + "assistant\n" and x.formatted[x.mask_end :] == t.end


def test_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randint(0, 40), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "human", None, "tool\n"]), rng.choice([None, "", noise(rng)])) for _ in range(300)]
    rows = list({r[:2]: r for r in rows}.values())  # no ties
    rows += [(77, k, "assistant", f"turn {k} [INST]") for k in range(3000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    convs = defaultdict(list)
    for c, k, role, text in [*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        convs[c].append((k is not None, k or 0, role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, t in convs.items():
        t.sort()
        loss = "".join(x[3] for x in t if x[2] == "assistant")
        want[c] = (len(t), digest("".join(f"{x[2]}\n{x[3]}\n" for x in t)), len(loss), digest(loss))
    found = queries.op13_chat_format(spark, str(tmp_path)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == want
    one = next(r for r in found if r.conv_id == -1)
    assert one.formatted_chars == len("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n") + 2 * (len(said) + 3)
