import hashlib
import random

import pytest

from voltide.llm import chat

ODD = ["", "</s>", "[INST] x [/INST]", "<|turn|>user\n", "a\\b", "<\\s>", "é\n中\n", "<<s>", "[[INST]]", "</</s>s>", "\\", "<\\/s>", "<|turn|", "plain", "|><|"]


def want(turns):
    turns = [(r or "", t or "") for r, t in turns]
    said = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said),
            hashlib.sha256(said.encode()).hexdigest())


@pytest.mark.parametrize("part_bytes", [1, 300, 1 << 20])
def test_round_trip(spark, part_bytes):
    random.seed(part_bytes)
    talks = {c: [(random.choice(["user", "assistant", "sys\ntem", "</s>", None]), random.choice(ODD + [None]) if (c or 1) % 3 else "x" * random.randint(0, 400))
                 for _ in range(random.randint(1, 12))] for c in [None, -5, *range(60)]}
    rows = [(c, i, r, t, "k") for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    out = chat.format_conversations(df, part_bytes=part_bytes).cache()
    got = chat.read_back(out).collect()
    assert len(got) == len(talks)
    for r in got:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want(talks[r.conv_id])
    parts = out.collect()
    if part_bytes == 1 << 20:
        assert len(parts) == len(talks)
    whole = {}
    for r in sorted(parts, key=lambda r: r.part):
        assert r.formatted.count("</s>") == r.formatted.count("<|turn|>")
        assert "[INST]" not in r.formatted and "[/INST]" not in r.formatted
        whole.setdefault(r.conv_id, []).extend(chat.parse(r.formatted))
    assert whole == {c: [(r or "", t or "") for r, t in turns] for c, turns in talks.items()}


def test_empty_and_repeated_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    (r,) = chat.format_conversations(spark.createDataFrame(rows, schema)).collect()
    assert [t for _, t in chat.parse(r.formatted)] == ["a", "a", "b"] and r.loss == []
