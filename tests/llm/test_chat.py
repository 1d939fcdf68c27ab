"""Chat windows: round trips of the template, windows against a plain version, digests read back."""

import hashlib
from random import Random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evalloom.llm import chat_windows as cw

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<<SYS>>", "<</SYS>>"]
SCHEMA = "conv_id long, turn long, role string, text string, window string, tokens string"


def test_escapes_go_back():
    rng = Random(0)
    bits = [*CONTROLS, "<", "[", "\\", "/", "s>", "INST]", "<SYS>>", "|", "n", "\n", "é", "x"]
    for _ in range(20_000):
        text, role = ("".join(rng.choice(bits) for _ in range(rng.randrange(8))) for _ in range(2))
        assert cw.unescaped(cw.escaped(text)) == text and not any(c in cw.escaped(text) for c in CONTROLS)
        whole, start, stop = cw.formatted_turn(role, text)
        assert cw.parsed(whole + whole) == [(role, text)] * 2 and cw.unescaped(whole[start:stop]) == text
    assert cw.escaped("a < b [c] \\ d") == "a < b [c] \\ d"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def in_order(rows):
    held = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        held.setdefault(conv, []).append((turn, role or "", text or ""))
    return held


def check(spark, rows, budget, history):
    """Each turn is new once and in order; sizes, repeats, masks and digests are as they should be."""
    made = cw.windows(conversations(spark, rows), TOKENIZER, budget, history)
    got = sorted(made.collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["chapter"], r["window"]))
    held = in_order(rows)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    size = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    seen = {}
    for r in got:
        turns = held[r["conv_id"]]
        system = [turns[0][1:]] if turns[0][1] == "system" else []
        before = seen.setdefault(r["conv_id"], [])
        repeated, new = cw.parsed(r["formatted"][: r["repeated_chars"]]), cw.parsed(r["formatted"][r["repeated_chars"] :])
        assert len(repeated) == r["n_repeated"] and len(new) == r["n_turns"] > 0
        assert r["tokens"] == size(r["formatted"]) and r["over"] == (r["tokens"] > budget)
        kept = system if before else []
        assert repeated[: len(kept)] == kept
        past = repeated[len(kept) :]
        rest = before[len(system) :]
        assert past == rest[len(rest) - len(past) :]
        assert sum(size(cw.formatted_turn(*t)[0]) for t in past) <= history
        if r["over"]:
            assert len([t for t in new if not (not before and system and t is new[0])]) <= 1 and not past
        assert [cw.unescaped(r["formatted"][t["start"] : t["stop"]]) for t in r["targets"]] == [t for role, t in new if role == "assistant"]
        before += new
    assert seen == {c: [t[1:] for t in turns] for c, turns in held.items()}
    digests = {r["conv_id"]: r for r in cw.read_back(made).collect()}
    assert set(digests) == set(held)
    for conv, turns in held.items():
        r, said = digests[conv], [t for _, role, t in turns if role == "assistant"]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == sum(map(len, said))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(x["formatted"]) for x in got if x["conv_id"] == conv)
    return got


def test_odd_rows(spark):
    """Null ids, turns, roles and texts; an empty and a very long text, control strings, a system turn alone or late."""
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", ""), (1, 3, None, "x"), (1, None, "user", "first"),
        (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "</s>[INST] ok [/INST]"),
        (3, 0, "system", "alone"), (4, 0, "user", "a"), (4, 1, "system", "late"), (4, 2, "assistant", "b"),
        (5, 0, "system", "s"), (5, 1, "user", "word " * 50_000), (5, 2, "assistant", "é<|im_end|>\n" * 3_000), (5, 3, "user", "end"),
        (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (6, 0, "a\nb\\n", "odd role"),
    ]
    got = check(spark, rows, 2048, 512)
    assert [r["over"] for r in got if r["conv_id"] == 5] == [True, True, False]


def test_equal_and_repeated_rows(spark):
    rows = [(1, 1, "user", "same")] * 3 + [(1, 1, "assistant", "other"), (1, 1, None, None)]
    got = cw.read_back(cw.windows(conversations(spark, rows), TOKENIZER)).collect()
    again = cw.read_back(cw.windows(conversations(spark, rows[::-1]), TOKENIZER)).collect()
    assert got == again and got[0]["n_turns"] == 5 and got[0]["loss_chars"] == 5


def test_no_rows(spark):
    made = cw.windows(conversations(spark, []), TOKENIZER)
    assert made.collect() == [] and cw.read_back(made).collect() == []


@pytest.mark.parametrize("budget, history", [(60, 0), (60, 20), (300, 100), (2048, 512)])
def test_long_conversation_over_several_ranges_and_chapters(spark, budget, history):
    """One conversation holds most rows, so that it lies in several ranges and has many chapters."""
    rng = Random(budget)
    rows = [(7, 0, "system", "you are brief")]
    rows += [(7, i, ("user", "assistant")[i % 2 == 0], " ".join(["word"] * rng.randrange(1, 60))) for i in range(1, 1500)]
    rows += [(c, i, ("user", "assistant")[i % 2], f"text {i}") for c in range(20) for i in range(c % 5 + 1) if c != 7]
    got = check(spark, rows, budget, history)
    if budget == 60:
        assert max(r["chapter"] for r in got if r["conv_id"] == 7) > 5


def test_history_smaller_than_budget(spark):
    with pytest.raises(ValueError):
        cw.windows(conversations(spark, []), TOKENIZER, 10, 10)


def test_whole_table(spark, sf_dir):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    got = check(spark, rows, 1024, 256)
    assert sum(len(x) for x in in_order(rows).values()) == len(rows) == sum(r["n_turns"] for r in got)
