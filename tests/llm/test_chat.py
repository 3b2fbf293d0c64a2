import hashlib
import random

from spanlight.llm import bpe, chat

PARTS = [*chat.MARKS, "\\", "[", "]", "INST", "/", "<|endoftext|>", "a", " b", "\n", "é", "😀", "<", ">", "s"]


def test_escape_is_reversible_and_leaves_no_mark():
    template = chat.Template(bpe.byte_pairs(bpe.vocabulary_path()))
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
        escaped = template.escape(text)
        assert template.unescape(escaped) == text
        assert not any(m in escaped for m in (*chat.MARKS, "<|endoftext|>"))


def expected(rows):
    turns = "".join(f"{r}\n{t}\n" for r, t in rows)
    loss = "".join(t for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query_reads_back(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randint(1, 6)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool<s>", None]), text, "x"))
    rows.append((99, 0, "assistant", "long " * 30_000, "x"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string").repartition(5)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op8_chat(spark, str(tmp_path)).collect()}
    convs = {}
    for c, _, role, text, _ in rows + [(*p, None) for p in chat.PLANTED]:
        convs.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(turns)
        assert r.formatted_chars >= sum(len(t) for _, t in turns)


def test_masks_starts_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi there"), (1, 1, "assistant", "fine, thanks"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_turns(df).collect(), key=lambda r: r.position)
    pairs = bpe.byte_pairs(bpe.vocabulary_path())
    assert [r.start for r in rows] == [0, len(rows[0].token_ids), len(rows[0].token_ids) + len(rows[1].token_ids)]
    assert not any(rows[0].loss_mask) and not any(rows[2].loss_mask)
    assert pairs.decode([k for k, m in zip(rows[1].token_ids, rows[1].loss_mask) if m]) == "fine, thanks"
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0
