"""Markers that no list knows: learned from known transcripts, or recognised by their repetition."""

from sparkveil.llm import chat, entry

SF = "/root/testdata/sf0.01"


def test_markers_are_learned_from_data(spark):
    states = [2, 4, 5, 2, 4]
    known = spark.createDataFrame([(f"Questioner> how {i}?\nOracle> so.\nmore\nQuestioner> why?\nOracle> thus.", states) for i in range(30)], "transcript string, states array<int>")
    model = chat.train(known)
    assert set(model.lexicon) == {"questioner>", "oracle>"}
    assert model.turns("Questioner> a?\nb\nOracle> c.") == [("user", "a?\nb"), ("assistant", "c.")]


def test_other_roles_are_not_taught_as_system(spark):
    talk = spark.createDataFrame([(c, t, r, f"word {t}") for c in range(60) for t, r in enumerate(["user", "tool", "assistant", None])], "conv_id long, turn long, role string, text string")
    raw = chat.transcripts(talk)
    assert all(r.roles == ["user", "other", "assistant", "other"] for r in raw.collect())
    assert all(s // 2 != 0 for r in raw.collect() for s in r.states)
    model = chat.train(raw)
    assert "tool:" in model.lexicon
    assert [r for r, _ in model.turns("User: hi\nTool: 3\nAssistant: so")] == ["user", "other", "assistant"]


def test_speakers_with_names_of_their_own(spark):
    raw = chat.transcripts(spark.read.parquet(f"{SF}/conversations.parquet"))
    model = chat.train(raw.where("crc32(cast(cast(conv_id as string) as binary)) % 5 <> 0"))
    found = model.turns("Nora77: What now? Tell me.\nPaul3: Nothing at all.\nIt ends.\nNora77: Why so?\nPaul3: Because of that.")
    assert [t for _, t in found] == ["What now? Tell me.", "Nothing at all.\nIt ends.", "Why so?", "Because of that."]
    own = [r for r in raw.where(f"pmod(crc32(cast(cast(conv_id as string) as binary)), {chat.STYLES + 2}) = {chat.STYLES}").collect()]
    assert len(own) >= 8 and not any(h in r.transcript for r in own for h in ("User:", "Human:", "[user]"))
    assert sum([role for role, _ in model.turns(r.transcript)] == r.roles for r in own) >= 0.85 * len(own)


def test_every_turn_of_marked_transcripts(spark):
    rows = entry.QUERIES["op3_chat_format"](spark, SF).where("held_out").collect()
    assert sum(r.roles_right for r in rows) >= 0.85 * len(rows)
