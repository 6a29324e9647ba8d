"""Defects of replies: each rule, the pairing, and both models."""

import numpy as np
import pytest

from millrace.llm import pairs as P
from millrace.llm import refusals
from millrace.llm.language import SEEDS, prose_sentences

SCHEMA = "id string, conversation_id string, seq long, role string, content string, created_at long, meta string, loaded_at timestamp"
CALLS = '{"tool_calls": [{"name": "x"}]}'


@pytest.fixture(scope="module")
def models():
    sentences, labels = [], []
    for code, text in SEEDS.items():
        mine = prose_sentences(text)
        sentences += mine
        labels += [code] * len(mine)
    texts = [f"- The store keeps {i} rows in memory\n- The disk is full again\n- We saw the cache drop it" for i in range(5)] + list(SEEDS.values())
    talk = refusals.fit_talk([prose_sentences(t, 1) for t in texts], lambda t: prose_sentences(t, 1))
    return P.LanguageBayes().fit(sentences, labels), P.EndModel().fit(texts), talk


ASK = "How do I make the prompt builder ignore the old files when the disk is full?"


@pytest.mark.parametrize(
    ("prompt", "reply", "want"),
    [
        (ASK, None, "empty"), (ASK, " ​…", "empty"), (ASK, "```\n```", "empty"), (None, "It keeps the rows in memory.", None),
        (ASK, ASK, "copy"), (ASK, f'"{ASK}"', "copy"), (ASK, f"> {ASK}", "copy"), (ASK, ASK.upper(), "copy"), (ASK, f"You asked: {ASK}", "copy"), (ASK, f"{ASK}\n\n{ASK}", "copy"), (ASK, ASK[:-1], "copy"),
        (ASK, f"> {ASK}\n\nThere are some people who think that it was written by the other team.", None),
        (ASK, "I'm sorry, but I can't help with that.", "refusal"), (ASK, "Thanks for asking about `x`! My instructions don't permit me to give any information on it.", "refusal"),
        (ASK, "I can't reproduce the crash here, but it clearly reads past the end.", None), (ASK, "Sorry for the confusion earlier: it can't return null.", None),
        (ASK, "Das Erste, was du tun solltest, ist sie zu fragen, was sie gesehen haben.", "wrong_language"),
        (ASK + " Please answer in German.", "Das Erste, was du tun solltest, ist sie zu fragen, was sie gesehen haben.", None),
        (ASK + " Please answer in German.", "The first thing that you should do is to ask them what they have seen.", "wrong_language"),
        (ASK, "```py\nx = 1\n", "truncated"), (ASK, "Use this:\n\n```py\nx = 1\n```", None), (ASK, "There are some people who think that nothing has", "truncated"),
        (ASK, "1. There are some people who think so.\n2.", "truncated"), (ASK, "1. There are some people.\n2. We did not know whether", "truncated"),
        (ASK, "- The disk is full again\n- The store keeps 7 rows in memory", None), (ASK, "See core/window_buffer.py", None), (ASK, "Yes.", None), (ASK, "x " * 200_000 + "end.", None),
    ],
)
def test_defects(models, prompt, reply, want):
    assert P.defect_of(prompt, reply, *models) == want


def frame(spark, rows):
    return spark.createDataFrame([(f"m{i}", *r[:4], i, r[4] if len(r) > 4 else None, None) for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("block", [2, 2048])
def test_pairing(spark, block):
    rows = [("c", 1, "user", "a"), ("c", 2, "assistant", "b"), ("c", 3, " Assistant ", "c"), ("c", 4, "assistant", "d", CALLS), ("c", 5, "tool", "e"), ("c", 9, "assistant", "f"), ("c", 12, "user", "g"),
            ("c", 12, "assistant", "h"), ("c", 30, "assistant", "i"), ("d", 1, "assistant", "j"), ("d", None, "user", "k"), (None, 1, "user", "l"), (None, 2, "assistant", "m"), ("e", 1, "user", None), ("e", 2, "assistant", None)]
    got = {(r.reply, r.prompt) for r in P.prompt_pairs(frame(spark, rows), block).collect()}
    assert got == {("b", "a"), ("c", "a"), ("f", "a"), ("h", "a"), ("i", "g"), (None, None)}
    long = [("c", 1, "user", "a")] + [("c", i, "assistant", f"r{i}") for i in range(2, 60)] + [("c", 60, "user", "z")] + [("c", i, "assistant", f"r{i}") for i in range(61, 90)]
    pairs = {r.reply: r.prompt for r in P.prompt_pairs(frame(spark, long), block).collect()}
    assert pairs == {f"r{i}": "a" if i < 60 else "z" for i in range(2, 90) if i != 60}


def test_query_shape_and_empty(spark):
    assert P.defective_pairs(frame(spark, []).limit(0)).count() == 0
    rows = [("c", 1, "user", ASK), ("c", 2, "assistant", ""), ("c", 3, "user", ASK), ("c", 4, "assistant", ASK)]
    assert {(r.message_id, r.defect) for r in P.defective_pairs(frame(spark, rows)).collect()} == {("m1", "empty"), ("m3", "copy")}


def test_refusals_that_no_seed_holds(models):
    talk = models[2]
    said = {"I won't be able to help you with that request.": True, "Das darf ich leider nicht beantworten.": True, "Je ne peux pas vous répondre.": True, "No puedo hablar de esa petición.": True,
            "The server refuses the request because the token is old.": False, "We can't read the file while the disk is full.": False, "Thank you for the question.": False, "Yes.": False}
    assert dict(zip(said, P.refused([[s] for s in said], talk))) == said
    assert P.refused([["I can't help with that.", "The cache keeps old rows in memory."], ["Thanks for asking.", "I can't help with that."], []], talk) == [False, True, False]


def test_short_sentences_are_learnt_by_their_company():
    english = prose_sentences(SEEDS["en"])
    runs = [[english[i : i + 1], ["No, it is privato."], english[i + 1 : i + 2]] for i in range(6)]
    text = P.text_scores([["No, it is privato."], english[:2]], P.fit_languages(runs))
    assert not P.in_other_language(None, text[1], text[0])
    alone = P.text_scores([prose_sentences(SEEDS["it"])[:2]], P.fit_languages(runs))[0]
    assert P.in_other_language(None, text[1], alone) and P.in_other_language("fr", text[1], text[1]) and not P.in_other_language(None, text[1] * 0, alone)


def test_asked_language_in_a_long_sentence():
    filler = "the part of the service that keeps sessions open while it waits for the queue, " * 5
    assert len(filler) > 200
    assert P.asked_language(f"Please read {filler}and then answer in French so that the team can follow.") == "fr"
    assert P.asked_language(f"Answer in German, {filler}please.") == "de" and P.asked_language("Answer in French.") == "fr"
    assert P.asked_language(f"Please read {filler}and answer.") is None


def test_long_messages_are_learnt_from_too(spark):
    """How items of this list end is only said in a message of over 4,000 characters."""
    item = "The queue holds the session"
    long = "\n".join(f"- {x}" for x in [item, *(f"Line number of the list {'x' * (i % 40)} is here" for i in range(120))])
    rows = [("a", 1, "user", ASK), ("a", 2, "assistant", long + "."), ("b", 1, "user", ASK), ("b", 2, "assistant", f"We saw it. {item}")]
    assert len(long) > 4000
    found = {r.message_id: r.defect for r in P.judge_pairs(frame(spark, rows)).collect()}
    assert found == {"m1": None, "m3": None}


def test_spread_fits_are_the_plain_ones(spark):
    texts = [[s, *prose_sentences(SEEDS[c])[:2]] for c in ("en", "de", "fr", "it") for s in ("No, it is privato.", "Das ist xyz.", *prose_sentences(SEEDS[c])[2:6])]
    rows = [("c", i, "assistant" if i % 2 else "user", "\n".join(x)) for i, x in enumerate(texts * 3)] + [(None, None, "user", "Null and void it is."), ("c", 3, "user", "-")]
    messages = frame(spark, rows).repartition(3)
    read = P.read_messages(messages)
    runs = {}
    for r in read.collect():
        for spot, said in zip(r.spots, P._unpacked(r.said)):
            runs.setdefault(spot, []).append(said)
    assert len(runs) > 3 and np.allclose(P.fit_languages_of(read).log, P.fit_languages(list(runs.values())).log)
    replies = spark.createDataFrame([(x,) for run in runs.values() for x in run], "said array<string>")
    split = lambda t: prose_sentences(t, 1)
    extra = spark.createDataFrame([(["I really cannot help you with that.", "I am sorry."],), (["Thank you.", "I must refuse that wish."],), (["I am sorry, but I cannot help you with this."],), ([],)], "said array<string>")
    plain, spread = (refusals.fit_talk_of(replies.union(extra), split, 3, here).weights for here in (100, 0))
    assert np.abs(plain).max() > 0.1 and np.allclose(plain, spread, atol=1e-5)


def test_chances_of_ends_are_those_of_the_model(spark):
    replies = ["- The store keeps 5 rows in memory\n- The disk is full\n- Yes\n- We saw it", "The disk is full. The disk is full again! A.\n- B\n- ok it", "We saw the cache drop it. Nobody knows when the disk is full or not.", "🙂 The cache. 日本語です。 Ja"]
    ends = P.EndModel().fit(replies)
    runs = [(run, closed) for x in replies * 2 for run, closed in P.EndModel.runs(x)]
    parts = ["The disk is full", "We saw the cache drop", "is full again", "A", "B", "ok", "We saw it", "🙂 The cache", "Nobody knows when the disk is full or", "never met", "A disk is full", "Yes", "in memory", "日本語です", "Nobody knows", "The store keeps 7 rows in memory"]
    got = {r.part: r.chance for r in P.end_chances(spark.createDataFrame([(x,) for x in parts], "part string"), spark.createDataFrame(runs, "run string, closed boolean")).collect()}
    assert got == {x: ends.likelihood(x) for x in parts} and {0.0, 1.0, None} <= set(got.values()) and any(x and 0 < x < 1 for x in got.values())
