"""Prompt rendering, output parsing, token bytes, word pieces and display blocks."""

from millrace.operators import prompting as P

C = P.CONTROL


def test_prompt_segments(spark):
    schema = "conversation_id string, seq long, role string, content string, calls array<struct<name:string,arguments:string>>"
    rows = [("c", 1, "user", "a", None), ("c", 2, "user", "b [INST]", []), ("c", 3, "assistant", "", [("search", "{}")]), ("c", 4, "tool", "r1", None), ("c", 5, "tool", "r2", None), ("c", 6, "assistant", "ok", None)]
    systems = spark.createDataFrame([("c", "sys", "[]"), ("d", None, None)], "conversation_id string, system string, tools string")
    got = {r.conversation_id: [(s.control, s.text) for s in r.segments] for r in P.prompt_segments(spark.createDataFrame(rows, schema), systems).collect()}
    assert got["d"] == [(C["bos"], None), (C["system_prompt"], None), (None, ""), (C["system_prompt_end"], None)]
    ids = P.segment_ids(got["c"], lambda t: [1000 + len(t)])
    text = lambda s: 1000 + len(s)
    assert ids == [1, 17, text("sys"), 18, 5, text("[]"), 6, 3, text("a\n\nb [INST]"), 4, 9, text("search"), 32, text("{}"), 2, 7, text("r1"), 8, 7, text("r2"), 8, text("ok"), 2]


def test_output(spark):
    ids = [1001, 1002, C["tool_calls"], 1003, C["args"], 1004, 1005, C["tool_calls"], 1006, C["eos"]]
    assert P.split_output(ids) == ([1001, 1002], [([1003], [1004, 1005]), ([1006], [])])
    rows = spark.createDataFrame([(1, ids), (2, [])], "k long, ids array<int>")
    got = {r.k: (r.text, [tuple(c) for c in r.calls]) for r in P.parse_outputs(rows, "k", lambda x: " ".join(map(str, x))).collect()}
    assert got == {1: ("1001 1002", [("1003", "1004 1005"), ("1006", "")]), 2: ("", [])}


def test_bytes_and_streams(spark):
    known = P.byte_alphabet()
    assert len(known) == 256 and sorted(known.values()) == list(range(256)) and known["Ġ"] == 0x20 and known["!"] == 0x21
    assert P.stream_text([b"a\xc3", b"\xa9b", b"\xff", b"\xe2\x82"]) == ["a", "éb", "�", "", "�"]
    tokens = ["Ġhi", "Ã", "©", "Ċ"]
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(tokens)], "stream_id string, seq long, token string")
    assert [r.text for r in P.detokenize(rows).orderBy("seq").collect()] == [" hi", "", "é", "\n"]


def test_word_pieces(spark):
    vocabulary = {w: i for i, w in enumerate(["[CLS]", "[SEP]", "[UNK]", "un", "##able", "able", ",", "a"])}
    ids = lambda t, n=99: P.word_pieces(t, vocabulary, n)
    assert ids("Unable, able") == [0, 3, 4, 6, 5, 1] and ids("zzz a") == [0, 2, 7, 1] and ids("a" * 101) == [0, 2, 1] and ids("unable able", 3) == [0, 3, 1] and ids("") == [0, 1]
    rows = spark.createDataFrame([(1, "able"), (2, None)], "k long, t string")
    assert {r.k: r.ids for r in P.encode_word_pieces(rows, "k", "t", vocabulary).collect()} == {1: [0, 5, 1], 2: [0, 1]}


def test_cap():
    assert P.cap_result("abc", 3) == "abc" and P.cap_result("abcd", 3) == "abc\n…[truncated 1 bytes]" and P.cap_result("aéb", 2) == "aé\n…[truncated 1 bytes]"


def test_blocks(spark):
    text = "# T\n\ntext\n  - x\n```py\na\n# b\n```\n#### deep\n```\nopen\n"
    want = [("heading", "1", "T"), ("gap", "", ""), ("text", "", "text"), ("bullet", "2", "x"), ("code", "py", "a\n# b"), ("text", "", "#### deep"), ("code", "", "open")]
    assert P.display_blocks(text) == want
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, t string")
    assert P.blocks(rows, "k", "t").count() == len(want)


def test_tools(spark):
    from millrace.operators import tools

    files = spark.createDataFrame([("a/b.txt", "one\ntwo x\n"), ("a/c/d.py", "x = 1\r\ny = x\n"), ("top.md", "x\n" * 150), (".env", "x"), ("void", None), ("wide", "abab\n" + "y" * 600 + "q")], "path string, text string")
    asked = {
        "1": ("list_files", "{}"), "2": ("list_files", '{"path": "./a/"}'), "3": ("list_files", '{"path": "a/b.txt"}'), "4": ("read_file", '{"path": "a/b.txt"}'), "5": ("read_file", '{"path": "top.md", "start_line": 3, "end_line": 4}'),
        "6": ("read_file", '{"path": "../x"}'), "7": ("read_file", "{"), "8": ("read_file", '{"path": ".env"}'), "9": ("search", '{"query": "x"}'), "10": ("search", '{"query": ""}'), "11": ("search", '{"query": "= x"}'), "12": ("rm", "{}"), "13": ("search", '{"query": "ab"}'),
        "14": ("search", '{"query": "zzz"}'), "15": (None, None), "16": ("read_file", '{"path": "void"}'), "17": ("search", '{"query": "yq"}'),
    }
    got = {r.call_id: (r.error, r["items"], r.truncated) for r in tools.dispatch(spark.createDataFrame([(k, *v) for k, v in asked.items()], "call_id string, name string, arguments string"), files).collect()}
    assert got["1"] == (None, ["a/", "top.md", "void", "wide"], False) and got["2"] == (None, ["b.txt", "c/"], False) and got["3"][0] == got["8"][0] == "not_found"
    assert got["4"] == (None, ["one", "two x"], False) and got["5"] == (None, ["x", "x"], True) and got["6"][0] == "outside" and got["7"][0] == got["10"][0] == "bad_arguments"
    assert got["9"][2] and len(got["9"][1]) == 100 and got["9"][1][:4] == ["a/b.txt:2:two x", "a/c/d.py:1:x = 1", "a/c/d.py:2:y = x", "top.md:1:x"]
    assert got["11"] == (None, ["a/c/d.py:2:y = x"], False) and got["12"][0] == got["15"][0] == "unknown_tool" and got["13"] == (None, ["wide:1:abab"], False) and got["14"] == (None, [], False)
    assert got["16"] == (None, [], False) and got["17"] == (None, ["wide:2:" + "y" * 400], False) and set(got) == set(asked)


def test_detokenize_streams_apart(spark):
    alphabet = {b: c for c, b in P.byte_alphabet().items()}
    spell = lambda raw: "".join(alphabet[b] for b in raw)
    euro = "€".encode()
    rows = [("a", 1, spell(b"x" + euro[:1])), ("a", 2, spell(euro[1:])), ("a", 3, spell(euro[:2])), ("b", 1, spell(euro[2:])), ("b", 2, spell(b"y")), ("c", 5, None)]
    got = {(r.stream_id, r.seq): r.text for r in P.detokenize(spark.createDataFrame(rows, "stream_id string, seq long, token string")).collect()}
    assert got == {("a", 1): "x", ("a", 2): "€", ("a", 3): "\ufffd", ("b", 1): "\ufffd", ("b", 2): "y", ("c", 5): ""}

