"""Splitting, encoding, packing, languages and source files on small fixtures."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.llm import langid, language, packing, sourcefiles, splitting, tokens

TEXTS = [None, "", " ", "\n\n", "hello world", "the same text again " * 400, "the same text again " * 400, "naïve ☃ 日本語のテキストです。" * 300, "x" * 50_000, " " * 20_000 + "y", "a  b c\t\n d" * 500, "<|endoftext|> is text", "can't won't I'll " * 200]


def documents(spark, texts=TEXTS, start=0):
    return spark.createDataFrame([(start + i, t, "en", "key") for i, t in enumerate(texts)], "doc_id long, text string, lang string, key string")


# Encoding.
def test_encoding_is_exact(spark):
    encode = tokens.encoder().encode_ordinary
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(documents(spark)).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert got[i] == (encode(text) if text else [])


def test_encoding_matches_the_other_library():
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(tokens.vocabulary_dir() + "/byte_bpe_50k.json")
    reader.encode_special_tokens = True
    for text in TEXTS[4:7] + TEXTS[10:]:
        assert tokens.encoder().encode_ordinary(text) == reader.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab '\n\t 1.é日 　​"), max_size=3000), st.integers(1, 6))
def test_chunks_rejoin(text, times):
    encode = tokens.encoder().encode_ordinary
    raw = (text * times).encode()
    parts = tokens.chunk_bytes(raw, encode) if raw else []
    assert b"".join(parts) == raw and [i for p in parts for i in encode(p.decode())] == encode(raw.decode())


def test_equal_chunks_are_shared():
    encode = tokens.encoder().encode_ordinary
    rng = np.random.default_rng(0)
    words = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"], 9)) + f" {i}." for i in range(400)]
    long = "\n".join(words).encode()
    a, b = tokens.chunk_bytes(long, encode), tokens.chunk_bytes(b"A new start. " + long, encode)
    assert len(set(a) & set(b)) >= len(a) - 2 and len(a) > 5


def test_encoding_empty_table(spark):
    assert tokens.encode_corpus(documents(spark).limit(0)).count() == 0


# Packing.
def test_packing(spark):
    rows = packing.pack_documents(documents(spark, TEXTS * 8), capacity=512).collect()
    sizes, encode = {}, tokens.encoder().encode_ordinary
    for r in rows:
        sizes[r.container] = sizes.get(r.container, 0) + r.size
        assert 0 <= r.size <= 512
    assert max(sizes.values()) <= 512
    for i, text in enumerate(TEXTS * 8):
        mine = sorted((r.piece, r.size) for r in rows if r.doc_id == i)
        n = len(encode(text)) if text else 0
        assert sum(s for _, s in mine) == n and [p for p, _ in mine] == list(range(max(1, -(-n // 512))))
        assert all(s == 512 for _, s in mine[:-1])
    assert packing.pack_documents(documents(spark).limit(0)).count() == 0


def test_containers_are_full(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], int(n))) for n in rng.integers(20, 900, 900)]
    rows = packing.pack_documents(documents(spark, texts), capacity=1024).groupBy("container").agg(F.sum("size").alias("size")).collect()
    assert len({r.container for r in rows}) == len(rows) and sum(r.size for r in rows) / (1024 * len(rows)) > 0.95


def test_hilbert_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = grid[np.argsort(packing.hilbert_key(grid, 3))]
    assert len(set(packing.hilbert_key(grid, 3))) == 512 and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# Splitting.
CODE = "\n".join(f"def step_{i}(value):\n    total = value * {i}\n    return total\n" for i in range(60))


def test_splitting_limits_and_cover(spark):
    wide = "a;" * 4000
    mixed = CODE + "\n" + wide + "\r\n" + CODE
    texts = {1: CODE, 2: wide, 3: mixed, 4: "short", 5: None, 6: "", 7: "é" * 1200, 8: "é" * 1201, 9: "x\n" * 60, 10: "x\n" * 61, 11: "x\r\n" * 61, 12: CODE}
    files = spark.createDataFrame([(k, v, "x") for k, v in texts.items()] * 2, "file_id long, text string, piece string")
    rows = splitting.split_oversized(files).collect()
    assert {r.file_id for r in rows} == {1, 2, 3, 8, 10, 11, 12}
    assert {(r.file_id, r.cut) for r in splitting.oversized_cuts(files).collect()} == {(1, "between_lines"), (2, "inside_line"), (3, "inside_line"), (8, "inside_line"), (10, "between_lines"), (11, "between_lines"), (12, "between_lines")}
    for key in (1, 3, 10, 11):
        lines = texts[key].replace("\r\n", "\n").rstrip("\n").split("\n") if key != 1 else CODE.rstrip("\n").split("\n")
        mine = sorted((r.piece, r.start_line, r.end_line, r.content, r.cut) for r in rows if r.file_id == key)
        covered = set()
        for (_, first, last, content, cut), (_, following, *_rest) in zip(mine, mine[1:] + [(0, len(lines) + 1)]):
            assert last - first < 60 and len(content.encode()) <= 2400
            covered |= set(range(first, last + 1))
            assert following <= last + 1 and following >= last + 1 - 8
            if cut == "between_lines":
                assert content == "\n".join(lines[first - 1 : last])
        assert covered == set(range(1, len(lines) + 1))


def test_overlap_around_long_lines():
    lines = [f"line {i}" for i in range(1, 71)] + ["word " * 1000 + "end"] + [f"line {i}" for i in range(72, 200)]
    pieces = splitting.split_text("\n".join(lines))
    inside = [p for p in pieces if p[3]]
    first, after = inside[0], inside[-1]
    assert first[:2] == (67, 71) and first[2].startswith("line 67\nline 68\nline 69\nline 70\nword word")
    assert after[0] == 71 and after[1] > 72 and after[2].split("\n")[0] == lines[70][-64:] and after[2].split("\n")[1:3] == ["line 72", "line 73"]
    assert max(p[1] - p[0] for p in pieces) < 60 and max(len(p[2].encode()) for p in pieces) <= 2400
    plain = [p for p in splitting.split_text("\n".join(lines), overlap=0) if p[3]]
    assert {p[:2] for p in plain} == {(71, 71)}


def test_every_piece_has_something_new():
    lines = ["a" * 300, "b" * 300, "c" * 300, "d" * 2300, "e"] * 9
    spans = [(a, b) for a, b, _, _ in splitting.split_text("\n".join(lines))]
    assert all(y[1] > x[1] for x, y in zip(spans, spans[1:])) and spans[-1][1] == len(lines)


def test_depth_does_not_depend_on_slices(monkeypatch):
    lines = CODE.split("\n")
    whole = splitting.cohesion_depth(lines)
    monkeypatch.setattr(splitting, "SLICE", 7)
    assert np.allclose(whole, splitting.cohesion_depth(lines))


def test_pieces_are_better_than_blind_cuts():
    """The words of neighbouring pieces overlap less at the cuts made than at cuts a few lines off."""
    rng = np.random.default_rng(4)
    topics = [[f"{a}{b}" for b in ("ing", "ers", "ed", "ful", "ness")] for a in ("load", "pack", "sort", "trim", "fold", "hash", "scan", "join")]
    lines = [" ".join(rng.choice(topics[int(t)], 6)) for t in rng.integers(0, 8, 40) for _ in range(int(rng.integers(8, 30)))]

    def likeness(cut):
        a, b = set(" ".join(lines[max(cut - 5, 0) : cut]).split()), set(" ".join(lines[cut : cut + 5]).split())
        return len(a & b) / max(len(a | b), 1)

    cuts = [b for _, b, _, _ in splitting.split_text("\n".join(lines), overlap=0)][:-1]
    assert np.mean([likeness(c) for c in cuts]) < 0.3 * np.mean([likeness(c + d) for c in cuts for d in (-9, 9)])


def test_two_texts_of_one_id(spark):
    rows = [(1, "x\n" * 70), (1, "y" * 3000), (1, "x\n" * 70), (2, "a\n\n" * 40 + "\n")]
    got = splitting.oversized_cuts(spark.createDataFrame(rows, "file_id long, text string")).collect()
    assert sorted((r.file_id, r.cut) for r in got) == [(1, "between_lines"), (1, "inside_line"), (2, "between_lines")]


def test_long_line_pieces_cover():
    for line in ("word " * 2000, "é" * 5000, "ab" * 9000):
        spans = splitting._inside(line, 2400)
        assert spans[0][0] == 0 and spans[-1][1] == len(line) and all(a < b and len(line[a:b].encode()) <= 2400 for a, b in spans)
        assert all(nxt[0] <= cur[1] and nxt[0] > cur[0] for cur, nxt in zip(spans, spans[1:]))


def test_cuts_fall_between_topics():
    one, two = "\n".join(["apple pear plum fruit basket"] * 40), "\n".join(["motor engine wheel brake clutch"] * 40)
    assert splitting.split_text(one + "\n" + two, overlap=0)[0][1] == 40


# Languages.
def test_labels(spark):
    said = {"en": "en", "EN-us": "en", "deu": "de", "German": "de", "fr_CA": "fr", " pt ": "pt", "": None, "xx": None, "n/a": None, "utf-8": None, None: None, "JA": "ja"}
    rows = spark.createDataFrame([(k,) for k in said], "lang string").select("lang", language.language_of_label(F.col("lang")).alias("x")).collect()
    assert {r.lang: r.x for r in rows} == said


def test_prose_leaves_code_out():
    text = "# readConfig\n\nThe cache keeps old rows in memory. Siehe `x_y`.\n\n```\n[06:05] WARN nicht gefunden und das ist nicht gut\n```\nutil/a_b.py:12\ncommit 0a1b2c3d4e5f60718293\n"
    assert prose(text) == ["The cache keeps old rows in memory."]


def prose(text):
    return [s.strip() for s in language.prose_sentences(text)]


def test_seed_model_knows_its_languages():
    model = langid.Machines().fit(*langid.seed_sentences())
    fresh = {"en": "Some of the people were here when we came back from there.", "de": "Wir haben nicht gewusst, dass die anderen noch nicht fertig sind.", "nl": "Wij hebben niet geweten dat de anderen nog niet klaar zijn.",
             "fr": "Nous ne savons pas pourquoi les autres sont déjà partis.", "es": "No sabemos por qué los otros ya se han ido de aquí.", "it": "Non sappiamo perché gli altri sono già andati via.", "pt": "Não sabemos porque é que os outros já foram embora.", "ru": "Мы не знаем, почему другие уже ушли.", "ja": "なぜ他の人がもう帰ったのか分かりません。"}
    assert dict(zip(fresh, model.judge(list(fresh.values()))[0])) == dict(zip(fresh, fresh))


def test_documents_and_segments(spark):
    de, fr = language.SEEDS["de"], language.SEEDS["fr"]
    rows = [(1, language.SEEDS["en"], "English"), (2, de, "en"), (3, de + "\n\n" + fr, "de"), (4, None, "en"), (5, "  ", "en"), (6, "x = 1", None), (7, fr, None), (8, language.SEEDS["en"] + " Nous ne savions pas si ce serait assez.", "en"), (9, "﻿", "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang) for r in langid.mislabelled(table).collect()} == {(2, "de"), (3, "de"), (3, "fr"), (7, "fr")}
    segments = [(r.segment, r.lang, r.first_line, r.last_line) for r in langid.language_segments(table).where("doc_id = 3").orderBy("segment").collect()]
    assert segments == [(0, "de", 1, 1), (1, "fr", 3, 3)]
    assert langid.mislabelled(table.limit(0)).count() == 0


def test_short_texts_have_a_language(spark):
    rows = [(1, "Guten Tag. Bis bald.", "en"), (2, "Vielen Dank!", None), (3, "Thank you.", "en"), (4, "foo(bar);", "en"), (5, "x = 1", None), (6, "12:30", "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.document_languages(table).collect()} == {1, 2, 3}
    assert 2 in {r.doc_id for r in langid.mislabelled(table).collect()}


def test_sentences_know_their_lines():
    text = "Where is the file?\r\n\r\n```py\nx = 1\ny = 2\n```\nThe file is not here. It was moved away.\n`a b` ```c``` We will look for it."
    assert [(n, s.strip()) for n, s in language.numbered_sentences(text)] == [(1, "Where is the file?"), (7, "The file is not here."), (7, "It was moved away."), (8, "We will look for it.")]


# Source files.
def test_notices():
    said = lambda t: sourcefiles.notices(t)[:2]
    assert said("// Code generated by x. DO NOT EDIT.\n\nint a;\n") == (True, False) and said("int a;\n\n// Generated by x from y. Don't modify by hand.\n")[0]
    assert said("# writes the line 'DO NOT EDIT' into what it makes\nx = 1\n") == (False, False) and not said("x = 1\n\n# do not edit the output, edit this generator\n")[0]
    assert not said("x = 1\n# not generated: keep it readable\n")[0] and not said('HEADER = "# Code generated by {name}. DO NOT EDIT."\nx = 1\n')[0]
    assert said("// Copyright (c) 2012 the abc authors.\nint a;\n") == (False, True) and said("// Copyright (c) 2025 the authors of this project.\n// See LICENSE at the root.\nint a;\n") == (False, False)
    tool, others, body = sourcefiles.notices("/*! abc v2.1 | (c) 2019 abc contributors | BSD-3-Clause */ function a(b){return b}")
    assert others and tool and body.strip().startswith("function")


def test_notices_beyond_long_headers():
    licence = "".join(f"// Licence line {i}.\n" for i in range(30))
    assert sourcefiles.notices(licence + "// Code generated by x. DO NOT EDIT.\nint a;\n") == (True, False, "int a;")
    assert sourcefiles.notices("int a;\n// Generated by x from y.\n" + licence) == (True, False, "int a;")
    block = "/* a header\n" + "   of many lines\n" * 20 + "   Generated by x, do not edit */"
    assert sourcefiles.notices(block + " int a;\n") == (True, False, " int a;") and sourcefiles.notices("int a;\n" + block) == (True, False, "int a;")
    assert sourcefiles.notices("<!--\nGenerated by x.\n-->\n<p>a</p>") == (True, False, "<p>a</p>")
    assert sourcefiles.notices("/* never closed\nint a;\n")[2] == "int a;" and sourcefiles.notices("int a; /* b\n c */\n")[2] == "int a; /* b\n c */"
    assert sourcefiles.notices("/*\n" * 3 + "// a\n") == (False, False, "")


def test_foreign_files(spark):
    hand = [f"def work_{i}(items):\n    # keep the order of the items\n    out = []\n    for item in items:\n        out.append(item.name_{i})\n    return out\n\n\nclass Holder{i}:\n    def read(self, path):\n        with open(path) as source:\n            return source.read()\n" for i in range(40)]
    lib = "\n".join(f"def lib_{i}(alpha, beta):\n    gamma_{i} = alpha[{i}] + beta.delta_{i * 7}\n    return gamma_{i}\n" for i in range(30))
    made = ["# Code generated by tool. DO NOT EDIT.\n" * (i % 2) + "\n".join(f"FIELD_{i}_{j} = _descriptor.Field(name='f{j}', number={j})" for j in range(40)) for i in range(20)]
    data = "TABLE = [\n" + "\n".join(", ".join(str(j * 0.37) for j in range(20)) + "," for _ in range(10)) + "\n]\n"
    rows = [(i, f"src/m{i}.py", t) for i, t in enumerate(hand)] + [(100, "lib/other.py", "x = 1\n" + lib.replace("gamma_3", "other_3")), (101, "src/table.py", data), (102, "docs/a.md", lib), (103, "a.py", None), (104, "b.py", ""), (105, "c.py", "﻿"), (106, None, "# Code generated by x. DO NOT EDIT.\na = 1\n")]
    rows += [(200 + i, f"src/g{i}.py", t) for i, t in enumerate(made)] + [rows[0], rows[0]]
    files = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "file_id long, path string, text string, data string")
    outside = spark.createDataFrame([(1, "other.py", lib), (2, "none.py", None)], "lib_id int, file_name string, text string")
    got = [r.file_id for r in sourcefiles.foreign_files(files, outside).collect()]
    assert len(got) == len(set(got)) and {100, 101, 106} | {201 + 2 * i for i in range(10)} <= set(got) and not set(got) & {102, 103, 104, 105}
    assert len(set(got) & {200 + 2 * i for i in range(10)}) >= 8 and len(set(got) & set(range(40))) <= 2
    assert sourcefiles.foreign_files(files.limit(0), outside).count() == 0


def test_forest_finds_files_whose_notice_it_has_not_seen(spark):
    """Notices of a fifth of the files are hidden from the fit; the forest alone has to find them."""
    hand = [f"def work_{i}(items, limit):\n    # keep the order of the items\n    out = []\n    for item in items:\n        if item.size > limit:\n            out.append(item.name_{i})\n    return out\n" * (1 + i % 3) for i in range(60)]
    made = ["# Code generated by tool. DO NOT EDIT.\n" + "\n".join(f"FIELD_{i}_{j} = _descriptor.Field(name='f{j}', number={j})" for j in range(20 + i)) for i in range(40)]
    rows = [(i, f"src/m{i}.py", t) for i, t in enumerate(hand)] + [(100 + i, f"src/g{i}.py", t) for i, t in enumerate(made)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    outside = spark.createDataFrame([], "lib_id int, file_name string, text string")
    hidden = F.col("id") % 5 == 0
    judged = sourcefiles.judge_files(files, outside, hide=hidden).where(hidden).collect()
    assert len([r for r in judged if r.tool]) == 8 and all((r.chance >= 0.5) == r.tool for r in judged)


def test_outside_prints_are_bounded(spark):
    texts = ["\n".join(f"int value_{i}_{k % 40} = call_{i}(alpha, {i});" for i in range(30)) for k in range(60)]
    outside = spark.createDataFrame([(k, "a.c", t) for k, t in enumerate(texts)], "lib_id int, file_name string, text string")
    most = sourcefiles.outside_prints(outside, 4)[1].groupBy("print").count().agg(F.max("count")).first()[0]
    files = spark.createDataFrame([(1, "x.c", texts[45] + "\nint mine;"), (2, "y.c", "int other(int a) { return a + 1; }")], "file_id long, path string, text string")
    shares = {r.id: r for r in sourcefiles.describe_files(files).join(sourcefiles.shares_of_outside(sourcefiles.describe_files(files), outside, 4), "row", "left").collect()}
    assert most == 4 and shares[1].of_outside > 0.9 and shares[1].of_file > 0.9 and not shares[2].of_outside


@pytest.mark.parametrize("holders", [1, 3, 16])
def test_shares_count_all_outside_files(spark, holders):
    """Against plain sets; the small files lie only in what very many files share, and one name has two texts."""
    import math

    block = lambda k: [f"int value_{k}_{i} = call_{k}({i}, alpha);" for i in range(12)]
    made = [(k, "a.c", "\n".join(sum((block(b) for b in range(8) if b <= 1 or (k >> (b - 2)) & 1), []))) for k in range(40)]
    made += [(90, "small.c", "\n".join(block(0))), (90, "small.c", "\n".join(block(1)[:6])), (91, "z.c", "\n".join(block(1)))]
    mine = [(i, f"m{i}.c", "\n".join(sum((block(b) for b in blocks), [f"int mine_{i}_{j} = {j};" for j in range(9)]))) for i, blocks in enumerate([[0], [1], [0, 1, 3], [2, 5], [], [0, 1, 2, 3, 4, 5, 6]])]
    described = sourcefiles.describe_files(spark.createDataFrame(mine, "file_id long, path string, text string"))
    shares = sourcefiles.shares_of_outside(described, spark.createDataFrame(made, "lib_id int, file_name string, text string"), holders)
    got = {r.id: (r.of_outside, r.of_file, r.common) for r in described.join(shares, "row").collect()}
    prints = lambda text: set(sourcefiles.fingerprints(sourcefiles._TOKEN.findall(text)))
    want = {}
    for i, _, text in mine:
        own = prints(text)
        n = [(len(own & their), len(their)) for their in (prints(t) for _, _, t in made) if own & their]
        if n:
            want[i] = (max(a / b for a, b in n), max(a for a, _ in n) / len(own), math.log1p(max(a for a, _ in n)))
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_encoded_bytes_are_data():
    blob = "\n".join("QmFzZTY0+/" * 7 for _ in range(20))
    assert sourcefiles.blob_share(f'icon = """{blob}"""\n') > 0.9 and sourcefiles.blob_share("def a_long_name_of_a_function_that_is_written_by_hand_for_once(): pass") < 0.9
    assert sourcefiles.is_data(f'icon = """{blob}"""\n', __import__("collections").Counter())


def test_fingerprints_cover_changed_copies():
    text = "\n".join(f"def lib_{i}(alpha, beta): return alpha[{i}] + beta" for i in range(40))
    whole, part = (set(sourcefiles.fingerprints(t.split())) for t in (text, text.replace("lib_7(", "other(")))
    assert len(whole & part) > 0.8 * len(whole) and sourcefiles.fingerprints(["a", "b"]) == []


@pytest.mark.parametrize("name", ["p1_found", "p1_turns", "p2_found", "p5_found"])
def test_sql(spark, name):
    import os

    from millrace.llm import queries
    from tests.compare import SMALL, connect, same

    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    assert same(queries.queries()[name](spark, SMALL), connect(SMALL), queries.oracle_sql()[name])
