"""The structural chunker: pinned spans, declarations and invariants."""

import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from millrace.operators import chunking as C

RUST = "use std::fmt;\nuse std::io;\n\n/// Adds.\n#[inline]\npub fn add(a: u8) -> u8 {\n    a + 1\n}\n\nimpl<T: X> fmt::Debug for Holder<T> {\n    fn fmt(&self) {\n    }\n}\n"


def test_plain_windows():
    """Full windows, and a last one of fewer than three lines takes from the one before."""
    for n, want in [(60, [(1, 60)]), (61, [(1, 58), (59, 61)]), (122, [(1, 60), (61, 119), (120, 122)]), (123, [(1, 60), (61, 120), (121, 123)])]:
        assert [(s.start + 1, s.stop) for s in C.spans("other", [f"entry {i}" for i in range(n)])] == want


@pytest.mark.parametrize("width", [79, 239, 599])
def test_byte_cap(width):
    """As many lines as fit with their line ends between them."""
    assert C.spans("other", ["-" * width] * 200)[0].stop == min(60, 2401 // (width + 1))


def test_long_line_is_cut_at_a_character():
    for text in ("é" * 1500, "z" + "é" * 1500, "日" * 900):
        (chunk,) = C.chunk_text("a.txt", text)
        assert text.startswith(chunk[3]) and 2400 - 2 <= len(chunk[3].encode()) <= 2400


def test_headings_in_code_are_none():
    text = "# Guide\nsome words\nand more\n\n~~~python\n# comment\nx = 1\n~~~\n\n### Notes\nfirst\nsecond\n# End\nlast\nlines\n"
    assert [c[4] for c in C.chunk_text("guide.md", text)] == ["Guide", "Notes", "End"]


def test_attached_comments_and_symbols():
    chunks = C.chunk_text("a.rs", RUST)
    assert [(c[0], c[4], c[5]) for c in chunks] == [(1, None, "text"), (4, "add", "fn"), (10, "fmt::Debug for Holder<T>", "impl")]


def test_overlap_of_long_declaration():
    text = "fn big() {\n" + "    step();\n" * 149 + "}\n"
    chunks = C.chunk_text("a.rs", text)
    assert chunks[0][4] == "big" and chunks[1][0] == chunks[0][1] - 7 and chunks[1][4] is None


@pytest.mark.parametrize(
    ("language", "line", "want"),
    [
        ("rust", "pub(crate) async unsafe fn go<T>() {", ("fn", "go")), ("rust", "macro_rules! vecs {", ("fn", "vecs")), ("rust", "let x = 1;", None),
        ("zig", "pub const A = packed struct {", ("struct", "A")), ("zig", "const n = 3;", None), ("zig", 'test "abc" {', ("fn", "abc")),
        ("swift", "@objc public class func make() {", ("fn", "make")), ("swift", "final class Box {", ("struct", "Box")),
        ("go", "func (s *A) Foo() {", ("fn", "Foo")), ("go", "    type X struct {", None), ("js", "export default async function run() {", ("fn", "run")),
        ("js", "const f = (x) => x", ("fn", "f")), ("js", "export const X = 3;", ("struct", "X")), ("js", "const X = 3;", None), ("js", "export {", ("text", None)),
        ("python", "    async def go(self):", ("fn", "go")), ("python", "        def deep(self):", None), ("ruby", "def self.make", ("fn", "make")),
        ("shell", "go_home() {", ("fn", "go_home")), ("shell", "function up {", ("fn", "up")), ("c", "static int foo(const char *p) {", ("fn", "foo")),
        ("c", "int foo(void);", None), ("c", "if (x) {", None), ("c", "- (void)doIt:(int)x {", ("fn", "doIt")), ("c", "@interface Foo : Bar", ("struct", "Foo")),
        ("c", "typedef struct Foo {", ("struct", "Foo")), ("markdown", "####### no", None), ("other", "def x():", None),
    ],
)
def test_declarations(language, line, want):
    assert C.declaration(language, line) == want


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["a.rs", "a.py", "a.md", "a.txt", "a.c"]), st.lists(st.sampled_from(["fn a() {", "def b():", "# h", "x" * 300, "", "    body", "int f(int a) {", "é" * 1300, "```"]), max_size=150))
def test_invariants(path, lines):
    text = "\n".join(lines)
    chunks = C.chunk_text(path, text)
    rows = C.text_lines(text)
    covered = set()
    for first, last, digest, content, _, _ in chunks:
        assert last - first < 60 and len(content.encode()) <= 2400
        assert digest == hashlib.sha256(f"{path}\0{first}\0{content}".encode()).hexdigest()
        covered |= set(range(first, last + 1))
    assert all(i + 1 in covered for i, line in enumerate(rows) if line.strip())


def test_table(spark):
    files = spark.createDataFrame([(1, "a.rs", RUST), (2, None, "x\n"), (3, "b.py", None), (4, "c.py", "")], "file_id long, path string, text string")
    rows = C.chunk_files(files, "file_id").collect()
    assert {r.file_id for r in rows} == {1, 2}
