"""Structural chunking: sections at declarations or headings, cut to a line and byte limit.

A text is one row and is chunked inside its scan task; a batch of texts becomes
one batch of chunk rows. What a declaration looks like is a table of patterns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame

from millrace.functions.text import LANGUAGES

MAX_LINES, MAX_BYTES, MIN_LINES, OVERLAP = 60, 2400, 3, 8
MAX_INDENT = 4

_LANGUAGE_OF = {ending: name for name, endings in LANGUAGES.items() for ending in endings.split()}
_NAME = r"[*&\s]*(?P<name>[\w$]+)"


def _words(*words: str) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + r")(?!\w)\s*"


# A row: (pattern over the line without indent, kind, must start the line). The first match counts.
_RUST = "(?:" + _words("pub", "(crate)", "(super)", "(self)", "async", "unsafe", "extern", '"C"', "default", "const") + ")*"
_SWIFT = r"(?:@\S+\s+)*(?:" + _words("public", "private", "fileprivate", "internal", "open", "static", "final", "override", "mutating", "nonmutating") + ")*"
_SCRIPT = "(?:" + _words("export", "default", "async", "declare", "abstract") + ")*"
_ZIG = "(?:" + _words("pub", "export", "extern", "inline", "noinline") + ")*"
_PATTERNS: dict[str, list[tuple[str, str, bool]]] = {
    "markdown": [(r"#{1,6} (?P<name>.*)", "heading", True)],
    "rust": [
        (_RUST + _words("impl") + r"(?P<impl>.*)", "impl", False),
        (_RUST + _words("fn") + _NAME, "fn", False),
        (_RUST + _words("struct", "enum", "union", "trait") + _NAME, "struct", False),
        (_RUST + _words("mod") + _NAME, "mod", False),
        (_RUST + _words("macro_rules!") + _NAME, "fn", False),
    ],
    "zig": [
        (_ZIG + _words("const") + r"(?P<name>[\w$]+)[^=]*=\s*(?:" + _words("packed", "extern") + ")*" + _words("struct", "enum", "union", "opaque"), "struct", False),
        (_ZIG + _words("test") + r'(?:"(?P<name>[^"]*)")?', "fn", False),
        (_ZIG + _words("fn") + _NAME, "fn", False),
    ],
    "swift": [
        (_SWIFT + r"(?:class\s+)?" + _words("func") + _NAME, "fn", False),
        (_SWIFT + _words("class", "struct", "enum", "protocol", "extension", "actor") + _NAME, "struct", False),
    ],
    "go": [
        (_words("func") + r"(?:\([^)]*\)\s*)?" + _NAME, "fn", True),
        (_words("type") + _NAME, "struct", True),
    ],
    "js": [
        (_SCRIPT + _words("function") + _NAME, "fn", False),
        (_SCRIPT + _words("class", "interface", "type", "enum") + _NAME, "struct", False),
        (_SCRIPT + _words("namespace") + _NAME, "mod", False),
        (_SCRIPT + _words("const", "let", "var") + _NAME + r".*(?:=>|function)", "fn", False),
        (r"export(?!\w).*?" + _words("const", "let", "var") + _NAME, "struct", True),
        (_words("export") + "", "text", True),
    ],
    "python": [
        (r"(?:" + _words("async") + ")*" + _words("def", "fn") + _NAME, "fn", False),
        (r"(?:" + _words("async") + ")*" + _words("class", "struct", "trait") + _NAME, "struct", False),
    ],
    "ruby": [
        (_words("def") + r"(?:self\.)?" + _NAME, "fn", False),
        (_words("class") + _NAME, "struct", False),
        (_words("module") + _NAME, "mod", False),
    ],
    "shell": [
        (_words("function") + _NAME, "fn", False),
        (r"(?P<name>[\w$]+)\s*\(\)", "fn", False),
    ],
    "c": [
        (r"@(?:interface|implementation|protocol)(?!\w)\s*" + _NAME, "struct", True),
        (r"[-+] \([^)]*\)" + _NAME, "fn", True),
        (r"(?!.*;\s*$)(?![^(]*\()(?:" + _words("typedef") + ")*" + _words("struct", "class", "enum", "union") + _NAME, "struct", True),
        (r"(?!.*;\s*$)(?![^(]*\()" + _words("namespace") + _NAME, "mod", True),
        (
            r"(?!.*;\s*$)(?!(?:return|if|else|while|for|switch|case|do|goto|sizeof|delete|new|throw|using|typedef)(?!\w))"
            r"(?=[A-Za-z_])[\w\s*&:<>,~]*[\s*&>,<](?P<name>[\w:~]+)\s*\(",
            "fn", True,
        ),
    ],
}
_DECLARATIONS = {lang: [(re.compile(p), kind, top) for p, kind, top in rows] for lang, rows in _PATTERNS.items()}
_ATTACHED = {
    "rust": ("//", "#["), "zig": ("//",), "go": ("//",), "c": ("//", "/*", "*", "template"), "swift": ("//", "/*", "*", "@"),
    "js": ("//", "/*", "*", "@"), "python": ("@", "#"), "ruby": ("#",), "shell": ("#",),
}


@dataclass(frozen=True)
class Span:
    """Lines ``start`` to ``stop`` (0-based, exclusive) of one section or chunk."""

    start: int
    stop: int
    kind: str = "text"
    symbol: str | None = None
    declared: bool = False


def text_lines(text: str) -> list[str]:
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [x[:-1] if x.endswith("\r") else x for x in parts]


def language_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return _LANGUAGE_OF.get(name.rsplit(".", 1)[-1].lower(), "other") if "." in name[1:] else "other"


def _implementation(text: str) -> str | None:
    """Name of a Rust implementation block: its own generics, body and bounds left out."""
    if text.startswith("<"):
        depth = 0
        for i, char in enumerate(text):
            depth += (char == "<") - (char == ">" and text[i - 1] != "-")
            if depth == 0:
                text = text[i + 1 :].lstrip()
                break
    return text.split("{")[0].split(" where")[0].strip() or None


def declaration(language: str, line: str) -> tuple[str, str | None] | None:
    """``(kind, symbol)`` if the line starts a declaration."""
    body = line.lstrip()
    indent = len(line[: len(line) - len(body)].encode())
    if not body or indent > MAX_INDENT:
        return None
    for pattern, kind, top in _DECLARATIONS.get(language, ()):
        if top and indent:
            continue
        found = pattern.match(body)
        if found:
            groups = found.groupdict()
            if "impl" in groups:
                return kind, _implementation(groups["impl"])
            name = groups.get("name")
            return kind, name.strip() if kind == "heading" and name else name
    return None


def _sections(language: str, lines: list[str]) -> list[Span]:
    starts: list[Span] = []
    fenced, free = False, 0
    for i, line in enumerate(lines):
        if language == "markdown":
            if line.startswith(("```", "~~~")):
                fenced = not fenced
                continue
            if fenced:
                continue
        found = declaration(language, line)
        if found is None:
            continue
        room = len(line) - len(line.lstrip()) + 1
        top = i
        while top > free:
            above = lines[top - 1]
            body = above.lstrip()
            if not body.startswith(_ATTACHED.get(language, ())) or not body or len(above) - len(body) > room:
                break
            top -= 1
        starts.append(Span(top, 0, found[0], found[1], True))
        free = i + 1
    if not starts or starts[0].start > 0:
        starts.insert(0, Span(0, 0))
    stops = [s.start for s in starts[1:]] + [len(lines)]
    return [replace(s, stop=stop) for s, stop in zip(starts, stops)]


def _joined(sections: list[Span]) -> list[Span]:
    """Sections of fewer than three lines go into the next one, a last one into the one before."""
    out: list[Span] = []
    small: Span | None = None
    for section in sections:
        if small is not None:
            own = small if small.declared else section
            section = Span(small.start, section.stop, own.kind, own.symbol, own.declared)
            small = None
        if section.stop - section.start < MIN_LINES:
            small = section
        else:
            out.append(section)
    if small is not None:
        if out:
            out[-1] = replace(out[-1], stop=small.stop)
        else:
            out.append(small)
    return out


def spans(language: str, lines: list[str]) -> list[Span]:
    """The chunks of a text as line spans."""
    if not lines:
        return []
    sizes = [len(x.encode()) for x in lines]
    out: list[Span] = []
    for section in _joined(_sections(language, lines)):
        at = section.start
        while True:
            stop, used = at + 1, sizes[at]
            while stop < section.stop and stop - at < MAX_LINES and used + 1 + sizes[stop] <= MAX_BYTES:
                used += 1 + sizes[stop]
                stop += 1
            shared = min(OVERLAP, (stop - at) // 2) if section.declared else 0
            short = MIN_LINES - (section.stop - stop + shared)
            if stop < section.stop and short > 0:
                stop = max(stop - short, at + 1)
            first = at == section.start
            out.append(Span(at, stop, section.kind if first else "text", section.symbol if first else None, section.declared and first))
            if stop >= section.stop:
                break
            at = max(stop - shared, at + 1)
    return out


def chunk_text(path: str, text: str) -> list[tuple[int, int, str, str, str | None, str]]:
    """``(start_line, end_line, digest, content, symbol, kind)`` of each chunk that isn't blank."""
    lines = text_lines(text)
    out = []
    for span in spans(language_of(path), lines):
        content = "\n".join(lines[span.start : span.stop]).encode()[:MAX_BYTES].decode("utf-8", "ignore")
        if not content.strip():
            continue
        digest = hashlib.sha256(b"\0".join((path.encode(), str(span.start + 1).encode(), content.encode()))).hexdigest()
        out.append((span.start + 1, span.stop, digest, content, span.symbol, span.kind))
    return out


CHUNK_COLUMNS = ["start_line", "end_line", "digest", "content", "symbol", "kind"]


def chunk_files(files: DataFrame, key: str, path: str = "path", text: str = "text") -> DataFrame:
    """``(key, path, start_line, end_line, digest, content, symbol, kind)`` of all texts; null texts give none."""
    kind = files.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, p, *chunk) for k, p, t in zip(frame["key"], frame["path"], frame["text"]) for chunk in chunk_text(p or "", t)]
            yield pd.DataFrame(rows, columns=[key, "path", *CHUNK_COLUMNS])

    picked = files.where(files[text].isNotNull()).select(files[key].alias("key"), files[path].alias("path"), files[text].alias("text"))
    return picked.mapInPandas(run, f"{key} {kind}, path string, start_line bigint, end_line bigint, digest string, content string, symbol string, kind string")
