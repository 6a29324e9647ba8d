"""Text functions as Catalyst expressions; sizes are bytes of UTF-8 unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}_]+"
# Before a capital after a small letter or digit; before the last capital of a run that a small letter follows.
HUMPS = r"_+|(?<=[\p{Ll}0-9])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"

# Language and fence tag by file extension.
LANGUAGES = {
    "rust": "rs", "zig": "zig", "c": "c h cc cpp cxx hpp hh hxx m mm", "swift": "swift", "go": "go",
    "js": "js jsx mjs cjs ts tsx mts cts", "python": "py pyi mojo", "ruby": "rb rake", "shell": "sh bash zsh", "markdown": "md markdown mdx",
}
FENCE_TAGS = {
    "rust": "rs", "zig": "zig", "c": "c h", "cpp": "cc cpp cxx hpp hh hxx", "objectivec": "m mm", "swift": "swift", "go": "go",
    "javascript": "js jsx mjs cjs", "typescript": "ts tsx mts cts", "python": "py pyi", "mojo": "mojo", "ruby": "rb rake", "bash": "sh bash zsh",
    "markdown": "md markdown mdx", "toml": "toml", "json": "json", "yaml": "yaml yml",
}
# File names and extensions that mark secrets, folders that are never indexed.
SECRET_EXTENSIONS = ("pem", "key", "p12", "pfx", "jks", "keystore", "kdbx", "asc", "gpg", "mobileprovision", "p8")
PRUNED_DIRS = (".git", "node_modules", "target", "dist", "build", "out", "vendor", ".venv", "venv", "__pycache__", ".cache", ".idea", ".vscode", "zig-out", "zig-cache", "Pods")


def lines(text: Column) -> Column:
    """Lines ended by LF or CRLF, without an empty one after the last line end; an empty text has none."""
    body = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(body)


def identifier_parts(word: Column) -> Column:
    return F.filter(F.split(word, HUMPS), lambda p: F.length(p) > 0)


def tokens(text: Column) -> Column:
    """Search tokens: each word in lower case, followed by its shorter identifier parts of two characters or more."""
    words = F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})")), lambda w: F.regexp_replace(w, r"^_+|_+$", ""))

    def spread(word: Column) -> Column:
        parts = F.filter(identifier_parts(word), lambda p: (F.length(p) >= 2) & (F.length(p) < F.length(word)))
        small = F.lower(word)
        # Most words have no capital and no underscore, and so no parts.
        return F.when((small == word) & ~word.contains("_"), F.array(word)).otherwise(F.concat(F.array(small), F.transform(parts, F.lower)))

    return F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= 2), spread))


def byte_cut(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters within ``limit`` bytes."""
    raw = F.encode(text, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, limit - back).cast("string")) for back in range(4)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*cuts))


def capped(text: Column, limit: int) -> Column:
    """A text cut after the character that starts before byte ``limit``, with a note of how much is missing."""
    raw = F.encode(text, "UTF-8")
    cut = F.coalesce(*(F.try_validate_utf8(F.substring(raw, 1, limit + more).cast("string")) for more in range(4)))
    missing = (F.octet_length(text) - F.octet_length(cut)).cast("string")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(cut, F.lit("\n…[truncated "), missing, F.lit(" bytes]")))


def captured(text: Column, limit: int) -> Column:
    """``(bytes, dropped)``: head and tail of an output, half of ``limit`` bytes each, with a note between them of what was dropped."""
    raw, half = F.encode(text, "UTF-8"), limit // 2
    total = F.octet_length(text)
    dropped = F.greatest(total - 2 * half, F.lit(0))
    note = F.encode(F.concat(F.lit("\n…[truncated "), dropped.cast("string"), F.lit(" bytes]…\n")), "UTF-8")
    tail = F.substring(raw, total - half + 1, F.lit(half))
    return F.struct(F.when(dropped > 0, F.concat(F.substring(raw, 1, half), note, tail)).otherwise(raw).alias("bytes"), dropped.alias("dropped"))


def short_digest(digest: Column) -> Column:
    """The first eight hexadecimal digits, as shown to a reader."""
    return F.left(digest, F.lit(8))


# What an encoder wants ahead of a text, by task.
TASK_PREFIXES = {"search_query": "search_query: ", "search_document": "search_document: ", "classification": "classification: ", "clustering": "clustering: "}


def task_input(task: str, text: Column) -> Column:
    return F.concat(F.lit(TASK_PREFIXES[task]), text)


def recipe(fingerprint: Column, dim: Column) -> Column:
    """How vectors were made, in one text: an index is only asked by an encoder with the same."""
    return F.concat_ws("|", fingerprint, F.lit("search_document"), F.concat(F.lit("dim"), dim.cast("string")), F.lit("v1"))


def chunk_digest(path: Column, start_line: Column, content: Column) -> Column:
    zero = F.unhex(F.lit("00"))
    parts = (F.encode(path, "UTF-8"), zero, F.encode(start_line.cast("string"), "UTF-8"), zero, F.encode(content, "UTF-8"))
    return F.sha2(F.concat(*parts), 256)


def longest_run(text: Column, char: str) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"({char}+)")), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def fence(text: Column) -> Column:
    """A backtick fence longer than any run inside the text, of three at least."""
    return F.repeat(F.lit("`"), F.greatest(longest_run(text, "`"), F.lit(2)) + 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def _by_extension(path: Column, table: dict[str, str], otherwise: str) -> Column:
    pairs = [F.lit(x) for name, endings in table.items() for ending in endings.split() for x in (ending, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit(otherwise))


def language_of(path: Column) -> Column:
    return _by_extension(path, LANGUAGES, "other")


def fence_tag(path: Column) -> Column:
    return _by_extension(path, FENCE_TAGS, "")


def is_secret(path: Column) -> Column:
    """Whether the file name looks like a secret."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ending = F.element_at(F.split(name, r"\."), -1)
    return (
        (name == ".env") | name.startswith(".env.") | name.startswith("id_rsa") | name.startswith("id_ed25519")
        | name.contains("credentials") | name.contains("secret") | ending.isin(*SECRET_EXTENSIONS)
    )


# Names that the tools never show, by any part of a path.
HIDDEN_NAMES, HIDDEN_STARTS, HIDDEN_ENDS, HIDDEN_WORDS = (".git", "target", "node_modules"), (".env", "id_rsa"), (".pem", ".key", ".sqlite"), ("credentials", "secret")


def is_hidden_from_tools(path: Column) -> Column:
    """Whether any part of a path has a name that tools must not show."""

    def hidden(part: Column) -> Column:
        return any_of([part.isin(*HIDDEN_NAMES), *(part.startswith(x) for x in HIDDEN_STARTS), *(part.endswith(x) for x in HIDDEN_ENDS), *(part.contains(x) for x in HIDDEN_WORDS)])

    return F.exists(F.split(F.lower(path), "/"), hidden)


def is_held_out(path: Column, marker: str = "held_out") -> Column:
    """Whether a path is kept from the model: its name says so."""
    return F.coalesce(path.contains(marker), F.lit(False))


def in_pruned_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*PRUNED_DIRS))


def confined_path(path: Column) -> Column:
    """``(path, error)``: the path with ``.`` parts dropped, or why it is refused."""
    parts = F.split(path, "/")
    error = (
        F.when(F.instr(path, "\x00") > 0, "nul_byte")
        .when(path.startswith("/"), "absolute")
        .when(F.exists(parts, lambda p: p == ".."), "outside")
    )
    clean = F.array_join(F.filter(parts, lambda p: (p != ".") & (p != "")), "/")
    return F.struct(F.when(error.isNull(), clean).alias("path"), error.alias("error"))


def heading(line: Column) -> Column:
    """``(level, title)`` of a Markdown heading at the line's start, else null."""
    marks = F.regexp_extract(line, r"^(#{1,6}) ", 1)
    title = F.regexp_replace(F.regexp_replace(line, r"^#{1,6} ", ""), r"^\s+|\s+$", "")
    return F.when(marks != "", F.struct(F.length(marks).alias("level"), title.alias("title")))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def run_lengths(text: Column) -> Column:
    """Run-length code: count and character of each run, a run of over 255 in several counts."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)((.)\2*)"), 1)

    def coded(run: Column) -> Column:
        char, n = F.substring(run, 1, 1), F.length(run)
        whole = F.repeat(F.concat(F.lit("255"), char), F.floor(n / 255).cast("int"))
        return F.concat(whole, F.when(n % 255 > 0, F.concat((n % 255).cast("string"), char)).otherwise(""))

    return F.array_join(F.transform(runs, coded), "")


def key_value(line: Column) -> Column:
    """``(key, value)`` of a ``key=value`` line with a key of 1 to 15 and a value of up to 63 bytes, else null."""
    bare = F.regexp_replace(line, r"[\r\n]+$", "")
    at = F.instr(bare, "=")
    key, value = F.substring(bare, F.lit(1), at - 1), F.substring(bare, at + 1, F.length(bare))
    fits = (at > 1) & (F.octet_length(key) <= 15) & (F.octet_length(value) <= 63)
    return F.when(fits, F.struct(key.alias("key"), value.alias("value")))


def diff_class(line: Column) -> Column:
    """Class of a line shown as a diff: header, meta, added, removed or plain."""
    return (
        F.when(line.startswith("+++") | line.startswith("---") | line.startswith("diff --git"), "header")
        .when(line.startswith("@@"), "meta")
        .when(line.startswith("+"), "added")
        .when(line.startswith("-"), "removed")
        .otherwise("plain")
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
