"""Between messages and a model: prompt segments, output parsing, token bytes, word pieces, display blocks."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.context import merge_roles

# Control ids of the chat vocabulary; text ids start at 1000.
CONTROL = {
    "unk": 0, "bos": 1, "eos": 2, "inst": 3, "inst_end": 4, "available_tools": 5, "available_tools_end": 6, "tool_results": 7, "tool_results_end": 8,
    "tool_calls": 9, "pad": 11, "system_prompt": 17, "system_prompt_end": 18, "args": 32, "call_id": 33, "think": 34, "think_end": 35,
}
FIRST_TEXT_ID = 1000


def _segment(control: str | None, text: Column | None = None) -> Column:
    return F.struct(F.lit(None if control is None else CONTROL[control]).cast("int").alias("control"), (F.lit(None).cast("string") if text is None else text).alias("text"))


def prompt_segments(messages: DataFrame, systems: DataFrame) -> DataFrame:
    """``(conversation_id, segments)``: a prompt as an array of control ids and texts.

    ``messages (conversation_id, seq, role, content, calls array<struct<name,
    arguments>>)``, ``systems (conversation_id, system, tools)``. Neighbours of
    one role are merged first. Text stays text: a control id only ever comes
    from the template.
    """
    flags = messages.withColumn("called", F.coalesce(F.size("calls") > 0, F.lit(False)))
    merged = merge_roles(flags.select("conversation_id", "seq", "role", "content", F.col("called").alias("calls")))
    named = flags.where("called").select("conversation_id", "seq", F.col("calls").alias("made"))
    rows = merged.drop("calls").join(named, ["conversation_id", "seq"], "left")
    calls = F.flatten(F.transform("made", lambda c: F.array(_segment("tool_calls"), _segment(None, c["name"]), _segment("args"), _segment(None, c["arguments"]))))
    none = F.array().cast("array<struct<control:int,text:string>>")
    part = (
        F.when(F.col("role") == "user", F.array(_segment("inst"), _segment(None, F.col("content")), _segment("inst_end")))
        .when(F.col("role") == "tool", F.array(_segment("tool_results"), _segment(None, F.col("content")), _segment("tool_results_end")))
        .when(F.col("role") == "assistant", F.concat(F.array(_segment(None, F.col("content"))), F.coalesce(calls, none), F.array(_segment("eos"))))
        .otherwise(none)
    )
    turns = rows.select("conversation_id", "seq", part.alias("part")).groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("turns"))
    head = F.array(_segment("bos"), _segment("system_prompt"), _segment(None, F.coalesce("system", F.lit(""))), _segment("system_prompt_end"))
    tools = F.when(F.col("tools").isNotNull(), F.array(_segment("available_tools"), _segment(None, F.col("tools")), _segment("available_tools_end"))).otherwise(none)
    both = systems.join(turns, "conversation_id", "left")
    return both.select("conversation_id", F.concat(head, tools, F.coalesce(F.flatten(F.col("turns.part")), none)).alias("segments"))


def segment_ids(segments: Iterable[tuple[int | None, str | None]], encode: Callable[[str], list[int]]) -> list[int]:
    """Token ids of one prompt's segments."""
    out: list[int] = []
    for control, text in segments:
        out += [control] if control is not None else encode(text) if text else []
    return out


def split_output(ids: list[int]) -> tuple[list[int], list[tuple[list[int], list[int]]]]:
    """Text ids and ``(name ids, argument ids)`` of each tool call; only control ids delimit a call."""
    text: list[int] = []
    calls: list[tuple[list[int], list[int]]] = []
    sink = text
    for token in ids:
        if token == CONTROL["tool_calls"]:
            calls.append(([], []))
            sink = calls[-1][0]
        elif token == CONTROL["args"] and calls and sink is calls[-1][0]:
            sink = calls[-1][1]
        elif token == CONTROL["eos"]:
            sink = text
        else:
            sink.append(token)
    return text, calls


def parse_outputs(rows: DataFrame, key: str, decode: Callable[[list[int]], str]) -> DataFrame:
    """``(key, text, calls)`` of generated id sequences ``(key, ids)``."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parsed = [split_output(list(ids)) for ids in frame["ids"]]
            calls = [[{"name": decode(n).strip(), "arguments": decode(a).strip()} for n, a in made] for _, made in parsed]
            yield pd.DataFrame({key: frame[key], "text": [decode(t) for t, _ in parsed], "calls": calls})

    return rows.select(key, "ids").mapInPandas(run, f"{key} {kind}, text string, calls array<struct<name:string,arguments:string>>")


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """Character of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_bytes(token: str) -> bytes:
    known = byte_alphabet()
    return bytes(known.get(char, 0x3F) for char in token)


def stream_text(pieces: Iterable[bytes]) -> list[str]:
    """Text completed by each piece of a byte stream, and what is left at the end; partial characters wait, broken ones are replaced."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    out = [decoder.decode(piece) for piece in pieces]
    return [*out, decoder.decode(b"", True)]


def detokenize(pieces: DataFrame) -> DataFrame:
    """``(stream_id, seq, text)``: text completed by each ``(stream_id, seq, token)`` in order, the rest with the last one.

    Rows are sorted by stream and place and decoded as they pass; nothing of a
    stream is held but its unfinished character and its last row. Streams are
    spread over tasks by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, held = None, None

        def rows(made: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*made)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["stream_id", "seq", "text"])

        for batch in batches:
            out = []
            for name, seq, token in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held is not None and held[0] == name:
                    out.append(held)
                else:
                    if held is not None:
                        out.append((*held[:2], held[2] + decoder.decode(b"", True)))
                    decoder = codecs.getincrementaldecoder("utf-8")("replace")
                held = (name, seq, decoder.decode(token_bytes(token or "")))
            yield rows(out)
        if held is not None:
            yield rows([(*held[:2], held[2] + decoder.decode(b"", True))])

    ordered = pieces.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("bigint").alias("seq"), "token")
    return ordered.repartition("stream_id").sortWithinPartitions("stream_id", "seq", "token").mapInArrow(run, "stream_id string, seq bigint, text string")


def basic_words(text: str) -> list[str]:
    """Lower-case words, every punctuation or symbol character by itself."""
    return re.findall(r"[^\W_]+|[^\s\w]|_", text.lower())


def word_pieces(text: str, vocabulary: dict[str, int], limit: int, longest: int = 100) -> list[int]:
    """Ids between ``[CLS]`` and ``[SEP]``, at most ``limit`` in all: greedy longest pieces, an unmatched word as ``[UNK]``."""
    out: list[int] = []
    for word in basic_words(text):
        if len(out) >= limit - 2:
            break
        out += _pieces(word, vocabulary, longest)
    return [vocabulary["[CLS]"], *out[: max(limit - 2, 0)], vocabulary["[SEP]"]]


def _pieces(word: str, vocabulary: dict[str, int], longest: int) -> list[int]:
    unknown = [vocabulary["[UNK]"]]
    if len(word) > longest:
        return unknown
    found, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        stop = next((e for e in range(len(word), at, -1) if mark + word[at:e] in vocabulary), None)
        if stop is None:
            return unknown
        found.append(vocabulary[mark + word[at:stop]])
        at = stop
    return found


def encode_word_pieces(rows: DataFrame, key: str, text: str, vocabulary: dict[str, int], limit: int = 512) -> DataFrame:
    """``(key, ids)`` of every text; the vocabulary has a fixed size."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame["key"], "ids": [word_pieces(t or "", vocabulary, limit) for t in frame["text"]]})

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, ids array<int>")


def cap_result(text: str, limit: int) -> str:
    """A tool result of about ``limit`` bytes: cut after the character that starts before it, with a note of what is missing."""
    raw = text.encode()
    if len(raw) <= limit:
        return text
    cut = limit
    while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
        cut += 1
    return f"{raw[:cut].decode()}\n…[truncated {len(raw) - cut} bytes]"


def display_blocks(text: str) -> list[tuple[str, str, str]]:
    """``(kind, detail, text)`` of Markdown as shown: code with its language, headings of levels 1 to 3, bullets with their indent, gaps, text."""
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    out: list[tuple[str, str, str]] = []
    code: list[str] | None = None
    tag = ""
    for line in lines:
        bare = line.strip(" \t")
        if code is not None:
            if bare.startswith("```"):
                out.append(("code", tag, "\n".join(code)))
                code = None
            else:
                code.append(line)
        elif bare.startswith("```"):
            code, tag = [], bare[3:].strip(" \t")
        elif not bare:
            if out:
                out.append(("gap", "", ""))
        elif found := re.match(r"(#{1,3}) (.*)", bare):
            out.append(("heading", str(len(found.group(1))), found.group(2).strip(" \t")))
        elif bare.startswith(("- ", "* ")):
            out.append(("bullet", str(len(line) - len(line.lstrip(" \t"))), bare[2:]))
        else:
            out.append(("text", "", line))
    if code is not None:
        out.append(("code", tag, "\n".join(code)))
    return out


def blocks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, block, kind, detail, text)`` of every text."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [(k, n, *block) for k, t in zip(frame["key"], frame["text"]) for n, block in enumerate(display_blocks(t))]
            yield pd.DataFrame(made, columns=[key, "block", "kind", "detail", "text"])

    picked = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return picked.mapInPandas(run, f"{key} {kind}, block int, kind string, detail string, text string")
