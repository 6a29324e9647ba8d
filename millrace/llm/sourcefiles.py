"""Generated, minified and vendored source files, and data in the form of code.

A random forest judges each file by compression ratio, token entropy,
identifier lengths, comment density and the like, by its path, and by how much
of it is in known outside files (shared token fingerprints). It is fitted on a
bounded sample of files (``fit_rows`` of each kind, the lowest id hashes)
labelled by notices in their first and last comments; those comments are cut
out before the features are computed, so the forest has to find other signs.
What is found is what the forest says; a notice alone finds nothing.

Defined results
- prose (by extension) and null, empty or blank texts are never found;
- a null path is judged by the text alone;
- repeated rows of one id come out once, and an id with several texts if any of
  them is found; extra columns are ignored;
- a notice counts only in a leading or trailing comment, not when quoted, and
  a licence of the project itself is no sign;
- an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.session import cut_lineage

FIT_ROWS = 3000
DATA_SHARE, DATA_TOKENS = 0.5, 60
HOLDERS = 16
DOUBT = 0.12
LONG = 300
GRAM, WINNOW = 6, 4
# Extensions of prose, and folder names in common use for what others or tools wrote.
PROSE = ("md", "txt", "rst", "adoc", "markdown", "text")
OUTSIDE = {
    "vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "external", "extern", "contrib", "deps",
    "node_modules", "site-packages", ".venv", "venv", "pods", "bower_components", "submodules", "carthage",
}
MADE = {"generated", "gen", "codegen", "autogen", "out", "build", "target", "dist", "assets", "static", "public", "web", "bundle", "release", "debug", "__generated__"}

_NAME = re.compile(r"(?:[.\-_](?:min|bundle|gen|generated|pb|packed|prod|chunk)\.[a-z]+|_pb2\w*\.py|-[0-9a-f]{6,}\.[a-z]+)$", re.I)
_COMMENT = re.compile(r"^\s*(?://|#(?!include|define|undef|if|endif|else|pragma|import|\[|!\[)|/\*|\*|<!--|--\s|;;|\"\"\"|''')")
_BLOCKS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))
_TOOL = re.compile(
    r"auto-?\s?generated|automatically (?:generated|created|produced|written)|(?:code |file )?generated (?:by|from|with|using)|@generated|machine[- ](?:made|generated|written)|do not (?:edit|modify|change)|"
    r"don't (?:edit|modify|change)|manual (?:edits|changes) (?:will|are)|changes will be (?:lost|overwritten)|(?:edits|changes) (?:get|are) (?:lost|overwritten)|^\W*produced by \S+|"
    r"wurde (?:von \S+ |automatisch )?(?:erzeugt|generiert|erstellt)|automatisch (?:erzeugt|generiert|erstellt)|nicht von hand (?:ändern|bearbeiten)|"
    r"produit automatiquement|généré (?:par|automatiquement)|ne pas (?:modifier|éditer)|generado (?:por|automáticamente)|no (?:editar|modificar)\b|generato (?:da|automaticamente)|non modificare|"
    r"gerado (?:por|automaticamente)|não (?:editar|modificar)|gegenereerd|niet (?:met de hand )?(?:bewerken|wijzigen)|to refresh\s*$|edit the (?:source|template|schema)|sourcemappingurl=|"
    r"сгенерирован|не редактировать|自動生成|編集しないで",
    re.I,
)
_TALK = re.compile(r"['\"`‘“][^'\"`’”]*(?:generated|edit)[^'\"`’”]*['\"`’”]|\bnot (?:auto-?)?generated\b|\bthis (?:generator|template|one)\b|written by hand|\b(?:writes?|emits?|prints?|looks for|detects?|skips?) (?:the|a|any|files?)\b", re.I)
_LICENCE = re.compile(r"SPDX-License-Identifier|copyright\s+(?:\(c\)|©|\d{4})|\(c\)\s*\d{4}|distributed under|licensed under|released under the|\b(?:MIT|BSD|Apache|MPL|GPL|LGPL|ISC)\b[- ]?(?:\d|licen[cs]e)", re.I)
_OWN = re.compile(r"authors of this project|this project's authors|LICENSE at the root", re.I)
_STRING = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")
_BLOB = re.compile(r"[A-Za-z0-9+/\\]{60,}={0,2}")
_TOKEN = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*|\d[\w.]*|[^\w\s]")

FEATURES = (
    "length", "squeeze", "entropy", "word_mean", "word_spread", "word_short", "comments", "line_mean", "line_max", "blank_share",
    "digit_share", "string_share", "same_shape", "shape_share", "mark_share", "longest_run", "token_share", "code_share",
    "outside", "made", "named", "depth", "style", "sign_share", "number_share", "bare_max", "bare_mean", "blob_share", "of_outside", "of_file", "common",
)


def _leading(lines: list[str]) -> tuple[list[str], list[str]]:
    """``(comments, rest)`` of a text's start; code that follows a block's end on its line is of the rest."""
    head: list[str] = []
    rest, unclosed, i = list(lines), set(), 0
    while i < len(rest):
        line = rest[i]
        block = next((x for x in _BLOCKS if line.lstrip().startswith(x[0]) and x not in unclosed), None)
        if block:
            at, end = i, line.find(block[1], line.index(block[0]) + len(block[0]))
            while end < 0 and at + 1 < len(rest):
                at += 1
                end = rest[at].find(block[1])
            if end < 0:
                unclosed.add(block)
                continue
            cut = end + len(block[1])
            head += [*rest[i:at], rest[at][:cut]]
            rest[at] = rest[at][cut:]
            i = at if rest[at].strip() else at + 1
        elif not line.strip() or _COMMENT.match(line) or line.startswith("#!"):
            head.append(line)
            i += 1
        else:
            break
    return head, rest[i:]


def _trailing(lines: list[str]) -> int:
    """Where the comments at a text's end begin."""
    bottom = len(lines)
    while bottom:
        line = lines[bottom - 1]
        block = next((x for x in _BLOCKS[:2] if line.rstrip().endswith(x[1])), None)
        at = bottom - 1
        while block and at >= 0 and block[0] not in lines[at]:
            at -= 1
        if block and at >= 0:
            if not lines[at].lstrip().startswith(block[0]):
                break
            bottom = at
        elif not line.strip() or _COMMENT.match(line):
            bottom -= 1
        else:
            break
    return bottom


def notices(text: str) -> tuple[bool, bool, str]:
    """``(made by a tool, of others, text without its leading and trailing comments)``."""
    head, body = _leading(text.replace("\r\n", "\n").split("\n"))
    bottom = _trailing(body)
    body, tail = body[:bottom], body[bottom:]
    said = [x for x in (*head, *tail) if x.strip()]
    tool = any(_TOOL.search(x) and not _TALK.search(x) for x in said)
    # Minifiers and bundlers keep comments that open with "/*!", and hardly anybody writes them by hand.
    tool = tool or any(x.lstrip().startswith("/*!") for x in head)
    note = "\n".join(head)
    others = bool(_LICENCE.search(note)) and not _OWN.search(note)
    return tool, others, "\n".join(body)


def _shape(line: str) -> str:
    return re.sub(r"\d+", "0", re.sub(r"[A-Za-z_$]+", "a", re.sub(r"\d*\.\d+", "0", line)))


def _is_word(token: str) -> bool:
    return token[0].isalpha() or token[0] in "_$"


def number_share(counts: Counter) -> float:
    """Share of number literals among number literals and words."""
    numbers = sum(n for x, n in counts.items() if x[0].isdigit())
    words = sum(n for x, n in counts.items() if _is_word(x))
    return numbers / max(numbers + words, 1)


def is_data(body: str, counts: Counter) -> bool:
    """Whether a text is evidently a table: mostly number literals, or mostly encoded bytes."""
    return counts.total() >= DATA_TOKENS and number_share(counts) >= DATA_SHARE or blob_share(body) >= DATA_SHARE


def blob_share(text: str) -> float:
    """Share of a text in long runs of the letters that encode bytes; no identifier or word is as long."""
    return sum(map(len, _BLOB.findall(text))) / max(len(text), 1)


def features(text: str, path: str | None, counts: Counter) -> list[float]:
    """The numbers the forest sees; ``text`` is without its outer comments, ``counts`` are its tokens'."""
    raw = text.encode("utf-8", "replace")
    size = max(len(raw), 1)
    bytes_ = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    total = max(counts.total(), 1)
    share = np.array(list(counts.values()), dtype=np.float64) / total if counts else np.ones(1)
    words = [(len(x), n) for x, n in counts.items() if _is_word(x)] or [(0, 1)]
    long, often = (np.array(x, dtype=np.float64) for x in zip(*words))
    many = often.sum()
    mean = float(long @ often / many)
    # Beyond LONG, how long a line is only tells how a tool wraps its output; such lines count by statement.
    units = [u for x in lines for u in (x.replace("}", ";").split(";") if len(x) > LONG else (x,)) if u.strip()] or [""]
    shapes = Counter(_shape(x.strip()) for x in units)
    lengths = [len(x) for x in lines]
    # Lines without their string literals: a long query or message is no sign of a tool.
    bare = [len(_STRING.sub("", x)) for x in lines]
    parts = (path or "").lower().split("/")
    name = parts[-1]
    marks = sum(n for x, n in counts.items() if not (x[0].isalnum() or x[0] in "_$"))
    longest = max((len(x) for x in re.findall(r"[A-Za-z0-9+/=]{20,}", text)), default=0)
    return [
        float(np.log1p(size)), len(zlib.compress(raw, 6)) / size, float(-(share * np.log2(share)).sum()), mean, float(np.sqrt(max((long - mean) ** 2 @ often / many, 0.0))),
        float(often[long <= 2].sum() / many), sum(bool(_COMMENT.match(x)) for x in lines) / len(lines), float(np.log1p(np.minimum(lengths, LONG).mean())), float(np.log1p(min(max(lengths), LONG))),
        float(bytes_[[9, 10, 11, 12, 13, 32]].sum() / size), float(bytes_[48:58].sum() / size), (sum(lengths) - sum(bare)) / max(len(text), 1),
        shapes.most_common(1)[0][1] / len(units), len(shapes) / len(units), marks / total, float(np.log1p(longest)), len(counts) / total, float(long @ often / max(len(text), 1)),
        float(any(x in OUTSIDE for x in parts[:-1])), float(any(x in MADE for x in parts[:-1])), float(bool(_NAME.search(name))), float(len(parts)),
        float(name.endswith((".css", ".js"))), float(bytes_[list(b"=(){};:")].sum() / size), number_share(counts), float(np.log1p(min(max(bare), LONG))), float(np.log1p(np.minimum(bare, LONG).mean())), blob_share(text),
    ]


def fingerprints(tokens: list[str]) -> list[int]:
    """Winnowed hashes of token runs: the least of every few consecutive ones, so equal stretches share them."""
    if len(tokens) < GRAM:
        return []
    known = {x: zlib.crc32(x.encode("utf-8", "replace")) for x in set(tokens)}
    marks = np.array([known[x] for x in tokens], dtype=np.uint64)
    h = np.zeros(len(tokens) - GRAM + 1, dtype=np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + marks[j : j + len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    if len(h) > WINNOW:
        h = np.lib.stride_tricks.sliding_window_view(h, WINNOW).min(axis=1)
    return np.unique(h).view(np.int64).tolist()


def _describe(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tools, others, tables, prints, numbers = [], [], [], [], []
            for path, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tool, other, body = notices(text)
                tools.append(tool)
                others.append(other)
                tokens = _TOKEN.findall(body)
                counts = Counter(tokens)
                tables.append(is_data(body, counts))
                prints.append(fingerprints(tokens))
                numbers.append(features(body, path, counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(tools, pa.bool_()), pa.array(others, pa.bool_()), pa.array(tables, pa.bool_()), pa.array(prints, pa.list_(pa.int64())), pa.array(numbers, pa.list_(pa.float64()))],
                ["id", "row", "tool", "others", "data", "prints", "numbers"],
            )

    return run


def describe_files(files: DataFrame, id_col: str = "file_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(id, row, tool, others, data, prints, numbers)`` of each file of code, once for every text of an id; ``row`` tells them apart."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = files.schema[id_col].dataType
    ending = F.lower(F.regexp_extract(F.coalesce(F.col(path_col), F.lit("")), r"\.([^./]+)$", 1))
    code = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text")).where(
        F.col("text").rlike(r"[\p{L}\p{N}]") & ~ending.isin(*PROSE)
    )
    single = code.distinct().withColumn("row", F.md5(F.concat_ws("\x1f", F.col("id").cast("string"), F.coalesce("path", F.lit("\x1e")), "text")))
    schema = f"id {kind.simpleString()}, row string, tool boolean, others boolean, data boolean, prints array<bigint>, numbers array<double>"
    return single.mapInArrow(_describe(to_arrow_type(kind)), schema)


def _prints(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(_TOKEN.findall(notices(t)[2])) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["lib", "prints"])

    return run


def outside_prints(outside: DataFrame, holders: int = HOLDERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The inverted index of the outside files in three frames: ``classes``, ``index`` and ``members``.

    ``index`` is ``(lib, print, of_lib)`` with at most ``holders`` files a print,
    the same ones for every print. All further files of a print are in the
    other two: prints that the same further files hold are of one class,
    ``(print, class)``, and ``(class, lib, of_lib)`` are its files. So many
    versions of one file are a few classes, and nothing is left out. Files with
    the same prints are one, and each text of a name is a file of its own.
    """
    files = outside.where(F.col("text").isNotNull()).select(F.lit(0).alias("lib"), "text").distinct()
    files = files.mapInArrow(_prints(pa.int32()), "lib int, prints array<bigint>").where(F.size("prints") > 0)
    files = cut_lineage(files.select(F.md5(F.concat_ws(",", F.col("prints").cast("array<string>"))).alias("lib"), "prints").dropDuplicates(["lib"]))
    spread = files.select("lib", F.size("prints").alias("of_lib"), F.explode("prints").alias("print"))
    first = Window.partitionBy("print").orderBy("lib")
    ranked = cut_lineage(spread.withColumn("rank", F.row_number().over(first)))
    rest = ranked.where(F.col("rank") > holders).drop("rank")
    # A set of files is told by its size and two sums of hashes without carry, so no row holds it.
    alike = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("lib")).alias("a"), F.bit_xor(F.xxhash64("lib", F.lit(1))).alias("b"))
    classes = rest.groupBy("print").agg(alike.alias("class"))
    members = rest.join(classes.groupBy("class").agg(F.min("print").alias("print")), "print").select("class", "lib", "of_lib")
    return classes, ranked.where(F.col("rank") <= holders).drop("rank"), members


def shares_of_outside(described: DataFrame, outside: DataFrame, holders: int = HOLDERS) -> DataFrame:
    """``(row, of_outside, of_file, common)``: the greatest shares of an outside file that a file holds, and of the file in one.

    All pairs that share a fingerprint count, with all that they share. A file
    meets at most ``holders`` rows of the index a fingerprint; what is in more
    outside files is first counted by class and meets their files once a class.
    Whether the index is broadcast is Catalyst's choice by size, a hot
    fingerprint of the files is split by AQE, and counts are combined on the
    map side.
    """
    classes, index, members = outside_prints(outside, holders)
    held = described.select("row", F.size("prints").alias("in_file"), F.explode("prints").alias("print"))
    near = held.join(index, "print").groupBy("row", "lib").agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in ("of_lib", "in_file")))
    far = held.join(classes, "print").groupBy("row", "class").agg(F.count("*").alias("n"), F.max("in_file").alias("in_file"))
    far = far.join(members, "class").select("row", "lib", "n", "of_lib", "in_file")
    every = near.unionByName(far).groupBy("row", "lib").agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("of_lib", "in_file")))
    return every.groupBy("row").agg(
        F.max(F.col("n") / F.col("of_lib")).alias("of_outside"), F.max(F.col("n") / F.col("in_file")).alias("of_file"), F.max(F.log1p(F.col("n").cast("double"))).alias("common")
    )


def _forest(sample: DataFrame, least: int, trees: int, seed: int = 11):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(featuresCol="vector", labelCol="kind", weightCol="weight", numTrees=trees, maxDepth=9, minInstancesPerNode=least, seed=seed, cacheNodeIds=False).fit(sample)


def judge_files(
    files: DataFrame, outside: DataFrame, id_col: str = "file_id", path_col: str = "path", text_col: str = "text", fit_rows: int = FIT_ROWS, hide: Column | None = None
) -> DataFrame:
    """``(id, tool, others, data, chance)`` of each text of code: its notices, and the forest's chance that it is not hand-written.

    Texts are read once; their features and fingerprints are written to the
    checkpoint folder and feed the copy search, the forest's sample, its second
    fit and the prediction. Rows where ``hide`` holds (a condition on ``id``)
    are left out of every fit, to measure the forest on them.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    described = cut_lineage(describe_files(files, id_col, path_col, text_col))
    shares = shares_of_outside(described, outside)
    rows = described.drop("prints").join(shares, "row", "left")
    more = F.array(*(F.coalesce(c, F.lit(0.0)) for c in ("of_outside", "of_file", "common")))
    # Tables of numbers hardly ever have a notice: they are labelled by what they are.
    kind = F.when(F.col("tool"), 1.0).when(F.col("others"), 2.0).when(F.col("data"), 3.0).otherwise(0.0)
    rows = cut_lineage(rows.select("id", "row", "tool", "others", "data", kind.alias("kind"), array_to_vector(F.concat("numbers", more)).alias("vector")))
    fit = rows if hide is None else rows.where(~hide)
    near = Window.partitionBy("kind").orderBy("spot", "row")
    sample = fit.withColumn("spot", F.xxhash64("id")).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= fit_rows)
    sample = cut_lineage(sample.select("kind", "vector", "spot", "row").repartition(1).sortWithinPartitions("spot", "row").drop("row"))
    # Every kind weighs in the fit what it weighs in the table, however many of its rows were sampled.
    whole = {r["kind"]: r["count"] for r in fit.groupBy("kind").count().collect()}
    kinds = {r["kind"]: r["count"] for r in sample.groupBy("kind").count().collect()}
    verdict = rows.withColumn("chance", F.lit(0.0))
    if len(kinds) == 1 and not kinds.get(0.0):
        verdict = rows.withColumn("chance", F.lit(1.0))
    elif len(kinds) > 1:
        weight = F.lit(1.0)
        for name, taken in kinds.items():
            weight = F.when(F.col("kind") == name, whole[name] / taken).otherwise(weight)
        sample = sample.withColumn("weight", weight)
        hand = vector_to_array("probability")[0]
        # Only some foreign files have a notice, so those without one dilute the hand-written ones. Each half of
        # the sample is judged by a forest that has not seen it, and the doubtful are left out of the last fit.
        halves = [sample.where(F.pmod("spot", F.lit(2)) == k) for k in (0, 1)]
        if all(half.where("kind = 0").head() and half.where("kind > 0").head() for half in halves):
            judged = _forest(halves[0], 5, 30).transform(halves[1]).unionByName(_forest(halves[1], 5, 30).transform(halves[0]))
            clean = judged.where((F.col("kind") > 0) | (hand > 1 - DOUBT)).select("kind", "vector", "spot", "weight")
            sample = cut_lineage(clean.coalesce(1).sortWithinPartitions("spot"))
        if not sample.where("kind = 0").isEmpty():
            verdict = _forest(sample, 2, 60).transform(rows).withColumn("chance", 1 - hand)
    return verdict.select("id", "tool", "others", "data", "chance")


def foreign_files(
    files: DataFrame, outside: DataFrame, id_col: str = "file_id", path_col: str = "path", text_col: str = "text", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """``(id_col, tool, others, data, chance)`` of each file that the forest takes for not hand-written by the project, once an id."""
    judged = judge_files(files, outside, id_col, path_col, text_col, fit_rows).where(F.col("chance") >= 0.5)
    return judged.groupBy("id").agg(*(F.max(c).alias(c) for c in ("tool", "others", "data", "chance"))).withColumnRenamed("id", id_col)
