"""Languages of documents and of their segments, whatever their labels say.

Hierarchical discrimination: one-versus-one linear support vector machines
choose the family first, then others separate the languages within it. The
features are hashed character n-grams of a sentence of prose.

The machines are fitted on a bounded sample of labelled rows (at most
``fit_rows`` documents a language, the ones with the lowest id hash, of at most
``FIT_CHARS`` characters) together with a few built-in sentences. A sentence that
several of those documents share has the label of most of them; of the others,
what a first fit on the built-in sentences firmly contradicts is left out. So
wrong labels do little harm. Every document is then judged over its whole text.

Defined results
- null, empty and blank texts, and texts without prose, have no language and give no rows;
- sentences of fewer than three words count only in a text that has no longer one;
- a text is mixed if at least two sentences each are firmly in two languages;
- a label that is null, blank or unknown names no language;
- repeated rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.language import DIMS, FAMILIES, FAMILY_OF, LANGUAGES, SEEDS, fit_line, folded, gram_hashes, language_of_label, numbered_sentences, prose_sentences

FIT_ROWS = 120
FIT_CHARS = 4000
FIRM = 0.35
ROUNDS = 60
STEP = 1000


class Machines:
    """One-versus-one linear support vector machines over families, and over the languages of each."""

    def __init__(self):
        self.duels: list[tuple[str, str, tuple[str, ...], tuple[str, ...]]] = [
            (a, b, FAMILIES[a], FAMILIES[b]) for a, b in combinations(FAMILIES, 2)
        ]
        for members in FAMILIES.values():
            self.duels += [(a, b, (a,), (b,)) for a, b in combinations(members, 2)]
        self.weights = np.zeros((DIMS, len(self.duels)), dtype=np.float32)

    def fit(self, sentences: list[str], labels: list[str], penalty: float = 2e-4) -> Machines:
        """Squared hinge loss by accelerated gradient steps; deterministic."""
        buckets, owner = gram_hashes(sentences)
        label = np.array(labels)
        per = np.bincount(owner, minlength=len(sentences))
        value = 1.0 / np.sqrt(np.maximum(per, 1))
        for k, (_, _, left, right) in enumerate(self.duels):
            side = np.where(np.isin(label, left), 1.0, np.where(np.isin(label, right), -1.0, 0.0))
            if not ((side > 0).any() and (side < 0).any()):
                continue
            self.weights[:, k] = fit_line(buckets, owner, value, side, penalty, ROUNDS)
        return self

    def scores(self, sentences: list[str]) -> np.ndarray:
        """Signed distances ``(sentence, duel)``."""
        buckets, owner = gram_hashes(sentences)
        per = np.bincount(owner, minlength=len(sentences)).astype(np.float64)
        out = np.zeros((len(sentences), len(self.duels)))
        order = np.argsort(owner, kind="stable")
        owner, buckets = owner[order], buckets[order]
        if len(owner):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[starts]] = np.add.reduceat(self.weights[buckets], starts, axis=0)
        return out / np.sqrt(np.maximum(per, 1))[:, None]

    def judge(self, sentences: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and margin of each sentence: the family by votes, then the language within it."""
        distance = self.scores(sentences)
        families = list(FAMILIES)
        ballots = {f: np.zeros(len(sentences)) for f in families}
        least = {f: np.full(len(sentences), np.inf) for f in families}
        inner: dict[str, list[int]] = {f: [] for f in families}
        for k, (a, b, left, _) in enumerate(self.duels):
            if a in FAMILIES:
                for name, d in ((a, distance[:, k]), (b, -distance[:, k])):
                    ballots[name] += (d > 0) + 1e-3 * np.tanh(d)
                    least[name] = np.minimum(least[name], d)
            else:
                inner[FAMILY_OF[left[0]]].append(k)
        family = np.argmax([ballots[f] for f in families], axis=0)
        names = np.empty(len(sentences), dtype=object)
        margin = np.zeros(len(sentences))
        for i, f in enumerate(families):
            rows = family == i
            if not rows.any():
                continue
            members = FAMILIES[f]
            votes = np.zeros((len(members), rows.sum()))
            tight = np.full((len(members), rows.sum()), np.inf)
            for k in inner[f]:
                a, b = (members.index(x) for x in self.duels[k][:2])
                d = distance[rows, k]
                votes[a] += (d > 0) + 1e-3 * np.tanh(d)
                votes[b] += (d < 0) - 1e-3 * np.tanh(d)
                tight[a] = np.minimum(tight[a], d)
                tight[b] = np.minimum(tight[b], -d)
            best = np.argmax(votes, axis=0)
            names[rows] = np.array(members, dtype=object)[best]
            margin[rows] = np.minimum(least[f][rows], tight[best, np.arange(rows.sum())])
        return list(names), np.where(np.isfinite(margin), margin, 0.0)


def seed_sentences() -> tuple[list[str], list[str]]:
    sentences, labels = [], []
    for code, text in SEEDS.items():
        for sentence in prose_sentences(text):
            sentences.append(sentence)
            labels.append(code)
    return sentences, labels


def fit_machines(documents: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> Machines:
    """Machines fitted on at most ``fit_rows`` labelled documents of each language, gathered on the driver."""
    first, names = seed_sentences()
    seeds = Machines().fit(first, names)
    labelled = documents.select(F.col(text_col).alias("text"), language_of_label(F.col(label_col)).alias("label"), F.xxhash64(id_col, text_col).alias("spot"))
    labelled = labelled.where(F.col("label").isNotNull() & (F.length("text") <= FIT_CHARS) & (F.length(F.trim("text")) > 0))
    near = Window.partitionBy("label").orderBy("spot")
    sample = labelled.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= fit_rows).select("text", "label").collect()
    # How often a sentence, by its letters alone, is met in texts of each label: of what many texts share, most are labelled right.
    kept: list[tuple[str, list[str], list[str], np.ndarray]] = []
    votes: dict[str, dict[str, int]] = {}
    for text, label in sorted(sample):
        mine = prose_sentences(text)
        if not mine:
            continue
        said, margin = seeds.judge(mine)
        if sum(x == label for x in said) * 2 < len(said):
            continue
        kept.append((label, mine, said, margin))
        for key in {folded(s) for s in mine}:
            seen = votes.setdefault(key, {})
            seen[label] = seen.get(label, 0) + 1
    sentences, labels, sure = list(first), list(names), [True] * len(first)
    taken: set[str] = set()
    for label, mine, said, margin in kept:
        for s, x, m in zip(mine, said, margin):
            key = folded(s)
            if key in taken:
                continue
            seen = votes[key]
            best = max(sorted(seen), key=seen.get)
            often = seen[best] >= 3 and seen[best] * 3 >= 2 * sum(seen.values())
            if often or x == label or m < 0.1:
                taken.add(key)
                sentences.append(s)
                labels.append(best if often else label)
                sure.append(often)
    model = Machines().fit(sentences, labels)
    # Second look: what the fitted machines contradict was in another language.
    said, _ = model.judge(sentences)
    good = [i for i, (x, y, certain) in enumerate(zip(said, labels, sure)) if x == y or certain]
    if len(good) == len(sentences):
        return model
    return Machines().fit([sentences[i] for i in good], [labels[i] for i in good])


def judge_texts(texts: list[str | None], model: Machines) -> list[tuple[list[str], list[float], list[int]]]:
    """Languages, margins and lines of the sentences of each text; equal sentences of a batch are judged once."""
    sentences = [numbered_sentences(t) if t else [] for t in texts]
    place: dict[str, int] = {}
    spots = [[place.setdefault(s, len(place)) for _, s in part] for part in sentences]
    every, names, margins = list(place), [], []
    for at in range(0, len(every), STEP):
        said, margin = model.judge(every[at : at + STEP])
        names += said
        margins += margin.tolist()
    return [([names[i] for i in part], [margins[i] for i in part], [line for line, _ in own]) for part, own in zip(spots, sentences)]


def segments_of(names: list[str], margins: list[float]) -> list[tuple[int, int, str, float]]:
    """``(first sentence, last sentence, language, mean margin)`` of each run of sentences in one language.

    A sentence that is not firm takes the language of its neighbours.
    """
    firm: dict[str, int] = {}
    for name, margin in zip(names, margins):
        if margin >= FIRM:
            firm[name] = firm.get(name, 0) + 1
    kept = {name for name, count in firm.items() if count >= 2}
    if len(kept) < 2 and names:
        total: dict[str, float] = {}
        for name, margin in zip(names, margins):
            total[name] = total.get(name, 0.0) + max(margin, 0.01)
        kept = {max(sorted(total), key=total.get)}
    out: list[list] = []
    for i, (name, margin) in enumerate(zip(names, margins)):
        if name not in kept:
            name, margin = (out[-1][2] if out else None), 0.0
        if out and (out[-1][2] == name or out[-1][2] is None):
            out[-1][1], out[-1][2] = i, name if out[-1][2] is None else out[-1][2]
            out[-1][3].append(margin)
        else:
            out.append([i, i, name, [margin]])
    if out and out[-1][2] is None:
        out[-1][2] = next(iter(kept))
    return [(a, b, name, float(np.mean(m))) for a, b, name, m in out]


def _confidence(margin: float) -> float:
    return round(1.0 / (1.0 + float(np.exp(-4.0 * margin))), 6)


def _segmenter(id_type: pa.DataType, model, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = model.value
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], [], [], []]
            judged = judge_texts(batch.column(2).to_pylist(), machines)
            for key, label, (names, margins, lines) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), judged):
                found = segments_of(names, margins)
                spans = [(lines[a], lines[b]) for a, b, _, _ in found]
                if whole:
                    by: dict[str, list] = {}
                    for a, b, name, margin in found:
                        mine = by.setdefault(name, [0, 0.0])
                        mine[0] += b - a + 1
                        mine[1] += margin * (b - a + 1)
                    found = [(len(by), n, name, total / n) for name, (n, total) in sorted(by.items())]
                    spans = [(lines[0], lines[-1])] * len(found) if found else []
                for k, ((a, b, name, margin), (first, last)) in enumerate(zip(found, spans)):
                    for column, value in zip(rows, (key, label, a if whole else k, b if whole else b - a + 1, name, _confidence(margin), first, last)):
                        column.append(value)
            kinds = (id_type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["id", "label", "a", "b", "lang", "confidence", "first_line", "last_line"])

    return run


def _identify(documents: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int, whole: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = documents.schema[id_col].dataType
    model = documents.sparkSession.sparkContext.broadcast(fit_machines(documents, text_col, label_col, id_col, fit_rows))
    rows = documents.select(F.col(id_col).alias("id"), language_of_label(F.col(label_col)).alias("label"), F.col(text_col).alias("text"))
    schema = f"id {kind.simpleString()}, label string, a int, b int, lang string, confidence double, first_line int, last_line int"
    return rows.where(F.col("text").isNotNull()).mapInArrow(_segmenter(to_arrow_type(kind), model, whole), schema)


def language_segments(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(id_col, segment, sentences, lang, confidence, first_line, last_line)``: the runs of sentences in one language, in order.

    Lines are counted from 1 and end at LF, CRLF or U+2028.
    """
    rows = _identify(documents, id_col, text_col, label_col, fit_rows, False)
    return rows.select(F.col("id").alias(id_col), F.col("a").alias("segment"), F.col("b").alias("sentences"), "lang", "confidence", "first_line", "last_line")


def document_languages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(id_col, label, n_langs, sentences, lang, confidence)``: one row per language of each document.

    Narrow: a scan and one Python stage, no shuffle. The broadcast model has
    a fixed size (15 machines of 32,768 weights).
    """
    rows = _identify(documents, id_col, text_col, label_col, fit_rows, True)
    return rows.select(F.col("id").alias(id_col), "label", F.col("a").alias("n_langs"), F.col("b").alias("sentences"), "lang", "confidence")


def mislabelled(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(id_col, lang)`` of the documents whose label is missing or wrong, or that mix languages."""
    rows = document_languages(documents, id_col, text_col, label_col, fit_rows)
    return rows.where((F.col("n_langs") > 1) | ~F.coalesce(F.col("label") == F.col("lang"), F.lit(False))).select(id_col, "lang")


__all__ = ["LANGUAGES", "document_languages", "fit_machines", "language_segments", "mislabelled", "segments_of"]
