"""Defective prompt and response pairs.

A pair is a current assistant message without tool calls and the nearest
earlier user message of its conversation. Languages of prompt and reply are
posteriors of a naive Bayes model over character n-grams; truncation is judged
by the likelihood that a text ends after its last characters; refusals by the
machines of ``refusals``; copies by the words that prompt and reply share. The
models are fitted on all messages, in runs of neighbours, and the built-in
sentences; every pair is then judged over its whole texts.

Defined results
- versions of a message are resolved first (latest ``loaded_at``);
- null, empty or symbol-only replies are ``empty``;
- a reply without an earlier user message, or with a null ``seq``, is no pair;
- equal ``seq``: a user message counts as earlier only with a smaller ``seq``;
  of several with the same one, the latest ``created_at``, then the larger id;
- null prompts are compared as empty texts; damaged ``meta`` means no tool calls;
- texts of any length are judged: a reply of one word is wrong in its language if
  the posteriors say so, and a copy if it is all of the prompt;
- one defect a reply, in the order empty, copy, refusal, wrong_language, truncated;
- empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.conversations import clean_role, current_messages, has_tool_calls
from millrace.llm.language import DIMS, LANGUAGES, SEEDS, clean_text, folded, gram_hashes, prose_sentences
from millrace.llm.refusals import TalkMachines, declines, fit_talk_of
from millrace.session import cut_lineage, release

BLOCK = 2048
VISIBLE = re.compile(r"[^\W_]")
END_ORDERS = (32, 20, 14, 9, 5)
SEEN_BITS = 24
ASKED_BITS = 22
END_LIKELY = 0.25
# Overlapping n-grams of three orders say about the same thing three times; a reply is in another language once in fifty.
TEMPER, PRIOR = 1 / 3, 50.0
FIRM = 10.0
RUN = 20
SHORT = 200
STEP = 1000
VOTES = [f"v{k}" for k in range(len(LANGUAGES))]

# How prompts name the language of the answer, by its English,
# German, French, Spanish, Italian, Portuguese and Dutch name.
LANGUAGE_WORDS = {
    "en": "english|englisch|anglais|inglés|inglese|inglês|engels|английск\\w*|英語",
    "de": "german|deutsch|allemand|alemán|tedesco|alemão|duits|немецк\\w*|ドイツ語",
    "nl": "dutch|niederländisch|holländisch|néerlandais|neerlandés|holandés|olandese|neerlandês|holandês|nederlands|голландск\\w*|オランダ語",
    "fr": "french|französisch|français|francés|francese|francês|frans|французск\\w*|フランス語",
    "es": "spanish|spanisch|espagnol|español|castellano|spagnolo|espanhol|spaans|испанск\\w*|スペイン語",
    "pt": "portuguese|portugiesisch|portugais|portugués|portoghese|português|portugees|португальск\\w*|ポルトガル語",
    "it": "italian|italienisch|italien|italiano|italiaans|итальянск\\w*|イタリア語",
    "ru": "russian|russisch|russe|ruso|russo|русск\\w*|ロシア語",
    "ja": "japanese|japanisch|japonais|japonés|giapponese|japonês|japans|японск\\w*|日本語",
}
_ASKS = re.compile(
    r"\b(?:answer|reply|respond|write|antwort\w*|schreib\w*|répon\w*|écri\w*|respond\w*|respuesta|escrib\w*|contest\w*|rispon\w*|risposta|scriv\w*|respost\w*|escrev\w*|antwoord\w*|schrijf\w*|ответ\w*|напиши\w*|отвеча\w*)\b|答え|回答|返答|書いて",
    re.I,
)
_LANGUAGE = re.compile("|".join(rf"(?P<{k}>(?<!\w)(?:{v})(?!\w))" if k != "ja" else rf"(?P<{k}>{v})" for k, v in LANGUAGE_WORDS.items()), re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|(?<=[。！？])\s*|\n+")

_FENCE_LINE = re.compile(r"^\s*```", re.M)
_QUOTE_LINE = re.compile(r"^\s*>[^\n]*\n?", re.M)
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
_BARE_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s*$")
_MARK = re.compile(r"\s*[\[(](?:PR\s*)?#?\d+[\])]\s*$")
_FILE = re.compile(r"`?[\w.\-]*(?:/[\w.\-]+)+\.[a-z]{1,4}\b`?")
_NAMED = re.compile(r"`[^`\n]*`|\b\w*[a-z0-9]_\w+\b|\b[A-Za-z]*[a-z][A-Z]\w*\b")
_STOPS = ".!?。！？…"


def _masked(text: str) -> str:
    return re.sub(r"\d+", "0", _NAMED.sub("\x01", _FILE.sub("\x02", text)))


class LanguageBayes:
    """Naive Bayes over hashed character n-grams of orders 2 to 4; one counts once a sentence, however often it is in it."""

    ORDERS = (2, 3, 4)

    def _grams(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(bucket, sentence)`` of the distinct n-grams, in the order of sentences."""
        buckets, owner = gram_hashes(sentences, self.ORDERS)
        both = np.sort(owner.astype(np.int64) * DIMS + buckets)
        both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
        return both % DIMS, both // DIMS

    def __init__(self):
        self.log = np.zeros((DIMS, len(LANGUAGES)), dtype=np.float32)

    def cells(self, sentences: list[str], columns: np.ndarray) -> np.ndarray:
        """``bucket * languages + language`` of each n-gram that counts, sentences being in the languages ``columns``."""
        buckets, owner = self._grams(sentences)
        return buckets * len(LANGUAGES) + columns[owner]

    def of_counts(self, counts: np.ndarray) -> LanguageBayes:
        """The model of the counts of all cells."""
        counts = 0.05 + counts.reshape(DIMS, len(LANGUAGES))
        self.log = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        return self

    def fit(self, sentences: list[str], labels: list[str]) -> LanguageBayes:
        columns = np.array([LANGUAGES.index(x) for x in labels], dtype=np.int64)
        return self.of_counts(np.bincount(self.cells(sentences, columns), minlength=DIMS * len(LANGUAGES)))

    def scores(self, sentences: list[str]) -> np.ndarray:
        """Log likelihood of each sentence in each language."""
        buckets, owner = self._grams(sentences)
        out = np.zeros((len(sentences), len(LANGUAGES)))
        if len(owner):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[starts]] = np.add.reduceat(self.log[buckets].astype(np.float64), starts, axis=0)
        return out

    def judge(self, sentences: list[str]) -> tuple[list[str], np.ndarray]:
        """Language of each sentence and its log odds against the runner-up."""
        if not sentences:
            return [], np.empty(0)
        scores = self.scores(sentences)
        ranked = np.sort(scores, axis=1)
        return [LANGUAGES[i] for i in scores.argmax(axis=1)], ranked[:, -1] - ranked[:, -2]


def _run(part: str) -> str:
    return " " + _masked(_MARK.sub("", part.rstrip(_STOPS)))


class EndModel:
    """How likely a text is to end after its last characters.

    Counts are kept for the endings of closed sentences only; of all other
    contexts of the longer orders a bitmap remembers that they were seen.
    """

    def __init__(self):
        self.counts: dict[str, list[int]] = {}
        self.seen = np.zeros(1 << (SEEN_BITS - 3), dtype=np.uint8)

    @staticmethod
    def _spots(context: str) -> tuple[int, int]:
        raw, mask = context.encode("utf-8", "surrogatepass"), (1 << SEEN_BITS) - 1
        return zlib.crc32(raw) & mask, zlib.crc32(raw[::-1]) & mask

    @staticmethod
    def runs(text: str) -> set[tuple[str, bool]]:
        """``(run, closed)`` of a text. Ends are taken where they are certain: closed sentences, and list items that are followed by another."""
        runs = set()
        body = re.sub(r"```.*?(?:```|\Z)", "\n", clean_text(text), flags=re.S)
        lines = [x for x in body.split("\n") if x.strip()]
        for i, line in enumerate(lines):
            item = bool(_ITEM.match(line))
            parts = [x for x in _SENTENCE.split(_ITEM.sub("", line)) if x and x.strip()]
            for j, part in enumerate(parts):
                part = part.strip()
                closed = part[-1] in _STOPS or (item and j == len(parts) - 1 and i + 1 < len(lines) and _ITEM.match(lines[i + 1]))
                runs.add((_run(part), bool(closed)))
        return runs

    def fit(self, texts: list[str]) -> EndModel:
        runs = {run for text in texts for run in self.runs(text)}
        counts: dict[str, list[int]] = {}
        for run, closed in runs:
            if closed:
                for k in END_ORDERS:
                    counts.setdefault(run[-k:], [0, 0])[0] += 1
        spots = set()
        for run, closed in runs:
            n = len(run)
            for k in END_ORDERS:
                if n <= k:
                    if closed:
                        counts[run][1] += 1
                    continue
                for at in range(k, n + closed):  # whether an open run is complete is not known
                    context = run[at - k : at]
                    known = counts.get(context)
                    if known is not None:
                        known[1] += 1
                    elif k > 8:
                        spots.update(self._spots(context))
        for spot in spots:
            self.seen[spot >> 3] |= 1 << (spot & 7)
        self.counts = {k: v for k, v in counts.items() if v[1]}
        return self

    def likelihood(self, text: str) -> float | None:
        """Share of the occurrences of the longest known context that ended a sentence; None if none is known."""
        run = _run(text.strip())
        for k in END_ORDERS:
            context = run[-k:]
            known = self.counts.get(context)
            if known is not None:
                return known[0] / known[1]
            if k > 8 and len(context) == k:
                if all(self.seen[spot >> 3] >> (spot & 7) & 1 for spot in self._spots(context)):
                    return 0.0
        return None


def open_end(reply: str) -> bool | str:
    """Whether the reply stops before its last sentence, list item or code block is complete; its last part if only an end model can tell."""
    text = clean_text(reply).rstrip()
    if len(_FENCE_LINE.findall(text)) % 2:
        return True
    if text.endswith("```"):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1]
    if _BARE_ITEM.match(last):
        return True
    item = bool(_ITEM.match(last))
    bare = _ITEM.sub("", last).rstrip()
    plain = _MARK.sub("", bare).rstrip("\"'”»)] ")
    if not plain:
        return False
    if plain[-1] in _STOPS and not plain.endswith((".." , "…")):
        return False
    if item:
        before = [x.rstrip() for x in lines[:-1] if _ITEM.match(x)]
        if before and before[-1][-1] in _STOPS:
            return True
    elif len(lines) == 1 and len(bare.split()) <= 3 and _FILE.sub("\x02", bare).endswith("\x02"):
        return False  # a bare pointer to a file
    return [x for x in _SENTENCE.split(bare) if x and x.strip()][-1]


def is_truncated(reply: str, ends: EndModel) -> bool:
    """Whether the reply is cut off, by its form or by its last part's likelihood to end a sentence."""
    end = open_end(reply)
    return end if isinstance(end, bool) else (ends.likelihood(end) or 0.0) < END_LIKELY


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", clean_text(text).casefold())


def _find(words: list[str], inner: list[str]) -> int:
    """Position of ``inner`` in ``words`` or -1, by whole words."""
    if not inner:
        return -1
    text, part = "\x00" + "\x00".join(words) + "\x00", "\x00" + "\x00".join(inner) + "\x00"
    at = text.find(part)
    return -1 if at < 0 else text.count("\x00", 0, at)


def is_copy(prompt: str, reply: str) -> bool:
    """Whether the reply is the prompt (or its prose) again, with at most a few words of its own, fewer than it repeats."""
    said = _words(reply)
    asked = _words(prompt)
    if not said or not asked:
        return False
    if said == asked:
        return True
    prose = _words(re.sub(r"```.*?(?:```|\Z)", " ", prompt, flags=re.S))
    for whole in (asked, prose):
        rest, found = list(said), 0
        while (at := _find(rest, whole)) >= 0:
            rest = rest[:at] + rest[at + len(whole) :]
            found += 1
        if found and len(rest) <= min(4, found * len(whole) // 2):
            return True
    # A part of the prompt, in the same words and nothing else: at least its last sentence.
    if len(said) >= 5 and len(said) * 2 > len(prose) and _find(prose, said) >= 0:
        tail = [x for x in _SENTENCE.split(re.sub(r"```.*?(?:```|\Z)", " ", prompt, flags=re.S)) if x and x.strip()]
        return bool(tail) and said[-min(3, len(said)) :] == _words(tail[-1])[-min(3, len(said)) :]
    return False


def asked_language(prompt: str) -> str | None:
    """The language a sentence of the prompt asks the answer to be in."""
    for sentence in _SENTENCE.split(re.sub(r"```.*?(?:```|\Z)", "\n", clean_text(prompt), flags=re.S)):
        if sentence and _ASKS.search(sentence):
            named = _LANGUAGE.search(sentence)
            if named:
                return named.lastgroup
    return None


def text_scores(texts: list[list[str]], bayes: LanguageBayes) -> np.ndarray:
    """Summed log likelihoods of the sentences of each text; equal sentences of a batch are scored once."""
    place: dict[str, int] = {}
    spots = [[place.setdefault(s, len(place)) for s in part] for part in texts]
    every = list(place)
    scores = np.concatenate([bayes.scores(every[at : at + STEP]) for at in range(0, len(every), STEP)]) if every else np.empty((0, len(LANGUAGES)))
    return np.array([scores[part].sum(axis=0) if part else np.zeros(len(LANGUAGES)) for part in spots]).reshape(len(texts), len(LANGUAGES))


def in_other_language(asked: str | None, own: np.ndarray, said: np.ndarray) -> bool:
    """Whether a reply's prose is in another language than the prompt asks for, or than the prompt's own.

    The posteriors of both texts are compared: how likely the two are in one
    language, against two different ones, all languages alike beforehand. A
    text that says nothing about its language changes nothing.
    """
    reply = np.exp(TEMPER * (said - said.max()))
    prompt = np.zeros(len(LANGUAGES)) if asked else np.exp(TEMPER * (own - own.max()))
    if asked:
        prompt[LANGUAGES.index(asked)] = 1.0
    n = len(LANGUAGES)
    same = float(prompt @ reply) / n
    other = (float(prompt.sum() * reply.sum()) - float(prompt @ reply)) / (n * (n - 1))
    return other > PRIOR * same


def refused(replies: list[list[str]], talk: TalkMachines) -> list[bool]:
    """Whether each reply, as its sentences, declines; a reply whose first sentence is an answer is not read on."""
    first = sorted({x[0] for x in replies if x})
    margins: dict[str, np.ndarray] = {}
    for at in range(0, len(first), STEP):
        margins |= dict(zip(first[at : at + STEP], talk.margins(first[at : at + STEP])))
    left = [bool(x) and margins[x[0]].argmax() != 2 for x in replies]
    more = sorted({s for x, go in zip(replies, left) if go for s in x[1:]} - margins.keys())
    for at in range(0, len(more), STEP):
        margins |= dict(zip(more[at : at + STEP], talk.margins(more[at : at + STEP])))
    return [go and declines(np.array([margins[s] for s in x])) for x, go in zip(replies, left)]


def reply_prose(reply: str) -> list[str]:
    """Sentences of a reply, without what it quotes."""
    return prose_sentences(_QUOTE_LINE.sub("", reply) or reply, 1)


def defects(prompts: list[str | None], replies: list[str | None], bayes: LanguageBayes, talk: TalkMachines) -> tuple[list[str | None], list[str | None]]:
    """The defect of each reply, or None, and the last part of those that are truncated if an end model says so."""
    out: list[str | None] = [None] * len(replies)
    parts: list[str | None] = [None] * len(replies)
    open_: list[int] = []
    for i, (prompt, reply) in enumerate(zip(prompts, replies)):
        if not reply or not VISIBLE.search(reply):
            out[i] = "empty"
        elif is_copy(prompt or "", reply):
            out[i] = "copy"
        else:
            open_.append(i)
    prose = [reply_prose(replies[i]) for i in open_]
    declined = refused([x if "```" not in replies[i] else [] for x, i in zip(prose, open_)], talk)
    said = text_scores(prose, bayes)
    own = text_scores([prose_sentences(prompts[i] or "", 1) for i in open_], bayes)
    for k, i in enumerate(open_):
        if declined[k]:
            out[i] = "refusal"
        elif in_other_language(asked_language(prompts[i] or ""), own[k], said[k]):
            out[i] = "wrong_language"
        elif isinstance(end := open_end(replies[i]), str):
            parts[i] = end
        elif end:
            out[i] = "truncated"
    return out, parts


def defect_of(prompt: str | None, reply: str | None, bayes: LanguageBayes, ends: EndModel, talk: TalkMachines) -> str | None:
    (defect,), (part,) = defects([prompt], [reply], bayes, talk)
    return "truncated" if part is not None and (ends.likelihood(part) or 0.0) < END_LIKELY else defect


def fit_languages(runs: list[list[list[str]]]) -> LanguageBayes:
    """Naive Bayes from the built-in sentences and unlabelled ``runs`` of neighbouring messages, each a list of sentences.

    A sentence is labelled by the last fit and by the company it keeps: each time
    it is met, the language of most messages around it speaks for that one. So
    short sentences, which say too little by themselves, are learnt too.
    """
    sentences, labels = [], []
    for code, text in SEEDS.items():
        mine = prose_sentences(text)
        sentences += mine
        labels += [code] * len(mine)
    runs = [[[folded(s) for s in text] for text in run] for run in runs]
    model = LanguageBayes().fit(sentences, labels)
    pool = sorted({s for run in runs for text in run for s in text})
    place = {s: i for i, s in enumerate(pool)}
    company = np.log(PRIOR * (len(LANGUAGES) - 1))
    for firm in (FIRM, FIRM / 2):
        scores = np.concatenate([model.scores(pool[at : at + STEP]) for at in range(0, len(pool), STEP)]) if pool else np.empty((0, len(LANGUAGES)))
        near = np.zeros((len(pool), len(LANGUAGES)))
        for run in runs:
            spots = [[place[s] for s in text] for text in run]
            said = np.array([scores[spot].sum(axis=0) for spot in spots])
            two = np.sort(said, axis=1)[:, -2:]
            known = np.where(two[:, 1] - two[:, 0] >= firm, said.argmax(axis=1), -1)
            votes = np.bincount(known[known >= 0], minlength=len(LANGUAGES))
            for spot, own in zip(spots, known):
                others = votes - (np.arange(len(LANGUAGES)) == own)
                if others.any():
                    near[spot, int(others.argmax())] += company
        after = np.sort(TEMPER * scores + near, axis=1)[:, -2:]
        label = (TEMPER * scores + near).argmax(axis=1)
        good = np.flatnonzero(after[:, 1] - after[:, 0] >= company / 2)
        model = LanguageBayes().fit(sentences + [pool[i] for i in good], labels + [LANGUAGES[label[i]] for i in good])
    return model


RUNS = pa.list_(pa.struct([("run", pa.string()), ("closed", pa.bool_())]))
TEXTS = pa.list_(pa.string())


def _packed(rows: list, kind: pa.DataType) -> bytes:
    """A column of some messages, compressed: sentences of neighbours are much alike."""
    batch, sink = pa.RecordBatch.from_arrays([pa.array(rows, kind)], ["x"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> list:
    return pa.ipc.open_stream(blob).read_all()["x"].to_pylist()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), STEP):
            batch = whole.slice(at, STEP)
            role, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            said = [reply_prose(x) for x in texts]
            short = [x for x, r, text in zip(said, role, texts) if r == "assistant" and len(text) <= SHORT and "```" not in text]
            runs = [[{"run": run, "closed": closed} for run, closed in EndModel.runs(x)] for r, x in zip(role, texts) if r == "assistant"]
            blobs = _packed([[folded(s) for s in x] for x in said], TEXTS), _packed(short, TEXTS), _packed(runs, RUNS)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in blobs)], ["spots", "said", "short", "runs"])


def read_messages(messages: DataFrame) -> DataFrame:
    """What the models learn from messages of users and assistants, in blocks of some: their spots and sentences, those of short replies, and replies' runs up to ends."""
    texts = messages.select(F.xxhash64("conversation_id", F.floor(F.col("seq") / RUN)).alias("spot"), clean_role(F.col("role")).alias("role"), "content")
    texts = texts.where((F.length(F.trim("content")) > 0) & F.col("role").isin("user", "assistant"))
    return cut_lineage(texts.mapInArrow(_read, "spots array<bigint>, said binary, short binary, runs binary").withColumn("block", F.monotonically_increasing_id()))


def short_replies(read: DataFrame) -> DataFrame:
    """``(said)``: the sentences of each short reply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_unpacked(blob), TEXTS)], ["said"])

    return read.select("short").mapInArrow(run, "said array<string>")


def reply_runs(read: DataFrame) -> DataFrame:
    """``(run, closed)`` of all replies, equal ones of a block once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                found = {(r["run"], r["closed"]) for row in _unpacked(blob) for r in row}
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.bool_())], ["run", "closed"])

    return read.select("runs").mapInArrow(run, "run string, closed boolean")


def _tell(model, firm: float):
    """The language of each message that is told for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, spots, blob in zip(*(c.to_pylist() for c in batch.columns)):
                scores = text_scores(_unpacked(blob), model.value)
                two = np.sort(scores, axis=1)[:, -2:]
                known = np.where(two[:, 1] - two[:, 0] >= firm, scores.argmax(axis=1), -1)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(spots), pa.int64()), pa.array(range(len(spots)), pa.int32()), pa.array(spots, pa.int64()), pa.array(known, pa.int32())], ["block", "place", "spot", "known"])

    return run


def _keep_company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each sentence of a block is met among messages of each language."""
    for batch in batches:
        for blob, near in zip(*(c.to_pylist() for c in batch.columns)):
            votes: dict[str, list[int]] = {}
            beside = {x["place"]: x["near"] for x in near or []}
            for i, text in enumerate(_unpacked(blob)):
                for s in set(text):
                    mine = votes.setdefault(s, [0] * len(LANGUAGES))
                    if i in beside:
                        mine[beside[i]] += 1
            columns = np.array(list(votes.values()), dtype=np.int64).reshape(-1, len(LANGUAGES)).T
            yield pa.RecordBatch.from_arrays([pa.array(list(votes), pa.string()), *map(pa.array, columns)], ["s", *VOTES])


def _count_grams(model):
    company = np.log(PRIOR * (len(LANGUAGES) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(DIMS * len(LANGUAGES), dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), STEP):
                part = batch.slice(at, STEP)
                sentences, near = part.column(0).to_pylist(), np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]])
                score = TEMPER * model.value.scores(sentences) + company * near
                two = np.sort(score, axis=1)[:, -2:]
                good = np.flatnonzero(two[:, 1] - two[:, 0] >= company / 2)
                counts += np.bincount(model.value.cells([sentences[i] for i in good], score.argmax(axis=1)[good]), minlength=counts.size)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts[cells], pa.int64())], ["cell", "n"])

    return run


def fit_languages_of(read: DataFrame) -> LanguageBayes:
    """What ``fit_languages`` makes of all messages; only counts of n-grams, of a fixed number, come to the driver."""
    sentences = [(code, s) for code, text in SEEDS.items() for s in prose_sentences(text)]
    model, columns = LanguageBayes(), np.array([LANGUAGES.index(code) for code, _ in sentences], dtype=np.int64)
    seeds = np.bincount(model.cells([s for _, s in sentences], columns), minlength=DIMS * len(LANGUAGES))
    model.of_counts(seeds)
    for firm in (FIRM, FIRM / 2):
        sent = read.sparkSession.sparkContext.broadcast(model)
        told = cut_lineage(read.select("block", "spots", "said").mapInArrow(_tell(sent, firm), "block bigint, place int, spot bigint, known int"))
        votes = told.where("known >= 0").groupBy("spot").agg(*(F.count_if(F.col("known") == k).alias(v) for k, v in enumerate(VOTES)))
        others = F.array(*(F.col(v) - (F.col("known") == k).cast("bigint") for k, v in enumerate(VOTES)))
        near = told.join(votes, "spot").select("block", "place", others.alias("others")).where(F.array_max("others") > 0)
        near = near.select("block", F.struct("place", (F.array_position("others", F.array_max("others")) - 1).cast("int").alias("near")).alias("near"))
        beside = read.select("block", "said").join(near.groupBy("block").agg(F.collect_list("near").alias("near")), "block", "left")
        pool = beside.select("said", "near").mapInArrow(_keep_company, "s string, " + ", ".join(f"{v} bigint" for v in VOTES))
        pool = pool.groupBy("s").agg(*(F.sum(v).alias(v) for v in VOTES))
        made = pool.mapInArrow(_count_grams(sent), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts = seeds.copy()
        counts[made["cell"].to_numpy()] += made["n"].to_numpy()
        model = LanguageBayes().of_counts(counts)
    return model


def _windows(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each length up to the longest order, and 64-bit hashes of the windows of it from every place."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(END_ORDERS) + 1):
        if n > len(codes):
            return
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(1)
        h ^= h >> np.uint64(29)
        mixed = (h ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
        yield n, mixed ^ (mixed >> np.uint64(32))


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, lengths, starts)`` of texts one after the other."""
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64), lengths, np.cumsum(lengths) - lengths


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts before the end of each last part, of all orders."""
    for batch in batches:
        runs = [_run(x.strip()) for x in batch.column(0).to_pylist()]
        texts = [run[-k:] for run in runs for k in END_ORDERS]
        codes, lengths, starts = _laid_out(texts)
        made = np.zeros(len(texts), dtype=np.uint64)
        for n, h in _windows(codes):
            made[lengths == n] = h[starts[lengths == n]]
        order = np.tile(np.array(END_ORDERS), len(runs))
        part = np.repeat(np.arange(len(runs)), len(END_ORDERS))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(part)), pa.array(-order, pa.int32()), pa.array((order > 8) & (lengths == order)), pa.array(made.view(np.int64))], ["part", "order", "long", "context"]
        )


def _count_ends(wanted):
    """How often each context occurs in a batch's runs, and how often it ends one; contexts nobody asks for are mostly left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, lengths, starts = _laid_out(batch.column(0).to_pylist())
            closed = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            left, shut = lengths[owner] - (np.arange(len(codes)) - starts[owner]), closed[owner]
            found, ends, times = [], [], []
            for n, h in _windows(codes):
                whole = np.flatnonzero(closed & (lengths == n))
                x = h[starts[whole]]
                x = x[wanted.value[x >> np.uint64(64 - ASKED_BITS)]]
                orders = sum(k >= n for k in END_ORDERS)
                found.append(x), ends.append(np.full(len(x), orders)), times.append(np.full(len(x), orders))
                if n in END_ORDERS:
                    after = left[: len(h)] - n
                    take = np.flatnonzero((after > 0) | (after == 0) & shut[: len(h)])
                    take = take[(lengths[owner[take]] > n) & wanted.value[h[take] >> np.uint64(64 - ASKED_BITS)]]
                    found.append(h[take]), ends.append((after[take] == 0).astype(np.int64)), times.append(np.ones(len(take), dtype=np.int64))
            if found:
                every, place = np.unique(np.concatenate(found), return_inverse=True)
                n = [np.bincount(place, np.concatenate(x), len(every)).astype(np.int64) for x in (ends, times)]
                yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), *map(pa.array, n)], ["context", "ends", "times"])

    return run


def end_chances(parts: DataFrame, runs: DataFrame) -> DataFrame:
    """``(part, chance)``: what an ``EndModel`` of all ``(run, closed)`` says about each ``part``, null if it knows no context.

    Only contexts that some part asks for are counted, by 64-bit hashes, and
    joined; no task and no driver holds a model. A bitmap of a fixed size keeps
    most of the others from the shuffle.
    """
    asked = cut_lineage(parts.select("part").distinct().mapInArrow(_contexts, "part string, order int, long boolean, context bigint"))
    wanted = np.zeros(1 << ASKED_BITS, dtype=bool)
    wanted[asked.select(F.shiftrightunsigned("context", 64 - ASKED_BITS).alias("x")).distinct().toArrow()["x"].to_numpy()] = True
    counts = runs.distinct().mapInArrow(_count_ends(runs.sparkSession.sparkContext.broadcast(wanted)), "context bigint, ends bigint, times bigint")
    counts = counts.groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("times").alias("times"))
    chance = F.when(F.col("ends") > 0, F.col("ends") / F.col("times")).when(F.col("long") & (F.col("times") > 0), 0.0)
    said = asked.join(counts, "context", "left").select("part", "order", chance.alias("chance"))
    return said.groupBy("part").agg(F.min(F.when(F.col("chance").isNotNull(), F.struct("order", "chance")))["chance"].alias("chance"))


def prompt_pairs(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(message_id, prompt, reply)`` of every pair.

    The nearest earlier prompt is sought in blocks of sequence numbers, so a
    very long conversation is not one task. Each block's last prompt is carried
    to the replies at the start of later ones by two running maxima, over the
    blocks of a group and over the groups: one row a block, no pairs of blocks.
    """
    live = current_messages(
        messages.select(
            "id", "loaded_at", "conversation_id", "seq", "created_at", clean_role(F.col("role")).alias("role"), "content",
            has_tool_calls(F.col("meta")).alias("calls"),
        ),
        "id", "conversation_id", "seq", "created_at", "role", "content", "calls",
    )
    live = live.where(F.col("role").isin("user", "assistant") & F.col("conversation_id").isNotNull() & F.col("seq").isNotNull())
    live = live.withColumn("block", F.floor(F.col("seq") / block))
    user = F.when(F.col("role") == "user", F.struct("seq", "created_at", "id", "content"))
    inside = Window.partitionBy("conversation_id", "block").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    replies = live.withColumn("asked", F.max(user).over(inside)).where((F.col("role") == "assistant") & ~F.col("calls"))
    replies = replies.select("id", "conversation_id", "block", "asked", "content")
    # One row a block, whether it has a prompt or not.
    lasts = live.groupBy("conversation_id", "block").agg(F.max(user).alias("mine")).withColumn("group", F.floor(F.col("block") / block))
    groups = lasts.groupBy("conversation_id", "group").agg(F.max("mine").alias("mine"))
    before_group = Window.partitionBy("conversation_id").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("conversation_id", "group", F.max("mine").over(before_group).alias("older"))
    before_block = Window.partitionBy("conversation_id", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("recent", F.max("mine").over(before_block)).where(F.col("block") > 0).join(groups, ["conversation_id", "group"])
    carried = carried.select("conversation_id", "block", F.coalesce("recent", "older").alias("mine")).where(F.col("mine").isNotNull())
    later = replies.where(F.col("asked").isNull() & (F.col("block") > 0)).drop("asked").join(carried, ["conversation_id", "block"])
    later = later.select(F.col("id").alias("message_id"), F.col("mine.content").alias("prompt"), F.col("content").alias("reply"))
    found = replies.where(F.col("asked").isNotNull()).select(F.col("id").alias("message_id"), F.col("asked.content").alias("prompt"), F.col("content").alias("reply"))
    return found.unionByName(later)


def _judge(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = defects(batch.column(1).to_pylist(), batch.column(2).to_pylist(), *models.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in said)], ["message_id", "defect", "part"])

    return run


def judge_pairs(messages: DataFrame) -> DataFrame:
    """``(message_id, defect)`` of every pair; ``defect`` is null for a sound one.

    The models of languages and refusals are broadcast; together they have a
    fixed size of a few megabytes. Last parts that only the end model can judge
    are looked up by a join.
    """
    read = read_messages(messages)
    talk = fit_talk_of(short_replies(read), lambda text: prose_sentences(text, 1))
    models = messages.sparkSession.sparkContext.broadcast((fit_languages_of(read), talk))
    release(messages.sparkSession)
    judged = cut_lineage(prompt_pairs(messages).mapInArrow(_judge(models), "message_id string, defect string, part string"))
    open_ = judged.where(F.col("part").isNotNull())
    chances = end_chances(open_, reply_runs(read))
    cut_off = F.when(F.coalesce("chance", F.lit(0.0)) < END_LIKELY, F.lit("truncated"))
    ended = open_.join(chances, "part").select("message_id", cut_off.alias("defect"))
    return judged.where(F.col("part").isNull()).select("message_id", "defect").unionByName(ended)


def defective_pairs(messages: DataFrame) -> DataFrame:
    """The defective pairs alone."""
    return judge_pairs(messages).where(F.col("defect").isNotNull())
