"""Languages, prose extraction and hashed character n-grams, shared by the language operators."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import Column, functions as F

# ISO 639-1 code, its three-letter codes and its English name.
NAMES = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "nl": ("nld", "dut", "dutch"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"),
    "it": ("ita", "italian"),
    "ru": ("rus", "russian"),
    "ja": ("jpn", "japanese"),
}
FAMILIES = {"germanic": ("en", "de", "nl"), "romance": ("fr", "es", "pt", "it"), "slavic": ("ru",), "japonic": ("ja",)}
LANGUAGES = tuple(x for members in FAMILIES.values() for x in members)
FAMILY_OF = {x: family for family, members in FAMILIES.items() for x in members}

# A few plain sentences a language, so that a model exists for every language
# however few labelled rows a table has.
SEEDS = {
    "en": "The first thing that you should do when this happens is to ask them what they have seen. We did not know whether it would be enough for all of us. There are some people who think that nothing has changed since last year. If you want to use it, please read the notes which were written by the other team. After that, each of these files can be moved or deleted without any problem. My guess is that somebody forgot about it, because it should have been done already. This is why we can only say that the result was better than before. It turned out to be slow, so they gave it back after a while.",
    "de": "Das Erste, was du tun solltest, wenn so etwas passiert, ist sie zu fragen, was sie gesehen haben. Wir wussten nicht, ob es für uns alle reichen würde. Es gibt einige Leute, die glauben, dass sich seit dem letzten Jahr nichts geändert hat. Wenn man es benutzen will, muss man auch die Hinweise lesen, die von der anderen Gruppe geschrieben wurden. Danach kann jede dieser Dateien ohne Probleme verschoben oder gelöscht werden. Vermutlich hat jemand das vergessen, weil es schon längst erledigt sein sollte. Deshalb können wir nur sagen, dass das Ergebnis besser war als zuvor. Bitte prüfe, ob der Fehler noch auftritt, nachdem wir das Programm geändert haben.",
    "nl": "Het eerste wat je moet doen als dit gebeurt, is hun vragen wat ze hebben gezien. We wisten niet of het voor ons allemaal genoeg zou zijn. Er zijn sommige mensen die denken dat er sinds vorig jaar niets is veranderd. Als je het wilt gebruiken, lees dan ook de aantekeningen die door de andere groep zijn geschreven. Daarna kan elk van deze bestanden zonder problemen worden verplaatst of verwijderd. Waarschijnlijk heeft iemand het vergeten, want het had al gedaan moeten zijn. Daarom kunnen we alleen zeggen dat het resultaat beter was dan eerst. Kijk even of de fout nog bestaat, nadat we het programma hebben aangepast.",
    "fr": "La première chose que vous devez faire quand cela arrive, c'est de leur demander ce qu'ils ont vu. Nous ne savions pas si ce serait assez pour nous tous. Il y a des gens qui pensent que rien n'a changé depuis l'année dernière. Si vous voulez l'utiliser, il faut aussi lire les notes qui ont été écrites par l'autre équipe. Après cela, chacun de ces fichiers peut être déplacé ou supprimé sans aucun problème. Je pense que quelqu'un l'a oublié, parce que cela devait déjà être fait. C'est pourquoi on peut seulement dire que le résultat était meilleur qu'avant. Merci de vérifier si l'erreur existe encore, dès que nous avons changé le programme.",
    "es": "Lo primero que debes hacer cuando esto pasa es preguntarles qué han visto. No sabíamos si sería bastante para todos nosotros. Hay algunas personas que creen que nada ha cambiado desde el año pasado. Si quieres usarlo, también hay que leer las notas que fueron escritas por el otro equipo. Después de eso, cada uno de estos archivos se puede mover o borrar sin ningún problema. Creo que alguien lo olvidó, porque ya tenía que estar hecho. Por eso solo podemos decir que el resultado era mejor que antes. Por favor, revisa si el error todavía existe, en cuanto hayamos cambiado el programa.",
    "pt": "A primeira coisa que deves fazer quando isto acontece é perguntar-lhes o que viram. Não sabíamos se seria bastante para todos nós. Há algumas pessoas que pensam que nada mudou desde o ano passado. Se quiseres usá-lo, também é preciso ler as notas que foram escritas pela outra equipa. Depois disso, cada um destes ficheiros pode ser movido ou apagado sem nenhum problema. Acho que alguém se esqueceu, porque já devia estar feito. É por isso que só podemos dizer que o resultado era melhor do que antes. Por favor, verifica se o erro ainda existe, assim que tivermos alterado o programa.",
    "it": "La prima cosa che devi fare quando succede questo è chiedere loro che cosa hanno visto. Non sapevamo se sarebbe bastato per tutti noi. Ci sono alcune persone che pensano che niente sia cambiato dall'anno scorso. Se vuoi usarlo, devi anche leggere le note che sono state scritte dall'altra squadra. Dopo di che, ognuno di questi file può essere spostato o cancellato senza alcun problema. Penso che qualcuno se ne sia dimenticato, perché doveva già essere fatto. Per questo possiamo solo dire che il risultato era migliore di prima. Per favore controlla se l'errore esiste ancora, non appena abbiamo cambiato il programma.",
    "ru": "Первое, что нужно сделать, когда это происходит, это спросить их, что они видели. Мы не знали, будет ли этого достаточно для всех нас. Есть люди, которые думают, что с прошлого года ничего не изменилось. Если вы хотите это использовать, прочитайте также заметки, которые были написаны другой командой. После этого каждый из этих файлов можно переместить или удалить без проблем. Наверное, кто-то забыл об этом, потому что это уже должно быть сделано. Поэтому мы можем только сказать, что результат был лучше, чем раньше.",
    "ja": "これが起きたとき最初にするべきことは、彼らに何を見たか聞くことです。それが私たち全員に十分かどうか分かりませんでした。去年から何も変わっていないと考えている人もいます。使いたい場合は、別のチームが書いたメモも読む必要があります。その後、これらのファイルは問題なく移動または削除できます。誰かが忘れたのだと思います。結果は以前より良くなったとしか言えません。",
}

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_LINK = re.compile(r"https?://\S+")
_NAME = re.compile(
    r"[A-Za-z0-9_.\-]*[_/\\](?:[A-Za-z0-9_./\\:\-]*[A-Za-z0-9_/\\])?|[A-Za-z]*[a-z][A-Z][A-Za-z0-9]*|[A-Za-z]+\d[A-Za-z0-9]*|[A-Za-z0-9\-]+\.[A-Za-z]{1,4}\b(?!\s+[a-z])|\b(?=\w*\d)[0-9a-fA-F]{6,}\b"
)
_SPEAKER = re.compile(r"^\s*(?:user|assistant|system|tool)\s*:\s*", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|(?<=[。！？])\s*|\n+|\s{4,}")
_BROKEN = re.compile("[Â-ô][\u0080-¿]+")
_HIDDEN = re.compile("[­​-‏⁠️﻿]")
_LETTER = re.compile(r"[^\W\d_]")
_BULLET = re.compile(r"^\s*(?:[-*+>#]+|\d+[.)])\s+")
_KANA = re.compile("[぀-ヿ一-鿿]")
_CLAUSE_WORDS = re.compile(r"[^\W\d_]{2,}")
_CODE = re.compile(r"[{}()\[\];=<>|\\/$@#]|::|->")


def _mend(found: re.Match) -> str:
    try:
        return found.group(0).encode("latin-1").decode("utf-8")
    except UnicodeError:
        return found.group(0)


def clean_text(text: str) -> str:
    """The text with doubly encoded letters mended, invisible characters dropped, and in NFKC."""
    if not text.isascii():
        text = _BROKEN.sub(_mend, text)
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text.replace("\u2028", "\n").replace("\u2019", "'")))
    return text.replace("\r\n", "\n")


def numbered_sentences(text: str, least: int = 3) -> list[tuple[int, str]]:
    """``(line, sentence)`` of the text's prose, lines counted from 1; code, logs, identifiers and paths are left out.

    A sentence has at least ``least`` words of two letters or more, in Japanese
    one letter more than that. A text without any such sentence gives its
    shorter ones, so that every text with prose has some.
    """
    plain = _INLINE.sub(" x ", _FENCE.sub(lambda m: "\n" * m.group(0).count("\n") or "    ", clean_text(text)))
    out: list[tuple[int, str]] = []
    short: list[tuple[int, str]] = []
    for number, line in enumerate(plain.split("\n"), 1):
        if not line.strip():
            continue
        line = _BULLET.sub("", _SPEAKER.sub("", line))
        line = _NAME.sub(" ", _LINK.sub(" ", line))
        for sentence in _SENTENCE.split(line):
            if not sentence:
                continue
            if _KANA.search(sentence):
                (out if len(_LETTER.findall(sentence)) > least else short).append((number, sentence))
            elif (words := len(_CLAUSE_WORDS.findall(sentence))) >= least:
                out.append((number, sentence))
            elif words and not _CODE.search(sentence):
                short.append((number, sentence))
    return out or short


def prose_sentences(text: str, least: int = 3) -> list[str]:
    return [sentence for _, sentence in numbered_sentences(text, least)]


def folded(sentence: str) -> str:
    """A sentence by its words alone, in lower case."""
    return " ".join(re.findall(r"[^\W\d_]+'?", sentence.casefold()))


ORDERS = (1, 2, 3, 4)
BITS = 15
DIMS = 1 << BITS


def gram_hashes(sentences: list[str], orders=ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of all sentences: ``(bucket, sentence)`` of each, grouped by order."""
    texts = [f" {folded(s)} " for s in sentences]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(s) for s in texts])
    buckets, owners = [], []
    for n in orders:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for j in range(n):
            h = (h ^ codes[j : j + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        same = owner[:m] == owner[n - 1 :]
        buckets.append((h >> np.uint32(32 - bits))[same].astype(np.int64))
        owners.append(owner[:m][same])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate(buckets), np.concatenate(owners)


def language_of_label(label: Column) -> Column:
    """ISO 639-1 code a label names, or null: case, region, three-letter code and English name are understood."""
    key = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)(?:[-_].*)?$", 1))
    pairs = [x for code, names in NAMES.items() for name in (code, *names) for x in (F.lit(name), F.lit(code))]
    return F.try_element_at(F.create_map(*pairs), key)


def fit_line(buckets: np.ndarray, owner: np.ndarray, value: np.ndarray, side: np.ndarray, penalty: float, rounds: int, dims: int = DIMS, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a linear support vector machine: squared hinge loss by accelerated gradient steps; deterministic.

    ``side`` is 1, -1 or 0 (not used) of each sentence. Both sides weigh the
    same, however many sentences each has; ``weight`` is that within a side.
    """
    take = side[owner] != 0
    b, o = buckets[take], owner[take]
    weight = np.ones(len(side)) if weight is None else weight
    share = 0.5 * weight * ((side > 0) / max(weight[side > 0].sum(), 1e-300) + (side < 0) / max(weight[side < 0].sum(), 1e-300))
    w = np.zeros(dims)
    ahead, moment = w.copy(), 1.0
    rate = 1.0 / (2.0 * 1.5 + penalty)
    for _ in range(rounds):
        score = np.bincount(o, ahead[b], len(side)) * value
        slack = np.maximum(0.0, 1.0 - side * score) * (side != 0)
        pull = -2.0 * share * slack * side * value
        grad = np.bincount(b, pull[o], dims) + penalty * ahead
        new = ahead - rate * grad
        later = (1 + np.sqrt(1 + 4 * moment * moment)) / 2
        ahead = new + (moment - 1) / later * (new - w)
        w, moment = new, later
    return w
