"""Telling declining sentences from courtesies and from answers: three linear machines over hashed character n-grams.

There are no labelled refusals, so the machines start from the sentences below
and are fitted again on all short replies that the first ones are sure of. Many
replies stay with the executors, which only send gradients. What is judged is never looked up: every sentence gets three margins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.language import fit_line, gram_hashes
from millrace.session import cut_lineage

KINDS = ("decline", "courtesy", "answer")
ORDERS = (3, 4, 5)
BITS = 16
ROUNDS = 40
PENALTY = 2e-4
# Distinct replies that are fitted on the driver, and sentences of a task where there are more.
HERE, TASK = 15_000, 20_000
SURE = 0.3
LEAD = 0.3

# A few plain sentences a language: declining to answer; what surrounds it; and statements about what
# a program can't do, which are answers.
SEEDS = {
    "decline": """
I am sorry, but I cannot help you with this. I can't answer this question. I am unable to assist with that request. I have to decline this request. I must refuse to do that.
I would rather not talk about this topic. I am not allowed to discuss this. My rules do not permit me to answer. My guidelines don't allow me to say anything about it. I won't do that.
This is something that I will not do. I can't comply with this. That is beyond what I may talk about. This is not a question that I answer. I have to turn this request down. I can't give any information on this. No comment on this question. I'd rather not discuss this. It would go against my guidelines. That lies outside of what I can help with. This is outside of what I may discuss. I am not permitted to do this. I'm not allowed to help here. As an assistant I may not do that.
Es tut mir leid, aber ich kann dir dabei nicht helfen. Ich kann diese Frage nicht beantworten. Diese Anfrage muss ich leider ablehnen. Ich darf dazu nichts sagen. Dazu möchte ich nichts sagen.
Meine Regeln erlauben mir keine Antwort darauf. Meine Richtlinien erlauben mir nicht, darüber zu sprechen. Darüber möchte ich lieber nicht reden. Leider darf ich das nicht tun. Dazu kann ich keine Auskunft geben. Dabei kann ich nicht helfen.
Je suis désolé, mais je ne peux pas vous aider. Je ne peux pas répondre à cette question. Je dois refuser cette demande. Je préfère ne pas en parler. Je ne suis pas autorisé à répondre.
Mes règles ne me permettent pas de répondre. Mes consignes m'interdisent d'en parler. Malheureusement, je dois décliner. Je ne souhaite pas m'exprimer sur ce sujet. Je ne peux donner aucune information à ce sujet. Je ne peux pas vous aider avec cela.
Lo siento, pero no puedo ayudarte con eso. No puedo responder a esta pregunta. Debo rechazar esta solicitud. Prefiero no hablar de este tema. No me está permitido responder. No estoy autorizado a hablar de eso.
Mis normas no me permiten responder. Mis instrucciones no me dejan hablar de ello. Lamentablemente tengo que negarme. No puedo dar ninguna información sobre esto. No puedo ayudar con esta petición.
Mi dispiace, ma non posso aiutarti. Non posso rispondere a questa domanda. Devo rifiutare questa richiesta. Preferisco non parlarne. Non mi è permesso rispondere. Non sono autorizzato a parlare di questo argomento.
Le mie regole non mi permettono di rispondere. Le mie istruzioni non mi lasciano parlare di questo. Purtroppo devo dire di no. Non posso dare nessuna informazione su questo. Non posso aiutare con questa richiesta.
Lamento, mas não posso ajudar. Não posso responder a esta pergunta. Tenho de recusar este pedido. Prefiro não falar disso. Não me é permitido responder. Não estou autorizado a falar sobre esse assunto.
As minhas regras não me permitem responder. As minhas instruções não me deixam falar disso. Infelizmente devo recusar. Não posso dar nenhuma informação sobre isto. Não posso ajudar com este pedido.
Het spijt me, maar daar kan ik je niet bij helpen. Ik kan deze vraag niet beantwoorden. Ik moet dit verzoek weigeren. Dit verzoek moet ik helaas afwijzen. Daar praat ik liever niet over. Ik mag daar niets over zeggen.
Mijn regels staan mij niet toe te antwoorden. Mijn richtlijnen laten dat niet toe. Helaas mag ik dat niet doen. Daar kan ik geen informatie over geven. Hier kan ik niet mee helpen.
К сожалению, я не могу вам помочь. Я не могу ответить на этот вопрос. Я вынужден отказаться. Я предпочитаю об этом не говорить. Мои правила не позволяют мне отвечать. Мне не разрешено обсуждать это.
申し訳ありませんが、お手伝いできません。この質問にはお答えできません。そのご依頼はお断りします。規則によりお話しできません。その件については回答を控えさせていただきます。
""",
    "courtesy": """
I am sorry. My apologies. Please excuse me. Thank you for your question. Thanks for asking about this. I understand that you want to change this. I see why you ask. Please ask somebody else. Please ask the person who looks after it. Please choose another topic. I hope you understand. Can I do something else for you?
Es tut mir leid. Entschuldigung. Danke für die Frage. Danke für deine Frage dazu. Ich verstehe, dass du das ändern willst. Bitte frage jemand anderen. Bitte wähle ein anderes Thema. Ich hoffe auf dein Verständnis.
Je suis désolé. Toutes mes excuses. Merci pour la question. Merci de votre question à ce sujet. Je comprends que vous vouliez changer cela. Adressez-vous à une autre personne. Choisissez un autre sujet.
Lo siento. Mis disculpas. Gracias por la pregunta. Gracias por preguntar por eso. Entiendo que quieras cambiarlo. Pregunta a otra persona. Elige otro tema, por favor.
Mi dispiace. Mi scuso. Grazie per la domanda. Grazie di aver chiesto. Capisco che tu voglia cambiarlo. Chiedi a un'altra persona. Scegli un altro argomento, per favore.
Lamento. Peço desculpa. Obrigado pela pergunta. Obrigada por perguntar. Compreendo que queiras mudar isso. Pergunta a outra pessoa. Escolhe outro assunto, por favor.
Het spijt me. Mijn excuses. Bedankt voor de vraag. Dank voor je vraag. Ik begrijp dat je dit wilt veranderen. Vraag het aan iemand anders. Kies een ander onderwerp.
Извините. Спасибо за вопрос. Я понимаю, что вы хотите это изменить. Спросите кого-нибудь другого. Выберите другую тему.
申し訳ありません。ご質問ありがとうございます。別の話題をお選びください。担当の方にお尋ねください。
""",
    "answer": """
I can't reproduce the crash on my machine. It can't return null here. The program is not able to read the file. The rules do not allow a space in the name. You must not call this function twice. I cannot see any problem in this code. I would rather use a list than a map. This request is refused by the server. Yes. No. Done. It is three. See the notes. No, it is private. Please check the other file. I understand the code now, and it reads past the end. Sorry for the confusion, it is the second one. The call was declined because the list was empty. I have to turn the cache off before the test. Unfortunately I can't reproduce the error here, but the function gives up too early. I am sorry for the delay, the test has passed now. Whoever moves the file must also change the path.
Ich kann den Fehler nicht nachstellen. Das Programm kann die Datei nicht lesen. Die Regeln erlauben kein Leerzeichen im Namen. Die Anfrage wird vom Server abgelehnt. Ja. Nein. Erledigt. Siehe die Hinweise. Nein, das ist privat. Bitte prüfe die andere Datei. Ich verstehe den Code jetzt. Leider kann ich den Fehler hier nicht nachstellen, aber die Funktion gibt zu früh auf. Wer die Datei verschiebt, muss auch den Pfad ändern.
Je ne peux pas reproduire l'erreur. Le programme ne peut pas lire le fichier. Les règles ne permettent pas d'espace dans le nom. La demande est refusée par le serveur. Oui. Non. C'est fait. Voir les notes. Merci de vérifier l'autre fichier. Malheureusement, je ne peux pas reproduire l'erreur ici, mais la fonction s'arrête trop tôt. Si vous déplacez le fichier, il faut aussi changer le chemin.
No puedo reproducir el error. El programa no puede leer el archivo. Las normas no permiten espacios en el nombre. La petición es rechazada por el servidor. Sí. No. Hecho. Mira las notas. Por favor, revisa el otro archivo. Lamentablemente no puedo reproducir el error aquí, pero la función termina demasiado pronto. Si mueves el archivo, también hay que cambiar la ruta.
Non posso riprodurre l'errore. Il programma non può leggere il file. Le regole non permettono spazi nel nome. La richiesta viene rifiutata dal server. Sì. No. Fatto. Vedi le note. Per favore controlla l'altro file. Purtroppo non posso riprodurre l'errore qui, ma la funzione finisce troppo presto. Se sposti il file, bisogna cambiare anche il percorso.
Não consigo reproduzir o erro. O programa não pode ler o ficheiro. As regras não permitem espaços no nome. O pedido é recusado pelo servidor. Sim. Não. Feito. Vê as notas. Por favor, verifica o outro ficheiro. Infelizmente não consigo reproduzir o erro aqui, mas a função termina cedo demais. Se moveres o ficheiro, também tens de mudar o caminho.
Ik kan de fout niet nabootsen. Het programma kan het bestand niet lezen. De regels staan geen spatie in de naam toe. Het verzoek wordt door de server geweigerd. Ja. Nee. Klaar. Zie de notities. Kijk even naar het andere bestand. Helaas kan ik de fout hier niet nabootsen, maar de functie stopt te vroeg. Wie het bestand verplaatst, moet ook het pad aanpassen.
Я не могу воспроизвести ошибку. Программа не может прочитать файл. Правила не допускают пробелов в имени. Да. Нет. Готово. К сожалению, я не могу воспроизвести ошибку здесь, но функция завершается слишком рано.
エラーを再現できません。プログラムはファイルを読めません。名前に空白は使えません。はい。いいえ。完了しました。
""",
}


class TalkMachines:
    """One machine for each kind against the other two; the greatest margin names the kind."""

    def __init__(self):
        self.weights = np.zeros((1 << BITS, len(KINDS)), dtype=np.float32)

    def fit(self, sentences: list[str], kinds: list[str], weight: np.ndarray | None = None, penalty: float = PENALTY) -> TalkMachines:
        buckets, owner = gram_hashes(sentences, ORDERS, BITS)
        per = np.bincount(owner, minlength=len(sentences))
        value = 1.0 / np.sqrt(np.maximum(per, 1))
        label = np.array([KINDS.index(x) for x in kinds])
        for k in range(len(KINDS)):
            self.weights[:, k] = fit_line(buckets, owner, value, np.where(label == k, 1.0, -1.0), penalty, ROUNDS, 1 << BITS, weight)
        return self

    def margins(self, sentences: list[str]) -> np.ndarray:
        """``(sentence, kind)``."""
        out = np.zeros((len(sentences), len(KINDS)))
        buckets, owner = gram_hashes(sentences, ORDERS, BITS)
        per = np.bincount(owner, minlength=len(sentences)).astype(np.float64)
        order = np.argsort(owner, kind="stable")
        owner, buckets = owner[order], buckets[order]
        if len(owner):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[starts]] = np.add.reduceat(self.weights[buckets], starts, axis=0)
        return out / np.sqrt(np.maximum(per, 1))[:, None]


def declines(margins: np.ndarray) -> bool:
    """Whether a reply with these margins of its sentences declines and helps with nothing.

    A sentence declines if it is rather that than an answer by ``LEAD``,
    whatever courtesy it holds; no sentence may be an answer first of all.
    """
    return bool((margins[:, 0] - margins[:, 2] > LEAD).any() and (margins.argmax(axis=1) != 2).all())


def seed_sentences(split) -> tuple[list[str], list[str]]:
    sentences, kinds = [], []
    for kind, text in SEEDS.items():
        for line in text.split("\n"):
            mine = split(line)
            sentences += mine
            kinds += [kind] * len(mine)
    return sentences, kinds


def fit_talk(replies: list[list[str]], split, rounds: int = 4) -> TalkMachines:
    """Machines from the seeds and from the sentences of ``replies``, which are answers unless a fit is sure that the reply declines.

    All unlabelled answers together weigh as much as those among the seeds,
    since refusals that are not known yet hide among them.
    """
    first, kinds = seed_sentences(split)
    seen = sorted({s for reply in replies for s in reply} - set(first))
    place = {s: i for i, s in enumerate(seen)}
    spots = [np.array([place.get(s, -1) for s in reply]) for reply in replies if reply]
    hidden = kinds.count("answer") / max(len(seen), 1)
    label = np.full(len(seen), 2)
    for _ in range(rounds):
        weight = np.concatenate([np.ones(len(first)), np.where(label == 2, hidden, 1.0)])
        model = TalkMachines().fit(first + seen, kinds + [KINDS[k] for k in label], weight)
        margins = np.vstack([model.margins(seen), np.array([-1.0, -1.0, 1.0])])
        fresh = sure_kinds(spots, margins)
        if (fresh[:-1] == label).all():
            break
        label = fresh[:-1]
    return model


def sure_kinds(spots: list[np.ndarray], margins: np.ndarray) -> np.ndarray:
    """The kind of each sentence by the replies it is in, given as rows of ``margins``: answers unless a reply surely declines."""
    fresh = np.full(len(margins), 2)
    for spot in spots:
        mine = margins[spot]
        # One sentence is surely no answer, and none is surely one.
        if (mine[:, 0] - mine[:, 2]).max() > SURE and (mine[:, 2] - mine[:, :2].max(axis=1)).max() < SURE:
            fresh[spot] = np.where(mine[:, 0] >= mine[:, 1], 0, 1)
    return fresh


def _hash_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buckets, owner = gram_hashes(batch.column(0).to_pylist(), ORDERS, BITS)
        ends = 2 * np.cumsum(np.bincount(owner, minlength=len(batch)))
        raw = pa.py_buffer(buckets[np.argsort(owner, kind="stable")].astype(np.uint16).tobytes())
        made = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), raw])
        yield pa.RecordBatch.from_arrays([batch.column(0), made], ["s", "buckets"])


def _pull(ahead: np.ndarray, buckets: np.ndarray, owner: np.ndarray, label: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The sentences' part of the gradient of each machine's loss, ``(kind, bucket)``; ``share[k, l]`` is what a sentence of kind ``l`` weighs for machine ``k``."""
    value = 1.0 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(label)), 1))
    out = np.zeros(ahead.shape)
    for k in range(len(KINDS)):
        side = np.where(label == k, 1.0, -1.0)
        slack = np.maximum(0.0, 1.0 - side * np.bincount(owner, ahead[k][buckets], len(label)) * value)
        out[k] = np.bincount(buckets, (-2.0 * share[k, label] * slack * side * value)[owner], ahead.shape[1])
    return out


def _pull_rows(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, share = sent.value
        total = np.zeros(ahead.shape)
        for batch in batches:
            grams, label = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            owner = np.repeat(np.arange(len(label)), [len(x) // 2 for x in grams])
            total += _pull(ahead, np.frombuffer(b"".join(grams), dtype=np.uint16).astype(np.int64), owner, label, share)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return run


def _sure_rows(model, known: frozenset[str]):
    """Sentences of replies that surely decline, with their kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = [x for x in batch.column(0).to_pylist() if x]
            seen = sorted({s for reply in replies for s in reply} - known)
            place = {s: i for i, s in enumerate(seen)}
            margins = np.vstack([*(model.value.margins(seen[at : at + 1000]) for at in range(0, len(seen), 1000)), np.array([[-1.0, -1.0, 1.0]])])
            kinds = sure_kinds([np.array([place.get(s, -1) for s in reply]) for reply in replies], margins)[:-1]
            sure = np.flatnonzero(kinds != 2)
            yield pa.RecordBatch.from_arrays([pa.array([seen[i] for i in sure], pa.string()), pa.array(kinds[sure], pa.int32())], ["s", "label"])

    return run


def fit_talk_of(replies: DataFrame, split, rounds: int = 4, here: int = HERE) -> TalkMachines:
    """What ``fit_talk`` makes of all ``replies``, an array of sentences each.

    Up to ``here`` distinct ones are fitted on the driver. Of more of them every
    step's gradient is summed by the executors, a matrix of a fixed size a task.
    """
    replies = cut_lineage(replies.where(F.size("said") > 0).distinct())
    if replies.count() <= here:
        return fit_talk([r.said for r in replies.collect()], split, rounds)
    first, kinds = seed_sentences(split)
    own = np.array([KINDS.index(x) for x in kinds])
    buckets, owner = gram_hashes(first, ORDERS, BITS)
    spark, known = replies.sparkSession, frozenset(first)
    seen = replies.select(F.explode("said").alias("s")).distinct().where(~F.col("s").isin(*first))
    seen = cut_lineage(seen.mapInArrow(_hash_grams, "s string, buckets binary"))
    many = seen.count()
    hidden = kinds.count("answer") / max(many, 1)
    labelled = spark.createDataFrame([], "s string, label int")
    for _ in range(rounds):
        rows = seen.join(labelled, "s", "left").select("buckets", F.coalesce("label", F.lit(2)).alias("label"))
        rows = cut_lineage(rows.repartition(min(48, -(-many // TASK))))
        number = np.zeros(len(KINDS))
        for r in rows.groupBy("label").count().collect():
            number[r["label"]] = r["count"]
        each = np.array([1.0, 1.0, hidden])  # what an unlabelled sentence weighs
        total = np.bincount(own, minlength=len(KINDS)) + number * each
        side = np.where(np.eye(len(KINDS), dtype=bool), total, total.sum() - total[:, None])
        share = 0.5 / np.maximum(side, 1e-300)
        w = np.zeros((len(KINDS), 1 << BITS))
        ahead, moment, rate = w.copy(), 1.0, 1.0 / (2.0 * 1.5 + PENALTY)
        for _ in range(ROUNDS):
            sent = spark.sparkContext.broadcast((ahead, share * each))
            grad = _pull(ahead, buckets, owner, own, share) + PENALTY * ahead
            for r in rows.mapInArrow(_pull_rows(sent), "total binary").collect():
                grad += np.frombuffer(r["total"]).reshape(grad.shape)
            sent.destroy()
            new = ahead - rate * grad
            later = (1 + np.sqrt(1 + 4 * moment * moment)) / 2
            ahead = new + (moment - 1) / later * (new - w)
            w, moment = new, later
        model = TalkMachines()
        model.weights = w.T.astype(np.float32)
        before = labelled
        sure = replies.mapInArrow(_sure_rows(spark.sparkContext.broadcast(model), known), "s string, label int")
        labelled = cut_lineage(sure.distinct())
        if labelled.exceptAll(before).isEmpty() and before.exceptAll(labelled).isEmpty():
            break
    return model
