"""Defective prompt and response pairs, each with the kind of its defect.

Method: character n-gram models are trained here.  A naive Bayes model gives the
language posterior of the prompt and of the response (without code, paths and quotes);
a pair whose response is surely in another language is flagged.  A language that the
table does not hold is known by its distance: how likely a text is, per n-gram, under
a language is set between n-grams never seen in it and what its own texts get, and a
text that stays near the lower end of all of them is in none of them.  A model of text endings gives the likelihood
that a response of its kind ends as this one does; an unlikely end is a truncation, as
are dangling list marks, open brackets and fences, marks of an ellipsis, and the
missing tail of a response that had to repeat the prompt.  Refusals are told by a second
naive Bayes model over sentences, fitted on seed sentences in nine languages and on
the sentences of the table that match a few patterns; a response is a refusal when
refusing sentences make up a good share of it.  Stand-ins and copies are told by
comparing words.

All models are fitted on all rows; languages in them are seeded by function words.

Scale: three scans: counts of n-grams, counts of ends, defects.  Counts are added up
over the tasks by slices of buckets and by n-gram; only sums and the ends that come often
go through the driver.  N-grams are hashed and scored for whole batches of texts at once.

Defined results for odd input: a null or invisible response is empty; a null prompt
has no language and cannot be copied; unknown modes are treated like rewrite but are
never copies; repeated rows are each judged; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 4
#: Buckets of hashed n-grams, as a power of two; characters scored in one step.
BUCKETS, STEP = 18, 500_000
#: Places that endings are marked on, as a power of two; buckets of counts that travel in one row.
MARKS, SLICE = 22, 1 << 15
#: N-grams that a text needs to be judged foreign to all languages, and the place between unseen (0) and
#: usual (1) likelihood below which it is.
KNOWN_GRAMS, OUTSIDE = 60, 0.35
#: Order of the refusals' n-grams; n-grams weighed together; log-odds, in nats, from which they refuse.
REFUSAL_ORDER, REFUSAL_SPANS, REFUSES = 5, (24, 64), 4.5
#: Log-odds from which a sentence is held against the patterns that label the sample.
DOUBTFUL = 0.5
#: How often each seed sentence is counted.
SEED_WEIGHT = 3
#: Posterior log-odds, in nats, that a foreign response needs; ends rarer than UNLIKELY are truncations,
#: as are ends rarer than USUAL that do not close anything.
SURE, UNLIKELY, USUAL, END_ORDER, END_SUPPORT = 6.0, 0.012, 0.5, 6, 25
#: Support of an ending as a share of the rows, where that is more.
END_SHARE = 25 / 8000

#: Function words that seed the languages of the sample.
SEEDS = {
    "en": "the and to is in of that it why does what for from with when please you can make so are keep".split(),
    "de": "der die das und ist nicht so dass den ein eine zu warum mit im auf kannst du ich möchte wenn bitte aus".split(),
    "fr": "le la les et est pas que des une un pour pourquoi dans avec quand tu je veux du sur mais ne".split(),
    "es": "el los las y es no que una un para por qué con cuando puedes quiero del lo pero en al se".split(),
}

#: Fillers of speech and labels that add nothing to a copy.
FILLERS = frozenset("um umm uh uhm er erm hm hmm so basically like well okay ok right hey yeah äh ähm also ja gut na nun euh ben bon alors bah eh pues bueno mira este o sea".split())
LABELS = frozenset("prompt rewritten enhanced improved output result answer response final text transcript here is the your umformuliert ergebnis résultat consigne texte resultado texto".split())

#: Words that stand in for content.
STAND_INS = frozenset("empty null none nil na n/a nan undefined blank tbd todo void leer vide vacio vacío nichts rien nada pending missing unavailable".split())

#: Refusals, by language: declining statements about the task at hand.
REFUSALS = [
    r"\b(?:i(?:'m| am) sorry|sorry|unfortunately|apologies)\b[^.!?\n]{0,60}\b(?:can(?:'t|not| not)|unable|won't|not able|not something)\b",
    r"\bsorry, no\b|\bnot something i can do\b",
    r"\bi (?:can(?:'t|not| not)|won't(?: be able to)?|will not|am not able to|am unable to|must decline|have to decline|decline to|refuse to|would rather not|do not feel comfortable|don't feel comfortable)\b[^.!?\n]{0,40}\b(?:rewrite|rephrase|produce|help|assist|comply|turn(?:ing)?|do|write|create|continue|process|work|fulfil\w*|answer|provide)\b",
    r"\bi must decline\b|\bi (?:do not|don't) feel comfortable\b|\bi(?:'m| am) unable to\b|\bi am not able to\b|\bi will not continue\b",
    r"\bagainst (?:my|our|the) (?:guidelines|policy|policies|rules)\b",
    r"\b(?:outside of|beyond) what i (?:may|can|am allowed to)\b|\bno prompt from my side\b|\bi have to stop at this point\b|\bwould not be appropriate\b",
    r"\b(?:kann|darf|werde|möchte|will) (?:ich|das|dies\w*)\b[^.!?\n]{0,60}\b(?:nicht|kein\w*)\b|\b(?:das|dabei|diese anfrage|dazu|hierbei) (?:kann|darf|werde|möchte) ich (?:leider )?nicht\b|\bich (?:kann|darf|werde|möchte|muss)\b[^.!?\n]{0,50}\b(?:nicht (?:helfen|bearbeiten|umformulieren|weiter\w*)|ablehnen|kein\w* (?:prompt|text|anweisung)\w*)",
    r"\b(?:ist|wäre) mir nicht (?:gestattet|erlaubt|möglich)\b|\bmöchte ich kein\w* prompt\b|\bes tut mir leid, (?:aber )?(?:dabei|das|ich)\b",
    r"\bje (?:suis désolée?, )?(?:je )?ne (?:peux|puis|souhaite|vais|suis) pas\b[^.!?\n]{0,40}\b(?:aider|reformuler|traiter|répondre|autorisée?|rédiger|travailler|continuer|en mesure)\b|\bje ne suis pas autorisée?\b|\bje dois (?:refuser|décliner)\b|\b(?:il m'est|il est) impossible de (?:reformuler|traiter|rédiger|répondre)\b|\bn'est pas possible de mon côté\b|\bje préfère ne (?:pas|rien)\b",
    r"\b(?:lo siento|lamentablemente|perdón)\b[^.!?\n]{0,30}\bno (?:puedo|me es)\b|\bno (?:puedo|podré) (?:ayudar|reformular|atender|continuar|procesar)\b|\bno me es posible\b|\bdebo (?:rechazar|declinar)\b|\bno tengo permiso\b|\bprefiero no (?:redactar|escribir|hacer|trabajar|responder)\b|\bno estoy autorizad[oa]\b",
]
_REFUSAL = [re.compile(p, re.I) for p in REFUSALS]
#: Words one of which every refusal that matches a pattern holds.
_REFUSAL_HINT = re.compile(r"n't|not\b|no\b|unable|declin|refus|against|outside|beyond|nicht|kein|ablehn|\bn[e']|impossible|préfère|rechaz|prefiero")
#: Sentences that refuse, and others like them that do not, by language.
REFUSING = """I'm sorry, but I can't help with that request. | Sorry, that is not something I can do. | I cannot rewrite this prompt for you. | I cannot help you with this. | I cannot answer this question. | I won't do that. | I am not able to assist with this. | I must decline this request. | I'd rather not write about this topic. | I am not allowed to respond to that. | As an assistant, I'm unable to provide this. | It is against my policy to work on this. | This would not be appropriate, so I have to stop here.
Es tut mir leid, dabei kann ich nicht helfen. | Diese Frage kann ich nicht beantworten. | Das werde ich nicht tun. | Ich darf dazu nichts schreiben. | Diese Anfrage muss ich ablehnen. | Das ist mir nicht gestattet. | Das ist mir leider nicht möglich. | Darauf möchte ich nicht antworten.
Je suis désolé, je ne peux pas vous aider. | Je ne peux pas répondre à cette question. | Je ne vais pas faire cela. | Je dois refuser cette demande. | Je ne suis pas autorisé à répondre. | Je préfère ne rien écrire à ce sujet. | Traiter ce texte n'est pas possible de mon côté.
Lo siento, no puedo ayudar con esa petición. | No puedo responder a esta pregunta. | No voy a hacer eso. | Debo rechazar esta solicitud. | No estoy autorizado a contestar. | No tengo permiso para trabajar en esto. | Prefiero no escribir sobre ese tema.
Mi dispiace, ma non posso aiutarti. | Non posso rispondere a questa domanda. | Non sono in grado di farlo. | Devo rifiutare questa richiesta. | Preferisco non scrivere su questo argomento.
Desculpe, mas não posso ajudar com isso. | Não posso responder a esta pergunta. | Não vou fazer isso. | Tenho de recusar este pedido. | Prefiro não escrever sobre este tema.
Het spijt me, maar ik kan je hier niet mee helpen. | Ik kan deze vraag niet beantwoorden. | Dat ga ik niet doen. | Ik moet dit verzoek weigeren.
Przykro mi, ale nie mogę w tym pomóc. | Nie mogę odpowiedzieć na to pytanie. | Nie zrobię tego. | Muszę odmówić tej prośbie.
Извините, но я не могу помочь с этим. | Я не могу ответить на этот вопрос. | Я не буду этого делать. | Я вынужден отклонить эту просьбу."""
ANSWERING = """Keep the public interface and do not touch the tests. | Find out why the request cannot be parsed and fix it. | The option must not change the result. | Explain the cause and answer in two sentences. | I think the topic of this question is the cache.
Lass die Schnittstelle gleich und ändere die Tests nicht. | Finde heraus, warum die Anfrage nicht gelesen werden kann. | Erkläre die Ursache und antworte in zwei Sätzen. | Ich glaube, dabei hilft ein neuer Test.
Garde l'interface publique et ne touche pas aux tests. | Trouve pourquoi la demande ne peut pas être lue. | Explique la cause et réponds en deux phrases. | Je crois que la question concerne le cache.
Mantén la interfaz pública y no toques las pruebas. | Averigua por qué la petición no se puede leer. | Explica la causa y responde en dos frases. | Creo que la pregunta trata de la caché.
Mantieni l'interfaccia pubblica e non toccare i test. | Scopri perché la richiesta non può essere letta. | Spiega la causa e rispondi in due frasi. | Credo che questa domanda riguardi la cache.
Mantenha a interface pública e não toque nos testes. | Descubra por que o pedido não pode ser lido. | Explique a causa e responda em duas frases.
Houd de interface gelijk en raak de tests niet aan. | Zoek uit waarom het verzoek niet gelezen kan worden. | Leg de oorzaak uit en antwoord in twee zinnen.
Zachowaj publiczny interfejs i nie zmieniaj testów. | Sprawdź, dlaczego nie można odczytać prośby. | Wyjaśnij przyczynę i odpowiedz w dwóch zdaniach.
Сохрани открытый интерфейс и не меняй тесты. | Выясни, почему запрос не читается. | Объясни причину и ответь двумя предложениями."""
#: Share of the response, in characters, that its refusing sentences and pleasantries must make up.
REFUSAL_SHARE = 0.45

_INVISIBLE = re.compile(r"[\s​-‏‪-‮⁠-⁤﻿­\xa0]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_FENCED = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_CODE = re.compile(r"`[^`\n]*`|\[\[[^\]\n]*\]?\]?|https?://\S+|\S*[/\\_@]\S*|\b\w*[a-zß-ÿ][A-Z]\w*\b|\b\w+\.(?:py|js|ts|md|php|twig|ya?ml|json|html|css|sh)\b|\d+")
_QUOTED = re.compile(r"^[ \t]*>.*$|\"[^\"\n]{0,400}\"|“[^”\n]{0,400}”|«[^»\n]{0,400}»|„[^“”\n]{0,400}[“”]", re.M)
_QUOTES = re.compile(r"[>\"“«„]")
_SENTENCE, _INNER = re.compile(r"(?<=[.!?。！？])\s+|\n+"), re.compile(r"(?<=\w)[./](?=\w)")
_UNLIKE = re.compile(r"\S*[\d_/`@]\S*|\b\w*[a-zß-ÿ][A-Z]\w*")
_CUT_ENDS = ".…])>\"'”’`"
_BREAK = re.compile(r"[\s()\[\]`\"<>]")
_CONTEXT = re.compile(r"^##+ *(?:context|kontext|contexte|contexto)\b.*\Z", re.I | re.M | re.S)
_DANGLING = re.compile(r"(?:\A|\n)[ \t]*(?:\d{1,3}[.)]|[-*+•]|#{1,6}|>)[ \t]*\Z")
_CUT_MARK = re.compile(r"(?:\.\.\.|…|[\[(<]\s*(?:\w+ ){0,3}(?:truncated|cut|continued|snip|omitted|(?:token|length|size|output|character) limit|max(?:imum)? (?:tokens?|length|output)|end of (?:output|buffer)|abgeschnitten|gekürzt|tronqué\w*|coupé\w*|truncad\w*|cortad\w*)\b[^\])>\n]{0,30}[\])>])[\"'”’`)\]]*\Z", re.I)


#: Paths, identifiers and addresses; an ending is judged by their kind, not their letters.
_NAMED = re.compile(r"[^\s()\[\]`\"<>]*[/\\_@][^\s()\[\]`\"<>]*")


def _named(m: re.Match) -> str:
    core = m.group().rstrip(".,;:!?")
    kind = re.search(r"\.[a-z]{1,5}\Z", core)
    return "\u00a7" + (kind.group() if kind else "") + m.group()[len(core) :]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_SPANS = re.compile(r"`[^`\n]*`|\[\[[^\]\n]*\]?\]?")
_plain: dict[str, str] = {}


def prose(text: str) -> str:
    """The text without code, paths, identifiers and numbers, in lower case with single blanks."""
    if "```" in text or "~~~" in text:
        text = _FENCED.sub(" ", text)
    if "`" in text or "[[" in text:
        text = _SPANS.sub(" ", text)
    if len(_plain) > 200_000:  # words are remembered; forgetting them changes no result
        _plain.clear()
    out = []
    for token in text.split():
        kept = _plain.get(token)
        if kept is None:
            kept = _plain[token] = " ".join(_CODE.sub(" ", token).lower().split())
        if kept:
            out.append(kept)
    return " ".join(out)


# --- models --------------------------------------------------------------------------------


def hashed(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, ends): the hashed n-grams of all texts, one blank around each, and where those of each text end."""
    lengths = np.array([len(t) + 2 for t in texts], np.int64)
    codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.maximum(lengths - order + 1, 0)
    if not counts.any():
        return np.empty(0, np.int64), np.cumsum(counts)
    h = np.zeros(max(len(codes) - order + 1, 0), np.uint64)
    for k in range(order):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(h)]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    whole = np.ones(len(codes), bool)
    stop = np.cumsum(lengths)
    for k in range(1, order):  # those that run over the end of their text
        whole[stop - np.minimum(k, lengths)] = False
    return (h >> np.uint64(64 - BUCKETS)).astype(np.int64)[whole[: len(h)]], np.cumsum(counts)


def _sums(weights: np.ndarray, buckets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of the weights of each text's n-grams."""
    total = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def _steps(texts: list[str]) -> Iterator[list[str]]:
    """The texts in parts of about STEP characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > STEP:
            yield part
            part, size = [], 0
    if part:
        yield part


def counted(texts: list[str], order: int) -> np.ndarray:
    """How many n-grams of the texts fall into each bucket."""
    return sum((np.bincount(hashed(p, order)[0], minlength=1 << BUCKETS) for p in _steps(texts)), np.zeros(1 << BUCKETS, np.int64))


class LanguageModel:
    """Character n-gram naive Bayes; posteriors over the languages it was fitted on, and what lies outside of them."""

    def __init__(self, weights: np.ndarray, unseen: np.ndarray, usual: np.ndarray, languages: tuple[str, ...]) -> None:
        self.weights, self.unseen, self.usual, self.languages = weights, unseen, usual, languages

    @staticmethod
    def fit(texts: dict[str, list[str]]) -> LanguageModel:
        languages = tuple(sorted(texts))
        counts = np.zeros((len(languages), 1 << BUCKETS))
        for row, lang in zip(counts, languages, strict=True):
            for part in _steps(texts[lang]):
                row += np.bincount(hashed(part, ORDER)[0], minlength=1 << BUCKETS)
        return LanguageModel.counted(counts, languages)

    @staticmethod
    def counted(counts: np.ndarray, languages: tuple[str, ...]) -> LanguageModel:
        """The model of so many n-grams of each language and bucket."""
        totals = counts.sum(1, keepdims=True) + 0.5 * ((counts > 0).any(0).sum() + 1)
        unseen = np.log(0.5 / totals[:, 0]) / ORDER
        weights = np.log((counts + 0.5) / totals).astype(np.float32)
        usual = (counts * weights).sum(1) / ORDER / np.maximum(counts.sum(1), 1)
        return LanguageModel(weights, unseen, usual, languages)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of each text per language, its n-grams); overlapping n-grams are counted at 1/order each."""
        out, many = [np.empty((0, len(self.languages)))], [np.empty(0, np.int64)]
        for part in _steps(texts):
            buckets, ends = hashed(part, ORDER)
            out.append(np.stack([_sums(w, buckets, ends) for w in self.weights], 1) / ORDER if len(self.weights) else np.empty((len(part), 0)))
            many.append(np.diff(ends, prepend=0))
        return np.concatenate(out), np.concatenate(many)

    def best(self, text: str) -> tuple[int, float, list[float]]:
        """(language, its lead over the next in nats, all scores)."""
        s = self.scores([text])[0][0]
        ranked = np.argsort(-s, kind="stable")
        return int(ranked[0]), float(s[ranked[0]] - s[ranked[1]]) if len(s) > 1 else 0.0, s.tolist()

    def foreign(self, asked: list[str], got: list[str]) -> np.ndarray:
        """Which of the texts ``got`` are surely not in the language of their counterpart in ``asked``."""
        if not self.languages or not asked:
            return np.zeros(len(asked), bool)
        (a, an), (g, gn) = self.scores(asked), self.scores(got)
        rows = np.arange(len(asked))
        want, have = a.argmax(1), g.argmax(1)
        lead = lambda s: np.diff(np.sort(s, 1)[:, -2:], axis=1)[:, 0] if s.shape[1] > 1 else np.full(len(s), np.inf)
        long = np.array([len(x) >= 12 and len(y) >= 12 for x, y in zip(asked, got, strict=True)], bool)
        # how near the most likely language comes to its usual likelihood
        place = lambda s, n: ((s / np.maximum(n, 1)[:, None] - self.unseen) / np.maximum(self.usual - self.unseen, 1e-9)).max(1)
        a_known, g_known = place(a, an) >= OUTSIDE, place(g, gn) >= OUTSIDE
        among = a_known & g_known & (want != have) & (lead(a) > 2.0) & (lead(g) > 2.0) & (g[rows, have] - g[rows, want] > SURE)
        outside = (a_known & ~g_known & (gn >= KNOWN_GRAMS)) | (~a_known & g_known & (an >= KNOWN_GRAMS))
        return long & (among | outside)


class RefusalModel:
    """Naive Bayes log-odds of a sentence being a refusal, by character n-grams."""

    def __init__(self, odds: np.ndarray) -> None:
        self.odds = odds

    @staticmethod
    def fit(refusing: list[str], others: list[str]) -> RefusalModel:
        return RefusalModel.counted(counted(refusing, REFUSAL_ORDER), counted(others, REFUSAL_ORDER))

    @staticmethod
    def counted(yes: np.ndarray, no: np.ndarray) -> RefusalModel:
        """The model of so many n-grams of refusals and of answers in each bucket."""
        # brought to one size first: what few refusals hold says little until the answers would have shown it
        no = no * (yes.sum() / max(no.sum(), 1))
        return RefusalModel((np.log(yes + 0.5) - np.log(no + 0.5)).astype(np.float32))

    def refuses(self, sentences: list[str]) -> np.ndarray:
        """The highest log-odds of any span of each sentence; n-grams never seen say nothing."""
        out = [np.empty(0)]
        for part in _steps(sentences):
            buckets, ends = hashed(part, REFUSAL_ORDER)
            starts = np.concatenate([[0], ends[:-1]])
            total = np.concatenate([[0.0], np.cumsum(self.odds[buckets], dtype=np.float64)])
            best = np.full(len(part), -np.inf)
            some = np.flatnonzero(ends > starts)
            for span in REFUSAL_SPANS if len(some) else ():
                last = np.minimum(np.arange(len(buckets)) + span, np.repeat(ends, ends - starts))
                best[some] = np.maximum(best[some], np.maximum.reduceat(total[last] - total[:-1], starts[some]))
            out.append(best / REFUSAL_ORDER)
        return np.concatenate(out)


class EndModel:
    """How likely a text ends after its last characters, from counts of n-grams and of ends."""

    def __init__(self, seen: dict[str, int], ends: dict[str, int]) -> None:
        self.seen, self.ends = seen, ends

    @staticmethod
    def shape(text: str) -> str:
        return re.sub(r"\d+", "9", _NAMED.sub(_named, text.rstrip()))

    @staticmethod
    def tail(text: str, order: int = END_ORDER) -> str:
        """The last characters of the whole text's shape; names and numbers do not run over blanks, so its end is enough."""
        if len(text) > 200 and (m := _BREAK.search(text, len(text) - 200)):
            t = EndModel.shape(text[m.end() :])
            if len(t) >= order:
                return t
        return EndModel.shape(text)

    @staticmethod
    def fit(texts: list[str], order: int = END_ORDER, least: int = END_SUPPORT) -> EndModel:
        shapes = [EndModel.shape(t) for t in texts]
        seen = EndModel.grams(shapes, order, least)
        ends = Counter(t[-k:] for t in shapes for k in range(1, min(order, len(t)) + 1))
        return EndModel(seen, {g: n for g, n in ends.items() if g in seen})

    @staticmethod
    def grams(shapes: list[str], order: int = END_ORDER, least: int = 1, marked: np.ndarray | None = None) -> dict[str, int]:
        """The n-grams of the shapes that come ``least`` times and, if given, fall on a place that is ``marked``."""
        lengths, joined = np.array([len(t) for t in shapes], np.int64), "".join(shapes)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        stop, seen = np.cumsum(lengths), {}
        whole, h = np.ones(len(codes), bool), np.zeros(len(codes), np.uint64)
        for k in range(1, order + 1):
            h = h[: max(len(codes) - k + 1, 0)] * np.uint64(0x9E3779B97F4A7C15) + codes[k - 1 :]
            if k > 1:
                whole[(stop - np.minimum(k - 1, lengths))[lengths > 0]] = False  # would run over the end of its text
            at = np.flatnonzero(whole[: len(h)])
            if marked is not None:
                at = at[marked[EndModel.place(h[at])]]
            _, first, n = np.unique(h[at], return_index=True, return_counts=True)
            seen |= {joined[i : i + k]: c for i, c in zip(at[first[n >= least]].tolist(), n[n >= least].tolist(), strict=True)}
        return seen

    @staticmethod
    def place(h: np.ndarray) -> np.ndarray:
        """Where a hashed n-gram falls among the MARKS."""
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - MARKS)).astype(np.int64)

    @staticmethod
    def marks(grams: list[str]) -> np.ndarray:
        """The places of n-grams, each once."""
        out = set()
        for k in {len(g) for g in grams}:
            same = [g for g in grams if len(g) == k]
            codes, h = np.frombuffer("".join(same).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, k), np.zeros(len(same), np.uint64)
            for c in codes.T:
                h = h * np.uint64(0x9E3779B97F4A7C15) + c
            out.update(EndModel.place(h).tolist())
        return np.array(sorted(out), np.int64)

    def likelihood(self, text: str, order: int = END_ORDER) -> float:
        """Of ending here, by the longest ending seen often enough."""
        t = self.tail(text, order)
        for k in range(min(order, len(t)), 0, -1):
            n = self.seen.get(t[-k:])
            if n:
                return self.ends.get(t[-k:], 0) / n
        return 1.0  # nothing known of such an end


def seed_language(plain: str) -> str | None:
    """The language whose function words clearly lead in a text's prose, else None."""
    hits = Counter(words(plain))
    score = sorted(((sum(hits[w] for w in seeds), lang) for lang, seeds in SEEDS.items()), reverse=True)
    return score[0][1] if score[0][0] >= 3 and score[0][0] >= 1.5 * score[1][0] else None


def sort_texts(rows: list[tuple[str | None, str | None, str | None]]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """(texts by language, prompts by mode) that the models are fitted on, of (transcript, prompt, mode)."""
    texts: dict[str, list[str]] = {lang: [] for lang in SEEDS}
    for transcript, prompt, _ in rows:
        for text in (transcript, prompt):
            if text and (lang := seed_language(plain := prose(text))):
                texts[lang].append(plain)
    return texts, sort_ends(rows)


def sort_ends(rows: list[tuple[str | None, str | None, str | None]]) -> dict[str, list[str]]:
    """The prompts by mode, without those that bear a mark of a cut."""
    ends: dict[str, list[str]] = defaultdict(list)
    for _, prompt, mode in rows:
        if prompt and (end := prompt.rstrip()) and not (end[-1] in _CUT_ENDS and _CUT_MARK.search(end)):
            ends[mode or ""].append(prompt)
    return ends


def sort_sentences(prompts: list[str | None]) -> tuple[list[str], list[str]]:
    """(refusing, others): the prompts' sentences by the patterns."""
    refusing, others = [], []
    for prompt in prompts:
        for s in sentences(prompt or ""):
            (refusing if _matches(s) else others).append(masked(s))
    return refusing, others


def seed_sentences() -> tuple[list[str], list[str]]:
    """(refusing, others) of the seeds, as often as they count."""
    each = lambda text: [masked(s.strip()) for line in text.splitlines() for s in line.split("|")]
    return each(REFUSING) * SEED_WEIGHT, each(ANSWERING) * SEED_WEIGHT


def support(rows: int) -> int:
    """How often an ending has to come among so many rows: in large tables the same cut comes often enough to look like an end."""
    return max(END_SUPPORT, round(END_SHARE * rows))


def fit(rows: list[tuple[str | None, str | None, str | None]]) -> tuple[LanguageModel, dict[str, EndModel]]:
    """The models of languages and of ends from (transcript, prompt, mode) of a few rows."""
    texts, ends = sort_texts(rows)
    return LanguageModel.fit({k: v for k, v in texts.items() if v}), {m: EndModel.fit(v, least=support(len(rows))) for m, v in ends.items()}


def fit_refusals(prompts: list[str | None]) -> RefusalModel:
    """The model of refusals from the seeds and the sentences of a few prompts."""
    (yes, no), (seed_yes, seed_no) = sort_sentences(prompts), seed_sentences()
    return RefusalModel.fit(seed_yes + yes, seed_no + no)


def train(rows: DataFrame) -> tuple[LanguageModel, dict[str, EndModel], RefusalModel]:
    """The models from all rows (transcript, enhanced_prompt, mode): counts of every task are added up.

    An end is only asked for where a text ends, so n-grams are counted at the ends that some
    text has: these are marked in one pass, and what falls on a mark is counted in the next.
    """
    kinds = [f"language {lang}" for lang in sorted(SEEDS)] + ["refusing", "others", "marks"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                yield list(zip(*(c.to_pylist() for c in part.columns), strict=True))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for chosen in parts(batches):
            texts, ends = sort_texts(chosen)
            found = [(f"language {lang}", counted(t, ORDER)) for lang, t in texts.items() if t]
            found += [(kind, counted(t, REFUSAL_ORDER)) for kind, t in zip(("refusing", "others"), sort_sentences([r[1] for r in chosen]), strict=True) if t]
            for kind, n in found:
                total[kind] = total.get(kind, 0) + n
            tails = list({t[-k:] for prompts in ends.values() for p in prompts for t in [EndModel.tail(p)] for k in range(1, min(END_ORDER, len(t)) + 1)})
            total.setdefault("marks", np.zeros(1 << MARKS, np.int64))[EndModel.marks(tails)] = 1
        cut = [(kind, k, n[k : k + SLICE]) for kind, n in total.items() for k in range(0, len(n), SLICE) if n[k : k + SLICE].any()]
        for kind, k, n in cut:
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([k], pa.int32()), pa.array([zlib.compress(n.tobytes(), 1)], pa.binary())], names=["kind", "at", "n"])

    def add(table: pa.Table) -> pa.Table:
        n = np.zeros(SLICE, np.int64)
        for x in table["n"]:
            n += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        kind = table["kind"][0].as_py()
        return pa.table({"kind": [kind], "at": pa.array([table["at"][0].as_py()], pa.int32()), "n": [zlib.compress((np.minimum(n, 1) if kind == "marks" else n).tobytes(), 1)]})

    shape = "kind string, at int, n binary"
    sums = {k: np.zeros(1 << (MARKS if k == "marks" else BUCKETS), np.int64) for k in kinds}
    for r in rows.mapInArrow(count, shape).groupBy("kind", "at").applyInArrow(add, shape).collect():  # as many rows as there are slices
        sums[r["kind"]][r["at"] : r["at"] + SLICE] = np.frombuffer(zlib.decompress(r["n"]), np.int64)
    marks = rows.sparkSession.sparkContext.broadcast(np.packbits(sums["marks"] > 0).tobytes())  # half a MB

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(np.frombuffer(marks.value, np.uint8)).astype(bool)
        for chosen in parts(batches):
            for mode, prompts in sort_ends(chosen).items():
                shapes = [EndModel.shape(p) for p in prompts]
                seen, ends = EndModel.grams(shapes, marked=marked), Counter(t[-k:] for t in shapes for k in range(1, min(END_ORDER, len(t)) + 1))
                yield pa.RecordBatch.from_arrays([pa.array([mode] * len(seen)), pa.array(list(seen)), pa.array(list(seen.values()), pa.int64()), pa.array([ends.get(g, 0) for g in seen], pa.int64())], names=["mode", "gram", "seen", "ends"])

    least = support(rows.count())
    known = rows.mapInArrow(tally, "mode string, gram string, seen bigint, ends bigint").groupBy("mode", "gram").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))
    modes: dict[str, EndModel] = {}
    for r in known.where((F.col("seen") >= least) & (F.col("ends") > 0)).toLocalIterator():  # usual ends only
        end = modes.setdefault(r["mode"], EndModel({}, {}))
        end.seen[r["gram"]], end.ends[r["gram"]] = r["seen"], r["ends"]
    languages = tuple(lang for lang in sorted(SEEDS) if sums[f"language {lang}"].any())
    counts = np.array([sums[f"language {lang}"] for lang in languages]).reshape(-1, 1 << BUCKETS)
    yes, no = (counted(t, REFUSAL_ORDER) for t in seed_sentences())
    return LanguageModel.counted(counts, languages), modes, RefusalModel.counted(yes + sums["refusing"], no + sums["others"])


# --- defects -------------------------------------------------------------------------------


_FRAME = re.compile(r"[ \t]*(?:#{1,6}(?:[ \t]|$)|```|~~~|---)")


def is_empty(prompt: str | None) -> bool:
    """No content, or only a stand-in, a heading or marks."""
    if prompt is None:
        return True
    if len(list(islice(_WORD.finditer(prompt), 5))) < 5:  # stand-ins have fewer words
        seen = _INVISIBLE.sub(" ", prompt).strip()
        bare = re.sub(r"[\W_]+", " ", seen).strip().lower()
        if not bare or re.sub(r"[\s\[\](){}<>\"'`*_.:-]+", "", seen.lower()) in STAND_INS or bare in STAND_INS or re.fullmatch(r"n ?a|no (?:content|output|prompt|text|answer|response)", bare):
            return True
    return all(_FRAME.match(line) or not _INVISIBLE.sub("", line) for line in prompt.splitlines())


def sentences(prompt: str) -> list[str]:
    """The sentences of a response, without its quotes and code."""
    text = unquoted(_FENCED.sub(" ", prompt) if "```" in prompt or "~~~" in prompt else prompt).replace("’", "'").strip()
    return [s for s in _SENTENCE.split(_INNER.sub("_", text)) if s.strip()] if text else []


def unquoted(text: str) -> str:
    return _QUOTED.sub(" ", text) if _QUOTES.search(text) else text


_mask: dict[str, str] = {}


def masked(sentence: str) -> str:
    """A sentence in lower case whose names and numbers are all alike."""
    if len(_mask) > 200_000:  # words are remembered; forgetting them changes no result
        _mask.clear()
    out = []
    for token in sentence.split():
        kept = _mask.get(token)
        if kept is None:
            kept = _mask[token] = _UNLIKE.sub("§", token).lower()
        out.append(kept)
    return " ".join(out)


def _matches(sentence: str) -> bool:
    return _REFUSAL_HINT.search(sentence.lower()) is not None and any(p.search(sentence) for p in _REFUSAL)


def is_refusal(found: list[str], odds: np.ndarray | list[float]) -> bool:
    """Whether a response of these sentences declines, by the log-odds of each."""
    # what a sample held too seldom to be sure of may still be one of the labelled forms
    refusing = {i for i, v in enumerate(odds) if v >= REFUSES or (v >= DOUBTFUL and _matches(found[i]))}
    if not refusing:
        return False
    first, last = min(refusing), max(refusing)
    # greetings before and offers after belong to the refusal
    kept = sum(len(s) for i, s in enumerate(found) if i in refusing or (i < first and len(s) < 30) or (i > last and len(s) < 80 and len(found) <= last + 3))
    return kept >= REFUSAL_SHARE * sum(map(len, found))


def is_copy(transcript: str, prompt: str) -> bool:
    """The transcript again, apart from fillers, labels, case, punctuation and spacing."""
    said, got = Counter(words(transcript)), Counter(words(prompt))
    extra, missing = got - said, said - got
    if any(w not in FILLERS and w not in LABELS for w in extra):
        return False
    lost = sum(n for w, n in missing.items() if w not in FILLERS)
    return bool(got) and lost <= 0.05 * sum(said.values())


def _closed(text: str, marks: str) -> bool:
    """Whether a text ends with one of the marks, whatever closes after it."""
    bare = text.rstrip("\"'”’)]`")
    return bool(bare) and bare[-1] in marks


def is_truncated(transcript: str | None, prompt: str, mode: str | None, ends: dict[str, EndModel]) -> bool:
    text = prompt.rstrip()
    last = text.splitlines()[-1]
    # both marks stand at the very end
    if (text[-1] in _CUT_ENDS and _CUT_MARK.search(text)) or _DANGLING.search("\n" + last):
        return True
    if ("```" in text or "~~~" in text) and len(re.findall(r"^[ \t]*(?:```|~~~)", text, re.M)) % 2:
        return True
    fence = re.match(r"[ \t]*(?:```|~~~)", last)
    if last.count("(") > last.count(")") or last.count("[") > last.count("]") or (last.count("`") % 2 and not fence) or text[-1] in ",;:([{/\\–—-":
        return True
    if mode == "clean" and transcript:
        said, got = [w for w in words(transcript) if w not in FILLERS], [w for w in words(text) if w not in FILLERS]
        if got and len(got) < len(said) and got[:-1] == said[: len(got) - 1] and said[len(got) - 1].startswith(got[-1]):
            return True
        if got == said and _closed(text, ".!?"):
            return False
    if mode == "clean" and not _closed(text, ".!?…"):
        return True
    model = ends.get(mode or "")
    if model is None:
        return False
    likelihood = model.likelihood(text)
    # a last line that neither closes a sentence nor is code, a path or the end of a quote has to be a usual end
    closes = fence or re.search(r"[.!?。][\"'”’»)\]`*_]*\Z|\.[a-z]{2,5}[)\]`]*\Z", last)
    quotes = transcript and re.match(r"[ \t]*>", last) and words(transcript)[-3:] == words(last)[-3:]
    return likelihood < UNLIKELY or (not closes and not quotes and likelihood < USUAL)


def defects_of(
    rows: list[tuple[str | None, str | None, str | None]], language: LanguageModel, ends: dict[str, EndModel], refusals: RefusalModel
) -> list[str | None]:
    """The kind of the defect of each (transcript, prompt, mode), or None."""
    kinds: list[str | None] = ["empty" if is_empty(prompt) else None for _, prompt, _ in rows]
    open_ = [i for i, k in enumerate(kinds) if k is None]
    for i in open_:
        transcript, prompt, mode = rows[i]
        if mode == "rewrite" and transcript and is_copy(transcript, prompt):
            kinds[i] = "copy"
    rest = [i for i in open_ if kinds[i] is None]
    parts = [sentences(rows[i][1]) for i in rest]
    odds = refusals.refuses([masked(s) for p in parts for s in p])
    at = 0
    for i, p in zip(rest, parts, strict=True):
        if p and is_refusal(p, odds[at : at + len(p)]):
            kinds[i] = "refusal"
        at += len(p)
    spoken = [i for i in open_ if kinds[i] is None and rows[i][0]]
    asked = [prose(rows[i][0]) for i in spoken]
    got = [prose(_CONTEXT.sub(" ", rows[i][1]) if rows[i][2] == "verbatim" else unquoted(rows[i][1])) for i in spoken]
    for i, foreign in zip(spoken, language.foreign(asked, got), strict=True):
        if foreign:
            kinds[i] = "other_language"
    for i in open_:
        if kinds[i] is None and is_truncated(*rows[i], ends):
            kinds[i] = "truncated"
    return kinds


def defects(history: DataFrame) -> DataFrame:
    """(entry_id, defect) of the defective entries.  ``history``: entry_id, transcript, enhanced_prompt, mode."""
    rows = history.select("entry_id", "transcript", "enhanced_prompt", "mode")
    language, ends, refuse = train(rows.drop("entry_id"))
    fitted = (language.weights, language.unseen, language.usual, language.languages, {m: (e.seen, e.ends) for m, e in ends.items()}, refuse.odds)
    shared = history.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(fitted), 1))  # bounded by buckets and by usual ends

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, unseen, usual, languages, modes, odds = pickle.loads(zlib.decompress(shared.value))
        model, tails, refusals = LanguageModel(weights, unseen, usual, languages), {m: EndModel(*e) for m, e in modes.items()}, RefusalModel(odds)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                ids, *columns = (c.to_pylist() for c in part.columns)
                found = [(e, k) for e, k in zip(ids, defects_of(list(zip(*columns, strict=True)), model, tails, refusals), strict=True) if k]
                yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in found], pa.int64()), pa.array([k for _, k in found], pa.string())], names=["entry_id", "defect"])

    return rows.mapInArrow(scan, "entry_id bigint, defect string")
