import pytest
from siltstone.llm import pairs as P

TALK = {
    "en": "please look at the list and find out why it is sorted wrong and keep the public interface of the parser",
    "de": "bitte schau dir die Liste an und finde heraus warum sie falsch sortiert ist und lass die Schnittstelle gleich",
    "fr": "regarde la liste et trouve pourquoi elle est mal triée mais garde l'interface publique et ne touche pas aux tests",
    "es": "mira la lista y averigua por qué está mal ordenada pero mantén la interfaz pública y no toques las pruebas",
}
ROWS = [(t, "Review it.\n\n- " + t + ".\n- " + t + ".", "rewrite") for t in TALK.values() for _ in range(30)]
LANGUAGE, ENDS = P.fit(ROWS)
REFUSALS = P.fit_refusals([r[1] for r in ROWS])


def judge(prompt, mode="rewrite", transcript=TALK["en"]):
    return P.defects_of([(transcript, prompt, mode)], LANGUAGE, ENDS, REFUSALS)[0]


@pytest.mark.parametrize("prompt", [None, "", " \n", "​", "\xa0", "```\n```", '""', "---", "…", "(empty)", "null", "N/A", "## Context\n", "# Heading\n\n"])
def test_empty(prompt):
    assert judge(prompt) == judge(prompt, "clean") == "empty"


@pytest.mark.parametrize(
    "prompt",
    [
        "Sorry, no. That is not something I can do.", "Hm. I cannot rewrite this prompt. Would you like to try a different topic?", "It is against my policy to work on the parser. You may want to ask a colleague.",
        "Es tut mir leid, dabei kann ich nicht helfen.", "Zu NimStore möchte ich keinen Prompt verfassen. Gern ein anderes Thema.", "An hooks/x.md zu arbeiten ist mir nicht gestattet.",
        "Je dois refuser de traiter cette requête.", "Écrire une consigne pour a/b.md n'est pas possible de mon côté.", "Bueno. Prefiero no redactar nada sobre a/B.ts.", "No me es posible reformular este texto.",
    ],
)
def test_refusal(prompt):
    assert judge(prompt) == "refusal"


@pytest.mark.parametrize(
    "prompt",
    [
        "I'm not going to answer that.", "I am not able to write about this request.", "I must refuse. I will not help with that topic.", "As an assistant I'd rather not respond to this.",
        "Leider darf ich diese Frage nicht beantworten.", "Dabei möchte ich nicht helfen.", "Je ne vais pas répondre à cette demande.", "Je préfère ne pas vous aider.",
        "No voy a responder a esa pregunta.", "Debo rechazar esta petición.", "Mi dispiace, non sono in grado di rispondere a questa richiesta.", "Não posso ajudar com este pedido.",
        "Ik kan dit verzoek niet beantwoorden.", "Nie mogę pomóc w tej prośbie.", "Я не могу помочь с этой просьбой.",
    ],
)
def test_refusals_that_no_pattern_or_seed_states(prompt):
    assert prompt not in P.REFUSING and judge(prompt) == "refusal"


@pytest.mark.parametrize("prompt", ["Find out why the parser cannot read the list and do not change the tests.", "The worker must not answer while the list is sorted. Keep it so.", "Explain why this topic is not in the list of names."])
def test_negations_are_no_refusals(prompt):
    assert judge(prompt) != "refusal"


def test_quoted_refusals_are_none():
    assert judge('Review the list and the parser of the file.\n\n- Find out why it is wrong.\n\nKeep the message "Sorry, I can\'t open it" unchanged.') is None


@pytest.mark.parametrize("make", [str, str.upper, lambda t: f'"{t}"', lambda t: "um so " + t.replace(" ", "\n", 5), lambda t: "Prompt: " + t.capitalize() + "."])
def test_copy_in_rewrite_only(make):
    assert judge(make(TALK["en"])) == "copy"
    assert judge(TALK["en"].capitalize() + ".", "clean") is None


#: The same request in languages without a model.
UNKNOWN = {
    "it": "guarda l'elenco e scopri perché è ordinato male ma lascia stare l'interfaccia pubblica del parser e i suoi test.",
    "pl": "spójrz na listę i sprawdź dlaczego jest źle posortowana ale nie zmieniaj publicznego interfejsu parsera.",
    "fi": "katso luetteloa ja selvitä miksi se on järjestetty väärin mutta pidä jäsentimen julkinen rajapinta ennallaan.",
    "ru": "посмотри на список и выясни почему он отсортирован неправильно но не меняй открытый интерфейс разборщика.",
    "zh": "请看一下这个列表并找出为什么排序不对但是请保持解析器的公共接口不变也不要动测试代码谢谢你的帮助请看一下这个列表并找出为什么排序不对但是请保持解析器的接口",
}


def test_other_language():
    for a in TALK:
        for b in TALK:
            want = None if a == b else "other_language"
            assert judge(TALK[b].capitalize() + ".", "clean", TALK[a]) == want or (a == b)
    for text in UNKNOWN.values():  # languages that the sample does not hold
        assert judge(text, "clean", TALK["en"]) == "other_language"
        assert judge(TALK["en"].capitalize() + ".", "clean", text) == "other_language"
    quote = "Review the parser and keep the names of the list.\n\n> " + TALK["de"]
    assert judge(quote) != "other_language"


@pytest.mark.parametrize("tail", ["...", "…", " [truncated]", "\n[output cut]", " <max tokens reached>", "\n\n4.", "\n- ", " (merge", "\n\n```py\nx = 1", " and the", ","])
def test_truncated(tail):
    assert judge("Review it.\n\n- " + TALK["en"] + ".\n- Find out why it is sorted wrong" + tail) == "truncated"


def test_missing_tail_of_a_tidied_transcript():
    assert judge(" ".join(TALK["en"].split()[:9]).capitalize(), "clean") == "truncated"


def test_whole_table(spark):
    rows = [(1, None, None, None, "x"), (2, TALK["en"], "", "clean", "x"), (3, None, TALK["en"] + ".", "rewrite", "x"), (2, TALK["en"], "", "clean", "x"), (4, TALK["en"], TALK["en"] * 3000 + ".", "other", "x")]
    df = spark.createDataFrame(rows, "entry_id bigint, transcript string, enhanced_prompt string, mode string, defect string")
    got = sorted((r["entry_id"], r["defect"]) for r in P.defects(df).collect())
    assert got[:3] == [(1, "empty"), (2, "empty"), (2, "empty")]
    assert P.defects(df.limit(0)).collect() == []


def test_language_accuracy_on_held_out_text(spark, small):
    """Languages that the documents table states, against the model fitted on dictated texts."""
    h = spark.read.parquet(f"{small}/whisper_history.parquet").select("transcript", "enhanced_prompt", "mode").collect()
    model, _ = P.fit([tuple(r) for r in h])
    docs = spark.read.parquet(f"{small}/documents.parquet").where("lang in ('en', 'de', 'fr', 'es') and n_chars > 300").select("text", "lang").collect()
    right = sum(model.languages[model.best(P.prose(r["text"])[:4000])[0]] == r["lang"] for r in docs)
    assert right >= 0.85 * len(docs)  # some of the stated languages are wrong


def test_long_refusals():
    many = " ".join(f"I cannot rewrite part {c} of this prompt for you." for c in "abcdefg")
    assert judge(many) == "refusal" and len(many) < 600
    assert judge("I cannot help with " + "the parser and its list of names " * 20 + "today.") == "refusal"
    assert judge("Review it. Keep the names of the parser and sort the list. " * 12 + "I cannot help with the rest.") != "refusal"


def test_ends_are_weighed_against_the_whole_text():
    model = P.EndModel.fit(["Keep the parser and " + "sort the list of names. " * 40 for _ in range(30)])
    assert model.seen["parser"] == 30 and model.likelihood("Keep the parser") == 0
