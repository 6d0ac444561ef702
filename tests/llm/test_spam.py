import pytest
from siltstone.llm import spam as S

SENTENCE = "In practice the retry queue always rewrites {} rows of the lock file before the {} starts."
TOPICS = "alias budget canary daily entity frontmatter graph hotspot index job kernel lint mapper".split()
PROSE = " ".join(SENTENCE.format(i, t) for i, t in enumerate(TOPICS))
SPAM = {
    "tags": " ".join(f"#Retry{t.capitalize()}2025" for t in TOPICS * 2),
    "links": "\n".join(f"https://www.example.net/free/{t}-{i}" for i, t in enumerate(TOPICS * 2)),
    "markdown links": "\n".join(f"- [free {t}](https://go.example.com/{t}-9)" for t in TOPICS * 2),
    "wiki links": "\n".join(f"[[{t}]] [[queue {t}]] [[deal]]" for t in TOPICS),
    "html links": " | ".join(f'<a href="https://go.example.org/{t}">cheap {t}</a>' for t in TOPICS),
    "keywords": ", ".join(f"buy {t}" for t in TOPICS * 3),
    "headings": "\n".join(f"## Best {t.capitalize()}\nbest {t} top queue best {t} best {t}" for t in TOPICS),
    "products": "\n".join(f"SKU-{1000 + i} | free {t} | sale | 9.99" for i, t in enumerate(TOPICS)),
    "fake sentences": " ".join("Free retry queue for best lock file. retry queue best lock file retry queue." for _ in range(12)),
    "one sentence first": SENTENCE.format(1, "job") + "\n\n" + "buy retry queue cheap lock file " * 40,
    "list of pages": "Partner pages:\n" + "\n".join(f"{i}. Cheap {t.capitalize()} > go.example.com/{t}-{i}.html" for i, t in enumerate(TOPICS)),
}
GOOD = {
    "prose": PROSE,
    "capitals": PROSE.upper(),
    "index": "# Index\n\n" + "\n".join(f"- [[concepts/{t}]] — {SENTENCE.format(i, t)}" for i, t in enumerate(TOPICS)),
    "glossary": "\n".join(f"**{t}**: {SENTENCE.format(i, t)}" for i, t in enumerate(TOPICS)),
    "changelog": "\n".join(f"- {i}.{i}: {SENTENCE.format(i, t)}" for i, t in enumerate(TOPICS)),
    "log": "\n".join(f"2025-05-0{1 + i % 9} 21:50 WARN {SENTENCE.format(i, t)}" for i, t in enumerate(TOPICS)),
    "table": "| path | note |\n|---|---|\n" + "\n".join(f"| /{t} | {SENTENCE.format(i, t)} |" for i, t in enumerate(TOPICS)),
    "code": SENTENCE.format(1, "job") + "\n\n```php\n" + "\n".join(f"$x{i} = new Store({i});" for i in range(40)) + "\n```",
    "bare code": "\n".join(f"$x{i} = new Store({i});" for i in range(40)),
    "one line": "`mapper_vitor_map` still merges `line_lintor_id()`.",
    "empty": "",
    "blank": " \n\n",
    "null": None,
}


SPAM |= {
    "keywords ending like code": "\n".join(f"cheap shoes buy {t} online cheap shoes;" for t in TOPICS * 4),
    "keywords opening like imports": "\n".join(f"import cheap {t} shoes import cheap shoes" for t in TOPICS * 3),
    "cyrillic keywords": ", ".join(f"купить {w} дёшево" for w in "обувь сумки часы телефон окна двери".split() * 4),
    "chinese keywords": "、".join(f"便宜{w}购买{w}" for w in "鞋子 手表 皮包 手机 窗户 电脑".split() * 5),
    "keyword sentences": " ".join(f"Osta {a} halvalla {b} netistä {a} halvalla {b}." for a in "kengät kello laukku".split() for b in "nyt heti tänään".split()),
    "prices": "\n".join(f"{t.upper()} • SALE • {i}.99 • FREE" for i, t in enumerate(TOPICS * 2)),
}
#: One paragraph of plain prose per language.
PROSE_IN = {
    "russian": "Вчера вечером мы долго искали ключ от старого сарая. Бабушка вспомнила, что отдала его соседу ещё весной. Сосед рассмеялся и принёс ключ вместе с банкой мёда. Теперь дети каждый день просят открыть дверь.",
    "polish": "Wczoraj wieczorem długo szukaliśmy klucza do starej szopy. Babcia przypomniała sobie, że oddała go sąsiadowi jeszcze wiosną. Sąsiad roześmiał się i przyniósł klucz razem ze słoikiem miodu.",
    "finnish": "Eilen illalla etsimme pitkään vanhan vajan avainta. Isoäiti muisti antaneensa sen naapurille jo keväällä. Naapuri nauroi ja toi avaimen hunajapurkin kanssa.",
    "italian": "Ieri sera abbiamo cercato a lungo la chiave del vecchio capanno. La nonna si ricordò di averla data al vicino già in primavera. Il vicino rise e portò la chiave insieme a un vasetto di miele.",
    "turkish": "Dün akşam eski kulübenin anahtarını uzun süre aradık. Büyükannem onu daha ilkbaharda komşuya verdiğini hatırladı. Komşu gülerek anahtarı bir kavanoz balla birlikte getirdi.",
    "hungarian": "Tegnap este sokáig kerestük a régi fészer kulcsát. A nagymama eszébe jutott, hogy még tavasszal odaadta a szomszédnak. A szomszéd nevetett, és egy üveg mézzel együtt hozta el a kulcsot.",
    "vietnamese": "Tối qua chúng tôi tìm mãi chiếc chìa khóa của nhà kho cũ. Bà nhớ ra rằng bà đã đưa nó cho người hàng xóm từ mùa xuân. Người hàng xóm cười và mang chìa khóa sang cùng một lọ mật ong.",
    "greek": "Χθες το βράδυ ψάχναμε ώρα το κλειδί της παλιάς αποθήκης. Η γιαγιά θυμήθηκε ότι το είχε δώσει στον γείτονα από την άνοιξη. Ο γείτονας γέλασε και έφερε το κλειδί μαζί με ένα βάζο μέλι.",
    "arabic": "بحثنا مساء أمس طويلا عن مفتاح المخزن القديم. تذكرت الجدة أنها أعطته للجار في الربيع. ضحك الجار وأحضر المفتاح مع جرة من العسل.",
    "hebrew": "אתמול בערב חיפשנו זמן רב את המפתח של המחסן הישן. סבתא נזכרה שנתנה אותו לשכן עוד באביב. השכן צחק והביא את המפתח יחד עם צנצנת דבש.",
    "hindi": "कल शाम हमने पुराने गोदाम की चाबी बहुत देर तक ढूँढी। दादी को याद आया कि उन्होंने उसे वसंत में पड़ोसी को दे दिया था। पड़ोसी हँसा और शहद के डिब्बे के साथ चाबी ले आया।",
    "chinese": "昨天晚上我们找旧仓库的钥匙找了很久。奶奶想起来春天的时候就把它交给了邻居。邻居笑着把钥匙和一罐蜂蜜一起送了过来。现在孩子们每天都要求把门打开。",
    "japanese": "昨日の夜、古い物置の鍵を長いあいだ探しました。祖母は春に隣の人へ渡したことを思い出しました。隣の人は笑って、はちみつの瓶といっしょに鍵を持ってきてくれました。",
    "korean": "어제 저녁에 우리는 낡은 창고의 열쇠를 오랫동안 찾았다. 할머니는 봄에 이웃에게 맡겼다는 것을 떠올렸다. 이웃은 웃으며 꿀 한 병과 함께 열쇠를 가져왔다.",
    "thai": "เมื่อคืนนี้พวกเราหากุญแจโรงเก็บของเก่าอยู่นานมาก ยายนึกขึ้นได้ว่าเคยฝากกุญแจไว้กับเพื่อนบ้านตั้งแต่ฤดูใบไม้ผลิ เพื่อนบ้านหัวเราะแล้วเอากุญแจมาให้พร้อมน้ำผึ้งหนึ่งขวด",
    "unpunctuated": "so yesterday evening we looked for the key of the old shed for a very long time and then grandma remembered that she had given it to the neighbour back in spring who only laughed and brought it over with a jar of honey",
}
GOOD |= PROSE_IN
GOOD |= {
    "wrapped": "> Day 729 was the second time that our dusty weather\n> vane log was moved by a drift and the other\n> ledger of my neighbour gave way, although the copper\n> registry still showed a hundred open entries.\n" * 3,
    "imports": "import os\nimport sys\nfrom pathlib import Path\n\n" + "\n".join(f"value_{i} = Path({i}).name" for i in range(20)) + "\nprint(value_3)",
    "log without stops": "\n".join(f"2025-05-0{1 + i % 9} 21:50:{i:02d} INFO the worker flushed {i} rows of the {t} and took the next job" for i, t in enumerate(TOPICS * 3)),
}


@pytest.mark.parametrize("kind", SPAM)
def test_spam(kind):
    assert S.judge(SPAM[kind])[0]


@pytest.mark.parametrize("kind", GOOD)
def test_not_spam(kind):
    assert not S.judge(GOOD[kind])[0]


def test_table(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*SPAM.values(), *GOOD.values()])] + [(0, SPAM["tags"], "again"), (99, PROSE * 500, "long")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spam string")
    assert sorted(r["doc_id"] for r in S.spam_pages(df).collect()) == sorted([0, *range(len(SPAM))])
    assert S.spam_pages(df.limit(0)).collect() == []
