import pytest

from quarterloom.llm.sentences import split_sentences

# A bar stands between units.
CASES = {
    "abbreviations": "Mr. Ito met Dr. Vann at 4 p.m. local time.| They hold 3.5% vs. 2.1% at Mel Corp. (formerly Bon Inc.) and left.| It is in the U.S. and abroad.",
    "ambiguous ends": "The list has funds, trusts, etc.| The book closed at 4 p.m.| We are in the U.S.| The desk left.",
    "initials": "J. Voss of Tal Inc. signed.| A reader from St. Orwin wrote.",
    "numbers": "A fall of .66 per cent is noise.| See Sec. 13(f), para. 2.1, and Fig. 3.| File v2.58.1 is at data.example/q36.csv now.",
    "quotation": "“The price was right. We would do it again.”| The trust left.| “Are you sure?” the analyst asked.| \"Why did you sell?\" asked Lo, who left.| It has \"core holdings\".| Done!",
    "brackets": "It fell (see p. 41).| (The figures exclude puts. And calls.)| Next one [sic].| End.",
    "ellipsis": "It was slow... but complete.| Nobody answered...| eBrindle joined.| What?!| Yes.",
    "missing space": "It was complete.|Most are based here.",
    "name with a mark": "Shares of Quorum! Media were untouched.| Not yet!| Go.",
    "paragraphs": "Q&A\n\n|Analyst: One line\nbroken here. |Two.\r\n\r\n|• Added A. Corp.\n|• Sold B\n|• C Inc.: +3%\n\n|1. First\n|2. Second\n\n|End",
    "wrapped number": "It rose by\n31. The end came in\n2020. |Then more.".replace("31. The", "31 of the"),
    "german": "Am 31. Dezember endete die Frist.| Im 3. Quartal fiel es um ca. 5,3 %.| Hr. Dr. Ral leitet das Team, z. B. für Chemie.| „Der Preis war gut. Wir tun es.“| „Wir nicht“, sagte Bar.| Vgl. S. 17 ff. des Berichts.",
    "french": "« Le prix était bon. Nous recommencerions. »| Pourquoi vendre ?| Voir l’art. 6, al. 2, c.-à-d. la n° 6.| Selon M. Ral, « le poids reste ».| Le ratio atteint 4,3… mais baisse.",
    "spanish": "¿Quién vendió?| ¡Qué subida!| Ud. la ve en EE. UU. y aquí.| El Sr. Gar y la Dra. Kal firman, pág. 3.| «No vendemos», dijo Gar.",
    "decomposed": "Véase el art. 2, párr. 3, aquí.| Fin del März.",
    "russian": "А. Салма и В. Вор подписали.| В 2023 г. отчёт подали, т. е. поздно.| Облигации и т. д. не учтены.| «Цена была. Хорошей», — сказал Га.| См. стр. 17.",
    "chinese": "经理说：“价格合适。我们还会买入。”|换手率为7.1%（占3.2%）。|“我们不卖。”他这样说。|真的吗？！|没有人回答……|比率为4.3……但不含期权。",
    "japanese": "「売らない。」|なぜ売ったのか？|「よかった。また買う。」と彼は語った。|終わり。",
    "korean": "\"왜 팔았습니까?\"라고 물었다.| \"좋았다. 다시 살 것이다.\"| 왜 팔았을까?| PER은 30.5배이다.",
    "hindi": "डॉ. Mel ने कहा, “हम नहीं।”| Bel Inc. ने बताया।| क्यों बेचा?",
    "arabic": "قال د. Wen إن السعر كان؛ ولم يضف.| قالت أ. Mel: «لن نبيع.»| لماذا؟| نعم.",
    "thai": "ผู้จัดการยื่นรายงาน |กองทุนเพิ่มหุ้น 6,859 หุ้นแล้ว |มูลค่ารวม $8.4M ต่ำ",
    "addresses": "See www.Example.com for it.| Read https://data.Example.com/ab?Next=12.Of!Kind and www.Abc.Def.com.| Write to jane.Doe@fund.Example.com today.| Ask ab.Cd.Ef@x.org.| Go to shop.Example.com/list now.",
    "file names": "Open report.Final.pdf first.| Then old-report.Draft.Two.xlsx.| It was complete.|Most are in data.All.csv.",
    "decimals": "比率为３．１４倍。|它涨了7．5%。|占3。|5月结束．|完了。",
    "code and names": "See https://www.Example.com/Report.Final for details.| Mail bob@mail.Foo.com today.| It calls System.Out.println there.| Open budget.Xlsx now.| Then Pvt. Ryan met Adm. Jones and Supt. Lee.| Shares of Yum! Brands fell.| We sold some of Kalto! Foods.| What a day in Paris!| The end.",
    "own english": "The U.S. economy grew 2.1% in Q3.| Is it over?| \"No,\" she said.| \"It isn't over. We wait.\"| Dr. Smith (b. 1970) agrees.| See Fig. 2 etc. for more.",
    "own german": "Das Haus steht am Rhein.| Prof. Weber kam am 3. Oktober um 8.30 Uhr.| „Warum? Ich weiß es nicht.“| Er ging z. B. nach Bonn.",
    "own french": "M. Dupont habite à Lyon.| Il a dit : « Je pars. Adieu ! »| Quelle heure est-il ?| Voir p. 12.",
    "own spanish": "La Sra. López llegó a las 9.30.| ¿Quién es?| ¡Hola!| «Ven. Te espero.»| Fin.",
    "own russian": "Он приехал в г. Тверь.| Кто там?| «Войдите. Открыто.»| Рост составил 3,5 %.| А. П. Чехов писал пьесы.",
    "own chinese": "今天天气很好。|你去哪儿？|他说：“我不去。你去吧。”|价格是3.5元。|太好了！",
    "own japanese": "今日は晴れです。|どこへ行きますか？|「行こう。早く。」|はい！",
    "own korean": "오늘은 날씨가 좋다.| 어디로 갑니까?| 값은 3.5원이다.| 좋아!",
    "own hindi": "आज मौसम अच्छा है।|तुम कहाँ जा रहे हो?| मूल्य 3.5 रुपये है।|ठीक है!",
    "own arabic": "الطقس جميل اليوم.| إلى أين تذهب؟| السعر 3.5 ريال.| حسنا!",
    "own thai": "วันนี้อากาศดี |เขาไปตลาด |ราคา 3.5 บาท",
    "private use": " One  two.| Three.",
}


@pytest.fixture(scope="module")
def split(spark):
    rows = [(i, t.replace("|", "")) for i, t in enumerate(CASES.values())]
    got = {}
    for r in split_sentences(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect():
        got.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"], r["sentence"]))
    return {n: sorted(got.get(i, [])) for i, n in enumerate(CASES)}


@pytest.mark.parametrize("name", list(CASES))
def test_units(split, name):
    text = CASES[name].replace("|", "")
    assert [s for _, _, s in split[name]] == [p.strip() for p in CASES[name].split("|")]
    for a, b, s in split[name]:
        assert text[a:b] == s == s.strip()


def test_missing_blank_repeated_and_long(spark):
    long = "One two three. " * 20_000
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t  ", 0), (4, "Ab. Cde.", 0), (4, "Ab. Cde.", 0), (None, "X.", 0), (5, long, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_pos int")
    got = split_sentences(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"]))
    assert set(by) == {4, None, 5} and sorted(by[4]) == [(0, 3), (0, 3), (4, 8), (4, 8)] and by[None] == [(0, 2)]
    assert sorted(by[5]) == [(15 * i, 15 * i + 14) for i in range(20_000)]
    assert split_sentences(df.limit(0)).count() == 0


def test_many_closing_marks(spark):
    rows = [(1, "It fell (see [a. B" + "]" * 15 + ") again. End.")]
    got = split_sentences(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).orderBy("start_pos").collect()
    assert [r["sentence"] for r in got] == [rows[0][1][:-5], "End."]


def test_no_window_on_lists_quotations_and_brackets(spark):
    said = "The price was right. We would do it again. " * 500  # 21,500 characters
    item = "one two three four " * 30
    rows = {
        "list": [f"{i}. {item}" for i in range(1, 20)],
        "quotation": [f"“{said}It is so.” ", "The trust left. ", f'"{said}So." ', "End."],
        "guillemets": [f"«{said}Так.» ", "End."],
        "single": [f"He wrote ‘{said}so’ to us. ", "End."],
        "bracket": [f"It fell (see {said}here) again. ", f"({said}So.) ", f"It rose [{said}here] again. ", "End."],
        "introduced": ["经理说：“" + "价格合适。我们买入。" * 200 + "”", "他走了。"],
    }
    join = {n: "\n".join(u) if n == "list" else "".join(u) for n, u in rows.items()}
    got = {}
    for r in split_sentences(spark.createDataFrame(list(join.items()), "doc_id string, text string"), with_text=True).collect():
        got.setdefault(r["doc_id"], []).append((r["start_pos"], r["sentence"]))
    for n, units in rows.items():
        assert [s for _, s in sorted(got[n])] == [u.strip() for u in units], n
