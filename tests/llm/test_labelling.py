"""The conditional random field against enumeration, and what it labels on pages and texts of other kinds
than those of the tables."""

import itertools
import time
import unicodedata

import numpy as np
import pytest

from shelfmark.llm import crf, html_extract, quality_rules


def plain_score(field, items, labels):
    total = field.start[labels[0]]
    for i, (f, y) in enumerate(zip(items, labels, strict=True)):
        total += sum(field.weights[x][y] for x in f if x in field.weights)
        if i:
            total += field.transitions[labels[i - 1]][y]
    return total


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    field = crf.Crf({f"f{i}": rng.normal(size=2) for i in range(6)}, rng.normal(size=(2, 2)), rng.normal(size=2))
    sequences = [[[f"f{rng.integers(8)}" for _ in range(rng.integers(0, 4))] for _ in range(n)] for n in (1, 2, 3, 5, 8, 8, 1, 4)]
    for items, got in zip(sequences, field.decode(sequences), strict=True):
        best = max(itertools.product((0, 1), repeat=len(items)), key=lambda y: plain_score(field, items, y))
        assert plain_score(field, items, got) == pytest.approx(plain_score(field, items, best))


def test_training_climbs_the_likelihood_of_enumeration():
    rng = np.random.default_rng(4)
    sequences, gold = [], []
    for _ in range(30):
        y = [int(rng.random() < 0.5)]
        for _ in range(rng.integers(0, 5)):
            y.append(y[-1] if rng.random() < 0.8 else 1 - y[-1])
        gold.append(y)
        sequences.append([[f"is{v}" if rng.random() < 0.8 else "odd", "bias"] for v in y])

    def loss(field, l2):
        total = -0.5 * l2 * sum((p**2).sum() for p in (*field.weights.values(), field.transitions, field.start))
        for items, y in zip(sequences, gold, strict=True):
            every = [plain_score(field, items, z) for z in itertools.product((0, 1), repeat=len(items))]
            total += plain_score(field, items, y) - np.logaddexp.reduce(every)
        return total

    field = crf.train(sequences, gold, l2=0.5, rounds=400)
    best = loss(field, 0.5)
    for p in (*field.weights.values(), field.transitions, field.start):  # no small step from there is better
        for at in np.ndindex(p.shape):
            for step in (1e-2, -1e-2):
                p[at] += step
                assert loss(field, 0.5) < best + 1e-4
                p[at] -= step


PAGES = [
    ('<article><p>Before the script there is text here.</p><script src="a.js"/>code()</script><p>After it more text follows.</p></article>', "Before the script there is text here. After it more text follows."),
    ("<article><p>Energy equals mass times velocity squared, they said.</p></article>", "Energy equals mass times velocity squared, they said."),
    ("<html><body><div><a href=/>Home</a> <a href=/a>About</a></div><div><h1>Rain in the hills</h1><p>The rain came early this year, and the river rose above the old bridge before noon.</p><p>Nobody in the village had seen the like, said the miller, who has lived there for sixty years.</p></div><div>Copyright 2020 Example Inc. All rights reserved.</div></body></html>", "Rain in the hills The rain came early this year, and the river rose above the old bridge before noon. Nobody in the village had seen the like, said the miller, who has lived there for sixty years."),
    ("<main><p>The area is <math><mi>a</mi><mo>=</mo><mn>4</mn></math> square metres, as the builder told us.</p><noscript>Switch on the lights to see the full plan.</noscript></main>", "The area is a=4 square metres, as the builder told us. Switch on the lights to see the full plan."),
    ("<html><body><nav><a href=/>Home</a><a href=/b>Poems</a></nav><article><h1>The gull</h1><p>The gull goes out<br>over the grey,<br>and what it saw<br>it will not say.</p></article><footer>Written by nobody</footer></body></html>", "The gull The gull goes out over the grey, and what it saw it will not say."),
    ("<body><ul class=menu><li><a href=/>Start</a><li><a href=/r>Recipes</a></ul><main><h1>Barley soup</h1><ul><li>200 g barley<li>1 onion<li>2 carrots</ul><ol><li>Soak the barley.<li>Fry the onion and add everything.<li>Cook for an hour.</ol></main><aside><h3>More recipes</h3><a href=/1>Bean soup</a><a href=/2>Pea soup</a></aside></body>", "Barley soup 200 g barley 1 onion 2 carrots Soak the barley. Fry the onion and add everything. Cook for an hour."),
    ('<body><div id="gdpr-consent"><p>We use cookies to improve your experience.</p><button>OK</button></div><div class="post"><h2>Notes on bees</h2><p>Bees return to the same flowers until the nectar is gone, and then they dance for new ones.</p></div><div class="comments"><h3>2 comments</h3><div class="c"><b>Tom</b><p>Nice piece about the bees, thank you.</p></div></div></body>', "Notes on bees Bees return to the same flowers until the nectar is gone, and then they dance for new ones."),
    ("<p>A &lt;b&gt; sign &amp; 3 < 4, said&nbsp;she.<!-- not > this --></p>", "A <b> sign & 3 < 4, said she."),
]


RAIN = "<p>The rain came early this year, and the river rose above the old bridge before noon.</p><p>Nobody in the village had seen the like, said the miller, who has lived there for sixty years.</p>"
RAIN_TEXT = "The rain came early this year, and the river rose above the old bridge before noon. Nobody in the village had seen the like, said the miller, who has lived there for sixty years."
HEADLINES = [
    (f"<header><a href=/>The Daily</a></header><article><header><h1>Rain in the hills</h1></header>{RAIN}</article><footer>&copy; 2020 Daily</footer>", "Rain in the hills " + RAIN_TEXT),
    (f"<body><nav><a href=/>Home</a> <a href=/n>News</a></nav><main><article><header><h1>Rain in the hills</h1><div class=byline>By Tom Lee, 3 May 2020</div></header>{RAIN}</article></main><footer>All rights reserved.</footer></body>", "Rain in the hills " + RAIN_TEXT),
    (f"<body><div class=menu><a href=/>Home</a></div><div class=hero><h1>Rain in the hills</h1></div><div class=content>{RAIN}</div><div class=footer>Copyright 2020</div></body>", "Rain in the hills " + RAIN_TEXT),
    (f"<body><h1>Rain in the hills</h1>{RAIN}<p>Copyright 2020 Example Inc. All rights reserved.</p></body>", "Rain in the hills " + RAIN_TEXT),
    (f"<body><div><a href=/>Home</a> <a href=/a>About</a></div><h1>Rain in the hills</h1>{RAIN}<p>© 2021 The Daily. All rights reserved.</p></body>", "Rain in the hills " + RAIN_TEXT),
    (f"<html><body><div>{RAIN}</div><div>Copyright 2020 Example Inc.</div></body></html>", RAIN_TEXT),
    (f"<body><h1>Rain in the hills</h1>{RAIN}<h3>2 comments</h3><div><b>Tom</b><p>Nice piece about the river, thank you. I live there.</p></div><div><b>Ann</b><p>The bridge should be built anew.</p></div></body>", "Rain in the hills " + RAIN_TEXT),
    (f"<header><h1>The Daily Planet</h1><a href=/>Home</a></header><article><h1>Rain in the hills</h1>{RAIN}</article>", "Rain in the hills " + RAIN_TEXT),
    (f"<body><header><h1>The Daily Planet</h1></header><main>{RAIN}</main></body>", RAIN_TEXT),
]


def test_headlines_legal_lines_and_comments():
    field = html_extract.model()
    assert html_extract.main_texts([p for p, _ in HEADLINES], field) == [w for _, w in HEADLINES]


def plain_tag_end(page, at):
    here = at
    while here < len(page):
        if page[here] == ">":
            return here + 1
        if page[here] in "'\"":
            here = page.find(page[here], here + 1)
            if here < 0:
                break
        here += 1
    return page.index(">", at) + 1


def test_tags_end_where_the_plain_reader_ends_them():
    rng = np.random.default_rng(6)
    for _ in range(3000):
        page = "".join(rng.choice(list("ab<='\"> "), rng.integers(1, 60))) + ">"
        ends, at = html_extract._TagEnds(page), 0
        while 0 <= (at := page.find("<", at)):
            assert ends(at) == plain_tag_end(page, at)
            at += 1
    many = "<p " + "a='>' " * 2000 + ">The text of it.</p>"
    assert [b.text for b in html_extract.blocks(many)] == ["The text of it."]


def plain_texts(pages, field):
    """The same by scores added up in turn and by trying every labelling."""
    out = []
    for page in pages:
        cut = html_extract.blocks(page)
        items = html_extract.features(cut)
        best = max(itertools.product((0, 1), repeat=len(items)), key=lambda y: plain_score(field, items, y), default=())
        out.append(" ".join(b.text for b, y in zip(cut, best, strict=True) if y))
    return out


def test_texts_equal_the_best_of_all_labellings():
    field = html_extract.model()
    pages = [p for p, _ in html_extract.training_pages(150, seed=5) if len(html_extract.blocks(p)) < 12]
    assert len(pages) > 40 and html_extract.main_texts(pages, field) == plain_texts(pages, field)


def test_most_blocks_of_pages_that_it_was_not_trained_on():
    field = html_extract.model()
    right = total = 0
    for page, want in html_extract.training_pages(150, seed=6):
        cut = html_extract.blocks(page)
        got = field.decode([html_extract.features(cut)])[0]
        right += sum((b.text in want) == y for b, y in zip(cut, got, strict=True))
        total += len(cut)
    assert right > 0.97 * total


def test_scores_do_not_depend_on_what_stands_before():
    field = html_extract.model()
    items = [f for p, _ in PAGES for f in html_extract.features(html_extract.blocks(p))] + [[], []]
    together = field.emissions(items)
    assert all((field.emissions([f])[0] == row).all() for f, row in zip(items, together, strict=True))


def test_other_pages():
    field = html_extract.model()
    assert html_extract.main_texts([p for p, _ in PAGES], field) == [w for _, w in PAGES]


@pytest.mark.parametrize("piece", ["<div>", '<a href="x ', "<svg><b>", "<a '\">", "</b><i>", "<!-", "<a '' \"'>"])
def test_hostile_pages_take_time_by_their_length(piece):
    field = html_extract.model()
    began = time.time()
    html_extract.main_texts([piece * 50_000 + "<p>The end of it all is here.</p>"], field)
    assert time.time() - began < 20


def test_repeated_and_clashing_pages(spark):
    rows = [(1, "u", PAGES[0][0], "x", 3), (1, "u", PAGES[0][0], "y", 3), (None, "u", PAGES[1][0], None, None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [got[0], got[0], got[2]])) or len(got) == 3
    assert sorted(r["text"] for r in got) == sorted([PAGES[0][1], PAGES[0][1], PAGES[1][1]])


TEXTS = {
    "The gull goes out at break of day,\nover the water, cold and grey,\nand what it saw along the shore\nit will not tell us any more,\nnor will the wind that blew that way.": True,
    "Barley soup\n200 g barley\n1 onion\n2 carrots\n1 l stock\nSoak the barley overnight.\nFry the onion in butter until it is soft.\nAdd everything and cook for an hour.": True,
    "Anna: Have you seen the new bridge?\nTom: Not yet, but I heard it is open.\nAnna: Let us go there on Sunday.\nTom: I would like that.": True,
    "The river rose above the old bridge before noon. Nobody had seen the like.\n\nThe miller, who has lived there for sixty years, moved his sacks to the loft.": True,
    "Buy now and save 50% on all garden chairs!\nFree shipping on orders over $30.\nBest price guaranteed, limited time offer.\nOrder today and get a free cushion.": False,
    "Home\nAbout Us\nProducts\nServices\nGallery\nOur Team\nNews\nContact\nSite Map\nLogin Page": False,
    "var a = [1, 2];\nfor (i = 0; i < 3; i++) { a.push(i); }\nreturn a.length;\n<div class=x></div>\nfunction go() { return {}; }": False,
}


def test_other_texts(spark):
    field = quality_rules.model()
    assert [bool(k) for k in quality_rules.judge(list(TEXTS), field, 0.5)[-1]] == list(TEXTS.values())
    whole = quality_rules.judge(list(TEXTS), field, 0.5)
    for i, t in enumerate(TEXTS):  # a verdict depends on the text alone
        assert [x[0] for x in quality_rules.judge([t], field, 0.5)] == [x[i] for x in whole]
    long = "A sentence about one thing and another. " * 30_000
    rows = spark.createDataFrame([(1, long, True), (1, long, False), (2, None, None)], "doc_id long, text string, kept boolean")
    got = quality_rules.quality_rules(rows).collect()
    assert sorted(r["n_words"] for r in got) == [0, 210_000, 210_000] and all(r["base_failed"] for r in got)
    assert [r["kept"] for r in quality_rules.kept_documents(rows).collect()] == []


SCRIPTS = {
    "Devanagari": "आज सुबह नदी के किनारे बहुत लोग जमा हुए थे। गाँव के मुखिया ने कहा कि पानी का स्तर कल से घट रहा है।",
    "Bengali": "আজ সকালে নদীর ধারে অনেক মানুষ জড়ো হয়েছিল। গ্রামের প্রধান বলেছেন যে জলের স্তর গতকাল থেকে কমছে।",
    "Tamil": "இன்று காலை ஆற்றின் கரையில் பல மக்கள் கூடினர். கிராமத் தலைவர் நீர் மட்டம் நேற்று முதல் குறைந்து வருகிறது என்று கூறினார்.",
    "decomposed Latin": unicodedata.normalize("NFD", "Le maire a déclaré hier que l'été serait très sec, et que les réserves d'eau étaient déjà épuisées à moitié."),
    "Cyrillic": "Сегодня утром на берегу реки собралось много людей. Глава деревни сказал, что уровень воды со вчерашнего дня падает.",
    "Arabic": "تجمع كثير من الناس صباح اليوم على ضفة النهر. وقال رئيس القرية إن مستوى المياه ينخفض منذ أمس، وإن المدارس ستفتح يوم الاثنين.",
    "Hebrew": "הבוקר התאספו אנשים רבים על גדת הנהר. ראש הכפר אמר שמפלס המים יורד מאז אתמול ובתי הספר ייפתחו ביום שני.",
    "Greek": "Σήμερα το πρωί πολλοί άνθρωποι συγκεντρώθηκαν στην όχθη του ποταμού. Ο πρόεδρος είπε ότι η στάθμη πέφτει από χθες.",
    "Hangul": "오늘 아침 강가에 많은 사람들이 모였다. 마을 이장은 어제부터 물이 줄고 있다고 말했다. 학교는 월요일에 다시 문을 연다고 한다.",
    "Ethiopic": "ዛሬ ጠዋት ብዙ ሰዎች በወንዙ ዳር ተሰበሰቡ። የመንደሩ አለቃ የውሃው መጠን ከትናንት ጀምሮ እየቀነሰ ነው አሉ።",
    "Thai": "เช้านี้มีคนมากมายมารวมตัวกันที่ริมแม่น้ำ ผู้ใหญ่บ้านบอกว่าระดับน้ำลดลงตั้งแต่เมื่อวาน โรงเรียนจะเปิดในวันจันทร์ เด็ก ๆ ดีใจมาก ทุกคนกลับบ้าน และ พักผ่อน ก่อน ค่ำ",
    "Han": "\n".join(["今天早上许多人聚集在河边，看着上涨的水。", "村长说，从昨天开始水位已经下降。", *(f"{c}天过去了，老人们又说起从前的故事，大家安静地听着。" for c in "一二三四五六七八九")]),
    "a message": "hey are you coming over later tonight\ni was thinking we could order something and watch that film\nlet me know when you leave work so i can start",
}
SPOILT = ["आज## सुबह## नदी** के$$ किनारे## बहुत## लोग** जमा## हुए$$ थे## गाँव** के##", "if (x == 1) { y = [2]; }\nreturn foo.bar();\nvar q = [x];\n#id { color: 0 }\nvar z = [y];", "Click here to subscribe\nCopyright 2020 Example Inc. All rights reserved.\nSign in to share this page"]


def test_texts_of_many_scripts_are_kept():
    texts = [*SCRIPTS.values(), *SPOILT]
    kept = quality_rules.judge(texts, quality_rules.model(), 0.5)[-1].tolist()
    assert dict(zip(SCRIPTS, kept)) == dict.fromkeys(SCRIPTS, True) and kept[len(SCRIPTS) :] == [False] * len(SPOILT)
