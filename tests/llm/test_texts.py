"""Problems 3, 6, 8, 9 and 10: rules on small texts, round trips, brute force."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.functions.text import py_tokens
from loomtext.llm.boilerplate import body_text, composite_density, first_mark, main_body, main_lines
from loomtext.llm.leaks import SuffixAutomaton, leaked, without_leaks
from loomtext.llm.packing import Packer, containers
from loomtext.llm.sentences import sentences, units
from loomtext.llm.splitting import pieces, split_oversized

# sentences -----------------------------------------------------------------------------------------------------------

SENTENCES = [
    "One.| Two! |Three?| Four… |Five?!",
    "Dr. Bo and Prof. Li saw No. 214, e.g. 3.5 items (cf. Ann et al., vol. 2, pp. 3 ff.).| Then at 4 a.m. they left.",
    "It holds x, y, etc.| It ran at 7 p.m.| Next.",
    "The U.S. build, like the U.K. one, works.| Tests by J. K. Bo et al. show it.",
    "It was slow ... then fast.| Then quiet… |Done.",
    '"Can it?" asked she.| The log says "Done. Closing." and stops.| He said, "it is."| Not yet.',
    "It waits (it may. This is so.) and goes.| (A whole one.)| [See it.]| End.",
    "‘One,’ said he, ‘then two.’| It’s kept.",
    "Run it from ./a/.. and wait.| Ask for https://e.com/a.html?v=2.1 to go.| Edit a.b and set c.d to 3.",
    "Kept.|The next one has no space.| tilio.poldim returns it.",
    "Manche Arten, z. B. der Filter, d. h. alle, bzw. keine, sind da.| Stand 21. Juni: gut.| Nach ca. 26 Min. kopiert er.| „Geht das?“ fragte sie.| Er heißt „stabil.“| Ende.",
    "M. Bo écrit : « C’est prêt. Fermez-le. » dans son mot.| Pourquoi ferme-t-il ?| Certains cas, p. ex. le nœud, restent !| Fin.",
    "El Sr. Bo y la Dra. Li dicen.| ¿Por qué?| ¡No toque!| «¿Está?», preguntó ella.",
    "Це на с. 16, п. 3, див. рис. 2 і табл. 3.| Понад 5 тис. разів.| У м. Київ та ін. містах є.| «Чи так?» — спитав він.| Журнал пише «Готово. Все.» і спить.| На 37 р. до н. е. було.| Кінець",
    "डॉ. राम के अनुसार है।| क्या है?| उसने पूछा, \"क्या है?\" और गया।| अंत",
    "قال د. علي إنه جاهز.| لماذا؟| كتب «تم. أغلقه.» ثم توقف.| لا!",
    "これは一つ。|「終わり。閉じて。」と書く。|彼は「本当？」と聞く。|設定（索引を含む。ただし空を除く。）を消す！|2.5倍です。",
    "日志写道：“完成。正在。”随后停止。|节点（见图5。也见a.cfg。）可以。|为什么？|好",
    "ระบบปิดคำ| ดัชนีเก่า 5 รายการ| คำใหม่",
    "A heading",
    "- First item.| Second.",
    "1. Use it here.| Then stop.",
    "> If it splits\n> the rest.| Then\n> stop.",
    "import a\nb = a.c(2.5)\nx.y()",
    "menu. |neither it. |nor that.",
    "3.5 of them.| 12 rows.",
    "It takes 25.2 ms.| La versión es.| Ms. Bo and Mr. Li.| End.",
    "Див. табл. 69.| polsun.beldim стискає.| (See it.)| ab.cd",
    "It holds x, etc.| ditvis.poldim is one.| ‘A,’ said he, ‘then b.’| tukkit.matkul is.| [See it.]| mekjak.likkom is.| Quiet… |gumio.letmik is, e.g. polsun.beldim.",
]


@pytest.mark.parametrize("marked", SENTENCES)
def test_sentences(marked):
    text = marked.replace("|", "")
    assert [text[a:b] for a, b in units(text)] == [p.strip() for p in marked.split("|")]


def test_list_levels():
    texts = {
        "Steps:\n1. Use it\n2. Then stop": ["Steps:\n1. Use it\n2. Then stop"],
        "Steps:\n1. Use it.\n2. Then stop.": ["Steps:\n1. Use it.", "2. Then stop."],
        "- A (one, two\n- B two. C (it. is) so. D.": ["- A (one, two\n- B two.", "C (it. is) so.", "D."],
        "- A (one.\n  - sub\n  here) on. Next.": ["- A (one.\n  - sub\n  here) on.", "Next."],
        "Er schrieb „- eins.\n- zwei.“ und ging.": ["Er schrieb „- eins.\n- zwei.“ und ging."],
        "Tak np. ten. Patrz rys. 2 itd. Koniec.": ["Tak np. ten.", "Patrz rys. 2 itd.", "Koniec."],
        "Siehe Abs. 2 dort. Ende.": ["Siehe Abs. 2 dort.", "Ende."],
    }
    for text, expected in texts.items():
        assert [text[a:b] for a, b in units(text)] == expected


def test_linear_time():
    import time

    def took(text):
        start = time.perf_counter()
        units(text)
        return time.perf_counter() - start

    for part in ("“ab ", "»x ", "(a. ", '„b "c ', "A.B.C.", "- (x\n", "’ ‘ "):
        small, large = (min(took(part * n) for _ in range(2)) for n in (2000, 16000))
        assert large < 40 * small + 0.2, part


def test_paragraphs():
    text = "  Title here\n\nOne line\ngoes on. Two.\n \n\r\n(unclosed quote \" here. Next.\r\n\r\nLast "
    assert [text[a:b] for a, b in units(text)] == ["Title here", "One line\ngoes on.", "Two.", '(unclosed quote " here.', "Next.", "Last"]
    assert units("") == units(" \n \n") == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1.!? \n\"'“”«»()[]。「」กข—Dr", max_size=60))
def test_units_cover_the_text(text):
    found = units(text)
    inside = [i for a, b in found for i in range(a, b)]
    assert inside == sorted(set(inside))
    assert all(text[a:b] == text[a:b].strip() and a < b for a, b in found)
    assert {i for i, c in enumerate(text) if not c.isspace()} <= set(inside)


def test_sentence_table(spark):
    rows = [(1, "A b. C d.", 5), (2, None, 5), (3, "  ", 5), (1, "E.", 5), (None, "F.", 5), (4, "Long one. " * 20000, 5)]
    got = sentences(spark.createDataFrame(rows, "doc_id long, text string, sent_start int"))
    assert got.where("doc_id < 4").count() == 3 and got.where("doc_id = 4").count() == 20000
    assert sentences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# splitting -----------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc .!\n。", max_size=400), st.integers(5, 60), st.data())
def test_pieces_round_trip(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    parts, at = pieces(text, limit, overlap), 0
    unbroken = re.split(r"[ \n.!。]", text)
    for n, (a, b, stretch) in enumerate(parts):
        assert b - a <= limit and a == (max(0, at - overlap) if n else 0) and b > at or not text
        if b < len(text):
            assert stretch in map(len, unbroken) and stretch >= limit - overlap if stretch else text[b - 1] in " \n.!。"
        at = b
    assert at == len(text)
    contents = [0, *(b for _, b, _ in parts)]
    assert all(c - a > limit - overlap for a, c in zip(contents, contents[2:]))
    assert any(s > limit for _, _, s in parts) == (len(text) > limit and max(map(len, unbroken)) > limit)


def test_pieces_prefer_strong_boundaries():
    a, b = "x" * 40 + ". " + "y" * 40 + ".", "z" * 50 + "."
    text = a + "\n\n" + b
    assert [text[i:j] for i, j, _ in pieces(text, 100, 0)] == [a + "\n\n", b]
    # weakest first: the heap joins words, then sentences, so the paragraphs stay apart though other cuts would fill pieces better
    text = "One two. Three.\n\nFour five six seven. Eight.\n\nNine."
    assert [text[i:j] for i, j, _ in pieces(text, 30, 0)] == ["One two. Three.\n\n", "Four five six seven. Eight.\n\n", "Nine."]
    assert pieces("short", 100, 10) == [(0, 5, 0)]
    assert [s for _, _, s in pieces("a" * 95 + " " + "b" * 250, 100, 10)] == [95, 0, 250, 250, 0]


def test_split_table(spark):
    rows = [(1, "w " * 1500, "k"), (2, "q" * 2001, "k"), (3, "s", "k"), (4, None, "k"), (None, "w " * 1500, "k"), (5, "ab " * 100000, "k")]
    df = spark.createDataFrame(rows, "id long, body string, piece string")
    got = split_oversized(df, "id", "body")
    assert {(r.item_id, r.cut) for r in got.collect()} == {(1, "boundary"), (2, "forced"), (5, "boundary")}
    assert got.where("item_id = 5").count() >= 100000 * 3 / 1800
    assert split_oversized(df.limit(0), "id", "body").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "id", "body", 10, 10)


# packing -------------------------------------------------------------------------------------------------------------


def packed(sizes, look=256, capacity=1000):
    packer = Packer(capacity, look)
    return [x for i, s in enumerate(sizes) for x in packer.put(s, i)] + packer.rest()


def test_packer():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 400) for _ in range(5000)]
    placed = packed(sizes)
    assert sorted(i for _, i in placed) == list(range(5000))
    used = {}
    for box, i in placed:
        used[box] = used.get(box, 0) + sizes[i]
    assert max(used.values()) <= 1000 and len(used) <= sum(sizes) / 1000 * 1.01 + 1
    assert packed([]) == [] and packed([1000, 1000, 1]) == [(0, 0), (1, 1), (2, 2)]


def test_containers_hold_neighbours():
    """Where on the curve the items of a container lie, against the same items with the curve's order lost in short windows."""
    rng = random.Random(4)
    sizes = [min(1000, int(rng.lognormvariate(5, 1)) + 1) for _ in range(6000)]

    def spread(order):
        at = {}
        for box, i in packed([sizes[i] for i in order]):
            at.setdefault(box, []).append(order[i])
        boxes = [max(x) - min(x) for x in at.values() if len(x) > 1]
        return sum(boxes) / len(boxes), sum(sizes) / 1000 / len(at)

    curve = list(range(len(sizes)))
    windows = [i for a in range(0, 6000, 256) for i in rng.sample(curve[a : a + 256], len(curve[a : a + 256]))]
    (own, fill), (mixed, _), (lost, _) = spread(curve), spread(windows), spread(rng.sample(curve, 6000))
    assert fill > 0.99 and own < 0.8 * mixed and own < 0.05 * lost


def test_containers(spark):
    rng = random.Random(2)
    words = "alpha beta gamma delta Кіт 索引 x1".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 700)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "alpha " * 9000), (203, "same"), (203, "same"), (None, "x")]
    got = containers(spark.createDataFrame([(*d, 7, 8) for d in docs], "doc_id long, text string, key int, tokens int")).toPandas()
    fill = got.groupby("container").tokens.sum()
    assert fill.max() <= 1024 and (got.tokens > 0).all()
    of = got.sort_values(["doc_id", "first_token"]).groupby("doc_id")
    big = of.get_group(202)
    assert len(big) > 1 and (big.tokens.iloc[:-1] == 1024).all() and big.first_token.tolist() == list(range(0, 1024 * len(big), 1024))
    assert {200, 201}.isdisjoint(got.doc_id) and len(of.get_group(203)) == 2
    assert (of.size().drop([202, 203])[of.tokens.sum() <= 1024] == 1).all()
    assert containers(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# leaks ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=5), st.lists(st.integers(0, 4), max_size=25), st.integers(1, 4))
def test_automaton(items, words, least):
    auto = SuffixAutomaton(list(enumerate(items)), least)
    runs = {p: (n, auto.items[s]) for p, n, s in auto.runs([w if w < 4 else None for w in words])}
    for place in range(len(words)):
        holds = lambda run, item: any(item[k : k + len(run)] == run for k in range(len(item) - len(run) + 1))
        longest = max((n for n in range(place + 2) if any(holds(words[place + 1 - n : place + 1], i) for i in items)), default=0)
        if longest >= least:
            run = words[place + 1 - least : place + 1]
            assert runs[place] == (longest, tuple(k for k, i in enumerate(items) if holds(run, i)))
        else:
            assert place not in runs


@pytest.mark.parametrize("block_words, slice_characters, bits", [(200_000, 4_000_000, 27), (60, 300, 27), (60, 300, 8)])
def test_leaks(spark, monkeypatch, block_words, slice_characters, bits):
    """Against brute force, in one block and in many, and with a filter so small that it lets nearly everything through."""
    from loomtext.llm import leaks

    for name, value in (("BLOCK_WORDS", block_words), ("SLICE_CHARACTERS", slice_characters), ("FILTER_BITS", bits)):
        monkeypatch.setattr(leaks, name, value)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["П’ять", "café", "Straße", "don't"]
    items = [(i, " ".join(rng.choices(words, k=30)), "x") for i in range(6)] + [(6, "too short", "x"), (7, None, "x"), (8, "", "x")]
    items.append((9, items[0][1].upper(), "x"))
    docs = []
    for d in range(30):
        part = items[d % 6][1].split()
        n = rng.choice([8, 11, 12, 13, 20, 30])
        a = rng.randrange(30 - n + 1)
        docs.append((d, "intro text " + ",\n ".join(w.title() if d % 2 else w for w in part[a : a + n]) + " end.", 1))
    docs += [(50, None, 1), (51, "", 1), (None, items[0][1], 1), (52, "filler " * 50000 + items[1][1], 1)]
    expected = set()
    for d, text, _ in docs:
        got = py_tokens(text or "")
        grams = {tuple(got[k : k + 12]) for k in range(len(got) - 11)}
        for i, body, _ in items:
            w = py_tokens(body or "")
            if d is not None and any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11)):
                expected.add((d, i))
    documents = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    evals = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    spans = leaked(documents, evals)
    assert {(r.doc_id, r.item_id) for r in spans.collect()} == expected and len(expected) > 10
    clean = {r.doc_id: r for r in without_leaks(documents, spans, coverage=0.9).collect()}
    assert not leaked(spark.createDataFrame([(d, r.text) for d, r in clean.items()], "doc_id long, text string"), evals).count()
    assert clean[50].text is None and clean[51].text == "" and clean[52].leaked_words == 30
    assert leaked(documents, evals.limit(0)).count() == 0 == leaked(documents.limit(0), evals).count()
    with pytest.raises(ValueError):
        leaked(documents, evals, 0)


# boilerplate ---------------------------------------------------------------------------------------------------------


def page(site, i, body, title="T"):
    lines = ["Home | Docs | Blog", f"Docs > Guides > {title} {i}", f"{title} {i}", *body, "Related articles", "Some other page", f"Page number {i + 7}", f"Shared {i} times", "« Before | After »", f"© 2024 {site.title()}"]
    return (i, f"https://www.{site}.example/p/{i}", f"{title} {i} - {site.title()}", "\r\n".join(lines), 9)


def test_main_body(spark):
    bodies = {i: [f"Unique sentence number {c} of the text.", f"{c} = 5", "", f"- An item {c}", "Note: may change." if i < 2 else f"More of {c} here."] for i, c in enumerate("abcdefghijkl")}
    rows = [page("alpha", i, b) for i, b in bodies.items()]
    rows += [(100, "https://alpha.example/p/0?x=1", "T 0 - Alpha", rows[0][3], 9), (101, "https://alpha.example/z", None, None, 9), (102, None, None, "", 9), (103, "https://alpha.example/q", "Q", "Home | Docs | Blog\n© 2024 Alpha\n", 9)]
    rows += [(104, None, None, "Just one plain sentence.", 9), (None, "u", "t", "text", 9)]
    got = {}
    for r in main_body(spark.createDataFrame(rows, "page_id long, url string, title string, text string, n int")).collect():
        got.setdefault(r.page_id, []).append(r.line_no)
    for i in range(12):
        assert sorted(got[i]) == [2, 3, 4, 6, 7], i
    assert sorted(got[100]) == [2, 3, 4, 6, 7] and got[104] == [0]
    assert {101, 102, 103}.isdisjoint(got)
    assert main_body(spark.createDataFrame([], "page_id long, url string, title string, text string")).count() == 0


def test_density():
    d = composite_density
    assert d(100, 1, 10, 0.1, 0.1) > d(100, 2, 10, 0.2, 0.1) > 0
    assert d(100, 1, 10, 0.1, 0.1) > d(100, 1, 50, 0.1, 0.1) > d(100, 1, 50, 0.5, 0.1) > d(100, 1, 98, 0.98, 0.1) > 0


def test_the_density_step_decides():
    """One line of the same share is kept on a page that is linked all over and dropped on one that hardly is."""
    text, menu = [100] * 5, [10] * 20
    assert main_lines([*text, 60], [0.1] * 5 + [0.45]) == [0, 1, 2, 3, 4]
    assert 25 in main_lines([*text, *menu, 60], [0.1] * 5 + [0.98] * 20 + [0.45])
    assert main_lines(menu, [0.98] * 20) == [] == main_lines([], [])
    # short text beside long text reaches the threshold, whatever its length
    assert main_lines([800] * 12 + [7, 8, 1, 4], [0.1] * 15 + [0.98]) == list(range(15))


def test_first_mark():
    assert first_mark("« Some page | Another »") == "«" and first_mark("Vorige: A B Nächste: C") == "vorige:" and first_mark("#a #b-c") == "#"
    assert first_mark("Docs > Guides > A page") == "docs >"
    for line in ("A plain line", "- item - more", "x = f(1) - 2", "He said: no — yes.", "A - b", ""):
        assert first_mark(line) is None


@pytest.mark.parametrize("tags, related, menu", [("Tags", "Related articles", "Home Docs Blog"), ("Etichette", "Articoli correlati", "Inizio Guide Notizie"), ("Tagi", "Powiązane wpisy", "Start Dokumenty Wieści")])
def test_any_language(spark, tags, related, menu):
    """Labels, menus and links to neighbours are known by how pages repeat them, in languages that no list names."""
    rng, rows = random.Random(6), []
    word = lambda: "".join(rng.choices("bdklmnoprstuvaei", k=6))
    kept = {}
    for i in range(60):
        site = f"site{i % 4}"
        body = [f"{word().title()} {' '.join(word() for _ in range(14))}." for _ in range(5)]
        listed = lambda: f"{word().title()} {word()}"
        head = [*menu.split(), f"{word().title()} {i}"] if i % 2 else [" | ".join(menu.split()), f"{word().title()} {i}"]
        lines = [*head, *body[:2], f"n = {word()}({i})", *body[2:], related, listed(), listed(), tags, listed(), f"« {listed()} | {listed()} »", f"© 2020 {site.title()}"]
        first = len(head) - 1
        kept[i] = list(range(first, first + 7))
        rows.append((i, f"https://{site}.example/{i}", head[-1], "\n".join(lines)))
    got = {}
    for r in main_body(spark.createDataFrame(rows, "page_id long, url string, title string, text string")).collect():
        got.setdefault(r.page_id, []).append(r.line_no)
    assert {k: sorted(v) for k, v in got.items()} == kept


def test_body_text(spark):
    rows = [page("alpha", i, [f"Unique {c} {c * 3} here.", f"  Also {c * 4}. "]) for i, c in enumerate("abcdefghij")] + [(99, "u", None, None, 9)]
    got = {r.page_id: r.text for r in body_text(spark.createDataFrame(rows, "page_id long, url string, title string, text string, n int")).collect()}
    assert got == {i: f"T {i}\nUnique {c} {c * 3} here.\nAlso {c * 4}." for i, c in enumerate("abcdefghij")}
