"""The training-data operators on small inputs: what they find, and nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkloom.llm import boilerplate, leaks, mixing, quality, readability, sentences, splitting, stuffing
from inkloom.llm.common import language, words_of

BLOCKS = "block_id bigint, file_id bigint, site string, pos int, text string, kind string, line_no int, col_no int, block_label string, head_level int, bold_lead boolean, word_count int"
FILES = "file_id bigint, path string, file_format string, doc_type string, lang string, site string, settings_id int"
SETTINGS = "settings_id int, max_reading_grade double, max_unit_tokens int, overlap_tokens int"


def blocks(spark, rows):
    """rows: (file_id, pos, text, kind, head_level); a column ``odds`` clashes with names that the operators use."""
    return spark.createDataFrame([(i + 1, f, None, p, t, k, 1, 1, "", h, False, None) for i, (f, p, t, k, h) in enumerate(rows)], BLOCKS).withColumn("odds", F.lit(1)).withColumn("d", F.lit("x"))


def files(spark, rows):
    return spark.createDataFrame([(i, f"f{i}", fmt, None, None, None, s) for i, fmt, s in rows], FILES).withColumn("nature", F.lit("?")).withColumn("blocks", F.lit(0))


def settings(spark, *rows):
    return spark.createDataFrame(list(rows), SETTINGS)


# ---- 6


PASSAGES = [(1, "The road between Lindor and Ithbor was closed for 32 weeks after a clay jar fell on it, and nobody paid the 508 crowns."), (2, "在院子尽头的老仓库里有五十四个竹篮和三盏灯笼没有人知道为什么"), (3, None), (4, ""), (5, "too brief")]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit(9)).withColumn("share", F.lit("x"))


def test_leaks(spark):
    items = spark.createDataFrame(PASSAGES + [(6, PASSAGES[0][1])], "item_id bigint, passage string").withColumn("text", F.lit("x"))
    whole = PASSAGES[0][1]
    rows = [
        (1, "Before. " + whole.upper() + " After."),
        (2, whole.replace(" ", "\n> ").replace("weeks", "days")),
        (3, " ".join(reversed(whole.split()))),
        (4, "A short quote: was closed for 32 weeks."),
        (5, "x" * 300_000 + " " + whole[: len(whole) * 2 // 3]),
        (6, "前面的话。在院子尽头的老仓库里，有五十四个竹篮和三盏灯笼。后面的话。"),
        (7, None),
        (8, ""),
        (9, "Between this line. The road between Lindor and Ithbor was closed — an advert stands here, with many words of its own — for 32 weeks after a clay jar fell on it, and nobody paid."),
        (1, "Before. " + whole.upper() + " After."),
    ]
    got = leaks.leaks(_docs(spark, rows), items).select("doc_id", "item_id").collect()
    pairs = [tuple(r) for r in got]
    assert set(pairs) == {(1, 1), (1, 6), (2, 1), (2, 6), (5, 1), (5, 6), (6, 2), (9, 1), (9, 6)}
    assert pairs.count((1, 1)) == 2
    assert leaks.leaks(_docs(spark, rows).limit(0), items).count() == 0
    assert leaks.leaks(_docs(spark, rows), items.limit(0)).count() == 0


@pytest.mark.parametrize("versions", [3, 10])
def test_versions_of_one_passage_are_all_found_in_any_number_of_blocks(spark, monkeypatch, versions):
    stem = "The road between Lindor and Ithbor was closed for {} weeks after a clay jar fell on it, and nobody in the old town paid the crowns that were owed to the council"
    items = spark.createDataFrame([(i, stem.format(30 + i)) for i in range(versions)], "item_id bigint, passage string")
    rest, less = " ".join(stem.split()[14:]), " ".join(stem.split()[18:])  # wording that all versions share: more than half of them, less than half
    docs = _docs(spark, [(i, "Before. " + stem.format(30 + i) + " After.") for i in range(versions)] + [(98, rest), (99, less)])
    one = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, items).collect()}
    assert one == {(d, i) for d in (*range(versions), 98) for i in range(versions)}
    monkeypatch.setattr(leaks, "MAX_PATTERN_BYTES", 2000)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, items).collect()} == one


def test_short_passages_are_found_whole(spark):
    items = spark.createDataFrame([(1, "Paris in 1900"), (2, "Oslo"), (3, "a b"), (4, "一九"), (5, "?!")], "item_id bigint, passage string")
    docs = _docs(spark, [(1, "It was PARIS, in 1900."), (2, "In Paris in 1901 and Oslo"), (3, "A B, c"), (4, "一 九"), (5, "Osloer ab"), (6, "?!")])
    assert {(r["doc_id"], r["item_id"], r["share"]) for r in leaks.leaks(docs, items).collect()} == {(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 4, 1.0)}


def test_search_against_brute_force():
    rnd = random.Random(4)
    words = [f"w{i:02d}x" for i in range(12)]
    passages = [(i, " ".join(rnd.choices(words, k=9))) for i in range(40)]
    import numpy as np

    tables = leaks.Items(passages + [(99, "w00x"), (98, "w01x w02x")]).tables
    assert len(tables) == 2
    for _ in range(20):
        text = leaks.normalised(" ".join(rnd.choices(words, k=400)))
        for pats in tables:
            at, pattern = pats.occurrences(np.frombuffer(text, np.uint8))
            want = {(i, k) for k, p in enumerate(pats.patterns) for i in range(len(text)) if text.startswith(p, i)}
            assert set(zip(at.tolist(), pattern.tolist())) == want


def test_pattern_blocks_change_nothing(spark, monkeypatch):
    items = spark.createDataFrame(PASSAGES, "item_id bigint, passage string")
    docs = _docs(spark, [(1, PASSAGES[0][1]), (2, PASSAGES[1][1])])
    one = sorted(map(tuple, leaks.leaks(docs, items).collect()))
    monkeypatch.setattr(leaks, "MAX_PATTERN_BYTES", 200)
    assert sorted(map(tuple, leaks.leaks(docs, items).collect())) == one and len(one) == 2


def test_shared_folder(spark):
    class Session:
        class sparkContext:
            master = "spark://head:7077"

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError):
        mixing.shared_folder(Session)
    Session.sparkContext.master = "local[2]"
    assert mixing.shared_folder(Session)
    mixing.release(spark)
    path = mixing.durable(spark.range(3), "kept").inputFiles()[0].removeprefix("file:")
    import os

    assert os.path.exists(path) and mixing.release(spark) == 1 and not os.path.exists(path)


# ---- 5


@pytest.mark.parametrize("limit", [1, 2, 5, 40])
@pytest.mark.parametrize("overlap", [0, 1, 3, 100])
def test_pieces(limit, overlap):
    rnd = random.Random(limit * 7 + overlap)
    for text in ("", "x" * 500, "a b. c! d\n\ne " * 30, "".join(rnd.choice("ab .!\n，。") for _ in range(700)), "字" * 90 + "。" + "字" * 90):
        got = splitting.pieces(text, limit, overlap)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        assert all(splitting.tokens_of(e - s) <= limit for s, e, _ in got) or not text
        share = min(4 * overlap, 4 * limit - 2)
        assert all(a[1] - b[0] == share and b[1] > a[1] for a, b in zip(got, got[1:]))


def test_pieces_are_natural():
    text = "A first sentence stands here. A second one follows it.\n\nA new paragraph begins. It ends as well."
    (s0, e0, k0), (s1, e1, _) = splitting.pieces(text, 18, 0)
    assert k0 == 5 and text[s1:].startswith("A new")


def test_split_units(spark):
    u = spark.createDataFrame([(1, 1, "word " * 30), (1, 1, "word " * 30), (2, 1, "x" * 200), (3, 1, "short"), (4, 1, None), (5, None, "y" * 99), (6, 9, ""), (7, 2, "a" * 39), (8, 2, "a" * 40)], "unit_id bigint, file_id bigint, state string").withColumn("tokens", F.lit(3)).withColumn("piece", F.lit(0)).withColumn("lim", F.lit(0))
    f = files(spark, [(1, "md", 1), (1, "md", 1), (2, "md", 2)])
    s = settings(spark, (1, None, 20, 2), (2, None, 10, None))
    got = splitting.split_units(u, f, s)
    assert {(r["unit_id"], r["forced_cut"]) for r in got.collect()} == {(1, 0), (2, 1), (8, 1)}
    assert got.where("unit_id = 1 and piece_no = 0").count() == 1
    assert splitting.split_units(u.limit(0), f, s).count() == 0 and splitting.split_units(u, f.limit(0), s.limit(0)).count() == 0


# ---- 7


def test_mix(spark):
    docs = [(i, "one two three four five six seven eight nine ten " * (1 + i % 3), ("big", " Big", "B-I-G", "small source", "Small_Source")[i % 5] if i % 7 else "big") for i in range(400)] + [(900, None, "big"), (901, "", "big"), (902, "lost", None), (903, "other text", "unknown")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("tokens", F.lit(0)).withColumn("hash", F.lit(""))
    t = spark.createDataFrame([("big", 0.1, 1), ("small source", 0.0, None), ("none", None, 2), ("b_i_g", 0.1, 1), (None, 0.5, 1), ("absent", 0.8, 3)], "source_name string, target_weight double, max_repeats int")
    plan, rep = mixing.mixed(d, t)
    r = {x["source_name"]: x for x in rep.collect()}
    assert r["absent"]["short"] and not r["small source"]["short"] and not r["none"]["short"]
    names = {"big", "b_i_g"}
    assert {n for n in r if n in names} == names  # spelled apart, they are two sources
    assert plan.where("copies < 1").count() == 0


@pytest.mark.parametrize(("weight", "repeats"), [(0.5, 1), (0.7, 1), (0.9, 4), (0.01, 2)])
def test_mix_reaches_its_share(spark, weight, repeats):
    docs = spark.createDataFrame([(i, "a b c d e " * 3, "x" if i % 2 else "y") for i in range(600)], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("x", weight, repeats), ("y", 1 - weight, 1)], "source_name string, target_weight double, max_repeats int")
    plan, rep = mixing.mixed(docs, t)
    r = {x["source_name"]: x for x in rep.collect()}
    each = 1 / 600
    want = min(weight, repeats / 2)
    assert want - each - 1e-9 <= r["x"]["share"] <= want + 1e-9 and r["x"]["short"] == (weight > repeats / 2)
    copies = [c["copies"] for c in plan.where("source = 'x'").collect()]
    assert not copies or max(copies) <= repeats and max(copies) - min(copies) <= 1


def test_thresholds_are_nested_and_repeated_hashes_stay_together(spark):
    s = spark.createDataFrame([(i, "x", 5, (i // 2) * 7919 * 10**13 % 2**63) for i in range(200)], "doc_id bigint, source string, tokens bigint, hash bigint")
    cut = [mixing.thresholds(s, {"x": b})["x"] for b in (0, 50, 333, 999, 1000)]
    assert cut == sorted(cut) and cut[0] == 0 and cut[-1] == 1 << 64
    got = [mixing.mix(s, [{"source": "x", "rounds": 0, "below": c}]).count() for c in cut]
    assert got == [0, 10, 66, 198, 200]


def test_mix_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("x", 1.0, 1)], "source_name string, target_weight double, max_repeats int")
    plan, rep = mixing.mixed(d, t)
    assert plan.count() == 0 and [(r["share"], r["short"]) for r in rep.collect()] == [(0.0, False)]
    assert mixing.mixed(d, t.limit(0))[1].count() == 0


# ---- 8


HONEST = "The old mill stands by the river. Its wheel turned for many years, and people came from far to see it. Nobody knows who built the first one."


def test_stuffed(spark):
    rows = [
        (1, "cheap shoes buy shoes cheap red shoes sale shoes buy cheap shoes online shoes sale cheap shoes buy shoes red sale"),
        (2, "\n".join(f"* [cheap thing {i}](http://x{i}.example/a)" for i in range(9))),
        (3, "#shoes #cheap #sale #buy #red #online #shop #deal"),
        (4, HONEST),
        (5, "\n".join(f"- [The mill {i}](http://x.example/{i}): {HONEST}" for i in range(4))),
        (6, "My dog is tall.\n" * 9),
        (7, None),
        (8, ""),
        (9, "# Only a heading"),
        (10, HONEST + "\n\n" + "\n".join(f"http://x{i}.example/a" for i in range(40))),
        (1, "cheap shoes buy shoes cheap red shoes sale shoes buy cheap shoes online shoes sale cheap shoes buy shoes red sale"),
    ]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(1)).withColumn("key", F.lit("k"))
    got = {r["doc_id"]: r["reason"] for r in stuffed_rows(d)}
    assert got == {1: "repeated", 2: "links", 3: "links", 10: "links"}
    assert stuffing.stuffed(d.limit(0)).count() == 0


def test_stuffed_whatever_the_lines_look_like(spark):
    extra = ["ราคาถูก", "ขาย", "ซื้อ", "ออนไลน์", "ร้าน", "ลดราคา", "ดีที่สุด", "ส่งฟรี"] * 3
    dull = "cheap red buy sale order online discount top".split()
    rows = [
        (1, "cheap shoes! buy shoes! order shoes now. " * 100),
        (2, " ".join("พรมขนสัตว์" + x if i % 2 else x + "พรมขนสัตว์" for i, x in enumerate(extra))),
        (3, "\n".join(f"- {x} shoes" for x in dull)),
        (4, "\n\n".join(f"# Shop\ncheap shoes sale\nbuy shoes {x}\nshoes online {x}" for x in dull[:4])),
        (5, HONEST + "\n\n" + "Our oak stool shop sells oak stool with best oak stool deals. Looking for oak stool? Oak stool price, oak stool sale! Choose oak stool, because oak stool is top. " * 4),
        (6, "羊毛地毯批发，羊毛地毯便宜，羊毛地毯就选这里。找羊毛地毯？羊毛地毯价格！羊毛地毯包邮，羊毛地毯最好，羊毛地毯就选这里。" * 4),
        (20, "My dog is tall. " * 40),
        (21, "The dog barks. The dog sleeps. The dog eats. " * 5),
        (22, "\n".join(f"- {x} for the mill" for x in ("wheel", "stone", "floor", "roof", "door", "rope", "cart"))),
        (23, (HONEST + "\n\n") * 5),
    ]
    got = {r["doc_id"]: r["reason"] for r in stuffed_rows(spark.createDataFrame(rows, "doc_id bigint, text string"))}
    assert got == {i: "repeated" for i in range(1, 7)}


#: Honest documents, so that the corpus knows which words are common.
AROUND = [
    f"The {a} of the {b} is in the yard for a week, and it was not at the gate when we came to the {c}. You can ask how the {c} got to the {a} on a day in {m}."
    for a, b, c, m in zip("mill wheel rope cart barn lamp boat well roof path pump vat loom kiln".split(), "farm town port dam hill lake ford quay abbey chapel school inn forge lock".split(), "clerk baker smith miller nurse tailor guard pilot mason monk judge cook scribe fisher".split(), "March June July May April August October spring summer autumn winter December January November".split())
]


def stuffed_rows(d):
    around = d.sparkSession.createDataFrame(list(enumerate(AROUND, 1000)), "doc_id bigint, text string")
    return stuffing.stuffed(d.unionByName(around, allowMissingColumns=True)).collect()


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Pump online pump best pump. Looking for pump? Pump guide, pump guide! Choose pump, because pump from the pump store is best. Looking for pump? Pump best, pump online! Our pump shop sells pump with online pump deals.", True),
        ("Si busca manguera, aquí hay manguera online. Si busca lámpara, aquí hay lámpara barato. Si busca manguera, aquí hay manguera precio. Si busca lámpara, aquí hay lámpara mejor. Si busca manguera, aquí hay manguera barato.", True),
        ("找花园水管？花园水管最好！找花园水管？花园水管包邮！花园水管价格，花园水管便宜，花园水管就选这里。花园水管批发，花园水管厂家，花园水管就选这里。", True),
        ("Why the mill stays · Near Me Pump · How Lin fixed the roof · Pump Sale · Notes on the vat · Pump For Sale · Town library", True),
        ("The pump was mended on Monday. Nobody had looked at the pump for a year, and the clerk said so twice. A new pump costs more than the mill earns in June, but the old one can be kept for a while if it is oiled. The board will decide about it in the autumn.", False),
        ("The hirer shall return the hose to the grower on Monday. The hose stays the property of Berdor. The hirer shall return the cart to the clerk after the storm. The cart stays the property of Selwick. The hirer shall return the barn to the smith in early March. The barn stays the property of Linmar.", False),
        ("El taller abre la compuerta durante la noche. El barco anota tres motivos según Norgar. La vecina cuenta las cajas desde el invierno. El informe de mayo muestra un error sin mucho esfuerzo.", False),
    ],
)
def test_stuffing_set_as_sentences(spark, text, found):
    got = stuffed_rows(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    assert [r["doc_id"] for r in got] == [1] * found


def test_time_of_a_page_is_linear_in_its_length():
    import time

    def took(n):
        began = time.process_time()
        for text in ("see http://x.example and " + "[word " * n, "cheap shoes! buy shoes " * n, "<a " * n, "http://x.example " + "no marks " * n):
            stuffing.study([1], [text])
        return time.process_time() - began

    took(100)
    assert took(40_000) < 30 * took(4_000) + 0.5


def test_salad_is_judged_in_sentences_too(spark):
    rng = random.Random(3)
    plain = [f"{a} {b} {c} {d}" for a, b, c, d in zip(*(iter([f"w{i}" for i in range(400)]),) * 4)]
    around = [(i, ". ".join(rng.sample(plain, 20)) + ".") for i in range(300)]
    words = " ".join(plain).split()
    salad = ". ".join(" ".join(rng.sample(words, 4)) for _ in range(20)) + "."
    got = stuffing.stuffed(spark.createDataFrame([*around, (999, salad)], "doc_id bigint, text string")).collect()
    assert [(r["doc_id"], r["reason"]) for r in got] == [(999, "salad")]


def test_mean_pmi_of_every_page_against_brute_force(spark, monkeypatch):
    import math
    from collections import Counter

    texts = ["alpha beta gamma alpha beta delta alpha beta gamma alpha beta delta omega psi chi alpha beta", "beta gamma delta. alpha omega", "Alpha beta. Gamma delta alpha."]
    one, two = Counter(), Counter()
    for t in texts:
        ws = words_of(t)
        one.update(ws)
        two.update(zip(ws, ws[1:]))
    monkeypatch.setattr(stuffing, "CHUNK", 20)  # one text a chunk
    got = {r["doc_id"]: r for r in stuffing.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        ws = words_of(t)
        want = sum(math.log(two[p] * sum(one.values()) / one[p[0]] / one[p[1]]) for p in zip(ws, ws[1:])) / (len(ws) - 1)
        assert got[i]["mean_pmi"] == pytest.approx(want) and got[i]["pairs"] == len(ws) - 1


# ---- 3


def test_time_of_a_block_is_linear_in_its_length(model):
    import time

    def took(n):
        text = "« Bonjour ! » dit-il. Dr. Low came at 5 p.m. It rained.The end 3.5 kg... and more. " * n
        began = time.process_time()
        assert len(sentences.split(text, model, "en")) > n
        return time.process_time() - began

    took(100)
    assert took(12_000) < 20 * took(1_200) + 0.5  # 1 MB against 100 kB


def test_short_cut_for_single_sentences_changes_nothing(model):
    rnd = random.Random(8)
    bits = ["Low", "dr", ".", "!", "?", "…", "。", " ", " ", "\n", "»", "«", '"', "”", ")", "门", "ๆ", "ก", "5", "The end", "है", "।", "3.5"]
    for _ in range(4000):
        text = "".join(rnd.choices(bits, k=rnd.randint(0, 7)))
        assert sentences.split(text, model) == sentences.split(text, model, language(text) or "en"), text


@pytest.fixture(scope="module")
def model():
    starters = {("en", w) for w in ("The", "It", "She")} | {("de", w) for w in ("Die", "Der")} | {("ar", "كل")}
    return sentences.Model(starters, {("en", "dr"), ("en", "yahoo!"), ("en", "p.m"), ("de", "0"), ("de", "dr")})


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("en", "Dr. Low came at 5 p.m. It rained. She left!", ["Dr. Low came at 5 p.m.", "It rained.", "She left!"]),
        ("en", "Yahoo! Ltd. sells 3.5 kg. The end.", ["Yahoo! Ltd. sells 3.5 kg.", "The end."]),
        ("en", '"Stop it!" said the man. "Why?" she wrote.', ['"Stop it!" said the man.', '"Why?" she wrote.']),
        ("en", "One here.The next one... and more.", ["One here.", "The next one... and more."]),
        ("en", "(The end came.) It went on.", ["(The end came.)", "It went on."]),
        ("en", "a list entry", ["a list entry"]),
        ("de", "Am 9. Mai kam Dr. Ott. Die Tür war zu.", ["Am 9. Mai kam Dr. Ott.", "Die Tür war zu."]),
        ("zh", "他问：“门关了吗？”然后走了。价格是1.5元！好。", ["他问：“门关了吗？”然后走了。", "价格是1.5元！", "好。"]),
        ("ja", "「止まれ！」と門番が叫んだ。次の文。", ["「止まれ！」と門番が叫んだ。", "次の文。"]),
        ("th", "ประโยคหนึ่ง ประโยคสอง 13 คน", ["ประโยคหนึ่ง", "ประโยคสอง 13 คน"]),
        ("hi", "वह आया। वह गया?", ["वह आया।", "वह गया?"]),
        ("ar", "«قف!» صاح الحارس. كل يوم.", ["«قف!» صاح الحارس.", "كل يوم."]),
        ("en", "  \n ", []),
        ("en", "", []),
    ],
)
def test_split(model, lang, text, want):
    assert [text[a:b] for a, b in sentences.split(text, model, lang)] == want


def test_learning(spark):
    rnd = random.Random(1)
    names = [a + b for a in ("Bor", "Lin", "Tar", "Wex") for b in ("mos", "hav", "kel", "ney")]
    rows = []
    for i in range(400):
        n = [rnd.choice(names) for _ in range(3)]
        parts = [f"The mill of Dr. {n[0]} was sold to him by the town of {n[1]}.", "It is on the hill in the old part of the place.", f"She saw it with Dr. {n[2]} at the gate."]
        rows.append((i, " ".join(parts[i % 3 :] + parts[: i % 3])))
    b = spark.createDataFrame(rows + [(None, "x"), (9000, None), (9001, ""), (0, rows[0][1])], "block_id bigint, text string").withColumn("n", F.lit(0)).withColumn("lang", F.lit(0))
    m = sentences.learn(b)
    assert ("en", "dr") in m.abbreviations and ("en", "place") not in m.abbreviations
    assert {("en", "The")} <= m.starters and ("en", names[0]) not in m.starters
    got = sentences.sentences(b, m)
    assert got.where("block_id = 0").count() == 3 and got.count() == 1200
    empty = b.limit(0)
    assert sentences.sentences(empty, sentences.learn(empty)).count() == 0


def test_numbers_are_judged_by_the_word_behind_them(spark):
    def learned(dates, ends):
        rows = [f"Der Rat kam am {i % 28 + 1}. Mai in die Stadt und blieb nicht im Haus." for i in range(dates)]
        rows += [f"Die Mühle wurde verkauft im Jahr {1900 + i}. {w} kam der Rat mit dem Plan." for i, w in zip(range(ends), ["Gestern", "Heute", "Danach", "Dort"] * ends)]
        rows += [f"Der Rat ist nicht im {x}. {w} kam er mit dem Plan." for w in ("Gestern", "Heute", "Danach", "Dort", "Der", "Der", "Die", "Die") for x in ("Haus", "Dorf", "Tal", "Wald", "Saal", "Hof", "Turm", "Bad")]
        return sentences.learn(spark.createDataFrame(list(enumerate(rows)), "block_id bigint, text string"))

    date, end = "Der Rat kam am 9. Mai in die Stadt.", ["Sie wurde verkauft im Jahr 2019.", "Gestern kam der Rat."]
    for dates, ends in ((30, 60), (200, 20)):  # numbers mostly end a sentence, mostly go on
        m = learned(dates, ends)
        assert [date[a:b] for a, b in sentences.split(date, m, "de")] == [date]
        assert [" ".join(end)[a:b] for a, b in sentences.split(" ".join(end), m, "de")] == end


def test_language():
    assert [language(t) for t in ("The mill of the town", "Die Mühle der Stadt", "Le moulin de la ville est là", "门关了", "門は閉まった", "ประโยค", "वह आया", "قف", "Дом Wexkel", "", "123")] == ["en", "de", "fr", "zh", "ja", "th", "hi", "ar", "ru", "", ""]


# ---- 2, 4, 1


PARA = "The old mill stands by the river and its wheel turned for many years. People came from far to see it, and nobody knows who built the first of them. It was sold in the spring."


def pages(spark, n=30):
    rows, fs = [], []
    for i in range(n):
        fs.append((i, "html" if i % 2 else "md", 1))
        body = [("Head of page", "heading", 1), (PARA, "paragraph", 0), ("Second part", "heading", 2), (PARA, "list_item", 0)]
        if i % 2:
            body = [("Head of page - Site", "title", 0), ("Home", "list_item", 0), ("Search", "list_item", 0), *body, ("Related stories", "paragraph", 0), (f"Mill number {i}", "paragraph", 0), ("All rights reserved", "paragraph", 0)]
        rows += [(i, p, t, k, h) for p, (t, k, h) in enumerate(body)]
    return files(spark, fs), blocks(spark, rows)


def test_boilerplate(spark):
    f, b = pages(spark)
    again = b.unionByName(b)
    got = boilerplate.boilerplate(f, again)
    assert got.count() == 15 * 10
    kept = got.where("file_id = 1 and not removed").join(b.select("block_id", "text"), "block_id").collect()
    assert sorted(r["text"] for r in kept) == sorted(["Head of page", PARA, "Second part", PARA])
    assert boilerplate.boilerplate(f.limit(0), b).count() == 0 and boilerplate.boilerplate(f, b.limit(0)).count() == 0
    odd = blocks(spark, [(1, None, "Alone", None, None), (1, 2, None, None, None), (None, 1, "x", "p", 0), (77, 1, "x", "p", 0), (1, 3, "", "p", 0), (1, 4, "x" * 200_000, "p", 0)])
    assert boilerplate.boilerplate(f, odd).count() == 3


def test_features_are_counted_over_all_files(spark):
    n = 60_000
    fs = spark.range(n).select(F.col("id").alias("file_id"), F.when(F.col("id") % 2 == 0, "html").otherwise("md").alias("file_format"))
    # each of ten wordings stands in four pages
    text = F.when((F.col("id") < 80) & (F.col("id") % 2 == 0), F.concat(F.lit("Corner "), F.element_at(F.array(*(F.lit(f"{c}x") for c in "abcdefghij")), (F.col("id") / 8).cast("int") + 1))).otherwise("plain text")
    bs = spark.range(n).select(F.col("id").alias("file_id"), F.col("id").alias("block_id"), F.lit(0).alias("pos"), text.alias("text"), F.lit("paragraph").alias("kind"), F.lit(0).alias("head_level"), F.lit(None).cast("int").alias("word_count"))
    m = boilerplate.fit(fs, bs, False)
    assert {f for f in m.odds if f.startswith("=corner")} == {f"=corner {c}x" for c in "abcdefghij"}
    assert m.odds["=corner ax"] == pytest.approx(math.log(6 / 30_002) - math.log(2 / 30_002))


def test_long_files_give_the_same_in_segments(spark, monkeypatch):
    from inkloom.llm import common

    rnd = random.Random(9)
    f, b = pages(spark)
    kinds = [("Home  Shop  Help", "paragraph", 0), ("Related pages", "heading", 2), ("See the mill", "list_item", 0), (PARA, "paragraph", 0), ("Part of it", "heading", 2), ("A subject", "heading", 3), ("x | y", "table_cell", 0), ("Cookies are used here.", "paragraph", 0)]
    rows = [(i, p, *("Head of page", "heading", 1)) if p == 300 * (i - 901) + 40 else (i, p, *rnd.choice(kinds)) for i in (901, 902, 903) for p in range(1500)]
    f = f.unionByName(files(spark, [(901, "html", 1), (902, "html", 1), (903, "md", 1)]), allowMissingColumns=True)
    b = b.unionByName(blocks(spark, rows).withColumn("block_id", F.col("block_id") + 10_000))
    s = settings(spark, (1, 8.0, None, None))
    look = lambda: ({tuple(r) for r in boilerplate.boilerplate(f, b).select("block_id", "removed").collect()}, {(r["file_id"], r["words"], r["sentences"], round(r["grade"], 9)) for r in readability.grades(f, b, s).collect()})
    whole = look()
    monkeypatch.setattr(common, "SEGMENT", 250)
    assert look() == whole and len(whole[0]) == 3150 and {x for _, x in whole[0]} == {True, False} and any(r[0] > 900 for r in whole[1])


def test_familiar_words_are_those_of_files_that_raters_find_easy(spark):
    rows = [(i, 1, 1, True, 5, 50, ["the", "stone", "plain" if i < 100 else "hard"], [1, 1, 1]) for i in range(200)]
    rows = spark.createDataFrame(rows, readability.PROSE)
    labels = spark.createDataFrame([(i, lv) for i in range(200) for lv in ((1, 1, 3) if i < 100 else (1, 5, 5))] + [(None, 1), (3, None)], "file_id bigint, read_level int")
    assert readability.familiar(rows, labels) == {"the", "stone", "plain"}  # "hard" stands in half of all files, but in none of the easy ones
    assert readability.familiar(rows) == readability.familiar(rows, labels.limit(0)) == {"the", "stone", "plain", "hard"}
    assert readability.familiar(rows.limit(0), labels) == set()


def test_minimum_cut_against_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randint(1, 8)
        u = [rnd.uniform(-3, 3) for _ in range(n)]
        edges = {(i, j): rnd.uniform(0, 2.5) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5}

        def cost(side):
            return sum(max(0, x) for x, s in zip(u, side) if not s) + sum(max(0, -x) for x, s in zip(u, side) if s) + sum(w for (i, j), w in edges.items() if side[i] != side[j])  # noqa: B023

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(boilerplate.minimum_cut(u, edges)) == pytest.approx(best)


def test_natures(spark):
    f = files(spark, [(i, "MD", 1) for i in range(40)] + [(90, "html", 1)])
    rows = [(i, p, PARA, "paragraph", 0) for i in range(36) for p in range(3)]
    rows += [(36, p, f"{w} of the mill", "paragraph", 0) for p, w in enumerate(("wheel", "stone", "floor", "roof"))]
    rows += [(37, p, f"wheel | {p}4.5 | n/a | {p}%", "paragraph", 0) for p in range(5)]
    rows += [(38, p, "function a9(z){return x[53]||!0};function g9(y){return x[5]||!0};", "list_item", 0) for p in range(3)]
    rows += [(39, 0, "Only a heading", "heading", 1), (39, 1, "", "paragraph", 0), (39, 2, None, None, None), (90, 0, "a b", "list_item", 0)]
    b = blocks(spark, rows)
    got = {r["file_id"]: r["nature"] for r in quality.file_natures(f, b.unionByName(b)).collect() if r["nature"] != "prose"}
    assert got == {36: "list", 37: "table", 38: "junk"}
    assert quality.file_natures(f, b.limit(0)).count() == 0
    one = quality.natures(b).where("file_id = 38").first()
    assert sum(one["contributions"]) == pytest.approx(one["distance"])


def test_junk_that_ends_as_a_sentence(spark):
    rows = [(i, p, PARA, "paragraph", 0) for i in range(36) for p in range(3)]
    rows += [(40, p, "." * (90 + p) + " " + "." * 70, "paragraph", 0) for p in range(3)]
    rows += [(41, p, f"{p}QmFzZTY0aXNhZW5jb2RpbmdvZmJ5dGVz{p}aGVsbG93b3JsZA YWFhYmJiY2NjZGRkZWVlZmZmZ2dnaGhoaWlp{p}oaWlpampqa2trbGxs.", "paragraph", 0) for p in range(3)]
    f = files(spark, [(i, "md", 1) for i in [*range(36), 40, 41]])
    got = {r["file_id"]: r["nature"] for r in quality.file_natures(f, blocks(spark, rows)).collect() if r["nature"] != "prose"}
    assert got == {40: "junk", 41: "junk"}


def test_grades(spark):
    hard = "Institutional reconfiguration of methodological responsibilities necessitates epistemological standardization of the heterogeneous infrastructures within contemporary organizational environments. " * 6
    easy = "The cat sat on the mat. It saw a red bird in the old tree. The bird sang to it. " * 4
    rows = [(i, 0, easy, "paragraph", 0) for i in range(30)] + [(50, 0, hard, "paragraph", 0), (51, 0, "Die Mühle der Stadt ist alt und nicht schön. " * 9, "paragraph", 0), (52, 0, "Too short.", "paragraph", 0), (53, 0, hard, "heading", 1), (54, 0, None, None, 0)]
    f = files(spark, [(i, "md", 1 if i % 2 else 9) for i in [*range(30), *range(50, 55)]])
    s = settings(spark, (1, 8.0, None, None), (9, None, None, None))
    b = blocks(spark, rows)
    got = {r["file_id"]: r for r in readability.grades(f, b.unionByName(b), s).collect()}
    assert set(got) == {*range(30), 50} and got[50]["over"] and not any(got[i]["over"] for i in range(30))
    assert got[50]["reading_limit"] == 14.0 and got[1]["reading_limit"] == 8.0
    assert readability.grades(f, b.limit(0), s).count() == 0


def test_blocks_without_words_behind_the_heading(spark):
    f, b = pages(spark)
    rows = [(1, 500 + i, "1 234 " * 20 if i else "." * 90, "paragraph", 0) for i in range(3)]
    more = b.unionByName(blocks(spark, rows).withColumn("block_id", F.col("block_id") + 10_000))
    got = {r["block_id"]: r["removed"] for r in boilerplate.boilerplate(f, more).collect()}
    assert {10_001, 10_002, 10_003} <= set(got)
    s = settings(spark, (1, 8.0, None, None))
    assert {r["file_id"] for r in readability.grades(f, more, s).collect()} == {r["file_id"] for r in readability.grades(f, b, s).collect()}


def test_blocks_are_gathered_without_columns_that_nothing_reads(spark):
    from inkloom.llm import common

    held = common.files_with_blocks(*pages(spark)).schema["blocks"].dataType.elementType.names
    assert set(held) == {"pos", "block_id", "text", "kind", "head_level"}


def test_words_found_on_bytes_are_those_of_the_patterns():
    from inkloom.llm import common

    rnd = random.Random(7)
    odd = [*" \t\n\x1c\x85\xa0.!?…·|>»\"'”’-_{\\²ªßİKſΣéÿœ\x81\x92\ud800и", "  ", "...", "the", "für", "Don't", "don’t", "-x", "'tis", "a--b", "Dr.", "मिल", "日本", "And so", "Shop"]
    for _ in range(3000):
        t = "".join(rnd.choice(odd) + " " * (rnd.random() < 0.4) for _ in range(rnd.randint(0, 30)))
        assert readability.word_counts(t) == Counter(readability._WORD.findall(t.lower())), t
        assert common.letter_words(t) == re.findall(r"[^\W\d_]+", t.lower()), t
        assert boilerplate.is_ended(t) == bool(re.search(r"[.!?。！？।؟]+[\"'”’»」』)\]]*\s*$", t) and not re.search(r"(?:…|\.\.\.)\s*$", t)), t
        assert boilerplate.is_navigation(t) == bool(boilerplate._NAV.search(t) and not boilerplate.is_prose(t)), t
        last = re.match(r"(?s).*[.!?]+[\"'”’»)\]]*(?=\s|$)", t)
        assert readability.is_running(t) == (last is not None and last.end() >= 0.5 * len(t) and len(readability._ODD.findall(t)) <= 0.05 * len(t) and quality.cells_of(t) == 1 and " " in t.strip()), t
