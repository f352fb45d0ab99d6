"""Look-alike texts, cut texts and languages on made-up corpora."""

import random

import pytest

from loreline.llm.cut import cut_rates, score_cuts
from loreline.llm.language import OTHER, document_languages, is_foreign, label_language, relabelled
from loreline.llm.lookalike import CLASSES, Lattice, consistent_text, same_looking_classes, same_looking_pairs, visible

ALIKE = "origin string, scope int, id long, text string, form string"


def test_no_letter_is_in_two_classes():
    letters = "".join(CLASSES)
    assert len(letters) == len(set(letters))


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Рort", "Port", True), ("Ｐｏｒｔ", "Port", True), ("Po​rt", "Port", True), ("a b", "a b", True), ("ﬁn", "fin", True), ("é", "é", True), ("ɡo", "go", True), ("qν", "qv", True),
        ("Port", "port", False), ("é", "e", False), ("a b", "ab", False), ("1", "l", False), ("0", "O", False), ("Ⅰ", "I", False), ("𝐀", "A", False),
    ],
)
def test_forms_are_equal_just_where_texts_look_equal(a, b, same):
    read = Lattice({("^", "P"): 5, ("P", "o"): 5, ("o", "r"): 5}).text
    assert (read(a) == read(b)) is same and read(read(a)) == read(a)


def test_pairs_and_classes_are_brute_force(spark):
    r = random.Random(4)
    swap = {"o": "оo", "a": "аa", "P": "РP", "e": "еe"}
    words = ["Port Gare", "Port  Gare", "port gare", "Old Pearl", "Peal"]
    rows = [("x", r.randint(0, 1), i, "".join(r.choice(swap.get(c, c)) for c in r.choice(words)), "clash") for i in range(60)]
    rows += [("x", 0, 100, None, ""), ("x", 0, 101, "", ""), rows[0]]
    df = spark.createDataFrame(rows, ALIKE)
    plain = lambda t: t.translate(str.maketrans("оаРе", "oaPe"))
    good = {x[:4] for x in rows if x[3]}
    want = {(a[2], b[2]) for a in good for b in good if a[2] < b[2] and a[1] == b[1] and a[3] != b[3] and plain(a[3]) == plain(b[3])}
    assert {(x.a_id, x.b_id) for x in same_looking_pairs(df).collect()} == want and want
    classes = same_looking_classes(df).collect()
    assert len(classes) == len(good)
    for c in classes:
        mates = {x.raw for x in classes if (x.scope, x.form) == (c.scope, c.form)}
        assert len(mates) == c.members
    assert same_looking_pairs(df.limit(0)).count() == 0


def test_nulls_and_long_texts_keep_their_place(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "аb" * 20_000)], "id int, text string")
    got = {r.id: r.consistent for r in consistent_text(df, "text", {}).collect()}
    assert got[1] is None and got[2] == "" and len(got[3]) == 40_000 and visible("") == ""


# -- cut texts -------------------------------------------------------------------------------------------


def recaps(n, seed):
    r = random.Random(seed)
    sentence = lambda: " ".join(r.choice("the crew finds an old map under broken stairs while rain falls over harbour walls again".split()) for _ in range(r.randint(6, 14))).capitalize() + r.choice("...!?").replace("..", ".")
    return ["\n\n".join(" ".join(sentence() for _ in range(r.randint(2, 5))) for _ in range(r.randint(1, 3))) for _ in range(n)]


def test_cut_records_are_told_from_whole_ones(spark):
    r, rows, cut = random.Random(1), [], set()
    for i, t in enumerate(recaps(600, 1)):
        if i % 10 == 0:
            t, _ = t[: r.randint(len(t) // 2, len(t) - 12)].rstrip().rstrip(".!? "), cut.add(i)
        rows.append(("d", i, "src" if i % 2 else None, t))
    rows += [("d", 1000, "src", None), ("d", 1001, "src", "  "), ("d", 1002, "src", "Cast: Ann, Bob, Cid"), rows[3]]
    scored = score_cuts(spark.createDataFrame(rows, "origin string, rec_id long, source string, text string"))
    got = {x.rec_id: x.p_cut for x in scored.collect()}
    assert got[1000] is None and got[1001] is None
    found = {i for i, p in got.items() if p is not None and p >= 0.5}
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.01 * len(rows)
    rates = {x.source: (x.records, x.rate) for x in cut_rates(scored).collect()}
    assert set(rates) == {"", "src"} and rates[""][0] == 300
    assert score_cuts(spark.createDataFrame([], "origin string, rec_id long, source string, text string")).count() == 0


# -- languages -------------------------------------------------------------------------------------------

WORDS = {
    "en": "the ship with which they were never going home again because nobody would follow", "de": "das schiff mit dem sie niemals wieder nach hause fahren weil niemand folgen wollte",
    "fr": "le navire avec lequel ils ne sont jamais rentrés parce que personne voulait les suivre", "es": "el barco con el que nunca volvieron porque nadie quería seguirlos hasta la orilla",
    "it": "la nave con cui non sono mai tornati perché nessuno voleva seguirli fino alla riva", "pt": "o navio com que nunca voltaram porque ninguém queria segui-los até à margem não são",
    "ja": "その船で彼らは二度と家に帰らなかった誰もついて行かなかったからだ",
}


def paragraph(lang, r):
    w = WORDS[lang].split() if lang != "ja" else list(WORDS[lang])
    return ("" if lang == "ja" else " ").join(r.choice(w) for _ in range(24)) + "."


def corpus(n=210, seed=6):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 7]
        parts = [paragraph(lang, r) for _ in range(4)]
        other = list(WORDS)[(i + 3) % 7]
        if i % 5 == 0:
            parts[2] = paragraph(other, r)
        label = None if i % 6 == 0 else "klingon" if i % 11 == 0 else {"en": "English", "de": "de-AT"}.get(lang, lang)
        rows.append((i, "\n\n".join(parts), label, lang, other if i % 5 == 0 else None))
    return rows


def test_labels_and_foreign_paragraphs_are_put_right(spark):
    rows = corpus()
    df = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string")
    got = {(x.doc_id, x.seg_no, x.lang) for x in relabelled(df.unionByName(df.limit(9))).collect()}
    want = {(i, -1, lang) for i, _, label, lang, _ in rows if label in (None, "klingon")} | {(i, 2, other) for i, _, _, _, other in rows if other}
    assert len(got ^ want) <= 0.03 * len(want)


def test_none_of_the_languages_blank_and_short_texts(spark):
    rows = [x[:3] for x in corpus()]
    odd = [(900, "Он никогда не вернулся домой, потому что никто не хотел следовать за ним.", "en"), (901, "他们从来没有回家因为没有人愿意跟随他们到岸边去", None), (902, None, "en"), (903, "  \n\n ", "en"), (904, "the ship", "en"), (905, "1 2 3", "en")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in document_languages(df).where("doc_id >= 900").collect()}
    assert got[900].main == OTHER and got[901].main == OTHER and got[902].main is None and got[903].main is None and got[905].main is None
    assert got[904].segments[0].confidence < 0.9 and is_foreign("Он") and not is_foreign("Él")
    assert not {900, 901, 902, 903, 905} & {x.doc_id for x in relabelled(df).collect()}
    assert document_languages(df.limit(0)).count() == 0


def test_names_of_languages(spark):
    df = spark.createDataFrame([("EN",), ("en-GB",), ("Français",), ("日本語",), ("x",), (None,), ("",)], "lang string")
    assert [r[0] for r in df.select(label_language(df["lang"])).collect()] == ["en", "en", "fr", "ja", None, None, None]
