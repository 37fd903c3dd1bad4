import itertools
import random

import numpy as np
import pytest

from voxloom.llm.quality import LOOKS, LineModel, line_model, look_of, text_quality, viterbi

PROSE = "She asked who described the receipt on the shallow orchard, and nobody had an answer for it. When it was late they went home."


@pytest.mark.parametrize(
    "line, look",
    [
        (PROSE, "sentence"), ("• gentle parcel", "marked item"), ("(12) weekly orchard", "marked item"), ("ledger 48", "short item"), ("Home » News » Contact » Team", "inline list"),
        ("€2.45\t€96801.65\t-\t€6.09", "row"), ("---|---|---", "row"), ("3,810.9 | 0.3 | 27.0", "row"), ("var y=function(){return 264<<68};", "code"), ("8a 5e 49 da 05 50 c5 fa", "token"),
        ("M9v0lppP+FopF9QLj1G/y01zwAcKxtgxTmKEpGBt8xy9", "token"), ("Züge Züge Züge Züge Züge", "repeat"), ("Ð¼Ñ‹ Ð´ÑƒÐ¼Ð°ÐµÐ¼ Ñ‡Ñ‚Ð¾", "garbled"), ("лПЗДБ РПЕЪДБ ЪБВЩМЙ ТЕЛЙ", "garbled"),
        ("z.na,ymgl;egdejk;l..zofvktbr,;diieygtbfy", "noise"), ("我们昨天检查了那个遥远的河流。", "sentence"), ("联系方式", "short item"), ("Creo que los niÃ±os de Quafenmere son mÃ¡s pÃºblicos", "sentence"), ("   ", "other"),
    ],
)
def test_looks(line, look):
    assert look_of(line)[0] == look


def test_words_are_counted_over_the_whole_line(spark):
    prose = (PROSE + " ") * 200
    late = " ".join(prose.split()[:400]) + " Züge" * 4_000
    early = "Züge " * 400 + " ".join(prose.split()[:4_000])
    assert look_of(late)[0] == "repeat" and look_of(early)[0] == "sentence"
    found = text_quality(spark.createDataFrame([(1, late), (2, early)], "doc_id long, text string"))
    assert {(r.doc_id, r.kind) for r in found.collect()} == {(1, "junk"), (2, "prose")}


def test_viterbi_finds_the_likeliest_path():
    rng, model = random.Random(3), LineModel.prior()
    start, transition, emission = model.logs()
    for _ in range(20):
        lengths = np.array([rng.randint(0, 5) for _ in range(6)])
        looks = np.array([rng.randrange(len(LOOKS)) for _ in range(lengths.sum())], np.int64)
        found, at = viterbi(model, looks, lengths), 0
        for n in lengths:
            own, mine = looks[at : at + n], found[at : at + n]
            at += n
            score = lambda p: start[p[0]] + sum(emission[o, s] for o, s in zip(own, p)) + sum(transition[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            if n:
                assert score(list(mine)) == pytest.approx(max(score(p) for p in itertools.product(range(4), repeat=int(n))))


def test_expected_counts_are_those_over_all_paths():
    rng, model = random.Random(8), LineModel.prior()
    lengths = np.array([4, 1, 3])
    looks = np.array([rng.randrange(len(LOOKS)) for _ in range(8)], np.int64)
    start, pairs, seen = model._expected(looks, lengths)
    s, p, e, at = np.zeros(4), np.zeros((4, 4)), np.zeros((len(LOOKS), 4)), 0
    for n in lengths:
        own = looks[at : at + n]
        at += n
        paths = list(itertools.product(range(4), repeat=int(n)))
        weights = np.array([model.start[x[0]] * np.prod([model.emission[o, y] for o, y in zip(own, x)]) * np.prod([model.transition[a, b] for a, b in zip(x, x[1:])]) for x in paths])
        for x, w in zip(paths, weights / weights.sum()):
            s[x[0]] += w
            for a, b in zip(x, x[1:]):
                p[a, b] += w
            for o, y in zip(own, x):
                e[o, y] += w
    assert np.allclose(start, s) and np.allclose(pairs, p) and np.allclose(seen, e)


def test_fitting_finds_how_lines_are_drawn():
    rng = np.random.default_rng(1)
    true = LineModel.prior()
    stay = np.where(np.eye(4, dtype=bool), 0.97, 0.01)
    looks, lengths = [], []
    for _ in range(400):
        state = rng.choice(4, p=true.start)
        lengths.append(int(rng.integers(1, 40)))
        for _ in range(lengths[-1]):
            looks.append(rng.choice(len(LOOKS), p=true.emission[:, state]))
            state = rng.choice(4, p=stay[state])
    model = LineModel.fitted(np.array(looks), np.array(lengths), rounds=20, weight=0.001)
    assert np.abs(model.transition - stay).max() < 0.03 and np.abs(model.emission - true.emission).max() < 0.06
    assert np.allclose(LineModel.of(model.values()).transition, model.transition)
    assert np.allclose(LineModel.fitted(np.zeros(0, np.int64), np.zeros(0, np.int64)).emission, true.emission)


def test_lines_that_are_not_of_the_test_data(spark):
    prose = "The committee will not meet again until the end of May, but its members have been asked to send in what they think of the draft."
    other = "Der Ausschuss wird sich erst am Ende des Monats wieder mit der Frage befassen, weil noch nicht alle Antworten da sind."
    third = "La commission se réunira à la fin du mois, mais les membres ont déjà reçu le texte et peuvent y répondre par écrit."
    steps = "\n".join(f"{n}. {x}" for n, x in enumerate(["flour", "two eggs", "salt", "olive oil", "warm water", "dry yeast", "a pan"], 1))
    cells = "\n".join(f"| {c} | {i * 3}.{i} | {i * 17 % 11} |" for i, c in enumerate(["Lisbon", "Oslo", "Quito", "Cairo", "Perth", "Seoul"]))
    code = "\n".join(["import os;", "x = {'a': [1, 2]};", "for (i=0;i<9;i++){ go(i); }", "</div><div class='q'>", "$f = fn($x) => $x ** 2;"] * 3)
    rows = [(1, prose), (2, other), (3, third), (4, steps), (5, cells), (6, code), (7, prose + "\n" + steps[:20])]
    found = {r.doc_id: r.kind for r in text_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "prose", 2: "prose", 3: "prose", 4: "list", 5: "table", 6: "junk", 7: "prose"}


def test_the_model_is_one_row_and_of_a_bounded_sample(spark):
    df = spark.range(300).selectExpr("id as doc_id", "case when id % 2 = 0 then repeat('- entry\n', 50) end as text")
    whole, part = (LineModel.of(line_model(df, sample=n).collect()[0][0]) for n in (1000, 60))
    assert whole.emission[2, 1] > LineModel.prior().emission[2, 1] + 0.01 and part.emission[2, 1] > LineModel.prior().emission[2, 1]
    assert [len(r.model) for r in line_model(df.limit(0)).collect()] in ([], [20 + 4 * len(LOOKS)])


def test_the_model_is_fitted_on_all_lines_of_all_documents(spark):
    late = "- entry\n" * 600 + "€2.45\t€96801.65\t-\t€6.09\n" * 2_000
    texts = [late, None, "", *("var y=function(){return 264<<68};\n" * (n % 5) + PROSE for n in range(2_600))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    looks = [[list(LOOKS).index(look_of(line)[0]) for line in (t or "").splitlines()] for t in texts]
    whole = LineModel.fitted(np.array([x for own in looks for x in own]), np.array([len(own) for own in looks]))
    found = LineModel.of(line_model(df).first().model)
    assert np.allclose(found.start, whole.start) and np.allclose(found.transition, whole.transition) and np.allclose(found.emission, whole.emission)
    given, own = ({tuple(r) for r in text_quality(df, model=m).collect()} for m in (line_model(df), None))
    assert given == own and len(own) == len(texts)


def test_operator(spark):
    items = "\n".join(f"• item {i}" for i in range(30))
    table = "\n".join(f"name {i}\t{i}.5\t{i * 7}\t-" for i in range(30))
    wrapped = "\n".join(" ".join(PROSE.split()[i : i + 3]) for i in range(0, 24, 3))
    rows = [(1, PROSE), (2, items), (3, table), (4, "8f 3a " * 40), (5, None), (6, ""), (7, " \n\t"), (8, wrapped), (9, "Home\nNews\n" + PROSE), (10, PROSE * 20_000), (None, items), (2, items)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as kind", "1 as words")
    found = {(r.doc_id, r.kind) for r in text_quality(df).collect()}
    assert found == {(1, "prose"), (2, "list"), (3, "table"), (4, "junk"), (5, None), (6, None), (7, None), (8, "prose"), (9, "prose"), (10, "prose"), (None, "list")}
    one = text_quality(df.where("doc_id = 1")).first()
    assert one.lines == 1 and one.words == 24 and one.ended_line_share == 1.0 and one.prose_share == 1.0 and 3 < one.mean_word_length < 5 and one.digit_share == 0.0
    assert text_quality(df).count() == len(rows) and text_quality(df.limit(0)).count() == 0
