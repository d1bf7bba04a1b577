"""Leaks, defects, truncation and levels on fixtures made here."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tallgrass.llm import arrowtext as at
from tallgrass.llm import boosting, fieldshape, language, leaks, linear, pairs, reading_level, truncation

rng = random.Random(5)
NAMES = ["Brell", "Toska", "Quimby", "Vessa", "Darnum", "Ophir", "Lethe", "Marrow", "Senna", "Jubal", "Karst", "Wexley"]


def name():
    return rng.choice("BDFGKLMNPRSTV") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice("aeiou") + rng.choice("ckmnrsx") + rng.choice(["", "a", "o"])


def question():
    return " ".join(f"The steward {name()} of {name()} ships {rng.randint(2, 9999)} {rng.choice(['lanterns', 'barrels', 'kites'])} to {name()} before {rng.choice(['noon', 'dawn'])}." for _ in range(5)) + " How many remain? [ANS] Round your answers to three decimal places if necessary."


QUESTIONS = [question() for _ in range(40)]
PROSE = ["Factor out the common term and simplify.", "Adding both sides yields a larger value.", "We cannot divide by zero here.", "The mean is close to the median in this table.", "So the claim holds for every index.", "It is unable to exceed the bound, as shown above."]


def prose(n):
    return " ".join(rng.choice(PROSE) for _ in range(n))


# --- arrowtext ---------------------------------------------------------------------------------


def test_hashes_do_not_depend_on_place():
    texts = ["Alpha beta 12", "", "beta", "x" * 3000 + " beta", "ÄÖ beta-12"]
    col = pa.array(texts)
    w = at.Words(*at.buffers(col))
    beta = at.hash_text("beta")
    assert sorted(w.row[w.hash == beta].tolist()) == [0, 2, 3, 4] and at.hash_text("BETA") == beta
    part = at.Words(*at.buffers(col.slice(2, 2)))
    assert part.hash[0] == beta and part.rows == 2 and w.count.tolist() == [3, 0, 1, 2, 3]
    assert [b - a for a, b in at.blocks(col, 10)] and sum(b - a for a, b in at.blocks(col, 10)) == 5
    assert list(at.blocks(pa.array([], pa.string()))) == []


# --- leaks -------------------------------------------------------------------------------------


def items(spark):
    rows = [(i, q) for i, q in enumerate(QUESTIONS)] + [(3, QUESTIONS[3]), (99, None)]
    return spark.createDataFrame(rows, "id bigint, question string")


def test_leaks(spark):
    w = QUESTIONS[7].split(" ")
    part = " ".join(w[10:40])
    typo = part.split(" ")
    typo[9] = "changed"
    docs = {
        1: "Intro. " + QUESTIONS[0] + " Outro.", 2: prose(20) + " " + part.upper() + " " + prose(5), 3: part.replace(" ", " "), 4: "<b>" + part.replace(" ", "</b> <i>_", 1) + "_</i>", 5: " ".join(w[10:26]) + ". " + prose(9) + " " + " ".join(w[26:42]),
        6: " ".join(typo), 7: " ".join(w[10:16]), 8: "Round your answers to three decimal places if necessary. " * 3, 9: question(), 10: None, 11: "", 12: prose(9000) + " " + part, 13: part.replace(" ", " ​"), 14: QUESTIONS[3],
    }
    rows = [(k, t, "x") for k, t in docs.items()] + [(1, docs[1], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id string")  # id clashes with the result
    got = [(r[0], r[1]) for r in leaks.leaked(df, items(spark)).collect()]
    want = [(1, 0), (1, 0), (2, 7), (3, 7), (4, 7), (5, 7), (6, 7), (12, 7), (13, 7), (14, 3)]
    assert sorted(got) == want
    assert leaks.leaked(df.limit(0), items(spark)).count() == 0 and leaks.leaked(df, items(spark).limit(0)).count() == 0


def test_retrieval_loses_nothing_against_brute_force():
    ix = leaks.Index(list(range(len(QUESTIONS))), QUESTIONS)
    texts = []
    for _ in range(300):
        w = rng.choice(QUESTIONS).split(" ")
        a = rng.randint(0, len(w) - 30)
        texts.append(prose(rng.randint(0, 8)) + " " + " ".join(w[a : a + rng.randint(3, 30)]) + " " + prose(3))
    w = leaks._words(leaks.level(pa.array(texts)))
    everything = np.arange(len(texts) * len(QUESTIONS))
    assert set(ix.verify(w, everything)[0].tolist()) == set(ix.verify(w, ix.retrieve(w))[0].tolist())


# --- language ----------------------------------------------------------------------------------


def test_language():
    texts = ["The sum of the terms is zero.", "Die Summe der beiden Zahlen ist null.", "La somme des deux termes est nulle.", "Сумма двух чисел равна нулю.", "所以只剩下一个解。", "$x^2 + 1$", "", "<redacted_thinking>\n</redacted_thinking> \\boxed{C}"]
    tongue = language.Tongue()
    s = language.sentences(pa.array(texts), tongue)
    assert [language.LANGS[k] if k >= 0 else "-" for k in s.main()] == ["en", "de", "fr", "ru", "zh", "-", "-", "-"]
    mixed = language.sentences(pa.array(["The sum of these is one. " * 3 + "Die Summe ist eins. ", "Die Summe der Zahlen ist eins. " * 3 + "The sum is one. "]), tongue)
    share = mixed.other(np.array([0, 0]))
    assert share[0] < 0.5 < share[1]
    short = ["gegen den Uhrzeigersinn", "siempre positiva", "i due valori", "нет решений", "无解", "none of these", "increasing", "8、x，DNE", "converges absolutely", "no real roots"]
    assert (language.sentences(pa.array(short), tongue).other(np.zeros(10, int)) > 0).tolist() == [True] * 5 + [False] * 5
    again = language.Tongue().refine(pa.array(QUESTIONS + texts))
    assert [language.LANGS[k] if k >= 0 else "-" for k in language.sentences(pa.array(texts), again).main()][:5] == ["en", "de", "fr", "ru", "zh"]
    assert language.Tongue().refine(pa.array([], pa.string())).table.any()


# --- linear and boosting -----------------------------------------------------------------------


def test_linear_learns_and_calibrates():
    g = np.random.default_rng(1)
    n = 1200
    x = (g.random((n, 4)) < 0.5).astype(float)
    y = np.stack([x[:, 0] * x[:, 1] > 0, g.random(n) < 0.3], axis=1).astype(float)
    slot, row = np.where(y[:, 1] > 0, 77, 500), np.arange(n)
    m = linear.Linear(2, 4).fit(x, slot, row, y)
    assert min(m.held_out) > 0.98
    assert linear.best_cut(np.array([3.0, 2, 1]), np.array([1, 1, 0])) == 1.5 and linear.best_cut(np.array([1.0]), np.array([0])) == np.inf


def test_boosting():
    g = np.random.default_rng(2)
    x = g.random((2000, 5))
    y = np.sin(6 * x[:, 0]) + (x[:, 1] > 0.5)
    m = boosting.Boosted(trees=150).fit(x[:1500], y[:1500])
    assert np.mean((m.predict(x[1500:]) - y[1500:]) ** 2) < 0.02
    assert boosting.Boosted(trees=3).fit(np.zeros((3, 2)), np.ones(3)).predict(np.zeros((2, 2))).tolist() == [1, 1]
    assert len(m.predict(x[:0])) == 0


# --- defects and truncation --------------------------------------------------------------------


def answered(k, wrap=True):
    body = prose(rng.randint(2, 9))
    return (f"<think>\n{body}\n</think>\n\n" if wrap else body + "\n\n") + f"Final Answer: \\boxed{{{k}}}"


def tables(spark):
    resp, truth = [], {}
    for i in range(900):
        q = i % len(QUESTIONS)
        kind = ["ok"] * 6 + ["truncated", "refusal", "copy", "empty", "language"]
        k = kind[i % len(kind)]
        t = answered(rng.randint(1, 99), rng.random() < 0.7)
        if k == "truncated":
            t = t[: rng.randint(40, t.index("\\boxed{") + 6)]
        elif k == "refusal":
            t = rng.choice(["I'm sorry, but I can't help with this one. Please ask your teacher.", prose(2) + " However, I am not allowed to continue and will not give a result.", "I must decline to answer. It looks like homework."])
        elif k == "copy":
            t = rng.choice([str, str.upper, lambda s: "Question: " + s])(QUESTIONS[q])
        elif k == "empty":
            t = rng.choice([None, "", " \n", "N/A", "<think>\n\n</think>", "\\boxed{}"])
        elif k == "language":
            t = "<think>\n" + "Zuerst formen wir die Gleichung um. Danach teilen wir beide Seiten durch drei. " * 3 + "\n</think>\n\n\\boxed{4}"
        resp.append((i, q, f"run-{i % 3}", t))
        truth[i] = k
    resp.append((900, 5_000, " RUN-1 ", answered(3)))
    resp.append((901, None, None, None))
    sft = [(i, QUESTIONS[i % 40], answered(i), str(i), "x") for i in range(400)]
    sft += [(400, QUESTIONS[0], answered(1), None, "x"), (401, QUESTIONS[0], answered(1), "\\frac{3}{", "x"), (402, QUESTIONS[1], answered(1), QUESTIONS[1], "x"), (403, QUESTIONS[2], answered(1), "declined to answer", "x"), (404, QUESTIONS[2], answered(1), "keine Lösung", "x"), (405, None, None, "7", "x")]
    it = [(i, q, ["1"], i, None) for i, q in enumerate(QUESTIONS)]
    return (
        spark.createDataFrame(sft, "scan_idx bigint, question string, response string, answer string, defect string"),
        spark.createDataFrame(resp, "scan_idx bigint, id bigint, run_tag string, response string"),
        spark.createDataFrame(it, "id bigint, question string, answer array<string>, scan_idx bigint, updated_at timestamp"),
        truth,
    )


@pytest.fixture(scope="module")
def made(spark):
    return tables(spark)


def test_defects(spark, made):
    sft, resp, it, truth = made
    got = {(r.tab, r.scan_idx, r.fld): r.defect for r in pairs.defects(sft, resp, it).collect()}
    want = {k: v for k, v in truth.items() if v != "ok"}
    mine = {k[1]: v for k, v in got.items() if k[0] == "responses"}
    assert mine.pop(901) == "empty" and 900 not in mine
    right = sum(mine.get(k) == v for k, v in want.items())
    assert right / len(want) > 0.97 and right / len(mine) > 0.97
    answers = {k[1]: v for k, v in got.items() if k[2] == "answer"}
    assert answers == {400: "empty", 401: "truncated", 402: "copy", 403: "refusal", 404: "language"}
    assert {k[1]: v for k, v in got.items() if k[:3:2] == ("sft_corpus", "response")} == {405: "empty"}


def test_defects_of_empty_tables(spark, made):
    sft, resp, it, _ = made
    assert pairs.defects(sft.limit(0), resp.limit(0), it.limit(0)).count() == 0
    assert {r.defect for r in pairs.defects(sft.limit(0), resp.where("scan_idx = 901"), it).collect()} == {"empty"}


def test_truncation(spark, made):
    _, resp, it, truth = made
    j = truncation.judged(resp, it)
    cut = {r.scan_idx for r in j.where("cut").collect()}
    want = {k for k, v in truth.items() if v == "truncated"}
    assert len(cut & want) / len(want) > 0.97 and len(cut & want) / len(cut) > 0.97
    rate = {r.run_tag: r for r in truncation.rates(j).collect()}
    assert rate["run-1"].rows == 301 and rate[None].cut_rows == 0 and j.count() == 902
    assert truncation.judged(resp.limit(0), it).count() == 0


def test_limits(spark):
    rows = [(i, 1, "Cut ", "x" * 50 if i % 2 else "x" * (i % 49)) for i in range(200)] + [(300 + i, 1, "free", "y" * (i + 1)) for i in range(100)]
    df = spark.createDataFrame(rows, "scan_idx bigint, id bigint, run_tag string, response string")
    got = {r._tag: (r._chars, r._bytes) for r in pairs.run_limits(df).collect()}
    assert got == {"cut": (50, 50), "free": (None, None)}
    near = [r for r in rows if r[2] == "Cut " and len(r[3]) >= 47]  # a cut within a character leaves up to three bytes less
    assert pairs.with_limits(df).where("_limit").count() == len(near)


def test_shapes():
    f = lambda t, n=1: dict(zip(fieldshape.RESPONSE, fieldshape.response_shape(t, n)[0]))
    assert f("<think>\na\n</think>\n\n\\boxed{1}")["complete_box"] and f("ANSWER: 5\n")["complete_value"] and f("x \\boxed{1}, \\boxed{", 2)["open_box"]
    assert f("\\boxed{1}", 2)["deficit"] and f("text\n</think>")["close_then_nothing"] and f("Final Answer:")["nothing"] and f("so we\n\nFinal Answer:")["mark_no_value"]
    assert f("<think>" + "\\boxed{" * 3000)["open_box"] and not f("")["complete_box"]
    assert f("\\boxed{}" * 30)["nothing"] and f("<think>\n</think>" + " \n" * 200 + "Final Answer:")["nothing"] and not f("0")["nothing"]
    assert f("So the sum is 12.")["concludes"] and not f("So the sum telescopes nicely.")["concludes"] and f("ANSWER: 5\n" + "x y z " * 200)["complete_value"]


# --- levels ------------------------------------------------------------------------------------

WORDS = {"primary": "cat dog ball count apple hat small two box red", "middle": "ratio percent fraction decimal perimeter average discount kilogram metre probability", "secondary": "derivative logarithm quadratic sine vertex integral polynomial discriminant tangent binomial", "university": "sheaf functor cohomology ergodic manifold resolvent homomorphism topology semigroup kernel"}


def written(band):
    w = WORDS[band].split()
    return " ".join("The " + " ".join(rng.choice(w) for _ in range(6)) + " is " + rng.choice(w) + "." for _ in range(12))


def test_levels(spark):
    docs = [(i, written(list(WORDS)[i % 4]), "en", ["a", "b", None][i % 3], 500, "x") for i in range(600)]
    labels = [(i, i, "r", [list(WORDS)[i % 4], " " + list(WORDS)[i % 4].upper()][i % 2]) for i in range(0, 400)] + [(9000, 2, "r", None), (9001, 3, "r", "odd"), (9002, 77777, "r", "primary")]
    docs += [(700, None, "en", "a", 400, "x"), (701, "", "en", "a", 300, "x"), (702, written("primary"), "de", "a", 500, "x"), (703, written("primary"), "en", "a", 299, "x"), (704, written("university") * 400, "en", "a", 10**6, "x"), (705, written("primary"), None, None, None, "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, band string")
    l = spark.createDataFrame(labels, "label_id bigint, doc_id bigint, rater string, band string")
    got = {r.doc_id: r.band for r in reading_level.levels(d, l).collect()}
    assert set(got) == {*range(600), 700, 701, 704} and got[704] == "university"
    assert np.mean([got[i] == list(WORDS)[i % 4] for i in range(400, 600)]) > 0.97
    report = reading_level.fit(d, l).report
    assert report["n"].sum() == 400 and report["accuracy"].min() > 0.9
    assert set(r.band for r in reading_level.levels(d, l.limit(0)).collect()) == {"primary"}
    assert reading_level.levels(d.limit(0), l).count() == 0
    m = reading_level.Model(["one text"], np.array([1.0]), np.array(["a"], object))
    assert len(m.bands(pa.array(["x", ""]))) == 2 and isinstance(m.report, pd.DataFrame)
