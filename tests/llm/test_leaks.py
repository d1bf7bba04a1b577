"""Leak search: forms of writing, shared and short questions, divided passages, WAND and shards against brute force."""

import random

import numpy as np
import pyarrow as pa

from tallgrass.llm import arrowtext as at
from tallgrass.llm import leaks

rng = random.Random(8)
STEM = "The {} of {} ships {} {} to {} before {} while {} repairs the {} beside {} and {} counts every {} again"


def word():
    return "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))


def question():
    return STEM.format(*(word() for _ in range(11))) + ". Round your answers to three decimal places if necessary."


QUESTIONS = [question() for _ in range(60)]
SHORT = "Which of the twelve lighthouses at Karnu stands furthest from the northern quay"
CHINESE = "甲乙两地相距四百五十公里一列火车从甲地开往乙地每小时行驶九十公里问几小时到达乙地"


def pairs_of(items, docs, answers=None):
    ix = leaks.Index([i for i, _ in items], [q for _, q in items], answers)
    w = leaks._words(leaks.level(pa.array(docs)))
    p = ix.verify(w, ix.retrieve(w))[0]
    return {(int(x // ix.items), int(ix.ids[x % ix.items])) for x in p}


def test_one_question_under_many_ids():
    items = [(i, QUESTIONS[0]) for i in range(6)] + list(enumerate(QUESTIONS[1:], 10))
    assert pairs_of(items, [QUESTIONS[0], "Round your answers to three decimal places if necessary. " * 4]) == {(0, i) for i in range(6)}


def test_short_questions_and_few_words():
    items = [(1, SHORT), (2, "Find x"), (3, ""), *enumerate(QUESTIONS, 10)]
    docs = ["So: " + SHORT + "?", "the twelve lighthouses at Karnu", "Find x now", SHORT.replace("Karnu", "Velmo").replace("quay", "gate").replace("twelve", "nine")]
    assert pairs_of(items, docs) == {(0, 1)}
    assert pairs_of([(1, SHORT)], docs[:2]) == {(0, 1)} and pairs_of([], docs) == set()


def test_marks_and_scripts():
    q = QUESTIONS[5]
    words = q.split(" ")
    docs = ["—".join(words), "“" + "” “".join(words) + "”", "前面的文字" + CHINESE + "后面还有", q.upper().replace(" ", "…"), " ".join(w[:1] + "\u0301" + w[1:] for w in words), "$\\text{" + q + "}$", "<p>" + "</p> <p>".join(words) + "</p>"]
    assert pairs_of([*enumerate(QUESTIONS), (99, CHINESE)], docs) == {(0, 5), (1, 5), (2, 99), (3, 5), (4, 5), (5, 5), (6, 5)}


def test_answers_decide_where_words_nearly_suffice():
    items, w = list(enumerate(QUESTIONS)), QUESTIONS[3].split(" ")
    need = leaks.Index([i for i, _ in items], [q for _, q in items]).need[3]
    part = " ".join(w[2 : 2 + int(np.ceil(need * leaks.NEARLY))])
    answers = [["419.25", "harbour"] if i == 3 else ["7"] for i, _ in items]
    docs = [part + ". Answers: harbour, 419.25", part + ". Answers: harbour", " ".join(w[2:6]) + " harbour, 419.25"]
    assert pairs_of(items, docs, answers) == {(0, 3)}


def test_wand_scores_what_brute_force_scores():
    ix = leaks.Index(list(range(60)), QUESTIONS)
    docs = []
    for _ in range(400):
        w = rng.choice(QUESTIONS).split(" ")
        a = rng.randint(0, len(w) - 8)
        docs.append(" ".join(word() for _ in range(rng.randint(0, 30))) + " " + " ".join(w[a : a + rng.randint(2, 22)]) + " " + rng.choice(QUESTIONS)[:60])
    w = leaks._words(leaks.level(pa.array(docs)))
    got, want = set(ix.retrieve(w).tolist()), set()
    dense = np.zeros((len(ix.slots.keys) + 1, ix.items))
    for t in range(len(ix.slots.keys)):
        dense[t, ix.item[ix.start[t] : ix.start[t + 1]]] = ix.impact[ix.start[t] : ix.start[t + 1]]
    term = ix.slots.find(w.hash)
    for r in range(w.rows):
        own = term[w.first[r] : w.first[r + 1]]
        for a in range(0, len(own), leaks.STRIDE):
            score = dense[np.unique(own[a : a + leaks.WINDOW])].sum(axis=0)
            want |= {r * ix.items + int(i) for i in np.flatnonzero(score >= 1 + 1e-4)}
            got -= {r * ix.items + int(i) for i in np.flatnonzero(abs(score - 1) < 1e-4)}
    assert want and got == want


def test_divided_passages_are_found():
    docs, own = [], []
    for i in range(600):
        k = rng.randrange(60)
        w, noise = QUESTIONS[k].split(" "), [word() for _ in range(60)]
        docs.append(" ".join(noise[:20] + w[1:11] + noise[20:40] + w[11:21] + noise[40:]))
        own.append((i, k))
    assert len(pairs_of(list(enumerate(QUESTIONS)), docs) & set(own)) / len(own) > 0.99


def test_slots():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    s = at.Slots(keys)
    assert s.find(keys).tolist() == list(range(len(keys))) and (s.find(keys + np.uint64(1)) >= 0).sum() == np.isin(keys + np.uint64(1), keys).sum()
    assert len(s.table) <= 4 * len(keys) and at.Slots(keys[:0]).find(keys[:3]).tolist() == [-1] * 3


def test_many_items_stay_small():
    texts = [f"{i} {word()} {word()} ships {i * 7} {word()} to {word()} before {word()} {i % 97} {word()}" for i in range(50_000)]
    ix = leaks.Index(list(range(len(texts))), texts)
    assert ix.item.nbytes + ix.impact.nbytes + ix.block_max.nbytes + ix.block_last.nbytes + ix.block_head.nbytes < 10 * len(ix.item) + 16 * len(ix.slots.keys)
    assert ix.slots.table.nbytes <= 16 * len(ix.slots.keys)
    w = leaks._words(leaks.level(pa.array([texts[41_234], "nothing"])))
    assert ix.verify(w, ix.retrieve(w))[0].tolist() == [41_234]


def test_shards_give_what_one_index_gives(spark, monkeypatch):
    rows = [(i, q, [str(i)]) for i, q in enumerate(QUESTIONS)] + [(70, QUESTIONS[4], None), (4, QUESTIONS[9], ["1"]), (80, None, None)]
    items = spark.createDataFrame(rows, "id bigint, question string, answer array<string>")
    docs = spark.createDataFrame([(i, " ".join(QUESTIONS[i % 60].split(" ")[i % 5 : 20 + i % 5])) for i in range(90)] + [(90, None), (91, "")], "doc_id bigint, text string")
    one = sorted(leaks.evidence(docs, items).collect())
    monkeypatch.setattr(leaks, "SHARD_BYTES", 3000)
    assert len(list(leaks.build_indexes(items))) > 2
    many = sorted(leaks.evidence(docs, items).collect())
    assert [r[:2] for r in one] == [r[:2] for r in many] and np.allclose([r.words for r in one], [r.words for r in many])
    assert (4, 4) in [r[:2] for r in one] and (4, 70) in [r[:2] for r in one] and (9, 4) in [r[:2] for r in one]
