"""The stemmer against the publication's examples and a procedural version; the stored index against scoring every text."""

import glob
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import stems
from quarry.functions.stems import STEP_2, STEP_3, STEP_4, porter
from quarry.operators import retrieve, textindex
from quarry.operators.textindex import TextIndex

pytestmark = pytest.mark.usefixtures("few_partitions")

#: Examples of the publication (after all steps).
EXAMPLES = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ",
    "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "x1_ing": "x1_ing", "is": "is",
}


def plain_stem(word):
    """The rules word by word, told by a string of v and c."""
    if not re.fullmatch("[a-z]{3,}", word):
        return word

    def kinds(w):
        out = ""
        for i, c in enumerate(w):
            out += "v" if c in "aeiou" or (c == "y" and i and out[i - 1] == "c") else "c"
        return out

    measure = lambda w: len(re.findall("v+c+", kinds(w)))
    vowel = lambda w: "v" in kinds(w)
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and kinds(w)[-2:] == "cc"
    cvc = lambda w: kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s):
                if vowel(w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif measure(w) == 1 and cvc(w):
                        w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        for s, r in sorted(rules, key=lambda x: -len(x[0])):
            if w.endswith(s):
                w = w[: -len(s)] + r if measure(w[: -len(s)]) else w
                break
    for s in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(s):
            head = w[: -len(s)]
            w = head if measure(head) > 1 and (s != "ion" or head.endswith(("s", "t"))) else w
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


def test_stems_of_examples_and_of_made_up_words(spark):
    rng = random.Random(1)
    ends = [s for s, _ in STEP_2 + STEP_3] + STEP_4 + ["s", "ed", "ing", "y", "e", "eed", "ies", "sses", "ll", ""]
    made = ["".join(rng.choice(["b", "st", "y", "a", "e", "ou", "l", "ll", "tt", "z", "w", "i"]) for _ in range(rng.randrange(1, 5))) + rng.choice(ends) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(6000)]
    ws = sorted({*EXAMPLES, *made, "über", "a", "yy", "yyy", "sayyed"})
    got = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in ws], "w string").select("w", porter(F.col("w")).alias("s")).collect()}
    assert {w: got[w] for w in EXAMPLES} == EXAMPLES
    assert {w: s for w, s in got.items() if s != plain_stem(w)} == {}


VOCAB = ["connect", "connected", "connecting", "connection", "relate", "relational", "ponies", "pony", "the", "sky", "x_1", "rare", "rarer", "walk", "walks", "walked"]


def texts(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(VOCAB, weights=range(len(VOCAB), 0, -1), k=rng.randrange(0, 60)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


QUESTIONS = [(0, "the connection of ponies"), (1, "rarer"), (2, "walking; relate! RELATES"), (3, "nothing here"), (4, ""), (5, "the the the"), (6, None)]


def scanned(spark, rows, k, by_length):
    """Every text scored."""
    q = spark.createDataFrame(QUESTIONS, "query_id int, query string")
    out = {}
    for qid, text in QUESTIONS:
        terms = {plain_stem(w) for w in list(dict.fromkeys(w for w in re.split("[^a-z0-9_]+", (text or "").lower()) if len(w) > 1))[:12]}
        points = {}
        for doc, t in rows:
            ws = [w for w in re.split("[^a-z0-9_]+", (t or "").lower()) if len(w) > 1]
            stems = [plain_stem(w) for w in ws]
            import math

            s = sum(int((1 + math.log(n)) / ((1 + math.log(len(ws))) if by_length else 1) * 1_000_000 + 0.5) for x in terms if (n := stems.count(x)))
            if s:
                points[doc] = s
        out |= {(qid, d): (s, i + 1) for i, (d, s) in enumerate(sorted(points.items(), key=lambda x: (-x[1], x[0]))[:k])}
    assert q.count() == len(QUESTIONS)
    return out


def found(index, spark, k, by_length=False):
    q = spark.createDataFrame(QUESTIONS, "query_id int, query string")
    return {(r["query_id"], r["doc_id"]): (round(r["score"] * 1_000_000), r["rank"]) for r in index.search(q, k, by_length=by_length).collect()}


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


@pytest.mark.parametrize("first_blocks", [2])
def test_index_follows_changes_and_answers_as_a_scan_does(spark, tmp_path, monkeypatch, first_blocks):
    monkeypatch.setattr(textindex, "FIRST_BLOCKS", first_blocks)
    rows = texts(1, 150)
    index = TextIndex(spark, f"file://{tmp_path}/ix", buckets=4, blocks=16)
    assert found(index, spark, 5) == {}
    assert index.refresh(frame(spark, rows)) == 150 and index.refresh(frame(spark, rows)) == 0
    for by_length in (False, True):
        assert found(index, spark, 5, by_length) == scanned(spark, rows, 5, by_length)
    before = files(tmp_path)
    rows = [(i, t) for i, t in rows if i % 9] + [(900, "rarer connection"), (901, None), (902, "")]
    rows = [(i, t + " pony pony" if i % 20 == 1 and t else t) for i, t in rows]
    written = index.refresh(frame(spark, rows))
    assert 0 < written < 15 + 3 and {f: m for f, m in files(tmp_path).items() if f in before} == before  # nothing old is written anew
    assert found(index, spark, 5) == scanned(spark, rows, 5, False)
    assert index.refresh(frame(spark, [(3, "rare rare rare")]), whole=False) == 1
    rows = [(i, "rare rare rare" if i == 3 else t) for i, t in rows]
    assert found(index, spark, 7, True) == scanned(spark, rows, 7, True)
    index.compact()
    assert len(index._commits()) == 1 and found(TextIndex(spark, f"file://{tmp_path}/ix"), spark, 7) == scanned(spark, rows, 7, False)
    assert sorted(r["doc"] for r in index.documents().collect()) == sorted(i for i, _ in rows)


def test_a_generation_that_was_broken_off_is_not_read(spark, tmp_path, monkeypatch):
    index = TextIndex(spark, f"file://{tmp_path}/ix", buckets=2, blocks=4)
    rows = texts(4, 30)
    index.refresh(frame(spark, rows))
    monkeypatch.setattr(index, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.refresh(frame(spark, [(1, "rarer")]), whole=False)
    index = TextIndex(spark, index.path)
    assert found(index, spark, 4) == scanned(spark, rows, 4, False)
    index.refresh(frame(spark, [(1, "rarer")]), whole=False)
    assert found(index, spark, 4) == scanned(spark, [(i, "rarer" if i == 1 else t) for i, t in rows], 4, False)


def test_only_the_folders_of_the_terms_are_read(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/ix", buckets=16, blocks=4)
    index.refresh(frame(spark, texts(2, 60)))
    asked = index._asked(spark.createDataFrame([(0, "pony")], "query_id int, query string"))
    plan = index._of_terms(index.postings(), asked)._jdf.queryExecution().executedPlan().toString()
    filters = next(x for x in re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan))
    assert "bucket" in filters and "gen" in filters and "EqualTo(term" in plan


def test_bounds_spare_blocks(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/ix", buckets=2, blocks=64)
    index.refresh(frame(spark, texts(3, 400)))
    left, every = index.blocks_left(spark.createDataFrame([(0, "rarer walked sky")], "query_id int, query string"), 3)
    assert left < every / 2


def test_the_light_scan_agrees_where_words_are_stemmed(spark, tmp_path):
    rows = texts(6, 80)
    index = TextIndex(spark, f"file://{tmp_path}/ix", buckets=2, blocks=8)
    index.refresh(frame(spark, rows))
    q = spark.createDataFrame([(0, "connection ponies")], "query_id int, query string")
    slow = retrieve.keyword(retrieve.inverted_index(frame(spark, rows), "doc_id", "text"), q, 10, "doc_id", stems=True)
    a = {r["doc_id"]: round(r["score"], 4) for r in slow.collect()}
    b = {r["doc_id"]: round(r["score"], 4) for r in index.search(q, 10).collect()}
    assert sorted(a.values()) == pytest.approx(sorted(b.values()), abs=2e-4)


def test_all_words_of_a_question_count(spark, tmp_path):
    rows = [(1, "w13 w14"), (2, "w1"), (3, "w15 w15 w15 ponies"), (4, "other")]
    index = TextIndex(spark, f"file://{tmp_path}/ix", buckets=2, blocks=4)
    index.refresh(frame(spark, rows))
    q = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(1, 16)) + " pony")], "query_id int, query string")
    assert [(r["doc_id"], r["rank"]) for r in index.search(q, 5).orderBy("rank").collect()] == [(3, 1), (1, 2), (2, 3)]


def test_stems_in_python_are_those_of_the_column(spark):
    rng = random.Random(2)
    ends = [s for s, _ in STEP_2 + STEP_3] + STEP_4 + ["s", "ed", "ing", "y", "e", "eed", "ies", "sses", "ll", ""]
    made = ["".join(rng.choice(["b", "st", "y", "a", "e", "ou", "l", "ll", "tt", "z", "w", "i", "Y", "7"]) for _ in range(rng.randrange(1, 5))) + rng.choice(ends) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(6000)]
    ws = sorted({*EXAMPLES, *made, "über", "a", "yy", "yyy", "sayyed", "ing", "ied", "eed", "abc\n", ""})
    got = spark.createDataFrame([(w,) for w in ws], "w string").select("w", porter(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in got if r["s"] != stems.stem(r["w"])} == {}


def test_texts_are_stemmed_where_they_are_read(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/ix", buckets=2, blocks=4)
    split = index._split(index._terms(spark.createDataFrame([(1, b"", "walk walks Walked x_1")], "doc long, digest binary, text string")))
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["term"], r["tf"], r["len"]) for r in split.collect()) == [("walk", 3, 4), ("x_1", 1, 4)]


@pytest.mark.parametrize("by_length", [False, True])
@pytest.mark.parametrize("cells", [1, 150, 2_000_000])
def test_long_questions_are_scored_together_as_a_scan_does(spark, tmp_path, monkeypatch, by_length, cells):
    rows = texts(8, 120) + [(500 + i, "rarer walked") for i in range(30)]  # and many equal scores
    index = TextIndex(spark, f"file://{tmp_path}/ix", buckets=4, blocks=8)
    index.refresh(frame(spark, rows))
    rows = [(i, "sky" if i == 3 else t) for i, t in rows]
    index.refresh(frame(spark, rows))
    q = spark.createDataFrame([("a", " ".join(VOCAB)), ("b", "rarer walked sky the pony x_1 relate"), ("c", " ".join(VOCAB[::2]) + " none here"), ("d", "")], "query_id string, query string")
    answer = lambda: sorted(map(tuple, index.search(q, 7, by_length=by_length).collect()))
    monkeypatch.setattr(textindex, "TOGETHER", 0)
    expected = answer()
    monkeypatch.setattr(textindex, "TOGETHER", 1000)
    monkeypatch.setattr(textindex, "LONG", 1)
    monkeypatch.setattr(textindex, "CELLS", cells)
    assert len(expected) == 21 and answer() == expected


@pytest.mark.parametrize("cells", [1, 60, 2_000_000])
def test_scores_are_added_up_across_batches(monkeypatch, cells):
    import numpy as np

    monkeypatch.setattr(textindex, "CELLS", cells)
    rng = np.random.default_rng(3)
    rows = [(f"d{d:04}", t, int(rng.integers(1, 6))) for d in range(300) for t in range(9) if rng.random() < 0.4]
    asked = [(t, q) for t in range(9) for q in range(5) if (t + q) % 3]
    starts, of = np.searchsorted([t for t, _ in asked], np.arange(10)), np.array([q for _, q in asked])
    batches = [tuple(np.array(c, object if i == 0 else np.int64) for i, c in enumerate(zip(*rows[a : a + 7], strict=True))) for a in range(0, len(rows), 7)]
    points = {}
    for d, t, w in rows:
        for q in (q for x, q in asked if x == t):
            points[q, d] = points.get((q, d), 0) + w
    want = [(q, d, p) for n in range(5) for p, d, q in sorted(((p, d, q) for (q, d), p in points.items() if q == n), key=lambda x: (-x[0], x[1]))[:4]]
    assert list(zip(*(x.tolist() for x in textindex.best_together(iter(batches), starts, of, 5, 4)), strict=True)) == want
