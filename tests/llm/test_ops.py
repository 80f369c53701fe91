"""The corpus operators against plain versions, and on nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import pathlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, hmm, kneser, linedup, mixing, pii, pipeline, quality, queries, spm, tjoin, topk
from quarry.llm import words as w

from .. import oracle
from . import brute

SF = oracle.SF
RNG = random.Random(7)
VOCAB = [f"w{i}" for i in range(60)] + ["Über", "naïve", "😀"]


def text(n, rng=RNG):
    return "".join(rng.choice(VOCAB) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(n))


def variants(base, rng, edits):
    ws = base.split()
    for _ in range(edits):
        ws[rng.randrange(len(ws))] = rng.choice(VOCAB)
    return " ".join(ws)


def family_rows():
    """Exact and near copies, short, empty and null texts, repeated rows."""
    rng, rows = random.Random(11), []
    for b in range(4):
        base = " ".join(rng.choice(VOCAB) for _ in range(rng.choice([30, 60, 120])))
        rows += [variants(base, rng, rng.choice([0, 0, 1, 1, 2, 3, 6])) for _ in range(25)]
    rows += ["", None, " \n", "one", "One", "one two", "one two three", "a b c d", "a b c d e"]
    out = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    return out + [out[0], out[40]]


def clash(spark, rows, id_="doc_id"):
    """Documents with columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t) for i, t in rows], f"{id_} long, text string")
    names = ["n", "h", "sid", "row", "c", "k", "size", "target", "taken", "kept", "line", "occ", "pos", "rank", "score", "__id", "__n"]
    return df.select(id_, "text", F.lit("en").alias("lang"), (F.col(id_) % 3).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit(i).alias(n) for i, n in enumerate(names)])


def empty(spark):
    return clash(spark, []).limit(0)


# -- words -------------------------------------------------------------------------------------------------------------


def test_words_agree_with_the_pattern_in_pieces_of_any_size(monkeypatch):
    rng = random.Random(3)
    texts = [text(rng.randint(0, 60), rng) for _ in range(40)] + ["", None, "x" * 5000, " " * 3000 + "y", "é" * 700]
    want = [brute.words(t) for t in texts]
    for size in (7, 64, 1 << 20):
        monkeypatch.setattr(w, "PIECE_BYTES", size)
        data, offsets = w.buffers(pa.array(texts, pa.string()))
        starts, ends, hashes = w.words(data, offsets, lower=False)
        raw, first = data.tobytes(), w.word_offsets(starts, offsets)
        got = [[raw[a:b].decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
        assert got == want
        assert len(set(hashes.tolist())) == len({x for ws in want for x in ws})


def test_lower_case_is_ascii_only():
    h = lambda s: w.words(*w.buffers(pa.array([s])), lower=True)[2].tolist()
    assert h("ABC") == h("abc") and h("Ü") != h("ü")


# -- 1 -----------------------------------------------------------------------------------------------------------------


def test_quality_base_columns(spark):
    rows = [(i, t) for i, t in enumerate([text(80), "a b c a b c a b c", "x\nx\n\nx", "", None, "#$ %\n|<>", text(3000), "tie " * 60])]
    rows.append(rows[0])
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.assess(clash(spark, rows), labels).collect()
    key = lambda r: tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert sorted(map(key, got)) == sorted((i, *brute.base_quality(t)) for i, t in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.assess(empty(spark), none).count() == 0
    r = quality.assess(clash(spark, [(1, text(80))]), none).first()
    assert r["kept"] or r["base_failed"]


def test_quality_of_clashing_names_narrow_ids_and_long_texts(spark):
    rows = [(1, text(80)), (2, text(30_000)), (3, None), (4, ""), (1, text(80))]
    docs = clash(spark, rows).withColumn("doc_id", F.col("doc_id").cast("int")).withColumn("n_words", F.lit(1)).withColumn("anomaly", F.lit(0.5))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r["doc_id"] for r in quality.assess(docs, labels).collect()) == [1, 1, 2, 3, 4]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {1, 2}
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_cut_offs_weigh_good_against_bad():
    bins = [(10, 9000, 10), (20, 990, 20), (30, 10, 60), (40, 0, 10)]
    assert quality.cut_off(bins) == 30 / quality.BINS  # 10 of 10,000 good ones for 70 of 100 bad ones
    assert quality.cut_off([(10, 9990, 99), (30, 10, 1)]) == 2.0  # not worth it
    assert quality.cut_off([(10, 0, 5)]) == 2.0 and quality.cut_off([]) == 2.0
    assert quality.cut_off([(10, 9000, 0), (20, 990, 0), (30, 10, 0)]) == 21 / quality.BINS
    assert quality.cut_off([(10, 95, 5), (30, 2, 90)]) == 30 / quality.BINS  # two rows are more than the share, but few


def test_letters_are_counted_by_code_point():
    n = len(quality.STATS)
    stats = dict(zip(quality.STATS, quality._statistics(pa.array(["Привет мир", "abc 12", "“—”…", "你好 ñ"])), strict=True))
    assert stats["n_alpha"].tolist() == [9, 3, 0, 3] and stats["n_chars_seen"].tolist() == [10, 6, 4, 4] and len(stats) == n


def test_forest_isolates_what_is_odd():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(500, 3)), [[9.0, 9.0, 9.0]]])
    s = quality.grow(x).score(x)
    assert s[-1] == s.max() and s[-1] > np.quantile(s, 0.99)
    assert len(quality.grow(np.zeros((0, 3))).score(x)) == len(x)


def test_quality_rejects_labelled_junk_and_keeps_good(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.assess(docs, labels).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in out}
    assert kept[1] > 0.97 and kept[0] < 0.3
    assert quality.keep_good(docs, labels).count() == quality.assess(docs, labels).where("kept").count()


# -- 2 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_join_classes(spark, k, percent):
    rows = family_rows()
    got = sorted(map(tuple, tjoin.classes(clash(spark, rows), words=k, percent=percent).collect()))
    assert got == sorted(brute.components(rows, k, percent))


def test_join_with_small_lists_as_centres_too(spark, monkeypatch):
    monkeypatch.setattr(tjoin, "SMALL", 1)
    monkeypatch.setattr(tjoin, "PAIRS", 0)
    monkeypatch.setattr(tjoin, "MERGED", 1)  # and leftovers searched by the true lengths of their lists
    rows = family_rows()
    assert sorted(map(tuple, tjoin.classes(clash(spark, rows)).collect())) == sorted(brute.components(rows, 3, 90))


def test_lists_too_long_to_be_merged_get_centres_however_few_the_pairs_are(spark, monkeypatch):
    monkeypatch.setattr(tjoin, "MERGED", 8)
    monkeypatch.setattr(tjoin, "PAIRS", 1000)
    calls, plain = [], tjoin._links_by_difference
    monkeypatch.setattr(tjoin, "_links_by_difference", lambda *a: calls.append(1) or plain(*a))
    rows = family_rows()
    assert sorted(map(tuple, tjoin.classes(clash(spark, rows)).collect())) == sorted(brute.components(rows, 3, 90))
    assert calls


def test_members_of_a_list_become_pairs_only_where_they_may_link(spark):
    rng, rule = random.Random(5), tjoin.Rule()
    common = [f"p{i}" for i in range(12)]
    texts = [" ".join(common + [f"w{rng.random()}" for _ in range(rng.choice([60, 100, 200]))]) for _ in range(120)]
    texts += [f"{t} end" for t in texts[:5]]
    sets = [s for s in tjoin._sets(pa.array(texts), 3)]
    sizes = spark.createDataFrame([(i, len(s), bytearray(tjoin._parities(s))) for i, s in enumerate(sets)], "sid long, n long, hist binary")
    lists = spark.createDataFrame([(int(h), i, len(s)) for i, s in enumerate(sets) for h in s.view(np.int64)], "h long, sid long, n long")
    met = tjoin._meetings(lists, sizes, rule)
    want = {(i, 120 + i) for i in range(5)}
    got = {(r["sid"], r["other"]) for r in met.collect()}
    assert want <= got and len(got) < 50  # of 7,750 pairs that share the lists of the passage
    assert want <= {(r["c"], r["sid"]) for r in tjoin._occurrences(lists, sizes, rule).collect()}


def test_join_of_nothing(spark):
    assert tjoin.classes(empty(spark)).count() == 0
    assert tjoin.keep_one(empty(spark)).count() == 0


def test_join_keeps_one_of_each_class(spark):
    rows = family_rows()
    docs = clash(spark, rows)
    out = tjoin.keep_one(docs)
    assert out.columns == docs.columns
    comp = {(d, t): c for (d, t), (_, _, c) in zip(rows, brute.components(rows, 5, 80), strict=True)}
    want = sorted({d for (d, t), c in comp.items() if not brute.words(t) or c == d})
    assert sorted(r["doc_id"] for r in out.collect()) == want


# -- 3 -----------------------------------------------------------------------------------------------------------------


def test_forward_and_expectations_are_exact():
    rng, c = np.random.default_rng(0), 20
    k = hmm.STATES
    p = hmm.Parameters(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T)
    seqs = [rng.integers(0, c, n) for n in (1, 2, hmm.CHUNK - 1, hmm.CHUNK, hmm.CHUNK + 1, 500, 1)]
    log, start, moves, emits = hmm.forward(seqs, p, True)
    s0, m0, e0 = np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
    for s, got in zip(seqs, log, strict=True):
        a, total = [p.start], 0.0
        for x in s:
            y = (a[-1] @ p.move) * p.emit[x]
            total += math.log(y.sum())
            a.append(y / y.sum())
        assert got == pytest.approx(total)
        b = np.ones(k)
        for t in range(len(s) - 1, -1, -1):
            xi = a[t][:, None] * p.move * (p.emit[s[t]] * b)[None, :]
            xi /= xi.sum()
            m0 += xi
            e0[s[t]] += xi.sum(0)
            b = p.move @ (p.emit[s[t]] * b)
            b /= b.sum()
        s0 += p.start * b / (p.start * b).sum()
    assert np.allclose(start, s0) and np.allclose(moves, m0) and np.allclose(emits, e0)


def test_lm_base_scores_and_gain(spark, monkeypatch):
    monkeypatch.setattr(hmm, "DICTIONARY", 40)  # so that counts come by the join too
    monkeypatch.setattr(hmm, "HEAD", 16)
    rows = [*family_rows(), (5000, text(4000))]
    got = sorted(map(tuple, hmm.score(clash(spark, rows)).collect()))
    want = sorted(brute.base_lm(rows))
    assert [g[:5] for g in got] == [x[:5] for x in want]
    assert [g[5] for g in got] == pytest.approx([x[5] for x in want])
    assert all(g[6] < 0 for g in got)


def test_lm_predicts_held_out_text_better_than_counts(spark):
    out = hmm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.95 * out[1]


def test_lm_of_nothing(spark):
    assert hmm.score(empty(spark)).count() == 0


# -- 4 -----------------------------------------------------------------------------------------------------------------


def test_mixing_targets_and_taken(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "é", "z", None, "hot", "hot", "hot"]), " ".join(["x"] * rng.randint(0, 400)) if rng.random() > 0.05 else None) for i in range(400)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, source string, text string").withColumn("size", F.lit(-1)).withColumn("target", F.lit(-1))
    got = mixing.mix(df, block=16).collect()
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = brute.targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 32
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(5), block=16).collect()))


@pytest.mark.parametrize("votes, seats", [([3.0, 1.0, 1.0], 7), ([0.0, 5.0, 5.0], 4), ([10.0] * 7, 3), ([1e6, 1.0, 2.0, 0.5], 500), ([1.0], 9)])
def test_apportionment(spark, votes, seats):
    df = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, i int, v double, m long")
    assert [r["quota"] for r in mixing.apportion(df, ["g"], "i", "v", "m").orderBy("i").collect()] == brute.sainte_lague(votes, seats)


def test_mixing_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert [r["taken"] for r in mixing.mix(clash(spark, [(1, ""), (2, None)])).collect()] == [0, 0]


def test_take_repeats_rows(spark):
    docs = clash(spark, [(i, text(50)) for i in range(30)])
    out = mixing.take(docs)
    assert out.columns == docs.columns
    n = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in mixing.mix(docs).collect():
        assert n.get(r["doc_id"], 0) == math.floor(r["taken"] / r["size"] + 0.5)


def test_take_whole_meets_the_targets_with_long_documents(spark):
    rng = random.Random(17)
    rows = [(i, rng.choice(["a", "b", "c", "c", "c"]), " ".join(["x"] * rng.choice([0, 20, 300, 900, 3000]))) for i in range(600)]
    df = spark.createDataFrame([*rows, rows[1], (-1, None, None)], "doc_id long, source string, text string").withColumn("taken", F.lit(-1))
    out = mixing.take_whole(df)
    assert out.columns == df.columns
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    targets = {r["source"]: r["target"] for r in mixing.mix(df).collect() if r["target"]}
    for source, target in targets.items():
        assert abs(got[source] - target) <= 3000 / 2 + mixing.BLOCK
    assert max(r["count"] for r in out.groupBy("doc_id", "source").count().where(f"doc_id <> {rows[1][0]}").collect()) <= mixing.CAP
    assert sorted(map(repr, out.collect())) == sorted(map(repr, mixing.take_whole(df.repartition(5)).collect()))
    assert mixing.take_whole(df.limit(0)).count() == 0


# -- 5 -----------------------------------------------------------------------------------------------------------------


def test_sentencepiece_parity_and_round_trip(spark):
    import sentencepiece

    model = spm.read_model()
    texts = [*spm.PARITY, text(300), "a" * 3000, "\r\n\t x", "  ", None]
    spm.verify_parity(model, [t for t in texts if t is not None])
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = {r["doc_id"]: r for r in spm.encode(clash(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert got[i]["ids"] == ids and got[i]["n_ids"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
        assert got[i]["round_trip"] or "▁" in (t or "")
    assert spm.encode(empty(spark), model).count() == 0


def test_sentencepiece_keeps_columns_of_its_own_names(spark):
    docs = clash(spark, [(1, "a b"), (2, None)]).withColumn("ids", F.lit(7)).withColumn("round_trip", F.lit("x"))
    out = spm.encode(docs, spm.read_model(), keep=True)
    assert out.columns == [*docs.columns, "ids_", "round_trip_"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["ids"] == 7 and len(got[1]["ids_"]) > 0 and got[2]["round_trip_"] and got[2]["ids_"] == []


def _message(*parts):
    out = b""
    for number, value in parts:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2, len(value)]) + value
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
        else:
            out += bytes([number << 3, value])
    return out


def test_unigram_models_are_rebuilt_too():
    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("▁", -2.0, 1), ("a", -2.5, 1), ("b", -2.0, 1), ("ab", -1.5, 1)]
    data = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += _message((2, _message((3, 1)))) + _message((3, _message((3, 1), (4, 1), (5, 1))))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    for t in ("ab a", "b  ab", "aab"):
        assert spm.Encoder(data).encode([t])[0].tolist() == sp.encode(t)


# -- 6 -----------------------------------------------------------------------------------------------------------------


def test_pii_base_spans():
    rng = random.Random(5)
    for _ in range(20_000):
        a = rng.choice(["ab.@@-1 ", "0123456789 -.+()", "+1 ()-a", "4111 -", "1.2.", "a@b.c-_%"])
        t = "".join(rng.choice(a) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute.pii(t)
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + "." * 1000) == []


def test_pii_terms_that_disclose(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, f"{text(20, rng)} hotline +1 555 123 45{i % 90 + 10} {text(20, rng)}") for i in range(20)]
    rows += [(100 + i, text(40, rng)) for i in range(200)] + [(900, "call the hotline now"), (901, ""), (902, None)]
    got = {r["doc_id"]: r for r in pii.report(clash(spark, rows)).collect()}
    assert got[0]["n_phone"] == 1 and got[901]["spans"] == got[902]["spans"] == "" and got[901]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert "term_phone:9:16" in got[900]["spans"]
    assert not any("term_" in got[100 + i]["spans"] for i in range(200))
    for i, t in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and got[i]["spans"].startswith(base)


def test_sanitised_text():
    assert pii.sanitise_text("call hotline +1 555 123 4567 or hotline", [("phone", 13, 28), ("term_phone", 5, 12), ("term_phone", 32, 39)]) == "call <phone> [phone] or <phone>"


def test_pii_texts_come_out_sanitised_and_rare_terms_count(spark):
    rng = random.Random(4)
    rows = [(i, f"{text(20, rng)}pager{i % 4} +1 555 123 45{i + 10} {text(20, rng)}") for i in range(12)]  # each of four terms in 3 texts
    rows += [(100 + i, text(200, rng)) for i in range(400)] + [(800, "once +1 555 123 4599"), (900, "mail a@b.org now"), (901, ""), (902, None)]
    got = {r["doc_id"]: r for r in pii.report(clash(spark, rows)).collect()}
    for i, t in rows[:12]:
        assert "term_phone:" in got[i]["spans"] and got[i]["sanitised"] == t.replace(f"pager{i % 4}", "<phone>").replace(f"+1 555 123 45{i + 10}", "[phone]")
    assert got[800]["sanitised"] == "once [phone]" and got[900]["sanitised"] == "mail [email] now"
    assert got[901]["sanitised"] == "" and got[902]["sanitised"] is None
    assert all(got[i]["sanitised"] == t for i, t in rows[12:412])
    assert pii.sanitise_text("abcdefgh", [("phone", 0, 4), ("card", 2, 6)]) == "[phone]gh"


def test_pii_of_nothing(spark):
    assert pii.report(empty(spark)).count() == 0


# -- 7 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_bit_parallel_edits(spark, tau):
    rng, pairs = random.Random(3), []
    for _ in range(1500):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            if rng.random() < 0.4 or i == len(b):
                b.insert(i, rng.choice("abé😀"))
            elif rng.random() < 0.5:
                del b[i]
            else:
                b[i] = rng.choice("abé😀")
        if abs(len(a) - len(b)) <= tau:
            pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "x string, y string").withColumn("r", linedup.within_edits("x", "y", tau)).collect()
    assert [r["r"] for r in got] == [brute.edits(r["x"], r["y"]) <= tau for r in got]


def line_rows():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(20, 40))) for _ in range(30)]
    rows = []
    for d in range(90):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                i = rng.randrange(len(line))
                if rng.random() < 0.33:
                    line.insert(i, rng.choice("abc"))
                elif rng.random() < 0.5:
                    line[i] = "z"
                else:
                    del line[i]
            lines.append("".join(line))
            if rng.random() < 0.1:
                lines.append(rng.choice(["", " \t"]))
        rows.append((d * 7 - 50, "\n".join(lines) if rng.random() > 0.03 else None))
    return [*rows, (10_000, "q" * 50_000 + "\n" + "q" * 49_999)]


def test_line_dedup(spark):
    rows = line_rows()
    docs = clash(spark, rows)
    out = linedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "__n_lines", "__n_kept"]
    want = brute.dedup_lines(rows)
    for r in out.collect():
        assert r["text"] == want[r["doc_id"]]
        assert r["text"] is None or r["n_chars"] == len(r["text"])


def test_short_lines_within_one_edit(spark):
    rows = [(1, "short line ab\nabcdefgh\ntiny"), (2, "short line xb\nabcdefghi\ntinx"), (3, "short line xyz\nabcdefgh"), (4, "a line of twenty-three!!\na line of twenty-three"), (5, "a line of twenty-thre")]
    got = {r["doc_id"]: r["text"] for r in linedup.dedup_lines(clash(spark, rows)).collect()}
    assert got == brute.dedup_lines(rows)
    assert got[2] == "tinx" and got[3] == "short line xyz"


def test_line_dedup_of_wide_ids(spark):
    rows = [(1 << 40, "one line that is long enough to be compared"), (-(1 << 50), "one line that is long enough to be compered"), (3, "one line that is long enough to be compared")]
    got = {r["doc_id"]: r["text"] for r in linedup.dedup_lines(clash(spark, rows)).collect()}
    assert got == brute.dedup_lines(rows)


def test_line_dedup_of_repeated_rows_and_nothing(spark):
    rows = [(1, "same line here\nother"), (1, "same line here\nother"), (2, "other")]
    assert sorted(r["text"] for r in linedup.dedup_lines(clash(spark, rows)).collect()) == ["", "same line here\nother", "same line here\nother"]
    assert linedup.dedup_lines(empty(spark)).count() == 0


# -- 8 -----------------------------------------------------------------------------------------------------------------


def test_chat_template_is_reversible():
    odd = ["", "".join(chat.CONTROLS), chat.ESCAPE + "3;", "<|es<|esc|>c|>", "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant<|text|>x"]
    turns = [(r, t) for r in ("user", "assistant", "<|turn|>") for t in odd]
    assert chat.parse(chat.render(turns)) == turns
    out, mask, rewrites = chat.loss_mask(turns)
    assert not rewrites and [chat.unescape(out[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant" and t]


def test_chat_detects_rewritten_history():
    last_only = lambda turns: "".join(f"[{r}]{t}" for r, t in turns[-1:])
    assert chat.loss_mask([("user", "a"), ("assistant", "b")], last_only) == ("[assistant]b", [], True)
    plain = lambda turns: "".join(f"{r}: {t}\n" for r, t in turns)
    out, mask, rewrites = chat.loss_mask([("user", "a"), ("assistant", "b: \n")], plain)
    assert not rewrites and [out[a:b] for a, b in mask] == ["b: \n"]


def test_chat_of_templates_that_change_texts():
    strips = lambda turns: "".join(f"[{r}] {t.strip()}\n" for r, t in turns)
    out, mask, changed = chat.loss_mask([("user", " a "), ("assistant", " b \n")], strips)
    assert not changed and [out[a:b].strip() for a, b in mask] == ["b"]
    upper = lambda turns: "".join(f"[{r}] {t.upper()}\n" for r, t in turns)
    assert chat.loss_mask([("assistant", "abc")], upper) == ("[assistant] ABC\n", [], True)
    long = [("user" if k % 2 else "assistant", f"turn {k} " * 20) for k in range(400)]
    out, mask, changed = chat.loss_mask(long)
    assert not changed and "".join(chat.unescape(out[a:b]) for a, b in mask) == "".join(t for r, t in long if r == "assistant")


def test_chat_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([(1, 2, "user", "x"), (1, 1, None, None), (1, 2, "assistant", "y"), (1, None, "system", "s"), (None, 1, "assistant", "z")], "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    said = "system\ns\n\n\nassistant\ny\nuser\nx\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["loss_chars"] == 1 and got[None]["n_turns"] == 1
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


# -- 9 -----------------------------------------------------------------------------------------------------------------


def test_top_k_with_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (rng.integers(-2, 3, 8) / 4)]) for i in range(300)]
    rows += [(i, [0.25] * 8) for i in range(300, 340)] + [(1000, None), (1001, [None, 1.0]), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, [1.0] * 8), (1005, [1.0, 0.5]), rows[7]]
    every = [*rows, rows[50], (100, [0.5] * 8)]  # a query that comes twice, and two of one id
    df = spark.createDataFrame(every, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("x", F.lit(1))
    got = sorted(map(tuple, topk.top_k(df).collect()))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in [*rows, rows[50], (100, [0.5] * 8)] if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for at, (q, v) in [(at, g) for at, g in enumerate(good) if g[0] % 50 == 0]:
        best = sorted((-sum(a * b for a, b in zip(v, u, strict=False)), i) for other, (i, u) in enumerate(good) if other != at)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    assert [r[2] for r in sorted(map(tuple, topk.top_k(df.where("vec_id in (150, 151)")).collect()))] == [151]


def test_top_k_over_several_blocks(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = sorted(map(tuple, topk.top_k(df).collect()))
    monkeypatch.setattr(topk, "ROWS", 60)
    monkeypatch.setattr(topk, "QUERIES", 3)
    assert sorted(map(tuple, topk.top_k(df).collect())) == whole


# -- 10 ----------------------------------------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one(spark):
    model = kneser.train(spark.createDataFrame([(1, "a b a b c"), (2, "b c a a"), (3, "c c b a d")], "doc_id long, text string"))
    _, _, h = w.words(*w.buffers(pa.array(["a b c d"])), lower=True)
    vocab = np.append(h, [w.U64(kneser.END), w.U64(99)])
    for u, v in ((kneser.START, kneser.START), (h[0], h[1]), (h[3], h[2]), (kneser.START, h[1]), (5, 6)):
        n = len(vocab)
        p = 10 ** model.log10(np.full(n, u, w.U64), np.full(n, v, w.U64), vocab)
        assert p.sum() == pytest.approx(1.0, abs=1e-6)


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = kneser.classify(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in out}
    assert kept[1] > 0.95 and kept[0] < 0.5


def test_perplexities_are_those_of_all_trusted_texts(spark, few_partitions):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    # more words than the sample had room for: the first of them in any order took it all
    rows += [(1000 + i, f"z{i} " * 700_000 + "a b c") for i in range(8)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows if i >= 1000 or i % 2], "doc_id long, quality int, toxic int")
    held = {r["doc_id"] for r in labels.where(F.pmod(F.xxhash64(F.lit(kneser.SEED + 1), "doc_id"), F.lit(kneser.HELD_OUT)) == 0).collect()}
    chosen = {r["doc_id"] for r in labels.collect()} - held
    assert sum(i >= 1000 for i in chosen) > 2  # at 700,000 words
    model = kneser.train(docs.where(F.col("doc_id").isin([*chosen])))
    got = {r["doc_id"]: r for r in kneser.classify(docs, labels).collect()}
    assert got.keys() == {i for i, _ in rows}
    for i, t in rows:
        u, v, x, _ = kneser._ngrams(pa.array([t]))
        assert got[i]["n_tokens"] == len(x)
        assert got[i]["logprob"] == pytest.approx(model.log10(u, v, x).sum(), rel=1e-6, abs=1e-7 * len(x))  # the model holds 32-bit floats


def test_classifier_without_labels_nulls_and_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = kneser.classify(clash(spark, [(1, text(30)), (2, None), (3, ""), (3, "")]), none).collect()
    assert len(got) == 4 and all(r["kept"] for r in got) and {r["n_tokens"] for r in got if r["doc_id"] != 1} == {1}
    assert kneser.classify(empty(spark), none).count() == 0


# -- queries and pipeline ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    oracle.same(spark, oracle.connect(), queries.QUERIES[name], queries.ORACLES[name])


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert after.columns[: len(columns)] == columns
        seen[name] = (docs, after)
        docs = after
    before, after = seen["n-gram Jaccard join"]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    want = sorted(d for (d, t), (_, _, c) in zip(rows, brute.components(rows, 5, 80), strict=True) if c == d)
    assert sorted(r["doc_id"] for r in after.collect()) == want
    before, after = seen["line dedup"]
    want = {d: t for d, t in brute.dedup_lines([tuple(r) for r in before.select("doc_id", "text").collect()]).items() if brute.words(t)}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert docs.where("not round_trip").count() == 0 and docs.count() > 0


def test_a_stage_lets_go_of_the_shuffles_before_it(spark, monkeypatch):
    dirs = [pathlib.Path(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {p for d in dirs for p in d.glob("*/shuffle_*")}
    before = files()
    spark.range(5000).repartition(7).groupBy(F.col("id") % 5).count().write.format("noop").mode("overwrite").save()
    left = files() - before
    spark.sparkContext.parallelize(range(64), 64).count()  # threads hold on to the tasks they ran last

    def waits(docs):
        end = time.monotonic() + 20
        while files() & left and time.monotonic() < end:
            time.sleep(0.1)
        return docs

    assert left
    monkeypatch.setattr(tjoin, "keep_one", waits)
    pipeline.ngram_jaccard_join(spark, spark.range(1), SF)
    assert not files() & left


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).count() > 0


def test_spans_of_terms_come_by_kind_as_listed_then_by_place():
    spans = [("term_ip", 0, 6), ("term_email", 32, 38), ("term_phone", 1, 2), ("term_ip", 0, 3), ("term_email", 4, 5)]
    assert sorted(spans, key=pii._listed) == [("term_email", 4, 5), ("term_email", 32, 38), ("term_ip", 0, 3), ("term_ip", 0, 6), ("term_phone", 1, 2)]
