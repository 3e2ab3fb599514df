"""Hard negatives, tokenizer alignment and repeated lines: plain Python, odd rows and inner rules."""

from __future__ import annotations

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import alignment as A
from rasterloom.llm import hard_negatives as H
from rasterloom.llm import line_dedup as L
from rasterloom.llm.queries import QUERIES


def plain_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain_lines(texts, documents):
    split = [(t or "").split("\n") for t in texts]
    held = Counter(k for lines in split for k in {plain_key(line) for line in lines} if k)
    out = []
    for lines in split:
        kept = [line for line in lines if held[plain_key(line)] < documents]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


ODD_LINES = [
    "a\nB \nc", "A\n\tb\nd", " a\nb", "a", None, "", "\n\n", "a\r\nb\x0b", "É\né", "É", " x \nx", "x", "a\n" * 3000, "a\n" * 3000,
]


@pytest.mark.parametrize("documents", [2, 4])
def test_lines_equal_plain_python(spark, documents):
    rows = [(i if i % 5 else None, t, "k", "gone") for i, t in enumerate(ODD_LINES)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, k string, gone string")
    for batches in (1, 5):
        runs = L.LineRuns(spark, documents, fanout=2)
        found = L.drop_repeated_lines(docs, runs, batches=batches).collect()
        assert sorted((r["n_lines"], r["n_dropped"], r["kept"]) for r in found) == sorted(plain_lines(ODD_LINES, documents))
        assert all(len(level) < 2 for level in runs.levels)
    assert L.drop_repeated_lines(docs.limit(0)).count() == 0


def test_runs_settle_and_merge(spark):
    """Settled hashes aren't counted on, levels merge, and no anti-join or merging moves a run."""
    runs = L.LineRuns(spark, documents=3, buckets=4, fanout=3)
    batch = spark.createDataFrame([(["a", "b"],), (["a", None, "a"],), (["a", "c"],)], "hashes array<string>")
    runs.add(batch)
    assert {r["hash"]: r["n"] for r in runs.runs()[0].collect()} == {"a": 3, "b": 1, "c": 1}
    runs.add(batch)
    assert {r["hash"]: r["n"] for r in runs.runs()[1].collect()} == {"b": 1, "c": 1}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = runs.repeated()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.add(batch)
    assert [len(level) for level in runs.levels] == [0, 1]
    assert {r["hash"]: r["n"] for r in runs.runs()[0].collect()} == {"a": 3, "b": 3, "c": 3}
    assert {r["hash"] for r in runs.repeated().collect()} == {"a", "b", "c"}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_lines_of_earlier_documents_count(spark):
    old = spark.createDataFrame([(i, "same line\nown %d" % i) for i in range(6)], "doc_id bigint, text string")
    new = spark.createDataFrame([(i, "SAME LINE\nother %d" % i) for i in range(6, 10)], "doc_id bigint, text string")
    runs = L.LineRuns(spark)
    assert {r["n_dropped"] for r in L.drop_repeated_lines(old, runs).collect()} == {0}
    assert {(r["n_dropped"], r["kept"].split()[0]) for r in L.drop_repeated_lines(new, runs).collect()} == {(1, "other")}


def plain_negatives(rows, anchors, positives=5, negatives=10, shares=(30, 90)):
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=False))
    out = set()
    for a, label, v in rows:
        if a not in anchors:
            continue
        scored = sorted((-dot(v, w), i, lab) for i, lab, w in rows if i != a)
        for p in [(s, i) for s, i, lab in scored if lab == label][:positives]:
            hard = [(-s, i) for s, i, lab in scored if lab != label and shares[0] * -p[0] <= 100 * -s <= shares[1] * -p[0]][:negatives]
            out |= {(a, p[1], r + 1, i, -p[0], s) for r, (s, i) in enumerate(hard)}
    return out


def mined(df, anchors, **more):
    found = H.mine(df, F.col("vec_id").isin(anchors), **more).collect()
    return {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found}


@pytest.mark.parametrize(("size", "scale"), [(1, 3), (7, 5), (40, 200), (70, 1 << 25)])
def test_negatives_equal_plain_python(spark, size, scale):
    """Ties, a hot label, tiny tiles and scores beyond doubles."""
    rng = np.random.default_rng(size)
    centre = rng.integers(-scale, scale, size)
    rows = [(i, int(rng.choice([0, 0, 0, 1, 2])), (centre + rng.integers(-scale, scale, size)).astype(float).tolist()) for i in range(150)]
    rows += [(1000 + i, 1 - i % 2, rows[i][2]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, v array<double>")
    anchors = [0, 3, 50, 1003]
    assert mined(df, anchors, tile=(2, 60)) == plain_negatives(rows, anchors)
    assert mined(df, anchors, shares=(-200, 95)) == plain_negatives(rows, anchors, shares=(-200, 95))


def test_summaries_bound_the_score():
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(0, 60, (40, 65)))
    exact = v @ v.T
    closer = None
    for mean, deviation in H.summaries(v, H.levels_of(65)):
        reach = deviation @ deviation.T
        assert (np.abs(exact - mean @ mean.T) <= reach + 1e-6).all()
        assert closer is None or reach.sum() < closer
        closer = reach.sum()


def test_negatives_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    sound = [(100, 1, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (2, 2, [2.0, 1.0]), (3, 2, [4.0]), (3, 2, [4.0]), (4, 2, [])]
    odd = [(None, 1, [1.0, 1.0]), (5, None, [1.0, 1.0]), (6, 2, None), (7, 2, [None, 9.0]), (8, 2, [inf, 1.0]), (9, 2, [nan, 1.0])]
    df = spark.createDataFrame(sound + odd, "vec_id bigint, label int, v array<double>").selectExpr("*", "1 as rank", "'x' as s")
    wanted = {(100, 1, 1, 2, 11, 4), (100, 1, 2, 3, 11, 4), (100, 1, 3, 3, 11, 4)}
    assert mined(df, [100]) == wanted
    assert mined(df.limit(0), [100]) == set() and mined(df, [77]) == set()
    assert mined(df.where("vec_id = 4 or vec_id is null"), [4]) == set()


def plain_alignment(texts):
    """Both public libraries on whole texts, and every pair of overlapping tokens by their byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A.MODEL_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=A.MODEL_B)
    names = {i: t for t, i in json.loads(a.to_str())["model"]["vocab"].items()}
    letters = A.byte_letters()
    found = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in names[i]) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for p, i in zip(pieces, ids_b, strict=True)]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            found.append(([], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        groups, i, j = [], 0, 0
        for end in sorted({*ends_a.tolist()} & {*ends_b.tolist()}):
            p, q = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            groups.append(f"{','.join(map(str, ids_a[i:p]))}|{','.join(map(str, ids_b[j:q]))}")
            i, j = p, q
        starts_a, starts_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
        links = []
        for k, x in enumerate(ids_a):
            lo, hi = np.searchsorted(ends_b, starts_a[k], side="right"), np.searchsorted(starts_b, ends_a[k], side="left")
            links += [(x, ids_b[m]) for m in range(lo, hi)]
        found.append((ids_a, ids_b, groups, links))
    held = Counter(pair for *_, links in found for pair in set(links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [
        (len(ids_a), len(ids_b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), ";".join(groups))
        for ids_a, ids_b, groups, links in found]


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
ODD_TEXTS = [
    None, "", " ", "  ", "   a  b   ", "a", "\n\n  a\n b \n", "\ta\t\tb\x1c \x1cc\x85 d\xa0 e\u2003 f", "<|endoftext|> <s></s><unk> <0x41>", "a\u2581b",
    "\u2581", "naïve café – 東京タワー ∑∂ 🦊🦊", "it's we'll I'M 123456 7,8.9 !!! ...", "\x00 \x00a", "same same same same", "aaaaaaaaaaaaaaaaaaaa" * 40,
    "same same", "x" * 3000 + " y", "e\u0301 \u0301 e", "word " * 5000,
]


def test_alignment_equals_plain_python(spark):
    rows = [(i if i % 4 else None, t, "k", [1]) for i, t in enumerate(ODD_TEXTS)] + [(1, "same same", "k", [2])] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, pairs array<int>")
    found = A.align(docs)
    got = sorted(tuple(r[c] for c in [*NUMBERS, "groups"]) for r in found.rows.collect())
    assert got == sorted(plain_alignment([r[1] for r in rows]))
    empty = A.align(docs.limit(0))
    assert empty.rows.count() == 0 and empty.pairs.count() == 0


def test_alignment_query(spark, sf_dir, texts):
    found = {r["doc_id"]: r for r in QUERIES["op12_token_alignment"](spark, sf_dir).collect()}
    assert set(found) == set(texts)
    for (doc_id, _), wanted in zip(texts.items(), plain_alignment(list(texts.values())), strict=True):
        own = found[doc_id]
        assert tuple(own[c] for c in NUMBERS) == wanted[:6]
        assert own["groups_sha256"] == (hashlib.sha256(wanted[6].encode()).hexdigest() if wanted[6] else "")


def test_irregular_groups_alone_enter_the_pairs(spark):
    """A pair of tokens with the same bytes is counted in the vector, also where it overlaps in an irregular group."""
    models = A.read_models()
    aligner = A.Aligner(models)
    docs = spark.createDataFrame([(1, "the cat naïvety"), (2, "the the dog")], "doc_id bigint, text string")
    found = A.align(docs, models)
    the = models.ranks[b" the"]
    assert found.same[0][the] == 2 and aligner.same[the] >= 0
    for r in found.pairs.collect():
        assert aligner.same[r["pair"] >> 32] != r["pair"] & 0xFFFFFFFF


def test_forgotten_chunks_are_learnt_again(texts, monkeypatch):
    """However few chunks are remembered, texts are aligned alike."""
    models = A.read_models()
    sample = [t for t in texts.values() if t][:40] + ["京" * 300 + " a", "x" * 200, "a b", "x" * 200]
    wanted = [A.Aligner(models).align(t) for t in sample]
    monkeypatch.setattr(A, "REMEMBERED", 60)
    monkeypatch.setattr(A, "LONG_CHARS", 250)
    few = A.Aligner(models)
    for text, own in zip(sample * 2, wanted * 2, strict=True):
        found = few.align(text)
        assert found[1] == own[1]
        for x, y in zip((found[0], *found[2:]), (own[0], *own[2:]), strict=True):
            np.testing.assert_array_equal(x, y)


def test_every_letter_of_a_long_word_counts():
    from rasterloom.llm import language, toxicity

    a, b = "x" * 60 + "merde" + "y" * 60, "x" * 60 + "blume" + "y" * 60
    assert set(language.word_features(a)) != set(language.word_features(b))
    assert "mer" in language.word_features(a) and len(language.word_features("q" * 200)) == 198 + 7
    ids, sizes = toxicity.trigrams([a, "to", b])
    assert sizes.tolist() == [125, 2, 125]
    assert sorted(ids[:125]) != sorted(ids[127:])


def test_texts_go_through_models_in_bounded_slices():
    import pyarrow as pa

    from rasterloom.llm import language
    from rasterloom.llm.common import text_slices

    texts = pa.array(["a" * 4, None, "b" * 4, "", "c" * 30, "d", "e", "f" * 9, "é" * 5])
    found = list(text_slices(texts, 3, 10))
    assert [a for a, _ in found] == [0, *np.cumsum([n for _, n in found])[:-1].tolist()] and sum(n for _, n in found) == len(texts)
    for a, n in found:
        size = sum(len((t or "").encode()) for t in texts.slice(a, n).to_pylist())
        assert n <= 3 and (size <= 10 or n == 1)
    assert list(text_slices(pa.array([], pa.string()))) == []
    assert language.segment(4) == 1 << 17 and language.segment(100) <= (1 << 19) // 100 and language.segment(10**6) == language.BLOCK


def test_language_stage_uses_its_answer(spark):
    """A wrongly declared language goes; an even mixture, an unlabelled text, repeated rows and a NULL id stay."""
    from rasterloom.llm import language

    words = {"en": "the house and garden with many flowers under bright sunshine", "de": "das haus und der garten mit vielen blumen unter hellem schein"}
    rng, rows = np.random.default_rng(1), []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(rng.choice(words[lang].split(), 12)), lang))
    mixed = " ".join(x for pair in zip(words["en"].split(), words["de"].split(), strict=False) for x in pair)
    rows += [(900, words["de"], "en"), (901, words["de"], None), (902, mixed, "en"), (902, mixed, "en"), (None, words["en"], "en"), (903, "123 !", "en"), (904, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'x' as _id", "1 as lang_pred")
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter([*range(120), 901, 902, 902, None])
    only = Counter(r["doc_id"] for r in language.keep_known(docs, languages=["de"]).collect())
    assert {i for i in only if i is not None and i < 900} == set(range(1, 120, 2)) and 901 in only and None not in only


def test_frequent_chunks_stay_remembered(monkeypatch, texts):
    """Ids don't depend on what an encoder remembers."""
    from rasterloom.llm import sentencepieces as S

    sample = [t for t in texts.values() if t][:60]
    vocabulary = S.read_vocabulary()
    wanted = [S.Encoder(vocabulary).encode(t).tolist() for t in sample[:10]]
    monkeypatch.setattr(S, "REMEMBERED", 40)
    few = S.Encoder(vocabulary)
    assert [few.encode(t).tolist() for t in sample[:10]] == wanted
    assert len(few.chunks) <= 20 and len(few.older) <= 20


def test_chunks_of_a_batch_are_searched_together(monkeypatch, texts):
    """Short chunks of known characters take no search of their own; ids are the library's, also of odd characters and cuts."""
    import random

    import sentencepiece

    from rasterloom.llm import sentencepieces as S

    vocabulary, library, rng = S.read_vocabulary(), sentencepiece.SentencePieceProcessor(model_file=S.MODEL), random.Random(11)
    alone, one = [], S.Encoder._one
    monkeypatch.setattr(S.Encoder, "_one", lambda self, chunk: alone.append(chunk) or one(self, chunk))
    sample = [t for t in texts.values() if t][:40]
    encoder = S.Encoder(vocabulary)
    assert [x.tolist() for x in encoder.encode_all(sample)] == [library.encode(t) for t in sample]
    assert all(len(c) > S.REMEMBERED_CHARS or any(x not in vocabulary.pieces for x in c.replace(" ", S.SPACE)) for c in alone)
    characters, pieces = "ab é  .,!\n\t\r\"'()#-_=0189∑日🎉\x00\x7f", list(vocabulary.pieces)
    odd = ["".join(rng.choices(characters, k=rng.randint(0, 150))) for _ in range(300)] + ["".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(300)]
    monkeypatch.setattr(S, "BLOCK_CHARS", 500)
    assert [x.tolist() for x in encoder.encode_all(["", *odd, ""])] == [[], *map(library.encode, odd), []]
