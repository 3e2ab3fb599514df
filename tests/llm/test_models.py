"""The fitted operators: exact inference, right gradients, held-out accuracy, empirical Bayes by hand."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import language, quality, secrets, toxicity
from rasterloom.llm.queries import QUERIES


def small_field(size=3, seed=1):
    rng = np.random.default_rng(seed)
    return language.Model([f"l{k}" for k in range(size)], {"": 0}, np.zeros((1, size)), rng.normal(0, 2, (size, size)), rng.normal(0, 2, size)), rng


def plain_posteriors(scores, model):
    n, size = scores.shape
    ahead, back = np.zeros((n, size)), np.zeros((n, size))
    ahead[0] = model.start + scores[0]
    for i in range(1, n):
        ahead[i] = np.logaddexp.reduce(ahead[i - 1][:, None] + model.transitions, axis=0) + scores[i]
    for i in range(n - 2, -1, -1):
        back[i] = np.logaddexp.reduce(model.transitions + scores[i + 1] + back[i + 1], axis=1)
    both = ahead + back
    return np.exp(both - np.logaddexp.reduce(both, axis=1, keepdims=True))


def test_forward_backward_over_blocks_and_segments(monkeypatch):
    """Documents shorter and longer than blocks and segments, some empty, against each one's own forward-backward."""
    monkeypatch.setattr(language, "BLOCK", 8)
    monkeypatch.setattr(language, "SEGMENT", 64)
    model, rng = small_field()
    lengths = np.array([1, 0, 7, 8, 9, 300, 0, 64, 2, 129])
    scores = rng.normal(0, 3, (50, 3))
    ids = rng.integers(0, 50, lengths.sum())
    found, at = language.language_sums(ids, lengths, scores, model), 0
    for n, row in zip(lengths, found, strict=True):
        want = plain_posteriors(scores[ids[at : at + n]], model).sum(axis=0) if n else np.zeros(3)
        assert np.allclose(row, want, atol=1e-8)
        at += n


def test_field_gradient():
    """Expected labels and transitions are the slopes of the log-sum over all labellings."""
    model, rng = small_field()
    scores, mask = rng.normal(0, 1, (2, 4, 3)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)

    def total():
        value = 0.0
        for s, m in zip(scores, mask, strict=True):
            v = model.start + s[0]
            for i in range(1, m.sum()):
                v = np.logaddexp.reduce(v[:, None] + model.transitions, axis=0) + s[i]
            value += np.logaddexp.reduce(v)
        return value

    node, edge = language._expectations(scores, mask, model)
    for k in range(3):
        for j in range(3):
            model.transitions[k, j] += 1e-5
            up = total()
            model.transitions[k, j] -= 2e-5
            assert np.isclose(edge[k, j], (up - total()) / 2e-5, atol=1e-5)
            model.transitions[k, j] += 1e-5
    scores[0, 2, 1] += 1e-5
    up = total()
    scores[0, 2, 1] -= 2e-5
    assert np.isclose(node[0, 2, 1], (up - total()) / 2e-5, atol=1e-5)


def test_switching_text():
    words = {"aa": [f"ka{c}lo" for c in "bcdfgh"], "bb": [f"ti{c}re" for c in "mnpqrs"]}
    rng = np.random.default_rng(2)
    samples = [(lang, list(rng.choice(words[lang], 20))) for lang in words for _ in range(40)]
    model = language.fit(samples)
    reader = language.Reader(model)
    langs, scores = reader.predict([" ".join(words["aa"] * 3 + words["bb"]), " ".join(words["bb"]), "12 ?", None, ""])
    assert langs == ["aa", "bb", "und", "und", "und"]
    assert abs(scores[0] - 0.75) < 0.05 and scores[1] > 0.95 and scores[2:] == [0, 0, 0]


def test_remembered_words_change_nothing(monkeypatch, texts):
    some = [texts[d] for d in sorted(texts)[:40]]
    samples = [("a" if i % 2 else "b", language.words_of(t)[:60]) for i, t in enumerate(some)]
    model = language.fit(samples, steps=5)
    whole = language.Reader(model).predict(some)
    monkeypatch.setattr(language, "REMEMBERED", 50)
    monkeypatch.setattr(language, "SEGMENT", 512)
    pieces = language.Reader(model).predict(some)
    assert whole[0] == pieces[0] and np.allclose(whole[1], pieces[1])


def test_network_gradient():
    rng = np.random.default_rng(0)
    h, width = toxicity.STATE, toxicity.WORD_DIM + toxicity.CHAR_DIM
    p = {
        "in_f": rng.normal(0, 0.5, (width, 3 * h)), "rec_f": rng.normal(0, 0.5, (h, 3 * h)), "bias_f": rng.normal(0, 0.5, 3 * h),
        "in_b": rng.normal(0, 0.5, (width, 3 * h)), "rec_b": rng.normal(0, 0.5, (h, 3 * h)), "bias_b": rng.normal(0, 0.5, 3 * h),
        "attend": rng.normal(0, 0.5, (2 * h, 2 * h)), "look": rng.normal(0, 0.5, 2 * h), "out": rng.normal(0, 0.5, 2 * h), "out_bias": np.zeros(1),
    }
    x, mask, y = rng.normal(size=(6, 4, width)), np.ones((6, 4, 1)), np.array([0, 1, 1, 0.0])
    mask[3:, 2] = 0
    g, d_x, _ = toxicity._gradients(p, x, mask, y)
    for target, slope in [(v, g[k]) for k, v in p.items()] + [(x, d_x)]:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in target.shape)
            target[at] += 1e-6
            up = toxicity._gradients(p, x, mask, y)[2]
            target[at] -= 2e-6
            down = toxicity._gradients(p, x, mask, y)[2]
            target[at] += 1e-6
            assert np.isclose(slope[at], (up - down) / 2e-6, atol=1e-6)


def test_windows_cover_texts_whole():
    lengths = np.array([0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 100, 1001])
    owner, at = toxicity.windows(lengths)
    for i, n in enumerate(lengths):
        starts = at[owner == i]
        covered = {p for a in starts for p in range(a, min(a + toxicity.WINDOW, n))}
        assert covered == set(range(n))
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_one_bad_window_in_a_long_text():
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(60)]
    samples = []
    for i in range(200):
        words = list(rng.choice(plain, 60))
        if i % 2:
            words[rng.integers(0, 60)] = "awful"
        samples.append((words, i % 2))
    scorer = toxicity.Scorer(toxicity.fit(samples))
    long = list(rng.choice(plain, 5000))
    bad = [*long[:3210], "awful", *long[3210:]]
    scores = scorer.score([" ".join(long), " ".join(bad), "awful", "word1", None, ""])
    assert scores[0] < 0.5 < scores[1] and scores[3] < 0.5 < scores[2] and scores[4:] == [0.0, 0.0] or max(scores[4:]) < 1e-9


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")

    def share(found, truth, right):
        return found.where("held_out").join(truth, "doc_id").agg(F.avg(right.cast("int"))).first()[0]

    assert share(QUERIES["op7_language_id"](spark, sf_dir), docs.select("doc_id", "lang"), F.col("lang") == F.col("lang_pred")) > 0.97
    assert share(QUERIES["op6_quality"](spark, sf_dir), labels, F.col("quality") == F.col("predicted")) > 0.97
    assert share(QUERIES["op8_toxicity"](spark, sf_dir), labels, F.col("toxic") == F.col("predicted")) > 0.9


def test_shrinkage_by_hand(spark):
    """Means of sites and sections without the document itself, for every row, against plain arithmetic."""
    rng = np.random.default_rng(6)
    data = [(i, "A" * int(rng.integers(0, 5)) + "b c d " * int(rng.integers(1, 9)), f"s{i % 5}", "xy"[i % 2]) for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string, lang string")
    model = quality.Classifier([0.0] * 7, [1.0] * 7, [-8.0, 0, 0, 1.0, 0.5, 0, 0], 0.3, 0.7)
    found = {r["doc_id"]: r for r in quality.judge(docs, model, path=F.col("lang")).collect()}
    assert set(found) == set(range(300))
    p = {i: 1 / (1 + np.exp(-(r["evidence"] + 0.7))) for i, r in found.items()}
    mean = np.mean(list(p.values()))

    def groups(key):
        out = {}
        for i, r in found.items():
            out.setdefault(key(r), []).append(p[i])
        return out

    def strength(parts, parent):
        between = np.mean([(np.mean(v) - parent(k)) ** 2 for k, v in parts.items()])
        within = sum(np.sum((np.array(v) - np.mean(v)) ** 2) for v in parts.values()) / sum(len(v) - 1 for v in parts.values())
        return quality._strength(between, within, len(parts) / sum(1 / len(v) for v in parts.values()))

    sites, sections = groups(lambda r: r["host"]), groups(lambda r: (r["host"], r["path"]))
    by_site, by_section = strength(sites, lambda k: mean), strength(sections, lambda k: np.mean(sites[k[0]]))
    for i, r in found.items():
        site, section = sites[r["host"]], sections[r["host"], r["path"]]
        host = (sum(site) - p[i] + by_site * mean) / (len(site) - 1 + by_site)
        path = (sum(section) - p[i] + by_section * host) / (len(section) - 1 + by_section)
        assert np.isclose(r["host_mean"], host) and np.isclose(r["path_mean"], path)
        assert np.isclose(r["score"], 1 / (1 + np.exp(-(r["evidence"] + np.log(path / (1 - path))))))


def test_random_strings_stand_out(spark):
    key = "q7Xv" "B2mKp9ZtL4wRy8Nc3HdF"
    docs = spark.createDataFrame(
        [(i, f"the quick brown foxes jumped over something password = {key[i % 9:]}{i}Zk") for i in range(60)] + [(99, f"see internationalization-and-localization {key}")],
        "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    at = len("see internationalization-and-localization ")
    assert [(s["start"], s["end"], s["rank"]) for s in found[99]] == [(at, at + len(key), 3)]


def test_rare_secrets_train_the_models(spark, monkeypatch):
    """Secrets rarer than the sample of texts, and one text whose copies would fill the sample."""
    monkeypatch.setattr(secrets, "TRAIN_TEXTS", 20)
    key = "q7Xv" "B2mKp9ZtL4wRy8Nc3HdF"
    plain = [f"the quick brown foxes jumped over something number {i}" for i in range(600)]
    rare = [f"jumped over password = {key[i % 9:]}{i}Zk" for i in range(12)]
    at = len("see internationalization-and-localization ")
    for texts in (plain + rare, ["copied text " * 3] * 600 + plain[:60] + rare):
        docs = spark.createDataFrame([*enumerate(texts), (9999, f"see internationalization-and-localization {key}")], "doc_id bigint, text string")
        ratios = secrets.train_markov(docs)
        found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs, ratios=ratios).collect()}
        assert [(s["start"], s["end"], s["rank"]) for s in found[9999]] == [(at, at + len(key), 3)]


def test_copies_of_a_secret_train_once(spark):
    rows = [(i, f"plain ordinary words stand here, token: {'Zq9' * 5}") for i in range(50)] + [(99, "another ordinary sentence, token: kX7bV2nM4qLp")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert secrets.train_markov(docs) == secrets.train_markov(docs.dropDuplicates(["text"]))


def test_missing_random_strings_are_reported(spark):
    import pytest

    docs = spark.createDataFrame([(1, "nothing secret stands here")], "doc_id bigint, text string")
    with pytest.warns(UserWarning, match="no random string"):
        assert not any(secrets.train_markov(docs))


def switching(spark, count):
    """Labelled texts of made-up languages, and one text that mixes all of them evenly."""
    letters = ["bdg", "lmn", "rst", "vwz", "fhk", "cpq"][:count]
    words = [[a + v + b + u for a in three for b in three for v, u in ("ai", "eo", "ou")] for three in letters]
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(words[i % count], 20)), f"l{i % count}") for i in range(60 * count)]
    mixed = " ".join(" ".join(w[:8]) for w in words)
    return spark.createDataFrame([*rows, (9000, mixed, None), (9001, "12 ?", None), (9002, None, None)], "doc_id bigint, text string, lang string")


def test_texts_that_mix_languages_evenly_stay(spark):
    docs = switching(spark, 4)
    model = language.train(docs)
    mixed = language.identify(docs.where("doc_id = 9000"), model, ["doc_id"]).first()
    assert mixed["lang_pred"] != "und" and mixed["lang_score"] < 0.4
    gone = {r["doc_id"] for r in docs.join(language.keep_known(docs), "doc_id", "left_anti").collect()}
    assert gone == {9001, 9002}


def test_too_many_languages_are_reported(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(language, "TRAIN_LANGUAGES", 2)
    with pytest.warns(UserWarning, match="more than 2 labelled languages"):
        assert len(language.train(switching(spark, 3)).languages) == 2


def test_passages_lie_whole_in_a_window_wherever_they_stand():
    for n in (20, 24, 25, 41, 100):
        _, at = toxicity.windows(np.array([n]))
        assert all(any(a <= p and p + 20 <= a + toxicity.WINDOW for a in at) for p in range(n - 20 + 1))
