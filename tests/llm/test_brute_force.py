"""Queries against their SQL, or against plain Python over every row of the small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
import xxhash
from check import compare, connect

from rasterloom.llm.queries import ORACLES, QUERIES

SPACE = r"[\x20\x09-\x0D]+"


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == ""


def plain_base(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets(spark, sf_dir, texts):
    found = rows(QUERIES["op2_secret_scan"](spark, sf_dir))
    assert set(found) == set(texts)
    names = ("assign", "access", "hex")
    for doc_id, text in texts.items():
        base = plain_base(text or "")
        printed = [f"{names[k]}:{a}:{b}" for a, k, b in base]
        own = found[doc_id]
        assert own["base_sha256"] == hashlib.sha256(",".join(printed).encode()).hexdigest()
        assert [own["n_assign"], own["n_access"], own["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert set(printed) <= set(own["spans"].split(",") if own["spans"] else [])


def plain_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(SPACE, lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_groups(prints):
    parent = {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {d: root(d) for d in ids}


def test_simhash(spark, sf_dir, texts):
    found = rows(QUERIES["op4_simhash"](spark, sf_dir))
    prints = {d: plain_print(t) for d, t in texts.items()}
    assert {d: r["fingerprint"] for d, r in found.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r["component_id"] for d, r in found.items()} == plain_groups(prints)


def test_links_over_a_dense_cluster(spark):
    """Chains and clusters of fingerprints, sign bit included: the same components as all pairs give."""
    import random

    from rasterloom.llm.components import components
    from rasterloom.llm.simhash import fingerprint_links

    rng, prints = random.Random(5), set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            for b in rng.sample(range(64), rng.choice((1, 1, 2, 3))):
                p ^= 1 << b
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    found = {r["node"]: r["root"] for r in components(fingerprint_links(df)).collect()}
    wanted = plain_groups({p: p for p in prints})
    groups = defaultdict(set)
    for p, r in wanted.items():
        groups[r].add(signed(p))
    got = defaultdict(set)
    for p in map(signed, prints):
        got[found.get(p, p)].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_pieces_equal_the_library(spark, sf_dir, texts):
    import sentencepiece

    from rasterloom.llm.sentencepieces import MODEL

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = rows(QUERIES["op10_sentencepiece"](spark, sf_dir))
    assert set(found) == set(texts)
    for doc_id, text in texts.items():
        assert list(found[doc_id]["ids"]) == library.encode(text or ""), doc_id
        assert found[doc_id]["round_trip"]


def test_best_path_by_scores():
    """The streaming search against a search over the whole text, for a vocabulary with piece probabilities."""
    import random

    from rasterloom.llm.sentencepieces import Encoder, Vocabulary

    rng = random.Random(3)
    pieces = sorted({"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(30)} | set("abc"))
    scores = {p: -rng.uniform(1, 9) for p in pieces}
    encoder = Encoder(Vocabulary({p: i for i, p in enumerate(pieces)}, scores, list(range(1000, 1256)), rule="scores"))
    for n in (1, 5, 40, 400):
        text = "".join(rng.choices("abc", k=n))
        best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - 4), end):
                if (p := text[start:end]) in scores and best[start] + scores[p] > best[end]:
                    best[end], back[end] = best[start] + scores[p], start
        found = list(encoder.search(text))
        assert "".join(found) == text
        assert sum(scores[p] for p in found) == pytest.approx(best[n])


def test_pipeline_stages(spark, sf_dir, texts):
    """Each stage against plain Python on its own input; the language stage may drop only texts without a language."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, dict(texts)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "sentencepieces":
            found = rows(out)
            assert set(found) == set(before) and all(r["round_trip"] for r in found.values())
            break
        assert out.columns == columns
        kept = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(kept) <= set(before)
        gone = set(before) - set(kept)
        if name == "language":
            assert len(gone) < 0.02 * len(before)
        elif name == "exact_duplicates":
            groups = defaultdict(list)
            for d, t in before.items():
                groups[re.sub(SPACE, "", t or "")].append((-len(t or ""), d))
            assert set(kept) == {min(g)[1] for g in groups.values()}
        elif name == "near_duplicates":
            groups = plain_groups({d: plain_print(t) for d, t in before.items()})
            assert set(kept) == set(groups.values())
        elif name == "decontamination":
            db = connect(sf_dir)
            bad = {d for d, c in db.execute(f"select doc_id, contaminated from ({ORACLES['op3_decontamination']})").fetchall() if c}
            assert gone == bad & set(before)
        before, docs = kept, out


def test_index_search_beyond_broadcast(spark, sf_dir, monkeypatch):
    """The shuffled joins that large inputs get give the same rows as the broadcast ones."""
    from rasterloom.llm import common, decontaminate

    monkeypatch.setattr(decontaminate, "small", lambda df, rows=0: df)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert compare(QUERIES["op3_decontamination"](spark, sf_dir), connect(sf_dir), ORACLES["op3_decontamination"]) == ""


def test_substring_dedup_at_other_sizes(spark):
    from rasterloom.llm.substring_dedup import dedup_substrings

    docs = [(1, "a b c d e f g h"), (2, "x c d e f y"), (3, "c d e f"), (4, "a b c"), (5, None), (6, "q r s t q r s t")]
    found = rows(dedup_substrings(spark.createDataFrame(docs, "doc_id bigint, text string"), size=4, shortest=2))
    assert {d: r["kept"] for d, r in found.items()} == {1: "a b c d e f g h", 2: "x y", 3: "", 4: "a b c", 5: "", 6: "q r s t q r s t"}


def test_proximity(spark):
    from pyspark.sql import functions as F

    from rasterloom.llm.decontaminate import PositionIndex, benchmark_windows, proximity_matches

    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id int, text string")
    docs = spark.createDataFrame(
        [(1, "x alpha beta other gamma delta epsilon"), (2, "alpha one two"), (3, "epsilon delta gamma beta alpha")], "doc_id int, text string")
    windows = benchmark_windows(bench)
    index = PositionIndex(docs, windows.select(F.explode("terms").alias("term")))
    assert {r["doc_id"]: r["near"] for r in proximity_matches(index, windows).collect()} == {1: 5, 3: 4}


def test_digest_index_keeps_what_it_has_seen(spark):
    from rasterloom.llm.exact_dedup import DigestIndex, drop_duplicates

    schema = "doc_id bigint, text string"
    index = DigestIndex(spark, buckets=4)
    first = drop_duplicates(spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], schema), index)
    assert sorted(r["doc_id"] for r in first.collect()) == [1, 3]
    again = DigestIndex(spark, index.path, buckets=4)
    second = drop_duplicates(spark.createDataFrame([(9, "a\tb"), (8, "d")], schema), again)
    assert [r["doc_id"] for r in second.collect()] == [8]
    assert again.table().count() == 3
    index.close()
    again.close()


def test_url_rules(spark):
    """Nested rules of several hosts against a longest-match search."""
    from rasterloom.llm.url_filter import filter_urls

    rules = [("com", "/", "allow"), ("a.com", "/x/", "block"), ("a.com", "/x/y", "allow"), ("b.a.com", "/", "allow"), ("", "/", "block"), (None, "/", "block")]
    urls = ["http://a.com/x/yz", "http://A.com/x/z", "https://q.a.com/x/#f", "http://b.a.com/x/y/z", "http://b.a.com", "http://acom/x/", "nothing", None, "http://a.com/x?x/y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    found = rows(filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")), "page_id")
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits) if fits else (0, None, "allow")
        assert (found[i]["host"], found[i]["path"], found[i]["rule"], found[i]["verdict"]) == (host, path, want[1], want[2]), url


def plain_near(docs, windows, slack=5, share=0.8):
    """``{(doc_id, window): near}`` by looking around every occurrence of each window's rarest terms."""
    import math

    counts = defaultdict(int)
    for w in docs.values():
        for term in w:
            counts[term] += 1
    found = {}
    for window in windows:
        ranked = sorted((counts[term], place, term) for place, term in enumerate(window) if counts[term])
        need = math.ceil(share * len(window))
        for d, w in docs.items():
            for _, place, term in ranked[: max(0, len(ranked) - need + 1)]:
                starts = [p - place for p, x in enumerate(w) if x == term]
                near = max((sum(x in w[max(0, s + q - slack) : max(0, s + q + slack + 1)] for _, q, x in ranked) for s in starts), default=0)
                if near >= need:
                    found[d, window] = near
                    break
    return found


def test_proximity_with_changed_words(spark, monkeypatch):
    """Passages with words replaced (each one in turn, so also the rarest), moved, left out and put in."""
    import random

    from pyspark.sql import functions as F

    from rasterloom.llm import decontaminate as D

    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(40)]
    passage = [rng.choice(common) for _ in range(12)]
    passage.insert(5, "rarest")
    texts = [" ".join(rng.choices(common + rare, k=60)) for _ in range(25)] + ["rarest c1", "nothing"]
    for i in range(13):
        texts.append(" ".join([*rng.choices(common, k=i), *passage[:i], "other", *passage[i + 1 :], "end"]))
    texts.append(" ".join(passage[:3] + passage[4:8] + ["x", "y"] + passage[8:]))
    texts.append(" ".join(passage[:2] + passage[4:6] + passage[7:]))
    for _ in range(20):
        mixed = list(passage)
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(mixed))
            mixed[i] = rng.choice([rng.choice(rare), mixed[i - 1]])
        texts.append(" ".join(rng.choices(rare, k=7) + mixed + rng.choices(common, k=9)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(passage[2:9] + rare[:8])), (3, "r1 absent c2 r2")], "item_id int, text string")
    windows = D.benchmark_windows(bench)
    want = plain_near({i: t.split() for i, t in enumerate(texts)}, {tuple(r["terms"]) for r in windows.collect()})
    assert all((27 + i, tuple(passage)) in want for i in range(13))
    names = {r["window_id"]: tuple(r["terms"]) for r in windows.collect()}

    def found():
        index = D.PositionIndex(docs, windows.select(F.explode("terms").alias("term")))
        return {(r["doc_id"], names[r["window_id"]]): r["near"] for r in D.proximity_matches(index, windows).collect()}

    assert found() == want
    monkeypatch.setattr(D, "small", lambda df, rows=0: df)
    assert found() == want


def test_proximity_query(spark, sf_dir, texts):
    from rasterloom.llm.decontaminate import WINDOW

    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    owners = defaultdict(set)
    for item, text in duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall():
        w = lower(text)
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            owners[tuple(w[i : i + WINDOW])].add(str(item))
    found = rows(QUERIES["op3_proximity"](spark, sf_dir))
    exact = rows(QUERIES["op3_decontamination"](spark, sf_dir))
    assert set(found) == set(exact) == set(texts)
    some = {d: lower(texts[d]) for d in sorted(texts) if found[d]["n_near"] or d % 10 == 0}
    for d, w in some.items():
        text = f" {' '.join(w)} "
        assert found[d]["n_near"] >= sum(f" {' '.join(g)} " in text for g in owners)
        assert found[d]["n_items"] >= exact[d]["n_items"]
