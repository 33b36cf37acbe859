"""The registered queries over whole small tables against plain versions."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from pastmark.llm import quality_model, queries, token_counts, toxicity

from . import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def rows(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


def auc(pairs):
    pairs = sorted(pairs)
    ranks, i = [], 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        ranks += [(i + j + 1) / 2] * (j - i)
        i = j
    n = sum(y for _, y in pairs)
    return (sum(r for r, (_, y) in zip(ranks, pairs, strict=True) if y) - n * (n + 1) / 2) / (n * (len(pairs) - n))


def test_toxicity(spark, docs):
    out = {r["doc_id"]: r for r in rows(spark, "op1_toxicity")}
    assert out.keys() == {d[0] for d in docs}
    assert all(r["held_out"] == brute.held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in out.items())
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    held = [(out[i]["score"], y) for i, y in labels.items() if i in out and out[i]["held_out"]]
    assert auc(held) > 0.9


def test_toxicity_scores_are_those_of_the_fitted_parts(spark, docs):
    """Every score again from lexicon, trees and curve, without Spark."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    out = {r.doc_id: r.score for r in model.score(frame).collect()}
    trees, curve = brute.forest(model.trees), (list(model.curve.boundaries), list(model.curve.predictions))
    lookalikes = dict(zip("013457@$", "oieastas", strict=True))
    for i, text, _ in docs:
        features = brute.toxic_features(text, model.lexicon, set(toxicity.SECOND_PERSON), lookalikes)
        assert out[i] == pytest.approx(brute.toxic_score(features, trees, *curve), abs=1e-9)
    assert len({round(x, 6) for x in out.values()}) > 20


def test_quality_grades_are_those_of_the_fitted_weights(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_model.fit(frame, spark.read.parquet(f"{SF}/labels.parquet"), queries.graded(), 3)
    out = {r.doc_id: r for r in model.score(frame).collect()}
    for i, text, _ in docs:
        tails = brute.quality_tails(text, model.weights, model.thresholds, quality_model.FEATURES)
        assert out[i].tails == pytest.approx(tails, abs=1e-6) and out[i].expected_grade == pytest.approx(sum(tails), abs=1e-6)


def test_secret_scan(spark, docs):
    out = {r["doc_id"]: r for r in rows(spark, "op2_secret_scan")}
    assert len(out) == len(docs)
    for i, text, _ in docs:
        *counts, sha, base = brute.secrets(text)
        r = out[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == [*counts, sha]
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex")] == [x for x in base.split(",") if x]
    assert sum(r["n_assign"] for r in out.values()) > 10


def test_source_mix(spark, docs):
    out = {r["doc_id"]: r for r in rows(spark, "op3_source_mix")}
    assert len(out) == len(docs)
    sizes, takes = Counter(), Counter()
    for i, text, source in docs:
        assert out[i]["size"] == len(brute.words(text)) and out[i]["taken"] <= 3 * out[i]["size"]
        sizes[source] += out[i]["size"]
        takes[source] += out[i]["taken"]
    targets = brute.targets(sizes)
    for i, _, source in docs:
        assert out[i]["source_size"] == sizes[source] and out[i]["target"] == pytest.approx(targets[source], rel=1e-9)
    assert all(abs(takes[s] - t) <= max(64, 0.01 * t) for s, t in targets.items())
    assert {r["doc_id"]: r["taken"] for r in rows(spark, "op3_source_mix")} == {i: r["taken"] for i, r in out.items()}


def test_token_counts(spark, docs):
    import public_tokenizers

    vocabulary = set(token_counts.byte_level_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    out = {r["doc_id"]: r for r in rows(spark, "op4_token_counts")}
    memo = {}
    for i, text, _ in docs:
        counts = [memo.get(w) or memo.setdefault(w, brute.greedy_pieces(w.encode(), vocabulary)) for w in brute.words(text)]
        assert (out[i]["n_words"], out[i]["n_pieces"], out[i]["longest_word_pieces"]) == (len(counts), sum(counts), max(counts, default=0))


def test_quality_grades(spark, docs):
    out = {r["doc_id"]: r for r in rows(spark, "op5_quality_grades")}
    assert out.keys() == {d[0] for d in docs}
    assert all(r["p_above_0"] >= r["p_above_1"] >= 0 and r["expected_grade"] == pytest.approx(r["p_above_0"] + r["p_above_1"]) for r in out.values())
    held = [r for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["doc_id"] in out and out[r["doc_id"]]["held_out"]]
    assert auc([(out[r["doc_id"]]["expected_grade"], r["quality"]) for r in held]) > 0.9
    assert np.mean([out[r["doc_id"]]["kept"] == bool(r["quality"]) for r in held]) > 0.9


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*e.ids, 0], "<u4") for (i, _, _), e in zip(docs, tokenizer.encode_batch([t or "" for _, t, _ in docs], add_special_tokens=False), strict=True)}
    pieces, sequences, steps = defaultdict(list), defaultdict(list), defaultdict(set)
    for r in rows(spark, "op6_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        steps[r["step_id"]].add((r["sequence_id"], r["sequence_length"]))
    assert pieces.keys() == ids.keys()
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i]) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[i][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[i])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == own[0]["sequence_length"] and at <= 1024 and at & (at - 1) == 0
    assert all(len({n for _, n in s}) == 1 and sum(n for _, n in s) <= 64 * 1024 for s in steps.values())
    by_length = defaultdict(list)
    for s in steps.values():
        by_length[next(iter(s))[1]].append(len(s))
    assert all(max(x) - min(x) <= 1 for x in by_length.values())


def test_line_dedup(spark, docs):
    out = {r["doc_id"]: r for r in rows(spark, "op7_line_dedup")}
    for (i, _, _), (n, dropped, kept) in zip(docs, brute.line_dedup([d[:2] for d in docs]), strict=True):
        assert (out[i]["n_lines"], out[i]["n_dropped"], out[i]["kept_sha256"]) == (n, dropped, hashlib.sha256(kept.encode()).hexdigest())
    assert sum(r["n_dropped"] for r in out.values()) > 10


def test_exact_topk(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    ids, vectors = np.array(table["vec_id"]), np.floor(1024 * np.array(table["embedding"], float)).astype(np.int64)
    out = defaultdict(list)
    for r in rows(spark, "op8_exact_topk"):
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    queries_ = [i for i in ids.tolist() if i % 100 == 0]
    assert out.keys() == set(queries_)
    for q in queries_:
        score = vectors @ vectors[ids == q][0]
        best = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != q)[:10]
        assert sorted(out[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_quality_rules(spark, docs):
    out = {r["doc_id"]: r for r in rows(spark, "op9_quality_rules")}
    for i, text, _ in docs:
        counts, r = brute.quality_counts(text), out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    agree = [out[i]["kept"] == bool(y) for i, y in labels.items() if i in out]
    assert np.mean(agree) > 0.9


def test_near_dedup(spark, docs):
    out = rows(spark, "op10_near_dedup")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute.near_components([d[:2] for d in docs])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert sum(not r["kept"] for r in out) > 10


def test_fingerprints(spark, docs):
    out = {r["doc_id"]: r for r in rows(spark, "op11_fingerprints")}
    expect = brute.following([d[:2] for d in docs])
    assert out.keys() == expect.keys()
    errors = []
    for i, text, _ in docs:
        n, edited, after = expect[i]
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        sizes = [len(brute.shingles(x)) for x in (text, edited, after)]
        for value, other, size in ((r["near_edited"], edited, sizes[1]), (r["near_next"], after, sizes[2])):
            errors.append(abs(value - brute.likeness(text, other)))
            assert errors[-1] < (1e-12 if max(sizes[0], size) < 256 else 0.16)
        assert r["n_shingles"] == pytest.approx(sizes[0], rel=1e-9 if sizes[0] < 256 else 0.3)
    assert np.mean(errors) < 0.02 and np.mean([r["near_edited"] > 0.2 for r in out.values()]) > 0.9
    by_text = defaultdict(set)
    for i, text, _ in docs:
        by_text[text].add(out[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_spelling_variants(spark, docs):
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows(spark, "op12_spelling_variants")}
    assert out == brute.spelling([d[:2] for d in docs]) and len(out) > 10_000


def test_whitening(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    ids, x = np.array(table["vec_id"]), np.floor(1024 * np.array(table["embedding"], float)).astype(np.int64) + 100_000
    out = rows(spark, "op13_whitening")
    n = len(ids)
    deviation = dict(zip(ids.tolist(), ((n * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist(), strict=True))
    assert len(out) == 8 * n and all(r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] < 1e-9 for r in out)
    centred = (n * x - x.sum(axis=0)) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    white = centred @ (vectors / np.sqrt(values))
    for k in range(1, 9):
        mine = {r["vec_id"]: r for r in out if r["component"] == k}
        other = white[:, -k] * np.sign(white[0, -k] * mine[ids[0]]["whitened"])
        assert np.abs(other - [mine[i]["whitened"] for i in ids.tolist()]).max() < 1e-7
        assert mine[ids[0]]["explained"] == pytest.approx(values[-k] / values.sum(), rel=1e-9)
