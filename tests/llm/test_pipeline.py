"""The pipeline's stages, one after the other, against plain versions of each on what the stage before has kept."""

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from pastmark.llm import queries, toxicity

from . import brute

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append([r.asDict() for r in docs.collect()])
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert i == 4 or docs.columns == COLUMNS
    start, clean, lined, apart, mixed = kept
    packed = docs.collect()

    whole = spark.read.parquet(f"{SF}/documents.parquet")
    scored = toxicity.fit(whole, spark.read.parquet(f"{SF}/labels.parquet")).score(whole)
    toxic = {r.doc_id for r in scored.where("predicted = 1").collect()}
    assert toxic and {r["doc_id"] for r in clean} == {r["doc_id"] for r in start} - toxic

    texts = {r["doc_id"]: r["text"] for r in lined}
    rows = [(r["doc_id"], r["text"]) for r in clean]
    assert texts == {i: x[2] for (i, _), x in zip(rows, brute.line_dedup(rows), strict=True)}
    assert all(r["n_chars"] == len(r["text"]) for r in lined)

    components = brute.near_components(list(texts.items()), 80)
    assert {r["doc_id"] for r in apart} == {i for i, (_, c) in components.items() if i == c}
    assert all(r["text"] == texts[r["doc_id"]] for r in apart)

    sizes, takes = Counter(), Counter()
    words = {r["doc_id"]: brute.words(r["text"]) for r in apart}
    for r in apart:
        sizes[r["source"]] += len(words[r["doc_id"]])
    for r in mixed:
        takes[r["source"]] += len(brute.words(r["text"]))
        assert not Counter(brute.words(r["text"])) - Counter(words[r["doc_id"]])
    targets = brute.targets(sizes)
    assert all(abs(takes[s] - t) <= max(64, 0.02 * t) for s, t in targets.items())
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3

    encode = queries.tokens().start()
    ids, pieces = defaultdict(list), defaultdict(list)
    for r in mixed:
        ids[r["doc_id"]].append(encode(r["text"]))
    assert sum(r.length for r in packed) == sum(len(x) for own in ids.values() for x in own)
    for r in packed:
        pieces[r.doc_id].append(r)
    for i, own in pieces.items():
        assert Counter(np.concatenate(ids[i]).tolist()) == Counter(np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist())


def test_run_gives_packed_rows(spark):
    assert corpus_pipeline.run(spark, SF.replace('0.01', '0.001')).count() > 100


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and ids, texts without words, further columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, mark long, row string, features string"
    line = "one fine and rather long line that comes in many documents"
    rows = [
        (1, None, "en", "a", 0, 1, "r", "f"), (2, "", None, "a", 0, 1, "r", "f"), (3, " \n\t", "en", None, 3, 1, None, None), (None, f"{line}\nalone", "en", "a", None, 1, "r", "f"), (None, None, None, None, None, None, None, None),
        (4, f"{line}\nx y z", "en", "a", 1, 1, "r", "f"), (5, f"{line}\nx y z", "en", "b", 1, 1, "r", "f"), (6, f"{line}\nu v", "en", "b", 1, 1, "r", "f"),
        (7, "six words that are said twice", "en", "b", 1, 1, "r", "f"), (7, "six words that are said twice", "en", "b", 1, 1, "r", "f"), (7, "another text of the same id", "en", "c", 1, 1, "r", "f"), (8, "six words that are said twice", "en", "b", 1, 1, "r", "f"),
        (9, "long " * 40_000, "en", "c", 1, 1, "r", "f"),
    ]
    labels = "/root/testdata/sf0.001"
    for frame, empty in ((spark.createDataFrame(rows, schema), False), (spark.createDataFrame([], schema), True)):
        docs, kept = frame, [frame.collect()]
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{empty}{i}")
            stage(spark, docs, labels).write.parquet(path)
            docs = spark.read.parquet(path)
            assert i == 4 or docs.columns == frame.columns
            kept.append(docs.collect())
        if empty:
            assert not any(kept)
            continue
        key = lambda r: (r.doc_id, r.text, r.source)
        assert Counter(map(key, kept[1])) == Counter(map(key, kept[0]))  # none is toxic
        want = [(r.doc_id, t) for r, (_, _, t) in zip(kept[1], brute.line_dedup([(r.doc_id, r.text) for r in kept[1]]), strict=True)]
        assert Counter((r.doc_id, r.text or "") for r in kept[2]) == Counter(want)
        left = Counter(r.doc_id for r in kept[3])
        assert left[8] == 0 and left[7] == 2 and left[None] == 2 and left[1] == left[2] == left[3] == left[9] == 1
        assert {r.doc_id for r in kept[4]} <= {None, 4, 5, 6, 7, 9} and all(brute.words(r.text) for r in kept[4])
        assert sum(r.length for r in kept[5]) == sum(r.doc_tokens for r in kept[5] if r.start == 0)
