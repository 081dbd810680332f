import hashlib

import corpus_pipeline as cp

from tallybrook.llm import jaccard_join, pii
from tallybrook.llm.queries import queries
from tests.llm.test_texts import classes


def test_stages_against_brute_force(spark, docs, cases, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = cases
    frame = docs
    # 1: no letters, no language
    frame = cp.identify_language(spark, frame, str(tmp_path))
    kept = [c for c in kept if c[1] and any(x.isalpha() for x in c[1])]
    assert sorted(map(str, (tuple(r) for r in frame.collect()))) == sorted(map(str, kept)) and frame.columns == cp.COLUMNS
    # 2: one of each group, null ids stay
    frame = cp.drop_near_copies(spark, frame, str(tmp_path))
    label = classes(kept)
    kept = [c for c in dict((str(c), c) for c in kept).values() if c[0] is None or label[c[0]][1] == c[0]]
    assert sorted(map(str, (tuple(r) for r in frame.collect()))) == sorted(map(str, kept))
    # 3: base spans masked
    before = {r.doc_id: r.text for r in frame.collect()}
    frame = cp.mask_personal_data(spark, frame, str(tmp_path))
    for r in frame.collect():
        if pii.base_spans(before[r.doc_id]):
            assert r.text != before[r.doc_id] and not pii.base_spans(r.text) and r.n_chars == len(r.text)
        else:
            assert r.text == before[r.doc_id]
    # 4: whole documents, twice at most
    texts = {r.doc_id: r.text for r in frame.collect()}
    frame = cp.mix_sources(spark, frame, str(tmp_path))
    taken = frame.collect()
    assert all(texts[r.doc_id] == r.text for r in taken) and max(sum(r.doc_id == s.doc_id for s in taken) for r in taken) <= 2
    # 5: nothing lost
    last = cp.encode_pieces(spark, frame, str(tmp_path)).collect()
    assert len(last) == len(taken) and all(r.lossless and r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last)


def test_run_and_names(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.columns[0] == "doc_id" and out.count() > 0 and out.filter("not lossless").count() == 0
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    assert jaccard_join.word_set("", 3) == set()


def test_near_copies_by_five_words(spark, tmp_path):
    words = [f"w{i}" for i in range(50)]
    changed = lambda *at: " ".join("x" + w if i in at else w for i, w in enumerate(words))
    texts = [changed(), changed(25), changed(10, 25, 40), changed(3, 25), "one two three four", "one two three four", "one two three five"]
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)]
    sets = [jaccard_join.word_set(t, 5) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a in label[:]:
            for b in range(len(texts)):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = cp.drop_near_copies(spark, spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(cp.COLUMNS, ("long", "string", "string", "string", "long"), strict=True))), str(tmp_path))
    assert label[1] == 0 and sorted(r.doc_id for r in got.collect()) == sorted(set(label))
    a, b = (jaccard_join.word_set(t, 3) for t in texts[:2])
    assert 100 * len(a & b) < 90 * len(a | b)
