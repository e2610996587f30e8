"""Registered corpus queries, and the pipeline against its stages by brute force."""

import hashlib

import pytest

import corpus_pipeline
from plumbline.llm import language_id, queries, sentencepiece_bpe as sp
from tests.llm.test_dedup import lower, near_brute
from tests.llm.test_labels import FOREIGN
from tests.llm.test_tokens import fill
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    assert_same(spark, connect(sf_dir), sf_dir, name, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_one_row_per_document(spark, sf_dir, small, name):
    found = queries.QUERIES[name](spark, sf_dir)
    if "doc_id" in found.columns:
        assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(r.doc_id for r in small.select("doc_id").collect())
    else:
        assert found.count() > 0


LONG = "der lange satz und noch ein wort " * 20000
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "123 !?", None, None), (4, "the and of that is the in", None, "a"), (4, "the and of that is the in", None, "a"), (None, "the and of it", "en", None),
    (None, None, None, None), (6, LONG, "de", "b"), (7, LONG, "de", "b"), (8, "tie", "en", ""), (9, "TIE", "en", "a"), (9, "another text of nine", "en", "b"),
]


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_rows(spark, sf_dir, make, number):
    """Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names, by each stage's docstring."""
    name, stage = corpus_pipeline.STAGES[number]
    docs = make(ODD, extra=("class_id", "keep_id", "kept", "rejected", "repeats", "ids", "size", "root"))
    found = stage(spark, docs, sf_dir)
    assert found.columns == (docs.columns if number < 4 else ["doc_id", "ids"])
    rows = found.collect()
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in rows)
    if number == 0:
        assert not {1, 2, 3} & set(ids) and {6, 7} <= set(ids) and ids.count(4) in (0, 2)
    elif number == 1:
        assert ids == sorted([2, 3, 4, 4, -1, 7, 9, 9])
    elif number == 2:
        assert ids == sorted([1, 3, 4, 4, -1, -1, 6, 8, 9, 9])
    elif number == 3:
        assert {6, 7} & set(ids) and set(map(tuple, rows)) <= set(map(tuple, docs.collect())) and ids.count(4) % 2 == 0
    else:
        assert len(rows) == len(ODD)
        encoder = sp.Encoder(sp.load_pieces())
        assert all((r.ids is None) if t is None else r.ids == encoder.encode(t, i) for r, (i, t, _, _) in zip(rows, ODD, strict=True))
    empty = stage(spark, make([], extra=("class_id", "ids")), sf_dir)
    assert empty.count() == 0 and empty.columns == ([*docs.columns[:5], "class_id", "ids"] if number < 4 else ["doc_id", "ids"]), name


def mixed_by_hand(rows, weights=(3, 1, 2), share=1.5, epochs=2.0):
    """How often each of (doc_id, text, source) is taken: water-filling by repeated clamping, then documents in seeded order."""
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s))
    total = [sum(size[i] for i, _, s in rows if s == source) for source in sources]
    target = dict(zip(sources, fill(total, [weights[k % len(weights)] for k in range(len(sources))], share, epochs), strict=True))
    taken = {}
    for source, n in zip(sources, total, strict=True):
        whole, done = int(target[source] // n) if n else 0, 0
        for i in sorted((i for i, _, s in rows if s == source), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest()):
            taken[i] = whole + (size[i] > 0 and done + size[i] / 2 <= target[source] - whole * n + 1e-9)
            done += size[i]
    return taken


def test_pipeline(spark, sf_dir, small, texts):
    """All stages, on documents and some foreign texts, against plain versions of each."""
    extra = [(10**6 + i, t, None, "src0", len(t)) for i, t in enumerate(FOREIGN)]
    docs = small.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    texts = texts | {r[0]: r[1] for r in extra}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    model = language_id.fit_centroids(docs.where(~language_id.held_out()))
    kept = {}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        kept[number] = [r.doc_id for r in docs.select("doc_id").collect()]
    first = [i for i, t in texts.items() if not model.predict(t)[2]]
    assert sorted(kept[0]) == sorted(first) and len(first) < len(texts) and not {r[0] for r in extra} & set(first)
    last = {}
    for i in first:
        last[lower(texts[i])] = max(i, last.get(lower(texts[i]), i))
    assert sorted(kept[1]) == sorted(last.values())
    classes = near_brute([(i, texts[i]) for i in sorted(last.values())])
    assert sorted(kept[2]) == sorted(set(classes.values()))
    taken = mixed_by_hand([(i, texts[i], source[i]) for i in kept[2]])
    assert sorted(kept[3]) == sorted(i for i, n in taken.items() for _ in range(n))
    encoder = sp.Encoder(sp.load_pieces())
    assert all(r.ids == encoder.encode(texts[r.doc_id], r.doc_id) for r in docs.collect()) and sorted(kept[4]) == sorted(kept[3])
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
