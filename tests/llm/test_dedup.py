"""Exact, substring and near-duplicate detection against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, order_minhash, substring_dedup
from plumbline.llm.components import connected_components
from plumbline.llm.order_minhash import aligned, labelled_shingles, near_duplicates, similarity
from plumbline.llm.words import WordHashes, rolling, sliding_min

LONG = " ".join(f"w{i}" for i in range(3000))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = set()
    for i, t in rows:
        keep = max((x for x in groups[lower(t)] if x is not None), default=None)
        out.add((i, keep, len(groups[lower(t)]), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return out


EXACT = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, LONG), (8, LONG.upper()), (9, "x"), (9, "x"), (None, "a b"), (None, "alone"), (10, "tie"), (11, "tie ")]


@pytest.mark.parametrize("hash128", [None, lambda t: F.unhex(F.lit("00")), lambda t: F.unhex(F.substring(F.md5(t), 1, 2))], ids=["md5", "all clash", "some clash"])
def test_exact(make, hash128):
    options = {"hash128": hash128} if hash128 else {}
    docs = make(EXACT, extra=("keep_id", "kept", "__hot_x"))
    found = [tuple(r) for r in exact_dedup.exact_duplicates(docs, **options).collect()]
    assert len(found) == len(EXACT) and set(found) == exact_brute(EXACT)
    kept = exact_dedup.drop_exact_duplicates(docs, **options)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [2, 4, 5, 6, 8, 9, 9, 10, 11]


def test_exact_keep_min_and_empty(make):
    found = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(make(EXACT[:4]), keep="min").collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 3}
    assert exact_dedup.exact_duplicates(make([])).count() == 0 and exact_dedup.drop_exact_duplicates(make([])).count() == 0


def test_exact_hot_group(make, monkeypatch):
    monkeypatch.setattr("plumbline.llm.columns.HOT_SHARE", 0.3)
    rows = [(i, "hot" if i < 40 else f"t{i % 25}") for i in range(90)]
    assert {tuple(r) for r in exact_dedup.exact_duplicates(make(rows)).collect()} == exact_brute(rows)


def substring_brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for a in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[a : a + window])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def substring_found(docs, window):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeated_passages(docs, window=window).collect())


def test_substring_on_documents(small, texts):
    assert substring_found(small, 50) == substring_brute(list(texts.items()), 50)


@pytest.mark.parametrize("seed", range(3))
def test_substring_random(make, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "é", "x y", "　"][: 3 + seed]
    base = [" ".join(rng.choices(vocabulary, k=rng.randrange(20, 120))) for _ in range(4)]
    rows = []
    for i in range(14):
        parts = [rng.choice(base).split(" ") for _ in range(2)]
        rows.append((rng.randrange(10), " \n".join(w for p in parts for w in p[rng.randrange(len(p)) :])))
    rows += [(20, None), (21, ""), (22, LONG), (23, LONG), (23, LONG), (None, LONG), (24, "a " * 500)]
    docs = make(rows, extra=("block", "key"))
    assert substring_found(docs, 20) == substring_brute(rows, 20)


def test_substring_does_not_depend_on_memory():
    """Blocks that forget the words of earlier ones in between give the same."""
    tables = [pa.table({"doc_id": [i], "text": [" ".join(f"w{i * 7 % 90 + j}" for j in range(80))]}) for i in range(6)]
    wanted = [substring_dedup._nominate(20)([pa.scalar(0)], t) for t in tables]
    remembered, substring_dedup.REMEMBERED = substring_dedup.REMEMBERED, 60
    try:
        assert [substring_dedup._nominate(20)([pa.scalar(0)], t) for t in tables] == wanted
    finally:
        substring_dedup.REMEMBERED = remembered


def test_substring_empty_and_text(make):
    assert substring_dedup.remove_repeated_passages(make([])).count() == 0
    passage = " ".join(f"p{i}" for i in range(60))
    rows = substring_dedup.remove_repeated_passages(make([(1, f"one {passage} two"), (2, f"three  {passage} four")]), with_text=True).orderBy("doc_id").collect()
    assert [r.kept_text for r in rows] == [f"one {passage} two", "three four"]


def test_substring_automaton_decides():
    """What no phrase of the automaton leads to stays, though its windows are confirmed; phrases come from another block."""
    passages = [" ".join(f"{c}{i}" for i in range(60)) for c in "pq"]
    here = pa.table({"doc_id": [7], "text": [f"some {passages[0]} more {passages[1]} end"]})
    there = pa.table({"doc_id": [3], "text": [" ".join(passages)]})
    key = [pa.scalar(0)]
    nominated = {r["key"]: r for r in substring_dedup._nominate(50)(key, here).to_pylist()}
    shared = [(k, 3, 3, 7) for k in nominated if k in {r["key"] for r in substring_dedup._nominate(50)(key, there).to_pylist()}]
    wanted = pa.table(dict(zip(("key", "first", "low", "high"), map(list, zip(*shared)))))
    rows = substring_dedup._confirm(50)(key, there, wanted).append_column("first", pa.array([3] * substring_dedup._confirm(50)(key, there, wanted).num_rows))
    assert any(r["phrase"] and r["phrase"].startswith("p") for r in rows.to_pylist())

    def removed(confirmed):
        return substring_dedup._removed(substring_dedup._Passages(here, 50), confirmed).sum()

    assert removed(rows) == 120
    without = pa.Table.from_pylist([r for r in rows.to_pylist() if not (r["phrase"] or "").startswith("p")], schema=rows.schema)
    assert removed(without) == 60
    assert removed(rows.filter(pa.compute.equal(rows.column("more"), substring_dedup._OF_PHRASE))) == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(5) for _ in range(rng.randrange(25))]
        b = [rng.randrange(5) for _ in range(rng.randrange(25))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.9]
        arrays = [np.array(x, dtype=np.uint64) for x in (a, b)]
        assert aligned(*arrays, 60) == lcs(a, b)
        # a band that reaches the bound decides as the whole alignment does
        whole = lcs(a, b)
        if a and b:
            band = int((len(a) + len(b)) * 0.2 / 1.8) + 1
            enough = lambda m: m >= 0.8 * (len(a) + len(b) - m)
            assert enough(aligned(*arrays, band)) == enough(whole)


def test_rolling_and_minima():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, 300).astype(np.uint64)
    keys, found = {}, rolling(x, 7)
    for i, k in enumerate(found.tolist()):
        assert keys.setdefault(tuple(x[i : i + 7].tolist()), k) == k
    assert len(set(keys.values())) == len(keys)
    for width in (1, 2, 5, 8, 35):
        assert sliding_min(found, width).tolist() == [found[i : i + width].min() for i in range(len(found) - width + 1)]


def near_brute(rows):
    """Class of each document by comparing all pairs."""
    hashes = WordHashes()
    shingles = [labelled_shingles(hashes.of((t or "").encode())) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or similarity(shingles[i], shingles[j]):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        smallest[r] = min(doc, smallest.get(r, doc))
    return {doc: smallest[find(i)] for i, (doc, _) in enumerate(rows)}


def test_near_on_documents(small, texts):
    assert {r.doc_id: r.class_id for r in near_duplicates(small).collect()} == near_brute(list(texts.items()))


def test_near_cases(make):
    words = LONG.split()
    near = words[:1500] + ["other"] + words[1501:]
    half = words[:1500] + [f"v{i}" for i in range(1500)]
    rows = [(5, LONG), (3, " ".join(near)), (4, " ".join(half)), (6, "one two"), (7, "one  two"), (8, "two one"), (9, None), (10, ""), (11, " "), (12, LONG), (13, "a b c d e"), (14, "a b c d e f")]
    docs = make(rows + [(12, LONG)], extra=("rep", "class_id"))
    found = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert found == near_brute(rows)
    assert found[5] == 3 and found[12] == 3 and found[4] == 4 and found[7] == 6 and found[8] == 8 and found[10] == 9 and found[11] == 11
    kept = order_minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 8, 9, 11, 13, 14]
    assert near_duplicates(make([])).count() == 0
    nulls = near_duplicates(make([(None, "q w e r t y"), (1, "q w e r t y"), (None, "alone here")])).collect()
    assert sorted(str(r.class_id) for r in nulls) == ["1", "1", "None"]


def test_near_order_matters(make):
    words = [f"w{i}" for i in range(200)]
    swapped = " ".join(words[100:] + words[:100])
    found = {r.doc_id: r.class_id for r in near_duplicates(make([(1, " ".join(words)), (2, swapped)])).collect()}
    assert found == {1: 1, 2: 2}


def test_near_recall(make):
    """Random pairs at a similarity just above the bound are found."""
    rng = random.Random(7)
    rows = []
    for g in range(60):
        words = [f"g{g}x{i}" for i in range(140)]
        rows.append((2 * g, " ".join(words)))
        for at in rng.sample(range(4, 136), 2):
            words[at] = "changed"
        rows.append((2 * g + 1, " ".join(words)))
    found = {r.doc_id: r.class_id for r in near_duplicates(make(rows)).collect()}
    assert sum(found[2 * g + 1] == 2 * g for g in range(60)) >= 59


@pytest.mark.parametrize("shape", ["path", "star", "pairs", "none"])
def test_components(spark, shape):
    links = {"path": [(i, i + 1) for i in range(40)], "star": [(7, i) for i in range(30) if i != 7], "pairs": [(10 * i, 10 * i + 1) for i in range(9)] + [(0, None), (3, 3)], "none": []}[shape]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted = {"path": dict.fromkeys(range(41), 0), "star": dict.fromkeys(range(30), 0), "pairs": {x: 10 * i for i in range(9) for x in (10 * i, 10 * i + 1)}, "none": {}}[shape]
    assert found == wanted


def template_family(size=1500, planted=60):
    """Texts that are 85 % template, not linked to each other, and a near copy at about 0.82 of each of the first ones."""
    rng = random.Random(11)
    head = [f"t{i}" for i in range(255)]
    rows = [(i, head + [f"d{i}x{j}" for j in range(45)]) for i in range(size)]
    for i in range(planted):
        words = list(rows[i][1])
        for at in rng.sample(range(10, 250, 12), 6):
            words[at] = f"c{i}x{at}"
        rows.append((size + i, words))
    return [(i, " ".join(w)) for i, w in rows]


def components(count, pairs):
    """The smallest member of each one's component, by union and find."""
    root = list(range(count))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(count)}


def test_near_template_family(make):
    """Classes inside a large family that shares a template are those of comparing all pairs."""
    rows, size, planted = template_family(), 1500, 60
    hashes = WordHashes()
    shingles = [labelled_shingles(hashes.of(t.encode())) for _, t in rows]
    assert not similarity(shingles[1], shingles[2]) and similarity(shingles[0], shingles[size]) > 0.8
    # the rest are plain members, alike but for their own words
    pairs = [(i, j) for i in range(len(rows)) for j in (*range(min(i, 200)), *range(max(size, 200), i)) if similarity(shingles[i], shingles[j])]
    assert len(pairs) >= planted
    assert {r.doc_id: r.class_id for r in near_duplicates(make(rows)).collect()} == components(len(rows), pairs)


@pytest.mark.parametrize("edits, size", [(2, 120), (3, 250), (5, 150)])
def test_near_family_of_edits(make, edits, size):
    """Copies with random edits, of which not all are linked to each other, get the classes of comparing all pairs."""
    rng, rows = random.Random(edits), []
    for i in range(size):
        words = [f"t{j}" for j in range(200)]
        for at in rng.sample(range(200), edits):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    hashes = WordHashes()
    shingles = [labelled_shingles(hashes.of(t.encode())) for _, t in rows]
    pairs = [(j, i) for i in range(size) for j in range(i) if similarity(shingles[i], shingles[j])]
    assert {r.doc_id: r.class_id for r in near_duplicates(make(rows)).collect()} == components(size, pairs)


@pytest.mark.parametrize("apart", [0, 1, 7])
def test_crowded_pairs_are_those_between_roots(make, spark, apart):
    """Texts of one root make no pairs; every similar pair of different roots is found, whatever roots there are."""
    rng, rows = random.Random(apart), []
    for i in range(80):
        words = [f"t{j}" for j in range(60)]
        for at in rng.sample(range(60), 1):
            words[at] = f"e{i}"
        rows.append((i, " ".join(words), 0 if not apart or i % 8 else i % apart + 100))
    hashes = WordHashes()
    shingles = [labelled_shingles(hashes.of(t.encode())) for _, t, _ in rows]
    wanted = {(j, i) for i in range(80) for j in range(i) if rows[i][2] != rows[j][2] and similarity(shingles[i], shingles[j])}
    docs = spark.createDataFrame(rows, "id long, text string, root long")
    found = {(r.a, r.b) for r in order_minhash.crowded_pairs(docs).collect()}
    assert wanted <= found and all(rows[a][2] != rows[b][2] for a, b in found) and bool(wanted) == bool(apart)
    verified = {(r.a, r.b) for r in order_minhash.verify_crowded(order_minhash.crowded_pairs(docs), docs.select("id", "text"), 80).collect()}
    assert verified == wanted


def test_shingles_of_one_root_are_not_spelled_out(spark, monkeypatch):
    """Of families of one root each, only the shingles that several roots may have become rows of the prefix join."""
    made, cut = [], order_minhash.cut_lineage
    monkeypatch.setattr(order_minhash, "cut_lineage", lambda frame: made.append(cut(frame)) or made[-1])
    rows = [(i, " ".join(f"f{i % 3}e{i}" if j == i // 3 % 60 else f"f{i % 3}w{j}" for j in range(60)), i % 3) for i in range(600)]
    rows += [(600, " ".join(f"f0w{j}" for j in range(60)), 600), (601, "", 601), (602, None, 602)]
    found = {(r.a, r.b) for r in order_minhash.crowded_pairs(spark.createDataFrame(rows, "id long, text string, root long")).collect()}
    assert found == {(i, 600) for i in range(0, 600, 3)}
    assert made[1].count() <= made[0].count() < 5000


def test_near_crowd(make):
    """A family whose texts all match is one class."""
    rows = [(i, " ".join([*(f"t{j}" for j in range(200)), f"d{i}"])) for i in range(150)]
    assert {r.class_id for r in near_duplicates(make(rows)).collect()} == {0}


def test_near_links(make):
    """Every text of a class names another one of it with a link that holds, whatever round found it; copies share it, others have none."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    base = rng.choices(vocabulary, k=120)
    rows = []
    for i in range(300):  # a family that fills buckets, each member with its own edits
        words = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3])):
            words[at] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(rng.choices(vocabulary, k=60))) for i in range(20)]
    rows += [(2000, rows[305][1] + " one more"), (2001, rows[310][1]), (2002, None)]
    found = {r.doc_id: r for r in near_duplicates(make(rows)).collect()}
    texts = dict(rows)
    shingles = {i: order_minhash.labelled_shingles(WordHashes().of((t or "").encode())) for i, t in rows}
    classes = near_brute(rows)
    members = {}
    for i, r in found.items():
        assert r.class_id == classes[i]
        members.setdefault(r.class_id, set()).add(texts[i])
    for i, r in found.items():
        assert (r.link_to is None) == (r.similarity is None) == (len(members[r.class_id]) == 1)
        if r.link_to is not None:
            assert found[r.link_to].class_id == r.class_id and found[r.link_to].copy_of == r.link_to and texts[r.link_to] != texts[i]
            assert order_minhash.similarity(shingles[i], shingles[r.link_to]) == r.similarity >= 0.8
    assert found[2000].link_to == 1005 and found[2001].link_to is None and found[2001].copy_of == 1010


def test_sketches_by_lots(spark, monkeypatch):
    """A task holds the words and keys of a lot of texts, not those of a whole batch; no row is lost, nulls, empty and long texts among them."""

    class Plan:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    monkeypatch.setattr(order_minhash, "LOT_BYTES", 4096, raising=False)
    rows = [(1, None), (2, ""), (None, "x y"), (3, LONG), (3, LONG), *((10 + i, f"{i} some words of a text of its own {i} " * 5) for i in range(200)), (4, None)]
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "text"])
    found = list(order_minhash.sketch_documents(Plan())(iter([batch, batch.slice(0, 0), batch.slice(0, 2)])))
    assert max(b.num_rows for b in found) < 40
    wanted = [(i, hashlib.md5((t or "").encode()).hexdigest(), order_minhash.sketch(labelled_shingles(WordHashes().of((t or "").encode()))[1])) for i, t in [*rows, *rows[:2]]]
    assert [tuple(r.values()) for b in found for r in b.to_pylist()] == wanted
