"""Encoding, packing, token counts and mixing."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from plumbline.llm import mixing, packing, sentencepiece_bpe as sp, token_counts as tc
from plumbline.llm.tokens import byte_encoding

ODD = ["", "a", " a", "a ", "  a   b \n\n c", "   ", "\n", "€€ 日本 x\ty", "▁x ▁", "\U0001f642\U0001f642", "m².x", "no_space_" * 40, "x" * 3000]


def random_texts(seed, count=300):
    rng = random.Random(seed)
    return ["".join(rng.choice("abe  \n▁é日\U0001f642\t.th,²") for _ in range(rng.choice([10, 30, 200]))) for _ in range(count)]


def test_plain_encoding_is_the_library(texts):
    model, encoder = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL_PATH), sp.Encoder(sp.load_pieces(), dropout=0.0)
    for t in [*list(texts.values())[:80], *ODD, *random_texts(1)]:
        assert encoder.decode(encoder.encode(t)) == t
        if sp._MARK not in t:
            assert encoder.encode(t) == model.encode(t), t


def merged_by_hand(encoder, model, scores, unit, key):
    """Merge-dropout read off its definition: strings, and a fresh search for the best neighbours at every step."""
    symbols, passed, skips, number = list(unit.replace(" ", sp._MARK)), set(), encoder.skipped(key), 0
    skip, start = next(skips), [*range(len(unit))]
    while True:
        # a pair is told by where its parts begin and end
        pairs = [(-scores[a + b], i, (start[i], len(a), len(b))) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores and (start[i], len(a), len(b)) not in passed]
        if not pairs:
            break
        _, i, name = min(pairs)
        if number == skip:
            passed.add(name)
            skip = next(skips)
        else:
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del start[i + 1]
        number += 1
    return [i for s in symbols for i in ([model.piece_to_id(s)] if s in scores else [model.piece_to_id(f"<0x{b:02X}>") for b in s.encode()])]


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_dropout_by_hand(texts, dropout):
    model, encoder = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL_PATH), sp.Encoder(sp.load_pieces(), dropout=dropout)
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not model.is_byte(i)}
    short = [t for t in texts.values() if t and len(t) < 3000][:12]
    for doc_id, text in enumerate([*short, *ODD[:-1], "x" * 200, *random_texts(3, 40)]):
        for i, part in enumerate(text.split(sp._MARK) if text else ()):
            units = encoder.units.findall(part if i else " " + part)
            assert "".join(units) == (part if i else " " + part)
        if text and sp._MARK not in text:
            keys = encoder.occurrence_keys(doc_id, np.arange(len(units))).tolist()
            assert encoder.encode(text, doc_id) == sum((merged_by_hand(encoder, model, scores, u, k) for u, k in zip(units, keys, strict=True)), [])


def test_skips_are_independent():
    """Every candidate is skipped with the same probability, whatever came before it."""
    encoder = sp.Encoder(sp.load_pieces(), dropout=0.3)
    keys = encoder.occurrence_keys(7, np.arange(4000)).tolist()
    rows = np.zeros((len(keys), 12), dtype=bool)
    for row, key in zip(rows, keys, strict=True):
        for at in encoder.skipped(key):
            if at >= len(row):
                break
            row[at] = True
    assert abs(rows.mean(axis=0) - 0.3).max() < 0.03
    assert abs(rows[:, 1:][rows[:, :-1]].mean() - 0.3) < 0.02 and abs(rows[:, 1:][~rows[:, :-1]].mean() - 0.3) < 0.02


def test_dropout(texts):
    encoder, plain = sp.Encoder(sp.load_pieces()), sp.Encoder(sp.load_pieces(), dropout=0.0)
    text = next(t for t in texts.values() if len(t) > 3000)
    forms = {tuple(encoder.encode(text, i)) for i in range(5)}
    assert len(forms) == 5 and all(encoder.decode(f) == text for f in forms)
    assert all(len(f) > len(plain.encode(text)) for f in forms)
    assert sp.Encoder(sp.load_pieces()).encode(text, 3) == encoder.encode(text, 3)
    assert sp.Encoder(sp.load_pieces(), seed=1).encode(text, 3) != encoder.encode(text, 3)
    for t in [*ODD, *random_texts(2)]:
        assert encoder.decode(encoder.encode(t, 9)) == t


def test_encoding_tables(make):
    docs = make([(i, t) for i, t in enumerate(ODD)] + [(90, None), (None, "a b"), (0, "twice")], extra=("ids",))
    encoded = sp.encode_documents(docs)
    assert [r.text for r in sp.decode_documents(encoded).collect()] == [*ODD, None, "a b", "twice"]
    digests = sp.encoding_digest(docs).collect()
    assert [r.n_ids for r in digests] == [len(r.ids or []) for r in encoded.collect()]
    assert all(r.lossless for r in digests if r.doc_id != 90) and digests[len(ODD)].lossless is None
    assert sp.encode_documents(make([])).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        limit = rng.choice([5, 8, 16, 33])
        sizes = [rng.randrange(1, limit + 1) for _ in range(rng.randrange(60))]
        rows = packing.best_fit_decreasing(sizes, limit)
        assert sorted(sum(rows, [])) == list(range(len(sizes))) and all(sum(sizes[i] for i in r) <= limit for r in rows)
        room = []
        for s in sorted(sizes, reverse=True):
            fitting = [r for r in room if r >= s]
            if fitting:
                room.remove(min(fitting))
            room.append((min(fitting) if fitting else limit) - s)
        assert sorted(limit - sum(sizes[i] for i in r) for r in rows) == sorted(room)


def test_packing_round_trip(make, texts, tmp_path, spark):
    rows = [*list(texts.items())[:60], (900, None), (901, ""), (902, "word " * 3000), (902, "word")]
    docs = make(rows, extra=("row_id", "ids"))
    encoding = byte_encoding()
    wanted = {}
    for i, t in rows[:-1]:
        wanted[i] = encoding.encode_ordinary(t or "")
    packed = packing.pack_documents(docs.where("NOT (doc_id = 902 AND text = 'word')"), length=256, lot=5000).collect()
    found: dict = {}
    for r in packed:
        assert len(r.ids) == len(r.positions) == 256 and r.cu_seqlens[0] == 0
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False)):
            assert r.positions[a:b] == list(range(b - a))
            assert found.setdefault(r.doc_ids[k], {}).setdefault(r.pieces[k], r.ids[a:b]) == r.ids[a:b]
        assert set(r.ids[r.cu_seqlens[-1] :]) <= {packing.END_OF_DOCUMENT}
    assert {k: sum((v[i] for i in sorted(v)), []) for k, v in found.items()} == {k: v for k, v in wanted.items() if v}
    packing.write_packed(docs, str(tmp_path / "packed"), length=128)
    matrix = spark.read.parquet(str(tmp_path / "packed")).first()
    ids = np.frombuffer(matrix.ids, dtype="<i4").reshape(matrix.n_rows, matrix.length)
    assert [e[-1] for e in matrix.cu_seqlens] == [int(r.n_ids) for r in packing.packing_digest(docs, length=128).orderBy("row_id").limit(len(ids)).collect()]
    assert packing.pack_documents(make([])).count() == 0


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 18])
def test_counts(make, block_bytes):
    rows = [(1, "a few words"), (2, None), (3, ""), (4, "more " * 50), (5, "end"), (5, "again again")]
    encoding = byte_encoding()
    found = tc.count_tokens(tc.flat_token_blocks(make(rows), block_bytes=block_bytes)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in found) == sorted((i, len(encoding.encode_ordinary(t or ""))) for i, t in rows)


@pytest.mark.parametrize("block_bytes", [2, 4, 10, 1000])
def test_counts_of_files(spark, tmp_path, block_bytes):
    rng = random.Random(block_bytes)
    wanted = {}
    for f in range(3):
        ids = [rng.choice([7, 7, 8, 0]) for _ in range(rng.randrange(1, 60))]
        np.array(ids, dtype="<u2").tofile(tmp_path / f"{f}.bin")
        counts = [len(x) for x in "".join("|" if i == 0 else "x" for i in ids).split("|")]
        wanted |= {(f"{f}.bin", n): c for n, c in enumerate(counts if counts[-1] else counts[:-1])}
    (tmp_path / "3.bin").write_bytes(b"")
    for whole in (False, True):
        found = tc.count_tokens(tc.read_flat_files(spark, str(tmp_path), block_bytes=block_bytes, whole=whole), end=0).collect()
        assert {(r.file.split("/")[-1], r.ordinal): r.n_tokens for r in found} == wanted


def test_counts_of_one_file_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tc, "SPAN_BYTES", 64)
    ids = np.random.default_rng(1).integers(0, 40, 5000).astype("<u2")
    ids.tofile(tmp_path / "one.bin")
    blocks = tc.read_flat_files(spark, str(tmp_path), block_bytes=32)
    assert blocks.rdd.getNumPartitions() > 100 and sorted(r.block for r in blocks.collect()) == list(range(-(-10000 // 32)))
    ends = np.flatnonzero(ids == 0)
    wanted = [*(np.diff(ends, prepend=-1) - 1).tolist(), *([len(ids) - 1 - int(ends[-1])] if ends[-1] < len(ids) - 1 else [])]
    assert [r.n_tokens for r in tc.count_tokens(blocks, end=0).orderBy("ordinal").collect()] == wanted


def test_counts_odd_tables(make):
    rows = [(1, "some words"), (None, "x"), (3, None)]
    found = tc.count_tokens(tc.flat_token_blocks(make(rows, extra=("file", "block", "payload", "doc_ids")))).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 1), (1, 2), (3, 0)]
    assert tc.count_tokens(tc.flat_token_blocks(make([]))).count() == 0


def test_packing_fill(texts):
    """Packing lot by lot fills rows nearly as well as one pass over everything."""
    encoding = byte_encoding()
    sizes = [n for t in texts.values() for n in [len(encoding.encode_ordinary(t or ""))] for n in [*[256] * (n // 256), n % 256] if n]
    rows = lambda part: len(packing.best_fit_decreasing(part, 256))
    lots = [sizes[i : i + 400] for i in range(0, len(sizes), 400)]
    assert rows(sizes) <= sum(map(rows, lots)) <= 1.02 * rows(sizes)
    assert sum(sizes) / (256 * sum(map(rows, lots))) > 0.95


def fill(sizes, weights, share=1.5, epochs=2.0):
    """Water-filling by repeated clamping."""
    total, full, target = share * sum(sizes), set(), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(epochs * sizes[i] for i in full)
        target = {i: epochs * sizes[i] for i in full} | {i: left * weights[i] / sum(weights[j] for j in rest) for i in rest}
        above = {i for i in rest if target[i] > epochs * sizes[i] * (1 + 1e-12)}
        if not above:
            return [target[i] for i in range(len(sizes))]
        full |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 5, 50, 700, 9000]) for _ in range(rng.randrange(2, 9))]
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    found = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
    for name, want in zip(names, fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]), strict=True):
        assert found[name] == pytest.approx(want)


def test_mix(make, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 60), None, rng.choice(["b", "a", "a", "a", None, "\U0001f642"])) for i in range(600)] + [(700, None, None, "a"), (701, "", None, "empty"), (702, "x", None, ""), (5, "w w", None, "a")]
    docs = make(rows, extra=("bucket", "taken"))
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows) and sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    for source in {r.source for r in found}:
        part = [r for r in found if r.source == source]
        assert sum(r.size for r in part) == part[0].source_size
        assert abs(sum(r.taken for r in part) - part[0].target) <= max((r.size for r in part), default=0)
        assert all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in part)
    repeated = mixing.repeat_documents(docs.where("doc_id <> 5"))
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r.repeats for r in mixing.mix(docs.where("doc_id <> 5")).collect())
    twice = mixing.repeat_documents(docs.where("doc_id = 5 OR source = 'b'"))
    assert {r.doc_id for r in twice.collect()} <= {r.doc_id for r in docs.collect()}
    long = mixing.mix(make([(1, "w " * 2_000_000, None, "a"), (2, "w", None, "a")])).orderBy("doc_id").collect()
    assert [r.size for r in long] == [2_000_000, 1] and all(r.taken <= 2 * r.size for r in long)
    wanted = sorted(map(str, mixing.repeat_documents(docs).collect()))
    monkeypatch.setattr(mixing, "LIMITS", 0)
    assert sorted(map(str, mixing.repeat_documents(docs).collect())) == wanted
    assert mixing.mix(make([])).count() == 0 and mixing.repeat_documents(make([])).count() == 0


@pytest.mark.parametrize("merges", [1, 2, 4])
def test_dropout_varies_for_each_occurrence(texts, merges):
    """A short unit whose first candidates are skipped for a share of its occurrences varies, however often it comes up."""
    encoder, plain = sp.Encoder(sp.load_pieces()), sp.Encoder(sp.load_pieces(), dropout=0.0)
    words = sorted({w for t in list(texts.values())[:40] for w in (t or "").split() if w.isalpha()})
    words = [w for w in words if len(w) + 1 - len(plain.encode(w)) == merges][:6]
    assert len(words) == 6
    for word in words:
        text = " ".join([word] * 4000)
        found = encoder.encode(text, 5)
        assert encoder.decode(found) == text and found != encoder.encode(text, 6)
        assert set(found) - set(plain.encode(word)), word


def test_dropout_does_not_depend_on_memory(texts, monkeypatch):
    some = [t for t in texts.values() if t][:30] + ["y" * 70 + " y"]
    encoder = sp.Encoder(sp.load_pieces())
    wanted = [encoder.encode(t, i) for i, t in enumerate(some * 2)]
    assert len(encoder.known) > 50
    monkeypatch.setattr(sp, "REMEMBERED", 50)
    other = sp.Encoder(sp.load_pieces())
    assert [other.encode(t, i) for i, t in enumerate(some * 2)] == wanted
    ids, starts = other.encode_lot([*some, None], [*range(len(some)), 7])
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [*wanted[: len(some)], []]


def test_encoding_holds_little_at_a_time():
    """What a lot of many texts takes beside the encoder, as a peak: units are numbered text by text."""
    encoder = sp.Encoder(sp.load_pieces())
    texts = [f"a b c d e f g h {i % 9} " * 100 for i in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(texts)], ["doc_id", "text"])
    encoder.encode_lot(texts[:9], list(range(9)))
    tracemalloc.start()
    rows = 0
    for lot in sp._lots([batch]):
        rows += len(encoder.encode_lot(lot.column("text").to_pylist(), lot.column("doc_id").to_pylist())[1]) - 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 800 and peak < 40_000_000


def test_counts_by_files(spark, make, tmp_path, monkeypatch):
    """Files written, read by ranges and removed: nulls, repeated rows, long texts, many spans of a file, and an empty table."""
    folders = []
    monkeypatch.setattr(tc, "shared_folder", lambda spark, name: folders.append(str(tmp_path / name)) or folders[-1])
    monkeypatch.setattr(tc, "SPAN_BYTES", 4096)
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y"), (4, "ein wort " * 20000), *((10 + i, t) for i, t in enumerate(random_texts(8)))]
    encoding = byte_encoding()
    for parts in (1, 3):
        docs = make(rows, extra=("file", "block", "n_tokens")).repartition(parts)
        found = sorted(((r.doc_id, r.n_tokens) for r in tc.count_by_files(docs, block_bytes=512).collect()), key=str)
        assert found == sorted(((i, len(encoding.encode_ordinary(t or ""))) for i, t in rows), key=str)
        assert not (tmp_path / "token-files").exists()
    assert tc.count_by_files(make([])).count() == 0


def test_flat_files_hold_the_ids(spark, make, tmp_path):
    rows = [(i, t) for i, t in enumerate(random_texts(9, 50))]
    listed = tc.write_flat_files(make(rows).repartition(2), f"file:{tmp_path}/ids", block_bytes=256).collect()
    encoding, end = byte_encoding(), [tc.END_OF_DOCUMENT]
    wanted = {i: encoding.encode_ordinary(t) for i, t in rows}
    for file in {r.file for r in listed}:
        own = sorted((r for r in listed if r.file == file), key=lambda r: r.block)
        ids = np.fromfile(file.removeprefix("file:"), dtype="<u2").tolist()
        assert ids == sum((wanted[d] + end for r in own for d in r.doc_ids), []) and sum(r.length for r in own) == 2 * len(ids)
