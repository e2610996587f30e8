"""Language identification, personal data and quality rules."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from plumbline.llm import language_id, pii, quality_crf as Q
from plumbline.llm.columns import first_by_hash
from plumbline.llm.quality_crf import LineModel


def test_language_accuracy(small):
    model = language_id.fit_centroids(small.where(~language_id.held_out()))
    rows = small.join(language_id.predict_languages(small, model), "doc_id").withColumn("out", language_id.held_out()).collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in out} == {r.doc_id for r in rows if r.out}
    assert sum(r.lang == r.lang_pred for r in out) / len(out) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_cases(make, small):
    model = language_id.fit_centroids(small)
    docs = make([(1, None), (2, ""), (3, "123 !?"), (4, "Это другой язык"), (5, "the and of that is " * 30000), (5, "the"), (None, "le la de et est")], extra=("lang_pred", "score"))
    found = [tuple(r) for r in language_id.predict_languages(docs, model).collect()]
    assert [r[1] for r in found[:3]] == ["und"] * 3 and all(r[3] for r in found[:4]) and found[3][1] != "und"
    assert found[4][1] == "en" and not found[4][3] and len(found) == 7
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5, 5]
    assert language_id.predict_languages(make([]), model).count() == 0
    nothing = language_id.fit_centroids(make([(1, None, "en"), (2, "text", None), (None, "text", "en")]))
    assert language_id.predict_languages(docs, nothing).first().lang_pred == "und"


def ngram_counts_by_hand(text):
    """The hashed n-grams counted one by one with Python's integers."""
    codes = [" "]
    for c in text.lower() + " ":
        c = c if "a" <= c <= "z" or ord(c) >= 128 else " "
        codes += [c] if c != " " or codes[-1] != " " else []
    counts, base = {}, 0
    for n, (size, multiplier) in enumerate(zip(language_id.DIMENSIONS, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)), 1):
        for i in range(len(codes) - n + 1):
            h = 0
            for c, m in zip(codes[i : i + n], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                h = (h ^ ord(c)) * m & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            at = base + ((h >> 16) & (size - 1))
            counts[at] = counts.get(at, 0) + 1
        base += size
    return counts


def test_language_fit_by_hand():
    """Centroids and predictions against dictionaries and plain loops."""
    rng = random.Random(8)
    kinds = {"x": "thering an of", "y": "der und schein", "z": "éla ou que"}
    make_text = lambda k: " ".join("".join(rng.sample(rng.choice(kinds[k].split()), 2)) for _ in range(rng.randrange(3, 30)))
    rows = sorted({(k, make_text(k)) for k in kinds for _ in range(16)})
    model = language_id.fit_texts(rows, centroids=2)
    kept = [r for k in kinds for i, r in enumerate([r for r in rows if r[0] == k], 1) if i % language_id.CALIBRATION]
    counted = [(k, ngram_counts_by_hand(t)) for k, t in kept]
    for (_, t), (_, c) in zip(kept, counted, strict=True):
        assert {i: n for i, n in enumerate(language_id.term_counts(t).tolist()) if n} == c
    idf = lambda i: math.log((1 + len(kept)) / (1 + sum(i in c for _, c in counted))) + 1

    def unit(v):
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {i: x / norm for i, x in v.items()}

    dot = lambda a, b: sum(x * b.get(i, 0.0) for i, x in a.items())
    vector = lambda c: unit({i: math.log1p(n) * idf(i) for i, n in c.items()})
    centers = []
    for k in sorted(kinds):
        vectors = [vector(c) for lang, c in counted if lang == k]
        second = min(range(len(vectors)), key=lambda i: dot(vectors[i], vectors[0]))
        pair = [vectors[0], vectors[second]]
        for _ in range(8):
            own = [max((0, 1), key=lambda j: (dot(v, pair[j]), -j)) for v in vectors]
            for j in (0, 1):
                total = {}
                for v, o in zip(vectors, own, strict=True):
                    for i, x in v.items() if o == j else ():
                        total[i] = total.get(i, 0.0) + x
                pair[j] = unit(total) if total else pair[j]
        centers += [(k, c) for c in pair]
    for k, t in rows:
        near = [(dot(vector(ngram_counts_by_hand(t)), c), lang) for lang, c in centers]
        found, score, _ = model.predict(t)
        assert abs(max(near)[0] - score) < 1e-3 and (found == max(near)[1] or sorted(near)[-1][0] - sorted(near)[-2][0] < 1e-3)


FOREIGN = [
    "De snelle bruine vos springt over de luie hond en daarna gaat hij slapen in het grote groene bos waar niemand hem kan vinden",
    "La volpe veloce marrone salta sopra il cane pigro e poi va a dormire nel grande bosco verde dove nessuno lo può trovare",
    "Szybki brązowy lis przeskakuje nad leniwym psem a potem idzie spać w wielkim zielonym lesie gdzie nikt nie może go znaleźć",
    "for(int i=0;i<n;++i){ if(x[i]>y) return foo(bar,baz); } while(true) { printf('%d', qq); } struct node *next = malloc(sizeof(struct node));",
    "xq zzk wvv qqj kkx jjq zxv qwk xxk vvz kqj zzx wqk jvx",
    "Это другой язык",
]


def test_language_rejection(make, small):
    """Foreign texts and letter soup go, nearly all documents and pieces of them stay."""
    model = language_id.fit_centroids(small.where(~language_id.held_out()))
    docs = small.select("doc_id", "text", "lang", "source", "n_chars").union(make([(10**6 + i, t) for i, t in enumerate(FOREIGN)]).select("doc_id", "text", "lang", "source", "n_chars"))
    kept = {r.doc_id for r in language_id.keep_identified(docs, model).select("doc_id").collect()}
    assert [t for i, t in enumerate(FOREIGN) if 10**6 + i in kept] == []
    assert len(kept) >= 0.998 * small.count()
    out = pieces = 0
    for r in small.where(language_id.held_out()).select("text").collect():
        words = (r.text or "").split()
        for n in (3, 6, 12, 24, 48, 96):
            if len(words) >= n and language_id.has_letter(piece := " ".join(words[len(words) // 3 :][:n])):
                pieces, out = pieces + 1, out + model.predict(piece)[2]
    assert out <= 0.005 * pieces, (out, pieces)


PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_brute(text):
    tests = [lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")), lambda m: 12 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15]
    return sorted(((*m.span(), k) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if tests[k](m[0])), key=lambda x: (x[0], x[2]))


def test_pii_base():
    rng = random.Random(1)
    for _ in range(8000):
        text = "".join(rng.choice("ab1234567890..@@--  +()_%\né") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == base_brute(text), text


def test_pii_base_on_documents(texts):
    for text in texts.values():
        assert pii.base_spans(text) == base_brute(text)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail bob [at] example [dot] com now", "email", "bob [at] example [dot] com"),
        ("jane at mail dot example dot org please", "email", "jane at mail dot example dot org"),
        ("call plus one five five five four one two three four five six.", "phone", "plus one five five five four one two three four five six"),
        ("аdmin@exаmple.com", "email", "аdmin@exаmple.com"),
        ("bo​b@exa​mple.com x", "email", "bo​b@exa​mple.com"),
        ("mail john[@]mail[.]com now", "email", "john[@]mail[.]com"),
        ("mail john&#64;mail.com now", "email", "john&#64;mail.com"),
        ("mail john&#x40;mail&#46;com now", "email", "john&#x40;mail&#46;com"),
        ("?to=john%40mail.com now", "email", "john%40mail.com"),
        ("mail user_at_mail_dot_com now", "email", "user_at_mail_dot_com"),
        ("mail user_at_mail_dot_example_dot_org!", "email", "user_at_mail_dot_example_dot_org"),
        ("host one dot two dot three dot four", "ip", "one dot two dot three dot four"),
        ("４" + "１" * 15 + " ok", "card", "４" + "１" * 15),
        ("vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "card", None),
    ],
)
def test_pii_disguises(text, kind, span):
    span = span or text
    (found,) = pii.added_spans(text, pii.base_spans(text))
    assert (pii.KINDS[found[2]], text[found[0] : found[1]]) == (kind, span)


def disguised(rng, kind):
    """An identifier of a kind in one of many disguises."""
    spell = {"0": "zero", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine"}
    look = {"a": "\u0430", "e": "\u0435", "o": "\u043e", "c": "\u0441", "p": "\u0440", **{str(d): chr(0xFF10 + d) for d in range(10)}}

    def masked(text):
        how = rng.randrange(3)
        if how == 0:
            return "".join(look.get(c, c) if rng.random() < 0.5 else c for c in text)
        return "".join(c + rng.choice(["\u200b", "\u00ad", "", ""]) for c in text[:-1]) + text[-1] if how == 1 else text

    def run(digits):
        words = set(rng.sample(range(len(digits)), rng.randrange(2, len(digits) + 1)))
        separator = rng.choice([" ", "-", ", "])
        return separator.join(spell[d] if i in words else d for i, d in enumerate(digits))

    if kind == "email":
        name = lambda n: "".join(rng.choice("abcdeopxyz") for _ in range(n))
        at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" at ", "."), (" [at] ", "."), ("@", " dot "), (" {at} ", "."), ("[@]", "[.]"), ("&#64;", "."), ("&#x40;", "&#46;"), ("%40", "."), ("_at_", "_dot_"), (" (@) ", " (.) "), ("@", ".")])
        text = f"{masked(name(5))}{at}{masked(name(6))}{dot}com"
        return text if (at, dot) != ("@", ".") else masked(text)
    if kind == "ip":
        parts = [str(rng.randrange(256)) for _ in range(4)]
        if rng.random() < 0.5:
            return ".".join(masked(p) for p in parts)
        return rng.choice([" dot ", " [dot] ", "."]).join(spell[str(rng.randrange(10))] for _ in range(4))
    if kind == "phone":
        return rng.choice(["plus ", "+"]) + run("".join(rng.choice("123456789") for _ in range(rng.randrange(9, 13))))
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return run(digits + next(d for d in "0123456789" if luhn(digits + d)))


@pytest.mark.parametrize("kind", pii.KINDS)
def test_pii_recall_of_disguises(kind):
    """Nearly every disguise of a generator is found with its exact span, and the same texts without the identifiers give nothing."""
    rng, found, total = random.Random(len(kind)), 0, 600
    for _ in range(total):
        before, after = rng.choice(["write to ", "(see: ", "\n", "contact | "]), rng.choice([" today", ")", "\nthanks", ", or not"])
        text = disguised(rng, kind)
        whole = before + text + after
        base = pii.base_spans(whole)
        found += (len(before), len(before) + len(text), pii.KINDS.index(kind)) in base + pii.added_spans(whole, base)
        assert not pii.added_spans(before + after, [])
    assert found / total >= 0.97, found / total


def test_pii_plain_underscores():
    """File names and words with signs in brackets are no identifiers."""
    for text in ("look_at_me.txt", "a_dot_b", "see [.] and [@] there", "100%40", "R&#38;D", "f(.)", "at_dot_at"):
        assert not pii.added_spans(text, pii.base_spans(text)), text


@pytest.mark.parametrize("text", ["a_at_b" * 100000, "[@" * 200000, "&#0000" * 200000, "&#" + "0" * 500000, "mail a [at] b [dot] com" + " " * 10**6 + "x", "[ " * 300000, " at" * 300000, "1.2." * 100000 + "one", "four " * 200000, "\t\n" * 400000 + "at x.com"], ids=range(10))
def test_pii_is_linear(text):
    began = time.process_time()
    pii.added_spans(text, pii.base_spans(text))
    assert time.process_time() - began < 60


def test_pii_table(make, texts):
    rows = [(1, None), (2, ""), (3, "a@b.c 1.2.3.4 x [at] y [dot] com \U0001f642"), (4, "plain words at home"), (3, "a@b.c"), (5, "9" * 200000), (None, "+1 (578) 555-6437")]
    found = [tuple(r) for r in pii.find_personal_data(make(rows, extra=("spans", "n_email"))).collect()]
    empty = hashlib.sha256(b"").hexdigest()
    assert found[0] == (1, 0, 0, 0, 0, empty, "", 0) and found[1][1:] == found[0][1:] and found[3][1:] == found[0][1:]
    assert found[2][1:5] == (1, 1, 0, 0) and found[2][6] == "email:0:5,ip:6:13,email:14:32" and found[2][7] == 1
    assert found[2][5] == hashlib.sha256(b"email:0:5,ip:6:13").hexdigest() and found[6][4] == 1
    masked = [r.text for r in pii.mask_personal_data(make(rows)).collect()]
    assert masked[2] == "<email> <ip> <email> \U0001f642" and masked[0] is None and masked[6] == "<phone>"
    assert pii.find_personal_data(make([])).count() == 0
    assert not any(pii.added_spans(t, pii.base_spans(t)) for t in texts.values())


def quality_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, t in enumerate(triples) if triples.count(t) > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_base(make, texts):
    rng = random.Random(2)
    rows = [(i, t[:6000]) for i, t in list(texts.items())[:60]] + [(900 + i, "".join(rng.choice(["a ", "b ", "c\n", "é  ", "# ", "\t", "\r\n", "| "]) for _ in range(rng.randrange(90)))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "a b c"), (1003, "x " * 3000), (1002, "a b c"), (None, "one two")]
    found = Q.score_quality(make(rows, extra=("kept", "n_words")), Q.DEFAULT).collect()
    assert len(found) == len(rows)
    for r, (_, text) in zip(found, rows, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_brute(text)
        assert not (r.base_failed and r.kept)
    assert Q.score_quality(make([]), Q.DEFAULT).count() == 0


def test_viterbi():
    rng = np.random.default_rng(5)
    for _ in range(50):
        model = LineModel(tuple(rng.normal(size=len(Q.FEATURES))), rng.normal(), tuple(map(tuple, rng.normal(size=(2, 2)))))
        lines = [tuple(x) for x in rng.normal(size=(rng.integers(1, 7), len(Q.FEATURES)))]

        def score(y):
            s = sum(np.dot(f, model.weights) for f, v in zip(lines, y, strict=True) if v)
            return s + (model.start if y[0] else 0) + sum(model.change[a][b] for a, b in itertools.pairwise(y))

        assert score(model.labels(lines)) == pytest.approx(max(score(y) for y in itertools.product((0, 1), repeat=len(lines))))


def test_quality_verdicts(spark, small, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = Q.fit_quality(small, labels)
    rows = Q.score_quality(small, model).join(labels, "doc_id").where("NOT base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) / len(rows) >= 0.95
    assert Q.fit_quality(small, labels.limit(0)) == Q.DEFAULT


def test_quality_mixed_documents(spark, small, sf_dir):
    """Navigation before and after prose: each line gets its own label, and the share of words decides."""
    model = Q.fit_quality(small, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    prose = [r.text for r in small.where("lang = 'en'").join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(30).collect()]
    prose = [x for t in prose for x in t.split("\n") if len(x.split()) > 30 and x.endswith(".")][:40]
    rng, right, total = random.Random(4), 0, 0
    assert len(prose) == 40
    for n_nav, n_prose in itertools.product((4, 12), (4, 12)):
        for _ in range(5):
            nav = [" | ".join("".join(rng.choice("aeioustrn") for _ in range(6)) for _ in range(rng.randrange(5, 30))) + " |" for _ in range(n_nav)]
            text, half = rng.sample(prose, n_prose), n_nav // 2
            lines = nav[:half] + text + nav[half:]
            wanted = [1] * half + [0] * n_prose + [1] * (n_nav - half)
            found = model.labels(Q._lines("\n".join(lines).encode())[0])
            right, total = right + sum(x == y for x, y in zip(found, wanted, strict=True)), total + len(wanted)
    assert right / total > 0.9, right / total
    rows = Q.score_quality(small, model).where("n_boilerplate > 0 AND n_boilerplate < n_lines").count()
    assert rows > 0.005 * small.count()


def test_quality_chain_decides(spark, small, sf_dir):
    """On documents put together from lines of good and bad ones, verdicts with the chain differ from those of the same lines each for itself."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    examples = Q.line_examples(small, labels)
    model = Q.fit_documents(examples)
    single = LineModel(model.weights, 0.0, ((0.0, 0.0), (0.0, 0.0)))
    rng = random.Random(8)
    good, bad = ([e for e in examples if e[2] == q and len(e[1]) > 3] for q in (1, 0))
    differ = 0
    for _ in range(300):
        (f, c, _), (g, d, _) = rng.choice(bad), rng.choice(good)
        i, j = rng.randrange(1, 8), rng.randrange(1, 8)
        lines, counts = [*f[:i], *g[:j], *f[i : i + 3]], [*c[:i], *d[:j], *c[i : i + 3]]
        shares = [sum(n for n, y in zip(counts, m.labels(lines), strict=True) if not y) / sum(counts) for m in (model, single)]
        differ += (shares[0] >= Q.CONTENT_SHARE) != (shares[1] >= Q.CONTENT_SHARE)
    assert differ > 3, differ


def test_quality_balance():
    assert Q.balance([[0, 0], [1, 1], [0, 1], [1]]) == [1.0, 1.0, 3.0, 1.0] and Q.balance([[0], [1]]) == [1.0, 1.0] and Q.balance([[0, 1]] * 3) == [1.0] * 3


@pytest.mark.parametrize("weights", [None, [3.0, 1.0, 1.0, 2.0, 1.0, 1.0]])
def test_quality_fit_by_brute_force(weights):
    """The gradient of the chain's likelihood vanishes where the fit ends, over all sequences of labels."""
    rng = np.random.default_rng(2)
    examples = [([(1.0, *rng.normal(size=len(Q.FEATURES) - 1))] * 1 + [(1.0, *rng.normal(size=len(Q.FEATURES) - 1)) for _ in range(n - 1)], rng.integers(0, 2, n).tolist()) for n in (1, 2, 3, 4, 5, 5)]

    def loss(model):
        def score(f, y):
            return sum(np.dot(x, model.weights) for x, v in zip(f, y, strict=True) if v) + model.start * y[0] + sum(model.change[a][b] for a, b in itertools.pairwise(y))

        value = sum(w * (score(f, y) - np.log(sum(np.exp(score(f, z)) for z in itertools.product((0, 1), repeat=len(y))))) for w, (f, y) in zip(weights or [1.0] * 6, examples, strict=True))
        params = [*model.weights, model.start, *model.change[0], *model.change[1]]
        return value / total - 0.05 * np.dot(params, params) / 2

    total = sum(w * len(y) for w, (_, y) in zip(weights or [1.0] * 6, examples, strict=True))
    model = Q.fit_lines(examples, weights=weights, rounds=800, ridge=0.05)
    best = loss(model)
    params = np.array([*model.weights, model.start, *model.change[0], *model.change[1]])
    for i in range(len(params)):
        for step in (-0.02, 0.02):
            p = params.copy()
            p[i] += step
            k = len(Q.FEATURES)
            assert loss(LineModel(tuple(p[:k]), p[k], ((p[k + 1], p[k + 2]), (p[k + 3], p[k + 4])))) <= best + 1e-7


def test_quality_refined_labels():
    model = LineModel((0.0, 1.0, *(0.0,) * 8), 0.0, ((0.0, 0.0), (0.0, 0.0)))
    lines = [(1.0, x, *(0.0,) * 8) for x in (2.0, -3.0, -0.5, 1.0)]
    assert model.labels(lines) == [1, 0, 0, 1]
    assert Q.refined_labels(model, lines, [10, 10, 10, 10], 0) == [1, 0, 1, 1]
    assert Q.refined_labels(model, lines, [10, 10, 10, 10], 1) == [1, 0, 0, 1]
    assert Q.refined_labels(model, lines, [30, 10, 10, 10], 1) == [1, 0, 0, 0]  # 30 of 60 words are content, which is the share
    assert Q.refined_labels(model, lines, [31, 10, 10, 10], 1) == [0, 0, 0, 0]


def test_quality_sample_is_bounded(make):
    long = make([(i, "line of words\n" * 5000) for i in range(3)] + [(1, "again")] * 50 + [(4, None), (None, "x")])
    labels = long.select("doc_id").distinct().withColumn("quality", F.lit(1)).union(make([(9, "")]).selectExpr("doc_id", "0"))
    examples = Q.line_examples(long, labels)
    assert len(examples) == 3 and all(len(c) <= Q.LINES and len(f) == len(c) and q == 1 for f, c, q in examples)


def test_language_letters_and_number(spark, make):
    """Signs that have a case but are no letters do not make a text; every language is learnt, however many there are."""
    assert not language_id.has_letter("Ⓐ ⅷ 12") and language_id.has_letter("ª") and language_id.has_letter("日")
    rows = [(i * 100 + k, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}{chr(0x6E00 + i)} " * (5 + k), f"l{i:03d}", None) for i in range(70) for k in range(4)]
    model = language_id.fit_centroids(make(rows))
    assert len(set(model.languages)) == 70 and model.predict(rows[-1][1])[0] == "l069"


def test_first_by_hash(spark):
    """The same rows as a window over everything gives, for a hot key, a rare one and ties."""
    ids = [(i, "hot") for i in range(3000)] + [(i, "rare") for i in range(5)] + [(7, "tie")] * 3
    rows = spark.createDataFrame(ids, "doc_id long, lang string")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    wanted = rows.withColumn("turn", F.row_number().over(order)).where("turn <= 40").select("doc_id", "lang")
    assert sorted(first_by_hash(rows, "lang", 40).collect()) == sorted(first_by_hash(rows, "lang", 40, most=None).collect()) == sorted(wanted.collect())
    assert not first_by_hash(rows.limit(0), "lang", 40).collect()


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("call plus 4 9 three zero 5 5 5 1 2 3 4", "phone", "plus 4 9 three zero 5 5 5 1 2 3 4"),
        ("host 10.zero.zero.one", "ip", "10.zero.zero.one"),
        ("(four one one one one one one one one one one one one one one one.)", "card", "four one one one one one one one one one one one one one one one"),
        ("jоhn.doe@example.com", "email", "jоhn.doe@example.com"),
        ("ring +49 30 555 12 three four now", "phone", "+49 30 555 12 three four"),
        ("host ১0.0.0.1", "ip", "১0.0.0.1"),
    ],
)
def test_pii_disguises_by_themselves(text, kind, span):
    found = pii.added_spans(text, pii.base_spans(text))
    assert [(pii.KINDS[k], text[s:e]) for s, e, k in found] == [(kind, span)]


def test_pii_containing_span_is_masked(make):
    (row,) = pii.mask_personal_data(make([(1, "to jоhn.doe@example.com now")])).collect()
    assert row.text == "to <email> now"


def test_pii_gate_lets_all_through():
    """No text that the normal form changes is passed over, whatever else is in it."""
    rng = random.Random(3)
    parts = ["[@]", "(.)", "&#64;", "&#x2E;", "%40", "_at_", "_dot_", "_", "&", "%", "&COMMAT;", "one", "(four", "six.", "7", "10", ".", "plus", "dot", "at", "a", "[at]", "(dot)", "zero", "+", "@", "x", ",", "-", "un", "Fünf", "\u201csix\u201d", "\u00a0", "_", "\t", "ONE", "zéro"]
    for _ in range(20000):
        text = rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(9)))
        hint, near = pii._gates(text)
        if pii._odd(text):  # always looked at
            continue
        assert pii.normal_form(text)[0] == text or pii._HINT.search(text), text
        assert hint or not pii._HINT.search(text), text
        assert near or not pii._NEAR.search(text), text


def test_pii_many_zeros():
    text = "0" * 5000 + ".0.0.1"
    assert (0, len(text), 1) in pii.base_spans(text)
