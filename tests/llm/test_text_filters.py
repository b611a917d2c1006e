"""Quality rules, fingerprints, quality classifier, language, personal data."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD, documents, words

from vspark.llm import fingerprint as FP
from vspark.llm import language as L
from vspark.llm import pii
from vspark.llm import quality_classifier as QC
from vspark.llm import quality_rules as QR

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_features(text):
    text = text or ""
    ws = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    marked = {i + k for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for k in range(8)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_base_features_against_the_definition():
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "a b c d e f g h i ", "x\n", "\n", "é# ", " ", "\x1c", "<|>", "\t", "w" + str(rng.randint(0, 3)) + " "]) for _ in range(rng.randint(0, 60)))
        assert QR.base_features(text) == slow_features(text)
    assert QR.base_features(None) == (0, 0, 0, 0, 0)


def test_divergence():
    p, q = np.array([1.0, 3, 0]), np.array([[1.0, 3, 0], [0, 0, 5], [0, 0, 0]])
    assert QR.js_distances(p, q) == pytest.approx([0, 1, 1])
    assert QR.js_distances(np.zeros(3), q) == pytest.approx([1, 1, 1])


ENGLISH = "the of and to in is it that was for on with as be this".split()


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(ENGLISH) if rng.random() < 0.4 else "".join(rng.choice(["er", "on", "th", "al", "in", "st"]) for _ in range(rng.randint(2, 4))) for _ in range(n))


def test_rules(spark):
    good = [(i, prose(i), "en", "s") for i in range(30)]
    bad = [(100, prose(100).upper().replace(" ", "!! "), "en", "s"), (101, prose(101).replace(" ", "### "), "en", "s"), (102, "the same words " * 50, "en", "s"), (103, "few words", "en", "s")]
    got = {r.doc_id: r for r in QR.apply_rules(documents(spark, good + bad, extra=True)).collect()}
    assert all(got[i].kept for i in range(30)) and not any(got[i].kept for i in range(100, 104))
    assert got[102].base_failed and got[103].base_failed and not got[100].base_failed
    odd = QR.apply_rules(documents(spark, ODD)).collect()
    assert len(odd) == len(ODD) and not any(r.kept for r in odd)
    assert QR.apply_rules(documents(spark, ODD).filter("false")).collect() == []


def test_fingerprints_are_multiset_sums():
    a, b = FP.lanes("one\ntwo\n\none"), FP.lanes("one\n\none\ntwo")
    assert np.array_equal(a, b) and not np.array_equal(a, FP.lanes("one\ntwo\n"))
    assert np.array_equal(FP.insert(FP.lanes("x\ny"), "z z"), FP.lanes("z z\nx\ny")) and np.array_equal(FP.delete(a, "two"), FP.lanes("one\n\none"))
    assert np.array_equal(FP.unpack(FP.pack(a)), a)
    text = words(1, 400)
    assert FP.likeness(FP.lanes(text), FP.lanes(text)) == 1 and FP.likeness(FP.lanes(text), FP.lanes(words(2, 400))) < 0.3
    half = text[: len(text) * 3 // 4] + words(3, 400)[: len(text) // 4]
    assert 0.6 < FP.likeness(FP.lanes(text), FP.lanes(half)) < 0.9
    assert FP.likeness(FP.lanes("ab " * 900), FP.lanes("ab " * 900 + "cd " * 300)) > 0.7


@pytest.mark.parametrize("n", [1, 2, 57])
def test_edited_texts(spark, n):
    rng = random.Random(n)
    rows = [(i * 3 - 20, rng.choice(["", None, "é", "abcd", words(i, 20)]), "en", "s") for i in range(n)]
    got = {r.doc_id: r for r in FP.edited_fingerprints(documents(spark, rows, extra=True).repartition(5)).collect()}
    assert len(got) == n
    for i, (d, t, *_) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % n][1] or ""
        k = len(t) // 4
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()
        assert got[d].fingerprint == FP.pack(FP.lanes(t)) and 0 <= got[d].near_next <= 1


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(FP, "ROWS_A_PART", 5)
    rows = [(i * i, f"t{i}", "en", "s") for i in range(83)]
    got = {r.doc_id: r.next_text for r in FP.with_next_text(documents(spark, rows).repartition(7)).collect()}
    assert got == {i * i: f"t{(i + 1) % 83}" for i in range(83)}


def test_fingerprints_of_odd_rows(spark):
    assert len(FP.edited_fingerprints(documents(spark, ODD)).collect()) == len(ODD)
    assert FP.edited_fingerprints(documents(spark, ODD).filter("false")).collect() == []
    assert FP.fingerprint_texts(documents(spark, ODD)).filter("fingerprint is null").count() == 0


def test_quality_is_learned_from_labels(spark):
    rows = [(i, prose(i) if i % 3 else prose(i).replace(" ", " | "), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(9999, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    model = QC.fit_quality(docs, labels)
    got = QC.score_quality(docs, model).collect()
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in got]) > 0.98 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    odd = QC.score_quality(documents(spark, ODD, extra=True), model).collect()
    assert len(odd) == len(ODD)
    assert QC.fit_quality(docs, labels.filter("quality = 1")) is None and {r.score for r in QC.score_quality(documents(spark, ODD), None).collect()} == {0.5}


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"]
    table = L.Pieces(pieces)
    p = np.random.default_rng(0).random((len(pieces) + 2, 2))
    p[table.none] = 0

    def brute(word, g):
        index = {x: i for i, x in enumerate(pieces)}

        def rest(i):
            if i == len(word):
                return 1.0
            total = 0.0 if word[i] in index else p[table.missing, g] * rest(i + 1)
            return total + sum(p[index[word[i : i + k]], g] * rest(i + k) for k in range(1, 9) if i + k <= len(word) and word[i : i + k] in index)

        return np.log(rest(0))

    for word in ("a", "ab", "abab", "abxba", "ba" * 20):
        ((_, codes),) = L.by_length([word])
        logs = L.forward(table.lattice(codes), p)[1][0]
        if len(word) < 12:
            assert logs == pytest.approx([brute("▁" + word, g) for g in (0, 1)])
        assert np.isfinite(logs).all()


def test_expectation_maximisation_does_not_lower_the_likelihood(monkeypatch):
    monkeypatch.setattr(L, "SMOOTH", 1e-9)
    ws = ["der", "die", "und", "haus", "the", "and", "house"]
    counts = np.array([[5, 0], [4, 0], [6, 0], [1, 0], [0, 7], [0, 6], [0, 2]], float)
    table = L.Pieces(L.read_pieces(PIECES))
    total = []
    for rounds in (0, 1, 3):
        p = L.train(ws, counts, table, rounds)
        total.append(sum((L.forward(table.lattice(c), p)[1] * counts[at]).sum() for at, c in L.by_length(ws)))
    assert total[0] <= total[1] + 1e-6 <= total[2] + 2e-6


def test_languages(spark):
    rng = random.Random(0)
    stock = {"de": "der die und ist nicht ein haus strasse gehen".split(), "en": "the and is not a house street walking".split(), "fr": "le la et est pas une maison rue marcher".split()}
    rows = [(i, " ".join(rng.choice(stock[g]) for _ in range(30)), g, "s") for i, g in enumerate(["de", "en", "fr"] * 40)]
    docs = documents(spark, rows, extra=True)
    model = L.fit_languages(docs.filter("doc_id < 90"), PIECES)
    got = {r.doc_id: r for r in L.predict_languages(docs, model).collect()}
    assert all(got[i].lang_pred == g for i, _, g, _ in rows) and all(0 <= r.score <= 1 for r in got.values())
    odd = {r.doc_id: r.lang_pred for r in L.predict_languages(documents(spark, ODD + [(8, "123 !? ²", "en", "s")]), model).collect()}
    assert {odd[i] for i in (1, 2, 3, 8)} == {"und"} and odd[7] != "und"
    none = L.fit_languages(docs.filter("false"), PIECES)
    assert {r.lang_pred for r in L.predict_languages(documents(spark, ODD), none).collect()} == {"und"}
    assert L.predict_languages(docs.filter("false"), model).collect() == []


def slow_spans(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_against_the_expressions():
    rng = random.Random(0)
    parts = ["a", "b.c", "@", ".", "x@y.zz", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "(", ")", " ", "é", "7", "12345678901234567890", "-", "a@b", "%", "1.2.3.4.5.6.7.8", "001.002.003.004"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == slow_spans(text), text


def test_checksums_context_and_redaction():
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001") and pii.luhn("4111111111111111")
    text = 'IBAN DE89 3704 0044 0532 0130 00, SSN 123-45-6789 (social security), plain 123-45-6789, token = "ab12cd34ef56ab12cd34", mail a.b@c.example.com'
    kinds = Counter(s[2] for s in pii.find_spans(text)[1])
    assert kinds["iban"] == 1 and kinds["secret"] == 1 and kinds["email"] == 1 and kinds["ssn"] >= 1
    assert "a.b@c" not in pii.redact(text, pii.find_spans(text)[1]) and "<EMAIL>" in pii.redact(text, pii.find_spans(text)[1])
    assert pii.find_spans("order 123-45-6789 part")[1] == []
    for long in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 100_000):
        pii.find_spans(long)


def test_pii_tables(spark):
    got = {r.doc_id: r for r in pii.find_pii(documents(spark, ODD + [(9, "x 1.2.3.4 y", "en", "s")], extra=True)).collect()}
    assert got[9].spans == "ip:2:9" and got[9].n_ip == 1 and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    docs = documents(spark, ODD + [(9, "x 1.2.3.4 y", "en", "s")], extra=True)
    out = pii.redact_pii(docs)
    r = out.filter("doc_id = 9").first()
    assert out.columns == docs.columns and (r.text, r.n_chars) == ("x <IP> y", 8) and out.count() == len(ODD) + 1
    assert pii.find_pii(docs.filter("false")).collect() == []


@pytest.mark.parametrize(
    ("text", "found"),
    [("please pay invoice 7 to DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]), ("order, part, example: DE89370400440532013000.", ["DE89370400440532013000"])]
    + [(f"to {i} {w} x", [i]) for i in ("ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "NO93 8601 1117 947") for w in ("EUR", "BIC", "250", "SWIFT", "BANK", "ZZ12", "1")]
    + [("ES91 2100 0418 4502 0005 1332 DE89 3704 0044 0532 0130 00", ["ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00"]), ("REFS AB12 3456 7890 AT61 1904 3002 3457 3201 EUR", ["AT61 1904 3002 3457 3201"]), ("DE89 3704 0044 0532 0130 01 EUR", []), ("ES9121000418450200051332Q", [])],
)
def test_ibans_among_words(text, found):
    assert [text[a:b] for a, b, k, _ in pii.find_spans(text)[1] if k == "iban"] == found


def test_time_of_ibans_is_linear():
    import time

    for text in ("AB12 " * 100_000, "AB12" * 100_000, "DE89 3704 0044 0532 0130 01 " * 20_000):
        began = time.time()
        pii.find_spans(text)
        assert time.time() - began < 20


@pytest.mark.parametrize("n", [16, 512, 513, 100_000])
def test_secrets_of_any_length(n):
    key = ("ab12" * n)[:n]
    text = f"token = {key} end"
    assert pii.redact(text, pii.find_spans(text)[1]) == "token = <SECRET> end"


def test_rules_of_other_languages(spark):
    rng = random.Random(1)
    stock = {"ru": ("и в не на я что он с как это по но они к у".split(), "ра но ст ов ен ка".split()), "zh": ("的 是 在 了 和 有 我 不 这 他".split(), "中 国 人 大 学 生".split())}

    def text(lang):
        common, parts = stock[lang]
        return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(120))

    rows = [(i, prose(i), "en", "s") for i in range(20)] + [(100 + i, text("ru"), "ru", "s") for i in range(20)] + [(200 + i, text("zh"), "zh", "s") for i in range(20)]
    rows += [(300, text("ru").replace(" ", " ### "), "ru", "s"), (301, prose(301).replace(" ", "### "), "en", "s"), (302, prose(302).upper().replace(" ", "!! "), None, "s"), (303, text("ru"), None, "s"), (304, " ".join(f"q{rng.random():.9f}"[2:].translate(str.maketrans("0123456789", "qwzxvkjpbg")) for _ in range(120)), "en", "s")]
    docs = documents(spark, rows, extra=True)
    references = QR.language_references(docs)
    assert set(references) == {"en", "ru", "zh"} and set(stock["ru"][0]) < set(references["ru"][2])
    kept = {r.doc_id: r.kept for r in QR.apply_rules(docs).collect()}
    assert all(kept[i] for i in kept if i < 300 or i == 303) and not any(kept[i] for i in (300, 301, 302, 304))
    only = {k: r for k, r in references.items() if k == "en"}
    got = {r.doc_id: r.kept for r in QR.apply_rules(docs, only).collect()}
    assert all(got[i] for i in range(300) if i in got) and not got[301]


def slow_spans(text):
    """All spans by the definitions, each proposal held against each base span."""
    base = pii.base_spans(text)
    kept = [(a, b, k) for a, b, k in base]
    for m in re.finditer(r"(?i:token|secret|api[_-]?key|password|passwd|pwd)[ \t]{0,4}[=:][ \t]{0,4}[\"']?([A-Za-z0-9+/_-]{16,})", text):
        if pii.score(text, *m.span(1), "secret", any(c.isdigit() for c in m[1])) >= pii.THRESHOLD:
            kept.append((*m.span(1), "secret"))
    for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text):
        a, b, c = m[0].split("-")
        if a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000" and pii.score(text, *m.span(), "ssn", False) >= pii.THRESHOLD:
            kept.append((*m.span(), "ssn"))
    for m in re.finditer(r"(?<![A-Za-z0-9])DE[0-9]{2}(?: ?[0-9]{4}){4} ?[0-9]{2}(?![A-Za-z0-9])", text):
        digits = m[0].replace(" ", "")
        if int(digits[4:] + "1314" + digits[2:4]) % 97 == 1:
            kept.append((*m.span(), "iban"))
    return sorted((s for s in kept if s in base or not any(a <= s[0] and s[1] <= b for a, b, _ in base)), key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_added_spans_against_the_definitions():
    rng = random.Random(5)
    pieces = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013001", "DE12 500", "123-45-6789", "social security 078-05-1120", "666-45-6789", "token = 0123456789abcdef", "password: abcdefghijklmnop", "api_key='a1" + "b" * 40 + "'", "token=" + "9" * 16, "a@b.co", "10.0.0.1", "4111111111111111", "+1 415 555 2671", "order", "ssn", "\n", "x", ", "]
    seen = Counter()
    for _ in range(500):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))
        got = [s[:3] for s in pii.find_spans(text)[1]]
        assert got == slow_spans(text), text
        seen.update(k for _, _, k in got)
    assert set(seen) == set(pii.KINDS)


def test_time_of_alternating_spans_is_linear():
    import time

    for text in ("a@b.co token = 0123456789abcdef " * 20_000, "10.0.0.1 123-45-6789 ssn " * 20_000):
        began = time.time()
        pii.find_spans(text)
        assert time.time() - began < 20
    assert pii.find_spans("") == ([], [])


def test_pii_of_empty_tables(spark):
    none = documents(spark, ODD, extra=True).filter("false")
    assert pii.find_pii(none).collect() == [] and pii.redact_pii(none).collect() == []


def test_long_words_are_trained_on_and_scored_whole(monkeypatch):
    table = L.Pieces(["▁", "a", "b", "ab", "▁a", "ba", "aba", "bababababababababa"])
    rng = np.random.default_rng(4)
    p = rng.random((len(table.pieces) + 2, 2))
    p[table.none] = 0
    p /= p.sum(axis=0)

    def slow(codes):
        """Forward sums by position in logarithms, without scales or blocks."""
        word = "".join(map(chr, codes))
        index = {x: i for i, x in enumerate(table.pieces)}
        logs = np.full((len(word) + 1, 2), -np.inf)
        logs[0] = 0
        for i in range(1, len(word) + 1):
            for j in range(max(0, i - table.longest), i):
                k = index.get(word[j:i], table.missing if i - j == 1 else None)
                if k is not None:
                    logs[i] = np.logaddexp(logs[i], logs[j] + np.log(p[k]))
        return logs[-1]

    monkeypatch.setattr(L, "BLOCK", 50)
    ws = ["".join(rng.choice(list("abx"), n)) for n in (1, 17, 49, 50, 51, 120, 333)]
    for _, codes in L.by_length(ws):
        expected = [slow(c) for c in codes]
        assert L.log_probabilities(codes, table, p) == pytest.approx(np.array(expected)) == L.forward(table.lattice(codes), p)[1]
    # One long run of words gives about what the words give by themselves, far below the smallest double.
    long = "".join(rng.choice(["ab", "ba", "aba"], 3_000))
    q = L.train([long], np.ones((1, 1)), table)
    assert np.isfinite(q).all() and q.sum() == pytest.approx(1) and q[table.pieces.index("x") if "x" in table.pieces else table.missing, 0] < 1e-3
    gain = [L.forward(table.lattice(codes), L.train([long], np.ones((1, 1)), table, r))[1][0, 0] for r in (0, 2, 4) for _, codes in L.by_length([long])]
    assert gain[0] <= gain[1] <= gain[2] + 1e-6


def test_many_languages_long_documents_and_all_pieces(spark):
    pieces = L.read_pieces(PIECES)
    assert max(map(len, pieces)) == 16
    rng = random.Random(2)
    tongues = {f"x{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(70)}
    rows = [(100 * k + i, " ".join(rng.choice(ws) for _ in range(40)), g, "s") for k, (g, ws) in enumerate(tongues.items()) for i in range(4)]
    rows += [(10_000 + i, "straßenbahnhaltestelle" * 1_500 + " ", "long", "s") for i in range(2)] + [(20_000, "123", "none", "s")]
    model = L.fit_languages(documents(spark, rows, extra=True), PIECES)
    assert model.languages == sorted([*tongues, "long", "none"]) and np.allclose(model.p.sum(axis=0), 1)
    got = {r.doc_id: r.lang_pred for r in L.predict_languages(documents(spark, rows), model).collect()}
    assert np.mean([got[i] == g for i, _, g, _ in rows[:-1]]) > 0.98 and got[20_000] == "und"


def test_languages_of_empty_tables(spark):
    none = documents(spark, ODD).filter("false")
    model = L.fit_languages(none, PIECES)
    assert model.languages == [] and L.predict_languages(none, model).collect() == []
    assert {r.lang_pred for r in L.predict_languages(documents(spark, ODD), model).collect()} == {"und"}


def test_kept_against_the_definition(spark):
    """References and verdicts by plain counting."""
    rng = random.Random(6)
    other = "le la et les des un une que est pour qui dans par sur pas au plus".split()
    french = lambda k: " ".join(rng.choice(other) if rng.random() < 0.4 else "".join(rng.choice(["eau", "oi", "ai", "ré", "ée"]) for _ in range(rng.randint(2, 4))) for _ in range(k))
    gibberish = lambda: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(200))
    rows = [(i, prose(i, rng.randint(10, 400)), "en", "s") for i in range(60)] + [(100 + i, french(rng.randint(10, 400)), "fr", "s") for i in range(40)]
    rows += [(200, gibberish(), "en", "s"), (201, gibberish(), "fr", "s"), (202, french(300), "en", "s"), (203, prose(203, 300), "fr", "s"), (204, prose(204, 300), "de", "s"), (205, prose(205, 300), None, "s"), (206, gibberish(), None, "s")]
    rows += [(207, " ".join(str(rng.random()) for _ in range(100)), "en", "s"), (208, prose(208, 100) + " 4111111111111111" * 3, "en", "s"), (209, prose(209).replace(" ", " #$ "), "en", "s"), (210, prose(210).upper(), "fr", "s")] + [(300 + k, *r[1:]) for k, r in enumerate(ODD)]
    kinds = {"Ll": 0, "Lu": 1, "Lt": 1}

    def chars(text):
        import unicodedata

        counts = [0] * QR.CLASSES
        for c in text or "":
            k = unicodedata.category(c)
            if c not in " \t\n\x0b\x0c\r":
                counts[5 if c in "#*$%&|<>!" else kinds.get(k, {"L": 2, "M": 2, "N": 3, "P": 4, "S": 5}.get(k[0], 6))] += 1
        counts[3] = max(0, counts[3] - 0.2 * sum(counts))
        return counts

    def folded(text):
        return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())

    def divergence(p, q):
        if not sum(p):
            return 1.0
        p, total = [x / sum(p) for x in p], 0.0
        for x, y in zip(p, q, strict=True):
            m = (x + y) / 2
            total += (x and x * np.log2(x / m)) + (y and y * np.log2(y / m))
        return max(0.0, total / 2) ** 0.5

    failed = {i: slow_features(t)[0] < 20 or 100 * slow_features(t)[4] > 30 * slow_features(t)[0] for i, t, *_ in rows if i is not None}
    references = {}
    for lang in {g for i, _, g, _ in rows if g and not failed[i]}:
        texts = [t for i, t, g, _ in rows if g == lang and not failed[i]]
        shares = [[round(1000 * c / max(1, sum(chars(t)))) for c in chars(t)] for t in texts]
        count = Counter(w for t in texts for w in folded(t))
        top = sorted(count, key=lambda w: (-count[w], w.encode()))[:32]
        medians = [sorted(x)[(len(x) - 1) // 2] / 1000 for x in zip(*shares, strict=True)]
        references[lang] = medians, top, [(count.total() - sum(count[w] for w in top)) / count.total()] + [count[w] / count.total() for w in top]

    def verdict(text, lang):
        n, size, _, _, repeated = slow_features(text)
        if n < 20 or 100 * repeated > 30 * n:
            return False
        near = []
        for medians, top, shares in [references[lang]] if lang in references else references.values() if lang is None else []:
            count = Counter(folded(text))
            own = [count[w] for w in top]
            by_chars = sum(medians) and divergence(chars(text), [m / sum(medians) for m in medians])
            by_words = divergence([count.total() - sum(own), *own], shares)
            near.append(not (size >= 100 and by_chars > 0.185) and not (n >= 70 and by_words > 0.08 + 2.7 / n**0.5))
        return any(near) if near else True

    docs = documents(spark, rows, extra=True)
    got = {r.doc_id: r.kept for r in QR.apply_rules(docs.repartition(5)).filter("doc_id is not null").collect()}
    assert got == {i: verdict(t, g) for i, t, g, _ in rows if i is not None}
    assert not any(got[i] for i in (200, 201, 202, 203, 206, 207, 209, 210)) and all(got[i] for i in (205, 208)) and sum(got.values()) > 80
    again = {r.doc_id: r.kept for r in QR.apply_rules(docs.repartition(2, "text")).filter("doc_id is not null").collect()}
    assert got == again


def test_quality_of_empty_tables_and_repeated_ids(spark):
    rows = [(i % 40, prose(i) if i % 2 else prose(i).replace(" ", " | "), "en", "s") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] * 3, "doc_id long, quality int, toxic int")
    docs = documents(spark, rows + rows)
    model = QC.fit_quality(docs, labels)
    got = QC.score_quality(docs, model).collect()
    assert len(got) == 160 and np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95
    assert QC.fit_quality(docs.filter("false"), labels) is None and QC.fit_quality(docs, labels.filter("false")) is None
    assert QC.score_quality(docs.filter("false"), model).collect() == []
    texts = docs.selectExpr("concat('id', doc_id) AS doc_id", "text")
    assert QC.fit_quality(texts, labels.selectExpr("concat('id', doc_id) AS doc_id", "quality")) is not None


def test_pairwise_fit_against_plain_descent():
    """The minimum of the pairs' logistic loss, found by gradient steps instead of Newton's."""
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0.5, 1, (60, 3)), rng.normal(-0.5, 1, (50, 3))
    model = QC.rank(good, bad, 0.4, pairs=500)
    draw = np.random.default_rng(QC.SEED)
    standard = lambda x: np.clip((x - model.mean) / model.spread, -8, 8)
    d = standard(good)[draw.integers(0, 60, 500)] - standard(bad)[draw.integers(0, 50, 500)]
    w = np.zeros(3)
    for _ in range(20_000):
        w += 0.1 * (d.T @ (1 / (1 + np.exp(d @ w))) / 500 - QC.RIDGE * w)
    assert model.weights == pytest.approx(w, abs=1e-4)
    below = np.concatenate([np.full(60, 0.6 / 60), np.full(50, 0.4 / 50)])[np.concatenate([model.raw(good), model.raw(bad)]) < model.cut].sum()
    assert abs(below - 0.4) <= 0.4 / 50 + 0.6 / 60


def test_quality_counts_all_labelled_documents_and_pairs(spark):
    """More documents of a label than 5,000 and more pairs than 60,000, against Newton steps over all pairs one by one."""
    marks = random.Random(4)
    rows = [(i, " ".join(marks.choice(("ab", "Cd", "e.", "f1", "|g")[: 5 if i % 120 == 0 or marks.random() < 0.1 else 4]) for _ in range(marks.randint(3, 12))), "en", "s") for i in range(7_200)]
    labels = spark.createDataFrame([(i, int(i % 120 > 0), 0) for i in range(7_200)], "doc_id long, quality int, toxic int")
    model = QC.fit_quality(documents(spark, rows).repartition(3), labels)
    learned = [(int(i % 120 > 0), QC.features(text)) for i, text, _, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    y, x = np.array([r[0] for r in learned]), np.array([r[1] for r in learned])
    assert (y == 1).sum() > 5_000
    assert model.mean == pytest.approx(x.mean(axis=0), abs=1e-9) and model.spread == pytest.approx(x.std(axis=0) + 1e-6, abs=1e-9)
    z = np.clip((x - model.mean) / model.spread, -8, 8)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    assert len(d) > 60_000
    w = np.zeros(z.shape[1])
    for _ in range(30):
        lost = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve((d * (lost * (1 - lost))[:, None]).T @ d / len(d) + QC.RIDGE * np.eye(len(w)), d.T @ lost / len(d) - QC.RIDGE * w)
    assert model.weights == pytest.approx(w, abs=1e-3)
    scores, bad = np.sort(model.raw(x)), (y == 0).sum()
    assert model.cut == pytest.approx((scores[bad - 1] + scores[bad]) / 2, abs=1e-9)


def test_quality_cut_of_ties_and_dealt_parts():
    """The cut is that of the sorted scores, and neither it nor the weights depend on how documents are dealt."""
    rng = np.random.default_rng(5)
    for n in range(4, 40):
        x, y = rng.integers(0, 4, (n, 2)).astype(float), np.arange(n) % 3 // 2
        whole = QC.fit(lambda part: [part([(x, y)])])  # noqa: B023
        parts = QC.fit(lambda part: [part([(x[k::3], y[k::3])]) for k in range(min(3, n))])  # noqa: B023
        scores, bad = np.sort(whole.raw(x)), (y == 0).sum()
        assert whole.cut == pytest.approx((scores[bad - 1] + scores[bad]) / 2, abs=1e-12)
        assert parts.weights == pytest.approx(whole.weights, abs=2e-9) and parts.cut == pytest.approx(whole.cut, abs=1e-7)


def test_next_texts_by_text_ids(spark, monkeypatch):
    monkeypatch.setattr(FP, "ROWS_A_PART", 3)
    names = sorted(f"d{i}\"x" for i in range(30))
    docs = spark.createDataFrame([(n, f"t{n}") for n in names] + [(None, "last")], "doc_id string, text string")
    got = {r.doc_id: r.next_text for r in FP.with_next_text(docs.repartition(4)).collect()}
    follows = [*names, None]
    assert got == {n: "last" if follows[k + 1] is None else f"t{follows[k + 1]}" for k, n in enumerate(names)} | {None: f"t{names[0]}"}
    assert FP.with_next_text(docs.filter("false")).collect() == []


def test_likenesses_against_the_sketches_definition(spark):
    """near_edited and near_next are the likeness of fingerprints that are made one by one."""
    rows = [(i, words(i, 30 + i) if i % 3 else words(i - i % 2, 40), "en", "s") for i in range(12)]
    got = {r.doc_id: r for r in FP.edited_fingerprints(documents(spark, rows)).collect()}
    for i, t, *_ in rows:
        after = rows[(i + 1) % 12][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[i].near_edited == FP.likeness(FP.lanes(t), FP.lanes(edited)) and got[i].near_next == FP.likeness(FP.lanes(t), FP.lanes(after))
        assert got[i].near_edited > 0.5 and np.array_equal(FP.unpack(got[i].edited_fingerprint), FP.lanes(edited))
