"""Tests of the findings of round 2."""

import random
from difflib import SequenceMatcher

import numpy as np

from lamplight.functions.likeness import Texts
from lamplight.llm import licenses
from lamplight.operators import audit, quotes, register, repetition, reports


def test_numbers_beyond_an_int_cite_no_chapter(spark):
    rows = spark.createDataFrame([("chapter 3", "Ch 3: 'de éch 7 ou ch 70.12 et ch 4964762769080830 le'", None), ("99999999999", "", "Ch 2: x")], "r string, e string, c string")
    got = [x[0] for x in rows.select(quotes.cited_chapters(*(rows[c] for c in "rec"))).collect()]
    assert got == [[3, 70], [2]]
    assert quotes.quote_parts("Ch 4964762769080830: so it was") == [(None, "so it was")]


def _said(rnd, n):
    made = []
    for i in range(n):
        words = ["".join(rnd.choices("abdeèß", k=rnd.randint(1, 6))) for _ in range(rnd.choice([2, 4, 9, 25, 70]))]
        if i % 3 == 0 and made:  # much like one before
            words = made[-rnd.randint(1, min(i, 25))].split()
            words[rnd.randrange(len(words))] = "Öde"
        made.append(" ".join(words))
    return made


def test_near_sentences_by_bounds_are_those_of_every_comparison(spark):
    rnd = random.Random(7)
    rows = [(k, i, t) for k in (1, 2, 3) for i, t in enumerate(_said(rnd, 120))]
    want = set()
    for k, i, t in rows:
        for j in range(max(0, i - 19), i):
            other = rows[(k - 1) * 120 + j][2]
            if len(t.split()) >= 4 and len(other.split()) >= 4 and (r := SequenceMatcher(None, other.lower(), t.lower()).ratio()) >= 0.7:
                want.add((k, j, i, round(r, 4), other, t))
    got = repetition.band_pairs(spark.createDataFrame(rows, "doc_id long, pos int, sentence string"), "doc_id", examples=True)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50


def test_common_subsequences_rule_out_what_letters_do_not():
    texts = Texts([("abc" * 40)[:n] + "zu" * m for n in (0, 1, 63, 64, 65, 120) for m in (0, 30, 90)] + ["ab" * 50 + "cd" * 50, "dc" * 50 + "ba" * 50, "x" * 300, "x" * 299 + "y"])
    last = len(texts.sizes)
    a, b = np.array([last - 4, last - 2, 0, 3]), np.array([last - 3, last - 1, 5, 4])
    assert texts.shared(a, b).tolist() == [200, 299, 0, 1]
    assert texts.common(a, b).tolist() == [99, 299, 0, 1]


def test_few_windows_pass_the_license_filter_by_chance(spark):
    hashes = [r.h for r in spark.range(15_000).selectExpr("xxhash64(id) AS h").collect()]
    windows = spark.range(200_000).selectExpr("id", "xxhash64(id) AS a", "xxhash64(-id - 1) AS b")
    passed = [r.id for r in licenses._suspected(windows, hashes).collect()]
    assert set(range(15_000)) <= set(passed) and len(passed) < 15_200
    assert licenses._suspected(windows, list(range(licenses.MOST_TEMPLATE_SHINGLES + 1))).count() == 200_000


def test_glosses_are_only_sought_where_a_sign_of_one_stands(monkeypatch):
    sought, search = [], register.regex.search
    monkeypatch.setattr(register.regex, "search", lambda *a, **k: sought.append(a) or search(*a, **k))
    plain = " ".join(f"The kel-dra{'a' * i} stood. It was so. Nobody spoke. They went." for i in range(40))
    told = plain + " The vex-ta (a tree) grew. It was KNOWN\nas sel-mo. Far off. No more. By then. A tor-fin means nothing."
    found = register.candidates(told)
    left = [key for _, _, key in register.untaught(found, told)]
    assert len(found) == 43 and left == [key for _, _, key in found[:40]]
    assert len(sought) < 20


def test_quotes_are_found_without_a_pattern_for_every_term(monkeypatch):
    assert reports.quote_around("set-kin", "No. A reset-kin, a ſet-kin.") == "A reset-kin, a ſet-kin."
    monkeypatch.setattr(reports.regex, "search", None)
    assert reports.quote_around("kel-dra", "No. A kel-draé, a KEL-DRA stood. Yes.") == "A kel-draé, a KEL-DRA stood."
    assert reports.quote_around("dra", "kel_dra drab") is None


def test_terms_of_one_word_are_joined_with_the_words_of_the_texts(spark):
    texts = spark.createDataFrame([("a", "The Vex-ta’s oru, oru² and çoru"), ("a", None), ("b", "vexta zel\u0301 zelda")], "manuscript string, content string")
    asked = [("a", "oru"), ("a", "vex"), ("a", "vex-ta"), ("a", "ex"), ("a", "vex-ta's"), ("b", "vex"), ("b", "zel"), ("b", "zelda"), ("b", "oru"), ("a", "oru")]
    found = audit.mentioned(texts, spark.createDataFrame(asked, "manuscript string, term string"))
    assert sorted(map(tuple, found.collect())) == [("a", "oru"), ("a", "vex"), ("a", "vex-ta"), ("a", "vex-ta's"), ("b", "zelda")]
    assert "left_semi" in str(found._jdf.queryExecution().optimizedPlan()).lower().replace("leftsemi", "left_semi")
