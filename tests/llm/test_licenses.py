import random

from millrace.llm import licenses as L
from millrace.llm.textvec import normalise


def longest(templates, tokens, i):
    """Length of the longest run ending at tokens[i] that a template holds."""
    n = 0
    while n <= i and any(any(t[k : k + n + 1] == tokens[i - n : i + 1] for k in range(len(t) - n)) for t in templates):
        n += 1
    return n


def test_matching_statistics_equal_brute_force():
    r = random.Random(8)
    for _ in range(40):
        templates = [[r.randrange(4) for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 5))]
        automaton = L.SuffixAutomaton()
        for k, t in enumerate(templates):
            automaton.add(t, k)
        automaton.finish()
        tokens = [r.randrange(5) for _ in range(60)]
        stats = automaton.statistics(tokens)
        assert [n for n, _ in stats] == [longest(templates, tokens, i) for i in range(60)]
        for i, (n, state) in enumerate(stats):
            if n:
                run = tokens[i - n + 1 : i + 1]
                want = {(k, e) for k, t in enumerate(templates) for e in range(n, len(t) + 1) if t[e - n : e] == run}
                assert set(automaton.places(state)) == want


def test_finds_notices_with_edits(docs_of):
    notice = "This project is licensed under the terms of the MIT license."
    edited = notice.replace("under the", "under all the")
    docs = docs_of([(1, f"Foo. {notice} Bar. {notice}"), (2, edited), (3, "the terms of the house"), (4, None), (5, ""), (None, notice)], extra=True)
    rows = L.scan_licenses(docs).collect()
    assert sum(r.doc_id == 1 for r in rows) == 2 and {r.doc_id for r in rows} == {1, 2, None}
    for r in rows:
        assert r.license == "MIT" and r.coverage >= L.MIN_COVERAGE
    assert L.scan_licenses(docs_of([])).count() == 0


def test_every_template_is_found_alone(docs_of):
    docs = docs_of([(k, f"Some text before. {t} And after.") for k, (_, t) in enumerate(L.TEMPLATES)])
    found = {r.doc_id: r for r in L.scan_licenses(docs).collect()}
    for k, (name, text) in enumerate(L.TEMPLATES):
        assert found[k].license == name
        whole = f"Some text before. {text} And after."
        assert normalise(whole[found[k].start_char : found[k].end_char]) == normalise(text)


def test_long_text_and_repeats(docs_of):
    text = "the license of the " * 100_000 + L.TEMPLATES[3][1]
    rows = L.scan_licenses(docs_of([(1, text), (1, text)])).collect()
    assert [r.license for r in rows] == ["Apache-2.0"] * 2


def test_full_texts_edited_wrapped_and_partial():
    scanner = L.Scanner(L.TEMPLATES)
    for name, text in L.TEXTS:
        words = text.split()
        edited = " ".join("edited" if i % 20 == 19 else w for i, w in enumerate(words))
        wrapped = "\n".join(" * " + " ".join(words[i : i + 7]) for i in range(0, len(words), 7))
        most, half = " ".join(words[: len(words) * 19 // 20]), " ".join(words[len(words) // 2 :])
        got = list(scanner.scan([f"Before. {t} zzz after." for t in (edited, wrapped, most, half)]))
        assert all(n == name for i, n, *_ in got if i < 3), (name, [g[:3] for g in got])
        assert {i for i, n, *_ in got if n == name} >= {0, 1, 2}, name
        whole = [g for g in got if g[0] == 1]
        assert len(whole) == 1 and whole[0][6] == 1
        assert not any(i == 3 and len(normalise(L.TEMPLATES[t][1]).split()) > len(words) * 3 // 4 for i, _, t, *_ in got)


def test_notice_that_a_full_text_continues():
    notice = "Licensed under the Apache License, Version 2.0."
    (span,) = L.Scanner(L.TEMPLATES).scan([f"{notice} The license you have."])
    assert span[1] == "Apache-2.0" and span[5] == 8


def test_candidates_lose_nothing(monkeypatch):
    r = random.Random(3)
    pieces = [w for _, t in r.sample(L.TEXTS, 8) if len(t) < 9000 for w in [t.split()]] + [t.split() for _, t in L.NOTICES]
    texts = []
    for _ in range(40):
        out = []
        for _ in range(r.randint(1, 3)):
            p = r.choice(pieces)
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            out += p[a:b] if r.random() < 0.4 else [w for w in p if r.random() > 0.03]
        texts.append(" ".join(out))
    scanner = L.Scanner(L.TEMPLATES)
    got = list(scanner.scan(texts))
    monkeypatch.setattr(scanner, "candidates", lambda runs: list(range(len(L.TEMPLATES))))
    scanner.least = 0
    assert got and list(scanner.scan(texts)) == got


def test_spdx_tags(docs_of):
    ids = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "BSD-3-Clause", "CC-BY-4.0"]
    docs = docs_of([(k, f"# SPDX-License-Identifier: {i}\nimport os\n") for k, i in enumerate(ids)] + [(90, "// SPDX-License-Identifier: LicenseRef-Own\nint x;"), (91, "SPDX-License-Identifier:")])
    assert {r.doc_id: r.license for r in L.scan_licenses(docs).collect()} == {k: i.removesuffix("-only").removesuffix("-or-later") for k, i in enumerate(ids)}


def test_chains_cover_as_much_as_any_subset():
    """Against every subset of the matches that advances in text and template with gaps of at most max_gap."""
    from itertools import combinations

    r = random.Random(10)
    scanner = L.Scanner([("T", " ".join(f"w{i}" for i in range(20)))], min_match=1, min_coverage=0.01, max_gap=4)
    for _ in range(150):
        runs = []
        for _ in range(r.randint(1, 6)):
            n = r.randint(1, 5)
            runs.append((0, r.randrange(25), r.randrange(20 - n + 1), n))

        def covered(chain):
            for (_, a, p, n), (_, b, q, m) in zip(chain, chain[1:]):
                if not (b >= a + n and q >= p + n and b - a - n <= 4 and q - p - n <= 4):
                    return 0
            return sum(n for *_, n in chain)

        ordered = sorted(set(runs), key=lambda x: (x[1], x[2]))
        best = max(covered(c) for k in range(1, len(ordered) + 1) for c in combinations(ordered, k))
        got = scanner.chains(sorted(set(runs)))
        assert got and max(c for *_, c in got) >= best, (runs, got, best)  # a chain may also take part of a match
