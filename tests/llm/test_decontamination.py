import random

import pytest

from millrace.llm import decontamination as D
from millrace.llm.textvec import normalise

ITEM = "What is the name of the river that runs by the old mill in the valley of stones and why"


@pytest.fixture(scope="module")
def bench(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id long, text string")

    return make


def brute(items, text, window=D.WINDOW, min_words=D.MIN_WORDS):
    """Item ids of which a run of window words stands in text."""
    have = normalise(text).split()
    found = set()
    for i, t in items:
        words = normalise(t).split()
        if len(words) < max(1, min_words):
            continue
        n = min(window, len(words))
        runs = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
        if any(tuple(have[k : k + n]) in runs for k in range(len(have) - n + 1)):
            found.add(i)
    return found


def test_offsets_point_to_the_original(docs_of, bench):
    text = f"Before…  “{ITEM.upper().replace(' ', '  -- ')}”! After."
    (row,) = D.find_leaks(docs_of([(7, text)]), bench([(3, ITEM)])).collect()
    assert (row.doc_id, row.item_id, row.words) == (7, 3, 20)
    assert text[row.start_char : row.end_char].startswith("WHAT") and text[row.start_char : row.end_char].endswith("WHY")


def test_offsets_with_characters_that_grow_or_shrink(docs_of, bench):
    item = "the ﬁrst oﬀer of the straße is café Ⅳ times the naïve one at all"
    text = "İ ﬃ é! " + item + " — end"
    (row,) = D.find_leaks(docs_of([(1, text)]), bench([(1, item)])).collect()
    assert text[row.start_char : row.end_char] == item


def test_against_brute_force(docs_of, bench, made_words):
    r = random.Random(5)
    vocabulary = made_words(9, 12)
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(3, 20)))) for k in range(30)]
    docs = []
    for i in range(120):
        ws = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            w = items[r.randrange(30)][1].split()
            a = r.randint(0, max(0, len(w) - 5))
            ws[5:5] = w[a : a + r.randint(4, 16)]
        docs.append((i, " ".join(ws)))
    got = {(x.doc_id, x.item_id) for x in D.find_leaks(docs_of(docs), bench(items), window=6).collect()}
    assert got == {(i, k) for i, t in docs for k in brute(items, t, 6)}
    parted = {(x.doc_id, x.item_id) for x in D.find_leaks(docs_of(docs), bench(items), window=6, max_chars=300).collect()}
    assert parted == got
    kept = {x.doc_id for x in D.drop_leaked(docs_of(docs), bench(items), window=6).collect()}
    assert kept == {i for i, t in docs if not brute(items, t, 6)}


def test_awkward_tables(docs_of, bench):
    docs = docs_of([(1, None), (2, ""), (None, ITEM), (3, ITEM), (3, ITEM)], extra=True)
    assert D.find_leaks(docs, bench([])).count() == 0
    assert D.drop_leaked(docs, bench([])).count() == 5
    items = bench([(1, ITEM), (2, ITEM), (None, ITEM), (4, None), (5, ""), (6, "too few words")])
    rows = D.find_leaks(docs, items).collect()
    assert len(rows) == 3 * 3 and {r.item_id for r in rows} == {1, 2, None}
    left = D.drop_leaked(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 2}
    assert D.find_leaks(docs_of([]), items).count() == 0


def test_very_long_text(docs_of, bench):
    text = "lorem ipsum " * 200_000 + ITEM + " dolor" * 100_000
    (row,) = D.find_leaks(docs_of([(1, text)]), bench([(1, ITEM)])).collect()
    assert text[row.start_char : row.end_char] == ITEM


def test_scripts_without_spaces(docs_of, bench):
    item = "请问这条河流的名字是什么为什么它会流过石头山谷里的老磨坊"
    text = f"前言。{item[3:25]}，后记 and English words"
    rows = D.find_leaks(docs_of([(1, text), (2, "这条河流很长"), (3, item)]), bench([(9, item)])).collect()
    got = {r.doc_id: (text if r.doc_id == 1 else item)[r.start_char : r.end_char] for r in rows}
    assert got == {1: item[3:25], 3: item}
    assert {r.doc_id for r in D.drop_leaked(docs_of([(1, text), (2, "这条河流很长"), (3, item)]), bench([(9, item)])).collect()} == {2}


def test_offsets_where_marks_combine_across_characters(docs_of, bench):
    text = "\u1100\u1161\u11a8 " + ITEM.replace("e", "e\u0301", 3) + " \u0344\u0301 \ufdfa end"
    rows = D.find_leaks(docs_of([(1, text)]), bench([(3, normalise(text)), (4, ITEM)])).collect()
    spans = {r.item_id: text[r.start_char : r.end_char] for r in rows}
    assert spans[3].startswith("\u1100") and "mill" in spans[4] and not spans[4].startswith("\u1100")
