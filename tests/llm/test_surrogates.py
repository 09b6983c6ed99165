import re

import pytest

from millrace.llm import surrogates as S

TEXT = "Mail Anna Smith at anna.smith@mail.example.org or +49 30 1234567; card 4111 1111 1111 1111, IP 10.1.2.3, SSN 123-45-6789. Smith said so."


def test_same_entity_same_surrogate_others_differ():
    s = S.Surrogates()
    out, found = s.rewrite(TEXT)
    assert {k for k, *_ in found} >= {"email", "phone", "card", "ip", "ssn", "name"}
    for kind, a, b in found:
        assert not re.search(rf"(?<!\w){re.escape(TEXT[a:b])}(?!\w)", out), kind
    again, _ = S.Surrogates().rewrite(TEXT)
    assert again == out
    other, _ = S.Surrogates(b"another key").rewrite(TEXT)
    assert other != out
    surname = next(TEXT[a:b] for k, a, b in found if k == "name" and TEXT[a:b] == "Smith")
    new = s.of("name", surname)
    assert len(re.findall(rf"\b{new}\b", out)) == 2


def test_format_kept():
    s = S.Surrogates()
    card = s.of("card", "4111 1111 1111 1111")
    assert re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", card) and S.luhn(re.sub(r"\D", "", card))
    assert s.of("card", "4111111111111111") == card.replace(" ", "")
    assert s.of("ip", "10.1.2.3").startswith("10.")
    assert S.iban_valid(s.of("iban", "DE89 3704 0044 0532 0130 00").replace(" ", ""))
    assert re.fullmatch(r"\+49 \d\d \d{7}", s.of("phone", "+49 30 1234567"))
    assert s.of("email", "a@x.org").split("@")[1] == s.of("email", "b@x.org").split("@")[1]


def test_names_keep_gender_and_script():
    s = S.Surrogates()
    for names in S._LISTS.values():
        made = [s.of("name", n) for n in names]
        assert sorted(made) == sorted(names) and all(a != b for a, b in zip(made, names))


@pytest.mark.parametrize("size", [2, 17, 999, 1000, 54321])
def test_permutation(size):
    s = S.Surrogates()
    n = min(size, 3000)
    assert len({s.permute(x, size, "t") for x in range(n)}) == n
    assert all(0 <= s.permute(x, size, "t") < size for x in range(n))


def test_distinct_over_many():
    s = S.Surrogates()
    phones = [f"+1 555 {i:07d}" for i in range(3000)]
    assert len({s.of("phone", p) for p in phones}) == 3000


def test_table(docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "nothing here"), (4, TEXT), (4, TEXT), (None, "x@y.org")], extra=True)
    out = S.with_surrogates(docs).collect()
    by = {r.doc_id: r for r in out}
    assert by[1].surrogate_text is None and by[1].n_entities == 0
    assert by[2].surrogate_text == "" and by[3].surrogate_text == "nothing here"
    assert len({r.surrogate_text for r in out if r.doc_id == 4}) == 1 and by[4].n_entities >= 7
    same = S.with_surrogates(docs, in_place=True)
    assert same.columns == docs.columns
    assert {r.doc_id: r.text for r in same.collect()}[4] == by[4].surrogate_text
    assert S.with_surrogates(docs_of([])).count() == 0


def test_long_text(docs_of):
    text = "word " * 200_000 + "write to me@there.org please " + "word " * 200_000
    (r,) = S.with_surrogates(docs_of([(1, text)])).collect()
    assert "me@there.org" not in r.surrogate_text and len(r.surrogate_text) == len(text)


def test_hints_lose_nothing(monkeypatch):
    names = ["password", "PASSWD", "pwd", "Secret", "token", "api_key", "api-key", "apikey", "apı_key", "access_key", "AccessKey", "paſſword"]
    texts = [f"the {n}{sep}abcdefghij here" for n in names for sep in (": ", "=", " = ", '": "')]
    texts += [f"the {p}{sep}{'abcdefgh' * 3} here" for p in ("ghp", "gho", "ghs", "github_pat", "sk", "pk", "xoxa", "xoxb", "xoxp") for sep in "-_"]
    texts += ["AKIA" + "ABCDEFGH" * 2, "ASIA" + "ABCDEFGH" * 2, "at abcd:beef:cafe:dead:face:fade:bead:deaf now", "mail jo@there.org"]
    texts += [f"dann kam {t}{blank}Xaver spät" for t in ("Mr", "Mr.", "Mrs", "Mrs.", "Ms.", "Miss", "Dr.", "Prof.", "Herr", "Herrn", "Frau", "Señor", "Señora", "Sr.", "Sra.", "Monsieur", "Madame", "Mme", "господин", "госпожа") for blank in (" ", "\t", " \t ")]
    with_hints = [S.find(t) for t in texts]
    assert all(with_hints), [t for t, f in zip(texts, with_hints) if not f]
    monkeypatch.setattr(S, "_may_match", lambda text: True)
    monkeypatch.setattr(S, "_may_have_title", lambda text: True)
    assert [S.find(t) for t in texts] == with_hints


LABELLED = {
    "email": ["jörg.weber@example.de", "info@müller.de", "иван@почта.рф", "josé@correo.es", "张三@例子.公司", "jo@there.org", "jo\u0308rg@mail.de"],
    "phone": ["030 1234567", "06 12 34 56 78", "06.12.34.56.78", "0171 2345678", "0049 30 1234567", "555 123 4567", "(030) 123 45 67", "0171/2345678", "01712345678", "+33 6 12 34 56 78", "612 345 678"],
    "name": ["Wolfgang Krause", "Céline Mercier", "Álvaro Navarro", "Jennifer Clark", "Xaver Unbekannt"],
}
#: Forms that are not found, as the README says.
MISSED = {"612 345 678", "Xaver Unbekannt"}


def test_recall_on_labelled_forms():
    s = S.Surrogates()
    for kind, entities in LABELLED.items():
        for e in entities:
            out, found = s.rewrite(f"Man schrieb an {e}, und das war alles.")
            whole = "".join(f"Man schrieb an {e}, und das war alles."[a:b] for k, a, b in found if k == kind)
            assert (whole.replace(" ", "") == e.replace(" ", "")) == (e not in MISSED), (e, found)
            assert (e in out) == (e in MISSED), out


def test_national_numbers_keep_their_form():
    s = S.Surrogates()
    assert re.fullmatch(r"0[1-9]\d \d{7}", s.of("phone", "030 1234567")) and re.fullmatch(r"0049 \d\d \d{7}", s.of("phone", "0049 30 1234567"))
    assert re.fullmatch(r"\(0[1-9]\d\) \d{3} \d\d \d\d", s.of("phone", "(030) 123 45 67")) and re.fullmatch(r"0[1-9]\d{9}", s.of("phone", "01712345678"))


@pytest.mark.parametrize("text", ["am 01.02.2024 10:30 Uhr", "am 05-11-2023 12", "0,1234567 oder 0.123456789", "es waren 2000 100 3000", "0123"])
def test_dates_and_numbers_are_no_phones(text):
    assert S.find(text) == []


@pytest.mark.parametrize("size", [*range(2, 40), 255, 256, 257, 1000])
def test_permutation_has_no_fixed_point(size):
    s = S.Surrogates(b"k")
    made = [s.permute(x, size, "t") for x in range(size)]
    assert sorted(made) == list(range(size)) and all(a != b for a, b in enumerate(made))


def made_entities(r, kind):
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("bcdfgklmnrst") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    if kind == "email":
        return r.choice((f"{word()}.{word()}@{word()}.org", f"{word()}{digits(2)}@mail{digits(1)}.example.com", f"{r.choice(S._GIVEN_NAMES).lower()}_{word()}@x.de"))
    if kind == "card":
        number = r.choice("345") + digits(14)
        number += next(d for d in "0123456789" if S.luhn(number + d))
        return r.choice((number, " ".join(number[i : i + 4] for i in range(0, 16, 4))))
    return {
        "phone": f"+1 ({r.choice('23456789')}{digits(2)}) {digits(3)}-{digits(4)}",
        "ip": ".".join(str(r.randint(1, 254)) for _ in range(4)),
        "ssn": f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}",
        "secret": "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 40)))),
        "name": word().capitalize() if r.random() < 0.7 else r.choice([*S._LIST_OF]),
    }[kind]


def test_replacements_over_a_corpus_stay_distinct_and_the_same():
    """Against a table of all entities: one replacement each, in every document, none twice and none its own."""
    import random

    r, s = random.Random(4), S.Surrogates(b"corpus key")
    for kind in ("email", "phone", "ip", "card", "ssn", "secret", "name"):
        entities = sorted({made_entities(r, kind) for _ in range(600)})
        table = {e: S.Surrogates(b"corpus key").of(kind, e) for e in entities[::7]}
        made = {e: s.of(kind, e) for e in entities}
        same = lambda x: re.sub(r"\D", "", x) if kind == "card" else x  # noqa: E731 - one card may be written in two ways
        assert len({same(v) for v in made.values()}) == len({same(e) for e in entities}), kind
        assert all(v != e for e, v in made.items()) and all(made[e] == v for e, v in table.items()), kind
    shown = {"email": "Write to {}.", "phone": "Call {} now", "ip": "from {} today", "card": "card {} ok", "ssn": "ssn {}.", "secret": 'token = "{}" end'}
    for _ in range(200):
        parts = [(k, made_entities(r, k)) for k in r.sample(sorted(shown), 4)]
        text = " | ".join(shown[k].format(e) for k, e in parts)
        assert s.rewrite(text)[0] == " | ".join(shown[k].format(s.of(k, e)) for k, e in parts), text


def test_whole_secrets_and_what_is_none():
    s = S.Surrogates()
    long = "".join("abcdefghij"[i * i % 10] for i in range(900))
    out, found = s.rewrite(f"api_key = {long} end")
    assert found[0][0] == "secret" and out.endswith(" end") and not any(long[i : i + 12] in out for i in range(0, 880, 12))
    for clean in ("number 4111111111111112 of", "version 1.2.3.4 and release 10.0.0.1", "ratio 3.5 :: 4"):
        assert s.rewrite(clean) == (clean, [])
    assert [k for k, *_ in S.find("at fe80::1 and 2001:db8::ff00:42 too")] == ["ip", "ip"]
    out, _ = s.rewrite("call +1 (217) 555-7713 12.5 times")
    assert out.endswith(" 12.5 times")


def test_addresses_follow_names():
    s = S.Surrogates()
    out, _ = s.rewrite("Anna Smith (anna.smith@x.org), also smith7@x.org")
    given, family = out.split()[:2]
    assert f"({given.lower()}.{family.lower()}@" in out and f" {family.lower()}" in out.split("also")[1]


def test_names_of_any_script_and_their_endings():
    s = S.Surrogates()
    for text in ("Mr. 王小明 came", "Frau Ğülen kam", "Mrs. Bullocka left", "Dr. Ñandú vino"):
        out, found = s.rewrite(text)
        assert [k for k, *_ in found] == ["name"] and out != text and len(out) == len(text), text
    assert s.of("name", "Bullocka").endswith("a")


def test_clashing_columns_and_key_of_the_session(spark, docs_of):
    docs = docs_of([(1, "x@y.org"), (2, None)]).selectExpr("doc_id", "'keep me' AS surrogate_text", "'and me' AS __surrogate_text", "text AS Text")
    rows = S.with_surrogates(docs, in_place=True).collect()
    assert all(r.surrogate_text == "keep me" and r["__surrogate_text"] == "and me" for r in rows) and rows[0].Text != "x@y.org"
    spark.conf.set("millrace.pii.key", "of the session")
    try:
        assert S.with_surrogates(docs, in_place=True).first().Text == S.Surrogates(b"of the session").rewrite("x@y.org")[0]
    finally:
        spark.conf.unset("millrace.pii.key")
