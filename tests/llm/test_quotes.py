from millrace.llm import quotes as Q


def test_parse_nested():
    own, passages = Q.parse("On Monday Ann wrote:\n> first line\n> second line\n>> older\nmy answer")
    assert own == "my answer"
    assert passages == [(1, "first line\nsecond line"), (2, "older")]
    assert Q.parse("a > b") == ("a > b", []) and Q.parse(None) == ("", [])


def test_links_and_reply_order():
    out = Q.link([(0, "a", "The mill is old. It stands by the river."), (1, "b", "I like boats."), (2, "c", "> It stands by the river.\nWhich river?"), (3, "d", "> I LIKE  boats!\nMe too.\n> Which river?\nhm")])
    by = {m["turn"]: m for m in out}
    assert by[2]["reply_to"] == 0 and by[2]["quotes"] == [0] and by[2]["text"] == "Which river?"
    assert by[3]["quotes"] == [1, 2]
    assert [m["turn"] for m in out] == [0, 1, 2, 3]


def brute(messages):
    """Original of each passage by comparing words at every line or sentence beginning."""
    from millrace.llm.textvec import normalise

    parsed = [Q.parse(t) for *_, t in messages]
    found = []
    for i, (_, passages) in enumerate(parsed):
        for _, p in passages:
            want, hit = normalise(p).split(), None
            for j in range(i):
                own = parsed[j][0]
                for m in Q._BEGIN.finditer(own):
                    if want and normalise(own[m.end() :]).split()[: len(want)] == want:
                        hit = j
            found.append(hit)
    return found


def test_against_brute_force():
    import random

    r = random.Random(4)
    base = ["alpha beta.", "Gamma delta! Eps zeta.", "one two\nthree four", "same. same. same."]
    for _ in range(60):
        messages = [(0, "x", r.choice(base))]
        for t in range(1, 6):
            lines = []
            for _ in range(r.randint(0, 2)):
                src = r.choice(messages)[2].lstrip("> ")
                lines.append("> " * r.randint(1, 2) + r.choice([s for s in src.split("\n") if s] or ["zzz"]))
            messages.append((t, "x", "\n".join([*lines, r.choice(base)])))
        got = [q for m in sorted(Q.link(messages), key=lambda m: m["turn"]) for q in m["quotes"]]
        assert got == brute(messages)


def test_table(spark):
    rows = [(1, 0, "u", "hello there you"), (1, 1, "a", "> hello there you\nhi"), (1, 1, "a", "> hello there you\nhi"), (2, None, None, None), (None, 0, "u", "x"), (1, 2, "u", "> never said\n")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, messages string")
    out = {r.conv_id: r for r in Q.link_conversations(df).collect()}
    assert set(out) == {1, 2, None}
    assert (out[1].n_messages, out[1].n_quotes, out[1].n_linked) == (3, 2, 1)
    assert [m.text for m in out[1].messages] == ["hello there you", "hi", ""]
    assert out[1].messages[2].unlinked == ["never said"]
    assert out[2].messages[0].text == ""
    assert Q.link_conversations(df.limit(0)).count() == 0


def test_long_conversation():
    text = "word " * 100_000
    out = Q.link([(i, "u", f"number {i} speaks. {text}" if i < 3 else f"> number {i % 3} speaks.\nyes") for i in range(200)])
    assert len(out) == 200 and all(m["quotes"] == [m["turn"] % 3] for m in out if m["turn"] >= 3)


def test_passage_that_begins_inside_a_line():
    first = "We met by the mill: bring the two boats, and a rope.\nThe river is high this week and the ford is closed."
    out = Q.link([(0, "a", first), (1, "b", "Fine."), (2, "c", "> and a rope.\nWhich rope?"), (3, "d", "> is high this week and\n> the ford is closed.\nSince when?")])
    by = {m["turn"]: m for m in out}
    assert by[2]["quotes"] == [0] == by[3]["quotes"] and by[2]["reply_to"] == 0 == by[3]["reply_to"]
    assert [m["turn"] for m in out] == [0, 1, 2, 3] and [m["depth"] for m in out] == [0, 1, 1, 1]


def brute_every_word(messages):
    """Original of each passage by comparing words at every word."""
    from millrace.llm.textvec import normalise

    parsed = [Q.parse(t) for *_, t in messages]
    words = [normalise(own).split() for own, _ in parsed]
    found = []
    for i, (_, passages) in enumerate(parsed):
        for _, p in passages:
            want = normalise(p).split()
            hits = [j for j in range(i) if want and any(words[j][k : k + len(want)] == want for k in range(len(words[j])))]
            found.append(hits[-1] if hits else None)
    return found


def test_against_brute_force_at_every_word():
    import random

    r = random.Random(9)
    for _ in range(150):
        messages = []
        for t in range(6):
            lines = []
            for _ in range(r.randint(0, 2) if t else 0):
                src = Q.parse(r.choice(messages)[2])[0].split()
                a = r.randrange(len(src) + 1)
                lines.append("> " + " ".join(src[a : a + r.randint(1, 5)]))
                lines.append("")
            messages.append((t, "x", "\n".join([*lines, *(" ".join(r.choice("abcd") for _ in range(r.randint(1, 8))) for _ in range(2))])))
        got = [q for m in sorted(Q.link(messages), key=lambda m: m["turn"]) for q in m["quotes"]]
        assert got == brute_every_word(messages)


def test_passages_of_generated_messages():
    """Messages made from a known list of passages, nested, announced and parted in several ways."""
    import random

    r = random.Random(12)
    said = ["On Mon, 3 Jun 2024 at 10:00, Ann Lee wrote:", "Am 3.6.2024 schrieb Jörg Weber:", "Le 3 juin Ann a écrit :", "El lunes Ana escribió:"]
    for _ in range(300):
        lines, want, own, depth = [], [], [], 0
        for _ in range(r.randint(1, 6)):
            if r.random() < 0.4:
                text = [f"answer {r.randrange(99)} a > b" for _ in range(r.randint(1, 2))]
                lines += text
                own += text
                depth = 0
                continue
            before, depth = depth, r.randint(1, 4)
            passage = [f"words {r.randrange(999)} of it" for _ in range(r.randint(1, 3))]
            if before == 0 and r.random() < 0.5:
                lines += [r.choice(said)] + [""] * r.randint(0, 1)
            elif before == depth:  # an empty line of the mark parts the two
                lines.append(">" * depth)
            mark = r.choice([">" * depth + " ", "> " * depth, " " + "> " * depth])
            lines += [mark + x for x in passage]
            want.append((depth, "\n".join(passage)))
        text, got = Q.parse("\n".join(lines))
        assert got == want, lines
        assert [x for x in text.split("\n") if x] == own


def test_rows_without_a_conversation_stand_alone(spark):
    df = spark.createDataFrame([(None, 0, "u", "hello there you"), (None, 1, "a", "> hello there you\nhi"), (None, 1, "a", "> hello there you\nhi")], "conv_id long, turn long, role string, text string")
    rows = Q.link_conversations(df).collect()
    assert sorted((r.n_messages, r.n_quotes, r.n_linked) for r in rows) == [(1, 0, 0), (1, 1, 0)]  # equal messages count once
