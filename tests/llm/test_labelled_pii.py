"""Personal data in texts with known spans: the method finds what the base patterns leave out, and little else."""

import random

import pytest

from freshet.llm import pii

WORDS = "the river rose over night and people of the lower town moved to higher ground while rain went on".split()


def checked(rng, n):
    """A number of ``n`` digits that begins like a card and passes the check-digit rule."""
    body = [4] + [rng.randrange(10) for _ in range(n - 2)]
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(body)))
    return "".join(map(str, body)) + str(-total % 10)


def hextets(rng, first):
    return ":".join([first, *(f"{rng.randrange(0x1000, 0x10000):x}" for _ in range(7))])


def labelled(rng):
    """Texts with (kind, start, end) of their personal data, plain and disguised, among numbers that are none."""
    name = lambda: rng.choice(["anna", "li.wei", "k_ito", "omar", "eva.m"]) + str(rng.randrange(100))
    four = lambda s: [s[k : k + 4] for k in range(0, 16, 4)]
    true = [
        ("email", "write to ", lambda: f"{name()}@example.org"), ("email", "contact ", lambda: f"{name()} (at) example (dot) org"), ("email", "mail ", lambda: f"{name()} at example dot com"),
        ("ip", "from the server ", lambda: f"{rng.randrange(60, 200)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}"), ("ip", "login from ", lambda: hextets(rng, "2001")),
        ("card", "pay by card ", lambda: " ".join(four(checked(rng, 16)))), ("card", "my visa is ", lambda: ".".join(four(checked(rng, 16)))), ("card", "card no ", lambda: " - ".join(four(checked(rng, 16)))),
        ("phone", "call ", lambda: f"+1 615 {rng.randrange(200, 999)} {rng.randrange(1000, 9999)}"), ("phone", "my phone is ", lambda: f"(615) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"),
    ]
    false = [
        lambda: f"version {rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(20)}", lambda: f"at {rng.randrange(10, 24)}:{rng.randrange(10, 60)}:{rng.randrange(10, 60)}", lambda: f"on 20{rng.randrange(10, 30)}-11-{rng.randrange(10, 29)}",
        lambda: f"we met at noon near {rng.choice(WORDS)}", lambda: f"order {rng.randrange(10**7, 10**8)}", lambda: ".".join(str(rng.randrange(1000, 9999)) for _ in range(2)), lambda: f"ratio {rng.randrange(9)}:{rng.randrange(9)}",
    ]
    for k in range(600):
        text, spans = " ".join(rng.choices(WORDS, k=rng.randrange(3, 20))) + " ", []
        for _ in range(rng.randrange(0, 3)):
            text += rng.choice(false)() + " " + " ".join(rng.choices(WORDS, k=4)) + " "
        if k % 3:
            kind, cue, made = true[k % len(true)]
            hit = made()
            spans.append((kind, len(text) + len(cue), len(text) + len(cue) + len(hit)))
            text += cue + hit + " " + " ".join(rng.choices(WORDS, k=3))
        yield text, spans


def test_method_beats_the_base(spark):
    rows = list(labelled(random.Random(5)))
    want = {(i, *s) for i, (_, spans) in enumerate(rows) for s in spans}
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    every, base = set(), set()
    for r in pii.find_personal_data(frame).collect():
        for s in r["spans"]:
            found = (r["doc_id"], pii.KINDS[s["kind"]], s["start"], s["end"])
            every.add(found)
            base |= {found} if s["base"] else set()
    scores = lambda got: (len(got & want) / len(got), len(got & want) / len(want))
    (p0, r0), (p1, r1) = scores(base), scores(every)
    print(p0, r0, p1, r1)
    assert p1 >= 0.95 and p1 >= p0 - 0.01 and r1 >= r0 + 0.3
    disguised = {w for w in want if w not in base}
    assert {k for _, k, *_ in disguised & every} == {"email", "ip", "card", "phone"}


@pytest.mark.parametrize("text", ["", "at noon", "12:34:56 and 01:02:03:04:05:06", "2024.11.28 and 1.2.3", "1111.2222.3333.4445"])
def test_what_is_no_personal_data(spark, text):
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.find_personal_data(frame).first()["spans"] == []
