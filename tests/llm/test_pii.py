import random
import unicodedata

import numpy as np
import pytest

from gapline.llm.pii import LABELS, PiiSettings, _reconciled, find_in, fit, training_rows, with_pii
from gapline.llm.pii_model import Tagger, encode, word_features
from gapline.llm.pii_patterns import TYPES, confirmed, labels, number_spans, roster_pattern

PEOPLE = [("Ilvar", "Drexley"), ("Rose", "Stone"), ("May", "Lake"), ("Nerys", "Halvick")]
SMALL = PiiSettings(sample=400, hidden=24, shards=2, rounds=3, steps=60, batch=32)


def documents(seed, n):
    """Texts with their true spans, from a few sentence forms."""
    rng = random.Random(seed)
    calm = ["The sensor was warm today.", "Rose early and went out.", "Batch 2.27.81 of 2024-09-27, checksum 003577255.", "In May the light is early.", "It happened twice on 2024-01-02.", "Window 1080-1200-1320 was split."]
    out = []
    for i in range(n):
        text, spans = "", []
        for _ in range(rng.randint(2, 6)):
            g, f = rng.choice(PEOPLE)
            g2 = "".join(rng.choice(("ka", "lo", "mer", "vin", "tor")) for _ in range(2)).capitalize()
            form = rng.randint(0, 9)
            pii = {0: ("Spoke with ", f"{g} {f}", " about it.", "person_name"), 1: ("My name is ", f"{g2} {f}", " and I sleep.", "person_name"), 2: ("Write to ", f"{g.lower()}.{f.lower()}@mail.example.org", " please.", "email"),
                   3: ("Call ", f"+1 202 555 0{rng.randint(100, 199)}", " before noon.", "phone"), 4: ("SSN ", f"9{rng.randint(10, 99)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", " was noted.", "id_number"),
                   5: ("We moved to ", f"{rng.randint(2, 200)} Millrace Lane", ", Ostley.", "street_address")}.get(form)
            if pii:
                spans.append((len(text) + len(pii[0]), pii[3]))
                text += pii[0] + pii[1] + pii[2] + " "
            else:
                text += rng.choice(calm) + " "
        out.append((i, text, spans))
    return out


@pytest.fixture(scope="module")
def tagger(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in documents(1, 400)], "doc_id bigint, text string")
    return fit(docs, "doc_id", "text", spark.createDataFrame(PEOPLE, "given_name string, family_name string"), SMALL)


def test_held_out_accuracy(tagger):
    held = documents(2, 150)
    found = find_in(tagger, [t for _, t, _ in held], SMALL)
    got = {(i, a, k) for (i, _, _), spans in zip(held, found) for a, _, k in spans}
    true = {(i, a, k) for i, _, spans in held for a, k in spans}
    assert len(got & true) >= 0.9 * len(true) and len(got - true) <= 0.1 * len(true)


def test_placeholders_keep_the_rest(spark, tagger):
    text = "Tag eins.\r\nCall +1 202 555 0123 before noon. Café ☕\n"
    long = "The sensor was warm today. " * 3000 + "Call +1 202 555 0123 before noon."
    rows = [(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, text, "x"), (5, long, "x")]
    out = {r.doc_id: r for r in with_pii(spark.createDataFrame(rows, "doc_id bigint, text string, redacted string"), "text", tagger, SMALL).collect()}
    assert out[1].redacted == text.replace("+1 202 555 0123", "[PHONE]") == out[4].redacted
    assert out[2].redacted is None and out[2].pii == [] and out[3].redacted == "" and out[3].pii == []
    assert out[5].pii[0].char_start == long.index("+1") and len(out[5].pii) == 1
    for r in out.values():
        t = {i: t for i, t, _ in rows}[r.doc_id]
        pieces, at = "", 0
        for s in r.pii:
            pieces += t[at : s.char_start] + f"[{s.pii_type.upper()}]"
            at = s.char_end
        assert t is None or pieces + t[at:] == r.redacted


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    model = fit(empty, "doc_id", "text", spark.createDataFrame([], "given_name string, family_name string"), PiiSettings(rounds=1, steps=2))
    assert with_pii(empty, "text", model).collect() == []
    find_in(model, ["Some text 123", ""])


def test_gradients_are_the_derivatives():
    rng = np.random.default_rng(0)
    m = Tagger(LABELS, 6)
    m.w = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.05 for k, v in m.w.items()}
    c, k, g = rng.integers(1, 90, (7, 3)), rng.integers(1, 7, (7, 3)), rng.integers(0, LABELS, (7, 3))
    words = rng.integers(0, 50, (7, 3, 6))
    mask = np.ones((7, 3))
    mask[5:, 1] = 0
    _, grads = m.gradients(c, k, words, g, mask)
    for name, w in m.w.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        w[at] += 1e-3
        up = m.gradients(c, k, words, g, mask)[0]
        w[at] -= 2e-3
        down = m.gradients(c, k, words, g, mask)[0]
        w[at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3 * max(1, abs(grads[name][at]))


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(3)
    m = Tagger(3, 4)
    m.w["trans"] = rng.standard_normal((3, 3))
    scores = rng.standard_normal((5, 2, 3))
    from itertools import product

    for b in range(2):
        best = max(product(range(3), repeat=5), key=lambda p: sum(scores[t, b, p[t]] for t in range(5)) + sum(m.w["trans"][p[t], p[t + 1]] for t in range(4)))
        assert tuple(m.viterbi(scores)[:, b]) == best


def test_windows_are_reconciled_globally():
    spans = [(0, 10, 0, 5.0), (8, 20, 0, 6.0), (18, 25, 1, 5.0), (30, 32, 2, 1.0)]
    assert _reconciled(spans) == [(0, 10, 0, 5.0), (18, 25, 1, 5.0), (30, 32, 2, 1.0)]


def test_labels_and_checks():
    roster = roster_pattern(PEOPLE)
    text = "Spoke with Ilvar Drexley. Call (202) 555-0184. SSN 911-22-3333. Mail a.b at lab dot example. Went to 12 Mill Lane, Ostley. In May it rained on 2024-05-06."
    assert [(text[a:b], k) for a, b, k in labels(text, roster)] == [("Ilvar Drexley", "person_name"), ("(202) 555-0184", "phone"), ("911-22-3333", "id_number"), ("a.b at lab dot example", "email"), ("12 Mill Lane", "street_address")]
    assert confirmed("on 2024-05-06 it", 3, 13, "email") is None
    assert confirmed("Mr. Stone slept", 0, 9, "person_name") == (4, 9)
    assert number_spans("checksum 003577255.") == []
    assert set(TYPES) == {"email", "phone", "id_number", "street_address", "person_name"}


def test_accents_composed_or_not():
    one, two = "Dormí mal", unicodedata.normalize("NFD", "Dormí mal")
    assert len(two) == len(one) + 1
    assert (word_features(*encode(one))[-1] == word_features(*encode(two))[-1]).all()
    assert len(encode("\ud800x")[0]) == 2 and word_features(*encode("")).shape == (0, 6)


def test_identity_numbers_with_letters():
    for number in ("QQ 66 76 11 D", "QQ951834A", "qq 686307 a"):
        for text in (f"Identity number: {number} My wrist itched.", f"The nurse read {number} back to me."):
            a = text.index(number)
            assert labels(text, None) == [(a, a + len(number), "id_number")]
            assert confirmed(text, a + 3, a + len(number) - 1, "id_number") == (a, a + len(number))
    assert number_spans("code xqq686307ab and Q 686307.") == []


@pytest.mark.parametrize(
    "before, address, after",
    [
        ("The courier stood at ", "14 Harrow Steps Crescent", ", Queensholt NM7 6QZ and left."),
        ("home ", "146 Fennel Crescent", ", Apt 5, Queensholt."),
        ("Ask for ", "31B Harrow Rookery", ", Ostley, ZZ 00837.\nWent out."),
        ("She lives at ", "7 Old Mill Rookery", " with a dog."),
        ("Das Ersatzgerät ging an ", "Alte Zeile 88 c", ", 00199 Neu-Wiesel. Am"),
        ("ohne jetzt unter der Adresse ", "Hintere Schanze 208 c", ", 00291 Obertannau.\nDie"),
        ("El reloj se envió a ", "Cuesta Almendro 65", ", bajo, 00929 Puerto Luzán."),
        ("Wir wohnen in der ", "Grünbühlstraße 7", ", 00291 Obertannau."),
    ],
)
def test_addresses_by_shape(before, address, after):
    for form in ("NFC", "NFD"):
        b, x, e = (unicodedata.normalize(form, t) for t in (before, address, after))
        text, span = b + x + e, (len(b), len(b) + len(x))
        assert confirmed(text, span[0] + 2, span[1], "street_address") == span
        assert "rookery" not in x.lower() or "ZZ" not in text or labels(text, None) == [(*span, "street_address")]
        assert "Crescent" not in x and "Zeile" not in x and "straße" not in x or labels(text, None) == [(*span, "street_address")]


def test_numbers_with_capitals_are_no_addresses():
    for text, at in (("flag never rose.\nA: 12 Long Gaps Lane-marked in the plot", "12 Long"), ("It was 65 Percent of all", "65 Percent"), ("kept a diary for 13 days, Nobody", "13 days")):
        assert confirmed(text, text.index(at), text.index(at) + len(at), "street_address") is None
        assert labels(text, None) == []


def test_openers_of_whole_texts(spark):
    calm = "the sensor was warm. " * 30
    rows = [(i, calm + "Field notes: none. " + calm + ("Once only." if i == 3 else "")) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    # A sample of few short stretches sees hardly any of them; a word of one text isn't frequent in a small table.
    assert training_rows(df, "doc_id", "text", PEOPLE, PiiSettings(sample=3, sample_chars=40))[1] == {"Field"}


def test_names_that_also_open_sentences():
    openers = frozenset({"Field", "Rose", "She", "Text"})
    for text, name, kept in (("It was. Field looked at the light.", "Field", True), ("Field wants the plot.", "Field", True), ("Spoke to Dr. Rose yesterday.", "Rose", True), ("Field notes: none.", "Field", False), ("She looked at the light.", "She", False), ("Text (202) 555-0184.", "Text", False)):
        a = text.index(name)
        assert confirmed(text, a, a + len(name), "person_name", openers) == ((a, a + len(name)) if kept else None)
