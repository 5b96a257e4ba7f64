"""Personal items: every kind and form, what is none, and placeholders."""

import pytest

from cadastra.llm import personal

LEFT, RIGHT = frozenset({"contact:", "spoke w/", "per", "Our clerk", "clerk"}), frozenset({"re:", "all desks", "took", "disputes"})
TERMS = personal.Terms(frozenset({"vincent", "ursula", "harold", "bill"}), frozenset({"annex", "location", "road"}), frozenset({"vexley", "tarrow bend"}), LEFT, RIGHT)
FINDER = personal.Finder(TERMS)


def spans(text):
    return [(k, text[a:b]) for k, a, b in FINDER.items(text)]


@pytest.mark.parametrize("mail", ["a.b@example.org", "x+y1 @ books.test", "q-h(at)office.example", "a_b [at] accounts [dot] example [dot] com", "larry.d at office dot example", "A.B@MAIL.EXAMPLE", "n" * 300 + "@" + "h" * 200 + ".example"])
def test_emails(mail):
    assert spans(f"Replies go to {mail}. Then.") == [("email", mail)]


@pytest.mark.parametrize("phone", ["(970)555-0171", "740-555-0169", "255/555-0144", "555-0181", "+1-647-555-0122 x477", "4495550128", "946 555 0169", "1-503-555-0110 x18", "(602) 555 0118 ext. 256", "+1 639 555 0128", "497.555.0163", "+44 20 7946 0958", "+49 30 901820", "+34 912 345 678"])
def test_phones(phone):
    assert spans(f"call {phone}.") == [("phone", phone)]


@pytest.mark.parametrize(("text", "item"), [("SSN 972445643 noted", "972445643"), ("Signer 958 17 3352", "958 17 3352"), ("reads DL# 65K819114.", "65K819114"), ("gave driver licence Q1579-1023-9781 as", "Q1579-1023-9781"), ("passport no. 4XJ375524 on", "4XJ375524")])
def test_numbers(text, item):
    assert spans(text) == [("id_number", item)]


@pytest.mark.parametrize(
    "address",
    ["167 Pewter Hill Ave, Vexley, Texas 00190", "5772 S. Marlpit Road, Apt 324\nDunmallow, Texas 00481", "796 S. Candlewick Rd, Unit 241, Vexley", "2034 Tinderbox Dr.", "9434 Cobblemoor Street", "8274 LANTERNFIELD STREET, LAKEMONT FERRY TX 00393", "8433 Harrowgate St Tarrow Bend, Texas 00180", "12 Elm Street, Denver, CO 80202", "12 Elm Street, Denver, CO", "9 Oak Lane\nPortland Oregon 97201", "77 Mill Rd, Apt 4, Albany, NY 12207-1234"],
)
def test_addresses(address):
    assert spans(f"Mail copies to {address} \nnext") == [("street_address", address)]


@pytest.mark.parametrize(
    ("text", "name"),
    [("Dear Ms. Ursula V. Telzo-Refe,", "Ursula V. Telzo-Refe"), ("Owner: Telzorefe, Vincent J.\n", "Telzorefe, Vincent J."), ("Owner: vincent mirgrir-zirdir\n", "vincent mirgrir-zirdir"), ("contact: U. Triprawalgi 5", "U. Triprawalgi"), ("Owner: FRANCISCO RORKOR\n", None), ("spoke w/ Dokel-Firmir, L. re: trailers", "Dokel-Firmir, L."), ("per HAROLD BRELLAL all desks sold", "HAROLD BRELLAL"), ("Our clerk Vincemt Zirgrir took the call", "Vincemt Zirgrir")],
)
def test_names(text, name):
    assert spans(text) == ([("person_name", name)] if name else [])


@pytest.mark.parametrize("text", [None, "", " ", "The Harold Annex opens at 21.", "1000 | garden tractors | SN 998-54-5877 | 2014 | 55,229.13", "invoice 5223426 shows 11,501.36", "FEIN 00-7721167 on letterhead", "serial 555-8-087 not on list", "model XR-2928270 is a press", "unit 4 on Highway 84 closed", "lot 14 blk 4, no building", "Main Street store only", "Refer to case @871 in the log.", "paid $555,170 for", "Order 27-5488471 came on 04-27-2025.", "WHEN THE FREIGHT BILL DOUBLED THE LOT"])
def test_no_items(text):
    assert spans(text or "") == []


def test_items_never_nest_and_long_texts_end():
    text = "Vincent Telzorefe <vincent.telzorefe@example.org> 12 Vincent Road, Vexley, TX 00190 " * 400 + "9" * 100_000
    items = FINDER.items(text)
    assert len(items) == 1200 and all(a[2] <= b[1] for a, b in zip(items, items[1:], strict=False))


def test_learning_finding_and_redacting(spark):
    named = [f"Dear Ursula Telzo{c}, the Harold Annex. 12 Elm Road, Vexley, TX 00190" for c in "abcdefgh"] + ["See the Harold Annex now. The Harold Annex."] * 8
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*named, None, ""])], "id BIGINT, text STRING, kind STRING")
    found = personal.disclosure(df)
    assert "ursula" in found.given and "harold" not in found.given and "vexley" in found.towns
    terms = spark.sparkContext.broadcast(personal.Terms(found.given, frozenset(), found.towns))
    items = personal.find_items(df, "t", "id", "text", terms)
    assert {r["kind"] for r in items.collect()} == {"person_name", "street_address"} and items.count() == 16
    out = {r["row_id"]: r["redacted"] for r in personal.redact(df, "id", "text", terms).collect()}
    assert out[0] == "Dear [PERSON_NAME], the Harold Annex. [STREET_ADDRESS]" and out[16] is None and out[17] == ""
    assert personal.disclosure(df.limit(0)) == personal.Terms()


def test_cues_and_names_in_no_list_are_learnt_and_unrelated_texts_change_nothing(spark):
    """Invented given names, named by titles in some texts, teach the cues of others, which then show names by themselves."""
    import random

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(n)).capitalize()
    given, last = [word(3) for _ in range(12)], [word(4) for _ in range(60)]
    person = lambda: f"{rng.choice(given)} {rng.choice(last)}"
    texts, people = [], []
    for form in ["Dear Ms. {},\nthe list is here."] * 60 + ["The foreman {} was told of it."] * 60 + ["Mailed by surveyor {} on Monday."] * 60 + ["We saw {} nods at the gate."] * 60:
        people.append(person())
        texts.append(form.format(people[-1]))
    places = [f"The Upper {word(2)} Annex and Lower {word(2)} Yard stay shut." for _ in range(80)]
    terms = []
    for rows in (texts + places, texts + places + [f"No {word(3)} of any kind is due by month {i}." for i in range(3000)]):
        terms.append(personal.disclosure(spark.createDataFrame([(t,) for t in rows], "text STRING")))
    assert terms[0] == terms[1] and {g.lower() for g in given} <= terms[0].given and not {"upper", "lower"} & terms[0].given
    assert {"foreman", "surveyor"} <= terms[0].left and "nods" in terms[0].right
    finder = personal.Finder(terms[0])
    found = [[t[a:b] for k, a, b in finder.items(t)] for t in texts]
    assert sum(f == [p] for f, p in zip(found, people, strict=True)) >= 0.95 * len(texts)
    assert [t[a:b] for t in ["The foreman K. Velmorat was told of it."] for _, a, b in finder.items(t)] == ["K. Velmorat"]  # shown by the cue alone
    assert all(finder.items(t) == [] for t in places)


def test_long_names_are_whole():
    long = "Vincent " + "Morjel" * 20 + "-Zirgrir"
    assert spans(f"per {long} took it") == [("person_name", long)]
    assert spans(f"Owner: {'Telzo' * 15}, Vincent\n") == [("person_name", "Telzo" * 15 + ", Vincent")]
