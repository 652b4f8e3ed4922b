import random

import pytest

from clauseworks.llm import residue

CASES = [
    "The Buyer shall pay {{ amount }} within 30 days.",
    "The term ends on [insert date here] unless renewed.",
    "Signed by <%= party_name %> and the Seller.",
    "Payment is due within [●] days of delivery.",
    "Lorem ipsum dolor sit amet dolor ipsum lorem sit.",
    "blah blah blah blah blah blah",
    "404 Not Found\n\nThe file you asked for could not be loaded.",
    "Please enable JavaScript to view this document.",
    "Error 502: no se puede mostrar el documento.",
    "Dummy paragraph 4. This block only shows where the real wording will stand.",
    "Due on XX/XX/20XX at noon.",
    "[object Object]",
]
NONE = [
    "The fee is [***] per unit of the goods, confidential treatment requested.",
    "[Intentionally omitted]",
    "[Signature page follows]",
    "Signed for the Seller: ______________________  Date: ____________",
    '"Error Page" means the page shown by the Platform when a file is not found.',
    "The Publisher shall not print placeholder or dummy text in the catalogue.",
    '"TBD" in Annex 3 means that the Owner will name the figure by 5 May 2020.',
    "Prices < 7 and > 218 are reported to the Board.",
    "The portal is written in JavaScript and the Licensee shall enable it on every terminal.",
    None,
    "",
    " \n",
]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(1)
    party, verb, thing = ["Buyer", "Seller", "Agent", "Owner"], ["shall deliver", "may inspect", "must insure", "shall pay for"], ["the goods", "a warranty", "every shipment", "the premises", "any invoice"]
    clauses = [" ".join(f"The {rng.choice(party)} {rng.choice(verb)} {rng.choice(thing)} within {rng.randrange(90)} days of notice." for _ in range(4)) for _ in range(800)]
    marks = [f"The {rng.choice(party)} {m} the goods." for m in ("[Intentionally omitted]", "[Signature page follows]", "[***]") for _ in range(40)]
    rows = [*CASES, *NONE, *[f"{c}\n{x}" for c, x in zip(CASES * 4, clauses, strict=False)], *clauses, *marks]
    df = spark.createDataFrame([(k, t, 0.0) for k, t in enumerate(rows)] + [(None, "{{ x }}", 0.0), (0, rows[0], 0.0)], "doc_id bigint, text string, mark_odds double")
    got = [r.doc_id for r in residue.residue_documents(df).collect()]
    assert len(got) == len(set(got))
    return set(got), len(rows)


def test_cases_are_found(found):
    n = len(CASES)
    missed = [CASES[k % n] for k in [*range(n), *range(n + len(NONE), n + len(NONE) + 4 * n)] if (k if k < n else k) not in found[0]]
    assert missed == []


def test_nothing_else_is(found):
    n = len(CASES)
    own = {*range(n), *range(n + len(NONE), n + len(NONE) + 4 * n)}
    assert {k for k in found[0] if k not in own} == set()


def test_without_any_trusted_example(spark):
    df = spark.createDataFrame([(1, "The Buyer pays."), (2, None)], "doc_id bigint, text string")
    assert residue.residue_documents(df).count() == 0
    assert residue.residue_documents(df.limit(0)).count() == 0


def test_long_texts(spark):
    df = spark.createDataFrame([(1, "The Buyer pays. " * 20_000 + "{{ amount }}")], "doc_id bigint, text string")
    assert residue.residue_documents(df).count() == 1


MESSAGES = [
    "You must enable JavaScript to view this document.",
    "JavaScript must be enabled to view this page.",
    "Error 404: the page may have been moved.",
    "Please enable JavaScript, or this page will not load.",
    "We are down for maintenance and will be back soon.",
    "Error 503 - the administrator will look into it.",
]
SPOKEN_OF = [
    "Where error 404 is shown on the portal, the Supplier must repair it within two days.",
    "The following must be repaired: error 404 pages; lorem ipsum texts.",
    "If the portal shows error 404, and the Buyer complains, the Supplier must repair it.",
    "You may not print lorem ipsum in the catalogue.",
    "Any page that returns error 404 must be repaired by the Supplier.",
]


def _among_clauses(spark, rows):
    """Numbers of those rows that are found among ordinary clauses and some residue."""
    rng = random.Random(2)
    party, verb, thing = ["Buyer", "Seller", "Agent"], ["shall deliver", "may inspect", "must insure"], ["the goods", "a warranty", "every shipment"]
    clauses = [" ".join(f"The {rng.choice(party)} {rng.choice(verb)} {rng.choice(thing)} within {rng.randrange(90)} days of notice." for _ in range(4)) for _ in range(400)]
    marks = [f"The {rng.choice(party)} {m} the goods." for m in ("[Intentionally omitted]", "[Signature page follows]", "[***]") for _ in range(40)]
    df = spark.createDataFrame(list(enumerate([*rows, *CASES, *clauses, *marks])), "doc_id bigint, text string")
    return {r.doc_id for r in residue.residue_documents(df).collect() if r.doc_id < len(rows)}


def test_messages_with_modal_verbs(spark):
    n = len(MESSAGES)
    rows = [*MESSAGES, *[f"The Buyer shall pay the price.\n{m}" for m in MESSAGES], *SPOKEN_OF]
    assert [rows[k] for k in sorted(set(range(2 * n)) ^ _among_clauses(spark, rows))] == []


WIDE = [
    "{{ client-name }}", "{{ party.name | upper }}", "{{#if party}}", "{{ items[0].name }}", "{{_name}}", "{% if party == 'x' %}", "${client-name}", "{client-name}", "<client-name>",
    "[Insert Licensee's name]", "[Party A/Party B]", "[insert full registered name of the Licensee and address]", "(insert the full registered name of the Licensee and its address)",
]
NOT_FILLED_IN = [
    "[Remainder of this page intentionally left blank, signature page follows]",
    "[Inserted by the Deed of Variation, dated 5 May 2020]",
    "[Omitted: commercially sensitive, see Rule 24(b)]",
    "[1]",
    '{"unit": "kg", "limit": 5}',
    '<a href="x.html">',
    "<john@example.com>",
    "<https://example.com/a>",
    '<?xml version="1.0"?>',
]


def test_wide_marks(spark):
    rows = [f"The Buyer shall pay {x} today." for x in [*WIDE, *NOT_FILLED_IN]]
    assert [rows[k] for k in sorted(set(range(len(WIDE))) ^ _among_clauses(spark, rows))] == []


def test_brackets_hide_no_filler():
    text = "[Lorem ipsum dolor sit amet, consectetur]"
    cut, marks = residue.passages(text)
    assert cut == [text] and [m.inner for m in marks] == [text[1:-1]]


def test_unclosed_delimiters_take_no_time():
    residue.passages("[{{ <% $$a (insert " * 20_000)


def test_rare_residue_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(residue, "SAMPLE", 20)
    monkeypatch.setattr(residue, "TRUSTED_SAMPLE", 20)
    clauses = [f"The Buyer shall deliver {k} goods. The Seller may inspect them within {k % 90} days." for k in range(2_000)]
    rare = {5_001: CASES[0], 5_002: CASES[4], 5_003: CASES[7]}
    df = spark.createDataFrame([*enumerate(clauses), *rare.items()], "doc_id bigint, text string")
    assert {r.doc_id for r in residue.residue_documents(df).collect()} == set(rare)
