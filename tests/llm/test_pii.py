"""Names, their short forms and other layouts; collisions; an independent search for addresses."""

import re
import unicodedata

import pytest
from ledgerloom.llm import pii

KEY = b"k"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def rewritten(text):
    return pii.replaced(text, KEY, {})[0]


@pytest.mark.parametrize(
    "text, gone",
    [
        ("Herr Hans Peter Müller kam.", "Hans Peter Müller"),
        ("Señora María José García vino.", "María José García"),
        ("Mr. John A. Smith left.", "John Smith"),
        ("Mr John O'Brien left.", "John Brien"),
        ("Mr O'Brien left.", "Brien"),
        ("Then Mr John Smith came; later John Smith and Smith left. SMITH'S car; Smith-led.", "John Smith SMITH"),
        ("Frau Dr. Müller-Lüdenscheidt sprach.", "Müller Lüdenscheidt"),
        ("Monsieur d'Artagnan et Mr de la Cruz", "Artagnan Cruz"),
        ("Κύριος Γιώργος Παπαδόπουλος ήρθε", "Γιώργος Παπαδόπουλος"),
        ("Prof. Dr. J.R.R. Tolkien wrote", "Tolkien"),
        ("Call 0171 2345678 or 030/1234567, 555 123 4567, 01 23 45 67 89.", "2345678 1234567 4567"),
        ("From 2a00:1450:4001:81b::200e and fe80::1ff:fe23:4567:890a.", "1450 200e fe23"),
        ("From 2A00:1450:4001:081B:0000:0000:0000:200E.", "1450 200E"),
    ],
)
def test_nothing_stays_in_clear(text, gone):
    made = rewritten(text)
    assert not [word for word in gone.split() if word in made], made


def test_what_is_no_entity_stays():
    for text in (
        "std::vector a::b 12:30:45 00:1A:2B:3C:4D:5E ::1", "The smith met the brown bear.", "Mr smiths", "I. A. B.",
        "Mr X. said so", "Dr. is a title", "2024-01-01 12:30", "", "127.0.0.1",
    ):
        assert rewritten(text) == text


def test_full_and_short_forms_agree():
    first = rewritten("Mr John Smith, Dr John Smith, Mr Smith, Mr John, Smith and John A. Smith's JOHN SMITH.")
    given, family = re.match(r"Mr (\w+) (\w+), ", first).groups()
    assert given in pii.GIVEN["m", "latin"]
    short = f"Mr {given} {family}, Dr {given} {family}, Mr {family}, Mr {given}, {family} and {given} A. {family}'s"
    assert first == f"{short} {given.upper()} {family.upper()}."
    assert rewritten("Mrs. Smith") == f"Mrs. {family}"
    assert rewritten("Frau Smith-Jones").startswith(f"Frau {family}-")
    a, b = rewritten("Mrs Jane Smith and Mr Jane Smith").split(" and ")
    assert a.split()[2] == b.split()[2] == family and a.split()[1] != b.split()[1]


@pytest.mark.parametrize(
    "name, script",
    [("Παπαδόπουλος", "GREEK"), ("Петров", "CYRILLIC"), ("李明", "CJK"), ("김철수", "HANGUL"), ("محمد", "ARABIC"), ("כהן", "HEBREW")],
)
def test_scripts_are_kept(name, script):
    made = rewritten(f"Mr {name}").removeprefix("Mr ")
    assert made != name and all(unicodedata.name(c).startswith(script) for c in made)


def test_addresses_keep_their_network_and_layout():
    made = rewritten("fe80::1 2a00:1450::200e 2A00:1450:4001:081B:0000:0000:0000:200E").split()
    assert made[0].startswith("fe8") or made[0].startswith("fe9") or made[0][:3] in ("fea", "feb")
    assert made[2].isupper() and made[2].count(":") == 7
    assert rewritten("030/1234567").startswith("0") and rewritten("0171 2345678")[4] == " "


def test_collisions_end(docs_of):
    names = [f"Mr. {c}o {a}x{b}y" for a in "ABCDEFGHKL" for b in "abcdefgh" for c in ("Ra", "Ro", "Ru")]
    docs = docs_of(*enumerate(names))
    turns = pii.collisions(docs, KEY, syllables=1)
    made = [pii.replaced(n, KEY, turns, 1)[0] for n in names]
    assert turns and len(set(made)) == len(names)
    assert len({m.split()[1] for m in made}) == 3 and len({m.split()[2] for m in made}) == 80


def test_joined_turns_give_the_same_texts(docs_of, monkeypatch):
    names = [f"Mr. {a}x{b}y met {a}x{b}y, {a}{b}@mail.org" for a in "ABCDEFGHKL" for b in "abcdefgh"]
    docs = docs_of(*enumerate(names), (0, names[0]), (None, None), (-1, ""))
    sent = sorted(pii.pseudonymise(docs, KEY, syllables=1).collect(), key=str)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", -1)
    assert sorted(pii.pseudonymise(docs, KEY, syllables=1).collect(), key=str) == sent
    assert len({r.text for r in sent}) == len(names) + 2


def mail_addresses(text):
    """Found letter by letter around each @, without patterns."""
    found = set()
    for at, c in enumerate(text):
        if c != "@":
            continue
        start, end = at, at + 1
        while start and (text[start - 1].isalnum() or text[start - 1] in "._+-"):
            start -= 1
        while end < len(text) and (text[end].isalnum() or text[end] in ".-"):
            end += 1
        local, domain = text[start:at].lstrip("._+-"), text[at + 1 : end].rstrip(".-")
        labels = domain.split(".")
        if local and len(labels) > 1 and all(labels) and labels[-1].isalpha() and len(labels[-1]) > 1:
            found.add(f"{local}@{domain}")
    return found


def test_no_address_of_the_tables_stays(documents, texts):
    made = {r.doc_id: r.text for r in pii.pseudonymise(documents).collect()}
    wanted = {d: mail_addresses(t or "") for d, t in texts.items()}
    assert any(wanted.values())
    for d, addresses in wanted.items():
        assert not [a for a in addresses if a in (made[d] or "")]
