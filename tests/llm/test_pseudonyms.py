import datetime
import ipaddress
import re

import pytest

from reelmetrics.llm import pseudonyms, registry
from reelmetrics.llm.pseudonyms import Permutation, replace

DO, UNDO = Permutation(b"key"), Permutation(b"key", undo=True)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 260, 1000, 7919])
def test_permutation_is_one_to_one_and_can_be_undone(size):
    got = [DO(x, size, b"t") for x in range(size)]
    assert sorted(got) == list(range(size))
    assert [UNDO(y, size, b"t") for y in got] == list(range(size))
    if size > 100:
        assert got != [DO(x, size, b"other") for x in range(size)] != [Permutation(b"another")(x, size, b"t") for x in range(size)]


def plain_luhn(digits):
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = int(c) * (2 if place % 2 else 1)
        total += n if n < 10 else n - 9
    return total % 10 == 0


@pytest.mark.parametrize(
    ("value", "kind"),
    [
        ("und.34@mail7.example.com", "email"),
        ("A_b+c@x.org", "email"),
        ("4111 1111 1111 1111", "card"),
        ("4111-1111-1111-1111", "card"),
        ("4845168114407329", "card"),
        ("+1 (017) 555-7713", "phone"),
        ("+44 20 7946 0958", "phone"),
        ("555-123-4567", "phone"),
        ("(212) 555-0187", "phone"),
        ("233.254.104.120", "ip"),
        ("1.43.7.85", "ip"),
        ("2001-02-28", "date"),
        ("31/12/1999", "date"),
        ("12/31/1999", "date"),
        ("01.02.2003", "date"),
        ("GB82 WEST 1234 5698 7654 32", "iban"),
        ("DE89370400440532013000", "iban"),
        ("078-05-1120", "ssn"),
    ],
)
def test_value_keeps_its_format_and_comes_back(value, kind):
    text = f"before {value}, after {value}!! 12 cats"
    new, marks = replace(text, DO)
    found = [new[m["start"] : m["start"] + m["length"]] for m in marks]
    assert [m["kind"] for m in marks] == [kind, kind]
    assert found[0] == found[1] != value
    shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", s)))
    assert shape(found[0]) == shape(value) and len(new) == len(text)
    assert new == text.replace(value, found[0])
    assert replace(new, UNDO)[0] == text
    digits = re.sub(r"\D", "", found[0])
    if kind == "card":
        assert plain_luhn(digits)
    if kind == "ip":
        ipaddress.ip_address(found[0])
    if kind == "date" and "-" in value:
        datetime.date.fromisoformat(found[0])
    if kind == "iban":
        plain = found[0].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_other_writing_of_a_number_stays_linked():
    digits = [re.sub(r"\D", "", replace(t, DO)[0]) for t in ("4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111")]
    assert len(set(digits)) == 1


@pytest.mark.parametrize("text", ["", "no numbers", "9807915762804490", "version 4.0. and 2.0.", "999.1.1.1 1.2.3.4.5", "30.02.2001 2001-13-01", "000-12-1234 666-12-1234", "a @ b", "0000000000000000", "x" * 10_000, "1 2 3 4 5 6 7", 'token = "97cc2f83a66d7aa2f0cf60f331ab75ccf6093a82"'])
def test_what_is_not_valid_stays(text):
    assert replace(text, DO) == (text, [])


def test_neighbours_do_not_hide_a_value():
    text = "12 4111 1111 1111 1111 123 7536784127813051 4845168114407329 10.0.0.1/x@y.example.com,2001-02-28"
    new, marks = replace(text, DO)
    assert [m["kind"] for m in marks].count("card") == 2
    assert "4111 1111 1111 1111" not in new and "4845168114407329" not in new
    assert "7536784127813051" in new  # its check digit is wrong
    assert replace(new, UNDO)[0] == text


def test_documents(spark):
    rows = [(1, "call +1 (017) 555-7713", 5, "a"), (2, "or +1 (017) 555-7713.", 6, "b"), (3, None, 7, "c"), (None, "", 8, "d"), (4, "w 1 " * 100_000 + "10.20.30.40", 9, "e"), (4, "no", 10, "e"), (4, "no", 10, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, new string")
    done = pseudonyms.pseudonymise(docs, "key")
    assert done.columns == docs.columns
    got = done.orderBy("spans").collect()
    assert [r[2:] for r in got] == [r[2:] for r in rows] and [r[0] for r in got] == [r[0] for r in rows]
    assert got[0].text[5:22] == got[1].text[3:20] != "+1 (017) 555-7713"
    assert got[2].text is None and got[3].text == "" and got[5].text == "no"
    assert got[4].text.startswith("w 1 w 1 ") and not got[4].text.endswith("10.20.30.40") and len(got[4].text) == len(rows[4][1])
    assert pseudonyms.pseudonymise(docs.where("false"), "key").count() == 0


def test_whole_query_comes_back_and_links(spark, small):
    """All documents: only spans differ, each span keeps its format, equal values have equal pseudonyms and other values others, and all comes back."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in registry.QUERIES["op5_pseudonyms"](spark, small).collect()}
    assert got.keys() == texts.keys()
    back = Permutation(registry.PSEUDONYM_KEY.encode(), undo=True)
    links, spans = {}, 0
    for key, text in texts.items():
        r = got[key]
        assert r.n_replaced == len(r.spans) and len(r.text or "") == len(text or "")
        at, kept = 0, []
        for s in r.spans:
            old, new = text[s.start : s.start + s.length], r.text[s.start : s.start + s.length]
            assert s.start >= at and r.text[at : s.start] == text[at : s.start]
            shape = lambda v: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", v)))
            assert shape(old) == shape(new)
            links.setdefault((s.kind, old), set()).add(new)
            kept.append((s.start, s.start + s.length))
            at, spans = s.start + s.length, spans + 1
        assert (r.text or "")[at:] == (text or "")[at:]
        assert text is None or replace(r.text, back)[0] == text
        for simple in (r"(?<!\S)[a-z0-9.]+@[a-z0-9.]+\.[a-z]{2,}(?!\S)", r"(?<!\S)(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?!\S)", r"(?<!\S)(?:(?:[1-9]\d?|1\d\d)\.){3}(?:[1-9]\d?|1\d\d)(?!\S)"):
            assert all(any(a <= m.start() and m.end() <= b for a, b in kept) for m in re.finditer(simple, text or ""))
    assert spans > 20 and all(len(new) == 1 for new in links.values())
    assert len({(kind, *new) for (kind, _), new in links.items()}) == len(links)


def test_key_of_the_session(spark, small):
    mine = lambda: [r.text for r in registry.QUERIES["op5_pseudonyms"](spark, small).orderBy("doc_id").collect()]
    first = mine()
    spark.conf.set("spark.reelmetrics.pseudonymKey", "another key")
    try:
        assert mine() != first
    finally:
        spark.conf.unset("spark.reelmetrics.pseudonymKey")
