"""Forms of values beyond those in the given tables."""

import pytest

from chatlake.llm import pii

HIDE, SHOW = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", invert=True)


@pytest.mark.parametrize("value, kind", [
    ("GB82 WEST 1234 5698 7654 32", "iban"), ("NL91ABNA0417164300", "iban"), ("IE29 AIBK 9311 5212 3456 78", "iban"),
    ("IT60X0542811101000000123456", "iban"), ("FR14 2004 1010 0505 0001 3M02 606", "iban"), ("BE68 5390 0754 7034", "iban"),
    ("(212) 555-0187", "phone"), ("212-555-0187", "phone"), ("1-212-555-0187", "phone"), ("212.555.0187", "phone"),
    ("+33 6 12 34 56 78", "phone"), ("06 12 34 56 78", "phone"), ("+1 (212) 555-0187", "phone"),
    ("2024-02-29", "date"), ("25/12/1999", "date"), ("13/1/2001", "date"), ("12/25/1999", "date"),
    ("1990/12/25", "date"), ("2001/3/07", "date"), ("jörg@example.com", "email"), ("i@x.com", "email")])
def test_form(value, kind):
    for before, after in (("", ""), ("see ", "."), ("x ", " THEN 12"), ("(", ")")):
        new, found = HIDE.replace(before + value + after)
        assert found == [(len(before), len(before) + len(value), kind)]
        body = new[len(before):len(new) - len(after)]
        assert new.startswith(before) and new.endswith(after) and body != value
        shape = lambda s: ["9" if c.isdigit() else "A" if c.isalpha() else c for c in s]
        assert shape(body) == shape(value)
        assert SHOW.replace(new) == (before + value + after, found)


def test_timestamp_keeps_its_time():
    new, found = HIDE.replace("at 2024-02-29T10:00:00Z.")
    assert found == [(3, 13, "date")] and new.endswith("T10:00:00Z.") and "2024-02-29" not in new
    assert SHOW.replace(new)[0] == "at 2024-02-29T10:00:00Z."


def test_the_whole_subscriber_number_moves():
    new = {HIDE.replace(f"+1 (212) 555-{i:04d}")[0][9:12] for i in range(40)}
    assert len(new) > 20


def test_no_values():
    text = "GB82 WEST 1234 5698 7654 33, 112-555-0187, 30/30/1999, 2024-02-30T10:00, 00 12 34 56 78"
    assert HIDE.replace(text) == (text, [])


def test_no_value_stays_as_it_is():
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        new = HIDE.replace(f"{c}@x.com")[0]
        assert new != f"{c}@x.com" and SHOW.replace(new)[0] == f"{c}@x.com"
    for size in (2, 3, 10, 26, 997):
        moved = [HIDE._move("t", size, x) for x in range(size)]
        assert sorted(moved) == list(range(size)) and all(x != y for x, y in enumerate(moved))
        assert [SHOW._move("t", size, y) for y in moved] == list(range(size))


def test_letters_stay_in_their_alphabet():
    for local in ("jörg", "почта", "Ünal.Øst7", "联系我abc", "αβγ"):
        new, found = HIDE.replace(f"{local}@example.com")
        assert found == [(0, len(local) + 12, "email")] and new.endswith("@example.com") and new != f"{local}@example.com"
        assert [pii._alphabet(c) for c in new] == [pii._alphabet(c) for c in f"{local}@example.com"]
        assert SHOW.replace(new)[0] == f"{local}@example.com"
    assert HIDE.replace("ქართ@example.com") == ("ქართ@example.com", [])
