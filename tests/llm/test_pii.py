"""Surrogates: scripts, formats, one number in two forms, and a whole table without leaks, clashes or lost coreference."""

import ipaddress
import re

import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import surrogates  # noqa: E402
from tidemark.llm.common import table  # noqa: E402


def rewrite(table_of, *texts):
    rows = [(i, t, None, None, 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["text"] for r in surrogates.pseudonymise(table_of(rows)).collect()}
    return [got[i] for i in range(len(texts))]


def test_names_keep_their_script(table_of):
    greek, other, repeat = rewrite(table_of, "Mr Παπαδάκης and κα Ελένη Παπαδάκη; Παπαδάκης", "Mr 王 met Mr כהן", "Mr 王 came")
    man, given, woman, again = re.fullmatch(r"Mr (\w+) and κα (\w+) (\w+); (\w+)", greek).groups()
    assert man == again == woman + "ς" and given.lower() in surrogates.GIVEN["greek", "f"]
    assert {surrogates.script_of(w) for w in (man, given, woman)} == {"greek"} and "Παπαδάκη" not in greek
    han, hebrew = re.fullmatch(r"Mr (\w+) met Mr (\w+)", other).groups()
    assert surrogates.script_of(han) == "cjk" and {surrogates.script_of(c) for c in hebrew} == {"hebrew"}
    assert han != "王" and hebrew != "כהן" and repeat == f"Mr {han} came"


def test_telephone_forms(table_of):
    one, two, abroad = rewrite(table_of, "555-123-4567, +1 555-123-4567", "+1 (555) 123 4567 / 555 123 4567",
                               "+49 30 1234567, +49301234567, 030/1234567, +33 1 23 45 67 89")
    digits = [re.sub(r"\D", "", p) for t in (one, two) for p in re.split(r", | / ", t)]
    assert len({d[-10:] for d in digits}) == 1 and [len(d) for d in digits] == [10, 11, 11, 10]
    assert digits[0] != "5551234567" and two.startswith("+1 (")
    spaced, plain, national, french = abroad.split(", ")
    assert re.fullmatch(r"\+49 \d\d \d{7}", spaced) and plain == spaced.replace(" ", "") and plain != "+49301234567"
    assert re.fullmatch(r"0\d\d/\d{7}", national) and national != "030/1234567"
    assert re.fullmatch(r"\+33 \d \d\d \d\d \d\d \d\d", french)


def test_more_formats(table_of):
    ssn, iban, six, none = rewrite(
        table_of, "123-45-6789 000-12-3456 666-12-3456", "DE89 3704 0044 0532 0130 00, DE89370400440532013000, DE88370400440532013000",
        "2001:db8::1 2001:0db8:0000:0000:0000:0000:0000:0001 fe80::1:2 ::1 12:30:45 std::a::b",
        "2024/01/02 5+5 = 10, +100 +2000 points, a::b, AB12 is short, 1-2-3")
    assert re.fullmatch(r"\d{3}-\d\d-\d{4} 000-12-3456 666-12-3456", ssn) and not ssn.startswith("123-45-6789")
    spaced, plain, wrong = iban.split(", ")
    assert spaced.replace(" ", "") == plain != "DE89370400440532013000" and wrong == "DE88370400440532013000"
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", spaced)
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    short, full, local, *rest = six.split(" ")
    assert ipaddress.ip_address(short) == ipaddress.ip_address(full) != ipaddress.ip_address("2001:db8::1")
    assert "::" in short and len(full) == 39 and local.startswith("fe80::") and rest == ["::1", "12:30:45", "std::a::b"]
    assert none.startswith("2024/01/02 5+5 = 10, +100 +2000 points, a::b, AB12 is short")


@pytest.mark.parametrize("kind, value", [
    ("phone", "4155550123"), ("phone", "+493012345"), ("national", "0301234567"), ("ssn", "123456789"),
    ("iban", "DE89370400440532013000"), ("ipv6", "2001:db8::1"), ("surname:greek:m", "παπαδάκη"), ("given:cjk:m", "王")])
def test_later_attempts_find_free_ones(kind, value):
    drawn = [surrogates.draw(surrogates.KEY, kind, value, attempt) for attempt in range(60)]
    assert len(set(drawn[24:])) > 20 and drawn == [surrogates.draw(surrogates.KEY, kind, value, a) for a in range(60)]


def test_whole_table(lspark):
    """Only entities change; one value has one surrogate, two values have two, and none is any entity's real value."""
    docs = table(lspark, "/root/testdata/sf0.01", "documents")
    new = {r["doc_id"]: r for r in surrogates.pseudonymise(docs).collect()}
    given, n = {}, 0
    for row in docs.select("doc_id", "text").collect():
        text, out = row["text"] or "", new[row["doc_id"]]["text"] or ""
        hits = surrogates.find(text)
        parts = [text[a:b] for a, b in zip([0] + [h[1] for h in hits], [h[0] for h in hits] + [len(text)])]
        pattern = "(.+?)".join(map(re.escape, parts))
        match = re.fullmatch(pattern, out, re.DOTALL)
        assert match and new[row["doc_id"]]["n_entities"] == len(hits), row["doc_id"]
        for (start, end, kind, value, ending), found in zip(hits, match.groups()):
            n += 1
            found = found.lower()
            if kind in ("phone", "card", "ssn", "iban", "national"):
                found = re.sub(r"[^0-9a-z]", "", found)[-10 if kind == "phone" and value[0] != "+" else 0:]
            given.setdefault((kind, value), set()).add(found.removesuffix(ending))
    assert n > 50 and all(len(v) == 1 for v in given.values())
    drawn = [(kind, *v) for (kind, _), v in given.items()]
    assert len(set(drawn)) == len(drawn)
    assert not set(drawn) & {(kind, value.lower()) for kind, value in given}
