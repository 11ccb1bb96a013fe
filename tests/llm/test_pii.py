import hashlib
import random
import re

import pytest

from weirlog.llm import pii

from cases import documents, empty

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PIECES = ["a@b.c", "@", "a", ".", "1", "12", "255", "256", "4242424242424242", "4111 1111-1111 1111", "+1 ", "(", ")", "-", " ", "é", "é@x.y", "b.", "+49 30 1234567", "\n", "00000000000000"]


def brute(text):
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[name]
            if ok():
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(15)))
        assert [s[:3] for s in pii.spans(text) if s[1] < 4] == brute(text)


@pytest.mark.parametrize(("text", "kinds"), [("DE89 3704 0044 0532 0130 00", ["iban"]), ("DE88 3704 0044 0532 0130 00", []), ("GB82WEST12345698765432 and", ["iban"]), ("my ssn 123-45-6789", ["id"]), ("part 123-45-6789", []), ("1.2.3.4", ["ip"]), ("1.2.3.999", []), ("mail a.b@c.org!", ["email"])])
def test_kinds(text, kinds):
    assert [pii.KINDS[s[1]] for s in pii.spans(text)] == kinds


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 100_000, "AB12" * 50_000, "+" + "(" * 200_000):
        pii.spans(text)


def test_digest_and_counts(spark):
    rows = {r["doc_id"]: r for r in pii.find(spark.createDataFrame([(1, "write to a@b.co or +1 212 555 0100"), (2, None)], "doc_id long, text string")).collect()}
    assert (rows[1]["n_email"], rows[1]["n_phone"], rows[1]["spans"]) == (1, 1, "email:9:15,phone:19:34")
    assert rows[1]["base_sha256"] == hashlib.sha256(b"email:9:15,phone:19:34").hexdigest()
    assert rows[2]["spans"] == "" and rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[2]["max_score"] is None


def test_redact_keeps_rows_and_columns(spark):
    docs = documents(spark)
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == docs.count()
    one = spark.createDataFrame([(1, "call +1 212 555 0100 or a@b.co."), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(one).orderBy("doc_id").collect()] == ["call [PHONE] or [EMAIL].", None]
    assert pii.find(empty(spark)).count() == 0


@pytest.mark.parametrize(("text", "end"), [("IBAN CZ6508000000192000145399 BIC ABCD", 29), ("iban XX23 8000 0000 1920 0014 53 ABC 1", 0), ("bank CZ65 0800 0000 1920 0014 5399 AND MORE", 34)])
def test_number_before_other_words(text, end):
    found = [x for x in pii.spans(text) if x[1] == 4]
    assert [x[2] for x in found] == ([end] if end else [])


def test_unlisted_country_ends_at_a_word():
    body = "8000000019200014"
    check = next(f"{n:02d}" for n in range(2, 99) if pii.mod97(f"XX{n:02d}{body}"))
    text = f"account XX{check}{body} PLEASE NOTE"
    assert [(a, b) for a, k, b, _ in pii.spans(text) if k == 4] == [(8, 8 + 20)]
