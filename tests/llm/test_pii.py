import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from epilode.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    odd = [int(c) for c in d[::-1][0::2]]
    even = [sum(divmod(2 * int(c), 10)) for c in d[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def brute(text):
    """Base spans straight from the patterns."""
    text, out = text or "", []
    out += [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and plain_luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def base(text):
    return [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab@@..0123456789+-- ()_%é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([
    "4425414259157784", "4111 1111 1111 1111", "+1 (319) 555-5132", "a.b@mail.example.com", "39.197.112.39", "1.2.3.4.5.6.7.8", " ", ",", ".",
    "-", "999.1.1.1", "0001.2.3.0255", "@", "a@b", "x@y.z@w.v", "+", "12", "+49 89 123456-7", "é🙂",
]), max_size=12).map("".join))
def test_base_spans_of_joined_parts(text):
    assert base(text) == brute(text)


def test_more_kinds():
    def kinds(text):
        return [(s[0], text[s[1] : s[2]]) for s in pii.find_spans(text) if s[0] not in pii.BASE]

    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00.") == []
    assert kinds("GB82WEST12345698765432 x") == [("iban", "GB82WEST12345698765432")]
    assert kinds("his ssn is 123-45-6789.") == [("ssn", "123-45-6789")]
    assert kinds("part 123-45-6789.") == [] and kinds("ssn 666-45-6789, 123-00-6789") == []
    assert kinds("call (319) 555-5132 now") == [("tel", "(319) 555-5132")]
    assert kinds("phone 319-555-5132") == [("tel", "319-555-5132")]
    assert kinds("box 319-555-5132") == [] and kinds("call +1 (319) 555-5132") == []


def test_context_moves_the_score():
    def one(text):
        return pii.find_spans(text)[0][3]

    assert one("version 1.2.3.4") < one("at 1.2.3.4") < one("server 1.2.3.4")
    assert one("card 4425414259157784") > one("x 4425414259157784") > one("order 4425414259157784")


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("1" * 300_000, "1." * 150_000, "1 " * 150_000, "a" * 300_000 + "@" + "b" * 300_000, "+1" + "(" * 300_000, "a@" * 100_000,
                 "@" * 200_000, "AB12" * 60_000, "123-45-" * 40_000, "+" * 100_000 + "1"):
        pii.find_spans(text)
    assert time.time() - began < 20


def test_redaction():
    text = "to a.b@c.de or +1 (319) 555-5132, 4111 1111 1111 1111."
    assert pii.redact_text(text, pii.find_spans(text)) == "to [EMAIL] or [PHONE], [CARD]."


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = entry.queries()["op4_pii"](spark, folder).collect()
    assert len(rows) == len(texts) and sum(r.n_email for r in rows) and sum(r.n_card for r in rows)
    for r in rows:
        want = brute(texts[r.doc_id])
        digest = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in pii.BASE)
        assert set(digest.split(",")) - {""} <= set(r.spans.split(","))


def test_edge_rows(docs_of):
    rows = [(None, "a@b.cd"), (1, None), (1, ""), (2, "é🙂 a@b.cd"), (2, "é🙂 a@b.cd"), (3, "x " * 100_000 + "a@b.cd")]
    out = pii.find(docs_of(rows))
    assert out.columns[:-1] == docs_of(rows).columns
    got = sorted((r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.pii.spans]) for r in out.collect())
    assert got == [
        (0, [("email", 0, 6)]), (1, []), (1, []), (2, [("email", 3, 9)]), (2, [("email", 3, 9)]), (3, [("email", 200_000, 200_006)]),
    ]
    assert pii.find(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        pii.find(docs_of(rows), into="n")
