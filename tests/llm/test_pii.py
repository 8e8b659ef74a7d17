from __future__ import annotations

import re

import pytest
from rowferry.llm import pii, queries

FOUND = {
    "email": r"[\w.+-]+@[\w.-]+\w", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}", "card": r"(?<![\w-])\d{16}(?!\w)",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w)",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_query_replaces_every_entity_and_nothing_else(spark, sf):
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    new = {r.doc_id: r for r in queries.QUERIES["op1_pii"](spark, sf).collect()}
    assert set(old) == set(new)
    pattern = re.compile("|".join(f"(?P<{k}>{p})" for k, p in FOUND.items()))
    stand: dict[str, str] = {}
    for d, text in old.items():
        matches = list(pattern.finditer(text))
        assert new[d].n_entities == len(matches)
        at, gaps = 0, []
        for m in matches:
            gaps.append(re.escape(text[at:m.start()]))
            gaps.append(f"({FOUND[m.lastgroup]})")
            at = m.end()
        fitted = re.fullmatch("".join(gaps) + re.escape(text[at:]), new[d].text)
        assert fitted, d
        for m, got in zip(matches, fitted.groups()):
            assert got != m.group() and stand.setdefault(m.group(), got) == got
            assert m.lastgroup == "ip" or re.sub(r"\w", "x", got) == re.sub(r"\w", "x", m.group())
            assert m.lastgroup != "card" or luhn(got) and got[0] == m.group()[0]
            assert m.lastgroup != "ip" or all(0 < int(x) < 255 for x in got.split("."))
    assert len(set(stand.values())) == len(stand) > 10
    assert not any(v in stand for v in stand.values())


def texts(spark, *rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return [r.text for r in pii.replaced(df, secret="k").orderBy("doc_id").collect()]


def test_spellings_of_one_thing_share_a_surrogate(spark):
    a, b, c, d = texts(spark, "call +1 (988) 555-2485 now", "or +1 988 555 2485.", "write A.Person@Mail.example.org", "a.person@mail.example.org")
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(a) == digits(b) != "19885552485" and digits(a)[:1] == "1"
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} now", a) and re.fullmatch(r"or \+1 \d{3} \d{3} \d{4}\.", b)
    assert re.fullmatch(r"write [A-Z]\.[A-Z][a-z]{5}@[A-Z][a-z]{3}\.[a-z]{7}\.org", c) and c[6:].lower() == d


def test_names_keep_gender_script_case_and_coreference(spark):
    a, b, c, d, e = texts(spark, "Mrs Ada Byron met Mr. John Byron.", "Then Mrs Byron left; MR BYRON and Mr BYRON stayed",
                          "г-жа Иванова и г-н Петров", "Frau Müller-Lüdenscheid", "Herr Γεωργίου")
    first = re.fullmatch(r"Mrs (\w+) (\w+) met Mr\. (\w+) (\w+)\.", a).groups()
    assert first[1] == first[3] != "Byron" and first[0][-2:] in ("na", "te", "ia", "ne") and first[2][-2:] in ("on", "rt", "nd", "ic")
    assert b == f"Then Mrs {first[1]} left; MR BYRON and Mr {first[1].upper()} stayed"
    woman, man = re.fullmatch(r"г-жа ([А-Яа-я]+) и г-н ([А-Яа-я]+)", c).groups()
    assert woman.endswith(("ова", "ева", "ина", "ская")) and man.endswith(("ов", "ев", "ин", "ский"))
    assert re.fullmatch(r"Frau [A-Z][a-z]+", d) and "ller" not in d and re.fullmatch("Herr [Α-Ωα-ωά-ώ]+", e) and "Γεωρ" not in e


def test_clean_texts_stay(spark):
    clean = ["Version 1.2.3.4.5 of 2024-01-02, 10:30", "a1b2c3 4565410125667261abc x@y", "@ 12345 +1", "3.14159 and 1,000,000",
             "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae", "Mr fox and Dr no", "x" * 3000 + "@"]
    assert texts(spark, *clean) == clean


def test_odd_rows_and_collisions(spark, odd_documents, no_documents):
    got = sorted((str(r.doc_id), str(r.text)) for r in pii.replaced(odd_documents, secret="k").collect())
    assert got == sorted((str(r.doc_id), str(r.text)) for r in odd_documents.collect())
    assert pii.replaced(no_documents, secret="k").count() == 0
    # 250 numbers of four digits draw from 10,000: some collide at first, or with a number that is there.
    mentions = spark.createDataFrame([("phone", f"{i:04d}") for i in range(250)], "type string, name string")
    rows = pii.stand_ins(mentions, "key").collect()
    assert len({r.surrogate for r in rows}) == 250 and not {r.surrogate for r in rows} & {r.name for r in rows}
    assert sorted(rows) == sorted(pii.stand_ins(mentions, "key").collect())
    assert {r.surrogate for r in pii.stand_ins(mentions, "other").collect()} != {r.surrogate for r in rows}


def test_repeated_rows_with_entities(spark):
    rows = [(1, "ip 10.0.0.1 x"), (1, "ip 10.0.0.1 x"), (None, "ip 10.0.0.1 y"), (2, "10.0.0.1")]
    got = pii.replaced(spark.createDataFrame(rows, "doc_id long, text string"), secret="k").collect()
    assert len(got) == 4 and all(r.n_entities == 1 for r in got)
    assert len({re.search(r"\d+\.\d+\.\d+\.\d+", r.text).group() for r in got}) == 1


def test_full_spaces_end(spark):
    """All 100 addresses of one figure and a domain of one figure, all phones of two figures, and names of one
    letter in a script without syllables: surrogates get longer."""
    mails = texts(spark, " ".join(f"{a}@{b}.de" for a in range(10) for b in range(10)))[0].split()
    pairs = [m.split("@") for m in mails]
    assert len(set(mails)) == 100 and all(not re.fullmatch(r"\d@\d\.de", m) and m.endswith(".de") for m in mails)
    assert [p[0] for p in pairs[::10]] == [p[0] for p in pairs[9::10]] and len({p[1] for p in pairs}) == 10
    for kind, names in (("phone", [f"{i:02d}" for i in range(100)]), ("ssn", list("0123456789")), ("last-n", [chr(0x5d0 + i) for i in range(27)])):
        rows = pii.stand_ins(spark.createDataFrame([(kind, n) for n in names], "type string, name string"), "k").collect()
        assert len({r.surrogate for r in rows}) == len(names) and not {r.surrogate for r in rows} & set(names)


def test_a_space_that_cannot_grow_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "DRAWS", 2)
    cards = spark.createDataFrame([("card", f"4{i}") for i in range(10)], "type string, name string")  # each has the next as its only value
    with pytest.raises(pii.NoSurrogate, match="card"):
        pii.stand_ins(cards, "k")
    with pytest.raises(ValueError):
        pii.stand_ins(cards, "")


def test_people_of_a_domain_share_it(spark):
    a, b, c = texts(spark, "ada@mail.example.org and Bob@Mail.Example.org", "ada@other.net", "bob@other.net")
    x, y = re.fullmatch(r"([a-z]{3})@([a-z]{4}\.[a-z]{7})\.org and ([A-Z][a-z]{2})@([A-Z][a-z]{3}\.[A-Z][a-z]{6})\.org", a).group(1, 2), re.findall(r"(\w+)@([\w.]+)\.org", a)[1]
    assert x[1] == y[1].lower() and a.split("@")[0] == b.split("@")[0] and c.split("@")[0] == y[0].lower() and b.split("@")[1] == c.split("@")[1]


def test_single_names_of_known_people(spark):
    a, b, c, d, e = texts(spark, "Mrs Ada Byron", "Mrs Ada", "Mr Ada", "Mr Byron", "Mrs Grace")
    first, last = a.split()[1:]
    assert b == f"Mrs {first}" and c.split()[1] not in (first, last) and d == f"Mr {last}"
    assert e.startswith("Mrs ") and e.split()[1] not in ("Grace", first, last)
    assert texts(spark, "Dr Ada Ada and Dr Ada")[0].split()[-1] == texts(spark, "Dr Ada Ada and Dr Ada")[0].split()[2]


def test_more_forms(spark):
    given = ["371449635398431", "3714 496353 98431", "2221 0000 0000 0009", "1-800-555-1234", "1 800 555 1234", "2001:db8::8a2e:370:7334",
             "FE80:0000:0000:0000:0202:B3FF:FE1E:8329", "fe80::1"]
    got = texts(spark, *[f"x {g} y" for g in given])
    for g, t in zip(given, got):
        new = t[2:-2]
        assert new != g and re.sub("[0-9A-Fa-f]", "0", new) == re.sub("[0-9A-Fa-f]", "0", g), (g, t)
    assert all(luhn(re.sub(r"\D", "", t[2:-2])) for t in got[:3]) and all(t[2:4] == "37" for t in got[:2])
    assert 2221 <= int(got[2][2:6]) <= 2720 and all(re.match(r"x 1.[2-9]\d\d.[2-9]\d\d.\d{4} y", t) for t in got[3:5])
    assert got[0][2:-2] == re.sub(" ", "", got[1][2:-2]) and got[3][2:-2] == got[4][2:-2].replace(" ", "-") and got[6] == "x " + got[6][2:-2].upper() + " y"
    clean = ["std::vector a::b at 10:30:45 and 12:00", "dead::beef", "2024-01-02T10:30:00 ratio 1:2", "2220123412341234", "123 456"]
    assert texts(spark, *clean) == clean
