"""PII surrogates of forms that the corpus fills, of any script, and of the parts of names."""

from tests.llm.test_operators import docs
from tidewater.llm import pii


def surrogates(spark, rows, kind):
    """Each row's text is one entity: {text: its surrogate}."""
    got = {r.doc_id: r for r in pii.replace(docs(spark, list(enumerate(rows))), b"key").collect()}
    assert all(r.kinds == [kind] for r in got.values())
    return {t: got[i].text for i, t in enumerate(rows)}


def test_a_full_form_gets_longer_surrogates(spark, monkeypatch):
    monkeypatch.setattr(pii, "MAX_ROUNDS", 3)
    rows = [f"{a}@{b}.com" for a in "aeiou" for b in "aeiou"]
    out = surrogates(spark, rows, "email")
    assert len(set(out.values())) == 25 and not set(out.values()) & set(rows)


def test_any_script_has_an_alphabet(spark):
    rows = ["สมชาย@ไทย.คอม", "աննա@փոստ.հայ", "٠٥٠-١٢٣-٤٥٦٧"]
    assert [k for t in rows for _, _, k in pii.find(t)] == ["email", "email", "phone"]
    got = {r.doc_id: r.text for r in pii.replace(docs(spark, list(enumerate(rows))), b"key").collect()}
    for i, t in enumerate(rows):
        assert got[i] != t and len(got[i]) == len(t) and not any(a == b for a, b in zip(got[i].split("@"), t.split("@"), strict=True))


def test_forms_that_only_lengthen():
    for kind, value in (("card", "4111 1111 1111 1111"), ("ip", "10.1.2.3"), ("ssn", "123-45-6789"), ("phone", "012 345")):
        made = [pii.surrogate(kind, value, b"k", pii.MAX_ROUNDS + i) for i in range(4)]
        assert len(set(made)) == 4 and all(len(m) > len(value) for m in made)
    assert all(pii._luhn(pii.surrogate("card", "4111111111111111", b"k", pii.MAX_ROUNDS + i)) for i in range(4))


def test_names_are_replaced_part_by_part(spark):
    # Li is one of 105 strings of its form; all of them but a few are in use, so a permutation alone leaves some in clear.
    short = [a + b for a in "BCDFGHJKLMNPQRSTVWXYZ" for b in "aeiou"]
    rows = [f"Mr. {n}" for n in short] + ["Frau Zofia Nowak", "Ms. Anna", "Anna Nowak", "Herr Zbigniew Nowak", "Ms. Martin", "Peter Martin", "Mr. Martin"]
    rows += [f"{n} Nowak" for names in pii.GIVEN.values() for n in names]
    got = {t: x.split(" ") for t, x in surrogates(spark, rows, "person").items()}
    assert not any(a == b for t, x in got.items() for a, b in zip(t.split(" ")[-2 if " Nowak" in t else -1 :], x[-2 if " Nowak" in t else -1 :], strict=True))
    new = {got[f"Mr. {n}"][1] for n in short}
    assert len(new) == len(short) and not new & set(short)
    assert all(n in pii.GIVEN["f", "latin"] for n in got["Frau Zofia Nowak"][1].split("-"))
    assert all(n in pii.GIVEN["m", "latin"] for n in got["Herr Zbigniew Nowak"][1].split("-"))
    assert got["Ms. Anna"][1] == got["Anna Nowak"][0] in pii.GIVEN["f", "latin"]
    assert got["Ms. Martin"][1] == got["Peter Martin"][1] == got["Mr. Martin"][1] not in pii._GENDER
    assert len({x[-1] for t, x in got.items() if t.endswith("Nowak")}) == 1
    for k, names in pii.GIVEN.items():
        assert {got[f"{n} Nowak"][0] for n in names} == set(names), k


def test_coreference_and_distinctness_over_a_corpus(spark, monkeypatch):
    """Entities of small and nearly full forms in several scripts, spread over documents, against the definitions:
    one surrogate an entity, none for two, none that is an entity of the corpus, and the same types found again."""
    import random

    monkeypatch.setattr(pii, "MAX_ROUNDS", 4)
    r = random.Random(11)
    letters = {"latin": "abcdefg", "cyrillic": "абвгд", "thai": "กขค", "arabic": "ابت", "cjk": "一丁七"}
    pool = [f"{a}{b}@{c}.com" for abc in letters.values() for a in abc for b in abc for c in abc[:2]]
    pool += [f"0{i}{j} {k:03d}" for i in range(10, 13) for j in range(3) for k in range(0, 1000, 9)]
    pool += [f"{i}.{j}.0.1" for i in range(1, 20) for j in range(5)] + [f"{i:03d}-{j:02d}-{k:04d}" for i in (1, 2) for j in range(4) for k in range(0, 9999, 777)]
    pool += [f"{t} {n}" for t in ("Mr.", "Frau") for n in ("Stone", "Li", "Bo", "Ёлкин", "Παπάς")]
    rows = [" | ".join(r.sample(pool, 12)) for _ in range(250)]
    rows += [" | ".join(pool[i : i + 12]) for i in range(0, len(pool), 12)]
    made: dict[str, str] = {}
    for row in pii.replace(docs(spark, list(enumerate(rows))), b"key").collect():
        before, after = rows[row.doc_id].split(" | "), row.text.split(" | ")
        assert len(before) == len(after) == row.n_entities
        for a, b in zip(before, after, strict=True):
            assert made.setdefault(a, b) == b, a
            assert [k for _, _, k in pii.find(a)] == [k for _, _, k in pii.find(b)] or ":" in b, (a, b)
    assert len(made) == len(pool) == len(set(pool))
    plain = {a: b for a, b in made.items() if not a.startswith(("Mr.", "Frau"))}
    assert len(set(plain.values())) == len(plain) and not set(plain.values()) & set(plain)
    names = {a.split(" ")[1]: b.split(" ")[1] for a, b in made.items() if a not in plain}
    assert len(set(names.values())) == len(names) and not set(names.values()) & set(names)
    assert made["Mr. Stone"].split(" ")[1] == made["Frau Stone"].split(" ")[1]


def hostile(n):
    """Texts on which patterns that go back and forth take more than time in proportion."""
    return {
        "digits": "1" * n, "dashes": "1" + "-" * n, "letters": "a" * n, "capitals": "A" * n, "number and letter": "0123-" + "4" * n + "x", "spaced": "0123-456" + " 78" * (n // 3) + "x",
        "slugs": "ab-" * (n // 3), "keys": "aB-" * (n // 3), "late digit": "aB-" * (n // 3) + "1", "dashed digits": "1-" * (n // 2), "key and letter": "aB1-" * (n // 4) + "é",
        "ats": "a@" * (n // 2), "dots": "a." * (n // 2), "mail": "a@" + "a." * (n // 2), "colons": "a:" * (n // 2), "double": "a::" * (n // 3), "names": "Anna " * (n // 5), "caps": "ANNA " * (n // 5), "titles": "mr. " * (n // 4),
        "hyphens": "Anna-" * (n // 5), "plus": "+1 " * (n // 3), "brackets": "(123) " * (n // 6), "hex": "0a" * (n // 2), "iban": "DE12 " * (n // 5), "blanks": " " * n, "zero": "0123 " * (n // 5), "sk": "sk-" * (n // 3), "ips": "1." * (n // 2),
    }


def test_time_is_in_proportion_to_the_text():
    import time

    def took(t):
        began = time.perf_counter()
        pii.find(t)
        return time.perf_counter() - began

    small, large = hostile(100_000), hostile(1_000_000)
    for name, t in large.items():
        a, b = min(took(small[name]) for _ in range(2)), took(t)
        assert b < 3 and b < 30 * a + 0.3, (name, a, b)


def test_keys_in_runs_by_definition():
    """A key begins at a run's beginning or behind a dash of it, where the part up to the next dash has both cases, a digit follows, and
    28 characters are left."""
    import random
    import re

    def plain(t):
        out, at = [], 0
        while at < len(t):
            m = re.compile(r"(?<!\w)(?=[A-Za-z_-]*\d)(?=[A-Za-z0-9_]*[a-z])(?=[A-Za-z0-9_]*[A-Z])[A-Za-z0-9_-]{28,}(?!\w)").search(t, at)
            if not m:
                break
            out.append((m.start(), m.end(), "secret"))
            at = m.end()
        return out

    r = random.Random(2)
    for _ in range(4000):
        t = "".join(r.choice(["a", "B", "1", "-", "_", "aB3xYz9q", "abcdefgh", "ABC-", "é", " "]) for _ in range(r.randint(1, 30)))
        got, want = pii._keys(t), plain(t)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want], t


def test_names_of_other_spellings():
    found = lambda t: [t[a:b] for a, b, k in pii.find(t) if k.startswith("person")]
    for t, names in {
        "Meet Jean-Luc Picard now": ["Jean-Luc Picard"], "from John O\u2019Brien.": ["John O\u2019Brien"], "Mr. O'Neill left": ["O'Neill"], "says mr. john smith said": ["john smith"], "ANNA STONE, 1990": ["ANNA STONE"],
        "MRS. STONE": ["STONE"], "dr. and mrs. miller are": ["miller"], "THE UNITED NATIONS": [], "mr. and mrs.": [], "Mr. Stone": ["Stone"], "Contact Zofia Nowak now": [],
    }.items():
        assert found(t) == names, t
    assert [k for _, _, k in pii.find("at 2001:db8::8a2e:370:7334 and fe80::1, a::b, 12:30:45")] == ["ip6"] * 1 + ["ip6"]


def test_spellings_keep_their_form(spark):
    rows = ["ANNA STONE", "Anna Stone", "mr. john smith", "2001:db8::8a2e:370:7334"]
    got = {r.doc_id: r.text for r in pii.replace(docs(spark, list(enumerate(rows))), b"key").collect()}
    assert got[0].isupper() and got[0].split()[0] == got[1].split()[0].upper() and got[2].startswith("mr. ") and got[2].islower()
    assert [k for _, _, k in pii.find(got[3])] == ["ip6"] and got[3] != rows[3]
