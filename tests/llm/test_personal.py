import pytest

from gristmill.llm import personal

NAMES = personal.Names({"tovin", "ylva"}, {"orvane", "o'tarrow", "nakamori-voss"})


def got(text, names=NAMES):
    return [(text[a:b], k) for a, b, k in personal.entities(text, names)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to a.b+c@x-y.co.test, please", [("a.b+c@x-y.co.test", "email")]), ("GET /x?mail=a_b%40h.test&page=1", [("a_b%40h.test", "email")]), ("contact: kellan+m(at)clover dot example", [("kellan+m(at)clover dot example", "email")]), ("mail a_s at quarry-p dot test now", [("a_s at quarry-p dot test", "email")]), ("git clone git@ci.x.test:a/b.git", []), ("npm i @ember/f@4.1.2 cc @p63", []), ("<Sefa_o@CINDER.TEST>", [("Sefa_o@CINDER.TEST", "email")]),
        ("Tel. +33 1 99 92 39 83 or", [("+33 1 99 92 39 83", "phone")]), ("855.555.0139 ext. 101.", [("855.555.0139 ext. 101", "phone")]), ("((555) 555-0117)", [("(555) 555-0117", "phone")]), ("0044 20 7946 0680", [("0044 20 7946 0680", "phone")]), ("+34.900.634.122", [("+34.900.634.122", "phone")]), ("Build 931-18-463898 took 10.0.0.0/16 and 204401149000", []), ("Offsets 555-47 to 555-20, v1.2.3, 2020-10-09", []),
        ("SSN: 920-64-2893", [("920-64-2893", "id_number")]), ("ssn=956 13 6345", [("956 13 6345", "id_number")]), ("Passport: CM2074937 ", [("CM2074937", "id_number")]), ("Reisepass Nr. CM2074937", [("CM2074937", "id_number")]), ("Steuer-ID 34 478 260 496 and", [("34 478 260 496", "id_number")]), ("DNI 43106498-Y, lives", [("43106498-Y", "id_number")]), ("see issue #95042", []),
        ("go to 82A Alder Court, Apt 11, Norhaven, second floor", [("82A Alder Court, Apt 11, Norhaven", "address")]), ("at 39 rue des Aulnes, 90533 Norhaven", [("39 rue des Aulnes, 90533 Norhaven", "address")]), ("at Lindenstraße 316, 54667 Saltbridge", [("Lindenstraße 316, 54667 Saltbridge", "address")]), ("173 Alder Ave., Saltbridge 60870", [("173 Alder Ave., Saltbridge 60870", "address")]), ("fails on Route 66 Lane and Main Branch", []),
        ("Dr. Tovin Orvane said", [("Tovin Orvane", "name")]), ("Assignee: O'Tarrow, Ylva\n", [("O'Tarrow, Ylva", "name")]), ("TOVIN O’TARROW's file", [("TOVIN O’TARROW", "name")]), ("Tovin and Orvane, Ylva alone", [("Orvane, Ylva", "name")]), ("Ylva Nakamori-Voss <ylva.orvane@x.test>", [("Ylva Nakamori-Voss", "name"), ("ylva.orvane@x.test", "email")]), ("Bloom Filter", []), ("", []),
    ],
)
def test_entities(text, want):
    assert got(text) == want


def docs(spark):
    rows = [
        (1, "Author: Tovin Orvane <t@x.test>\n"), (2, "Signed-off-by: Tovin Orvane <t@x.test>"), (3, "As Orvane, Tovin wrote yesterday"), (4, "x Tovin Orvane (+33 1 99 92 39 83)."), (4, "x Tovin Orvane (+33 1 99 92 39 83)."),
        (5, None), (6, ""), (7, "nothing here"), (8, "Author: Solo Once <s@x.test>"), (9, "a" * 200_000 + " t@x.test"),
    ]
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, pii_type string, entities int")


def test_rows(spark):
    df = docs(spark)
    lex = {(r.role, r.word) for r in personal.name_lexicon(df).collect()}
    assert lex == {("g", "tovin"), ("f", "orvane")}  # one mention does not make a name
    rows = sorted((r.doc_id, r.start_pos, r.pii_type) for r in personal.personal_entities(df).collect())
    assert (3, 4, "name") in rows and (1, 9, "name") in rows and (1, 23, "email") in rows and (4, 17, "phone") in rows and (9, 200_002, "email") in rows and not [r for r in rows if r[0] in (5, 6, 7)]
    assert rows.count((4, 17, "phone")) == 2
    out = {r.doc_id: r.text for r in personal.pseudonymised(df, "k").collect()}
    assert out[5] is None and out[6] == "" and out[7] == "nothing here" and "Tovin" not in out[3]
    a, b = out[1].split()[1], out[3].split()[1]
    assert a == b and a.startswith("[NAME_") and out[3] == f"As {b} wrote yesterday"  # coreference, and the rest unchanged
    other = {r.doc_id: r.text for r in personal.pseudonymised(df, "another key").collect()}
    assert other[3] != out[3]
    assert personal.personal_entities(df.limit(0)).count() == 0


def test_surrogates_are_distinct(spark):
    found = personal.personal_entities(docs(spark), with_text=True)
    t = personal.surrogate_table(found, "k").collect()
    assert len({r.surrogate for r in t}) == len(t) == len({(r.pii_type, r.canon) for r in t})
    assert next(r for r in t if r.pii_type == "name" and "tovin" in r.canon).documents == 4


def test_lifelike_keeps_the_form():
    s = personal.realistic("Tovin O'Tarrow 42-B", personal.keyed(b"k", "name", "x"))
    assert len(s) == 19 and s[0].isupper() and s[6:8] != "Tovi" and s[7] == "'" and s[-4:-2].isdigit() and s != "Tovin O'Tarrow 42-B" and s[4] == "n"


def test_lexicon_bound(spark):
    with pytest.raises(ValueError):
        personal.learned_names(docs(spark), limit=1)


def test_name_of_one_place(spark):
    assert got("Author: Solo Once <s@x.test>", None) == [("Solo Once", "name"), ("s@x.test", "email")]
    assert got("Assignee: Once, Solo\n", None) == [("Once, Solo", "name")] and got("call Solo Once (+33 1 99 92 39 83)", None)[0] == ("Solo Once", "name")
    assert got("Author: the team <s@x.test>", None) == [("s@x.test", "email")]
    df = docs(spark)
    assert (8, 9, "name") in {(r.doc_id, r.start_pos, r.pii_type) for r in personal.personal_entities(df).collect()}
    assert "Solo" not in {r.doc_id: r.text for r in personal.pseudonymised(df, "k").collect()}[8]


@pytest.mark.parametrize("at", [" at ", "\tat\t", " AT ", " arroba ", "(at)", "[  at  ]", "{\tat }", "<at>", "[ ät ]", "(  @ )", "( chez )", "( arroba )"])
@pytest.mark.parametrize("dot", [" [.] ", " (.) ", " {dot} ", " [punkt] ", " (punto) ", "(\tdot  )", " dot ", "\tpunkt\t", "<point>"])
def test_spelt_out_emails(at, dot):
    mail = f"mara{at}example{dot}com"
    assert got(f"mail {mail}, please") == [(mail, "email")]


@pytest.mark.parametrize("lifelike", [False, True])
def test_texts_have_the_surrogates_of_the_table(spark, lifelike):
    people = [f"{g}l {f}o" for g in "AEIOU" for f in "BCDFGHKLM"]  # 45 of 80 surrogates of their form
    df = spark.createDataFrame([(i, f"Author: {p} <") for i, p in enumerate(people)], "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.text[len("Author: ") : -2] for r in personal.pseudonymised(df, "k", lifelike=lifelike).collect()}
    assert len(set(out.values())) == len(people)
    table = personal.surrogate_table(personal.personal_entities(df, with_text=True), "k", **({"lifelike": True} if lifelike else {})).collect()
    assert {r.surrogate for r in table} == set(out.values())
