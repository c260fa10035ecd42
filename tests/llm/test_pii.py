import re

from pyspark.sql import functions as F

from taxaspark.llm import pii

ROWS = [
    (1, "Call Mr. John Smith at +1 (578) 555-6437 or john.smith@mail.example.com. Mr. Smith said 17.252.227.210, 4111 1111 1111 1111."),
    (2, "Mrs. Anna Smith, (578) 555-6437; JOHN.SMITH@MAIL.EXAMPLE.COM, GB82 WEST 1234 5698 7654 32 and 078-05-1120."),
    (3, "Господин Иван Петров; Κυρία Μαρία Παππά; Frau Müller. 4111-1111-1111-1111"),
    (4, None), (5, ""), (6, "Nothing here: 2020, 12.5, 3.14.15, abc@, @home, hex 94be4dd6d402559f"), (None, "a@b.org"), (1, "a@b.org"),
]


def replaced(spark, rows, secret="k"):
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("row", F.lit(1)).withColumn("kind", F.lit("x")).withColumn("found", F.lit("y"))
    out = pii.with_surrogates(docs, secret).select("doc.*", "kinds")
    assert out.columns == [*docs.columns, "kinds"]
    return out.orderBy("doc_id", "text").collect()


def luhn(number):
    d = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def test_form_gender_script_and_coreference(spark):
    got = {r["doc_id"]: r["text"] for r in replaced(spark, ROWS)}
    one = re.fullmatch(r"Call Mr\. (\w+us|\w+o|\w+en) (\w+) at \+1 (\(\d{3}\) \d{3}-\d{4}) or ([a-z]+\.[a-z]+@[a-z]+\.[a-z]+\.com)\. Mr\. (\w+) said ([\d.]+), (\d{4} \d{4} \d{4} \d{4})\.", next(r["text"] for r in replaced(spark, ROWS[:1])))
    assert one and one[2] == one[5] and luhn(one[7]) and one[7] != "4111 1111 1111 1111"
    two = re.fullmatch(r"Mrs\. (\w+a) (\w+), (\(\d{3}\) \d{3}-\d{4}); ([A-Z.@]+), (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) and (\d{3}-\d\d-\d{4})\.", got[2])
    assert two and two[2] == one[2] and two[3] == one[3] and two[4] == one[4].upper()
    account = two[5].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1
    three = re.fullmatch(r"Господин ([а-я]+) ([а-я]+); Κυρία ([α-ω]+α) ([α-ω]+); Frau ([a-z]+)\. (\d{4}-\d{4}-\d{4}-\d{4})", got[3], re.IGNORECASE)
    assert three and three[6].replace("-", " ") == one[7]
    assert got[4] is None and got[5] == "" and got[6] == ROWS[5][1]


def test_no_entity_is_left_and_keys_differ(spark):
    texts = " ".join(r["text"] or "" for r in replaced(spark, ROWS))
    for real in ("Smith", "John", "555-6437", "john.smith", "17.252", "4111", "WEST", "078-05", "Иван", "Петров", "Παππά", "Müller", "a@b.org"):
        assert real not in texts
    assert replaced(spark, ROWS) == replaced(spark, ROWS)
    assert replaced(spark, ROWS) != replaced(spark, ROWS, "other")


def test_many_entities_stay_distinct(spark):
    names = ["Ann" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(600)]
    rows = [(i, f"Mrs. {n} Ro{n.lower()}: {i % 256}.{i // 256}.7.9, {n.lower()}@x.org") for i, n in enumerate(names)] + [(1000 + i, "Mr. Hot Host hot@x.org") for i in range(300)]
    got = {r["doc_id"]: r["text"] for r in replaced(spark, rows)}
    parts = [re.fullmatch(r"Mrs\. (\w+) (\w+): ([\d.]+), (\S+)", got[i]).groups() for i in range(600)]
    for column in zip(*parts, strict=True):
        assert len(set(column)) == 600
    assert not {x for p in parts for x in p[3:]} & {r[1].split()[-1] for r in rows}
    assert len({got[1000 + i] for i in range(300)}) == 1


def test_surrogates_that_meet_are_drawn_again(spark, monkeypatch):
    def narrow(kind, norm, attempt, secret):
        return F.concat(F.lit("s"), F.pmod(F.xxhash64(norm, attempt), F.lit(40)).cast("string"))

    monkeypatch.setattr(pii, "surrogate", narrow)
    entities = spark.createDataFrame([("email", f"s{i}" if i < 3 else f"n{i}") for i in range(20)], "kind string, norm string")
    got = pii.assigned(entities, "k").collect()
    made = [r["surrogate"] for r in got]
    assert len(set(made)) == 20 and not {"s0", "s1", "s2"} & set(made)


def test_empty_table_and_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 100_000 + "me@x.org")], "doc_id int, text string")
    assert pii.with_surrogates(docs.limit(0), "k").count() == 0
    out = pii.with_surrogates(docs, "k").first()
    assert out["kinds"] == ["email"] and out["doc"]["text"].startswith("word " * 100_000) and "me@x.org" not in out["doc"]["text"]


def test_bare_mentions_and_particles(spark):
    rows = [
        (1, "Dr. Maria Garcia spoke. Garcia said: MARIA's garcia, Garciamar. Garcia's own."),
        (2, "Mr Jan van der Berg left; Berg, Jan."),
        (3, "Garcia and Berg are not people of this row: x@y.org"),
        (4, "Mrs. Ana Luz Mar Sol Paz Vega's house. Vega. Κυρία Μαρία Παππά, Παππά"),
    ]
    got = {r["doc_id"]: r["text"] for r in replaced(spark, rows)}
    one = re.fullmatch(r"Dr\. (\w+) (\w+) spoke\. (\w+) said: (\w+)'s garcia, Garciamar\. (\w+)'s own\.", got[1])
    assert one and one[2] == one[3] == one[5] != "Garcia" and one[4] == one[1].upper() != "MARIA"
    two = re.fullmatch(r"Mr (\w+) van der (\w+) left; (\w+), (\w+)\.", got[2])
    assert two and two[1] == two[4] != "Jan" and two[2] == two[3] != "Berg"
    assert got[3].startswith("Garcia and Berg are not")
    assert not re.search("Ana|Luz|Mar|Sol|Paz|Vega|Παππά", got[4]) and "'s house" in got[4]


def test_all_short_addresses_of_a_host_get_surrogates(spark):
    norms = [f"{i}@x.org" for i in range(10, 100)] + [f"{chr(97 + i)}@y.org" for i in range(26)]
    got = pii.assigned(spark.createDataFrame([("email", n) for n in norms], "kind string, norm string"), "k").collect()
    made = {r["surrogate"] for r in got}
    assert len(got) == len(made) == len(norms) and not made & set(norms)


def test_one_surrogate_under_all_titles(spark):
    rows = [
        (1, "Dr. Maria Garcia met us. Mrs. Maria Garcia left. My name is Maria Garcia."),
        (2, "Prof. Maria spoke; Maria agreed."),
        (3, "Mr. Luca Bianchi. Mr. Luca Bianchi. Mr. Luca."),
        (4, "Mrs. Luca Verdi."),
    ]
    got = {r["doc_id"]: r["text"] for r in replaced(spark, rows)}
    one = re.fullmatch(r"Dr\. (\w+) (\w+) met us\. Mrs\. (\w+) (\w+) left\. My name is (\w+) (\w+)\.", got[1])
    assert one and one[1] == one[3] == one[5] != "Maria" and one[2] == one[4] == one[6] != "Garcia"
    assert got[2] == f"Prof. {one[1]} spoke; {one[1]} agreed."
    assert one[1][-1] == "a"
    three = re.fullmatch(r"Mr\. (\w+) (\w+)\. Mr\. (\w+) (\w+)\. Mr\. (\w+)\.", got[3])
    assert three and three[1] == three[3] == three[5] and three[2] == three[4] and got[4].startswith(f"Mrs. {three[1]} ")
    assert re.search("(o|en|us)$", three[1])  # two of three titles are male
