"""PII surrogates: formats, coreference, distinctness and redraws."""

import re

from pyspark.sql import functions as F

from gravelbed.llm import surrogates


def replaced(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r["surrogate_text"], r["kinds"]) for r in surrogates.replaced(df).orderBy("doc_id").collect()]


def test_types_formats_and_coreference(spark):
    text = "Mail Joe.Doe7@Mail4.example.com or joe.doe7@mail4.example.com, call +1 (743) 555-3824, from 10.0.0.7 pay 4111111111111111 or 4111-1111-1111-1111."
    other = "x@mail4.example.com +1 743 555 3824 123-45-6789 " + "ab12" * 10
    (new, kinds), (new2, kinds2) = replaced(spark, text, other)
    assert kinds == ["email", "email", "phone", "ip", "card", "card"] and kinds2 == ["email", "phone", "ssn", "secret"]
    assert [len(x) for x in (new2,)] == [len(other)] and "743" not in new and "joe" not in new.lower() and "4111111" not in new
    a, b = re.findall(r"\S+@\S+\.com", new)
    assert a.lower() == b and a[0].isupper() and a.split("@")[1].lower() == new2.split()[0].split("@")[1]
    phone, phone2 = (re.search(r"\+1.*?\d{4}(?!\d)", x)[0] for x in (new, new2))
    assert re.sub(r"\D", "", phone) == re.sub(r"\D", "", phone2) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone)
    card = re.search(r"\d{16}", new)[0]
    assert "-".join(card[i : i + 4] for i in range(0, 16, 4)) in new and card[0] == "4"
    assert sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(card)) % 10 == 0


def test_names_keep_gender_and_script(spark):
    (a, ka), (b, kb), (c, kc) = replaced(spark, "Yes, Mr. Smith met Mary Smith.", "Госпожа Иванова ждёт", "The Smith is no name here, nor is John.")
    assert ka == ["name", "name"] and kb == ["name"] and kc == []
    first, given, second = re.fullmatch(r"Yes, Mr\. (\w+) met (\w+) (\w+)\.", a).groups()
    assert first == second != "Smith" and given in surrogates.GIVEN["female"] and given != "Mary"
    assert re.fullmatch(r"Госпожа [А-Я][а-я]{6} ждёт", b) and b != "Госпожа Иванова ждёт" and c == "The Smith is no name here, nor is John."


def test_collisions_are_redrawn(spark, monkeypatch):
    real, drawn = surrogates.surrogate, [f"{i}.1.1.{i}" for i in range(1, 40)]

    def poor(match, attempts):
        kind = surrogates.kind_of(match)
        attempt = F.coalesce(attempts[surrogates.entity(kind, surrogates.normal(kind, match))], F.lit(0))
        return F.concat(F.lit("9.9.9."), (F.crc32(F.concat(match, attempt.cast("string")).cast("binary")) % 100).cast("string"))

    monkeypatch.setattr(surrogates, "surrogate", poor)
    out = replaced(spark, " ".join(drawn), "9.9.9.5 " + drawn[0], *drawn[::-1])
    assert real is not poor
    whole = out[0][0].split()
    assert len(set(whole)) == len(drawn) and "9.9.9.5" not in whole and out[1][0].split()[1] == whole[0]
    assert [x for x, _ in out[2:]] == whole[::-1]


def test_nulls_empty_long_and_extra_columns(spark):
    rows = [(None, None, 1), (1, "", 2), (2, "a" * 200_000 + " 8.8.8.8", 3), (2, "no", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds int")
    got = {r["text"]: r for r in surrogates.replaced(df).collect()}
    assert got[None]["surrogate_text"] is None and got[None]["kinds"] == [] and got[""]["surrogate_text"] == "" and got["no"]["surrogate_text"] == "no"
    assert got["a" * 200_000 + " 8.8.8.8"]["kinds"] == ["ip"]
    assert surrogates.replaced(df.limit(0)).count() == 0


def test_whole_table_against_brute_force(spark, sf_dir):
    pattern = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\+\d \(\d{3}\) \d{3}-\d{4}|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])|(?<![\w-])\d{16}(?![\w-])|(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    pairs, real = {}, {m for t in texts.values() for m in pattern.findall(t)}
    for r in surrogates.op10_surrogates(spark, sf_dir).collect():
        old, new = pattern.findall(texts[r["doc_id"]]), pattern.findall(r["text"])
        assert len(old) == len(new) == r["n_entities"] and pattern.split(texts[r["doc_id"]]) == pattern.split(r["text"])
        for a, b in zip(old, new, strict=True):
            assert pairs.setdefault(a, b) == b and b not in real
    assert pairs and len(set(pairs.values())) == len(pairs)


def test_given_name_as_last_word_with_its_turn_taken(spark):
    def new(*names):
        docs = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "doc_id long, text string")
        return [r["surrogate_text"] for r in surrogates.replaced(docs).orderBy("doc_id").collect()]

    given = next(iter(surrogates.GIVEN.values()))[0]
    (turned,) = new(f"Mr {given}")
    got = new(f"Mr {given}", turned)
    assert got[0] not in (f"Mr {given}", turned) and len(set(got)) == 2 and all(x.startswith("Mr ") for x in got)
