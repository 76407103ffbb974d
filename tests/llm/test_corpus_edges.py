"""Nulls, empty texts and tables, long texts, ties, repeated rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

from llm_texts import prose
from tabloom.llm import chat, decontaminate, fingerprints, langid, minhash, mixing, passages, pitman_yor, url_rules, warc

LONG = prose(3, 30_000)


@pytest.fixture(scope="module")
def odd(make_docs):
    return make_docs(
        [
            (1, "the cat sat on the mat", "en", "a"), (2, None, None, None), (3, "", "en", None), (4, " \t\n", "fr", "b"),
            (5, LONG, "en", "a"), (None, "the cat sat on the mat", "en", "a"), (6, "THE CAT sat on  the mat", "fr", "c"),
            (7, "12 34 !!", None, "c"), (8, "ein hund", "de", "b"), (8, "ein hund", "de", "b"), (9, "é", "fr", None),
        ]
    )


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_language(odd, empty):
    model = langid.fit(odd, F.lit(True))
    got = langid.identify(odd, model).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4, 7))
    assert by[8].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)
    none = langid.fit(empty, F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0
    assert langid.with_language(odd, model).columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"]


def test_near_duplicates(odd, empty):
    got = sorted(map(tuple, minhash.near_duplicates(odd).collect()), key=str)
    by = {r[0]: r[1:] for r in got}
    assert len(got) == 11 and got.count((8, 1, 8, True)) == 2
    assert by[1] == (4, 1, True) and by[6] == (4, 1, False) and by[None] == (4, None, True)
    assert all(by[i] == (0, i, True) for i in (2, 3, 4)) and by[9] == (1, 9, True)
    assert minhash.near_duplicates(empty).count() == 0


def test_mixing(odd, empty):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == 11 and {r.size for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert all(r.copies <= 2 and r.taken == r.copies * r.size for r in got)
    assert mixing.mix_sources(empty).count() == 0
    mixed = mixing.with_copies(odd)
    assert mixed.columns == [c for c in odd.columns if c != "copies"] + ["copies"] or set(mixed.columns) == set(odd.columns)
    again = {(r.doc_id, r.copies) for r in mixed.collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_fingerprints(odd, empty):
    got = fingerprints.fingerprint_edits(odd).collect()
    assert len(got) == 11 and got[0].doc_id == 9 and got[-1].doc_id is None
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[None].fingerprint and by[2].fingerprint == by[3].fingerprint == "0" * 512
    assert by[2].near_next == 0 and by[3].near_next == 1.0
    assert fingerprints.fingerprint_edits(empty).count() == 0
    one = fingerprints.fingerprint_edits(odd.filter("doc_id = 1")).first()
    assert one.near_next == 1.0 and one.n_chars == 22
    texts = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_texts(odd).collect()}
    assert texts[5] == by[5].fingerprint


def test_pitman_yor(odd, empty):
    got = pitman_yor.score_texts(odd, F.col("doc_id") != 5).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 11 and by[2].n_tokens == by[4].n_tokens == 1 and by[5].n_tokens == 30_001
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert pitman_yor.score_texts(empty, F.lit(True)).count() == 0
    unlearned = pitman_yor.score_texts(odd, F.lit(False)).collect()
    assert {(r.score, r.base_score, r.n_known, r.train_tokens) for r in unlearned} == {(0.0, 0.0, 0, 0)}


def test_passages(odd, empty, make_docs):
    assert passages.repeated_passages(odd).count() == 0
    assert passages.repeated_passages(empty).count() == 0
    shared = prose(11, 60)
    docs = make_docs([(1, prose(1, 80) + " " + shared), (2, shared + " " + prose(2, 500)), (None, shared), (3, LONG + " " + shared), (4, LONG), (4, LONG)])
    found = passages.repeated_passages(docs)
    got = {(r.doc_id, r.source_id) for r in found.collect()}
    assert got == {(2, 1), (3, 1), (4, 3)}
    left = {r.doc_id: r.text for r in passages.without_passages(docs, found).collect()}
    assert left[1] == prose(1, 80) + " " + shared and left[None] == shared
    assert left[2].strip() == prose(2, 500) and left[3].strip() == LONG and left[4].strip() == ""


def test_decontaminate(odd, empty, spark):
    items = spark.createDataFrame(
        [(1, "the cat sat on the", "mat"), (1, "the cat sat on the", "mat"), (2, None, None), (3, "", "  "), (4, LONG, "end")],
        "id long, question string, answer string",
    )
    got = [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd, items).collect()]
    assert sorted(got, key=str) == [(1, 1), (6, 1), (None, 1)]
    assert decontaminate.find_leaks(odd, items.limit(0)).count() == 0
    assert decontaminate.find_leaks(empty, items).count() == 0
    marked = decontaminate.with_leaks(odd, items)
    assert marked.count() == 11 and marked.filter("n_leaks = 1").count() == 3


def test_urls(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.b.Example.ORG/es/1?x"), (2, None), (3, "example.org/es/"), (None, "https://org/"), (5, "http://org"),
            (6, "http://notexample.org/es/"), (7, "http://x.com/de/a"), (7, "http://x.com/de/a"), (8, "ftp://y.com#/fr/"), (9, ""),
            (10, "http://x.com/\n/fr/" + "y" * 50_000),
        ],
        "page_id long, url string",
    ).withColumn("key", F.lit("clash"))
    rules = spark.createDataFrame(
        [("org", "/", "allow"), ("example.org", "/es/", "allow"), ("EXAMPLE.org", "/es/", "block"), ("com", "/de/", "block"), (None, "/", "block")],
        "host string, path string, verdict string",
    )
    got = sorted(((r.page_id, r.host, r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules).collect()), key=str)
    assert got == sorted(
        [
            (1, "a.b.example.org", "example.org/es/", "block"), (2, "", None, "allow"), (3, "", None, "allow"), (None, "org", "org/", "allow"),
            (5, "org", None, "allow"), (6, "notexample.org", "org/", "allow"), (7, "x.com", "com/de/", "block"), (7, "x.com", "com/de/", "block"),
            (8, "y.com", None, "allow"), (9, "", None, "allow"), (10, "x.com", None, "allow"),
        ], key=str,
    )
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.rule for r in url_rules.judge_urls(pages, rules.limit(0)).collect()} == {None}


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame(
        [(3, "http://a/ä", "x"), (1, None, "x"), (2, "u", None), (4, "u", ""), (None, "u", "x"), (5, "u\nv", "é" * 200_000), (1, None, "x")],
        "page_id long, url string, html string",
    ).withColumn("id", F.lit("clash"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages, str(tmp_path / "a")).collect()), key=str)
    assert got == sorted(
        [(1, 1, "response", None)] * 2
        + [(3, 1, "revisit", 1), (2, 0, "response", None), (4, 0, "revisit", 2), (None, 1, "response", None), (5, 400_000, "response", None)], key=str,
    )
    assert warc.round_trip(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_chat(spark):
    turns = spark.createDataFrame(
        [(1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", None), (1, 4, "assistant", "b"), (2, 1, None, "alone"), (None, 1, "user", "x"),
         (3, None, "assistant", "ä"), (4, 1, "assistant", "same"), (4, 2, "assistant", "same")],
        "conv_id long, turn long, role string, text string",
    ).withColumn("prompt", F.lit("clash"))
    told = chat.conversations(turns)
    pairs = told.select("id", F.col("turns").alias("chosen"), chat.last_answer_swapped(F.col("turns")).alias("rejected"))
    by = {r.id: r for r in chat.format_preferences(pairs).collect()}
    assert sorted(by) == [1, 2, 3, 4]
    assert by[1].n_prompt_turns == 3 and by[1].prompt.endswith("<|im_start|>user\n<|im_end|>\n")
    for r in by.values():
        for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            for span in filter(None, spans.split(",")):
                a, b = map(int, span.split("-"))
                assert text[:a].endswith("<|im_start|>assistant\n") and text[a:b].endswith("<|im_end|>")
    assert (by[1].chosen_spans, by[1].rejected_spans) == ("22-33", "22-33") and "a<|im_end|>" in by[1].rejected
    assert by[2].n_prompt_turns == 0 and by[2].rejected == "" and by[2].chosen_spans == ""
    assert by[3].rejected_spans == "22-32" and by[4].n_prompt_turns == 2 and by[4].chosen == by[4].rejected == ""
    turn = "array<struct<role:string,text:string>>"
    nothing = spark.createDataFrame([(1, None, None)], f"id long, chosen {turn}, rejected {turn}")
    assert chat.format_preferences(nothing).first().prompt == ""
    assert chat.format_preferences(pairs.limit(0)).count() == 0
