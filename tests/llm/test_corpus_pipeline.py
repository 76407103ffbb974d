"""The pipeline's rows against a plain version on documents with planted cases."""

import collections
import math
import re

import corpus_pipeline
import pytest
from llm_texts import prose

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def runs(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    passage, item = prose(901, 70), prose(902, 30)
    rows = [(i, prose(i, 90 + i % 40), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(40)]
    rows += [(100, prose(5, 95), "en", "s0"), (101, prose(5, 95) + " more", "en", "s1"), (102, prose(6, 96).upper(), "fr", None)]
    rows += [(103, prose(300, 80) + " " + passage, "en", "s1"), (104, passage + " " + prose(301, 80), "en", "s2"), (105, "  " + passage, "fr", "s2")]
    rows += [(106, prose(302, 60) + " " + item + ". " + prose(303, 60), "en", "s0"), (107, "1234 5678", "en", "s0"), (108, None, None, "s0"), (109, "", "fr", "s1")]
    rows += [(110, prose(304, 20), "en", "s1"), (110, prose(304, 20), "en", "s1")]
    frame = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, prose(903, 30))], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return rows, passage, str(folder)


def test_rows(spark, planted):
    rows, passage, folder = planted
    kept = {r[0]: r for r in rows if re.search(r"[^\W\d_]", r[1] or "")}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and a in kept:
                x, y = (runs(re.sub("[A-Z]", lambda m: m[0].lower(), kept[i][1]), 3) for i in (a, b))
                if 100 * len(x & y) >= 85 * len(x | y):
                    del kept[b]
    assert 100 not in kept and 101 not in kept and 102 not in kept
    texts = {i: r[1] for i, r in kept.items()}
    texts[104] = texts[104].replace(passage, "")
    del texts[105], texts[106]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) <= set(texts) and all(got[i].text == texts[i] and got[i].n_chars == len(texts[i]) for i in got)
    # The mix, from the plain texts.
    sizes = {i: len(texts[i].split()) for i in texts}
    source = {i: kept[i][3] for i in texts}
    total = collections.Counter()
    for i, s in source.items():
        total[s] += sizes[i]
    weights = dict(zip(sorted(total, key=lambda s: (s is None, s)), [3, 1, 2, 3]))
    held = set()
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in held)) / sum(weights[s] for s in weights if s not in held)
        over = {s for s in total if s not in held and weights[s] * level > 2 * total[s]}
        if not over:
            break
        held |= over
    for s in total:
        target = 2 * total[s] if s in held else weights[s] * level
        taken = sum(got[i].copies * sizes[i] for i in got if source[i] == s)
        assert abs(taken - target) <= max(sizes[i] for i in sizes if source[i] == s) / 2
        assert all(got[i].copies in (math.floor(target / total[s]), math.floor(target / total[s]) + 1) for i in got if source[i] == s)


def test_stages_hand_on_documents(spark, planted):
    docs = spark.read.parquet(f"{planted[2]}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "substring_dedup", "decontaminate", "mix"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, planted[2])
        assert out.columns == NAMES and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.limit(0), planted[2]).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), planted[2]).count() == 0


def test_near_dedup_takes_five_words_and_80_percent(spark, make_docs):
    base = prose(400, 200).split()
    longer = base + prose(401, 40).split()
    rows = [(1, " ".join(base)), (2, " ".join(longer)), (3, prose(403, 200)), (4, prose(403, 200) + " " + prose(404, 60))]
    rows += [(5, " ".join(prose(405, 200).split())), (6, " ".join(prose(405, 200).split()[:91] + prose(406, 18).split() + prose(405, 200).split()[109:]))]
    share = lambda a, b: len(runs(a, 5) & runs(b, 5)) / len(runs(a, 5) | runs(b, 5))
    assert share(rows[0][1], rows[1][1]) >= 0.8 > share(rows[2][1], rows[3][1]) and share(rows[4][1], rows[5][1]) < 0.85
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, make_docs(rows, False), None).collect()}
    assert kept == {a for a, t in rows if not any(b < a and share(t, u) >= 0.8 for b, u in rows)} and 2 not in kept
