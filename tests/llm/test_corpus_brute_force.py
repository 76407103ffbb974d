"""Operators that SQL cannot say, held against plain versions of what they compute."""

import collections
import itertools
import math
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from llm_texts import prose
from pyspark.sql import functions as F

from tabloom.llm import decontaminate, fingerprints, langid, minhash, mixing, passages, pitman_yor, url_rules, warc
from tabloom.llm.queries import QUERIES


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_language_of_held_out_documents(spark, sf_dir, documents):
    got = [r for r in QUERIES["op2_language_id"](spark, sf_dir).collect() if r.held_out]
    right = sum(documents[r.doc_id].lang == r.lang_pred for r in got)
    assert len(got) > 20 and right >= 0.97 * len(got)


def test_language_scores_are_those_of_naive_bayes(make_docs):
    docs = make_docs([(1, "Le chat, le chien", "fr"), (2, "the cat & the dog", "en"), (3, "der hund", "de"), (4, "les chats", "fr")])
    model = langid.fit(docs, F.lit(True))

    def grams(text):
        letters = re.sub(r"[^a-z]+", " ", " " + text.lower())
        return collections.Counter(letters[i : i + n] for n in (2, 3) for i in range(len(letters) - n + 1))

    counts = collections.defaultdict(collections.Counter)
    for text, lang in (("Le chat, le chien", "fr"), ("the cat & the dog", "en"), ("der hund", "de"), ("les chats", "fr")):
        counts[lang] += grams(text)
    prior = {"fr": 2, "en": 1, "de": 1}
    for text in ("le hund", "cats the", "x"):
        logs = {
            k: math.log(prior[k] / 4) + sum(n * math.log((c[g] + 0.1) / (c.total() + 0.1 * langid.BUCKETS)) for g, n in grams(text).items())
            for k, c in counts.items()
        }
        best = max(logs, key=logs.get)
        langs, share = model.score(pa.array([text]))
        assert langs == [best]
        assert share[0] == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), rel=1e-3)


def test_near_duplicates(spark, make_docs):
    rnd = random.Random(5)
    base = [prose(s, 120).split() for s in range(6)]
    rows, at = [], 0
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 8])):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(1000)}"
            rows.append((at := at + 1, " ".join(w)))
    rows += [(at + i, " ".join(base[0][:i])) for i in range(1, 12)]
    sets = {i: runs(t, 3) or {tuple(words_of(t))} for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(make_docs(rows)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_signatures_estimate_likeness():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    for size, share in ((8, 0.5), (60, 0.7), (1500, 0.85)):
        found = []
        for _ in range(12):
            a = rnd.sample(words, size)
            b = a[: int(size * share)] + rnd.sample(words, size - int(size * share))
            sets, bounds = minhash.shingle_sets(pa.array([" ".join(a), " ".join(b)]))
            one, two = minhash.signatures(sets, bounds)
            x, y = runs(" ".join(a), 3), runs(" ".join(b), 3)
            found.append((one == two).mean() - len(x & y) / len(x | y))
        assert abs(np.mean(found)) < 0.06


def test_water_filling(spark, make_docs):
    sizes = {"a": 400, "b": 30, "c": 900, "d": 20, None: 100}
    rows, at = [], 0
    for source, n in sizes.items():
        while n > 0:
            k = min(n, 3 + at % 7)
            rows.append((at := at + 1, " ".join(["w"] * k), "en", source))
            n -= k
    got = mixing.mix_sources(make_docs(rows)).collect()
    weights = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1]))
    target, held = {}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in held)
        level = rest / sum(w for s, w in weights.items() if s not in held)
        over = {s for s in sizes if s not in held and weights[s] * level > 2 * sizes[s]}
        if not over:
            break
        held |= over
    target = {s: 2.0 * sizes[s] if s in held else weights[s] * level for s in sizes}
    source_of = {r[0]: r[3] for r in rows}
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[source_of[r.doc_id]]) and r.source_size == sizes[source_of[r.doc_id]]
        taken[source_of[r.doc_id]] += r.taken
    assert len(got) == len(rows) and len(held) >= 2
    assert all(abs(taken[s] - target[s]) <= 10 for s in sizes)


def test_water_filling_that_cannot_be_met(make_docs):
    got = mixing.mix_sources(make_docs([(1, "a b", "en", "x"), (2, "c", "en", "y")]), share=9.0).collect()
    assert {(r.doc_id, r.target, r.copies) for r in got} == {(1, 4.0, 2), (2, 2.0, 2)}


def test_cuts_among_many_documents(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 5 + 1).cast("int")), " ").alias("text"), F.lit("s").alias("source")
    )
    got = mixing.mix_sources(docs, share=0.37).toPandas()
    assert abs(got["taken"].sum() - got["target"].iloc[0]) <= 3


def test_fingerprints_estimate_generalised_jaccard():
    rnd = random.Random(3)
    found = []
    for trial in range(25):
        vocabulary = [f"{trial}w{i}" for i in range(40)]
        a = [rnd.choice(vocabulary) for _ in range(120)]
        b = a[: rnd.randint(0, 120)]
        b += [rnd.choice(vocabulary) for _ in range(120 - len(b))]
        x, y = (fingerprints._fingerprints([" ".join(t).encode()], 512) for t in (a, b))
        one, two = collections.Counter(a), collections.Counter(b)
        found.append(fingerprints.likeness(x, y)[0] - (one & two).total() / (one | two).total())
    assert abs(np.mean(found)) < 0.012 and np.abs(found).max() < 0.09


def test_edited_texts(spark, sf_dir, documents):
    import hashlib

    got = {r.doc_id: r for r in QUERIES["op7_fingerprints"](spark, sf_dir).collect()}
    order = sorted(documents, reverse=True)
    for doc, after in zip(order, order[1:] + order[:1]):
        text, nxt = documents[doc].text or "", documents[after].text or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + nxt[:k]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, other, following = (fingerprints._fingerprints([t.encode()], fingerprints.SAMPLES) for t in (text, edited, nxt))
        assert (r.fingerprint, r.edited_fingerprint) == tuple(fingerprints._hex(x)[0] for x in (own, other))
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(own, other)[0], fingerprints.likeness(own, following)[0])


def test_url_rules_in_many_ranges(spark):
    rnd = random.Random(4)
    labels = ["a", "b", "ab", "org", "com"]
    hosts = [".".join(rnd.choices(labels, k=rnd.randint(1, 4))) for _ in range(60)]
    paths = ["/", "/x", "/x/", "/x/y", ""]
    rules = {(rnd.choice(hosts), rnd.choice(paths)): rnd.choice(["allow", "block"]) for _ in range(25)}
    urls = [(i, f"http://{rnd.choice(hosts)}{rnd.choice(['', '/', '/x', '/x/y/z', '/q'])}") for i in range(3000)]
    urls += [(5000 + i, "http://www.a.b.org/x/y") for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        table = spark.createDataFrame([(*k, v) for k, v in rules.items()], "host string, path string, verdict string")
        got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 6000
    for i, url in urls:
        host, _, path = url.removeprefix("http://").partition("/")
        path = "/" + path if "/" in url.removeprefix("http://") else ""
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (max(fits)[2:] if fits else (None, "allow")), url


def test_archives_hold_what_the_format_says(spark, tmp_path):
    path = str(tmp_path / "w")
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i % 50} " + prose(i % 50, 300)) for i in range(200)], "id long, url string, html string")
    warc.write_archives(pages.select("id", "url", F.col("html").cast("binary").alias("payload")), path)
    back = {r.id: r for r in warc.read_archives(spark, path).collect()}
    assert len(back) == 200 and all(back[i].record_type == ("response" if i < 50 else "revisit") for i in range(200))
    assert all(bytes(back[i].payload).decode() == f"<p>{i} " + prose(i, 300) for i in range(50))
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    data = files[0].read_bytes()
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D
    size = struct.unpack_from("<I", data, 4)[0]
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    text = plain.stream_reader(data, read_across_frames=True).read()
    assert text.count(b"WARC/1.1\r\n") == len(list(warc.records_in(data)))


def test_broken_archives_are_refused():
    good = warc.archive_bytes([warc.record_bytes(i, "u", prose(i, 50).encode(), None) for i in range(20)])
    assert [r["id"] for r in warc.records_in(good)] == list(range(20))
    for bad in (good[:-3], good[:5], good + b"junkjunk", good[:-20] + bytes(20), good + struct.pack("<II", 0x184D2A5D, 0)):
        with pytest.raises(ValueError):
            list(warc.records_in(bad))
    record = warc.record_bytes(1, "u", b"payload", None)
    for old, new in ((b"WARC/1.1", b"HTTP/1.1"), (b"WARC-Date", b"X-Date"), (b"Length: 7", b"Length: 8"), (b"payload\r", b"paylaod\r")):
        with pytest.raises(ValueError):
            warc.parse_record(record.replace(old, new))


def test_a_compressed_dictionary_is_read():
    records = [warc.record_bytes(i, "u", prose(i, 200).encode(), None) for i in range(30)]
    good = warc.archive_bytes(records)
    size = struct.unpack_from("<I", good, 4)[0]
    small = zstandard.ZstdCompressor().compress(good[8 : 8 + size])
    assert [r["id"] for r in warc.records_in(struct.pack("<II", 0x184D2A5D, len(small)) + small + good[8 + size :])] == list(range(30))


def test_leaks(spark, sf_dir, documents):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}

    def plain(text):
        return words_of(re.sub(r"[\x00-\x7F]", lambda m: m[0] if m[0].isalnum() else " ", text or ""))

    want = set()
    for i, text in items.items():
        w = text.split()
        k = max(len(w) // 3, 1)
        asked, told = plain(" ".join(w[:-k])), set(plain(" ".join(w[-k:])))
        question = {tuple(asked[j : j + 5]) for j in range(len(asked) - 4)}
        for doc, r in documents.items():
            d = plain(r.text)
            if len(question & {tuple(d[j : j + 5]) for j in range(len(d) - 4)}) >= 0.8 * len(question) and len(told & set(d)) >= 0.8 * len(told):
                want.add((doc, i))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontaminate"](spark, sf_dir).collect()}
    assert got == want and len(want) > 2


def test_block_maxima_lose_no_item():
    """Blocks that stay closed hold no item at or above the threshold, and scores in open ones are complete."""
    rnd = np.random.default_rng(6)
    items = []
    for key in range(60):
        w = np.sort(rnd.choice(200, rnd.integers(6, 25))).astype(np.uint64) + np.uint64(1)
        items.append(decontaminate._item(key, w[:-2], w[-2:]))
    index = decontaminate.BlockMaxIndex(items)
    for _ in range(300):
        words = np.unique(rnd.choice(200, rnd.integers(5, 120)).astype(np.uint64) + np.uint64(1))
        _, term = index.lookup(words)
        term = np.unique(term)
        query, block = index.open_blocks(np.zeros(len(term), int), term, 1)
        got = set(index.search(term.tolist(), block.tolist()))
        here = set(term.tolist())
        want = {i for i, (w, bound) in enumerate(index.weights) if sum(x for t, x in w.items() if t in here) / max(bound, 1e-6) >= 1 - 1e-6}
        assert got == want


def test_passages(spark, sf_dir, documents):
    """Every word of a stretch of 50 or more that an earlier document has is found."""
    found = collections.defaultdict(set)
    for r in QUERIES["op10_repeated_passages"](spark, sf_dir).collect():
        assert r.source_id < r.doc_id and r.n_words >= 50 and r.overlap >= 0.8
        found[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
        mine = words_of(documents[r.doc_id].text)[r.first_word : r.first_word + r.n_words]
        own = [tuple(mine[i : i + 5]) for i in range(len(mine) - 4)]
        other = runs(documents[r.source_id].text, 5)
        assert sum(s in other for s in own) >= 0.8 * len(own)
    seen, total = collections.defaultdict(list), 0
    for doc in sorted(documents):
        w, active, need = words_of(documents[doc].text), {}, set()
        shingles = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for i, s in enumerate(shingles):
            active = {at: active.get((at[0], at[1] - 1), 0) + 1 for at in seen.get(s, ())}
            if (n := max(active.values(), default=0)) >= 46:
                need |= set(range(i - n + 1, i + 5))
        for i, s in enumerate(shingles):
            seen[s].append((doc, i))
        total += len(need)
        assert need <= found[doc], doc
    assert total > 500


def test_seating_follows_the_restaurant():
    """Tables of a cell have the conditional distribution that enumeration of all seatings gives."""
    theta, d, p, counts = 0.7, 0.4, 0.3, 4

    def weight(sizes):
        w = 1.0
        for k, n in enumerate(sizes):
            w *= (theta + d * k) * p
            for m in range(1, n):
                w *= m - d
        return w

    def seatings(n):
        if n == 0:
            yield []
            return
        for s in seatings(n - 1):
            for k in range(len(s)):
                yield [*s[:k], s[k] + 1, *s[k + 1 :]]
            yield [*s, 1]

    want = collections.Counter()
    for s in seatings(counts):
        want[len(s)] += weight(s)
    rng = np.random.default_rng(0)
    n = 4000
    many = pitman_yor.Seating(np.full(n, counts), np.arange(n), np.full(n, p), theta, d)
    for _ in range(12):
        many.sweep(rng)
    assert many.sizes.sum() == n * counts and len(many.sizes) == many.tables.sum()
    got = collections.Counter(many.tables.tolist())
    for t, w in want.items():
        assert got[t] / n == pytest.approx(w / want.total(), abs=0.03)


def test_probabilities_sum_to_one_and_beat_the_base(spark, sf_dir, documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = {r.doc_id: r for r in pitman_yor.score_texts(docs, ~held).collect()}
    asked = {r.doc_id for r in docs.filter(held).collect()}
    counts = collections.Counter()
    for i, r in documents.items():
        if i not in asked:
            counts.update([*words_of(r.text), None])
    for i, r in documents.items():
        tokens = [*words_of(r.text), None]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(t in counts for t in tokens), counts.total())
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (counts.total() + len(counts) + 1)) for t in tokens), abs=1e-6)
    assert sum(got[i].score for i in asked) > sum(got[i].base_score for i in asked)


def test_next_token_probabilities_sum_to_one(make_docs, monkeypatch):
    """After any context, over the known tokens and the unseen one."""
    docs = make_docs([(i, x) for i, x in enumerate(["a b a b c", "b a d", "a a a e f", "g h a b", "i i i j k k"])])
    models, fit = [], pitman_yor._fit
    monkeypatch.setattr(pitman_yor, "_fit", lambda *x: models.append(fit(*x)) or models[-1])
    for head in (3, 100):
        pitman_yor.score_texts(docs, F.lit(True), head=head)
        model = models[-1]
        n = len(model.head)
        assert n == min(head, 12) and model.types == 12 and model.tokens == 28
        for context in range(n + 2):
            p = model.backoff[context] * model.parent
            mine = model.cells // (n + 2) == context
            p[model.cells[mine] % (n + 2)] += model.seats[mine]
            assert p.sum() == pytest.approx(1)
        inner = collections.Counter("a b a b c b a d a a a e f g h a b i i i j k k".split() + ["end"] * 5)
        rest = sorted(inner.values())[: 12 - n]
        of = dict(zip(model.rest_counts.tolist(), model.rest))
        assert sum(of[c] for c in rest) + model.unseen == pytest.approx(1)


def test_every_word_is_a_context(make_docs):
    """A pair that training has seen is likelier than one it has not, also where words are many and rare."""
    n = 1500
    rows = [(i, f"x{i % n} y{i % n}") for i in range(3 * n)]
    rows += [(10_000 + i, f"x{i} y{i}") for i in range(n)] + [(20_000 + i, f"x{i} y{(i + 1) % n}") for i in range(n)]
    got = {r.doc_id: r.score for r in pitman_yor.score_texts(make_docs(rows), F.col("doc_id") < 10_000).collect()}
    assert all(got[10_000 + i] > got[20_000 + i] + 1 for i in range(n))


def test_word_contexts_sum_to_one(make_docs, monkeypatch):
    """After any context, over all known tokens and the unseen one; and the scores are those of the cells."""
    texts = ["a b a b c", "b a d", "a a a e f", "g h a b", "i i i j k k"]
    models, fit = [], pitman_yor._fit_words
    monkeypatch.setattr(pitman_yor, "_fit_words", lambda *x: models.append(fit(*x)) or models[-1])
    held = "a b k zz"
    got = {r.doc_id: r for r in pitman_yor.score_texts(make_docs([*enumerate(texts), (9, held)]), F.col("doc_id") != 9).collect()}
    model = models[-1]
    assert model.types == 12 and model.tokens == 28 and model.start_customers == 5
    share = dict(zip(model.told.tolist(), model.shares))
    asked = {r.word: share[r.asked] for r in model.symbols.collect()}
    assert len(asked) == 12 and sum(asked.values()) + model.unseen == pytest.approx(1)
    cells = {(r.context, r.symbol): r.seated for r in model.cells.collect()}
    tokens = [[*t.split(), None] for t in texts]
    assert len(cells) == len({p for t in tokens for p in zip(["start", *t], t)})
    tables = {r.word: r.tables for r in model.contexts.collect()}
    hashes = {w: int(pitman_yor.word_hashes(*pitman_yor.buffers(pa.array([w])))[0].astype(np.int64)[0]) for w in [*"abcdefghijk", "zz"]}
    hashes |= {None: 1, "start": 2}
    customers = collections.Counter(w for t in tokens for w in ["start", *t])
    for w in [*"abcdefghijk", "start"]:
        seated = sum(s for (u, _), s in cells.items() if u == hashes[w])
        assert seated + model.discount * tables[hashes[w]] == pytest.approx(customers[w])
    want = 0.0
    for u, w in zip(["start", *held.split()], [*held.split(), None]):
        floor = (1 + model.discount * tables.get(hashes[u], 0)) * asked.get(hashes[w], model.unseen)
        want += math.log10((cells.get((hashes[u], hashes[w]), 0) + floor) / (1 + customers[u]))
    assert got[9].score == pytest.approx(want, abs=1e-6)


def test_runs_of_near_copies():
    """The longest run with the share, whatever gaps it has: against all pairs of ends."""

    def longest(own, other):
        hits = [i for i, s in enumerate(own) if s in other]
        fits = [(j - i + 1, -i, j) for i in hits for j in hits if j - i >= 45 and 10 * sum(i <= h <= j for h in hits) >= 8 * (j - i + 1)]
        if not fits:
            return []
        n, i, j = max(fits)
        left, right = longest(own[:-i], other), longest(own[j + 1 :], other)
        return left + [(-i, j)] + [(a + j + 1, b + j + 1) for a, b in right]

    draw = random.Random(5)
    for _ in range(150):
        own = list(range(draw.randrange(40, 220)))
        other = set(own)
        for _ in range(draw.randrange(7)):
            at = draw.randrange(len(own))
            other -= set(range(at, at + draw.randrange(1, 25)))
        got = passages.alike_runs(np.array(own), np.array(sorted(other)))
        assert [(a, b) for a, b, _ in got] == longest(own, other)
        assert all(s == pytest.approx(sum(a <= h <= b for h in other) / (b - a + 1)) for a, b, s in got)


def test_passage_with_six_words_changed_in_the_middle(make_docs):
    shared = prose(500, 100).split()
    edited = shared[:46] + prose(501, 6).split() + shared[52:]
    docs = make_docs([(1, prose(502, 70) + " " + " ".join(shared)), (2, " ".join(edited) + " " + prose(503, 70))])
    got = [(r.doc_id, r.source_id, r.first_word, r.n_words, round(r.overlap, 3)) for r in passages.repeated_passages(docs).collect()]
    assert got == [(2, 1, 0, 100, 0.896)]


def test_parts_in_earlier_documents_hide_no_passage(make_docs):
    """Two documents share 60 words; two earlier ones have 45 of them each, too few for a passage of their own."""
    rows = []
    for k in range(40):
        at, shared = 10 * k, prose(600 + k, 60).split()
        rows += [(at, prose(1000 + at, 60) + " " + " ".join(shared[:45])), (at + 1, " ".join(shared[15:]) + " " + prose(1001 + at, 60))]
        rows += [(at + i, prose(1000 + at + i, 60) + " " + " ".join(shared) + " " + prose(1004 + at + i, 60)) for i in (2, 3)]
    found = collections.defaultdict(set)
    for r in passages.repeated_passages(make_docs(rows)).collect():
        assert (r.doc_id % 10, r.source_id) == (3, r.doc_id - 1)
        found[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    assert found == {10 * k + 3: set(range(60, 120)) for k in range(40)}


def test_longer_passage_around_a_known_one(make_docs):
    """The first document has the middle of what the others share."""
    shared = prose(700, 120)
    middle = " ".join(shared.split()[35:90])
    docs = make_docs([(1, middle + " " + prose(701, 60)), (2, prose(702, 60) + " " + shared), (3, shared + " " + prose(703, 60))])
    found = collections.defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        found[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    assert found == {2: set(range(95, 150)), 3: set(range(120))}


def test_passages_of_rows_with_one_id(make_docs):
    """Each row is judged by its own text and loses its own passage."""
    shared = prose(800, 80)
    rows = [(1, prose(801, 40) + " " + shared), (2, prose(802, 25) + " " + shared), (2, prose(803, 10)), (2, prose(804, 300)), (3, shared + " x")]
    docs = make_docs(rows)
    found = passages.repeated_passages(docs)
    assert {(r.doc_id, r.source_id, r.n_words) for r in found.collect()} >= {(2, 1, 80)}
    left = sorted((r.doc_id, r.text.strip()) for r in passages.without_passages(docs, found).collect())
    assert left == sorted([(1, rows[0][1]), (2, prose(802, 25)), (2, rows[2][1]), (2, rows[3][1]), (3, "x")])


def test_near_copies_of_passages(make_docs):
    """Passages with words replaced, inserted and deleted, a share of 0.8 and more, are found in 99 of 100 cases."""
    draw, rows, want = random.Random(5), [], {}
    for k in range(150):
        n = draw.randrange(60, 160)
        own, other = prose(2000 + k, n).split(), prose(2000 + k, n).split()
        for _ in range(draw.randrange(0, 3)):
            at = draw.randrange(8, len(other) - 8)
            change = draw.choice(["replace", "insert", "delete"])
            other[at : at + (change != "insert")] = [] if change == "delete" else [f"new{k}"]
        rows += [(10 * k, " ".join(prose(4000 + k, 70).split() + own)), (10 * k + 1, " ".join(other + prose(6000 + k, 70).split()))]
        theirs = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        runs_of = passages.alike_runs(np.array([tuple(other[i : i + 5]) in theirs for i in range(len(other) - 4)]), np.array([True]))
        want[10 * k + 1] = {w for f, l, _ in runs_of for w in range(f, l + 5)}
    found = collections.defaultdict(set)
    for r in passages.repeated_passages(make_docs(rows)).collect():
        assert r.source_id == r.doc_id - 1
        found[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    held = sum(len(w & found[i]) for i, w in want.items())
    assert held >= 0.99 * sum(map(len, want.values())) and sum(map(bool, want.values())) > 140
