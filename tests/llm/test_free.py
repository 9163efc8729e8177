"""Archives, classifier, near-duplicates and personal data against brute force, and on awkward rows."""

import hashlib
import io
import itertools
import random
import re
import time
import zipfile

import numpy as np
import pytest
import xxhash
from palisade.llm import archives, cotraining, pii, simhash
from pyspark.sql import functions as F

from tests.llm.conftest import LONG, PROSE, texts

DATA = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


# --- Archives. ---

PAGES = [
    (3, "http://a/1", "x" * 200), (1, "http://a/2\r\nX: y", "x" * 200), (2, None, "x" * 200), (None, "u", "x" * 200), (4, "u", "short"), (5, "u", "short"), (6, "u", None),
    (7, "u", ""), (8, "é", "é😀" * 40), (9, "é", "é😀" * 40), (1, "again", "x" * 200), (None, "u", "y" * 150), (None, "u", "y" * 150), (10, "u", "long " * 200_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "extra", b"x") for p in PAGES], "page_id long, url string, html string, digest string, payload binary")


def test_round_trip(pages):
    found = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archives.round_trip(pages).collect()), key=str)
    expected = []
    for page, _, html in PAGES:
        body = (html or "").encode()
        equal = [p for p, _, h in PAGES if (h or "").encode() == body and p is not None]
        first = min(equal) if equal and len(body) >= 100 else None
        revisit = first is not None and page != first
        expected.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert found == sorted(expected, key=str)
    assert archives.round_trip(pages.limit(0)).isEmpty()


def test_payloads_come_back_whole(spark, pages, tmp_path):
    packages = archives.write_packages(archives.planned(pages), str(tmp_path), most=1000).cache()
    assert packages.count() > 1
    back = archives.read_packages(packages, str(tmp_path), payload=True).filter("record_type = 'response'")
    bodies = {(h or "").encode() for _, _, h in PAGES}
    assert {bytes(r.payload) for r in back.collect()} == bodies


def test_other_readers_and_both_directory_forms(pages, tmp_path):
    (package,) = archives.write_packages(archives.planned(pages).coalesce(1), str(tmp_path)).collect()
    with zipfile.ZipFile(package.path) as z:
        assert z.testzip() is None and z.namelist() == [archives.DATA, archives.INDEX] and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        parts = {n: z.read(n) for n in z.namelist()}
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
        z.comment = b"a comment after the end record"
    with open(package.path, "rb") as wide:
        assert list(archives.records(wide, package.size)) == list(archives.records(plain, len(plain.getvalue())))
    with pytest.raises(ValueError):
        archives.members(io.BytesIO(b"no archive" * 9), 90)


# --- Classifier. ---


def test_held_out_accuracy(spark):
    labels = table(spark, "labels")
    train, held = (labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0 if hold else F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) != 0) for hold in (False, True))
    scores = cotraining.scored(table(spark, "documents"), train).select("row.doc_id", "scores.score").join(held, "doc_id")
    right = scores.filter((F.col("score") >= 0.5) == ((F.col("quality") == 1) & (F.col("toxic") == 0)))
    clean = scores.filter("quality = 1 and toxic = 0")
    assert right.count() >= 0.85 * scores.count()
    assert clean.filter("score >= 0.5").count() >= 0.93 * clean.count()


def test_views_teach_each_other():
    """Words tell half of the documents apart, metadata the others; pseudo-labels carry what one view knows to the other."""
    rng = random.Random(3)

    def row(i):
        good = i % 4 < 2
        # Word 3 marks good documents of the half whose words say nothing else, and only documents without a label have it.
        words = [rng.randrange(1000, 4000) for _ in range(30)] + ([1 if good else 2] if i % 2 else [3] * good * (i >= 400))
        shape = [float(good if i % 2 == 0 else 0.5), 0.0] + [rng.random() for _ in range(7)]
        return {"good": int(good), "body": i, "words": np.unique(np.array(words, np.int32)), "names": ["x"], "layout": shape}

    rows = [row(i) for i in range(4000)]

    def teach(model, held):
        found = cotraining.Exchange(cotraining.META_SLOTS + cotraining.BINS * len(model.edges))
        free = [r for r in rows if r["body"] not in set(held.tolist())]
        found.add(model, [r["words"] for r in free], [cotraining.meta_slots(r["names"], r["layout"], model.edges) for r in free])
        return found

    model = cotraining.fit(rows[:400], teach)
    assert all(min(round_) > 500 for round_ in model.taught)
    assert model.text.weights[3] == 0 and model.text.lean[3] > 2 and model.text.lean[1] == 0 and model.meta.lean.any()
    unseen = [r for r in rows[400:] if 3 in r["words"]]
    assert (model.text.columns([r["words"] for r in unseen])[:, 1] > 0).all()
    assert not cotraining.fit(rows[:400], teach, rounds=0).text.lean.any()


def test_a_round_equals_brute_force_and_labelled_documents_take_part(spark):
    """Counts of one round over all documents, each of which has a label; one slot after the other, one document after the other."""
    documents = table(spark, "documents").repartition(5)
    labels = documents.select("doc_id", F.when(F.length("text") % 3 > 0, 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic"))
    marked = labels.filter("quality = 0").select("doc_id", F.lit(" zzbad zzworse zzworst").alias("mark"))
    documents = documents.join(marked, "doc_id", "left").withColumn("text", F.concat("text", F.coalesce("mark", F.lit("")))).drop("mark")
    model = cotraining.trained(documents, labels)
    assert len(model.taught) == cotraining.ROUNDS and all(by_words > 100 for by_words, _ in model.taught)
    rows = documents.select("text", "lang", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("body")).collect()
    held = np.array([r.body for r in rows[::7]], np.int64)
    counts = cotraining.exchange_over(documents, ["lang", "source"])(model, held).counts
    expected = [{}, {}]
    for r in rows:
        if r.body in set(held.tolist()):
            continue
        text = (r.text or "").encode()
        slots = [cotraining.word_slots(text), cotraining.meta_slots([r.lang, r.source], cotraining.layout(text), model.edges)]
        for pupil, teacher in ((0, model.meta), (1, model.text)):
            z = teacher.columns([slots[1 - pupil]])[0] @ teacher.scale[:2] + teacher.scale[2]
            p = 1 / (1 + np.exp(-z))
            if p >= cotraining.SURE or p <= 1 - cotraining.SURE:
                for slot in [*slots[pupil].tolist(), len(counts[pupil][0]) - 1]:
                    pair = expected[pupil].setdefault(slot, [0, 0])
                    pair[int(p >= 0.5)] += 1
    for count, pairs in zip(counts, expected):
        assert {int(s): count[:, s].tolist() for s in np.flatnonzero(count.sum(axis=0))} == pairs


def test_classifier_on_awkward_rows(awkward, labels, no_documents):
    scored = cotraining.scored(awkward, labels)
    rows = scored.collect()
    assert len(rows) == len(texts()) and all(0 <= r.scores.score <= 1 for r in rows) and scored.select("row.*").columns == awkward.columns
    same = [r.scores.score for r in rows if r.row.doc_id == 5]
    assert same[0] == same[1]
    assert cotraining.kept(awkward, labels.limit(0)).count() == len(texts()) and cotraining.scored(no_documents, labels).isEmpty()
    assert cotraining.scored(awkward.select("doc_id", "text"), labels).count() == len(texts())
    assert cotraining.trained(awkward, labels) is not None and cotraining.trained(no_documents, labels) is None


# --- Near-duplicates. ---


def fingerprint(text, width=4):
    found = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + width]), 42) for i in range(max(1, len(found) - width + 1))] if found else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if near(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_clusters_equal_brute_force(spark, awkward, no_documents):
    some = [(r[0], r[1]) for r in texts()] + [(100 + i, r.text) for i, r in enumerate(table(spark, "documents").limit(150).collect())]
    found = simhash.clusters(spark.createDataFrame(some, "doc_id long, text string")).collect()
    prints = {t: fingerprint(t) for _, t in some}
    roots = components(sorted(set(prints.values())), lambda a, b: bin(a ^ b).count("1") <= 4)
    smallest = {}
    for doc, text in some:
        if doc is not None:
            smallest[roots[prints[text]]] = min(doc, smallest.get(roots[prints[text]], doc))
    expected = sorted(((doc, prints[t], smallest.get(roots[prints[t]])) for doc, t in some), key=str)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in found), key=str) == expected
    assert simhash.clusters(awkward).count() == len(texts()) and simhash.clusters(no_documents).isEmpty()


def test_a_bucket_gives_links_that_span_and_no_more():
    rng = np.random.default_rng(8)
    for _ in range(20):
        fps = np.unique(np.concatenate([int(c) ^ (np.int64(1) << rng.integers(0, 64, 30)) for c in rng.integers(-(2**63), 2**63, 4)] + [np.array([-(2**63), 1, -1, 0])]))
        found = [(int(x), int(y)) for a, b in simhash.within(4)(fps) for x, y in zip(a, b)]
        expected = components(fps.tolist(), lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4)
        assert sorted((r, n) for n, r in expected.items() if r != n) == sorted(found)


def test_prefix_rounds_leave_no_pair_out(spark, monkeypatch):
    """Texts of few words near the threshold, so that buckets are crowded and most candidates fail."""
    monkeypatch.setattr(simhash, "CROWD", 3)
    rng, some = random.Random(12), []
    for i in range(220):
        words = [f"w{k}" for k in range(60 + rng.randrange(8))]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(40)}"
        some.append((i, " ".join(words)))
    sets = {d: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for d, t in some}
    roots = components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    gone = {r.doc_id for r in simhash.duplicates(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    assert gone == {d for d, r in roots.items() if d != r}


@pytest.mark.parametrize("hot", [512, 3])
def test_schemes_find_the_same_components(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)  # 3: most buckets of parts go through the whole ball
    rng = np.random.default_rng(5)
    centres = rng.integers(-(2**63), 2**63, 12)
    fps = sorted({int(c) ^ simhash.signed(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for c in centres for _ in range(12)})
    expected = components(fps, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for scheme in (simhash.Scheme(), simhash.Scheme(parts=3, keep=2)):
        roots = {r.node: r.root for r in simhash.components(simhash.linked(frame, scheme)).collect()}
        assert {f: roots.get(f, f) for f in fps} == expected


@pytest.mark.parametrize("small, hot", [(16, 512), (4, 8)])
def test_near_copies_go(spark, awkward, no_documents, monkeypatch, small, hot):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(4)
    some, groups = [], []
    for g in range(12):
        words = [f"w{rng.randrange(900)}" for _ in range(240)]
        group = []
        for k in range(30 if g == 0 else 3):
            copy = list(words)
            for _ in range(2 if k else 0):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            group.append(len(some))
            some.append((len(some), " ".join(copy)))
        groups.append(group)
    gone = {r.doc_id for r in simhash.duplicates(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    copies = {d for group in groups for d in group[1:]}
    assert not gone - copies and len(gone) >= 0.97 * len(copies)
    left = simhash.deduplicated(awkward)
    assert left.columns == awkward.columns and sorted(r.doc_id for r in left.filter("text like 'line 0%'").collect()) == [5, 5]
    assert simhash.deduplicated(no_documents).isEmpty()


def shuffled_blocks(rng, n):
    """Pairs of texts of similarity 0.8 or more whose differences stand in one block."""
    new = lambda k: [f"n{rng.randrange(10**9)}" for _ in range(k)]
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        yield words, (words[:248], words[:272], words + new(64), words[:150] + new(24) + words[174:], words[50:])[i % 5]


def test_near_copies_of_block_edits_all_go(spark):
    some = [(i, " ".join(w)) for i, w in enumerate(itertools.chain.from_iterable(shuffled_blocks(random.Random(7), 60)))]
    some += [(1000, "one two"), (1001, "ONE  two"), (1002, "two one"), (1003, None), (1004, "")]
    gone = {r.doc_id for r in simhash.duplicates(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    assert gone == set(range(1, 120, 2)) | {1001, 1004}


def test_near_copies_among_pages_of_one_vocabulary_all_go(spark):
    rng, some = random.Random(9), []
    for i in range(650):
        words = [f"w{k}" for k in range(60)]
        rng.shuffle(words)
        some.append((i, " ".join(words)))
        if i < 50:
            some.append((1000 + i, " ".join([*words[:-2], words[-1], words[-2]])))
    rows = spark.createDataFrame(some, "doc_id long, text string")
    assert simhash.sketched(rows, simhash.Similarity()).select("prints").distinct().count() == 1
    assert {r.doc_id for r in simhash.duplicates(rows).collect()} == set(range(1000, 1050))


# --- Personal data. ---


def personal(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(x * 2 - 9 * (x > 4) for x in d[-2::-2])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


PERSONAL = [
    "a@b.c@d.e @x.y a@@b.c a.b+c@mail-1.example.com, é@a.b x@y x@y.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "4111 1111-1111 1111 4111111111111112 +49 (170) 123-4567. +1 2",
    "card 4111111111111111 4111111111111111", "+491701234567 tel +4917012345678901234 0.0.0.0", "..@a.b %@a.b-.c a@b..c"]


def test_patterns_equal_brute_force(spark, awkward):
    rng = random.Random(9)
    random_texts = ["".join(rng.choice("a1.@+- 5(é)4%") for _ in range(rng.randrange(80))) for _ in range(4000)]
    for text in PERSONAL + random_texts + [r.text for r in table(spark, "documents").collect()]:
        assert pii.pattern_spans(text) == personal(text), text
    begin = time.time()
    pii.pattern_spans("a" * 400_000 + "1" * 400_000 + ".5" * 200_000 + "@" * 100_000 + "+" * 100_000)
    pii.field_spans(None, [LONG], [[]])
    assert time.time() - begin < 5
    found = pii.find_personal(awkward).collect()
    assert len(found) == len(texts())
    assert pii.find_personal(awkward.limit(0)).isEmpty()


def random_field(seed):
    rng = np.random.default_rng(seed)
    chain, skip = rng.normal(size=(2, pii.LABELS, pii.LABELS))
    return pii.Field(rng.normal(size=(len(pii.FEATURES), pii.LABELS)), chain + chain.T, skip + skip.T)


def test_propagation_is_exact_on_a_tree():
    graph = pii.Graph([(0, i, i + 1) for i in range(4)], [[0, 3], [0, 5], [1], [0, 7, 8]], [(0, 1), (1, 2)], [(0, 3)])
    field = random_field(1)
    unary, total = field.potentials(graph), np.zeros((4, pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=4):
        score = sum(unary[i, y] for i, y in enumerate(labels)) + field.chain[labels[0], labels[1]] + field.chain[labels[1], labels[2]] + field.skip[labels[0], labels[3]]
        for i, y in enumerate(labels):
            total[i, y] += np.exp(score)
    assert np.allclose(field.marginals(graph, rounds=200), total / total.sum(axis=1, keepdims=True), atol=1e-3)


def test_field_marks_other_spellings_of_a_number(spark):
    some = [(i, f"call +49 170 55{i:05d} now, mail user{i}@mail.example.com or 10.0.{i % 250}.7, total {i} of {i * 37} items") for i in range(400)]
    some.append((1000, "call +4917099887766 today " + "words " * 300 + "or 017099887766 tonight, order 12345 of 99"))
    rows = {r.doc_id: r for r in pii.find_personal(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    text = some[-1][1]
    at = text.index("017099887766")
    assert f"phone:{at}:{at + 12}" in rows[1000].spans.split(",") and "12345" not in [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in rows[1000].spans.split(","))]
    assert all(set(r.base.split(",")) <= set(r.spans.split(",")) for r in rows.values()) and PROSE


def test_labels_do_not_depend_on_the_block(monkeypatch):
    texts_ = [f"call +49 170 55{i:05d} or 017055{i:05d}, room {i} of 12.5, user{i}@mail.example.com and user{i}@other " * (1 + i % 3) for i in range(40)]
    base = [pii.pattern_spans(t) for t in texts_]
    field = random_field(3)
    alone = [pii.field_spans(field, [t], [b])[0] for t, b in zip(texts_, base)]
    assert any(alone)
    for block, messages in ((1, 50_000), (50, 7), (10**9, 50_000)):
        monkeypatch.setattr(pii, "BLOCK", block)
        monkeypatch.setattr(pii, "MESSAGES", messages)
        assert pii.field_spans(field, texts_, base) == alone


def test_a_text_full_of_addresses():
    text = " ".join(f"user{i}@mail{i}.example.com 10.0.{i % 256}.7 {i}" for i in range(50_000))
    begin = time.time()
    base = pii.pattern_spans(text)
    assert len(base) == 100_000
    spans = pii.field_spans(random_field(2), [text], [base])[0]
    assert time.time() - begin < 60
    meeting = pii.Meeting(base)
    assert all(meeting.first(a, b) is None for _, a, b in spans[:100])
