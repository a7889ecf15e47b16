"""The corpus operators against brute force, and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from compare import connect, mismatch

import __spark_entry__ as entry
import corpus_pipeline
from tablesmith.llm import crf, decontaminate, lbl, mixing, passages, pii, pivots, queries, revisits, simhash, wrappers

WORDS = "ada bo cy dee eli fay gus hal ivy jo kit lou may ned oz pam quin ray sue tom una val wes xia yul zoe".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, doc string, _at int, anchor int"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    shared = prose(1, 60)
    texts = [
        prose(2, 80) + " " + shared, shared + " " + prose(3, 80), prose(2, 80) + " " + shared, prose(2, 80) + " " + shared + " end", "", None, "  \n ",
        "one", "A b", prose(4, 30000), prose(4, 30000) + " x", "mail a@b.co or +1 (415) 555-0100, 4111 1111 1111 1111", "\n".join(["same line here"] * 50)]
    rows = [(i, t, "en", "s", 1, "x", "y", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def removed(docs, n=13):
    words = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - n + 1):
            if i is not None:
                key = tuple(w[k:k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k:k + n])] < i:
                gone[k:k + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [0.005, 1e-9])
def test_passages(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(passages, "HOT_SHARE", hot)
    got = passages.remove_repeats(docs)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()], key=str) == removed(rows_of(docs))
    assert passages.remove_repeats(empty).count() == 0


def test_salted_anchors(spark):
    shared = prose(9, 40)
    many = spark.createDataFrame([(i, f"{prose(i + 100, 5)} {shared} {prose(i + 900, 5)}") for i in range(60)], "doc_id long, text string")
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_repeats(many).collect()], key=str)
    assert got == removed(rows_of(many))


def by_hand(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(len(w) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def clusters(values, linked):
    up = list(range(len(values)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def test_near_copies(docs, empty):
    rows = rows_of(docs)
    prints = [by_hand(t) for _, t in rows]
    roots = clusters(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, p - (1 << 64) if p >> 63 else p, least.get(r)) for (i, _), p, r in zip(rows, prints, roots)), key=str)
    assert sorted([tuple(r) for r in simhash.near_copies(docs).collect()], key=str) == want
    assert simhash.near_copies(empty).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == set(least.values())


def test_near_copies_go_by_row(spark):
    """Rows without an id, and rows that share one, stay or go by their own text."""
    a, b, c, d, e, f, g = (prose(40 + i, 80) for i in range(7))
    long = prose(4, 30000)
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (3, d), (7, d), (7, e), (8, e), (9, f), (9, f), (9, g), (None, long), (None, long + " x")]
    kept = rows_of(simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    of_long = [r for r in kept if (r[1] or "").startswith(long)]
    assert len(of_long) == 1
    rest = sorted((r for r in kept if r not in of_long), key=str)
    assert rest == sorted([(1, a), (None, b), (None, c), (3, d), (7, e), (9, f), (9, g)], key=str)


def test_large_shards_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 2)
    rng = np.random.default_rng(5)
    values = sorted({0} | {sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for k in (1, 2, 3, 5, 8) for _ in range(40)})
    from tablesmith.llm.common import components

    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()}
    roots = clusters(values, lambda a, b: (a ^ b).bit_count() <= 3)
    groups = {}
    for v, r in zip(values, roots):
        groups.setdefault(r, []).append(v)
    for g in groups.values():
        assert len({found.get(v, v) for v in g}) == 1
    assert len({found.get(v, v) for v in values}) == len(groups)


def test_quality_held_out(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    got = entry.queries()["op3_line_field_quality"](spark, big).toPandas()
    labels = duckdb.sql(f"select doc_id, quality from '{big}/labels.parquet'").df()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got.merge(labels, on="doc_id")
    held = held[held.held_out]
    assert ((held.predicted == held.quality).mean()) > 0.95


def test_chain_marginals():
    rng = np.random.default_rng(3)
    step = rng.normal(size=(2, 2))
    u = rng.normal(size=5)
    good, pairs = crf._chain(np.r_[u, u[:1]], np.array([5, 1]), step)
    weight, want, total = np.zeros(5), np.zeros((2, 2)), 0.0
    for code in range(32):
        y = [code >> i & 1 for i in range(5)]
        p = math.exp(sum(u[i] * y[i] for i in range(5)) + sum(step[y[i], y[i + 1]] for i in range(4)))
        total += p
        weight += p * np.array(y)
        for i in range(4):
            want[y[i], y[i + 1]] += p
    assert np.allclose(good[:5], weight / total) and np.allclose(pairs, want / total)
    assert np.isclose(good[5], 1 / (1 + math.exp(-u[0])))


def test_quality_odd_rows(spark, docs, empty):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(0, 1), (12, 0), (1, 1), (None, 1), (9, None)], "doc_id long, quality int")
    assert crf.train(empty, labels) is None and crf.keep_good(docs, None).count() == docs.count()
    field = crf.train(docs, labels, held_out=9)
    scores = docs.select(crf.quality(field, F.col("text")).alias("s")).collect()
    assert len(scores) == docs.count() and all(0 <= r.s <= 1 for r in scores)
    assert crf.keep_good(docs, field).columns == docs.columns


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    near = np.concatenate([base, base + rng.normal(size=base.shape) * 0.15, base[:5], base[:5]])
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(near.astype(np.float32))]
    more = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, rows[0][1], None), (905, [1.0], 0), (None, rows[0][1], 0), (906, [], 1)]
    got = {r.vec_id: r for r in pivots.near_vectors(spark.createDataFrame(rows + more, "vec_id long, embedding array<float>, label int")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.9 * link.sum() <= found <= link.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904, 905, 906))
    assert got[None].n_links == 0 and not got[None].kept
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pivots.near_vectors(none).count() == 0


def test_vectors_in_a_crowd(spark):
    """Distinct near vectors in one large group, in a field of others, against brute force."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64) / 8
    crowd = centre / np.linalg.norm(centre) * np.sqrt(0.94) + rng.normal(size=(10500, 64)) * np.sqrt(0.06 / 64)
    x = np.concatenate([crowd, rng.normal(size=(15000, 64)) / 8])
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x)), "label": np.zeros(len(x), int)}))
    got = pivots.near_vectors(table.repartition(8)).toPandas().set_index("vec_id").sort_index()
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    links = np.concatenate([(x[i:i + 500] @ x.T >= 0.93).sum(axis=1) - 1 for i in range(0, len(x), 500)])
    assert (got.n_links.to_numpy() <= links).all()
    assert got.n_links.sum() >= 0.99 * links.sum()
    assert (got.n_links >= 0.9 * links).mean() >= 0.99
    linked = np.flatnonzero(links[:10500] > 100)
    assert len(linked) > 9000 and (got.component_id.to_numpy()[linked] == linked.min()).all()


def test_directions_suit_any_length():
    rng = np.random.default_rng(9)
    for dim in (1, 2, 3, 4, 8, 64):
        p = pivots.directions(dim, 4096)
        x, w = pivots.unit(rng.normal(size=(3000, dim))), rng.normal(size=(3000, dim))
        w -= (x * w).sum(axis=1, keepdims=True) * x
        y = x if dim == 1 else 0.93 * x + np.sqrt(1 - 0.93**2) * pivots.unit(w)
        a, b = pivots.nearest_pivots(x, p), pivots.nearest_pivots(y, p)
        assert ((a[:, :, None] == b[:, None, :]).sum(axis=(1, 2)) >= pivots.SHARED).mean() > 0.99


def test_language_model(spark, docs, empty):
    from pyspark.sql import functions as F

    some = docs.where("doc_id is not null")
    got = lbl.train_and_score(some).collect()
    counts = Counter()
    for i, t in rows_of(some):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(lbl.tokens((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows_of(some))
    for r in got:
        w = lbl.tokens((texts[r.doc_id] or "").encode())
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score < 0
    model, others = lbl.learn(some)
    total = np.exp(model.near[:, None, :] + model.far[None, :, :] - model.norm.T[:, :, None]).sum(axis=2)
    assert np.allclose(total, 1)
    assert lbl.train_and_score(empty).count() == 0
    assert lbl.score(docs, *lbl.learn(empty), F.lit(True)).count() == docs.count()
    held = np.bincount(model.labels, model.counts + 0.5, model.rare + 1)
    for r in others.collect():
        held[r["class"]] += r.n + 0.5
    held[model.rare] += 0.5
    assert np.allclose(held, model.whole)


def test_language_model_held_out(spark, sf):
    got = [r for r in entry.queries()["op5_log_bilinear"](spark, sf).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.98 * sum(r.base_score for r in got)


def test_language_model_without_a_frequent_list(spark, docs, monkeypatch):
    # With a short list most tokens take the joined path: counts and probabilities stay the same.
    some = docs.where("doc_id is not null")
    whole = {(r.doc_id, r.n_tokens, r.n_known): r for r in lbl.train_and_score(some).collect()}
    monkeypatch.setattr(lbl, "FREQUENT", 20)
    monkeypatch.setattr(lbl, "HEADS", 15)
    got = {(r.doc_id, r.n_tokens, r.n_known): r for r in lbl.train_and_score(some).collect()}
    assert got.keys() == whole.keys()
    assert all(got[k].base_score == pytest.approx(whole[k].base_score) for k in got)
    model, others = lbl.learn(some)
    assert len(model.words) == 20 and len(model.labels) == 20
    classes = {r["class"] for r in others.where(f"n >= {lbl.SEEN}").collect()}
    assert len(classes - {model.rare}) > 1 and {r["class"] for r in others.where(f"n < {lbl.SEEN}").collect()} <= {model.rare}


def test_shares_keep_all_counts(spark):
    rows = [(1, 10 * lbl.STEPS * lbl.ROUNDS * lbl.BATCH), (2, 7), (3, 1)]
    total = sum(n for _, n in rows)
    cut = lbl.shares(spark.createDataFrame(rows, "k bigint, n bigint"), total)
    assert cut.rdd.getNumPartitions() == total // lbl.share_tokens(total)
    got = Counter()
    for r in cut.collect():
        got[r.k] += r.n
        assert r.n <= lbl.share_tokens(total)
    assert got == dict(rows)


def test_shares_do_not_follow_the_partitions(spark, monkeypatch):
    total = 8 * lbl.share_tokens(1)
    rows = [(k, total // 4000) for k in range(4000)]
    frame = type(spark.range(0))
    deal = frame.repartition
    packed = {}
    for least in (1, 40):
        monkeypatch.setattr(frame, "repartition", lambda self, n, *c, least=least: deal(self, max(n, least), *c))
        got = lbl.shares(spark.createDataFrame(rows, "k bigint, n bigint"), total).mapInArrow(lbl._packed, "k binary, n binary").collect()
        packed[least] = sorted((bytes(r.k), bytes(r.n)) for r in got)
    assert packed[1] == packed[40] and len(packed[1]) == total // lbl.share_tokens(total)
    assert sorted(np.concatenate([np.frombuffer(k, dtype=np.int64) for k, _ in packed[1]]).tolist()) == [k for k, _ in rows]


def test_tokens_of_several_texts():
    # Numbers of other words are counted anew in each text; contexts do not reach over the ends of texts.
    ids = [np.array([5, -1, -2], np.int32), np.array([-1], np.int32), np.array([-2, 7, -1], np.int32)]
    lists = {"at": [[0, 1], [], [1]], "n": [[9, 8], [], [4]], "class": [[1, 2], [], [3]]}
    batch = pa.record_batch(
        [pa.array([zstandard.compress(i.tobytes()) for i in ids]), pa.array([2, 1, 2], pa.int32()), *[pa.array(x, pa.list_(pa.int64())) for x in lists.values()]],
        names=["ids", "n_words", *lists])
    for at_once in (1, 4, 100):
        found = []
        for whole, counts, classes, starts in lbl._tokens_of(batch, 6, at_once):
            c = lbl._looked_up(whole, np.arange(10), classes)
            n = lbl._looked_up(whole, np.full(10, 50), counts)
            one, two = lbl._before(c, starts, 99)
            found += [x.tolist() for x in np.split(np.stack([c, n, one, two], axis=1), starts[1:])]
        assert found == [
            [[5, 50, 99, 99], [1, 9, 5, 99], [2, 8, 1, 5]], [[6, 0, 99, 99]], [[3, 4, 99, 99], [7, 50, 3, 99], [6, 0, 7, 3]]]


def test_words_are_kept_once(spark, docs, monkeypatch):
    # Of what is written to learn the classes only one table holds the words without a number, and none their company.
    monkeypatch.setattr(lbl, "FREQUENT", 20)
    monkeypatch.setattr(lbl, "HEADS", 15)
    kept, write = {}, lbl.written
    monkeypatch.setattr(lbl, "written", lambda df, label: kept.setdefault(label, write(df, label)))
    _, others = lbl.learn(docs)
    assert [label for label, t in kept.items() if "word" in t.columns] == ["counts", "others"]
    assert kept["others"].columns == ["id", "word", "n", "class"] and kept["others"].where("word is not null").count() == others.count()


def test_company_across_texts(spark):
    # Words without a number are known by their spelling, and gaps part the texts.
    ids = [np.array([0, -1, 1, -2], np.int32), np.array([-1, 0], np.int32)]
    batch = pa.record_batch([pa.array([zstandard.compress(i.tobytes()) for i in ids]), pa.array([[b"x", b"y"], [b"y"]])], names=["ids", "words"])
    out, named = (o.to_pydict() for o in lbl._company(2, 2, np.array([0, 1]), 2)(iter([batch])))
    got = {w: (n, a, b) for w, n, a, b in zip(out["word"], out["n"], out["c0"], out["c1"])}
    assert got == {b"x": (1, 1, 1), b"y": (2, 2, 1)} and named["n"] == []


def test_head_groups():
    blocks = np.kron(np.eye(3), np.full((4, 4), 50.0)) + 1
    groups = lbl.head_groups(blocks, groups=3)
    assert len(set(groups)) == 3 and all(len(set(groups[i:i + 4])) == 1 for i in (0, 4, 8))


def test_pages(spark, sf):
    import html as h

    got = {r.page_id: r for r in entry.queries()["op6_wrapper_induction"](spark, sf).collect()}
    for i, page in duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
        assert got[i].text == "\n\n".join(p for p in parts if p) and got[i].n_chars == len(got[i].text)


def test_wrappers(spark):
    def page(i):
        return f"<body><div class=top>Site name</div><div class=x><p>Story {i} &amp; more</p><p>about  {i}</p></div><div>Printed on paper</div></body>"

    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(12)] + [(90, None, page(1)), (91, "http://b.org", None), (92, "x", ""), (93, "http://c.org", "<div>" * 5000 + "deep")]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[3] == "Story 3 & more\n\nabout 3"
    assert got[90].startswith("Site name") and got[91] == got[92] == "" and got[93] == "deep"
    assert wrappers.extract("<body><article><h1>A</h1><p>b<br>c<aside>no</aside><div class='comments'>no</div></article><form>no</form>") == "A\n\nb c"
    assert wrappers.main_text(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


def test_windows(spark, docs, empty):
    items = spark.createDataFrame([(1, prose(1, 30)), (2, "ONE"), (2, "one"), (3, None), (4, ""), (None, "zzz")], "item_id long, text string")
    got = decontaminate.contamination(docs, items).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].items == ["1"] and by[0].n_hit == 30 and by[7].items == ["2"] and by[5].n_words == 0 and by[9].n_hit == 0
    assert decontaminate.contamination(docs, items.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, items).count() == 0
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()}.isdisjoint({0, 1, 2, 3, 7})
    cut = decontaminate.decontaminate(docs, items, remove="spans")
    assert decontaminate.contamination(cut, items).where("n_hit > 0").count() == 0 and cut.count() == docs.count()


def test_personal_data_base(spark, sf):
    for folder in (sf, sf.replace("sf0.001", "sf0.01")):
        assert mismatch(entry.queries()["op8_personal_data"](spark, folder).drop("spans"), connect(folder), queries.OP8_BASE_SQL) is None


def test_personal_data(spark, docs, empty):
    text = "IBAN DE89 3704 0044 0532 0130 00, call 415-555-0100, a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 +49 30 1234567é 4111-1111-1111-1111 1"
    long = "9 " * 40000 + "a" * 40000 + "1" * 40000
    frame = spark.createDataFrame([(1, text), (2, long), (3, None)], "doc_id int, text string")
    found = {r.doc_id: [(s.kind, s.text) for s in r["all"]] for r in pii.spans(frame).collect()}
    assert found[2] == [] and found[3] == []
    # A card match takes as many digits as it can and is not tried again.
    assert found[1] == [("email", "a@b.c"), ("email", "_d@e.f"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("phone", "+49 30 1234567"), ("iban", "DE89 3704 0044 0532 0130 00"), ("tel", "415-555-0100")]
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.where("doc_id = 11").first().text == "mail <email> or <phone>, <card>"
    assert red.where("doc_id = 5").first().text is None and pii.redact(empty).count() == 0


def test_rake():
    cells = [("a", "x", "t", 100), ("a", "y", "t", 10), ("b", "x", "u", 50), ("b", "y", "t", 40)]
    w = mixing.rake(cells, {"source": {"a": 3, "b": 7}, "lang": {"x": 1, "y": 1}, "topic": {"t": 7, "u": 3, "none": 9}}, sweeps=500)
    assert w == pytest.approx([0.2, 0.1, 0.3, 0.4], abs=1e-6)


def test_mix(docs, empty):
    got = mixing.mix(docs)
    assert got.count() == docs.count() and mixing.mix(empty).count() == 0
    r = got.where("doc_id is null").first()
    assert r._source == "unknown" and 0 <= r._probability <= 1 and r._repeat >= 1


def test_revisits(spark):
    kind = "record_id long, url string, ts long, status int, headers map<string,string>, slot int, h int"
    rows = [
        (1, "HTTP://www.A.org:80/p/?b=2&a=1&utm_x=3#f", 10, 200, {"ETag": '"1"', "Content-Length": "9", "Vary": "x"}, 0, 0),
        (2, "https://a.org/p?a=1&b=2", 9000, 304, {"etag": 'W/"1"', "Vary": "y", "Content-Length": "0"}, 0, 0),
        (3, "https://a.org/p?a=1&b=2", 10, 304, None, 0, 0), (4, "https://a.org/p?a=1&b=2", 9, 304, {}, 0, 0),
        (5, "https://a.org/p?a=1&b=2", 9001, 304, {"etag": '"2"'}, 0, 0), (6, None, 1, 304, None, 0, 0), (7, "http://b", None, 304, None, 0, 0), (None, "http://b", 1, None, None, 0, 0)]
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, kind)).collect()}
    assert {i: (r.outcome, r.refers_to) for i, r in got.items()} == {2: ("resolved", 1), 3: ("unvalidated", 1), 4: ("missing", None), 5: ("mismatch", None)}
    assert got[2].headers == {"etag": 'W/"1"', "vary": "y", "content-length": "9"} and got[2].url == "a.org/p?a=1&b=2"
    assert revisits.resolve(spark.createDataFrame([], kind)).count() == 0


def test_pipeline_stages(spark, sf, docs, empty):
    for frame in (docs, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf)
            if name != "mixture":
                assert out.columns == frame.columns
            out.count()
    given = spark.read.parquet(f"{sf}/documents.parquet")
    near = simhash.drop_near_copies(given).select("doc_id").collect()
    rows = rows_of(given)
    assert len(near) == len(set(clusters([by_hand(t) for _, t in rows], lambda a, b: (a ^ b).bit_count() <= 3)))
