"""Tokenizer alignment, conversation prefixes and toxic spans against brute force, and on awkward rows."""

import hashlib
import itertools
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tablesmith.llm import alignment, near_texts, pivots, prefixes, toxicity, wrappers
from tablesmith.llm.pairhash import PairHash
from tablesmith.llm.simhash import BKTree

FOLDER = "/opt/tokenizers"


# --- minimal perfect hash ---------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_pair_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).permutation(1 << 20)[:n].astype(np.int64) - 500
    table = PairHash.from_bytes(PairHash.build(keys).to_bytes())
    assert sorted(table.index(keys).tolist()) == list(range(n))
    stored = table.ordered(keys)
    assert (stored[table.verified(keys, stored)] == keys).all()
    others = np.arange(1 << 21, (1 << 21) + 500)
    assert (table.verified(others, stored) == -1).all()


def test_pair_hash_lists_what_the_levels_leave(monkeypatch):
    monkeypatch.setattr("tablesmith.llm.pairhash.LEVELS", 1)
    keys = np.arange(300) * 7
    table = PairHash.from_bytes(PairHash.build(keys).to_bytes())
    assert len(table.rest) and sorted(table.index(keys).tolist()) == list(range(300))


# --- alignment --------------------------------------------------------------------------------------


def aligned(rows):
    a_tok = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    letters = alignment._byte_letters()
    counts, found = Counter(), []
    for doc, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        ab = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
        bb = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            a, b, ab, bb = [], [], [], []
        ends = {e: j for j, e in enumerate(itertools.accumulate(map(len, bb)))}
        links, groups, i0, j0 = [], [], 0, 0
        for i, e in enumerate(itertools.accumulate(map(len, ab))):
            if e in ends:
                j = ends[e]
                links.append((a[i], b[j]))
                groups.append(",".join(map(str, a[i0:i + 1])) + "|" + ",".join(map(str, b[j0:j + 1])))
                i0, j0 = i + 1, j + 1
        counts.update(links)
        found.append((doc, len(a), len(b), links, ";".join(groups)))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return counts, sorted([
        (d, na, nb, len(li), len(li), sum(counts[p] == top[p[1]] for p in li), sum(counts[p] for p in li), hashlib.sha256(g.encode()).hexdigest() if g else "", g)
        for d, na, nb, li, g in found], key=str)


ODD = [
    "Plain words, don't stop.", "", None, " ", "  two  spaces ", "<|endoftext|> and </s> <s> <0x41>", "tab\tnew\nline\r\n\x00\x0b end", "▁ hides a space", "Ελληνικά 漢字 🙂👩‍👩‍👧 é é",
    "ｆｕｌｌ ﬁ ½", "  \u0085 gaps", "x" * 3000, " " * 3000 + "x", "ab " * 60_000, "Plain words, don't stop."]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 1, "c", False, "k") for i, t in enumerate(ODD)] + [(None, "no id", 1, "c", True, "k"), (None, None, 1, "c", True, "k")]
    rows += [rows[0], rows[0], (3, "same id, other text", 2, "c", True, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk int, slice string, is_doc boolean, keys string")


def as_rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_alignment_against_brute_force(odd, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 4000)
    made = alignment.Alignment(odd)
    assert made.slices > 10
    counts, want = aligned([(r[0], r[1]) for r in odd.select("doc_id", "text").collect()])
    assert as_rows(made.documents()) == want
    got = {(r.a, r.b): r.n for r in made.pairs().collect()}
    assert got == dict(counts)
    assert as_rows(alignment.align(odd, with_groups=False).drop("groups")) == sorted([w[:-1] for w in want], key=str)


def test_alignment_of_nothing(odd):
    assert alignment.align(odd.limit(0)).count() == 0
    only_null = alignment.align(odd.where("text IS NULL"))
    assert {r.n_links for r in only_null.collect()} == {0}


def test_alignment_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = as_rows(entry.queries()["op11_tokenizer_alignment"](spark, sf))
    assert got == sorted([w[:-1] for w in aligned([tuple(r) for r in rows])[1]], key=str)


def test_both_forms_of_the_first_tokenizer_agree():
    load = alignment._Load(FOLDER)()
    rng = random.Random(5)
    texts = ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x300, 0xD7FF), rng.randrange(0xE000, 0x11000), 0x20, 0x0A])) for _ in range(40)) for _ in range(2000)]
    assert [load.fast.encode_ordinary(t) for t in texts] == [e.ids for e in load.slow.encode_batch(texts, add_special_tokens=False)]


# --- prefixes ---------------------------------------------------------------------------------------


def tries(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in turns.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
        ends[seq].append(c)
    kids = Counter(n[:-1] for n in nodes if n)
    leaves, saved = Counter(), Counter()
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1]) if n else 0
    return sorted([
        (min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in nodes.items()], key=str)


SCHEMA = "conv_id long, turn long, role string, text string, shard int, keys string, is_row string, n int, digest string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "r", 2, "d") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(4))
def test_prefixes_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 7)
    rng = random.Random(seed)
    rows = []
    for c in range(rng.choice([30, 250])):
        conv = rng.randrange(0, 5000) if seed % 2 else c
        # A third of the conversations are alike, and all share few turns.
        for t in range(3 if rng.random() < 0.3 else rng.randrange(1, 9)):
            rows.append((conv, t, rng.choice(["user", "user", None]), "same" if rng.random() < 0.8 else rng.choice(["", None, "é🙂", "b" * 40])))
    rows += rows[:3] + [(conv, None, None, None), (None, 1, "user", "lost"), (conv, 0, "z", "tie"), (conv, 0, "a", "tie")]
    assert as_rows(prefixes.prefix_trie(talk(spark, rows))) == tries(rows)


def test_prefixes_of_long_and_empty_conversations(spark):
    deep = [(1, t, "user", f"turn {t % 7}") for t in range(120)] + [(2, t, "user", f"turn {t % 7}") for t in range(119)]
    # Conversation 5 takes more turns from an absent head than it has itself: no turn is left.
    gone = next(c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = deep + [(gone, 1, "user", "only")]
    assert as_rows(prefixes.prefix_trie(talk(spark, rows))) == tries(rows)
    assert prefixes.prefix_trie(talk(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_double_array_holds_every_child(seed):
    rng = np.random.default_rng(seed)
    trie, level, expected = prefixes.DoubleArray(), np.array([0]), {}
    for _ in range(5):
        pairs = sorted({(int(s), int(t)) for s in level for t in rng.integers(0, 3000, rng.choice([1, 1, 1, 2, 15]))})
        parents, labels = np.array([p for p, _ in pairs]), np.array([t for _, t in pairs])
        trie.add(parents, labels)
        level = trie.step(parents, labels)
        assert (level > 0).all() and len(set(level.tolist())) == len(level)
        expected |= dict(zip(pairs, level.tolist()))
    for (s, t), child in expected.items():
        assert trie.step(np.array([s]), np.array([t]))[0] == child
        assert trie.step(np.array([s]), np.array([t + 5000]))[0] == -1


# --- toxic spans ------------------------------------------------------------------------------------

CALM = "river stone lamp green walk quiet table garden seven open letter window bread cloud paper music road train small happy".split()
RUDE = ["grobnik", "vexoid", "slurmish"]


def calm(rng, n):
    return [rng.choice(CALM) + rng.choice(["", "s", "ed"]) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        words = calm(rng, rng.randrange(5, 120))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 15)):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE) + rng.choice(["", "ly", "ness"]))
        text = " ".join(w + (". " if rng.random() < 0.1 else "") for w in words)
        rows.append((i, text, "x", 1.0, "y", 3))
        labels.append((i, int(toxic)))
    labels += [labels[0], (None, 1), (5000, 1), (7, None)]
    rows += [rows[1], (None, rows[0][1], "x", 1.0, "y", 3), (901, None, "x", 1.0, "y", 3), (902, "", "x", 1.0, "y", 3), (903, "?! 12\n", "x", 1.0, "y", 3)]
    rows.append((904, " ".join(calm(rng, 60_000)) + " grobnik", "x", 1.0, "y", 3))
    return (spark.createDataFrame(rows, "doc_id long, text string, _id string, _y double, _t string, near int"),
            spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels))


def test_toxic_spans(corpus):
    docs, labels, truth = corpus
    model = toxicity.train(docs, labels)
    got = docs.select("doc_id", "text", toxicity.toxicity(model, docs.text).alias("it")).select("doc_id", "text", "it.score", "it.spans").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    fresh = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(fresh) > 200
    right = [(r.score >= toxicity.ACCEPT) == bool(truth.get(r.doc_id)) for r in fresh if truth.get(r.doc_id) is not None]
    assert sum(right) / len(right) > 0.97
    for r in fresh:
        hit = [r.text[int(a):int(b)] for a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert all(w[:6] in {x[:6] for x in RUDE} for w in hit)
        assert bool(hit) == bool(truth[r.doc_id])
    by_id = {r.doc_id: r for r in got}
    assert by_id[901].score == by_id[902].score == by_id[903].score < 0.5 and by_id[901].spans == ""
    assert by_id[904].spans == f"{len(by_id[904].text) - 7}:{len(by_id[904].text)}"


def test_toxic_field_without_both_labels(corpus):
    docs, labels, _ = corpus
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert toxicity.train(docs.limit(0), labels) is None
    assert docs.limit(3).select(toxicity.toxicity(None, docs.text)["score"].alias("s")).distinct().collect()[0].s == 0.5


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(3)
    model = toxicity.SpanField({}, rng.normal(size=3 * toxicity.CLASSES), rng.normal(size=(2, 2)))
    own, counts = rng.integers(0, toxicity.CLASSES, 9), np.array([4, 1, 4])
    got = model.marginals(own, counts)
    unary = model.unary(own, np.array([0, 4, 5]))
    for s, n in zip([0, 4, 5], counts):
        total, on = 0.0, np.zeros(n)
        for y in itertools.product([0, 1], repeat=int(n)):
            w = np.exp(sum(unary[s + i] for i in range(n) if y[i]) + sum(model.step[y[i], y[i + 1]] for i in range(n - 1)))
            total, on = total + w, on + w * np.array(y)
        assert np.allclose(got[s:s + n], on / total)


def test_toxic_query_uses_no_held_out_label(spark, sf, monkeypatch):
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda docs, labels, **k: seen.append(labels) or train(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1"), **k))
    fewer = as_rows(entry.queries()["op13_toxic_span_field"](spark, sf))
    monkeypatch.setattr(toxicity, "train", train)
    assert seen and as_rows(entry.queries()["op13_toxic_span_field"](spark, sf)) == fewer


# --- names that operators use themselves ------------------------------------------------------------

NAMES = (
    "row id h _h _some_id _some_h some_id some_h doc _hid _hh _spans spans _email _ip _card _phone _iban _ssn _tel _key _source _lang _topic _tokens _weight"
    " _probability _repeat _kept _s _l _t _id _w _at _n _k _tk fp fingerprint root first stays none topic n_tokens weight probability repeat _c _q _it").split()


def test_stages_keep_the_callers_columns(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(calm(rng, 60)) for _ in range(30)]
    texts += [texts[0], texts[1] + " end", None, "", "call +1 (415) 555-0100 now", "IBAN DE89 3704 0044 0532 0130 00 USD"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)], schema)
    folder = str(tmp_path)
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, texts[5])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == "mixture" or out.columns == docs.columns, name
        replaced = {"topic", "n_tokens", "weight", "probability", "repeat", "_topic", "_tokens", "_weight", "_probability", "_repeat", "_source", "_lang", "_kept"}
        for r in out.collect():
            for n in set(NAMES) & set(out.columns) - (replaced if name == "mixture" else set()):
                assert r[n] == f"{n}{r['doc_id']}", (name, n)
    clean = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["personal_data"](spark, docs, folder).collect()}
    assert clean[34] == "call <phone> now" and clean[35] == "IBAN <iban> USD"


# --- wrappers: deep pages, slots over all pages, comments -------------------------------------------


def test_wrapper_of_deep_pages(spark):
    deep = "<div>" * 2000
    rows = [(i, "https://deep.example/a", f"<html><body><p class='top'>Same line</p>{deep}words {i}{'</div>' * 2000}</body></html>") for i in range(24)]
    got = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == {i: f"words {i}" for i in range(24)}


def test_slot_that_differs_once_is_no_template(spark):
    page = lambda i, note: f"<html><body><div class='lead'>{note}</div><div class='line'>Always here</div><article><p>Text {i} of this page</p></article></body></html>"
    body = lambda i, note: page(i, note).replace("<article>", "<section>").replace("</article>", "</section>")
    rows = [(i, "https://h.example/x", body(i, "Rare words" if i == 77 else "Common words")) for i in range(200)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[77] == "Rare words\n\nText 77 of this page" and got[5] == "Common words\n\nText 5 of this page"


def test_template_is_learned_from_all_pages(spark):
    # The line stands on the host's first page and on seven of 400 others: eight picked pages miss most of those.
    page = lambda i, line: f"<html><body>{line}<section><p>Text {i} of this page</p></section></body></html>"
    every = {i: page(i, "") for i in range(400)}
    hashes = {r.i: r.h for r in spark.createDataFrame([(i, page(i, "<div class='note'>Rare line</div>")) for i in every], "i int, html string").selectExpr("i", "xxhash64(html) AS h").collect()}
    some = sorted(hashes, key=hashes.get)[:1] + [i for i in range(0, 400, 57)]
    rows = [(i, "https://h.example/x", page(i, "<div class='note'>Rare line</div>") if i in some else html) for i, html in every.items()]
    first = min(spark.createDataFrame(rows, "i int, u string, html string").selectExpr("xxhash64(html) AS h", "i").collect()).i
    assert first in some
    for n in (1, 7):
        got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(n)).collect()}
        assert got == {i: f"Text {i} of this page" for i in every}
    # Copies of a page are one page: they make nothing template.
    copies = [(i, "https://h.example/x", page(1, "<div class='note'>Rare line</div>")) for i in range(20)]
    assert {r.text for r in wrappers.main_text(spark.createDataFrame(copies, "page_id int, url string, html string")).collect()} == {"Rare line\n\nText 1 of this page"}


def test_comment_articles_are_no_text():
    page = "<body><article><p>Story</p></article><article class='comment'><p>First!</p></article><div class='usercomments'><p>Second</p></div></body>"
    assert wrappers.extract(page) == "Story"


# --- near texts -------------------------------------------------------------------------------------


def groups_of(rows):
    """Groups of row numbers whose five-word shingles have similarity 0.8 or more, by comparing all with all."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets.append({b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        union = len(sets[i] | sets[j])
        if not union or len(sets[i] & sets[j]) >= 0.8 * union:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


@pytest.fixture(scope="module")
def alike(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for size in (1, 3, 6, 40, 300):
        for copies in (1, 2, 6):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for c in range(copies):
                words = list(base)
                if c:
                    words[rng.randrange(size)] = rng.choice(vocabulary) if size > 39 else words[0]
                rows.append((n, " ".join(words).upper() if c == 3 else " ".join(words)))
                n += 1
    crowd = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(60):
        words = list(crowd)
        words[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append((n, " ".join(words)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n"), (None, rows[0][1]), (None, "only here and without an id"), (0, rows[0][1]), (5, "another text with the id five")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, s string, root int"), rows


@pytest.mark.parametrize("bucket", [4096, 8])
def test_near_texts_against_brute_force(alike, bucket, monkeypatch):
    monkeypatch.setattr(near_texts, "BUCKET", bucket)
    df, rows = alike
    want = groups_of(rows)
    kept = near_texts.drop_similar(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(want))
    first = {}
    for g, r in zip(want, rows):
        first[g] = min(first.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted((d is None, d or 0) for d, _ in got) == sorted(first.values())
    assert near_texts.drop_similar(df.limit(0)).count() == 0


def test_near_texts_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    first = {}
    for g, r in zip(groups_of(rows), rows):
        first[g] = min(first.get(g, r[0]), r[0])
    assert sorted(r.doc_id for r in near_texts.drop_similar(df).collect()) == sorted(first.values())
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    assert sorted(r.doc_id for r in stage(spark, df, sf).collect()) == sorted(first.values())


def test_near_texts_far_apart_by_fingerprint(spark):
    # Similarity 0.8 exactly, fingerprints more than 16 bits apart.
    rng = random.Random(3)
    rows = []
    while len(rows) < 6:
        words = [f"v{rng.randrange(10**6)}" for _ in range(13)]
        pair = [" ".join(words), " ".join([*words[:-1], "other"])]
        if (near_texts.fingerprint(near_texts.shingles(pair[0])) ^ near_texts.fingerprint(near_texts.shingles(pair[1]))).bit_count() > 16:
            rows += [(len(rows) + i, t) for i, t in enumerate(pair)]
    assert len(set(groups_of(rows))) == 3
    kept = near_texts.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]


@pytest.mark.parametrize("partners", [0, 2])
@pytest.mark.parametrize("block", [4096, 7])
def test_near_texts_whatever_the_trees_propose(alike, partners, block, monkeypatch):
    # What the trees leave apart is judged pair by pair, also where a shard is cut into blocks.
    monkeypatch.setattr(near_texts, "RADIUS", 16 if partners else -1)
    monkeypatch.setattr(near_texts, "BLOCK", block)
    df, rows = alike
    assert near_texts.drop_similar(df).count() == len(set(groups_of(rows)))


def test_nearest_in_a_tree():
    rng = random.Random(5)
    tree, values = BKTree(), []
    for _ in range(300):
        v = rng.choice(values) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if values and rng.random() < 0.7 else rng.getrandbits(64)
        got = [(values[i] ^ v).bit_count() for i in tree.nearest_then_add(v, 16, 2)]
        assert got == sorted(d for d in ((x ^ v).bit_count() for x in values) if d <= 16)[:2]
        values.append(v)


# --- pivots -----------------------------------------------------------------------------------------


def test_very_long_and_very_short_vectors_link(spark):
    rows = [(0, [1e200, 2e200], 1), (1, [1e200, 2e200], 1), (2, [1e-200, 2e-200], 1), (3, [1.0, 2.0], 1), (4, [1e308, -1e308], 1), (5, [float("inf"), 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4), 5: (0, 5)}


def test_few_cosines_are_worked_out():
    rng = np.random.default_rng(1)
    x = pivots.unit(rng.normal(size=(10_000, 64)))
    points = pivots.directions(64, max(pivots.MIN_PIVOTS, len(x) // pivots.VECTORS_PER_PIVOT))
    held = np.zeros((len(x), len(points)), np.float32)
    np.put_along_axis(held, pivots.nearest_pivots(x, points), 1, axis=1)
    chosen = sum(int((held[i:i + 1000] @ held.T >= pivots.SHARED).sum()) for i in range(0, len(x), 1000)) - len(x)
    assert chosen < 0.1 * len(x) * (len(x) - 1)


def test_directions_are_compared_within_little_memory():
    tracemalloc.start()
    count = pivots.fitting(16, 16_384)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    points = pivots.drawn(16, 16_384)
    assert 10 < count < len(points) and (points[:count] == pivots.directions(16, 16_384)).all()


def test_nearest_pivots_are_the_nearest():
    rng = np.random.default_rng(4)
    x = pivots.unit(rng.normal(size=(700, 12)))
    for count in (6, 100, 5000):
        points = pivots.drawn(12, count)
        cosines = np.sort(x @ points.T, axis=1)[:, ::-1][:, :pivots.DEPTH]
        assert np.allclose(np.take_along_axis(x @ points.T, pivots.nearest_pivots(x, points), axis=1), cosines, atol=1e-12)


def test_sub_lists_tell_the_same_links_as_all_pairs():
    rng = np.random.default_rng(6)
    points = pivots.drawn(64, 1024)
    for size, crowd in ((60, 0), (400, 0), (900, 60)):
        z = rng.normal(size=(size * 40, 64))
        z = pivots.unit(np.concatenate([z, z + rng.normal(size=z.shape) * 0.3, rng.normal(size=64) + rng.normal(size=(crowd, 64)) * 0.25]))
        orders = np.sort(pivots.nearest_pivots(z, points), axis=1).astype(np.uint16)
        pivot = int(np.bincount(orders[-max(crowd, 10):, :9].ravel()).argmax())
        rows = np.flatnonzero((orders[:, :9] == pivot).any(axis=1))
        x, orders, ids, n = z[rows].astype(np.float32), orders[rows], rows * 3, rng.integers(1, 4, len(rows))
        side = rng.random(len(rows)) < 0.5
        for blocks in (None, side):
            left = np.arange(len(rows)) if blocks is None else np.flatnonzero(~side)
            want = pivots.block_links(ids, n, pivots.unit(x), orders, left, left if blocks is None else np.flatnonzero(side), pivot)
            got = pivots.sub_list_links(ids, n, x, orders, blocks, pivot)
            assert got is not None and (got[0] == want[0]).all() and (got[1] == want[1]).all()
            assert size < 400 or want[0].any()


def test_shares_and_blocks_of_lists_link_alike(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 8))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.05, x[:20]])
    rows = [(i, [float(c) for c in v], i % 2) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted(pivots.near_vectors(table).collect())
    assert any(r.n_links for r in want)
    monkeypatch.setattr(pivots, "SHARE_BYTES", 30_000)
    monkeypatch.setattr(pivots, "BLOCK", 4)
    monkeypatch.setattr(pivots, "LONGEST", 6)
    assert sorted(pivots.near_vectors(table).collect()) == want
