"""Neighbours, pieces, toxicity, near duplicates, media and the pipeline against brute force, round trips and held-out rows."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from pagemend.llm import ann, media, near_dedup, pieces, toxicity
from pagemend.llm.components import connected

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", "  two  spaces ", "Hello world", "é日本🦊\x00", "▁mark", "a" * 3000, "line\none\ttab", "word " * 4000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double"


# --- neighbours --------------------------------------------------------------


def brute_nearest(rows, queries, k):
    usable = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in usable:
        if queries(q):
            best = {}
            for i, b in usable:
                if i != q:
                    d = float(np.sqrt(((a - b) ** 2).sum()))
                    best[i] = min(d, best.get(i, math.inf))
            out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def test_neighbours_of_a_small_table_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(120)]
    rows += [(200, [0.0] * 6), (201, None), (202, [1.0, None] + [0.0] * 4), (203, [float("nan")] + [1.0] * 5), (204, [float("inf")] * 6), (None, [1.0] * 6), (300, rows[0][1]), (301, rows[0][1])]
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<float>, score int, rank string")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(r.score, 9), r.vec_id))
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = {q: [(round(d, 9), i) for d, i in best] for q, best in brute_nearest(f32, lambda q: q % 10 == 0, 10).items()}
    assert got == want
    assert ann.nearest(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_fewer_candidates_than_asked_for(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    (row,) = ann.nearest(table, F.col("vec_id") == 0).collect()
    assert (row.rank, row.vec_id, row.score) == (1, 1, 1.0)


def test_recall_of_a_forest(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24)) * 2
    x = (centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 24))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 100 == 0, leaf=64).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 100):
        d = ((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1)
        d[q] = math.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(got) == 60 and hits / 600 >= 0.9


# --- pieces ------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.Model(PIECES)


def brute_score(model, text):
    """The greatest score of any split, by plain dynamic programming over the piece list."""
    table = {p: s for (p, _, k), s in zip(pieces.read_model(PIECES)["pieces"], model.scores.tolist(), strict=True) if k in (pieces.NORMAL, pieces.USER)}
    best = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 40), j):
            if text[i:j] in table:
                best[j] = max(best[j], best[i] + table[text[i:j]])
        if text[j - 1] not in table:
            best[j] = max(best[j], best[j - 1] + model.least)
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.text(st.one_of(st.sampled_from("the and of ing▁ ABC\n"), st.characters(codec="utf-8")), max_size=30))
def test_pieces_are_the_best_split_and_decode(text):
    model = pieces.Model(PIECES) if not hasattr(test_pieces_are_the_best_split_and_decode, "m") else test_pieces_are_the_best_split_and_decode.m
    test_pieces_are_the_best_split_and_decode.m = model
    enc = pieces.encoder(model)
    ids = enc.encode(text)
    assert enc.decode(ids) == text.replace("▁", " ")
    byte, score, at = set(model.bytes_), 0.0, 0
    out = ids.tolist()
    while at < len(out):
        if out[at] in byte and model.out[out[at]] not in (b"\n",):
            n = next(k for k in range(1, 5) if _is_char(b"".join(model.out[i] for i in out[at : at + k])))
            score, at = score + model.least, at + n
        else:
            score, at = score + (model.least if out[at] in byte else model.scores[out[at]]), at + 1
    whole = "▁" + text.replace(" ", "▁") if text else ""
    assert score == pytest.approx(brute_score(model, whole))


def _is_char(data):
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def test_pieces_searched_together(monkeypatch, model):
    monkeypatch.setattr(pieces, "FEW_CHUNKS", 0)
    monkeypatch.setattr(pieces, "CHUNKS_AT_ONCE", 7)
    rng = np.random.default_rng(12)
    letters = [*"etaoinshrdlucm▁éü日🦊-0.\n"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 90))) for _ in range(60)] + ["the quick brown fox " * 20, "", " ", "antidisestablishmentarianism"]
    enc, plain = pieces.Encoder(model), pieces.Encoder(model)
    for text, ids in zip(texts, enc.encode_all(texts), strict=True):
        marked = "▁" + text.replace(" ", "▁") if text else ""
        assert ids.tolist() == [i for c in pieces._CHUNK.findall(marked) for i in plain.viterbi(c)]


def test_unread_models(tmp_path, model):
    piece = lambda p, score, kind: b"\x0a" + bytes([len(p) + 9]) + b"\x0a" + bytes([len(p)]) + p + b"\x15" + np.float32(score).tobytes() + b"\x18" + bytes([kind])
    rules = lambda *pairs: b"\x1a" + bytes([2 * len(pairs)]) + b"".join(bytes(p) for p in pairs)
    path = tmp_path / "m.model"
    words = piece(b"a", -1.0, 1) + piece(b"ab", -1.5, 1)
    path.write_bytes(piece(b"<unk>", 0.0, 2) + words + rules((0x18, 0), (0x20, 0)))
    enc = pieces.Encoder(pieces.Model(str(path)))
    assert enc.encode("abxa").tolist() == [2, 0, 1] and enc.encode_all(["é"])[0].tolist() == [0]  # no byte pieces: the unknown piece
    path.write_bytes(words + rules((0x20, 0)))
    with pytest.raises(ValueError, match="neither"):
        pieces.Model(str(path))
    path.write_bytes(piece(b"<unk>", 0.0, 2) + words + rules((0x18, 1)))
    with pytest.raises(ValueError, match="normalizes"):
        pieces.Model(str(path))


def test_trie_holds_its_words_only():
    words = {"a": 0, "ab": 1, "abc": 2, "b": 3, "bé": 4, "zz": 5}
    trie = pieces.DoubleArray(words)

    def find(word):
        s = 0
        for ch in word:
            c = trie.codes.get(ch, 0)
            t = trie.base[s] + c
            if not c or t >= len(trie.check) or trie.check[t] != s or not t:
                return -1
            s = t
        return trie.value[s]

    assert {w: find(w) for w in words} == words
    assert [find(w) for w in ("z", "c", "abcd", "ba", "")] == [-1] * 5


def test_encode_texts(spark, model):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, "Hello world", 1)], "doc_id long, text string, n_pieces int")
    got = pieces.encode_texts(docs, PIECES, with_ids=True).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        p, text = r["__pieces"], r.text or ""
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.n_pieces and zlib.crc32(bytes(p.ids)) == p.ids_crc32 and p.exact == ("▁" not in text)
        assert p.decoded_sha256 == hashlib.sha256(text.replace("▁", " ").encode()).hexdigest()
    assert pieces.encode_texts(docs.limit(0), PIECES).count() == 0


# --- toxicity ----------------------------------------------------------------


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{k}" for k in rng.zipf(1.3, 40) % 500]
        grade = int(rng.choice(3, p=[0.8, 0.12, 0.08]))
        words += [f"bad{k}" for k in rng.integers(0, 6, 2 * grade)]
        rng.shuffle(words)
        docs.append((i, " ".join(words), None, None))
        labels.append((i, 0 if grade == 2 else 1, int(grade > 0)))
    return docs, labels


@pytest.fixture(scope="module")
def tox(spark):
    docs, labels = labelled(3000, 3)
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic boolean, grade int")
    lab = spark.createDataFrame([*labels[:2400], (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return d, lab, labels, toxicity.train(d, lab)


def test_severity_follows_held_out_grades(tox):
    d, _, labels, model = tox
    assert model.t1 < model.t2
    want = {i: (0 if not t else 1 + (q == 0)) for i, q, t in labels[2400:]}
    rows = [r for r in toxicity.score_texts(d, model).collect() if r.doc_id in want]
    mean = [np.mean([r["__toxicity"].expected_severity for r in rows if want[r.doc_id] == g]) for g in range(3)]
    assert mean[0] < 0.3 < mean[1] < mean[2]
    wrong = sum(r["__toxicity"].toxic != (want[r.doc_id] > 0) for r in rows)
    assert wrong / len(rows) < 0.08


def test_toxicity_edges(spark, tox):
    d, labels, _, model = tox
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "bad1 bad2 bad3 " * 30000)], "doc_id long, text string")
    got = toxicity.score_texts(docs, model).collect()
    assert [r["__toxicity"].toxic for r in got] == [False, False, False, True]
    assert toxicity.score_texts(docs.limit(0), model).count() == 0
    none = toxicity.train(d, labels.filter("toxic = 0"))
    assert not any(r["__toxicity"].toxic for r in toxicity.score_texts(docs, none).collect())
    again = toxicity.train(d.repartition(5), labels.repartition(3))
    assert (again.words, again.t1, again.t2, again.cut) == (model.words, model.t1, model.t2, model.cut)


def plain_probability(score, grade, t1, t2):
    sig = lambda x: 1 / (1 + math.exp(-x))
    return [1 - sig(score - t1), sig(score - t1) - sig(score - t2), sig(score - t2)][grade]


def test_likelihood_and_slopes_by_definition():
    rng = np.random.default_rng(9)
    score, grade, t1, t2 = rng.normal(size=60), rng.integers(0, 3, 60), -0.4, 0.9
    prob, by_score, by_t2 = toxicity._slopes(score, grade, t1, t2)
    h = 1e-6
    for i in range(60):
        log = lambda ds=0.0, d2=0.0: math.log(plain_probability(score[i] + ds, grade[i], t1, t2 + d2))  # noqa: B023, E731
        assert prob[i] == pytest.approx(plain_probability(score[i], grade[i], t1, t2))
        assert by_score[i] == pytest.approx((log(h) - log(-h)) / (2 * h), abs=1e-5)
        assert by_t2[i] == pytest.approx((log(0, h) - log(0, -h)) / (2 * h), abs=1e-5)


def test_fit_against_plain_descent():
    """Weights and thresholds of a small table against plain coordinate steps on the penalized likelihood."""
    rng = np.random.default_rng(10)
    x = rng.random((120, 5)) < 0.4
    grade = np.clip((x @ [2.0, -1.0, 0.0, 1.0, 0.0] + rng.logistic(size=120)).round().astype(int), 0, 2)
    rows, cols = np.nonzero(x)
    l1 = 0.01

    def value(w, t1, t2):
        return -sum(math.log(max(1e-12, plain_probability(float(x[i] @ w), grade[i], t1, t2))) for i in range(120)) / 120 + l1 * np.abs(w).sum()

    w, t1, t2 = toxicity._fit_active(rows.astype(np.int32), cols.astype(np.int32), 120, 5, grade, l1, 400)
    at = [*w, t1, t2]
    found, step = value(w, t1, t2), 0.05
    while step > 1e-3:  # no step along any coordinate lowers the value
        for i in range(7):
            for d in (-step, step):
                near = list(at)
                near[i] += d
                if near[5] < near[6]:
                    assert value(np.array(near[:5]), near[5], near[6]) >= found - 1e-5
        step /= 3


def test_scores_against_plain_sums(tox):
    d, _, _, model = tox
    for r in toxicity.score_texts(d, model).limit(200).collect():
        s = sum(model.words.get(toxicity.word_hash(w), 0.0) for w in {w.strip(toxicity.STRIP) for w in r.text.lower().split()})
        expected = sum(k * plain_probability(s, k, model.t1, model.t2) for k in range(3))
        assert r["__toxicity"].expected_severity == pytest.approx(expected) and r["__toxicity"].toxic == (expected > model.cut)


# --- near duplicates ---------------------------------------------------------


def shingles(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows, percent):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            both = len(s & u)
            if s and u and a != b and 100 * both >= percent * (len(s) + len(u) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d, _ in sets}


def near_rows(seed):
    rng = np.random.default_rng(seed)
    rows = [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE\ttwo"), (905, "one two three"), (None, "one two"), (906, "long " * 9000), (906, "long " * 9000)]
    ident = 0
    for size in (1, 1, 2, 3, 12, 60):
        for _ in range(3):
            base = [f"v{k}" for k in rng.integers(0, 3000, rng.integers(20, 200))]
            for _ in range(size):
                words = list(base)
                for _ in range(rng.integers(0, max(1, len(words) // 30) + 1)):
                    words[rng.integers(0, len(words))] = f"x{rng.integers(0, 3000)}"
                rows.append((ident * 7 % 5003, " ".join(words)))
                ident += 1
    chain = [f"c{k}" for k in range(100)]
    for i in range(10):  # each near the one before it, the ends far apart
        rows.append((2000 + i, " ".join(chain[i * 3 :] + [f"e{k}" for k in range(i * 3)])))
    return rows


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80)])
def test_near_groups(spark, seed, percent):
    rows = near_rows(seed)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, node int").repartition(6)
    got = near_dedup.near_groups(docs, percent=percent).collect()
    assert len(got) == len(rows)
    want = brute_groups(rows, percent)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    sizes = {}
    for d, t in rows:
        sizes.setdefault(d, set()).add(len(shingles(t)))
    assert all(r.n_shingles in sizes[r.doc_id] and r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    left = near_dedup.drop_near(docs, percent=percent)
    assert left.columns == docs.columns
    assert sorted({r.doc_id for r in left.collect() if r.doc_id is not None}) == sorted(set(want.values()))


def test_near_groups_of_nothing(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_open_hub_lists_go_on_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "DIRECT_TESTS", 0)
    rows = near_rows(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_groups(docs, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute_groups(rows, 85)


def recombined(seed):
    """Long documents of many shared passages, and near copies of two passages each."""
    rng = np.random.default_rng(seed)
    passages = [[f"p{i}w{k}" for k in range(60)] for i in range(16)]
    rows = [(1000 + i, " ".join(w for j in rng.permutation(16)[:8] for w in passages[j])) for i in range(60)]
    for i in range(30):
        a, b = rng.permutation(16)[:2]
        words = passages[a] + passages[b]
        near = list(words)
        near[rng.integers(0, len(near))] = f"y{i}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
    return rows


@pytest.mark.parametrize(("seed", "tests"), [(2, 0)])
def test_copies_far_from_every_hub(spark, monkeypatch, seed, tests):
    if tests is not None:
        monkeypatch.setattr(near_dedup, "DIRECT_TESTS", tests)
        monkeypatch.setattr(near_dedup, "PART_TESTS", 50, raising=False)
    rows = recombined(seed)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_groups(rows, 85)


def mixtures(seed):
    """Texts mixed from 14 passages, each with a twin of one other word."""
    rng = np.random.default_rng(seed)
    passages = [[f"p{i}w{k}" for k in range(40)] for i in range(14)]
    rows = []
    for i in range(60):
        words = [w for j in rng.permutation(14)[: rng.integers(2, 5)] for w in passages[j]]
        twin = list(words)
        twin[rng.integers(0, len(twin))] = f"z{i}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(twin))]
    return rows


def twins_with_foreign_hubs():
    """Twin pairs of three passages, and for each passage texts that hold it alone among their own."""
    passages = {(i, j): [f"t{i}p{j}w{k}" for k in range(30)] for i in range(8) for j in range(3)}
    rows = []
    for i in range(8):
        words = [w for j in range(3) for w in passages[i, j]]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join([*words[:-1], "other"]))]
        for j in range(3):
            rows += [(1000 + 100 * i + 10 * j + n, " ".join(passages[i, j] + [f"h{i}{j}{n}w{k}" for k in range(20)])) for n in range(4)]
    return rows


@pytest.mark.parametrize(("rows", "tests"), [(mixtures(11), 50_000_000), (mixtures(12), 0), (twins_with_foreign_hubs(), 50_000_000)], ids=["mixed", "mixed in rounds", "foreign hubs"])
def test_no_twin_is_missed(spark, monkeypatch, rows, tests):
    monkeypatch.setattr(near_dedup, "DIRECT_TESTS", tests)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_groups(rows, 85)


def one_passage(seed, n):
    """Texts over half of which is one passage, the rest their own; every tenth has a twin of one other word."""
    rng = np.random.default_rng(seed)
    passage, rows = [f"p{k}" for k in range(60)], []
    for i in range(n):
        words = passage + [f"o{i}w{k}" for k in range(rng.integers(42, 50))]
        rows.append((10 * i, " ".join(words)))
        if i % 10 == 0:
            rows.append((10 * i + 1, " ".join([*words[:-9], f"t{i}", *words[-8:]])))
    return rows


def test_a_passage_of_many_documents_gives_no_pairs(spark, monkeypatch):
    compared, links = [], near_dedup._links

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return links(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_links", counted)
    rows = one_passage(5, 200)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    want = brute_groups(rows, 80)
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) == 200
    assert sum(compared) < 4 * len(rows)  # 24,090 pairs of these texts have the passage in common


def test_connected(spark):
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [tuple(map(int, e)) for e in rng.integers(200, 300, (60, 2))] + [(7, 7), (400, 400)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(root) and {r.node: r.comp for r in got} == {x: find(x) for x in root}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# --- media -------------------------------------------------------------------


def test_text_media(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, "", "ü" * 100_000])], "doc_id long, text string, feature string")
    got = {r.doc_id: (r.text, r["__media"]) for r in media.text_media(docs).collect()}
    assert len(got) == len(TEXTS) + 2
    for text, m in got.values():
        data = (text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (m.n_bytes, m.payload_bytes, m.payload_sha256, m.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[0][1] == got[1][1] == got[len(TEXTS)][1]
    assert media.text_media(docs.limit(0)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.binary(min_size=1, max_size=2000), st.booleans())
def test_payload_round_trip(data, chroma):
    payload = media.padded(data)[1]
    reader = media.ProgressiveReader(media.write_payload(payload, chroma))
    assert media.read_payload(reader, len(payload)) == payload
    assert reader.rgb().shape == (reader.height, reader.width, 3)
    with pytest.raises(ValueError):
        media.ProgressiveReader(media.write_payload(payload)[: len(payload) // 2 + 20])


def plain_inverse(coef):
    """The inverse transform by its definition."""
    out = np.zeros((8, 8))
    grid = np.zeros(64)
    grid[media.ZIGZAG] = coef
    grid = grid.reshape(8, 8)
    for x in range(8):
        for y in range(8):
            for u in range(8):
                for v in range(8):
                    cu, cv = (1 / math.sqrt(2) if k == 0 else 1 for k in (u, v))
                    out[y, x] += cu * cv * grid[v, u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) / 4
    return out + 128


def test_inverse_transform_and_grey():
    payload = bytes(np.random.default_rng(4).integers(0, 256, 64, dtype=np.uint8))
    reader = media.ProgressiveReader(media.write_payload(payload))
    want = plain_inverse(np.frombuffer(payload, np.uint8).astype(float) + 256)
    assert np.allclose(reader.planes()[0], want, atol=0.05)
    assert (reader.rgb()[:, :, 0] == np.clip(np.rint(reader.planes()[0]), 0, 255)).all()


def foreign_file(spark, rgb, quality=0.85):
    """A progressive file by the JVM's own image library, and what that library reads back from it."""
    j = spark._jvm
    h, w, _ = rgb.shape
    picture = j.java.awt.image.BufferedImage(w, h, 1)
    pixels = spark.sparkContext._gateway.new_array(j.int, h * w)
    for i, p in enumerate((rgb.astype(int) @ [1 << 16, 1 << 8, 1]).ravel().tolist()):
        pixels[i] = p
    picture.setRGB(0, 0, w, h, pixels, 0, w)
    writer = j.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(1), how.setCompressionMode(2), how.setCompressionQuality(quality)
    held = j.java.io.ByteArrayOutputStream()
    stream = j.javax.imageio.ImageIO.createImageOutputStream(held)
    writer.setOutput(stream), writer.write(None, j.javax.imageio.IIOImage(picture, None, None), how), stream.close()
    data = bytes(held.toByteArray())
    back = j.javax.imageio.ImageIO.read(j.java.io.ByteArrayInputStream(data))
    read = np.array(list(back.getRGB(0, 0, w, h, None, 0, w)), np.int64) & 0xFFFFFF
    return data, np.stack([read >> 16, read >> 8 & 255, read & 255], axis=-1).reshape(h, w, 3)


@pytest.mark.parametrize(("height", "width", "noise", "quality"), [(45, 61, 40, 0.9), (16, 16, 0, 0.5), (1, 1, 0, 0.8), (33, 8, 120, 0.95)])
def test_foreign_progressive_files(spark, height, width, noise, quality):
    y, x = np.mgrid[0:height, 0:width]
    rgb = np.stack([4 * x, 5 * y, 2 * (x + y)], axis=-1) + np.random.default_rng(8).integers(0, noise + 1, (height, width, 3))
    data, want = foreign_file(spark, rgb.clip(0, 255).astype(np.uint8), quality)
    heads = [i for i in range(len(data) - 1) if data[i] == 0xFF and data[i + 1] == 0xDA]
    assert b"\xff\xc2" in data and len(heads) == 10  # interleaved DC, spectral selection, refining scans
    reader = media.ProgressiveReader(data)
    assert [(p.h, p.v) for p in reader.parts] == [(2, 2), (1, 1), (1, 1)]
    off = np.abs(reader.rgb().astype(int) - want)
    assert off.max() <= 5 and off.mean() < 0.8
    with pytest.raises(ValueError):
        media.ProgressiveReader(data[: heads[-1]])


def test_text_media_gives_tensors(spark):
    docs = spark.createDataFrame([(1, "a text of some bytes " * 40), (2, None)], "doc_id long, text string")
    for r in media.text_media(docs, tensors=True).collect():
        m = r["__media"]
        reader = media.ProgressiveReader(bytes(m.stored))
        assert len(reader.parts) == 3 and len(m.rgb) == 3 * m.height * m.width and zlib.crc32(m.rgb) == m.rgb_crc32
        assert (np.frombuffer(m.rgb, np.uint8).reshape(m.height, m.width, 3) == reader.rgb()).all()
        assert media.read_payload(reader, m.payload_bytes) == media.padded(r.text)[1]


def test_decode_images(spark):
    files = [media.write_payload(bytes(64 * 5)), media.write_payload(bytes(range(64)) * 3, chroma=True), None]
    table = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "id int, content binary")
    got = [r.tensor for r in media.decode_images(table).orderBy("id").collect()]
    assert [(t.height, t.width) for t in got] == [(8, 40), (8, 24), (0, 0)]
    assert all(len(t.rgb) == 3 * t.height * t.width for t in got)


# --- pipeline ----------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(6)
    words = [f"v{k}" for k in range(4000)]
    docs = []
    for i in range(300):
        text = " ".join(rng.choice(words, 60))
        if i % 10 == 3:
            text += " badword awfulword badword"
        if i % 12 == 5 and i % 10 != 3 and (i - 5) % 10 != 3:  # a copy has its original's label
            text = docs[i - 5][1].split("\n")[0] + " more"
        docs.append((i, text + "\nA line that every document repeats here", "en", f"s{i % 3}" if i % 2 else "hot", len(text), "k", 0.5))
    docs += [(1000, None, None, None, None, None, None), (1001, "", "en", "s1", 0, None, None)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 10 == 3)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "sentence_pieces"]
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < 4:
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/stage{i}")
        now = spark.read.parquet(f"{tmp_path}/stage{i}")
        kept.append(sorted(r.doc_id for r in now.collect()))
    assert all(i % 10 != 3 for i in kept[0]) and len(kept[0]) > 260
    texts = [r.text for r in spark.read.parquet(f"{tmp_path}/stage1").collect()]
    assert sum("every document repeats" in (t or "") for t in texts) == 1
    groups = brute_groups([(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/stage1").collect()], 80)
    assert set(kept[2]) == set(groups.values())
    assert set(kept[3]) <= set(kept[2]) and kept[4] == kept[3]
    enc = pieces.encoder(pieces.Model(PIECES))
    by_id = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/stage3").collect()}
    for r in now.limit(50).collect():
        assert enc.decode(np.frombuffer(r.ids, "<u4")) == (by_id[r.doc_id] or "")
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == kept[4]
