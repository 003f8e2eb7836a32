"""The training-data operators against brute force on small tables with nulls, empty and repeated rows, ties and clashing names."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opplens.llm import chat, decontaminate, licences, media, mixing, near, pii, repeats, tokens, toxicity, webp
from opplens.llm.queries import vocabulary

SENTENCE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
TEXTS = [None, "", " ", "one", SENTENCE, SENTENCE, SENTENCE + " phi", "x" * 900, "x" * 900 + "y", "mail a@b.co now a@b.co_c@d.ef", "card 4111 1111 1111 1111 ip 1.2.3.4 300.1.1.1 +49 (30) 1234-5678", "é日本 don't <|endoftext|> 12", "Released under the MIT License.\nfoo"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i else None, t, f"s{i % 3}" if i % 4 else None, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, source string, n_words string")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark, docs):
    items = [("b", SENTENCE.upper()), ("a", "one"), ("c", None), ("d", "")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    for limit in (1 << 20, 600):
        got = Counter(tuple(r) for r in decontaminate.digest(decontaminate.find_contamination(docs, bench, broadcast_limit=limit)).collect())
        want = Counter()
        for r in docs.collect():
            w, hit, found = words(r.text), set(), set()
            for g, ids in windows.items():
                for k in range(len(w) - len(g) + 1):
                    if tuple(w[k : k + len(g)]) == g:
                        hit |= set(range(k, k + len(g)))
                        found |= ids
            want[(r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
        assert got == want
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


def test_mixing(docs):
    rows = mixing.mix_sources(docs, keep=["doc_id", "source"]).collect()
    assert len(rows) == docs.count() and all(0 <= r.copies <= 3 for r in rows)
    total = sum(r.size for r in rows)
    targets = {r.source: r.target for r in rows}
    assert abs(sum(targets.values()) - total) < 1e-6
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def base_spans(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if (kind == "email" or kind == "ip" and all(int(x) < 256 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn or kind == "phone" and 9 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark, docs):
    extra = spark.createDataFrame([(90, "é" * 3 + "a@b.c@d.e x@y.z-", None, None), (91, "1" * 5000, None, None), (92, "+1 2+3 " * 50, None, None)], docs.schema)
    found = pii.sanitise(docs.unionByName(extra))
    for r in found.collect():
        assert [(s.kind, s.start, s.end) for s in r.base] == base_spans(r.text)
    told = spark.createDataFrame([(i, f"{w} filler{i} words{i} Zorro writes to secret@corp.example about thing{i}") for i, w in enumerate(["red", "blue", "green", "grey"])] + [(i, "red blue green grey writes about to") for i in range(10, 80)], "doc_id long, text string")
    by = {r.doc_id: r for r in pii.redact(pii.sanitise(told)).collect()}
    assert "[TERM]" in by[0].text and "secret@" not in by[0].text and "Zorro" not in by[0].text and by[10].text == "red blue green grey writes about to"


def test_pii_single_mention(spark):
    far = "common words follow here " * 10
    rows = [(0, f"Zebulon writes to once@corp.example about common things. {far}and Zebulon again"), (0, "copy")] + [(i, far + "writes about common things") for i in range(1, 60)]
    rows += [rows[0]] * 3  # copies do not make the term a common one
    got = {r.text for r in pii.redact(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"))).where("doc_id = 0").collect()}
    one = next(t for t in got if t != "copy")
    assert "Zebulon" not in one and "once@" not in one and one.endswith("and [TERM] again") and "common things" in one


def test_tokens(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    rng = np.random.default_rng(0)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(list(" '\n\trelstvdmnAB12,.!é日"), 50)) for _ in range(500)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.count_block([t.encode() for t in texts], vocabulary()).tolist() == want
    assert tokens.count_tokens(docs, vocabulary()).count() == docs.count()


def test_media(docs):
    for t in (b"", b"a", bytes(range(256)) * 9, b"z" * 9000):
        assert media.pixels_of(media.to_media(media.to_payload(t))).tobytes() == media.to_payload(t)
    stored = media.store_media(docs, keep=["doc_id", "text"])
    for r in media.read_media(stored).collect():
        payload = media.to_payload((r.text or "").encode())
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.payload_bytes == len(payload)


def literal_file(transforms, pixels, cache_bits=0, cached=()):
    """A file with every pixel literal, but for those in cached, which are read from the colour cache."""
    out = webp.Writer()
    h, w = pixels.shape
    for v, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (0, 4)):
        out.put(v, n)

    def image(px, main):
        flat = px.reshape(-1).tolist()
        use = main and cache_bits
        out.put(1 if use else 0, 1)
        if use:
            out.put(cache_bits, 4)
        if main:
            out.put(0, 1)
        slot = lambda v: 280 + ((v * webp.CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits))
        green = [slot(v) if use and i in cached else v >> 8 & 255 for i, v in enumerate(flat)]
        lits = [v for i, v in enumerate(flat) if not (use and i in cached)]
        lens = [webp.code_lengths(np.bincount(green, minlength=280 + (1 << cache_bits if use else 0)))] + [webp.code_lengths(np.bincount([v >> s & 255 for v in lits], minlength=256)) for s in (16, 0, 24)]
        for x in lens:
            webp.put_code(out, x)
        far = np.zeros(40, np.int64)
        far[0] = 1
        webp.put_code(out, far)
        codes = [webp.canonical(x) for x in lens]
        put = lambda k, s: out.put(int(codes[k][s]), int(lens[k][s])) if np.count_nonzero(lens[k]) > 1 else None
        for i, v in enumerate(flat):
            put(0, green[i])
            if green[i] < 256:
                for k, s in ((1, 16), (2, 0), (3, 24)):
                    put(k, v >> s & 255)

    for kind, tile, data in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if data is not None:
            out.put(tile - 2, 3)
            image(data, False)
    out.put(0, 1)
    image(pixels, True)
    return webp.container(out.pack())


@pytest.mark.parametrize("mode", range(14))
def test_webp_transforms_and_cache(mode):
    rng = np.random.default_rng(mode)
    want = rng.integers(0, 1 << 32, (9, 13), dtype=np.uint32)
    want[4, 5] = want[4, 4]
    factors = rng.integers(0, 1 << 24, (3, 4), dtype=np.uint32) | np.uint32(0xFF000000)
    modes = np.full((3, 4), 0xFF000000 | mode << 8, np.uint32)
    # forward: cross-colour first, then the predictor on its result; each inverse is checked against this plain form
    s8 = lambda v: v - 256 if v > 127 else v
    crossed = want.copy()
    for y in range(9):
        for x in range(13):
            v, f = int(want[y, x]), int(factors[y >> 2, x >> 2])
            g, r, b = s8(v >> 8 & 255), v >> 16 & 255, v & 255
            b -= (s8(f >> 8 & 255) * g >> 5) + (s8(f >> 16 & 255) * s8(r) >> 5)
            r -= s8(f & 255) * g >> 5
            crossed[y, x] = v & 0xFF00FF00 | (r & 255) << 16 | b & 255
    residual = crossed.copy()
    for y in range(9):
        for x in range(13):
            at = lambda j, i: int(crossed[j, i])
            guess = 0xFF000000 if not (x or y) else at(0, x - 1) if not y else at(y - 1, 0) if not x else webp.predict(mode, at(y, x - 1), at(y - 1, x), at(y - 1, x + 1) if x < 12 else at(y, 0), at(y - 1, x - 1))
            residual[y, x] = sum(((int(crossed[y, x]) >> s) - (guess >> s) & 255) << s for s in (0, 8, 16, 24))
    file = literal_file([(webp.CROSS_COLOUR, 2, factors), (webp.PREDICTOR, 2, modes)], residual)
    assert np.array_equal(webp.decode(file), want)
    assert np.array_equal(webp.decode(literal_file([], want, 6, {4 * 13 + 5})), want)


def test_licences(docs):
    model = licences.train(docs)
    by = {r.doc_id: [x.family for x in r.licences] for r in licences.scan(docs, model).collect()}
    assert by[12] == ["mit"] and not by[4] and not by[1]


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "<|im_end|> <\\| </s>[INST]"), (1, 2, "assistant", None), (1, 3, "assistant", "\\<<SYS>> ok <"), (2, 0, None, ""), (None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for c in (1, 2, None):
        want = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert [tuple(t) for t in read[c].turns] == want
        assert list(read[c].loss_texts) == [t for role, t in want if role == "assistant"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_near_duplicates(spark, docs):
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    base = [list(rng.choice(vocab, 200)) for _ in range(40)]
    texts, owner = [], []
    for i, b in enumerate(base):
        for _ in range(i % 4 + 1):
            c = list(b)
            for k in rng.integers(0, 200, 3):
                c[k] = "edited"
            texts.append(" ".join(c))
            owner.append(i)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near.classify(df).collect()}
    assert got == {i: owner.index(o) for i, o in enumerate(owner)}
    assert near.keep_one(df).count() == 40
    kept = near.keep_one(docs)
    assert kept.where(F.col("text") == SENTENCE).count() == 1
    assert near.classify(docs.limit(0)).count() == 0


def brute_classes(texts, least=0.8):
    """The least number of the class of each text, by aligning all pairs."""
    ids = {}
    each = [np.asarray([ids.setdefault(w, len(ids)) for w in words(t)], np.uint64) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    counts = [Counter(e.tolist()) for e in each]
    for i in range(len(texts)):
        for j in range(i):
            longer = max(len(each[i]), len(each[j]))
            if min(len(each[i]), len(each[j])) < least * longer or (counts[i] & counts[j]).total() < least * longer - 1e-9:
                continue
            if near.similarity_of(each[i], each[j], least) is not None:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


def test_near_pairs_beside_many_false_candidates(spark):
    rng = np.random.default_rng(11)
    own = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    common, texts = own(90), []
    for _ in range(300):  # all share two thirds, which makes them candidates; 45 words in 135 differ, so none are alike
        texts.append(" ".join(common + own(45)))
    for k in range(3):  # few pairs that are alike
        texts.append(" ".join(texts[k].split()[:-4] + own(4)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: i - 300 if i >= 300 else i for i in range(303)}
    assert {r.doc_id: r.class_id for r in near.classify(df).collect()} == want


def test_near_members_of_two_families(spark):
    rng = np.random.default_rng(12)
    own = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    boilerplate, texts = own(40), []
    for _ in range(8):  # each text is like the one before and after it only, so it belongs to the families of both
        t = boilerplate + own(160)
        for step in range(6):
            t = t[: 40 + 26 * step] + own(26) + t[66 + 26 * step :]
            texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near.classify(df).collect()} == brute_classes(texts)


def test_edit_distance():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 5, rng.integers(1, 30)).astype(np.uint64)
        b = rng.integers(0, 5, rng.integers(1, 30)).astype(np.uint64)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a.tolist(), 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b.tolist(), 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        for most in (40, row[-1], row[-1] - 1):
            want = row[-1] if row[-1] <= most else None
            assert near.band_distance(a.tolist(), b.tolist(), most) == want if most >= 0 else True
            assert near.edit_distance(a, b, most) == want
    long = rng.integers(0, 1 << 60, 900).astype(np.uint64)
    other = long.copy()
    other[rng.choice(900, 100, replace=False)] = 1
    assert near.edit_distance(long, other, 180) == 100 and near.edit_distance(long, other, 99) is None


def test_near_recall_over_all_pairs(spark):
    """All pairs of a given table held against the alignment of each pair: 0.9 of the pairs at least, and no pair of unlike texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = sorted({r.text or "" for r in docs.collect()})
    want = brute_classes(texts)
    got = {t or "": c for t, c in near.classify(docs).join(docs, "doc_id").select("text", "class_id").collect()}
    mine: dict[int, set[int]] = {}
    for i, t in enumerate(texts):
        mine.setdefault(got[t], set()).add(want[i])
    assert all(len(roots) == 1 for roots in mine.values())
    assert len(mine) - len(set(want.values())) <= 0.1 * (len(texts) - len(set(want.values())))


@pytest.mark.parametrize("heavy", [50_000, 2])
def test_repeats(docs, monkeypatch, heavy):
    monkeypatch.setattr(repeats, "HEAVY", heavy)  # with 2, nearly every digit is dealt to several tasks
    rows = repeats.remove_repeats(docs, 40).collect()
    texts = [(r.text or "").encode() for r in rows]
    seen = Counter(t[i : i + 40] for t in texts for i in range(len(t) - 39))
    for r, t in zip(rows, texts):
        gone = {j for i in range(len(t) - 39) if seen[t[i : i + 40]] > 1 for j in range(i, i + 40)}
        assert bytes(r.kept) == bytes(c for j, c in enumerate(t) if j not in gone) and r.n_removed == len(gone)


def test_repeats_of_400_bytes_on_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = repeats.remove_repeats(docs, 400).collect()
    texts = [(r.text or "").encode() for r in rows]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        assert bytes(r.kept) == bytes(np.frombuffer(t, np.uint8)[~gone]) and r.n_removed == gone.sum() and r.n_spans == (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(600):
        w, toxic = list(rng.choice(vocab, 60)), int(i % 5 == 0)
        if toxic:
            w[30], w[32] = "idiot", "moron"
        rows.append((i, " ".join(w), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), may_learn=F.col("doc_id") < 400)
    out = toxicity.score(df, model).where("doc_id >= 400").collect()
    assert all(r.predicted == r.toxic for r in out)
    assert toxicity.segments([(2, 5.0), (4, 4.0), (90, 3.0)], 100, -0.1) == [(2, 5, pytest.approx(8.9)), (90, 91, pytest.approx(3.0))]
    empty = toxicity.fit(df.limit(0).select("doc_id", "text"), df.limit(0).select("doc_id", "toxic"))
    assert toxicity.score(df.limit(3), empty).count() == 3
