"""Alignment, recompression and the filter audit against brute force, on awkward tables, and the queries against their SQL."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from opplens.llm import align, audit, queries, recompress

DATA = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def paths():
    import public_tokenizers

    return [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def tokens(texts):
    """Whole texts encoded by the libraries, as (id, bytes) of both sides, or None."""
    both = align.Vocabularies(*paths())
    out = []
    for t in texts:
        a, b = both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t)
        a, b = [(k, both.bytes_a[k]) for k in a], [(k, both.bytes_b[k]) for k in b]
        whole = (" " + t).encode()
        out.append((a, b) if t and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None)
    return out


def brute_alignment(texts):
    rows, corpus = [], Counter()
    for found in tokens(texts):
        spans = []
        for side in found or ([], []):
            at, own = 0, []
            for k, x in side:
                own.append((at, at + len(x), k))
                at += len(x)
            spans.append(own)
        links = [(a[2], b[2]) for a in spans[0] for b in spans[1] if a[0] < b[1] and b[0] < a[1]]
        ends = sorted({a[1] for a in spans[0]} & {b[1] for b in spans[1]})
        groups = [";".join("|".join(",".join(str(x[2]) for x in side if lo < x[1] <= hi) for side in spans) for lo, hi in zip([0, *ends], ends))]
        corpus.update(links)
        rows.append((len(spans[0]), len(spans[1]), len(ends), links, hashlib.sha256(groups[0].encode()).hexdigest() if ends else ""))
    most = defaultdict(int)
    for (_, b), n in corpus.items():
        most[b] = max(most[b], n)
    return [(a, b, g, len(links), sum(corpus[x] == most[x[1]] for x in links), sum(corpus[x] for x in links), sha) for a, b, g, links, sha in rows]


ODD = ["", "a  b", "  lead", "tail  ", "\n\nx\ty  z", "<s> hi </s> <unk>", "<|endoftext|> x", "don't stop we'll", "　wide space", "é ﬁ ½", "\x1c a\x1fb", "a\x00b", "12345 678", " ", ".", "日本語 テキスト", "🙂 🙃🙂", "▁ odd ▁x", "a b", "same text", "same text"]
ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("looked_up", [10**6, 0])
def test_alignment_is_that_of_all_overlaps(spark, looked_up):
    texts = [*ODD, *(r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 1500").orderBy("doc_id").limit(40).collect())]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (3, texts[3])], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, *(r[c] for c in ALIGNED)) for r in align.align(docs, *paths(), keep=["doc_id"], looked_up=looked_up).collect())
    want = brute_alignment([*texts, "", texts[3]])
    assert got == sorted(zip([*range(len(texts)), 900, 3], *zip(*want)))


def test_alignment_carries_open_groups_over_blocks(spark, monkeypatch):
    """A long text in many blocks of events, one of them a word of 30,000 letters."""
    rng = np.random.default_rng(3)
    text = " ".join("".join(rng.choice(list("abcdeé日"), int(rng.integers(1, 12)))) for _ in range(9000)) + " " + "x" * 30_000
    both = align.Vocabularies(*paths())
    a, b = both.tokens([text])[0]
    r = align.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), *paths()).first()
    assert len(text.encode()) > 1.3 * align.BLOCK and (r.n_a, r.n_b) == (len(a), len(b))
    ends = [np.cumsum(n[x]) for n, x in zip(both.lengths, (a, b))]
    assert r.n_groups == len(np.intersect1d(*ends)) and r.n_links == len(np.union1d(*ends))
    machine = align.Sweep(both)
    marks = [np.isin(np.arange(1, ends[0][-1] + 1), e) for e in ends]
    for lo in range(0, len(marks[0]), 97):  # other blocks give the same digest
        part = [m[lo : lo + 97] for m in marks]
        machine.take(*part, *[x[m[:lo].sum() : m[: lo + 97].sum()] for x, m in zip((a, b), marks)])
    assert machine.end()[:5] == (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256)


def brute_windows(rows, window):
    words = [SPACE.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1) if d is not None else ():
            g = tuple(w[i : i + window])
            first[g] = min(d, first.get(g, d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("kinds,window", [(2, 13), (5, 13), (40, 5), (3000, 13), (1, 4), (7, 1), (60, 31)])
def test_recompression_finds_every_repeat(spark, kinds, window, monkeypatch):
    """Texts of few and of many words, with copies, shared passages, runs, repeats within a text, ids that several texts have, and nulls."""
    monkeypatch.setattr(recompress, "MANY", 3)
    rng = np.random.default_rng(kinds)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, kinds, n)]
    passages = [draw(int(n)) for n in rng.integers(window, 4 * window, 4)]
    rows = []
    for i in range(60):
        w = draw(int(rng.integers(0, 60)))
        for p in rng.choice(4, int(rng.integers(0, 3))):
            w[len(w) // 2 : len(w) // 2] = passages[p]
        rows.append((int(rng.integers(0, 50)) if i % 9 else None, ["\t", " ", "\n "][i % 3].join(w) + "\x00é" * (i % 2)))
    rows += [(70, rows[5][1]), (2, rows[5][1]), rows[7], rows[7], (71, None), (72, ""), (73, " ".join(["again"] * 50)), (4, " ".join(["again"] * 50)), (74, "x" * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in recompress.remove_repeated_windows(docs, window).collect()), key=str)
    assert got == brute_windows(rows, window)


def test_recompression_beyond_broadcast_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(recompress, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(recompress, "GATHER", 50)
    rng = np.random.default_rng(9)
    long = " ".join(f"w{x}" for x in rng.integers(0, 50_000, 200_000))  # over a megabyte
    cut = " ".join(long.split()[90_000:90_040])
    rows = [(1, long), (2, "before " + cut + " after"), (0, cut[:-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in recompress.remove_repeated_windows(docs).collect()), key=str)
    assert got == brute_windows(rows, 13) and sum(r[2] for r in got) == 39 + 40


def brute_audit(rows, labels):
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = []
    for d, text, source in rows:
        t = text or ""
        w = SPACE.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and least[t] < d}
        docs.append((source or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, shapley = [], Counter()
    for part in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                out.append([part, "".join(order), k + 1, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f])
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_walks_every_order(spark, monkeypatch):
    import opplens.llm.common as common

    monkeypatch.setattr(common, "SALT_ROWS", 5)  # copies are salted
    rng = np.random.default_rng(7)
    texts = [None, "", "a b", "AB cd", "x # y", " ".join(f"w{i}" for i in range(60)), " ".join(["w"] * 70), " ".join(f"w{i}" for i in range(70)) + " $", "É" * 10 + "A", " "]
    rows = [(int(rng.integers(0, 40)) if i % 11 else None, texts[int(rng.integers(0, len(texts)))], [None, "", "s1", "s2"][int(rng.integers(0, 4))]) for i in range(90)]
    rows += [(50, "only clean " + " ".join(f"v{i}" for i in range(60)), "clean"), rows[3], rows[3]]
    labels = [(i, i % 2, i % 3) for i in range(40)] + [(5, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, key string, n string")
    got = audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r[c] for c in AUDIT) for r in got.collect()) == brute_audit(rows, labels)
    empty = audit.audit_filters(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert empty.columns == list(AUDIT) and empty.count() == 0


@pytest.mark.parametrize("run", [lambda d: align.align(d, *paths()), recompress.remove_repeated_windows])
def test_awkward_columns(spark, run, tmp_path):
    names = ["row", "key", "k1", "doc", "tag", "a.b", "N_A", "N_Words", "spans", "pairs"]
    docs = spark.createDataFrame([(i, t, *([f"v{i}"] * len(names))) for i, t in enumerate([None, "", "one two", "one two", "x " * 40])], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    out = run(docs)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    out.write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 5 and sorted(r[0] for r in back.select("`a.b`").collect()) == [f"v{i}" for i in range(5)]
    empty = run(docs.limit(0))
    assert empty.columns == out.columns and empty.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in cur.description)
    names = [c[0] for c in cur.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == columns
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_queries_run_on_whole_tables(spark, name):
    """One row for each document, for queries without SQL."""
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    df = queries.QUERIES[name](spark, DATA)
    ids = [r.doc_id for r in df.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) == n
