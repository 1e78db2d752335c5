"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

import public_tokenizers
from pyspark.sql import functions as F
from weftline.llm import common, decontaminate, fingerprint, jaccard_join, kd_sharding, line_dedup, sentencepiece_codec, token_counts, token_files, toxicity, warc
from weftline.operators import spread

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
PLAIN = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _texts():
    r = np.random.default_rng(11)
    base = [" ".join(r.choice(WORDS, r.integers(1, 60))) for _ in range(40)]
    out = list(base)
    for t in base[:12]:  # near and exact copies
        w = t.split()
        w[len(w) // 2] = "changed"
        out += [t, " ".join(w), t.upper().replace(" ", "  \n")]
    return out + [None, "", " \n ", "one", "one", " ".join(WORDS * 400), "Straße\n" + base[0] + "\nStraße"]


@pytest.fixture(scope="module")
def docs(spark):
    t = _texts()
    rows = [(i * 7 % 1000, x, "en" if i % 3 else None, "s", i, "clash") for i, x in enumerate(t)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string").repartition(3)


@pytest.fixture(scope="module")
def pdf(docs):
    return docs.toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def _shingles(t):
    w = [x for x in re.split("[ \t-\r]+", (t or "").translate(PLAIN)) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_join(docs, pdf, empty):
    sets = {i: _shingles(t) for i, t in zip(pdf.doc_id, pdf.text)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {i: (len(sets[i]), find(i)) for i in ids}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()}
    assert got == want
    kept = {r.doc_id for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {i for i in ids if find(i) == i}
    assert jaccard_join.join(empty).count() == 0


def _components(rows, percent=80):
    """(n_shingles, component) of each (id, text) by all pairs."""
    sets = {i: _shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_join_of_long_lists(spark, monkeypatch):
    """Lists in parts and by length groups, leaders with many followers, and no table or folder left behind."""
    monkeypatch.setattr(jaccard_join, "LIST_PART", 3)
    monkeypatch.setattr(jaccard_join, "SPREAD", 2)
    monkeypatch.setattr(jaccard_join, "MOST_FREQUENT", 20)
    monkeypatch.setattr(jaccard_join, "HARMLESS", 1)
    monkeypatch.setattr(spread, "HEAVY_KEYS", 2)
    r = np.random.default_rng(7)
    base = list(r.choice(WORDS, 120))
    rows = []
    for i in range(90):  # parts of one text of all lengths, with changed words; neighbours are similar, ends are not
        n = int(r.integers(20, 120))
        a = int(r.integers(0, 121 - n))
        w = list(base[a : a + n])
        for k in r.choice(n, i % 3):
            w[k] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(200, ""), (201, None), (202, "")]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = _components(rows)
    assert len({c for _, c in want.values()}) > 5
    out = jaccard_join.join(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == want
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("weftline_sets")]


def test_jaccard_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 4)
    r = np.random.default_rng(2)
    base, rows = list(r.choice(WORDS, 80)), [(None, "alpha beta"), (900, ""), (901, None), (902, "alone"), (903, "alpha beta"), (903, "alpha beta")]
    for i in range(30):  # near copies of one text, each of a few others; some twice
        w = list(base)
        for k in r.choice(80, i % 4):
            w[k] = f"x{i}"
        rows += [(i, " ".join(w))] + [(100 + i, " ".join(w).upper())] * (i % 5 == 0)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [_shingles(t) if i is not None else frozenset() for i, t in rows]
    links = [sum(j != k and len(a & b) * 100 >= 80 * len(a | b) > 0 for k, b in enumerate(sets)) for j, a in enumerate(sets)]
    got = collections.Counter((r.doc_id, r.n_links) for r in jaccard_join.join(docs, links=True).collect())
    assert got == collections.Counter((i, n) for (i, _), n in zip(rows, links))
    assert len(set(links)) > 5


def test_jaccard_join_of_repeated_keys(spark):
    r = np.random.default_rng(6)
    a, b = (" ".join(r.choice(WORDS, 40)) for _ in range(2))
    rows = [(5, a), (5, b), (6, f"{a} more"), (7, f"{b} more"), (8, a), (8, b)]
    work = jaccard_join.SimilarityJoin(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", 5, 80)
    texts = collections.defaultdict(set)
    for x in work.table.collect():
        texts[x.sid].add(x.text)
    work.close()
    assert sorted(map(sorted, texts.values())) == sorted([t] for t in {t for _, t in rows})


def _items(spark):
    r = np.random.default_rng(4)
    rows = [(i, " ".join(r.choice(WORDS, n))) for i, n in enumerate([3, 1, 12, 15, 20])] + [(7, None), (8, "..."), (None, "alpha"), (2, "mu nu")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_decontamination(spark, docs, pdf, empty):
    items = _items(spark)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for r in items.collect():
        w = word.findall((r.text or "").translate(PLAIN))
        if r.item_id is not None and w:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(str(r.item_id))
    got = {r.doc_id: r for r in decontaminate.digest(decontaminate.scan(docs, items)).collect()}
    for i, t in zip(pdf.doc_id, pdf.text):
        w = word.findall((t or "").translate(PLAIN))
        hit, found = set(), set()
        for win, own in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= own
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(found), sha, bool(hit))
    clean = decontaminate.remove(docs, items)
    assert clean.columns == docs.columns
    assert decontaminate.scan(clean, items).where("n_hit > 0").count() == 0
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in clean.collect()}
    assert all(after[i] == before[i] for i in before if not got[i].contaminated)
    assert decontaminate.scan(empty, items).count() == 0
    assert decontaminate.scan(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    items = _items(spark)
    whole = {r.doc_id: r for r in decontaminate.digest(decontaminate.scan(docs, items)).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert {r.doc_id: r for r in decontaminate.digest(decontaminate.scan(docs, items)).collect()} == whole


def test_removal_in_blocks(spark, monkeypatch):
    w = [f"word{i}" for i in range(60)]
    run = lambda a, b: " ".join(w[a:b])
    # Windows that overlap in a document, and one that comes together only when others have been cut out of it.
    items = spark.createDataFrame([(i, run(a, a + 10)) for i, a in enumerate([0, 5, 10, 20, 25, 40])], "item_id bigint, text string")
    texts = [run(0, 20), run(18, 37), f"{run(20, 25)} {run(40, 50)} {run(25, 30)} rest", f"{run(40, 45)} {run(0, 15)} {run(45, 50)} rest", f"{run(0, 5)} {run(20, 35)} {run(5, 10)} rest", "rest", "", None, run(0, 10)]
    docs = spark.createDataFrame([(i, t, -1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint, __flags string")
    rows = lambda: sorted(decontaminate.remove(docs, items).collect())
    whole = rows()
    assert [r.text and r.text.split() for r in whole] == [w[18:20] + w[35:37], ["rest"], ["rest"], ["rest"], ["rest"], "", None]
    for size, blocks in ((20, 6), (150, 3)):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert sum(map(bool, decontaminate._blocks(items, "item_id", "text"))) == blocks
        assert rows() == whole


def test_phrases_are_flat():
    """A block of the greatest size: what goes to the tasks and what the driver holds on the way are bounded."""
    import pickle
    import tracemalloc

    r = np.random.default_rng(1)
    items = [(str(i), " ".join(map(str, r.integers(0, 50_000, 1000)))) for i in range(300)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    phrases = decontaminate.Phrases(items, 10)
    assert tracemalloc.get_traced_memory()[1] < 60 * size
    tracemalloc.stop()
    assert len(pickle.dumps(phrases)) < 6 * size and len(phrases.groups[0][1]) == 300 * 991


def test_decontamination_edges(spark):
    """Repeated and null keys, a very long text, clashing names; every row comes back."""
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(1, passage), (1, passage), (1, None), (None, f"x {passage} y"), (2, "word " * 300_000 + passage + " tail"), (3, ""), (4, "..."), (5, passage.upper().replace(" ", "--"))]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string")).withColumn("text2", F.lit("x")).withColumn("items", F.lit("x")).withColumn("flags", F.lit("x"))
    items = spark.createDataFrame([(9, passage), (9, passage), (10, passage)], "item_id bigint, text string")
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.scan(docs, items).collect())
    both = ("10", "9")
    assert got == collections.Counter([(1, 12, 12, both)] * 2 + [(1, 0, 0, ()), (None, 14, 12, both), (2, 300_013, 12, both), (3, 0, 0, ()), (4, 0, 0, ()), (5, 12, 12, both)])
    clean = decontaminate.remove(docs, items)
    assert clean.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "none")[-7:].strip()) for r in clean.collect()) == [("1", "none"), ("2", "d  tail"), ("3", "none"), ("4", "..."), ("None", "x  y")]


def _kd_tree(rows, shards):
    """Shard of each (id, text, labels...) row by sorting every node whole."""
    code = lambda x: int((x.encode().hex() + "0" * 8)[:8], 16) * 16 + signed(x) % 16
    signed = lambda x: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64(x, seed=42).intdigest())
    points, groups = [], collections.defaultdict(list)
    for i, t, *labels in rows:
        groups[t or ""].append([code(x or "") for x in labels])
    size = lambda t: len(t.encode()) + 1
    total = sum(size(t) * len(g) for t, g in groups.items())
    for i, t, *_ in rows:
        t = t or ""
        assert size(t) * len(groups[t]) <= total / shards or len(groups[t]) == 1
        dims = [len(t), *(min(x) for x in zip(*groups[t]))]
        points.append((i, size(t), dims, (zlib.crc32(t.encode()), xxhash.xxh64(t, seed=42).intdigest() >> 4)))
    spread = lambda ps, d: float(np.std([np.log1p(p[2][d]) for p in ps]))
    root = [spread(points, d) for d in range(len(points[0][2]))]
    out = {}

    def split(ps, first, count):
        if count == 1 or not ps:
            out.update({p[0]: first for p in ps})
            return
        dim = max(range(len(root)), key=lambda d: round(spread(ps, d) / root[d], 9) if root[d] else 0.0)
        place = lambda p: (p[2][dim], p[3])
        left, weights = count // 2, collections.Counter()
        for p in ps:
            weights[place(p)] += p[1]
        target, run = sum(weights.values()) * left / count, 0
        for x in sorted(weights):
            if run + weights[x] >= target:
                break
            run += weights[x]
        low = target - run > run + weights[x] - target
        goes = lambda p: place(p) < x or (low and place(p) == x)
        split([p for p in ps if goes(p)], first, left)
        split([p for p in ps if not goes(p)], first + left, count - left)

    split(points, 0, shards)
    return out


def test_sharding(spark, docs, pdf, empty):
    r = np.random.default_rng(3)
    texts = [" ".join(r.choice(WORDS, r.integers(1, 60))) for _ in range(300)]
    rows = [(i, texts[int(r.integers(0, 300))], str(r.choice(["en", "de", "fr"])), f"s{r.integers(0, 5)}") for i in range(500)] + [(500, None, None, None), (501, "", "en", "x"), (502, "é" * 50, "", "s1")]
    made = clashing(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).repartition(3)
    for shards in (6,):
        out = kd_sharding.shard(made, shards, tolerance=0).toPandas().set_index("doc_id")
        assert out.shard.to_dict() == _kd_tree(rows, shards)
        whole = collections.defaultdict(set)
        for i, t, *_ in rows:
            whole[t].add(out.shard[i])
        assert all(len(x) == 1 for x in whole.values())
        sums = out.groupby("shard")["size"].sum()
        assert len(sums) == shards and sums.max() < 1.1 * sums.min()
    assert kd_sharding.shard(made, target_bytes=int(out["size"].sum()) // 3 + 1).select("shard").distinct().count() == 3

    out = kd_sharding.shard(docs, 4).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert out.doc_id.tolist() == pdf.doc_id.tolist()
    texts = [(t or "").encode() for t in pdf.text]
    assert out["size"].tolist() == [len(t) + 1 for t in texts] and out.text_crc32.tolist() == [zlib.crc32(t) for t in texts]
    for _, g in out.groupby("shard"):
        assert g.sort_values("doc_id").slot.tolist() == list(range(len(g)))
    assert kd_sharding.shard(empty, 4).count() == 0


def test_sharding_of_a_group_that_outweighs_a_shard(spark):
    """Its copies are cut; null and repeated keys each have a slot."""
    rows = [(i, "the same text " * 5) for i in range(200)] + [(1000 + i, f"text {i} of its own " * 3) for i in range(200)] + [(None, "x"), (None, "x"), (7, "y")]
    out = kd_sharding.shard(clashing(spark.createDataFrame(rows, "doc_id bigint, text string")), 8).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(out) == len(rows) and len(sums) == 8 and sums.max() < 1.1 * sums.min()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
        g = g.sort_values("slot")
        assert g.doc_id.isna().tolist() == sorted(g.doc_id.isna(), reverse=True) and g.doc_id.dropna().is_monotonic_increasing


def test_token_files(docs, pdf, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = token_files.round_trip(docs, path).toPandas().sort_values("doc_id").reset_index(drop=True)
    start = 0
    for i, text in enumerate(pdf.text):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got.start[i], got.n_tokens[i], got.ids_crc32[i]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.round_trip(empty, path).count() == 0


def test_fingerprints(docs, pdf, empty):
    got = fingerprint.against_edits(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = [t or "" for t in pdf.text]
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got.n_chars[i] == len(t) and got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, got.near_edited[i]), (nxt, got.near_next[i])):
            a, b = _shingles(t), _shingles(other)
            if len(a | b) < fingerprint.K:
                assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    same = got.assign(t=texts).groupby("t").fingerprint.nunique()
    assert (same == 1).all()
    assert fingerprint.against_edits(empty).count() == 0
    assert fingerprint.fingerprints(docs).count() == len(pdf)


def test_line_dedup(docs, pdf, empty):
    blank = " \t\n\x0b\x0c\r"
    holders = {}
    for i, t in zip(pdf.doc_id, pdf.text):
        for line in (t or "").split("\n"):
            k = line.strip(blank).translate(PLAIN)
            if len(k) >= 10:
                holders.setdefault(k, set()).add(i)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    for i, t in zip(pdf.doc_id, pdf.text):
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(own := holders.get(x.strip(blank).translate(PLAIN), {i})) < 2 or min(own) == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(lines), len(lines) - len(stay), "\n".join(stay))
    assert line_dedup.dedup_lines(empty).count() == 0
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


CLASH = ["id", "pos", "th", "k", "key", "h1", "h2", "n", "line", "lines", "first", "shared", "bucket", "shard", "slot", "size", "crc", "predicted", "start", "root", "sid"]


def clashing(df):
    """With columns that have the names operators use inside."""
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


@pytest.mark.parametrize("heavy", [1, 1000])
def test_line_dedup_edges(spark, monkeypatch, heavy):
    """Null and repeated keys, repeated rows, a line that all rows hold, clashing names; some lines by either way."""
    monkeypatch.setattr(spread, "HEAVY_KEYS", heavy)
    common_line, other = "a line that everybody holds", "a line that some hold"
    rows = [(None, f"{common_line}\nx"), (None, f"{common_line}\nx"), (None, None), (3, ""), (3, f"own line of three\n{common_line}"), (3, f"own line of three\n{other}")]
    rows += [(i, f"{common_line}\n{'  ' * i}{other.upper()}\nline of its own {i}\n{common_line}") for i in range(4, 30)]
    rows += [(-7, other), (30, "own line of three"), (31, "\n".join(["long line number " + str(i) for i in range(20_000)])), (32, "long line number 77"), (32, "long line number 77")]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(3)
    low = lambda i: (i is not None, i or 0)
    holders = collections.defaultdict(set)
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(PLAIN)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[norm(x)].add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(norm(x)) < 10 or len(holders[norm(x)]) < 2 or min(holders[norm(x)], key=low) == i]
        want.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    three = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs, min_docs=3).collect()}
    assert (30, "own line of three") in three and (32, "long line number 77") in three and (-7, other) in three


def test_line_hashes(spark):
    """The second hash is no function of the first: it isn't the first hashed on."""
    rows = spark.createDataFrame([(f"line {i} " * 5,) for i in range(200)], "line string")
    got = rows.select(*line_dedup.line_hashes(F.col("line")), F.xxhash64("line", F.lit(1)).alias("chained")).collect()
    assert all(r.h2 not in (r.h1, r.chained) for r in got) and len({r.h2 for r in got}) == 200


def test_sentencepiece(docs, pdf, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    coded = sentencepiece_codec.encode_decode(docs, path)
    got = {r.doc_id: r for r in coded.collect()}
    for i, t in zip(pdf.doc_id, pdf.text):
        ids = sp.encode(t or "") + [2]
        assert got[i].n_tokens == len(ids) and np.frombuffer(got[i].ids, "<u2").tolist() == ids
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode(coded, path).collect()} == {i: t or "" for i, t in zip(pdf.doc_id, pdf.text)}
    assert sentencepiece_codec.encode_decode(empty, path).count() == 0


def test_token_counts(docs, pdf, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for x in pdf.text]
    hist = token_counts.histogram(token_counts.lengths(docs, path))
    rows = {r.n_tokens: r for r in token_counts.answers(hist).collect()}
    assert {k: r.docs for k, r in rows.items()} == dict(collections.Counter(n))
    for k, r in rows.items():
        assert (r.docs_within, r.longer_docs, r.ids_cut_at, r.ids_lost) == (sum(x <= k for x in n), sum(x > k for x in n), sum(min(x, k) for x in n), sum(max(0, x - k) for x in n))
    for r in token_counts.at_limits(hist, [0, 5, 10**6]).collect():
        k = r.context_limit
        assert (r.docs_within, r.longer_docs, r.ids_cut_at) == (sum(x <= k for x in n), sum(x > k for x in n), sum(min(x, k) for x in n))
    assert token_counts.quantile(token_counts.answers(hist), 0.5).first().length == sorted(n)[-(-len(n) // 2) - 1]
    assert token_counts.histogram(token_counts.lengths(empty, path)).count() == 0


def test_warc(spark, tmp_path, monkeypatch):
    import gzip
    import pathlib

    monkeypatch.setattr(spread, "HEAVY_KEYS", 1)
    big, other = "<p>" + "x" * 1200, "<q>" + "é" * 700
    rows = [(1, "http://www.a.org/x y", big), (2, "http://a.org/", "small"), (3, "http://b.org/é", big), (4, None, None), (5, "http://a.org/", "small"), (9, "http://a.org/", big), (9, "http://a.org/", big), (12, "nourl", "é\r\n\r\nWARC/1.1\r\n")]
    rows += [(5 * 10**18, "http://c.org/", big), (-(10**18), "http://c.org/", other), (3 * 10**11, "http://c.org/", other), (None, "http://c.org/", big), (20, "http://long.org/", "0123456789" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for c in ("id", "digest", "bytes", "first", "n", "d", "value", "run", "pos", "ts", "revisit"):
        pages = pages.withColumn(c, F.lit("x"))
    path = f"{tmp_path}/warc"
    warc.write_archives(pages.repartition(3), path, archive_bytes=600)
    runs = common.cut(warc.sorted_runs(spark, path), "runs")
    files = {f.name: f.read_bytes() for f in pathlib.Path(path).glob("part-*")}
    assert len(files) > 3
    index = warc.merged(runs, range_rows=4).toPandas()
    top = {big: 5 * 10**18, other: 3 * 10**11}
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    kind = lambda i, h: ("revisit", top[h]) if h in top and i != top[h] else ("response", -1)
    want = collections.Counter((i, len((h or "").encode()), sha(h), *kind(i, h)) for i, _, h in rows)
    none = lambda x, other: other if pd.isna(x) else int(x)
    table = warc.merged(runs).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, none(r.refers_to, -1)) for r in table) == want
    order = [(r.urlkey, r.ts, r.page_id is not None, r.page_id or 0) for r in table]
    assert order == sorted(order) and [tuple(r) for r in table] == [tuple(r) for r in warc.merged(runs, range_rows=4).collect()] and len(index) == len(rows)
    assert all(re.fullmatch(r"(19|20)\d{12}", r.ts) for r in table)
    for r in table:  # a record can be read from its place alone
        one = gzip.decompress(files[r.run][r.offset : r.offset + r.length]).decode()
        assert one.startswith("WARC/1.1\r\n") and f"WARC-Record-ID: <urn:x-page:{'null' if r.page_id is None else r.page_id}>" in one
    whole = next(iter(files.values()))
    assert gzip.decompress(whole).startswith(b"WARC/1.1")
    for damaged in (whole[:-30], whole[:40] + b"x" + whole[41:], b"junk" + whole, gzip.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"), gzip.compress(b"no record")):
        with pytest.raises(ValueError):
            list(warc.parse(damaged))
    assert warc.archive(pages.limit(0)).count() == 0


def test_toxicity(spark):
    r = np.random.default_rng(8)
    docs, labels = [], []
    for i in range(400):
        w = list(r.choice(WORDS, 40))
        bad = i % 8 == 0
        if bad:
            for k in range(3):
                w.insert(int(r.integers(0, 40)), ["grobnik", "grobnika", "vilez"][k])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    d = spark.createDataFrame([*docs, (1000, None), (1001, "")], "doc_id bigint, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = toxicity.score(d, toxicity.learn(d, lab)).toPandas().set_index("doc_id")
    truth = pd.Series({i: t for i, _, t in labels})
    assert (out.predicted[truth.index] == truth).mean() > 0.98
    assert out.score[1000] == out.score[1001] < 0.3 and out.score.between(0, 1).all()


def _patterns(lexicon, text):
    raw = text.encode()
    c = toxicity.Reader(lexicon).counts(raw, np.array([0, len(raw)]))[0]
    return {p: v for p, v in zip(toxicity.PATTERNS, c) if v}


def test_grammar():
    def patterns(text):
        return _patterns(toxicity.Lexicon.seed(), text)

    assert patterns("What a moron.") == {"insult": 1}
    assert patterns("You are a moron.") == {"insult_target": 1}
    assert patterns("Moron, said nobody; a moron like you") == {"insult": 1, "insult_target": 1}
    assert patterns("He is not a moron.") == patterns("He isn't a moron.") == patterns("He isn’t a moron") == {"negated": 1}
    assert patterns("The paper said moron twice, it is true") == {"reported": 1}
    assert patterns('He wrote: "you are scum. You are trash."') == {"reported": 2}
    assert patterns('"You are an idiot," she said.') == patterns("“You are an idiot,” she said.") == {"reported": 1}
    assert patterns("She said hello, you are an idiot") == {"insult_target": 1}
    assert patterns("They will hurt you") == {"threat_target": 1}
    assert patterns("moron\nmoron moron") == {"insult": 1}
    assert patterns("The path was worth a stupendous trashcan idiom") == patterns("Nothing here.") == patterns("") == {}


def test_grammar_by_brute_force():
    """Lines of symbols, one letter each, with up to two quotation marks: every rule written down by itself."""
    letters = "oitTnR,:\"."  # in the order of the symbols' numbers

    def slow(s):
        marks = [k for k, c in enumerate(s) if c == '"']

        def opens(q):
            before = re.split('["]', s[:q])[-1].split(".")[-1]
            return bool(re.search("R[^,R]*(,[on,]*)?$", before)) and not (marks.index(q) == 1 and opens(marks[0]))

        def followed(q):
            return bool(re.match('[^".]*R', s[q + 1 :])) and not (marks.index(q) == 0 and len(marks) == 2 and followed(marks[1]))

        out = []
        for k, c in enumerate(s):
            if c not in "it":
                out.append(None)
                continue
            left, right = re.split('[,:".]', s[:k])[-1], re.split('[,:".]', s[k + 1 :])[0]
            prior, after = [q for q in marks if q < k], [q for q in marks if q > k]
            quoted = (prior and opens(prior[-1])) or (after and followed(after[0]))
            if "n" in left[-3:]:
                out.append("negated")
            elif quoted or re.search("R[^,R]*$", s[:k].split('"')[-1].split(".")[-1]):
                out.append("reported")
            else:
                out.append({"i": "insult", "t": "threat"}[c] + "_target" * ("T" in left + right))
        return out

    r, reader = np.random.default_rng(5), toxicity.Reader(toxicity.Lexicon.seed())
    for _ in range(4000):
        s = "".join(r.choice(list("ooooitTnR,:."), r.integers(1, 24)))
        for _ in range(r.integers(0, 3)):
            k = int(r.integers(0, len(s) + 1))
            s = s[:k] + '"' + s[k:]
        assert reader.read([letters.index(c) for c in s]) == slow(s), s


def test_grammar_decides(spark):
    """Whatever is learned, one targeted insult or threat is toxic; negated and reported ones, and words that only begin
    like an insult, aren't."""
    r = np.random.default_rng(8)
    rows = [(i, " ".join([*r.choice(WORDS, 30), *["moron"] * (i % 5 == 0)])) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    for model in (toxicity.learn(docs, labels), toxicity.learn(docs, labels.limit(0))):
        bad = ["You are pathetic", "I will kill you", "those idiots", "I will shoot you and beat her"]
        good = ["You are not pathetic.", "I will never kill you", "She said you are an idiot", '"You are an idiot," she said.', "The fire may destroy the wood", "The path was worth a stupendous trashcan idiom", "", None]
        d = spark.createDataFrame([(t,) for t in bad + good], "text string").withColumn("doc_id", F.lit(1)).withColumn("predicted", F.lit("x")).withColumn("score", F.lit("x"))
        out = {x.text: x.predicted for x in toxicity.score(d, model, keep=True).collect()}
        assert out == {**{t: 1 for t in bad}, **{t: 0 for t in good}}


def test_toxicity_edges(spark):
    rows = [(1, "You are a moron"), (1, "You are a moron"), (None, "You are a moron"), (2, None), (3, ""), (4, "word, " * 200_000 + "you moron"), (5, "moron " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit(1)).withColumn("y", F.lit(1)).withColumn("h", F.lit(1)).withColumn("key", F.lit(1))
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (None, 1, "x"), (2, None, "x"), (3, 1, "x")], "doc_id bigint, toxic int, text string")
    out = toxicity.score(docs, toxicity.learn(docs, labels)).toPandas()
    assert len(out) == len(rows) and out.doc_id.isna().sum() == 1
    assert out[out.doc_id.isin([2, 3])].score.nunique() == 1 and out.score.between(0, 1).all()
    assert out[~out.doc_id.isin([2, 3, 5])].predicted.eq(1).all()
    for d, lab in ((docs.limit(0), labels), (docs, labels.limit(0)), (docs.limit(0), labels.limit(0))):
        assert toxicity.score(d, toxicity.learn(d, lab)).count() == d.count()
