"""Manifest, divergence and MinHash operators against brute force, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import bayes_minhash, merkle_manifest, source_divergence
from lodestone.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx long, size long, node string, path string, term string, n long, bands string, sig string, component string"
LONG = " ".join(f"word{k % 977}" for k in range(60_000))
ODD = [
    (1, None, "en", "s", 0), (2, "", "en", "s", None), (3, "   \n\t ", None, "s", 0), (4, "one", "en", None, 3), (5, LONG, "en", "s", 0),
    (6, "same text here, again and again", "en", "s", 0), (7, "same text here, again and again", "en", "s", 0), (7, "same text here, again and again", "en", "s", 0),
    (None, "no id at all", "en", "s", 0), (None, "No id at all", "", "", 2**63 - 1), (8, "ünïcode 漢字 🙂 x\x00y", "de", "s", 0),
]


def odd(spark):
    return spark.createDataFrame([(*r, "x", 9, 9, "x", "x", "x", 9, "x", "x", "x") for r in ODD], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(sf):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]


# manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes, fanout):
    """The top of a tree, and of each leaf the (left, right) siblings on its way up."""
    paths, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, up_owners = [], []
        for k in range(0, len(nodes), fanout):
            run = nodes[k : k + fanout]
            for pos in range(len(run)):
                for leaf in owners[k + pos]:
                    paths[leaf].append(("".join(run[:pos]), "".join(run[pos + 1 :])))
            up.append(h(*run))
            up_owners.append([leaf for x in owners[k : k + fanout] for leaf in x])
        nodes, owners = up, up_owners
    return nodes[0], paths


def plain_manifest(rows, fanout=2, every=7):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row, sorted."""
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        members = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees.append((members, *plain_tree([plain_leaf(*r) for r in members], fanout)))
    if not trees:
        return []
    root, tops = plain_tree([t[1] for t in trees], fanout)
    out = []
    for (members, subroot, paths), top in zip(trees, tops):
        for r, path in zip(members, paths):
            path = path + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % every == 0 and r[4] is not None
            node = plain_leaf(r[0], r[1], r[2], r[3], r[4] + 1) if hit else plain_leaf(*r)
            for left, right in path:
                node = h(left, node, right)
            out.append((r[0], plain_leaf(*r), subroot, root, h(*(x + y for x, y in path)), node, node == root))
    return sorted(out, key=str)


def got_manifest(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_manifest_of_documents(spark, sf):
    want = plain_manifest(rows_of(sf))
    assert got_manifest(QUERIES["op11_merkle_manifest"](spark, sf)) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_of_odd_input(spark, fanout):
    assert got_manifest(merkle_manifest.audited(odd(spark), fanout)) == plain_manifest(ODD, fanout)
    assert merkle_manifest.audited(empty(spark), fanout).collect() == []


def test_a_single_row_is_its_own_root(spark):
    [r] = merkle_manifest.audited(odd(spark).filter("doc_id = 4")).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == h("") and r.verified


def test_a_hot_tree_is_dealt_over_tasks(spark, monkeypatch):
    rows = [(k // 3, "copy", "en" if k % 40 else "de", "s", 4) for k in range(3000)]  # equal ids and equal rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert got_manifest(merkle_manifest.audited(df)) == plain_manifest(rows)
    leaves = df.select(F.col("lang").alias("tree"), "doc_id", F.lit("n").alias("node"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny parts would be put together
    written, plain = [], merkle_manifest.materialise
    monkeypatch.setattr(merkle_manifest, "materialise", lambda df, label: written.append(plain(df, label)) or written[-1])
    try:
        numbers = merkle_manifest.numbered(leaves, "tree", "doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for tree, n in Counter("en" if k % 40 else "de" for k in range(3000)).items():
        mine = [r for r in numbers if r.tree == tree]
        assert sorted(r.idx for r in mine) == list(range(n)) and all(r["size"] == n for r in mine)
        assert [r.doc_id for r in sorted(mine, key=lambda r: r.idx)] == sorted(r.doc_id for r in mine)
    assert len(written[0].filter("tree = 'en'").select(F.input_file_name()).distinct().collect()) > 1


# divergence


def plain_divergences(rows, min_docs=30, top=50):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        total = Counter(t for d in mine for t in d[2])
        part = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        q, sources = part(total), sorted({d[1] for d in mine})
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in sources}
        p = {s: part(counts[s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            more = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for name, items, most in (("pair", pairs, len(pairs)), ("term", more, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, name, item, value, rank))
    return sorted(out)


def got_divergences(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergences_of_documents(spark, sf):
    got = got_divergences(source_divergence.divergences(spark.read.parquet(f"{sf}/documents.parquet"), min_docs=10, top=7))
    assert got == plain_divergences(rows_of(sf), 10, 7) and {r[2] for r in got} == {"pair", "term"}


@pytest.mark.parametrize("min_docs", [1, 2, 30])
def test_divergences_of_odd_input(spark, min_docs):
    more = [(k, t, "en", s, 0) for k, (t, s) in enumerate([("Same here", "other"), ("again", "third"), (None, "fourth")])]
    df = odd(spark).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    assert got_divergences(source_divergence.divergences(df, min_docs)) == plain_divergences([*ODD, *more], min_docs)
    assert source_divergence.divergences(empty(spark)).collect() == []


def test_many_blocks_give_the_same_sums(spark, sf, monkeypatch):
    monkeypatch.setattr(source_divergence, "BLOCK_CELLS", 50)
    got = got_divergences(source_divergence.divergences(spark.read.parquet(f"{sf}/documents.parquet"), min_docs=10))
    assert got == plain_divergences(rows_of(sf), 10)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB1 éİ漢", max_size=8), max_size=6))
def test_slices_are_terms(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    starts, ends, docs = source_divergence.term_slices(data, offsets)
    lowered = source_divergence._LOWER[data].tobytes()
    want = [(k, t) for k, text in enumerate(texts) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.replace("B", "b"))]
    assert [(k, lowered[s:e].decode()) for k, s, e in zip(docs.tolist(), starts, ends)] == want
    for digest in (len, lambda _: 0, source_divergence.xxhash.xxh3_64_intdigest):  # hashes that collide, and one that doesn't
        codes, terms = source_divergence.grouped_slices(lowered, starts, ends, digest)
        assert [terms[c].decode() for c in codes] == [t for _, t in want] and len(set(terms)) == len(terms)


# near duplicates


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + min(k, len(words))]) for i in range(len(words) - min(k, len(words)) + 1)} if words else set()


def plain_classes(rows, k, percent):
    """(doc_id, set size, component_id) of each row, by comparing all pairs that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            where[t].append(i)
    for pair in {(i, j) for x in where.values() for i in x for j in x if i < j}:
        i, j = pair
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def got_classes(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def test_minhash_of_documents(spark, sf):
    want = plain_classes([r[:2] for r in rows_of(sf)], 2, 80)
    assert got_classes(QUERIES["op13_bayes_minhash"](spark, sf)) == want
    assert any(d != c for d, _, c in want)


def test_minhash_of_odd_input(spark):
    assert got_classes(bayes_minhash.minhash_duplicates(odd(spark), 2, 80)) == plain_classes([r[:2] for r in ODD], 2, 80)
    assert bayes_minhash.minhash_duplicates(empty(spark), 2, 80).collect() == []
    with pytest.raises(ValueError):
        bayes_minhash.minhash_duplicates(empty(spark), 2, 49)


def families(seed):
    """Chains of edits, copies with few changes, and pages that share a passage and nothing else."""
    pick, texts = random.Random(seed), []
    word = lambda: f"w{pick.randrange(5000)}"
    chain = [word() for _ in range(60)]
    for _ in range(60):
        chain[pick.randrange(60)] = word()
        texts.append(" ".join(chain))
    copy = [word() for _ in range(80)]
    for _ in range(150):
        one = list(copy)
        for _ in range(pick.randrange(8)):
            one[pick.randrange(80)] = word()
        texts.append(" ".join(one))
    passage = [word() for _ in range(50)]
    texts += [" ".join([*(word() for _ in range(pick.randrange(5, 30))), *passage]) for _ in range(150)]
    return list(enumerate(pick.sample(texts, len(texts))))


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_minhash_of_families(spark, percent, monkeypatch):
    from lodestone.llm import signature_join

    monkeypatch.setattr(signature_join, "BLOCK", 16)  # buckets of many blocks
    rows = families(percent)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_classes(bayes_minhash.minhash_duplicates(df, 2, percent)) == plain_classes(rows, 2, percent)


def test_pages_with_a_common_passage_send_no_tokens(spark, monkeypatch):
    sent = []
    plain = bayes_minhash.wanted_sets
    monkeypatch.setattr(bayes_minhash, "wanted_sets", lambda documents, sets, ids, *rest: sent.append(ids.count()) or plain(documents, sets, ids, *rest))
    pick = random.Random(3)
    word = lambda: f"w{pick.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = [(k, " ".join([*(word() for _ in range(60)), *passage])) for k in range(1500)]
    out = bayes_minhash.minhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert len(out) == 1500 and all(r.kept for r in out)
    assert sum(sent) < 75, sent


def test_plan_misses_as_rarely_as_asked():
    steps = bayes_minhash.plan(80)
    assert (1 - 0.8**steps.rows) ** steps.bands <= bayes_minhash.MISS and steps.minima == steps.bands * steps.rows
    pick = np.random.default_rng(5)
    for similarity, least, most in ((0.8, 0.9999, 1), (0.9, 0.9999, 1), (0.5, 0, 0.01), (0.3, 0, 0)):
        equal = pick.random((4000, steps.minima)) < similarity
        x = np.zeros(equal.shape, dtype=np.uint16)
        n = np.full(4000, 100)
        kept = len(bayes_minhash.surviving(x, np.where(equal, 0, 1).astype(np.uint16), n, n, 80, steps.least)[0]) / 4000
        assert least <= kept <= most, (similarity, kept)


def test_minima_estimate_similarity():
    tokens = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64)
    functions = bayes_minhash.hash_functions(400)
    a, b = (bayes_minhash.minhash(x, functions) for x in (tokens[:2000], tokens[1000:]))
    assert abs(np.mean(a == b) - 1 / 3) < 0.08
    few = bayes_minhash.minhash(tokens[:3], functions)
    assert set(few.tolist()) <= {v for t in tokens[:3] for v in bayes_minhash.minhash(np.array([t]), functions).tolist()}
