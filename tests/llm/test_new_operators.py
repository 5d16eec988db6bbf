"""SimHash, periodic runs and the manifest against plain Python, on awkward rows and on real ones."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import manifest, queries, runs, simhash
from tests.llm.test_queries import LOWER, WORD, in_order

REAL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(odd_dir):
    """Folder and rows of documents: with awkward rows, and plain ones."""
    read = lambda d: pq.read_table(f"{d}/documents.parquet").select(["doc_id", "text", "lang", "source", "n_chars"]).to_pylist()
    return [(odd_dir, read(odd_dir)), (REAL, read(REAL))]


# SimHash


def fingerprint(text, k):
    found = [w.translate(LOWER) for w in WORD.findall(text or "")]
    shingles = [" ".join(found[i : i + k]) for i in range(max(len(found) - k + 1, 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints, radius):
    """Components of distinct fingerprints by comparing all pairs."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= radius:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def test_simhash_matches_all_pairs(spark, tables):
    for where, rows in tables:
        got = Counter(tuple(r) for r in queries.QUERIES["op11_simhash"](spark, where).collect())
        prints = [(r["doc_id"], fingerprint(r["text"], 4)) for r in rows]
        root = reachable({p for _, p in prints}, 4)
        least = {}
        for i, p in prints:
            if i is not None:
                least[root[p]] = min(i, least.get(root[p], i))
        assert got == Counter((i, f"{p:016x}", least.get(root[p])) for i, p in prints)


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_covering_masks_reach_every_choice_of_bits(radius):
    rng = random.Random(radius)
    masks = simhash.covering(0, radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        differs = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not m & differs for m in masks)
    for mask in masks[:4]:
        deeper = simhash.covering(mask, radius)
        assert all(m & mask == mask and m != mask for m in deeper)
        free = [b for b in range(64) if not mask >> b & 1]
        for _ in range(500):
            differs = sum(1 << b for b in rng.sample(free, radius))
            assert any(not m & differs for m in deeper)


def test_links_lose_nothing_where_keys_are_dealt_again(spark):
    """A dense family, scattered prints and single pairs, with a limit that the family's tables exceed."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    family = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))) for _ in range(400)}
    loose = {rng.getrandbits(64) for _ in range(300)}
    near = {p ^ sum(1 << b for b in rng.sample(range(64), 4)) for p in list(loose)[:50]}
    prints = family | loose | near
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "print long")
    want = reachable(prints, 4)
    for limit in (64, simhash.LIMIT):
        found = [r for t in simhash.links(frame, 4, limit) for r in t.collect()]
        root = {p: p for p in prints}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for r in found:
            a, b = r["src"] % (1 << 64), r["dst"] % (1 << 64)
            assert 0 < (a ^ b).bit_count() <= 4
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        assert {p: find(p) for p in prints} == want
    with pytest.raises(ValueError):
        simhash.links(frame, 4, 16)


def test_votes_of_long_texts():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    first = np.array([0, 0, 1, 3, 300, 1500, 1500])
    got = simhash.vote(hashes, first)
    for a, b, p in zip(first[:-1], first[1:], got, strict=True):
        own = [int(h) for h in hashes[a:b]]
        assert int(p) == sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in own) > len(own))


# Periodic runs


def runs_of(w, least=12):
    """Every stretch of every period, the smallest period of each by trying all."""
    out = set()
    n = len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, 2 * q) and not any(all(w[x] == w[x + p] for x in range(s, e - p)) for p in range(1, q)):
                out.add((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_runs_match_all_periods(spark, tables):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for where, rows in tables:
        got = Counter(tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, where).collect())
        want, skipped = Counter(), 0
        for r in rows:
            words = planted(r["doc_id"], WORD.findall(r["text"] or ""))
            if len(words) > 5000:
                skipped += 1
                continue
            found = runs_of(words)
            kept = [True] * len(words)
            for s, n, q in found:
                kept[s + q : s + n] = [False] * (n - q)
            best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=None)
            figures = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
            want[(r["doc_id"], len(found), *figures, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for w, k in zip(words, kept, strict=True) if k)))] += 1
        assert not want - got and sum(got.values()) - sum(want.values()) == skipped <= 2
        assert sum(k[1] for k in want) > 0


def test_runs_of_dense_texts():
    rng = random.Random(6)
    texts = [[rng.randrange(k) for _ in range(n)] for k in (1, 2, 3, 8) for n in (0, 1, 11, 12, 40, 90)]
    texts += [[0, 1] * 20 + [2] + [0, 1] * 9 + [3, 3] * 12, [0] * 30 + [1] + [0] * 30 + [1] + [0] * 30, ([0, 0, 1] * 8 + [2]) * 3]
    arrays = [np.array(t, np.int64) for t in texts]
    for t, w, c in zip(texts, arrays, runs.lag_counts(arrays), strict=True):
        assert c.tolist() == [0] + [sum(t[i] == t[i + q] for i in range(len(t) - q)) for q in range(1, len(t) // 2 + 1)]
        assert runs.find(w, c) == runs_of(t)


def test_heavy_words_are_counted_exactly(monkeypatch):
    rng = np.random.default_rng(7)
    texts = [rng.choice(40, 3000, p=np.arange(40, 0, -1) / 820), rng.integers(0, 2, 1500), np.tile(np.arange(7), 300)]
    wanted = [[0] + [int((w[:-q] == w[q:]).sum()) for q in range(1, len(w) // 2 + 1)] for w in texts]
    assert [c.tolist() for c in runs.lag_counts(texts)] == wanted
    monkeypatch.setattr(runs, "_OFTEN", 10**12)  # all light
    assert [c.tolist() for c in runs.lag_counts(texts)] == wanted


def test_long_repetitive_texts_end_soon():
    for w in (np.zeros(200_000, np.int64), np.arange(200_000) % 3, np.random.default_rng(8).integers(0, 2, 60_000)):
        found = runs.find(w, runs.lag_counts([w])[0])
        assert found
    assert runs.find(np.zeros(200_000, np.int64), runs.lag_counts([np.zeros(200_000, np.int64)])[0]) == [(0, 200_000, 1)]


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([(1, "x y " * 10, "a", "own"), (2, None, None, "own")], "id long, text string, runs string, tag string")
    got = {r["id"]: r for r in runs.periodic(rows).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 20, 2)] and got[1]["collapsed"] == "x y" and got[1]["tag"] == "own"
    assert got[2]["runs"] == [] and got[2]["collapsed"] == ""


# Manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    parts = (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)
    return H(*("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def proofs(nodes):
    """(root, path of each node) of the tree of three children a node."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        groups = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for n, path in enumerate(paths):
            group, own = groups[at[n] // 3], at[n] % 3
            path.append(("".join(group[:own]), "".join(group[own + 1 :])))
            at[n] //= 3
        nodes = [H(*g) for g in groups]
    return nodes[0], paths


def manifest_of(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: proofs([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, upper = proofs([trees[s][0] for s in names])
    for s, above in zip(names, upper, strict=True):
        for (_, _, leaf, r), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            gone = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            node = leaf_of(r, r["text"].replace("\n", "")) if gone and r["text"] is not None else leaf
            for left, right in path + above:
                node = H(left, node, right)
            yield r["doc_id"], leaf, trees[s][0], root, H(*(a + b for a, b in path + above)), node, node == root


def test_manifest_matches_plain_trees(spark, tables):
    for where, rows in tables:
        got = queries.QUERIES["op13_manifest"](spark, where).collect()
        assert in_order(got) == in_order(manifest_of(rows))
        assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_of_many_blocks_and_sources(spark, levels):
    """Tiers of small blocks, a source of most rows, sources of one row, sources in bytewise order."""
    rows = [{"doc_id": i, "source": s, "lang": None, "n_chars": i, "text": f"t{i}\n"} for i, s in enumerate([*["hot"] * 200, *(f"s{j}" for j in range(30)), "é", "Z", None, None, "", *["ten"] * 10])]
    frame = spark.createDataFrame([tuple(r[c] for c in manifest.COLUMNS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    found = manifest.manifest(frame, levels=levels).withColumn("back", manifest.fold("path", F.col("leaf")))
    siblings = lambda path: H(*(s["left"] + s["right"] for s in path))
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], siblings(r["path"])) for r in found.collect()]
    assert in_order(got) == in_order(r[:5] for r in manifest_of(rows))
    assert found.filter("back <> root").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 81])
def test_traversal_gives_the_paths_of_the_whole_block(n):
    leaves = [H(str(i)) for i in range(n)]
    root, want = proofs(leaves)
    height = len(want[0])
    assert list(manifest.traverse(leaves, height)) == want and manifest.block_root(leaves, height) == root


@pytest.mark.parametrize("name", ["op11_simhash", "op12_periodic_runs", "op13_manifest"])
def test_reruns_agree(spark, name):
    once, again = (queries.QUERIES[name](spark, REAL).collect() for _ in range(2))
    assert in_order(once) == in_order(again)
